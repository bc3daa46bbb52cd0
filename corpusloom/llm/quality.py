"""Quality classifier by importance resampling.

Two generative models over hashed n-grams - of target text (labelled good and not toxic) and of all raw text - give each
document a log importance weight: the sum over its n-grams of log(target rate / raw rate). Documents are drawn without
replacement, each in proportion to its weight, by Gumbel top-k: the k largest of  log weight + Gumbel noise  (``TEMPERATURE``
scales the noise; 1 is the sampling itself). The noise is a function of the seed and the doc_id, so reruns agree. The target
size k may be given as a share of the documents (``share``); else it is the number of documents whose weight reaches the
threshold that best separates the labelled documents (a false rejection counts ``CAUTION`` times a miss), so that clean
documents stay. A third of the labelled documents, by a hash of their ids, are kept out of the target model and set the
threshold.

The raw model counts every document, the target model a bounded sample of the labelled ones (``LABELS``); both models have ``BUCKETS`` counts, which bounds what the driver
holds. Rates are smoothed towards the raw model by ``PRIOR`` expected counts: a bucket the target has too little of to
tell weighs nothing. Tokens are words and runs of signs; any ``orders`` of n-grams may be asked for. On held-out labels order
1 separated best (README): pairs add more of the common weight of clean text than evidence against a few bad words.

The k-th largest key is found by histograms of 1024 bins, each pass inside one bin of the last, not by a sort.

Cases: null and empty texts have log weight 0; very long texts are read whole, in slices; without labels or without target
text every document is kept; documents equal to the k-th key are all kept; rows with equal doc_ids and texts share a key;
null doc_ids share one noise; extra columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as T
from corpusloom.llm.license import IS_WORD
from corpusloom.llm.shared import stage

BUCKETS, PRIOR, TEMPERATURE, CAUTION, ORDERS, SEED = 1 << 18, 1.0, 1.0, 8.0, (1,), 11
#: At most about so many labelled documents fit the target model and set the threshold.
LABELS = 40_000
#: Keys and thresholds are compared in multiples of 1/GRID.
GRID = 1 << 16


def ngrams(data: np.ndarray, off: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of a slice of texts. Tokens are runs of letters and digits, and runs of other signs."""
    low = T.LOWER[data]
    word = IS_WORD[low]
    start, end, row = (np.concatenate(x) for x in zip(T.spans(word, off), T.spans(~word & ~T.SPACE[low], off)))
    order = np.argsort(start, kind="stable")
    start, end, row = start[order], end[order], row[order]
    h = T.span_hashes(low, start, end)
    rows, buckets = [], []
    for n in orders:
        k = len(h) - n + 1
        if k > 0:
            key = np.zeros(k, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    key = T.mix(key + h[i : i + k])
            inside = row[:k] == row[n - 1 :]
            rows.append(row[:k][inside])
            buckets.append((key[inside] % np.uint64(BUCKETS)).astype(np.int64))
    z = np.zeros(0, dtype=np.int64)
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (z, z)


def _counter(orders):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, np.ndarray] = {}
        for b in batches:
            data, off = T.buffers(b.column("text"))
            good = np.asarray(b.column("good").to_numpy(zero_copy_only=False), dtype=bool)
            for lo, hi, part, o in T.slices(data, off):
                row, bucket = ngrams(part, o, orders)
                for model, chosen in ((False, bucket), (True, bucket[good[lo:hi][row]])):
                    held[model] = held.get(model, 0) + np.bincount(chosen, minlength=BUCKETS)
        for model, n in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), model)), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["target", "bucket", "n"])

    return count


def label_sample(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """doc_id and good of about ``most`` labelled documents at most, by a hash of the id; of several labels the worst counts.
    Bounded by ``most``, so it is broadcast, and texts stay where they are."""
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    ids = known.agg(F.approx_count_distinct("doc_id").alias("n")).first()["n"]
    taken = known.where(F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(max(1, -(-ids // most)))) == 0)
    return F.broadcast(taken.groupBy("doc_id").agg(F.min(good).alias("good")))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with good: true, false or (without a label in the sample) null."""
    return docs.join(label_sample(labels), "doc_id", "left")


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(3)) == 0


def fit(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = ORDERS) -> np.ndarray | None:
    """The log ratio of each bucket; None without target text."""
    marked = _labelled(docs.select(F.col("doc_id").cast("long"), "text"), labels).select("text", (F.coalesce("good", F.lit(False)) & ~_held_out()).alias("good"))
    counts = marked.mapInArrow(_counter(orders), "target boolean, bucket int, n long").groupBy("target", "bucket").agg(F.sum("n").alias("n"))
    model = {False: np.zeros(BUCKETS), True: np.zeros(BUCKETS)}
    for target, part in counts.toPandas().groupby("target"):  # at most twice BUCKETS rows
        model[bool(target)][part["bucket"]] = part["n"]
    if not model[True].sum():
        return None
    expected = model[False] * (model[True].sum() / model[False].sum())
    return np.log((model[True] + PRIOR) / (expected + PRIOR)).astype(np.float32)


def weight(ratios: np.ndarray, orders: tuple[int, ...] = ORDERS):
    """A column function: the log importance weight of a text."""

    @F.arrow_udf("double")  # texts stay in Arrow buffers: no Python strings are made
    def of(texts: pa.Array) -> pa.Array:
        data, off = T.buffers(texts)
        out = np.zeros(len(texts))
        for lo, hi, part, o in T.slices(data, off):
            row, bucket = ngrams(part, o, orders)
            out[lo:hi] = np.bincount(row, ratios[bucket].astype(np.float64), minlength=hi - lo)
        return pa.array(out)

    return of


def _key(score: Column, seed: int = SEED) -> Column:
    """Log weight plus Gumbel noise, as a multiple of 1/GRID."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), 11).cast("double") + 0.5) / float(1 << 53)
    return F.round((score - F.lit(TEMPERATURE) * F.log(-F.log(unit))) * GRID).cast("long")


def threshold(scored: DataFrame) -> float | None:
    """The weight that best separates good from other labelled documents; None if one kind is missing."""
    bins = scored.where(F.col("good").isNotNull() & _held_out()).groupBy("good", (F.round(F.asinh("score") * 50) / 50).alias("bin")).count().toPandas()  # some 2,000 rows, whatever the scores: bins widen with them
    good, bad = bins[bins["good"]], bins[~bins["good"].astype(bool)]
    if not len(good) or not len(bad):
        return None
    cuts = np.sort(bins["bin"].unique()) + 0.01
    lost = np.array([good.loc[good["bin"] < c, "count"].sum() for c in cuts]) / good["count"].sum()
    missed = np.array([bad.loc[bad["bin"] >= c, "count"].sum() for c in cuts]) / bad["count"].sum()
    cost = CAUTION * lost + missed
    best = int(np.argmin(cost))
    return float(np.sinh(cuts[best])) if cost[best] < 1.0 else None


def kth_largest(keys: DataFrame, k: int, bins: int = 1024) -> int | None:
    """The k-th largest value of the column ``key`` (long)."""
    ends = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not ends[2] or k <= 0:
        return None
    lo, hi = ends[0], ends[1]
    k = min(k, ends[2])
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)
        rows = keys.where(f"key between {lo} and {hi}").groupBy(F.floor((F.col("key") - lo) / width).cast("long").alias("b")).count().collect()  # at most ``bins`` rows
        for b, n in sorted(((r["b"], r["count"]) for r in rows), reverse=True):
            if k <= n:
                lo, hi = lo + b * width, min(hi, lo + b * width + width - 1)
                break
            k -= n
    return lo


class Classifier:
    """Fitted on ``docs`` and ``labels``. ``verdict`` is a column over doc_id and text; ``scored`` holds all weights; ``size``
    is k, ``cut`` the k-th key."""

    def __init__(self, docs: DataFrame, labels: DataFrame, share: float | None = None, orders: tuple[int, ...] = ORDERS) -> None:
        self.ratios = fit(docs, labels, orders)
        self.cut = self.scored = self.size = None
        if self.ratios is not None:
            self.of = weight(self.ratios, orders)
            scored = docs.select(F.col("doc_id").cast("long"), self.of("text").alias("score"))
            self.scored = stage(_labelled(scored, labels).withColumn("key", _key(F.col("score"))), "scored")
            at = threshold(self.scored) if share is None else None
            if share is not None:
                self.size = round(share * self.scored.count())
            elif at is not None:
                self.size = self.scored.where(F.col("score") >= at).count()
            if self.size is not None:
                self.cut = kth_largest(self.scored, self.size) if self.size else 1 << 62  # k of 0 keeps nothing

    def verdict(self) -> Column:
        return F.lit(True) if self.cut is None else _key(self.of("text")) >= self.cut


def judged(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key, kept of every document."""
    c = Classifier(docs, labels, share)
    if c.scored is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("sample_key"), F.lit(True).alias("kept"))
    return c.scored.select("doc_id", F.col("score").alias("log_weight"), (F.col("key") / GRID).alias("sample_key"), (F.lit(True) if c.cut is None else F.col("key") >= c.cut).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """``docs`` without the rejected rows, with all columns."""
    return docs.where(Classifier(docs, labels, share).verdict())
