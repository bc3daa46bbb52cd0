"""Quality rules: document statistics, two fixed rules, and robust multivariate outliers per language and source.

Each document gets a vector of transformed statistics. Per (lang, source), per lang and over all documents the
minimum-covariance-determinant estimate is found: from several starts - medians and median deviations, and small random
subsets - concentration steps keep the ``KEEP`` share of documents with the smallest Mahalanobis distance and estimate
again; after ``SHORT`` steps the start with the least determinant goes on for ``LONG`` more. Its covariance is made
consistent for a Gaussian by the usual factor. All groups, levels and starts share each pass.

One formula settles small groups: an estimate counts as many documents as it has, and ``PSEUDO`` more are taken from the
level above (for all documents, from a wide prior around their own mean). A document whose squared distance under the
estimate of its language and source exceeds ``CUT`` is rejected.

Every step is an aggregation over all documents: statistics are kept as integers (multiples of 1/GRID), so sums are
exact and reruns agree whatever the task order, and quantiles are taken over a grid, so their state is bounded. The scale
of each statistic has a floor, so a group of nearly equal documents does not reject small departures.

Cases: null or empty text has no words (and fails the base rule); null languages and sources are groups of their own;
null ids are judged like others; repeated rows are each judged; documents tied at a quantile are all kept in its core, a
distance of exactly the cut stays; whole texts of any length are read; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as T
from corpusloom.llm.shared import stage

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
GRID, KEEP, STARTS, SHORT, LONG = 1024, 0.75, 4, 2, 2
#: Documents of a random start, about; documents taken from the level above; the prior's scale in floors.
SUBSET, PSEUDO, WIDE = 24, 40, 4.0
#: Documents of a part of a group, about. What a group has to know goes to each of its parts, so that a join never gathers a
#: group (the one of all documents is the largest) and every aggregation is combined before it is shuffled.
PART = 100_000
#: Names and floors (in units of the statistic) of the statistics.
FEATURES = {"f_length": 0.9, "f_word": 0.35, "f_symbol": 0.03, "f_repeat": 0.12, "f_lines": 0.12, "f_distinct": 0.08}
#: Squared distance beyond which a document is an outlier. Wide (a Gaussian of 6 statistics stays below 45 but for one in
#: ten million), as lengths have heavy tails; pipe tables, symbol noise and word lists lie beyond 140.
CUT = 94.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id",)] + [("lang", pa.string()), ("source", pa.string())] + [(c, pa.int64()) for c in (*COUNTS, "n_distinct", "n_lines")])


def _repeated(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where (row, key) occurs twice or more."""
    both = T.mix(keys ^ T.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = np.zeros(len(s), dtype=bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), dtype=bool)
    out[order] = same
    return out


def _not_first(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where (row, key) occurred before."""
    both = T.mix(keys ^ T.mix(rows.astype(np.uint64) + np.uint64(1)))
    out = np.ones(len(both), dtype=bool)
    out[np.unique(both, return_index=True)[1]] = False
    return out


def counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each row of a slice of texts."""
    n = len(off) - 1
    member = ~T.SPACE[data]
    start, end, row = T.spans(member, off)
    per = lambda r, **k: np.bincount(r, minlength=n, **k).astype(np.int64)
    out = {"n_words": per(row), "word_chars": T.row_sums(member & ((data & 0xC0) != 0x80), off), "n_symbols": T.row_sums(_SYMBOL[data], off)}
    h = T.span_hashes(data, start, end)
    out["n_distinct"] = per(row[~_not_first(row, h)])
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) >= WINDOW:
        k = len(h) - WINDOW + 1
        key = np.zeros(k, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(WINDOW):
                key = T.mix(key + h[i : i + k])
        inside = np.flatnonzero(row[:k] == row[WINDOW - 1 :])
        twice = inside[_repeated(row[inside], key[inside])]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = per(row[np.cumsum(covered[:-1]) > 0])
    line_start, line_end, line_row = T.spans(data != 0x0A, off)
    words = np.searchsorted(start, line_end) - np.searchsorted(start, line_start) > 0
    line_start, line_end, line_row = line_start[words], line_end[words], line_row[words]
    again = _not_first(line_row, T.span_hashes(data, line_start, line_end))
    return out | {"n_dup_lines": per(line_row[again]), "n_lines": per(line_row)}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = T.buffers(b.column("text"))
        for lo, hi, part, o in T.slices(data, off):
            kept = [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang", "source")]
            got = counts(part, o)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(kept, _SCHEMA)] + [pa.array(got[c]) for c in _SCHEMA.names[3:]], schema=_SCHEMA)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    kind = {pa.int64(): "long", pa.string(): "string"}
    d = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return d.mapInArrow(_count_batches, ", ".join(f"{f.name} {kind[f.type]}" for f in _SCHEMA))


def _vectors(stats: DataFrame) -> DataFrame:
    """Statistics as integers, in multiples of 1/GRID."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    made = {
        "f_length": F.log(words + 1.0), "f_word": F.log(chars / words) * 2, "f_symbol": F.sqrt(F.col("n_symbols") / chars),
        "f_repeat": F.asin(F.sqrt(F.col("n_repeat_words") / words)), "f_lines": F.asin(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
        # the share of distinct words falls with the length; this exponent takes most of that out
        "f_distinct": F.log(F.greatest(F.col("n_distinct"), F.lit(1))) - 0.85 * F.log(words),
    }
    return stats.withColumns({k: F.round(v * GRID).cast("long") for k, v in made.items()})


def _chi2(x: float, d: int) -> float:
    """Distribution function of chi-squared with an even number of degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(d // 2))


def consistency(share: float, d: int) -> float:
    """What the covariance of the ``share`` nearest of a Gaussian has to be multiplied by."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, d) < share else (lo, mid)
    return share / _chi2(lo, d + 2)


_D = len(FEATURES)
_I, _J = np.triu_indices(_D)
_FLOOR = np.array(list(FEATURES.values())) ** 2
_EST = "g string, start int, n long, mean array<double>, cov array<double>, inv array<double>, logdet double"


def _square(packed: np.ndarray) -> np.ndarray:
    c = np.zeros((_D, _D))
    c[_I, _J] = c[_J, _I] = packed
    return c


def _estimate(scale: float):
    """Mean, covariance (with floors), its inverse and determinant, from sums."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in groups:
            rows = []
            for g, start, n, s1, s2 in zip(b["g"], b["start"], b["n"], b["s1"], b["s2"]):
                mean = np.asarray(s1, dtype=float) / GRID / n
                c = _square(scale * (np.asarray(s2, dtype=float) / GRID**2 / n - mean[_I] * mean[_J])) + np.diag(_FLOOR)
                rows.append((g, start, n, mean, c[_I, _J], np.linalg.inv(c)[_I, _J], np.linalg.slogdet(c)[1]))
            yield pd.DataFrame(rows, columns=["g", "start", "n", "mean", "cov", "inv", "logdet"])

    return run


def _distance() -> Column:
    names, terms, k = list(FEATURES), [], 0
    dev = [F.col(f) / GRID - F.col("mean")[i] for i, f in enumerate(names)]
    for i in range(len(names)):
        for j in range(i, len(names)):
            terms.append(dev[i] * dev[j] * F.col("inv")[k] * (1.0 if i == j else 2.0))
            k += 1
    return sum(terms[1:], terms[0])


def _moments(v: DataFrame, scale: float) -> DataFrame:
    names = list(FEATURES)
    pairs = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    sums = v.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(a)) for a in names]).alias("s1"), F.array(*pairs).alias("s2"))
    return sums.mapInPandas(_estimate(scale), _EST)


def _to_parts(known: DataFrame, parts: DataFrame) -> DataFrame:
    """What is known of groups, once for every part."""
    return known.join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _middle(v: DataFrame, parts: DataFrame) -> DataFrame:
    """The first start: medians, and median absolute deviations as a diagonal covariance; n counts the whole group."""
    names = list(FEATURES)
    mid = stage(v.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(f, F.lit(0.5)).alias(f"m_{f}") for f in names]), "mcd-medians")
    spread = v.join(_to_parts(mid.drop("n"), parts), ["g", "part"]).groupBy("g").agg(*[F.percentile(F.abs(F.col(f) - F.col(f"m_{f}")), F.lit(0.5)).alias(f"d_{f}") for f in names])
    diag = []
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            scale = F.pow(F.col(f"d_{a}") * 1.4826 / GRID, 2) + F.lit(FEATURES[a] ** 2)
            diag.append(F.lit(1.0) / scale if i == j else F.lit(0.0))
    return mid.join(spread, "g").select("g", F.lit(0).alias("start"), "n", F.array(*[F.col(f"m_{f}") / GRID for f in names]).alias("mean"), F.array(*diag).alias("inv"))


def _concentrated(v: DataFrame, parts: DataFrame, est: DataFrame, step: str) -> DataFrame:
    """One concentration step of every group and start."""
    far = lambda e: v.join(_to_parts(e, parts), ["g", "part"]).withColumn("q", F.round(F.log(_distance() + 0.01) * 64).cast("long")).drop("mean", "inv")
    est = est.select("g", "start", "mean", "inv")
    # the share is of the group's documents: ties at the quantile all stay
    most = stage(far(est).groupBy("g", "start").agg(F.percentile("q", F.lit(KEEP)).alias("most")), f"mcd-cut-{step}")
    return stage(_moments(far(est.join(most, ["g", "start"])).where("q <= most"), consistency(KEEP, _D)), f"mcd-{step}")


def _key(*columns: str) -> Column:
    """A group as text; null is a value of its own, and no two groups share a text."""
    named = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), F.col(c)), F.lit("null")) for c in columns]
    return F.concat_ws("/", F.lit(str(len(columns))), *named)


def estimates(v: DataFrame) -> DataFrame:
    """g, n, mean, cov, logdet of every group of all three levels. ``v``: lang, source and the statistics."""
    names = list(FEATURES)
    v = v.select(F.explode(F.array(_key("lang", "source"), _key("lang"), _key())).alias("g"), F.xxhash64("doc_id", *names).alias("id"), *names)
    parts = stage(v.groupBy("g").agg((F.floor(F.count(F.lit(1)) / PART) + 1).cast("int").alias("parts")), "mcd-parts")
    v = stage(v.join(parts, "g").withColumn("part", F.pmod("id", F.col("parts")).cast("int")).drop("parts"), "mcd-rows")
    first = stage(_middle(v, parts), "mcd-0")
    # subsets by a hash of the document: about SUBSET documents of each group, others for each start
    some = v.join(_to_parts(first.select("g", F.greatest(F.lit(1), F.floor(F.col("n") / SUBSET)).alias("one_in")), parts), ["g", "part"]).withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(1, STARTS)])))
    seeds = _moments(some.where(F.pmod(F.xxhash64("start", "id"), F.col("one_in")) == 0), 1.0)
    est = stage(first.select("g", "start", "mean", "inv").unionByName(seeds.select("g", "start", "mean", "inv")), "mcd-starts")
    for step in range(SHORT):
        est = _concentrated(v, parts, est, f"short{step}")
    # the least determinant, then the first start
    est = est.groupBy("g").agg(F.min(F.struct("logdet", "start", "mean", "inv")).alias("b")).select("g", "b.*")
    for step in range(LONG):
        est = _concentrated(v, parts, est, f"long{step}")
    return est.drop("n", "inv").join(first.select("g", "n"), "g").select("g", "n", "mean", "cov", "logdet")


def _pooled(n: float, mean, cov, other_mean, other_cov):
    """``n`` documents of one estimate and PSEUDO of another as one."""
    w = n / (n + PSEUDO)
    gap = mean - other_mean
    return w * mean + (1 - w) * other_mean, w * cov + (1 - w) * other_cov + w * (1 - w) * np.outer(gap, gap)


def _shrunk(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in rows:
        out = []
        for r in b.itertuples(index=False):
            level = lambda e: (e["n"], np.asarray(e["mean"], dtype=float), _square(np.asarray(e["cov"], dtype=float)))
            own, lang, everything = level(r.e0), level(r.e1), level(r.e2)
            mean, cov = _pooled(*everything, everything[1], np.diag(_FLOOR) * WIDE**2)
            mean, cov = _pooled(*own, *_pooled(*lang, mean, cov))
            out.append((r.g, mean, np.linalg.inv(cov)[_I, _J]))
        yield pd.DataFrame(out, columns=["g", "mean", "inv"])


def _settled(est: DataFrame, groups: DataFrame) -> DataFrame:
    """g, mean, inv for every (lang, source), with the levels above mixed in."""
    packed = est.select("g", F.struct("n", "mean", "cov").alias("e"))
    for i in range(3):
        groups = groups.join(packed.withColumnsRenamed({"g": f"g{i}", "e": f"e{i}"}), f"g{i}")
    return groups.select(F.col("g0").alias("g"), "e0", "e1", "e2").mapInPandas(_shrunk, "g string, mean array<double>, inv array<double>")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared; null in groups without a document of enough words) and kept."""
    v = stage(_vectors(statistics(docs)), "rules")
    usable = v.where(f"n_words >= {MIN_WORDS}")
    groups = usable.select(_key("lang", "source").alias("g0"), _key("lang").alias("g1"), _key().alias("g2")).distinct()
    settled = stage(_settled(stage(estimates(usable), "mcd"), groups), "settled")
    out = v.withColumn("g", _key("lang", "source")).join(settled, "g", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("distance", F.when(F.col("mean").isNotNull(), _distance()))
    return out.select("doc_id", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))).alias("kept"))
