"""Near-duplicate documents: a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every document gets the set of its distinct word shingles (64-bit hashes), a fingerprint of the set and a MinHash
   signature; a coordinate and its value make a token. Documents with equal sets become one node.
2. Tokens are posted: one list of documents for each coordinate and value. A pair counts if it collides in at least
   ``MATCHES`` of ``COORDINATES`` coordinates; a pair at the wanted similarity fails that with a probability below 1e-6
   (binomial tail). A list of one document collides with nothing, so a document in fewer than ``MATCHES`` longer lists drops
   out. Only the prefix of a document is merged: all but its MATCHES - 1 longest lists. Two documents that collide often
   enough share a list of their prefixes; the long lists are skipped and looked into for pairs that met.
3. Each list has a pivot: its member with the most company in its lists (of near copies of one text, the one nearest to
   that text). The members of all lists of a pivot form its block; two documents that share a list share a block.
   First every member meets its pivot: collisions are counted, pairs above the threshold confirmed on full sets, components
   of the links found. A group of thousands of near copies costs work in proportion to its size so far.
4. Only members of a block that lie in different components still have to meet. A block is dealt into parts, and each two
   parts meet in a task: posting lists of the prefixes are merged there, documents that met are looked up in each
   other's long lists, those above the threshold are confirmed on full sets by merging lists of shingles. A task emits a
   spanning set of its links, no pairs.
5. Components of all confirmed links give each document its class.

Parts are bounded by rows and by shingles (``ROWS``, ``SHINGLES``); a block that stays in several components costs work that
grows with the square of its number of parts. Nothing is dropped for it.

Cases: null or empty texts have an empty set and are linked with nothing; texts with fewer words than a shingle have
their whole sequence as one; very long texts are read whole, in slices; documents without an id take no part (component
null, kept); repeated rows fall into one class; rows that share a doc_id count as one document, linked with all that
one of its texts is; a similarity of exactly the threshold links; of members tied for pivot the smaller id is it;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as T
from corpusloom.llm.graph import components
from corpusloom.llm.shared import stage

COORDINATES, MATCHES, ROWS, SHINGLES = 48, 24, 256, 1 << 20
PERCENT = 80
_RNG = np.random.default_rng(97)
_A = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a slice of texts."""
    low = T.LOWER[data]
    start, end, row = T.spans(~T.SPACE[low], off)
    h = T.span_hashes(low, start, end)
    first = np.searchsorted(row, np.arange(len(off)))
    k = max(0, len(h) - width + 1)
    key = np.zeros(k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            key = T.mix(key + h[i : i + k])
        out = []
        for i in range(len(off) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                out.append(np.unique(key[a : b - width + 1]))
            elif b > a:
                whole = np.full(1, 0x5EED + int(b - a), dtype=np.uint64)
                for j in range(a, b):
                    whole = T.mix(whole + h[j])
                out.append(whole)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One token per coordinate: a hash of the coordinate and its minimum."""
    with np.errstate(over="ignore"):
        low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 4096):
            low = np.minimum(low, (shingles[at : at + 4096, None] * _A + _B).min(axis=0))
        return T.mix(low + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.buffers(b.column("text"))
            for lo, hi, part, o in T.slices(data, off):
                sets = shingle_sets(part, o, width)
                prints = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
                tokens = [signature(s).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(tokens, _SCHEMA.field(4).type)], schema=_SCHEMA)

    return sign


_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.buffers(b.column("text"))
            for lo, hi, part, o in T.slices(data, off):
                found = pa.array([s.view(np.int64) for s in shingle_sets(part, o, width)], _SETS.field(1).type)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), found], schema=_SETS)

    return sets


class _Lists:
    """Posting lists of rows of values: which rows hold a value."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.size = np.array([len(r) for r in rows], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = np.unique(np.concatenate(rows), return_inverse=True)[1]
        self.holder = np.repeat(np.arange(len(rows)), self.size)[np.argsort(self.ids, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.ids))])

    def merged(self, row: int) -> np.ndarray:
        """For each row, the number of values it shares with this one."""
        mine = self.ids[self.at[row] : self.at[row + 1]]
        lo, count = self.first[mine], self.first[mine + 1] - self.first[mine]
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.bincount(self.holder[where], minlength=len(self.size))

    def common(self, row: int, others: np.ndarray) -> np.ndarray:
        """The same for chosen rows, by looking up their values."""
        mine = np.zeros(len(self.first), dtype=bool)
        mine[self.ids[self.at[row] : self.at[row + 1]]] = True
        return np.array([mine[self.ids[self.at[j] : self.at[j + 1]]].sum() for j in others.tolist()], dtype=np.int64)


def _linker(percent: int):
    """Confirmed links between two parts of a block, or inside one, that tie components: a spanning set (a, b)."""

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node, part, inside = rows["node"].to_numpy(), rows["part"].to_numpy(), key[1] == key[2]
        tokens = list(rows["tokens"])
        short, full, sets = _Lists([t[: len(t) - MATCHES + 1] for t in tokens]), _Lists(tokens), _Lists(list(rows["shingles"]))
        names, group = np.unique(rows["class"].to_numpy(), return_inverse=True)
        n, out = sets.size, []
        for i in range(len(rows)) if inside else np.flatnonzero(part == key[1]).tolist():
            near = (short.merged(i) > 0) & (group != group[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            near &= np.arange(len(rows)) > i if inside else part != part[i]
            near = np.flatnonzero(near)
            near = near[full.common(i, near) >= MATCHES]
            if not len(near):
                continue
            shared = sets.merged(i)[near]
            for j in near[100 * shared >= percent * (n[i] + n[near] - shared)].tolist():
                if group[i] != group[j]:
                    out.append((node[i], node[j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return link


def _postings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, company, tokens) of the documents that can collide, tokens with the shortest list first; (node, token,
    company) of their prefixes."""
    posted = nodes.select("node", F.explode("tokens").alias("token"))
    # written first: with two plain exchanges below the join, adaptive execution can split a token with very many rows
    often = stage(posted.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1"), "tokens")
    ordered = posted.join(often, "token").groupBy("node").agg(F.sum("length").alias("company"), F.sort_array(F.collect_set(F.struct("length", "token"))).alias("t"))
    signs = ordered.where(F.size("t") >= MATCHES).select("node", "company", F.col("t.token").alias("tokens"))
    signs = stage(signs.join(nodes.select("node", "n"), "node"), "signs")
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1))
    return signs, signs.select("node", "n", "company", F.explode(prefix).alias("token"))


def _blocks(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pivot, parts) of the blocks; (pivot, node, part) of their members, the pivots themselves aside."""
    rank = F.struct("company", (-F.col("node")).alias("low"))
    pivots = prefix.groupBy("token").agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("length")).where("length > 1")
    pivots = stage(pivots.select("token", (-F.col("r.low")).alias("pivot")), "pivots")
    member = stage(prefix.join(pivots, "token").where("node != pivot").select("pivot", "node", "n").distinct(), "members")
    load = F.greatest(F.ceil(F.count(F.lit(1)) / ROWS), F.ceil(F.sum("n") / SHINGLES))
    blocks = stage(member.groupBy("pivot").agg(load.cast("int").alias("parts")), "blocks")
    member = member.join(blocks, "pivot").select("pivot", "node", "n", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    return blocks, member


def _starred(member: DataFrame, blocks: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of members with their pivots. A pivot goes once to every part of its block, so none is a hot key."""
    # written first: the parts of a pivot are few rows, yet a pivot may have very many
    hub = stage(blocks.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "hubs")
    hub_of = lambda d, c: hub.join(d, "node").select(F.col("node").alias("pivot"), "part", *[F.col(x).alias(f"p_{x}") for x in c])
    met = member.join(signs.select("node", "tokens"), "node").join(hub_of(signs, ["n", "tokens"]), ["pivot", "part"])
    met = met.where((100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")) & (F.size(F.array_intersect("tokens", "p_tokens")) >= MATCHES))
    met = stage(met.select("pivot", "part", "node"), "met")
    both = met.join(sets, "node").join(hub_of(sets, ["shingles"]), ["pivot", "part"]).withColumn("common", F.size(F.array_intersect("shingles", "p_shingles")))
    alike = 100 * F.col("common") >= percent * (F.size("shingles") + F.size("p_shingles") - F.col("common"))
    return both.where(alike).select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def _parted(member: DataFrame, blocks: DataFrame, signs: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between members of a block that lie in different components."""
    named = member.join(classes, "node", "left").select("pivot", "node", "part", F.coalesce("label", "node").alias("class"))
    named = stage(named, "named")
    mixed = stage(named.groupBy("pivot").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").join(blocks, "pivot").select("pivot", "parts"), "mixed")
    rows = stage(named.join(mixed, "pivot"), "rows").join(signs.select("node", "tokens"), "node").join(sets, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("pivot", "node", "class", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "tokens", "shingles")
    return rows.groupBy("pivot", "one", "two").applyInPandas(_linker(percent), "a long, b long")


def clusters(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stage(texts.mapInArrow(_signer(width), "doc_id long, n_shingles long, fa long, fb long, tokens array<long>"), "signed")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    nodes = stage(usable.groupBy("fa", "fb").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min_by("tokens", "doc_id").alias("tokens")), "nodes")
    signs, prefix = _postings(nodes)
    blocks, member = _blocks(prefix)
    tied = member.select(F.col("node").alias("doc_id")).union(blocks.select("pivot")).distinct()
    # only ids are hashed on their side; texts are neither sorted nor aggregated
    read = texts.where("text is not null").join(tied.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = stage(read.mapInArrow(_setter(width), "node long, shingles array<long>"), "sets")
    # distinct gathers the few links into few files; the join above has a partition for each share of the sets
    links = stage(_starred(member, blocks, signs, sets, percent).distinct(), "links")
    more = _parted(member, blocks, signs, sets, components(links), percent)
    classes = components(links.union(more)).select("node", F.col("label").alias("component"))
    named = nodes.select("fa", "fb", "node").join(classes, "node", "left").select("fa", "fb", F.coalesce("component", "node").alias("component"))
    own = (F.col("doc_id").isNotNull()) & (F.col("n_shingles") > 0)
    out = signed.drop("tokens").withColumn("fa", F.when(own, F.col("fa"))).join(named, ["fa", "fb"], "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near-duplicates: of each class one row with its smallest doc_id stays, with all its columns.

    Rows meet only ids: one anti-join drops the classes' other members and the ids that occur twice. The rows of the
    latter are numbered in a table of their own, and of each id the row with the smallest number stays.
    """
    away = clusters(docs.select("doc_id", "text"), width, percent).where("not kept").select("doc_id").distinct()
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    twice = stage(ids.where("n > 1 and doc_id is not null").select("doc_id").join(away, "doc_id", "left_anti"), "twice")
    rest = docs.join(away.union(twice).hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return rest
    several = docs.join(twice.hint("shuffle_hash"), "doc_id", "left_semi")
    several = stage(several.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "several")
    first = several.groupBy("doc.doc_id").agg(F.min("row").alias("row")).select("row")
    chosen = several.join(first.hint("shuffle_hash"), "row", "left_semi").select("doc.*")
    return rest.unionByName(chosen.select(*docs.columns))
