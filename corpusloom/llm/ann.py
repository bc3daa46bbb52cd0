"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one priority queue over all trees.

Trees are fitted on a bounded sample (``SAMPLE`` vectors): a node splits at the median of the projection on the difference
of two sampled vectors. Every vector is indexed: it goes to one leaf of each tree. A query walks all trees from one
priority queue ordered by the smallest margin on the way (the side not taken costs its distance to the plane) and visits
leaves until they hold its budget of entries. Leaves and the queries that visit them meet by (tree, leaf);
a leaf's or a query list's surplus over ``CHUNK`` is dealt into chunks, so no task holds more. Each meeting emits a few
best per query; those are ranked exactly, in double precision on the original vectors.

One formula sets the work at every size: a query's leaves hold ``BUDGET * n ** POWER`` entries, which grows slower than the
table, and trees are so deep (``DEEPEST`` at most, as planes are sent to every task) that these are about ``VISITS`` leaves,
so what a query emits does not grow with the table.

Equal vectors are indexed once, with the few smallest ids of each (found in salted steps, so a vector that a third of
all rows share is split), since only those can be among the nearest. The budget is large because vectors without clusters
need it: see the README for measured recall.

Cases: vectors that are null, zero, hold null or non-finite components, or have another length than most (a cosine
between lengths is not defined), and rows without an id take no part; fewer candidates than asked give fewer rows; ties go to the smaller id; repeated ids count once; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import stage

SAMPLE, TREES, VISITS, DEEPEST = 20_000, 16, 48, 10
BUDGET, POWER, CHUNK, SALTS = 13.0, 0.72, 20_000, 32


class Forest:
    """Planes of all trees: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 5) -> None:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.depth, inner = depth, 2**depth - 1
        self.planes = np.zeros((trees, inner, dim), dtype=np.float32)
        self.cuts = np.zeros((trees, inner), dtype=np.float32)
        for t in range(trees):
            at = np.zeros(len(sample), dtype=np.int64)
            for node in range(inner):
                here = np.flatnonzero(at == node)
                a, b = sample[rng.choice(here, 2)] if len(here) > 1 else (np.zeros(dim), np.zeros(dim))
                plane = a - b if (a != b).any() else rng.normal(size=dim)
                plane = plane / np.linalg.norm(plane)
                side = sample[here] @ plane
                cut = np.median(side) if len(here) else 0.0
                self.planes[t, node], self.cuts[t, node] = plane, cut
                at[here] = 2 * node + 1 + (side > cut)

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(v), len(self.planes)), dtype=np.int64)
        for t in range(len(self.planes)):
            side = v @ self.planes[t].T > self.cuts[t]
            node = np.zeros(len(v), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(v)), node]
            out[:, t] = node - (2**self.depth - 1)
        return out

    def visits(self, v: np.ndarray, sizes: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) in order of the queue until the leaves hold ``budget`` entries."""
        margin = np.einsum("tnd,d->tn", self.planes, v) - self.cuts
        first = 2**self.depth - 1
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        out, held = [], 0
        while queue and held < budget:
            cost, t, node = heapq.heappop(queue)
            while node < first:
                m = float(margin[t, node])
                heapq.heappush(queue, (max(cost, abs(m)), t, 2 * node + (1 if m > 0 else 2)))
                node = 2 * node + (2 if m > 0 else 1)
            if sizes[t, node - first]:
                out.append((t, node - first))
                held += int(sizes[t, node - first])
        return out


def _matrix(raw: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float32).reshape(-1, dim)


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(x, dtype=np.float64) for x in v])
    m /= np.abs(m).max(axis=1, keepdims=True)  # before squaring, so that large components do not overflow
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _poster(forest: Forest):
    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = _unit(b["v"])
                leaf = forest.leaves(v)
                raw = [x.tobytes() for x in v]
                t = leaf.shape[1]
                yield pd.DataFrame({"tree": np.tile(np.arange(t), len(v)), "leaf": leaf.ravel(), "rep": np.repeat(b["rep"].to_numpy(), t), "raw": np.repeat(np.array(raw, dtype=object), t)})

    return post


def _asker(forest: Forest, sizes: np.ndarray, budget: float):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, v in zip(b["query_id"], _unit(b["v"]) if len(b) else ()):
                raw = v.tobytes()
                rows += [(t, leaf, q, raw) for t, leaf in forest.visits(v, sizes, budget)]
            yield pd.DataFrame(rows, columns=["tree", "leaf", "query_id", "raw"])

    return ask


def _meeter(dim: int, keep: int):
    def meet(posted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(posted) and len(asked):
            v, rep = _matrix(posted["raw"], dim), posted["rep"].to_numpy()
            q, ids = _matrix(asked["raw"], dim), asked["query_id"].to_numpy()
            for at in range(0, len(q), 512):
                near = q[at : at + 512] @ v.T
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if keep < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                out.append(pd.DataFrame({"query_id": np.repeat(ids[at : at + 512], best.shape[1]), "rep": rep[best].ravel(), "near": np.take_along_axis(near, best, 1).ravel().astype(float)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "near": pd.Series(dtype="float64")})

    return meet


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    top = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = top["n"] if top else 0
    infinite = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where((F.size("v") == dim) & ~infinite & F.exists("v", lambda x: x != 0.0))


def nearest(vectors: DataFrame, k: int = 5, modulus: int = 50, budget: float = BUDGET, power: float = POWER) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``modulus``."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    # an id that is there twice has one vector, the smallest
    rows = stage(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    # the k + 1 smallest ids of each distinct vector, in two steps
    few = lambda d, *by: d.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(f"r <= {k + 1}").drop("r")
    salted = few(rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))), "v", "salt")
    distinct = few(salted.drop("salt"), "v").groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = stage(distinct.withColumn("rep", F.element_at("ids", 1)), "distinct")
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], empty)
    sample = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, n // SAMPLE))) == 0).select("rep", "v").toPandas() if n > SAMPLE else distinct.select("rep", "v").toPandas()
    sample = sample.sort_values("rep")
    depth = min(DEEPEST, max(1, round(np.log2(n * VISITS / (budget * n**power)))))
    forest = Forest(_unit(sample["v"]) if len(sample) else np.zeros((0, 1), dtype=np.float32), depth)
    dim = forest.planes.shape[2]
    posted = distinct.select("rep", "v").mapInPandas(_poster(forest), "tree int, leaf int, rep long, raw binary")
    posted = stage(posted, "leaves")
    sizes = np.zeros((TREES, 2**depth), dtype=np.int64)
    for r in posted.groupBy("tree", "leaf").count().collect():  # at most trees times leaves
        sizes[r["tree"], r["leaf"]] = r["count"]
    wanted = rows.where(F.pmod("vec_id", F.lit(modulus)) == 0).select(F.col("vec_id").alias("query_id"), "v")
    asked = stage(wanted.mapInPandas(_asker(forest, sizes, budget * n**power), "tree int, leaf int, query_id long, raw binary"), "asked")
    load = [(r["tree"], r["leaf"], int(-(-sizes[r["tree"], r["leaf"]] // CHUNK)), int(-(-r["count"] // CHUNK))) for r in asked.groupBy("tree", "leaf").count().collect()]
    load = F.broadcast(spark.createDataFrame(load or [(0, 0, 1, 1)], "tree int, leaf int, vs int, qs int"))  # at most trees times leaves
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(load, ["tree", "leaf"]).withColumn("vp", part("rep", "vs")).withColumn("qp", every("qs"))
    right = asked.join(load, ["tree", "leaf"]).withColumn("qp", part("query_id", "qs")).withColumn("vp", every("vs"))
    keys, cols = ["tree", "leaf", "vp", "qp"], lambda d, c: d.select("tree", "leaf", "vp", "qp", c, "raw")
    met = cols(left, "rep").groupBy(*keys).cogroup(cols(right, "query_id").groupBy(*keys)).applyInPandas(_meeter(dim, 2 * k + 2), "query_id long, rep long, near double")
    found = met.groupBy("query_id", "rep").agg(F.max("near").alias("near"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "rep"))).where(f"r <= {2 * k + 2}")
    exact = best.select("query_id", "rep").join(distinct.withColumnRenamed("v", "b"), "rep").join(wanted.withColumnRenamed("v", "a"), "query_id")
    # scaled by the largest component, so that squares neither overflow nor vanish
    for c in "ab":
        exact = exact.withColumn("m", F.array_max(F.transform(c, F.abs))).withColumn(c, F.when((F.col("m") > 1e100) | (F.col("m") < 1e-100), F.transform(c, lambda x: x / F.col("m"))).otherwise(F.col(c)))
    exact = exact.withColumn("score", _dot("a", "b") / F.sqrt(_dot("a", "a") * _dot("b", "b"))).withColumn("vec_id", F.explode("ids")).where("vec_id != query_id")
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(f"rank <= {k}")
    return exact.select("query_id", "rank", "vec_id", "score")
