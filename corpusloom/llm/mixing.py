"""Mix sources to target weights by systematic sampling.

Every source gets a target number of words. A document's expected copies are target / source size, so the prefix sums
of a source are (rank * ratio); one offset per source is added, and a document is emitted once for each integer that
its interval of the prefix sum crosses. Documents are ranked by (size, a hash of doc_id, doc_id), which stratifies the sample by size: a
source's words stay within about one document of its target.

The rank inside a source is built from three levels of counts - (source, size), then ``BUCKETS`` buckets by hash, then
``row_number`` inside a bucket - so that a source or one size of it with a third of all rows, whatever its ids look like, is
never sorted in one task. Only counts meet: the largest window by source has one row for each distinct size, the largest
by (source, size) one for each bucket, and the one over all sources one row for each source.

Cases: a null source is a source of its own, last in order; null text has size 0; a source of size 0 has target 0 and
takes nothing; documents with a null doc_id come first among equals and share a bucket, as do rows of one doc_id, which
has one row in a sound table; repeated rows each have their own interval; very long texts are counted where they are; extra
columns, whatever their names, are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"
#: Buckets of a size of a source, by four hexadecimal digits of a hash of the id.
BUCKETS = 1 << 16


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per source: mx_src, mx_null, source_size, target, mx_u. ``sizes`` has mx_src, mx_null, source_size.

    Weights repeat along the sources in code-point order. Resharing the excess of capped sources by weight ends at one
    water level: target = min(cap * size, weight * level), found in one pass over the sources by size / weight.
    """
    everything = Window.partitionBy()
    named = Window.orderBy("mx_null", "mx_src")
    by_ratio = Window.orderBy("mx_ratio", "mx_pos")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("mx_pos") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("mx_pos", F.row_number().over(named) - 1).withColumn("mx_w", weight)
    t = t.withColumn("mx_max", F.col("source_size") * F.lit(float(cap))).withColumn("mx_ratio", F.col("mx_max") / F.col("mx_w"))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("mx_max").over(before), F.lit(0.0))
    rest = F.sum("mx_w").over(everything) - F.coalesce(F.sum("mx_w").over(before), F.lit(0.0))
    t = t.withColumn("mx_level", left / rest).withColumn("mx_capped", F.col("mx_level") >= F.col("mx_ratio"))
    level = F.min(F.when(~F.col("mx_capped"), F.struct("mx_ratio", "mx_pos", "mx_level"))).over(everything)["mx_level"]
    t = t.withColumn("target", F.when(F.col("mx_capped"), F.col("mx_max")).otherwise(F.col("mx_w") * level))
    salt = F.concat(F.lit(f"{seed}:"), F.when(F.col("mx_null"), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("mx_src"))))
    unit = F.conv(F.substring(F.md5(salt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return t.select("mx_src", "mx_null", "source_size", "target", unit.alias("mx_u"))


def mix(docs: DataFrame, counted: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` (doc_id, source, mx_size and any others) with source_size, target and copies added.

    ``counted``: the same rows' doc_id, source and mx_size alone, if they can be read more cheaply than ``docs``.
    """
    keys = {"mx_null": F.col("source").isNull(), "mx_src": F.coalesce(F.col("source"), F.lit("")), "mx_block": F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("long").cast("string")), 1, 4), 16, 10).cast("int"), F.lit(-1))}
    small = (docs if counted is None else counted).select("doc_id", "source", "mx_size").withColumns(keys)
    blocks = small.groupBy("mx_src", "mx_null", "mx_size", "mx_block").agg(F.count(F.lit(1)).alias("mx_n"))
    sizes = blocks.groupBy("mx_src", "mx_null", "mx_size").agg(F.sum("mx_n").alias("mx_n"))
    totals = sizes.groupBy("mx_src", "mx_null").agg(F.sum(F.col("mx_n") * F.col("mx_size")).alias("source_size"))
    prior = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("mx_src", "mx_null", "mx_size", F.coalesce(F.sum("mx_n").over(prior("mx_src", "mx_null", "mx_size")), F.lit(0)).alias("mx_below"))
    blocks = blocks.withColumn("mx_earlier", F.coalesce(F.sum("mx_n").over(prior("mx_src", "mx_null", "mx_size", "mx_block")), F.lit(0))).drop("mx_n")
    places = blocks.join(sizes, ["mx_src", "mx_null", "mx_size"]).join(source_targets(totals, **options), ["mx_src", "mx_null"])
    inside = Window.partitionBy("mx_src", "mx_null", "mx_size", "mx_block").orderBy("doc_id")
    ranked = docs.withColumns(keys).withColumn("mx_row", F.row_number().over(inside))
    out = ranked.join(places, ["mx_src", "mx_null", "mx_size", "mx_block"])
    rank = F.col("mx_below") + F.col("mx_earlier") + F.col("mx_row")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rank * ratio + F.col("mx_u")) - F.floor((rank - 1) * ratio + F.col("mx_u"))
    return out.withColumn("copies", crossed.cast("long")).select(*docs.columns, "source_size", "target", "copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it was drawn, with the columns of ``docs``."""
    sized = docs.select(F.struct("*").alias("mx_doc"), "doc_id", "source", word_count().alias("mx_size"))
    drawn = mix(sized, docs.select("doc_id", "source", word_count().alias("mx_size")), **options).where("copies > 0")
    return drawn.withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("mx_doc.*")
