"""Link families of pages, what they lead to, and walks over the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls as U


def on_site(links: DataFrame) -> DataFrame:
    """Links of a page to its own site, not to itself and not to assets, each url once (first place)."""
    u, base = F.split_part("url", F.lit("#"), F.lit(1)), F.split_part("base", F.lit("#"), F.lit(1))
    l = links.withColumn("url", u).where((U.bare_host(F.col("url")) == U.bare_host(F.col("base"))) & (F.rtrim("url", F.lit("/")) != F.rtrim(base, F.lit("/"))) & ~U.is_asset(F.col("url")))
    return l.groupBy("page_id", "base", "url").agg(F.min("pos").alias("pos"))


def link_families(links: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """page_id, family, url, pos. Urls group under their parent pattern; a numeric shape names the family only where it covers
    ``share`` of the group, else the parent does; families of fewer than ``least`` urls are left out."""
    l = on_site(links).withColumns({"parent": U.pattern(F.col("url")), "shape": U.family(F.col("url"))})
    shapes = l.groupBy("page_id", "parent", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    top = shapes.groupBy("page_id", "parent").agg(F.max_by("shape", F.struct("n", -F.col("first"))).alias("top"), F.max("n").alias("n"), F.sum("n").alias("total"))
    top = top.withColumn("numeric", F.contains("top", F.lit("<n>")) & (F.col("n") >= share * F.col("total")))
    j = l.join(top.select("page_id", "parent", "top", "numeric"), ["page_id", "parent"])
    j = j.where((F.col("numeric") & (F.col("shape") == F.col("top"))) | (~F.col("numeric") & (F.col("parent") != "/")))
    j = j.withColumn("family", F.when(F.col("numeric"), F.col("top")).otherwise(F.col("parent")))
    size = F.count(F.lit(1)).over(Window.partitionBy("page_id", "family"))
    return j.withColumn("size", size).where(F.col("size") >= least).select("page_id", "base", "family", "url", "pos", "size")


def majority(samples: DataFrame, by: list[str], kind: str = "kind", order: str = "pos") -> DataFrame:
    """The most frequent kind of each group; ties go to the kind seen first."""
    votes = samples.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    return votes.groupBy(*by).agg(F.max_by(kind, F.struct("votes", -F.col("first"))).alias("leads_to"))


def walk(edges: DataFrame, start: DataFrame, levels: int) -> DataFrame:
    """node, level of what is reached from ``start`` within so many steps over edges (src, dst): a frontier joined with the
    edges, less what was seen. Each level is checkpointed, so plans stay short."""
    seen = start.select("node", F.lit(0).alias("level")).checkpoint()
    frontier = seen
    for level in range(1, levels + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").select("node", F.lit(level).alias("level")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
