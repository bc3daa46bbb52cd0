"""Downloaded bulk files: entries of zip archives, and listings of captures."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    if not name.endswith("/"):
                        raw = z.read(name)
                        wide = raw.startswith((b"\xff\xfe", b"\xfe\xff"))
                        rows.append((path, name, raw.decode("utf-16" if wide else "utf-8", "replace")))
                        yield pd.DataFrame(rows, columns=["path", "name", "text"])  # one entry at a time: an archive may be large
                        rows = []


def zip_entries(files: DataFrame) -> DataFrame:
    """path, name, text of every entry; ``files``: path and content, as the binaryFile source gives them."""
    return files.select("path", "content").mapInPandas(_entries, "path string, name string, text string")


def good_captures(captures: DataFrame, n: int = 4, recent: int = 25) -> DataFrame:
    """The newest ``n`` captures of each url with status 200, equal bodies once; ``captures``: url, ts, status, digest."""
    distinct = captures.where("status = 200").groupBy("url", "digest").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("url").orderBy(F.desc("ts"))
    return distinct.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(n, recent))


def sitemap_locations(files: DataFrame) -> DataFrame:
    """url, pos, loc of site map files (url, body): tagged locations, or else bare urls of a file whose tags are gone."""
    tagged = F.regexp_extract_all("body", F.lit(P.LOCATION), F.lit(1))
    bare = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(P.BARE_URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,)]+$", "")))
    return files.select("url", F.posexplode(F.when(F.size(tagged) > 0, tagged).otherwise(bare)).alias("pos", "loc"))


def sitemap_tree(files: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """root, loc: the locations below each root file, each file read once. A file is an index if it says so, or if every location
    in it looks like a site map; indexes are followed ``depth`` times, and those further down are given as locations."""
    locs = sitemap_locations(files)
    says = files.select("url", F.contains("body", F.lit("<sitemapindex")).alias("says"))
    index = locs.groupBy("url").agg(F.bool_and(F.col("loc").rlike(P.SITEMAP_FILE)).alias("all")).join(says, "url").select("url", (F.col("says") | F.col("all")).alias("index"))
    locs = locs.join(index, "url")
    level, out = roots.select(F.col("url").alias("root"), "url"), None
    for step in range(depth + 1):
        found = level.join(locs, "url").select("root", "loc", "index")
        leaves = found.where(~F.col("index") | F.lit(step == depth)).select("root", "loc")
        out = leaves if out is None else out.unionByName(leaves)
        level = found.where("index").select("root", F.col("loc").alias("url")).distinct()
    return out.distinct()
