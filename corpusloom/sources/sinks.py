"""What is kept: mirrors, listings, host memory, moves, failures, recipes, sections and result lines.

State tables are Parquet with the latest row of each key; a change is a new table made from the old one and the news."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import urls as U


def write_mirror(pages: DataFrame, path: str) -> None:
    """Good pages (url, outcome, fetched, ...), by host, under a key of the url; texts to two million characters."""
    good = pages.where(F.col("outcome").isin("ok", "want_miss"))
    good = good.withColumns({"host": U.host(F.col("url")), "key": U.mirror_key(F.col("url")), "text": F.substring("text", 1, 2_000_000)})
    good.write.mode("append").partitionBy("host").parquet(path)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")


def read_mirror(mirror: DataFrame, now: float, days: float = 1.0) -> DataFrame:
    """The newest copy of each url that is not older than ``days``."""
    return latest(mirror, "url", "fetched").where(F.lit(now) - F.col("fetched") < days * 86400)


def merge_hosts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Host memory (host, updated, ...): the last writer wins."""
    return latest(old.unionByName(new, allowMissingColumns=True), "host", "updated")


def propose_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Moves (kind, scope, spec, note, tries, wins, dead) with proposals: a note replaces an old one only if it is there, and a
    proposed move that had been retired is alive again."""
    key = ["kind", "scope", "spec"]
    n = new.select(*key, F.col("note").alias("n_note"), F.lit(True).alias("n_is"))
    merged = old.join(n, key, "full_outer")
    return merged.select(*key, F.coalesce("n_note", "note").alias("note"), F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("wins", F.lit(0)).alias("wins"), F.when(F.col("n_is"), False).otherwise(F.coalesce("dead", F.lit(False))).alias("dead"))


def score_moves(moves: DataFrame, results: DataFrame) -> DataFrame:
    """Moves after results (kind, scope, spec, ok): tries and wins counted, hopeless ones retired."""
    key = ["kind", "scope", "spec"]
    r = results.groupBy(*key).agg(F.count(F.lit(1)).alias("t"), F.count_if("ok").alias("w"))
    out = moves.join(r, key, "left").withColumns({"tries": F.col("tries") + F.coalesce("t", F.lit(0)), "wins": F.col("wins") + F.coalesce("w", F.lit(0))}).drop("t", "w")
    hopeless = ~F.col("kind").isin("locale_prefix", "listing_root") & (F.col("tries") >= P.PRUNE_TRIES) & (F.col("wins") == 0)
    return out.withColumn("dead", F.col("dead") | hopeless)


def append_failures(old: DataFrame, new: DataFrame, ring: int = P.RING) -> DataFrame:
    """The failure log (id, ...) with news, cut to the latest ids."""
    both = old.unionByName(new)
    return both.join(F.broadcast(both.agg(F.max("id").alias("_last"))), F.col("id") >= F.col("_last") - ring).drop("_last")


def upsert_recipes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recipes (name, steps, tries, wins, updated, ...): a compiled one starts its counts anew."""
    return latest(old.unionByName(new.withColumns({"tries": F.lit(0).cast("long"), "wins": F.lit(0).cast("long")}), allowMissingColumns=True), "name", "updated")


def write_sections(sections: DataFrame, path: str) -> None:
    """citation, heading, text, url as JSON lines."""
    sections.select("citation", "heading", "text", "url").write.mode("overwrite").json(path)


def write_results(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
