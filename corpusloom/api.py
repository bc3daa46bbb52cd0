"""The engine's tools over stored tables, for programs and the command line.

An ``Engine`` holds a session and a folder of tables: pages (url, title, text, links, jsonld), attempts, hosts, moves, failures,
recipes, enrollments. Tables that are not there are empty. Every tool returns a DataFrame; nothing is fetched here - captures are
read by the ``captures`` source and kept by ``sources.sinks``.
"""

from __future__ import annotations

import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.operators import links as L
from corpusloom.plans import recipes as R
from corpusloom.plans.url_queries import ranked_patterns
from corpusloom.sources import sinks, statutes

TABLES = {
    "pages": "url string, title string, text string, n_scripts int, links array<struct<pos:int,url:string,text:string>>, jsonld array<string>",
    "hosts": "host string, reader string, hold_reason string, hold_since double, hold_until double, held_by string, pace double, updated double",
    "moves": "kind string, scope string, spec string, note string, tries long, wins long, dead boolean",
    "failures": "id long, host string, url string, code string, at double",
    "recipes": "name string, about string, steps string, examples string, tries long, wins long, last_code string, updated double",
    "enrollments": "host string, status string, reason string, note string, updated double",
    "jobs": "host string, total long, fetched long, failed long, state string, updated double",
}
MOVE_KINDS = ("url_rewrite", "listing_path", "detail_suffix", "locale_prefix", "listing_root")


class Engine:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], TABLES[name])

    def _replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write the new state beside the old one, then over it."""
        cols = [f.name for f in self.spark.createDataFrame([], TABLES[name]).schema]
        df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in cols]).write.mode("overwrite").parquet(f"{self.folder}/{name}.new")
        self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.new").write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    def reach(self, want: str = "") -> DataFrame:
        """url, outcome and excerpt of every stored page."""
        p = self.table("pages")
        shell = X.shell(F.col("text"), F.col("n_scripts"))
        return p.select("url", X.judge(F.col("title"), F.col("text"), shell, want).alias("outcome"), X.excerpt(F.col("text")).alias("excerpt"), (X.prose_milli(F.col("text")) / 1000).alias("prose"))

    def site_map(self, filter: str = "", host: str = "") -> DataFrame:
        s = self.table("pages").select(F.xxhash64("url").alias("pos"), U.canonical(F.col("url")).alias("url"))
        s = s.where(U.host(F.col("url")) == host) if host else s
        return ranked_patterns(s.where(F.col("url").rlike(f"(?i){filter}")) if filter else s)

    def families(self) -> DataFrame:
        l = self.table("pages").select(F.xxhash64("url").alias("page_id"), F.col("url").alias("base"), F.inline("links"))
        return L.link_families(l).groupBy("base", "family").agg(F.count(F.lit(1)).alias("links"))

    def explore(self, host: str) -> DataFrame:
        """Patterns of a host with the recipes that are known for it."""
        known = self.table("recipes").where(F.startswith("name", F.lit(host + "/"))).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("recipes"))
        return self.site_map(host=host).withColumn("recipes", F.lit(known.first()["recipes"]))

    def hold(self, host: str, reason: str, now: float, until: float | None = None, lift: bool = False) -> DataFrame:
        new = self.spark.createDataFrame([(host, None, None if lift else reason[:300], None if lift else now, until, "agent", None, now)], TABLES["hosts"])
        return self._replace("hosts", sinks.merge_hosts(self.table("hosts"), new))

    def moves(self, kind: str | None = None) -> DataFrame:
        m = self.table("moves").where("not dead")
        m = m.where(F.col("kind") == kind) if kind else m
        return m.withColumn("score", (F.col("wins") + 1) / (F.col("tries") + 2)).orderBy(F.desc("score"), "spec")

    def propose(self, kind: str, spec: str, scope: str = "*", note: str | None = None) -> DataFrame:
        wrong = kind not in MOVE_KINDS or kind == "listing_path" and not spec.startswith("/")
        if kind == "url_rewrite":
            try:
                re.compile(spec)
            except re.error:
                wrong = True
        if wrong:
            raise ValueError("BAD_MOVE")
        new = self.spark.createDataFrame([(kind, scope, spec, note)], "kind string, scope string, spec string, note string")
        return self._replace("moves", sinks.propose_moves(self.table("moves"), new))

    def memory(self, host: str | None = None) -> DataFrame:
        h = self.table("hosts")
        return h.where(F.col("host") == host) if host else h

    def enroll(self, host: str, status: str, now: float, reason: str = "") -> DataFrame:
        if status not in ("needed", "requested", "enrolled", "declined"):
            raise ValueError("BAD_ENROLL")
        new = self.spark.createDataFrame([(host, status, reason, None, now)], TABLES["enrollments"])
        return self._replace("enrollments", sinks.latest(self.table("enrollments").unionByName(new), "host", "updated"))

    def compile(self, name: str, steps: list, examples: list[str], now: float) -> tuple[str, str]:
        """Check a recipe, try it on its examples, and keep it if all succeed."""
        code, message = R.compile_recipe(name, steps, examples)
        if code:
            return code, message
        bad = self._run(name, steps, examples).where("code is not null").orderBy("raw").first()
        if bad:
            return "TEST_FAILED", bad["line"]
        new = self.spark.createDataFrame([(name, "", json.dumps(steps), json.dumps(examples), 0, 0, None, now)], TABLES["recipes"])
        self._replace("recipes", sinks.upsert_recipes(self.table("recipes"), new))
        return "", ""

    def _run(self, name: str, steps: list, inputs: list[str]) -> DataFrame:
        pages = self.table("pages")
        return R.run_recipe(name, steps, self.spark.createDataFrame([(i,) for i in inputs], "raw string"), pages, pages.select(F.xxhash64("url").alias("pos"), "url"))

    def run(self, name: str, inputs: list[str]) -> DataFrame:
        """RESULT lines of a stored recipe for many inputs at once."""
        found = self.table("recipes").where(F.col("name") == name).first()
        if not found:
            lines = self.spark.createDataFrame([(i,) for i in inputs], "raw string")
            return lines.select("raw", X.result_line(F.lit(False), F.lit(name), F.col("raw"), F.lit("NO_RECIPE")).alias("line"), F.lit("NO_RECIPE").alias("code"))
        return self._run(name, json.loads(found["steps"]), inputs)

    def recipes(self) -> DataFrame:
        return self.table("recipes").withColumn("score", (F.col("wins") + 1) / (F.col("tries") + 2))

    def cache(self) -> DataFrame:
        left = F.col("total") - F.col("fetched") - F.col("failed")
        return self.table("jobs").withColumn("left", left)

    def laws(self, state: str, documents: DataFrame) -> DataFrame:
        return statutes.sections(documents, state).where("gate = ''")


def main(argv: list[str]) -> int:
    """run FOLDER NAME [INPUT... | -] · recipes FOLDER · cache FOLDER · laws FOLDER STATE DOCUMENTS OUT"""
    if len(argv) < 2 or argv[0] not in ("run", "recipes", "cache", "laws"):
        print(main.__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    e, rest = Engine(spark, argv[1]), argv[2:]
    if argv[0] == "run":
        inputs = [x.strip() for x in sys.stdin if x.strip()] if rest[1:] == ["-"] else rest[1:] or [""]
        failed = 0
        for r in e.run(rest[0], inputs).toLocalIterator():
            print(r["line"])
            failed += r["code"] is not None
        return int(failed > 0)
    if argv[0] == "laws":
        sinks.write_sections(e.laws(rest[0], spark.read.parquet(rest[1])), rest[2])
    else:
        getattr(e, argv[0])().show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
