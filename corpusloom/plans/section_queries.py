"""Sections of documents and versions of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import sections as S
from corpusloom.plans import derive as D
from corpusloom.plans.registry import query

SEC = D.with_("section_src")[:-1] + """, o AS (SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM section_src),
sec AS (SELECT doc_id, s::INTEGER AS sec, max(head) AS id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*)::INTEGER AS n_lines FROM o WHERE s > 0 GROUP BY 1, 2) """


def _sections(spark, d):
    return S.split_sections(D.section_src(spark, d))


@query(SEC + "SELECT doc_id, sec, id, n_lines, md5(text) AS digest FROM sec")
def section_split(spark, d):
    return _sections(spark, d).select("doc_id", "sec", "id", "n_lines", F.md5("text").alias("digest"))


@query(SEC + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY length(text) DESC, sec) AS rn FROM sec) SELECT doc_id, id, sec FROM r WHERE rn = 1")
def section_longest(spark, d):
    return S.longest(_sections(spark, d)).select("doc_id", "id", "sec")


@query(SEC + "SELECT doc_id, id, min(sec) AS sec FROM sec GROUP BY 1, 2")
def section_first(spark, d):
    return S.first(_sections(spark, d)).select("doc_id", "id", "sec")


@query(SEC + "SELECT doc_id, id, md5(string_agg(text, chr(10) || chr(10) ORDER BY sec)) AS digest, count(*) AS versions FROM sec GROUP BY 1, 2")
def section_versions(spark, d):
    return S.joined_versions(_sections(spark, d)).select("doc_id", "id", F.md5("text").alias("digest"), "versions")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber AS seq, l_shipdate::DATE AS effective FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY effective > DATE '1998-01-01', CASE WHEN effective <= DATE '1998-01-01' THEN -epoch(effective) ELSE epoch(effective) END, CASE WHEN effective <= DATE '1998-01-01' THEN -seq ELSE seq END) AS rn FROM b)
SELECT l_orderkey, seq, CAST(effective AS VARCHAR) AS effective FROM r WHERE rn = 1""")
def section_inforce(spark, d):
    v = D.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.to_date("l_shipdate").alias("effective"))
    return S.in_force(v, ["l_orderkey"], F.lit("1998-01-01").cast("date")).select("l_orderkey", "seq", F.col("effective").cast("string").alias("effective"))


@query("SELECT p_partkey, trim(unnest(string_split(replace(p_name, ' ', ', '), ','))) AS id FROM part")
def section_multi_id(spark, d):
    """A row that names several ids becomes one row for each."""
    return D.table(spark, d, "part").select("p_partkey", F.explode(F.split(F.replace("p_name", F.lit(" "), F.lit(", ")), ",")).alias("id")).select("p_partkey", F.trim("id").alias("id"))


@query(D.with_("section_src") + "SELECT doc_id, line, count(*) AS n FROM section_src WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(*) >= 2")
def running_heads(spark, d):
    return S.running_heads(D.section_src(spark, d))


@query("WITH k AS (SELECT s_suppkey, 'ch ' || s_suppkey || '.' || (s_nationkey % 7) AS name, s_suppkey AS a, s_nationkey % 7 AS b FROM supplier) SELECT name, row_number() OVER (ORDER BY a, b)::INTEGER AS rank FROM k")
def natural_sort(spark, d):
    s = D.table(spark, d, "supplier").select(F.concat(F.lit("ch "), F.col("s_suppkey").cast("string"), F.lit("."), (F.col("s_nationkey") % 7).cast("string")).alias("name"))
    D.checkpoints(spark)
    return S.ranked(s.withColumn("key", S.natural_key(F.col("name"))), "key").select("name", "rank")


@query("SELECT p_partkey, 'Code § ' || p_size || '-' || p_partkey || ' (' || p_brand || ')' AS citation FROM part")
def citation_format(spark, d):
    spaced = F.concat(F.col("p_size").cast("string"), F.lit(" - "), F.col("p_partkey").cast("string"))
    return D.table(spark, d, "part").select("p_partkey", S.citation("Code § {id} ({title})", id=spaced, title=F.col("p_brand")).alias("citation"))
