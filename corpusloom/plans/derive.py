"""The shapes that operators need, derived from the plain tables; ``SQL`` holds the same derivations for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import urls as U

NOW = 1706659200  # 2024-01-31 00:00:00 UTC: "now" is a parameter, never the clock


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: the context's, else the one that the session names. On one machine a local folder is set
    where neither is; on a cluster that would lose rows, as each executor has its own disk, so it is an error there."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not held.isDefined():
        if not named and not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster") and not named:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = named or "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(named)
    return (named or held.get()).rstrip("/")


def site(spark, d) -> DataFrame:
    """pos, url (canonical) of every captured page."""
    return table(spark, d, "pages").select(F.col("page_id").alias("pos"), U.canonical(F.col("url")).alias("url"))


def link(spark, d) -> DataFrame:
    """page_id, base, pos, url: the links of every page in document order, made absolute."""
    p = table(spark, d, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    out = p.select("page_id", F.col("url").alias("base"), F.posexplode(hrefs).alias("pos", "href"))
    return out.select("page_id", "base", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("https://"), U.host(F.col("base")), F.split_part("href", F.lit("#"), F.lit(1))).alias("url"))


def site_link(spark, d) -> DataFrame:
    """page_id, base, pos, url: the site map of each host as the links of one page, its root."""
    s = site(spark, d).withColumn("host", U.host(F.col("url")))
    return s.select(F.min("pos").over(Window.partitionBy("host")).alias("page_id"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("base"), "pos", "url")


def text_page(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"), "text")


def child_link(spark, d) -> DataFrame:
    """Links in which every other one hangs under its page's own path."""
    own = F.concat(F.lit("https://"), U.host(F.col("base")), F.rtrim(U.path(F.col("base")), F.lit("/")), U.path(F.col("url")))
    return link(spark, d).withColumn("url", F.when(F.col("pos") % 2 == 0, own).otherwise(F.col("url")))


def host_link(spark, d) -> DataFrame:
    """page_id, host, linked: another host that each page links to; some carry its owner's name."""
    p = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host")).withColumn("bare", F.regexp_replace("host", r"^www\.", ""))
    name = F.replace(F.split_part("bare", F.lit("."), F.lit(1)), F.lit("-"), F.lit(""))
    linked = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("shop."), "bare")).when(F.col("page_id") % 3 == 1, F.concat(name, F.lit("-docs.example"))).otherwise("cdn.example")
    return p.select("page_id", "host", linked.alias("linked"))


def blocked_text(spark, d) -> DataFrame:
    """doc_id, text: documents of which one in ten opens like a block page, and one in ten like half of one."""
    lead = F.when(F.col("doc_id") % 10 == 0, "Access denied. Your IP address is 10.0.0.1. ").when(F.col("doc_id") % 10 == 1, "Access denied. ").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(lead, "text").alias("text"))


def attempt(spark, d, source: DataFrame | None = None) -> DataFrame:
    """A log of reads: req_id, secs (since the epoch), host, reader, outcome, k. ``source``: the events, if not from the table."""
    e = table(spark, d, "events") if source is None else source
    outcome = F.create_map(*[F.lit(x) for kv in {"view": "ok", "click": "want_miss", "signup": "js_shell", "purchase": "not_found", "error": "refused"}.items() for x in kv])
    return e.select(
        F.col("event_id").alias("req_id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("secs"),
        F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"), F.lit(".example")).alias("host"),
        F.element_at(F.array(*[F.lit(r) for r in P.READERS]), (F.col("event_id") % 4 + 1).cast("int")).alias("reader"),
        F.element_at(outcome, F.col("event_type")).alias("outcome"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value",
        "user_id",
    )


def move(spark, d) -> DataFrame:
    """Routing rules with their tries and wins."""
    p = table(spark, d, "part")
    l = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("tries"), F.count_if(F.col("l_returnflag") == "R").alias("wins"))
    kinds = F.array(*[F.lit(k) for k in ("url_rewrite", "listing_path", "detail_suffix", "locale_prefix", "listing_root")])
    scope = F.when(F.col("p_partkey") % 3 == 0, "*").when(F.col("p_partkey") % 3 == 1, "example").otherwise(F.concat(F.lit("h"), (F.col("p_partkey") % 10).cast("string"), F.lit(".example")))
    return p.join(l, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"), F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("kind"), scope.alias("scope"),
        F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("spec"), F.coalesce("tries", F.lit(0)).cast("long").alias("tries"), F.coalesce("wins", F.lit(0)).cast("long").alias("wins"),
    )


def recipe_input(spark, d) -> DataFrame:
    """Distinct inputs and the urls of their item pages."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("input")).agg(F.min("p_partkey").alias("k"))
    gap = F.when(F.col("k") % 3 == 0, "_").when(F.col("k") % 3 == 1, "-").otherwise("")
    return p.select("input", "k", F.concat(F.lit("https://catalog.example/p/"), F.replace(F.col("input"), F.lit(" "), gap)).alias("url"))


def section_src(spark, d) -> DataFrame:
    """Lines of documents: doc_id, line_no, line, and the id of a section head (a first token of up to four letters)."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", F.regexp_extract("line", r"^([A-Za-z]{1,4})(?:[^A-Za-z]|$)", 1).alias("head"))


def mirror(spark, d) -> DataFrame:
    """Pages kept: url, fetched (epoch seconds)."""
    s = site(spark, d).where("pos % 3 = 0")
    return s.select("pos", "url", (F.lit(1704067200) + F.col("pos") * 3600).alias("fetched"))


def first_seen(df: DataFrame, *by: str, order: str = "pos") -> DataFrame:
    """The first row of each key, in order."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


_HOST = "lower(regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1))"
_PATH = "regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def sql_host(u: str) -> str:
    return _HOST.format(u=u)


def sql_path(u: str) -> str:
    return _PATH.format(u=u)


def sql_query(u: str) -> str:
    return _QUERY.format(u=u)


def sql_bare(u: str) -> str:
    return f"regexp_replace({sql_host(u)}, '^www\\.', '')"


def sql_pattern(u: str) -> str:
    p = f"string_split(regexp_replace(CASE WHEN rtrim({sql_path(u)}, '/') = '' THEN '/' ELSE rtrim({sql_path(u)}, '/') END, '[0-9]+', 'N', 'g'), '/')"
    return f"left(array_to_string(CASE WHEN len({p}) > 2 THEN list_append({p}[1:len({p})-1], '*') ELSE {p} END, '/'), 200)"


def sql_family(u: str) -> str:
    whole = f"({sql_path(u)} || CASE WHEN {sql_query(u)} <> '' THEN '?' || {sql_query(u)} ELSE '' END)"
    s = f"regexp_replace({whole}, '[0-9][0-9A-Za-z]*', '<n>', 'g')"
    for _ in range(2):  # no lookaround here: adjacent tokens need a second pass
        s = f"regexp_replace({s}, '([-_/=])[IVXLC]{{1,7}}([-_./]|$)', '\\1<n>\\2', 'g')"
    return f"CASE WHEN contains({s}, '<n>') THEN {s} ELSE {sql_pattern(u)} END"


def sql_canonical(u: str) -> str:
    kept = f"array_to_string(list_filter(string_split({sql_query(u)}, '&'), lambda x: NOT regexp_matches(split_part(x, '=', 1), '{P.TRACKING}') AND regexp_matches(x, '=.')), '&')"
    return f"'https://' || regexp_replace({sql_host(u)}, ':(80|443)$', '') || {sql_path(u)} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = {
    "site": f"site AS (SELECT page_id AS pos, {sql_canonical('url')} AS url FROM pages)",
    "link": f"""link AS (SELECT page_id, base, (pos - 1)::BIGINT AS pos, 'https://' || {sql_host('base')} || split_part(href, '#', 1) AS url FROM (
      SELECT page_id, base, unnest(hs) AS href, generate_subscripts(hs, 1) AS pos FROM (SELECT page_id, url AS base, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages)))""",
    "text_page": "text_page AS (SELECT doc_id, left(split_part(text, chr(10), 1), 80) AS title, text FROM documents)",
    "attempt": """attempt AS (SELECT event_id AS req_id, floor(epoch(ts))::BIGINT AS secs, 'h' || (user_id % 10) || '.example' AS host,
      (['direct', 'firecrawl', 'crawl4ai', 'browser'])[event_id % 4 + 1] AS reader,
      CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'want_miss' WHEN 'signup' THEN 'js_shell' WHEN 'purchase' THEN 'not_found' WHEN 'error' THEN 'refused' END AS outcome,
      json_extract_string(props, '$.k')::BIGINT AS k, value, user_id FROM events)""",
    "move": """move AS (SELECT p_partkey AS id, (['url_rewrite', 'listing_path', 'detail_suffix', 'locale_prefix', 'listing_root'])[p_partkey % 5 + 1] AS kind,
      CASE p_partkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'example' ELSE 'h' || (p_partkey % 10) || '.example' END AS scope, '/' || replace(p_name, ' ', '-') AS spec,
      coalesce(tries, 0)::BIGINT AS tries, coalesce(wins, 0)::BIGINT AS wins
      FROM part LEFT JOIN (SELECT l_partkey, count(*) AS tries, count(*) FILTER (l_returnflag = 'R') AS wins FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)""",
    "recipe_input": """recipe_input AS (SELECT input, k, 'https://catalog.example/p/' || replace(input, ' ', CASE k % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '' END) AS url
      FROM (SELECT p_name AS input, min(p_partkey) AS k FROM part GROUP BY 1))""",
    "section_src": """section_src AS (SELECT doc_id, (line_no - 1)::BIGINT AS line_no, line, regexp_extract(line, '^([A-Za-z]{1,4})(?:[^A-Za-z]|$)', 1) AS head FROM (
      SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))""",
}
SQL["child_link"] = SQL["link"].replace("link AS (SELECT page_id, base, (pos - 1)::BIGINT AS pos, ", "link AS (SELECT page_id, base, (pos - 1)::BIGINT AS pos, CASE WHEN (pos - 1) % 2 = 0 THEN 'https://' || " + sql_host("base") + " || rtrim(" + sql_path("base") + ", '/') || " + sql_path("('https://' || " + sql_host("base") + " || split_part(href, '#', 1))") + " ELSE ").replace("split_part(href, '#', 1) AS url", "split_part(href, '#', 1) END AS url")
SQL["host_link"] = f"""host_link AS (SELECT page_id, host, CASE page_id % 3 WHEN 0 THEN 'shop.' || bare WHEN 1 THEN replace(split_part(bare, '.', 1), '-', '') || '-docs.example' ELSE 'cdn.example' END AS linked
      FROM (SELECT page_id, {sql_host('url')} AS host, regexp_replace({sql_host('url')}, '^www\\.', '') AS bare FROM pages))"""
SQL["blocked_text"] = "blocked_text AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'Access denied. Your IP address is 10.0.0.1. ' WHEN 1 THEN 'Access denied. ' ELSE '' END || text AS text FROM documents)"
SQL["site_link"] = SQL["site"] + f", link AS (SELECT min(pos) OVER (PARTITION BY {sql_host('url')}) AS page_id, 'https://' || {sql_host('url')} || '/' AS base, pos, url FROM site)"
SQL["mirror"] = SQL["site"] + ", mirror AS (SELECT pos, url, 1704067200 + pos * 3600 AS fetched FROM site WHERE pos % 3 = 0)"


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
