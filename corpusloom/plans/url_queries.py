"""Url functions, site maps, listings and mirrors over the captured pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import urls as U
from corpusloom.plans import derive as D
from corpusloom.plans.registry import query

q = D.quoted


def _pages(spark, d):
    return D.table(spark, d, "pages")


@query("SELECT page_id, url, length(html) AS n_chars FROM pages")
def src_pages_scan(spark, d):
    return _pages(spark, d).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query(f"SELECT page_id, {D.sql_host('url')} AS host FROM pages")
def url_host(spark, d):
    return _pages(spark, d).select("page_id", U.host(F.col("url")).alias("host"))


@query(f"SELECT page_id, {D.sql_pattern('url')} AS pattern FROM pages")
def url_pattern(spark, d):
    return _pages(spark, d).select("page_id", U.pattern(F.col("url")).alias("pattern"))


@query(f"SELECT page_id, {D.sql_family('url')} AS family FROM pages")
def url_family(spark, d):
    return _pages(spark, d).select("page_id", U.family(F.col("url")).alias("family"))


@query(f"SELECT page_id, {D.sql_canonical('url')} AS canonical FROM pages")
def url_canonical(spark, d):
    return _pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("canonical"))


_LOC = "(?i)^((?:/(?:[a-z]{2}[-_])?[a-z]{2}(?:[-_][a-z]{2})?){1,2})(?:/|$)"


@query(f"SELECT page_id, regexp_extract({D.sql_path('url')}, '{_LOC}', 1) AS locale FROM pages")
def url_locale(spark, d):
    return _pages(spark, d).select("page_id", U.locale(F.col("url")).alias("locale"))


def _flag(name, rx):
    def run(spark, d):
        return D.link(spark, d).select("page_id", "pos", F.col("url").rlike(rx).alias("flag"))

    run.__name__ = name
    query(D.with_("link") + f"SELECT page_id, pos, regexp_matches(url, {q(rx)}) AS flag FROM link")(run)


_flag("url_editorial", P.EDITORIAL)
_flag("url_catalog", P.CATALOG)
_flag("url_assets", P.ASSET)


@query(D.with_("link") + f"SELECT page_id, pos, url FROM link WHERE {D.sql_bare('url')} = {D.sql_bare('base')} AND starts_with({D.sql_path('url')}, '/') AND NOT regexp_matches(url, {q(P.ASSET)})")
def url_in_scope(spark, d):
    return D.link(spark, d).where(U.in_scope(F.col("url"), U.bare_host(F.col("base")), F.lit("/")) & ~U.is_asset(F.col("url"))).select("page_id", "pos", "url")


_RULES = [("plus", ""), ("[^a-z0-9]", "")]


@query(D.with_("recipe_input") + "SELECT input, regexp_replace(replace(lower(regexp_extract(url, '([^/]*)$', 1)), 'plus', ''), '[^a-z0-9]', '', 'g') AS key FROM recipe_input")
def slug_key(spark, d):
    return D.recipe_input(spark, d).select("input", U.slug_key(F.regexp_extract("url", "([^/]*)$", 1), _RULES).alias("key"))


@query("SELECT page_id, left(sha256(url), 24) AS key FROM pages")
def mirror_key(spark, d):
    return _pages(spark, d).select("page_id", U.mirror_key(F.col("url")).alias("key"))


def ranked_patterns(site, most=25, kept=15, samples=3):
    """Url patterns by frequency (ties: first seen), editorial ones last, with their first urls."""
    seen = Window.partitionBy("pattern").orderBy("pos")
    s = site.withColumn("pattern", U.pattern(F.col("url"))).withColumn("rn", F.row_number().over(seen))
    g = s.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first_pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= samples, F.struct("pos", "url")))), lambda x: x["url"]), " ").alias("samples"))
    g = g.orderBy(F.desc("count"), "first_pos").limit(most).withColumn("editorial", F.col("pattern").rlike(P.EDITORIAL))
    return g.orderBy("editorial", F.desc("count"), "first_pos").limit(kept).select("pattern", "count", "editorial", "samples")


_PATTERNS = f"""p AS (SELECT pos, url, {D.sql_pattern('url')} AS pattern FROM site),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY pos) AS rn FROM p),
g AS (SELECT pattern, count(*) AS count, min(pos) AS f, string_agg(url, ' ' ORDER BY pos) FILTER (rn <= 3) AS samples FROM r GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 25)
SELECT pattern, count, regexp_matches(pattern, {q(P.EDITORIAL)}) AS editorial, samples FROM g ORDER BY 3, 2 DESC, f LIMIT 15"""


@query(D.with_("site")[:-1] + ", " + _PATTERNS)
def site_patterns(spark, d):
    return ranked_patterns(D.site(spark, d))


@query(D.with_("site") + "SELECT pos, url FROM site WHERE regexp_matches(url, '(?i)/en/|page=2')")
def sitemap_filter(spark, d):
    return D.site(spark, d).where(F.col("url").rlike("(?i)/en/|page=2"))


@query(D.with_("link") + f"SELECT url, min(page_id * 1000 + pos) AS first_pos FROM link GROUP BY 1")
def ordered_distinct(spark, d):
    return D.link(spark, d).groupBy("url").agg(F.min(F.col("page_id") * 1000 + F.col("pos")).alias("first_pos"))


def spread(df, by, order, n):
    """``n`` rows of each group spread across it: the index floor(length * k / (n + 1)) for k = 1..n."""
    w = Window.partitionBy(by)
    at = F.row_number().over(w.orderBy(order)) - 1
    s = df.withColumn("i", at).withColumn("size", F.count(F.lit(1)).over(w))
    hit = F.exists(F.sequence(F.lit(1), F.lit(n)), lambda k: F.floor(F.col("size") * k / (n + 1)) == F.col("i"))
    return s.where(hit).drop("size")


@query(D.with_("site") + f""", p AS (SELECT pos, url, {D.sql_pattern('url')} AS pattern FROM site),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY pattern) AS n FROM p)
SELECT pattern, i::INTEGER AS i, url FROM r WHERE i IN (n * 1 // 6, n * 2 // 6, n * 3 // 6, n * 4 // 6, n * 5 // 6)""")
def spread_sample(spark, d):
    return spread(D.site(spark, d).withColumn("pattern", U.pattern(F.col("url"))), "pattern", "pos", 5).select("pattern", "i", "url")


@query(D.with_("link") + f""", x AS (SELECT DISTINCT page_id, url FROM link WHERE NOT regexp_matches(url, {q(P.LISTING_WORDS)})),
r AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(url, '/')), length(url), url)::INTEGER AS rank FROM x)
SELECT * FROM r WHERE rank <= 3""")
def listing_urls(spark, d):
    """The three shallowest, shortest urls of each page that are not listings themselves."""
    x = D.link(spark, d).select("page_id", "url").where(~F.col("url").rlike(P.LISTING_WORDS)).distinct()
    w = Window.partitionBy("page_id").orderBy(F.size(F.split("url", "/")), F.length("url"), "url")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query(D.with_("site", "link") + """, a AS (SELECT pos AS o, 0 AS src, url FROM site UNION ALL SELECT page_id * 1000 + pos, 1, url FROM link),
r AS (SELECT url, src, row_number() OVER (PARTITION BY url ORDER BY src, o) AS rn FROM a) SELECT url, src FROM r WHERE rn = 1""")
def sitemap_union(spark, d):
    """Site map before link walk, each url once."""
    a = D.site(spark, d).select(F.col("pos").alias("o"), F.lit(0).alias("src"), "url").unionByName(D.link(spark, d).select((F.col("page_id") * 1000 + F.col("pos")).alias("o"), F.lit(1).alias("src"), "url"))
    return a.groupBy("url").agg(F.min("src").alias("src"))


@query(f"""WITH c AS (SELECT page_id, {D.sql_host('url')} AS host, md5(html) AS digest, page_id AS ts FROM pages),
k AS (SELECT host, digest, max(ts) AS ts FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC)::INTEGER AS rank FROM k) SELECT * FROM r WHERE rank <= 4""")
def captures_topn(spark, d):
    """The newest four captures of each host, equal bodies once."""
    k = _pages(spark, d).groupBy(U.host(F.col("url")).alias("host"), F.md5("html").alias("digest")).agg(F.max("page_id").alias("ts"))
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("ts")))).where("rank <= 4")


@query("""SELECT page_id, unnest(regexp_extract_all(sm, '<loc>\\s*(.*?)\\s*</loc>', 1)) AS loc FROM (SELECT page_id, '<urlset><url><loc> ' || url || ' </loc></url></urlset>' AS sm FROM pages)""")
def sitemap_locs(spark, d):
    sm = _pages(spark, d).select("page_id", F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url></urlset>")).alias("sm"))
    return sm.select("page_id", F.explode(F.regexp_extract_all("sm", F.lit(r"<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"), F.lit(1))).alias("loc"))


def _fresh(name, days):
    def run(spark, d):
        return D.mirror(spark, d).where(F.lit(D.NOW) - F.col("fetched") < days * 86400).select("url", "fetched")

    run.__name__ = name
    query("WITH " + D.SQL["mirror"] + f" SELECT url, fetched FROM mirror WHERE {D.NOW} - fetched < {int(days * 86400)}")(run)


_fresh("mirror_fresh", 25)
_fresh("listing_fresh", 28.5)


@query("WITH " + D.SQL["mirror"] + " SELECT pos, url FROM site WHERE url NOT IN (SELECT url FROM mirror)")
def cache_todo(spark, d):
    return D.site(spark, d).join(D.mirror(spark, d).select("url"), "url", "left_anti").select("pos", "url")


@query("WITH " + D.SQL["mirror"] + f""", j AS (SELECT {D.sql_host('s.url')} AS host, m.url IS NOT NULL AS done FROM site s LEFT JOIN mirror m ON s.url = m.url)
SELECT host, count(*) AS total, count(*) FILTER (done) AS fetched, ((count(*) - count(*) FILTER (done)) * 5)::BIGINT AS eta_seconds FROM j GROUP BY 1""")
def cache_status(spark, d):
    j = D.site(spark, d).join(D.mirror(spark, d).select("url", F.lit(True).alias("done")), "url", "left").withColumn("host", U.host(F.col("url")))
    return j.groupBy("host").agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("fetched"), ((F.count(F.lit(1)) - F.count("done")) * 5).alias("eta_seconds"))


@query(D.with_("link") + f"SELECT page_id, count(DISTINCT {D.sql_path('url')}) >= 10 AS listing FROM link WHERE {D.sql_bare('url')} = {D.sql_bare('base')} GROUP BY 1")
def is_listing(spark, d):
    l = D.link(spark, d).where(U.bare_host(F.col("url")) == U.bare_host(F.col("base")))
    return l.groupBy("page_id").agg((F.count_distinct(U.path(F.col("url"))) >= 10).alias("listing"))


@query(D.with_("link") + "SELECT DISTINCT page_id, url FROM link WHERE regexp_matches(url, '/[0-9A-Za-z]+/?$')")
def links_in_family(spark, d):
    return D.link(spark, d).where(F.col("url").rlike(U.family_regex("/<n>"))).select("page_id", "url").distinct()


@query(D.with_("host_link") + """, n AS (SELECT host, linked, replace(split_part(regexp_replace(host, '^www\\.', ''), '.', 1), '-', '') AS name FROM host_link)
SELECT DISTINCT host, linked AS own FROM n WHERE length(name) >= 3 AND linked <> host AND contains(linked, name)""")
def own_hosts(spark, d):
    """Hosts that a site links to and whose name holds its own first label: shops, manuals and the like of one owner."""
    name = F.replace(F.split_part(F.regexp_replace("host", r"^www\.", ""), F.lit("."), F.lit(1)), F.lit("-"), F.lit(""))
    l = D.host_link(spark, d).withColumn("name", name).where((F.length("name") >= 3) & (F.col("linked") != F.col("host")))
    return l.where(F.contains("linked", F.col("name"))).select("host", F.col("linked").alias("own")).distinct()


def find_listings(hosts, learned, shaped, guessed, listings, first: int = 3, most: int = 8):
    """host, url, source: where each host keeps its index of things. The learned route if there is one; else the first of its
    listing-shaped urls (the ``first`` shallowest and shortest are looked at) that is a listing; else the first of the
    ``most`` best guessed paths that is; else none. ``learned``: host, url; ``shaped``: host, url; ``guessed``: path, score;
    ``listings``: url of the pages that are listings. One row a host; the guesses are a bounded list."""
    by_shape = Window.partitionBy("host").orderBy(F.size(F.split("url", "/")), F.length("url"), "url")
    shaped = shaped.distinct().withColumn("rank", F.row_number().over(by_shape).cast("long")).where(F.col("rank") <= first)
    best = guessed.orderBy(F.desc("score"), "path").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")).cast("long"))
    tried = hosts.crossJoin(F.broadcast(best)).select("host", F.concat(F.lit("https://"), "host", "path").alias("url"), "rank")
    row = lambda df, step, source: df.select("host", "url", F.lit(step).alias("step"), "rank" if "rank" in df.columns else F.lit(0).cast("long").alias("rank"), F.lit(source).alias("source"))
    found = row(shaped, 1, "sitemap").unionByName(row(tried, 2, "moves")).join(listings.select("url").distinct(), "url", "left_semi")
    found = found.unionByName(row(learned, 0, "learned"))
    won = found.groupBy("host").agg(F.min_by(F.struct("url", "source"), F.struct("step", "rank", "url")).alias("w"))
    return hosts.join(won, "host", "left").select("host", "w.url", F.coalesce("w.source", F.lit("none")).alias("source"))


_SHAPED = "(?i)/(en|de)/[0-9]*[02468]([/?]|$)"


@query(D.with_("site", "link") + f""", s AS (SELECT pos, url, {D.sql_host('url')} AS host FROM site), h AS (SELECT host, min(pos) AS least FROM s GROUP BY 1),
k AS (SELECT page_id FROM link GROUP BY 1 HAVING count(DISTINCT {D.sql_path('url')}) >= 5), ls AS (SELECT DISTINCT url FROM s JOIN k ON k.page_id = s.pos),
sh AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY len(string_split(url, '/')), length(url), url) AS rank FROM (SELECT DISTINCT host, url FROM s WHERE regexp_matches(url, {q(_SHAPED)}))),
g AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS rank FROM (SELECT {D.sql_path('url')} AS path, count(*) + 1.0 / min(pos + 1) AS score FROM s GROUP BY 1) ORDER BY score DESC, path LIMIT 8),
f AS (SELECT host, url, 0 AS step, 0 AS rank, 'learned' AS source FROM s WHERE pos IN (SELECT least FROM h WHERE least % 5 = 0)
 UNION ALL SELECT host, url, 1, rank, 'sitemap' FROM sh WHERE rank <= 3 AND url IN (SELECT url FROM ls)
 UNION ALL SELECT host, 'https://' || host || path, 2, rank, 'moves' FROM h, g WHERE 'https://' || host || path IN (SELECT url FROM ls)),
w AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY step, rank, url) AS rn FROM f)
SELECT h.host, w.url, coalesce(w.source, 'none') AS source FROM h LEFT JOIN w ON h.host = w.host AND w.rn = 1""")
def listing_find(spark, d):
    """The listing of each captured host."""
    s = D.site(spark, d).withColumn("host", U.host(F.col("url")))
    h = s.groupBy("host").agg(F.min_by("url", "pos").alias("url"), F.min("pos").alias("least"))
    is_index = D.link(spark, d).groupBy("page_id").agg(F.count_distinct(U.path(F.col("url"))).alias("n")).where("n >= 5")
    guessed = s.groupBy(U.path(F.col("url")).alias("path")).agg((F.count(F.lit(1)) + 1.0 / F.min(F.col("pos") + 1)).alias("score"))
    listings = s.join(is_index, F.col("pos") == F.col("page_id"), "left_semi")
    return find_listings(h.select("host"), h.where("least % 5 = 0").select("host", "url"), s.where(F.col("url").rlike(_SHAPED)).select("host", "url"), guessed, listings)
