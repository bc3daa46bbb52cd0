"""Families, samples, yields, walks and page parsing over the captured pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.operators import links as L
from corpusloom.plans import derive as D
from corpusloom.plans.registry import query
from corpusloom.plans.url_queries import spread
from corpusloom.sources import html as H

q = D.quoted
def _families(src: str, out: str) -> str:
    """The link families of the pages of ``src``, as a chain of tables that ends in ``out``."""
    o, sh, c, t, j, k = (f"{out}_{x}" for x in "osctjk")
    return f"""{o} AS (SELECT page_id, base, url, min(pos) AS pos FROM {src} WHERE {D.sql_bare('url')} = {D.sql_bare('base')} AND rtrim(url, '/') <> rtrim(split_part(base, '#', 1), '/') AND NOT regexp_matches(url, {q(P.ASSET)}) GROUP BY 1, 2, 3),
{sh} AS (SELECT *, {D.sql_pattern('url')} AS parent, {D.sql_family('url')} AS shape FROM {o}),
{c} AS (SELECT page_id, parent, shape, count(*) AS n, min(pos) AS f FROM {sh} GROUP BY 1, 2, 3),
{t} AS (SELECT page_id, parent, first(shape ORDER BY n DESC, f) AS top, max(n) AS n, sum(n) AS total FROM {c} GROUP BY 1, 2),
{j} AS (SELECT s.page_id, s.base, s.url, s.pos, s.parent, s.shape, t.top, contains(t.top, '<n>') AND t.n >= 0.8 * t.total AS num FROM {sh} s JOIN {t} t USING (page_id, parent)),
{k} AS (SELECT *, CASE WHEN num THEN top ELSE parent END AS family FROM {j} WHERE (num AND shape = top) OR (NOT num AND parent <> '/')),
{out} AS (SELECT * FROM (SELECT page_id, base, family, url, pos, count(*) OVER (PARTITION BY page_id, family) AS size FROM {k}) WHERE size >= 3) """


FAM = D.with_("site_link")[:-1] + ", " + _families("link", "fam")


@query(FAM + "SELECT page_id, family, count(*) AS links FROM fam GROUP BY 1, 2")
def link_families(spark, d):
    return L.link_families(D.site_link(spark, d)).groupBy("page_id", "family").agg(F.count(F.lit(1)).alias("links"))


@query(FAM + ", g AS (SELECT DISTINCT page_id, family FROM fam) SELECT page_id, family FROM g WHERE family NOT IN (SELECT family FROM g WHERE page_id = (SELECT min(page_id) FROM g))")
def families_minus_nav(spark, d):
    """Families that the first page does not show: those it shows are navigation further down."""
    g = L.link_families(D.site_link(spark, d)).select("page_id", "family").distinct()
    nav = g.join(F.broadcast(g.agg(F.min("page_id").alias("page_id"))), "page_id").select("family")
    return g.join(nav, "family", "left_anti").select("page_id", "family")


_UNDER = f"rtrim({D.sql_path('base')}, '/') || '/'"


@query(D.with_("child_link") + f"SELECT page_id FROM link WHERE {D.sql_host('url')} = {D.sql_host('base')} AND starts_with({D.sql_path('url')}, {_UNDER}) AND rtrim({D.sql_path('url')}, '/') || '/' <> {_UNDER} GROUP BY 1 HAVING count(DISTINCT url) >= 3")
def hub_pages(spark, d):
    """Pages with three or more children under their own path: hubs of a family, not items."""
    closed = lambda c: F.concat(F.rtrim(U.path(F.col(c)), F.lit("/")), F.lit("/"))
    l = D.child_link(spark, d).where((U.host(F.col("url")) == U.host(F.col("base"))) & F.startswith(U.path(F.col("url")), closed("base")) & (closed("url") != closed("base")))
    return l.groupBy("page_id").agg(F.count_distinct("url").alias("n")).where("n >= 3").select("page_id")


_WORDS = ["tion", "ment", "ung", "ción"]


@query(D.with_("link") + f""", o AS (SELECT page_id, url, min(pos) AS pos FROM link WHERE {D.sql_host('url')} = {D.sql_host('base')} AND regexp_matches(lower(url), '{'|'.join(_WORDS)}') AND NOT regexp_matches(url, {q(P.ASSET)}) GROUP BY 1, 2),
r AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INTEGER AS rank FROM o) SELECT * FROM r WHERE rank <= 3""")
def want_links(spark, d):
    """The first three links of a page that hold a word of what is wanted."""
    hay = F.lower("url")
    l = D.link(spark, d).where((U.host(F.col("url")) == U.host(F.col("base"))) & F.exists(F.array(*[F.lit(w) for w in _WORDS if w not in P.STEER_STOP]), lambda w: F.contains(hay, w)) & ~U.is_asset(F.col("url")))
    o = l.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("rank <= 3").select("page_id", "url", "rank")


@query(D.with_("link") + f""", o AS (SELECT page_id, url, min(pos) AS pos, len(list_filter(['tion', 'ment', 'the'], lambda w: contains(lower(url), w))) AS hits FROM link WHERE {D.sql_host('url')} = {D.sql_host('base')} GROUP BY 1, 2),
r AS (SELECT page_id, url, hits, row_number() OVER (PARTITION BY page_id ORDER BY hits DESC, pos)::INTEGER AS rank FROM o WHERE hits >= 1) SELECT page_id, url, hits::INTEGER AS hits, rank FROM r WHERE rank <= 2""")
def sibling_links(spark, d):
    """Links that share most words with a request, the best two."""
    hits = F.size(F.filter(F.array(F.lit("tion"), F.lit("ment"), F.lit("the")), lambda w: F.contains(F.lower("url"), w)))
    o = D.link(spark, d).where(U.host(F.col("url")) == U.host(F.col("base"))).groupBy("page_id", "url").agg(F.min("pos").alias("pos")).withColumn("hits", hits).where("hits >= 1")
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("hits"), "pos"))).where("rank <= 2").select("page_id", "url", "hits", "rank")


_VOTE = ", v AS (SELECT page_id, CASE WHEN size >= 10 THEN 'index' ELSE 'page' END AS kind, count(*) AS n, min(pos) AS f FROM fam GROUP BY 1, 2) SELECT page_id, first(kind ORDER BY n DESC, f) AS leads_to FROM v GROUP BY 1"


@query(FAM + _VOTE)
def majority_vote(spark, d):
    f = L.link_families(D.site_link(spark, d)).withColumn("kind", F.when(F.col("size") >= 10, "index").otherwise("page"))
    return L.majority(f, ["page_id"])


@query(FAM + """, i AS (SELECT *, row_number() OVER (PARTITION BY page_id, family ORDER BY pos) - 1 AS i FROM fam),
p AS (SELECT * FROM i WHERE i IN (size * 1 // 6, size * 2 // 6, size * 3 // 6, size * 4 // 6, size * 5 // 6)),
g AS (SELECT page_id, family, max(size) AS links, count(*) AS got, count(*) FILTER (length(url) % 3 <> 0) AS good FROM p GROUP BY 1, 2)
SELECT page_id, family, CASE WHEN good >= 2 THEN links * good * 1000 // got ELSE 0 END AS yield_milli FROM g""")
def family_yield(spark, d):
    """Size of a family times the share of good pages in a spread sample, in thousandths; 0 below two good ones."""
    f = L.link_families(D.site_link(spark, d)).withColumn("key", F.struct("page_id", "family"))
    s = spread(f.drop("size").withColumn("links", F.col("pos")), "key", "pos", 5)
    g = s.groupBy("page_id", "family").agg(F.count(F.lit(1)).alias("got"), F.count_if(F.length("url") % 3 != 0).alias("good"))
    n = f.groupBy("page_id", "family").agg(F.count(F.lit(1)).alias("links"))
    y = F.when(F.col("good") >= 2, F.floor(F.col("links") * F.col("good") * 1000 / F.col("got"))).otherwise(F.lit(0))
    return g.join(n, ["page_id", "family"]).select("page_id", "family", y.cast("long").alias("yield_milli"))


def _sampled(src: str, n: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, family ORDER BY pos) - 1 AS i FROM {src}) WHERE i IN ({', '.join(f'size * {k} // {n + 1}' for k in range(1, n + 1))})"


@query(FAM + ", c" + D.SQL["child_link"] + ", " + _families("clink", "sub") + f""", a AS ({_sampled('fam', 5)}),
b AS (SELECT a.*, s.pos AS page, length(a.url) % 3 <> 0 AS good, EXISTS (SELECT 1 FROM sub WHERE sub.page_id = s.pos) AS idx FROM a JOIN site s ON s.url = a.url),
v AS (SELECT page_id, family, max(size) AS links, count(*) AS got, count(*) FILTER (good) AS good, count(*) FILTER (good AND idx) AS n_idx, count(*) FILTER (good AND NOT idx) AS n_page, min(pos) FILTER (good AND idx) AS f_idx, min(pos) FILTER (good AND NOT idx) AS f_page, arg_min(page, pos) FILTER (good AND idx) AS rep FROM b GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN n_idx > n_page OR (n_idx = n_page AND f_idx < f_page) THEN 'index' WHEN n_page > 0 THEN 'page' END AS leads_to, CASE WHEN good >= 2 THEN links * good // got ELSE 0 END AS y0 FROM v),
z AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0 DESC, family) AS place FROM y),
under AS (SELECT z.page_id, z.family AS above, sub.family, sub.url, sub.pos, sub.size FROM z JOIN sub ON sub.page_id = z.rep WHERE place <= 2 AND leads_to = 'index' AND y0 > 0 AND NOT EXISTS (SELECT 1 FROM fam WHERE fam.page_id = z.page_id AND fam.family = sub.family)),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, above, family ORDER BY pos) - 1 AS i FROM under),
w AS (SELECT page_id, above, family, max(size) * count(*) FILTER (length(url) % 3 <> 0) // count(*) AS y1, count(*) FILTER (length(url) % 3 <> 0) AS good FROM d WHERE i IN (size * 1 // 4, size * 2 // 4, size * 3 // 4) GROUP BY 1, 2, 3),
x AS (SELECT page_id, above, first(family ORDER BY y1 DESC, family) AS below, max(y1) AS y1 FROM w WHERE good >= 1 GROUP BY 1, 2)
SELECT z.page_id, z.family, z.leads_to, x.below, (y0 * coalesce(x.y1, 1))::BIGINT AS estimated FROM z LEFT JOIN x ON x.page_id = z.page_id AND x.above = z.family""")
def family_walk(spark, d):
    """Which of a site's link families lead to good pages, and to how many: spread samples, a majority vote on what they are (an
    index of more links, or pages), and a look one level deeper under the two best index families, whose yields multiply.
    What the upper page already shows is navigation below. (Good is a stand-in test on the url, as in ``family_yield``.)"""
    good = F.length("url") % 3 != 0
    top = L.link_families(D.site_link(spark, d))
    sub = L.link_families(D.child_link(spark, d))
    pages = D.site(spark, d).select(F.col("pos").alias("page"), "url").join(sub.select(F.col("page_id").alias("page"), F.lit(True).alias("idx")).distinct(), "page", "left")
    keyed = lambda f, *by: f.withColumn("key", F.struct(*by)).withColumnRenamed("size", "links")
    s = spread(keyed(top, "page_id", "family"), "key", "pos", 5).join(pages, "url").withColumns({"good": good, "idx": F.coalesce("idx", F.lit(False))})
    index = F.col("good") & F.col("idx")
    v = s.groupBy("page_id", "family").agg(
        F.max("links").alias("links"), F.count(F.lit(1)).alias("got"), F.count_if("good").alias("good"), F.count_if(index).alias("n_index"), F.count_if(F.col("good") & ~F.col("idx")).alias("n_page"),
        F.min(F.when(index, F.col("pos"))).alias("f_index"), F.min(F.when(F.col("good") & ~F.col("idx"), F.col("pos"))).alias("f_page"), F.min_by(F.when(index, F.col("page")), F.when(index, F.col("pos"))).alias("rep"),
    )
    kind = F.when((F.col("n_index") > F.col("n_page")) | ((F.col("n_index") == F.col("n_page")) & (F.col("f_index") < F.col("f_page"))), "index").when(F.col("n_page") > 0, "page")
    y = v.withColumns({"leads_to": kind, "own": F.when(F.col("good") >= 2, F.floor(F.col("links") * F.col("good") / F.col("got"))).otherwise(F.lit(0))})
    y = y.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("own"), "family")))
    deeper = y.where("place <= 2 and leads_to = 'index' and own > 0").select(F.col("page_id").alias("root"), F.col("family").alias("above"), F.col("rep").alias("page_id"))
    under = deeper.join(sub, "page_id").drop("page_id").join(top.select(F.col("page_id").alias("root"), "family").distinct(), ["root", "family"], "left_anti")
    u = spread(keyed(under, "root", "above", "family"), "key", "pos", 3).groupBy("root", "above", "family").agg(F.max("links").alias("links"), F.count(F.lit(1)).alias("got"), F.count_if(good).alias("good"))
    u = u.where("good >= 1").withColumn("more", F.floor(F.col("links") * F.col("good") / F.col("got")))
    first = F.row_number().over(Window.partitionBy("root", "above").orderBy(F.desc("more"), "family"))
    u = u.withColumn("r", first).where("r = 1").select(F.col("root").alias("page_id"), F.col("above").alias("family"), F.col("family").alias("below"), "more")
    out = y.join(u, ["page_id", "family"], "left")
    return out.select("page_id", "family", "leads_to", "below", (F.col("own") * F.coalesce("more", F.lit(1))).cast("long").alias("estimated"))


@query(D.with_("link") + f""", e AS (SELECT DISTINCT {D.sql_host('base')} AS src, split_part({D.sql_path('url')}, '/', 2) AS dst FROM link),
a AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), l1 AS (SELECT DISTINCT dst AS node FROM a WHERE src = (SELECT min(src) FROM e)),
l2 AS (SELECT DISTINCT a.dst AS node FROM a JOIN l1 ON a.src = l1.node), s AS (SELECT min(src) AS node FROM e)
SELECT node, min(level)::INTEGER AS level FROM (SELECT node, 0 AS level FROM s UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2) GROUP BY 1""")
def link_walk(spark, d):
    """What is reached from one host in two steps over sections that hosts share."""
    D.checkpoints(spark)
    e = D.link(spark, d).select(U.host(F.col("base")).alias("src"), F.split_part(U.path(F.col("url")), F.lit("/"), F.lit(2)).alias("dst")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return L.walk(both, e.agg(F.min("src").alias("node")), 2)


def _parsed(spark, d):
    return H.parse_pages(D.table(spark, d, "pages"))


@query()
def page_text(spark, d):
    return _parsed(spark, d).select("page_id", "text", "n_scripts")


@query()
def page_links(spark, d):
    return _parsed(spark, d).select("page_id", F.inline("links"))


def _unescaped(e: str) -> str:
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        e = f"replace({e}, '&{name};', '{sign}')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


_TITLE, _HEADING = (_unescaped(f"regexp_extract(html, '<{a}>([^<]*)</{b}>', 1)") for a, b in (("title", "title"), ("h[12]", "h[12]")))


@query(f"SELECT page_id, CASE WHEN regexp_matches({_TITLE}, '[A-Za-z0-9]') OR {_HEADING} = '' THEN {_TITLE} ELSE left({_HEADING}, 200) END AS title FROM pages")
def page_title(spark, d):
    return _parsed(spark, d).select("page_id", "title")


@query()
def page_shell(spark, d):
    return _parsed(spark, d).select("page_id", X.shell(F.col("text"), F.col("n_scripts")).alias("shell"))


@query()
def jsonld_nodes(spark, d):
    """Typed nodes of structured data; the captured pages carry none, so each is given one from its id."""
    given = F.concat(F.col("html"), F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"P'), F.col("page_id").cast("string"), F.lit('","offers":[{"price":"'), F.col("page_id").cast("string"), F.lit('.50"}]}]}</script>'))
    p = H.parse_pages(D.table(spark, d, "pages").withColumn("html", given))
    return p.select("page_id", F.explode("jsonld").alias("node")).select("page_id", F.get_json_object("node", "$.sku").alias("sku"), X.dig(F.col("node"), "offers.price").alias("price"))


@query()
def block_text(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.array_join(H.blocks_of_class(F.col("html"), F.lit("ad*")), "\n").alias("text"))


@query("SELECT doc_id, text FROM documents WHERE regexp_matches(text, '^[\\x00-\\xFF]*$') AND NOT regexp_matches(text, '[\\x80-\\x9F]')")
def decode_text(spark, d):
    """Latin texts written in a one-byte charset come back as they were."""
    t = D.table(spark, d, "documents").where(F.col("text").rlike(r"^[\x00-\xFF]*$") & ~F.col("text").rlike(r"[\x80-\x9F]"))
    return t.select("doc_id", H.decoded(F.encode("text", "ISO-8859-1"), F.lit("text/html; charset=iso-8859-1")).alias("text"))


@query("SELECT page_id, NOT starts_with(" + D.sql_path("url") + ", '/fr') AS allowed FROM pages")
def robots_allow(spark, d):
    rules = F.lit("User-agent: *\nDisallow: /fr\n")
    return D.table(spark, d, "pages").select("page_id", H.robots_allowed(rules, F.lit("reader"), F.col("url")).alias("allowed"))
