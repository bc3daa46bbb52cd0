"""Known inputs and outputs of single operators."""

import http.server
import io
import json
import threading
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.operators import holds, links, outcomes, sections
from corpusloom.plans import recipes
from corpusloom.plans.host_queries import contrast
from corpusloom.plans.url_queries import ranked_patterns, spread
from corpusloom.sources import archives, html


def values(spark, rows, f, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(f).collect()]


def test_urls(spark):
    x = F.col("x")
    assert values(spark, ["https://x.com/product/RB2011-UiAS", "https://x.com/a/12/b", "https://x.com"], U.pattern(x)) == ["/product/*", "/a/N/*", "/"]
    fam = ["https://h/Laws/Chapter_14A.html", "https://h/Laws/Chapter_1.html", "https://h/NHTOC-XIV", "https://h/products/dime-evo", "https://h/a/I/V/x"]
    assert values(spark, fam, U.family(x)) == ["/Laws/Chapter_<n>.html"] * 2 + ["/NHTOC-<n>", "/products/*", "/a/<n>/<n>/x"]
    assert values(spark, ["https://h/us/en/products", "https://h/en-gb/x", "https://h/products", "https://h/en"], U.locale(x)) == ["/us/en", "/en-gb", "", "/en"]
    assert values(spark, ["http://X.com:80/a?utm_source=1&b=2&c=#f"], U.canonical(x)) == ["https://x.com/a?b=2"]
    assert values(spark, ["CRS354-48G-4S+2Q+RM", "crs354_48g_4splus2qplusrm"], U.slug_key(x, [("plus|[+]", ""), ("[^a-z0-9]", "")])) == ["crs35448g4s2qrm"] * 2
    assert values(spark, ["a b/c"], U.encoded(x)) == ["a%20b%2Fc"]
    flags = ["/en/blogs/1/x", "/en/newsroom/press-releases/x", "/en/partners/x", "/request-a-quote", "/en/products/x", "/c/en/us/support/x"]
    assert values(spark, flags, x.rlike(P.EDITORIAL)) == [True] * 4 + [False] * 2
    assert values(spark, ["/ch/14A/", "/ch/14/x/"], x.rlike("^" + U.family_regex("/ch/<n>/").replace("/?$", "$"))) == [True, False]


def test_goal(spark):
    j = lambda title, text, shell=False, want="": values(spark, [(title, text)], X.judge(F.col("a"), F.col("b"), F.lit(shell), want), "a string, b string")[0]
    assert [j("", "x" * 400), j("", "x" * 400, want="price"), j("", "Just a moment... " + "x" * 400), j("", "x", True), j("404 Not Found", "x" * 400), j("", " \n"), j("", "short")] == ["ok", "want_miss", "challenge", "js_shell", "error_page", "empty", "thin"]
    texts = ["Blocked 203.0.113.7 for assistance EMAIL: webmaster@example.gov", "A person blocked from voting may appeal.", "Your IP address is logged.", "Access Denied ... Reference #18.5b2d1102"]
    assert values(spark, texts, X.blocked(F.col("x"))) == [True, False, False, True]


def test_text(spark):
    x = F.col("x")
    assert values(spark, ["The courts enumerated in section 1-101 are courts of record and shall keep a seal."], X.prose_milli(x))[0] > 600
    assert values(spark, ["Home Products Support Contact Careers News Partners Login Register"], X.prose_milli(x))[0] < 300
    good = "A normal sentence about the statute that the legislature enacted for the people of this state in that year."
    eaten = "A cour of record shall keep minu es of every session held by i s officers; hese papers remain o be read by any person who asks for copies ha concern real es a e, lands or deb s."
    assert values(spark, [good, "Skip navigation Home", eaten], X.not_content(x)) == ["", "chrome", "letters missing"]
    assert values(spark, ["a *b*  `c` | d", None], X.clean(x)) == ["a b c d", ""]
    tails = ["Crucial T705 4TB | CT4000T705SSD5 | crucial.com", "Wiring Devices | Lighting Controls"]
    assert values(spark, tails, X.untail(x, F.lit("crucial"))) == ["Crucial T705 4TB", tails[1]]
    js = json.dumps({"offers": [{"price": "565.99"}], "sku": "C"})
    assert values(spark, [js], X.dig(x, "offers.price")) == ["565.99"] and values(spark, [js], X.dig(x, "sku")) == ["C"]
    cases = [(403, False, True, "", True, "challenge"), (429, False, False, "", True, "rate_limited"), (403, False, False, "", True, "refused"), (503, False, False, "", True, "server_error"), (200, True, False, "", True, "blocked"), (None, False, False, "net::ERR_HTTP2_PROTOCOL_ERROR", True, "silent_refusal"), (None, False, False, "SSL x", True, "tls")]
    got = values(spark, [c[:5] for c in cases], X.fetch_outcome(F.col("s"), F.col("b"), F.col("c"), F.col("d"), F.col("r")), "s int, b boolean, c boolean, d string, r boolean")
    assert got == [c[5] for c in cases]
    assert values(spark, ["k1 and a%2Fb and a/b"], X.scrub(x, ["k1", "a/b"])) == ["[key] and [key] and [key]"]
    assert values(spark, ["Legi-Scan!"], X.keyname(x)) == ["LEGI_SCAN"]


def test_every_outcome_has_a_code(spark):
    assert outcomes.dimension(spark).where("code = ''").count() == 0 and len({o for o, _ in P.PRIORITY}) == 21
    hosts = spark.createDataFrame([("se.com",), ("x.org",)], "host string")
    assert [r["host"] for r in outcomes.scope_regexes(hosts, ["se[.]com", "("]).collect()] == ["se.com"]


def test_families_and_ranking(spark):
    rows = [(1, "https://h.com/list", i, f"https://www.h.com/ch/{i}/") for i in range(5)] + [(1, "https://h.com/list", 9, "https://h.com/a.png"), (1, "https://h.com/list", 10, "https://o.com/ch/7/")]
    rows += [(2, "https://h.com/p", i, f"https://h.com/product/{s}") for i, s in enumerate(["RB2", "crs", "hap-ac3", "dime"])]
    df = spark.createDataFrame(rows, "page_id long, base string, pos long, url string")
    assert {(r["page_id"], r["family"], r["size"]) for r in links.link_families(df).select("page_id", "family", "size").distinct().collect()} == {(1, "/ch/<n>/", 5), (2, "/product/*", 4)}
    site = spark.createDataFrame([(i, f"https://x.com/en/blogs/{i}/a") for i in range(60)] + [(100 + i, f"https://x.com/en/products/p{i}") for i in range(4)], "pos long, url string")
    assert [r["pattern"] for r in ranked_patterns(site).collect()] == ["/en/products/*", "/en/blogs/N/*"]
    s = spread(spark.createDataFrame([(1, i) for i in range(10)], "g long, pos long"), "g", "pos", 3)
    assert sorted(r["pos"] for r in s.collect()) == [2, 5, 7]


def test_credit_by_contrast(spark):
    t = spark.createDataFrame([(1, 1, "/en", "/products", False), (1, 2, "", "/products", True), (2, 1, "/de", "/shop", False)], "g long, at long, prefix string, root string, won boolean")
    got = {(r["slot"], r["value"]): (r["tries"], r["wins"]) for r in contrast(t, ["g"], "at", ["prefix", "root"]).collect()}
    assert got == {("prefix", "/en"): (1, 0), ("prefix", ""): (1, 1), ("root", "/products"): (1, 1)}


def test_holds_double_and_slow():
    one = holds.fold(None, [(0, "blocked", 0.0)])
    two = holds.fold(one, [(2000, "blocked", 0.0)])
    assert one[2] == 1800 and two[2] - 2000 == 3600 and two[3] >= 2 * one[3] and one[3] >= 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=30).map(sorted), st.integers(1, 40))
def test_closed_form_of_the_schedule(arrivals, gap):
    start, want = None, []
    for a in arrivals:
        start = a if start is None else max(a, start + gap)
        want.append(start)
    best, got = None, []
    for i, a in enumerate(arrivals):
        best = a - i * gap if best is None else max(best, a - i * gap)
        got.append(i * gap + best)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.sampled_from(["blocked", "archive", "rate_limited", "silent_refusal", "server_error"]), st.floats(0, 1e6)), max_size=12))
def test_pace_never_quickens(events):
    state, pace = None, 1.0
    for e in sorted(events):
        state = holds.fold(state, [e])
        assert state[3] >= pace and state[2] - state[1] <= P.HOLD_MOST
        pace = state[3]


def test_html():
    page = html.parse('<head><title>=====</title></head><nav><a href="/x#f">Menu</a></nav><article><h1>AMD Ryzen</h1><p>One <b>two<p>three &amp; four<script>var t="</p>"</script></article><footer>no</footer>', "https://h.com/a/b")
    assert page["title"] == "AMD Ryzen" and page["links"] == [("https://h.com/x", "Menu")] and page["text"] == "# AMD Ryzen\nOne two\nthree & four"
    ld = html.parse('<script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"C"},3]}</script><script type="application/ld+json">{bad</script>', "https://h.com")
    assert [json.loads(n)["sku"] for n in ld["jsonld"]] == ["C"] and ld["n_scripts"] == 2
    text = '<nav>x</nav><div id="law"><p>(1) A person may vote.</p><p>(2) Ballots are secret.</p></div>'
    assert html.block_texts(text, id="law") == ["(1) A person may vote.\n(2) Ballots are secret."] and html.block_texts(text, cls="none") == []
    assert html.decode("§ 1-1".encode(), "text/html; charset=utf-16") == "§ 1-1" and html.decode("§ 1".encode("cp1252")) == "§ 1"
    for told in ("text/html; charset=utf-8", "text/html; charset=UTF8", "text/html; charset=no-such", "text/html; charset=utf-16"):
        assert html.decode("§ 1".encode("cp1252"), told) == "§ 1"
    assert html.decode(b"<meta charset='koi8-r'>" + "да".encode("koi8-r")).endswith("да") and html.decode("§".encode("utf-16"), "charset=utf-16") == "§" and html.decode(b"") == ""
    odd = '<div class="box a"><p>one<div>in</div><script>var x</script></div><p class=boxes>two</p><div class="box b">three'
    assert html.block_texts(odd, cls="box") == ["one\nin", "three"] and html.block_texts(odd, cls="box*") == ["one\nin", "two", "three"] and html.block_texts(odd, attr=("class", "boxes")) == ["two"] and html.block_texts(odd) == []


def test_recipes(spark):
    assert recipes.compile_recipe("bad name", [{"reach": "x"}])[0] == "BAD_NAME"
    assert recipes.compile_recipe("a.com/x", [{"reach": "https://a.com/{input}"}], ["one"])[0] == "NEED_EXAMPLES"
    assert recipes.compile_recipe("a.com/x", [{"find": "x"}])[0] == "BAD_STEPS"
    for bad in (None, [], [3], [{}], [{"go": 1}], [{"reach": "x"}, {"extract": {}}], [{"reach": "x"}, {"jsonld": "a"}], [{"map": "x", "same": [["a"]]}], [{"map": "x", "same": [["(", "b"]]}], [{"input": "a"}, {"reach": "x"}], [{"input": [["a", "b"]]}], [{"reach": "x", "want": "("}]):
        assert recipes.check_steps(bad), bad
    for good in ([{"input": [["a", "b"]]}, {"reach": "x"}], [{"map": "x", "same": [["a", "b"]], "want": "{input}"}, {"jsonld": {"a": "b.c"}}, {"find": "{url}"}]):
        assert not recipes.check_steps(good), good
    assert recipes.check_steps([{"reach": "x"}, {"extract": {"a": r"^([^\\t]+)$"}}]) != "" and recipes.check_steps([{"reach": "x"}, {"extract": {"a": r"^([^\t]+)$"}}]) == ""
    text = "The record of the court shall be kept by the clerk of that court for any person. " * 8
    page = spark.createDataFrame([("https://a.com/A.1", "T", text + "\nRAM for A.1: 8 GB\nRAM for AX1: 9 GB", [(0, "https://a.com/s/A.1", "Specs")], [])], "url string, title string, text string, links array<struct<pos:int,url:string,text:string>>, jsonld array<string>")
    inputs = spark.createDataFrame([("A.1",), ("none",)], "raw string")
    out = {r["raw"]: r["line"] for r in recipes.run_recipe("a.com/x", [{"reach": "https://a.com/{input}"}, {"extract": {"ram": "RAM for {input}: [0-9]+ GB"}}], inputs, page).collect()}
    assert out["A.1"].endswith("ram=RAM for A.1: 8 GB") and out["none"] == "RESULT: fail | a.com/x | none | NOT_CACHED at step 1"


def test_sections(spark):
    assert sorted(["10", "9a", "9"], key=dict(zip(["10", "9a", "9"], values(spark, ["10", "9a", "9"], sections.natural_key(F.col("x"))))).get) == ["9", "9a", "10"]
    long = ["9" * 14, "1" + "0" * 14, "x2", "x10", "x010", "7b12", "7b2"]
    keys = dict(zip(long, values(spark, long, sections.natural_key(F.col("x")))))
    assert keys["9" * 14] < keys["1" + "0" * 14] and keys["x2"] < keys["x10"] == keys["x010"] and keys["7b2"] < keys["7b12"]
    v = spark.createDataFrame([(1, 1, "1997-01-01"), (1, 2, "1999-01-01"), (2, 1, "1999-05-05"), (2, 2, "2000-01-01")], "k long, seq int, effective string").withColumn("effective", F.to_date("effective"))
    assert {(r["k"], r["seq"]) for r in sections.in_force(v, ["k"], F.lit("1998-01-01").cast("date")).collect()} == {(1, 1), (2, 1)}


def test_statute_policies(spark):
    """What each state's policy makes of repeated, dated and joint ids; repeated lines stay but for running heads."""
    from corpusloom.sources import statutes

    def run(state, text, **k):
        d = spark.createDataFrame([(1, "u", "T", "Art.", text)], "doc_id long, url string, title string, kind string, text string")
        return {(r["citation"], r["text"]) for r in statutes.sections(d, state, **k).collect()}

    two = "§ 5. One (Effective until July 1, 2030)\nold\n§ 5. One (Effective July 1, 2030)\nnew\n§ 6. Two\n(a) Reserved.\n(a) Reserved.\n(a) Reserved."
    six = ("Va. Code § 6", "§ 6. Two\n(a) Reserved.\n(a) Reserved.\n(a) Reserved.")
    assert run("va", two, today="2026-01-01") == {("Va. Code § 5", "§ 5. One (Effective until July 1, 2030)\nold"), six}
    assert run("va", two, today="2031-01-01") == {("Va. Code § 5", "§ 5. One (Effective July 1, 2030)\nnew"), six}
    assert run("me", "§3. A (REPEALED)\nx\n§3. A\ny") == {("T M.R.S. § 3", "§3. A\ny")}
    assert run("nj", "1:2-3 A\nx\n1:2-3 A\ny\n1:2-4 B\n1:2-3 C") == {("N.J. Stat. § 1:2-3", "1:2-3 A\nx\n1:2-3 A\ny"), ("N.J. Stat. § 1:2-4", "1:2-4 B"), ("N.J. Stat. § 1:2-3", "1:2-3 C")}
    assert run("mi", "2.104, 2.105 Repealed. 1990") == {("MCL 2.104", "2.104, 2.105 Repealed. 1990"), ("MCL 2.105", "2.104, 2.105 Repealed. 1990")}
    assert run("tx", "Sec. 1.01. A\nx\nSec. 1.01. A\ny") == {("Tex. T § 1.01", "Sec. 1.01. A\nx\n\nSec. 1.01. A\ny")}
    assert run("ne", "1-101 A\nx\n1-101 A\ny") == {("Neb. Rev. Stat. § 1-101", "1-101 A\nx")}
    assert run("pr", "LEY\nArtículo 1. A\nLEY\na longer text\nArtículo 1. Short") == {("Ley T, Art. 1", "Artículo 1. A\na longer text")}


def test_archives(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("b.txt", "§".encode("utf-16"))
    files = spark.createDataFrame([("z.zip", bytearray(raw.getvalue()))], "path string, content binary")
    assert {(r["name"], r["text"]) for r in archives.zip_entries(files).collect()} == {("a.txt", "one"), ("b.txt", "§")}
    mixed = "<loc>https://h/sitemap-of-parts</loc><loc>https://h/p</loc>"
    maps = spark.createDataFrame([("r.xml", "<sitemapindex><loc>c.xml</loc><loc>m</loc></sitemapindex>"), ("m", mixed), ("c.xml", "<loc> https://h/1 </loc><loc><![CDATA[https://h/2]]></loc>"), ("t", "see https://h/3, and https://h/4.")], "url string, body string")
    roots = spark.createDataFrame([("r.xml",), ("t",)], "url string")
    assert {r["loc"] for r in archives.sitemap_tree(maps, roots).collect()} == {f"https://h/{i}" for i in (1, 2, 3, 4, "p", "sitemap-of-parts")}


@pytest.fixture
def server():
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = {"/robots.txt": b"User-agent: *\nDisallow: /no\n", "/a": b"<p>hi</p>"}.get(self.path)
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(body or b"gone")

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_web_source(spark, server):
    from corpusloom.sources.web import WebSource

    spark.dataSource.register(WebSource)
    urls = [f"{server}/{x}" for x in ("a", "no", "missing")] + ["http://held.example/"]
    df = spark.read.format("captures").option("urls", json.dumps(urls)).option("pace", "0").option("holds", '["held.example"]').load()
    got = {r["url"].rsplit("/", 1)[1]: (r["status"], r["error"]) for r in df.collect()}
    assert got == {"a": (200, None), "no": (None, "robots_disallowed"), "missing": (404, None), "": (None, "held")}


def test_stream_agrees_with_batch(spark):
    from corpusloom import plans

    q, _ = plans.load()
    d = "/root/testdata/sf0.001"
    rows = lambda n: sorted(map(tuple, q[n](spark, d).select("host", "n", "since", "until", "pace").collect()))
    assert rows("hold_backoff") == rows("stream_hold_backoff")
