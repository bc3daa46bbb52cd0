"""Moves, readers, holds, failures and reports over the log of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators import outcomes as O
from corpusloom.plans import derive as D
from corpusloom.plans.registry import query

q = D.quoted
A, M = D.with_("attempt"), D.with_("move")
_SCORE = "(wins + 1)::DOUBLE / (tries + 2)"


def score(m: DataFrame) -> DataFrame:
    return m.withColumn("score", (F.col("wins") + 1) / (F.col("tries") + 2))


@query(M + f"SELECT id, {_SCORE} AS score FROM move")
def move_score(spark, d):
    return score(D.move(spark, d)).select("id", "score")


@query(M + f"SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY {_SCORE} DESC, id)::INTEGER AS rank FROM move")
def moves_ranked(spark, d):
    return score(D.move(spark, d)).select("id", "kind", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "id")).alias("rank"))


@query(M + f", r AS (SELECT id, kind, scope, row_number() OVER (PARTITION BY kind, scope ORDER BY {_SCORE} DESC, id)::INTEGER AS rank FROM move) SELECT * FROM r WHERE rank <= 3")
def moves_topk(spark, d):
    w = Window.partitionBy("kind", "scope").orderBy(F.desc("score"), "id")
    return score(D.move(spark, d)).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("id", "kind", "scope", "rank")


@query(M + "SELECT id, NOT (kind NOT IN ('locale_prefix', 'listing_root') AND tries >= 5 AND wins = 0) AS alive FROM move")
def moves_alive(spark, d):
    dead = ~F.col("kind").isin("locale_prefix", "listing_root") & (F.col("tries") >= P.PRUNE_TRIES) & (F.col("wins") == 0)
    return D.move(spark, d).select("id", (~dead).alias("alive"))


@query("WITH " + D.SQL["move"] + ", " + D.SQL["attempt"] + ", h AS (SELECT DISTINCT host FROM attempt) SELECT m.id, h.host FROM move m JOIN h ON m.scope = '*' OR h.host = m.scope OR ends_with(h.host, '.' || m.scope)")
def move_scope(spark, d):
    """Moves that apply to hosts: each host meets its own suffixes, so the theta join is an equi-join. Scopes that are
    expressions are few and are matched on the side (``operators.outcomes.scope_regexes``)."""
    hosts = D.attempt(spark, d).select("host").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    keyed = hosts.select("host", F.explode(F.concat(suffixes, F.array(F.lit("*")))).alias("scope"))
    return D.move(spark, d).join(keyed, "scope").select("id", "host")


_CREDIT = """, t AS (SELECT req_id, secs // 86400 AS day, host, user_id % 5 AS prefix, k % 7 AS root, outcome = 'ok' AS won FROM attempt),
g AS (SELECT *, row_number() OVER (PARTITION BY day, host ORDER BY CASE WHEN won THEN 0 ELSE 1 END, req_id) AS rn FROM t),
w AS (SELECT day, host, prefix AS wp, root AS wr, req_id AS wid FROM g WHERE rn = 1 AND won),
s AS (SELECT 'prefix' AS slot, wp AS value, 1 AS tries, 1 AS wins FROM w UNION ALL SELECT 'root', wr, 1, 1 FROM w
 UNION ALL SELECT 'prefix', prefix, 1, 0 FROM t JOIN w USING (day, host) WHERE req_id < wid AND prefix <> wp UNION ALL SELECT 'root', root, 1, 0 FROM t JOIN w USING (day, host) WHERE req_id < wid AND root <> wr)
SELECT slot, value, sum(tries)::BIGINT AS tries, sum(wins)::BIGINT AS wins FROM s GROUP BY 1, 2"""


def contrast(tried: DataFrame, group: list[str], order: str, slots: list[str]) -> DataFrame:
    """Learning by contrast: the first winner of a group scores on every slot; the losers before it lose only on slots in
    which they differ from it; without a winner nothing is scored."""
    win = tried.where("won").groupBy(*group).agg(F.min_by(F.struct(order, *slots), order).alias("w"))
    wins = win.select(*[F.col(f"w.{s}").alias(s) for s in slots])
    lost = tried.join(win, group).where(F.col(order) < F.col(f"w.{order}")).select(*[F.when(F.col(s) != F.col(f"w.{s}"), F.col(s)).alias(s) for s in slots])
    long = lambda x, n: x.select(F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("value")) for s in slots])).alias("s")).select("s.*", F.lit(n).alias("won")).where("value is not null")
    return long(wins, 1).unionByName(long(lost, 0)).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("tries"), F.sum("won").cast("long").alias("wins"))


@query(A + _CREDIT)
def credit_contrast(spark, d):
    t = D.attempt(spark, d).select("req_id", F.floor(F.col("secs") / 86400).alias("day"), "host", (F.col("user_id") % 5).alias("prefix"), (F.col("k") % 7).alias("root"), (F.col("outcome") == "ok").alias("won"))
    return contrast(t, ["day", "host"], "req_id", ["prefix", "root"])


_MEMORY = """, x AS (SELECT host, reader, max(secs * 1000000 + req_id) FILTER (outcome = 'ok') AS ok, max(secs * 1000000 + req_id) FILTER (outcome NOT IN ('ok', 'not_found')) AS bad FROM attempt GROUP BY 1, 2)"""


def reader_state(a: DataFrame) -> DataFrame:
    """Per host and reader: the last success and the last failure that counts."""
    at = F.col("secs") * 1000000 + F.col("req_id")
    return a.groupBy("host", "reader").agg(F.max(F.when(F.col("outcome") == "ok", at)).alias("ok"), F.max(F.when(~F.col("outcome").isin("ok", "not_found"), at)).alias("bad"))


@query(A + _MEMORY + " SELECT host, reader, ok, CASE WHEN bad > coalesce(ok, -1) THEN bad END AS dead FROM x")
def reader_memory(spark, d):
    return reader_state(D.attempt(spark, d)).select("host", "reader", "ok", F.when(F.col("bad") > F.coalesce("ok", F.lit(-1)), F.col("bad")).alias("dead"))


@query(A + _MEMORY + f""", m AS (SELECT host, reader, ok, CASE WHEN bad > coalesce(ok, -1) THEN bad END AS dead FROM x),
w AS (SELECT host, arg_max(reader, ok) AS winner FROM m WHERE dead IS NULL AND ok IS NOT NULL GROUP BY 1)
SELECT m.host, reader, row_number() OVER (PARTITION BY m.host ORDER BY reader <> coalesce(winner, ''), coalesce({D.NOW} - dead // 1000000 < {P.DEAD_TTL}, false), list_position({list(P.READERS)}, reader))::INTEGER AS rank FROM m LEFT JOIN w ON m.host = w.host""")
def reader_order(spark, d):
    """The ladder of readers of each host: the winner first, recently failed ones last."""
    m = reader_memory(spark, d)
    winner = m.where("dead is null and ok is not null").groupBy("host").agg(F.max_by("reader", "ok").alias("winner"))
    fresh = F.coalesce(F.lit(D.NOW) - F.floor(F.col("dead") / 1000000) < P.DEAD_TTL, F.lit(False))
    w = Window.partitionBy("host").orderBy(F.col("reader") != F.coalesce("winner", F.lit("")), fresh, F.array_position(F.array(*[F.lit(r) for r in P.READERS]), F.col("reader")))
    return m.join(winner, "host", "left").select("host", "reader", F.row_number().over(w).alias("rank"))


@query(A + "SELECT user_id, count(*) >= 2 AND bool_and(outcome = 'refused') AS hold FROM attempt GROUP BY 1")
def silent_hold(spark, d):
    """Hold where two or more live reads were all refused silently."""
    return D.attempt(spark, d).groupBy("user_id").agg(((F.count(F.lit(1)) >= 2) & F.bool_and(F.col("outcome") == "refused")).alias("hold"))


@query(A + f"SELECT host, until FROM (SELECT host, max(secs) AS since, CASE WHEN max(k) % 2 = 0 THEN NULL ELSE max(secs) + max(k) * 3600 END AS until FROM attempt WHERE outcome = 'refused' GROUP BY 1) WHERE until IS NULL OR {D.NOW} < until")
def held_hosts(spark, d):
    h = D.attempt(spark, d).where("outcome = 'refused'").groupBy("host").agg(F.max("secs").alias("since"), F.max("k").alias("k"))
    h = h.withColumn("until", F.when(F.col("k") % 2 != 0, F.col("since") + F.col("k") * 3600))
    return h.where(F.col("until").isNull() | (F.lit(D.NOW) < F.col("until"))).select("host", "until")


@query(A + ", i AS (SELECT req_id, host, secs, row_number() OVER (PARTITION BY host ORDER BY secs, req_id) AS i FROM attempt) SELECT req_id, host, i * 30 + max(secs - i * 30) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) AS start FROM i")
def polite_schedule(spark, d):
    """When each read may start, 30 s apart on a host: start = max(arrival, previous start + gap), in closed form: with i the
    read's number, 30 i + the largest (arrival - 30 j) of the reads j up to it. Reads are numbered by host and day, and days
    hand on their count and their largest value, so a host with most of the log is not sorted in one task."""
    a = D.attempt(spark, d).select("req_id", "host", "secs", F.floor(F.col("secs") / 86400).alias("day"))
    inside = Window.partitionBy("host", "day").orderBy("secs", "req_id")
    a = a.withColumn("i", F.row_number().over(inside).cast("long")).withColumn("slack", F.col("secs") - F.col("i") * 30)
    a = a.withColumn("own", F.max("slack").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    days = a.groupBy("host", "day").agg(F.count(F.lit(1)).alias("n"), F.max("slack").alias("most"))
    before = Window.partitionBy("host").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    days = days.withColumn("handed", F.max(F.col("most") - F.col("earlier") * 30).over(before)).drop("n", "most")
    j = a.join(days, ["host", "day"])
    return j.select("req_id", "host", ((F.col("i") + F.col("earlier")) * 30 + F.greatest("handed", F.col("own") - F.col("earlier") * 30)).alias("start"))


_BAD = "outcome <> 'ok'"


@query(A + f"SELECT req_id FROM attempt WHERE {_BAD} AND req_id >= (SELECT max(req_id) FROM attempt WHERE {_BAD}) - {P.RING}")
def fail_ring(spark, d):
    """The failures with the latest ids."""
    f = D.attempt(spark, d).where(_BAD).select("req_id")
    last = f.agg(F.max("req_id").alias("last"))
    return f.join(F.broadcast(last), F.col("req_id") >= F.col("last") - P.RING).select("req_id")


@query(A + f"SELECT req_id, host, outcome FROM attempt WHERE {_BAD} ORDER BY req_id DESC LIMIT 50")
def failures_recent(spark, d):
    return D.attempt(spark, d).where(_BAD).select("req_id", "host", "outcome").orderBy(F.desc("req_id")).limit(50)


@query(A + f"SELECT host, outcome, count(*) AS n FROM attempt WHERE {_BAD} GROUP BY 1, 2")
def fail_reasons(spark, d):
    return D.attempt(spark, d).where(_BAD).groupBy("host", "outcome").agg(F.count(F.lit(1)).alias("n"))


_DIM = "dim(outcome, priority, code) AS (VALUES " + ", ".join(f"({q(o)}, {i}, {q(c)})" for i, (o, c) in enumerate(P.PRIORITY)) + ")"


@query(A + f", {_DIM} SELECT user_id, arg_min(code, priority) AS code, min(priority)::INTEGER AS priority FROM attempt JOIN dim USING (outcome) GROUP BY 1")
def diagnose(spark, d):
    """The worst outcome of each request by fixed priority, as the code it is reported under."""
    a = D.attempt(spark, d).join(O.dimension(spark), "outcome")
    return a.groupBy("user_id").agg(F.min_by("code", "priority").alias("code"), F.min("priority").alias("priority"))


@query(A + "SELECT host, count(*) AS total, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome <> 'ok') AS failed FROM attempt GROUP BY 1")
def run_totals(spark, d):
    return D.attempt(spark, d).groupBy("host").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") != "ok").alias("failed"))


@query(A + "SELECT user_id, count(*) >= 2 AND bool_and(outcome <> 'refused') AS pass, arg_min(outcome, req_id) FILTER (outcome = 'refused') AS first_failure FROM attempt GROUP BY 1")
def compile_gate(spark, d):
    """A recipe passes if all its examples do and there are two or more; else its first failure is shown."""
    bad = F.col("outcome") == "refused"
    return D.attempt(spark, d).groupBy("user_id").agg(((F.count(F.lit(1)) >= 2) & F.bool_and(~bad)).alias("pass"), F.min_by(F.when(bad, F.col("outcome")), F.when(bad, F.col("req_id"))).alias("first_failure"))


@query(A + "SELECT user_id, (count(*) FILTER (outcome = 'ok') + 1)::DOUBLE / (count(*) + 2) AS score, CASE WHEN arg_max(outcome, req_id) <> 'ok' THEN arg_max(outcome, req_id) END AS last_code FROM attempt GROUP BY 1")
def recipe_score(spark, d):
    last = F.max_by("outcome", "req_id")
    return D.attempt(spark, d).groupBy("user_id").agg(((F.count_if(F.col("outcome") == "ok") + 1) / (F.count(F.lit(1)) + 2)).alias("score"), F.when(last != "ok", last).alias("last_code"))


_ACCESS = "access AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'www.' ELSE '' END || 'h' || (c_custkey % 12) || '.example' AS host, min(c_custkey) AS key_id FROM customer GROUP BY 1)"


def _access(spark, d):
    c = D.table(spark, d, "customer")
    host = F.concat(F.when(F.col("c_custkey") % 3 == 0, "www.").otherwise(""), F.lit("h"), (F.col("c_custkey") % 12).cast("string"), F.lit(".example"))
    return c.groupBy(host.alias("host")).agg(F.min("c_custkey").alias("key_id"))


@query(A + f", {_ACCESS}, h AS (SELECT DISTINCT host FROM attempt) SELECT h.host, coalesce(a.key_id, b.key_id) AS key_id FROM h LEFT JOIN access a ON a.host = h.host LEFT JOIN access b ON b.host = 'www.' || h.host")
def access_route(spark, d):
    """The access route of a host, or else of its www. twin: candidates with a rank, the first that exists."""
    h = D.attempt(spark, d).select("host").distinct()
    c = h.select("host", F.posexplode(F.array("host", F.concat(F.lit("www."), "host"))).alias("rank", "as"))
    found = c.join(_access(spark, d).withColumnRenamed("host", "as"), "as").groupBy("host").agg(F.min_by("key_id", "rank").alias("key_id"))
    return h.join(found, "host", "left")


@query(A + f", {_ACCESS} SELECT req_id, key_id FROM attempt JOIN access USING (host)")
def api_access(spark, d):
    return D.attempt(spark, d).join(_access(spark, d), "host").select("req_id", "key_id")


@query(A + f", {_ACCESS} SELECT host, key_id, count(req_id) AS reads FROM access LEFT JOIN attempt USING (host) GROUP BY 1, 2")
def enroll_list(spark, d):
    a = _access(spark, d).join(D.attempt(spark, d).select("host", "req_id"), "host", "left")
    return a.groupBy("host", "key_id").agg(F.count("req_id").alias("reads"))


@query("WITH b AS (SELECT s_nationkey AS k, min(s_name) AS v FROM supplier GROUP BY 1), l AS (SELECT c_nationkey AS k, min(c_name) AS v FROM customer GROUP BY 1) SELECT coalesce(l.k, b.k) AS k, coalesce(l.v, b.v) AS v FROM b FULL JOIN l ON b.k = l.k")
def seed_merge(spark, d):
    """A shipped book under what was learned: the learned value wins."""
    b = D.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("v"), F.lit(1).alias("rank"))
    l = D.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("v"), F.lit(0).alias("rank"))
    return b.unionByName(l).groupBy("k").agg(F.min_by("v", "rank").alias("v"))


def best_paths(m: DataFrame, n: int = 8) -> DataFrame:
    """Locale prefixes times listing roots, and whole paths, the ``n`` best. Equal parts are merged first (the best score of each).

    Exact without the whole product: after one prefix, roots stand in the order of score and spec, so only the first ``n`` can
    be in the result; a prefix with ``n`` of higher score above it cannot, whichever its root. Equal prefixes all stay, as
    the order of whole paths is not that of prefixes. The product has ``n`` rows for each prefix at most.
    """
    best = m.groupBy("kind", "spec").agg(F.max("score").alias("score"))
    prefixes = best.where("kind = 'locale_prefix'").select(F.col("spec").alias("prefix"), F.col("score").alias("ps"))
    roots = best.where("kind = 'listing_root'").orderBy(F.desc("score"), "spec").limit(n).select(F.col("spec").alias("root"), F.col("score").alias("rs"))
    least = prefixes.orderBy(F.desc("ps")).limit(n).agg(F.min("ps").alias("least"))
    pairs = prefixes.join(F.broadcast(least), F.col("ps") >= F.col("least")).crossJoin(F.broadcast(roots))
    both = pairs.select(F.concat("prefix", "root").alias("path"), (F.col("ps") * F.col("rs")).alias("score"))
    both = both.unionByName(best.where("kind = 'listing_path'").select(F.col("spec").alias("path"), "score"))
    return both.groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path").limit(n)


@query(M + f""", p AS (SELECT spec AS prefix, {_SCORE} AS ps FROM move WHERE kind = 'locale_prefix'), r AS (SELECT spec AS root, {_SCORE} AS rs FROM move WHERE kind = 'listing_root'),
c AS (SELECT prefix || root AS path, ps * rs AS score FROM p, r UNION ALL SELECT spec, {_SCORE} FROM move WHERE kind = 'listing_path'),
g AS (SELECT path, max(score) AS score FROM c GROUP BY 1) SELECT path, score FROM g ORDER BY score DESC, path LIMIT 8""")
def listing_candidates(spark, d):
    return best_paths(score(D.move(spark, d)))


@query(A + f"SELECT 'failures' AS what, count(*) AS n FROM attempt WHERE {_BAD} UNION ALL SELECT 'hosts', count(DISTINCT host) FROM attempt UNION ALL SELECT 'readers', count(DISTINCT reader) FROM attempt")
def report_global(spark, d):
    a = D.attempt(spark, d).agg(F.count_if(F.col("outcome") != "ok").alias("failures"), F.count_distinct("host").alias("hosts"), F.count_distinct("reader").alias("readers"))
    return a.unpivot([], ["failures", "hosts", "readers"], "what", "n")


@query(A + f", r AS (SELECT req_id, outcome, row_number() OVER (ORDER BY req_id DESC)::INTEGER AS rank FROM attempt WHERE host = 'h3.example' AND {_BAD}) SELECT * FROM r WHERE rank <= 10")
def report_host(spark, d):
    f = D.attempt(spark, d).where((F.col("host") == "h3.example") & F.expr(_BAD))
    return f.select("host", "req_id", "outcome", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("req_id"))).alias("rank")).where("rank <= 10").drop("host")


@query(A + f", {_ACCESS}, f AS (SELECT host, count(*) FILTER (outcome = 'refused') AS walls, count(*) FILTER ({_BAD}) AS failing FROM attempt GROUP BY 1) SELECT f.host, walls, failing, a.key_id IS NULL AS no_route FROM f LEFT JOIN access a ON a.host = f.host")
def report_update(spark, d):
    """Hosts to look after: walls, failures and whether a route is known."""
    f = D.attempt(spark, d).groupBy("host").agg(F.count_if(F.col("outcome") == "refused").alias("walls"), F.count_if(F.expr(_BAD)).alias("failing"))
    return f.join(_access(spark, d), "host", "left").select("host", "walls", "failing", F.col("key_id").isNull().alias("no_route"))


_AB = "SELECT p_partkey, p_size % 2 = 0 AS exact FROM part"


@query(_AB)
def ab_exact(spark, d):
    """Exact agreement of an answer with the truth: every field of the truth equal after trimming."""
    p = D.table(spark, d, "part")
    truth = F.concat(F.lit("price="), F.col("p_size").cast("string"), F.lit("; cpu="), "p_brand")
    answer = F.concat(F.lit("RESULT: price= "), (F.col("p_size") - F.col("p_size") % 2).cast("string"), F.lit(" ;cpu="), "p_brand")
    fields = lambda c: F.transform(F.regexp_extract_all(c, F.lit("(price|cpu|ram|max_power)=([^;]+)"), F.lit(0)), lambda x: F.concat_ws("=", F.split_part(x, F.lit("="), F.lit(1)), F.trim(F.split_part(x, F.lit("="), F.lit(2)))))
    return p.select("p_partkey", ((F.size(fields(truth)) > 0) & (F.size(F.array_except(fields(truth), fields(answer))) == 0)).alias("exact"))


_KIND = "CASE k % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"
_HOLDS = f"""WITH RECURSIVE {D.SQL['attempt']},
e AS (SELECT host, secs, greatest(floor(value)::DOUBLE, {_KIND.format(float(P.HOLD_S), 120.0, float(P.ARCHIVE_HOLD))}::DOUBLE) AS need, {_KIND.format(5.0, 2.0, 5.0)}::DOUBLE AS slow,
  row_number() OVER (PARTITION BY host ORDER BY secs, req_id) AS n FROM attempt WHERE outcome = 'refused'),
f AS (SELECT host, n, secs AS since, floor(secs + least(need, {float(P.HOLD_MOST)}::DOUBLE))::BIGINT AS until, greatest(2.0::DOUBLE, slow) AS pace FROM e WHERE n = 1
 UNION ALL SELECT e.host, e.n, e.secs, floor(e.secs + least(greatest(need, 2.0::DOUBLE * (f.until - f.since)), {float(P.HOLD_MOST)}::DOUBLE))::BIGINT, least(greatest(2 * f.pace, slow), {float(P.HOLD_MOST)}::DOUBLE)
 FROM f JOIN e ON e.host = f.host AND e.n = f.n + 1)
SELECT host, max(n)::BIGINT AS n, arg_max(since, n)::BIGINT AS since, arg_max(until, n) AS until, arg_max(pace, n) AS pace FROM f GROUP BY 1"""


@query(_HOLDS)
def hold_backoff(spark, d):
    """Holds and pace of each host after its refusals in order: a fold with the previous hold as state."""
    from corpusloom.operators.holds import backoff, throttles

    return backoff(throttles(D.attempt(spark, d)))


@query(_HOLDS)
def stream_hold_backoff(spark, d):
    """The same fold as a Structured Streaming query with keyed state, run over all available input."""
    from corpusloom.streaming.holds import run_available

    return run_available(spark, d)
