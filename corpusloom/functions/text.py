"""Column functions on page texts: goal test, gates, scores and formats. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def blocked(text: Column) -> Column:
    """Both halves of a block page in the first 4000 characters: a refusal, and something about the visitor."""
    t = F.substring(text, 1, 4000)
    return t.rlike(P.BLOCK_REFUSAL) & t.rlike(P.BLOCK_VISITOR)


def carries(text: Column, want: str) -> Column:
    """Case-insensitive search; an expression that does not compile is looked up as it stands."""
    try:
        re.compile(want)
    except re.error:
        return F.contains(F.lower(text), F.lit(want.lower()))
    return text.rlike(f"(?i){want}")


def judge(title: Column, text: Column, shell: Column, want: str = "") -> Column:
    """The first that holds, in this order."""
    n, both = F.length(text), F.concat(title, F.lit(" "), text)
    out = F.when(shell, "js_shell").when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "empty")
    out = out.when((n < 8000) & blocked(both), "blocked")
    out = out.when((n < 5000) & F.concat(title, F.lit(" "), F.substring(text, 1, 1500)).rlike(P.CHALLENGE), "challenge")
    out = out.when(title.rlike(P.ERROR_PAGE) | ((n < 8000) & F.substring(text, 1, 300).rlike(P.ERROR_PAGE)), "error_page")
    out = out.when((n < 3000) & F.concat(title, F.lit(" "), F.substring(text, 1, 600)).rlike(P.LOGIN), "login_wall")
    out = out.when(n < P.MIN_GOOD, "thin")
    return (out.when(~carries(text, want), "want_miss") if want else out).otherwise("ok")


def shell(text: Column, n_scripts: Column) -> Column:
    return ((F.length(text) < 300) & (n_scripts >= 3)) | ((F.length(text) < 2000) & text.rlike(P.JS_NEEDED))


def prose_milli(text: Column) -> Column:
    """How much a text reads like sentences, in thousandths rounded down, from its first 800 characters."""
    words = F.regexp_extract_all(F.substring(text, 1, 800), F.lit(r"[A-Za-z]{2,}"), F.lit(0))
    known = F.array(*[F.lit(w) for w in P.FUNCTION_WORDS])
    n = F.size(words)
    dense = F.size(F.filter(words, lambda w: F.array_contains(known, F.lower(w)))) / n
    lower = F.size(F.filter(words, lambda w: w.rlike("^[a-z]"))) / n
    return F.when(n < 8, F.lit(0)).otherwise(F.floor(F.least(F.lit(1.0), dense / 0.35) * (0.5 + 0.5 * lower) * 1000)).cast("long")


def not_content(text: Column) -> Column:
    """Why an extracted value is not content; empty if it may be."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    top = F.array_max(F.transform(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w))))
    ref = F.when(F.length(F.regexp_replace(text, r"[^\p{Ll}]", "")) * 2 > letters, text).otherwise(low)
    stubs = F.size(F.filter(F.regexp_extract_all(ref, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: w.isin(*P.STUBS)))
    count_t = lambda c: F.length(c) - F.length(F.replace(c, F.lit("t"), F.lit("")))
    few = (letters > 80) & (count_t(ref) * 500 < letters) & (stubs >= 2)
    # cheapest first: a text with enough t's as it stands has enough whichever way it is counted; word shares come last
    damaged = F.when(few, F.coalesce(top * 100 < F.size(words) * 15, F.lit(True))).otherwise(F.lit(False))
    damaged = F.when(count_t(text) * 500 < F.length(text), damaged).otherwise(F.lit(False))
    return F.when(F.substring(text, 1, 6000).rlike(P.CHROME), "chrome").when(damaged, "letters missing").otherwise("")


def _windows(text: Column, want: str) -> Column:
    """The surroundings of the first matches behind the limit, in order."""
    rest, rx = F.substring(text, P.EXCERPT + 1, 2**31 - 1), f"(?i){want}"
    lengths = lambda a: F.slice(F.transform(a, F.length), 1, P.WINDOWS)
    held = F.struct(lengths(F.split(rest, rx)).alias("gap"), lengths(F.regexp_extract_all(rest, F.lit(rx), F.lit(0))).alias("len"), text.alias("text"))

    def one(h: Column, k: Column) -> Column:
        sum_ = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        at = F.lit(P.EXCERPT) + sum_(F.slice(h["gap"], 1, k)) + sum_(F.slice(h["len"], 1, k - 1))
        return F.concat(F.lit("… "), F.regexp_replace(F.substring(h["text"], at - P.AROUND + 1, F.lit(2 * P.AROUND)), r"^\s+|\s+$", ""), F.lit(" …"))

    # a lambda's variable is computed once, whatever is made of it
    made = lambda h: F.when(F.size(h["len"]) > 0, F.transform(F.sequence(F.lit(1), F.size(h["len"])), lambda k: one(h, k)))
    return F.get(F.transform(F.array(held), made), F.lit(0))


def excerpt(text: Column, want: str = "", full: bool = False) -> Column:
    """Short texts whole; long ones to the limit, then windows around the first matches of ``want`` behind it, and a footer. With
    ``full`` the text up to the limit of all answers."""
    whole = F.substring(text, 1, P.FULL)
    if full:
        return whole
    found = F.lit("")
    if want:
        try:
            re.compile(want)
            found = F.coalesce(F.concat(F.lit("\n\n"), F.array_join(_windows(text, want), "\n")), F.lit(""))
        except re.error:
            pass
    cut = F.concat(F.substring(text, 1, P.EXCERPT), found, F.lit(f"\n\n[excerpt: {P.EXCERPT} of "), F.length(text).cast("string"), F.lit(" chars; pass full=true for all]"))
    return F.when(F.length(text) <= P.EXCERPT, whole).otherwise(cut)


def clean(value: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[*_`|]+", " "), r"\s+", " ")), 1, 200)


def scrub(text: Column, secrets: list[str]) -> Column:
    """Each secret, and its percent-encoded form, replaced."""
    from urllib.parse import quote

    for s in secrets:
        for form in dict.fromkeys((s, quote(s, safe=""))):
            text = F.replace(text, F.lit(form), F.lit("[key]"))
    return text


def fetch_outcome(status: Column, is_blocked: Column, is_challenge: Column, detail: Column, resolves: Column) -> Column:
    """What a failed read was: by status where there is one, else by the error's text."""
    by_status = (
        F.when(is_blocked, "blocked").when(is_challenge & status.isin(403, 503), "challenge").when(status == 429, "rate_limited").when(status.isin(404, 410), "not_found")
        .when(status.isin(401, 403, 406, 409, 451), "refused").when(status >= 500, "server_error").otherwise("http_error")
    )
    by_text = F.when(F.upper(detail).rlike("CERTIFICATE|SSL"), "tls").when(detail.rlike("^(ImportError|ModuleNotFoundError)"), "reader_missing").when(detail.rlike(P.STALL) & resolves, "silent_refusal").otherwise("network")
    return F.when(status.isNotNull(), by_status).otherwise(by_text)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds, or the seconds until an HTTP date; 0 for anything else."""
    dated = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]+, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(value.try_cast("double"), F.greatest(F.lit(0.0), (F.unix_timestamp(dated) - now).cast("double")), F.lit(0.0))


def keyname(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def result_line(ok: Column, name: Column, value: Column, body: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("RESULT: "), F.when(ok, "ok").otherwise("fail")), name, F.when(F.coalesce(value, F.lit("")) == "", "-").otherwise(value), body)


def untail(value: Column, stem: Column) -> Column:
    """A name without trailing segments that name the site or look like a part number; the first always stays."""
    parts = F.split(value, r"\s+[|·–—]\s+")
    tail = lambda x: ((stem != "") & F.contains(F.lower(x), stem)) | F.trim(x).rlike("^[A-Z0-9][A-Z0-9-]{4,}$")
    # the last position that is not such a tail, or the first
    keep = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(1), lambda k, i: F.when(tail(F.element_at(parts, i)), k).otherwise(i))
    return F.array_join(F.slice(parts, F.lit(1), keep), " | ")


def dig(js: Column, dotted: str) -> Column:
    """A dotted path through JSON objects; a list on the way gives its first element."""
    node = js
    for part in dotted.split("."):
        node = F.coalesce(F.get_json_object(node, f"$.{part}"), F.get_json_object(node, f"$[0].{part}"))
    return F.coalesce(F.get_json_object(node, "$[0]"), node)
