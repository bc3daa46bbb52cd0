"""Secret scans through a trigram inverted index, in DataFrame operations only.

For each rule a Boolean trigram query is derived from its regular expression (``trigram_query``): a conjunction of
clauses, each a choice of strings, each string the set of its trigrams. Documents are posted under every query trigram
that their lower-cased text holds; the postings of a document are brought together, the queries intersect them, and only
the candidates that satisfy a rule's query are matched against its expression. A rule without mandatory trigrams scans
every document. Postings are keyed by doc_id, so copies of a text spread over many keys and no posting list of a common
trigram ever meets in one task. Rows that share a doc_id share their candidates, a superset that matching then narrows.

Positions: the text is split at the matches; start and end follow from the lengths of the pieces, in code points, summed
in blocks and blocks of blocks, so that a text with very many matches stays near linear.

Cases: null text counts as empty; a null doc_id is keyed by its text; very long texts are scanned whole; spans that start
together are in the order of the rules; repeated rows each get their row; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import re
from re import _constants as sre
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: The group whose length counts (0: the match), and the least length.
    group: int
    least: int


#: The base rules in their order, which is also the order among equal starts.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f] that are long enough
)
_GAP = r"""(?:[\s"']|\\[nrt])"""
#: A private key whole: to the END line that closes it, or else over its headers and lines of base64, the last of which may
#: be short. Line breaks may be spelt as \n. No part is tried twice, so a text with many BEGIN lines stays linear.
PRIVATE_KEY = (
    "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
    "(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    f"|(?:{_GAP}*+(?:Proc-Type|DEK-Info|Comment):[^\\r\\n\\\\]*+)*+"
    f"(?:(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}++[A-Za-z0-9+/]+={{0,2}}[ \\t]*+(?![^\\r\\n\\\\\"']))?)?)"
)
#: Formats of further credentials.
ADDED = (
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("forge_access", r"glpat-[A-Za-z0-9_-]{20,}", 0, 26),
    Rule("chat_token", r"xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("payment_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 24),
    Rule("package_token", r"npm_[A-Za-z0-9]{36}", 0, 40),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0, 69),
    Rule("private_key", PRIVATE_KEY, 0, 27),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("url_password", r"\b[a-z][a-z0-9+]{1,15}://[^\s/:@]+:[^\s/:@]+@", 0, 8),
    Rule("bearer", r"(?i:authorization)\x20?[:=]\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/-]{16,}", 0, 24),
    Rule("temporary_access", r"ASIA[A-Z0-9]{16,}", 0, 20),
)
RULES = BASE + ADDED
MOST_STRINGS = 64

Clause = frozenset[frozenset[str]]


def _clause(strings: set[str]) -> Clause | None:
    """A choice of trigram sets, without those implied by another; None if some string has no trigram."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if not sets or frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _walk(node, lower: bool = True) -> tuple[set[str] | None, list[Clause]]:
    """What a parsed expression can match: all strings, if few, or else clauses that every match satisfies."""
    run: set[str] = {""}
    clauses: list[Clause] = []
    exact = True

    def flush() -> None:
        nonlocal run, exact
        c = _clause(run)
        if c:
            clauses.append(c)
        run, exact = {""}, False

    for op, arg in node:
        strings, inner = _element(op, arg)
        clauses += inner
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            flush()
            if strings is not None:
                run = set(strings)
        else:
            run = {a + b for a in run for b in strings}
    if exact:
        return run, clauses
    flush()
    return None, clauses


def _element(op, arg) -> tuple[set[str] | None, list[Clause]]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, []
    if op is sre.AT:
        return {""}, []
    if op is sre.IN:
        chars: set[str] = set()
        for kind, v in arg:
            if kind is sre.LITERAL:
                chars.add(chr(v).lower())
            elif kind is sre.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, []
        return (chars, []) if len(chars) <= 8 else (None, [])
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        options = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in options):
            return set().union(*(s for s, _ in options)), []
        choice: set[frozenset[str]] = set()
        for s, inner in options:
            best = _clause(s) if s is not None else min(inner, key=len, default=None)
            if best is None:
                return None, []
            choice |= best
        return None, [frozenset(choice)]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, clauses = _walk(inner)
        if high == 1 and strings is not None:
            return strings | ({""} if low == 0 else set()), []
        return None, ([c for c in [_clause(strings)] if c] if strings is not None else clauses) if low else []
    return None, []


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses over trigrams of the lower-cased text that every match satisfies; none: the rule has to scan fully."""
    strings, clauses = _walk(_parser.parse(pattern))
    whole = _clause(strings) if strings is not None else None
    return list(dict.fromkeys(clauses + ([whole] if whole else [])))


@functools.cache
def queries() -> tuple[tuple[Clause, ...], ...]:
    return tuple(tuple(trigram_query(r.pattern)) for r in RULES)


def vocabulary() -> list[str]:
    """The trigrams of all queries, in order."""
    return sorted({t for q in queries() for clause in q for choice in clause for t in choice})


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def postings(docs: DataFrame) -> DataFrame:
    """The inverted index over the query trigrams: term (its number in ``vocabulary``) and ss_key of a document."""
    terms = vocabulary()
    words, numbers = F.array(*[F.lit(t) for t in terms]), F.sequence(F.lit(0), F.lit(len(terms) - 1))
    held = let(F.lower("text"), lambda low: F.filter(numbers, lambda i: F.contains(low, F.element_at(words, i + 1))))
    return docs.where("text is not null").select(_key().alias("ss_key"), F.explode(held).alias("term"))


def candidates(posted: DataFrame) -> DataFrame:
    """ss_key and a bit set of the rules whose queries its postings satisfy; only documents with a candidate rule."""
    terms = vocabulary()
    words = -(-len(terms) // 62)
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("term") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("term") % 62).cast("int"))).otherwise(F.lit(0).cast("long")))
    met = posted.groupBy("ss_key").agg(*[bit(w).alias(f"w{w}") for w in range(words)])
    place = {t: divmod(i, 62) for i, t in enumerate(terms)}

    def needs(choice: frozenset[str]) -> Column:
        need = [0] * words
        for t in choice:
            need[place[t][0]] |= 1 << place[t][1]
        return F.struct(*[F.lit(n).cast("long").alias(f"n{w}") for w, n in enumerate(need)])

    asked = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.array(*[F.array(*[needs(c) for c in sorted(clause, key=sorted)]) for clause in q]).alias("clauses")) for i, q in enumerate(queries()) if q])
    holds = lambda c: functools.reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(c[f"n{w}"]) == c[f"n{w}"] for w in range(words)])
    satisfied = F.filter(asked, lambda r: F.forall(r["clauses"], lambda clause: F.exists(clause, holds)))
    mask = F.aggregate(satisfied, F.lit(0).cast("long"), lambda m, r: m + r["bit"])
    return met.select("ss_key", mask.alias("ss_rules")).where("ss_rules != 0")


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, and others) with ss_rules, 0 where no rule has a candidate."""
    found = candidates(postings(docs))
    out = docs.withColumn("ss_key", _key()).join(found, "ss_key", "left").drop("ss_key")
    return out.withColumn("ss_rules", F.coalesce("ss_rules", F.lit(0).cast("long")))


BLOCK = 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is never expanded by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hit(text: Column, i: int, rule: Rule) -> Column:
    """Lengths of what lies between the matches, of the matches and of their groups; null without a match."""
    rx = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, F.length)
    held = F.struct(
        F.lit(i).alias("kind"),
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, rx, F.lit(0))).alias("len"),
        lengths(F.regexp_extract_all(text, rx, F.lit(rule.group))).alias("size"),
    )
    gate = F.col("ss_rules").bitwiseAND(F.lit(1 << i)) != 0 if queries()[i] else F.lit(True)
    return F.when(gate & text.rlike(rule.pattern), held)


def _located(hit: Column) -> Column:
    """Structs (start, kind, end) of the matches that pass."""
    size = F.size(hit["len"])
    step = F.zip_with(F.slice(hit["gap"], 1, size), hit["len"], lambda a, b: a + b)
    return F.struct(hit["kind"].alias("kind"), hit["gap"].alias("gap"), hit["len"].alias("len"), hit["size"].alias("size"), step.alias("step"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _blocks(hit: Column) -> Column:
    blocks = F.sequence(F.lit(0), F.floor((F.size(hit["len"]) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: _sum(F.slice(hit["step"], b * BLOCK + 1, F.lit(BLOCK))))
    return F.struct(*[hit[c].alias(c) for c in ("kind", "gap", "len", "size", "step")], sums.alias("sums"))


def _outer(hit: Column) -> Column:
    """Sums of blocks of blocks, beside the others."""
    outer = F.sequence(F.lit(0), F.floor((F.size(hit["sums"]) - 1) / BLOCK).cast("int"))
    sums = F.transform(outer, lambda b: _sum(F.slice(hit["sums"], b * BLOCK + 1, F.lit(BLOCK))))
    return F.struct(*[hit[c].alias(c) for c in ("kind", "gap", "len", "size", "step", "sums")], sums.alias("outer"))


def _spans(hit: Column) -> Column:
    def at(i: Column) -> Column:
        block, far = F.floor(i / BLOCK).cast("int"), F.floor(i / BLOCK**2).cast("int")
        start = _sum(F.slice(hit["outer"], F.lit(1), far)) + _sum(F.slice(hit["sums"], far * BLOCK + 1, block - far * BLOCK)) + _sum(F.slice(hit["step"], block * BLOCK + 1, i - block * BLOCK)) + F.get(hit["gap"], i)
        least = F.element_at(F.array(*[F.lit(r.least) for r in RULES]), hit["kind"] + 1)
        return F.when(F.get(hit["size"], i) >= least, F.struct(start.alias("start"), hit["kind"].alias("kind"), (start + F.get(hit["len"], i)).alias("end")))

    return F.transform(F.sequence(F.lit(0), F.size(hit["len"]) - 1), at)


def _found(text: Column) -> Column:
    """Array of (start, kind, end) in order of start, then rule; null where nothing matched."""

    def located(hits: Column) -> Column:
        steps = F.transform(F.transform(F.transform(hits, _located), _blocks), _outer)
        return F.when(F.size(hits) > 0, F.array_sort(F.array_compact(F.flatten(F.transform(steps, _spans)))))

    return let(text, lambda t: let(F.array_compact(F.array(*[_hit(t, i, r) for i, r in enumerate(RULES)])), located))


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ss_spans: an array of (start, kind, end), null where there is none; positions count code points."""
    out = with_candidates(docs)
    return out.withColumn("ss_spans", _found(F.coalesce("text", F.lit("")))).drop("ss_rules")


def _text(a: Column) -> Column:
    name = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans."""

    def digest(all_spans: Column) -> Column:
        base = F.filter(all_spans, lambda s: s["kind"] < len(BASE))

        def count(k: int) -> Column:
            return F.size(F.filter(all_spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k].kind}")

        return F.struct(*map(count, range(len(BASE))), F.sha2(_text(base), 256).alias("base_sha256"), _text(all_spans).alias("spans"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = with_candidates(docs.select("doc_id", "text"))
    found = found.select("doc_id", F.inline(F.array(let(F.coalesce(_found(F.coalesce("text", F.lit(""))), none), digest))))
    return found


MASK = "[secret]"


#: A text is cut from pieces of so many code points, so that a cut costs this much and not the text's length.
PIECE = 1024


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of the text that the pieces make up."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    one = F.substring(F.get(pieces, first), start - first * PIECE + 1, end - start)
    many = F.concat(F.substring(F.get(pieces, first), start - first * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(F.get(pieces, last), F.lit(1), end - last * PIECE))
    return F.when(end <= start, "").when(first == last, one).otherwise(many)


def _without(text: Column, spans_: Column) -> Column:
    """``text`` with everything that a span covers replaced; spans are in order of their starts and may overlap."""
    least = lambda a: F.coalesce(F.array_max(a), F.lit(0))
    groups = lambda a: F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
    upper = lambda a: F.transform(groups(a), lambda b: F.array_max(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(held: Column) -> Column:
        ends, blocks, outer, pieces = (held[c] for c in ("ends", "blocks", "outer", "pieces"))

        def reached(i: Column) -> Column:
            """How far the spans before the i-th reach."""
            block, far = F.floor(i / BLOCK).cast("int"), F.floor(i / BLOCK**2).cast("int")
            return F.greatest(least(F.slice(outer, F.lit(1), far)), least(F.slice(blocks, far * BLOCK + 1, block - far * BLOCK)), least(F.slice(ends, block * BLOCK + 1, i - block * BLOCK)))

        def part(span: Column, i: Column) -> Column:
            return let(reached(i), lambda at: F.when(span["start"] >= at, F.concat(_cut(pieces, at, span["start"]), F.lit(MASK))).otherwise(""))

        return F.concat(F.array_join(F.transform(held["spans"], part), ""), let(reached(F.size(ends)), lambda at: _cut(pieces, at, held["size"])))

    def outlined(held: Column) -> Column:
        return let(F.struct(*[held[c].alias(c) for c in ("spans", "ends", "blocks")], upper(held["blocks"]).alias("outer"), F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)).alias("pieces"), F.length(text).alias("size")), joined)

    ends = F.transform(spans_, lambda s: s["end"])
    return let(F.struct(spans_.alias("spans"), ends.alias("ends"), upper(ends).alias("blocks")), outlined)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced, overlapping ones by one mask; n_chars, where it is a column,
    follows. Null texts stay null. Spans are found on the text as it is, so none hides another."""
    out = with_candidates(docs.select(F.struct("*").alias("ss_doc"), "doc_id", "text"))
    masked = lambda t: let(_found(t), lambda s: F.when(F.size(F.coalesce(s, F.array())) > 0, _without(t, s)).otherwise(t))
    out = out.select("ss_doc", F.when(F.col("text").isNotNull(), let(F.col("text"), masked)).alias("ss_text"))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("ss_text"), "n_chars": F.length("ss_text").cast(kinds.get("n_chars", "long"))}
    return out.select(*[new.get(c, F.col("ss_doc")[c]).alias(c) for c in docs.columns])
