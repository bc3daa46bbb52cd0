"""Personal data: base patterns, and candidate spans judged by boosted trees.

Base kinds (email, ip, card, phone) are found by their patterns and always stay. Beside them high-recall generators
propose further spans, which may overlap: written-out addresses (``name at host dot tld``), national identity numbers,
bank account numbers, long digit groups, network addresses of six groups, street addresses. Gradient-boosted trees look
at the format of a candidate and at the words around it; a threshold for each kind, calibrated for precision on
held-out examples, selects. Where selected candidates overlap, the best score wins; one that overlaps a base span is
dropped. The trees are trained on the driver from examples made by ``examples`` (a bounded number, fixed seed): every
look-alike passes its generator, so the trees have to tell; the sentences that calibrate are not those that train.

Work is row by row on whole texts: no shuffle. Positions are code points, ends exclusive. Cases: null text counts as
empty; very long texts are searched whole, in time that grows with the text and its number of candidates; candidates tied
in score are taken in the order of the generators, then of the text; rows without an id and repeated rows are each
searched; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import boosting

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base kinds, as listed, then by start. Leftmost, non-overlapping per kind; failing matches are consumed."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # the part before "@" is a run of its characters; found from the "@", so long runs without one cost nothing
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: kind of the candidate -> (pattern, a character it needs)
GENERATORS = {
    "email": (re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\bat\b)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\bdot\b|\.)\s?[A-Za-z]{2,12}){1,3}\b"), "t"),
    "national_id": (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), "-"),
    "iban": (re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b"), None),
    "phone": (re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"), None),
    "mac": (re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"), None),
    "date_of_birth": (re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])"), None),
    "street": (re.compile(r"\b[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b"), None),
}
_CUES = {
    "email": ("mail", "contact", "write"), "national_id": ("ssn", "social", "security", "tax", "identity"), "iban": ("iban", "account", "bank", "transfer"), "phone": ("tel", "phone", "call", "fax", "mobile"),
    "mac": ("mac", "hardware", "adapter", "device"), "date_of_birth": ("born", "birth", "dob"), "street": ("address", "lives", "street", "home"),
}
_CONTEXT = 40


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    digits = _DIGIT.search(text) is not None
    low = None
    out = []
    for kind, (rx, needs) in GENERATORS.items():
        if kind == "email":
            low = low or text.lower()
            if not ("dot" in low or "(at)" in low or "[at]" in low or " at " in low and "." in low):
                continue
            if "dot" not in low and "(at)" not in low and "[at]" not in low:
                continue
        elif not digits or needs and needs not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in rx.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    kind, s, e = span
    body, before, after = text[s:e], text[max(0, s - _CONTEXT) : s].lower(), text[e : e + _CONTEXT].lower()
    digits = [c for c in body if c.isdigit()]
    n = len(body)
    cues = _CUES[kind]
    return [
        float(list(GENERATORS).index(kind)), float(n), len(digits) / n, sum(c.isupper() for c in body) / n, sum(c in " -.()[]:/" for c in body) / n,
        float(len(set(digits))), float(any(c in before for c in cues)), float(any(c in after for c in cues)), float(before.rstrip()[-1:] in (":", "=", "#")),
        float(bool(re.search(r"[(\[](?:at|dot)[)\]]", body.lower()))), float(" dot " in body.lower()), float(_iban_ok(body)) if kind == "iban" else 0.0,
        float(digits[:3] not in (["0", "0", "0"], ["6", "6", "6"]) and digits[:1] != ["9"]), float(s > 0 and text[s - 1].isalnum()), float(e < len(text) and text[e].isalnum()),
    ]


def _iban_ok(body: str) -> bool:
    b = body.replace(" ", "")
    return 15 <= len(b) <= 34 and int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1


def _iban(rng: np.random.Generator, valid: bool) -> str:
    country = ("DE", "FR", "ES", "GB")[rng.integers(4)]
    tail = "".join(str(d) for d in rng.integers(0, 10, 18))
    check = 98 - int("".join(str(int(c, 36)) for c in tail + country + "00")) % 97
    if not valid:  # any other check digits fail
        check = 2 + (check - 2 + int(rng.integers(1, 97))) % 97
    whole = f"{country}{check:02d}{tail}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.integers(2) else whole


#: Sentences around a candidate: ``{b}`` is its text, ``{c}`` a cue of its kind, ``{w}`` any word. Those of index 0 train, of
#: index 1 calibrate, of index 2 test; true ones and look-alikes.
_TRUE = (
    ("{w} {c}: {b} {w}", "the {c} is {b}, {w} {w}", "{w} {w} {c} {b}. {w}", "my {c} number {b} {w}", "{w} {w} {b} {w}"),
    ("please note {c} {b} for {w}", "{c}= {b}; {w}", "her {c} of record: {b}", "{w} ({c} {b}) {w}", "ask {w}, {b}"),
    ("{w} wrote {c} - {b}", "[{c}] {b} {w}", "new {c}, {b}, since {w}", "{w} gave {b} as {c}", "so {b} it was"),
)
_FALSE = (
    ("{w} part {b} {w}", "version {b} of {w}", "order no. {b} {w}", "{w} {w} {b} {w}", "table 4: {b} {w} {w}", "published {b}, {w}", "total {b} {w}"),
    ("build {b} was {w}", "item {b}, {w}", "see figure {b} {w}", "held on {b} at {w}", "{w} {b} {w} {w}", "score {b} {w}"),
    ("release {b} {w}", "lot {b}; {w}", "row {b} {w} {w}", "since {b} {w}", "{w}, {b}, {w}"),
)


def _body(kind: str, true: bool, rng: np.random.Generator, w) -> str:
    """A text that the generator of ``kind`` finds: one that is what it looks like, or one that often is not."""
    n = lambda lo, hi: int(rng.integers(lo, hi))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    if kind == "email":
        return f"{w()}.{w()} {pick('(at)', '[at]')} {w()} {pick('(dot)', '[dot]', 'dot', '.')} {pick('com', 'org', 'net')}" if true else pick(f"{w()} at {w()}.{w()} dot", f"dot {w()} at {w()}.{w()}", f"{w()} at {w()} dot {w()}")
    if kind == "national_id":
        area = n(1, 900) if true else pick(0, 666, n(900, 1000), n(1, 900))
        return f"{area:03d}-{n(1, 100) if true else pick(0, n(1, 100)):02d}-{n(1, 10000):04d}"
    if kind == "iban":
        return _iban(rng, true) if true or rng.integers(2) else f"{pick('AB', 'ZX', 'SN')}{n(10, 100)} {n(1000, 10000)} {n(1000, 10000)} {n(1000, 10000)}"
    if kind == "phone":
        area, local, last = n(200, 1000), n(200, 1000), n(0, 10000)
        return pick(f"({area}) {local}-{last:04d}", f"{area}-{local}-{last:04d}", f"{area} {local} {last:04d}") if true else pick(f"{n(0, 1000):03d}.{n(0, 1000):03d}.{last:04d}", f"{n(0, 1000):03d} {n(0, 1000):03d} {last:04d}", f"{area}-{local}-{last:04d}")
    if kind == "mac":
        return pick(":", "-").join(f"{n(0, 256):02x}" for _ in range(6)) if true else pick(":", "-").join(f"{n(0, pick(60, 100)):02d}" for _ in range(6))
    if kind == "date_of_birth":
        year = n(1935, 2012) if true else n(1500, 2030)
        return pick(f"{year}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29)}.{n(1, 13)}.{year}", f"{n(1, 13)}/{n(1, 29)}/{year}")
    way = pick("Street", "Ave", "Road", "Lane")
    return f"{n(1, 2000)} {w().title()} {way}" if true else f"{n(1, 100000)} {w().title()} {w().title()} {w().title()} {way}"


def examples(n: int = 6000, seed: int = 7, part: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in made sentences of one part. One true example in twenty stands in the sentence
    of a look-alike, and one look-alike in twenty in a true one's, so scores are spread and thresholds matter."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    w = lambda: "".join(letters[rng.integers(0, 26, rng.integers(3, 9))])
    pick = lambda xs: xs[rng.integers(len(xs))]
    x, y, kinds = [], [], []
    for _ in range(n):
        kind, true = pick(list(GENERATORS)), bool(rng.integers(2))
        sentence = pick((_TRUE if true ^ (rng.integers(20) == 0) else _FALSE)[part])
        while "{w}" in sentence:
            sentence = sentence.replace("{w}", w(), 1)
        before, after = sentence.replace("{c}", pick(_CUES[kind])).split("{b}")
        body = _body(kind, true, rng, w)
        text = f"{w()} {before}{body}{after}"
        at = len(text) - len(after) - len(body)
        for c in candidates(text):
            if c[0] == kind and c[1] < at + len(body) and at < c[2]:
                x.append(features(text, c))
                y.append(true)
                kinds.append(list(GENERATORS).index(kind))
    return np.array(x), np.array(y, dtype=float), np.array(kinds)


@functools.cache
def model(precision: float = 0.9) -> tuple[boosting.Boosted, tuple[float, ...]]:
    """The trees, and for each kind the least threshold that has the wanted precision on sentences that did not train."""
    x, y, _ = examples()
    trees = boosting.train(x, y, rounds=80)
    hx, hy, kinds = examples(4000, seed=8, part=1)
    p = trees.predict(hx)
    return trees, tuple(boosting.calibrate(p[kinds == k], hy[kinds == k], precision) for k in range(len(GENERATORS)))


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, disjoint and in order."""
    starts, ends = [], []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def added_spans(text: str, base: list[Span], trees: boosting.Boosted, thresholds: tuple[float, ...]) -> list[Span]:
    """Candidates whose score reaches the threshold of their kind; of overlapping ones the best, and none that overlaps a base
    span. What is taken is kept disjoint and sorted, so each candidate looks at its neighbours only."""
    found = candidates(text)
    if not found:
        return []
    p = trees.predict(np.array([features(text, c) for c in found]))
    names, out = {k: i for i, k in enumerate(GENERATORS)}, []
    starts, ends = _merged(base)
    for i in np.argsort(-p, kind="stable").tolist():
        kind, s, e = found[i]
        if p[i] < thresholds[names[kind]]:
            continue
        at = bisect.bisect_left(ends, s + 1)  # the first that ends behind the start
        if at == len(starts) or starts[at] >= e:
            out.append(found[i])
            starts.insert(at, s)
            ends.insert(at, e)
    return out


def joined(spans: list[Span], order: dict[str, int]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


ORDER = {k: i for i, k in enumerate(dict.fromkeys([*KINDS, *GENERATORS]))}
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _finder(trained):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[] for _ in range(6)]
            for text in b.column("text"):
                t = text.as_py() or ""
                base = base_spans(t)
                spans = base + added_spans(t, base, *trained)
                kinds = [k for k, _, _ in base]
                for c, v in zip(rows, [*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base, ORDER).encode()).hexdigest(), joined(spans, ORDER)]):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(rows, list(_SCHEMA)[1:]))], schema=_SCHEMA)

    return find


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, a digest of base spans, and all spans."""
    kept = docs.select(F.col("doc_id").cast("long"), "text")
    return kept.mapInArrow(_finder(model()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
