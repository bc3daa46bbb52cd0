"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression over the lower-cased text with a label, a priority, a confidence and the keywords it
cannot match without. A text is first searched for keywords in one pass; only rules all of whose keywords were seen
run. Detections that overlap are then resolved: a detection is suppressed if its interval lies inside another's of the same or
a better priority, or inside a longer one whose priority is at most ``SLACK`` worse. The base phrases (``BASE``) are looked up beside the rules and always stay.

Rules come from families times forms (full name, header sentence, SPDX tag, url, abbreviation with version), see
``build_rules``. Everything is computed row by row on whole texts: no shuffle, memory bounded by the text at hand.

Cases: null text counts as empty: no words, no places, null first and last word, empty labels and score 0; very long texts
are scanned whole, each in a slice of its own; of detections with one interval and one priority the first rule's stays; rows
without an id and repeated rows are each scanned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as T

#: The phrases looked for as consecutive words, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: A word is made of ASCII digits and letters and of anything beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
_E, _GAP = rb"(?![0-9a-z\x80-\xff])", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

#: Family, label stem, full name, versions.
FAMILIES = (
    ("gpl", "gnu general public license", ("1.0", "2.0", "3.0")),
    ("lgpl", "gnu lesser general public license", ("2.0", "2.1", "3.0")),
    ("agpl", "gnu affero general public license", ("1.0", "3.0")),
    ("gfdl", "gnu free documentation license", ("1.1", "1.2", "1.3")),
    ("apache", "apache license", ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla public license", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public license", ("1.0", "2.0")),
    ("cddl", "common development and distribution license", ("1.0", "1.1")),
    ("eupl", "european union public licence", ("1.0", "1.1", "1.2")),
    ("afl", "academic free license", ("1.1", "2.0", "2.1", "3.0")),
    ("osl", "open software license", ("1.0", "2.0", "2.1", "3.0")),
    ("artistic", "artistic license", ("1.0", "2.0")),
    ("cecill", "cecill free software license agreement", ("1.0", "2.0", "2.1")),
    ("lppl", "latex project public license", ("1.0", "1.1", "1.2", "1.3")),
    ("psf", "python software foundation license", ("2.0",)),
    ("bsl", "boost software license", ("1.0",)),
    ("zpl", "zope public license", ("1.1", "2.0", "2.1")),
    ("ofl", "sil open font license", ("1.0", "1.1")),
    ("upl", "universal permissive license", ("1.0",)),
    ("mspl", "microsoft public license", ()),
    ("isc", "isc license", ()),
    ("zlib", "zlib license", ()),
    ("mit", "mit license", ()),
    ("wtfpl", "do what the fuck you want to public license", ("1.0", "2.0")),
    ("unlicense", "the unlicense", ()),
)
#: Elements of the attribution family and its versions.
CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd", "zero")
CC_NAMES = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial", "zero": "zero"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Sentences of license texts.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("boost", "boost software license version 1 0 august 17th 2003"),
)


#: How much worse the priority of a longer detection may be that suppresses one inside it.
SLACK = 30


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


def _words(phrase: str) -> bytes:
    return _GAP.join(re.escape(w.encode()) for w in re.findall(r"[0-9a-z]+", phrase))


def _version(v: str) -> bytes:
    major, _, minor = v.partition(".")
    return re.escape(major.encode()) + (b"" if minor == "" else rb"(?:\." + minor.encode() + b")" + (b"?" if minor == "0" else b""))


@functools.cache
def build_rules() -> tuple[Rule, ...]:
    """All rules, best priority (smallest) first."""
    out: list[Rule] = []

    def add(label: str, priority: int, confidence: float, keywords: str, pattern: bytes) -> None:
        out.append(Rule(label, priority, confidence, tuple(k.encode() for k in keywords.split()), re.compile(pattern + _E)))

    between = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]{1,3}(?:v|ver|version|vs)?[\x00-\x2f\x3a-\x60\x7b-\x7f]{0,2}"
    for stem, name, versions in FAMILIES:
        key = max(re.findall(r"[a-z]+", name), key=len) if stem not in ("mit", "isc", "zlib") else stem
        for v in versions:
            tag = f"{stem}-{v}"
            add(tag, 10, 0.98, f"spdx {stem}", rb"spdx-license-identifier:[ \t]*" + re.escape(tag.encode()) + rb"(?:-only|-or-later|\+)?")
            add(tag, 20, 0.95, key, _words(name) + between + _version(v))
            add(f"{tag}-or-later", 15, 0.97, f"{key} later", _words(name) + between + _version(v) + rb"[^a-z]{1,6}or[^0-9a-z]{1,4}(?:\(at your option\) )?any later version")
            add(tag, 40, 0.8, stem, re.escape(stem.encode()) + rb"[- ]?v?" + _version(v) + (rb"(?:\+|-or-later|-only)?" if stem != "bsl" else b""))
            add(tag, 30, 0.9, f"{stem} http", rb"https?://[a-z0-9./-]{1,80}/" + re.escape(stem.encode()) + rb"[-/]?v?" + _version(v))
        add(stem, 10, 0.97, f"spdx {stem}", rb"spdx-license-identifier:[ \t]*" + re.escape(stem.encode()))
        add(stem, 50, 0.9, key, _words(name))
        add(stem, 45, 0.92, f"{key} under", rb"(?:licensed|released|distributed|available|published)" + _GAP + b"under" + _GAP + rb"(?:the" + _GAP + b")?(?:terms" + _GAP + b"of" + _GAP + b"the" + _GAP + b")?" + _words(name))
    for part in CC_PARTS:
        full = _GAP.join(re.escape(CC_NAMES[p].encode()) if p != "by" else b"attribution" for p in part.split("-"))
        for v in CC_VERSIONS if part != "zero" else ("1.0",):
            tag = f"cc-{part}-{v}" if part != "zero" else "cc0-1.0"
            add(tag, 10, 0.98, "spdx cc", rb"spdx-license-identifier:[ \t]*" + re.escape(tag.encode()))
            add(tag, 20, 0.95, "cc by" if part != "zero" else "cc0", re.escape(tag.split(v)[0][:-1].encode()).replace(rb"\-", rb"[- ]") + rb"[- ]" + re.escape(v.encode()))
            add(tag, 25, 0.95, "creative commons", rb"creative[- ]commons" + _GAP + full + _GAP + rb"(?:[a-z]+" + _GAP + rb"){0,3}" + re.escape(v.encode()))
            add(tag, 30, 0.93, "creativecommons.org", rb"https?://creativecommons\.org/(?:licenses|publicdomain)/" + re.escape(part.encode()) + b"/" + re.escape(v.encode()))
        add(f"cc-{part}" if part != "zero" else "cc0", 50, 0.85, "creative commons", rb"creative[- ]commons" + _GAP + full)
    for n in ("0", "1", "2", "3", "4"):
        add(f"bsd-{n}-clause", 20, 0.93, "bsd clause", n.encode() + rb"[- ]clause" + _GAP + b"bsd")
        add(f"bsd-{n}-clause", 20, 0.95, "bsd clause", b"bsd[- ]" + n.encode() + rb"[- ]clause")
    add("bsd", 50, 0.85, "bsd license", rb"bsd" + _GAP + b"license")
    for label, text in SENTENCES:
        longest = " ".join(sorted(re.findall(r"[a-z]+", text), key=len)[-2:])
        add(label, 35 if len(text) > 40 else 60, 0.96 if len(text) > 40 else 0.5, longest, _words(text))
    return tuple(sorted(out, key=lambda r: r.priority))


@functools.cache
def _scanner():
    rules = build_rules()
    keys = sorted({k for r in rules for k in r.keywords})
    base = [(label, [w.encode() for w in phrase.split()], re.compile(_words(phrase) + _E)) for phrase, label in BASE.items()]
    return rules, keys, base


def _places(pattern: re.Pattern[bytes], text: bytes) -> Iterator[re.Match[bytes]]:
    """Matches that start a word. A test of the byte before keeps the pattern's literal prefix, which makes search fast."""
    for m in pattern.finditer(text):
        if not m.start() or not IS_WORD[text[m.start() - 1]]:
            yield m


def detect(text: bytes) -> list[tuple[int, int, Rule]]:
    """Detections of the rules in a lower-cased text, with contained ones suppressed, by start."""
    rules, keys, _ = _scanner()
    seen = {k for k in keys if k in text}
    found = [(m.start(), m.end(), r) for r in rules if all(k in seen for k in r.keywords) for m in _places(r.pattern, text)]
    # longer first at a start: an interval is contained in an earlier one of this order, if in any
    found.sort(key=lambda x: (x[0], -x[1], x[2].priority))
    kept: list[tuple[int, int, Rule]] = []
    open_: list[tuple[int, int, Rule]] = []
    for x in found:
        open_ = [y for y in open_ if y[1] > x[0]]  # later ones start behind the others
        around = (y for y in open_ if y[1] >= x[1])
        if not any(y[2].priority <= x[2].priority + (SLACK if y[1] - y[0] > x[1] - x[0] else 0) for y in around):
            kept.append(x)
        open_.append(x)
    return kept


def scan(text: bytes) -> tuple[list[int], set[str], set[str], float]:
    """Byte starts of base places, base labels, all labels and the score of one lower-cased text."""
    base = _scanner()[2]
    places: list[int] = []
    labels: set[str] = set()
    for label, words, rx in base:
        at = [m.start() for m in _places(rx, text)] if all(w in text for w in words) else []
        if at:
            places += at
            labels.add(label)
    doubt = 0.1 if labels else 1.0
    found = detect(text)
    strongest: dict[str, float] = {}
    for _, _, r in found:
        strongest[r.label] = max(strongest.get(r.label, 0.0), r.confidence)
    for c in sorted(strongest.values()):
        doubt *= 1.0 - c
    return places, labels, labels | set(strongest), 1.0 - doubt


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = T.buffers(b.column("text"))
        for lo, hi, part, o in T.slices(data, off):
            low = T.LOWER[part]
            start, _, row = T.spans(IS_WORD[low], o)
            n_words = np.bincount(row, minlength=hi - lo).astype(np.int64)
            raw, cols = low.tobytes(), ([], [], [], [], [], [])
            for i in range(hi - lo):
                places, base, labels, score = scan(raw[o[i] : o[i + 1]])
                at = np.searchsorted(start, np.asarray(sorted(places), dtype=np.int64) + o[i]) - np.searchsorted(start, o[i])
                for c, v in zip(cols, (len(places), int(at[0]) if places else None, int(at[-1]) if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score)):
                    c.append(v)
            arrays = [b.column("doc_id").slice(lo, hi - lo), pa.array(n_words)] + [pa.array(c, f.type) for c, f in zip(cols, list(_SCHEMA)[2:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: places of the base phrases, labels and a score."""
    kept = docs.select(F.col("doc_id").cast("long"), "text")
    return kept.mapInArrow(_scan_batches, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
