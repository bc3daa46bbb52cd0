"""Statute connectors as declarative specs: how a document's lines become cited sections. No program is taken from data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import sections as S

#: State, citation template, policy for repeated ids (first, longest, join, run, dated, each, all), and what opens
#: a section.
_MARK = r"^\s*(?:§+|Sec(?:tion)?\.?|Art(?:ículo|icle)?\.?)\s*([0-9]+[0-9A-Za-z.:-]*)"
_NUMBER = r"^\s*([0-9]+[0-9A-Za-z]*(?:[-.:][0-9A-Za-z]+)+)"
_SEVERAL = r"^\s*([0-9]+\.[0-9]+[a-z]?(?:(?:,| and) *[0-9]+\.[0-9]+[a-z]?)*)"
SPECS = (
    ("al", "Ala. Code § {id}", "all", _NUMBER), ("as", "A.S.C.A. § {id}", "first", _NUMBER), ("co", "C.R.S. {id}", "dated", _NUMBER), ("ct", "Conn. Gen. Stat. § {id}", "all", _MARK),
    ("gu", "{title} GCA § {id}", "longest", _MARK), ("ia", "Iowa Code § {id}", "first", _NUMBER), ("il", "{title} ILCS {id}", "first", _MARK), ("md", "Md. Code, {title} § {id}", "all", _MARK),
    ("me", "{title} M.R.S. § {id}", "dated", _MARK), ("mi", "MCL {id}", "each", _SEVERAL), ("mn", "Minn. Stat. § {id}", "first", _NUMBER), ("mp", "{title} CMC § {id}", "first", _MARK),
    ("mt", "§ {id}, MCA", "join", _NUMBER), ("nd", "N.D.C.C. § {id}", "all", _NUMBER), ("ne", "Neb. Rev. Stat. § {id}", "first", _NUMBER), ("nh", "RSA {id}", "all", _NUMBER),
    ("nj", "N.J. Stat. § {id}", "run", _NUMBER), ("nv", "NRS {id}", "first", _NUMBER), ("ny", "N.Y. {title} § {id}", "all", _MARK), ("or", "ORS {id}", "first", _NUMBER),
    ("pa", "{title} Pa.C.S. § {id}", "first", _MARK), ("pr", "Ley {title}, {kind} {id}", "longest", _MARK), ("ri", "R.I. Gen. Laws § {id}", "first", _MARK), ("sd", "SDCL § {id}", "first", _NUMBER),
    ("tx", "Tex. {title} § {id}", "join", _MARK), ("ut", "Utah Code Ann. § {id}", "first", _NUMBER), ("va", "Va. Code § {id}", "dated", _MARK), ("vt", "{title} V.S.A. § {id}", "all", _MARK),
    ("wa", "RCW {id}", "first", _NUMBER), ("wi", "Wisconsin Statutes § {id}", "first", _NUMBER), ("wv", "W.Va. Code § {id}", "longest", _MARK), ("wy", "Wyo. Stat. § {id}", "first", _NUMBER),
)


#: States whose printed pages carry running heads: lines that recur in a document are cut there, and nowhere else.
RUNNING_HEADS = ("pr",)


@dataclass(frozen=True)
class Connector:
    state: str
    citation: str
    policy: str
    head: str


def states() -> dict[str, Connector]:
    return {s[0]: Connector(*s) for s in SPECS}


_POLICIES = {
    "all": lambda s, today: s,
    "first": lambda s, today: S.first(s),
    "longest": lambda s, today: S.longest(s),
    "join": lambda s, today: S.joined_versions(s).join(S.first(s).select("doc_id", "id", "heading"), ["doc_id", "id"]),
    "run": lambda s, today: S.merged_runs(s),
    "dated": lambda s, today: S.current(s, today),
    "each": lambda s, today: S.exploded_ids(s),
}


def sections(documents: DataFrame, state: str, stop: str | None = None, today: str = "2026-01-01") -> DataFrame:
    """citation, heading, text, url, and why a section is not content (empty if it may be). ``documents``: doc_id, url, title,
    kind, text. Repeated ids are settled by the state's policy, dated ones as of ``today``."""
    c = states()[state]
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    if state in RUNNING_HEADS:
        lines = lines.join(S.running_heads(lines, 2).select("doc_id", "line"), ["doc_id", "line"], "left_anti")
    lines = lines.withColumn("head", F.regexp_replace(F.regexp_extract("line", c.head, 1), r"[.:-]+$", ""))
    found = _POLICIES[c.policy](S.split_sections(lines, stop), F.lit(today).cast("date"))
    named = found.join(documents.select("doc_id", "url", "title", "kind"), "doc_id")
    cited = S.citation(c.citation, id=F.col("id"), title=F.coalesce("title", F.lit("")), kind=F.coalesce("kind", F.lit("")))
    return named.select(cited.alias("citation"), "heading", "text", "url", X.not_content(F.col("text")).alias("gate"))
