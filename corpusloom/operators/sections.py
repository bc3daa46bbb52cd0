"""Segmentation of long documents into cited sections: splitting at heads, and the policies for repeated ids.

A connector is a declarative spec of these parts; programs are never taken from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_sections(lines: DataFrame, stop: str | None = None) -> DataFrame:
    """doc_id, sec (number in the document), id, heading, text, n_lines. ``lines``: doc_id, line_no, line, head (the id, or
    empty). A head opens a section; lines before the first belong to none; a line that matches ``stop`` closes it."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opens = F.col("head") != ""
    closes = F.col("line").rlike(stop) if stop else F.lit(False)
    s = lines.withColumn("sec", F.sum((opens | closes).cast("int")).over(w)).withColumn("last", F.when(opens, "open").when(closes, "closed"))
    s = s.withColumn("state", F.last("last", ignorenulls=True).over(w)).where("state = 'open'")
    g = s.groupBy("doc_id", "sec").agg(F.max(F.when(opens, F.col("head"))).alias("id"), F.max(F.when(opens, F.col("line"))).alias("heading"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec"))
    return g.select("doc_id", rank.alias("sec"), "id", "heading", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"), F.size("ls").alias("n_lines"))


def longest(sections: DataFrame) -> DataFrame:
    """Of the candidates of an id the longest; ties go to the first."""
    w = Window.partitionBy("doc_id", "id").orderBy(F.desc(F.length("text")), "sec")
    return sections.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first(sections: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "id").orderBy("sec")
    return sections.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def joined_versions(sections: DataFrame) -> DataFrame:
    """All versions of an id, in order, as one text."""
    parts = F.sort_array(F.collect_list(F.struct("sec", "text")))
    return sections.groupBy("doc_id", "id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("versions"))


def in_force(versions: DataFrame, by: list[str], today: Column) -> DataFrame:
    """The version in force: the latest that has begun, or the earliest if none has."""
    begun = F.col("effective") <= today
    best = F.coalesce(F.max(F.when(begun, F.struct("effective", "seq"))), F.min(F.struct("effective", "seq")))
    return versions.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.seq").alias("seq"), F.col("b.effective").alias("effective"))


def natural_key(value: Column) -> Column:
    """A text key that sorts numbers inside a string by value: a number is led by its length, so longer ones come later."""
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    number = lambda p: F.concat(F.lit("0"), F.lpad(F.length(bare(p)).cast("string"), 6, "0"), bare(p))
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """``df`` with rank: the place of each row in the order of ``key`` over the whole table. Rows are dealt by ranges of the key and
    numbered inside each; ranges are drawn once (checkpoint) and hand on their counts, so nothing is sorted in one task."""
    dealt = df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return dealt.withColumn("_row", inside).join(counts, "_range").withColumn("rank", (F.col("_row") + F.col("_before")).cast("int")).drop("_range", "_row", "_before")


def merged_runs(sections: DataFrame) -> DataFrame:
    """Sections that follow each other under one id, as one: a long section is printed in pieces."""
    w = Window.partitionBy("doc_id").orderBy("sec")
    new = F.coalesce((F.col("id") != F.lag("id").over(w)).cast("int"), F.lit(1))
    runs = sections.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    parts = F.sort_array(F.collect_list(F.struct("sec", "heading", "text")))
    g = runs.groupBy("doc_id", "run", "id").agg(parts.alias("p"))
    return g.select("doc_id", F.col("p")[0]["sec"].alias("sec"), "id", F.col("p")[0]["heading"].alias("heading"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


_DATE = r"((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})"


def current(sections: DataFrame, today: Column) -> DataFrame:
    """Of the versions of an id the one in force: notes like "(Effective until July 1, 2030)" and "(Effective July 1, 2030)"
    in its first 400 characters are held against ``today``. What is in force beats what is not, what is not repealed beats
    what is, then the latest beginning wins; if nothing is in force, the earliest. Ties go to the first."""
    head = F.substring("text", 1, 400)
    date = lambda rx: F.try_to_timestamp(F.nullif(F.regexp_extract(head, rx + _DATE, 1), F.lit("")), F.lit("MMMM d, yyyy")).cast("date")
    s = sections.withColumns({"until": date(r"(?i:effective until|until|expires|repealed effective) "), "begins": date(r"(?i:effective|effective from|effective on|beginning) ")})
    live = F.coalesce(F.col("until") > today, F.lit(True)) & F.coalesce(F.col("begins") <= today, F.lit(True))
    begins = F.coalesce(F.datediff("begins", F.lit("0001-01-01").cast("date")), F.lit(0))
    gone = head.rlike(r"(?i)\(repealed\)|^[^\n]*\[repealed\]")
    order = [F.desc("live"), F.asc("gone"), F.when(F.col("live"), -F.col("age")).otherwise(F.col("age")), F.asc("sec")]
    s = s.withColumns({"live": live, "gone": gone, "age": begins})
    s = s.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(*order)))
    return s.where("_r = 1").drop("_r", "live", "gone", "age", "until", "begins")


def exploded_ids(sections: DataFrame) -> DataFrame:
    """A section that names several ids ("2.104, 2.105 Repealed") once for each."""
    return sections.withColumn("id", F.explode(F.transform(F.split("id", r",|\band\b"), F.trim))).where("id != ''")


def running_heads(lines: DataFrame, least: int = 2) -> DataFrame:
    """Lines that recur in a document: page heads and feet, not text."""
    return lines.where(F.trim("line") != "").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def citation(template: str, **parts: Column) -> Column:
    """``{id}`` and other names of a template, filled from columns; an id loses its blanks."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.regexp_replace(c, r"\s+", "") if name == "id" else c)
    return out
