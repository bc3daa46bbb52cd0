"""Recipes over a catalogue made of the parts table: one item page per distinct name."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.plans import derive as D
from corpusloom.plans.recipes import run_recipe
from corpusloom.plans.registry import query

R = D.with_("recipe_input")
_SAME = [["[^a-z0-9]", ""]]
_LAW = "The goods described on this page are kept in the store and may be ordered by any person who holds an account with the shop. "


def _pages(spark, d):
    """Item pages; those of an odd key lack the price, every fifth is too thin."""
    r = D.recipe_input(spark, d)
    text = F.concat(F.lit(_LAW * 4), F.lit("\nName: "), "input", F.when(F.col("k") % 2 == 0, F.concat(F.lit("\nPrice: $"), F.col("k").cast("string"), F.lit(".00"))).otherwise(""))
    node = F.concat(F.lit('{"@type":"Product","name":"'), "input", F.lit('","offers":[{"price":"'), F.col("k").cast("string"), F.lit('"}]}'))
    link = lambda pos, url, text: F.struct(F.lit(pos).alias("pos"), url.alias("url"), F.lit(text).alias("text"))
    return r.select("url", F.col("input").alias("title"), F.when(F.col("k") % 5 == 0, F.col("input")).otherwise(text).alias("text"),
                    F.array(link(0, F.lit("https://catalog.example/home"), "Home"), link(1, F.concat("url", F.lit("/specs/"), F.col("k").cast("string")), "Specifications")).alias("links"), F.array(node).alias("jsonld"))


def _run(spark, d, *steps):
    inputs = D.recipe_input(spark, d).select(F.col("input").alias("raw"))
    listing = D.recipe_input(spark, d).select(F.col("k").alias("pos"), "url")
    return run_recipe("catalog.example/item", list(steps), inputs, _pages(spark, d), listing).select(F.col("raw").alias("input"), "line")


_MAP = {"map": "https://catalog.example", "same": _SAME}
_REACH = {"reach": "{url}"}
_OK, _FAIL = "'RESULT: ok | catalog.example/item | ' || input || ' | '", "'RESULT: fail | catalog.example/item | ' || input || ' | '"
_PAGE = "'url=' || url || '; title=' || input"


@query(R + "SELECT input, regexp_replace(lower(input), '[^a-z0-9]+', '-', 'g') AS slug FROM recipe_input")
def recipe_input(spark, d):
    return D.recipe_input(spark, d).select("input", F.regexp_replace(F.lower("input"), "[^a-z0-9]+", "-").alias("slug"))


@query(R + f"SELECT input, {_OK} || 'count=1; first=' || url AS line FROM recipe_input")
def recipe_map_same(spark, d):
    return _run(spark, d, _MAP)


@query(R + f"SELECT input, CASE WHEN k % 5 = 0 THEN {_FAIL} || 'THIN_CONTENT at step 2' ELSE {_OK} || {_PAGE} END AS line FROM recipe_input")
def recipe_reach(spark, d):
    return _run(spark, d, _MAP, _REACH)


@query(R + f"SELECT input, CASE WHEN k % 5 = 0 THEN {_FAIL} || 'THIN_CONTENT at step 2' WHEN k % 2 = 0 THEN {_OK} || {_PAGE} || '; name=' || input || '; price=$' || k || '.00' ELSE {_FAIL} || 'EXTRACT_MISS at step 3' END AS line FROM recipe_input")
def recipe_extract(spark, d):
    return _run(spark, d, _MAP, _REACH, {"extract": {"name": "^name: (.*)$", "price": r"^price: (\$[0-9.]+)"}})


@query(R + f"SELECT input, CASE WHEN k % 5 = 0 THEN {_FAIL} || 'THIN_CONTENT at step 2' ELSE {_OK} || {_PAGE} || '; price=' || k END AS line FROM recipe_input")
def recipe_jsonld(spark, d):
    return _run(spark, d, _MAP, _REACH, {"jsonld": {"price": "offers.price", "colour?": "color"}})


@query(R + f"SELECT input, CASE WHEN k % 5 = 0 THEN {_FAIL} || 'THIN_CONTENT at step 2' ELSE {_FAIL} || 'NOT_CACHED at step 4' END AS line FROM recipe_input")
def recipe_find(spark, d):
    """Finds the specifications link, whose page is not in the store."""
    return _run(spark, d, _MAP, _REACH, {"find": "/specs/|^specifications$"}, _REACH)


@query(R + f"SELECT input, CASE WHEN k % 5 = 0 THEN {_FAIL} || 'THIN_CONTENT at step 2' ELSE {_OK} || 'count=1; first=' || url || '/specs/' || k END AS line FROM recipe_input")
def recipe_links(spark, d):
    return _run(spark, d, _MAP, _REACH, {"links": "/specs/<n>"})
