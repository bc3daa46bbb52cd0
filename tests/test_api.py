import pytest
from pyspark.sql import functions as F

from corpusloom.api import Engine
from corpusloom.sources import sinks, statutes

PROSE = "The record of the court shall be kept by the clerk of that court for any person who asks for it. " * 6


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    rows = [(f"https://a.com/p/{i}", f"T{i}", PROSE + f"\nPrice: {i}.00", 0, [{"pos": k, "url": f"https://a.com/p/{k}", "text": "x"} for k in range(5)], []) for i in range(5)]
    spark.createDataFrame(rows, "url string, title string, text string, n_scripts int, links array<struct<pos:int,url:string,text:string>>, jsonld array<string>").write.parquet(f"{e.folder}/pages")
    return e


def test_tools(engine):
    assert {r["outcome"] for r in engine.reach().collect()} == {"ok"}
    assert [r["pattern"] for r in engine.site_map().collect()] == ["/p/*"] and engine.site_map(filter="nothing").count() == 0
    assert {r["family"] for r in engine.families().collect()} == {"/p/<n>"}
    steps = [{"reach": "https://a.com/p/{input}"}, {"extract": {"price": "^price: ([0-9.]+)"}}]
    assert engine.compile("a.com/price", steps, ["1", "9"], 1.0)[0] == "TEST_FAILED" and engine.compile("a.com/price", steps, ["1", "2"], 1.0) == ("", "")
    assert [r["line"][-10:] for r in engine.run("a.com/price", ["3"]).collect()] == ["price=3.00"] and engine.run("none.com/x", ["3"]).first()["code"] == "NO_RECIPE"
    assert engine.explore("a.com").first()["recipes"] == "a.com/price" and engine.recipes().first()["score"] == 0.5
    engine.hold("a.com", "asked to", 5.0)
    assert engine.hold("a.com", "", 6.0, lift=True).first()["hold_reason"] is None and engine.memory("a.com").count() == 1
    engine.propose("listing_path", "/products", note="n")
    assert engine.propose("listing_path", "/products").first()["note"] == "n" and engine.moves("listing_path").first()["score"] == 0.5
    for kind, spec in (("listing_path", "p"), ("url_rewrite", "("), ("identity", "x")):
        with pytest.raises(ValueError, match="BAD_MOVE"):
            engine.propose(kind, spec)
    assert engine.enroll("a.com", "needed", 1.0).first()["status"] == "needed" and engine.cache().count() == 0


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.com/1", "ok", 10.0, "old"), ("https://a.com/1", "ok", 20.0, "new"), ("https://a.com/2", "blocked", 20.0, "x")], "url string, outcome string, fetched double, text string")
    sinks.write_mirror(pages, f"{tmp_path}/mirror")
    assert [r["text"] for r in sinks.read_mirror(spark.read.parquet(f"{tmp_path}/mirror"), 30.0).collect()] == ["new"]
    moves = spark.createDataFrame([("detail_suffix", "*", "/x", None, 0, 0, False), ("listing_root", "*", "/y", None, 0, 0, False)], "kind string, scope string, spec string, note string, tries long, wins long, dead boolean")
    lost = moves.select("kind", "scope", "spec", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("kind", "scope", "spec", F.lit(False).alias("ok"))
    after = sinks.score_moves(moves, lost)
    assert {r["kind"]: r["dead"] for r in after.collect()} == {"detail_suffix": True, "listing_root": False}
    again = sinks.propose_moves(after, moves.select("kind", "scope", "spec", F.lit("why").alias("note")))
    assert not again.where("dead").count() and again.where("note = 'why'").count() == 2
    log = spark.createDataFrame([(i,) for i in range(5000)], "id long")
    assert sinks.append_failures(log, spark.createDataFrame([(5000,)], "id long")).count() == 2001


def test_statutes(spark):
    assert len(statutes.states()) == 32
    text = "Title page\n§ 1. Name. This act may be cited as such.\nMore of one.\n§ 2. Scope.\nIt covers all.\n§ 2. Scope.\nIt covers all of the people in the state."
    d = spark.createDataFrame([(1, "https://l.gov/1", "5", None, text)], "doc_id long, url string, title string, kind string, text string")
    got = {r["citation"]: r["text"] for r in statutes.sections(d, "gu").collect()}
    assert set(got) == {"5 GCA § 1", "5 GCA § 2"} and got["5 GCA § 2"].endswith("state.")
    assert {r["citation"] for r in statutes.sections(d, "tx").collect()} == {"Tex. 5 § 1", "Tex. 5 § 2"}
