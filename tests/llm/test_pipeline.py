"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import collections
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import mixing, packing, quality, secretscan, shared

from . import plain
from .test_operators import DATA, ODD, SCHEMA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame(ODD, SCHEMA))
    docs.withColumn("copies", F.lit(3)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, f in corpus_pipeline.STAGES:
        tables.append(shared.stage(f(spark, tables[-1], folder), "test"))
        if name != "packing":
            assert tables[-1].columns == tables[0].columns
    rows = [t.collect() for t in tables]
    docs, good, single, clean, mixed, packed = rows
    key = lambda r: (r["doc_id"], r["text"])

    verdicts = quality.judged(tables[0], spark.read.parquet(f"{folder}/labels.parquet")).collect()
    kept = collections.Counter(r["doc_id"] for r in verdicts if r["kept"])
    assert collections.Counter(r["doc_id"] for r in good) == kept and len(good) > 0.8 * len(docs)

    classes = plain.classes({r["doc_id"]: r["text"] for r in good if r["doc_id"] is not None}, 5)
    ids = [r["doc_id"] for r in single]
    assert sorted(i for i in ids if i is not None) == sorted(k for k, (_, c) in classes.items() if k == c) and ids.count(None) == [r["doc_id"] for r in good].count(None)
    assert {key(r) for r in single} <= {key(r) for r in good}

    found = {r["doc_id"]: r["spans"] for r in secretscan.secrets(tables[2]).collect()}
    before = {r["doc_id"]: r["text"] for r in single}
    assert sorted(ids, key=str) == sorted((r["doc_id"] for r in clean), key=str)
    for r in clean:
        t = before[r["doc_id"]]
        if not found[r["doc_id"]]:
            assert r["text"] == t
            continue
        spans, at, want = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in found[r["doc_id"]].split(","))), 0, ""
        for a, b in spans:  # one mask for spans that overlap
            if a >= at:
                want += t[at:a] + "[secret]"
            at = max(at, b)
        assert r["text"] == want + t[at:] and r["n_chars"] == len(r["text"])
        assert not plain.secrets(r["text"])

    times = collections.Counter(key(r) for r in mixed)
    drawn = mixing.mix(tables[3].drop("copies").select("*", mixing.word_count().alias("mx_size"))).collect()
    assert times == collections.Counter({key(r): r["copies"] for r in drawn if r["copies"]})
    taken, target = collections.Counter(), {}
    for r in drawn:
        taken[r["source"]] += r["copies"] * r["mx_size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 2 * max(r["mx_size"] for r in drawn if r["source"] == s) for s, t in target.items())

    tok = packing._exact(packing.tokenizer_paths()[0])
    ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in mixed}
    n, seen, room = collections.Counter(r["doc_id"] for r in mixed), collections.Counter(), collections.defaultdict(list)
    for r in packed:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and plain.crc(part) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == collections.Counter({k: n[k] * len(v) for k, v in ids.items()})
    assert all(a + m == b for s in room.values() for (a, m), (b, _) in zip(sorted(s), sorted(s)[1:])) and all(min(s)[0] == 0 and sum(m for _, m in s) <= 1024 for s in room.values())
    assert shared.release(spark) > 0


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
