"""The pipeline against plain versions of its stages, each on that stage's own input."""

import random

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline as C
from kilowatch.llm import quality
from test_secrets import masked, plain as plain_spans
from test_simhash_dedup import plain_components, plain_fingerprint

R = random.Random(21)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randrange(2, 9))) for _ in range(900)]
ITEM = " ".join(R.choice(WORDS) for _ in range(25))


def prose(n):
    return ". ".join(" ".join(R.choice(WORDS) for _ in range(9)).capitalize() for _ in range(max(1, n // 9))) + "."


def junk(n):
    return " ".join(R.choice(WORDS) + R.choice(["%%%", "$$$", "###"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, junk(60) if k % 5 == 0 else prose(R.randrange(30, 300))) for k in range(500)]
    rows += [(1000 + k, rows[k][1]) for k in range(1, 60)]
    rows += [(2000 + k, prose(80) + " " + ITEM.title() + ", " + prose(40)) for k in range(10)]
    rows += [(3000 + k, prose(80) + f" token = \"{R.getrandbits(160):040x}\" " + prose(9)) for k in range(10)]
    rows += [(4000, None), (4001, ""), (None, prose(50)), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 5 != 0), 0) for k in range(500)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen.append((before.collect(), docs.collect()))
        if k < len(C.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    (rows, good), (_, one), (_, clean), (_, safe), (_, ids) = seen

    scores = {r["doc_id"]: r["predicted"] for r in quality.classified(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert sorted(good, key=str) == sorted((r for r in rows if scores[r["doc_id"]]), key=str)
    assert sum(r["doc_id"] is not None and r["doc_id"] < 500 and r["doc_id"] % 5 == 0 for r in good) <= 2 and len(good) > 450

    prints = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in good if r["doc_id"] is not None}
    groups = plain_components(prints)
    assert {r["doc_id"] for r in one} - {None} == {i for i, g in groups.items() if i == g} and len(one) == len(set(one))
    assert not {r["doc_id"] for r in one} & set(range(1000, 1060))

    assert {r["doc_id"] for r in one} - {r["doc_id"] for r in clean} == {i for i in range(2000, 2010)} & {r["doc_id"] for r in one}

    want = {r["doc_id"]: r["text"] and masked(r["text"], plain_spans(r["text"])[1]) for r in clean}
    assert {r["doc_id"]: r["text"] for r in safe} == want and all(r["n_chars"] == len(r["text"] or "") for r in safe)
    assert sum("[SECRET]" in (r["text"] or "") for r in safe) >= 8

    assert {r["doc_id"] for r in ids} == {r["doc_id"] for r in safe} and all(r["exact"] and len(r["ids"]) == r["n_tokens"] for r in ids)
    whole = C.run(spark, folder).collect()
    assert sorted(whole, key=str) == sorted(ids, key=str)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    names = set(entry_points.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
