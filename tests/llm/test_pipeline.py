"""The five stages, each on what its predecessor kept, against the operators and brute force."""

import random

import corpus_pipeline
import pytest
from helpers import documents


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))

    def prose(n):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(n))

    texts = [prose(rng.randrange(20, 90)) for _ in range(400)]
    for n in range(0, 400, 6):
        texts[n] += " oaf grump dunce"
    passage = prose(30)
    texts[1] = texts[2]  # an exact copy
    texts[7] = " ".join(texts[9].split()[:-1] + ["other"])  # a near copy, one line each
    texts[11] += "\n" + passage
    shared = "This very line is in many of the documents"
    for n in (13, 14, 15):
        texts[n] += "\n" + shared
    texts[16], texts[17] = None, ""
    documents(spark, texts, source=[f"s{n % 3}" if n % 5 else None for n in range(400)]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(n, int(n % 6 == 0)) for n in range(0, 400, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        assert docs.columns[:5] == columns and (k == 4 or len(docs.columns) == 5)
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert before.count() >= docs.count() == len(kept[-1])
    toxic, lines, groups, clean, mixed = kept
    assert sum(n % 6 == 0 for n in toxic) <= 4 and sum(n % 6 > 0 for n in toxic) >= 330
    shared = "This very line is in many of the documents"
    assert shared in lines[13]["text"] and not any(shared in lines[n]["text"] for n in (14, 15))
    # The exact copy loses all its lines; it goes, as do the texts that were empty.
    assert not {2, 16, 17} & set(lines) and lines[1]["n_chars"] == len(lines[1]["text"]) > 0
    assert all(r["text"] for r in lines.values())
    assert set(lines) - set(groups) == {9}
    assert set(groups) - set(clean) == {11}
    assert set(mixed) == set(clean) and all(r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in mixed.values())
    run = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, folder).collect()}
    assert run == {n: r.asDict() for n, r in mixed.items()}


def test_corpus_has_each_document_as_often_as_planned(spark, folder):
    plan = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, folder).collect()}
    rows = [r.asDict() for r in corpus_pipeline.corpus(spark, folder).collect()]
    want = [(n, k) for n, r in plan.items() for k in range(1, r["copies"] + 1)]
    assert sorted((r["doc_id"], r.pop("copy")) for r in rows) == sorted(want) and all(r == plan[r["doc_id"]] for r in rows)
    assert {r["copies"] for r in plan.values()} >= {0, 2}
    for source in {r["source"] for r in plan.values()}:
        own = [r for r in plan.values() if r["source"] == source]
        size = sum(r["size"] for r in rows if r["source"] == source)
        assert abs(size - own[0]["target"]) <= 3 * max(r["size"] for r in own)


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
