import os
import random

import pytest

import corpus_pipeline
from tests.llm.rows import documents
from worklens.llm import simhash
from worklens.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_each_others_documents(spark, tmp_path):
    docs = raw = table(spark, SF, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == raw.columns
            kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(a >= b for a, b in zip([{r.doc_id for r in raw.select("doc_id").collect()}, *kept], kept))
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == kept[-1]
    # Each stage's decision holds for what it kept.
    texts = [r.text.lower() for r in spark.read.parquet(f"{tmp_path}/exact_dedup").collect()]
    assert len(texts) == len(set(texts))
    assert simhash.near_groups(spark.read.parquet(f"{tmp_path}/simhash")).where("doc_id <> component_id").count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = documents(spark, extra=False).selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, str(tmp_path))
        out.collect()


def test_near_stage_keeps_one_of_each_group(spark):
    """By brute force over all pairs of fingerprints; ids that are repeated with other texts are judged by text."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 60, 400]))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "Two words", "two  WORDS", "two words more"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, "another text of this id which nobody else has in any form"), (None, texts[0]), (None, texts[0])]
    prints = [simhash.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    for a in known:
        for b in known:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k in known:
        least[top(k)] = min(least.get(top(k), rows[k][0]), rows[k][0])
    want = sorted((rows[k][0], rows[k][1] or "") for k in known if least[top(k)] == rows[k][0])
    docs = documents(spark, rows)
    got = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text or "") for r in got.collect()]
    assert sum(i is None for i, _ in kept) == 2 and sorted(x for x in kept if x[0] is not None) == want
