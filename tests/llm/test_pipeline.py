import random

import pytest

import corpus_pipeline
from marlspring.llm.quality import quality_rules
from tests.llm.conftest import SCHEMA, words


def test_stages_keep_columns_and_take_effect(spark, documents, tmp_path, odd_texts):
    item = " ".join(odd_texts[8].split()[50:70])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        if name != "bpe_encoding":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[1] > seen[2] > seen[3] == seen[4] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1]
    assert all(quality_rules(documents.where(f"doc_id = {r.doc_id}")).first().kept for r in docs.limit(3).collect())


@pytest.mark.parametrize("ids", [[None] * 6, [3] * 6, [None, None, 5, 5, None, 7], [4, None, 4, None, None, 1]])
def test_null_and_repeated_ids_lose_no_document(spark, tmp_path, ids):
    rng = random.Random(3)
    a, b, c, d = (" ".join(words(rng, 40, 10_000)) for _ in range(4))
    texts = [a, b, a, c, b + " tail", d]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * 6, ["y"] * 6, map(len, texts))), SCHEMA)
    spark.createDataFrame([(1, " ".join(c.split()[5:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    want = [min(((i, t) for i, t in zip(ids, texts) if t in group), key=lambda r: (r[0] is None, r[0], texts.index(r[1])))[0] for group in ([a], [b, texts[4]], [c], [d])]
    assert [next(i for i, t in kept if t in group) for group in ([a], [b, texts[4]], [c], [d])] == want and len(kept) == 4
    clean = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(r.text for r in clean.collect()) == sorted(t for t in texts if t != c)
