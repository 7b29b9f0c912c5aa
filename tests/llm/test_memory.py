import pytest

import corpus_pipeline
from marlspring.llm import common, suffixes


@pytest.mark.parametrize("stop", [2, 1])
def test_a_task_ends_by_giving_memory_back(monkeypatch, stop):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1))
    task = common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert [next(task) for _ in range(stop)] == [2, 3][:stop] and not told
    task.close()
    assert told == [1]


def test_blocks_reach_a_task_few_at_a_time(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1500)
    seen, real = {}, type(documents).mapInArrow
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, f, *a, **b: seen.setdefault(f.__name__, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) and real(self, f, *a, **b))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    suffixes.suffix_dedup(documents).collect()
    assert seen["deal"] <= 4 < seen["pack"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_stage_is_written_with_bounded_batches(spark, documents, tmp_path):
    before = {name: spark.conf.get(name) for name in corpus_pipeline.ROWS}
    try:
        for _, stage in corpus_pipeline.STAGES[:2]:
            for name in before:
                spark.conf.set(name, 10_000)
            stage(spark, documents, str(tmp_path))
            assert all(int(spark.conf.get(name)) <= 1000 for name in before)
    finally:
        for name, rows in before.items():
            spark.conf.set(name, rows)
