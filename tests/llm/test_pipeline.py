"""The corpus pipeline, stage by stage, each against its own input."""

import corpus_pipeline
from arbora.llm import decontaminate, storage, toxicity
from tests.conftest import SMALL
from tests.llm.test_operators import check_packing, groups_by_force


def test_stages(spark):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    rows, seen = storage.read(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out, _ = storage.materialize(stage(spark, rows, SMALL), f"test-{name}")
        before, after = ({r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} if "text" in x.columns else None for x in (rows, out))
        seen.append(name)
        if name == "toxicity":
            scores = toxicity.score(rows, toxicity.fit(rows, storage.read(spark, SMALL, "labels"))).collect()
            assert set(after) == {r["doc_id"] for r in scores if r["score"] < 0.7}
        elif name == "near_copies":
            assert set(after) == {i for i, (_, root) in groups_by_force(before.items()).items() if root == i}
        elif name == "decontamination":
            gone = {r["doc_id"] for r in decontaminate.contaminated(rows, storage.read(spark, SMALL, "benchmark")).collect()}
            assert set(after) == set(before) - gone
        elif name == "secrets":
            assert set(after) == set(before)
            assert not any("token = \"" in t for t in after.values())
        else:
            packed = out.collect()
            check_packing(packed, 4096)
            assert {r["doc_id"] for r in packed} == set(before)
        if name != "packing":
            assert out.columns == columns
            rows = out
    assert seen == ["toxicity", "near_copies", "decontamination", "secrets", "packing"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
