"""Every operator and pipeline stage on odd tables: nulls, empty and very long texts, ties, repeats, no rows, and clashing extra columns."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from arbora.llm import covertree, decontaminate, jaccard, licenses, packing, quality, secrets, shards, storage, templates, toxicity

#: Names that operators use inside, and that a caller's columns may have as well.
CLASHING = (
    "blob spans score gone before license_norm license_n license_kept license_base0 __norm __n __kept __blob __spans __score __gone __before row role features rep root key "
    "node id a b kind hub slot lead uid block island template host page subtrees blocks x dim wide shard place start ids piece length offset sequence_id found of least path"
).split()
LONG = "lorem ipsum token = abcdefgh12 mit license " * 6_000


def odd_rows():
    words = [f"v{k}" for k in range(40)]
    one = " ".join(words)
    return [(1, None), (2, ""), (3, " \n\t"), (4, one), (5, one), (5, one), (None, one), (6, one.upper()), (7, LONG), (8, "a b c"), (9, "a b c"), (10, 'password = "abcdefgh1"'), (None, None), (10, "other text of the same id")]


def docs_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module", params=["rows", "none"])
def docs(request, spark):
    return docs_of(spark, odd_rows()) if request.param == "rows" else docs_of(spark, odd_rows()).where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (8, 0, 0), (7, 0, 0), (None, 1, 1), (10, None, None), (4, 1, 1)], "doc_id bigint, quality int, toxic int")


def untouched(rows):
    """Extra columns have the caller's values."""
    return all(r[c] == f"own {c}" for r in rows for c in CLASHING)


def test_operators_on_odd_tables(spark, docs, labels):
    n = docs.count()
    groups = jaccard.similar_groups(docs).collect()
    assert len(groups) == n
    for r in groups:
        if r["doc_id"] in (4, 5, 6):
            assert (r["n_shingles"], r["component_id"]) == (36, 4)
        elif r["doc_id"] in (8, 9):
            assert (r["n_shingles"], r["component_id"]) == (1, 8)
        else:
            assert r["component_id"] == r["doc_id"]
    kept = jaccard.representatives(docs).collect()
    assert untouched(kept) and sorted(r["doc_id"] or 0 for r in kept) == sorted(r["doc_id"] or 0 for r in docs.collect() if r["doc_id"] not in (5, 6, 9))

    found = secrets.scan(docs).collect()
    assert len(found) == n
    for r in found:
        assert len(r["spans"]) == (6_000 if r["doc_id"] == 7 else 1 if r["doc_id"] == 10 and r["spans"] else 0)
    clear = secrets.redact(docs)
    assert clear.columns == docs.columns and clear.count() == n and untouched(clear.collect())

    slots = shards.materialise(docs, storage.new_path(spark, "edges")).collect()
    assert sorted(r["slot"] for r in slots) == list(range(len(slots))) and len({(r["doc_id"], r["start"]) for r in slots}) <= len(slots)
    packed = packing.pack(packing.cut_pieces(docs)).collect()
    assert sum(r["piece"] == 0 for r in packed) == n

    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == n and all(0 <= r["score"] <= 1 for r in scored)
    left = toxicity.accepted(docs, model)
    assert left.columns == docs.columns and untouched(left.collect())

    seen = licenses.scan(docs, "text", "result").collect()
    assert len(seen) == n and untouched(seen)
    for r in seen:
        assert r["result"]["labels"] == (["mit"] if r["doc_id"] == 7 else [])

    rows = quality.features(docs)
    known = labels.select("doc_id", "quality").where("doc_id is not null")
    assert all(0 <= r["score"] <= 1 for r in quality.score(rows, quality.fit(rows.join(known, "doc_id"), "quality")).collect())

    items = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (3, "a b c"), (4, " ".join(f"v{k}" for k in range(20)))], "item_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == ([(0, 4), (4, 4), (5, 4), (5, 4), (6, 4), (8, 1), (8, 3), (9, 1), (9, 3)] if n else [])
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and untouched(clean.collect())
    assert decontaminate.clean(docs, items.where("false")).count() == n


def test_pages_and_vectors_on_odd_tables(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<p>x"), (None, "http://a/", "<article>" + "<p>word " * 20_000), (3, "not a url", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("own") for c in CLASHING})
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in templates.extract(pages).collect())
    assert got == [(0, 20_000 * 5 - 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert templates.extract(pages.where("false")).count() == 0
    vectors = spark.createDataFrame([(50, [0.5, 0.5]), (50, [0.5, 0.5]), (1, [0.5, 0.5]), (2, []), (100, []), (None, None)], "vec_id bigint, embedding array<float>").withColumns({c: F.lit("own") for c in CLASHING})
    best = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in covertree.top_k(vectors, F.col("vec_id") % 50 == 0).collect())
    assert best == [(50, 1, 1, 32768), (50, 1, 1, 32768), (50, 2, 50, 32768), (50, 2, 50, 32768), (100, 1, 2, 0)]


def test_pipeline_stages_on_odd_tables(spark, docs, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a b c"), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    before = docs.count()
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, folder)
        if name != "packing":
            assert rows.columns == docs.columns
        out[name] = rows.collect()
        if name != "packing":
            assert untouched(out[name])
    assert sum(r["piece"] == 0 for r in out["packing"]) == before
    assert len(out["secrets"]) == before
    if before:
        assert sorted(r["doc_id"] or 0 for r in out["decontamination"]) == sorted(r["doc_id"] or 0 for r in docs.collect() if r["doc_id"] not in (8, 9))
        texts = {r["doc_id"]: r for r in out["secrets"] if r["doc_id"] == 7}
        assert "abcdefgh12" not in texts[7]["text"] and texts[7]["n_chars"] == len(texts[7]["text"])


def test_clashing_names_in_any_case(spark):
    frame = docs_of(spark, [(1, "x"), (2, random.Random(1).choice("yz"))]).withColumn("GONE_", F.lit(1))
    assert storage.free_name(frame, "gone") == "gone__"
    assert jaccard.representatives(frame).columns == frame.columns
