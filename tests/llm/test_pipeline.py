"""Each stage of the pipeline against a plain version on a whole table."""

import importlib.util
from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline as cp
from fleetline.llm import language_id, pii


def helper(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).parent / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows of each stage's input and output, written and reread between stages."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    extra = spark.createDataFrame([(10_001, None, None, None, 0), (10_002, "12 34", None, "x", 5), (10_003, "", "en", "x", 0)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in cp.STAGES:
        done = stage(spark, docs, sf_dir)
        if name != "packing":
            assert done.schema.names == docs.schema.names
        done.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_language(spark, stages):
    before, after = stages["language"]
    model = language_id.fit(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"))
    known = [r for r in before if language_id.has_letter(r["text"])]
    far = model.nearest([r["text"] for r in known])[2]
    assert ids(after) == sorted(r["doc_id"] for r, f in zip(known, far) if not f) and not {10_001, 10_002, 10_003} & set(ids(after))


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    plain = helper("test_simhash")
    groups = plain.plain_groups([(r["doc_id"], plain.plain_fingerprint(r["text"])) for r in before])
    assert ids(after) == sorted({c for _, _, c in groups}) and len(after) < len(before)


def test_decontamination(spark, sf_dir, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    plain = helper("test_decontaminate").plain
    assert ids(after) == sorted(r["doc_id"] for r in before if not plain(r["text"], items)) and len(after) < len(before)


def test_personal_data(stages):
    before, after = stages["personal_data"]
    text = {r["doc_id"]: r["text"] for r in before}
    assert ids(after) == ids(before)
    for r in after:
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.candidates(text[r["doc_id"]]):
            assert r["text"] == text[r["doc_id"]]
    assert any(r["text"] != text[r["doc_id"]] for r in after)


def test_packing(stages):
    before, after = stages["packing"]
    assert set(ids(after)) == set(ids(before))
    filled = {}
    for r in after:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_registered_queries(spark, sf_dir):
    found = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)] == [1] * 13 and "pipeline" in found
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
