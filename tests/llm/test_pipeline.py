"""Every stage of the pipeline against a brute-force version of its own input."""

import importlib.util
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from ruleloom.llm import packing, pii, toxicity

HERE = Path(__file__).resolve().parent
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def other(name):
    spec = importlib.util.spec_from_file_location(f"own_{name}", HERE / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of each stage over the smallest documents with odd rows added, stored."""
    where, sf = tmp_path_factory.mktemp("stages"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    longest = docs.orderBy("n_chars", ascending=False).first()
    odd = [(90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, " \n", "en", "s", 2), (None, "no id but a text of more than five words", "en", "s", 40), tuple(longest), tuple(longest)]
    tables = [docs.unionAll(spark.createDataFrame(odd, docs.schema))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf).write.parquet(f"{where}/{name}")
        tables.append(spark.read.parquet(f"{where}/{name}"))
    return tables


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "personal_data", "packing"]
    assert all(t.columns == COLUMNS for t in stages[:5]) and corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, stages):
    before, after = Counter(rows_of(stages[0])), Counter(rows_of(stages[1]))
    model = toxicity.fit(stages[0], spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    bad = {r for r in before if model.severity([r[1]])[0] >= 0.5}
    assert after == Counter({r: n for r, n in before.items() if r not in bad})


def test_one_of_each_group_stays(stages):
    brute = other("test_neardup")
    before = rows_of(stages[1])
    marks = brute._brute([r[:2] for r in before])
    assert Counter(rows_of(stages[2])) == Counter({r for r, m in zip(before, marks) if m[3]})


def test_repeats_are_cut(stages):
    brute = other("test_linededup")
    before, after = rows_of(stages[2]), {r[0]: r for r in rows_of(stages[3])}
    cuts = {}
    for doc_id, a, b, _, _ in brute.brute([r[:2] for r in before]):
        cuts.setdefault(doc_id, []).append((a, b))
    assert len(after) == len(before) and cuts
    for doc_id, text, *rest in before:
        kept = text
        for a, b in sorted(cuts.get(doc_id, ()), reverse=True):
            kept = kept[:a] + kept[b:]
        assert after[doc_id] == (doc_id, kept, *rest[:2], rest[2] if kept is None else len(kept))


def test_personal_data_is_replaced(stages):
    brute = other("test_pii")
    before, after = rows_of(stages[3]), {r[0]: r for r in rows_of(stages[4])}
    found = {}
    for doc_id, *_, spans in brute.brute([r[:2] for r in before]):
        found[doc_id] = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    assert len(after) == len(before) and any(found.values())
    for doc_id, text, *rest in before:
        clean = pii.sanitised(text, [s for s in found[doc_id] if s[0] in pii.MORE_KINDS])
        assert after[doc_id] == (doc_id, clean, *rest[:2], rest[2] if clean is None else len(clean))
        if not found[doc_id]:
            assert clean == text
        assert not re.search(r"@[a-z0-9-]+\.[a-z]", clean or "")


def test_all_pieces_are_packed(stages):
    brute = other("test_packing")
    tok = packing.WordTokenizer(packing.default_path())
    brute._check(stages[5].collect(), [r[:2] for r in rows_of(stages[4])], tok)


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == stages[5].columns and rows.where("length > 4096").isEmpty() and rows.count() > 100
