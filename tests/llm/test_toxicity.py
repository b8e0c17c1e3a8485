import random

import numpy as np
import pytest

from ruleloom.llm import toxicity
from ruleloom.llm.registry import RUN
import ruleloom.llm.queries  # noqa: F401

BAD = ["scum", "Moron", "IDIOTÄ", "trash"]


def corpus(n=700):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        bad = i % 7 == 0
        for _ in range(rng.randrange(1, 9) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice([",", ".", ""]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents(spark, folder):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows] + [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (None, "scum trash moron", "x", 1.0), (0, rows[0][1], "x", 1.0)], "doc_id long, text string, severity string, grade double").repartition(4)
    marks = spark.createDataFrame([(i, t, 1) for i, t in labels] + [(None, 1, 1), (3, None, 1), (88888, 1, 1), (0, 1, 1)], "doc_id long, toxic int, text int")
    sf = folder(documents=docs, labels=marks)
    got = RUN["op9_ordinal_toxicity"](spark, sf).collect()
    assert len(got) == docs.count()
    held_out = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 700}
    wrong = sum(r.toxic != (i % 7 == 0) for i, r in held_out.items())
    assert wrong <= 0.02 * len(held_out)
    assert next(r for r in got if r.doc_id is None).toxic
    assert not any(r.toxic for r in got if r.doc_id in (9000, 9001))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, RUN["op9_ordinal_toxicity"](spark, sf).collect()), key=str)
    model = toxicity.fit(docs, marks)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.toxic}
    assert (np.diff(model.thresholds) > 0).all()


def test_more_markers_are_more_severe(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = model.severity(["abcd hgfe", "abcd scum hgfe", "abcd scum moron, hgfe trash idiotä"])
    assert found[0] < 0.5 < found[1] < found[2]


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, None)]])
def test_without_toxic_labels_nothing_is_toxic(spark, folder, docs, labels):
    sf = folder(documents=docs, labels=spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = RUN["op9_ordinal_toxicity"](spark, sf).collect()
    assert len(got) == docs.count() and not any(r.toxic for r in got)
    sf = folder(documents=docs.limit(0), labels=spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert RUN["op9_ordinal_toxicity"](spark, sf).count() == 0


def test_grades_from_numbers():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 2000)
    rows = [np.unique(np.concatenate((rng.integers(100, 400, 20), np.arange(1, 9)[: 2 * g]))).astype(np.int64) for g in grades]
    model = toxicity.fit_ordinal(rows, grades)
    position = {int(f): w for f, w in zip(model.features, model.weights)}
    sums = np.array([sum(position.get(int(x), 0.0) for x in r) for r in rows])
    assert (model.grade(sums) == grades).mean() > 0.95
