import random

import numpy as np
import pytest

from synthloom.llm import toxicity
from synthloom.llm.toxicity import Counts, Model, fitted, held_out, label_model, logistic, op12_toxicity, scored


def prose(rng, toxic):
    words = ["".join(rng.choice("aeioubdfglmnrst") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(20, 120))]
    if toxic:
        for w in rng.choice([["idiot", "scum"], ["gr" + "unzelwicht"], ["zapfzapf", "xaverzapfer"]]) * 2:
            words.insert(rng.randint(0, len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, k % 7 == 0), k % 7 == 0) for k in range(1200)]
    docs = spark.createDataFrame([(k, t, "score") for k, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(y != (k % 97 == 5))) for k, _, y in rows], "doc_id long, toxic int")  # some are wrong
    return docs, labels, {k: y for k, _, y in rows}


def test_held_out_accuracy(spark, tables):
    docs, labels, truth = tables
    model = fitted(docs, labels.filter(~held_out()))
    rows = scored(docs, model).withColumn("held", held_out()).filter("held").collect()
    assert len(rows) > 200
    right = np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in rows])
    assert right > 0.97
    again = {r.doc_id: r.score for r in scored(docs.repartition(5), fitted(docs.repartition(3), labels.repartition(2).filter(~held_out()))).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def test_labels_of_held_out_rows_are_not_learned(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, prose(rng, k % 5 == 0)) for k in range(300)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id long, toxic int").withColumn("h", held_out())
    labels.drop("h").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    labels.selectExpr("doc_id", "IF(h, 1 - toxic, toxic) AS toxic").write.parquet(str(tmp_path / "b" / "labels.parquet"))
    a, b = ({r.doc_id: r.score for r in op12_toxicity(spark, str(tmp_path / x)).collect()} for x in "ab")
    assert a == b


def test_label_model_recovers_rates_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    fires = [rng.random(6000) < np.where(y, a, b) for a, b in ((0.6, 0.01), (0.5, 0.02), (0.4, 0.01), (0.7, 0.05))]
    votes = np.column_stack([*fires, fires[0], fires[0]])  # two copies of the first
    given = np.where(rng.random(6000) < 0.05, ~y, y).astype(int)
    posterior, rates, say = label_model(votes, given, np.ones(6000))
    assert np.mean((posterior > 0.5) == y) > np.mean(given == y)
    assert np.allclose(rates[0, :4], [0.6, 0.5, 0.4, 0.7], atol=0.06) and np.allclose(rates[1, :4], [0.01, 0.02, 0.01, 0.05], atol=0.03)
    assert max(say[[0, 4, 5]]) < 0.45 and min(say[1:4]) > 0.6


def test_logistic_meets_its_conditions():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.random((500, 3)), np.ones(500)])
    t, w = rng.random(500), rng.random(500) + 0.5
    beta = logistic(x, t, w)
    p = 1 / (1 + np.exp(-x @ beta))
    gradient = x.T @ (w / w.mean() * (p - t)) + toxicity.RIDGE * np.r_[beta[:-1], 0]
    assert np.abs(gradient).max() < 1e-3


def test_pieces_are_counted_as_by_definition():
    counts = Counts(("=abcd", "bcde", "zzzz"))
    found, words = counts.of("abcd ABCDE bcdebcde, you utter idiot; abcd")
    assert words == 7 and found == {0: 1, 4: 1, 5: 2, 6: 2}
    assert counts.of("") == ({}, 0)
    assert counts.of("q" * 500_000 + "zzzz")[0] == {7: 1}


def test_odd_rows_and_tables_without_labels(spark, tmp_path):
    rows = [(None, None), (1, ""), (1, "you stupid idiot"), (1, "you stupid idiot"), (2, "fine words " * 200_000), (3, "\x00 ☃")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS toxic", "0.5 AS score")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = scored(docs, fitted(docs, none)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert sorted(r.score >= 0.3 for r in got) == [False] * 4 + [True] * 2
    docs.drop("toxic", "score").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    none.write.parquet(str(tmp_path / "labels.parquet"))
    assert op12_toxicity(spark, str(tmp_path)).count() == 0


def test_a_model_of_no_pieces_is_the_lexicons():
    assert len(Model((), (), np.zeros(11)).weights) == 2 * toxicity.FIXED + 1
