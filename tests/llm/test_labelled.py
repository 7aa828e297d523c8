"""Models that learn from every labelled document."""

import numpy as np

from tidecast.llm import logistic, samples, toxicity


def test_toxicity_learns_from_all_labelled_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 50, raising=False)  # what a sample once held
    texts = [(i, f"vorbane {'zulgrit' if i % 4 == 0 else 'melion'} tarion{i % 5}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    # 100 of 400: (100 + 0.5) / 0.5 against the share of toxic documents
    share = 100.5 / 401
    assert abs(model.lexicon["zulgrit"] - np.log(100.5 / 0.5 * (1 - share) / share)) < 1e-9


def test_logistic_of_a_table_equals_that_of_arrays(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * [1.0, 7.0]
    y = (x[:, 0] + rng.normal(size=300) > 0.3).astype(int)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "_label int, _x array<double>").repartition(3)
    found, plain = logistic.fit_table(rows, 2), logistic.fit(x, y.astype(float))
    assert np.allclose(found.probability(x), plain.probability(x), atol=1e-9)
    one = logistic.fit_table(rows.where("_label = 1"), 2)
    assert np.allclose(one.probability(x[:1]), (y.sum() + 0.5) / (y.sum() + 1))
    assert logistic.fit_table(rows.where("_label = 7"), 2).probability(x[:1])[0] == 0.5


def test_all_labelled_documents_without_a_shuffle_of_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(60)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 80, 3)] + [(3, 0), (6, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    marks = {i: i % 2 for i in range(0, 80, 3)} | {6: 1}
    want = sorted((i % 50, marks[i % 50], f"text {i}") for i in range(60) if i % 50 in marks)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # labels too large for Spark's own choice
    try:
        for block, tables in ((1000, 1), (5, 6), (2, 1)):  # one block, several, more than passes are allowed
            monkeypatch.setattr(samples, "BLOCK_LABELS", block)
            parts = samples.labelled_parts(docs, labels, "toxic")
            plans = [p._jdf.queryExecution().executedPlan().toString() for p in parts]
            assert len(parts) == tables and all(("BroadcastHashJoin" in p) == (block != 2) for p in plans)
            assert sorted(map(tuple, samples.labelled_documents(docs, labels, "toxic").select("_id", "_label", "text").collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
