"""Quality rules and classifier."""

import numpy as np
from pyspark.sql import functions as F

from codequarry.llm import quality_model as Q
from codequarry.llm import quality_rules as R
from codequarry.llm.textstats import TextStats

SF = "/root/testdata/sf0.01"


def test_statistics_of_a_text():
    s = TextStats("A b\n#x! é\n\nA b\nÉ 12")
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (8, 11, 1, 1, 0)
    assert (s.n_upper, s.n_lower, s.n_loud, s.distinct_words, s.n_stutters) == (3, 4, 1, 6, 0)
    again = TextStats(" ".join("a b c d e f g h x a b c d e f g h y".split()))
    assert again.n_repeat_words == 16
    for empty in (None, "", " \n "):
        s = TextStats(empty)
        assert (s.n_words, s.word_chars, s.n_dup_lines, s.n_repeat_words, s.n_stutters) == (0,) * 5


def rows(spark, *pairs):
    return spark.createDataFrame([(k, t, True, 3) for k, t in pairs], "doc_id long, text string, kept boolean, n_words int")


def test_order_never_changes_verdicts(spark):
    clean = " ".join(f"word{i} and" for i in range(30))
    loud = " ".join(f"Word{i}!" for i in range(30))
    df = rows(spark, (1, clean), (2, loud), (3, None), (4, ""), (5, "a " * 200), (None, clean), (1, clean),
              (6, " ".join(f"# w{i}" for i in range(30))), (7, "x" * 100_000))
    got = {r.id: r.kept for r in R.judge(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, None: True, 6: False, 7: False}
    texts = df.select(F.col("doc_id").alias("id"), "text")
    assert sorted(R.rule_order(texts)) == sorted(R.RULES)
    for order in (sorted(R.RULES), sorted(R.RULES, reverse=True)):
        out = texts.mapInArrow(R._judge(order), R.judge(df).schema.simpleString()[7:-1].replace(":", " "))
        assert {r.id: r.kept for r in out.collect()} == got


def test_empty_tables(spark):
    none = rows(spark)
    assert R.judge(none).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.quality_scores(none, labels).collect() == []
    one = {r.id: r.score for r in Q.quality_scores(rows(spark, (1, "a"), (2, None)), labels).collect()}
    assert one == {1: 0.5, 2: 0.5}


def test_one_label_gives_its_share(spark):
    labels = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    got = Q.quality_scores(rows(spark, *[(k, "some words") for k in range(9)]), labels).collect()
    assert {r.score for r in got} == {1.0}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_scores(docs.withColumn("score", F.lit(9)), labels).join(
        labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got)
    assert len(got) > 100 and right / len(got) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(Q.training_fold(F.col("doc_id")), F.col("quality")).otherwise(
        1 - F.col("quality")))
    a, b = ({r.id: round(r.score, 9) for r in Q.quality_scores(docs, x).collect()} for x in (labels, wrong))
    assert a == b


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(Q.FEATURES)))
    y = rng.integers(0, 2, 400)
    df = spark.createDataFrame([(row.tolist(), int(c)) for row, c in zip(x, y)], "x array<double>, label int")
    model = Q.train(df)
    want = Q.Discriminant(np.bincount(y), np.stack([x[y == c].mean(axis=0) for c in (0, 1)]),
                          np.stack([np.cov(x[y == c].T, bias=True) for c in (0, 1)]))
    assert np.allclose(model.score(x), want.score(x))
