import math
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewmill.functions import labels as lb
from reviewmill.operators import features, metrics, scoring, terms, validation
from reviewmill.plans.evaluation import evaluate

CATS = ["A", "B"]
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the fake models below


def long(df, **kwargs):
    matrix = metrics.confusion_matrix(df, CATS)
    return {r.metric: r.value for r in metrics.metrics_long(matrix, **kwargs).collect()}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "A string, A_pred string, B string, B_pred string")


def test_one_class_only_scores_one(spark):
    got = long(labelled(spark, [("ABSENT", "ABSENT", "NEG", "ABSENT")] * 3))
    assert got["A_macro_f1"] == 1.0 and got["A_neg_recall"] == 0.0 and got["A_absent_recall"] == 1.0
    assert got["B_macro_f1"] == 0.0 and got["macro_f1_mean"] == 0.5 and got["exact_match_ratio"] == 0.0


def test_hand_computed_scores(spark):
    pairs = [("NEG", "NEG")] * 3 + [("NEG", "ABSENT")] + [("ABSENT", "NEG")] * 2 + [("ABSENT", "ABSENT")] * 4
    got = long(labelled(spark, [(t, p, t, t) for t, p in pairs]))
    assert got["A_macro_f1"] == pytest.approx((6 / 9 + 8 / 11) / 2)
    assert got["A_neg_recall"] == pytest.approx(3 / 4) and got["A_absent_recall"] == pytest.approx(4 / 6)
    assert got["exact_match_ratio"] == pytest.approx(0.7)
    counts = metrics.confusion_counts(metrics.confusion_matrix(labelled(spark, [(t, p, t, t) for t, p in pairs]), CATS))
    assert {r.category: (r.tp, r.fp, r.fn, r.tn) for r in counts.collect()}["A"] == (3, 2, 1, 4)


def test_error_labels_are_a_class_of_their_own(spark):
    got = long(labelled(spark, [("NEG", "ERROR", "NEG", None), ("ABSENT", "ABSENT", "NEG", "NEG")]))
    assert got["A_macro_f1"] == pytest.approx((0 + 1 + 0) / 3)
    assert got["B_macro_f1"] == pytest.approx((2 / 3 + 0) / 2)


def test_threshold_is_inclusive_and_unrounded(spark):
    df = spark.createDataFrame([(0.5,), (0.49999,), (0.0,)], "p double")
    got = [tuple(r) for r in df.select(lb.threshold_label("p"), lb.round_probability("p")).collect()]
    assert got == [("NEG", 0.5), ("ABSENT", 0.5), ("ABSENT", 0.0)]
    assert [r[0] for r in df.select(lb.threshold_label("p", 0)).collect()] == ["NEG"] * 3


def test_score_kinds(spark):
    probs = spark.createDataFrame([(0.2,), (0.9,)], "A_logit double")
    logits = spark.createDataFrame([(0.2,), (1.9,)], "A_logit double")
    assert metrics.detect_score_kind(probs, ["A_logit"]) == "prob"
    assert metrics.detect_score_kind(logits, ["A_logit"]) == "logit"
    assert metrics.detect_score_kind(spark.range(2), ["id"]) == "label"
    assert [r.A_pred for r in metrics.with_predictions(probs, ["A"], "auto").collect()] == ["ABSENT", "NEG"]
    assert [r.A_pred for r in metrics.with_predictions(logits, ["A"], "auto").collect()] == ["NEG", "NEG"]


def test_loss_is_stable(spark):
    df = spark.createDataFrame([(800.0, 0, -800.0, 1), (0.0, 1, 2.0, 1)], "A_logit double, A int, B_logit double, B int")
    want = (800 + 800 + math.log(2) + math.log1p(math.exp(-2))) / 4
    assert metrics.batch_loss(df, CATS).first().loss == pytest.approx(want)


def test_best_epoch(spark):
    rows = [("r", 1, 0.7), ("r", 3, 0.7), ("r", 2, 0.5), ("r", 4, float("nan")), ("s", 0, None), ("s", 1, 0.1)]
    log = spark.createDataFrame(rows, "run string, epoch int, val_f1 double")
    best = {r.run: r.epoch for r in metrics.best_epoch(log, "f1").collect()}
    lowest = {r.run: r.epoch for r in metrics.best_epoch(log, "val_f1", greater_is_better=False).collect()}
    assert best == {"r": 1, "s": 1} and lowest == {"r": 2, "s": 1}
    with pytest.raises(KeyError):
        metrics.best_epoch(log, "accuracy")


def test_encode_labels(spark):
    df = spark.createDataFrame([(1, "NEG", "ABSENT"), (2, "ERROR", "NEG"), (3, None, "x"), (4, "1", "0")], "id int, A string, B string")
    good, bad = validation.encode_labels(df, CATS)
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, 1, 0), (4, 1, 0)]
    assert {r.id: r.failed_checks for r in bad.collect()} == {2: ["A"], 3: ["A", "B"]}
    with pytest.raises(PySparkException):
        validation.encode_labels(df, CATS, "fail").collect()
    decoded = validation.decode_labels(spark.createDataFrame([(0, 1, 7)], "a int, b int, c int"), ["a", "b", "c"])
    assert tuple(decoded.first()) == ("ABSENT", "NEG", "7")


def test_request_checks(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "", 0.5), (3, "a", 1.5), (4, None, None), (5, " ", None)], "id int, content string, threshold double")
    good, bad = validation.validate_requests(df)
    assert sorted(r.id for r in good.collect()) == [1, 5]
    assert {r.id: r.failed_checks for r in bad.collect()} == {2: ["content"], 3: ["threshold"], 4: ["content"]}
    _, outside = validation.validate_probabilities(df, ["threshold"])
    assert sorted(r.id for r in outside.collect()) == [3, 4, 5]


def load_sizes():
    """Model that shows the size of the batch it was called with."""
    return lambda texts: [[float(len(texts)), float(len(t)) - 2] for t in texts]


def test_scoring_batches_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "abc") for i in range(70)], "review_id bigint, content string").coalesce(1)
    scored = scoring.score_reviews(df, load_sizes, CATS).orderBy("review_id").collect()
    assert [r.A_logit for r in scored] == [32.0] * 64 + [6.0] * 6
    assert scored[3].B_logit == -2.0 and scored[3].content is None
    result = scoring.triage_reviews(df, load_sizes, CATS).where("review_id = 3").first()
    assert result.content == "" and result.active_complaints == ["A"]
    assert list(result.categories) == CATS and result.categories["B"].label == "ABSENT"
    assert scoring.triage_reviews(df.limit(0), load_sizes, CATS).count() == 0


def load_limited():
    def classify(text):
        raise scoring.RateLimited()

    return classify


def test_rate_limit_waits_then_fails(spark):
    waits = []
    with pytest.raises(scoring.RateLimited):
        scoring._call(load_limited(), "x", 8, waits.append)
    assert waits == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 60.0]
    df = spark.createDataFrame([("x",)], "content string")
    with pytest.raises(PySparkException):
        scoring.classify_external(df, load_limited, CATS, wait=lambda s: None).collect()


def test_evaluate_and_report(spark):
    df = spark.createDataFrame([("abc", 1, 1), ("a", 1, 0), ("abcd", 0, 1)], "content string, A bigint, B bigint").coalesce(1)
    report, output = evaluate(df, load_sizes, CATS)
    values = {r.metric: r.value for r in report.collect()}
    assert values["B_macro_f1"] == 1.0 and values["exact_match_ratio"] == pytest.approx(2 / 3)
    assert output.columns == ["content", "A", "A_pred", "A_prob", "B", "B_pred", "B_prob"]
    named = output.select("A", "A_pred", "B", "B_pred")
    text = metrics.report_text(metrics.confusion_matrix(named, CATS), CATS).first().report
    assert "B Macro F1-score: 1.0000" in text and text.splitlines()[1] == "PRIMARY METRIC"


def test_fixed_length_rows(spark):
    df = spark.createDataFrame([(1, "aa bb aa cc", 1, 0), (2, None, 0, 1), (3, "aa " * 9, 1, 1)], "review_id bigint, content string, A int, B int")
    vocab = features.build_vocabulary(df, size=2)
    assert {r.token: r.token_id for r in vocab.collect()} == {"aa": 2, "bb": 3}
    rows = {r.review_id: r for r in features.fixed_length_rows(df, vocab, CATS, 6).collect()}
    assert rows[1].input_ids == [2, 3, 2, 1, 0, 0] and rows[1].attention_mask == [1, 1, 1, 1, 0, 0]
    assert rows[2].input_ids == [0] * 6 and rows[2].labels == [0.0, 1.0]
    assert rows[3].input_ids == [2] * 6 and rows[3].attention_mask == [1] * 6


def test_mismatches_compare_nulls(spark):
    gold = spark.createDataFrame([(1, "NEG", "NEG"), (2, "NEG", "NEG"), (3, "NEG", "NEG")], "review_id bigint, A string, B string")
    pred = spark.createDataFrame([(1, "NEG", "NEG"), (2, "NEG", None)], "review_id bigint, A_pred string, B_pred string")
    assert [r.review_id for r in metrics.mismatches(gold, pred, CATS).collect()] == [2]
    assert metrics.pair(gold, pred, CATS).count() == 2
    assert gold.select(F.count("*")).first()[0] == 3


def test_vocabulary_look_up_has_no_keyless_join(spark):
    df = spark.createDataFrame([(1, "aa bb", 1, 0)], "review_id bigint, content string, A int, B int")
    plan = features.fixed_length_rows(df, features.build_vocabulary(df, size=2), CATS, 6)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("by", ["weight", "neg_mean_weight", "pos_mean_weight"])
@pytest.mark.parametrize("size", [12, 1500])
def test_bounded_top_terms_equal_all_weights_and_weigh_few(spark, monkeypatch, by, size):
    """With few documents all terms are weighed; with many, only the frequent ones."""
    rng = random.Random(4)
    frequent = ["app crashed again", "driver came late", "wrong map shown", "refund never arrived"]
    rows = []
    for i in range(size):
        own = [f"word{rng.randrange(10**5)}" for _ in range(rng.randrange(9))]
        rows.append((i, rng.randrange(1, 6), " ".join([*own, rng.choice(frequent), rng.choice(frequent)])))
    df = spark.createDataFrame(rows, "review_id bigint, score int, content string").repartition(4)
    seen = []
    weigh = terms._mean_weights
    monkeypatch.setattr(terms, "_mean_weights", lambda r, s: seen.append(r.select("term").distinct().count()) or weigh(r, s))
    got = [tuple(r) for r in terms.top_weighted_terms(df, by, 10).collect()]
    few, seen[:] = list(seen), []
    assert got == [tuple(r) for r in terms.top_terms(terms.term_weights(df), by, 10).collect()]
    if size > 1000:
        assert max(few) < seen[0] / 20
    else:
        assert few[-1] == seen[0]


def test_bounded_top_terms_of_odd_tables(spark):
    none = spark.createDataFrame([], "review_id bigint, score int, content string")
    assert terms.top_weighted_terms(none).count() == 0
    one_side = spark.createDataFrame([(1, 5, "aa bb cc"), (2, 5, None)], "review_id bigint, score int, content string")
    assert [r.neg_mean_weight for r in terms.top_weighted_terms(one_side, "neg_mean_weight").collect()] == [None] * 3
