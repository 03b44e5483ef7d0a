import datetime as dt
import sys

import pytest
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from reviewmill import schemas
from reviewmill.operators import features
from reviewmill.plans import curation, evaluation
from reviewmill.session import shared_dir, spread
from reviewmill.sources import models, tables

CATS = ["A", "B"]
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the fake model below
AT = dt.datetime(2026, 8, 29, 11, 18, 30)
REVIEWS = [
    (1, "u", 5, AT, 'line one\nline "two", more'),
    (2, None, None, None, None),
    (3, "v", 1, AT, "back\\slash, comma"),
    (4, "w", 2, AT, ""),
]


def reviews(spark):
    return spark.createDataFrame(REVIEWS, schemas.REVIEWS)


def test_csv_round_trip(spark, tmp_path):
    tables.write_csv(reviews(spark), str(tmp_path / "with"), id_col="review_id")
    back = tables.read_reviews(spark, str(tmp_path / "with"), "csv").orderBy("review_id")
    assert [tuple(r) for r in back.collect()] == REVIEWS
    tables.write_csv(reviews(spark).drop("review_id"), str(tmp_path / "without"))
    header = next((tmp_path / "without").glob("part*")).read_text().splitlines()[0]
    assert header == "user_name,score,reviewed_at,content"
    tables.write_csv(reviews(spark).withColumn("row_id", F.lit(1)), str(tmp_path / "more"), id_col="row_id")
    header = next((tmp_path / "more").glob("part*")).read_text().splitlines()[0]
    assert header == "row_id,review_id,user_name,score,reviewed_at,content"


def test_swapped_csv_columns_are_an_error(spark, tmp_path):
    swapped = reviews(spark).select("review_id", "content", "score", "reviewed_at", "user_name")
    tables.write_csv(swapped, str(tmp_path / "swapped"))
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_reviews(spark, str(tmp_path / "swapped"), "csv").collect()


@pytest.mark.parametrize("index", [False, True])
def test_landing_gives_ids_once(spark, tmp_path, index):
    raw = reviews(spark).drop("review_id").withColumnsRenamed({v: k for k, v in schemas.RAW_NAMES.items()})
    if index:
        raw = raw.select(F.lit(5).alias("_c0"), "*")
    raw.repartition(3).write.options(header=True, quote='"', escape='"', emptyValue='""',
                                     timestampFormat="yyyy-MM-dd HH:mm:ss").csv(str(tmp_path / "raw"))
    for part in (tmp_path / "raw").glob("part*"):  # an index column has no name in such files
        part.write_text(part.read_text().replace("_c0,", ",", 1))
    for check in (tmp_path / "raw").glob(".*.crc"):
        check.unlink()
    landed = tables.land_reviews(spark, str(tmp_path / "raw"), str(tmp_path / "landed"), index=index)
    rows = landed.collect()
    assert landed.columns == schemas.REVIEWS.names
    assert sorted(str(tuple(r)[1:]) for r in rows) == sorted(str(tuple(r)[1:]) for r in REVIEWS)
    assert len({r.review_id for r in rows}) == len(rows)
    assert sorted(r.review_id for r in landed.collect()) == sorted(r.review_id for r in rows)


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_review_formats(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    reviews(spark).withColumn("extra", F.lit(1)).write.format(fmt).save(path)
    back = tables.read_reviews(spark, path, fmt)
    assert back.schema.names == schemas.REVIEWS.names
    assert [tuple(r) for r in back.orderBy("review_id").collect()] == REVIEWS
    with pytest.raises(ValueError):
        tables.read_reviews(spark, path, "xml")


def test_split_files_and_pruning(spark, tmp_path):
    rows = [("a", 0, 1, "train"), ("b", 1, 0, "valid"), ("c", 1, 1, "test")]
    df = spark.createDataFrame(rows, schemas.split(CATS))
    tables.write_splits(df, str(tmp_path / "s"))
    test = tables.read_split(spark, str(tmp_path / "s"), "test", CATS)
    assert [tuple(r) for r in test.collect()] == [("c", 1, 1)]
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        tables.read_split(spark, str(tmp_path / "s"), "dev", CATS)


def test_prompt_is_one_string(spark, tmp_path):
    (tmp_path / "p.md").write_text("line 1\n\nline 2\n")
    assert tables.read_prompt(spark, str(tmp_path / "p.md")) == "line 1\n\nline 2\n"


def test_predictions_path():
    one = tables.predictions_path("/out/", "interim/reviews.csv", "ver 2", "model-x")
    two = tables.predictions_path("/out", "processed/reviews.csv", "ver 2", "model-x")
    assert one == "/out/input=interim-reviews.csv/prompt=ver-2/model=model-x" and one != two


def test_annotation_template(spark, tmp_path):
    path = str(tmp_path / "template")
    tables.export_template(reviews(spark), path, CATS)
    tables.export_template(reviews(spark).limit(0), path, CATS)
    good, todo = tables.import_template(spark, path, CATS)
    assert good.count() == 0 and todo.count() == 4
    tables.export_template(reviews(spark).limit(0), path, CATS, force=True)
    assert tables.import_template(spark, path, CATS)[1].count() == 0
    filled = reviews(spark).withColumns({"A": F.lit("NEG"), "B": F.when(F.col("review_id") < 3, F.lit("ABSENT"))})
    tables.write_csv(filled, str(tmp_path / "filled"), id_col="review_id")
    good, todo = tables.import_template(spark, str(tmp_path / "filled"), CATS)
    assert sorted(r.review_id for r in good.collect()) == [1, 2]
    assert {r.review_id: r.failed_checks for r in todo.collect()} == {3: ["B"], 4: ["B"]}


def test_model_keeps_best_and_latest(spark, tmp_path):
    rows = [(i, "good ride" if i % 2 else "slow driver", i % 2, 1 - i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "review_id bigint, content string, A int, B int")
    model = features.fit_baseline(df, CATS, features=64, max_iter=3)
    root = str(tmp_path / "run")
    saved = [models.save_model(spark, model, root, e, {"val_f1": v}, "f1")
             for e, v in enumerate([0.5, 0.5, float("nan"), 0.9, 0.7])]
    assert saved == [True, False, False, True, False]
    loaded, best = models.load_model(spark, root, "f1")
    assert best["epoch"] == 3 and models.load_model(spark, root, "f1", "latest")[1]["epoch"] == 4
    logits = features.baseline_logits(loaded, df, CATS).select("A", (F.col("A_logit") > 0).cast("int").alias("p"))
    assert all(r.A == r.p for r in logits.collect())
    with pytest.raises(KeyError):
        models.save_model(spark, model, root, 9, {"val_loss": 1.0}, "f1")
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "none"), "f1")


def test_a_save_that_breaks_off_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "run")

    def rule(n):
        return PipelineModel([SQLTransformer(statement=f"SELECT {n} AS n FROM __THIS__")])

    class Broken:
        def write(self):
            raise OSError("disk")

    def loaded(which):
        model, row = models.load_model(spark, root, "f1", which)
        return model.transform(spark.range(1)).first()["n"], row["epoch"]

    assert models.save_model(spark, rule(1), root, 0, {"f1": 0.5}, "f1")
    with pytest.raises(OSError, match="disk"):
        models.save_model(spark, Broken(), root, 1, {"f1": 0.9}, "f1")
    rule(7).write().save(f"{root}/models/000000002")  # written, but no pointer
    assert loaded("best") == loaded("latest") == (1, 0)
    assert models.save_model(spark, rule(3), root, 1, {"f1": 0.6}, "f1")
    assert not models.save_model(spark, rule(4), root, 2, {"f1": 0.6}, "f1")
    assert loaded("best") == (3, 1) and loaded("latest") == (4, 2)


def test_predictions_table(spark, tmp_path):
    root = str(tmp_path / "predictions")
    one = spark.createDataFrame([(1, "NEG", "ABSENT")], "review_id long, A_pred string, B_pred string")
    runs = [("a/b", "p", "m"), ("a-b", "p", "m"), ("a b%é=:", "p", "m"), ("a/b", "p", "0042")]
    for run in runs:
        tables.write_predictions(one, root, *run, CATS)
    rows = tables.read_predictions(spark, root, CATS)
    assert sorted((r.input, r.prompt, r.model) for r in rows.collect()) == sorted(runs)
    tables.write_predictions(one.limit(0), root, *runs[0], CATS)
    assert tables.read_predictions(spark, root, CATS, "a/b").select("model").collect() == [("0042",)]
    pruned = tables.read_predictions(spark, root, CATS, "a-b", "p", "m")
    assert pruned.count() == 1
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(c in filters for c in ("input", "prompt", "model"))
    with pytest.raises(ValueError, match="name"):
        tables.write_predictions(one, root, "", "p", "m", CATS)


def test_build_splits(spark):
    rows = [(i, f"t{i}", "NEG" if i % 4 == 0 else "ABSENT", "ERROR" if i == 7 else "ABSENT") for i in range(40)]
    pool = spark.createDataFrame(rows, "review_id bigint, content string, A_pred string, B_pred string")
    golden = spark.createDataFrame([(100, "g", "NEG", "NEG")], "review_id bigint, content string, A string, B string")
    split, bad = curation.build_splits(pool, golden, CATS)
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 31, "valid": 8, "test": 1}
    assert [(r.review_id, r.failed_checks) for r in bad.collect()] == [(7, ["B"])]
    assert curation.labelled_rows(split, CATS).columns == ["content", "A", "B"]


def test_raw_files_to_templates_and_prompt(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, "u", i % 5 + 1, AT, " ".join(words[(i * k) % 10] + str(i * k) for k in range(1, 9))) for i in range(200)]
    raw = spark.createDataFrame([*rows, (900, "u", 1, AT, "too short")], schemas.REVIEWS)
    names = {v: k for k, v in schemas.RAW_NAMES.items()}
    tables.write_csv(raw.drop("review_id").withColumnsRenamed(names), str(tmp_path / "raw"))
    clean = curation.write_clean(spark, str(tmp_path / "raw"), str(tmp_path / "clean"))
    assert clean.count() == 200
    root = str(tmp_path / "annotation")
    curation.prepare_annotation(clean, root, CATS, golden=20, few_shot=5)
    curation.prepare_annotation(clean.limit(0), root, CATS)
    parts = [tables.import_template(spark, f"{root}/{n}", CATS)[1].count() for n in ("golden", "few_shot")]
    assert parts == [20, 5] and spark.read.parquet(f"{root}/pool").count() == 175
    filled = tables.import_template(spark, f"{root}/few_shot", CATS)[1].drop("failed_checks")
    filled = filled.withColumns({"A": F.lit("NEG"), "B": F.lit("ABSENT")})
    tables.write_csv(filled, str(tmp_path / "filled"), id_col="review_id")
    todo = curation.write_few_shot(spark, str(tmp_path / "filled"), str(tmp_path / "md"), CATS)
    text = tables.read_prompt(spark, str(tmp_path / "md"))
    assert todo.count() == 0 and text.count("### Example ") == 5
    assert text.startswith("## 4. Few-Shot Demonstrations\n\n### Example 1\n**Review:**\n")


def load_constant():
    return lambda texts: [[1.0, -1.0] for _ in texts]


def test_evaluate_a_split_from_files(spark, tmp_path):
    rows = [("a", 1, 0, "test"), ("b", 0, 0, "test"), ("c", 1, 1, "train")]
    tables.write_splits(spark.createDataFrame(rows, schemas.split(CATS)), str(tmp_path / "s"))
    out = str(tmp_path / "out")
    report = evaluation.evaluate_split(spark, str(tmp_path / "s"), "test", load_constant, out, CATS)
    values = {r.metric: r.value for r in report.collect()}
    assert values["exact_match_ratio"] == 0.5 and values["B_macro_f1"] == 1.0
    saved = spark.read.csv(out, header=True).orderBy("content").collect()
    assert [tuple(r) for r in saved] == [
        ("a", "NEG", "NEG", "0.7311", "ABSENT", "ABSENT", "0.2689"),
        ("b", "ABSENT", "NEG", "0.7311", "ABSENT", "ABSENT", "0.2689")]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(100, numPartitions=16).withColumnRenamed("id", "review_id")
    assert spread(wide) is wide
    assert spread(wide.coalesce(1)).rdd.getNumPartitions() == 8


def raw(spark, rows, path):
    df = spark.createDataFrame(rows, schemas.REVIEWS).drop("review_id")
    tables.write_csv(df.withColumnsRenamed({v: k for k, v in schemas.RAW_NAMES.items()}).repartition(3), str(path))
    return str(path)


def test_repeated_landings_go_on_with_ids_and_repeat_no_review(spark, tmp_path):
    target = str(tmp_path / "landed")
    assert tables.read_landings(spark, target).collect() == []
    first = raw(spark, [*REVIEWS, REVIEWS[0]], tmp_path / "one")
    again = {r.review_id: r for r in tables.land_more(spark, first, target).collect()}
    assert sorted(again) == [0, 1, 2, 3] and {r.landing for r in again.values()} == {1}
    # Nothing new: no landing, and no version.
    assert tables.land_more(spark, first, target).count() == 4
    assert tables.read_landings(spark, target).agg(F.max("landing")).first()[0] == 1
    # One field more or less is another review, null is not empty text, and microseconds count.
    later = AT.replace(microsecond=500)
    more = [(0, None, None, None, ""), (0, "u", 4, AT, REVIEWS[0][4]), (0, "u", 5, later, "x"), (0, "u", 5, AT, "x"), *REVIEWS]
    path = str(tmp_path / "two")
    spark.createDataFrame(more, schemas.REVIEWS).drop("review_id").withColumnsRenamed(
        {v: k for k, v in schemas.RAW_NAMES.items()}).write.parquet(path)
    got = {r.review_id: r for r in tables.land_more(spark, path, target, "parquet").collect()}
    assert sorted(got) == list(range(8)) and [got[i].landing for i in range(8)] == [1] * 4 + [2] * 4
    assert {i: got[i] for i in range(4)} == again


def test_a_landing_that_broke_off_is_not_read_and_is_replaced(spark, tmp_path):
    target = str(tmp_path / "landed")
    tables.land_more(spark, raw(spark, REVIEWS[:2], tmp_path / "one"), target)
    half = spark.createDataFrame([(2, "v", 5, AT, "half", "d")], schemas.LANDED.fieldNames()[:-1])
    half.write.parquet(f"{target}/landing=2")
    assert tables.read_landings(spark, target).count() == 2
    got = tables.land_more(spark, raw(spark, REVIEWS[1:], tmp_path / "two"), target).collect()
    assert sorted(r.review_id for r in got) == [0, 1, 2, 3] and "half" not in {r.content for r in got}
    assert {r.landing for r in got} == {1, 2}
