"""A labelling service that is asked once per text, over failed tasks, broken-off runs and copies."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reviewmill.operators.scoring import RateLimited
from reviewmill.plans import labelling
from reviewmill.sources import answers

CATS = ["A", "B"]
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Lost(BaseException):
    """A task that ends in the middle of its work."""


def service(asked, fails_at=None, error=None):
    def classify(text):
        if len(asked) == fails_at:
            raise error
        asked.append(text)
        if text == "bad":
            raise ValueError("no answer")
        return {"A": "NEG" if len(text) % 2 else "ABSENT", "B": "ABSENT"}

    return classify


TEXTS = {f"d{i}": "bad" if i == 4 else "t" * i for i in range(10)}


@pytest.mark.parametrize("every", [1, 3, 100])
@pytest.mark.parametrize("fails_at", range(10))
def test_a_task_that_fails_once_asks_no_text_twice(tmp_path, every, fails_at):
    folder, asked = str(tmp_path / "chunk=0"), []
    with pytest.raises(Lost):
        labelling.ask_chunk(TEXTS, folder, service(asked, fails_at, Lost()), CATS, every)
    assert len(answers.committed(folder)) == fails_at
    again = labelling.ask_chunk(TEXTS, folder, service(asked), CATS, every)
    assert again == (10 - fails_at, 0)
    assert sorted(asked) == sorted(TEXTS.values())
    have = answers.committed(folder)
    assert have["d4"] == ["ERROR", "ERROR"] and have["d3"] == ["NEG", "ABSENT"] and len(have) == 10


def test_a_rate_limited_chunk_keeps_its_answers(tmp_path):
    folder, asked, waits = str(tmp_path / "chunk=0"), [], []
    got = labelling.ask_chunk(TEXTS, folder, service(asked, 6, RateLimited()), CATS, 4, attempts=3, wait=waits.append)
    assert got == (6, 4) and len(waits) == 2
    assert len(answers.committed(folder)) == 6


def test_half_a_file_is_not_read(tmp_path):
    folder = tmp_path / "chunk=0"
    answers.commit(str(folder), {"d0": ["NEG", "NEG"]}, CATS)
    (folder / ".half").write_bytes(b"PAR1")
    assert answers.committed(str(folder)) == {"d0": ["NEG", "NEG"]}
    assert answers.committed(str(tmp_path / "none")) == {}


class Logged:
    """Service whose log is a folder; texts with the sign ``!`` find it down while ``down``."""

    def __init__(self, log, down):
        self.log, self.down = log, down

    def __call__(self):
        import uuid

        def classify(text):
            if self.down and "!" in text:
                raise RateLimited()
            with open(f"{self.log}/{uuid.uuid4().hex}", "w") as file:
                file.write(text)
            return {"A": "NEG" if text else "ABSENT"}

        return classify


def run(df, log, down, store):
    return labelling.label_once(
        df, Logged(str(log), down), store, CATS, chunk_size=3, commit_every=2, attempts=1, wait=lambda s: None
    )


def test_runs_share_answers_and_copies_share_calls(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [(i, "copied") for i in range(40)] + [(100 + i, f"text {i}{'!' * (i % 3 == 0)}") for i in range(20)]
    rows += [(200, ""), (201, None), (None, "copied")]
    df = spark.createDataFrame(rows, "review_id long, content string").withColumn("chunk", F.lit("own"))
    store = str(tmp_path / "store")
    first = run(df, log, True, store)
    assert first.columns == ["review_id", "content", "chunk", "A_pred", "B_pred"]
    pending = first.where("A_pred IS NULL").select("content").collect()
    assert {r.content for r in pending} >= {f"text {i}!" for i in range(0, 20, 3)}
    done = run(df, log, False, store).collect()
    assert len(done) == len(rows)
    assert all(r.A_pred == ("NEG" if r.content else "ABSENT") and r.B_pred == "ERROR" for r in done)
    calls = [p.read_text() for p in log.iterdir()]
    assert sorted(calls) == sorted({t or "" for _, t in rows})
    assert run(df, log, True, store).where("A_pred IS NULL").count() == 0
    assert len(list(log.iterdir())) == len(calls)
    assert not list((tmp_path / "store" / "open").glob("run=*"))


def test_a_run_that_was_lost_is_gone_on_with(spark, tmp_path):
    """Its small files are still there; the text that two attempts answered has one answer."""
    import hashlib

    store, log = str(tmp_path / "store"), tmp_path / "log"
    log.mkdir()
    digest = hashlib.sha256(b"one").hexdigest()
    answers.commit(f"{store}/open/run=x/chunk=0", {digest: ["NEG", "NEG"]}, CATS)
    answers.commit(f"{store}/open/run=y/chunk=7", {digest: ["ABSENT", "NEG"]}, CATS)
    df = spark.createDataFrame([(1, "one"), (2, "two")], "review_id long, content string")
    got = {r.review_id: (r.A_pred, r.B_pred) for r in run(df, log, False, store).collect()}
    assert got == {1: ("ABSENT", "NEG"), 2: ("NEG", "ERROR")}
    assert [p.read_text() for p in log.iterdir()] == ["two"]


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "review_id long, content string")
    assert run(df, tmp_path, False, str(tmp_path / "store")).collect() == []


def test_rows_without_an_id_and_repeated_rows_are_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [(None, "one"), (None, "one"), (1, "two"), (1, "two")] * 5
    df = spark.createDataFrame(rows, "review_id long, content string").repartition(4)
    got = [(r.content, r.A_pred) for r in run(df, log, False, str(tmp_path / "store")).collect()]
    assert sorted(got) == [("one", "NEG")] * 10 + [("two", "NEG")] * 10
    assert sorted(p.read_text() for p in log.iterdir()) == ["one", "two"]


def test_texts_stay_out_of_the_joins_for_labels_where_digests_are_known(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "rows")
    log.mkdir()
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)] + [(20, None)], "review_id long, content string")
    df.withColumn("known", F.sha2(F.coalesce("content", F.lit("")), 256)).write.parquet(path)
    rows, store = spark.read.parquet(path), str(tmp_path / "store")
    args = (Logged(str(log), False), store, CATS, 3)
    done = labelling.label_once(rows, *args, digest="known")
    again = labelling.label_once(done.drop("A_pred", "B_pred"), *args, digest="known").select("review_id", "A_pred")
    assert "content" not in again._jdf.queryExecution().executedPlan().toString()
    assert {r.review_id: r.A_pred for r in again.collect()} == {i: "NEG" if i < 20 else "ABSENT" for i in range(21)}
    assert len(list(log.iterdir())) == 8


def test_chunks_hold_each_text_once():
    import pandas as pd

    rows = ["a", "a", "b", "c", "c", "c", "d", "e"]
    for cut in range(len(rows) + 1):
        parts = [pd.DataFrame({"text_digest": p, "text": p}) for p in (rows[:cut], rows[cut:])]
        assert [sorted(c) for c in labelling._chunks(iter(parts), 2)] == [["a", "b"], ["c", "d"], ["e"]]
