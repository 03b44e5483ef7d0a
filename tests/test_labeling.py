import json

import pytest
from pyspark.sql import functions as F

from reviewmill.constants import CATEGORIES
from reviewmill.operators import labeling as lab
from reviewmill.plans import labelling as plan
from reviewmill.sources import tables


def response(row, content, status=200):
    body = {"choices": [{"message": {"content": content}}]}
    return json.dumps({"custom_id": f"row_{row}", "response": {"status_code": status, "body": body}})


def test_parse_responses(spark):
    full = {c: "NEG" for c in CATEGORIES}
    legacy = {"DRIVER_OPERATIONS": "NEG", "APP_AND_MAPS": "ABSENT", "PRICING_AND_BILLING": "NEG"}
    both = {**full, "DRIVER_OPS": "ABSENT", "DRIVER_OPERATIONS": "NEG"}
    lines = [
        response(1, json.dumps(full)), "", "   ", response(2, json.dumps(legacy)),
        response(3, json.dumps(both)), response(4, json.dumps({"APP_AND_MAPS": "NEG"})),
        response(5, "not json"), response(6, json.dumps(full), 500), response(7, '["list"]'),
        json.dumps({"custom_id": "row_8", "response": None}),
        json.dumps({"custom_id": "row_9", "response": {"status_code": 200, "body": {"choices": []}}}),
        response("x", json.dumps(full)),
    ]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r[0]: tuple(r[1:]) for r in lab.parse_responses(df).collect()}
    error = ("ERROR",) * 3
    assert got == {
        1: ("NEG",) * 3, 2: ("NEG", "ABSENT", "NEG"), 3: ("ABSENT", "NEG", "NEG"),
        4: ("ERROR", "NEG", "ERROR"), 5: error, 6: error, 7: error, 8: error, 9: error,
        None: ("NEG",) * 3,
    }


def test_request_line(spark):
    df = spark.createDataFrame([(7, 'say "hi"\n'), (8, None)], "review_id bigint, content string")
    one, two = [json.loads(r.line) for r in lab.label_requests(df, "Prompt\n\"x\"", "m").orderBy("review_id").collect()]
    assert one == {
        "custom_id": "row_7", "method": "POST", "url": "/v1/chat/completions",
        "body": {
            "model": "m", "temperature": 0.0, "max_completion_tokens": 150,
            "messages": [
                {"role": "system", "content": 'Prompt\n"x"'},
                {"role": "user", "content": 'Review: "say "hi"\n"'},
            ],
            "response_format": {
                "type": "json_schema",
                "json_schema": {
                    "name": "defect_schema", "strict": True,
                    "schema": {
                        "type": "object",
                        "properties": {c: {"type": "string", "enum": ["NEG", "ABSENT"]} for c in CATEGORIES},
                        "required": CATEGORIES, "additionalProperties": False,
                    },
                },
            },
        },
    }
    assert two["body"]["messages"][1]["content"] == 'Review: ""'


def test_partly_done_chunk_is_sent_again_whole(spark):
    chunks = spark.createDataFrame([(i, i // 3) for i in range(9)], "review_id bigint, chunk_id bigint")
    done = spark.createDataFrame([(i,) for i in (0, 1, 2, 4, 5)], "review_id bigint")
    pending = lab.pending_chunks(chunks, done)
    assert sorted(r.review_id for r in pending.collect()) == [3, 4, 5, 6, 7, 8]
    progress = {r.chunk_id: (r.total_rows, r.done_rows) for r in lab.chunk_progress(chunks, done).collect()}
    assert progress == {0: (3, 3), 1: (3, 2), 2: (3, 0)}
    assert lab.progress(chunks, done, 4).first().asDict() == {
        "classified_rows": 5, "total_rows": 9, "total_chunks": 3}


def test_run_with_resume(spark, tmp_path):
    reviews = spark.createDataFrame([(10 * i, f"text {i}") for i in range(7)], "review_id bigint, content string")
    state = str(tmp_path / "state")

    def answer(attempt, rows, label):
        folder = tmp_path / f"answers{attempt}"
        folder.mkdir()
        lines = [response(i, json.dumps({c: label for c in CATEGORIES})) for i in rows]
        (folder / "a.jsonl").write_text("\n\n".join(lines) + "\n")
        return plan.collect_responses(spark, reviews, state, str(folder), attempt)

    first = plan.prepare_requests(spark, reviews, state, str(tmp_path / "r1"), "p", "m", chunk_size=3)
    assert first.count() == 7
    assert sorted(p.name for p in (tmp_path / "r1").glob("chunk_group=*")) == ["chunk_group=0"]
    after = answer(1, [0, 10, 20, 30], "ABSENT")
    assert after.where("DRIVER_OPS_pred is null").count() == 3
    second = plan.prepare_requests(spark, reviews, state, str(tmp_path / "r2"), "p", "m", chunk_size=3)
    assert sorted(r.review_id for r in second.collect()) == [30, 40, 50, 60]
    after = answer(2, [30, 40, 50, 60], "NEG")
    got = {r.review_id: r.APP_AND_MAPS_pred for r in after.collect()}
    assert got == {0: "ABSENT", 10: "ABSENT", 20: "ABSENT", 30: "NEG", 40: "NEG", 50: "NEG", 60: "NEG"}


def _answers(spark, *rows):
    cats = [f"{c}_pred" for c in CATEGORIES]
    return spark.createDataFrame([(i, *[label] * len(cats)) for i, label in rows], f"review_id long, {', '.join(c + ' string' for c in cats)}")


def test_a_damaged_checkpoint_is_an_error(spark, tmp_path):
    state = str(tmp_path / "state")
    assert tables.read_checkpoint(spark, state).count() == 0
    tables.append_checkpoint(_answers(spark, (1, "ERROR")), state, 1)
    tables.append_checkpoint(_answers(spark, (1, "NEG")), state, 2)
    for f in (tmp_path / "state" / "attempt=2").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception, match="attempt=2"):
        lab.latest_predictions(tables.read_checkpoint(spark, state)).collect()


def test_repeated_attempts_and_ties(spark, tmp_path):
    state = str(tmp_path / "state")
    tables.append_checkpoint(_answers(spark, (1, "ERROR"), (2, "NEG")), state, 1)
    for _ in range(2):
        tables.append_checkpoint(_answers(spark, (1, "ERROR"), (1, "NEG"), (None, "NEG")), state, 2)
    assert tables.read_checkpoint(spark, state).count() == 4
    got = {r.review_id: (r.attempt, r.DRIVER_OPS_pred) for r in lab.latest_predictions(tables.read_checkpoint(spark, state)).collect()}
    assert got == {1: (2, "NEG"), 2: (1, "NEG")}
    assert tables.read_unidentified(spark, state, 2).count() == 1
    assert tables.read_unidentified(spark, state, 1).count() == 0


def _latest(spark, state):
    rows = lab.latest_predictions(tables.read_checkpoint(spark, state)).collect()
    return {r.review_id: (r.attempt, r.DRIVER_OPS_pred) for r in rows}


def test_compaction(spark, tmp_path):
    state = str(tmp_path / "state")
    tables.append_checkpoint(_answers(spark, (1, "ERROR"), (2, "NEG"), (25, "NEG"), (-3, "NEG")), state, 1)
    assert tables.compact_checkpoint(spark, state, ids_per_range=10) == 1
    tables.append_checkpoint(_answers(spark, (1, "NEG"), (1, "ERROR"), (4, "ABSENT")), state, 2)
    want = {1: (2, "NEG"), 2: (1, "NEG"), 4: (2, "ABSENT"), 25: (1, "NEG"), -3: (1, "NEG")}
    assert _latest(spark, state) == want
    # A merge that broke off has files, broken ones even, but no manifest.
    half = tmp_path / "state" / "_snapshot" / "version=2" / "id_range=0"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"broken")
    assert _latest(spark, state) == want
    assert tables.compact_checkpoint(spark, state) == 2 == tables.compact_checkpoint(spark, state)
    assert _latest(spark, state) == want and tables.read_checkpoint(spark, state).count() == 5
    # Only the range with new answers was written again.
    assert [p.name for p in (tmp_path / "state" / "_snapshot" / "version=2").glob("id_range=*")] == ["id_range=0"]
    with pytest.raises(ValueError, match="go on with 3"):
        tables.append_checkpoint(_answers(spark, (1, "NEG")), state, 2)
    tables.prune_checkpoint(spark, state)
    assert _latest(spark, state) == want and not list((tmp_path / "state").glob("attempt=*"))
    assert not (tmp_path / "state" / "_snapshot" / "version=1" / "id_range=0").exists()
    tables.append_checkpoint(_answers(spark, (25, "ERROR")), state, 3)
    assert _latest(spark, state) == {**want, 25: (3, "ERROR")}
    for f in half.glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception, match="id_range=0"):
        _latest(spark, state)


def test_few_shot_markdown(spark):
    row = (0, ' he said "no" ', " neg", "ABSENT", "absent ")
    df = spark.createDataFrame([row], ["row_id", "content", *CATEGORIES])
    lines = lab.few_shot_lines(lab.few_shot_blocks(df)).orderBy("position").collect()
    text = "\n".join(r.text for r in lines)
    labels = json.dumps(dict(zip(CATEGORIES, ["NEG", "ABSENT", "ABSENT"])), indent=2)
    assert text == "\n".join([
        "## 4. Few-Shot Demonstrations\n",
        "### Example 1\n" + '**Review:**\n"he said \\"no\\""\n\n**Output:**\n' + f"```json\n{labels}\n```\n"])


def test_promote_and_template_columns(spark):
    df = spark.createDataFrame([(1, "t", "NEG", "ERROR", "ABSENT")], ["review_id", "content", *[f"{c}_pred" for c in CATEGORIES]])
    promoted = lab.promote_pseudo_labels(df)
    assert promoted.columns == ["review_id", "content", *CATEGORIES]
    assert lab.project_labels(promoted).columns == ["content", *CATEGORIES]
    empty = lab.add_label_columns(df.select("review_id"))
    assert empty.first().DRIVER_OPS is None
    assert lab.drop_label_columns(empty).columns == ["review_id"]
    assert [r[0] for r in df.select(lab.encode_request_id()).collect()] == ["row_1"]
    assert df.select(lab.decode_request_id(F.lit("row_x"))).first()[0] is None
