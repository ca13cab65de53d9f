import pytest
from pyspark.sql import functions as F

from studyspark.functions import questions as q

ROWS = [("overview", "What is it?", "A study with Q: and A: in it", "a quote", 4), ("", "Why so?", "Because", "", None)]


def made(spark, rows=ROWS):
    return spark.createDataFrame([("Paper", rows)], f"title string, qs array<{q.QUESTION_TYPE}>")


def test_round_trip(spark):
    md = made(spark).select(q.render_questions("title", "qs", F.lit("a note")).alias("md"))
    assert [tuple(x) for x in md.select(q.parse_questions("md").alias("x")).first().x] == ROWS
    assert md.select(q.parse_title("md").alias("x")).first().x == "Paper"
    assert md.first().md.startswith("# Study Questions: Paper\n\n_a note_\n\n## Q1 (overview)\nWhat is it?\n\n**Answer:** A study")


def test_plain_pairs(spark):
    text = "Q: One?\nA: Yes,\nit is.\nQ: Two?\nA: No."
    got = spark.createDataFrame([(text,)], "t string").select(q.parse_questions("t").alias("x")).first().x
    assert [(x.question, x.answer) for x in got] == [("One?", "Yes,\nit is."), ("Two?", "No.")]


def test_sections_without_answer_are_dropped(spark):
    text = "# T\n\n## Q1\nNo marker here\n\n## Q2 (evidence)\nGood?\n\n**Answer:** yes\n\n**Evidence:** \"e\"\n"
    got = spark.createDataFrame([(text,)], "t string").select(q.parse_questions("t").alias("x")).first().x
    assert [tuple(x) for x in got] == [("evidence", "Good?", "yes", "e", None)]


def test_notes(spark):
    df = made(spark).select(q.render_questions("title", "qs").alias("a"))
    df = df.select("a", q.write_notes("a", F.lit("## Q9 (overview)\nx\n\n**Answer:** y")).alias("b")).select("*", q.write_notes("b", F.lit(" second ")).alias("c")).select("*", q.write_notes("c", F.lit("")).alias("d"))
    r = df.select(q.read_notes("a").alias("na"), q.read_notes("c").alias("nc"), q.read_notes("d").alias("nd"), F.size(q.parse_questions("b")).alias("n"), (F.col("d") == F.concat(F.rtrim(F.regexp_replace("a", r"\s+$", "")), F.lit("\n"))).alias("same")).first()
    assert tuple(r) == ("", "second", "", 2, True)
    kept = df.select(q.read_notes(q.render_keeping_notes(F.lit("T"), F.array().cast(f"array<{q.QUESTION_TYPE}>"), "c")).alias("x")).first().x
    assert kept == "second"


def test_model_replies(spark):
    good = '{"type":" Evidence ","question":" q ","answer":"a","evidence":"e"}'
    rows = [f'{{"questions":[{good}]}}', f'```json\n[{good},{{"type":"odd","question":"x","answer":"y"}},{{"question":"z"}}]\n```', "sorry", '{"questions":[]}', '{"other":1}', None]
    got = [r.x for r in spark.createDataFrame([(x,) for x in rows], "t string").select(q.parse_reply("t").alias("x")).collect()]
    assert [tuple(x) for x in got[0]] == [("evidence", "q", "a", "e")]
    assert [x.type for x in got[1]] == ["evidence", ""]
    assert got[2:] == [None] * 4


def test_replies_with_more_than_objects(spark):
    good = '{"type":"critique","question":"q","answer":"a","evidence":"e"}'
    rows = [f'["x", {good}]', f'{{"questions": [null, 3, {good}, [], "{{}}"]}}', f'[{{"question": 7, "answer": true, "type": null}}, {good}]', f'{{"questions": {good}}}', '"text"', "3", f'[{good}', '[{"question":"q"}]']
    got = [r.x and [tuple(q) for q in r.x] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(q.parse_reply("t").alias("x")).collect()]
    one = ("critique", "q", "a", "e")
    assert got == [[one], [one], [("", "7", "true", ""), one], None, None, None, None, None]


def test_plain_pairs_of_a_reply(spark):
    rows = ["Q: One?\nA: Yes.\nQ: Two?\nA: No.", '[{"question":"q","answer":"Q: x A: y"}]', "nothing", None]
    got = [r.x and [(q.question, q.answer) for q in r.x] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(q.parse_reply_or_pairs("t").alias("x")).collect()]
    assert got == [[("One?", "Yes."), ("Two?", "No.")], [("q", "Q: x A: y")], None, None]


@pytest.mark.parametrize("n, want", [(2, [1, 1, 0, 0]), (4, [1, 1, 1, 1]), (8, [2, 3, 2, 1]), (12, [3, 4, 3, 2]), (20, [4, 7, 5, 4])])
def test_quota(n, want):
    assert list(q.level_quota(n).values()) == want


def test_quota_sums():
    for n in range(1, 51):
        quota = q.level_quota(n)
        assert sum(quota.values()) == n and (n < 4 or min(quota.values()) >= 1)
