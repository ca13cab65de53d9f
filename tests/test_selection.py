import random

from studyspark.functions.questions import LEVELS, level_quota
from studyspark.operators import selection as s
from studyspark.operators import verification as v
from studyspark.functions.text import normalized
from pyspark.sql import functions as F


def test_rank_replies(spark):
    rows = spark.createDataFrame([(d, i) for d in (1, 2, 3) for i in range(3)], "doc_id int, cand_id int")
    replies = spark.createDataFrame([(1, [2, 0, 2, 99]), (2, [])], "doc_id int, ranked_ids array<int>")
    got = {}
    for r in s.rank_candidates(rows, replies).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append(r.cand_id)
    assert got == {1: [2, 0], 2: [0, 1, 2], 3: [0, 1, 2]}


def by_hand(types, n):
    """The picks and the order of one document, step by step."""
    quota, taken, chosen = level_quota(n), dict.fromkeys(LEVELS, 0), []
    for i, t in enumerate(types):
        if t in quota and taken[t] < quota[t]:
            taken[t] += 1
            chosen.append(i)
    chosen += [i for i in range(len(types)) if i not in chosen]
    picked = set(chosen[:n])
    level = {t: k for k, t in enumerate(LEVELS)}
    return sorted(picked, key=lambda i: (level.get(types[i], 4), i)) + [i for i in range(len(types)) if i not in picked]


def test_selection_against_a_plain_loop(spark):
    rng = random.Random(3)
    docs = {d: [rng.choice([*LEVELS, "evidence", ""]) for _ in range(rng.randint(1, 12))] for d in range(60)}
    rows = spark.createDataFrame([(d, i + 1, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id int, rank int, type string")
    for n in (3, 4, 7):
        got = {}
        for r in s.select_by_level(rows, n).orderBy("doc_id", "place").collect():
            got.setdefault(r.doc_id, []).append(r.rank - 1)
        assert got == {d: by_hand(ts, n) for d, ts in docs.items()}


def test_named_cases(spark):
    types = ["evidence"] * 6 + ["overview", "approach", "critique"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(types)], "doc_id int, rank int, type string")
    picked = s.select_by_level(rows, 4).where("picked").orderBy("place").collect()
    assert [r.type for r in picked] == list(LEVELS)
    assert s.select_by_level(rows.where("type = 'evidence'"), 3).where("picked").count() == 3


def test_candidate_plan():
    assert s.candidate_plan(12, 8) == {"target": 18, "per_chunk": 3, "overview": 5}
    assert s.candidate_plan(5, 1) == {"target": 8, "per_chunk": 8, "overview": 2}


TEXT = "Light travels through both slits at once and leaves a pattern of stripes on the far wall."


def verdict(spark, evidence, blind, judged):
    schema = "answer string, evidence string, blind struct<answerable:boolean,answer:string,quote:string>, judged struct<premise_ok:boolean,a_supported:boolean,verdict:string,reason:string>"
    df = spark.createDataFrame([("own", evidence, blind, judged)], schema).withColumn("norm_text", normalized(F.lit(TEXT)))
    return v.judge(df).first()


GOOD, REAL = (True, True, "agree", "same"), "travels through both slits at once"


def test_verdicts(spark):
    r = verdict(spark, REAL, (True, "blind", ""), GOOD)
    assert r.passed and r.answer == "own" and r.evidence == REAL and r.verification == "agree: same"
    r = verdict(spark, "invented words that nobody wrote", (True, " blind ", "leaves a pattern of\n stripes on the far"), GOOD)
    assert r.passed and r.answer == "blind" and r.evidence == "leaves a pattern of stripes on the far"
    assert verdict(spark, REAL, None, None).verification == "the model skipped this question"
    assert verdict(spark, REAL, (False, "x", ""), GOOD).verification == "not answerable from the text"
    assert verdict(spark, REAL, (None, " ", ""), GOOD).verification == "not answerable from the text"
    assert verdict(spark, "invented words that nobody wrote", (True, "x", ""), GOOD).verification == "no quote found in the text"
    assert verdict(spark, REAL, (None, "x", ""), None).verification == "the model skipped judging this question"
    assert verdict(spark, REAL, (True, "x", ""), (False, False, "agree", "r")).verification == "false premise: agree: r"
    assert verdict(spark, REAL, (True, "x", ""), (None, False, "agree", "r")).verification == "answer not supported: agree: r"
    assert not verdict(spark, REAL, (True, "x", ""), (None, None, "disagree", "r")).passed
    assert verdict(spark, REAL, (True, "x", ""), (None, None, "partial", None)).passed


def test_last_reply_counts(spark):
    df = spark.createDataFrame([(1, [(0, "a"), (1, "b"), (0, "c")])], "doc int, a array<struct<id:int,x:string>>")
    assert {r.id: r.r.x for r in v.last_by_id(df, "a", ["doc"]).collect()} == {0: "c", 1: "b"}


def test_distinct_evidence_in_bulk_and_in_batches(spark):
    rows = spark.createDataFrame([(1, 1, True, "Same quote."), (1, 2, True, "same QUOTE"), (1, 3, False, "x"), (1, 4, True, "other"), (1, 5, True, "third")], "doc_id int, place int, passed boolean, evidence string")
    assert [r.place for r in v.keep_distinct(rows, 2).orderBy("place").collect()] == [1, 4]
    batch = rows.withColumn("chunk", (F.lit(9) - F.col("place")).cast("int"))  # the later section comes first
    kept = spark.createDataFrame([(1, "other")], "doc_id int, norm string")
    assert sorted(r.place for r in v.new_evidence(batch, kept.limit(0)).collect()) == [2, 4, 5]
    assert sorted(r.place for r in v.new_evidence(batch, kept).collect()) == [2, 5]
