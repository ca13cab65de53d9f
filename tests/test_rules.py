"""The rules of verification, a case for each."""

from pyspark.sql import functions as F

from studyspark.functions.text import normalized
from studyspark.operators.verification import judge

TEXT = "The beam splits at the first mirror and joins again at the screen behind it, where the stripes appear."
#: (id, own evidence, blind answer, blind quote, answerable, premise_ok, a_supported, verdict)
REPLIES = [
    (1, "splits at the first mirror and joins again", "two paths", "", True, True, True, "agree"),
    (2, "splits at the first mirror and joins again", "two paths", "", True, True, True, "disagree"),
    (3, "a quote that nobody ever wrote in this text", "by a mirror", "joins again at the screen behind it", None, None, None, "partial"),
    (4, "a quote that nobody ever wrote in this text", "x", "nor was this one ever written anywhere", True, True, True, "agree"),
    (5, "splits at the first mirror and joins again", "two paths", "", False, True, True, "agree"),
    (6, "splits at the first mirror and joins again", "  ", "", True, True, True, "agree"),
    (7, "splits at the first mirror and joins again", "two paths", "", True, False, False, "agree"),
    (8, "splits at the first mirror and joins again", "two paths", "", True, True, False, "agree"),
    (9, "splits at the first mirror and joins again", "two paths", "", True, None, None, None),
    (10, None, "two paths", "splits at the first mir-\nror and joins again", True, True, True, "agree"),
]
WANT = {
    1: (True, "the answer", "agree: r"), 2: (False, "the answer", "disagree: r"), 3: (True, "by a mirror", "partial: r"), 4: (False, "the answer", "no quote fou"),
    5: (False, "the answer", "not answerab"), 6: (False, "the answer", "not answerab"), 7: (False, "the answer", "false premis"), 8: (False, "the answer", "answer not s"),
    9: (False, "the answer", "None: r"), 10: (True, "two paths", "agree: r"),
}


def test_rules(spark):
    schema = "id int, evidence string, b_answer string, b_quote string, answerable boolean, premise_ok boolean, a_supported boolean, verdict string"
    rows = spark.createDataFrame(REPLIES, schema).select(
        "id", F.lit("the answer").alias("answer"), "evidence", normalized(F.lit(TEXT)).alias("norm_text"),
        F.struct("answerable", F.col("b_answer").alias("answer"), F.col("b_quote").alias("quote")).alias("blind"),
        F.struct("premise_ok", "a_supported", "verdict", F.lit("r").alias("reason")).alias("judged"),
    )
    got = judge(rows).select("id", "passed", "answer", F.substring("verification", 1, 12)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == WANT
