"""Evidence-based verdicts on candidates, from a model's blind answers and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import quote_in_text
from ..functions.text import clean_quote, normalized


def last_by_id(replies: DataFrame, array: str, keys: list[str]) -> DataFrame:
    """One row per id of a reply's array; of repeated ids the last counts."""
    rows = replies.select(*keys, F.posexplode(array).alias("pos", "r"))
    return rows.groupBy(*keys, F.col("r.id").alias("id")).agg(F.max_by("r", "pos").alias("r"))


def answered(questions: DataFrame) -> DataFrame:
    """Adds own_ok and blind_ok (is either quote in the text), and fail: why a question needs no judging, or null.

    Columns: evidence, norm_text (normalised chunk), blind (struct answerable, answer, quote; null if skipped).
    A missing flag passes; only an explicit false fails."""
    blind = F.col("blind")
    out = questions.withColumn("_own", normalized(F.coalesce("evidence", F.lit("")))).withColumn("_blind", normalized(F.trim(F.coalesce(blind["quote"], F.lit("")))))
    out = out.withColumn("own_ok", quote_in_text("_own", "norm_text")).withColumn("blind_ok", quote_in_text("_blind", "norm_text"))
    fail = (
        F.when(blind.isNull(), "the model skipped this question")
        .when(blind["answerable"].eqNullSafe(False) | (F.trim(F.coalesce(blind["answer"], F.lit(""))) == ""), "not answerable from the text")
        .when(~(F.col("own_ok") | F.col("blind_ok")), "no quote found in the text")
    )
    return out.withColumn("fail", fail).drop("_own", "_blind")


def concluded(questions: DataFrame) -> DataFrame:
    """Adds passed, verification, and the evidence and answer that stand, to what ``answered`` gives.

    Column judged: struct premise_ok, a_supported, verdict, reason; null if skipped."""
    blind, judged = F.col("blind"), F.col("judged")
    said = F.concat(F.coalesce(judged["verdict"], F.lit("None")), F.lit(": "), F.coalesce(judged["reason"], F.lit("")))
    fail = F.coalesce(
        "fail",
        F.when(judged.isNull(), "the model skipped judging this question")
        .when(judged["premise_ok"].eqNullSafe(False), F.concat(F.lit("false premise: "), said))
        .when(judged["a_supported"].eqNullSafe(False), F.concat(F.lit("answer not supported: "), said))
        .when(~F.coalesce(judged["verdict"].isin("agree", "partial"), F.lit(False)), said),
    )
    passed = F.col("fail").isNull()
    return (
        questions.withColumn("fail", fail)
        .withColumn("passed", passed)
        .withColumn("verification", F.coalesce("fail", said))
        .withColumn("answer", F.when(passed & ~F.col("own_ok"), F.trim(blind["answer"])).otherwise(F.col("answer")))
        .withColumn("evidence", F.when(passed, clean_quote(F.when(F.col("own_ok"), F.col("evidence")).otherwise(F.trim(blind["quote"])))).otherwise(F.col("evidence")))
        .drop("own_ok", "blind_ok", "fail")
    )


def judge(questions: DataFrame) -> DataFrame:
    """``answered`` and ``concluded`` at once, where both replies are there already."""
    return concluded(answered(questions))


def keep_distinct(judged: DataFrame, n: int, order: str = "place") -> DataFrame:
    """The first n passed candidates of each document whose normalised evidence is new."""
    first = Window.partitionBy("doc_id", "_norm").orderBy(order)
    nth = Window.partitionBy("doc_id").orderBy(order)
    rows = judged.where("passed").withColumn("_norm", normalized("evidence")).withColumn("_first", F.row_number().over(first)).where("_first = 1")
    return rows.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= n).drop("_norm", "_first", "_n")


def new_evidence(judged: DataFrame, kept: DataFrame) -> DataFrame:
    """The passed rows of one batch, in the order of chunk and place, whose normalised evidence (norm) neither an
    earlier row of the batch nor one of ``kept`` (doc_id, norm) has."""
    first = Window.partitionBy("doc_id", "norm").orderBy("chunk", "place")
    rows = judged.where("passed").withColumn("norm", normalized("evidence")).withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    return rows.join(kept.select("doc_id", "norm").distinct(), ["doc_id", "norm"], "left_anti")
