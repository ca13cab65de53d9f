"""Attempts and readings: review pile, rollups, streaks.

``attempts``: paper, question, key, seq (order of appending), at (timestamp), correct.
``reads``: paper, read_at.  "Latest" always means last appended, not latest in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heat_level, iso_day, percent


def latest(attempts: DataFrame) -> DataFrame:
    """One row per key: outcome and time of the last attempt, misses of all time, first place."""
    return attempts.groupBy("key").agg(
        F.min_by("paper", "seq").alias("paper"), F.min_by("question", "seq").alias("question"), F.min("seq").alias("first_seq"),
        F.max_by("correct", "seq").alias("correct"), F.max_by("at", "seq").alias("last_at"),
        F.count("*").alias("attempts"), F.count_if(~F.col("correct")).alias("misses"),
    )


def review_pile(attempts: DataFrame) -> DataFrame:
    """Questions whose last attempt was wrong, longest ago first."""
    return latest(attempts).where(~F.col("correct")).orderBy("last_at", "first_seq")


def needs_review(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """All current questions with their attempts so far; those never tried need no review."""
    own = latest(attempts).select("key", F.col("attempts"), F.col("correct").alias("_last"), F.col("last_at").alias("last_seen"))
    out = questions.join(own, "key", "left")
    return out.withColumn("attempts", F.coalesce("attempts", F.lit(0))).withColumn("needs_review", F.coalesce(~F.col("_last"), F.lit(False))).drop("_last")


def review_items(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """The pile joined to current questions: what has been rewritten or removed drops out; order is kept."""
    place = Window.partitionBy("key").orderBy("q_seq")
    current = questions.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n", "paper", "question")
    return review_pile(attempts).join(current, "key").orderBy("last_at", "first_seq")


def daily(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(iso_day("at").alias("day")).agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))


def reading_days(attempts: DataFrame, reads: DataFrame, today, days: int | None = 182) -> DataFrame:
    """Readings and answers of each day with any: day, read (titles in order of appending), answered, correct.

    ``reads`` brings read_at, title and seq; ``today`` is a date or a date column's literal."""
    read = reads.where("read_at is not null").groupBy(iso_day("read_at").alias("day")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]).alias("read"))
    out = read.join(daily(attempts), "day", "full").select("day", F.coalesce("read", F.array().cast("array<string>")).alias("read"), F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce("correct", F.lit(0)).alias("correct"))
    return out if days is None else out.where(F.col("day") >= F.date_sub(F.lit(today), days))


def streak(days: DataFrame, today) -> DataFrame:
    """Active days in a row back from today, or from yesterday while today has none; one row.

    Islands: consecutive days share day - row_number.  The window sees one row per active day."""
    active = days.where((F.size("read") > 0) | (F.col("answered") > 0)).select("day").distinct()
    islands = active.withColumn("island", F.date_sub("day", F.row_number().over(Window.orderBy("day"))))
    found = islands.groupBy("island").agg(F.count("*").alias("n"), F.max("day").alias("last")).where(F.col("last") >= F.date_sub(F.lit(today), 1))
    return found.agg(F.coalesce(F.max_by("n", "last"), F.lit(0)).alias("streak"))


def calendar(days: DataFrame, first, last, today) -> DataFrame:
    """Every day of a span, with its counts, heat level and whether it is past, today or to come."""
    spark = days.sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    when = F.when(F.col("day") < F.lit(today), "past").when(F.col("day") == F.lit(today), "today").otherwise("future")
    n_read, answered = F.coalesce(F.size("read"), F.lit(0)), F.coalesce("answered", F.lit(0))
    n_read = F.when(n_read < 0, 0).otherwise(n_read)
    return span.join(days, "day", "left").select("day", n_read.alias("n_read"), answered.alias("answered"), heat_level(n_read, answered).alias("level"), when.alias("when"))


def sticking_points(attempts: DataFrame, titles: DataFrame, limit: int = 8) -> DataFrame:
    """Questions still missed, the most missed first; papers by title, or name without one."""
    own = latest(attempts).where(~F.col("correct")).select("paper", "question", "misses")
    return own.join(titles, "paper", "left").select("question", F.coalesce(F.col("title"), F.col("paper").cast("string")).alias("paper"), "misses").orderBy(F.desc("misses"), "question", "paper").limit(limit)


def overall(attempts: DataFrame) -> DataFrame:
    """One row over the whole history: answered, correct, accuracy, review pile."""
    sums = attempts.agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))
    pile = latest(attempts).agg(F.count_if(~F.col("correct")).alias("review_pile"))
    return sums.crossJoin(pile).withColumn("accuracy", percent("correct", "answered"))  # two single rows


def last_days(days: DataFrame, n: int = 10) -> DataFrame:
    """The last n days with answers, newest first, with the scale of their bars."""
    top = days.where("answered > 0").orderBy(F.desc("day")).limit(n)
    return top.withColumn("scale", F.greatest(F.lit(1), F.max("answered").over(Window.partitionBy(F.lit(1)))))


def marked_reads(log: DataFrame) -> DataFrame:
    """Current reading state from an append-only log (paper, seq, read_at or null to unmark): last write wins."""
    return log.groupBy("paper").agg(F.max_by(F.struct("read_at"), "seq").alias("s")).select("paper", F.col("s.read_at").alias("read_at")).where("read_at is not null")


def flatten(history: DataFrame) -> DataFrame:
    """attempts from stored history: rows (key, paper, question, attempts array<struct<at, correct>>)."""
    out = history.select("key", "paper", "question", F.posexplode("attempts").alias("n", "a"))
    return out.select("paper", "question", "key", F.col("n").cast("bigint").alias("seq"), F.col("a.at").alias("at"), F.col("a.correct").alias("correct"))
