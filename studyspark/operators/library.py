"""The library report: one row per paper, what to open next, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import status_tag
from .history import needs_review


def paper_counts(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """paper, total, seen, correct, review, last_studied over current questions."""
    own = needs_review(questions, attempts)
    tried = F.col("attempts") > 0
    return own.groupBy("paper").agg(
        F.count("*").alias("total"), F.count_if(tried).alias("seen"), F.count_if(tried & ~F.col("needs_review")).alias("correct"),
        F.count_if("needs_review").alias("review"), F.max("last_seen").alias("last_studied"),
    )


def papers(known: DataFrame, questions: DataFrame, attempts: DataFrame, reads: DataFrame) -> DataFrame:
    """``known`` papers (paper, title, has_pdf, has_html, added) with counts, status and reader kind."""
    counts = paper_counts(questions, attempts)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = known.join(counts, "paper", "left").join(reads.select("paper", "read_at"), "paper", "left")
    out = out.select(*known.columns, *map(zero, ("total", "seen", "correct", "review")), "last_studied", "read_at")
    kind = F.when(F.col("has_pdf"), "pdf").when(F.col("has_html"), "article")
    return out.withColumn("reader_kind", kind).withColumn("status", status_tag("seen", "correct", "review", "read_at"))


def suggest(shelf: DataFrame, seed: str = "", other_than: DataFrame | None = None) -> DataFrame:
    """One paper to open: unseen with questions, else unread without, else the one studied longest ago.

    Among the first two kinds the choice is by a seeded hash, so it is repeatable.  Papers of ``other_than``
    (paper), such as the open one, are left out; with no other paper there is no row."""
    if other_than is not None:
        shelf = shelf.join(other_than.select("paper"), "paper", "left_anti")
    quiz, fresh = F.col("total") > 0, F.col("seen") == 0
    tier = F.when(quiz & fresh, 0).when(~quiz & F.col("read_at").isNull(), 1).when(quiz, 2).otherwise(3)
    draw = F.md5(F.concat(F.col("paper").cast("string"), F.lit(seed)).cast("binary"))
    return shelf.withColumn("tier", tier).orderBy("tier", F.when(F.col("tier") < 2, draw), F.col("last_studied").asc_nulls_first(), "paper").limit(1).select("paper", "tier")


def search(shelf: DataFrame, query: str | Column = "", only: str = "all") -> DataFrame:
    """Papers whose title holds the query, any case; ``only``: all, unread or review."""
    words = F.lower(F.trim(query if isinstance(query, Column) else F.lit(query)))
    keep = F.contains(F.lower("title"), words)
    if only == "unread":
        keep &= F.col("read_at").isNull()
    elif only == "review":
        keep &= F.col("review") > 0
    return shelf.where(keep)


def recent(shelf: DataFrame, n: int = 4) -> DataFrame:
    """The first n papers in library order (newest added first) that were ever studied."""
    return shelf.where("last_studied is not null").orderBy(F.desc("added"), "paper").limit(n)


def totals(shelf: DataFrame) -> DataFrame:
    return shelf.agg(F.count("*").alias("papers"), F.count_if(F.col("seen") > 0).alias("papers_studied"), F.coalesce(F.sum("total"), F.lit(0)).alias("questions"), F.count("read_at").alias("papers_read"))


def model_list(suggested: DataFrame, installed: DataFrame) -> DataFrame:
    """Suggested models with whether they are installed, then installed ones that nobody suggested."""
    return suggested.withColumn("s", F.lit(True)).join(installed.withColumn("i", F.lit(True)), "name", "full").select("name", F.coalesce("s", F.lit(False)).alias("suggested"), F.coalesce("i", F.lit(False)).alias("installed"))


def checks_ok(checks: DataFrame) -> DataFrame:
    """(setup, ok, failed) of checks (setup, name, ok): all must hold; a null check does not, and ``failed`` names
    those that do not, sorted."""
    ok = F.coalesce("ok", F.lit(False))
    return checks.groupBy("setup").agg(F.every(ok).alias("ok"), F.array_join(F.sort_array(F.collect_list(F.when(~ok, F.col("name")))), ", ").alias("failed"))
