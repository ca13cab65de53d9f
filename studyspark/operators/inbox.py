"""What happens to files on their way from the inbox to the library, as set logic over names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html_article import reader_html, slug
from ..functions.text import allowed_file, file_stem


def add_papers(offered: DataFrame, inbox: DataFrame, library: DataFrame) -> DataFrame:
    """(name, why) of each offered file (name, is_file, seq): why is null for those to be copied.

    A name offered twice is in the inbox by its second time."""
    queued = inbox.select("name").distinct().withColumn("_q", F.lit(True))
    done = library.select("name").distinct().withColumn("_d", F.lit(True))
    sound = allowed_file("name", ("pdf",)) & F.col("is_file")
    again = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("_ok"), "seq")) > 1
    rows = offered.withColumn("_ok", sound).join(queued, "name", "left").join(done, "name", "left").withColumn("_again", again)
    why = F.when(~F.col("_ok"), "not a PDF").when(F.col("_q").isNotNull(), "already in the inbox").when(F.col("_d").isNotNull(), "already processed").when(F.col("_again"), "already in the inbox")
    return rows.select("seq", "name", why.alias("why"))


def pending(inbox: DataFrame, question_files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Inbox files without a question file, sorted by name; ``only`` restricts to names unless it is empty."""
    rows = inbox.where(allowed_file("name")).withColumn("stem", file_stem("name"))
    if only is not None and only.limit(1).count():
        rows = rows.join(only.select("name"), "name", "left_semi")
    return rows.join(question_files.select("stem"), "stem", "left_anti").orderBy("name")


def removable(names: DataFrame) -> DataFrame:
    """Names that may be removed from the inbox: allowed suffix, and no way out of the folder."""
    inside = ~F.col("name").rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~F.col("name").rlike(r"^([A-Za-z]:)?[/\\]") & ~F.col("name").rlike(r"[/\\]")
    return names.withColumn("ok", allowed_file("name") & inside)


def pasted(texts: DataFrame, least: int = 500) -> DataFrame:
    """Pasted texts (title, text) long enough to keep, as reader pages with file names."""
    name = F.when(F.trim("title") != "", F.trim("title")).otherwise("Pasted article")
    kept = texts.where(F.length(F.trim("text")) >= least).withColumn("title", name)
    return kept.select("title", F.concat(slug(F.lit("https://pasted.local/"), F.col("title")), F.lit(".html")).alias("name"), reader_html("title", "text", F.lit("")).alias("html"))


def shelve(names: DataFrame, question_files: DataFrame) -> DataFrame:
    """Stems that need an empty question file before their source moves to the library."""
    return names.select(file_stem("name").alias("stem")).distinct().join(question_files.select("stem"), "stem", "left_anti")


def distinct_jobs(jobs: DataFrame) -> DataFrame:
    """First job of each key, in order of arrival."""
    return jobs.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where("_n = 1").drop("_n").orderBy("seq")


def run_progress(lines: DataFrame) -> DataFrame:
    """Log lines (run, line_no, line) with their kind and running counts of dropped questions and finished papers.

    Dropped counts start anew with each paper."""
    text = F.trim(F.regexp_replace("line", r"^\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\]\s*", ""))
    kinds = (("found", r"^Found \d+ paper"), ("paper", r"^Processing .+\.(pdf|html?)\.\.\.$"), ("title", "^title: "), ("section", r"^section \d+/\d+"), ("ranking", "^ranking"), ("verifying", "^verifying"), ("dropped", "^dropped:"), ("passed", r"^\d+ of \d+ questions checked passed"), ("done", r"^Done\."), ("error", r"^(Can't start:|WARNING:|ERROR)"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    order = Window.partitionBy("run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    in_paper = Window.partitionBy("run", "paper_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda k: F.when(F.col("kind") == k, 1).otherwise(0)
    rows = lines.withColumn("text", text).withColumn("kind", kind).withColumn("paper_no", F.sum(n("paper")).over(order))
    part = lambda i: F.regexp_extract("text", r"^section (\d+)/(\d+)", i)
    fraction = (
        F.when(F.col("kind") == "section", F.try_divide(part(1).try_cast("double"), part(2).try_cast("double")) * 0.6)
        .when(F.col("kind") == "ranking", 0.65).when(F.col("kind") == "verifying", 0.75).when(F.col("kind") == "passed", 0.95).when(F.col("kind") == "done", 1.0)
    )
    return rows.select("run", "line_no", "kind", "paper_no", F.sum(n("dropped")).over(in_paper).alias("dropped"), F.sum(n("done")).over(order).alias("done"), fraction.alias("fraction"))
