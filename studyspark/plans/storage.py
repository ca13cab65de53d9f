"""Queries of sources, sinks, readers and models: what is written is read back, what is asked is answered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as qs
from ..functions import text as t
from ..operators import inbox as box
from ..operators import layout, library, verification
from ..operators.generation import find_title, generate, graded
from ..sources import fetch, files, model, pages, sinks
from .bindings import attempts, reads, table
from .queries import query


def _kept(spark):
    """Intermediate tables of a query, written to the shared folder and read again."""

    def keep(df, name):
        path = sinks.scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


# --- sinks and state ----------------------------------------------------------


@query
def q70_attempts_appended(spark, d):
    """Attempts appended in two writes are all there, each once."""
    path, rows = sinks.scratch(spark, "q70"), attempts(spark, d)
    sinks.append_attempts(rows.where("seq % 2 = 0"), path)
    sinks.append_attempts(rows.where("seq % 2 <> 0"), path)
    return spark.read.parquet(path)


@query
def q71_reads_appended(spark, d):
    """Marks, then unmarks of every third paper: the last of a paper counts."""
    path, rows = sinks.scratch(spark, "q71"), reads(spark, d)
    sinks.append_reads(rows, path)
    sinks.append_reads(rows.where("paper % 3 = 0").select("paper", (F.col("seq") + 1000000000).alias("seq"), F.when(F.lit(False), F.col("read_at")).alias("read_at")), path)
    last = spark.read.parquet(path).groupBy("paper").agg(F.max_by("read_at", "seq").alias("read_at"))
    return last.where("read_at is not null")


def _stem(spark, d):
    return table(spark, d, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("stem"), "item_id", "text")


@query
def q72_question_upsert(spark, d):
    """New files of two items in three replace old ones of one in two; notes stay with their paper."""
    body = lambda q: F.array(F.struct(F.lit("overview").alias("type"), F.lit(q).alias("question"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("answer"), F.lit("").alias("evidence"), F.lit(None).cast("int").alias("page")))
    items = _stem(spark, d)
    old = items.where("item_id % 2 = 0").select("stem", qs.write_notes(qs.render_questions("stem", body("Old?")), F.concat(F.lit("note of "), F.col("stem"))).alias("md"))
    new = items.where("item_id % 3 > 0").select("stem", F.col("stem").alias("title"), body("New?").alias("questions"), F.lit("made").alias("note"))
    after = sinks.upsert_questions(new, old)
    return after.select("stem", qs.read_notes("md").alias("notes"), F.get(qs.parse_questions("md"), F.lit(0))["question"].alias("question"), F.get(qs.parse_questions("md"), F.lit(0))["answer"].alias("answer"))


@query
def q73_files_written(spark, d):
    """Whole texts as files, one folder for each document, read back whole."""
    path = sinks.scratch(spark, "q73")
    sinks.write_files(_stem(spark, d), path, "text")
    return spark.read.text(path, wholetext=True).select(F.col("stem"), F.regexp_replace("value", r"\n$", "").alias("text"))


@query
def q74_history_read(spark, d):
    """Stored attempts, an object a line and key, flattened again."""
    path = sinks.scratch(spark, "q74")
    rows = attempts(spark, d).select("key", F.col("paper").cast("string").alias("paper"), "question", "seq", F.struct(F.col("at").cast("timestamp_ntz").alias("at"), "correct").alias("a"))
    lists = rows.groupBy("key", "paper", "question").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "a"))), lambda x: x["a"]).alias("attempts"))
    lists.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return files.history(spark, path).select("key", "paper", "question", F.inline("attempts"))


@query
def q75_state_lines(spark, d):
    """Lines of state; every fifth is cut off and counts as absent."""
    path = sinks.scratch(spark, "q75")
    line = F.to_json(F.struct("item_id", F.length("text").alias("n")))
    cut = F.when(F.col("item_id") % 5 == 0, F.substring(line, 1, 9)).otherwise(line)
    table(spark, d, "benchmark").select(cut.alias("value")).write.text(path)
    return files.state(spark, path, "item_id bigint, n int")


@query
def q76_log_lines(spark, d):
    path = sinks.scratch(spark, "q76")
    at = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "))
    line = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.concat(at, F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return files.log_lines(spark, path)


# --- inbox -----------------------------------------------------------------------


def _names(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".pdf").otherwise(".txt")).alias("name"), "doc_id")


def _stems(spark, d):
    return table(spark, d, "labels").where("doc_id is not null").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("stem"))


@query
def q77_pending_only(spark, d):
    """Pending files of a run that is given names, and of one that is given none."""
    names = _names(spark, d)
    some = box.pending(names, _stems(spark, d), names.where("doc_id % 3 = 0").select("name"))
    every = box.pending(names, _stems(spark, d), names.limit(0).select("name"))
    return some.select(F.lit("named").alias("run"), "name").unionByName(every.select(F.lit("all").alias("run"), "name"))


@query
def q78_shelved(spark, d):
    return box.shelve(_names(spark, d), _stems(spark, d))


@query
def q79_pasted_texts(spark, d):
    """Documents as pasted texts; short ones are refused, half of them have no title."""
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" Text "), F.col("doc_id").cast("string"), F.lit(" "))).otherwise(" ")
    texts = table(spark, d, "documents").select("doc_id", title.alias("title"), "text")
    return box.pasted(texts).groupBy("title").agg(F.count("*").alias("n"), F.count_if(F.col("html").contains(F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1>")))).alias("headed"))


@query
def q80_pdf_magic(spark, d):
    mark = F.when(F.col("page_id") % 3 == 0, "%PDF-1.7 ").when(F.col("page_id") % 3 == 1, " %PDF").otherwise("%PD")
    bodies = table(spark, d, "pages").select("page_id", F.encode(F.concat(mark, F.coalesce("html", F.lit(""))), "UTF-8").alias("body"))
    return sinks.pdf_only(bodies).select("page_id", F.octet_length("body").alias("n_bytes"))


# --- readers, transports and models --------------------------------------------------


def _get(url):
    """A transport decided by the last digit of an address."""
    n = len(url) % 4
    if n == 3:
        raise OSError("no route")
    return fetch.Reply((200, 404, 503)[n], {"Retry-After": "1"}, url.encode())


@query
def q81_fetch_retry(spark, d):
    """Replies, refusals and dead servers; no waits, as there is no server."""
    urls = table(spark, d, "pages").select("url").where("url is not null")
    return fetch.pages(urls, _get, sleep=lambda s: None).select("url", "status", F.decode("body", "UTF-8").alias("body"), "error")


@query
def q82_models_installed(spark, d):
    """Exact names, names without a tag, missing models, and a server that cannot be reached."""
    installed = F.when(F.col("user_id") % 5 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"), F.lit(":latest")), F.lit("big:32b")))
    wanted = F.when(F.col("user_id") % 2 == 0, "m1").otherwise("big:32b")
    return table(spark, d, "events").select("event_id", t.model_installed(installed, F.when(F.col("user_id") % 7 == 0, "big").otherwise(wanted)).alias("ok"))


@query
def q83_model_errors(spark, d):
    """Kinds of errors, once for each status and message."""
    message = F.element_at(F.array(*map(F.lit, ("Model not found", "timed out while loading", "the reply would repeat", "boom", "timed out"))), (F.col("event_id") % 5 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, (404, 500, 200))), (F.col("event_id") % 3 + 1).cast("int"))
    kinds = table(spark, d, "events").select(status.alias("status"), message.alias("message")).groupBy("status", "message").agg(F.count("*").alias("n"))
    return kinds.withColumn("kind", model.error_kind("status", "message"))


def _pdfs(spark, d):
    """Conversations as paged files: a page for each turn; every fourth page breaks the first reader."""
    page = F.concat(F.when(F.col("turn") % 4 == 1, "!").otherwise(""), F.when(F.col("turn") % 3 == 2, F.lit("")).otherwise(F.translate(F.coalesce("text", F.lit("")), "\f\r", "  ")))
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", page.alias("p")).alias("s"))
    whole = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["p"]), "\f").alias("t"))
    return whole.select("doc_id", F.encode(F.concat(F.when(F.col("doc_id") % 6 == 5, "odd!").otherwise("%PDF"), F.col("t")), "UTF-8").alias("content"))


def _read_by_ocr(content, page):
    if page % 2:
        raise RuntimeError("no picture")
    return "read from the picture"


@query
def q84_page_reading(spark, d):
    """Two readers and OCR over paged files, and what each had to do."""
    readers = pages.Readers(pages.SplitReader(broken="!"), pages.SplitReader(line_end="\r\n"), _read_by_ocr)
    return pages.read_pages(_pdfs(spark, d), readers)


@query
def q85_page_counts(spark, d):
    return pages.page_counts(_pdfs(spark, d), pages.SplitReader())


@query
def q86_assembled_files(spark, d):
    """Texts of the same files without OCR, as documents with page markers."""
    readers = pages.Readers(pages.SplitReader(broken="!"), pages.SplitReader(line_end="\r\n"))
    return layout.assemble(pages.read_pages(_pdfs(spark, d), readers))


@query
def q87_replies_by_id(spark, d):
    """Turns as answers to questions numbered modulo 3: of a repeated id the last answer counts."""
    r = F.struct((F.col("turn") % 3).cast("int").alias("id"), F.col("text").alias("answer"))
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", r.alias("r")))), lambda x: x["r"]).alias("a"))
    return verification.last_by_id(said, "a", ["conv_id"]).select("conv_id", "id", F.col("r.answer").alias("answer"))


@query
def q88_checks_ok(spark, d):
    """Orders as setups, their lines as checks."""
    ok = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("boolean")).otherwise(F.col("l_partkey") % 4 != 0)
    checks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("setup"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("name"), ok.alias("ok"))
    return library.checks_ok(checks)


@query
def q89_graded_answers(spark, d):
    """Answers that are in the reference, answers that are not, and none, marked by the stand-in."""
    answer = F.when(F.col("item_id") % 3 == 0, F.substring("text", 3, 20)).when(F.col("item_id") % 3 == 1, F.lit("zzz 0 zzz")).otherwise(F.lit(None).cast("string"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("What?").alias("question"), F.col("text").alias("reference"), F.lit("").alias("evidence"), answer.alias("answer"))
    return graded(rows, model.SentenceModel())


@query
def q90_titles_found(spark, d):
    """Declared titles that stand on the first page, names of files, and none."""
    meta = F.when(F.col("item_id") % 3 == 0, F.substring("text", 1, 60)).when(F.col("item_id") % 3 == 1, F.lit("scan.pdf"))
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("--- Page 1 ---\n"), F.col("text"), F.lit("\n\n--- Page 2 ---\nmore")).alias("text"), meta.alias("meta_title"))
    return find_title(docs, model.SentenceModel(), _kept(spark))


def _papers(spark, d):
    """Conversations as papers of one page for each turn."""
    part = F.concat(F.lit("--- Page "), (F.col("turn") + 1).cast("string"), F.lit(" ---\n"), F.col("text"))
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", part.alias("p")).alias("s"))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["p"]), "\n\n").alias("text"))


@query
def q91_question_pipeline(spark, d):
    """Verified questions of every conversation, by the stand-in."""
    return generate(_papers(spark, d), model.SentenceModel(), 6, _kept(spark))[0]


@query
def q92_run_summary(spark, d):
    return generate(_papers(spark, d), model.SentenceModel(), 6, _kept(spark))[1]
