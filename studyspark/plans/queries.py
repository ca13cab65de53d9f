"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html_article as html
from ..functions import questions as qs
from ..functions import quotes as quotes_fn
from ..functions import text as t
from ..functions.batches import bounded
from ..functions.chunking import chunk_array, chunks, framing_text, is_framing
from ..operators import history as h
from ..operators import inbox as box
from ..operators import layout, library, matching, selection, verification
from ..sources import sinks
from ..streaming import activity
from .bindings import attempts, questions, reads, table, titles, today

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- history ---------------------------------------------------------------


@query
def q01_attempts_flat(spark, d):
    return attempts(spark, d)


@query
def q02_latest_attempt(spark, d):
    return h.latest(attempts(spark, d)).select("key", "correct", "last_at", "attempts", "misses")


@query
def q03_review_pile(spark, d):
    return h.review_pile(attempts(spark, d)).select("key", "paper", "question", "last_at", "first_seq")


@query
def q04_needs_review_flags(spark, d):
    return h.needs_review(questions(spark, d), attempts(spark, d)).select("key", "attempts", "needs_review", "last_seen")


@query
def q05_daily_rollup(spark, d):
    return h.daily(attempts(spark, d))


def _days(spark, d, days=182):
    read = reads(spark, d).join(titles(spark, d), "paper", "left")
    return h.reading_days(attempts(spark, d), read, today(spark, d), days)


@query
def q06_reading_days(spark, d):
    return _days(spark, d).select("day", F.array_join("read", "; ").alias("read"), "answered", "correct")


@query
def q07_sticking_points(spark, d):
    return h.sticking_points(attempts(spark, d), titles(spark, d))


@query
def q08_overall_stats(spark, d):
    return h.overall(attempts(spark, d))


@query
def q09_paper_counts(spark, d):
    return library.paper_counts(questions(spark, d), attempts(spark, d))


def _shelf(spark, d):
    known = titles(spark, d).withColumn("has_pdf", F.col("paper") % 2 == 0).withColumn("has_html", F.col("paper") % 3 == 0).withColumn("added", F.col("paper"))
    return library.papers(known, questions(spark, d), attempts(spark, d), reads(spark, d))


@query
def q10_suggest_paper(spark, d):
    return library.suggest(_shelf(spark, d), "7")


@query
def q97_suggest_another(spark, d):
    """What is suggested while the suggested paper is open."""
    return library.suggest(_shelf(spark, d), "7", other_than=q10_suggest_paper(spark, d))


@query
def q11_streak_length(spark, d):
    return h.streak(_days(spark, d, None), today(spark, d))


@query
def q12_calendar_heatmap(spark, d):
    now = today(spark, d)
    first = now - timedelta(days=181)
    first -= timedelta(days=(first.weekday() + 1) % 7)  # weeks are columns and begin on Sunday
    return h.calendar(_days(spark, d, None), first, now, now)


@query
def q13_status_tags(spark, d):
    return _shelf(spark, d).select("paper", "status", "reader_kind")


@query
def q14_last_ten_days(spark, d):
    return h.last_days(_days(spark, d), 10).select("day", "answered", "correct", "scale")


@query
def q36_week_totals(spark, d):
    """Monday to Sunday of the current week."""
    now = today(spark, d)
    monday = now - timedelta(days=now.weekday())
    week = h.calendar(_days(spark, d, None), monday, monday + timedelta(days=6), now)
    return week.agg(F.sum("n_read").cast("bigint").alias("reads"), F.sum("answered").alias("answered"), F.count_if(F.col("when") == "future").alias("to_come"))


@query
def q37_review_items(spark, d):
    """The pile joined to what is still asked: questions of one kind have been rewritten away."""
    current = questions(spark, d).where("question <> 'click'").withColumn("q_seq", F.lit(1))
    return h.review_items(attempts(spark, d), current).select("key", "paper", "question", "last_at")


@query
def q38_marked_reads(spark, d):
    """A log of marks (views) and unmarks (clicks): the last of each paper counts."""
    log = table(spark, d, "events").where("event_type in ('view', 'click')")
    return h.marked_reads(log.select(F.col("user_id").alias("paper"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", F.col("ts")).alias("read_at")))


@query
def q39_recent_four(spark, d):
    return library.recent(_shelf(spark, d)).select("paper", "title", "last_studied")


@query
def q40_library_totals(spark, d):
    return library.totals(_shelf(spark, d))


@query
def q33_library_search(spark, d):
    return library.search(_shelf(spark, d), " PAPER 1", "review").select("paper", "title", "review")


@query
def q41_model_list(spark, d):
    """Nations as suggested models, customers' nations as installed ones."""
    suggested = table(spark, d, "nation").select(F.concat(F.lit("model"), F.col("n_nationkey").cast("string")).alias("name"))
    installed = table(spark, d, "supplier").select(F.concat(F.lit("model"), (F.col("s_nationkey") + 5).cast("string")).alias("name")).distinct()
    return library.model_list(suggested, installed)


# --- text ------------------------------------------------------------------


@query
def q15_question_keys(spark, d):
    asked = table(spark, d, "conversations")
    return asked.select("conv_id", "turn", t.question_key(F.col("conv_id").cast("string"), "text").alias("key"))


def _normed(spark, d):
    return table(spark, d, "documents").select("doc_id", t.normalized("text").alias("norm"))


@query
def q16_normalized_text(spark, d):
    return _normed(spark, d)


@query
def q17_needs_ocr_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", t.needs_ocr("text").alias("needs_ocr"))


@query
def q18_dot_leaders_stripped(spark, d):
    led = F.concat(F.lit("Contents . . . . . "), F.col("doc_id").cast("string"), F.lit(" .....\n"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.strip_dot_leaders(led).alias("text"))


@query
def q21_doc_fingerprint_dups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", t.fingerprint("text").alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query
def q42_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", t.preview("text", 300).alias("preview"))


@query
def q43_clean_quotes(spark, d):
    broken = F.replace("text", F.lit("tion"), F.lit("ti-\non"))
    return table(spark, d, "benchmark").select("item_id", t.clean_quote(broken).alias("quote"))


# --- quotes ----------------------------------------------------------------


def _quotes(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.normalized("text").alias("quote"))


@query
def q19_benchmark_quote_match(spark, d):
    return matching.quote_pairs(_normed(spark, d), _quotes(spark, d))


@query
def q20_quote_pages(spark, d):
    """Texts dealt to two marked pages; each document's own middle is the quote."""
    half = F.floor(F.length("text") / 2).cast("int")
    paged = F.concat(F.lit("--- Page 3 ---\n"), F.substring(F.col("text"), 1, half), F.lit("\n--- Page 4 ---\n"), F.substring(F.col("text"), half + 1, F.length("text")))
    quote = t.normalized(F.substring(F.col("text"), half + 1, F.lit(90)))
    return table(spark, d, "documents").select("doc_id", quotes_fn.find_page(quote, quotes_fn.page_index(paged)).alias("page"))


@query
def q35_loose_highlight(spark, d):
    """How each benchmark passage can be marked in the documents that hold it."""
    pairs = q19_benchmark_quote_match(spark, d)
    rows = pairs.join(table(spark, d, "documents"), "doc_id").join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")), "item_id")
    return rows.select("doc_id", "item_id", quotes_fn.highlight_level("quote", "text").alias("level"))


# --- chunks and articles ----------------------------------------------------


def _chunked(spark, d):
    return chunks(table(spark, d, "documents"), size=1000, overlap=100)


@query
def q22_chunks_small(spark, d):
    return _chunked(spark, d)


@query
def q23_framing_chunks(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.array(chunk_array("text", 1000, 100)), lambda c: F.size(c) > 0)).alias("c"))
    return parts.select("doc_id", F.size(F.filter("c", is_framing)).alias("n_framing"), framing_text(F.col("c")).alias("framing"))


def _articles(spark, d):
    bounded(spark)
    return table(spark, d, "pages").select("page_id", "url", html.page_struct("html").alias("p")).select("page_id", "url", "p.*", html.article_text("p.raw").alias("text"))


@query
def q24_article_text(spark, d):
    return _articles(spark, d).select("page_id", "text", F.array_join(html.headings("text"), " / ").alias("headings"))


@query
def q25_article_title_slug(spark, d):
    title = html.article_title("title", "meta_title", "text", "url")
    return _articles(spark, d).select("page_id", title.alias("title"), html.slug("url", title).alias("slug"))


def _urls(spark, d):
    own = table(spark, d, "pages").select("page_id", "url")
    kinds = ("https://www.biorxiv.org/content/10.1101/{}v1.full.pdf", "https://arxiv.org/abs/2401.{}", "https://arxiv.org/pdf/2401.{}.pdf", "https://example.org/a/{}?q=1")
    made = [own.select("page_id", F.concat(*(F.lit(p) if i == 0 else F.concat(F.col("page_id").cast("string"), F.lit(p)) for i, p in enumerate(k.split("{}")))).alias("url")) for k in kinds]
    for m in made:
        own = own.unionByName(m)
    return own


@query
def q26_canonical_sources(spark, d):
    return _urls(spark, d).select("page_id", "url", html.text_and_pdf_urls("url").alias("s")).select("page_id", "url", "s.text_url", "s.pdf_url")


@query
def q45_url_gates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.concat(F.when(F.col("lang") == "en", "HTTPS://").otherwise("ftp://"), F.col("source")).alias("url"))
    return rows.select("doc_id", t.web_address("url").alias("is_web"), t.readability("n", F.when(F.col("n") % 2 == 0, F.col("url"))).alias("action"))


@query
def q46_reader_pages(spark, d):
    marked = F.concat(F.lit("## Part <one>\n\n"), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", html.reader_html(F.lit('A & "B"'), marked, F.lit("https://example.org/?a=1&b=2")).alias("html"))


@query
def q47_tail_sections(spark, d):
    """The whole of each document in three sections, split at thirds of its length; the second are references."""
    third = F.floor(F.length("text") / 3).cast("int")
    body = F.concat(F.lit("## Intro\n\n"), F.substring("text", F.lit(1), third), F.lit("\n\n## References\n\n"), F.substring("text", third + 1, third), F.lit("\n\n## Methods\n\nlost\n\n## Appendix A\n\n"), F.substring("text", 2 * third + 1, F.length("text")))
    flat = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return flat.select("doc_id", F.array_join(html.without_tail(body), "\n\n").alias("text"))


# --- questions ---------------------------------------------------------------


@query
def q27_qa_pairs(spark, d):
    """A user's turn and the assistant's next one, as question and answer."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(order)).withColumn("next", F.lead("role").over(order))
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def _asked(spark, d):
    """Question sets of conversations: one per turn, with level, answer (the whole turn) and evidence."""
    level = F.element_at(F.array(*map(F.lit, (*qs.LEVELS, ""))), (F.col("turn") % 5 + 1).cast("int"))
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = table(spark, d, "conversations").select("conv_id", "turn", level.alias("type"), F.concat(F.lit("Why "), F.col("turn").cast("string")).alias("question"), F.concat(F.lit("Since "), line).alias("answer"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("e"), F.col("turn").cast("string"))).otherwise("").alias("evidence"), F.when(F.col("turn") % 4 == 0, F.col("turn").cast("int") + 1).alias("page"))
    return rows.withColumn("answer", F.trim("answer"))


def _files(asked):
    q = F.struct("type", "question", "answer", "evidence", "page")
    sets = asked.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", q.alias("q")))), lambda x: x["q"]).alias("q"))
    files = sets.select("conv_id", qs.write_notes(qs.render_questions(F.col("conv_id").cast("string"), "q", F.lit("made")), F.lit("## Q9 (overview)\nmy note")).alias("md"))
    return files.select("conv_id", F.posexplode(qs.parse_questions("md")).alias("pos", "q")).select("conv_id", "pos", "q.*")


@query
def q48_question_files(spark, d):
    """Sets are rendered as files and parsed again: every field comes back."""
    return _files(_asked(spark, d))


@query
def q49_notes_and_titles(spark, d):
    md = F.concat(F.lit("# Study Questions: "), F.col("source"), F.lit("\n\n## Q1\nA?\n\n**Answer:** b\n"))
    files = table(spark, d, "documents").select("doc_id", qs.write_notes(qs.write_notes(md, F.lit("old")), F.concat(F.lit(" new "), F.col("lang"))).alias("md"))
    return files.select("doc_id", qs.read_notes("md").alias("notes"), qs.parse_title("md").alias("title"), F.length("md").alias("n"))


@query
def q50_model_replies(spark, d):
    """JSON replies: objects, fenced bare lists, both holding more than questions, and text that is neither."""
    objects = F.to_json(F.array(F.struct(F.lit(" Overview ").alias("type"), F.concat(F.lit(" why "), F.col("turn").cast("string")).alias("question"), F.col("role").alias("answer"), F.lit("e").alias("evidence")), F.struct(F.lit("odd").alias("type"), F.lit("q").alias("question"), F.lit(" ").alias("answer"), F.lit("").alias("evidence"))))
    body = F.concat(F.when(F.col("turn") % 2 == 0, F.lit('["x", null, 3, {"questions": []}, ')).otherwise(F.lit("[")), F.substring(objects, F.lit(2), F.length(objects)))
    raw = F.when(F.col("role") == "user", F.concat(F.lit('{"questions":'), body, F.lit("}"))).when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise("sorry, no")
    rows = table(spark, d, "conversations").select("conv_id", "turn", qs.parse_reply(raw).alias("q"))
    return rows.select("conv_id", "turn", F.size(F.coalesce("q", F.array().cast("array<struct<type:string,question:string,answer:string,evidence:string>>"))).alias("n"), F.get("q", F.lit(0))["type"].alias("type"), F.get("q", F.lit(0))["question"].alias("question"))


def _candidates(spark, d):
    level = F.element_at(F.array(*map(F.lit, ("evidence", "evidence", "overview", "approach", "critique", "odd"))), (F.length("text") % 6 + 1).cast("int"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("cand_id"), level.alias("type"))


@query
def q28_level_selection(spark, d):
    ranked = _candidates(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("cand_id")))
    return selection.select_by_level(ranked, 4).select("doc_id", "cand_id", "picked", "place")


@query
def q51_rank_candidates(spark, d):
    """Replies rank candidates backwards, repeat ids and name unknown ones; one document in five has none."""
    rows = _candidates(spark, d)
    n = rows.groupBy("doc_id").agg(F.max("cand_id").alias("m"))
    ids = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(-1), F.lit(999))).otherwise(F.array(F.col("m"), F.lit(0), F.col("m"), F.lit(999), F.lit(1)))
    return selection.rank_candidates(rows, n.select("doc_id", ids.alias("ranked_ids"))).select("doc_id", "cand_id", "rank")


@query
def q29_verification_rules(spark, d):
    """Every document with one question; doc_id modulo 10 says what is wrong with the quotes, the blind answer or the verdict."""
    k = F.col("doc_id") % 10
    passage = lambda at: F.substring("text", at, 60)
    flag = lambda no, unknown: F.when(k.isin(*no), False).when(~k.isin(*unknown), True)
    evidence = F.when(k.isin(3, 4), "a quote that nobody ever wrote in this text").when(k != 0, passage(101))
    quote = F.when(k == 3, passage(201)).when(k == 4, "nor was this one ever written anywhere").when(k == 0, passage(101)).otherwise("")
    verdict = F.when(k == 2, "disagree").when(k == 3, "partial").when(k != 9, "agree")
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.lit("the answer").alias("answer"), evidence.alias("evidence"), t.normalized("text").alias("norm_text"),
        F.struct(flag([5], [3]).alias("answerable"), F.when(k == 6, "  ").otherwise("two paths").alias("answer"), quote.alias("quote")).alias("blind"),
        F.struct(flag([7], [3, 9]).alias("premise_ok"), flag([7, 8], [3, 9]).alias("a_supported"), verdict.alias("verdict"), F.lit("r").alias("reason")).alias("judged"),
    )
    return verification.judge(rows).select("doc_id", "passed", "answer", F.substring("verification", 1, 12).alias("why"))


@query
def q52_distinct_evidence(spark, d):
    """Of the passed candidates the first three of each document whose evidence, a whole turn, is new."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), (F.col("role") != "system").alias("passed"), F.col("text").alias("evidence"))
    return verification.keep_distinct(rows, 3).select("doc_id", "place")


# --- layout -----------------------------------------------------------------


def _words(spark, d):
    """Line items as word boxes: suppliers are pages, parts are rows, quantities are columns."""
    x0 = F.when(F.col("l_partkey") % 7 == 0, F.lit(250.0)).when(F.col("l_quantity") <= 25, F.col("l_quantity").cast("double") * 10).otherwise(F.col("l_quantity").cast("double") * 10 + 60)
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), F.col("l_suppkey").alias("page"), x0.alias("x0"), ((F.col("l_partkey") % 60) * 12.5).cast("double").alias("top"), F.concat(F.lit("w"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("text"))
    wide = F.when(F.col("x0") == 250.0, 100.0).otherwise(20.0)
    return rows.select("doc_id", "page", "x0", (F.col("x0") + wide).alias("x1"), "top", (F.col("top") + 10).alias("bottom"), "text")


def _pages(spark, d):
    return table(spark, d, "supplier").select(F.lit(0).alias("doc_id"), F.col("s_suppkey").alias("page"), F.lit(612.0).alias("width"), F.lit(800.0).alias("height"))


@query
def q30_gutter_detection(spark, d):
    return layout.gutters(_words(spark, d), _pages(spark, d)).select("page", "gutter")


@query
def q31_band_merge(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") * 5).cast("double").alias("top"), (F.col("l_partkey") * 5 + F.col("l_quantity")).cast("double").alias("bottom"))
    return layout.merge_intervals(rows, ["l_suppkey"]).select("l_suppkey", "band", "top", "bottom")


@query
def q53_words_in_regions(spark, d):
    words, pages = _words(spark, d), _pages(spark, d)
    return layout.in_regions(words, layout.regions(words, pages)).select("page", "text", "place")


@query
def q54_page_assembly(spark, d):
    """Conversations as documents, their turns as pages."""
    return layout.assemble(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text"))


@query
def q55_page_counters(spark, d):
    """A page is skipped only if nothing stands on it."""
    pages = table(spark, d, "documents").select(F.col("source").alias("doc_id"), (F.col("lang") == "de").alias("fallback"), t.needs_ocr("text").alias("ocr"), "text")
    return layout.page_counters(pages).withColumnRenamed("doc_id", "source")


@query
def q56_words_from_chars(spark, d):
    """Orders as rows of characters; every seventh part stands upright no more."""
    chars = table(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), F.lit(1).alias("page"), F.col("l_orderkey").cast("double").alias("top"), (F.col("l_orderkey") + 10).cast("double").alias("bottom"), (F.col("l_linenumber") * 6.0 + F.when(F.col("l_linenumber") > 3, 2.0).otherwise(0.0)).alias("x0"), F.substring("l_returnflag", 1, 1).alias("c"), (F.col("l_partkey") % 7 != 0).alias("upright"))
    return layout.words_from_chars(chars.withColumn("x1", F.col("x0") + 6)).select("top", "x0", "x1", "text")


# --- inbox ------------------------------------------------------------------


def _names(spark, d):
    suffix = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "fr", ".html").when(F.col("lang") == "de", ".htm").otherwise(".txt")
    return table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), suffix).alias("name"), F.col("doc_id").alias("seq"))


@query
def q32_inbox_antijoin(spark, d):
    done = table(spark, d, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("stem"))
    return box.pending(_names(spark, d), done).select("name", "stem")


@query
def q57_add_papers(spark, d):
    names = _names(spark, d)
    offered = names.select("name", (F.col("seq") * 2).alias("seq"), F.lit(True).alias("is_file")).unionByName(names.select("name", (F.col("seq") * 2 + 1).alias("seq"), (F.col("seq") % 2 == 0).alias("is_file")))
    queued = names.where("seq % 3 = 0").select("name")
    done = table(spark, d, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("name"))
    return box.add_papers(offered, queued, done)


@query
def q34_log_progress(spark, d):
    """Events as a run's log: a line for each, by its kind."""
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("[2024-01-01 02:00:00] Processing a"), F.col("user_id").cast("string"), F.lit(".pdf...")))
        .when(F.col("event_type") == "click", F.lit("  dropped: a question"))
        .when(F.col("event_type") == "purchase", F.lit("Done. 3 questions"))
        .when(F.col("event_type") == "signup", F.lit("section 2/4..."))
        .otherwise(F.lit("took 3 s"))
    )
    lines = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("line_no"), line.alias("line"))
    return box.run_progress(lines)


@query
def q58_removable_names(spark, d):
    bad = F.when(F.col("seq") % 4 == 1, F.concat(F.lit("../"), F.col("name"))).when(F.col("seq") % 4 == 2, F.concat(F.lit("/tmp/"), F.col("name"))).otherwise(F.col("name"))
    return box.removable(_names(spark, d).select(bad.alias("name")))


@query
def q59_distinct_jobs(spark, d):
    jobs = table(spark, d, "events").select(F.concat_ws("-", "user_id", "event_type").alias("key"), F.col("event_id").alias("seq"))
    return box.distinct_jobs(jobs)


@query
def q60_setting_values(spark, d):
    out = F.concat(F.lit("Power setting\nCurrent AC Power Setting Index: 0x"), F.lpad(F.lower(F.hex("event_id")), 8, "0"), F.lit("\nCurrent DC Power Setting Index: none"))
    return table(spark, d, "events").select("event_id", t.setting_index(out).alias("ac"), t.setting_index(out, on_battery=True).alias("dc"))


@query
def q61_small_scalars(spark, d):
    ev = table(spark, d, "orders")
    return ev.select("o_orderkey", t.size_mb(F.col("o_orderkey") * 12345).cast("double").alias("mb"), t.percent(F.col("o_orderkey") % 100, F.col("o_orderkey") % 7).alias("pct"), t.plural(F.col("o_orderkey") % 3, "paper").alias("label"), t.escape_html(F.concat(F.lit("<"), F.col("o_orderstatus"), F.lit("&>"))).alias("safe"))


# --- streams ------------------------------------------------------------------


@query
def x1_stream_daily(spark, d):
    """The daily rollup by Structured Streaming over the same events."""
    stream = activity.event_stream(spark, f"{d}/events.parquet")
    return activity.run_to_table(activity.daily_answers(stream), sinks.scratch(spark, "x1"))


@query
def x2_stream_sessions(spark, d):
    stream = activity.event_stream(spark, f"{d}/events.parquet")
    return activity.run_to_table(activity.sessions(stream, "6 hours"), sinks.scratch(spark, "x2"))


from . import marking, storage, streams  # noqa: E402, F401 - register their own queries here
