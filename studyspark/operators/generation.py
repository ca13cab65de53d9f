"""From texts to verified question sets: chunks, candidates, ranking, verdicts, pages.

Each model stage is one Arrow-batched pass whose replies are written to a table before
the next stage reads them, so a lost executor never asks a model twice for what is done.

Candidates are verified in rounds.  In each, every document that still lacks questions
sends as many of its next candidates as it lacks, so no more are checked than a loop over
one document would; a round is one pass over all documents, and there are as many rounds
as the unluckiest document needs.

Edge cases: a null or empty text gives no question and no call; a section whose reply
fails has no candidates, or only failed ones; ties in rank go to the order of generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import chunk_array, framing_text
from ..functions.questions import level_rank, parse_reply_or_pairs
from ..functions.quotes import find_page, page_index, quote_in_text
from ..functions.text import normalized
from ..sources.model import Model, replies
from .selection import candidate_plan, rank_candidates, select_by_level
from .verification import answered, concluded, last_by_id, new_evidence

OVERVIEW = -1
BLIND = "struct<answers:array<struct<id:int,answerable:boolean,answer:string,quote:string>>>"
JUDGED = "struct<judgements:array<struct<id:int,premise_ok:boolean,a_supported:boolean,verdict:string,reason:string>>>"
RANKED = "struct<ranked_ids:array<int>>"
#: Page markers, endings that no title has, the least length of a title, what a model sees of a first page.
FIRST_PAGE, SECOND_PAGE = "--- Page 1 ---", "--- Page 2 ---"
NO_TITLE = (".pdf", ".dvi", ".tex")
MIN_TITLE_CHARS = 8
FIRST_PAGE_CHARS = 3000

Table = Callable[[DataFrame, str], DataFrame]


def prompt(instruction: str, text: Column | None = None, **data: Column) -> Column:
    """The text first (a shared prefix is read once by a model's cache), then the instruction, then the data."""
    body = F.to_json(F.struct(*(c.alias(k) for k, c in data.items()))) if data else F.lit("{}")
    asked = F.concat(F.lit(instruction + "\nDATA\n"), body)
    return asked if text is None else F.concat(F.lit("TEXT\n"), text, F.lit("\n\n"), asked)


def sources(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, text, n_chunks) with the framing text as chunk -1."""
    own = docs.select("doc_id", F.explode(F.filter(F.array(chunk_array("text")), lambda c: F.size(c) > 0)).alias("c"))
    part = lambda no, text: F.struct(no.alias("chunk"), text.alias("text"))
    parts = F.concat(F.array(part(F.lit(OVERVIEW), framing_text(F.col("c")))), F.transform("c", lambda x, i: part(i, x)))
    return own.select("doc_id", F.size("c").alias("n_chunks"), F.explode(parts).alias("s")).select("doc_id", "s.chunk", "s.text", "n_chunks")


def candidates_of(src: DataFrame, model: Model, n: int, table: Table, done: DataFrame | None = None) -> DataFrame:
    """(doc_id, cand_id, chunk, type, question, answer, evidence): what the model asks about each section.

    ``done`` (doc_id, chunk, type, question, answer, evidence) are candidates that exist already; their sections are
    not asked again.  Ids follow the order of generation: the whole document first, then section by section."""
    todo = src if done is None else src.join(done.select("doc_id", "chunk").distinct(), ["doc_id", "chunk"], "left_anti")
    plan = candidate_plan(n, 1)
    per_chunk = F.greatest(F.lit(3), F.ceil(F.lit(plan["target"]) / F.col("n_chunks"))).cast("int")
    wanted = F.when(F.col("chunk") == OVERVIEW, plan["overview"]).otherwise(per_chunk)
    ids = F.struct("doc_id", "chunk").alias("id")
    asked = todo.where(F.trim("text") != "").select(ids, prompt("Write questions about this text.", F.col("text"), n=wanted).alias("prompt"))
    raw = table(replies(asked, model, "questions"), "candidates")
    made = raw.select("id.doc_id", "id.chunk", F.posexplode(parse_reply_or_pairs("raw")).alias("pos", "q")).select("doc_id", "chunk", "pos", "q.*")
    if done is not None:
        made = made.unionByName(done.withColumn("pos", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("chunk", "pos")
    return table(made.withColumn("cand_id", F.row_number().over(order) - 1).drop("pos"), "numbered")


def ranked(candidates: DataFrame, model: Model, n: int, table: Table) -> DataFrame:
    """Candidates with rank, picked and place: in the model's order, then by level quotas."""
    shown = F.sort_array(F.collect_list(F.struct(F.col("cand_id").alias("id"), "type", "question", "answer")))
    asked = candidates.groupBy(F.col("doc_id").alias("id")).agg(shown.alias("c"))
    raw = table(replies(asked.select("id", prompt("Rank these questions, the best first.", n=F.lit(n), candidates=F.col("c")).alias("prompt")), model, "rank"), "ranks")
    order = raw.select(F.col("id").alias("doc_id"), F.from_json("raw", RANKED)["ranked_ids"].alias("ranked_ids"))
    return table(select_by_level(rank_candidates(candidates, order), n), "placed")


def verified(batch: DataFrame, src: DataFrame, model: Model, table: Table, name: str) -> DataFrame:
    """Adds passed, verification, and the answer and evidence that stand, to a batch of candidates.

    One prompt for each section and pass: its text dominates.  Only questions with an answer and a quote that
    is in the text are judged.  A section whose reply fails fails as a whole."""
    at = F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy("place")) - 1
    rows = batch.withColumn("i", at).join(src.select("doc_id", "chunk", "text"), ["doc_id", "chunk"])
    key = F.struct("doc_id", "chunk").alias("id")
    listed = lambda df, *fields: df.groupBy("doc_id", "chunk").agg(F.first("text").alias("text"), F.sort_array(F.collect_list(F.struct(F.col("i").alias("id"), *fields))).alias("items"))

    def asked(df, instruction, task, schema, field, *fields):
        """(doc_id, chunk, i, task) of the replies, and (doc_id, chunk, <task>_error) of those that failed."""
        raw = table(replies(listed(df, *fields).select(key, prompt(instruction, F.col("text"), items=F.col("items")).alias("prompt")), model, task), f"{task}-{name}")
        by_id = last_by_id(raw.where("error is null").select("id.doc_id", "id.chunk", F.from_json("raw", schema)[field].alias("a")), "a", ["doc_id", "chunk"])
        return by_id.withColumnsRenamed({"id": "i", "r": task}), raw.where("error is not null").select("id.doc_id", "id.chunk", F.col("error").alias(f"{task}_error"))

    keys, section = ["doc_id", "chunk", "i"], ["doc_id", "chunk"]
    found, failed = asked(rows, "Answer each question from the text alone.", "blind", BLIND, "answers", "question")
    first = answered(rows.join(found, keys, "left").withColumn("norm_text", normalized("text"))).join(failed, section, "left")
    first = table(first.withColumn("fail", F.coalesce("blind_error", "fail")).drop("norm_text", "blind_error"), f"answered-{name}")
    found, failed = asked(first.where("fail is null"), "Judge answer A and answer B to each question.", "judge", JUDGED, "judgements", "question", F.col("answer").alias("answer_a"), F.col("blind.answer").alias("answer_b"))
    # where the judge fails, so does every question of the section that has got so far or not
    second = first.join(found.withColumnRenamed("judge", "judged"), keys, "left").join(failed, section, "left")
    return concluded(second.withColumn("fail", F.coalesce("judge_error", "fail"))).drop("i", "text", "blind", "judged", "judge_error")


def generate(docs: DataFrame, model: Model, n: int, table: Table, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first n verified questions of each document (doc_id, text), and a summary of the run.

    Questions: (doc_id, no, place, type, question, answer, evidence, page, chunk, verification), by level and place.
    Summary: (doc_id, generated, checked, kept, summary).  ``table`` writes an intermediate DataFrame under a name
    and reads it back; ``done``: see ``candidates_of``."""
    src = table(sources(docs), "sources")
    candidates = candidates_of(src, model, n, table, done)
    placed = ranked(candidates, model, n, table)
    state = table(placed.groupBy("doc_id").agg(F.count("*").alias("all")).select("doc_id", "all", F.lit(0).alias("checked"), F.lit(n).alias("lacking")), "state-0")
    kept, number = None, 0
    while state.where("lacking > 0 and checked < all").limit(1).count():  # a candidate at least of each such document
        number += 1
        open_ = state.where("lacking > 0 and checked < all").select("doc_id", "checked", "lacking")
        batch = placed.join(open_, "doc_id").where("place > checked and place <= checked + lacking").drop("checked", "lacking")
        judged = table(verified(batch, src, model, table, str(number)), f"judged-{number}")
        before = judged.limit(0).select("doc_id", F.lit("").alias("norm")) if kept is None else kept
        fresh = table(new_evidence(judged, before), f"kept-{number}")
        kept = fresh if kept is None else kept.unionByName(fresh)
        got = fresh.groupBy("doc_id").agg(F.count("*").cast("int").alias("got"))
        took = F.when((F.col("lacking") > 0) & (F.col("checked") < F.col("all")), F.least(F.col("lacking"), F.col("all") - F.col("checked"))).otherwise(0)
        state = table(state.join(got, "doc_id", "left").select("doc_id", "all", (F.col("checked") + took).cast("int").alias("checked"), (F.col("lacking") - F.coalesce("got", F.lit(0))).alias("lacking")), f"state-{number}")
    if kept is None:
        kept = placed.limit(0).withColumns({"verification": F.lit(""), "norm": F.lit("")})
    order = Window.partitionBy("doc_id").orderBy(level_rank("type"), "place")
    pages = docs.select("doc_id", page_index("text").alias("pages"))
    paged = kept.join(pages, "doc_id").withColumn("page", find_page(normalized("evidence"), "pages")).withColumn("no", F.row_number().over(order))
    return paged.select("doc_id", "no", "place", "type", "question", "answer", "evidence", "page", "chunk", "verification"), run_summary(docs, candidates, state, n)


def run_summary(docs: DataFrame, candidates: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """(doc_id, generated, checked, kept, summary) of every document."""
    made = candidates.groupBy("doc_id").agg(F.count("*").cast("int").alias("generated"))
    counted = docs.select("doc_id").join(made, "doc_id", "left").join(state.select("doc_id", "checked", (F.lit(n) - F.col("lacking")).alias("kept")), "doc_id", "left").fillna(0, ["generated", "checked", "kept"])
    text = F.format_string("%d of %d questions checked passed verification (%d generated).", "kept", "checked", "generated")
    return counted.withColumn("summary", text)


def find_title(docs: DataFrame, model: Model, table: Table) -> DataFrame:
    """(doc_id, title) of documents (doc_id, text, meta_title): the declared title if the first page holds it and it is
    no file's name, else the model's if the first page holds it, else null."""
    first = F.replace(F.get(F.split("text", SECOND_PAGE, 2), F.lit(0)), F.lit(FIRST_PAGE), F.lit(""))
    rows = docs.select("doc_id", first.alias("first"), F.trim(F.coalesce("meta_title", F.lit(""))).alias("meta")).withColumn("norm", normalized("first"))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    is_file = F.exists(F.array(*map(F.lit, NO_TITLE)), lambda e: F.endswith(F.lower("meta"), e))
    rows = table(rows.withColumn("own", F.when(quote_in_text(normalized("meta"), "norm") & ~is_file, squeezed(F.col("meta")))), "first-pages")
    asked = rows.where("own is null and trim(first) <> ''").select(F.col("doc_id").alias("id"), prompt("Copy the title of the paper whose first page this is.", F.substring("first", 1, FIRST_PAGE_CHARS)).alias("prompt"))
    raw = table(replies(asked, model, "title"), "titles").select(F.col("id").alias("doc_id"), squeezed(F.from_json("raw", "struct<title:string>")["title"]).alias("said"))
    said = F.when(quote_in_text(normalized("said"), "norm", MIN_TITLE_CHARS), F.col("said"))
    return rows.join(raw, "doc_id", "left").select("doc_id", F.coalesce("own", said).alias("title"))


def graded(answers: DataFrame, model: Model) -> DataFrame:
    """(id, verdict, feedback, error) of answers (id, question, reference, evidence, answer) marked against the reference.

    A reply without a verdict is "partly", without feedback an empty text; without a reply both are null."""
    data = {c: F.coalesce(c, F.lit("")) for c in ("question", "reference", "evidence", "answer")}
    raw = replies(answers.select("id", prompt("Mark the answer against the reference: correct, partly or incorrect, and say why in a sentence.", **data).alias("prompt")), model, "grade")
    reply = F.from_json("raw", "struct<verdict:string,feedback:string>")
    read = lambda field, other: F.when(F.col("error").isNull(), F.coalesce(reply[field], F.lit(other))).alias(field)
    return raw.select("id", read("verdict", "partly"), read("feedback", ""), "error")


def resumable(progress: DataFrame, current: DataFrame) -> DataFrame:
    """Sections that need not be asked again: ``progress`` (doc_id, fingerprint, chunk_no) whose text has not changed."""
    return progress.join(current.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_semi").select("doc_id", "chunk_no")
