"""Queries of state that outlives a run: resumed sections, closed windows, replaced state, the inbox as a queue, named files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators.inbox import run_progress
from ..sources import named, sinks, snapshots
from ..streaming import arrivals, progress, queue, resume, settings
from ..streaming.ingest import read_texts
from .bindings import table
from .queries import query

#: Partitions of the streams' state: it holds unfinished documents and the rows of a day.
_PARTITIONS = 8

# --- resumed sections ---------------------------------------------------------


@query
def x3_resumed_sections(spark, d):
    """Three runs over all documents, each broken off: what each has to ask, and what is complete.

    A document has a section for every 4,000 characters and one more.  By the end of run 1 its first doc_id % 3
    sections are answered, by the end of run 2 one more, by the end of run 3 all; before run 2 every seventh text changes."""
    folder = sinks.scratch(spark, "x3")
    text = F.coalesce("text", F.lit(""))
    for run in (1, 2, 3):
        now = F.when(F.lit(run > 1) & (F.col("doc_id") % 7 == 0), F.concat(text, F.lit(" changed"))).otherwise(text)
        docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document"), "doc_id", fingerprint(now).alias("fingerprint"), (F.floor(F.length(text) / 4000) + 1).cast("int").alias("sections"))
        docs = docs.withColumn("run", F.lit(run)).withColumn("seq", F.lit(run * 1_000_000).cast("bigint"))
        answered = F.col("sections") if run == 3 else F.greatest(F.lit(0), F.least("sections", (F.col("doc_id") % 3 + (run - 1)).cast("int")))
        # one pass over the texts: place -1 is the offer, the others are the replies
        rows = docs.withColumn("place", F.explode(F.sequence(F.lit(-1), answered - 1)))
        reply = F.col("place") >= 0
        rows = rows.withColumns({"kind": F.when(reply, "reply").otherwise("offer"), "seq": F.col("seq") + 1 + F.col("place"), "section": F.when(reply, F.col("place")), "answer": F.when(reply, F.concat(F.lit("answer "), F.col("place")))})
        found = resume.advance(rows, folder, partitions=max(_PARTITIONS, spark.sparkContext.defaultParallelism))
    return found.where("kind <> 'kept'").select("run", "kind", "document", "fingerprint", "section", F.size("answers").alias("answers"))


# --- closed windows and late rows ---------------------------------------------

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, value double"


def _arrived(spark, d, name, closing):
    """All events in three arrivals, some of them far too late and some twice; windows are closed after each.

    ``closing``: from the queue to windows; gives the folder and the windows as a stream."""
    folder = sinks.scratch(spark, name)
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    part = F.when(F.col("event_id") % 40 == 0, 3).when(F.col("ts") < "2024-01-12", 1).when(F.col("ts") < "2024-01-22", 2).otherwise(3)
    stream = None
    for arrival in (1, 2, 3):
        rows = events.where(part == arrival)
        arrivals.deliver(rows.unionByName(rows.where("event_id % 25 = 1")), folder)
        arrivals.route(spark, folder, _EVENTS)
        if closing:
            stream = closing(arrivals.queued(spark, folder, _EVENTS))
            arrivals.close(stream, folder, name, partitions=_PARTITIONS)
    return folder, stream


@query
def x4_closed_days(spark, d):
    folder, stream = _arrived(spark, d, "x4", arrivals.daily)
    return arrivals.closed(spark, stream, folder, "x4")


@query
def x5_late_events(spark, d):
    folder, _ = _arrived(spark, d, "x5", None)
    return arrivals.late(spark, folder, _EVENTS)


@query
def x6_closed_sessions(spark, d):
    folder, stream = _arrived(spark, d, "x6", lambda s: arrivals.sessions(s, "6 hours"))
    return arrivals.closed(spark, stream, folder, "x6")


# --- progress -----------------------------------------------------------------


@query
def x7_batch_progress(spark, d):
    """All events in three arrivals, a run for each from one checkpoint; what the log of the three runs says."""
    folder = sinks.scratch(spark, "x7")
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    for run in (1, 2, 3):
        arrivals.deliver(events.where(F.col("event_id") % 3 == run - 1), folder)
        name = f"arrivals-{folder.rsplit('/', 1)[-1]}"
        with progress.ProgressLog(spark, f"{folder}/log", name, str(run), 3):
            stream = spark.readStream.schema(_EVENTS).parquet(f"{folder}/arrivals").groupBy("user_id").count()
            write = stream.writeStream.queryName(name).outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={n}"))
            with settings(spark, {"spark.sql.shuffle.partitions": str(_PARTITIONS)}):
                write.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    log = progress.lines(spark, f"{folder}/log")
    return run_progress(log).join(log.select("run", "line_no", "rows"), ["run", "line_no"])


# --- replaced state -----------------------------------------------------------

_SETTINGS = "user_id bigint, model string, num_questions int"


@query
def q93_settings_replaced(spark, d):
    """Settings of every user, written, changed by two runs from what is stored, with a write between them that breaks off."""
    path = sinks.scratch(spark, "q93")
    users = table(spark, d, "events").groupBy("user_id").agg((F.max("event_id") % 50 + 1).cast("int").alias("num_questions"))
    snapshots.write(users.select("user_id", F.lit("small").alias("model"), "num_questions"), path)
    stored = snapshots.read(spark, path, _SETTINGS)
    snapshots.write(stored.withColumn("model", F.when(F.col("user_id") % 2 == 0, "large").otherwise(F.col("model"))), path)
    broken = snapshots.begin(spark, path)
    stored.where("user_id % 5 = 0").withColumn("model", F.lit("broken")).write.parquet(f"{path}/v{broken}")  # never committed
    stored = snapshots.read(spark, path, _SETTINGS)
    snapshots.write(stored.withColumn("num_questions", F.when(F.col("user_id") % 3 == 0, F.greatest(F.lit(1), F.least(F.lit(50), F.col("num_questions") * 2))).otherwise(F.col("num_questions"))), path)
    return snapshots.read(spark, path, _SETTINGS).withColumn("version", F.lit(snapshots.version(spark, path)))


# --- the inbox as a queue -----------------------------------------------------


def _items(spark, d, bad):
    """Benchmark items as files; those for which ``bad`` holds are not UTF-8."""
    name = F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit(".html"))
    body = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, d, "benchmark").select("item_id", name.alias("name"), F.when(bad, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body).alias("content"))


@query
def q94_queue_ledger(spark, d):
    """Three runs over an inbox of all items: every fifth cannot be read at first, every tenth is mended before the second run."""
    root = sinks.scratch(spark, "q94")
    inbox, library = f"{root}/inbox", f"{root}/library"
    n = F.col("item_number")
    numbered = lambda df: df.withColumn("item_number", F.regexp_extract("name", r"(\d+)\.html$", 1).cast("bigint"))
    items = _items(spark, d, F.regexp_extract(F.col("item_id").cast("string"), r"(\d+)$", 1).cast("bigint") % 5 == 0)
    named.write_named(items, inbox)
    read = lambda files: read_texts(files).join(files.select("name", "stem"), "stem").select("name", "text", "error")
    queue.process(spark, inbox, library, f"{root}/state", read)
    named.write_named(numbered(_items(spark, d, F.lit(False))).where(n % 10 == 0), inbox)
    queue.process(spark, inbox, library, f"{root}/state", read)
    queue.process(spark, inbox, library, f"{root}/state", read)
    places = [named.named_files(spark, folder, contents=False).select("name", F.lit(place).alias("place")) for folder, place in ((inbox, "inbox"), (library, "library"))]
    at = places[0].unionByName(places[1])
    texts = queue.texts(spark, f"{root}/state").select("name", F.length("text").alias("chars"))
    return queue.ledger(spark, f"{root}/state").join(at, "name", "full").join(texts, "name", "left").select("name", "status", "why", "tries", "place", "chars")


# --- named files --------------------------------------------------------------


@query
def q95_named_files(spark, d):
    """Reader pages of all benchmark items under names of their own: listed by a pattern, by name, with sizes and contents."""
    folder = sinks.scratch(spark, "q95")
    items = _items(spark, d, F.lit(False))
    named.write_named(items, folder)
    named.write_named(items.select(F.regexp_replace("name", "html$", "txt").alias("name"), "content"), folder)
    found = named.named_files(spark, folder, pattern="*.html")
    return found.select("name", "size_bytes", F.sha1("content").alias("sha1")).orderBy("name")


SQL = {
    "x3_resumed_sections": """
WITH d AS (
  SELECT doc_id, doc_id::VARCHAR AS document, doc_id % 3 AS k, 1 + length(coalesce(text, '')) // 4000 AS s, doc_id % 7 = 0 AS changed,
    substr(sha1(coalesce(text, '')), 1, 16) AS f1, substr(sha1(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' changed' ELSE '' END), 1, 16) AS f2
  FROM documents
), before AS (
  SELECT *, 1 AS run, f1 AS f, 0 AS had, k AS answered FROM d
  UNION ALL SELECT *, 2, f2, CASE WHEN changed OR k >= s THEN 0 ELSE k END, k + 1 FROM d
  UNION ALL SELECT *, 3, f2, CASE WHEN k + 1 >= s THEN 0 ELSE k + 1 END, s FROM d
)
SELECT run, 'ask' AS kind, document, f AS fingerprint, unnest(range(had, s))::INT AS section, NULL::INT AS answers FROM before
UNION ALL
SELECT run, 'complete', document, f, NULL, s::INT FROM before WHERE answered >= s""",
    "q93_settings_replaced": """
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'large' ELSE 'small' END AS model,
  (CASE WHEN user_id % 3 = 0 THEN greatest(1, least(50, n * 2)) ELSE n END)::INT AS num_questions, 4 AS version
FROM (SELECT user_id, max(event_id) % 50 + 1 AS n FROM events GROUP BY user_id)""",
    "q94_queue_ledger": """
WITH i AS (
  SELECT 'item-' || item_id || '.html' AS name, regexp_extract(item_id::VARCHAR, '(\\d+)$', 1)::BIGINT AS n, length(coalesce(text, '')) AS c FROM benchmark
)
SELECT name, CASE WHEN n % 5 = 0 AND n % 10 <> 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n % 5 = 0 AND n % 10 <> 0 THEN 'not UTF-8' END AS why,
  CASE WHEN n % 5 <> 0 THEN 1 WHEN n % 10 = 0 THEN 2 ELSE 3 END AS tries, CASE WHEN n % 5 = 0 AND n % 10 <> 0 THEN 'inbox' ELSE 'library' END AS place,
  CASE WHEN n % 5 = 0 AND n % 10 <> 0 THEN NULL ELSE c END AS chars
FROM i""",
    "q95_named_files": "SELECT 'item-' || item_id || '.html' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS size_bytes, sha1(coalesce(text, '')) AS sha1 FROM benchmark",
}

SQL["x7_batch_progress"] = """
WITH n AS (SELECT event_id % 3 + 1 AS run, count(*) AS rows FROM events GROUP BY 1)
SELECT run::VARCHAR AS run, line_no::INT AS line_no, ['paper', 'section', 'done'][line_no] AS kind, 1::BIGINT AS paper_no, 0::BIGINT AS dropped,
  CASE WHEN line_no = 3 THEN 1 ELSE 0 END::BIGINT AS done, CASE line_no WHEN 2 THEN run / 3 * 0.6 WHEN 3 THEN 1.0 END::DOUBLE AS fraction, CASE WHEN line_no = 2 THEN rows END AS rows
FROM n, (VALUES (1), (2), (3)) AS l(line_no)"""

_ARRIVED = """a AS (
  SELECT event_id, ts, user_id, value, CASE WHEN event_id % 40 = 0 THEN 3 WHEN ts < TIMESTAMP '2024-01-12' THEN 1 WHEN ts < TIMESTAMP '2024-01-22' THEN 2 ELSE 3 END AS part FROM events
), high AS (SELECT max(ts) AS high FROM a WHERE part < 3), timely AS (
  SELECT a.* FROM a, high WHERE part < 3 OR high IS NULL OR ts > date_trunc('milliseconds', high) - INTERVAL 1 DAY
), mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS mark FROM timely)"""

SQL["x4_closed_days"] = f"WITH {_ARRIVED} SELECT ts::DATE AS day, count(*) AS events, max(value) AS highest FROM timely, mark GROUP BY ts::DATE, mark HAVING ts::DATE + INTERVAL 1 DAY <= mark"
SQL["x5_late_events"] = f"""WITH {_ARRIVED}, late AS (SELECT a.event_id, a.ts, a.user_id, a.value FROM a, high WHERE part = 3 AND ts <= date_trunc('milliseconds', high) - INTERVAL 1 DAY)
SELECT * FROM late UNION ALL SELECT * FROM late WHERE event_id % 25 = 1"""
SQL["x6_closed_sessions"] = f"""WITH {_ARRIVED}, g AS (
  SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM timely WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS events FROM s, mark GROUP BY user_id, n, mark HAVING max(ts) + INTERVAL 6 HOUR <= mark"""
