"""State that outlives a run: resumed sections, closed windows, replaced state, the inbox as a queue, named files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from studyspark.sources import named, snapshots
from studyspark.streaming import arrivals, queue, resume
from studyspark.streaming.ingest import read_texts

NAMES = [c.strip().split(" ")[0] for c in resume.EVENTS.split(",")]


def events(spark, *rows):
    return spark.createDataFrame([dict(zip(NAMES, r, strict=True)) for r in rows], resume.EVENTS)


def offer(doc, run, seq, text, sections):
    return (doc, run, seq, "offer", text, sections, None, None)


def reply(doc, run, seq, text, sections, section):
    return (doc, run, seq, "reply", text, sections, section, f"{text}-{section}")


def asked(found, run):
    return sorted((r.document, r.fingerprint, r.section) for r in resume.to_ask(found, run).collect())


def test_finished_sections_are_not_asked_again_after_restarts(spark, tmp_path):
    folder = str(tmp_path / "r")
    found = resume.advance(events(spark, offer("a", 1, 1, "f", 3), reply("a", 1, 2, "f", 3, 0), offer("b", 1, 1, "g", 2), reply("b", 1, 2, "g", 2, 1), offer("c", 1, 1, "h", 1)), folder)
    assert asked(found, 1) == [("a", "f", 0), ("a", "f", 1), ("a", "f", 2), ("b", "g", 0), ("b", "g", 1), ("c", "h", 0)]
    # run 2: b has another text; a reply to the old one and a repeated reply count for nothing
    found = resume.advance(events(spark, offer("a", 2, 3, "f", 3), reply("a", 2, 4, "f", 3, 0), reply("a", 2, 5, "f", 3, 2), offer("b", 2, 3, "new", 2), reply("b", 2, 4, "g", 2, 0)), folder)
    assert asked(found, 2) == [("a", "f", 1), ("a", "f", 2), ("b", "new", 0), ("b", "new", 1)]
    found = resume.advance(events(spark, offer("a", 3, 6, "f", 3), reply("a", 3, 7, "f", 3, 1), offer("b", 3, 6, "new", 2)), folder)
    assert asked(found, 3) == [("a", "f", 1), ("b", "new", 0), ("b", "new", 1)]
    (done,) = found.where("kind = 'complete'").collect()
    assert (done.document, done.run, done.answers) == ("a", 3, {0: "f-0", 1: "f-1", 2: "f-2"})
    # what is complete has left the state: a new offer starts over
    assert asked(resume.advance(events(spark, offer("a", 4, 8, "f", 3)), folder), 4) == [("a", "f", 0), ("a", "f", 1), ("a", "f", 2)]


def test_a_document_costs_two_calls_to_the_store():
    """Reading and writing a document's progress is one round trip each, however many sections it has."""

    class Store:
        def __init__(self):
            self.value, self.calls = None, 0

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

    store, sections = Store(), resume.Sections()
    sections.init(store)
    row = lambda *r: Row(**dict(zip(NAMES, r, strict=True)))
    first = [row(*offer("a", 1, 0, "f", 9)), *(row(*reply("a", 1, 1 + i, "f", 9, i)) for i in range(8))]
    assert len(list(sections.handleInputRows("a", iter(first), None))) == 9 + 8 and store.calls == 2
    last = list(sections.handleInputRows("a", iter([row(*offer("a", 2, 9, "f", 9)), row(*reply("a", 2, 10, "f", 9, 8))]), None))
    assert [(r.kind, r.section) for r in last] == [("ask", 8), ("kept", 8), ("complete", None)] and len(last[2].answers) == 9
    assert store.calls == 4 and store.value is None


def test_progress_expires(spark, tmp_path):
    folder = str(tmp_path / "r")
    resume.advance(events(spark, offer("a", 1, 1, "f", 2), reply("a", 1, 2, "f", 2, 0)), folder, expiry_ms=1)
    assert asked(resume.advance(events(spark, offer("a", 2, 3, "f", 2)), folder, expiry_ms=1), 2) == [("a", "f", 0), ("a", "f", 1)]


def test_settings_of_the_session_stay_as_they_were(spark):
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    with resume.state_settings(spark):
        assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "false"
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before


EVENTS = "event_id bigint, ts timestamp, user_id bigint, value double"


def at(day, hour=0):
    return datetime(2025, 1, 1) + timedelta(days=day, hours=hour)


def deliver(spark, folder, rows):
    arrivals.deliver(spark.createDataFrame(rows, EVENTS), folder)
    arrivals.route(spark, folder, EVENTS)


def test_late_rows_are_set_apart_and_the_rest_is_counted_once(spark, tmp_path):
    folder = str(tmp_path / "s")
    stream = lambda: arrivals.daily(arrivals.queued(spark, folder, EVENTS))
    deliver(spark, folder, [(i, at(0, i % 24), 1, float(i)) for i in range(24)] * 2 + [(100, at(3), 1, 0.0)])
    arrivals.close(stream(), folder, "days")
    days = lambda: {str(r.day): r.events for r in arrivals.closed(spark, stream(), folder, "days").collect()}
    assert days() == {"2025-01-01": 24}  # every event came twice and counts once
    deliver(spark, folder, [(200, at(0), 2, 1.0), (201, at(2), 2, 1.0), (202, at(2, 5), 2, 1.0), (205, at(2, 6), 2, 1.0), (203, at(6), 2, 1.0), (204, None, 2, 1.0)])
    arrivals.close(stream(), folder, "days")
    assert [r.event_id for r in arrivals.late(spark, folder, EVENTS).orderBy("event_id").collect()] == [200, 201]
    assert days() == {"2025-01-01": 24, "2025-01-03": 2, "2025-01-04": 1}
    # with nothing new nothing is put out again
    arrivals.close(stream(), folder, "days")
    assert days() == {"2025-01-01": 24, "2025-01-03": 2, "2025-01-04": 1}


def test_state_holds_the_delay_and_not_the_stream(spark, tmp_path):
    folder, sizes = str(tmp_path / "s"), []
    for week in range(4):
        deliver(spark, folder, [(week * 10_000 + i, at(week * 7 + i / 100), i % 5, 0.0) for i in range(700)])
        query = arrivals.close(arrivals.daily(arrivals.queued(spark, folder, EVENTS)), folder, "days")
        sizes.append(max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress[-1:]))
    assert max(sizes) <= sizes[0] + 5 < 400  # a day of 100 events twice, not four weeks of them


def test_sliding_windows_and_sessions(spark, tmp_path):
    folder = str(tmp_path / "s")
    deliver(spark, folder, [(1, at(0, 1), 7, 0.0), (2, at(0, 2), 7, 0.0), (3, at(0, 9), 7, 0.0), (4, at(5), 8, 0.0)])
    found = {}
    for name, make in (("slide", lambda s: arrivals.sliding(s, "2 hours", "1 hour")), ("sessions", lambda s: arrivals.sessions(s, "3 hours"))):
        stream = lambda: make(arrivals.queued(spark, folder, EVENTS))  # noqa: B023, E731
        arrivals.close(stream(), folder, name)
        found[name] = arrivals.closed(spark, stream(), folder, name).collect()
    assert sorted((r.began.hour, r.events) for r in found["slide"]) == [(0, 1), (1, 2), (2, 1), (8, 1), (9, 1)]
    assert sorted((r.user_id, r.began.hour, r.ended.hour, r.events) for r in found["sessions"]) == [(7, 1, 5, 2), (7, 9, 12, 1)]


def test_a_broken_write_leaves_the_old_state(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "id int, v string"
    one = lambda v: spark.createDataFrame([(1, v)], schema)
    assert snapshots.version(spark, path) is None and snapshots.read(spark, path, schema).count() == 0
    assert snapshots.write(one("a"), path) == 1
    with pytest.raises(Exception, match="broken"):
        snapshots.write(one("b").select("id", F.raise_error(F.lit("broken")).cast("string").alias("v")), path)
    assert [tuple(r) for r in snapshots.read(spark, path, schema).collect()] == [(1, "a")]
    number = snapshots.begin(spark, path)
    one("c").write.parquet(f"{path}/v{number}")
    assert snapshots.read(spark, path, schema).first().v == "a"  # all is there, but the pointer
    assert snapshots.write(snapshots.read(spark, path, schema).withColumn("v", F.concat("v", F.lit("!"))), path) > number
    assert snapshots.read(spark, path, schema).first().v == "a!"
    snapshots.write(one("d"), path)
    assert 1 not in snapshots.versions(spark, path) and snapshots.read(spark, path, schema).first().v == "d"


def test_two_writers_take_different_numbers(spark, tmp_path):
    path = str(tmp_path / "s")
    assert len({snapshots.begin(spark, path) for _ in range(3)}) == 3


def test_what_was_read_leaves_the_inbox_once_and_what_failed_comes_again(spark, tmp_path):
    inbox, library, state = (str(tmp_path / n) for n in ("inbox", "library", "state"))
    rows = [("a.html", b"fine"), ("b.html", b"\xff"), ("c.txt", b"no paper"), ("d.pdf", b"%PDF")]
    named.write_named(spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary"), inbox)
    names = lambda folder: [r.name for r in named.named_files(spark, folder, contents=False).orderBy("name").collect()]
    told = lambda: {r.name: (r.status, r.tries) for r in queue.ledger(spark, state).collect()}
    seen = []

    def read(files):
        found = files.select("name").collect()
        seen.append(sorted(r.name for r in found))
        return read_texts(files).join(files.select("name", "stem"), "stem").select("name", "text", "error")

    assert queue.process(spark, inbox, library, state, read) == 1
    assert names(inbox) == ["b.html", "c.txt"] and names(library) == ["a.html", "d.pdf"]
    assert told() == {"a.html": ("done", 1), "b.html": ("failed", 1), "d.pdf": ("done", 1)}
    queue.process(spark, inbox, library, state, read)
    assert seen == [["a.html", "b.html", "d.pdf"], ["b.html"]] and told()["b.html"] == ("failed", 2)
    (tmp_path / "inbox" / "b.html").write_bytes(b"mended")
    queue.process(spark, inbox, library, state, read)
    assert names(inbox) == ["c.txt"] and told()["b.html"] == ("done", 3)
    assert {r.name: r.text for r in queue.texts(spark, state).collect()} == {"a.html": "fine", "b.html": "mended", "d.pdf": "%PDF"}


def test_a_run_that_breaks_while_reading_changes_nothing_and_one_that_breaks_before_moving_is_finished(spark, tmp_path):
    inbox, library, state = (str(tmp_path / n) for n in ("inbox", "library", "state"))
    named.write_named(spark.createDataFrame([("a.html", bytearray(b"x"))], "name string, content binary"), inbox)
    broken = lambda files: files.select("name", F.raise_error(F.lit("broken")).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    with pytest.raises(Exception, match="broken"):
        queue.process(spark, inbox, library, state, broken)
    assert queue.ledger(spark, state).count() == 0 and queue.texts(spark, state).count() == 0
    # as if the driver died between the ledger and the move
    number = snapshots.begin(spark, f"{state}/ledger")
    spark.createDataFrame([("a.html", "done", None, 1, number)], queue.LEDGER).write.parquet(f"{state}/ledger/v{number}")
    snapshots.commit(spark, f"{state}/ledger", number)
    assert queue.move_done(spark, inbox, library, state) == 1 and queue.move_done(spark, inbox, library, state) == 0
    assert [r.name for r in named.named_files(spark, library).collect()] == ["a.html"]


def test_named_files_come_back_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = {f"f {i} é.md": rng.randbytes(rng.randint(0, 5000)) for i in range(60)}
    folder = str(tmp_path / "n")
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in rows.items()], "name string, content binary")
    named.write_named(df.repartition(5), folder)
    named.write_named(df.limit(1).select("name", F.lit(b"new").alias("content")), folder)
    (tmp_path / "n" / ".hidden").write_text("x")
    (tmp_path / "n" / "sub").mkdir()
    got = {r.name: bytes(r.content) for r in named.named_files(spark, folder).collect()}
    assert got == rows | {df.limit(1).first()["name"]: b"new"}
    assert named.named_files(spark, folder, pattern="f 1*").count() == 11
    assert named.named_files(spark, folder, contents=False).where("content is not null").count() == 0
    assert named.named_files(spark, str(tmp_path / "missing")).count() == 0
    with pytest.raises(Exception, match="not the name of a file"):
        named.write_named(spark.createDataFrame([("../up", bytearray(b"x"))], "name string, content binary"), folder)
