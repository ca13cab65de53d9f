import json
from datetime import datetime

import pytest

from studyspark.functions.questions import QUESTION_TYPE
from studyspark.operators import generation, inbox
from studyspark.operators.settings import Settings
from studyspark.sources import files, sinks
from studyspark.sources.fetch import FetchError, Reply, fetch_with_retry, pages, wait_after
from studyspark.sources.model import ModelLooped, ask, error_kind, replies
from studyspark.streaming import ingest


def test_inbox_listing(spark, tmp_path):
    assert files.inbox(spark, str(tmp_path / "missing")).count() == 0
    for name in ("b_two.pdf", "a-one.html", "c.txt"):
        (tmp_path / name).write_text("x" * 10)
    got = files.inbox(spark, str(tmp_path)).collect()
    assert [(r.name, r.kind, r.title, r.size_bytes, r.size_mb) for r in got] == [("a-one.html", "article", "a one", 10, 0.1), ("b_two.pdf", "pdf", "b two", 10, 0.1)]


def test_articles_and_question_files(spark, tmp_path):
    (tmp_path / "ice.html").write_text("<title>Ice | Site</title><p>" + "A sentence of the article that is long enough to keep. " * 2 + "</p>")
    r = files.articles(spark, str(tmp_path)).first()
    assert r.title == "Ice" and r.text.startswith("A sentence")
    (tmp_path / "ice_questions.md").write_text("# Study Questions: Ice\n\n## Q1 (overview)\nWhy?\n\n**Answer:** so\n\n## Notes\nmine\n")
    r = files.question_files(spark, str(tmp_path)).first()
    assert (r.stem, r.title, r.notes, r.questions[0].type) == ("ice", "Ice", "mine", "overview")


def test_state_is_strict_for_history_only(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"key":"k","paper":"p","question":"q","attempts":[{"at":"2025-01-01T00:00:00","correct":true}]}\n')
    assert files.history(spark, str(tmp_path / "h.json")).first().attempts[0].correct is True
    (tmp_path / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017
        files.history(spark, str(tmp_path / "bad.json")).collect()
    assert files.state(spark, str(tmp_path / "bad.json"), "a int").count() == 0
    (tmp_path / "log.txt").write_text("[2025-01-01 02:00:00] started\nTraceback\n")
    assert [tuple(r) for r in files.log_lines(spark, str(tmp_path / "log.txt")).collect()] == [(datetime(2025, 1, 1, 2), "started")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", "q", "k", 1, datetime(2025, 1, 1), True)], "paper string, question string, key string, seq bigint, at timestamp_ntz, correct boolean")
    for _ in range(2):
        sinks.append_attempts(rows, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    old = spark.createDataFrame([("s", "# T\n\n## Notes\nkeep me\n"), ("other", "# O\n")], "stem string, md string")
    new = spark.createDataFrame([("s", "New", [("overview", "q", "a", "", None)], None)], f"stem string, title string, questions array<{QUESTION_TYPE}>, note string")
    got = {r.stem: r.md for r in sinks.upsert_questions(new, old).collect()}
    assert got["other"] == "# O\n" and "# Study Questions: New" in got["s"] and got["s"].endswith("## Notes\nkeep me\n")
    sinks.write_files(spark.createDataFrame(list(got.items()), "stem string, md string"), str(tmp_path / "f"))
    assert (tmp_path / "f" / "stem=s").is_dir()
    bodies = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"<html"),)], "body binary")
    assert sinks.pdf_only(bodies).count() == 1


def test_retry_policy():
    waits, tries = [], iter([Reply(429, {"Retry-After": "90"}), Reply(404), Reply(200, {}, b"x")])
    assert fetch_with_retry(lambda u: next(tries), "u", sleep=waits.append).body == b"x" and waits == [30, 6]
    assert wait_after(Reply(503), 2) == 10 and wait_after(Reply(429, {"retry-after": "Wed, 1 Jan"}), 1) == 5
    with pytest.raises(FetchError) as e:
        fetch_with_retry(lambda u: Reply(429), "u", sleep=waits.append)
    assert e.value.status == 429

    def broken(url):
        raise OSError("down")

    with pytest.raises(FetchError, match="down"):
        fetch_with_retry(broken, "u", sleep=waits.append)


def test_fetched_pages_isolate_failures(spark):
    got = {r.url: (r.status, r.error) for r in pages(spark.createDataFrame([("a",), ("b",)], "url string"), lambda u: Reply(200 if u == "a" else 404), sleep=lambda s: None).collect()}
    assert got == {"a": (200, None), "b": (404, "status 404")}


def test_model_retry_and_errors(spark):
    said = iter(["nonsense", '{"a": 1}'])
    assert ask(lambda t, p: next(said), "x", "p", json.loads) == {"a": 1}
    with pytest.raises(ValueError):
        ask(lambda t, p: "no", "x", "p", json.loads)

    def looped(task, prompt):
        raise ModelLooped("again and again")

    with pytest.raises(ModelLooped):
        ask(looped, "x", "p", json.loads)
    errors = [(404, "", "missing"), (None, "Timed out while loading", "loading"), (200, "repeat", "looped"), (500, "x", "crashed"), (None, "x", "other"), (500, None, "crashed"), (None, None, "other")]
    rows = spark.createDataFrame(errors, "status int, message string, want string").select("want", error_kind("status", "message").alias("got")).collect()
    assert all(r.got == r.want for r in rows)
    df = spark.createDataFrame([(1, "p")], "id int, prompt string")
    r = replies(df, lambda t, p: "bad", "x").first()
    assert r.raw == "bad" and r.error
    r = replies(df, lambda t, p: (_ for _ in ()).throw(ModelLooped("again")), "x").first()
    assert r.raw is None and r.error == "again"


def test_sections_done_are_not_asked_again(spark):
    progress = spark.createDataFrame([(1, "f1", 0), (1, "f1", 1), (2, "old", 0)], "doc_id int, fingerprint string, chunk_no int")
    current = spark.createDataFrame([(1, "f1"), (2, "new")], "doc_id int, fingerprint string")
    assert sorted(map(tuple, generation.resumable(progress, current).collect())) == [(1, 0), (1, 1)]


def test_settings():
    assert Settings.of({"num_questions": 999}).num_questions == 50 and Settings.of({"num_questions": 0}).num_questions == 1
    assert Settings.of({"num_questions": True, "guidance": 3, "model": "m"}) == Settings(model="m")
    assert Settings.of("broken") == Settings()
    assert Settings.of({"guidance": "g"}).changed({"num_questions": 5, "model": 1, "other": 2}) == Settings(num_questions=5, guidance="g")


def test_inbox_logic(spark):
    offered = spark.createDataFrame([(1, "new.pdf", True), (2, "new.pdf", True), (3, "queued.PDF", True), (4, "done.pdf", True), (5, "x.txt", True), (6, "gone.pdf", False)], "seq int, name string, is_file boolean")
    queued, done = spark.createDataFrame([("queued.PDF",)], "name string"), spark.createDataFrame([("done.pdf",)], "name string")
    got = {r.seq: r.why for r in inbox.add_papers(offered, queued, done).collect()}
    assert got == {1: None, 2: "already in the inbox", 3: "already in the inbox", 4: "already processed", 5: "not a PDF", 6: "not a PDF"}
    names = spark.createDataFrame([("b.pdf",), ("a.html",), ("c.txt",), ("d.pdf",)], "name string")
    have = spark.createDataFrame([("d",)], "stem string")
    assert [r.name for r in inbox.pending(names, have).collect()] == ["a.html", "b.pdf"]
    assert [r.name for r in inbox.pending(names, have, names.where("name = 'b.pdf'")).collect()] == ["b.pdf"]
    assert inbox.pending(names, have, names.limit(0)).count() == 2
    bad = spark.createDataFrame([("../x.pdf",), ("/etc/x.pdf",), ("x.txt",), ("x.pdf",)], "name string")
    assert [r.ok for r in inbox.removable(bad).collect()] == [False, False, False, True]
    assert [r.stem for r in inbox.shelve(names, have).orderBy("stem").collect()] == ["a", "b", "c"]
    texts = spark.createDataFrame([("  ", "x" * 600), ("Short", "y")], "title string, text string")
    assert [(r.title, r.name) for r in inbox.pasted(texts).collect()] == [("Pasted article", "pasted-Pasted-article.html")]


def test_progress(spark):
    log = ["Found 2 papers", "[2025-01-01 02:00:00] Processing a.pdf...", "  section 1/2...", "dropped: x", "dropped: y", "3 of 5 questions checked passed", "Done. 3", "Processing b.html...", "dropped: z", "ERROR: no"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(log)], "run int, line_no int, line string")
    got = inbox.run_progress(lines).orderBy("line_no").collect()
    assert [r.kind for r in got] == ["found", "paper", "section", "dropped", "dropped", "passed", "done", "paper", "dropped", "error"]
    assert [r.dropped for r in got][3:] == [1, 2, 2, 2, 0, 1, 1] and [r.done for r in got][-1] == 1 and got[2].fraction == 0.3


def test_stream_ingest_is_idempotent(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.pdf").write_bytes(b"text a")
    (box / "bad.html").write_bytes(b"\xff\xfe\xfa")
    run = lambda: ingest.ingest(ingest.new_files(spark, str(box)), ingest.read_texts, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    run()
    run()
    (box / "b.pdf").write_bytes(b"text b")
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("stem").collect()
    assert [(r.stem, r.text) for r in got] == [("a", "text a"), ("b", "text b")]
    assert [r.stem for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["bad"]
