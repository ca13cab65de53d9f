from datetime import date, datetime


from studyspark.operators import history as h
from studyspark.operators import library

SCHEMA = "paper string, question string, key string, seq bigint, at timestamp_ntz, correct boolean"


def attempts(spark, *rows):
    return spark.createDataFrame([(p, q, f"{p}::{q}", i, datetime.fromisoformat(at), ok) for i, (p, q, at, ok) in enumerate(rows)], SCHEMA)


def test_review_pile_is_by_last_attempt_and_order_of_appending(spark):
    log = attempts(spark, ("A", "q", "2025-09-01T08:00:00", False), ("B", "q", "2025-08-01T08:00:00", False))
    assert [r.paper for r in h.review_pile(log).collect()] == ["B", "A"]
    log = attempts(spark, ("A", "q", "2025-09-01T08:00:00", False), ("B", "q", "2025-08-01T08:00:00", False), ("A", "q", "2025-07-01T08:00:00", True))
    assert [r.paper for r in h.review_pile(log).collect()] == ["B"]  # appended last, though earlier in time


def test_ties_in_time_keep_the_order_of_appending(spark):
    log = attempts(spark, ("Z", "q", "2025-01-01T00:00:00", False), ("A", "q", "2025-01-01T00:00:00", False))
    assert [r.paper for r in h.review_pile(log).collect()] == ["Z", "A"]


def test_empty_history(spark):
    log = attempts(spark)
    assert h.review_pile(log).count() == 0 and h.daily(log).count() == 0
    assert tuple(h.overall(log).first()) == (0, 0, 0, 0)
    stored = spark.createDataFrame([("k", "p", "q", [])], "key string, paper string, question string, attempts array<struct<at:timestamp_ntz,correct:boolean>>")
    assert h.flatten(stored).count() == 0


def test_reading_days(spark):
    log = attempts(spark, ("A", "q", "2025-09-20T10:00:00", True), ("A", "r", "2025-09-21T10:00:00", False))
    reads = spark.createDataFrame([("Two", datetime(2025, 9, 20, 9), 1), ("One", datetime(2025, 9, 20, 8), 0), ("Old", datetime(2020, 1, 1), 2), ("None", None, 3)], "title string, read_at timestamp_ntz, seq int")
    got = {str(r.day): (r.read, r.answered, r.correct) for r in h.reading_days(log, reads, date(2025, 9, 21), 30).collect()}
    assert got == {"2025-09-20": (["One", "Two"], 1, 1), "2025-09-21": ([], 1, 0)}


def days(spark, *rows):
    return spark.createDataFrame([(date.fromisoformat(d), ["x"] * n, a, 0) for d, n, a in rows], "day date, read array<string>, answered bigint, correct bigint")


def test_streak(spark):
    now = date(2025, 3, 10)
    run = lambda *d: h.streak(days(spark, *d), now).first().streak
    assert run(("2025-03-10", 1, 0), ("2025-03-09", 0, 2), ("2025-03-07", 1, 0)) == 2
    assert run(("2025-03-09", 1, 0), ("2025-03-08", 1, 0)) == 2
    assert run(("2025-03-08", 1, 0)) == 0 and run() == 0
    assert run(("2025-03-10", 0, 0), ("2025-03-09", 1, 0)) == 1


def test_calendar_is_dense(spark):
    got = h.calendar(days(spark, ("2025-03-09", 1, 1)), date(2025, 3, 8), date(2025, 3, 11), date(2025, 3, 10)).orderBy("day").collect()
    assert [(r.n_read, r.answered, r.level, r.when) for r in got] == [(0, 0, 0, "past"), (1, 1, 2, "past"), (0, 0, 0, "today"), (0, 0, 0, "future")]


def test_sticking_points(spark):
    log = attempts(spark, *[("A", "b", "2025-01-01T00:00:00", False)] * 2, *[("A", "a", "2025-01-01T00:00:00", False)] * 2, ("B", "c", "2025-01-01T00:00:00", False), ("A", "d", "2025-01-01T00:00:00", False), ("A", "d", "2025-01-02T00:00:00", True))
    titles = spark.createDataFrame([("A", "Title A")], "paper string, title string")
    assert [tuple(r) for r in h.sticking_points(log, titles).collect()] == [("a", "Title A", 2), ("b", "Title A", 2), ("c", "B", 1)]
    assert h.sticking_points(log, titles, 1).count() == 1


def test_marks_last_write_wins(spark):
    log = spark.createDataFrame([("A", 1, datetime(2025, 1, 1)), ("A", 2, None), ("B", 1, None), ("B", 2, datetime(2025, 1, 2))], "paper string, seq int, read_at timestamp_ntz")
    assert [r.paper for r in h.marked_reads(log).collect()] == ["B"]


def shelf(spark, *rows):
    return spark.createDataFrame(rows, "paper string, title string, total int, seen int, review int, last_studied string, read_at string, added int")


def test_suggest(spark):
    pick = lambda *rows: [r.paper for r in library.suggest(shelf(spark, *rows)).collect()]
    quiz, unread, stale, fresh = ("quiz", "Q", 3, 0, 0, None, None, 1), ("unread", "U", 0, 0, 0, None, None, 2), ("stale", "S", 3, 1, 0, "2025-01-01", None, 3), ("fresh", "F", 3, 2, 0, "2025-02-01", None, 4)
    assert pick(fresh, stale, unread, quiz) == ["quiz"]
    assert pick(fresh, stale, unread) == ["unread"] and pick(fresh, stale) == ["stale"] and pick() == []
    assert pick(("only", "O", 0, 0, 0, None, "2025", 1)) == ["only"]
    opened = spark.createDataFrame([("quiz",)], "paper string")
    other = lambda *rows: [r.paper for r in library.suggest(shelf(spark, *rows), other_than=opened).collect()]
    assert other(fresh, unread, quiz) == ["unread"] and other(quiz) == []


def test_search_and_recent(spark):
    rows = shelf(spark, ("a", "Melting ICE", 1, 1, 1, "x", None, 1), ("b", "Ice cores", 1, 1, 0, "y", "2025", 2), ("c", "Sand", 1, 0, 0, None, None, 3))
    names = lambda df: sorted(r.paper for r in df.collect())
    assert names(library.search(rows, " ice ")) == ["a", "b"] and names(library.search(rows, "ice", "unread")) == ["a"]
    assert names(library.search(rows, "", "review")) == ["a"] and names(library.search(rows)) == ["a", "b", "c"]
    assert [r.paper for r in library.recent(rows).collect()] == ["b", "a"]
    assert tuple(library.totals(rows).first()) == (3, 2, 3, 1)


def test_counts_and_orphans(spark):
    log = attempts(spark, ("A", "q1", "2025-01-01T00:00:00", False), ("A", "q1", "2025-01-02T00:00:00", True), ("A", "gone", "2025-01-03T00:00:00", False))
    current = spark.createDataFrame([("A", "q1", "A::q1", 1), ("A", "q2", "A::q2", 2)], "paper string, question string, key string, q_seq int")
    r = library.paper_counts(current, log).first()
    assert (r.total, r.seen, r.correct, r.review) == (2, 1, 1, 0)
    assert h.review_items(log, current).count() == 0 and h.review_pile(log).count() == 1
    flags = {r.key: (r.attempts, r.needs_review) for r in h.needs_review(current.drop("q_seq"), log).collect()}
    assert flags == {"A::q1": (2, False), "A::q2": (0, False)}
