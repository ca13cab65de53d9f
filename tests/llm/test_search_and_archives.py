import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyspark.llm import registry, topk_mtree, warc


def brute(rows, queries, k):
    out = {}
    for qid, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != qid and len(v) == len(q))
        out[qid] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("dim, spread, n", [(1, 2, 400), (3, 1, 600), (8, 40, 500), (2, 0, 300)])
def test_trees_against_brute_force_with_ties(spark, dim, spread, n):
    rng = random.Random(dim)
    rows = [(i * 3 - 50, [rng.randint(-spread, spread) for _ in range(dim)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    queries = [r for r in rows if r[0] % 5 == 0]
    got = topk_mtree.top_k(df, df.where("vec_id % 5 = 0"), k=20, tree_rows=(64, 128), block_rows=(16, 32))
    assert found(got) == brute(rows, queries, 20)


def test_clustered_vectors_are_routed(spark):
    """Clusters, many copies of one vector, and fewer pivots than trees: the same as all comparisons, with fewer of them."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 300, (12, 6))
    v = np.floor(np.concatenate([np.repeat(centres, 60, axis=0) + rng.normal(0, 4, (720, 6)), np.tile(centres[:1], (300, 1))])).astype(int).tolist()
    rows = list(enumerate(v))
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    for most in (1024, 3):
        got = topk_mtree.top_k(df, df.where("vec_id % 7 = 0"), k=5, tree_rows=(40, 40), block_rows=(20, 20), most_pivots=most)
        assert found(got) == brute(rows, [r for r in rows if r[0] % 7 == 0], 5)
    tree = topk_mtree.MTree(np.arange(720), np.array(v[:720], float), page=16, fanout=6)
    for i in range(0, 720, 10):
        tree.search(tree.vectors[i], int(tree.ids[i]), 5)
    assert tree.computed < 0.8 * 72 * 720
    best = tree.search(tree.vectors[0], -1, 5)
    assert tree.search(tree.vectors[0], -1, 5, best[2][0]) == [b for b in best if b[0] >= best[2][0]]


def test_pages_small_enough_to_have_inner_levels():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 60, (30, 5))
    x = np.floor(np.repeat(centres, 40, axis=0) + rng.normal(0, 2, (1200, 5)))
    ids = rng.permutation(1200)
    tree = topk_mtree.MTree(ids, x, page=32, fanout=6)
    assert any(p[0] == "inner" for p in tree.pages) and sorted(tree.ids) == list(range(1200))
    for i in range(0, 1200, 60):
        want = sorted((-float(x[i] @ v), int(d)) for v, d in zip(x, ids, strict=True) if d != ids[i])[:7]
        assert tree.search(x[i], int(ids[i]), 7) == [(d, int(-s)) for s, d in want] or tree.search(x[i], int(ids[i]), 7) == [(int(-s), d) for s, d in want]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1, 2]), (20, [3, None]), (40, None), (None, [1, 1]), (1, [5, 5]), (2, [1, 2, 3]), (3, [5, 5]), (3, [5, 5]), (60, []), (80, [10**11, 1]), (4, [10**11, 2])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>").withColumns({c: F.lit("x") for c in ("id", "v", "dim", "part", "rank", "score")})
    got = found(topk_mtree.top_k(df, df.where("vec_id % 20 = 0"), k=20))
    assert set(got) == {0, 80}
    assert got[0] == [(4, 10**11 + 4), (80, 10**11 + 2), (1, 15), (3, 15), (3, 15)]
    assert got[80][0] == (4, 2**63 - 1) and got[80][1] == (1, 5 * 10**11 + 5)
    assert topk_mtree.top_k(df.limit(0), df, k=3).count() == 0 and topk_mtree.top_k(df, df.limit(0), k=3).count() == 0


def test_query_on_the_small_table(spark):
    rows = [(r.vec_id, [int(np.floor(64 * float(x))) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert found(registry.op1_topk_mtree(spark, "/root/testdata/sf0.001")) == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)


PAGES = [
    (1, "http://a/1", "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n é"),
    (5, None, None), (3, "a b", ""), (4, "x", "dup"), (2, "y", "dup"), (2, "y", "dup"), (None, "z", "dup"), (9, "w", "WARC/1.1\r\n" * 50), (10, "v", "\r\n\r\n"),
]


def test_archive_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("sha", "n", "first", "value", "file", "at", "next")})
    got = warc.archived(df.repartition(3), file_bytes=2 * warc.SMALLEST).collect()
    assert all(r.sound for r in got) and len(got) == len(PAGES)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted((p, len((h or "").encode()), digest(h), {5: "revisit", 4: "revisit"}.get(p, "response"), {5: 3, 4: 2}.get(p)) for p, _, h in PAGES if p is not None)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None) == want
    assert [r.record_type for r in got if r.page_id is None] == ["response"]
    assert warc.archived(df.limit(0)).count() == 0


def test_small_payloads_are_not_revisited(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id bigint, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.archived(df, min_payload=3).collect()} == {1: None, 2: None, 3: None, 4: 3}
    assert {r.page_id: r.refers_to for r in warc.archived(df, broadcast_rows=0).collect()} == {1: None, 2: 1, 3: None, 4: 3}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(-1, 60)), max_size=25))
def test_pointer_jumping_is_walking(pairs):
    nxt = dict(pairs)
    at = np.array(sorted(nxt), np.int64)
    following = np.array([nxt[a] if nxt[a] > a else -1 for a in at.tolist()], np.int64)
    walk, here = set(), 0
    steps = dict(zip(at.tolist(), following.tolist(), strict=True))
    while here in steps:
        walk.add(here)
        here = steps[here]
    assert set(at[warc.reached(at, following)].tolist()) == walk


def test_candidates_of_broken_bytes():
    assert warc.candidates(b"") == []
    assert warc.candidates(b"WARC/1.1\r\nno end")[0][1] == -1
    assert warc.candidates(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")[0][1] == -1


def test_files_roll_by_size(spark, tmp_path):
    """Small and large records, and one larger than a file may be."""
    html = {i: ("p%d " % i) * (10 if i % 4 else 12_000) for i in range(60)} | {99: "long " * 10_000_000}
    df = spark.createDataFrame(list(html.items()), "page_id bigint, html string").withColumn("url", F.lit("u")).repartition(2)
    warc.write_archives(df, f"{tmp_path}/a", file_bytes=1 << 17)
    sizes = sorted(p.stat().st_size for p in tmp_path.rglob("part-*"))
    assert sizes[-1] > 50_000_000 and all(n < 1 << 18 for n in sizes[:-1]) and len(sizes) > 9
    got = {r.page_id: r for r in warc.read_archives(spark, f"{tmp_path}/a").collect()}
    assert {i: r.payload_bytes for i, r in got.items()} == {i: len(t) for i, t in html.items()}
    assert all(r.payload_digest == warc.base32_sha1(html[i].encode()) for i, r in got.items())


def test_broken_archives_fail(spark, tmp_path):
    good = b"".join(warc.record(i, b"u", b"payload %d" % i, None, b"2024-01-01T00:00:00Z") + b"\r\n\r\n" for i in range(3))
    damaged = good.replace(b"payload 1", b"payl0ad 1")
    inside = good.replace(b"payload 2", b"WARC/1.1\r\n")  # a length that no longer holds
    for name, data, fails in (("good", good, False), ("cut", good[:-30], True), ("front", b"x" + good, True), ("damaged", damaged, True), ("inside", inside, True), ("empty", b"", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(data)
        if fails:
            with pytest.raises(Exception, match="BrokenArchive"):
                warc.read_archives(spark, str(tmp_path / name)).count()
        else:
            assert warc.read_archives(spark, str(tmp_path / name)).count() == (3 if data else 0)
