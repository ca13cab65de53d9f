import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from studyspark.llm import decontaminate


#: 13 words may differ in two; shorter items in as many as still leave a mask free.
NEEDED = {n: n - decontaminate.tolerated(decontaminate.MASKS, n, 0.8) for n in range(1, 14)}


def test_masks_find_every_window_with_two_substitutions():
    places = [frozenset(s + i for i in m) for m in decontaminate.MASKS for s in range(13 - max(m))]
    assert all(any(not p & set(bad) for p in places) for bad in combinations(range(13), 2))


def test_tolerance():
    assert NEEDED[13] == 11 and all(NEEDED[n] == n for n in range(1, 9)) and all(0 <= n - k <= n // 5 for n, k in NEEDED.items())


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """All alignments of all pairs, word by word."""
    out = {}
    for d, text in docs:
        dw = words(text)
        for i, passage in items:
            iw = words(passage)
            length = min(13, len(iw))
            for shift in range(-len(iw) + 1, len(dw)):
                same = [0 <= shift + k < len(dw) and dw[shift + k] == w for k, w in enumerate(iw)]
                best = max(sum(same[s : s + length]) for s in range(len(iw) - length + 1))
                if best >= NEEDED[length]:
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (sum(same), best, -shift))
    return {k: (v[0], v[1], -v[2]) for k, v in out.items()}


def planted(rng):
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((7, 8, 13, 20, 40, 55, 5, 3, 2, 1))]
    docs = []
    for d in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        passage = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 4)):
            passage[rng.randrange(len(passage))] = "changed"
        cut = rng.randint(0, len(passage) // 2) if d % 3 else 0
        at = rng.randint(0, len(own))
        docs.append((d, ", ".join(own[:at] + passage[cut:] + own[at:]).upper() + "!!"))
    return docs, items


def test_against_all_alignments(spark):
    docs, items = planted(random.Random(11))
    want = brute(docs, items)
    assert len(want) > 15
    for limit in (500_000, 0):
        got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_rows=limit).collect()
        assert {(r.doc_id, r.item_id): (r.n_matched, r.best_window, r.doc_start) for r in got} == want


def test_items_without_hits_and_edges(spark, nasty, no_docs):
    items = spark.createDataFrame([(1, "The first text holds a handful of plain words."), (1, "The first text holds a handful of plain words."), (2, None), (3, ""), (4, "text without"), (None, "Another text under the same id quite different from it")], "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(nasty, items).collect()}
    assert got == {(1, 1), (6, 1), (6, None), (None, 4)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(nasty, items, min_words=3).collect()} == got - {(None, 4)}
    assert decontaminate.overlaps(nasty, items.limit(0)).count() == 0 and decontaminate.overlaps(no_docs, items).count() == 0
    kept = decontaminate.clean(nasty, items)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 5


def test_no_python_on_the_main_path(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = decontaminate.clean(documents, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clean_removes_texts_and_not_ids(spark):
    """Other texts under a contaminated text's id, or beside it without an id, stay."""
    item = "what does the old ferryman carry across the river in the first hard winter"
    rows = [(None, f"So {item} then?"), (None, "A clean text without an id."), (None, None), (4, f"And {item}."), (4, "A clean text of the same id."), (5, "Another clean text.")]
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.clean(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, (r for r in rows if item not in (r[1] or ""))))
