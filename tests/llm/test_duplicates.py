import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from studyspark.llm import components, simhash_dedup, substring_dedup

WORDS = [f"w{i}" for i in range(400)]


def test_triples_cover_all_fours():
    triples = simhash_dedup.covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def by_hand(text):
    """The fingerprint of the contract, bit by bit."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(70)] + [(500, 500)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    want = union([p for p in pairs if p[0] != p[1]], {n for p in pairs if p[0] != p[1] for n in p})
    assert {r.node: r.root for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(9)
    rows = []
    for family in range(30):
        base = [rng.choice(WORDS) for _ in range(120)]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(120)] = rng.choice(WORDS)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    rows += ["", None, " ", "one", "one", "ONE two three", "a b c d", "A B C D"]
    return [(i + 10, t) for i, t in enumerate(rows)]


def test_classes_against_all_pairs(spark, copies):
    df = spark.createDataFrame(copies, "doc_id bigint, text string")
    prints = {i: by_hand(t) for i, t in copies}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = union(links, list(prints))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_dedup.near_duplicates(df).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


def test_hot_postings_are_dealt_to_cells(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "w0 bigint")
    back = lambda x: x & ((1 << 64) - 1)
    want = union([(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 4], prints)
    for block in (4096, 40):
        edges = simhash_dedup.linking_edges(df, bits=4, positions=simhash_dedup.covering_triples(), shared=4, block=block).collect()
        got = union([(back(r.a), back(r.b)) for r in edges], prints)
        groups = lambda roots: sorted(sorted(n for n in roots if roots[n] == r) for r in set(roots.values()))
        assert groups(got) == groups(want) and len(edges) < 20 * len(prints)


def test_similar_sets_of_shingles(spark, copies):
    df = spark.createDataFrame(copies, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_classes(df).collect()}
    sets = {}
    for i, t in copies:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = far = 0
    for a, b in combinations(sets, 2):
        both = len(sets[a] | sets[b])
        j = len(sets[a] & sets[b]) / both if both else 1.0
        if j >= 0.85:
            near += 1
            assert got[a] == got[b]
        elif j < 0.3:
            far += 1
            assert got[a] != got[b] or not sets[a]
    assert near > 20 and far > 100


def test_edges_of_near_duplicates(nasty, no_docs):
    got = simhash_dedup.near_duplicates(nasty).collect()
    assert len(got) == nasty.count()
    zero = {r.component_id for r in got if int(r.fingerprint, 16) == 0}
    assert zero == {2} and {r.component_id for r in got if r.doc_id == 1} == {1}
    kept = simhash_dedup.one_of_each(nasty).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [-1, 1, 2, 5, 6, 7, 8, 9]
    assert simhash_dedup.near_duplicates(no_docs).count() == 0 and simhash_dedup.one_of_each(no_docs).count() == 0
    assert simhash_dedup.one_of_each(nasty, broadcast_rows=0).count() == len(kept)
    with pytest.raises(ValueError):
        simhash_dedup.near_duplicates(nasty, bits=5)


def brute_units(rows, min_words=8):
    """Removed spans, by a dictionary over all units in rank order."""
    seen, out = {}, {}
    for i, text in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for s, e, u in substring_dedup.units(text, min_words):
            if seen.setdefault(u, (i, s)) != (i, s):
                out.setdefault(i, []).append((s, e))
    merged = {}
    for i, spans in out.items():
        for s, e in sorted(spans):
            last = merged.setdefault(i, [])
            if last and s <= last[-1][1]:
                last[-1] = (last[-1][0], max(e, last[-1][1]))
            else:
                last.append((s, e))
    return merged


def without(text, spans):
    at, parts = 0, []
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return "".join([*parts, text[at:]])


def kept_and_lost(rows):
    """Texts without their spans, and the pieces (words, edges dropped) that no kept text holds any more."""
    spans = brute_units(rows)
    kept = {i: without(t, spans.get(i, [])) for i, t in rows}
    bare = lambda words: " ".join(words).strip(substring_dedup._EDGE)
    running = "\n".join(" ".join(t.lower().split()) for t in kept.values())
    return kept, [p for _, t in rows for _, _, w in substring_dedup.pieces(t) if (p := bare(w)) not in running]


def test_no_piece_is_lost(documents):
    _, lost = kept_and_lost(sorted((r.doc_id, r.text) for r in documents.collect()))
    assert not lost


def test_overlapping_units_leave_every_piece_somewhere(spark):
    s1, s2, s3 = ("The ferry lay still in the frozen river for weeks.", "Nobody crossed on foot until the ice would bear.", "Then the sledges came with salt from the coast.")
    rows = [(0, f"{s1} {s2}"), (1, f"{s1} {s2} {s3}"), (2, f"{s2} {s3}"), (3, f"{s3} {s1}")]
    kept, lost = kept_and_lost(rows)
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == kept and not lost and got[1] == s3 and got[2] == got[3] == ""
    short = ("It froze, hard.", "Nobody crossed it.", "Salt grew dear then.", "Sledges came by night.")
    rows = [(0, " ".join(short[:3])), (1, " ".join(short)), (2, " ".join(short[1:])), (3, " ".join(short[2:] + short[:2]))]
    kept, lost = kept_and_lost(rows)
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == kept and not lost


def test_a_sentence_glued_to_other_words(spark):
    """Whatever the length of what stands around it, the rest of the sentence after its first comma goes."""
    rest = "the ferrymen carried their salt across on sledges by night because the ice was firmer then."
    rows = [(0, f"As the river froze, {rest}"), (1, f"five other words stand before As the river froze, {rest}"), (2, f"one As the river froze, {rest}")]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: rows[0][1], 1: "five other words stand before As the river froze, ", 2: "one As the river froze, "}


def test_passage_of_short_sentences(spark):
    passage = "It froze. The ferry lay still. Nobody crossed. Salt grew dear. Then came the sledges. By night they went. The ice held. Spring took it."
    rows = [(1, f"First words of one. {passage} The end of one."), (2, f"Other. Words! {passage} Another end.")]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] in ("Other. Words! Another end.", "Other. Words! Spring took it. Another end.")


def test_substring_dedup_against_a_dictionary(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute_units(rows)
    assert want
    texts = dict(rows)
    for r in substring_dedup.dedup(documents).collect():
        spans = [tuple(s) for s in r.spans or []]
        assert spans == want.get(r.doc_id, []) and r.n_removed == len(spans)
        kept, at = "", 0
        for s, e in spans:
            kept, at = kept + texts[r.doc_id][at:s], e
        assert r.text == kept + texts[r.doc_id][at:] and r.removed_chars == len(texts[r.doc_id]) - len(r.text)


def test_passage_inside_other_lines(spark):
    passage = "Once the river had frozen over the ferrymen carried salt across on sledges. They went by night because the ice was firmer then than at noon."
    rows = [(1, f"Own words of the first text come before it here. {passage} And after."), (2, f"| table | cell | {passage}\nOwn line of the second text."), (3, f"SHOUTED!! LINE!! {passage}")]
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "| table | cell | Own line of the second text." and got[3] == "SHOUTED!! LINE!! "


def test_edges_of_substring_dedup(nasty, no_docs):
    got = substring_dedup.dedup(nasty).collect()
    assert len(got) == nasty.count()
    assert [r.text for r in got if r.doc_id == 1] == ["The first text holds a handful of plain words."]
    assert sorted(r.text for r in got if r.doc_id == 6) == ["", "", "Another text under the same id, quite different from it."]
    assert [r.text for r in got if r.doc_id == 3] == [None]
    assert substring_dedup.dedup(no_docs).count() == 0 and substring_dedup.cleaned(no_docs).count() == 0
    docs = nasty.withColumn("n_chars", F.lit(0).cast("bigint"))
    rows = substring_dedup.cleaned(docs).collect()
    assert rows[0].__fields__ == docs.columns and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert len(rows) == len(got) - 2  # two rows have nothing left


def test_fingerprint_array_shapes():
    assert simhash_dedup.fingerprints([]).shape == (0,) and not np.any(simhash_dedup.fingerprints([b"", b" "]))


def jaccard_pair(rng, n, k):
    """Two texts of n + 4 words that differ in a run of k at the end, or in single words, far apart."""
    a = [f"v{rng.randrange(10**6)}" for _ in range(n + 4)]
    b = list(a)
    for _ in range(k):
        b[rng.randrange(n + 4)] = f"u{rng.randrange(10**6)}"
    return " ".join(a), " ".join(b)


def test_links_are_exactly_those_of_brute_force(spark):
    """Pairs right above 0.8 link and pairs under it never do, among 0.8-0.85 and 0.7-0.8."""
    rng = random.Random(31)
    rows, want, inside, under = [], {}, 0, 0
    while inside < 120 or under < 120:
        a, b = jaccard_pair(rng, rng.randint(60, 300), rng.randint(1, 12))
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        j = len(x & y) / len(x | y)
        if not 0.7 <= j <= 0.85 or (inside >= 120 if j >= 0.8 else under >= 120):
            continue
        inside, under = inside + (j >= 0.8), under + (j < 0.8)
        i = len(rows)
        rows += [(i, a), (i + 1, b)]
        want |= {i: i, i + 1: i if j >= 0.8 else i + 1}
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_chains_link_beside_a_node_that_does_not(spark):
    """In a bucket whose smallest node is too far from the others, these are compared with each other."""
    rng = random.Random(8)
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(150)] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_classes(df).collect()}
    assert got == union(near, list(sets)) and len(near) > 20
    for block in (3, 16):  # the same classes when buckets are dealt to cells of a few nodes
        found = {}
        for r in simhash_dedup._similar(df, "doc_id", "text", 5, 0.8, block=block).collect():
            found.setdefault(r.root, []).append(r.id)
        assert {i: min(ids) for ids in found.values() for i in ids} == got


def test_forest_of_a_cell_against_all_pairs():
    rng = np.random.default_rng(4)
    for n, half in ((1, None), (30, None), (30, 11), (30, 0)):
        base = rng.integers(0, 400, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, 45, replace=False), rng.integers(0, 400, int(k)).astype(np.uint64)])) for k in rng.integers(0, 9, n)]
        roots = [int(r) for r in rng.integers(0, 12, n)]
        inside = lambda i, j: half is None or i < half <= j
        pairs = [(i, j) for i, j in combinations(range(n), 2) if inside(i, j) and 10 * len(np.intersect1d(sets[i], sets[j])) >= 7 * len(np.union1d(sets[i], sets[j]))]
        got = simhash_dedup.similar_forest(sets, roots, half, 0.7, columns=50)
        assert set(got) <= set(pairs) and len(got) < max(n, 1)
        assert union([(roots[a], roots[b]) for a, b in got], set(roots)) == union([(roots[a], roots[b]) for a, b in pairs], set(roots))


def test_one_of_each_decides_by_id_and_text(spark):
    """Null and repeated ids with different texts: only copies go, and rows equal in both are one."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [
        (None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (1, text("c")), (2, text("c")), (2, text("d")), (2, text("e")), (3, text("e")), (3, text("f")), (3, text("f")), (4, text("g") + " x"), (4, text("g") + " y"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limit in (500_000, 0):
        got = sorted(((r.doc_id or 0, r.text) for r in simhash_dedup.one_of_each(df, broadcast_rows=limit).collect()))
        assert [(i, t[0]) for i, t in got] == [(0, "a"), (0, "b"), (1, "c"), (2, "d"), (2, "e"), (3, "f"), (4, "g")]


def test_stage_takes_its_candidates_from_the_fingerprints(spark, monkeypatch):
    """SimHash classes are buckets of their own: chains of links of 4 bits or fewer share a key, wordless nodes have none."""
    prints = [5, 5 ^ 0b1111, 5 ^ 0b11111111 << 40, 5 ^ 0b1111 ^ 0b1111 << 20, 5 ^ 0b1111 ^ 0b1111 << 20, 0]
    own = spark.createDataFrame([(n, 7 if w else 0, w) for n, w in enumerate(prints)], "node bigint, size bigint, w0 bigint")
    key = {r.node: r.key for r in simhash_dedup._simhash_keys(own).collect()}
    assert set(key) == set(range(5)) and key[0] == key[1] == key[3] == key[4] != key[2]
    rng, seen, whole = random.Random(2), [], simhash_dedup.linking_edges
    monkeypatch.setattr(simhash_dedup, "linking_edges", lambda fps, **how: seen.append((fps.count(), how["bits"], how["shared"])) or whole(fps, **how))
    text = " ".join(rng.choice(WORDS) for _ in range(600))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, " ".join(reversed(text.split()))), (4, text), (5, " ")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash_dedup.one_of_each(df).collect()) == [1, 3, 5]
    assert len(seen) == 1 and seen[0][0] in (2, 3) and seen[0][1:] == (4, 4)
