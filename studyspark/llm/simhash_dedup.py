"""SimHash near-duplicate classes through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of their
eight bytes, so they share at least 8 - d positional bytes: the guaranteed minimum
of count filtering.  Postings of single positional bytes would bring together one
pair in 32 of all; with a minimum of four shared bytes every pair to be found also
shares one of 20 triples of positions (no four of eight positions avoid them all),
and the inverted index is kept on those triples: 24-bit postings, 20 a fingerprint.
Within a posting the shared positional bytes of a pair are tallied, pairs under the
minimum fall out, and the rest are verified by their differing bits.

The stage of the pipeline asks for similar sets of shingles.  Its candidates are the SimHash
classes of these sets, by the same index, and each class is checked by the Jaccard similarity
of its sets (``similar_classes``).  No number of bits decides a similarity of 0.8, where some
ten of 64 bits differ: sets whose fingerprints lie further apart are completed by bands of
smallest hashes, under the same check.  A class or a band's bucket is first compared with its
smallest member; what is then still apart is compared in cells of two blocks, which emit
spanning forests as below and no pairs.

Only distinct fingerprints are indexed.  A posting never emits its pairs: it emits a
spanning forest of its links, found by searches that compare one fingerprint with
those not yet reached.  A posting with more than ``block`` fingerprints is dealt to
cells of two blocks each, so no task holds or compares a whole hot posting; forests
of all cells together connect what the posting connects.

Edge cases: a null text has no words, like an empty one; texts without words have
fingerprint zero and link like any other; repeated rows and exact copies share their
class; a null id never becomes a class id unless its whole class has none; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, as_bytes, in_arrow, removed, written
from .components import components


def simhash(h: np.ndarray) -> np.uint64:
    """The fingerprint of 64-bit hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(texts: list[bytes], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text (UTF-8)."""
    from xxhash import xxh64_intdigest as h64

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            h = [h64(b" ".join(words), seed)]
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - shingle + 1].tolist()
            h = [h64(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        out[i] = simhash(np.array(h, np.uint64))
    return out


def covering_triples(n: int = 8) -> list[tuple[int, int, int]]:
    """Triples of n positions such that any four positions hold one of them.

    Positions are dealt to three groups in a ring; a triple lies in one group, or has
    two positions in a group and one in the next.  Of four positions either three
    share a group, or two groups have two each, or a group of two has a neighbour on
    each side: in every case one of the triples is there."""
    group = [i * 3 // n for i in range(n)]
    out = []
    for t in combinations(range(n), 3):
        g = [group[i] for i in t]
        if len(set(g)) == 1:
            out.append(t)
        elif len(set(g)) == 2:
            two = max(set(g), key=g.count)
            one = min(set(g), key=g.count)
            if one == (two + 1) % 3:
                out.append(t)
    return out


def _links(x: np.ndarray, others: np.ndarray, bits: int, shared: int) -> np.ndarray:
    """Which of ``others`` link with x (rows of 64-bit words): the tally of shared positional bytes, then the verified bits."""
    differ = x ^ others
    same = (differ.view(np.uint8).reshape(len(differ), -1) == 0).sum(axis=1)
    return (same >= shared) & (np.bitwise_count(differ).sum(axis=1) <= bits)


def forest(fps: np.ndarray, bits: int, shared: int, half: int | None = None) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among ``fps``, as places; with ``half`` only links between fps[:half] and the rest count."""
    left = np.ones(len(fps), bool)
    a: list[int] = []
    b: list[int] = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            if half is None:
                rest = np.flatnonzero(left)
            elif i < half:
                rest = half + np.flatnonzero(left[half:])
            else:
                rest = np.flatnonzero(left[:half])
            if not len(rest):
                continue
            found = rest[_links(fps[i], fps[rest], bits, shared)]
            left[found] = False
            stack += found.tolist()
            a += [i] * len(found)
            b += found.tolist()
    return a, b


def _solve(key: np.ndarray, cell: np.ndarray, side: np.ndarray, fps: np.ndarray, bits: int, shared: int, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Forests of whole runs of equal (key, cell), as places.

    Runs of up to ``few`` are compared all at once, offset by offset; of these only the ones
    with several links, and all longer ones, are searched one by one."""
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    run = np.repeat(np.arange(len(first)), size)
    small = (size <= few)[run]
    found_a, found_b = [], []
    alive = np.flatnonzero(small)
    d = 1
    while True:
        alive = alive[alive + d < len(key)]
        alive = alive[run[alive] == run[alive + d]]
        if not len(alive):
            break
        for part in np.array_split(alive, len(alive) // 200_000 + 1):
            differ = fps[part] ^ fps[part + d]
            ok = np.bitwise_count(differ).sum(axis=1) <= bits
            ok &= (differ.view(np.uint8).reshape(len(differ), -1) == 0).sum(axis=1) >= shared
            ok &= (cell[part] < 0) | (side[part] != side[part + d])
            found_a.append(part[ok])
            found_b.append(part[ok] + d)
        d += 1
    a = np.concatenate([np.empty(0, np.int64), *found_a])
    b = np.concatenate([np.empty(0, np.int64), *found_b])
    links = np.bincount(run[a], minlength=len(first))
    single = links[run[a]] == 1
    out_a, out_b = a[single].tolist(), b[single].tolist()
    for r in np.flatnonzero((links > 1) | (size > few)).tolist():
        s, n = int(first[r]), int(size[r])
        half = None if cell[s] < 0 else int((side[s : s + n] == 0).sum())
        if half is not None and half in (0, n):
            continue
        p, q = forest(fps[s : s + n], bits, shared, half)
        out_a += [s + i for i in p]
        out_b += [s + i for i in q]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _edges_of_runs(width: int, bits: int, shared: int):
    """mapInArrow over rows (key, cell, side, words...) sorted by key, cell, side: the forest of each run."""

    def edges(part: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.stack(part[3:], axis=1)
        a, b = _solve(*part[:3], fps.view(np.uint64), bits, shared)
        cols = [pa.array(fps[rows, i], pa.int64()) for rows in (a, b) for i in range(width)]
        return pa.RecordBatch.from_arrays(cols, names=[f"{x}{i}" for x in "ab" for i in range(width)])

    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + width)])
            rows += batch.num_rows
            if rows < 100_000:
                continue
            now = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held, rows = [[c[cut:] for c in now]], len(now[0]) - cut
            if cut:
                yield edges([c[:cut] for c in now])
        if rows:
            yield edges([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def dealt(rows: DataFrame, by) -> DataFrame:
    """Adds cell and side: rows whose key has n > 1 blocks go to every cell of their block, by the hash ``by``.

    A cell of two blocks has two sides; one block with itself is one run (cell < 0), like a whole key of one block."""
    one = rows.where("n <= 1").withColumn("cell", F.lit(-1)).withColumn("side", F.lit(0))
    many = rows.where("n > 1").withColumn("_b", F.pmod(by, F.col("n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    cell = F.when(F.col("_b") == F.col("_o"), -2 - F.col("_b")).otherwise(F.least("_b", "_o").cast("bigint") * F.col("n") + F.greatest("_b", "_o"))
    return one.unionByName(many.withColumn("cell", cell).withColumn("side", F.when(F.col("_b") <= F.col("_o"), 0).otherwise(1)).drop("_b", "_o")).drop("n")


def linking_edges(fps: DataFrame, *, bits: int, positions: list[tuple[int, ...]], shared: int, block: int = 4096) -> DataFrame:
    """Edges (a, b) between nodes of ``fps`` that connect what links within postings connect.

    ``fps``: 64-bit words of distinct fingerprints as signed longs (w0, w1, ...).  A posting
    holds the fingerprints that agree in all bytes at one of the ``positions``; pairs link
    with ``shared`` equal positional bytes or more and ``bits`` differing bits or fewer."""
    words = fps.columns
    byte = lambda i: F.shiftrightunsigned(words[i // 8], 8 * (i % 8)).bitwiseAND(F.lit(255))

    def key(number: int, at: tuple[int, ...]):
        out = F.lit(number << 8 * len(at)).cast("bigint")
        for n, i in enumerate(at):
            out = out.bitwiseOR(F.shiftleft(byte(i), 8 * n))
        return out

    posted = fps.select(*words, F.explode(F.array(*(key(n, at) for n, at in enumerate(positions)))).alias("key"))
    hot = written(posted.groupBy("key").count().where(F.col("count") > block), "hot")
    cells = posted.withColumn("cell", F.lit(-1)).withColumn("side", F.lit(0))
    if hot.limit(1).count():
        counted = posted.join(hot, "key", "left").withColumn("n", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")).drop("count")
        cells = dealt(counted, F.xxhash64(*words))
    ordered = cells.select("key", "cell", "side", *words).repartition("key", "cell").sortWithinPartitions("key", "cell", "side", *words)
    names = [f"{x}{i}" for x in "ab" for i in range(len(words))]
    found = ordered.mapInArrow(_edges_of_runs(len(words), bits, shared), ", ".join(f"{n} bigint" for n in names))
    return found.select(*(node(*(F.col(f"{x}{i}") for i in range(len(words)))).alias(x) for x in "ab"))


def node(*words):
    """The number of a fingerprint among components: itself, or a hash of its words."""
    return words[0] if len(words) == 1 else F.xxhash64(*words)


def classes(docs: DataFrame, *, id_col: str, text_col: str, prints, width: int, bits: int, positions: list[tuple[int, ...]], shared: int) -> DataFrame:
    """(id, w0, ..., component_id) of every row; ``prints`` turns texts into rows of ``width`` 64-bit words."""
    kind = dict(docs.dtypes)[id_col]
    words = [f"w{i}" for i in range(width)]

    def run(batches):
        for b in batches:
            fps = prints(as_bytes(b.column(1))).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fps[:, i], pa.int64()) for i in range(width))], names=["id", *words])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = written(in_arrow(picked, run, f"id {kind}, " + ", ".join(f"{w} bigint" for w in words)), "fingerprints")
    least = marked.groupBy(*words).agg(F.min("id").alias("least"))
    nodes = components(linking_edges(least.select(*words), bits=bits, positions=positions, shared=shared))
    own = least.select(node(*map(F.col, words)).alias("node"), *words, "least")
    linked = written(nodes.join(own, "node").select(*words, "root", "least"), "linked")
    # written, so that a class of very many fingerprints can be split in the join
    roots = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    found = linked.join(roots, "root").select(*words, "component_id")
    # written, so that both sides of the last join are plain shuffles and a fingerprint with many copies can be split
    whole = written(least.join(found, words, "left").select(*words, F.coalesce("component_id", "least").alias("component_id")), "classes")
    removed(linked, roots)
    return marked.join(whole, words).select("id", *words, "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links of ``bits`` or fewer, 4 at most)."""
    if bits > 4:
        raise ValueError("triples of positions are sure to catch 4 differing bytes at most")
    found = classes(docs, id_col=id_col, text_col=text_col, prints=lambda t: fingerprints(t, shingle), width=1, bits=bits, positions=covering_triples(), shared=8 - bits)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of the pipeline's stage link at so many differing bits or fewer.
BITS = 4
#: Bands of smallest hashes: two sets with Jaccard J meet in one with probability 1 - (1 - J ** DEEP) ** BANDS.
BANDS, DEEP = 24, 4


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_intdigest as h64

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter((h64(p, seed) for p in parts), np.uint64, max(len(words) - shingle + 1, 1)))


def band_keys(h: np.ndarray, seed: int = 7) -> list[int]:
    """Signed 64-bit keys of the bands of a set of hashes; none for an empty set."""
    from xxhash import xxh64_intdigest as h64

    if not len(h):
        return []
    rng = np.random.default_rng(seed)
    mask, odd = (rng.integers(0, 1 << 64, BANDS * DEEP, np.uint64)[:, None] for _ in range(2))
    odd = odd | np.uint64(1)
    least = np.min([((h[k : k + 1024] ^ mask) * odd).min(axis=1) for k in range(0, len(h), 1024)], axis=0).reshape(BANDS, DEEP)
    return np.array([h64(least[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles have a Jaccard similarity of ``similarity`` or more; ``texts``: (node, text)."""

    def run(batches):
        for batch in batches:
            ok, known = [], {}
            for a, x, y in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                if a not in known:
                    known = {a: shingle_set(x, shingle)}
                one, two = known[a], shingle_set(y, shingle)
                both = len(np.intersect1d(one, two, assume_unique=True))
                ok.append(both >= similarity * (len(one) + len(two) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    beside = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return written(in_arrow(beside, run, "a bigint, b bigint"), "links")


def similar_forest(sets: list[np.ndarray], roots: list[int], half: int | None, similarity: float, columns: int = 4096) -> list[tuple[int, int]]:
    """Links, as places, that connect the classes ``roots`` which pairs of similar sets connect; with ``half``
    only pairs of a set before that place and one from it on count.

    Shared shingles of all pairs are counted by products of membership matrices, some columns at a time."""
    size = np.array([len(h) for h in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[place] > 1
    owner, place = owner[several], (np.cumsum(times > 1) - 1)[place[several]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(sets), len(sets)))
    for k in range(0, int((times > 1).sum()), columns):
        here = slice(*np.searchsorted(place, [k, k + columns]))
        x = np.zeros((len(sets), columns), np.float32)
        x[owner[here], place[here] - k] = 1
        both += x @ x.T
    close = np.triu(both >= similarity * (size[:, None] + size[None] - both) - 1e-9, 1)
    if half is not None:
        close[half:] = False
        close[:, :half] = False
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while r in parent:
            r = parent[r]
        return r

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(close)), strict=True):
        p, q = top(roots[a]), top(roots[b])
        if p != q:
            parent[q] = p
            out.append((a, b))
    return out


def _forests_of_cells(shingle: int, similarity: float):
    """mapInArrow over rows (key, cell, side, node, root, text) sorted by key, cell, side: the forest of each cell."""

    def run(batches):
        held: list[tuple] = []
        at = None

        def edges():
            sets = [shingle_set(r[3], shingle) for r in held]
            half = None if at[1] < 0 else sum(r[0] == 0 for r in held)
            found = similar_forest(sets, [r[2] for r in held], half, similarity)
            return pa.RecordBatch.from_arrays([pa.array([held[p[i]][1] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, cell, side, node, root, text in zip(*(batch.column(i).to_pylist() for i in range(5)), as_bytes(batch.column(5)), strict=True):
                if (key, cell) != at:
                    if len(held) > 1:
                        yield edges()
                    held, at = [], (key, cell)
                held.append((side, node, root, text))
        if len(held) > 1:
            yield edges()

    return run


def _mixed(classed: DataFrame) -> DataFrame:
    """(key, n: nodes, s: shingles, big: root of the largest class, m: its nodes, t: its shingles) of buckets of several classes.

    ``classed``: (key, node, size, root); of equally large classes the one of the largest root."""
    each = classed.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("size").alias("t"))
    whole = each.groupBy("key").agg(F.sum("m").alias("n"), F.sum("t").alias("s"), F.max(F.struct("m", "root", "t")).alias("most"))
    return written(whole.select("key", "n", "s", F.col("most.root").alias("big"), "most.m", "most.t").where("n > m"), "mixed")


def _cells(classed: DataFrame, mixed: DataFrame, block: int, shingles: int) -> DataFrame:
    """(key, cell, side, node, root): cells in which all pairs of nodes of different classes of a mixed bucket meet.

    A bucket of one block is one run.  Of others the largest class has blocks of its own, which meet the
    blocks of the rest and not each other; the blocks of the rest meet as in ``dealt``."""
    blocks = lambda n, s: F.ceil(F.greatest(n / block, s / shingles)).cast("bigint")
    rows = classed.join(mixed, "key").withColumn("_n", blocks(F.col("n"), F.col("s")))
    one = rows.where("_n <= 1").withColumn("cell", F.lit(-1).cast("bigint")).withColumn("side", F.lit(0))
    many = rows.where("_n > 1").withColumn("_h", F.xxhash64("node")).withColumn("_d", blocks(F.col("m"), F.col("t"))).withColumn("_r", blocks(F.col("n") - F.col("m"), F.col("s") - F.col("t")))
    rest, most = many.where("root <> big"), many.where("root = big")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    ends = rest.withColumn("_y", F.pmod("_h", "_r")).withColumn("_x", to("_d")).withColumn("side", F.lit(1))
    ends = ends.unionByName(most.withColumn("_x", F.pmod("_h", "_d")).withColumn("_y", to("_r")).withColumn("side", F.lit(0)))
    across = ends.withColumn("cell", F.col("_r") * F.col("_r") + F.col("_x") * F.col("_r") + F.col("_y"))
    among = dealt(rest.withColumn("n", F.col("_r")), F.col("_h"))
    out = ["key", "cell", "side", "node", "root"]
    return one.select(out).unionByName(across.select(out)).unionByName(among.select(out))


def _simhash_keys(own: DataFrame) -> DataFrame:
    """(node, size, key): the SimHash class of each node with words; ``own``: (node, size, w0: its fingerprint)."""
    worded = own.where("size > 0")
    linked = components(linking_edges(worded.select("w0").distinct(), bits=BITS, positions=covering_triples(), shared=8 - BITS))
    classed = worded.join(linked.withColumnRenamed("node", "w0"), "w0", "left")
    return classed.select("node", "size", F.xxhash64(F.lit("simhash"), F.coalesce("root", "w0")).alias("key"))


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, block: int = 512, shingles: int = 2_000_000) -> DataFrame:
    """(k: hash of id and text, id, root: number of the class) of every row.

    Nodes are distinct sets of shingles.  Their buckets are the classes of their SimHash fingerprints (links of
    ``BITS`` bits, through the byte-position index) and those of the bands.  In each every node is first compared with the
    smallest, so a family of near copies costs one comparison for each member.  Buckets whose nodes then
    stand in different classes are dealt to cells of two blocks of about ``block`` nodes and ``shingles``
    shingles at most, which compare all their sets; nodes of the largest class are not compared with each
    other.  So every pair of a bucket is compared or connected already, and none is emitted but links.
    A bucket of n nodes of many classes is copied n / ``block`` times."""
    kind = dict(docs.dtypes)[id_col]
    picked = docs.select(F.xxhash64(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for b in batches:
            sets = [shingle_set(t, shingle) for t in as_bytes(b.column(2))]
            nodes = np.array([xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            prints = np.array([simhash(h) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array(map(len, sets), pa.int64()), pa.array(prints), pa.array(map(band_keys, sets), pa.list_(pa.int64()))], names=["k", "id", "node", "size", "w0", "keys"])

    marked = written(in_arrow(picked, run, f"k bigint, id {kind}, node bigint, size bigint, w0 bigint, keys array<bigint>"), "sets")
    own = written(marked.groupBy("node").agg(F.min_by("keys", "k").alias("keys"), F.max("size").alias("size"), F.max("w0").alias("w0")), "own")
    alike = _simhash_keys(own)
    posted = written(own.select("node", "size", F.explode("keys").alias("key")).unionByName(alike), "postings")
    removed(own)
    # written like all aggregates that meet their own rows again: a hot bucket or class can be split in the join
    buckets = written(posted.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"), "buckets")
    met = written(posted.join(buckets, "key"), "met")
    removed(posted, buckets)
    needed = met.select("node").distinct().join(marked.groupBy("node").agg(F.min("k").alias("k")), "node")
    texts = written(picked.select("k", "text").join(needed, "k").groupBy("node").agg(F.first("text").alias("text")), "texts", codec="zstd")

    stars = written(met.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = verified(stars, texts, shingle, similarity)
    classed = written(met.join(components(links), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "classed")
    removed(met, stars)
    mixed = _mixed(classed)
    cells = _cells(classed, mixed, block, shingles).join(texts, "node").select("key", "cell", "side", "node", "root", "text")
    ordered = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "side", "node")
    more = written(in_arrow(ordered, _forests_of_cells(shingle, similarity), "a bigint, b bigint"), "links")
    removed(classed, mixed, texts)
    linked = components(links.unionByName(more))
    removed(links, more)
    found = written(marked.select("k", "id", "node").join(linked, "node", "left").select("k", "id", F.coalesce("root", "node").alias("root")), "classes")
    removed(marked)
    return found


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) over links of texts whose sets of word shingles have Jaccard ``similarity`` or more.

    Candidates share a SimHash class, or one of ``BANDS`` bands of ``DEEP`` smallest hashes: all but 4 in a million of
    pairs right at 0.8, fewer above.  Each link is verified by the sets themselves, so nothing under the threshold links."""
    found = _similar(docs, id_col, text_col, shingle, similarity)
    least = written(found.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return found.join(least, "root").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each class: that of the smallest id, then of the smallest hash.

    A document is an id and a text: rows equal in both are one, other rows of an id are decided each by
    their own class.  A null id is larger than any other."""
    found = _similar(docs, id_col, text_col, shingle, similarity)
    first = written(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("first")).select("root", F.col("first.id").alias("first_id"), F.col("first.k").alias("first")), "first")
    goes = ~(F.col("k").eqNullSafe(F.col("first")) & F.col("id").eqNullSafe(F.col("first_id")))
    rows = written(found.join(first, "root").groupBy("id", "k").agg(F.count("*").alias("n"), F.first(goes).alias("goes")).where("goes or n > 1"), "stay")
    removed(found, first)
    small = lambda df: F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df  # noqa: E731  proven small, else a shuffle join
    own = F.xxhash64(docs[id_col], docs[text_col])
    key, name = apart(docs, "_k", "_id")
    same = lambda keys: (own == keys[key]) & docs[id_col].eqNullSafe(keys[name])
    gone = small(rows.where("goes").select(F.col("k").alias(key), F.col("id").alias(name)))
    out = docs.join(gone, same(gone), "left_anti")
    again = rows.where("n > 1 and not goes").select(F.col("k").alias(key), F.col("id").alias(name))
    if again.limit(1).count():  # repeated rows of one document
        again = small(again)
        once = out.join(again, same(again)).dropDuplicates([key, name]).select(*docs.columns)
        out = out.join(again, same(again), "left_anti").unionByName(once)
    return out
