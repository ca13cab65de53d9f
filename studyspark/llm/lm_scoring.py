"""Language-model scoring with a log-bilinear neural model.

The vocabulary is open: a token's probability is that of its class after the two
classes before it, times that of the token within its class.  The most frequent words
(and the end of a text) are classes of their own: ``top``, or one for each ``spread``
words of the vocabulary if these are more, up to ``most`` (the normaliser below is a
table of pairs).  All other words fall into ``tails`` classes by their last two bytes,
and within a class a word has the add-one probability of its corpus count.  Class sequences are modelled by a
log-bilinear network: the two context classes have vectors, one matrix for each
position maps them to a predicted vector, and its inner products with the classes'
output vectors, plus a bias, are the logits.

Training is noise-contrastive estimation in numpy: each batch shares ``noise``
samples from the class frequencies, so data and noise scores are matrix products.
Every task trains on the windows of its own partition from a common start, and Spark
averages the parameters, weighted by windows, for ``rounds`` rounds.  Every window of
every training text is learned from; a task reads its windows in blocks of bounded size.
There are at most ``trainers`` such tasks, so what is averaged does not grow with the
input.  As with any such training, how the table is partitioned changes scores a little.

Scoring: logits are sums of one table for each position, so the normaliser of every
pair of contexts is one batched matrix product, exp(A) @ exp(B).T, made once.  Token
log-probabilities are then table look-ups and are normalised exactly.

Counts cover all training tokens.  The most frequent words, ``hot`` at most, go to the
tasks as a dictionary: those with a count so high that no more than that have it.
Tokens beyond them leave as (text, word, times) and meet their counts by a shuffle join.

Edge cases: a very long text is one array of class numbers, and its windows are cut into
rows of bounded length; a null or empty text is its end token; a null id is scored, is not held
out and is not learned from; repeated rows are scored and counted each; without
training texts all counts are 0 and the classes uniform; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_arrow, removed, written

#: The end of a text; white space, so no word is equal to it.
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


class Words:
    """The words of a batch of texts, lower-cased, as one Arrow array, and how many each text has."""

    def __init__(self, texts: pa.Array):
        found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        flat, owner = found.flatten(), pc.list_parent_indices(found)
        full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
        self.flat = flat.filter(full)
        self.owner = owner.filter(full).to_numpy()
        self.size = np.bincount(self.owner, minlength=len(texts))

    def places(self, vocabulary: pa.Array) -> np.ndarray:
        """The place of each word in a vocabulary, -1 where it has none."""
        return pc.fill_null(pc.index_in(self.flat, vocabulary), -1).to_numpy()

    def with_ends(self, words: np.ndarray, end) -> np.ndarray:
        """Values of all words with ``end`` behind each text's."""
        out = np.full(len(words) + len(self.size), end, words.dtype)
        out[np.arange(len(words)) + self.owner] = words
        return out

    @property
    def begins(self) -> np.ndarray:
        """Where each text begins in ``with_ends``."""
        return np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64)


def parts(column: pa.Array, most: int = 1 << 23):
    """(first row, slice) of a column of texts, each with ``most`` bytes at most or one text."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield at, column.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(column):
        yield at, column.slice(at)


class Classes:
    """Class numbers of words: own classes first, then the tails by ending, then the start of a text."""

    def __init__(self, words: list[bytes], tails: int):
        self.words, self.tails = words, tails
        self.own = len(words)
        self.size = self.own + tails + 1
        self.start = self.size - 1
        self.vocabulary = pa.array(words, pa.binary()).cast(pa.string())
        # by the last two bytes, the second last first; a word of one byte has a row of its own
        tail = lambda x: self.own + zlib.crc32(x) % tails
        self._tails = np.array([tail(bytes([x, y])) for x in range(256) for y in range(256)] + [tail(bytes([y])) for y in range(256)], np.int32)
        self.end = words.index(END) if END in words else int(tail(END))

    def __getstate__(self):
        return self.words, self.tails

    def __setstate__(self, state):
        self.__init__(*state)

    def tail(self, words: pa.Array) -> np.ndarray:
        """The classes that words not empty have by their endings."""
        if not len(words):
            return np.empty(0, np.int32)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        last = data[ends[1:] - 1].astype(np.int64)
        before = np.where(ends[1:] - ends[:-1] > 1, data[np.maximum(ends[1:] - 2, 0)].astype(np.int64), 256)
        return self._tails[before * 256 + last]

    def of(self, words: Words) -> np.ndarray:
        """The classes of all words, an end behind each text's."""
        place = words.places(self.vocabulary).astype(np.int32)
        other = np.flatnonzero(place < 0)
        place[other] = self.tail(words.flat.take(pa.array(other)))
        return words.with_ends(place, self.end)

    def contexts(self, c: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes one and two places before each of ``c``, in texts that begin at ``begins``."""
        one, two = np.empty_like(c), np.empty_like(c)
        one[1:], two[2:] = c[:-1], c[:-2]
        one[begins] = two[begins] = self.start
        second = begins + 1
        two[second[second < len(c)]] = self.start
        return one, two


class LogBilinear:
    """Parameters, of single precision: context vectors r, output vectors q, position matrices m1, m2, biases b."""

    def __init__(self, frequency: np.ndarray, dim: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(frequency)
        self.noise = (frequency + 1e-3) / (frequency + 1e-3).sum()
        self.r = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
        self.q = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
        self.m1 = np.eye(dim, dtype=np.float32) * np.float32(0.5)
        self.m2 = np.eye(dim, dtype=np.float32) * np.float32(0.5)
        self.b = np.log(self.noise).astype(np.float32)

    NAMES = ("r", "q", "m1", "m2", "b")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def fresh_sums(self) -> dict[str, np.ndarray]:
        """Adagrad's sums before the first step."""
        return {k: np.full(getattr(self, k).shape, 0.1, np.float32) for k in self.NAMES}

    def train(self, windows: np.ndarray, *, batch: int = 1024, noise: int = 96, rate: float = 0.12, seed: int = 5, sums: dict[str, np.ndarray] | None = None) -> None:
        """One pass of noise-contrastive estimation over windows (context 1, context 2, class), with Adagrad.

        With ``sums`` of an earlier block the pass goes on from there."""
        rng = np.random.default_rng(seed)
        sums = self.fresh_sums() if sums is None else sums
        n = len(self.noise)
        log_noise = np.log(self.noise * noise).astype(np.float32)
        drawn = np.searchsorted(np.cumsum(self.noise), rng.random((len(windows) // batch + 1) * noise)).clip(0, n - 1).astype(np.uint16)
        # numbers of classes in 16 bits: gathered and sorted in linear time
        first, second, classes = windows[rng.permutation(len(windows))].T.astype(np.uint16, order="C")
        ones = np.ones(batch, np.float32)
        size, step_size = np.float32(batch), np.float32(rate * np.sqrt(batch))
        for step, at in enumerate(range(0, len(windows), batch)):
            h1, h2, w = first[at : at + batch], second[at : at + batch], classes[at : at + batch]
            v = drawn[step * noise : (step + 1) * noise]
            r1, r2 = self.r.take(h1, axis=0), self.r.take(h2, axis=0)
            context = r1 @ self.m1 + r2 @ self.m2
            qw, qv = self.q.take(w, axis=0), self.q.take(v, axis=0)
            bias = self.b - log_noise
            real = np.einsum("ij,ij->i", context, qw) + bias.take(w)
            fake = context @ qv.T
            fake += bias.take(v)
            # gradients of the log-likelihood of telling data from noise
            with np.errstate(over="ignore"):  # exp beyond single precision: the share is 0
                up = 1 / (1 + np.exp(real))
                np.negative(fake, out=fake)
                np.exp(fake, out=fake)
                fake += 1
                down = np.divide(-1, fake, out=fake)
            d_context = down @ qv
            d_context += up[:, None] * qw
            found = {
                "q": _added(np.concatenate([w, v]), np.concatenate([up[:, None] * context, (context.T @ down).T])),
                "r": _added(np.concatenate([h1, h2]), np.concatenate([d_context @ self.m1.T, d_context @ self.m2.T])),
                "b": (slice(None), (np.bincount(w, up, n) + np.bincount(v, ones[: len(w)] @ down, n)).astype(np.float32)),
                "m1": (slice(None), r1.T @ d_context),
                "m2": (slice(None), r2.T @ d_context),
            }
            for k, (rows, g) in found.items():  # rows without a gradient would not change
                g *= np.float32(1 / len(w))
                total = g * g
                total *= size
                total += sums[k][rows]
                sums[k][rows] = total
                np.sqrt(total, out=total)
                g *= step_size
                g /= total
                getattr(self, k)[rows] += g

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log tables a[h1, w], b[h2, w] and the normaliser z[h1, h2]: log p(w | h1, h2) = a + b - z.

        The start of a text, the last class, is never predicted."""
        r, q = self.r.astype(np.float64), self.q.astype(np.float64)
        a = r @ self.m1 @ q.T + self.b
        b = r @ self.m2 @ q.T
        a[:, -1] = -np.inf
        top_a, top_b = a.max(axis=1, keepdims=True), b[:, :-1].max(axis=1, keepdims=True)
        z = np.log(np.exp(a - top_a)[:, :-1] @ np.exp(b - top_b)[:, :-1].T) + top_a + top_b.T
        return a.astype(np.float32), b.astype(np.float32), z.astype(np.float32)


def _added(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of the values of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows.take(first).astype(np.intp), np.add.reduceat(values.take(order, axis=0), first, axis=0)


def word_counts(docs: DataFrame, text_col: str = "text", most: int = 500_000) -> DataFrame:
    """(word, c) over all texts, ends included; each task adds up its own words before the shuffle."""

    def run(batches):
        held: list[pa.Table] = []

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in batches:
            for _, part in parts(b.column(0)):
                found = pc.value_counts(Words(part).flat)
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                held.append(pa.table({"word": pa.array([END.decode()]), "n": pa.array([len(part)], pa.int64())}))
                if sum(t.num_rows for t in held) > 2 * most:  # bounded whatever the size of a partition
                    held = [added()]
                    if held[0].num_rows > most:
                        yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    return in_arrow(docs.select(text_col), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, hot: int, steps: int = 1 << 16) -> pa.Table:
    """(word, c) of the ``hot`` most frequent words, by count and then by word; fewer only where there are fewer.

    The least count that fits whole is found from how many words have each count, so no task sorts a vocabulary;
    of the words of the next count the first in the order of words fill up what is left."""
    shares = counts.groupBy(F.least("c", F.lit(steps)).alias("c")).agg(F.count("*").alias("n")).collect()  # steps rows at most
    whole, next_c, n = steps + 1, None, 0
    for r in sorted(shares, key=lambda r: -r.c):
        if n + r.n > hot:
            next_c = r.c
            break
        whole, n = r.c, n + r.n
    full = counts.where(F.col("c") >= whole)
    if next_c is not None and n < hot:  # the top of a sort: each task hands on so many rows at most
        full = full.unionByName(counts.where(F.least("c", F.lit(steps)) == next_c).orderBy(F.desc("c"), "word").limit(hot - n))
    return full.toArrow().sort_by([("c", "descending"), ("word", "ascending")])


def training_windows(docs: DataFrame, classes, length: int = 16_384) -> DataFrame:
    """Rows of classes of running text, each text behind two starts: every place from the third on is
    the end of one window, unless it is a start.  Rows overlap in two places and hold ``length`` windows at most."""

    def run(batches):
        own = classes.value
        for b in batches:
            for _, part in parts(b.column(0)):
                words = Words(part)
                c, begins = own.of(words), words.begins
                stream = np.full(len(c) + 2 * len(begins), own.start, "<u2")  # two starts before each text
                stream[np.arange(len(c)) + 2 * np.repeat(np.arange(1, len(begins) + 1), words.size + 1)] = c
                yield pa.RecordBatch.from_arrays([pa.array([stream[k : k + length + 2].tobytes() for k in range(0, len(stream) - 2, length)], pa.binary())], names=["w"])

    return in_arrow(docs.select("text"), run, "w binary")


def blocks(batches, start: int, rows: int = 1 << 18):
    """Windows (context 1, context 2, class) of the rows of ``training_windows``, about ``rows`` at a time."""
    held, n = [], 0
    for b in batches:
        for x in b.column(0):
            c = np.frombuffer(x.as_buffer(), "<u2")
            at = 2 + np.flatnonzero(c[2:] != start)
            held.append(np.column_stack([c[at - 1], c[at - 2], c[at]]))
            n += len(at)
            if n >= rows:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def train(windows: DataFrame, model: LogBilinear, rounds: int) -> LogBilinear:
    """Parameter averaging: each round every task trains from the common parameters on its windows."""
    spark = windows.sparkSession
    for k in range(rounds):
        common = spark.sparkContext.broadcast(model)

        def run(batches, common=common, k=k):
            mine = LogBilinear.__new__(LogBilinear)
            mine.__dict__.update(common.value.__dict__)
            mine.load(mine.flat())  # arrays of its own: a step changes them in place
            sums, n = mine.fresh_sums(), 0
            for own in blocks(batches, len(mine.noise) - 1):
                mine.train(own, seed=(TaskContext.get().partitionId() * 7 + k) + (n << 20), sums=sums)
                n += len(own)
            if not n:
                return
            flat = mine.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * n), pa.array(np.full(len(flat), n, np.int64))], names=["i", "v", "n"])

        mean = windows.mapInArrow(run, "i int, v double, n bigint").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if mean.num_rows:  # as many rows as the model has parameters
            flat = model.flat()
            flat[mean.column("i").to_numpy()] = mean.column("v").to_numpy()
            model.load(flat)
        common.unpersist()
    return model


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    held: int = 2,
    top: int = 511,
    spread: int = 32,
    most: int = 2047,
    tails: int = 256,
    hot: int = 200_000,
    rounds: int = 2,
    trainers: int = 2048,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); log10 throughout."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    training = picked.where(fold("id", modulus) != held)
    counts = written(word_counts(training), "counts")

    known = most_frequent(counts, hot)
    words = known.column("word").cast(pa.binary()).to_pylist()
    times = known.column("c").to_pylist()
    own = words[: max(top, min(counts.count() // spread, most))]
    tail_class = (F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % tails).cast("int")
    in_tail = ~F.col("word").isin([w.decode() for w in own]) if own else F.lit(True)
    sums = counts.groupBy(F.when(in_tail, tail_class).otherwise(-1).alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # tails + 1 rows
    n_all, v_all = sum(r.c for r in sums), sum(r.v for r in sums)
    tail_c, tail_v = np.zeros(tails), np.zeros(tails)
    for r in sums:
        if r.t >= 0:
            tail_c[r.t], tail_v[r.t] = r.c, r.v
    tail_all = tail_c + tail_v + 1

    classes = Classes(own, tails)
    frequency = np.concatenate([np.array(times[: len(own)], float), tail_c, [0.0]])
    shared = spark.sparkContext.broadcast(classes)
    windows = written(training_windows(training.select("text"), shared), "windows")
    model = train(windows.coalesce(trainers), LogBilinear(frequency), rounds)
    removed(windows)
    tables = spark.sparkContext.broadcast(model.tables())
    heads = spark.sparkContext.broadcast((known.column("word").combine_chunks(), np.array(times, np.int64)))
    log_all = float(np.log10(n_all + v_all + 1))

    def run(batches):
        own, (a, b, z) = shared.value, tables.value
        kept, c = heads.value
        width = a.shape[1]
        classed = np.arange(len(kept), dtype=np.int32)  # own classes are the first words
        classed[own.own :] = own.tail(kept.slice(own.own))
        classed = np.append(classed, -1)
        inside = np.zeros(len(c) + 1)
        inside[own.own : -1] = np.log10(c[own.own :] + 1) - np.log10(tail_all[classed[own.own : -1] - own.own])
        base = np.append(np.log10(c + 1) - log_all, 0.0)
        end = kept.index(END.decode()).as_py()  # -1: the last place of the tables above, which counts nothing
        first = TaskContext.get().partitionId() << 40

        def scored(ids: pa.Array, words: Words) -> pa.RecordBatch:
            place = words.places(kept)
            rare = np.flatnonzero(place < 0)
            w = classed[place]
            w[rare] = own.tail(words.flat.take(pa.array(rare)))
            w, at, begins = words.with_ends(w, own.end).astype(np.int64), words.with_ends(place, end), words.begins
            h1, h2 = own.contexts(w, begins)
            p = a.take(h1 * width + w).astype(np.float64)
            p += b.take(h2 * width + w)
            p -= z.take(h1 * len(z) + h2)
            by_text = lambda x: np.add.reduceat(x, begins)  # noqa: E731  every text has its end at least
            number = first + np.arange(len(begins))
            known = by_text((at >= 0).astype(np.int64))
            owner = words.owner[rare]
            words_left = words.flat.take(pa.array(rare))
            if end < 0:  # ends that no training text has are tokens like other rare ones
                owner, words_left = np.concatenate([owner, np.arange(len(begins))]), pa.concat_arrays([words_left, pa.array([END.decode()] * len(begins))])
            left = pa.table({"k": number[owner], "word": words_left}).group_by(["k", "word"]).aggregate([([], "count_all")])
            n, m = len(begins), left.num_rows
            column = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.concat_arrays([pa.array(number), left.column("k").combine_chunks()]),
                    column(words.size + 1, pa.int64()), column(known, pa.int64()), column(by_text(base[at]), pa.float64()), column(by_text(p) / np.log(10) + by_text(inside[at]), pa.float64()),
                    pa.concat_arrays([pa.nulls(n, pa.string()), left.column("word").combine_chunks()]), pa.concat_arrays([pa.nulls(n, pa.int64()), left.column("count_all").combine_chunks()]),
                ],
                names=["id", "k", "n_tokens", "n_known", "base", "score", "word", "times"],
            )

        for batch in batches:
            for start, part in parts(batch.column(1)):
                yield scored(batch.column(0).slice(start, len(part)), Words(part))
                first += len(part)

    out = written(in_arrow(picked, run, f"id {kind}, k bigint, n_tokens bigint, n_known bigint, base double, score double, word string, times bigint"), "scored")
    whole = out.where("word is null").drop("word", "times")
    c1 = F.log10(F.coalesce("c", F.lit(0)) + 1)
    tail_log = F.element_at(F.array(*(F.lit(float(x)) for x in np.log10(tail_all))), tail_class + 1)
    rare = (
        out.where("word is not null").select("k", "word", "times").join(counts, "word", "left")
        .select("k", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("rare_known"), (F.col("times") * (c1 - log_all)).alias("rare_base"), (F.col("times") * (c1 - tail_log)).alias("rare_score"))
        .groupBy("k").agg(F.sum("rare_known").alias("rare_known"), F.sum("rare_base").alias("rare_base"), F.sum("rare_score").alias("rare_score"))
    )
    both = whole.join(rare, "k", "left")
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return both.select(
        F.col("id").alias(id_col), F.coalesce(fold("id", modulus) == held, F.lit(False)).alias("held_out"), "n_tokens", plus("n_known", "rare_known").alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"), plus("base", "rare_base").alias("base_score"), plus("score", "rare_score").alias("score"),
    )
