"""Byte-level byte-pair encoding and decoding by a vocabulary of ranks.

Words (the matches of the vocabulary's pattern) are encoded by Spark's higher-order functions:
a fold over the bytes of a word, each step merging the adjacent pair of the lowest rank, leftmost
first.  The ranks are a literal map from two adjacent pieces to the rank of their concatenation (dealt
into an array of short arrays, as Spark searches a map from its start); a piece is known by its rank.

Words repeat, so each frequent word is folded once: all words are counted over all documents,
and the most frequent ones, up to ``held`` words and 24 MB, are folded as a table of distinct words
and sent to the tasks that put documents together.  The others are rare, hence about as many as
their occurrences: the distinct ones of a document are folded beside the document, by the same
expression.  So texts are never shuffled, and nothing sent grows with the input.  Which words are
sent has no influence on the result.

A fold's work grows with the square of a word's length.  Words of over ``longest`` bytes (white
space, digits in thousands, scripts without spaces) are merged by a heap over a linked list
instead, with equal results; vocabulary words need no merging at all.

Decoding concatenates the pieces' bytes.

Edge cases: null and empty texts have no ids and decode to nothing; any text decodes to its own
bytes; special strings are text; very long texts are one list of words; repeated rows are encoded
each; a null id is passed through; other columns are ignored; an empty table gives an empty
result; an id that the vocabulary lacks is an error.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, table, written

#: Pairs of pieces are numbered from here on, so that no rank is as large.
_PAIR = 1 << 44
#: Arrays of so many short arrays hold the ranks of pairs.
_PLACES = 1 << 17
#: In a row of ids, numbers from here on stand for the document's own rare words.
_GAP = 1 << 31


def read_ranks(ranks_file: str) -> dict[bytes, int]:
    """Piece and rank of every line of a rank file."""
    with open(ranks_file, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, f))}


def rank_map(ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """The literal map from two pieces to the rank of their concatenation, and the pieces of single bytes.

    Pieces are known by their ranks.  Each short array holds the pairs of one remainder, every number of a pair
    followed by its rank."""
    places: list[list[int]] = [[] for _ in range(_PLACES)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            first, second = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if first is not None and second is not None:
                places[(31 * first + second) % _PLACES] += [_PAIR + (first << 22) + second, rank]
    single = [ranks[bytes([i])] for i in range(256)]
    return F.from_json(F.lit(json.dumps(places)), "array<array<bigint>>"), F.from_json(F.lit(json.dumps(single)), "array<bigint>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word: Column, pairs: Column, single: Column) -> Column:
    """Ids of a word (binary, two bytes at least): lowest rank first, leftmost among equals."""

    def rank(first: Column, second: Column) -> Column:
        # of a pair that is not there the number of another pair or null: no rank
        place = F.get(pairs, (first * 31 + second).bitwiseAND(F.lit(_PLACES - 1)).cast("int"))
        return F.get(place, F.array_position(place, first * (1 << 22) + second + _PAIR).cast("int"))

    def of_pairs(pieces: Column) -> Column:
        of = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: rank(F.get(pieces, i - 1), F.get(pieces, i)))
        return F.struct(pieces.alias("pieces"), of.alias("ranks"))

    def merged(s: Column, at: Column, piece: Column) -> Column:
        gone = F.lit(-1).cast("bigint")  # what is merged away, for a moment
        pieces = F.transform(s["pieces"], lambda x, i: F.when(i == at, piece).when(i == at + 1, gone).otherwise(x))
        before, after = lambda i: rank(F.get(s["pieces"], i), piece), lambda i: rank(piece, F.get(s["pieces"], i + 1))
        ranks = F.transform(s["ranks"], lambda x, i: F.when(i == at, gone).when(i == at - 1, before(i)).when(i == at + 1, after(i)).otherwise(x))
        return F.struct(F.array_remove(pieces, gone).alias("pieces"), F.array_remove(ranks, gone).alias("ranks"))

    def step(s: Column, _: Column) -> Column:
        at = lambda best: F.array_position(s["ranks"], best).cast("int") - 1
        return _let(F.array_min(s["ranks"]), lambda best: F.when(best < _PAIR, _let(at(best), lambda i: merged(s, i, best))).otherwise(s))

    bytes_ = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.get(single, F.ascii(c)))
    done = F.aggregate(F.sequence(F.lit(1), F.octet_length(word) - 1), _let(bytes_, of_pairs), step)
    return F.transform(done["pieces"], lambda x: x.cast("int"))


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a heap of pairs and a linked list, in time about proportional to the length."""
    part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        left, j = part[i], after[i]
        if left is None or j >= n or left + part[j] != pair:
            continue  # one side has changed since
        part[i], part[j] = pair, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (p := pair + part[k]) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        h = before[i]
        if h >= 0 and (p := part[h] + pair) in ranks:
            heapq.heappush(heap, (ranks[p], h, p))
    return [ranks[p] for p in part if p is not None]


def _packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _classes(text: str) -> dict[str, str]:
    """Letters, numbers and white space among the characters of ``text``, as the insides of classes; their Unicode tables are the library's."""
    import regex

    runs = lambda kind: (m[0] for m in regex.finditer(f"{kind}+", text))
    return {kind: "".join(f"{re.escape(r[0])}-{re.escape(r[-1])}" for r in runs(kind)) for kind in (r"\p{L}", r"\p{N}", r"\s")}


def _in_python(pattern: str, classes: dict[str, str]) -> str:
    """The pattern as it works on texts of the characters that ``classes`` were made of, in the syntax of Python's own expressions."""
    parts = re.split(r"(\[[^]]*\])", pattern)
    for i, part in enumerate(parts):
        for kind, inside in classes.items():
            part = part.replace(kind, inside if i % 2 else f"[{inside}]")
        parts[i] = part if i % 2 else part.replace(r"\S", f"[^{classes[r'\s']}]")
    return "".join(parts)


class _Known(dict):
    """Packed ids of words; what is not there is asked for each time and not kept."""

    def __init__(self, ask):
        super().__init__()
        self._ask = ask

    def __missing__(self, word: str) -> bytes:
        return self._ask(word)


class _Words:
    """Splits texts into words and looks their ids up; each worker process has one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, longest: int, folded: pa.Table | None = None):
        import regex

        self._any = self._ascii = self._plane = regex.compile(pattern).findall
        self._astral = re.compile("[\U00010000-\U0010ffff]").search
        # Python's own engine is twice as fast; it gets the classes spelled out, for the characters of one plane
        plane = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
        own = [_in_python(pattern, _classes(chars)) for chars in (plane[:128], plane)]
        if not any(re.search(r"\\[pPS]|\(\?i", p) for p in own):
            self._ascii, self._plane = (re.compile(p).findall for p in own)
        self._ranks, self._longest = ranks, longest
        self.known = _Known(self._unknown)
        for b in folded.to_batches(10_000) if folded is not None else ():
            for word, ids in zip(b.column(0).cast(pa.string()).to_pylist(), b.column(1).to_pylist(), strict=True):
                self.known[word] = _packed(ids)
        for piece, rank in ranks.items():
            try:
                self.known[piece.decode()] = _packed((rank,))
            except UnicodeDecodeError:
                pass  # half a character is never a word

    def words(self, text: str) -> list[str]:
        return (self._ascii if text.isascii() else self._any if self._astral(text) else self._plane)(text)

    def foldable(self, word: bytes) -> bool:
        return word not in self._ranks and len(word) <= self._longest

    def _unknown(self, word: str) -> bytes:
        if self.foldable(word.encode()):
            return _packed((_GAP + self._gaps.setdefault(word, len(self._gaps)),))
        return _packed(merged_ids(word.encode(), self._ranks))

    def row(self, text: str) -> tuple[bytes, list[str]]:
        """(packed ids with gaps, the distinct words that the gaps stand for)."""
        self._gaps: dict[str, int] = {}
        return b"".join(map(self.known.__getitem__, self.words(text))), list(self._gaps)


def _closed(ids: bytes, words: list[bytes]) -> bytes:
    """Ids with every gap filled by the ids of its word."""
    numbers = np.frombuffer(ids, "<u4")
    out, last = [], 0
    for at in np.flatnonzero(numbers >= _GAP).tolist():
        out += [ids[4 * last : 4 * at], words[int(numbers[at]) - _GAP]]
        last = at + 1
    return b"".join([*out, ids[4 * last :]])


_WORKER: dict[tuple, object] = {}


def _kept_in_worker(key: tuple, make):
    """The last value that this worker process made; what an earlier step held is let go before the next is made."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def _let_go() -> None:
    _WORKER.clear()


def frequent_words(texts: DataFrame, ranks_file: str, pattern: str, *, held: int, longest: int, most_bytes: int = 24 << 20, pending: int = 150_000) -> DataFrame:
    """(word) of the words that occur most in all texts, at most ``held`` and ``most_bytes``: whole classes of
    similar counts from the top.  A word that no task sees twice is not among them."""

    def run(batches):
        words = _kept_in_worker(("split", ranks_file, pattern, longest), lambda: _Words(read_ranks(ranks_file), pattern, longest))
        found: Counter = Counter()

        def counted():
            often = {w: n for word, n in found.items() if n > 1 and words.foldable(w := word.encode())}
            return pa.RecordBatch.from_arrays([pa.array(list(often), pa.binary()), pa.array(list(often.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    found.update(words.words(text))
            if len(found) > pending:
                yield counted()
                found.clear()
        yield counted()

    counts = in_arrow(texts, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.select("word", F.floor(F.log2("n") * 16).alias("level"), F.pmod(F.xxhash64("word"), F.lit(64)).alias("part"))
    counts = written(counts, "words")
    taken = None
    for r in sorted(counts.groupBy("level", "part").agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).collect(), key=lambda r: (-r.level, r.part)):
        held, most_bytes = held - r.n, most_bytes - r.bytes
        if held < 0 or most_bytes < 0:
            break
        taken = r
    if taken is None:
        return counts.select("word").limit(0)
    return counts.where((F.col("level") > taken.level) | ((F.col("level") == taken.level) & (F.col("part") <= taken.part))).select("word")


def _with_gaps(docs: DataFrame, ranks_file: str, pattern: str, *, id_col: str, text_col: str, held: int, longest: int) -> DataFrame:
    """(id, ids, gaps) of every text: packed ids, and the ids of the words that its gaps stand for."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    ranks = read_ranks(ranks_file)
    pairs, single = rank_map(ranks)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    head = frequent_words(texts, ranks_file, pattern, held=held, longest=longest)
    ids = written(head.select("word", _let(pairs, lambda m: folded(F.col("word"), m, single)).alias("ids")), "folded")
    sent = spark.sparkContext.broadcast(ids.toArrow())  # flat buffers: some 25 bytes a word
    number = sent._jbroadcast.id()

    def split(batches):
        words = _kept_in_worker(("encode", number, ranks_file), lambda: _Words(read_ranks(ranks_file), pattern, longest, sent.value))
        for b in batches:
            rows = [words.row(t) if t else (b"", []) for t in b.column(1).to_pylist()]
            gaps = pa.array([g for _, g in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i for i, _ in rows], pa.binary()), gaps], names=["id", "ids", "gaps"])

    # written, so that a task holds one Python worker with the words, not one for each step
    opened = written(in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), split, f"id {kind}, ids binary, gaps array<string>"), "opened", "zstd")
    rare = _let(pairs, lambda m: F.transform("gaps", lambda w: folded(w.cast("binary"), m, single)))
    return opened.select("id", "ids", rare.alias("gaps"))


def _filled(batch: pa.RecordBatch) -> list[bytes]:
    """Packed ids of the rows (id, ids, gaps) of a batch, without gaps."""
    return [_closed(i, [_packed(w) for w in words]) if words else i for i, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]


def encode(docs: DataFrame, ranks_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, held: int = 400_000, longest: int = 96) -> DataFrame:
    """(id, ids) of every text; ids: an array, or with ``packed`` little-endian 32-bit numbers as binary."""
    rows = _with_gaps(docs, ranks_file, pattern, id_col=id_col, text_col=text_col, held=held, longest=longest)

    def close(batches):
        _let_go()  # the words are needed no more
        for b in batches:
            filled = _filled(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(filled, pa.binary()) if packed else pa.array([np.frombuffer(x, "<i4") for x in filled], pa.list_(pa.int32()))], names=["id", "ids"])

    closed = in_arrow(rows, close, f"id {dict(rows.dtypes)['id']}, ids {'binary' if packed else 'array<int>'}")
    return closed.select(F.col("id").alias(id_col), "ids")


def _decoder(ranks_file: str):
    """Bytes of packed ids; each worker process reads the pieces once."""
    pieces = _kept_in_worker(("decode", ranks_file), lambda: {rank: piece for piece, rank in read_ranks(ranks_file).items()})
    return lambda packed: b"".join(map(pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def decode(encoded: DataFrame, ranks_file: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, bytes) of a table made by ``encode``, in either form: the concatenated pieces of the ids."""
    kinds = dict(encoded.dtypes)

    def run(batches):
        decoded = _decoder(ranks_file)
        for b in batches:
            texts = [decoded(x if isinstance(x, bytes) else _packed(x or ())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["id", "ids", "bytes"])

    out = in_arrow(encoded.select(F.col(id_col).alias("id"), "ids"), run, f"id {kinds[id_col]}, ids {kinds['ids']}, bytes binary")
    return out.select(F.col("id").alias(id_col), "ids", "bytes")


def encode_and_decode(docs: DataFrame, ranks_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", held: int = 400_000, longest: int = 96) -> DataFrame:
    """(id, ids, bytes) as ``decode`` gives them for packed ids of ``encode``, by one Python worker a task instead of two."""
    rows = _with_gaps(docs, ranks_file, pattern, id_col=id_col, text_col=text_col, held=held, longest=longest)

    def run(batches):
        decoded = _decoder(ranks_file)
        for b in batches:
            filled = _filled(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(filled, pa.binary()), pa.array(map(decoded, filled), pa.binary())], names=["id", "ids", "bytes"])

    out = in_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, ids binary, bytes binary")
    return out.select(F.col("id").alias(id_col), "ids", "bytes")


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = encode_and_decode(table(spark, sf_dir, "documents"), ranks_file, public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
