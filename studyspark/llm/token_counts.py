"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes a linked list of symbols; a heap holds the adjacent pairs whose
concatenation is a piece of the vocabulary, best rank first and leftmost among
equals.  Pairs are popped and merged until none is left, so the count is the
number of initial symbols minus the number of merges; identifiers are never
built.  A character that the vocabulary lacks stands as its UTF-8 bytes (byte
fallback), which never merge.

A merge never crosses a place where no piece can reach: pieces hold the space
sign only at their front, and no piece holds a line feed.  So the count of a text
is the sum over its space-led words, and words are counted once and remembered.

Only models of this kind are taken: byte-pair merging with byte fallback, no normaliser,
a space sign before the text, no pieces added by a user.  Any other is refused, since its
counts would differ.

Edge cases: a very long text is one list of words, a very long word one list of symbols
and a heap of its pairs, so time grows with length times its logarithm; a null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated results; a null id is passed through; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_arrow

SPACE = "▁"


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message: integers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


def unlike(model: bytes) -> list[str]:
    """Why a model's counts would not be those of ``PieceCounter``; nothing if they are."""
    # fixed values: the numbers of the model file's fields, and their defaults
    trainer, normaliser, kinds = {3: 1, 35: 0}, {2: b"", 3: 1, 4: 1, 5: 1}, set()
    for number, value in _fields(model):
        if number == 1:
            kinds.add(dict(_fields(value)).get(3, 1))
        elif number in (2, 3):
            (trainer if number == 2 else normaliser).update(_fields(value))
    reasons = {
        "it is not byte-pair merging": trainer[3] != 2,
        "it has no byte fallback": not trainer[35],
        "it normalises texts": bool(normaliser[2]) or bool(normaliser[4]),
        "it puts no space sign before a text": not normaliser[3] or not normaliser[5],
        "it has pieces of a user": 4 in kinds,
    }
    return [why for why, holds in reasons.items() if holds]


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE vocabulary with byte fallback."""

    def __init__(self, model_file: str, limit: int = 600_000):
        import sentencepiece

        with open(model_file, "rb") as f:
            model = f.read()
        if why := unlike(model):
            raise ValueError(f"{model_file}: {', '.join(why)}")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank = {
            sp.id_to_piece(i): -sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
        }
        apart = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        feeds = any("\n" in p for p in self.rank)
        if apart or feeds:  # a vocabulary whose pieces cross words: the text is one segment
            self._segments = lambda s: [s]
        else:
            self._segments = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall
        self._memo = Memo(self.merged, limit)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self._memo.__getitem__, self._segments(SPACE + text.replace(" ", SPACE))))

    def merged(self, segment: str) -> int:
        """Initial symbols minus merges of one segment."""
        rank = self.rank
        total = 0
        for c in segment:
            total += 1 if c in rank else len(c.encode())
        n = len(segment)
        if n == 1:
            return total
        part = list(segment)  # None once merged into its left neighbour
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(rank[p], i, 2) for i in range(n - 1) if (p := segment[i : i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = part[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(part[j]) != size:
                continue  # either side has changed since the pair was pushed
            left = part[i] = left + part[j]
            part[j] = None
            total -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := left + part[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, len(p)))
            h = before[i]
            if h >= 0 and (p := part[h] + left) in rank:
                heapq.heappush(heap, (rank[p], h, len(p)))
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    """One counter for each worker process; its memo lives as long as the worker."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PieceCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text; ``over_limit``: more than ``limit`` tokens."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        count = counter(model_file).count
        for b in batches:
            tokens = [count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    # bound as projections: other columns never leave the scan
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = in_arrow(picked, run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
