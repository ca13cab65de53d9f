"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document's tokens are cut
into full windows; the rest goes whole into the open window that it fills best.
When it fits none, a free place opens a new window; without one the fullest window
is emitted: as it is when at most ``slack`` tokens are missing, else after the head
of the document has filled it up.  What is still open at the end of the partitions
is merged by groups of partitions: its pieces are laid end to end into full
windows, and the one unfinished window of a group is cut into power-of-two lengths,
which need no padding.

Memory: open windows only (``windows`` x ``size`` ids a partition).  Documents are
tokenised chunk by chunk (a chunk is an optional space and the non-space run after
it, or white space), since the byte-level pattern never joins across such a border;
chunks are encoded once and remembered.  A text with special strings or control
separators is encoded whole.  Chunks not yet remembered are encoded from the
tokenizer's own vocabulary by an encoder on ranks, which gives the same ids (tests
compare them); where the vocabulary's form does not promise that, by the tokenizer.

Edge cases: a null text is empty and packs as the single end id; repeated rows are
packed each; a null id is passed through; an empty table packs to nothing; other
columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_arrow, written

_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
_ODD = re.compile(r"[\x1c-\x1f\x85᠎​﻿]").search


#: Fixed value: the pattern by which byte-level tokenizers split text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_ranks(tokenizer_file: str):
    """A quicker encoder of the same vocabulary, or None where it could give other ids.

    It needs plain byte-level pre-tokenisation and merges whose ids are in the order of the merges."""
    import json

    import tiktoken

    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if spec.get("normalizer") or not plain or model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    if made != sorted(made) or len(vocab.keys() - special) != len(made) + 256:
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ChunkedIds:
    """Token ids of a byte-level BPE tokenizer as little-endian 32-bit bytes."""

    def __init__(self, tokenizer_file: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        quick = _by_ranks(tokenizer_file)
        self._memo = Memo((lambda chunk: _packed(quick(chunk))) if quick else self.whole, limit)

    def whole(self, text: str) -> bytes:
        return _packed(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if _ODD(text) or any(s in text for s in self._special):
            return self.whole(text)
        return b"".join(map(self._memo.__getitem__, _CHUNK(text)))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_IDS: dict[str, ChunkedIds] = {}


def chunked_ids(tokenizer_file: str) -> ChunkedIds:
    if tokenizer_file not in _IDS:
        _IDS[tokenizer_file] = ChunkedIds(tokenizer_file)
    return _IDS[tokenizer_file]


class Packer:
    """Best-fit packing into at most ``windows`` open windows of ``size`` ids.

    ``done`` gets (pieces) of every finished window; a piece is (doc, start, ids as
    bytes, ids of the document)."""

    def __init__(self, size: int, windows: int, slack: int, done):
        self.size, self.windows, self.slack, self.done = size, windows, slack, done
        self.open: list[list] = []
        self.used: list[int] = []

    def add(self, doc, ids: bytes) -> None:
        total, start, size = len(ids) // 4, 0, self.size
        while total - start >= size:
            self.done([(doc, start, ids[4 * start : 4 * (start + size)], total)])
            start += size
        while start < total:
            need, best = total - start, -1
            for i, u in enumerate(self.used):
                if u + need <= size and (best < 0 or u > self.used[best]):
                    best = i
            if best < 0 and len(self.open) < self.windows:
                best = len(self.open)
                self.open.append([])
                self.used.append(0)
            if best < 0:
                best = max(range(len(self.used)), key=self.used.__getitem__)
                if size - self.used[best] <= self.slack:
                    self.close(best)
                    continue
                need = size - self.used[best]
            self.open[best].append((doc, start, ids[4 * start : 4 * (start + need)], total))
            self.used[best] += need
            start += need
            if self.used[best] == size:
                self.close(best)

    def close(self, i: int) -> None:
        self.done(self.open[i])
        last, used = self.open.pop(), self.used.pop()
        if i < len(self.open):
            self.open[i], self.used[i] = last, used


def merge(windows: list[list], size: int):
    """Lay the pieces of unfinished windows end to end; yields windows, the last ones of power-of-two lengths."""
    left = sum(len(p[2]) // 4 for w in windows for p in w)
    now: list = []
    room = length = min(size, left) if left >= size else 1 << (left.bit_length() - 1) if left else 0
    for w in windows:
        for doc, start, ids, total in w:
            while ids:
                part = ids[: 4 * room]
                now.append((doc, start, part, total))
                ids, start, room = ids[len(part) :], start + len(part) // 4, room - len(part) // 4
                if not room:
                    yield now
                    now, left = [], left - length
                    room = length = size if left >= size else 1 << (left.bit_length() - 1) if left else 0


_OUT = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _rows(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 9
    kinds = [kind, *[pa.int64()] * 6, pa.binary(), pa.int64()]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "grp"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _laid(window: list, sequence: int):
    offset = 0
    for doc, start, ids, total in window:
        n = len(ids) // 4
        yield (doc, start, n, zlib.crc32(ids), total, sequence, offset, None, None)
        offset += n


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    windows: int = 64,
    slack: int = 4,
    end_id: int = 0,
    merge_partitions: int = 16,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = dict(docs.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, out, count = TaskContext.get().partitionId(), [], 0
        encode = chunked_ids(tokenizer_file).ids

        def done(window):
            nonlocal count
            out.extend(_laid(window, part << 32 | count))
            count += 1

        packer, arrow = Packer(size, windows, slack, done), None
        for b in batches:
            arrow = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc, (encode(text) if text else b"") + end)
            yield _rows(arrow, out)
            out = []
        for k, window in enumerate(packer.open):
            out.extend((doc, start, len(ids) // 4, None, total, part << 32 | k, j, ids, part // merge_partitions) for j, (doc, start, ids, total) in enumerate(window))
        if out:
            yield _rows(arrow, out)

    def leftovers(key, t):
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        groups: dict[int, list] = {}
        cols = [t.column(n).to_pylist() for n in ("sequence_id", "id", "start", "ids", "doc_tokens")]
        for s, doc, start, ids, total in zip(*cols, strict=True):
            groups.setdefault(s, []).append((doc, start, ids, total))
        fullest = sorted(groups, key=lambda s: (-sum(len(p[2]) for p in groups[s]), s))
        rows, first = [], 1 << 62 | key[0].as_py() << 32
        for n, window in enumerate(merge([groups[s] for s in fullest], size)):
            rows.extend(r[:7] for r in _laid(window, first | n))
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [t.column("id").type, *[pa.int64()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # written once: the texts are tokenised one time for the finished and the open windows alike
    first = written(in_arrow(picked, run, f"id {kind}, {_OUT}, ids binary, grp bigint"), "packing")
    finished = first.where(F.col("grp").isNull()).drop("ids", "grp")
    merged = first.where(F.col("grp").isNotNull()).groupBy("grp").applyInArrow(leftovers, f"id {kind}, {_OUT}")
    return finished.unionByName(merged).withColumnRenamed("id", id_col)
