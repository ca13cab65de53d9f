"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad.  Its evidence is a weighted sum of its own
features and those of the lines before and after it; a 2 x 2 matrix joins the labels
of neighbouring lines.  Forward-backward gives each line's probability of being
good, and a document's score is their average weighted by the lines' lengths.

Training: the lines of a labelled document carry its label.  The model is fitted by
gradient ascent (Adam) on the penalised log-likelihood, on a bounded sample of the
labelled rows: at most ``max_labelled`` documents with at most ``max_lines`` lines
altogether, in the order of the hashes of their ids.  Only the sample's features reach
the driver.  Scoring covers every line of every text; chains are padded in blocks of
bounded size, so that a text of a million lines takes a block of its own.

Edge cases: a null or blank text has no lines and scores the share of label 1 in the
sample; without labels of both kinds every score is the smoothed share of label 1; a
document labelled twice takes its smaller label; null labels and labels of unknown
documents do not count; a null id is scored, is not held out and is not learned from;
repeated rows score alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold, in_arrow, labelled_sample

FEATURES = ("upper", "digit", "symbol", "bar", "high", "words", "word_length", "distinct", "stop", "tail_symbols", "length", "repeat")

_CLASS = np.zeros((256, 6), np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [
        "A" <= _c <= "Z",
        "0" <= _c <= "9",
        _b < 128 and not _c.isalnum() and not _c.isspace() and _c not in ".,'-",
        _c == "|",
        _b >= 128,
        _c.isascii() and _c.isalpha(),
    ]


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line that is not blank, their lengths in bytes)."""
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    if not lines:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    codes = np.frombuffer(b"".join(lines), np.uint8)
    sums = np.empty((len(lines), 6), np.int64)
    for j in range(6):
        sums[:, j] = np.add.reduceat(_CLASS[:, j][codes], starts)
    counted = np.empty((len(lines), 5))
    for i, line in enumerate(lines):
        words = line.lower().split()
        n = len(words)
        counted[i] = n, len(set(words)), line.rstrip()[-1:] in b".!?", sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".," for w in words), sum(map(bytes.__eq__, words, words[1:]))
    n = np.maximum(counted[:, 0], 1)
    letters = np.maximum(sums[:, 5], 1)
    out = np.column_stack([
        sums[:, 0] / letters, sums[:, 1] / size, sums[:, 2] / size, sums[:, 3] / n, sums[:, 4] / size, np.log1p(n), np.minimum(size / n, 30) / 10,
        counted[:, 1] / n, counted[:, 2], counted[:, 3] / n, np.log1p(size), counted[:, 4] / n,
    ])
    return out.astype(np.float32), size


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros beyond the ends), and a constant."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    return np.column_stack([x, np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none]), np.ones(len(x), x.dtype)])


def _logsum(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=-1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=-1, keepdims=True)))[..., 0]


def _block(evidence: list[np.ndarray], joint: np.ndarray):
    """``forward_backward`` of a few chains, padded to the longest.

    Chains are sorted by length, so that every step works on those still running."""
    order = np.argsort([-len(e) for e in evidence], kind="stable")
    longest = len(evidence[order[0]])
    lengths = np.array([len(evidence[i]) for i in order])
    score = np.zeros((len(order), longest, 2))
    for r, i in enumerate(order):
        score[r, : len(evidence[i]), 1] = evidence[i]
    alive = [int((lengths > t).sum()) for t in range(longest + 1)]
    alpha, beta = score.copy(), np.zeros_like(score)
    for t in range(1, longest):
        k = alive[t]
        alpha[:k, t] += _logsum(alpha[:k, t - 1, None, :] + joint.T[None])
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        beta[:k, t] = _logsum(joint[None] + (score[:k, t + 1] + beta[:k, t + 1])[:, None, :])
    total = _logsum(alpha[np.arange(len(order)), lengths - 1])
    good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
    pairs = np.zeros((2, 2))
    for t in range(1, longest):
        k = alive[t]
        pairs += np.exp(alpha[:k, t - 1, :, None] + joint[None] + (score[:k, t] + beta[:k, t])[:, None, :] - total[:k, None, None]).sum(axis=0)
    back = np.argsort(order)
    return [good[r, : lengths[r]] for r in back], pairs, total[back]


def padded_blocks(lengths: list[int], cells: int = 1 << 18, most: int = 1024) -> list[list[int]]:
    """Places of the chains that are not empty, like lengths together: no block has more than ``cells``
    padded lines unless it is one chain."""
    out: list[list[int]] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lengths.__getitem__):
        if not out or len(out[-1]) == most or (len(out[-1]) + 1) * lengths[i] > cells:
            out.append([])
        out[-1].append(i)
    return out


def forward_backward(evidence: list[np.ndarray], joint: np.ndarray):
    """P(good) of each line, pair marginals summed, and log partition of each of many chains.

    ``evidence``: the log weight of good against bad, one array for each chain; an empty chain has
    no line and log partition 0."""
    good: list = [np.zeros(0)] * len(evidence)
    pairs, total = np.zeros((2, 2)), np.zeros(len(evidence))
    for part in padded_blocks([len(e) for e in evidence]):
        found, joined, total[part] = _block([evidence[i] for i in part], joint)
        pairs += joined
        for i, g in zip(part, found, strict=True):
            good[i] = g
    return good, pairs, total


class LineCrf:
    """Weights of the evidence, the joint matrix, and the scaling of the features."""

    def __init__(self, prior: float):
        self.prior, self.weights = prior, None

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, *, rounds: int = 120, rate: float = 0.08, penalty: float = 0.004) -> LineCrf:
        if len(docs) == 0 or labels.min() == labels.max():
            return self
        lines = np.concatenate(docs)
        self.mean, self.scale = lines.mean(axis=0), lines.std(axis=0) + 1e-3
        xs = [with_neighbours((d - self.mean) / self.scale) for d in docs]
        x = np.concatenate(xs)
        cuts = np.cumsum([len(d) for d in docs])[:-1]
        y = np.repeat(labels, [len(d) for d in docs])
        theta = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        seen = np.zeros((2, 2))
        for label in (0, 1):
            seen[label, label] = sum(len(d) - 1 for d, k in zip(docs, labels, strict=True) if k == label)
        for step in range(1, rounds + 1):
            w, joint = theta[:-4], theta[-4:].reshape(2, 2)
            good, pairs, _ = forward_backward(np.split(x @ w.astype(np.float32), cuts), joint)
            gradient = np.concatenate([x.T @ (y - np.concatenate(good)).astype(np.float32), (seen - pairs).ravel()]) / len(docs) - penalty * theta
            m = 0.9 * m + 0.1 * gradient
            v = 0.99 * v + 0.01 * gradient**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.joint = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.weights is None:
            return out
        found = [line_features(t) for t in texts]
        good, _, _ = forward_backward([self.evidence(x) for x, _ in found], self.joint)
        for i, (g, (_, size)) in enumerate(zip(good, found, strict=True)):
            if len(g):
                out[i] = np.clip(np.average(g, weights=size), 0, 1)
        return out

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log weight of good against bad of each line: ``with_neighbours`` times the weights, part by part."""
        own, before, after = np.split(self.weights[:-1], 3)
        x = (x - self.mean) / self.scale
        out = x @ own + self.weights[-1]
        out[1:] += (x @ before)[:-1]
        out[:-1] += (x @ after)[1:]
        return out


def sample_features(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, modulus: int, held: int, max_labelled: int, max_lines: int):
    """The bounded training sample: features of each document's lines, and labels."""
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col, modulus) != held)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    lines = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"))) + 1
    picked = labelled_sample(docs, known, id_col=id_col, text_col=text_col, rows=max_labelled, weight=lines, most=max_lines, by_label=False)

    def run(batches):
        for b in batches:
            x = [line_features(t)[0] for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in x], pa.int32()), pa.array([f.tobytes() for f in x], pa.binary())], names=["y", "n", "x"])

    rows = in_arrow(picked, run, "y int, n int, x binary").where("n > 0").collect()
    rows.sort(key=lambda r: (r.y, r.n, bytes(r.x)))  # the order of rows does not change the fit
    return [np.frombuffer(r.x, np.float32).reshape(r.n, -1) for r in rows], np.array([min(max(r.y, 0), 1) for r in rows], float)


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 4, held: int = 2, max_labelled: int = 4000, max_lines: int = 400_000) -> LineCrf:
    x, y = sample_features(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, modulus=modulus, held=held, max_labelled=max_labelled, max_lines=max_lines)
    return LineCrf(float((y.sum() + 1) / (len(y) + 2))).fit(x, y)


def kept(docs: DataFrame, model: LineCrf, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores(as_bytes(b.column(place))) >= threshold))

    return in_arrow(docs, run, docs.schema)


def quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 4,
    held: int = 2,
    threshold: float = 0.7,
    max_labelled: int = 4000,
    max_lines: int = 400_000,
) -> DataFrame:
    """(id, held_out, score, predicted) of every text."""
    model = fitted(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, modulus=modulus, held=held, max_labelled=max_labelled, max_lines=max_lines)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(as_bytes(b.column(1))), pa.float64())], names=["id", "score"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = in_arrow(picked, run, f"id {kind}, score double")
    held_out = F.coalesce(fold("id", modulus) == held, F.lit(False))
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
