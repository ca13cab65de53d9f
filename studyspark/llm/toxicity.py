"""Toxicity by noisy-channel deobfuscation.

Writers hide words by look-alike characters ("1d10t"), by spacing ("i d i o t",
"i.d.i.o.t") and by repetition ("idiooot").  The channel model turns a suspicious
token into a lattice: each position may stand for itself, for the letters that it
resembles, for nothing (a separator between letters), and a run of one letter for one
or two of it; between spaced characters there is a border of words or none.  A Viterbi search finds the restored word that is likeliest under a
character trigram model of the corpus, less the costs of the channel.  A token
without anything suspicious has one path, itself, and is not searched.

The restored text is scored by terms learned from labelled rows.  Terms are words
and their openings of ``OPENINGS`` letters that nearly only toxic documents hold, by a
likelihood-ratio test that counts near copies once.  A logistic regression on how many
terms and telling words a text holds gives the score.

The character model counts the trigrams of all texts (its size is the cube of a small
alphabet).  The terms are fitted on a bounded sample of labelled rows: at most
``max_labelled`` of each label, with at most ``max_chars`` characters of each, in the
order of the hashes of their ids.  Their terms are counted by Spark; the driver gets the
telling ones and a few numbers of each text.

Spacing is found in runs of three or more single characters.  A word that is only split
in two ("id iot") is not restored.

Edge cases: a null or empty text restores to nothing and scores as a text without
terms; without labels of both kinds all scores are the smoothed share of label 1; a
document labelled twice takes its larger label; null labels do not count; a null id
is scored, is not held out and is not learned from; repeated rows score alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, fold, in_arrow, labelled_sample, removed, written

# Which letters a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l",
}
SEPARATORS = ".-_*~'`^,/\\:;=#"
OPENINGS = (4, 5, 6)
#: Natural-log costs of the channel: reading a character as a letter it resembles, dropping a separator, shortening a run.
COST_LOOKALIKE, COST_DROP, COST_RUN = 0.7, 0.2, 0.3
#: A longer token is no word: it stays, and what it stands for is added to the text's words.
LONGEST = 64

_EDGE = re.compile(r"^[^\w$@!|+(]+|[^\w$@+]+$|^(?:([$@!|+(])\1+)+|(?:([$@+])\2+)$")
_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)[^\s.\-_*](?:[\s.\-_*]+[^\s.\-_*]){2,}[.\-_*]*(?!\S)")
_GAP = re.compile(r"[\s.\-_*]+")

#: The character model's alphabet: 0 the border of a word, 1-26 letters, 27 any other byte of a letter.
_K = 28
_CODE = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b).lower()
    _CODE[_b] = ord(_c) - 96 if _b < 128 and "a" <= _c <= "z" else 27 if _b >= 128 else 0


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of letter trigrams, borders included, flattened to an array of the alphabet's size cubed."""
    c = _CODE[np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)]
    return np.bincount((c[:-2] * _K + c[1:-1]) * _K + c[2:], minlength=_K**3)


def _codes(text: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0 for c in text]


class Restorer:
    """Viterbi restoration of suspicious tokens under a character trigram model."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(_K, _K, _K).astype(float)
        three = (n + 0.01) / (n.sum(axis=2, keepdims=True) + 0.01 * _K)
        two = (n.sum(axis=0) + 0.1) / (n.sum(axis=(0, 2))[:, None] + 0.1 * _K)
        self.log = np.log(0.9 * three + 0.1 * two[None]).tolist()
        self.token = Memo(self.restored)

    def restored(self, token: str) -> str:
        """The word that a lower-cased token without white space stands for."""
        word = _EDGE.sub("", token)
        if word.isalpha():
            return word if not _RUN.search(word) or len(word) > LONGEST else self.viterbi(word)
        return word if len(word) > LONGEST else self.decoded(word)

    def decoded(self, word: str) -> str:
        """The best path of a word with anything suspicious, else the word, whatever its length."""
        if word.isalpha():
            return self.viterbi(word) if _RUN.search(word) else word
        if any(c.isalpha() for c in word) and (any(c in LOOKALIKES or c in SEPARATORS for c in word) or _RUN.search(word)):
            return self.viterbi(word)
        return word

    def viterbi(self, word: str, borders: bool = False) -> str:
        """Best path of the lattice: states are the last two letters emitted.

        With ``borders`` a word may end, as a space, before any character but the first.  Paths are
        linked backwards, so the time is linear in the length."""
        runs: list[tuple[str, int]] = []
        for c, same in groupby(word):
            n = sum(1 for _ in same)
            runs += [(c, n)] if c.isalpha() and (n > 2 or not borders) else [(c, 1)] * n
        log = self.log
        states: dict = {(0, 0): (0.0, None)}
        for i, (c, n) in enumerate(runs):
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c * min(n, 2), 0.0 if n <= 2 else COST_RUN))
                if n >= 3:
                    options.append((c, COST_RUN))
            else:
                options += [(x, COST_LOOKALIKE) for x in LOOKALIKES.get(c, "")]
                if c in SEPARATORS or not options:
                    options.append(("", COST_DROP))
            if borders and i:
                options += [(" " + x, cost) for x, cost in options if x]
            steps = [(out, _codes(out), cost) for out, cost in options]
            after: dict = {}
            for (a, b), (score, path) in states.items():
                for out, codes, cost in steps:
                    x, y, s = a, b, score - cost
                    for z in codes:
                        s += log[x][y][z]
                        x, y = y, z
                    best = after.get((x, y))
                    if best is None or s > best[0]:
                        after[x, y] = (s, (path, out))
            states = after
        path = max(((s + log[a][b][0], path) for (a, b), (s, path) in states.items()), key=lambda e: e[0])[1]
        text = []
        while path is not None:
            path, out = path
            text.append(out)
        return "".join(reversed(text))

    def words(self, text: str) -> list[str]:
        """Restored words of a whole text, with those of each run of spaced single characters and of overlong tokens."""
        text = text.lower()
        tokens = text.split()
        out = list(map(self.token.__getitem__, tokens))
        for t in tokens:
            if len(t) > LONGEST:
                word = _EDGE.sub("", t)
                if len(word) > LONGEST and (found := self.decoded(word)) != word:
                    out.append(found)
        for m in _SPACED.finditer(text):
            if any(map(str.isspace, m[0])):  # else it is one token, restored above
                out += self.viterbi(_GAP.sub("", m[0]), borders=True).split()
        return out


def terms_of(word: str) -> list[str]:
    """A word and its openings (marked, so that an opening is not a word)."""
    return [word, *(word[:n] + "*" for n in OPENINGS if len(word) > n)] if len(word) >= 3 else []


def _family(words: list[str]) -> int:
    """The same number for most near copies of a text: the least hash of its longer words."""
    from xxhash import xxh3_64_intdigest

    return min((xxh3_64_intdigest(w) for w in words if len(w) > 7), default=0) >> 1 or min(map(xxh3_64_intdigest, words), default=0) >> 1


def telling_terms(sample: DataFrame, precision: float = 0.95) -> list[str]:
    """Terms whose documents are nearly all toxic, more often than chance lets any candidate be.

    ``sample``: (y, family, terms: the different terms of a text).  A term counts once for each
    family of near copies.  Candidates are the terms of more than two toxic families; one is kept
    when the likelihood ratio against an equal share in both samples exceeds what the best of all
    candidates reaches by chance.  What is kept is as large as the sample allows, no more."""
    sizes = {r.y: r.n for r in sample.select("y", "family").distinct().groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return []
    counted = sample.select("y", "family", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count_if(F.col("y") == 1).alias("n"), F.count_if(F.col("y") == 0).alias("m")).where("n > 2")
    candidates = written(counted, "terms")
    least = 2 * math.log(candidates.count() + 1) + 2
    share = n_toxic / (n_clean + n_toxic)
    n, m = F.col("n"), F.col("m")
    often = n / n_toxic >= precision * (n / n_toxic + m / n_clean)
    ratio = 2 * (n * F.log(n / ((n + m) * share)) + F.when(m > 0, m * F.log(m / ((n + m) * (1 - share)))).otherwise(0))
    kept = sorted(r.term for r in candidates.where(often & (ratio > least)).select("term").collect())
    removed(candidates)
    return kept


class ToxicTerms:
    """Counts of learned terms in restored words, and the logistic regression on them."""

    def __init__(self, terms: list[str], prior: float):
        self.terms, self.prior, self.weights = frozenset(terms), prior, None
        self._hit = Memo(lambda w: next((t for t in terms_of(w) if t in self.terms), ""))

    def __getstate__(self):
        return {"terms": self.terms, "prior": self.prior, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(state["terms"], state["prior"])
        self.weights = state["weights"]

    def found(self, words: set[str]) -> Counter:
        """For each term, how many different words of the text it tells."""
        hits = Counter(map(self._hit.__getitem__, words))
        hits.pop("", None)
        return hits

    @staticmethod
    def features(hits: Counter, n: int) -> list[float]:
        total = sum(hits.values())
        return [1.0, float(total > 0), math.log1p(len(hits)), math.log1p(total), math.log1p(1000 * total / max(n, 1)) / 5]

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 1e-2) -> ToxicTerms:
        """Newton's method on the penalised log-likelihood."""
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w.tolist()
        return self

    def score(self, words: list[str]) -> tuple[float, list[str]]:
        hits = self.found(set(words))
        if self.weights is None:
            return self.prior, sorted(hits)
        z = sum(a * b for a, b in zip(self.weights, self.features(hits, len(words)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), sorted(hits)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts: one array of fixed size for each task, summed by Spark."""

    def run(batches):
        total = np.zeros(_K**3, np.int64)
        for b in batches:
            total += trigram_counts(as_bytes(b.column(0)))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], names=["g", "n"])

    out = np.zeros(_K**3, np.int64)
    for r in in_arrow(docs.select(text_col), run, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():  # _K**3 rows at most
        out[r.g] = r.n
    return out


_MODELS: dict[bytes, Restorer] = {}


def restorer(counts: np.ndarray) -> Restorer:
    """One restorer for each worker and model: its memo outlives a task."""
    key = counts.tobytes()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Restorer(counts)
    return _MODELS[key]


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 5,
    held: int = 0,
    threshold: float = 0.5,
    max_labelled: int = 2500,
    max_chars: int = 40_000_000,
) -> DataFrame:
    """(id, held_out, score, predicted, terms) of every text."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    label = F.max(F.when(F.col(label_col) > 0, 1).otherwise(0))
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col, modulus) != held)).groupBy(F.col(id_col).alias("id")).agg(label.alias("y"))
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    counts = spark.sparkContext.broadcast(character_model(picked))

    def sampled(batches):
        words = restorer(counts.value).words
        for b in batches:
            found = [words(t or "") for t in b.column(1).to_pylist()]
            each = [sorted(set(w)) for w in found]
            terms = [sorted({t for w in ws for t in terms_of(w)}) for ws in each]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(_family, each), pa.int64()), pa.array([len(w) for w in found], pa.int64()), pa.array(each, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))],
                names=["y", "family", "n", "words", "terms"],
            )

    texts = labelled_sample(docs, known, id_col=id_col, text_col=text_col, rows=max_labelled, weight=F.length(F.coalesce("text", F.lit(""))), most=max_chars, by_label=True)
    sample = written(in_arrow(texts, sampled, "y int, family bigint, n bigint, words array<string>, terms array<string>"), "sample")
    model = ToxicTerms(telling_terms(sample), (share.get(1, 0) + 1) / (sum(share.values()) + 2))

    def measured(batches):
        for b in batches:
            x = [model.features(model.found(set(w)), n) for w, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    # five numbers of each text of the sample
    rows = sorted((r.y, tuple(r.x)) for r in in_arrow(sample.select("y", "n", "words"), measured, "y int, x array<double>").collect())
    removed(sample)
    y = np.array([k for k, _ in rows], float)
    if 0 in y and 1 in y:
        model.fit(np.array([x for _, x in rows]), y)
    kind = dict(docs.dtypes)[id_col]
    held_model = spark.sparkContext.broadcast(model)

    def scored(batches):
        words, own = restorer(counts.value).words, held_model.value
        for b in batches:
            out = [own.score(words(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([t for _, t in out], pa.list_(pa.string()))], names=["id", "score", "terms"])

    out = in_arrow(picked, scored, f"id {kind}, score double, terms array<string>")
    held_out = F.coalesce(fold("id", modulus) == held, F.lit(False))
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms")
