import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyspark.llm import lm_scoring, quality_crf, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def auc(score, label):
    a, b = score[label == 1], score[label == 0]
    return (a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()


def judged(df, labels, label):
    rows = df.join(labels.select("doc_id", label), "doc_id").where("held_out").collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])


def test_quality_on_held_out_labels(larger):
    out = quality_crf.quality(*larger)
    score, label, predicted = judged(out, larger[1], "quality")
    assert auc(score, label) > 0.97 and predicted[label == 1].mean() > 0.97 and predicted[label == 0].mean() < 0.1
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in out.limit(200).collect())


def test_toxicity_on_held_out_labels(larger):
    out = toxicity.toxicity(*larger)
    score, label, predicted = judged(out, larger[1], "toxic")
    assert auc(score, label) > 0.88 and predicted[label == 1].mean() > 0.75 and predicted[label == 0].mean() < 0.01
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in out.limit(200).collect())


def test_scores_do_not_depend_on_other_columns(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    other = documents.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    for op in (quality_crf.quality, toxicity.toxicity):
        a, b = ({r.doc_id: r.score for r in op(d, labels).collect()} for d in (documents, other))
        assert a == b


@pytest.mark.parametrize("op", [quality_crf.quality, toxicity.toxicity])
def test_learned_edges(spark, nasty, no_docs, no_labels, op):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (5, 0, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for known in (no_labels, labels):
        rows = op(nasty, known).collect()
        assert len(rows) == nasty.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
        assert all(not r.held_out for r in rows if r.doc_id is None)
    assert op(no_docs, labels).count() == 0
    assert len({r.score for r in op(nasty, no_labels).collect()}) == 1


def chain_sums(evidence, joint):
    """Marginals of one chain by all labellings."""
    n = len(evidence)
    weights = {}
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        weights[tuple(y)] = math.exp(sum(e for e, k in zip(evidence, y, strict=True) if k) + sum(joint[a][b] for a, b in zip(y, y[1:], strict=False)))
    total = sum(weights.values())
    return [sum(w for y, w in weights.items() if y[i]) / total for i in range(n)], math.log(total)


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(1)
    chains = [rng.normal(size=n) for n in (1, 4, 2, 6, 3)]
    joint = rng.normal(size=(2, 2))
    good, pairs, total = quality_crf.forward_backward(chains, joint)
    for g, c in zip(good, chains, strict=True):
        assert np.allclose(g, chain_sums(c, joint)[0])
    assert np.isclose(pairs.sum(), sum(len(c) - 1 for c in chains))
    assert np.allclose(sorted(total), sorted(chain_sums(c, joint)[1] for c in chains))


def test_kept_keeps_rows_whole(nasty, no_docs):
    model = quality_crf.LineCrf(0.9)
    assert quality_crf.kept(nasty, model).count() == nasty.count() and quality_crf.kept(nasty, quality_crf.LineCrf(0.1)).count() == 0
    assert quality_crf.kept(nasty, model).columns == nasty.columns and quality_crf.kept(no_docs, model).count() == 0


@pytest.fixture(scope="module")
def restorer():
    text = b"the idiot and the stupid moron said that it is worthless and pathetic to call people losers " * 50
    return toxicity.Restorer(toxicity.trigram_counts([text]))


@pytest.mark.parametrize("raw, want", [("1d10t", "idiot"), ("$tupid", "stupid"), ("i.d.i.o.t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("w0rthl3ss!!", "worthless"), ('"the,', "the"), ("plain", "plain"), ("---", ""), ("x" * 100, "x" * 100), ("2024", "2024")])
def test_deobfuscation(restorer, raw, want):
    assert restorer.token[raw] == want


def test_spaced_words(restorer):
    assert "idiot" in restorer.words("you I D I O T you") and restorer.words("") == [] and restorer.words("a b") == ["a", "b"]


def test_viterbi_is_the_best_path(restorer):
    """Against the enumeration of every path."""
    def cost(text):
        x = y = 0
        s = 0.0
        for z in [*toxicity._codes(text), 0]:
            s += restorer.log[x][y][z]
            x, y = y, z
        return s

    for word in ("1d1ot", "l053r", "a.1.b", "|d|ot"):
        paths = {"": 0.0}
        for c in word:
            options = [(c, 0.0)] if c.isalpha() else [(x, toxicity.COST_LOOKALIKE) for x in toxicity.LOOKALIKES.get(c, "")]
            if c in toxicity.SEPARATORS or not options:
                options.append(("", toxicity.COST_DROP))
            paths = {p + o: max(s - k, paths.get(None, -math.inf)) for p, s in paths.items() for o, k in options}
        best = max(cost(p) + s for p, s in paths.items())
        got = restorer.viterbi(word)
        assert math.isclose(cost(got) + paths[got], best)


def base_by_hand(rows):
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    train = Counter(w for i, t in rows if i is not None and not held(i, 7, 2) for w in words(t))
    n, v = sum(train.values()), len(train)
    return n, {(i, t): (len(words(t)), sum(train[w] > 0 for w in words(t)), sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows}


@pytest.mark.parametrize("hot", [200_000, 50])
def test_base_scores_and_counts(documents, hot):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    n, want = base_by_hand(rows)
    texts = dict(rows)
    out = lm_scoring.score(documents, hot=hot, top=40, rounds=1).collect()
    for r in out:
        tokens, known, base = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, held(r.doc_id, 7, 2))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert len(out) == len(rows)


def test_model_beats_the_base_on_held_out_texts(larger):
    r = lm_scoring.score(larger[0]).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_tables_are_normalised():
    rng = np.random.default_rng(2)
    model = lm_scoring.LogBilinear(rng.integers(1, 50, 30).astype(float), dim=6)
    model.train(rng.integers(0, 29, (5000, 3)), batch=256, noise=20)
    a, b, z = model.tables()
    for h1, h2 in ((0, 0), (3, 29), (29, 29), (7, 1)):
        p = np.exp(a[h1, :-1].astype(float) + b[h2, :-1] - z[h1, h2])
        assert np.isclose(p.sum(), 1, atol=1e-4)


def test_nce_learns_the_right_successor():
    rng = np.random.default_rng(3)
    w = np.cumsum(rng.integers(0, 2, 40_000)) % 8  # the next class is the same or one more
    model = lm_scoring.LogBilinear(np.append(np.bincount(w, minlength=8), 0.0), dim=8)
    for k in range(4):
        model.train(np.column_stack([w[1:-1], w[:-2], w[2:]]), batch=256, noise=24, seed=k)
    a, b, z = model.tables()
    p = np.exp(a[3].astype(float) + b[3] - z[3, 3])
    assert p[3] + p[4] > 0.85


def test_language_model_edges(nasty, no_docs):
    rows = lm_scoring.score(nasty, top=5, tails=8).collect()
    assert len(rows) == nasty.count() and all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm_scoring.score(no_docs).count() == 0
    nobody = nasty.where("doc_id is null")
    assert {(r.train_tokens, r.n_known, r.base_score) for r in lm_scoring.score(nobody).collect()} == {(0, 0, 0.0)}


def test_every_window_is_learned_from(spark):
    """Short texts and long ones, of all lengths: each token is the class of one window."""
    texts = ["short", "a bb ccc " * 3, None, "", "one two three four five six seven " * 40, "short", *("x" * n for n in range(1, 9))]
    classes = lm_scoring.Classes([b"short", b"one", b"\n"], 8)
    want = Counter()
    for t in texts:
        c = [classes.words.index(x) if x in classes.words else classes.own + zlib.crc32(x[-2:]) % 8 for x in lm_scoring.tokens((t or "").encode())]
        pad = [classes.start, classes.start, *c]
        want.update(zip(pad[1:-1], pad[:-2], c, strict=True))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for length in (16_384, 50, 1):
        rows = lm_scoring.training_windows(docs, spark.sparkContext.broadcast(classes), length).toArrow().to_batches()
        for size in (1 << 18, 10):
            assert Counter(tuple(w) for b in lm_scoring.blocks(rows, classes.start, size) for w in b.tolist()) == want


def scores_by_hand(rows, tables, classes, counts):
    """log10 of each token's class by a softmax over all classes, and of the token within its class."""
    a, b = (t.astype(float) for t in tables[:2])
    tail = lambda w: zlib.crc32(w[-2:]) % classes.tails
    own = {w: i for i, w in enumerate(classes.words)}
    inside = Counter()
    for w, c in counts.items():
        if w not in own:
            inside[tail(w)] += c + 1
    out = {}
    for i, text in rows:
        total, h1, h2 = 0.0, classes.start, classes.start
        for w in lm_scoring.tokens((text or "").encode()):
            k = own[w] if w in own else classes.own + tail(w)
            logits = a[h1, :-1] + b[h2, :-1]
            total += (logits[k] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / math.log(10)
            if w not in own:
                total += math.log10((counts[w] + 1) / (inside[tail(w)] + 1))
            h1, h2 = k, h1
        out[i] = total
    return out


@pytest.mark.parametrize("hot", [200_000, 30])
def test_scores_against_an_explicit_softmax(spark, documents, monkeypatch, hot):
    made = {}
    train, windows = lm_scoring.train, lm_scoring.training_windows
    monkeypatch.setattr(lm_scoring, "train", lambda w, m, r: made.setdefault("model", train(w, m, r)))
    monkeypatch.setattr(lm_scoring, "training_windows", lambda d, c: windows(d, made.setdefault("classes", c)))
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").limit(60).collect()] + [(10**6, None), (10**6 + 1, " \t"), (10**6 + 2, "Zq \x1c\x85 é日本 one"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score(df, hot=hot, top=20, most=20, tails=8, rounds=1).collect()}
    classes, model = made["classes"].value, made["model"]
    counts = Counter(w for i, t in rows if i is not None and not held(i, 7, 2) for w in lm_scoring.tokens((t or "").encode()))
    want = scores_by_hand(rows, model.tables(), classes, counts)
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-4, abs_tol=1e-3) for i in want)


def test_words_of_a_batch_are_those_of_each_text():
    import pyarrow as pa

    texts = ["", None, " \t\n\x0b\x0c\r", "A b  C\n", "\x1c\x85 é日 ÀB\u00a0x", "z" * 70, "one two"]
    words = lm_scoring.Words(pa.array(texts, pa.string()))
    each = [lm_scoring.tokens((t or "").encode())[:-1] for t in texts]
    assert words.flat.cast(pa.binary()).to_pylist() == [w for ws in each for w in ws] and words.size.tolist() == list(map(len, each))
    assert words.places(pa.array(["c", "one", "two"])).tolist() == [["c", "one", "two"].index(w.decode()) if w in (b"c", b"one", b"two") else -1 for ws in each for w in ws]
    column = pa.array(texts, pa.string())
    for most in (1, 10, 1000):
        cut = list(lm_scoring.parts(column, most))
        assert [x for _, p in cut for x in p.to_pylist()] == texts and [k for k, _ in cut] == np.cumsum([0, *(len(p) for _, p in cut)])[:-1].tolist()


def test_own_classes_grow_with_the_vocabulary(spark, monkeypatch):
    made = []
    monkeypatch.setattr(lm_scoring, "train", lambda windows, model, rounds: made.append(len(model.noise) - 9) or model)
    for n in (100, 2000):
        docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(n // 20))) for i in range(20)], "doc_id bigint, text string")
        lm_scoring.score(docs, top=5, tails=8, spread=10, rounds=1).count()
    assert 5 <= made[0] < 20 and 100 < made[1] < 201


def test_spacing_is_in_the_lattice(restorer):
    """Borders between spaced characters are found, in runs of three to thousands of characters."""
    for raw, want in [("a n i d i o t", "an idiot"), ("i t  i s w o r t h l e s s", "it is worthless"), ("t h e\n1 d 1 0 t a n d t h e m o r o n", "the idiot and the moron"), ("m. o. r. o. n.", "moron")]:
        model = toxicity.Restorer(toxicity.trigram_counts([b"the idiot and the stupid moron said that it is worthless and pathetic to call an idiot " * 50]))
        assert " ".join(model.words(raw)[-len(want.split()) :]) == want
    assert restorer.words("t h e")[-1] == "the"
    long = restorer.words(" ".join("the stupid moron said that it is worthless ".replace(" ", "") * 300))
    assert long.count("stupid") > 250 and long.count("worthless") > 250
    assert "stupid" in restorer.words("st" + "u" * 200 + "pid") and "idiot" in restorer.words("i" + "." * 80 + "d.1.o.t")
