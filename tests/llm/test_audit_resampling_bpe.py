"""Source audit, importance resampling and byte-level BPE against plain definitions and the public library."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter
from zlib import crc32

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from studyspark.llm import byte_bpe, importance, source_audit

RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---- source audit ----

def terms_of(text):
    out, now = [], bytearray()
    for b in (text or "").encode() + b" ":
        if b >= 128 or chr(b).isalpha():
            now.append(b + 32 if 65 <= b <= 90 else b)
        elif now:
            out.append(bytes(now).decode())
            now = bytearray()
    return out


def audit_by_definition(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        df = Counter(t for d in here for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        sources = sorted({d[1] for d in here}, key=str.encode)

        def shares(some):
            n = Counter(t for d in some for t in d[2] if df[t] >= least)
            total = sum(n.values()) + len(kept)
            return n, {t: 1 + 10**9 * (n[t] + 1) // total for t in kept}

        p = {s: shares([d for d in here if d[1] == s]) for s in sources}
        q = shares(here)[1]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][1][t], p[o][1][t]) for t in kept), o) for o in sources if o != s]
            found = [(f(p[s][1][t], q[t]), t) for t in kept if p[s][0][t] and p[s][1][t] > q[t]]
            for part, items in (("pair", pairs), ("term", found)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(items, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("held", [1 << 18, 7, 0])
def test_audit_equals_its_definition_whatever_the_automaton_holds(spark, held):
    rng = random.Random(5)
    words = [rng.choice(["ab", "Cd", "é", "日本", "x" * 90, "naïve", "zz"]) + "abcdefgh"[i % 8] * (i % 3) for i in range(60)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None]), rng.choice([" ", "-", "1", "\n", "\x00"]).join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(120)]
    rows += [("en", "hot", "ab ab ab")] * 50 + [("fr", "only", None), ("fr", "other", "unique words here"), ("xx", "alone", "a b c")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "n", "g", "p0", "item", "posting")})
    assert as_rows(source_audit.audit(df.repartition(5), held=held)) == audit_by_definition(rows)


def test_audit_takes_odd_tables(spark, nasty, no_docs):
    odd = nasty.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    assert as_rows(source_audit.audit(odd)) == audit_by_definition([(r.lang, r.source, r.text) for r in odd.collect()])
    assert source_audit.audit(no_docs.withColumns({"lang": F.lit("a"), "source": F.lit("b")})).count() == 0


def test_most_frequent_terms_stay_under_their_bound(spark):
    kept = spark.createDataFrame([("en", f"t{i}", 3 + i % 5) for i in range(500)], "lang string, term string, df bigint")
    assert len(source_audit.most_frequent(kept, 100, 64)) <= 100
    assert sorted(source_audit.most_frequent(kept, 500, 64)) == sorted(f"t{i}" for i in range(500))
    assert source_audit.most_frequent(kept, 500, 2) == sorted(f"t{i}" for i in range(10)) or len(source_audit.most_frequent(kept, 500, 2)) == 10


# ---- importance resampling ----

def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", lowered)


def resampled_by_definition(docs, target, longest=1, buckets=10_000, least_words=20, percent=10):
    def features(text):
        w = words_of(text)
        return [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([i, len(f), weight, weight + importance.noise_of(i), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 20), (3, 50, 2), (2, 100, 0)])
def test_resampling_equals_its_definition(spark, longest, percent, least):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(80)] + ["É", "日本", "X9"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(200 + i, "the same text many times " * 6) for i in range(60)] + [(300, None), (301, ""), (None, "word1 " * 30)]
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(10)] + [None]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("key", "id", "copies", "score", "rank", "part", "_place", "_apart")})
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, copies int")
    got = importance.resample(df.repartition(7), aims, longest=longest, percent=percent, least_words=least, buckets=500)
    want = resampled_by_definition(docs, target, longest, 500, least, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_resampling_ranks_every_place_once_and_takes_odd_tables(spark, nasty, no_docs):
    aims = spark.createDataFrame([("plain words",)], "text string")
    got = importance.resample(nasty, aims, least_words=1, percent=100).collect()
    assert len(got) == nasty.count()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(r.n_features > 0 for r in got)
    assert importance.resample(no_docs, aims).count() == 0
    assert importance.resample(nasty, aims.limit(0)).count() == nasty.count()


def test_equal_scores_go_to_the_smaller_id_over_many_partitions(spark):
    rows = [(i, i % 3, True) for i in range(900)] + [(5, 2, True)] * 20 + [(7, 9, False)]
    df = spark.createDataFrame(rows, "id bigint, score bigint, eligible boolean").repartition(9)
    got = [(r.score, r.id) for r in importance.ranked(df, 400).where("rank is not null").orderBy("rank").collect()]
    assert got == [(s, i) for i, s, _ in sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))[:400]]


# ---- byte-level BPE ----

@pytest.fixture(scope="module")
def library():
    with open(RANKS_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD_TEXTS = [
    "", None, " ", "  ", "a  b", "a \n b", "\n\n", "don't we'll I'M", "x\x1cy\x1d z\x85w", "tab\t\tend ", "   x　y", "<|endoftext|> <|fim|>",
    "日本語のテキスト", "🙂🙃 é́ ﬁ", "123456789 ½ Ⅷ", "a" * 5000, " " * 3000 + "z", "ab" * 400 + "!?" * 300, "naïve Straße groß", "\x00\x01​﻿᠎ x", "١٢٣ abc", " x  y", "é" * 200,
]


@pytest.mark.parametrize("held, longest", [(400_000, 96), (0, 96), (3, 12)])
def test_ids_are_the_library_s_and_texts_come_back(spark, library, held, longest):
    rng = random.Random(3)
    texts = ODD_TEXTS + ["".join(rng.choices("abcdeé ÀЖ語\n\t.,'0129 ", k=rng.randint(1, 200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("id", "ids", "gaps", "bytes", "word")})
    coded = byte_bpe.encode(df.repartition(5), RANKS_FILE, public_tokenizers.PATTERN, held=held, longest=longest)
    got = {r.doc_id: r for r in byte_bpe.decode(coded, RANKS_FILE).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert list(got[i].ids) == library.encode_ordinary(text or ""), repr(text)
        assert bytes(got[i].bytes) == (text or "").encode()


def test_both_ways_of_merging_agree_with_the_library(spark, library):
    rng = random.Random(8)
    words = {bytes(rng.choices(b"abcdefgh stuv\xc3\xa9\xe6\x97\xa5", k=rng.randint(2, 40))) for _ in range(400)} | {b"a" * n for n in range(2, 60)}
    ranks = byte_bpe.read_ranks(RANKS_FILE)
    words -= ranks.keys()
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    pairs, single = byte_bpe.rank_map(ranks)
    for r in df.select("word", byte_bpe._let(pairs, lambda m: byte_bpe.folded(F.col("word"), m, single)).alias("ids")).collect():
        assert list(r.ids) == byte_bpe.merged_ids(bytes(r.word), ranks) == library._encode_bytes(bytes(r.word))


def test_a_long_word_takes_no_square_of_time(spark, library):
    text = "ab" * 150_000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (r,) = byte_bpe.decode(byte_bpe.encode(df, RANKS_FILE, public_tokenizers.PATTERN), RANKS_FILE).collect()
    assert bytes(r.bytes) == text.encode() and list(r.ids) == library.encode_ordinary(text)


def test_packed_ids_null_ids_repeated_rows_and_an_empty_table(spark, nasty, no_docs, library):
    rows = byte_bpe.decode(byte_bpe.encode(nasty, RANKS_FILE, public_tokenizers.PATTERN, packed=True), RANKS_FILE).collect()
    both = byte_bpe.encode_and_decode(nasty, RANKS_FILE, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in both) == Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in rows)
    want = Counter((r.doc_id, struct.pack(f"<{len(ids)}I", *ids)) for r in nasty.collect() for ids in [library.encode_ordinary(r.text or "")])
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    assert Counter(hashlib.sha256(bytes(r.bytes)).hexdigest() for r in rows) == Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in nasty.collect())
    assert byte_bpe.decode(byte_bpe.encode(no_docs, RANKS_FILE, public_tokenizers.PATTERN), RANKS_FILE).count() == 0


def test_an_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id bigint, ids array<int>"), RANKS_FILE).collect()


def test_words_are_those_of_the_librarys_pattern_in_every_script():
    import random

    import regex

    words = byte_bpe._Words(byte_bpe.read_ranks(RANKS_FILE), public_tokenizers.PATTERN, 96)
    assert words._plane is not words._any
    library, rng = regex.compile(public_tokenizers.PATTERN).findall, random.Random(5)
    plane = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    assert words.words(" ".join(f"{c}{c}" for c in plane)) == library(" ".join(f"{c}{c}" for c in plane))
    for k in range(3000):
        chars = (plane[:128], plane[:0x3000], [*plane[:0x3000], "😀", "𝒜", "𝟙"])[k % 3]
        text = "".join(rng.choice(chars if rng.random() < 0.5 else " 's\n1a") for _ in range(20))
        assert words.words(text) == library(text)
