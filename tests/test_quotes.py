import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyspark.functions import quotes as q
from studyspark.functions.text import normalized
from studyspark.operators import matching

SECTION = """--- Page 3 ---
The assay could not discrimi-
nate between open and closed states at room temperature.
--- Page 4 ---
Cooling the sample to four degrees separated the two populations completely."""


def matches(spark, quote, text=SECTION):
    df = spark.createDataFrame([(quote, text)], "q string, t string")
    return df.select(q.quote_in_text(normalized("q"), normalized("t")).alias("x")).first().x


def test_quotes_across_noise(spark):
    assert matches(spark, "could not discriminate between open and closed states")
    assert matches(spark, "COULD NOT, discriminate between; open and closed states!")
    assert matches(spark, "could not discriminate between open and closed states at room pressure")
    assert not matches(spark, "the assay was abandoned because the reagents had expired")
    assert not matches(spark, "open and closed")
    assert not matches(spark, "")


def test_pages(spark):
    find = lambda quote: spark.createDataFrame([(quote, SECTION)], "q string, t string").select(q.find_page(normalized("q"), q.page_index("t")).alias("x")).first().x
    assert find("Cooling the sample to four degrees") == 4
    assert find("could not discriminate between open and closed") == 3
    assert find("never written") is None and find("") is None
    assert spark.createDataFrame([("no markers",)], "t string").select(F.size(q.page_index("t")).alias("x")).first().x == 0


def test_window_rule_is_the_longest_common_block(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        quote = "".join(rng.choice("ab") for _ in range(rng.randint(25, 40)))
        cut = rng.randint(0, len(quote) - 1)
        text = "".join(rng.choice("ab") for _ in range(10)) + quote[cut:] + rng.choice("ab") + quote[: rng.randint(0, len(quote))]
        block = SequenceMatcher(None, quote, text, autojunk=False).find_longest_match().size
        rows.append((quote, text, block >= 0.8 * len(quote)))
    got = spark.createDataFrame(rows, "q string, t string, want boolean").select("q", "t", "want", q.quote_in_text("q", "t").alias("got")).where("want <> got").collect()
    assert got == []


@settings(max_examples=200, deadline=None)
@given(st.integers(25, 400))
def test_every_window_holds_a_gram(n):
    k = (4 * n + 4) // 5
    g = max(k // 2, 1)
    starts = list(range(0, n - g + 1, k - g + 1))
    assert all(any(w <= s and s + g <= w + k for s in starts) for w in range(n - k + 1))


def test_both_plans_find_the_same_pairs(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    docs = [(i, "".join(rng.choice(words) for _ in range(80))) for i in range(40)]
    asked = [(i, docs[i][1][20:70] if i % 2 else "z" * 30) for i in range(12)] + [(99, "short"), (98, None)]
    texts, quotes = spark.createDataFrame(docs, "doc_id int, norm string"), spark.createDataFrame(asked, "item_id int, quote string")
    brute = {(r.doc_id, r.item_id) for r in texts.crossJoin(quotes).where(q.quote_in_text("quote", "norm")).collect()}
    assert brute and {tuple(r) for r in matching.quote_pairs(texts, quotes).collect()} == brute


def test_highlight_levels(spark):
    text = "One two three four five six seven. Eight, nine ten eleven twelve thirteen! Other things follow here."
    level = lambda quote: spark.createDataFrame([(quote, text)], "q string, t string").select(q.highlight_level("q", "t").alias("x")).first().x
    assert level("one two — three four") == "whole"
    assert level("Missing words here now ok. Eight nine ten eleven twelve.") == "sentence"
    assert level("one two three four five six seven eight nine ten absent words follow") == "opening"
    assert level("nothing at all") == "none" and level("!!!") == "none"


def test_every_window_covers_a_whole_run_of_blocks():
    for c in range(6):
        width = matching.block(c)
        for window in (matching.SHORTEST << c, (matching.SHORTEST << c) + 1, (matching.SHORTEST << (c + 1)) - 1):
            for start in range(3 * width):
                assert any(start <= at and at + matching.RUN * width <= start + window for at in range(0, start + window, width))


def test_classes_of_quotes_follow_their_windows(spark):
    rows = [(n, "x" * n) for n in (25, 49, 50, 51, 99, 100, 200, 401, 3000)]
    for r in spark.createDataFrame(rows, "n int, q string").select("n", matching.window_class(F.col("q")).alias("c")).collect():
        window = (r.n * 4 + 4) // 5
        assert matching.SHORTEST << r.c <= window < matching.SHORTEST << (r.c + 1)


def test_pairs_equal_every_pair_tried_and_candidates_are_few(spark):
    """Texts full of stock phrases: they meet no quote of which they are but a small part."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    stock = [" ".join(word() for _ in range(3)) for _ in range(3)]
    quotes = [(i, " ".join([word() for _ in range(rng.choice([4, 9, 20, 60]))] + [rng.choice(stock)] + [word() for _ in range(rng.choice([2, 9, 20]))])) for i in range(40)] + [(100, None), (101, "short"), (102, "")]
    texts = []
    for i in range(120):
        parts = [rng.choice(stock) for _ in range(8)] + [word() for _ in range(40)]
        if i % 2:
            whole = quotes[rng.randrange(40)][1]
            cut = rng.randint(0, len(whole) // 6)
            parts.insert(rng.randrange(len(parts)), whole[cut : len(whole) - rng.randint(0, len(whole) // 6)])
        texts.append((i, " ".join(parts)))
    texts += [(500, None), (501, ""), (502, quotes[0][1])]
    t = spark.createDataFrame(texts, "doc_id int, norm string")
    asked = spark.createDataFrame(quotes, "item_id int, quote string")
    every = {tuple(r) for r in t.crossJoin(asked).where(q.quote_in_text("quote", "norm")).select("doc_id", "item_id").collect()}
    found = matching.candidates(t, asked)
    assert {tuple(r) for r in matching.quote_pairs(t, asked).collect()} == every and len(every) > 40
    assert found.count() < 2 * len(every)
    assert {tuple(r) for r in matching.candidates(t, asked, most_bytes=0).collect()} == {tuple(r) for r in found.collect()}
    assert matching.quote_pairs(t, asked.limit(0)).count() == 0 and matching.quote_pairs(t.limit(0), asked).count() == 0
