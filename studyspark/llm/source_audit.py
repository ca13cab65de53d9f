"""How far the sources of a language diverge: a vocabulary automaton in two passes.

First pass: the exact number of documents of each term, by language; a term in fewer than
``least`` documents of its language goes.  Second pass: an Aho-Corasick automaton of the kept
terms, each between two delimiters, runs over texts whose other characters are delimiters too,
and recounts the occurrences.  The counts are sparse postings (language, source, term, n).

The automaton holds at most ``held`` terms of at most ``longest`` bytes, those of the most
documents, so its size has a bound (it is broadcast); occurrences of kept terms beyond it are
counted from the same texts and found by the join with the kept terms, so no term is lost.

A pair of sources needs every kept term, but only few of them occur in both.  With p of a term
that does not occur written p0, the sum over all terms is

    V f(p0, q0) + sum over terms of p (f(p, q0) - f(p0, q0)) + sum over terms of q (f(p0, q) - f(p0, q0))
    + sum over terms of both (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).

The one-sided sums need the histogram of counts only, as p depends on the count alone; the last
one is added up inside the tasks that hold the postings of a term, so pairs are never rows.
All is integer arithmetic; no sum of a pair can leave 64 bits.

Edge cases: null text, language and source are ''; repeated rows are documents of their own;
a language without kept terms gives pairs of value 0 and no terms; a single source gives no
pairs; very long texts are scanned as they are, very long terms are counted outside the
automaton; ties rank by the UTF-8 bytes of the item; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import filterfalse
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, in_arrow, table, written

#: Letters of ASCII in lower case and all bytes beyond ASCII stay, anything else is a delimiter.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: So many sums or counts are held by a task before they are handed on.
_PENDING = 600_000


def _summed(counts: dict[tuple, Counter], names: tuple[str, ...]) -> pa.RecordBatch:
    """One row for each group and counted key: the group's values, the key, the count."""
    place = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts.values()]))
    columns = [pa.array([g[i] for g in counts], pa.binary()).cast(pa.string()).take(place) for i in range(len(names) - 2)]
    items = pa.array([x for c in counts.values() for x in c], pa.binary()).cast(pa.string())
    numbers = pa.array([n for c in counts.values() for n in c.values()], pa.int64())
    return pa.RecordBatch.from_arrays([*columns, items, numbers], names=list(names))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, df) of a table (lang, source, text): in how many documents of its language each term stands."""

    def run(batches):
        counts: dict[tuple, Counter] = {}
        for b in batches:
            for lang, text in zip(as_bytes(b.column(0)), as_bytes(b.column(1)), strict=True):
                counts.setdefault((lang,), Counter()).update(set(text.translate(_LETTERS).split()))
            if sum(map(len, counts.values())) > _PENDING:
                yield _summed(counts, ("lang", "term", "df"))
                counts = {}
        yield _summed(counts, ("lang", "term", "df"))

    found = in_arrow(docs.select("lang", "text"), run, "lang string, term string, df bigint")
    return found.groupBy("lang", "term").agg(F.sum("df").alias("df"))


def most_frequent(kept: DataFrame, held: int, longest: int) -> list[str]:
    """At most ``held`` terms of at most ``longest`` bytes, by documents: whole classes of similar numbers of documents
    from the top, then as much of the next class as a hash of its terms deals out."""
    terms = kept.where(F.octet_length("term") <= longest).groupBy("term").agg(F.sum("df").alias("df"))
    terms = terms.select("term", F.floor(F.log2("df") * 16).alias("level"), F.pmod(F.xxhash64("term"), F.lit(64)).alias("part"))
    room, taken = held, []
    for r in sorted(terms.groupBy("level", "part").count().collect(), key=lambda r: (-r.level, r.part)):
        if r["count"] > room:
            break
        room -= r["count"]
        taken.append((r.level, r.part))
    if not taken:
        return []
    *full, (level, part) = taken
    inside = (F.col("level") > level) | ((F.col("level") == level) & (F.col("part") <= part))
    return [r.term for r in terms.where(inside).select("term").collect()]


_AUTOMATA: dict[int, tuple] = {}


def _automaton(sent) -> tuple:
    """(automaton, its terms, their bytes as a set), built once in a worker process."""
    if sent.id not in _AUTOMATA:
        import ahocorasick

        made = ahocorasick.Automaton()
        for n, term in enumerate(sent.value):
            made.add_word(f" {term} ", n)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[sent.id] = (made, pa.array(sent.value, pa.string()), {t.encode() for t in sent.value})
    return _AUTOMATA[sent.id]


class _Sent:
    """A broadcast value with a number that tells it from others in a worker process."""

    def __init__(self, spark, value):
        self._broadcast = spark.sparkContext.broadcast(value)
        self.id = self._broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}

    @property
    def value(self):
        return self._broadcast.value


def recounted(docs: DataFrame, kept: DataFrame, *, held: int, longest: int) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms in each group, from the texts."""
    head = most_frequent(kept, held, longest)
    beyond = kept.select("term").distinct().count() > len(head)
    sent = _Sent(docs.sparkSession, head)

    def run(batches):
        automaton, terms, known = _automaton(sent)
        counts: dict[tuple, Counter] = {}  # by number of the term
        others: dict[tuple, Counter] = {}

        def handed_on():
            numbers = pa.array([i for c in counts.values() for i in c], pa.int32())
            found = terms.take(numbers)  # no object for each term
            names = [pa.array([g[k] for g in counts], pa.binary()).cast(pa.string()).take(pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts.values()]))) for k in (0, 1)]
            n = pa.array([n for c in counts.values() for n in c.values()], pa.int64())
            return pa.RecordBatch.from_arrays([*names, found, n], names=["lang", "source", "term", "n"])

        for b in batches:
            for lang, source, text in zip(*(as_bytes(b.column(i)) for i in range(3)), strict=True):
                plain = text.translate(_LETTERS)
                if len(terms):
                    found = map(itemgetter(1), automaton.iter(f" {plain.decode()} "))
                    counts.setdefault((lang, source), Counter()).update(found)
                if beyond:
                    others.setdefault((lang, source), Counter()).update(filterfalse(known.__contains__, plain.split()))
            if sum(map(len, counts.values())) + sum(map(len, others.values())) > _PENDING:
                yield handed_on()
                yield _summed(others, ("lang", "source", "term", "n"))
                counts, others = {}, {}
        yield handed_on()
        yield _summed(others, ("lang", "source", "term", "n"))

    found = in_arrow(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n bigint")
    # dealt by term once: the sums, the join and the postings of a term need no other exchange
    summed = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return summed.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")


def _p(n: str, total: str) -> Column:
    """One more than a billion times the smoothed share, floored; ``total``: occurrences and terms, over 0."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20, 0)) * 1000000000) div cast({total} as decimal(20, 0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _both_sides(terms: DataFrame) -> DataFrame:
    """(lang, g, h, v): what terms of both groups add to a pair, as sums of each task.

    ``terms``: (lang, postings) with postings an array of (g, p, p0)."""

    def run(batches):
        sums: dict[tuple, int] = {}

        def f(p, q):
            d = p - q
            return d * d // q

        def handed_on():
            langs, g, h = ([k[i] for k in sums] for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(g, pa.int64()), pa.array(h, pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["lang", "g", "h", "v"])

        for b in batches:
            langs = b.column(0).dictionary_encode()
            names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            starts = b.column(1).offsets.to_numpy()
            fields = [b.column(1).values.field(i).to_numpy() for i in range(3)]
            sizes = np.diff(starts)
            for size in np.unique(sizes[sizes > 1]):
                rows = np.flatnonzero(sizes == size)
                own = max(1, min(size, 1_000_000 // size))  # first groups at once
                at_once = max(1, 1_000_000 // (own * size))  # terms at once
                for k in range(0, len(rows), at_once):
                    some = rows[k : k + at_once]
                    g, p, p0 = (x[starts[some][:, None] + np.arange(size)] for x in fields)
                    for j in range(0, size, own):
                        a, pa_, p0a = (x[:, j : j + own, None] for x in (g, p, p0))
                        c, pc, p0c = (x[:, None, :] for x in (g, p, p0))
                        v = f(pa_, pc) - f(pa_, p0c) - f(p0a, pc) + f(p0a, p0c)
                        key = (lang[some].astype(np.int64)[:, None, None] << 48) + (a << 24) + c
                        keys, place = np.unique(key, return_inverse=True)
                        total = np.zeros(len(keys), np.int64)
                        np.add.at(total, place.ravel(), v.ravel())
                        for x, t in zip(keys.tolist(), total.tolist(), strict=True):
                            key = (names[x >> 48], x >> 24 & 0xFFFFFF, x & 0xFFFFFF)
                            if key[1] != key[2]:
                                sums[key] = sums.get(key, 0) + t
                    if len(sums) > _PENDING:
                        yield handed_on()
                        sums.clear()
        yield handed_on()

    return in_arrow(terms.select("lang", "postings"), run, "lang string, g bigint, h bigint, v bigint")


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 3, ranks: int = 200, held: int = 1 << 18, longest: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources by divergence, and its most typical terms.

    A language has at most 2 ** 24 sources."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = written(document_frequencies(docs).where(F.col("df") >= least), "kept")
    postings = written(recounted(docs, kept, held=held, longest=longest), "postings")

    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint").alias("g"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = groups.withColumn("total", F.col("n") + F.col("terms"))
    groups = written(groups.withColumn("p0", F.when(F.col("terms") > 0, F.expr("1 + 1000000000L div total")).otherwise(F.lit(1))), "groups")
    langs = groups.groupBy("lang").agg((F.sum("n") + F.max("terms")).alias("lang_total"))

    # the postings of each term, with p of the term in its group and in the language
    known = postings.join(groups.select("lang", "source", "g", "total", "p0"), ["lang", "source"]).select("lang", "term", "n", F.struct("g", _p("n", "total").alias("p"), "p0").alias("posting"))
    terms = known.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list("posting").alias("postings"))

    # pairs: for each two sources of a language, what all terms, terms of one and terms of both add
    counts = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    counts = counts.join(groups.select("lang", "source", "g", "total", "p0"), ["lang", "source"]).select("lang", "g", "p0", "times", _p("n", "total").alias("p"))
    mine, other = groups.select("lang", "g", "p0", "terms"), groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    every = mine.join(other, "lang").where("g <> h").select("lang", "g", "h", (F.col("terms") * _f("p0", "q0")).alias("v"))
    sided = counts.join(other, "lang").where("g <> h")
    first = sided.select("lang", "g", "h", (F.col("times") * (_f("p", "q0") - _f("p0", "q0"))).alias("v"))
    second = sided.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), (F.col("times") * (_f("q0", "p") - _f("q0", "p0"))).alias("v"))
    both = _both_sides(terms)
    pairs = every.unionByName(first).unionByName(second).unionByName(both).groupBy("lang", "g", "h").agg(F.sum("v").alias("value"))
    own, others = groups.select("lang", "g", "source"), groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = pairs.join(own, ["lang", "g"]).join(others, ["lang", "h"]).select("lang", "source", "item", "value")
    order = [F.desc("value"), F.asc("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    # typical terms: the best of each part of a group's terms first, so that no task sees a whole group
    typical = terms.join(langs, "lang").select("lang", "term", _p("n", "lang_total").alias("q"), F.explode("postings").alias("x")).select("lang", "term", "q", "x.g", "x.p").where("p > q")
    typical = typical.select("lang", "g", F.col("term").alias("item"), _f("p", "q").alias("value"), F.pmod(F.xxhash64("term"), F.lit(64)).alias("part"))
    best = typical.withColumn("k", F.row_number().over(Window.partitionBy("lang", "g", "part").orderBy(*order))).where(F.col("k") <= ranks)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= ranks).join(own, ["lang", "g"])

    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))
    return shape(pairs, "pair").unionByName(shape(best, "term"))


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same by plain counting: every kept term for every group.
SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3
), occurring AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d), n AS (
  SELECT lang, source, sum(n) AS n FROM occurring GROUP BY ALL
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL), counted AS (
  SELECT g.lang, g.source, kept.term, coalesce(o.n, 0) AS n, coalesce(n.n, 0) + v.v AS total
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN occurring o USING (lang, source, term)
), a AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // total::HUGEINT AS p FROM counted
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q
  FROM occurring GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM a JOIN a b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), ranked AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM a JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM ranked) WHERE part = 'pair' OR rank <= 200
"""
