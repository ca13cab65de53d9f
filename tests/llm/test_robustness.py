"""Names that clash, labels of documents that are not there, texts of one word, and scores against plain arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studyspark.llm import common, decontaminate, lm_scoring, quality_crf, simhash_dedup, substring_dedup, toxicity

UNDERSCORED = ["_spans", "_cut", "_id", "_k", "_bad", "_bad_id", "__K"]
LINES = "A line that several documents share word for word, as licences are shared.\n"


@pytest.fixture(scope="module")
def clashing(spark, nasty):
    """The odd rows with copies, shared lines and a passage of an item, and columns named like those of the stages."""
    more = [(20 + i, LINES + f"Own words of document number {i} follow here, {'many ' * i}of them.") for i in range(4)]
    more += [(30, LINES + "copy " * 20), (31, LINES + "copy " * 20), (31, LINES + "copy " * 20), (None, LINES + "copy " * 20), (40, "item one two three four five six seven eight nine ten eleven twelve thirteen " * 2)]
    rows = nasty.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    return rows.withColumns({c: F.lit("mine") for c in UNDERSCORED} | {"n_chars": F.length("text"), "lang": F.lit("en"), "source": F.lit("s")})


def test_apart_takes_names_that_are_free(clashing):
    names = common.apart(clashing, "_id", "_k", "free")
    assert names[2] == "free" and not {n.lower() for n in names[:2]} & {c.lower() for c in clashing.columns} and len(set(names)) == 3


def test_filtering_stages_take_any_column_names(spark, clashing):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id int, text string")
    for out in (substring_dedup.cleaned(clashing), decontaminate.clean(clashing, items), simhash_dedup.one_of_each(clashing)):
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and all(r["_spans"] == "mine" and r["__K"] == "mine" for r in rows)
    assert 40 not in {r.doc_id for r in decontaminate.clean(clashing, items).collect()}
    assert sum(r.text == LINES + "copy " * 20 for r in simhash_dedup.one_of_each(clashing).collect()) == 1


def test_the_whole_pipeline_takes_the_odd_table(spark, clashing, tmp_path):
    folder = str(tmp_path)
    clashing.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(20, 1, 0), (21, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = common.written(out, name)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("by_label, rows, most", [(True, 20, 10**9), (False, 50, 10**9), (True, 500, 900), (True, 10**6, 10**9)])
def test_labels_of_absent_documents_change_no_sample(spark, by_label, rows, most):
    docs = spark.createDataFrame([(i % 400, f"text {i % 450} " + "x" * (i % 7)) for i in range(500)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(300)], "id bigint, y int")
    absent = spark.range(10_000, 60_000).select("id", (F.col("id") % 2).cast("int").alias("y"))
    drawn = lambda k: sorted(tuple(r) for r in common.labelled_sample(docs, k, id_col="doc_id", text_col="text", rows=rows, weight=F.length("text"), most=most, by_label=by_label).collect())
    alone = drawn(known)
    assert alone == drawn(known.unionByName(absent)) and alone
    there = {(r.y, r.text) for r in docs.join(known, F.col("doc_id") == F.col("id")).select("y", "text").collect()}
    assert set(alone) <= there
    for y in (0, 1) if by_label else (None,):
        mine = [t for label, t in alone if y is None or label == y]
        assert len(mine) <= rows and sum(map(len, mine)) <= most
        if most == 10**9:
            every = docs.join(known, F.col("doc_id") == F.col("id")).where("true" if y is None else f"y = {y}").select("id", "text").distinct().count()
            assert len(mine) == min(rows, every)


def test_scores_do_not_hear_of_absent_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    absent = spark.range(10**6, 10**6 + 20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    both = labels.select("doc_id", "quality", "toxic").unionByName(absent, allowMissingColumns=True)
    for score, options in ((toxicity.toxicity, {"modulus": 5, "held": 0, "threshold": 0.5}), (quality_crf.quality, {"modulus": 4, "held": 2, "threshold": 0.7})):
        one, other = ({r.doc_id: r.score for r in score(documents, k, **options).collect()} for k in (labels, both))
        assert one == other and len(set(one.values())) > 1  # fitted, not one prior for all


def test_a_long_text_of_one_word_meets_an_item_of_it(spark):
    items = spark.createDataFrame([(9, "word " * 60)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "word " * 30_000), (2, "word " * 59), (3, "word " * 12), (4, ("word " * 11 + "other ") * 40)], "doc_id int, text string")
    got = {r.doc_id: (r.doc_start, r.n_matched, r.best_window) for r in decontaminate.overlaps(docs, items).collect()}
    want = {}
    for i, text in ((1, "word " * 200), (2, "word " * 59), (3, "word " * 12), (4, ("word " * 11 + "other ") * 40)):
        w = text.split()
        best = None
        for shift in range(-60, len(w)):
            same = [int(0 <= shift + k < len(w) and w[shift + k] == "word") for k in range(60)]
            window = max(sum(same[b : b + 13]) for b in range(48))
            if window >= 11 and (best is None or (sum(same), window, -shift) > best):
                best = (sum(same), window, -shift)
        if best:
            want[i] = (-best[2], *best[:2])
    assert got == want


def test_ties_at_the_limit_fill_the_words_up(spark):
    counts = spark.createDataFrame([(f"w{i:05d}", 1) for i in range(3000)] + [("often", 9), ("more", 7)], "word string, c bigint")
    got = lm_scoring.most_frequent(counts, 1000)
    assert got.num_rows == 1000 and got.column("word").to_pylist() == ["often", "more"] + [f"w{i:05d}" for i in range(998)]
    assert lm_scoring.most_frequent(counts, 1).column("word").to_pylist() == ["often"]
    assert lm_scoring.most_frequent(counts, 10**6).num_rows == 3002
    assert lm_scoring.most_frequent(counts.limit(0), 5).num_rows == 0
    assert np.all(np.diff(got.column("c").to_numpy()) <= 0)
