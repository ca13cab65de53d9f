from pyspark.sql import functions as F

from studyspark.functions import text as t


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'bigint'}" for n in names))
    return df.select(column.alias("x")).first().x


def test_normalized_folds_ligatures_only_when_asked(spark):
    assert one(spark, t.normalized("a"), a="All- atom,\n MODEL 2") == "allatommodel2"
    assert one(spark, t.normalized("a", nfkc=True), a="ﬁne-tuned") == "finetuned"
    assert one(spark, t.normalized("a"), a=None) is None


def test_sparse_pages(spark):
    for text, sparse in (("", True), ("  \n 12 \n", True), ("A sentence that has more than enough characters.", False)):
        assert one(spark, t.needs_ocr("a"), a=text) is sparse


def test_dot_leaders_and_ellipsis(spark):
    assert one(spark, t.strip_dot_leaders("a"), a="Intro . . . . . 3\nMethods......7") == "Intro 3\nMethods 7"
    assert one(spark, t.strip_dot_leaders("a"), a="and so on... version 1.2.3") == "and so on... version 1.2.3"


def test_clean_quote(spark):
    assert one(spark, t.clean_quote("a"), a="we  discrimi-\nnate   two") == "we discriminate two"


def test_json_fence_and_preview(spark):
    assert one(spark, t.strip_json_fence("a"), a=' ```json\n{"a": 1}\n``` ') == '{"a": 1}'
    assert one(spark, t.strip_json_fence("a"), a=" plain ") == "plain"
    assert one(spark, t.preview("a", 10), a="one two three four") == "one two…"
    assert one(spark, t.preview("a", 50), a="short") == "short"


def test_question_key_ignores_spacing_but_not_paper(spark):
    key = lambda p, q: one(spark, t.question_key("p", "q"), p=p, q=q)
    assert key("a", "Why is it?") == key("a", "why  is IT")
    assert key("a", "Why is it?") != key("b", "Why is it?")


def test_settings_listing(spark):
    listing = "x\n  Current AC Power Setting Index: 0x00000001\n  Current DC Power Setting Index: 0x00000000\n"
    assert one(spark, t.setting_index("a"), a=listing) == 1
    assert one(spark, t.setting_index("a", on_battery=True), a=listing) == 0
    assert one(spark, t.setting_index("a"), a="nothing here") is None


def test_names_and_small_numbers(spark):
    assert one(spark, t.paper_stem("a"), a="/q/deep_nets_questions.md") == "deep_nets"
    assert one(spark, t.file_stem("a"), a="a.b.pdf") == "a.b"
    assert one(spark, t.size_mb("a"), a=1) == 0.1 and one(spark, t.size_mb("a"), a=1_250_000) == 1.3
    assert one(spark, t.percent("a", "b"), a=1, b=8) == 13 and one(spark, t.percent("a", "b"), a=1, b=0) == 0
    assert one(spark, t.plural("a", "paper"), a=1) == "1 paper" and one(spark, t.plural("a", "paper"), a=2) == "2 papers"
    assert one(spark, t.escape_html("a"), a="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"


def test_heat_and_status(spark):
    assert [one(spark, t.heat_level("a", "b"), a=a, b=b) for a, b in ((0, 0), (0, 9), (1, 0), (1, 5), (3, 1), (4, 0))] == [0, 1, 2, 2, 4, 4]
    tag = lambda seen, correct, review, read: one(spark, t.status_tag("a", "b", "c", F.lit(read)), a=seen, b=correct, c=review)
    assert tag(3, 2, 1, "x") == "1 to review" and tag(3, 3, 0, "x") == "Read" and tag(3, 3, 0, None) == "3/3 right" and tag(0, 0, 0, None) == "Unread"


def test_model_lookup(spark):
    lists = spark.createDataFrame([(["a:latest", "b"],), (None,)], "l array<string>")
    assert [r.x for r in lists.select(t.model_installed("l", F.lit("a")).alias("x")).collect()] == [True, None]


def test_url_gates(spark):
    assert one(spark, t.web_address("a"), a=" HTTP://x") is True and one(spark, t.web_address("a"), a="ftp://x") is False
    act = lambda n, pdf: one(spark, t.readability("n", F.lit(pdf)), n=n)
    assert act(999, None) == "needs_render" and act(2000, "u") == "use_pdf" and act(2000, None) == "keep" and act(20000, "u") == "keep"
