"""Scalar text expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
SPARSE_PAGE_CHARS = 25
PREVIEW_CHARS = 1500
QUESTIONS_SUFFIX = "_questions"

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    from unicodedata import normalize

    return s.map(lambda x: None if x is None else normalize("NFKC", x))


def normalized(text: ColumnOrName, nfkc: bool = False) -> Column:
    """Lower-case letters and digits only.  ``nfkc`` first folds compatibility forms (ligatures,
    full-width letters) in an Arrow batch; Spark has no built-in for that."""
    c = col(text)
    return F.regexp_replace(F.lower(_nfkc(c) if nfkc else c), r"[^\p{L}\p{N}]", "")


def needs_ocr(page: ColumnOrName) -> Column:
    """A page with too few characters besides white space."""
    return F.length(F.regexp_replace(col(page), r"(?U)\s+", "")) < SPARSE_PAGE_CHARS


def strip_dot_leaders(text: ColumnOrName) -> Column:
    """Runs of four or more dots, blanks between them or not, become one space."""
    return F.regexp_replace(col(text), r"[ \t]*(?:\.[ \t]*){4,}", " ")


def clean_quote(quote: ColumnOrName) -> Column:
    """Join words broken by hyphen and line feed, then collapse white space."""
    joined = F.regexp_replace(col(quote), r"(?U)(\w)-\n(\w)", "$1$2")
    return F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))


def drop_glyph_ids(text: ColumnOrName) -> Column:
    """Glyphs without a text mapping, "(cid:12)", go."""
    return F.regexp_replace(col(text), r"\(cid:\d+\)", "")


def strip_json_fence(raw: ColumnOrName) -> Column:
    """The inside of a code fence around a whole reply, else the trimmed reply."""
    t = F.regexp_replace(col(raw), r"(?U)^\s+|\s+$", "")
    inside = F.regexp_extract(t, r"(?sU)\A```(?:json)?\s*(.*?)\s*```\z", 1)
    return F.when(t.rlike(r"(?sU)\A```(?:json)?\s*(.*?)\s*```\z"), inside).otherwise(t)


def preview(text: ColumnOrName, limit: int = PREVIEW_CHARS) -> Column:
    """A long text cut at the last space before the limit, with an ellipsis."""
    c = col(text)
    head = F.substring(c, 1, limit)
    cut = F.regexp_extract(head, r"(?s)\A(.*) [^ ]*\z", 1)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.when(F.contains(head, F.lit(" ")), cut).otherwise(head), F.lit("…")))


def question_key(paper: ColumnOrName, question: ColumnOrName, nfkc: bool = False) -> Column:
    """Identity of a question within a paper: insensitive to case, spacing and punctuation."""
    return F.concat(col(paper), F.lit("::"), F.substring(F.sha1(normalized(question, nfkc).cast("binary")), 1, 12))


def fingerprint(text: ColumnOrName) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of a text."""
    return F.substring(F.sha1(col(text).cast("binary")), 1, 16)


def file_name(path: ColumnOrName) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def file_stem(path: ColumnOrName) -> Column:
    """The name without directory and last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def paper_stem(path: ColumnOrName) -> Column:
    return F.regexp_replace(file_stem(path), f"{QUESTIONS_SUFFIX}$", "")


def spaced_stem(stem: ColumnOrName) -> Column:
    """A title from a file name."""
    return F.translate(col(stem), "_-", "  ")


def iso_day(at: ColumnOrName) -> Column:
    """The day of an ISO time, as text or timestamp."""
    return F.to_date(F.substring(col(at).cast("string"), 1, 10))


def setting_index(output: ColumnOrName, on_battery: bool = False) -> Column:
    """The hexadecimal AC (or DC) index in a settings listing; null where there is none."""
    kind = "DC" if on_battery else "AC"
    found = F.regexp_extract(col(output), rf"(?m)Current {kind} Power Setting Index:[ \t]*0[xX]([0-9a-fA-F]+)[ \t]*$", 1)
    return F.when(found != "", F.conv(found, 16, 10).cast("int"))


def size_mb(size_bytes: ColumnOrName) -> Column:
    """Megabytes to one decimal, 0.1 at least; halves round up."""
    return F.greatest(F.lit(0.1), F.floor(col(size_bytes) / 1e5 + 0.5) / 10)


def percent(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """Whole per cent, halves up, 0 of nothing."""
    return F.when(col(whole) > 0, F.floor(col(part) * 100 / col(whole) + 0.5)).otherwise(0).cast("int")


def plural(n: ColumnOrName, word: str) -> Column:
    return F.concat(col(n).cast("string"), F.lit(f" {word}"), F.when(col(n) == 1, "").otherwise("s"))


def escape_html(text: ColumnOrName) -> Column:
    c = col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def heat_level(n_read: ColumnOrName, answered: ColumnOrName) -> Column:
    """0 to 4: a reading weighs 2, any answer 1."""
    weight = col(n_read) * 2 + F.when(col(answered) > 0, 1).otherwise(0)
    return F.when(weight == 0, 0).when(weight <= 1, 1).when(weight <= 3, 2).when(weight <= 6, 3).otherwise(4)


def status_tag(seen: ColumnOrName, correct: ColumnOrName, review: ColumnOrName, read_at: ColumnOrName) -> Column:
    """One chip for where a reader is with a paper; review first, then read, then answered."""
    return (
        F.when(col(review) > 0, F.concat(col(review).cast("string"), F.lit(" to review")))
        .when(col(read_at).isNotNull(), F.lit("Read"))
        .when(col(seen) > 0, F.concat(col(correct).cast("string"), F.lit("/"), col(seen).cast("string"), F.lit(" right")))
        .otherwise(F.lit("Unread"))
    )


def allowed_file(name: ColumnOrName, suffixes: tuple[str, ...] = ("pdf", "html", "htm")) -> Column:
    return col(name).rlike(rf"(?i)\.({'|'.join(suffixes)})$")


def web_address(url: ColumnOrName) -> Column:
    return F.trim(col(url)).rlike(r"(?i)^https?://")


def readability(n_chars: ColumnOrName, pdf_url: ColumnOrName, rendered: int = 1000, full: int = 6000) -> Column:
    """What to do with an extracted article: render the page, take the PDF, or keep the text."""
    return F.when(col(n_chars) < rendered, "needs_render").when((col(n_chars) < full) & col(pdf_url).isNotNull(), "use_pdf").otherwise("keep")


def model_installed(installed: ColumnOrName, model: ColumnOrName) -> Column:
    """Exact name or its ``:latest``; null when the list itself is missing (server unreachable)."""
    return F.array_contains(col(installed), col(model)) | F.array_contains(col(installed), F.concat(col(model), F.lit(":latest")))
