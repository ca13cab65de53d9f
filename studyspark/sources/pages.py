"""Page texts of binary documents by injected readers.

No library for page images or page layouts is needed here: a ``Reader`` opens a document
and gives the number of its pages and the text of each.  What the first reader cannot
read, the second does; pages with hardly any text go to an OCR callable, if there is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html_article import article_text, page_struct
from ..functions.text import SPARSE_PAGE_CHARS, strip_dot_leaders
from ..operators.layout import assemble

PAGES = "page int, text string, fallback boolean, ocr boolean, skipped boolean, error string"


class Reader(Protocol):
    def count(self, content: bytes) -> int: ...

    def text(self, content: bytes, page: int) -> str:
        """Text of a page, counted from 0."""


@dataclass(frozen=True)
class Readers:
    """``ocr`` is None where no OCR is installed."""

    first: Reader
    second: Reader
    ocr: Callable[[bytes, int], str] | None = None

    def page(self, content: bytes, n: int) -> tuple[str, bool, bool, bool, str | None]:
        """(text, fallback, ocr, skipped, error) of one page."""
        notes, fallback = [], False
        try:
            text = self.first.text(content, n)
        except Exception as e:  # noqa: BLE001 - whatever a reader stumbles over, the other one reads the page
            fallback = True
            notes.append(type(e).__name__)
            text = self.second.text(content, n).replace("\r\n", "\n")
        sparse = len("".join(text.split())) < SPARSE_PAGE_CHARS
        seen = False
        if sparse and self.ocr is not None:
            try:
                text, seen = self.ocr(content, n), True
            except Exception as e:  # noqa: BLE001 - the page keeps what there is
                notes.append(f"OCR: {e}")
        return text, fallback, seen, sparse and self.ocr is None, "; ".join(notes) or None


def read_pages(files: DataFrame, readers: Readers) -> DataFrame:
    """(doc_id, page, text, fallback, ocr, skipped, error) of every page of files (doc_id, content); pages count from 1.

    A document that neither reader can open, or a page that neither can read, is one row with an error and an empty
    text; null contents and documents without pages give no row.  Pages go out one by one, so a long document is never
    held twice."""
    kind = dict(files.dtypes)["doc_id"]
    names = ["doc_id", "page", "text", "fallback", "ocr", "skipped", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())

        def row(ids, values):
            return pa.RecordBatch.from_arrays([ids, *(pa.array([v], t) for v, t in zip(values, types, strict=True))], names=names)

        for b in batches:
            for i, content in enumerate(b.column(1)):
                content, ids = content.as_py(), b.column(0).slice(i, 1)
                if content is None:
                    continue
                try:
                    n = readers.first.count(content)
                except Exception as e:  # noqa: BLE001
                    yield row(ids, (1, "", False, False, False, f"{type(e).__name__}: {e}"))
                    continue
                for page in range(n):
                    try:
                        yield row(ids, (page + 1, *readers.page(content, page)))
                    except Exception as e:  # noqa: BLE001
                        yield row(ids, (page + 1, "", True, False, False, f"{type(e).__name__}: {e}"))

    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, {PAGES}")


def page_counts(files: DataFrame, reader: Reader) -> DataFrame:
    """(doc_id, pages, error) of files (doc_id, content); pages is null where the document cannot be opened."""
    kind = dict(files.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            pages, errors = [], []
            for content in b.column(1).to_pylist():
                try:
                    pages.append(reader.count(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a document that cannot be opened does not end the job
                    pages.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pages, pa.int32()), pa.array(errors, pa.string())], names=["doc_id", "pages", "error"])

    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, pages int, error string")


def is_web_page(name: str | Column) -> Column:
    return F.lower(name).rlike(r"\.html?$")


def texts(files: DataFrame, readers: Readers) -> DataFrame:
    """(doc_id, text) of files (doc_id, name, content): saved web pages by the article reader, all others page by page."""
    web = files.where(is_web_page("name")).select("doc_id", article_text(page_struct(F.col("content").cast("string"))["raw"]).alias("text"))
    paged = assemble(read_pages(files.where(~is_web_page("name")), readers))
    return web.unionByName(paged).withColumn("text", strip_dot_leaders("text"))


class SplitReader:
    """A plain reader for tests and tables: pages are parted by form feeds; a page that opens with ``broken`` fails."""

    def __init__(self, broken: str = "", line_end: str = "\n"):
        self.broken, self.line_end = broken, line_end

    def pages(self, content: bytes) -> list[str]:
        if content is None or content[:4] != b"%PDF":
            raise ValueError("not a PDF")
        return content[4:].decode("utf-8", "replace").split("\f")

    def count(self, content: bytes) -> int:
        return len(self.pages(content))

    def text(self, content: bytes, page: int) -> str:
        found = self.pages(content)[page]
        if self.broken and found.startswith(self.broken):
            raise RuntimeError("unreadable page")
        return found.replace("\n", self.line_end)
