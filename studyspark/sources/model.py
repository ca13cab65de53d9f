"""Language models behind a small protocol, a retry wrapper, and a rule-based stand-in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.text import ColumnOrName, col

MAX_ATTEMPTS = 2


class Model(Protocol):
    def __call__(self, task: str, prompt: str) -> str:
        """The raw reply to a prompt; ``task`` names the reply's schema."""


class ModelLooped(ValueError):
    """The model repeated itself without end; worth another attempt."""


def ask(model: Model, task: str, prompt: str, parse: Callable[[str], object], attempts: int = MAX_ATTEMPTS):
    """A parsed reply; malformed ones are asked for again, the last error is raised."""
    last: Exception = ValueError("not asked")
    for _ in range(attempts):
        try:
            return parse(model(task, prompt))
        except ValueError as e:
            last = e
    raise last


def error_kind(status: ColumnOrName, message: ColumnOrName) -> Column:
    """missing, loading, looped, crashed or other; a null status or message tells nothing."""
    text, status = F.lower(F.coalesce(col(message), F.lit(""))), F.coalesce(col(status), F.lit(0))
    says = lambda word: F.contains(text, F.lit(word))
    return (
        F.when((status == 404) | says("not found"), "missing").when(says("timed out") & says("load"), "loading")
        .when(says("repeat") | says("loop"), "looped").when(status >= 500, "crashed").otherwise("other")
    )


def replies(prompts: DataFrame, model: Model, task: str) -> DataFrame:
    """(id, raw, error) for each prompt (id, prompt); a failed prompt is a row with an error, and its last reply
    (which may be plain text) if there was one."""
    kind = dict(prompts.dtypes)["id"]

    def run(batches):
        for b in batches:
            raw, error = [], []
            for p in b.column(1).to_pylist():
                said: list[str] = []
                try:
                    ask(lambda t, q, said=said: said.append(model(t, q)) or said[-1], task, p, json.loads)
                    error.append(None)
                except ValueError as e:
                    error.append(str(e))
                raw.append(said[-1] if said else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.string()), pa.array(error, pa.string())], names=["id", "raw", "error"])

    bounded(prompts.sparkSession)
    return prompts.select("id", "prompt").mapInArrow(run, f"id {kind}, raw string, error string")


class SentenceModel:
    """A deterministic stand-in that asks about a text's longest sentences and does not always agree.

    Prompts are a text behind "TEXT", if any, an instruction, and data as JSON after the last line that is "DATA".
    The blind answer to a question is the sentence that its words open; it has none if the number of the sentence's
    letters is a multiple of 7.  The judge says that a premise is false, an answer unsupported, or that both disagree,
    for answers whose letters are a multiple of 11, 5 or 3 in number; some replies are plain text or cut off."""

    def __init__(self, levels: tuple[str, ...] = ("overview", "approach", "evidence", "critique")):
        self.levels = levels

    def __call__(self, task: str, prompt: str) -> str:
        asked, _, data = prompt.rpartition("\nDATA\n")
        text = asked.partition("TEXT\n")[2].rpartition("\n\n")[0] if asked.startswith("TEXT\n") else ""
        return getattr(self, task)(text, json.loads(data))

    @staticmethod
    def sentences(text: str) -> list[str]:
        return sorted({s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if len(s.strip()) >= 40}, key=lambda s: (-len(s), s))

    @staticmethod
    def letters(text: str) -> int:
        return sum(map(str.isalnum, text))

    def questions(self, text, data):
        found = self.sentences(text)[: data["n"]]
        made = [{"type": self.levels[self.letters(s) % len(self.levels)], "question": f"What is said about {' '.join(s.split()[:5])}?", "answer": s, "evidence": s if self.letters(s) % 4 else "words that nobody wrote in any text"} for s in found]
        if len(text) % 9 == 0:  # a model that forgets the format
            return "\n".join(f"Q: {q['question']}\nA: {q['answer']}" for q in made)
        return json.dumps({"questions": made})

    def rank(self, text, data):
        return json.dumps({"ranked_ids": [c["id"] for c in sorted(data["candidates"], key=lambda c: (-self.letters(c["question"]), c["id"]))]})

    def blind(self, text, data):
        if len(text) % 13 == 0:
            return '{"answers": [{"id"'
        out = []
        for item in data["items"]:
            opening = item["question"].removeprefix("What is said about ").removesuffix("?")
            own = next((s for s in self.sentences(text) if s.startswith(opening)), "")
            out.append({"id": item["id"], "answerable": self.letters(own) % 7 != 0, "answer": own, "quote": own})
        return json.dumps({"answers": out})

    def judge(self, text, data):
        said = lambda n: {"premise_ok": n % 11 != 0, "a_supported": n % 5 != 0, "verdict": "disagree" if n % 3 == 0 else "agree", "reason": "by its length"}
        return json.dumps({"judgements": [{"id": i["id"], **said(self.letters(i["answer_a"]))} for i in data["items"]]})

    def title(self, text, data):
        return json.dumps({"title": next(iter(text.split("\n\n")[0].strip().splitlines()), "")})

    def grade(self, text, data):
        same = self.letters(data["answer"]) and data["answer"].lower() in data["reference"].lower()
        return json.dumps({"verdict": "correct", "feedback": "you said it"} if same else {"feedback": "you missed it"})
