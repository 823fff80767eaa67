"""External models behind small interfaces, with deterministic stand-ins (A16, A18, A22, A11, 2.U).

Results of a stand-in say nothing about a real model's quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import word_vector
from ..session import ship


class Encoder(Protocol):
    name: str
    dims: int

    def encode(self, rows: DataFrame, text_col: str) -> DataFrame:
        """The rows, identified by their first column, with ``vector``."""


class HashedEncoder:
    """Hashed word counts with unit norm."""

    name = "hashed-64"

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        ship(rows.sparkSession)
        return rows.withColumn("vector", word_vector(F.col(text_col), self.dims))


class FunctionEncoder:
    """A Python model: ``load`` runs once per worker task and gives a function from texts to vectors."""

    def __init__(self, name: str, dims: int, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16):
        self.name, self.dims, self.load, self.batch = name, dims, load, batch

    def encode(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        ship(rows.sparkSession)
        load, batch = self.load, self.batch

        @F.pandas_udf("array<float>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in parts:
                texts = s.fillna("").tolist()
                yield pd.Series([v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])])

        return rows.withColumn("vector", run(F.col(text_col)))


class LLM(Protocol):
    provider: str
    model: str

    def generate_json(self, system: str, prompt: str, schema: dict) -> dict: ...


class LLMError(RuntimeError):
    """The call failed for good."""


class QuotaError(LLMError):
    """No further call will succeed for now."""


class ScriptedLLM:
    """Gives prepared replies in turn, or by the first key that the prompt holds."""

    provider, model = "scripted", "scripted"

    def __init__(self, replies: list[dict] | dict[str, dict]):
        self.replies, self.calls = replies, []

    def generate_json(self, system: str, prompt: str, schema: dict) -> dict:
        self.calls.append(prompt)
        if isinstance(self.replies, list):
            if len(self.calls) > len(self.replies):
                raise QuotaError("no reply left")
            reply = self.replies[len(self.calls) - 1]
        else:
            reply = next((r for k, r in self.replies.items() if k in prompt), None)
            if reply is None:
                raise LLMError("no reply for this prompt")
        if isinstance(reply, Exception):
            raise reply
        return reply


_llms: dict[str, Callable[[str], LLM]] = {}
_ocr: dict[str, Callable[[], object]] = {}
_engines: dict[str, object] = {}


def register_llm(provider: str, make: Callable[[str], LLM]) -> None:
    _llms[provider] = make


def get_llm(provider: str, model: str) -> LLM:
    if provider not in _llms:
        raise ValueError(f"unknown provider {provider!r}")
    return _llms[provider](model)


def register_ocr(name: str, make: Callable[[], object]) -> None:
    _ocr[name] = make


def get_ocr_engine(name: str) -> object | None:
    """One engine per process; ``none`` is no engine, unknown names raise."""
    if name == "none":
        return None
    if name not in _ocr:
        raise ValueError(f"unknown OCR engine {name!r}")
    if name not in _engines:
        _engines[name] = _ocr[name]()
    return _engines[name]


def generate(prompts: DataFrame, make: Callable[[], LLM], system: str, schema: dict, columns: str) -> DataFrame:
    """(question_id, reply, error): each prompt sent by the executors; ``columns`` is the reply's type."""
    import json

    ship(prompts.sparkSession)

    def run(batches):
        llm = make()
        for df in batches:
            out = []
            for q, p in zip(df.question_id, df.prompt, strict=True):
                try:
                    out.append((q, json.dumps(llm.generate_json(system, p, schema)), None))
                except LLMError as e:
                    out.append((q, None, str(e)))
            yield pd.DataFrame(out, columns=["question_id", "raw", "error"])

    kind = dict(prompts.dtypes)["question_id"]
    rows = prompts.select("question_id", "prompt").mapInPandas(run, f"question_id {kind}, raw string, error string")
    return rows.select("question_id", F.from_json("raw", columns).alias("reply"), "error")
