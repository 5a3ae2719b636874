"""Answers from assembled context: chat clients, fallback between them, one Arrow pass over questions (inventory G6-G9)."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERS = "query_id long, raw_answer string, model_name string, prompt_tokens long, completion_tokens long, latency_ms double, error string"


class ChatClient(Protocol):
    name: str

    def complete(self, messages: list[dict]) -> tuple[str, dict]: ...


class ExtractiveClient:
    """No model: answers with the first sentence of each numbered block and cites it."""

    name = "extractive"

    def complete(self, messages: list[dict]) -> tuple[str, dict]:
        prompt = messages[-1]["content"]
        found = re.findall(r"(?m)^\[(\d+)\] [^\n]*\n([^\n]*?[.!?])(?:\s|$)", prompt)
        text = " ".join(f"{said} [{ref}]" for ref, said in found) or "The sources do not answer this."
        return text, {"prompt_tokens": len(prompt.split()), "completion_tokens": len(text.split())}


class FallbackClient:
    """Asks the second client where the first is unavailable; other errors, and the second's own, go on to the caller."""

    def __init__(self, first: ChatClient, second: ChatClient, unavailable: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)):
        self.first, self.second, self.unavailable, self.name = first, second, unavailable, first.name

    def complete(self, messages: list[dict]) -> tuple[str, dict]:
        try:
            return self.first.complete(messages)
        except self.unavailable:
            return self.second.complete(messages)


def generate(questions: DataFrame, system: str, make: Callable[[], ChatClient] = ExtractiveClient, keep: tuple[str, ...] = ()) -> DataFrame:
    """ANSWERS of questions(query_id, context, question), and their columns keep as they are; one client for each task. A failed row carries its error."""
    names = [f.split()[0] for f in ANSWERS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())

    def run(batches):
        client = make()
        for batch in batches:
            rows = []
            for key, context, question in zip(*(batch.column(i).to_pylist() for i in range(3))):
                user = f"Source Documents:\n{context or ''}\n\nQuestion: {question or ''}"
                start, text, usage, error = time.monotonic(), None, {}, None
                try:
                    text, usage = client.complete([{"role": "system", "content": system}, {"role": "user", "content": user}])
                except Exception as e:  # noqa: BLE001 - one question's failure is that row's result
                    error = f"{type(e).__name__}: {e}"
                rows.append((key, text, client.name, (usage or {}).get("prompt_tokens", 0), (usage or {}).get("completion_tokens", 0), (time.monotonic() - start) * 1000, error))
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(zip(*rows), kinds)), *batch.columns[3:]], [*names, *keep])

    asked = questions.select(F.col("query_id").cast("long"), "context", "question", *keep)
    further = "".join(f", {c} {t}" for c, t in asked.select(*keep).dtypes)
    return asked.mapInArrow(run, ANSWERS + further)
