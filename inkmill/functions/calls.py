"""Calls of a model as a table function: bounded concurrency, retries, one repair, a deterministic stub."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from inkmill.functions.text import canonical

BACKOFF, SENDS, DRAFTS, LOW, HIGH = (2, 5, 15, 30, 60), 6, 3, 0.85, 1.15


def request_key(payload: dict) -> str:
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


def stub_write(text: str, attempt: int) -> str:
    """Words of the text dealt by a hash: the same for the same input."""
    words = text.split()
    n = max(1, int(len(words) * (0.7 + 0.2 * attempt)))
    return " ".join(words[(k * 7) % len(words)] for k in range(n)) if words else ""


def stub_judge(payload: dict) -> str:
    n = int(request_key(payload)[:8], 16)
    return json.dumps({"scores": [{"id": i, "score": (n >> (4 * k)) % 11, "evidence": ""} for k, i in enumerate(payload["criteria"])]})


def with_retries(send: Callable[[], tuple[int, str]], retryable=frozenset((408, 409, 425, 429, 500, 502, 503, 504)), wait: Callable[[float], None] = lambda s: None) -> tuple[str, int]:
    """(reply, sends). Sends again on a retryable status, SENDS times at most."""
    for k in range(SENDS):
        status, reply = send()
        if status == 200:
            return reply, k + 1
        if status not in retryable or k == SENDS - 1:
            raise RuntimeError(f"status {status} after {k + 1} sends")
        wait(BACKOFF[min(k, len(BACKOFF) - 1)])
    raise AssertionError


def structured(call: Callable[[str | None], str], validate: Callable[[dict], None]) -> tuple[str, dict | None, str | None]:
    """('valid', value, None) or ('missing', None, error): parse, validate, and repair once with the error's first 500 characters."""
    error = None
    for _ in range(2):
        try:
            value = json.loads(call(error))
            validate(value)
            return "valid", value, None
        except (ValueError, KeyError) as e:
            error = str(e)[:500]
    return "missing", None, error


def drafts(docs: DataFrame, write: Callable[[str, int], str] = stub_write, concurrency: int = 8) -> DataFrame:
    """(doc_id, attempt, words, length_compliant): drafts until one has the length of its text, DRAFTS at most."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                target = len((text or "").split())
                for k in range(DRAFTS):
                    n = len(write(text or "", k).split())
                    out.append((doc_id, k, n, LOW * target <= n <= HIGH * target))
                    if out[-1][3]:
                        break
            yield pd.DataFrame(out, columns=["doc_id", "attempt", "words", "length_compliant"])

    return docs.select("doc_id", "text").repartition(concurrency).mapInPandas(run, "doc_id long, attempt long, words long, length_compliant boolean")


def grades(docs: DataFrame, criteria: list[str], judge: Callable[[dict], str] = stub_judge) -> DataFrame:
    """(doc_id, status, total): a grade for each text, mean of its scores; total is null if the reply stays invalid."""

    def check(value: dict) -> None:
        if [x["id"] for x in value["scores"]] != criteria or any(not 0 <= x["score"] <= 10 for x in value["scores"]):
            raise ValueError("scores do not fit the rubric")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                status, value, _ = structured(lambda e, t=text: judge({"text": t, "criteria": criteria, "error": e}), check)
                out.append((doc_id, status, sum(x["score"] for x in value["scores"]) / len(criteria) if value else None))
            yield pd.DataFrame(out, columns=["doc_id", "status", "total"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, status string, total double")
