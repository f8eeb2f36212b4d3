"""Models behind small interfaces, run over Arrow batches with one load a worker.

No neural model is installed here; the stand-ins are deterministic and say nothing about a model's quality.
"""

from __future__ import annotations

import functools
import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Tokenizer(Protocol):
    def tokenize(self, text: str) -> list[str]: ...


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, queries: Sequence[str], documents: Sequence[str]) -> Sequence[float]: ...


class Generator(Protocol):
    def generate(self, prompts: Sequence[str]) -> Sequence[str]: ...


class HashingEmbedder:
    """Signed hashing of words: whole numbers, so every product of two of these vectors is exact."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            h = np.array([word_hash(w) for w in (text or "").lower().split()], np.int64)
            np.add.at(out[i], (h >> 1) % self.dim, np.where(h & 1, np.float32(1), np.float32(-1)))
        return out


@functools.lru_cache(1 << 16)
def word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)


class OverlapReranker:
    """The share of the query's words that a document holds."""

    def score(self, queries: Sequence[str], documents: Sequence[str]) -> list[float]:
        return [len(q & d) / max(len(q), 1) for q, d in ((set(a.lower().split()), set(b.lower().split())) for a, b in zip(queries, documents, strict=True))]


class ExtractiveGenerator:
    """The first line of text under the first heading of the prompt's context."""

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return [next((line for line in p.split("]\n", 1)[-1].splitlines() if line.strip()), "") for p in prompts]


class TemplatePlanner:
    """Plans by a template: what a planner's answers look like, for the query named in the prompt."""

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return [self.answer(p, p.split("\n")[1]) for p in prompts]

    def answer(self, prompt: str, query: str) -> str:
        if prompt.startswith("EXPAND"):
            return json.dumps({"semantic_variants": [{"text": f"quy định {query}", "kind": "semantic", "reason": "template"}], "subqueries": [], "lexical_terms": [query]}, ensure_ascii=False)
        return json.dumps({"analysis": {"intent": "unknown", "query_type": "legal_concept", "entities": [], "temporal_scope": "current", "must_terms": []}}, ensure_ascii=False)


def tokenizer_udf(make: Callable[[], Tokenizer], batch: int = 256) -> Callable[[Column], Column]:
    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for a in parts:
            yield pa.array([model.tokenize(x or "") for at in range(0, len(a), batch) for x in a.slice(at, batch).to_pylist()], pa.list_(pa.string()))

    return run


def embedder_udf(make: Callable[[], Embedder], batch: int = 256) -> Callable[[Column], Column]:
    """A batch's texts become Python strings a few hundred at a time."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for a in parts:
            rows = [np.asarray(model.embed([x or "" for x in a.slice(at, batch).to_pylist()]), np.float32).reshape(len(a.slice(at, batch)), -1) for at in range(0, len(a), batch)]
            x = np.concatenate(rows) if rows else np.zeros((0, model.dim), np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return run


def reranker_udf(make: Callable[[], Reranker], batch: int = 256) -> Callable[[Column, Column], Column]:
    @F.arrow_udf("double")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make()
        for q, d in parts:
            some = lambda a, at: [x or "" for x in a.slice(at, batch).to_pylist()]
            scores = [s for at in range(0, len(q), batch) for s in model.score(some(q, at), some(d, at))]
            yield pa.array([float(np.ravel(s)[-1]) for s in scores], pa.float64())

    return run


def generate(prompts: DataFrame, make: Callable[[], Generator], batch: int = 8) -> DataFrame:
    """id, answer of (id, prompt); an empty answer or a short batch is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            answers: list[str] = []
            for at in range(0, len(part), batch):
                some = part["prompt"].iloc[at : at + batch].tolist()
                got = [a.strip() for a in model.generate(some)]
                if len(got) != len(some) or not all(got):
                    raise ValueError("the model left a prompt without an answer")
                answers += got
            yield pd.DataFrame({"id": part["id"].to_numpy(), "answer": answers})

    return prompts.select("id", "prompt").mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, answer string")


def respond(prompts: DataFrame, make: Callable[[], Generator], batch: int = 8, raw: str = "raw") -> DataFrame:
    """All columns but prompt, and the model's answer as ``raw``, whatever it is (a missing one is empty)."""
    kept = [f for f in prompts.schema.fields if f.name not in ("prompt", raw)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for part in parts:
            asked = part.column(part.schema.get_field_index("prompt")).to_pylist()
            got = [a for at in range(0, len(asked), batch) for a in [*model.generate(asked[at : at + batch]), *[""] * batch][: len(asked[at : at + batch])]]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), pa.array(got, pa.string())], names=[*(f.name for f in kept), raw])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{raw} string"])
    return prompts.mapInArrow(run, schema)


def rerank_pair(question: Column, intent: Column, scope_queries: Column, title: Column, scopes: Column, text: Column) -> tuple[Column, Column]:
    """What a reranker reads of a query and of a candidate. scope_queries: map of scope to query."""
    known = F.filter(F.transform(scopes, lambda s: F.try_element_at(scope_queries, s)), lambda x: x.isNotNull())
    query = F.concat(F.lit("Câu hỏi pháp luật: "), question, F.lit("\nÝ định cần trả lời: "), intent, F.lit("\nCâu truy vấn theo phạm vi: "), F.array_join(known, "\n"))
    document = F.concat(F.lit("Điều luật: "), F.coalesce(title, F.lit("")), F.lit("\nPhạm vi truy xuất: "), F.array_join(scopes, ", "), F.lit("\nNội dung: "), text)
    return query, document


def with_retries(write: Callable[[], None], retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> None:
    """Call until it succeeds, at most retries more times, waiting 1, 2, 4 ... at most 30 seconds between."""
    for attempt in range(retries + 1):
        try:
            return write()
        except Exception:
            if attempt == retries:
                raise
            sleep(min(2**attempt, 30))
