"""Plug points for embedders, analysers, planners, judges and answerers, with offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

_WORDS = 100_000  # words whose hashes a stand-in embedder holds, besides those of one text

Embed = Callable[[list[str]], np.ndarray]
Complete = Callable[[str], str]


def hashed_embedder(dim: int = 64) -> Embed:
    """A deterministic stand-in: token counts hashed to ``dim`` signed buckets."""

    known: dict[str, int] = {}  # of words seen before: the bucket, from ``dim`` on if it counts down

    def place(w: str) -> int:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        return h % dim if h >> 63 else h % dim + dim

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            found = t.lower().split()
            at = [known.get(w, -1) for w in found]
            if -1 in at:
                if len(known) > _WORDS:
                    known.clear()
                at = [known[w] if w in known else known.setdefault(w, place(w)) for w in found]
            n = np.bincount(np.array(at, np.int64), minlength=2 * dim)
            out[i] = n[:dim] - n[dim:]
        return out

    return embed


def embed_chunks(chunks: DataFrame, embed: Embed, key: str = "id", batch: int = 64) -> DataFrame:
    """(key, embedding): unit vectors of title and text, embedded in batches."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                v = np.asarray(embed(part.column(1).to_pylist()), np.float32)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "embedding"])

    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return chunks.select(key, text.alias("t")).mapInArrow(scan, f"{key} {dict(chunks.dtypes)[key]}, embedding array<float>")


def complete_rows(rows: DataFrame, key: str, prompt: str, complete: Complete, answer: str = "reply") -> DataFrame:
    """(key, reply): a language model's reply to each prompt; an error gives null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(1).to_pylist():
                try:
                    out.append(complete(p or ""))
                except Exception:  # a reply is optional, whatever the client raises
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, answer])

    return rows.select(key, prompt).mapInArrow(scan, f"{key} {dict(rows.dtypes)[key]}, {answer} string")


def sub_queries(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """(qid, sub_idx, text): a planner's JSON list of sub-queries; the question itself where there is none."""
    parsed = T.parse_reply(F.col("reply"), "array<string>")
    rows = questions.join(replies, "qid", "left").withColumn("subs", F.filter(F.coalesce(parsed, F.array()), lambda s: F.length(T.strip(s)) > 0))
    rows = rows.select("qid", F.posexplode(F.when(F.size("subs") > 0, F.col("subs")).otherwise(F.array("question"))).alias("sub_idx", "text"))
    return rows


def overlap_judge(facts: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, fact, covered): a stand-in judge; a fact is covered if enough of its words are in the answer."""
    words = lambda c: F.array_distinct(T.tokens(F.coalesce(F.col(c), F.lit(""))))
    share = F.size(F.array_intersect(words("fact"), words("answer"))) / F.greatest(F.size(words("fact")), F.lit(1))
    return facts.select("id", "fact", ((share >= least) & (F.size(words("fact")) > 0)).alias("covered"))


def refusing(_: str) -> str:
    """A stand-in model that plans nothing."""
    return json.dumps([])


def halving(question: str) -> str:
    """A stand-in planner: both halves of the whole question and a blank one between them, in a code fence."""
    half = len(question) // 2
    return "```json\n" + json.dumps([question[:half], "  ", question[half:]]) + "\n```"


@dataclass(frozen=True)
class Embedder:
    """An entry of the registry: how to make the model, its dimension, and where its vectors are stored."""

    make: Callable[[], Embed]
    dim: int
    vectors: str


EMBEDDERS: dict[str, Embedder] = {}


def register_embedder(name: str, make: Callable[[], Embed], dim: int, vectors: str) -> None:
    EMBEDDERS[name] = Embedder(make, dim, vectors)


def embedder(name: str | None = None) -> Embedder:
    """The embedder of a name, else of ``QUILLSPARK_EMBEDDER``, else the first registered one."""
    name = name or os.environ.get("QUILLSPARK_EMBEDDER") or next(iter(EMBEDDERS))
    if name not in EMBEDDERS:
        raise KeyError(f"no embedder {name!r}; known: {', '.join(EMBEDDERS)}")
    return EMBEDDERS[name]


register_embedder("hashed-16", partial(hashed_embedder, 16), 16, "vectors_hashed_16")
register_embedder("hashed-64", partial(hashed_embedder, 64), 64, "vectors_hashed_64")


def search_fallback(questions: DataFrame, contexts: DataFrame, search: Complete) -> DataFrame:
    """(qid, context, searched): the contexts, and for questions (qid, question) without one what ``search`` finds; its errors become text."""

    def told(question: str) -> str:
        try:
            return search(question)
        except Exception as e:  # whatever the client raises
            return f"search failed: {e}"

    lost = questions.join(contexts.select("qid"), "qid", "left_anti")
    found = complete_rows(lost, "qid", "question", told, "context")
    return contexts.select("qid", "context", F.lit(False).alias("searched")).unionByName(found.withColumn("searched", F.lit(True)))
