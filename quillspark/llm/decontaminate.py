"""Benchmark decontamination by winnowing.

Words are lower-cased runs of ASCII letters, digits and all characters beyond
ASCII.  A *window* is ``window`` consecutive words of a benchmark item; an item
with fewer words (but not none) is one window.  A document word inside an
occurrence of a window is *hit*.

Winnowing keeps, of every run of ``window - k + 1`` consecutive k-grams, the
one with the least hash (the last of equals).  Two equal windows keep the same
k-gram, so each shared window has a fingerprint in common; joining the
fingerprints and extending each match to both sides, word by word, therefore
finds every shared window and nothing else.  Items shorter than a window have
no such guarantee; their whole word sequences are looked up directly.

The benchmark is taken in blocks of about ``block_bytes`` of text.  A benchmark of
one block is broadcast.  Several are written to the shared folder; a task gathers
``SPAN_BYTES`` of documents and takes one block after another against them, so that
neither the driver nor a task holds more than one block, and marks add up.
Documents are not shuffled.

Edge cases: null texts have no words; an item with a null id marks words but is
not listed; equal ids count once; extra columns of either table are ignored;
rows that share a doc_id are judged each by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytescan as bs
from quillspark.scratch import scratch_path

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(h: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Positions kept by winnowing the hashes ``h``, row by row, with ``w`` hashes a window.

    ``first`` bounds the rows.  Of equal minima the last one is kept.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    # The low bits make room for the position, so that ties fall to the last.
    best = h.copy()
    at = np.arange(n)
    span = 1
    while span < w:  # doubling, the last step overlapping
        step = min(span, w - span)
        if step >= n:
            break
        right_h, right_at = best[step:], at[step:]
        take = right_h <= best[:-step]
        new_h, new_at = best.copy(), at.copy()
        new_h[:-step][take] = right_h[take]
        new_at[:-step][take] = right_at[take]
        best, at, span = new_h, new_at, span + step
    lengths = np.diff(first)
    ends = np.repeat(first[1:], lengths)
    ok = np.arange(n) + w <= ends
    return np.unique(at[ok])


class Block:
    """Lookup arrays of one block of benchmark items."""

    def __init__(self, ids: list[int | None], texts: list[str], window: int, k: int) -> None:
        self.window, self.k, self.ids = window, k, ids
        whole = bs.TextSlice(*bs.text_buffers(pa.array(texts, pa.large_string())), 0)
        w = bs.words(whole, bs.ALNUM)
        self.h = bs.word_hashes(whole.buf, w)
        self.first = w.first
        counts = w.counts
        item = np.repeat(np.arange(len(ids)), counts)
        grams = bs.gram_hashes(self.h, k)
        lo, hi = bs.gram_rows(w, k)
        keep = counts >= window
        compact = np.concatenate([np.arange(a, b) for a, b, y in zip(lo, hi, keep) if y] or [np.zeros(0, np.int64)])
        sizes = np.where(keep, hi - lo, 0)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = compact[winnow(grams[compact], bounds, window - k + 1)] if len(compact) else compact
        order = np.argsort(grams[at], kind="stable")
        self.fp, self.fp_at = grams[at][order], at[order]
        self.item = item
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, window):
            which = np.flatnonzero(counts == n)
            if len(which):
                g = bs.gram_hashes(self.h, n)[self.first[which]]
                o = np.argsort(g, kind="stable")
                self.short[n] = (g[o], which[o])

    def mark(self, h: np.ndarray, w: bs.Words, edge: np.ndarray, hits: list[list[set[int]]]) -> None:
        """Add to ``edge`` (+1 and -1 at run bounds) and to the items of each row in ``hits``."""
        counts = w.counts
        row = np.repeat(np.arange(len(counts)), counts)
        k, window = self.k, self.window
        if len(self.fp) and len(h) >= window:
            grams = bs.gram_hashes(h, k)
            lo, hi = bs.gram_rows(w, k)
            # k-grams that cross rows go: their slots are never a row's own
            sizes = hi - lo
            compact = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            at = compact[winnow(grams[compact], bounds, window - k + 1)] if len(compact) else compact
            a = np.searchsorted(self.fp, grams[at], "left")
            b = np.searchsorted(self.fp, grams[at], "right")
            some = b > a
            for p, x, y in zip(at[some].tolist(), a[some].tolist(), b[some].tolist()):
                r = row[p]
                d_lo, d_hi = int(w.first[r]), int(w.first[r + 1])
                for q in self.fp_at[x:y].tolist():
                    i = int(self.item[q])
                    i_lo, i_hi = int(self.first[i]), int(self.first[i + 1])
                    if not np.array_equal(h[p : p + k], self.h[q : q + k]):
                        continue
                    left = right = 0
                    while left < window - k and p - left > d_lo and q - left > i_lo and h[p - left - 1] == self.h[q - left - 1]:
                        left += 1
                    while right < window - k and p + k + right < d_hi and q + k + right < i_hi and h[p + k + right] == self.h[q + k + right]:
                        right += 1
                    if left + k + right >= window:
                        edge[p - left] += 1
                        edge[p + k + right] -= 1
                        hits[r].append(i)
        for n, (keys, which) in self.short.items():
            if len(h) < n:
                continue
            g = bs.gram_hashes(h, n)
            a = np.searchsorted(keys, g, "left")
            inside = a < len(keys)
            found = np.zeros(len(g), bool)
            found[inside] = keys[a[inside]] == g[inside]
            for p in np.flatnonzero(found).tolist():
                if row[p] != row[p + n - 1]:
                    continue
                edge[p] += 1
                edge[p + n] -= 1
                hits[row[p]].extend(which[a[p] : np.searchsorted(keys, g[p], "right")].tolist())


class Marks:
    """The words of a slice of documents, and what the blocks mark in it."""

    def __init__(self, s: bs.TextSlice) -> None:
        self.w = bs.words(s, bs.ALNUM)
        self.h = bs.word_hashes(s.buf, self.w)
        self.edge = np.zeros(len(self.h) + 1, np.int64)
        self.names: list[set[str]] = [set() for _ in range(len(s))]

    def add(self, block: Block) -> None:
        hits: list[list[int]] = [[] for _ in self.names]
        block.mark(self.h, self.w, self.edge, hits)
        for mine, got in zip(self.names, hits):
            mine.update(str(block.ids[i]) for i in set(got) if block.ids[i] is not None)

    def told(self) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Words, hit words and found items of each row."""
        hit = np.cumsum(self.edge)[:-1] > 0
        return self.w.counts, np.diff(np.concatenate([[0], np.cumsum(hit)])[self.w.first]), self.names


class Judge:
    """Marks documents against the blocks of a benchmark, which it makes one at a time."""

    def __init__(self, blocks: Blocks, window: int, k: int) -> None:
        self.blocks, self.window, self.k = blocks, window, k
        self.held: Block | None = None

    def _each(self) -> Iterator[Block]:
        if isinstance(self.blocks, list):
            for path in self.blocks:
                store, root = fs.FileSystem.from_uri(path)
                files = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet")]
                table = pa.concat_tables([pq.read_table(x, filesystem=store, partitioning=None) for x in files])
                yield Block(table["item_id"].to_pylist(), table["text"].to_pylist(), self.window, self.k)
        else:
            self.held = self.held or Block(*self.blocks.value, self.window, self.k)
            yield self.held

    def run(self, batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list[Marks]]]:
        """Each batch with the marks of its slices."""
        waiting: list[tuple[pa.RecordBatch, list[Marks]]] = []
        size = 0
        for batch in batches:
            marks = []
            for s in bs.slices(batch.column(place)):
                marks.append(Marks(s))
                size += len(s.buf)
            waiting.append((batch, marks))
            if size >= (SPAN_BYTES if isinstance(self.blocks, list) else 0):
                yield from self._judged(waiting)
                waiting, size = [], 0
        yield from self._judged(waiting)

    def _judged(self, waiting: list) -> Iterator[tuple[pa.RecordBatch, list[Marks]]]:
        if waiting:
            for block in self._each():
                for _, marks in waiting:
                    for m in marks:
                        m.add(block)
        yield from waiting


#: Documents that a task gathers before it goes through several blocks.
SPAN_BYTES = 32_000_000
#: A broadcast block, or the folders of several.
Blocks = Broadcast | list[str]


def _blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Blocks:
    """The benchmark as one broadcast block of at most ``block_bytes`` of text, or in several in the shared folder."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // block_bytes))
    if n_blocks == 1:
        rows = items.distinct().collect()  # at most block_bytes of text
        return spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
    root = scratch_path(spark, "benchmark")
    parts = items.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))
    parts.repartition("block").write.partitionBy("block").parquet(root)
    used = sorted(r.block for r in spark.read.parquet(root).select("block").distinct().collect())
    uri = root if "://" in root or root.startswith("file:") else f"file://{root}"
    return [f"{uri}/block={b}" for b in used]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 16_000_000) -> DataFrame:
    """One row for each document: its words, its hit words and the items found in it.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, sorted
    as strings and joined by commas), contaminated.
    """
    blocks = _blocks(docs, benchmark, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, marks in Judge(blocks, window, k).run(batches, 1):
            at = 0
            for m in marks:
                n_words, n_hit, names = m.told()
                columns = [
                    batch.column(0).slice(at, len(names)),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]),
                    pa.array(n_hit > 0),
                ]
                at += len(names)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(scan, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 16_000_000) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs; all columns kept."""
    blocks = _blocks(docs, benchmark, block_bytes)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, marks in Judge(blocks, window, k).run(batches, place):
            clean = [m.told()[1] == 0 for m in marks]
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)


WINNOW_SQL = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, len(g) AS n, g FROM (
  SELECT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM bw)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT doc_id, item_id, i, wins.n FROM grams JOIN wins ON grams.n = wins.n AND grams.g = wins.g),
marked AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
