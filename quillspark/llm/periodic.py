"""Periodic runs of words: stretches that repeat themselves at least four times, and texts without the repeats.

A run is a stretch of words with smallest period q and a length of at least
``power`` * q and ``least`` words that can't be extended to either side with period q.

Block matching: let L be the power of two with L <= q < 2 L.  A run of four
periods holds a whole block of L words that starts at a multiple of L, and
that block occurs again q words later.  So for each scale L the aligned blocks
of a document become keys of an Aho-Corasick automaton over word numbers, the
document is searched for all of them at once, and each occurrence from L to
2 L - 1 words behind its block is a seed.  Seeds are extended to both sides, first on
prefix hashes, which can only say too much, to drop those that stay too short
and to join those of one run; then word by word, which decides.  A run's period is the smallest
since scales and periods are taken in ascending order: a multiple of
a run's period leads to the same bounds and is recognised by them.

Not all of a document needs to be searched.  In a run of period q each group of
two (four, from L = 4 on) words has occurred at most q words before, but for the first period.
A stretch where that holds for less than ``(power - 1) * L`` words, or one inside of a run
found at a lesser scale, has no run of scale L.  These stretches are found over whole batches
of documents at once, by sorted hashes of the groups; most documents have none.

Work is n log n steps for n words, whatever they are; the automaton of one
scale holds a node for each word at most.  Rows are independent: nothing is shuffled.

Edge cases: null and empty texts and those of blanks have no words, no runs and an
empty collapsed text; a null id is kept; repeated rows are searched each; other
columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytescan import fmix64, gram_hashes, slices, word_hashes, words

POWER, LEAST = 4, 6
NEVER = np.iinfo(np.int64).max
SEEDS = 1 << 20

Run = tuple[int, int, int]


def shortest(q: int, power: int, least: int) -> int:
    return max(least, power * q)


def group_of(scale: int) -> int:
    """How many words are looked up together at a scale."""
    return 2 if scale < 4 else 4


def distances(h: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """How many words before the ``w`` words from here on occurred last in the same document (``NEVER``: not, or it ends before)."""
    out = np.full(len(h), NEVER)
    g = gram_hashes(h, w)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    counts = np.diff(first)
    at, start, end = np.arange(len(h)), np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
    out[(at - out < start) | (at + w > end)] = NEVER
    return out


def zones(h: np.ndarray, first: np.ndarray, power: int = POWER, least: int = LEAST) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each document that has any: (scale, start, end, where the repeats start) of the stretches that may hold runs.

    ``h`` are the words of several documents, of which the i-th has
    ``first[i]`` to ``first[i + 1]``; bounds are counted within a document.
    """
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    if not len(h):
        return found
    longest, scale, back, w = int(np.diff(first).max()), 1, None, 0
    while power * scale <= longest:
        if w != group_of(scale):
            w = group_of(scale)
            back = distances(h, first, w)
        enough = min(shortest(q, power, least) - q for q in range(scale, min(2 * scale, scale + least))) - w + 1
        breaks = np.concatenate(([-1], np.flatnonzero(back >= 2 * scale), [len(h)]))
        for k in np.flatnonzero(np.diff(breaks) > enough):
            z, last = int(breaks[k]) + 1, int(breaks[k + 1]) - 1
            doc = int(np.searchsorted(first, z, side="right")) - 1
            lo, hi = int(first[doc]), int(first[doc + 1])
            found.setdefault(doc, []).append((scale, max(lo, z - 2 * scale + 1) - lo, min(hi, last + w) - lo, z - lo))
        scale *= 2
    return found


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def seeds(x: np.ndarray, scale: int, spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q): the block of ``scale`` words at p, a multiple of it, occurs again at p + q, with scale <= q < 2 * scale."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    block, key, parts = [], [], []
    for lo, hi in spans:
        part = tuple(x[lo:hi].tolist())
        parts.append((lo, part))
        for p in range(-(-lo // scale) * scale, hi - scale + 1, scale):
            name = part[p - lo : p - lo + scale]
            number = automaton.get(name, -1)
            if number < 0:
                number = len(automaton)
                automaton.add_word(name, number)
            block.append(p)
            key.append(number)
    if not block:
        return
    automaton.make_automaton()
    hits = np.array([(number, lo + end + 1 - scale) for lo, part in parts for end, number in automaton.iter(part)], np.int64).reshape(-1, 2)
    wide = len(x) + 2 * scale + 1
    places = np.sort(hits[:, 0] * wide + hits[:, 1])
    p, base = np.array(block, np.int64), np.array(key, np.int64) * wide
    lo, hi = np.searchsorted(places, base + p + scale), np.searchsorted(places, base + p + 2 * scale)
    total = np.cumsum(hi - lo)
    for a, b in _pieces(total, SEEDS):
        n = (hi - lo)[a:b]
        which = np.repeat(np.arange(a, b), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        yield p[which], places[at] - base[which] - p[which]


def _pieces(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` units, given how many there are up to each item."""
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


class Stretches:
    """How far the words of a document agree with those a distance further on."""

    def __init__(self, x: np.ndarray):
        self.x = x
        power = np.full(len(x) + 1, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(fmix64(x.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * self.power[:-1], dtype=np.uint64)))

    def _alike(self, a: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.power[q] == self.sums[a + q + n] - self.sums[a + q]

    def likely(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the stretch of period ``q`` around ``p``, by hashes: never too short."""
        ahead, behind = np.zeros_like(p), np.zeros_like(p)
        step = 1 << max(0, len(self.x).bit_length() - 1)
        while step:
            fits = np.flatnonzero(p + q + ahead + step <= len(self.x))
            ahead[fits] += step * self._alike(p[fits] + ahead[fits], q[fits], step)
            fits = np.flatnonzero(p - behind - step >= 0)
            behind[fits] += step * self._alike(p[fits] - behind[fits] - step, q[fits], step)
            step //= 2
        return p - behind, p + q + ahead

    def exact(self, p: int, q: int) -> tuple[int, int]:
        """The same, word by word."""
        x, n = self.x, len(self.x)
        end, step = p + q, 64
        while end < n:
            to = min(n, end + step)
            other = np.flatnonzero(x[end:to] != x[end - q : to - q])
            if len(other):
                end += int(other[0])
                break
            end, step = to, 2 * step
        start, step = p, 64
        while start > 0:
            to = max(0, start - step)
            other = np.flatnonzero(x[to:start] != x[to + q : start + q])
            if len(other):
                start = to + int(other[-1]) + 1
                break
            start, step = to, 2 * step
        return start, end


def find_runs(x: np.ndarray, where: list[tuple[int, int, int, int]] | None = None, power: int = POWER, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs among the word numbers ``x``, by start and period."""
    if power < 3:
        raise ValueError("a run of less than three periods may hold no aligned block with its next occurrence")
    if where is None:
        where = zones(fmix64(x.astype(np.uint64)), np.array([0, len(x)]), power, least).get(0, [])
    found: dict[tuple[int, int], int] = {}
    stretches = Stretches(x) if where else None

    def settle(p: int, q: int, likely: tuple[int, int] | None = None) -> bool:
        bounds = stretches.exact(p, q)
        if bounds[1] - bounds[0] >= shortest(q, power, least) and q % found.get(bounds, q + 1):
            found[bounds] = q
        return bounds == likely

    for scale in sorted({z[0] for z in where}):
        bounds = np.array(sorted(found), np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(bounds[:, 1])
        spans = []
        for _, lo, hi, z in (z for z in where if z[0] == scale):
            before = int(np.searchsorted(bounds[:, 0], z, side="right"))
            if not before or reach[before - 1] < hi:  # else inside of a run of a lesser period
                spans.append((lo, hi))
        seen: dict[int, tuple[int, int]] = {}
        for p, q in seeds(x, scale, union(spans)):
            start, end = stretches.likely(p, q)
            long = np.flatnonzero(end - start >= np.maximum(least, power * q))
            _, one = np.unique(q[long] * (len(x) + 1) + start[long], return_index=True)
            for i in long[one].tolist():
                seen[int(q[i]) * (len(x) + 1) + int(start[i])] = (int(p[i]), int(end[i]))
        told_too_much = False
        for code in sorted(seen):
            q, start = divmod(code, len(x) + 1)
            p, end = seen[code]
            if q % found.get((start, end), q + 1):
                told_too_much |= not settle(p, q, (start, end))
        if told_too_much:  # a stretch of equal hashes may have stood for several
            for q, p in sorted((int(b), int(a)) for p, q in seeds(x, scale, union(spans)) for a, b in zip(p, q)):
                settle(p, q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(docs: DataFrame, power: int = POWER, least: int = LEAST) -> DataFrame:
    """One row for each document: doc_id, n_words, runs (start, length, period) and collapsed, the words kept joined by spaces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for s in slices(texts):
                w = words(s)
                where = zones(word_hashes(s.buf, w, lower=False), w.first, power, least)
                offsets, flat, collapsed = [0], [], []
                for i in range(len(s)):
                    tokens, runs = s.row(i).split(), []
                    if i in where:
                        number: dict[bytes, int] = {}
                        x = np.array([number.setdefault(t, len(number)) for t in tokens], np.int64)
                        runs = find_runs(x, where[i], power, least)
                        flat += runs
                        if runs:
                            tokens = [tokens[k] for k in np.flatnonzero(kept_words(len(tokens), runs)).tolist()]
                    offsets.append(len(flat))
                    collapsed.append(b" ".join(tokens))
                parts = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(triple)))
                out = [ids.slice(s.lo, len(s)), pa.array(w.counts, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(scan, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """``docs`` where a tenth of the texts, by crc32 of the id, go over into a loop of their words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def loop(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    looped = F.element_at(F.transform(F.array(split), loop), 1)
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), looped).otherwise(F.col("text")))


def run_report(found: DataFrame) -> DataFrame:
    """The longest run of each document, and digests of its runs and of its collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.selectExpr("doc_id", "n_runs", "-b.start as start", "b.length", "-b.period as period", "1000 * b.length div -b.period as exponent_milli", "runs_sha256", "collapsed_sha256")
