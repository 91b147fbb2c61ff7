"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

A byte of a document goes if a string of ``length`` bytes that covers it also
starts anywhere else, in another document or in the same.

*Sparse suffixes.*  Of the ``length - k + 1`` starts of ``k``-byte strings in a
window of ``length`` bytes, the one with the least hash (the first of equals) is
the window's *anchor*.  Equal windows have their anchor at the same place, so
it suffices to index the suffixes that start at anchors, about one in 150
bytes; all suffixes would take many times the disk of the input.  Neighbouring
windows with one anchor form a *run*.  An entry of a suffix array is the suffix at
a run's anchor: its first 24 bytes (``k`` if fewer), by which it is ordered, then fingerprints
of its first ``k`` bytes and of the whole stretch that the run's windows cover, and
how often that stretch occurs.  Suffixes are compared without the text: two with
equal bytes and fingerprint have a common prefix of ``k`` bytes at least.

*Levels.*  Documents come in batches.  Each batch gets its own array, sorted over
all tasks by ranges of suffixes.  It is merge-scanned against all existing
levels: all are dealt by ranges and sorted together, which shuffles the stored entries for each
batch, neighbours are compared, and intervals with a
common prefix of ``k`` bytes that hold a new suffix and another one are reported.
The same pass writes the merge of levels of equal rank, two of rank r giving one
of rank r + 1, so that n batches leave about log2(n) levels and each entry is
rewritten as many times.  Levels, reports and runs are tables of a folder with a
manifest, so that a family can be opened again and extended by a batch.

*Verdict.*  A stretch that occurs twice repeats all its windows.  A suffix that
shares ``k`` bytes with no other repeats none.  What is left, runs that occur once
but share their anchor with others (the edges of shared passages), is judged
window by window: the windows of one occurrence of each stretch under such a
fingerprint are hashed and counted.  Up to ``few`` stretches of one fingerprint
meet in a task, which bounds its memory; windows under more frequent ones are
counted by their hashes over all tasks.

Edge cases: null texts are empty; texts shorter than ``length`` keep all;
equal rows are occurrences of their own and remove each other; extra columns
are ignored; rows that share a doc_id are told apart by a hash of their text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bytescan as bs
from quillspark.scratch import materialize, read_or_none, scratch_path, semi_join

_STEP = 1 << 20


class Runs:
    """The runs of one text: anchors, first and last window start, and their hashes."""

    def __init__(self, text: np.ndarray, length: int, k: int) -> None:
        self.length = length
        parts = [self._part(text[a : a + _STEP + length - 1], length, k, a) for a in range(0, max(0, len(text) - length + 1), _STEP)]
        cat = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
        self.first, self.last, self.key, self.stretch = cat(0, np.int64), cat(1, np.int64), cat(2, np.uint64), cat(3, np.uint64)
        self.p1, self.p2, self.p3 = (cat(i, np.int64) for i in (4, 5, 6))

    @staticmethod
    def _sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = bs._tables(len(text) + 1)
        sums = np.empty(len(text) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(bs._BYTE[text] * power[: len(text)], out=sums[1:])
        return sums, inverse

    @classmethod
    def _part(cls, text: np.ndarray, length: int, k: int, base: int) -> tuple[np.ndarray, ...]:
        n, w = len(text), length - k + 1
        sums, inverse = cls._sums(text)
        grams = bs.fmix64((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
        keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        padded = np.full(-(-len(keyed) // w) * w, np.uint64(2**64 - 1))
        padded[: len(keyed)] = keyed
        grid = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        windows = n - length + 1
        anchor = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:] - 1, [windows - 1]])
        at = anchor[first]
        whole = (sums[last + length] - sums[first]) * inverse[first]
        shape = (at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
        # the first bytes of the suffix, k at most, as three numbers in the same order
        head = np.zeros((len(at), 24), np.uint8)
        head[:, : min(k, 24)] = text[at[:, None] + np.arange(min(k, 24))]
        head = head.view(">u8").astype(np.uint64)
        head = (head ^ np.uint64(1 << 63)).view(np.int64)
        return first + base, last + base, grams[at], bs.fmix64(whole + shape * np.uint64(0x9E3779B97F4A7C15)), head[:, 0], head[:, 1], head[:, 2]


def window_hashes(text: np.ndarray, first: int, last: int, length: int) -> np.ndarray:
    """A hash of each window of a run."""
    part = text[first : last + length]
    sums, inverse = Runs._sums(part)
    n = last - first + 1
    return bs.fmix64((sums[length : length + n] - sums[:n]) * inverse[:n])


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, tk, text): a key of each row's id and text without nulls."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1))
    return docs.select(doc_id.alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_RUN = "d long, tk long, first long, last long, key long, stretch long, p1 long, p2 long, p3 long"
#: The order of suffixes, and what tells two apart.
ORDER = ["p1", "p2", "p3", "key", "stretch"]
_ENTRY = ", ".join(f"{c} long" for c in ORDER)


def run_table(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(d, tk, first, last, key, stretch, p1, p2, p3): the runs of all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["first", "last", "key", "stretch", "p1", "p2", "p3"]
        for batch in batches:
            d, tk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in bs.slices(batch.column(2)):
                runs = [Runs(s.buf[s.offs[i] : s.offs[i + 1]], length, k) for i in range(len(s))]
                n = [len(r.first) for r in runs]
                columns = [np.repeat(d[s.lo : s.lo + len(s)], n), np.repeat(tk[s.lo : s.lo + len(s)], n)]
                columns += [np.concatenate([getattr(r, x) for r in runs]).view(np.int64) for x in names]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "tk", *names])

    return _keyed(docs).where(F.octet_length("text") >= length).mapInArrow(scan, _RUN)


_SCANNED = "role string, p1 long, p2 long, p3 long, key long, stretch long, n long, fresh boolean"


def _merge_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the sorted runs of a range of suffixes: (p1, p2, p3, key, stretch, n, fresh, moves).

    Yields equal entries that move to another level added up (role ``entry``),
    and for intervals with a common prefix of ``k`` bytes, their fingerprint and how many
    suffixes they hold: ``met`` if a fresh one has another beside it, ``edge`` if
    the interval touches an end of the range and may go on in the next one.
    """

    def pack(role: str, rows: list[np.ndarray], n: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), role)), *[pa.array(x) for x in rows], pa.array(n), pa.array(fresh)], names=["role", *ORDER, "n", "fresh"])

    def judged(rows: list[np.ndarray], n: np.ndarray, fresh: np.ndarray, moves: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        near = np.logical_and.reduce([x[1:] == x[:-1] for x in rows[:4]])  # common prefix of k bytes with the one before
        starts = np.flatnonzero(np.concatenate([[True], ~near]))
        total, new = np.add.reduceat(n, starts), np.maximum.reduceat(fresh, starts)
        told = (total > 1) & new
        side = np.zeros(len(starts), bool)
        side[0], side[-1] = first, side[-1] | last
        for role, pick in (("met", told & ~side), ("edge", side)):
            if pick.any():
                yield pack(role, [x[starts][pick] for x in rows], total[pick], new[pick])
        if moves.any():
            own = [x[moves] for x in rows]
            cuts = np.flatnonzero(np.concatenate([[True], ~np.logical_and.reduce([x[1:] == x[:-1] for x in own])]))
            yield pack("entry", [x[cuts] for x in own], np.add.reduceat(n[moves], cuts), np.zeros(len(cuts), bool))

    held: list[np.ndarray] | None = None
    first = True
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
        if len(held[0]) < 100_000:
            continue
        # the last interval may go on in the next batch
        change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in held[:4]]))
        if len(change):
            cut = int(change[-1]) + 1
            yield from judged([x[:cut] for x in held[:5]], *[x[:cut] for x in held[5:]], first, False)
            held, first = [x[cut:] for x in held], False
    if held is not None and len(held[0]):
        yield from judged(held[:5], *held[5:], first, True)


class SuffixIndexFamily:
    """Levels of sparse suffix arrays in a folder, each a table (p1, p2, p3, key, stretch, n) sorted over ranges of suffixes."""

    def __init__(self, spark: SparkSession, root: str | None = None, length: int = 400, k: int = 100) -> None:
        """Opens the family that ``root`` holds, or starts one there (by default in the scratch folder)."""
        self.spark, self.root, self.length, self.k = spark, root or scratch_path(spark, "family"), length, k
        rows = read_or_none(spark, f"{self.root}/manifest")
        last = [] if rows is None else rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()  # a row for each table
        if last and (last[0].length, last[0].k) != (length, k):
            raise ValueError("the family was made with other lengths")
        self.version = last[0].version if last else 0
        self.tables = [(r.role, r.rank, r.path) for r in last]

    @property
    def levels(self) -> list[tuple[int, DataFrame]]:
        """Rank and table of each level, the oldest first."""
        return [(rank, self.spark.read.parquet(p)) for role, rank, p in self.tables if role == "level"]

    def _write(self, df: DataFrame, tag: str) -> str:
        path = f"{self.root}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def add(self, docs: DataFrame, batches: int = 1) -> None:
        """Index documents, as one batch or as several that are told apart by a hash.

        The manifest is written after each batch; what a failed call leaves behind isn't seen.
        """
        folder = f"{self.root}/runs-{uuid.uuid4().hex}"
        batch = F.pmod(F.xxhash64("d", "tk"), F.lit(batches))
        run_table(docs, self.length, self.k).withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
        for b in sorted(r.batch for r in self.spark.read.schema(f"{_RUN}, batch int").parquet(folder).select("batch").distinct().collect()):
            self._add(f"{folder}/batch={b}")

    def _add(self, runs: str) -> None:
        """A batch's array, its merge-scan with all levels, and the merges."""
        array = self.spark.read.parquet(runs).groupBy(*ORDER).agg(F.count(F.lit(1)).alias("n"))
        ranks = [rank for role, rank, _ in self.tables if role == "level"]
        rank = 0
        while ranks and ranks[-1] == rank:  # the new array takes up all levels of the carry
            ranks.pop()
            rank += 1
        levels = [t for t in self.tables if t[0] == "level"]
        every = array.select(*ORDER, "n", F.lit(True).alias("fresh"), F.lit(True).alias("moves"))
        for i, (_, _, path) in enumerate(levels):
            every = every.unionByName(self.spark.read.parquet(path).select(*ORDER, "n", F.lit(False).alias("fresh"), F.lit(i >= len(ranks)).alias("moves")))
        merged = every.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_merge_scan, _SCANNED)
        scanned = self._write(merged, "scan")
        found = self.spark.read.parquet(scanned)
        level = self._write(found.where("role = 'entry'").select(*ORDER, "n"), "level")
        sides = found.where("role = 'edge'").groupBy("key").agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh")).where("n > 1 and fresh")
        met = self._write(found.where("role = 'met'").select("key").unionByName(sides.select("key")), "met")
        self.tables = [t for t in self.tables if t[0] != "level"] + levels[: len(ranks)] + [("level", rank, level), ("met", 0, met), ("runs", 0, runs)]
        self.version += 1
        rows = [(self.version, self.length, self.k, *t) for t in self.tables]
        manifest = self.spark.createDataFrame(rows, "version long, length int, k int, role string, rank int, path string")
        manifest.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _table(self, role: str, kinds: str) -> DataFrame:
        """All tables of a role as one; no rows before the first batch."""
        paths = [p for r, _, p in self.tables if r == role]
        return self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)

    def runs(self) -> DataFrame:
        """The runs of all documents added so far."""
        return self._table("runs", _RUN)

    def stretches(self) -> DataFrame:
        """(key, stretch, n, kinds, edge): the stretches under reported fingerprints, which may repeat.

        ``kinds`` counts the stretches of the fingerprint; ``edge`` says that one of them occurs once.
        """
        met, table = self._table("met", "key long"), self._table("level", f"{_ENTRY}, n long")
        counted = materialize(table.join(met.distinct(), "key", "left_semi").groupBy("key", "stretch").agg(F.sum("n").alias("n")), "counted")
        keys = counted.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), (F.min("n") == 1).alias("edge"))
        return counted.join(keys, "key")


def _edges(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The texts that hold representatives, each with their list."""
    wanted = materialize(reps.groupBy(F.col("rep.d").alias("d_"), F.col("rep.tk").alias("tk_")).agg(F.collect_list(F.struct("rep.first", "rep.last", "key", "n")).alias("at")), "edges")
    texts = semi_join(_keyed(docs), wanted.select(F.col("d_").alias("d"), F.col("tk_").alias("tk")), ["d", "tk"])
    joined = texts.join(wanted, (F.col("d") == F.col("d_")) & (F.col("tk") == F.col("tk_")))
    return joined.select("d", "tk", "text", "at")


def edge_spans(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(d, tk, first, last): repeated windows of the stretches that occur once, under keys of few kinds.

    The bytes of each stretch go to its key; the windows of one key are counted together.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bs.text_buffers(batch.column(2))
            rows = []
            for i, (d, tk, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                text = buf[offs[i] : offs[i + 1]]
                rows += [(x["key"], d, tk, x["first"], x["n"], text[x["first"] : x["last"] + length].tobytes()) for x in at]
            if rows:
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["key", "d", "tk", "first", "n", "bytes"])

    def judge(group: list[tuple]) -> list[tuple]:
        hashes = [window_hashes(np.frombuffer(g[5], np.uint8), 0, len(g[5]) - length, length) for g in group]
        values, counts = np.unique(np.concatenate(hashes), return_counts=True)
        twice = values[counts > 1]
        out = []
        for g, h in zip(group, hashes):
            if g[4] == 1 and len(twice):
                hit = np.concatenate([[0], np.isin(h, twice).astype(np.int8), [0]])
                turn = np.diff(hit)
                out += [(g[1], g[2], g[3] + int(a), g[3] + int(b) - 1) for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["d", "tk", "first", "last"])

        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if group and group[0][0] != row[0]:
                    out += judge(group)
                    group = []
                group.append(row)
            if out:
                yield pack(out)
        if group and (out := judge(group)):
            yield pack(out)

    pieces = _edges(docs, reps).mapInArrow(cut, "key long, d long, tk long, first long, n long, bytes binary")
    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "d long, tk long, first long, last long")


def window_spans(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """As ``edge_spans``, for keys of any number of kinds: windows are counted by their hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bs.text_buffers(batch.column(2))
            for i, (d, tk, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                text = buf[offs[i] : offs[i + 1]]
                for x in at:
                    h = window_hashes(text, x["first"], x["last"], length)
                    columns = [h.view(np.int64), np.full(len(h), d), np.full(len(h), tk), np.arange(x["first"], x["last"] + 1), np.full(len(h), x["n"])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "d", "tk", "first", "n"])

    windows = _edges(docs, reps).mapInArrow(cut, "h long, d long, tk long, first long, n long")
    twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    return windows.where("n = 1").join(twice, "h").select("d", "tk", "first", F.col("first").alias("last"))


def repeated_spans(family: SuffixIndexFamily, docs: DataFrame, few: int) -> DataFrame:
    """(d, tk, first, last): starts of windows that occur elsewhere, as inclusive ranges, for all ``docs`` of a family."""
    runs, length = family.runs(), family.length
    hits = materialize(runs.select("d", "tk", "first", "last", "key", "stretch").join(family.stretches().where("n > 1 or kinds > 1"), ["key", "stretch"]), "hits")
    spans = hits.where("n > 1").select("d", "tk", "first", "last")
    reps = hits.where("edge and kinds > 1").groupBy("key", "stretch").agg(F.min(F.struct("d", "tk", "first", "last")).alias("rep"), F.max("n").alias("n"), F.max("kinds").alias("kinds"))
    reps = materialize(reps, "reps")
    spans = spans.unionByName(materialize(edge_spans(docs, reps.where(F.col("kinds") <= few), length), "spans"))
    many = reps.where(F.col("kinds") > few)
    if not many.isEmpty():
        spans = spans.unionByName(materialize(window_spans(docs, many, length), "spans"))
    return spans


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 100, batches: int = 4, few: int = 20_000) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``spans``.

    ``spans`` lists the removed byte ranges of the original text, end exclusive.
    ``few`` is the most stretches that meet under one fingerprint: at 700 bytes
    and some 150 windows each, 14 MB of bytes and 24 MB of hashes in a task.
    """
    rows = docs.select("doc_id", "text")
    family = SuffixIndexFamily(docs.sparkSession, None, length, k)
    family.add(rows, batches)
    return removed(family, rows, few)


def removed(family: SuffixIndexFamily, docs: DataFrame, few: int = 20_000) -> DataFrame:
    """The result of ``remove_repeats`` for the documents of a family, ``docs`` being all of them."""
    rows, length = docs.select("doc_id", "text"), family.length
    whole = _keyed(rows).withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("sha", F.sha2("text", 256)).drop("text")
    ids = F.when(F.col("d") != -(2**63) + 1, F.col("d")).alias("doc_id")
    spans = repeated_spans(family, rows, few)
    lists = spans.groupBy("d", "tk").agg(F.collect_list(F.struct("first", "last")).alias("at"))

    def merge(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches_:
            cuts = []
            for at in batch.column(2).to_pylist():
                out: list[dict] = []
                for x in sorted((x["first"], x["last"] + length) for x in at):
                    if out and x[0] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], x[1])
                    else:
                        out.append({"start": x[0], "end": x[1]})
                cuts.append(out)
            removed = [sum(x["end"] - x["start"] for x in c) for c in cuts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, kind), pa.array(removed, pa.int64())], names=["d", "tk", "spans", "n_removed"])

    cuts = materialize(lists.mapInArrow(merge, "d long, tk long, spans array<struct<start:bigint,end:bigint>>, n_removed long"), "cuts")

    def keep(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            buf, offs = bs.text_buffers(batch.column(2))
            shas = []
            for i, at in enumerate(batch.column(3).to_pylist()):
                text, sha, start = memoryview(buf[offs[i] : offs[i + 1]]), hashlib.sha256(), 0
                for x in at:
                    sha.update(text[start : x["start"]])
                    start = x["end"]
                sha.update(text[start:])
                shas.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shas)], names=["d", "tk", "kept"])

    # Only texts of which something but not all goes are read again.
    told = whole.join(cuts, ["d", "tk"], "left")
    partial = told.where("n_removed is not null and n_removed < n_bytes").select(F.col("d").alias("d_"), F.col("tk").alias("tk_"), "spans").dropDuplicates(["d_", "tk_"])
    partial = materialize(partial, "partial")
    texts = semi_join(_keyed(rows), partial.select(F.col("d_").alias("d"), F.col("tk_").alias("tk")), ["d", "tk"])
    kept = texts.join(partial, (F.col("d") == F.col("d_")) & (F.col("tk") == F.col("tk_"))).select("d", "tk", "text", "spans").mapInArrow(keep, "d long, tk long, kept string")
    kept = materialize(kept, "kept").dropDuplicates(["d", "tk"])
    told = told.join(kept, ["d", "tk"], "left")
    sha = F.when(F.col("n_removed").isNull(), F.col("sha")).otherwise(F.coalesce("kept", F.lit(hashlib.sha256(b"").hexdigest())))
    return told.select(
        ids, "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"), sha.alias("kept_sha256"), "spans"
    )
