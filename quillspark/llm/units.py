"""Substring deduplication by hashing lines and the sentences in them.

A unit is a sentence: it ends with its line, or after ``.``, ``!`` or ``?``
before a blank.  Units are normalised (A-Z as a-z, runs of ASCII blanks as one)
and digested to 128 bits.  Equal digests are grouped over the whole corpus; the
occurrence with the least (doc_id, number in its document) is kept, all others
are removed.  Neighbouring removed units of a document form a passage, whose
number of words tells common phrases from copied text; ``min_words`` spares
shorter passages and is off by default.

Only digests and positions are shuffled: first as one minimum for each digest
and task, then in an equi-join with the table of repeated digests, which has one
row for each, so that Spark can split a digest that a third of all documents
share, then by document.

Offsets are code points of the original text, end exclusive.

Edge cases: null and empty texts and blank lines have no units; rows that share
a doc_id are documents of their own, in the order of their texts' hashes, and
equal rows remove each other's units, too; null doc_ids rank last; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.llm import bytescan as bs
from quillspark.scratch import scratch_path

#: ``row`` numbers the documents; a line of ``unit_no`` -1 tells how many units a document has, in ``n_words``.
UNITS = "doc_id long, row long, tk long, unit_no int, start int, end int, n_words int, h1 long, h2 long"
_FILE = pa.schema([(c, pa.int64() if c in ("doc_id", "row", "tk", "h1", "h2") else pa.int32()) for c in ("doc_id", "row", "tk", "unit_no", "start", "end", "n_words", "h1", "h2")])
_Q = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _sequence_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: int) -> np.ndarray:
    """A hash of each range of the hashes ``h``, by differences of prefix sums."""
    n = len(h)
    power, inverse = np.full(n + 1, q, np.uint64), np.full(n + 1, pow(q, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
    return bs.fmix64((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def units_of(s: bs.TextSlice) -> tuple[np.ndarray, ...]:
    """row, number, start, end, n_words, h1, h2 of all units of a slice."""
    w = bs.words(s, bs.NON_BLANK)
    n = len(w.start)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    h = bs.word_hashes(s.buf, w)
    row = np.repeat(np.arange(len(s)), w.counts)
    # a word opens a unit if it is the row's first, if a line ends before it, or after a full stop and a blank
    lines = np.concatenate([[0], np.cumsum(s.buf == 10)])
    opens = np.ones(n, bool)
    stop = np.isin(s.buf[w.end - 1], np.frombuffer(b".!?", np.uint8))
    opens[1:] = (row[1:] != row[:-1]) | (lines[w.start[1:]] != lines[w.end[:-1]]) | stop[:-1]
    lo = np.flatnonzero(opens)
    hi = np.concatenate([lo[1:], [n]])
    points = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])
    base = points[s.offs[row[lo]]]
    number = np.arange(len(lo)) - np.searchsorted(row[lo], row[lo], "left")
    return row[lo], number, points[w.start[lo]] - base, points[w.end[hi - 1]] - base, hi - lo, _sequence_hashes(h, lo, hi, _Q[0]), _sequence_hashes(h ^ np.uint64(0x5555), lo, hi, _Q[1])


def _unit_scan():
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "tk", "unit_no", "start", "end", "n_words", "h1", "h2"]
        for batch in batches:
            for s in bs.slices(batch.column(3), 1 << 20):
                row, number, start, end, n, h1, h2 = units_of(s)
                at = pa.array(row + s.lo)
                columns = [*[batch.column(i).take(at) for i in range(3)], *[pa.array(x.astype(np.int32)) for x in (number, start, end, n)], *[pa.array(x.view(np.int64)) for x in (h1, h2)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                none = [pa.nulls(len(s), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]
                total = pa.array(np.bincount(row, minlength=len(s)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(s.lo, len(s)) for i in range(3)], pa.array(np.full(len(s), -1, np.int32)), *none[:2], total, *none[2:]], names=names)

    return scan


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text"))


def unit_table(docs: DataFrame) -> DataFrame:
    """All units of all documents, with their digests, and a line for each document."""
    return _narrow(docs).mapInArrow(_unit_scan(), UNITS)


#: Bits of a packed rank that number the units of a document.
_UNIT_BITS = 24


def stored_units(docs: DataFrame) -> DataFrame:
    """``unit_table``, written by the tasks themselves to the shared folder, a file for each.

    Rows needn't pass through the JVM for that.  Only files that a task has
    closed and reported are read, so what a lost or repeated task leaves behind
    is never seen.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "units")
    uri = root if "://" in root or root.startswith("file:") else f"file://{root}"
    scan = _unit_scan()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        name, out, held = f"units-{uuid.uuid4().hex}.parquet", None, []

        def flush() -> None:
            nonlocal out
            table = pa.Table.from_batches(held).cast(_FILE)
            if out is None:
                store.create_dir(base, recursive=True)
                out = pq.ParquetWriter(f"{base}/{name}", _FILE, filesystem=store)
            out.write_table(table)
            held.clear()

        for batch in scan(batches):
            held.append(batch)
            if sum(b.num_rows for b in held) >= 200_000:
                flush()
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    names = sorted(r.name for r in _narrow(docs).mapInArrow(write, "name string").collect())  # one for each task
    return spark.read.schema(UNITS).parquet(*[f"{uri}/{n}" for n in names]) if names else spark.createDataFrame([], UNITS)


def _packs(units: DataFrame) -> bool:
    """Whether (doc_id, unit_no) fits one number and tells all units apart: ids are unique, not null, and small enough."""
    docs = units.where("unit_no = -1").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("n_words").alias("units")).first()
    return bool(docs.n) and docs.ids == docs.n and docs.lo >= 0 and docs.hi < 1 << (62 - _UNIT_BITS) and docs.units < 1 << _UNIT_BITS


def _again(units: DataFrame) -> DataFrame:
    """The units that aren't the first of their digest, with the one that is.

    The rank of a unit is (doc_id, text hash, row, unit_no), nulls last.  Where
    (doc_id, unit_no) is as good and fits one number, the minimum of that is
    taken instead, which Spark aggregates by hash, without objects.
    """
    every = ["doc_id", "row", "unit_no", "start", "end", "n_words"]
    packed = _packs(units)
    units = units.where("unit_no >= 0")
    if packed:
        rank = F.shiftleft("doc_id", _UNIT_BITS) + F.col("unit_no")
        kept = [F.shiftright("kept", _UNIT_BITS).alias("kept_doc_id"), F.col("kept").bitwiseAND(F.lit((1 << _UNIT_BITS) - 1)).cast("int").alias("kept_unit_no")]
    else:
        rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tk", "row", "unit_no")
        kept = [F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.unit_no").alias("kept_unit_no")]
    first = units.groupBy("h1", "h2").agg(F.min(rank).alias("kept"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    # dealt anew, so that the join has exchanges of its own on both sides, and Spark may split a frequent digest
    again = units.join(first.repartition("kept"), ["h1", "h2"]).where(rank > F.col("kept"))
    return again.select(*every, *kept)


def repeated_units(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """One row for each removed unit.

    Columns: doc_id, unit_no, start, end, n_words, kept_doc_id, kept_unit_no, passage_words.
    """
    again = _again(stored_units(docs))
    again = again.withColumn("island", F.col("unit_no") - F.row_number().over(W.partitionBy("row").orderBy("unit_no")))
    again = again.withColumn("passage_words", F.sum("n_words").over(W.partitionBy("row", "island")).cast("int"))
    return again.where(F.col("passage_words") >= min_words).drop("row", "island")


def _document_rows(min_words: int):
    """Batches of documents' lines, sorted by row and unit: the first line of each tells its units, the others are removed ones."""
    names = ["doc_id", "n_units", "n_removed", "removed_words", "longest_passage", "spans"]

    def told(t: pa.Table) -> pa.RecordBatch:
        row, unit, n_words = (t[c].to_numpy() for c in ("row", "unit_no", "n_words"))
        heads = np.flatnonzero(unit < 0)
        own = np.flatnonzero(unit >= 0)
        doc = np.searchsorted(heads, own, "right") - 1
        n, removed, longest = (np.zeros(len(heads), np.int64) for _ in range(3))
        spans = [""] * len(heads)
        if len(own):
            apart = np.concatenate([[True], (row[own][1:] != row[own][:-1]) | (unit[own][1:] != unit[own][:-1] + 1)])
            sums = np.add.reduceat(n_words[own].astype(np.int64), np.flatnonzero(apart))[np.cumsum(apart) - 1]
            keep = sums >= min_words
            own, doc, sums = own[keep], doc[keep], sums[keep]
            n = np.bincount(doc, minlength=len(heads))
            removed = np.bincount(doc, n_words[own], len(heads)).astype(np.int64)
            np.maximum.at(longest, doc, sums)
            part = t.take(pa.array(own))
            lines = [f"{a}:{b}:{'null' if c is None else c}:{d}" for a, b, c, d in zip(*(part[c].to_pylist() for c in ("start", "end", "kept_doc_id", "kept_unit_no")))]
            cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
            spans = [",".join(lines[a:b]) for a, b in zip(cuts, cuts[1:])]
        columns = [t["doc_id"].take(pa.array(heads)).combine_chunks(), *[pa.array(x.astype(np.int64)) for x in (n_words[heads], n, removed, longest)], pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # a document may go on in the next batch
            heads = np.flatnonzero(batch["unit_no"].to_numpy() < 0)
            if len(heads) and held and (sum(b.num_rows for b in held) + int(heads[-1])) >= 10_000:
                yield told(pa.Table.from_batches([*held, batch.slice(0, int(heads[-1]))]))
                held = []
                batch = batch.slice(int(heads[-1]))
            held.append(batch)
        if held and sum(b.num_rows for b in held):
            yield told(pa.Table.from_batches(held))

    return gather


def document_repeats(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """One row for each document.

    Columns: doc_id, n_units, n_removed, removed_words, longest_passage (in
    words), spans (``start:end:kept_doc_id:kept_unit_no`` of the removed units, by
    place, joined by commas).  Documents are put together from sorted lines, one
    after another.
    """
    units = stored_units(docs)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kept_doc_id", "long"), ("kept_unit_no", "int"))]
    lines = units.where("unit_no = -1").select("doc_id", "row", "unit_no", "start", "end", "n_words", *none).unionByName(_again(units))
    lines = lines.repartition("row").sortWithinPartitions("row", "unit_no")
    return lines.mapInArrow(_document_rows(min_words), "doc_id long, n_units long, n_removed long, removed_words long, longest_passage long, spans string")


UNITS_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?])([\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(1) || chr(10)), chr(1)) AS p FROM documents),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM cut),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM pieces),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit_no, off + length(piece) - length(regexp_replace(piece, '^[\x20\x09-\x0D]+', '')) AS a,
  off + length(regexp_replace(piece, '[\x20\x09-\x0D]+$', '')) AS b, len(w) AS n, w FROM placed WHERE len(w) > 0),
again AS (SELECT * FROM (SELECT *, min((doc_id, unit_no)) OVER (PARTITION BY w) AS kept FROM units) WHERE (doc_id, unit_no) > kept),
islands AS (SELECT *, unit_no - row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS g FROM again),
passages AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, g) AS total FROM islands),
told AS (SELECT doc_id, count(*) AS n_removed, sum(n) AS words, max(total) AS longest, string_agg(a || ':' || b || ':' || kept[1] || ':' || kept[2], ',' ORDER BY unit_no) AS spans FROM passages GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM units GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(words, 0) AS BIGINT) AS removed_words, CAST(coalesce(longest, 0) AS BIGINT) AS longest_passage, coalesce(spans, '') AS spans
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN told USING (doc_id)
"""
