"""Near-duplicate documents by SetSketch registers.

A document is the set of its ``k``-word shingles (words between ASCII blanks,
A-Z as a-z).  Documents whose sets have a Jaccard similarity of at least
``percent`` / 100 are linked; a component of linked documents is a group.

1. *Sketch.*  Each of ``rows * bands`` registers is the least of one hash over
   the set, as an exponential variable, rounded to a power of ``BASE`` and
   truncated to a byte.  Sketches merge by maximum; two sets agree in a
   register with a probability slightly above their similarity.
2. *Classes.*  Equal sets (by a 128-bit fingerprint) form a class; only classes
   are compared, so copies never meet in pairs.
3. *Bands.*  ``rows`` registers make a band.  With 6 rows and 42 bands a pair at
   0.8 shares no band with probability 3e-6.  Classes that share a band are
   candidates.
4. *Estimate, then verify.*  For a candidate pair the likelihood of the
   similarity, given how many registers are greater, less and equal and the two
   set sizes, is maximised; pairs five standard errors below the threshold go.
   The rest is confirmed on the full sets of both whole texts.

A bucket of thousands of classes isn't expanded into pairs.  Every member is
first compared with two members of the bucket, drawn by hash; first of all with
the most similar of those it meets.  Components of the confirmed links are
formed.  What then still lies in *different* components of one bucket, the
strays of large groups, is paired by the rarest shingles of a set (a prefix
filter) and compared on full sets.  No link is left out: a pair of one bucket is
compared, can't reach the threshold or is already in one component.

Links, components and fingerprints stay in tables.

Edge cases: texts that are null or without words have no shingles, are linked
with nothing and are kept; with fewer than ``k`` words the whole sequence is
the only shingle; rows that share a doc_id are compared each by its own text;
null doc_ids count after all others (a group of nothing but null ids has a null
component_id); equal rows fall into one class; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytescan as bs
from quillspark.llm.components import connected_components
from quillspark.scratch import materialize, semi_join

BASE = 1.1
RATE = 20.0
_rng = np.random.Generator(np.random.PCG64(99))
_MUL = _rng.integers(0, 2**32, 4096, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, 4096, dtype=np.uint32)
_CHUNK = 1 << 16
MOST = 100_000  # keys of a semi-join that are broadcast, which takes driver memory; more are shuffled


def shingle_sets(s: bs.TextSlice, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice."""
    w = bs.words(s, bs.NON_BLANK)
    h = bs.word_hashes(s.buf, w)
    grams = bs.gram_hashes(h, k)
    lo, hi = bs.gram_rows(w, k)
    out = []
    for a, b, e in zip(lo.tolist(), hi.tolist(), w.first[1:].tolist()):
        if b > a:
            out.append(np.unique(grams[a:b]))
        elif e > a:
            out.append(np.array([bs.sequence_hash(h[a:e])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(minima: np.ndarray) -> np.ndarray:
    """Least 32-bit hashes as truncated powers of ``BASE``."""
    x = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def sketch(sets: list[np.ndarray], m: int) -> np.ndarray:
    """[set, register] for non-empty sets."""
    out = np.empty((len(sets), m), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= _CHUNK):
            n += len(sets[j])
            j += 1
        h = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets[i : j - 1]])]).astype(np.int64)
        x = np.empty_like(h)
        for r in range(m):
            np.multiply(h, _MUL[r], out=x)
            np.add(x, _ADD[r], out=x)
            out[i:j, r] = np.minimum.reduceat(x, at)
        i = j
    return registers(out)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 100) -> np.ndarray:
    """The likeliest similarity of each pair of sketches, given both set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, steps + 1)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u - v * j), p(v - u * j)
    rest = np.maximum(1 - above - below, 1e-12)
    fit = more * np.log(np.maximum(above, 1e-12)) + less * np.log(np.maximum(below, 1e-12)) + same * np.log(rest)
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def sketch_table(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, tk, n, cls, sketch): one row for each document; ``tk`` hashes its text, ``cls`` its set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bs.slices(batch.column(2)):
                sets = shingle_sets(s, k)
                full = [x for x in sets if len(x)]
                made = iter(sketch(full, m)) if full else iter(())
                cls, rows = [], []
                for x in sets:
                    if len(x):
                        with np.errstate(over="ignore"):
                            twice = (np.bitwise_xor.reduce(bs.fmix64(x + np.uint64(1))), (bs.fmix64(x ^ np.uint64(0xABCDEF))).sum(dtype=np.uint64))
                        cls.append(np.array(twice, np.uint64).tobytes())
                        rows.append(next(made).tobytes())
                    else:
                        cls.append(None)
                        rows.append(None)
                columns = [batch.column(0).slice(s.lo, len(s)), batch.column(1).slice(s.lo, len(s)), pa.array([len(x) for x in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "n", "cls", "sketch"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, tk long, n long, cls binary, sketch binary")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int, least: float) -> DataFrame:
    """(a, b, est): the pairs whose sizes allow the threshold and whose estimate reaches ``least``."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.join(side("a"), "a")
    other = side("b").withColumnRenamed("b", "b_")
    fits = (F.col("b") == F.col("b_")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    sized = sized.join(other, fits).select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (4, 5))
                est = joint_estimate(a, b, part.column(2).to_numpy().astype(float), part.column(3).to_numpy().astype(float))
                ok = pa.array(est >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok), pa.array(est).filter(ok)], names=["a", "b", "est"])

    return sized.mapInArrow(judge, "a long, b long, est double")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): the pairs whose full sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    texts = semi_join(texts, ends, ["cid"], MOST)
    both = pairs.select("a", "b").join(texts.select(F.col("cid").alias("a"), F.col("text").alias("t_a")), "a")
    both = both.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("t_b")), "b").select("a", "b", "t_a", "t_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def set_of(cid: int, s: bs.TextSlice, i: int) -> np.ndarray:
            if cid not in held:
                if len(held) >= 256:
                    held.pop(next(iter(held)))
                one = bs.TextSlice(s.buf[s.offs[i] : s.offs[i + 1]], s.offs[i : i + 2] - s.offs[i], 0)
                held[cid] = shingle_sets(one, k)[0]
            return held[cid]

        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            whole = [bs.TextSlice(*bs.text_buffers(batch.column(i)), 0) for i in (2, 3)]
            ok = []
            for i, (a, b) in enumerate(zip(*ids)):
                x, y = set_of(a, whole[0], i), set_of(b, whole[1], i)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(inter * 100 >= (len(x) + len(y) - inter) * percent)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(confirm, "a long, b long")


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components; a class without links is its own."""
    for x in ("a", "b"):
        pairs = pairs.join(components.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
        pairs = pairs.withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
    return pairs.where("c_a != c_b").select("a", "b", *[c for c in pairs.columns if c == "est"])


def shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """(cid, h): a row for each distinct shingle of each text (cid, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bs.slices(batch.column(1)):
                sets = shingle_sets(s, k)
                cids = np.repeat(batch.column(0).slice(s.lo, len(s)).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(np.concatenate(sets).view(np.int64))], names=["cid", "h"])

    return texts.select("cid", "text").mapInArrow(scan, "cid long, h long")


def stray_links(placed: DataFrame, groups: DataFrame, texts: DataFrame, k: int, percent: int, strays: int = 100, others: int = 400) -> DataFrame:
    """(a, b): links between different components ``c`` of one group.

    ``placed`` has (cid, c), ``groups`` (node, component): classes that shared a
    bucket, by way of its drawn members.  Those outside the largest component
    of their group are its strays.  With the shingles of a group ordered from the
    rarest on, two sets that reach the threshold share one of the first
    ``n - ceil(n * percent / 100) + 1`` of each, and from there on both have as many
    left as they must share.  Strays meet only what shares such a shingle, so work grows with these
    matches, not with strays times classes.  The holders of a frequent one meet in
    blocks of some ``strays`` and ``others`` rows.
    """
    rows = placed.join(groups.select(F.col("node").alias("cid"), F.col("component").alias("g")), "cid")
    sizes = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("m"), F.sum("n").alias("n"))
    rows = materialize(rows.join(main.where("n > m").select("g", "main"), "g").select("g", "cid", "c", (F.col("c") != F.col("main")).alias("stray")), "strays")
    grams = shingle_rows(semi_join(texts, rows.select("cid"), ["cid"], MOST), k).join(rows, "cid")
    grams = materialize(grams, "grams")
    shared = grams.groupBy("g", "h").agg(F.count(F.lit(1)).alias("df"))
    sets = grams.join(shared, ["g", "h"]).groupBy("g", "cid", "c", "stray").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))
    n = F.size("hs")
    first = F.slice("hs", F.lit(1), n - F.floor((n * percent + 99) / 100).cast("int") + 1)
    heads = sets.select("g", "cid", "c", "stray", n.alias("n"), F.posexplode(first).alias("at", "x")).where("x.df > 1")
    heads = materialize(heads.select("g", "cid", "c", "stray", "n", (F.col("n") - F.col("at")).alias("left"), F.col("x.h").alias("h")), "heads")
    met = heads.groupBy("g", "h").agg(F.count_if("stray").alias("s"), F.count(F.lit(1)).alias("m")).where("s > 0 and m > 1")
    heads = heads.join(met.select("g", "h", F.ceil(F.col("s") / strays).alias("n_i"), F.ceil(F.col("m") / others).alias("n_j")), ["g", "h"])
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("cid", "c", "n", "left")]
    asking = heads.where("stray").select("g", "h", own("n_i").alias("i"), every("n_j").alias("j"), *side("a"))
    asked = heads.select("g", "h", every("n_i").alias("i"), own("n_j").alias("j"), *side("b"))
    sized = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    room = F.least("a_left", "b_left") * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent
    met = asking.join(asked, ["g", "h", "i", "j"]).where((F.col("a_c") != F.col("b_c")) & sized & room)
    pairs = met.select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).distinct()
    return verified(materialize(pairs, "pairs"), texts, k, percent)


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    return components if links.isEmpty() else connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def class_components(docs: DataFrame, classes: DataFrame, k: int, percent: int, rows: int, bands: int, strays: int, others: int) -> DataFrame:
    """(node, component) over class ids, for classes with at least one link."""
    m = rows * bands
    cut = percent / 100 - 5 * (0.16 / m) ** 0.5
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(j, F.substring(F.col("sketch"), j * rows + 1, F.lit(rows)))))
    in_band = classes.select("cid", "n", band.alias("band"))
    # Two members of each bucket, drawn by the hash of the class alone, so that buckets of one group share them.
    draw = F.struct(F.xxhash64("cid").alias("h"), "cid")
    ends = in_band.groupBy("band").agg(F.min(draw).alias("p"), F.max(draw).alias("q")).select("band", F.col("p.cid").alias("p"), F.col("q.cid").alias("q")).where("p != q")
    members = materialize(in_band.join(ends, "band"), "members")

    wanted = semi_join(classes.select("cid", "doc", "tk"), members.select("cid"), ["cid"], MOST).select("cid", F.col("doc").alias("d"), F.col("tk").alias("t"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text"))
    source = semi_join(source, wanted.select(F.col("d").alias("doc_id"), F.col("t").alias("tk")), ["doc_id", "tk"], MOST)
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")))
    texts = materialize(texts.groupBy("cid").agg(F.min("text").alias("text")), "texts")

    stars = members.select("cid", F.explode(F.array("p", "q")).alias("end")).where("cid != end")
    stars = materialize(stars.select(F.least("cid", "end").alias("a"), F.greatest("cid", "end").alias("b")).distinct(), "stars")
    scored = materialize(estimated(stars, classes, percent, cut), "scored")
    near = scored.select("a", "b", "est").unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "est"))
    best = near.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(verified(best, texts, k, percent), "links")
    components = connected_components(links)

    rest = materialize(_apart(scored.select("a", "b").join(best, ["a", "b"], "left_anti"), components), "rest")
    if not rest.isEmpty():
        components = _joined(components, materialize(verified(rest, texts, k, percent), "links"))

    # What is still apart in a bucket, without the two classes that all were compared with.
    named = members.join(components.select(F.col("node").alias("cid"), "component"), "cid", "left").select("band", "cid", "n", "p", "q", F.coalesce("component", "cid").alias("c"))
    open_ = named.where("cid != p and cid != q")
    mixed = open_.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
    named = materialize(named.join(mixed, "band"), "mixed")
    placed = named.where("cid != p and cid != q").select("cid", "c").distinct()
    if named.isEmpty():
        return components
    # one link for each class, and those between the drawn members of its buckets
    hubs = named.groupBy("cid").agg(F.min("p").alias("hub"), F.collect_set("p").alias("ps"))
    joined = hubs.select(F.explode("ps").alias("a"), F.col("hub").alias("b")).where("a != b").distinct()
    groups = connected_components(hubs.select(F.col("cid").alias("a"), F.col("hub").alias("b")).unionByName(joined))
    found = materialize(stray_links(placed, groups, texts, k, percent, strays, others), "strays")
    return _joined(components, found)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 6, bands: int = 42, strays: int = 100, others: int = 400) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, and ``tk``, ``stays``.

    ``tk`` is the hash of the text; ``stays`` marks the rows with the text that
    represents the group, ``kept`` those whose doc_id is its least.  ``strays`` and
    ``others`` size the blocks of ``stray_links``.
    """
    rows_of = materialize(sketch_table(docs, k, rows * bands), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tk")
    classes = rows_of.where("cls is not null").groupBy("cls").agg(F.min(order).alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "cls", "n", F.col("rep.doc_id").alias("doc"), F.col("rep.tk").alias("tk"), "sketch"), "classes")
    components = class_components(docs, classes, k, percent, rows, bands, strays, others)

    named = classes.select("cid", "cls", "doc", "tk").join(components.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("cls", F.struct(F.col("doc").isNull().alias("null"), F.col("doc").alias("doc_id"), "tk").alias("own"), "component")
    least = named.where("component is not null").groupBy("component").agg(F.min("own").alias("rep"))
    named = named.join(least, "component", "left").select(F.col("cls").alias("of"), F.coalesce("rep", "own").alias("rep"))
    out = rows_of.select("doc_id", "tk", "n", "cls").join(named, F.col("cls") == F.col("of"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id"))
    stays = F.col("cls").isNull() | (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("tk") == F.col("rep.tk")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tk", stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 6, bands: int = 42) -> DataFrame:
    """``docs`` with one row of each group, all columns kept; rows without shingles stay, repeated or not."""
    judged = materialize(near_duplicates(docs, k, percent, rows, bands), "judged")
    go = judged.where("not stays").select(F.col("doc_id").alias("d"), F.col("tk").alias("t")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"))
    left = keyed.join(go, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")), "left_anti")
    # rows that repeat in id and text: one of each stays; usually there are none, and nothing is shuffled
    again = judged.where("stays and n_shingles > 0").groupBy("doc_id", "tk").count().where("count > 1").select(F.col("doc_id").alias("d"), F.col("tk").alias("t"))
    if not again.isEmpty():
        again = materialize(again, "again")
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t"))
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "tk"]))
    return left.select("row.*")
