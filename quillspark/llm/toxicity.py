"""Toxicity by class-conditional Kneser-Ney models.

A model of toxic and one of ordinary documents each give a word its
probability after the word before it: discounted counts of the pair, backed
off to discounted continuation counts of the word, backed off to one *shared*
distribution.  A document's score is a calibrated function of the difference of
its two log-likelihoods divided by its number of words.

* Class counts come from a bounded sample, at most ``max_labelled`` rows of each
  label.  A pair counts the documents of the class it occurs in, so that one
  document cannot make it toxic; a word counts the different words before it in
  the class (a text's start is one of them).
* Discounts of counts of 1, 2 and more are estimated from the counts of counts
  of each class and level (Chen and Goodman), always below the count.  The pair
  level is always on.
* Words and pairs keep counts of their own, in both models, only where the
  documents of the two classes that hold them differ significantly (the G2
  statistic reaches ``least``).  What is pruned, rare expressions above all, is
  smoothed through the backoff: a pruned pair through its word, a pruned word
  through the shared counts, which are the same for both classes.  The mass of
  all pruned counts goes to the backoff, so that probabilities sum to 1.
* The shared backoff counts cover every document: for each word of the corpus,
  how many different words come before it, estimated by a HyperLogLog sketch of
  256 registers (some 6 %, without a ceiling).  The table of registers grows with
  the vocabulary; each task merges its registers before the only shuffle, so that
  a word sends 256 rows a task at most.  Only the words kept are looked up.
* ``least`` is chosen from ``levels``, by the best F1 on labelled rows that gave no
  counts; the cut with that F1 is put at a score of 0.3.

Rows whose crc32(doc_id) modulo 4 is 2 never give a label; of the rest, 3
calibrates and 0 and 1 give counts.  Counts are pruned before anything reaches
the driver, so that it and the tasks hold the words and pairs kept, at most those
of the sample.

Edge cases: an empty or null text scores as its prior; labels other than 0 and
1 and null ids are ignored; a doc_id with several labels is toxic if one says
so; without labels of both classes every score is 0.5 if there are none, else
the share of toxic ones; repeated rows are scored each; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytescan as bs
from quillspark.scratch import materialize

#: Low bits of a register's code: its number and its rank; the word's hash is above them.
REGISTER, RANK = 8, 6
#: Significance (G2) that words and pairs need to keep their counts; the best of these is taken.  The least keeps what a rare class alone has, once at least.
LEVELS = (3.0, 8.0, 12.0, 16.0, 24.0, 36.0)
#: Added to the number of words, so that a few words never make an extreme mean.
SHRINK = 30
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _hashes(s: bs.TextSlice) -> tuple[np.ndarray, np.ndarray, bs.Words]:
    """Hashes of the words of a slice and of the words before them (0 at a text's start), and the word bounds."""
    w = bs.words(s, bs.ALNUM)
    h = bs.word_hashes(s.buf, w)
    before = np.concatenate([np.zeros(1, np.uint64), h])[: len(h)]
    before[w.first[:-1][w.counts > 0]] = 0
    return h, before, w


def _pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return bs.fmix64(before * np.uint64(0x9E3779B97F4A7C15) ^ word)


def _word_key(h: np.ndarray) -> np.ndarray:
    """What the table of shared counts keeps of a word's hash: its upper 50 bits."""
    return (h >> np.uint64(REGISTER + RANK)).astype(np.int64)


def shared_counts(docs: DataFrame) -> DataFrame:
    """(word, kinds): how many different words come before each word (``_word_key``), over the whole corpus."""

    def registers(h: np.ndarray, before: np.ndarray) -> np.ndarray:
        x = bs.fmix64(before ^ np.uint64(0x9E3779B97F4A7C15))
        tail = x >> np.uint64(REGISTER)
        # the position of the lowest set bit; a tail of zeros ranks last
        low = tail & (~tail + np.uint64(1))
        rank = np.where(tail > 0, np.bitwise_count(low - np.uint64(1)) + 1, 64 - REGISTER).astype(np.uint64)
        key = h >> np.uint64(REGISTER + RANK) << np.uint64(REGISTER + RANK)
        return key | (x & np.uint64((1 << REGISTER) - 1)) << np.uint64(RANK) | rank

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        codes = np.sort(np.concatenate(parts))
        group = codes >> np.uint64(RANK)
        last = np.ones(len(codes), bool)
        last[:-1] = group[1:] != group[:-1]
        return codes[last]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, most = [], 0, 1 << 20
        for batch in batches:
            for s in bs.slices(batch.column(0)):
                h, before, _ = _hashes(s)
                inner = before != 0
                parts.append(merged([registers(h[inner], before[inner])]))
                waiting += len(parts[-1])
                if waiting > most:
                    parts = [merged(parts)]
                    waiting, most = len(parts[0]), max(1 << 20, 2 * len(parts[0]))
                if waiting > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0].view(np.int64))], names=["code"])
                    parts, waiting, most = [], 0, 1 << 20
        if parts:
            codes = merged(parts)
            for at in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 100_000].view(np.int64))], names=["code"])

    m = 1 << REGISTER
    word = F.shiftrightunsigned("code", REGISTER + RANK)
    codes = docs.select(F.col("text").cast("string")).mapInArrow(gather, "code long").repartition(word)
    ranks = codes.groupBy(word.alias("word"), F.shiftrightunsigned("code", RANK).alias("register")).agg(F.max(F.col("code").bitwiseAND((1 << RANK) - 1)).alias("rank"))
    rows = ranks.groupBy("word").agg(F.count(F.lit(1)).alias("filled"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("weight"))
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (F.col("weight") + m - F.col("filled"))
    small = m * F.log(m / (m - F.col("filled")))
    return rows.select("word", F.when((F.col("filled") < m) & (raw <= 2.5 * m), small).otherwise(raw).alias("kinds"))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic, r): at most ``max_labelled`` labelled documents of each class, by the hash of their id."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.withColumn("r", remainder(F.col("id"))).where("r != 2")
    order = F.xxhash64("id")
    picked = [rows.where(F.col("toxic") == c).orderBy(order, "id").limit(max_labelled) for c in (0, 1)]
    ids = materialize(picked[0].unionByName(picked[1]), "labelled")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("text", "toxic", "r")


def class_counts(sample: DataFrame) -> DataFrame:
    """(kind, before, word, n0, n1): ordinary and toxic documents with a word (kind 0), or with a word after another (kind 1)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for s in bs.slices(batch.column(0)):
                h, before, w = _hashes(s)
                row = np.repeat(np.arange(len(s)), w.counts)
                for kind, first in ((0, np.zeros_like(before)), (1, before)):
                    order = np.lexsort((h, first, row))
                    x, v, of = h[order], first[order], row[order]
                    new = np.ones(len(x), bool)
                    new[1:] = (x[1:] != x[:-1]) | (v[1:] != v[:-1]) | (of[1:] != of[:-1])
                    columns = [np.full(int(new.sum()), kind, np.int8), v[new].view(np.int64), x[new].view(np.int64), toxic[of[new] + s.lo].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "before", "word", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(gather, "kind byte, before long, word long, toxic int")
    return rows.groupBy("kind", "before", "word").agg(*[F.count(F.when(F.col("toxic") == c, 1)).cast("int").alias(f"n{c}") for c in (0, 1)])


def significance(n0: Column, n1: Column, all0: int, all1: int) -> Column:
    """G2 of the documents with an expression, ``n0`` of ``all0`` ordinary and ``n1`` of ``all1`` toxic ones."""
    share = (n0 + n1) / F.lit(float(all0 + all1))
    cell = lambda n, total, p: F.when(n > 0, n * F.log(n / (F.lit(float(total)) * p))).otherwise(F.lit(0.0))
    return 2 * (cell(n0, all0, share) + cell(all0 - n0, all0, 1 - share) + cell(n1, all1, share) + cell(all1 - n1, all1, 1 - share))


def discounts_of(n: np.ndarray) -> np.ndarray:
    """Discounts of counts of 0, 1, 2, 3 and more, from how many counts are 1, 2, 3 and 4 (``n``, by count)."""
    y = n[1] / max(1.0, n[1] + 2 * n[2])
    d = np.zeros(4)
    for k in (1, 2, 3):
        d[k] = np.clip(k - (k + 1) * y * n[k + 1] / n[k], 0.1, k - 0.1) if n[k] and n[k + 1] else 0.75
    return d


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in a sorted table; its length for those that aren't there."""
    at = np.searchsorted(table, keys)
    return np.where(table[np.minimum(at, len(table) - 1)] == keys, at, len(table)) if len(table) else np.zeros(len(keys), np.int64)


class ClassCounts:
    """What the class models know: counts of significant words and pairs, and totals over all of the sample.

    ``words``: sorted hashes, with ``kinds`` [class, word], ``history`` [class,
    word] (pairs that begin with it) and ``worth`` (G2; 0 for words that only
    begin pairs).  ``first`` and ``second``: places of a pair's words, with
    ``pairs`` [class, pair] and ``pair_worth``.  ``kind_sums`` [class] and the
    counts of counts ``kind_coc``, ``pair_coc`` [class, count] cover what is pruned, too.
    """

    def __init__(self, words, kinds, history, worth, first, second, pairs, pair_worth, kind_sums, kind_coc, pair_coc) -> None:
        self.words, self.kinds, self.history, self.worth = words, kinds, history, worth
        self.first, self.second, self.pairs, self.pair_worth = first, second, pairs, pair_worth
        self.kind_sums, self.kind_coc, self.pair_coc = kind_sums, kind_coc, pair_coc
        self.shared = np.zeros(len(words))

    def pruned(self, least: float) -> ClassCounts:
        """Without the words and pairs whose significance is below ``least``; words that only serve pairs stay, as pruned ones."""
        p = self.pair_worth >= least
        use = self.worth >= least
        use[self.first[p]] = use[self.second[p]] = True
        place = np.cumsum(use) - 1
        worth = np.where(self.worth >= least, self.worth, 0.0)[use]
        out = ClassCounts(self.words[use], self.kinds[:, use], self.history[:, use], worth, place[self.first[p]], place[self.second[p]], self.pairs[:, p], self.pair_worth[p], self.kind_sums, self.kind_coc, self.pair_coc)
        out.shared = self.shared[use]
        return out


class KneserNeyPair:
    """Log ratios, toxic over ordinary, of the words and pairs of both class models.

    A pair without counts of its own has the ratio of what its first word
    leaves to the backoff plus that of its second word; a word without counts
    has the ratio of what the classes leave to the shared counts, which are the
    same for both.
    """

    def __init__(self, counts: ClassCounts) -> None:
        n, first, second = len(counts.words), counts.first, counts.second
        keys = _pair_key(counts.words[first], counts.words[second])
        order = np.argsort(keys)
        logs = []
        for c in (0, 1):
            kinds, pairs, history = counts.kinds[c], counts.pairs[c], counts.history[c]
            kept = np.where(counts.worth > 0, kinds - discounts_of(counts.kind_coc[c])[np.minimum(kinds, 3)], 0.0)
            rest = 1 - kept.sum() / counts.kind_sums[c]
            p = kept / counts.kind_sums[c] + rest * counts.shared
            kept_pairs = pairs - discounts_of(counts.pair_coc[c])[np.minimum(pairs, 3)]
            back = 1 - np.divide(np.bincount(first, kept_pairs, n), history, out=np.zeros(n), where=history > 0)
            full = np.divide(kept_pairs, history[first], out=np.zeros(len(pairs)), where=history[first] > 0) + back[first] * p[second]
            logs.append([np.log(np.maximum(x, 1e-300)) for x in (np.append(p, rest), np.append(back, 1.0), full)])
        # a word that only serves pairs has the shared probability in both classes
        self.words, self.keys = counts.words, keys[order]
        self.of_word, self.of_back, of_pair = [y - x for x, y in zip(*logs, strict=True)]
        self.of_pair = np.append(of_pair[order], 0.0)

    def ratio(self, s: bs.TextSlice) -> np.ndarray:
        """Per row, the log ratio of its words over their number (and ``SHRINK``); 0 without words."""
        h, before, w = _hashes(s)
        if not len(h):
            return np.zeros(len(s))
        pair = _find(self.keys, _pair_key(before, h))
        logs = np.where(pair < len(self.keys), self.of_pair[pair], self.of_back[_find(self.words, before)] + self.of_word[_find(self.words, h)])
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return (sums[w.first[1:]] - sums[w.first[:-1]]) / (w.counts + SHRINK)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cut: float) -> tuple[float, float, float]:
    """Slope and intercept of a logistic function of ``x``, and the F measure it reaches at ``cut``.

    The function passes ``cut`` at the value that separates the labels with the
    best F1 and reaches about 0.9 at the mean of the toxic rows above it.
    Weights undo the sampling by class.
    """
    order = np.argsort(-x, kind="stable")
    ranked, hits = x[order], np.cumsum((y * weight)[order])
    fit = 2 * hits / (np.cumsum(weight[order]) + (y * weight).sum())
    fit[:-1][ranked[:-1] == ranked[1:]] = -1  # ties stand on one side
    best = int(np.argmax(fit))
    below = ranked[best + 1] if best + 1 < len(ranked) else ranked[best] - 1e-3
    at = (ranked[best] + below) / 2
    above = x[(y == 1) & (x > at)]
    slope = 3.0 / max(float(above.mean()) - at if len(above) else 0.0, 1e-6)
    return slope, float(np.log(cut / (1 - cut)) - slope * at), float(fit[best])


class ToxicityModel:
    """Counts of both classes and a calibration; ``counts`` is None where labels did not suffice.

    The tasks make the log ratios of the counts, once in each worker.
    """

    def __init__(self, counts: ClassCounts | None, slope: float, intercept: float) -> None:
        self.counts, self.slope, self.intercept = counts, slope, intercept
        self.pair: KneserNeyPair | None = None

    def scores(self, s: bs.TextSlice) -> np.ndarray:
        if self.counts is not None and self.pair is None:
            self.pair = KneserNeyPair(self.counts)
        x = np.zeros(len(s)) if self.pair is None else self.pair.ratio(s)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30)))


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a small table, by way of Arrow."""
    table = df.select(*names).toArrow()
    return [table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in names]


def _counts_of_counts(rows: DataFrame, names: tuple[str, str]) -> np.ndarray:
    """[class, count]: how many of the counts in the columns ``names`` are 1, 2, 3 and 4."""
    found = rows.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in names for k in (1, 2, 3, 4)]).first()
    return np.array([[0.0, *[float(found[f"{c}_{k}"]) for k in (1, 2, 3, 4)]] for c in names])


def significant_counts(table: DataFrame, all0: int, all1: int, least: float) -> ClassCounts | None:
    """The counts of ``class_counts`` that reach ``least``, pruned in Spark, with the totals of all; None if a class has no words."""
    pairs = table.where("kind = 1")
    kinds = materialize(pairs.groupBy("word").agg(F.count_if(F.col("n0") > 0).alias("k0"), F.count_if(F.col("n1") > 0).alias("k1")), "kinds")
    sums = kinds.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("k0", "k1")]).first()
    if not (sums.k0 and sums.k1):
        return None
    worth = significance(F.col("n0"), F.col("n1"), all0, all1)
    found = pairs.select("before", "word", "n0", "n1", worth.alias("worth")).where(F.col("worth") >= least)
    before, second, n0, n1, pair_worth = _columns(found, "before", "word", "n0", "n1", "worth")
    own, own_worth = _columns(table.where("kind = 0").select("word", worth.alias("worth")).where(F.col("worth") >= least), "word", "worth")
    words = np.unique(np.concatenate([own, before, second]).view(np.uint64))
    wanted = table.sparkSession.createDataFrame(pa.table({"word": words.view(np.int64)}))
    history = pairs.groupBy(F.col("before").alias("word")).agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"))

    def of_words(rows: DataFrame, *names: str) -> np.ndarray:
        # the words wanted are those the driver has; Spark broadcasts them if they are few
        key, *values = _columns(rows.join(wanted, "word", "left_semi"), "word", *names)
        at = np.searchsorted(words, key.view(np.uint64))
        out = np.zeros((len(names), len(words)))
        out[:, at] = np.stack(values)
        return out

    places = np.zeros(len(words))
    places[np.searchsorted(words, own.view(np.uint64))] = own_worth
    at = [np.searchsorted(words, x.view(np.uint64)) for x in (before, second)]
    return ClassCounts(
        words, of_words(kinds, "k0", "k1").astype(np.int64), of_words(history, "h0", "h1"), places, *at, np.stack([n0, n1]).astype(np.int64), pair_worth,
        np.array([sums.k0, sums.k1], float), _counts_of_counts(kinds, ("k0", "k1")), _counts_of_counts(pairs, ("n0", "n1")),
    )


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 5000, levels: tuple[float, ...] = LEVELS, cut: float = 0.3) -> ToxicityModel:
    """Fit both models and the calibration; see the module's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Copies of a text count once, with the label that most of them bear.
    sample = labelled_sample(docs, labels, max_labelled).groupBy("text").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"), F.min("r").alias("r"))
    sample = materialize(sample, "sample")
    share = {(r.toxic, r.held): r["count"] for r in sample.groupBy("toxic", (F.col("r") == 3).alias("held")).count().collect()}
    n_class = [sum(v for (c, _), v in share.items() if c == k) for k in (0, 1)]
    prior = np.log((n_class[1] + 0.5) / (n_class[0] + 0.5))
    if any(share.get((c, held), 0) == 0 for c in (0, 1) for held in (False, True)):
        return ToxicityModel(None, 0.0, float(prior))

    table = materialize(class_counts(sample.where("r != 3")), "counts")
    counts = significant_counts(table, share[0, False], share[1, False], min(levels))
    if counts is None:
        return ToxicityModel(None, 0.0, float(prior))

    corpus = materialize(shared_counts(docs), "shared")
    every = corpus.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0.0)).alias("kinds")).first()
    keys = _word_key(counts.words)
    mine = docs.sparkSession.createDataFrame(pa.table({"word": np.unique(keys)}))
    word, kinds = _columns(corpus.join(mine, "word", "left_semi"), "word", "kinds")
    order = np.argsort(word)
    at = _find(word[order], keys)
    # a tenth for each word, so that one that only opens texts isn't impossible
    counts.shared = (np.append(kinds[order], 0.0)[at] + 0.1) / (every.kinds + 0.1 * (every.n + 1))

    grid = [counts.pruned(x) for x in sorted(levels)]
    tables = docs.sparkSession.sparkContext.broadcast(grid)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [KneserNeyPair(x) for x in tables.value]
        for batch in batches:
            for s in bs.slices(batch.column(0)):
                for i, model in enumerate(models):
                    x = model.ratio(s)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), batch.column(1).slice(s.lo, len(s)), pa.array(x)], names=["i", "toxic", "x"])

    # at most max_labelled rows of each class, a number for each level
    held = sample.where("r = 3").select("text", "toxic").mapInArrow(measure, "i int, toxic int, x double").toPandas()
    tables.unpersist()
    rows = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic")).where(remainder(F.col("id")) != 2)
    weight = {r.toxic: r["count"] / max(1, n_class[r.toxic]) for r in rows.groupBy("toxic").count().collect()}
    held["weight"] = held.toxic.map(weight).astype(float)
    fits = {i: calibrate(g.x.to_numpy(), g.toxic.to_numpy(np.float64), g.weight.to_numpy(), cut) for i, g in held.sort_values(["i", "x", "toxic"]).groupby("i")}
    best = max(fits, key=lambda i: (round(fits[i][2], 9), i))
    slope, intercept, _ = fits[best]
    return ToxicityModel(grid[best], slope, intercept)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bs.slices(batch.column(2)):
                x = handle.value.scores(s)
                columns = [batch.column(0).slice(s.lo, len(s)), batch.column(1).slice(s.lo, len(s)), pa.array(x), pa.array((x >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    narrow = docs.select(doc_id.alias("doc_id"), F.coalesce(remainder(doc_id) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(score, SCORED)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns kept."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [handle.value.scores(s) < threshold for s in bs.slices(batch.column(place))]
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)
