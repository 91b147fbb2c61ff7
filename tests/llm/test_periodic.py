"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import periodic as P
from quillspark.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(x, power=4, least=6):
    """All runs, by trying every period at every place."""
    n, found = len(x), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(least, power * q) and not any(all(x[k] == x[k + d] for k in range(start, end - d)) for d in range(1, q)):
                found.append((start, end - start, q))
            i = j
    return sorted(found)


def nested(rng, n):
    """Loops of loops, with breaks."""
    x = [rng.randrange(3)]
    while len(x) < n:
        piece = x[-rng.randrange(1, min(len(x), 30) + 1) :]
        x += piece * rng.randrange(1, 7)
        if rng.random() < 0.5:
            x.append(rng.randrange(4))
    return x[:n]


def test_runs_of_all_kinds_of_sequences():
    rng = random.Random(1)
    cases = [[], [1], [1] * 5, [1] * 6, [1] * 500, [1, 2] * 4, [1, 2] * 3 + [1], ([1] * 31 + [2]) * 20, [1] * 40 + [2] + [1] * 40, list(range(8)) * 5]
    a, b = [1], [1, 2]
    for _ in range(10):
        a, b = b, b + a
    cases.append(b)  # no word four times in a row
    cases += [[rng.randrange(k) for _ in range(rng.randrange(120))] for k in (1, 2, 2, 3, 5) for _ in range(40)]
    cases += [nested(rng, rng.randrange(10, 400)) for _ in range(150)]
    for x in cases:
        assert P.find_runs(np.array(x, np.int64)) == plain(x), x


@pytest.mark.parametrize("power,least", [(3, 1), (3, 10), (5, 6), (4, 40)])
def test_other_limits(power, least):
    rng = random.Random(power * 100 + least)
    for _ in range(60):
        x = nested(rng, rng.randrange(10, 250))
        assert P.find_runs(np.array(x, np.int64), power=power, least=least) == plain(x, power, least)
    with pytest.raises(ValueError):
        P.find_runs(np.array([1, 1, 1]), power=2)


def test_hashes_that_say_too_much_change_nothing(monkeypatch):
    monkeypatch.setattr(P, "fmix64", lambda x: x - x)  # all words alike to the hashes
    rng = random.Random(7)
    for _ in range(60):
        x = nested(rng, rng.randrange(10, 200))
        assert P.find_runs(np.array(x, np.int64)) == plain(x)


def test_a_batch_of_documents_has_the_zones_of_each(monkeypatch):
    monkeypatch.setattr(P, "SEEDS", 5)
    rng = random.Random(3)
    texts = [nested(rng, rng.randrange(0, 200)) for _ in range(40)]
    h = np.array([w for x in texts for w in x], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = P.zones(h, np.cumsum([0, *map(len, texts)]))
    for i, x in enumerate(texts):
        assert P.find_runs(np.array(x, np.int64), found.get(i, [])) == plain(x)


def test_long_texts_in_bounded_steps():
    n = 300_000
    rng = np.random.default_rng(2)
    period = rng.integers(0, 1000, 37_000)
    for x, want in [(np.zeros(n, np.int64), [(0, n, 1)]), (np.tile(period, 9)[:n], [(0, n, 37_000)]), (np.tile([0] * 15 + [1], n // 16), None)]:
        got = P.find_runs(x)
        assert got == want if want else (0, n, 16) in got and len(got) == n // 16 + 1
    assert P.find_runs(rng.integers(0, 400, n)) == []


def report(text):
    words = WORD.findall(text or "")
    runs = plain(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *told, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def looped(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def test_reports_of_odd_rows(spark, make_docs):
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "a " * 6), (4, "a " * 6), (None, "b b\nb  b b b c"), (6, "é ü " * 4), (7, "x\x1cy " * 7), (8, "A a " * 5), (9, "\xa0 " * 8)]
    rows += [(100 + i, " ".join(f"w{v}" for v in nested(rng, rng.randrange(150)))) for i in range(40)]
    got = P.run_report(P.periodic_runs(make_docs(rows)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, *report(t)) for i, t in rows], key=str)
    assert P.run_report(P.periodic_runs(make_docs([]))).count() == 0
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_loops_are_planted_by_id(spark, make_docs):
    rng = random.Random(12)
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "  ")] + [(i, "  ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60)))) for i in range(300)]
    got = P.with_loops(make_docs(rows)).select("doc_id", "text").collect()
    plant = [(i, looped(i, t)) for i, t in rows]
    assert sorted(((i, WORD.findall(t or "")) for i, t in map(tuple, got)), key=str) == sorted(((i, WORD.findall(t or "")) for i, t in plant), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r)[1:] for r in registry.queries()["op11_periodic_runs"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts) and sum(r[0] > 0 for r in got.values()) > 10
    for i, text in texts:
        if len(text or "") < 8000:
            assert got[i] == report(looped(i, text)), i
