"""What the character models mark and what they leave, on fresh strings, and long runs."""

import random
import string
import tracemalloc

import pytest

from quillspark.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def marked(model, text, least=16):
    return [(a, b) for a, k, b in secrets.find_spans(text, model, least, 10.0) if k == 3]


def drawn(rng, kind, n):
    return "".join(rng.choice(secrets.ALPHABETS[kind]) for _ in range(n))


@pytest.mark.parametrize("kind", sorted(secrets.ALPHABETS))
def test_recall_on_fresh_keys(model, kind):
    rng = random.Random(99)
    for n, least in ((20, 0.85), (24, 0.95), (32, 0.97)):
        keys = [drawn(rng, kind, n) for _ in range(300)]
        hit = sum(any(b - a >= n - 6 for a, b in marked(model, f"see {k} there")) or "hex" == kind and n >= 32 for k in keys)
        assert hit >= least * len(keys), (kind, n, hit)


def test_what_isnt_secret_stays(model):
    rng = random.Random(5)
    for n in range(6, 40):
        for _ in range(20):
            assert not marked(model, "n " + "".join(rng.choice(string.digits) for _ in range(n)))
    for text in ("A" * 29, "ACGT" * 8, "".join(rng.choice("ACGT") for _ in range(40)), "CamelCaseIdentifierWithManyWords", "QWERTYUIOPASDFGHJKL", "a/long/path/of/words/index", "SOME_CONSTANT_NAME_OF_WORDS", "----------------------", "=" * 60):
        assert not marked(model, f"x {text} y"), text
    assert not secrets.mixed("12345678901234567890") and secrets.mixed("aB3dE5gH7jK9")


def test_a_uuid_is_marked_as_a_whole(model):
    rng, found = random.Random(6), 0
    for _ in range(100):
        u = "-".join(drawn(rng, "hex", n) for n in (8, 4, 4, 4, 12))
        spans = marked(model, f"id {u}.")
        assert spans in ([], [(3, 39)])
        found += bool(spans)
    assert found >= 90


def test_long_runs_in_bounded_memory(model):
    rng = random.Random(7)
    key = "".join(rng.choices(secrets.ALPHABETS["base62"], k=3_000_000))
    tracemalloc.start()
    spans = marked(model, key)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000 and sum(b - a for a, b in spans) >= 0.999 * len(key) and len(spans) <= 3
    words = "_".join(rng.choice(["some", "words", "of", "names"]) for _ in range(40_000))
    assert not marked(model, words)
    at = secrets.PIECE - 12  # across the end of a piece
    text = words[:at] + drawn(rng, "base62", 32) + words[at:]
    assert any(a <= at + 6 and b >= at + 26 for a, b in marked(model, text))


def test_hexadecimal_rules_hold_for_any_least(model):
    text = "x " + "0123456789abcdef" * 2 + " y"
    assert [k for _, k, _ in secrets.find_spans(text, model, 64, 10.0)] == [2]
