"""Secret scans: fixed rules, and character Markov models for strings no rule names.

First-order character models, of random strings by alphabet and of ordinary
identifiers, are trained from labelled samples.  A run of characters as secrets
have them is cut where the rules' spans lie; in each rest the stretch with the
best log-likelihood ratio, random over ordinary, is found for each alphabet (the
largest sum over neighbouring transitions).  It is a secret if it has at least
``least`` characters, its ratio exceeds ``margin`` and its characters are as
mixed as those of a key (``mixed``: neither a number nor letters of a few kinds nor words joined by
capitals); what lies before and after
it is searched again.  A key is thus found wherever it stands in a path or in a
long identifier, and a UUID is marked as a whole.  Long runs are searched in overlapping pieces, so
that memory doesn't grow with them.

The labelled samples: random strings are drawn with a fixed seed over the
alphabets that keys are commonly written in; ordinary identifiers are words and
numbers of a bounded sample of documents, without what a rule marks, joined the
way identifiers, paths and dates are, and drawn numbers of 6 to 20 digits.  Both sizes are parameters.  The scan itself
covers every whole text.

Edge cases: a null or empty text has no spans; overlapping spans of the rules
all count, the models' spans overlap nothing; repeated rows are scanned each;
without any ordinary words the prior stands for them; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytescan as bs

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_random long, spans string"

CANDIDATE = np.zeros(256, bool)
CANDIDATE[[ord(c) for c in string.ascii_letters + string.digits + "+/=_-"]] = True
_RUN = re.compile(r"[A-Za-z0-9+/=_-]+")

#: A stretch is lengthened by at most so many characters, to the next separator.
EDGE, SEPARATORS = 4, "/=_-"

#: Characters of the models; everything else shares the last state.
_STATES = np.full(256, 64 + 4, np.int64)
_STATES[[ord(c) for c in string.ascii_letters + string.digits + "+/=_-."]] = np.arange(68)
_N = 69


#: Runs are searched in pieces of so many characters, each of which reaches into the next one.
PIECE, OVERLAP = 1 << 16, 1 << 10

_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_TURN = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")


def mixed(s: str, kinds: int = 6) -> bool:
    """Whether characters are mixed as in a key: at least ``kinds`` of them, letters, and digits or capitals all over.

    Without digits two fifths of the places between letters must turn from small letters to
    capitals or back; in a key of both that is every second one, in joined words about every third.
    """
    return len(set(s)) >= kinds and _LETTER.search(s) is not None and (_DIGIT.search(s) is not None or 5 * len(_TURN.findall(s)) >= 2 * len(s))


class MarkovPair:
    """Log-likelihood ratios of character transitions, random over ordinary.

    Random strings have a model for each kind of the labelled sample, since an
    alphabet shows in every transition; their likelihoods are averaged.
    """

    def __init__(self, random: dict[str, list[str]], ordinary: list[str], prior: float = 0.5) -> None:
        base = self._log(ordinary, prior)
        self.ratios = np.stack([self._log(sample, prior) - base for _, sample in sorted(random.items())])

    @staticmethod
    def _log(sample: list[str], prior: float) -> np.ndarray:
        counts = np.full((_N, _N), prior)
        for s in sample:
            x = _STATES[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
            np.add.at(counts, (x[:-1], x[1:]), 1)
        return np.log(counts / counts.sum(1, keepdims=True))

    def score(self, s: str) -> float:
        """The ratio of the best alphabet over a whole string, all of them being as likely."""
        x = _STATES[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
        return float(self.ratios[:, x[:-1], x[1:]].sum(1).max() - np.log(len(self.ratios)))

    def stretches(self, s: str, least: int, margin: float) -> list[tuple[int, int]]:
        """The random stretches of a run, as (start, end), in order."""
        found: list[tuple[int, int]] = []
        for at in range(0, max(1, len(s) - OVERLAP), PIECE):
            for a, b in sorted(self._stretches(s[at : at + PIECE + OVERLAP], least, margin)):
                for m in _UUID.finditer(s, max(0, at + a - 36), at + b + 36):
                    if m.start() < at + b and m.end() > at + a:
                        a, b = min(a, m.start() - at), max(b, m.end() - at)
                if found and at + a <= found[-1][1]:
                    found[-1] = (min(found[-1][0], at + a), max(found[-1][1], at + b))
                else:
                    found.append((at + a, at + b))
        return found

    def _stretches(self, s: str, least: int, margin: float) -> list[tuple[int, int]]:
        x = _STATES[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
        steps = self.ratios[:, x[:-1], x[1:]]
        found, todo = [], [(0, len(s))]
        while todo:
            a, b = todo.pop()
            if b - a < least:
                continue
            sums = np.concatenate([np.zeros((len(steps), 1)), np.cumsum(steps[:, a : b - 1], 1)], 1)
            gain = sums - np.minimum.accumulate(sums, 1)
            kind, end = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[kind, end] - np.log(len(steps)) <= margin:
                continue
            start = int(sums[kind, : end + 1].argmin())
            lo, hi = a + start, a + int(end) + 1
            if hi - lo >= least:
                # the first and last characters of a key may look ordinary: as far as a separator, if that is near
                lo = next((i for i in range(lo, max(a, lo - EDGE) - 1, -1) if i == a or s[i - 1] in SEPARATORS), lo)
                hi = next((i for i in range(hi, min(b, hi + EDGE) + 1) if i == b or s[i] in SEPARATORS), hi)
                if mixed(s[lo:hi]):
                    found.append((lo, hi))
            # a short stretch is no secret, but one may lie on either side of it
            todo += [(a, lo), (hi, b)]
        return found


# fixed values: the alphabets of hexadecimal, base 62, base 32 and both forms of base 64
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base62": string.ascii_letters + string.digits,
    "base32": string.ascii_uppercase + "234567",
    "base64": string.ascii_letters + string.digits + "+/",
    "base64url": string.ascii_letters + string.digits + "-_",
}


def random_sample(n: int, seed: int = 7) -> dict[str, list[str]]:
    """``n`` labelled random strings of 16 to 64 characters for each of the alphabets that keys are written in."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return {kind: ["".join(np.array(list(letters))[rng.integers(0, len(letters), int(rng.integers(16, 65)))]) for _ in range(n)] for kind, letters in ALPHABETS.items()}


#: What the rules mark, for Spark's regular expressions.
_MARKED = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"


def ordinary_sample(docs: DataFrame, n_docs: int, n_strings: int) -> list[str]:
    """Words and numbers of ``n_docs`` documents, picked by a hash of their id, and identifiers made of them.

    What a rule marks is left out.  At most ``n_strings`` words come to the driver.
    """
    key = F.col("doc_id").cast("string")
    ids = docs.where("text is not null").select(key.alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(n_docs)
    picked = docs.join(F.broadcast(ids), key.eqNullSafe(F.col("id")), "left_semi")  # n_docs ids at most
    plain = F.regexp_replace("text", _MARKED, " ")
    word = F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit("[A-Za-z]{3,}|[0-9]{2,}"), F.lit(0)))).alias("w")
    found = [r.w for r in picked.select(word).distinct().orderBy(F.xxhash64("w"), "w").limit(n_strings).collect()]
    names, numbers = [w for w in found if w[0] > "9"], [w for w in found if w[0] <= "9"]
    out = list(found)
    for i in range(0, len(names) - 2, 3):
        a, b, c = names[i : i + 3]
        out += [f"{a}_{b}_{c}".lower(), f"{a.lower()}{b.title()}{c.title()}", f"{a}-{b}", f"{a}/{b}/{c}", a.upper(), f"{b}_{c}".upper()]
        if numbers:
            m, n = numbers[i % len(numbers)], numbers[(i + 1) % len(numbers)]
            out += [f"{a}{m}", f"{b}_{n}", f"{m}-{n}", f"{c}/{m}/{a}", f"{m}/{n}", f"{b}-{n}", f"{m}_{n}"]
    return out + long_numbers(len(found) // 10)


def long_numbers(n: int, seed: int = 11) -> list[str]:
    """``n`` drawn numbers of 6 to 20 digits: times, accounts and counters are ordinary, not secrets."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return ["".join(map(str, rng.integers(0, 10, int(rng.integers(6, 21))))) for _ in range(n)]


def find_spans(text: str, model: MarkovPair, least: int, margin: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order; offsets in code points, end exclusive."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = [m for m in _RUN.finditer(text) if m.end() - m.start() >= min(least, 32)]
    for r in runs:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, r.start(), r.end()) if m.end() - m.start() >= 32]
    base = sorted(spans)
    i = 0
    for r in runs:
        # the parts of the run that no rule covers
        at = r.start()
        while i < len(base) and base[i][2] <= at:
            i += 1
        rests = []
        for a, _, b in base[i:]:
            if a >= r.end():
                break
            rests.append((at, a))
            at = max(at, b)
        for a, b in [*rests, (at, r.end())]:
            if b - a >= least:
                spans += [(a + x, 3, a + y) for x, y in model.stretches(text[a:b], least, margin)]
    return sorted(spans)


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _suspects(s: bs.TextSlice, least: int) -> np.ndarray:
    """Rows that may hold a span: a long run, a key prefix, or an assignment sign."""
    runs = bs.words(s, CANDIDATE)
    row = np.repeat(np.arange(len(s)), runs.counts)
    out = np.zeros(len(s), bool)
    out[row[runs.end - runs.start >= least]] = True
    sign = np.flatnonzero((s.buf == ord(":")) | (s.buf == ord("=")))
    akia = np.flatnonzero((s.buf[:-3] == ord("A")) & (s.buf[1:-2] == ord("K")) & (s.buf[2:-1] == ord("I")) & (s.buf[3:] == ord("A"))) if len(s.buf) > 3 else sign[:0]
    for at in (sign, akia):
        out[np.searchsorted(s.offs, at, "right") - 1] = True
    return out


def _scanner(model, least: int, margin: float):
    nothing = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.value
        for batch in batches:
            for s in bs.slices(batch.column(1)):
                n = len(s)
                counts, base, told = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
                for i in np.flatnonzero(_suspects(s, min(least, 32))).tolist():
                    spans = find_spans(s.row(i).decode("utf-8", "replace"), pair, least, margin)
                    for _, k, _ in spans:
                        counts[k, i] += 1
                    base[i] = hashlib.sha256(_told([x for x in spans if x[1] < 3]).encode()).hexdigest()
                    told[i] = _told(spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, n), *[pa.array(c) for c in counts[:3]], pa.array(base), pa.array(counts[3]), pa.array(told)],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_random", "spans"],
                )

    return scan


def train(docs: DataFrame, n_random: int = 1500, n_docs: int = 400, n_strings: int = 20_000) -> MarkovPair:
    """Both models from their labelled samples; the sizes bound the training."""
    return MarkovPair(random_sample(n_random), ordinary_sample(docs, n_docs, n_strings))


def scan_secrets(docs: DataFrame, model: MarkovPair | None = None, least: int = 16, margin: float = 10.0) -> DataFrame:
    """One row for each document: counts by kind, the digest of the rules' spans, and all spans."""
    model = model or train(docs)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_scanner(handle, least, margin), SCHEMA)


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, at, stop = [], 0, -1
    for a, _, b in spans:
        if a >= stop:
            out += [text[at:a], mark]
        at = stop = max(stop, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, model: MarkovPair | None = None, least: int = 16, margin: float = 10.0) -> DataFrame:
    """``docs`` with all columns kept and the secrets in ``text`` replaced; ``n_chars`` follows, if there is one."""
    model = model or train(docs)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = handle.value
        for batch in batches:
            column = batch.column(place)
            texts = None
            for s in bs.slices(column):
                for i in np.flatnonzero(_suspects(s, min(least, 32))).tolist():
                    text = s.row(i).decode("utf-8", "replace")
                    if spans := find_spans(text, pair, least, margin):
                        texts = column.to_pylist() if texts is None else texts
                        texts[s.lo + i] = redact_text(text, spans)
            if texts is None:
                yield batch
            else:
                yield batch.set_column(place, batch.schema.field(place), pa.array(texts, column.type))

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
