"""Scalar functions over text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.profile import DEFAULT, Profile

FENCE = "`" * 3


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyword_match(path: Column, raw: Column, p: Profile = DEFAULT) -> Column:
    """Whether the path or the start of the raw text holds a keyword."""
    return F.concat(F.coalesce(path, F.lit("")), F.substring(F.coalesce(raw, F.lit("")), 1, p.keyword_prefix)).rlike(f"(?iu){p.keywords}")


def sections(text: Column, p: Profile = DEFAULT) -> Column:
    """The parts of a text before, between and after its section headings, stripped; empty ones go."""
    pattern = "(?U)" + "|".join(f"(?={b})" for b in p.boundaries)
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: F.length(s) > 0)


def chunk_text(text: Column, p: Profile = DEFAULT) -> Column:
    """The chunks of a text, in order.

    A short text is one chunk.  Else it is cut before section headings; short
    sections stay whole, long ones become overlapping windows, of which those
    with too little text are dropped.  A text that yields nothing keeps its start.
    """
    size, step = p.chunk_chars, p.chunk_step

    def full(w: Column) -> Column:
        """Whether at least ``chunk_min`` characters are left without the white space at both ends."""
        return w.rlike(rf"(?sU)\S.{{{p.chunk_min - 2},}}\S") if p.chunk_min > 1 else F.length(strip(w)) >= p.chunk_min

    def windows(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(step))
        cut = F.transform(starts, lambda a: F.substring(s, a + 1, F.lit(size)))
        return F.when(F.length(s) <= size, F.array(s)).otherwise(F.filter(cut, full))

    pieces = F.flatten(F.transform(sections(text, p), windows))
    long = let(pieces, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.substring(text, 1, size))))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(long)


def extract_date(text: Column, p: Profile = DEFAULT) -> Column:
    """The first date of the profile's form as ``yyyy-mm-dd``, else null."""
    part = lambda i: F.regexp_extract(text, f"(?U){p.date}", i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def section_numbers(text: Column, p: Profile = DEFAULT) -> Column:
    """The section numbers cited in a text, in order, with repeats."""
    found = F.regexp_extract_all(text, F.lit(f"(?U){p.reference}"), F.lit(0))
    return F.transform(found, lambda m: F.regexp_extract(m, r"(\d+[a-zA-Z]?)", 1))


def pair_numbers(text: Column, p: Profile = DEFAULT) -> Column:
    """Both numbers of each "X ja Y §"."""
    found = lambda i: F.regexp_extract_all(text, F.lit(f"(?U){p.reference_pair}"), F.lit(i))
    return F.concat(found(1), found(2))


def extract_references(text: Column, statute: Column, p: Profile = DEFAULT) -> Column:
    """``STATUTE_§N`` for each cited section, distinct, by first place; empty without a statute."""
    none = F.array().cast("array<string>")
    keys = F.array_distinct(F.transform(section_numbers(text, p), lambda n: F.concat(statute, F.lit("_§"), n)))
    return F.when(statute.isNull() | (statute == ""), none).otherwise(F.coalesce(keys, none))


def infer_statute(title: Column, path: Column, p: Profile = DEFAULT) -> Column:
    """The statute of the first rule that fits title or path."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(path, F.lit(""))))
    return F.coalesce(*[F.when(text.rlike(f"(?iuU){rule}"), F.lit(name)) for rule, name in p.statutes])


def classify_type(source: Column, folder: Column, p: Profile = DEFAULT) -> Column:
    """Document type from source and folder."""
    f = F.lower(folder)
    statutory = F.when(f.contains("korkein hallinto") | f.contains("kho"), "COURT_CASE").when(f.contains("asetus"), "STATUTE").otherwise("ARTICLE")
    advisory = F.when(f.contains("ennakkoratkaisu") | f.contains("kvl"), "COURT_CASE").otherwise("GUIDANCE")
    return F.when(source == p.authority_source, advisory).otherwise(statutory)


def node_id(path: Column) -> Column:
    """A document's id from its relative path."""
    return F.substring(F.replace(F.translate(path, "/ ", "__"), F.lit(".html"), F.lit("")), 1, 120)


def chunk_id(parent: Column, index: Column, total: Column) -> Column:
    """A chunk's id; the suffix only where there are several."""
    return F.substring(F.when(total > 1, F.concat(parent, F.lit("#chunk"), index.cast("string"))).otherwise(parent), 1, 140)


def parent_of(chunk: Column) -> Column:
    """The part of a chunk id before its last ``#chunk``."""
    return F.regexp_replace(chunk, r"(?s)#chunk(?!.*#chunk).*$", "")


def tokens(text: Column, p: Profile = DEFAULT) -> Column:
    """Lower-case tokens of the profile's token class."""
    return F.regexp_extract_all(F.lower(text), F.lit(p.token), F.lit(0))


def counted(words: Column) -> Column:
    """[(token, tf)]: the distinct words of an array and how often each is there, counted in the row."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda p: F.transform(p, lambda i, j: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(p, j + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, let(F.sort_array(words), runs))


def expand_query(text: Column, p: Profile = DEFAULT) -> Column:
    """Acronyms replaced by their long forms, in the profile's order."""
    for short, full in p.acronyms:
        text = F.regexp_replace(text, rf"(?<![A-Za-z])\Q{short}\E(?![A-Za-z])", full.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def is_refusal(answer: Column, p: Profile = DEFAULT) -> Column:
    """Whether an answer holds a marker of not knowing."""
    return F.coalesce(F.exists(F.array(*[F.lit(m) for m in p.refusals]), lambda m: F.contains(F.lower(answer), m)), F.lit(False))


def has_citation(answer: Column, p: Profile = DEFAULT) -> Column:
    return F.coalesce(answer.rlike(f"(?iuU){p.citation}"), F.lit(False))


def unfence(reply: Column) -> Column:
    """A reply without the code fence around it, if there is one; a fence without an end runs to the end."""
    inner = lambda r: strip(F.regexp_replace(F.regexp_replace(r, rf"(?s)^{FENCE}(.*?)(?:{FENCE}.*)?$", "$1"), "^json", ""))
    return let(strip(reply), lambda r: F.when(F.startswith(r, F.lit(FENCE)), inner(r)).otherwise(r))


def parse_reply(reply: Column, schema: str) -> Column:
    """The JSON of a reply; null where it is none."""
    return F.from_json(unfence(reply), schema)


def quoted(title: Column) -> Column:
    """A title for a search address, without the site's suffix."""
    return F.url_encode(F.replace(strip(title), F.lit(" - vero.fi"), F.lit("")))


def short(text: Column, n: int) -> Column:
    """At most ``n`` characters, with a mark if something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def context_block(c: dict[str, Column]) -> Column:
    """Header and body of one piece of evidence."""
    date = F.when(F.coalesce(c["date"], F.lit("")) != "", F.concat(F.lit(" — "), c["date"])).otherwise("")
    return F.concat(F.lit("["), c["id"], F.lit("] "), c["title"], F.lit(" ("), F.coalesce(c["source"], F.lit("?")), F.lit(", "), F.coalesce(c["type"], F.lit("?")), F.lit(")"), date, F.lit("\n"), c["text"])


def sse_frame(event: Column, data: Column) -> Column:
    """One frame of a server-sent event stream."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalise(a: Column) -> Column:
    """An array scaled to unit length; zeros stay."""
    return let(F.sqrt(dot(a, a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
