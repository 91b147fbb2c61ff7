"""Rows that a service shows: lookups, labels, sources and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import text as T
from quillspark.profile import DEFAULT, Profile

# fixed values: the types, search addresses and tags that the service shows
SHOWN_TYPES = ("ARTICLE", "CLAUSE", "GUIDANCE_S", "GUIDANCE", "COURT_CASE")
SEARCH = {"vero": "https://www.vero.fi/search/?q=", "finlex": "https://finlex.fi/fi/search/?text="}


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def point_lookup(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """One chunk by id, in the names of the service; no row if there is none."""
    names = {"id": "id", "parent_id": "parentId", "chunk_index": "chunkIndex", "chunk_total": "chunkTotal", "source": "source", "type": "type", "statute": "statute", "title": "title", "text": "text", "date": "date", "superseded_by": "supersededBy", "references": "references", "file_path": "filePath"}
    return chunks.where(F.col("id") == chunk_id).select(*[F.col(k).alias(v) for k, v in names.items() if k in chunks.columns], F.lit(None).cast("string").alias("section"))


def graph_node(chunks: DataFrame, profile: Profile = DEFAULT, *also: str) -> DataFrame:
    """(id, type, label, superseded, desc) for display, and the columns ``also``."""
    kind = F.coalesce(F.when(~_blank("type"), F.upper("type")), F.lit("ARTICLE"))
    kind = F.when(kind.isin(*SHOWN_TYPES), kind).when(F.col("source") == profile.authority_source, "GUIDANCE").otherwise("ARTICLE")
    parent = F.coalesce(F.when(~_blank("parent_id"), F.col("parent_id")), F.col("id"))
    title = T.strip(F.coalesce("title", F.lit("")))
    label = F.when(title != "", T.short(title, 38)).otherwise(F.substring(parent, -40, 40))
    text = F.replace(T.strip(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" "))
    return chunks.select(*also, parent.alias("id"), kind.alias("type"), label.alias("label"), (~_blank("superseded_by")).alias("superseded"), T.short(text, 140).alias("desc"))


def chunk_label(profile: Profile = DEFAULT) -> Column:
    """The short label of a chunk's citation."""
    src = F.when(_blank("source"), "doc").otherwise(F.col("source"))
    site = F.when(src == profile.authority_source, "vero.fi").when(src == profile.statute_source, "finlex.fi").otherwise(src)
    tail = F.concat(site, F.lit(" #chunk"), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?")))
    return F.when(~_blank("statute"), F.concat(F.col("statute"), F.lit(" · "), tail)).otherwise(tail)


def source_url(profile: Profile = DEFAULT) -> Column:
    """Where a source's own search finds a title; null without a title or for other sources."""
    title = T.strip(F.coalesce("title", F.lit("")))
    at = F.when(F.col("source") == profile.authority_source, SEARCH["vero"]).when(F.col("source") == profile.statute_source, SEARCH["finlex"])
    return F.when(title != "", F.concat(at, T.quoted(title)))


def source_rows(hits: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """(qid, parent_id, first_rank, label, tag, tag_label, url, chunks): one row for each parent, chunks in order."""
    tag = F.when(~_blank("superseded_by"), F.struct(F.lit("repealed").alias("tag"), F.lit("Repealed").alias("label"))).when(F.col("type") == "COURT_CASE", F.struct(F.lit("court").alias("tag"), F.lit("Court").alias("label")))
    tag = tag.when(F.col("source") == profile.authority_source, F.struct(F.lit("guidance").alias("tag"), F.lit("Guidance").alias("label"))).otherwise(F.struct(F.lit("statute").alias("tag"), F.lit("Statute").alias("label")))
    shown = hits.select("qid", "parent_id", "rank", tag.alias("t"), F.substring(F.coalesce(F.when(~_blank("title"), F.col("title")), F.col("parent_id")), 1, 120).alias("label"), source_url(profile).alias("url"), F.struct("rank", "id", chunk_label(profile).alias("label"), "score").alias("c"))
    head = F.min_by(F.struct("label", "t", "url"), "rank").alias("h")
    rows = shown.groupBy("qid", "parent_id").agg(F.min("rank").alias("first_rank"), head, F.array_sort(F.collect_list("c")).alias("chunks"))
    return rows.select("qid", "parent_id", "first_rank", "h.label", F.col("h.t.tag").alias("tag"), F.col("h.t.label").alias("tag_label"), "h.url", "chunks")


def first_claim(hits: DataFrame) -> DataFrame:
    """(qid, parent_id, sub_idx): the first sub-question that returned a parent."""
    return hits.groupBy("qid", "parent_id").agg(F.min("sub_idx").alias("sub_idx"))


def endpoints(log: DataFrame, chunks: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """(parent_id, chunk_id): the first chunk of each node that a walk log names."""
    ends = log.select(F.col("from").alias("parent_id")).unionByName(log.select(F.col("to").alias("parent_id"))).distinct()
    return ends.join(chunks, "parent_id").groupBy("parent_id").agg(F.min_by("id", order).alias("chunk_id"))


def event_rows(phases: list[tuple[str, DataFrame]], by_ord: bool = False) -> DataFrame:
    """(qid, seq, event, data, frame): the rows of each phase (qid, ord, and what it tells) as numbered events.

    Phases follow each other and rows keep their ``ord`` in them; with ``by_ord``
    the rows of all phases follow it together.  Nulls are written out.
    """
    out = None
    for i, (event, df) in enumerate(phases):
        data = F.to_json(F.struct(*[c for c in df.columns if c not in ("qid", "ord")]), {"ignoreNullFields": "false"})
        rows = df.select("qid", F.lit(i).alias("phase"), F.col("ord").cast("long").alias("ord"), F.lit(event).alias("event"), data.alias("data"))
        out = rows if out is None else out.unionByName(rows)
    seq = F.row_number().over(W.partitionBy("qid").orderBy(*(("ord", "phase") if by_ord else ("phase", "ord")), "data")).cast("long")
    return out.select("qid", seq.alias("seq"), "event", "data", T.sse_frame(F.col("event"), F.col("data")).alias("frame"))
