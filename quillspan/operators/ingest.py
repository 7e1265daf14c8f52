"""From chunks and what a model says of them to a grown, linked and pruned graph."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators import graph_build as B
from quillspan.operators import proposals as P
from quillspan.operators import similarity as V


class Responses(NamedTuple):
    """What a model answers, raw: topics by source, subtopics and contents by chunk (prompt_id, raw), labels of linked pairs (batch, index, label, confidence)."""

    topics: DataFrame
    subtopics: DataFrame
    contents: DataFrame
    labels: DataFrame | None = None


class IngestResult(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    counters: DataFrame
    warnings: DataFrame


_NAMES = "array<string>"


def known_names(proposed: DataFrame, nodes: DataFrame, kind: str, embed: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """`proposed` (name, ...) under the names of nodes of that kind that mean the same: equal in canonical form, or as near as `threshold`."""
    encoded = lambda df: embed(df.withColumn("text", F.col("name"))).select("name", "embedding")
    names = proposed.select("name").distinct()
    found = V.resolve_synonyms(encoded(names), encoded(nodes.where(F.col("node_type") == kind).select("name").distinct()), threshold)
    return proposed.join(found.select("name", "resolved"), "name", "left").withColumn("name", F.coalesce("resolved", "name")).drop("resolved")


def _first_union(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a name form with the first name and seq, the longest summary, and the ordered unions of list columns."""
    keyed = rows.withColumn("form", F.lower(F.trim("name")))
    best = keyed.groupBy("form").agg(F.min_by("name", "seq").alias("name"), F.max_by("summary", F.struct(F.length("summary"), -F.col("seq"))).alias("summary"), F.min_by("illustration", "seq").alias("illustration"), F.min("seq").alias("seq"))
    for c in columns:
        best = best.join(B.ordered_union(keyed, ["form"], c), "form", "left")
    return best.drop("form")


def extract_proposals(chunks: DataFrame, responses: Responses, max_topics: int = 5, max_contents: int = 3, known: Callable[[DataFrame, str], DataFrame] = lambda rows, kind: rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, subtopics, contents) as apply_bundle takes them, of chunks (chunk_id, source_id, seq) and responses about them.

    A topic comes from all chunks of its source, so its source_ids are as long as the source, as nodes hold them; subtopics of one name are one, with all their parents and chunks; a
    content without a subtopic of its own hangs on all its chunk's, and where none is known on its source's topics.
    `known` puts the names of rows (name, ...) of a kind in place of those that mean the same; what lies below a topic
    or subtopic calls it by that name.
    """
    blank, none = F.lit(""), F.array().cast(_NAMES)
    of_source = chunks.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("seq", "chunk_id"))).alias("all")).select(F.col("source_id").alias("prompt_id"), F.transform("all", lambda x: x["chunk_id"]).alias("source_ids"), F.get("all", F.lit(0))["seq"].alias("first"))
    entries = P.topic_entries(responses.topics, of_source.select("prompt_id", F.lit(max_topics).alias("max_topics")))
    entries = known(entries, "topic").checkpoint()
    topics = entries.join(of_source, "prompt_id").select("name", "summary", "scope", "illustration", F.lit(None).cast("string").alias("content_type"), blank.alias("raw_excerpt"), none.alias("key_terms"), "source_ids", (F.col("first") * 100 + F.col("pos")).alias("seq"))

    named = entries.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("all")).select(F.col("prompt_id").alias("source_id"), F.transform("all", lambda x: x["name"]).alias("topics"))
    prompts = chunks.select(F.col("chunk_id").alias("prompt_id"), "chunk_id", "source_id", F.col("seq").alias("at")).join(named, "source_id", "left").withColumn("topics", F.coalesce("topics", none)).checkpoint()
    found = P.subtopic_entries(responses.subtopics, prompts).join(prompts.select("prompt_id", "at"), "prompt_id")
    found = known(found.withColumn("source_chunk_ids", F.array("prompt_id")).withColumn("seq", F.col("at") * 100 + F.col("pos")), "subtopic").checkpoint()
    merged = _first_union(found, ["parents", "parent_subtopics", "source_chunk_ids"])
    subtopics = merged.select("name", "summary", F.lit(None).cast("string").alias("scope"), "illustration", F.lit(None).cast("string").alias("content_type"), blank.alias("raw_excerpt"), none.alias("key_terms"), F.col("source_chunk_ids").alias("source_ids"), "seq", "parents", "parent_subtopics")

    of_chunk = P.subtopics_of_chunks(found.select("name", "seq", "source_chunk_ids")).select("chunk_id", F.col("names").alias("subtopics"))
    context = prompts.join(of_chunk, "chunk_id", "left").select("prompt_id", "chunk_id", F.coalesce("subtopics", none).alias("subtopics"), F.lit(max_contents).alias("max_contents"))
    made = P.content_entries(responses.contents, context).join(prompts.select("prompt_id", "at", "topics"), "prompt_id")
    contents = known(made.withColumnRenamed("title", "name"), "content").select("name", "summary", F.lit(None).cast("string").alias("scope"), "illustration", "content_type", "raw_excerpt", "key_terms", F.col("evidence").alias("source_ids"), (F.col("at") * 100 + F.col("pos")).alias("seq"), "parents", F.col("topics").alias("topic_parents"))
    return topics, subtopics, contents


def ingest(
    chunks: DataFrame,
    responses: Responses,
    nodes: DataFrame,
    edges: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    same_name: float = 0.9,
    band: tuple[float, float] = (0.55, 0.90),
    max_pairs: int = 200,
    max_topics: int = 5,
    max_contents: int = 3,
    at: Column | None = None,
) -> IngestResult:
    """The graph after an ingest run over `chunks`: proposals under known names, merged; alike nodes linked and labelled; what stands alone and what is too many of its tier pruned.

    `embed` adds an embedding to (text). nodes and edges are the graph before, which may be empty. Only nodes that are new
    or touched are compared with all others when links are looked for. Counters and warnings are those of apply_bundle, of both merges.
    """
    known = lambda rows, kind: known_names(rows, nodes, kind, embed, same_name)
    tiers = [t.checkpoint() for t in extract_proposals(chunks, responses, max_topics, max_contents, known)]
    no_pairs = edges.limit(0).select("src", "dst", "label", "confidence")
    grown = P.apply_bundle(nodes, edges, *tiers, no_pairs, at)
    after, links = grown.nodes.checkpoint(), grown.edges.checkpoint()
    counters, warnings = grown.counters, grown.warnings
    if responses.labels is not None:
        texts = embed(P.linkables(after)).select("id", "embedding").checkpoint()
        touched = None
        for kind, t in zip(("topic", "subtopic", "content"), tiers):
            keys = t.select(P.make_key(kind, "name").alias("id"))
            touched = keys if touched is None else touched.unionByName(keys)
        pairs = V.band_join(texts, *band, max_pairs=max_pairs, new_ids=touched.distinct())
        ordered = pairs.orderBy(F.desc("score"), "a", "b").coalesce(1).withColumn("rank", F.monotonically_increasing_id())  # at most max_pairs rows
        related = V.label_pairs(ordered, responses.labels).select(F.col("a").alias("src"), F.col("b").alias("dst"), "label", "confidence")
        empty = [t.limit(0) for t in tiers]
        linked = P.apply_bundle(after, links, *empty, related, at)
        after, links, warnings = linked.nodes.checkpoint(), linked.edges.checkpoint(), warnings.unionByName(linked.warnings)
    kept, left = B.prune_to_ratio(B.prune_isolated(after, links), links)
    return IngestResult(B.prune_isolated(kept, left), left, counters, warnings)
