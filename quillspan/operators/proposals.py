"""From model responses to proposals, and from proposals to a graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillspan.functions.text import clean_terms, illustration, make_key, strip
from quillspan.operators.graph_build import CONTENT_TYPES, merge_nodes, semantic_edges, structural_edges
from quillspan.operators.retrieval import response_items
from quillspan.session import stored

def _text(name: str) -> Column:
    return strip(F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit("")))


def _texts(name: str) -> Column:
    raw = F.coalesce(F.try_variant_get("item", f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(raw, lambda t: strip(t)), lambda t: t != "")


def _illustration() -> Column:
    return illustration(_text("illustration_kind"), _text("illustration_hint"))


def _one_or(name: str, others: Column) -> Column:
    """The name that an entry gives, else all of `others`."""
    return F.when(_text(name) != "", F.array(_text(name))).otherwise(others)


def topic_entries(responses: DataFrame, context: DataFrame) -> DataFrame:
    """(prompt_id, pos, name, summary, scope, illustration): the first max_topics (context: prompt_id, max_topics) entries with a name; scope broad or narrow, else broad."""
    rows = response_items(responses).join(context.select("prompt_id", "max_topics"), "prompt_id").where("pos < max_topics")
    scope = F.lower(_text("scope"))
    scope = F.when(scope.isin("broad", "narrow"), scope).otherwise("broad")
    return rows.select("prompt_id", "pos", _text("name").alias("name"), _text("summary").alias("summary"), scope.alias("scope"), _illustration().alias("illustration")).where("name <> ''")


def subtopic_entries(responses: DataFrame, context: DataFrame, most: int = 3) -> DataFrame:
    """(prompt_id, pos, name, summary, parents, parent_subtopics, illustration): the first `most` entries, those with a name.

    Without a parent topic all topics of the document (context: prompt_id, topics) are parents; without a parent subtopic there is none.
    """
    rows = response_items(responses).join(context.select("prompt_id", "topics"), "prompt_id").where(F.col("pos") < most)
    nested = _one_or("parent_subtopic", F.array().cast("array<string>"))
    return rows.select(
        "prompt_id", "pos", _text("name").alias("name"), _text("summary").alias("summary"), _one_or("parent_topic", F.col("topics")).alias("parents"), nested.alias("parent_subtopics"), _illustration().alias("illustration")
    ).where("name <> ''")


def content_entries(responses: DataFrame, context: DataFrame) -> DataFrame:
    """(prompt_id, pos, title, content_type, summary, raw_excerpt, key_terms, illustration, parents, evidence): entries with a title, max_contents a chunk.

    context: prompt_id, chunk_id, subtopics, max_contents. An unknown type is other; excerpts have 300 characters; without
    a parent subtopic all of the chunk's; the chunk is the evidence.
    """
    rows = response_items(responses).join(context, "prompt_id").where("pos < max_contents")
    kind = F.lower(_text("content_type"))
    kind = F.when(kind.isin(*CONTENT_TYPES), kind).otherwise("other")
    return rows.select(
        "prompt_id", "pos", _text("title").alias("title"), kind.alias("content_type"), _text("summary").alias("summary"),
        F.rtrim(F.substring(_text("raw_excerpt"), 1, 300)).alias("raw_excerpt"), clean_terms(_texts("key_terms")).alias("key_terms"), _illustration().alias("illustration"), _one_or("parent_subtopic", F.col("subtopics")).alias("parents"), F.array("chunk_id").alias("evidence"),
    ).where("title <> ''")


def subtopics_of_chunks(subtopics: DataFrame) -> DataFrame:
    """(chunk_id, names): the subtopics (name, source_chunk_ids, seq) that each chunk gave, in order."""
    rows = subtopics.select(F.explode("source_chunk_ids").alias("chunk_id"), "seq", "name")
    return rows.groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.struct("seq", "name"))).alias("all")).select("chunk_id", F.transform("all", lambda x: x["name"]).alias("names"))


class GraphResult(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    counters: DataFrame
    warnings: DataFrame


_NAMES = "array<string>"
_REFS = {"topic_of_subtopic": "topic", "subtopic_of_subtopic": "subtopic", "subtopic_of_content": "subtopic", "topic_of_content": "topic"}


def parent_references(subtopics: DataFrame, contents: DataFrame) -> DataFrame:
    """(seq, child, reference, pos, parent_name, parent): each name by which a proposal calls a parent, with the key it stands for.

    subtopics: key, seq, parents (topics' names), parent_subtopics; contents: key, seq, parents (subtopics' names), topic_parents.
    """

    def named(tier: DataFrame, reference: str, column: str) -> Column:
        names = F.coalesce(F.col(column), F.array().cast(_NAMES)) if column in tier.columns else F.array().cast(_NAMES)
        return F.transform(names, lambda x, i: F.struct(F.lit(reference).alias("reference"), i.alias("pos"), x.alias("parent_name"), make_key(_REFS[reference], x).alias("parent")))

    found = None
    for tier, columns in ((subtopics, {"topic_of_subtopic": "parents", "subtopic_of_subtopic": "parent_subtopics"}), (contents, {"subtopic_of_content": "parents", "topic_of_content": "topic_parents"})):
        rows = tier.select("seq", F.col("key").alias("child"), F.explode(F.concat(*(named(tier, r, c) for r, c in columns.items()))).alias("x")).select("seq", "child", "x.*")
        found = rows if found is None else found.unionByName(rows)
    return found


def resolve_references(references: DataFrame, proposed: DataFrame, known: DataFrame) -> DataFrame:
    """`references` with outcome: bundle, graph, or null where no node of that key is in either (both: key). Every name is looked up once, in one table."""
    table = proposed.select("key", F.lit("bundle").alias("outcome")).unionByName(known.select("key", F.lit("graph").alias("outcome")))
    table = table.groupBy(F.col("key").alias("parent")).agg(F.min("outcome").alias("outcome"))
    return references.join(table, "parent", "left")


def apply_bundle(nodes: DataFrame, edges: DataFrame, topics: DataFrame, subtopics: DataFrame, contents: DataFrame, related: DataFrame, at: Column | None = None) -> GraphResult:
    """The graph with proposals merged in; the same bundle twice changes nothing but updated_at.

    topics, subtopics and contents have the columns that merge_nodes takes but key and node_type; subtopics also parents
    (topics' names) and parent_subtopics, contents parents (subtopics' names) and topic_parents. related: src, dst, label,
    confidence, and source_chunk_ids if there are any. Subtopics hang on their topics and on other subtopics, never on themselves. A proposal for a content hangs on
    its topics only where none of its subtopics is known. counters: (what, n) for nodes added and merged of each kind and
    edges added and merged. warnings: (seq, src, dst, reason) for topics and subtopics that a subtopic's topics and a
    content's subtopics name without being there, with the name as src, and for related pairs without both ends; unknown
    parent subtopics of subtopics and unknown fallback topics are passed over in silence.

    Proposals and pairs are dealt among all tasks and stored with their keys, as each is read many times.
    """
    tiers = [stored(df.repartition("name").withColumn("node_type", F.lit(kind)).withColumn("key", make_key(kind, "name")).where("key IS NOT NULL")) for kind, df in (("topic", topics), ("subtopic", subtopics), ("content", contents))]
    related = stored(related)
    columns = ["key", "node_type", "name", "summary", "scope", "content_type", "raw_excerpt", "key_terms", "source_ids", "seq"]
    more = [c for c in ("illustration", "illustration_path", "origin", "created_at") if any(c in t.columns for t in tiers)]
    proposals = None
    for tier in tiers:
        rows = tier.select(*columns, *(c for c in more if c in tier.columns))
        proposals = rows if proposals is None else proposals.unionByName(rows, allowMissingColumns=True)
    resolved = stored(resolve_references(parent_references(tiers[1], tiers[2]), proposals, nodes))
    # the keys of the merged nodes, without merging them
    keys = stored(proposals.select("key").unionByName(nodes.select("key")).distinct())

    kept = "outcome IS NOT NULL AND parent <> child"
    parents = resolved.where(f"{kept} AND reference IN ('topic_of_subtopic', 'subtopic_of_content')")
    by_proposal = parents.groupBy(F.col("seq"), F.col("child").alias("key")).agg(F.transform(F.sort_array(F.collect_set(F.struct("pos", "parent"))), lambda x: x["parent"]).alias("parents"))
    merged, _ = merge_nodes(nodes, proposals.join(by_proposal, ["seq", "key"], "left"), at)
    order = proposals.select("key", "seq").unionByName(nodes.select("key", "seq")).groupBy("key").agg(F.min("seq").alias("seq"))
    merged = merged.join(order, "key")

    # contents that have a subtopic, by proposal
    attached = resolved.where("reference = 'subtopic_of_content' AND outcome IS NOT NULL").select("seq", "child").distinct().withColumn("_attached", F.lit(True))
    links = resolved.where(kept).join(attached, ["seq", "child"], "left").where("reference <> 'topic_of_content' OR _attached IS NULL")
    relation = F.when(F.col("reference").endswith("_of_content"), "HAS_CONTENT").otherwise("HAS_SUBTOPIC")
    evidence = tiers[2].select("seq", F.col("key").alias("child"), F.col("source_ids").alias("source_chunk_ids"))
    wanted = links.select("seq", "child", F.col("parent").alias("src"), relation.alias("relation")).join(evidence, ["seq", "child"], "left")
    wanted = wanted.select("src", F.col("child").alias("dst"), "relation", F.coalesce("source_chunk_ids", F.array().cast(_NAMES)).alias("source_chunk_ids"), F.col("seq").cast("long").alias("seq"))
    before = edges.where("relation <> 'RELATED_TO'").select("src", "dst", "relation", F.coalesce("source_chunk_ids", F.array().cast(_NAMES)).alias("source_chunk_ids"), F.lit(-1).cast("long").alias("seq"))
    structural, _ = structural_edges(wanted, keys, before)
    semantic, missing = semantic_edges(edges.where("relation = 'RELATED_TO'"), related, keys)
    shape = ["src", "dst", "relation", "label", "confidence", "source_chunk_ids"]
    structural = structural.withColumn("label", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))

    lost = resolved.where("outcome IS NULL AND parent_name IS NOT NULL AND reference IN ('topic_of_subtopic', 'subtopic_of_content')")
    why = F.when(F.col("reference") == "topic_of_subtopic", "unknown topic").otherwise("unknown subtopic")
    warnings = lost.select(F.col("seq").cast("long").alias("seq"), F.col("parent_name").alias("src"), F.col("child").alias("dst"), why.alias("reason"))
    warnings = warnings.unionByName(missing.select(F.lit(None).cast("long").alias("seq"), "src", "dst", F.lit("missing end").alias("reason")))

    known = nodes.select("key", F.lit(True).alias("_known")).distinct()
    added = proposals.join(known, "key", "left").groupBy("node_type").agg(F.count_distinct(F.when(F.col("_known").isNull(), F.col("key"))).alias("added"), F.count(F.lit(1)).alias("n"))
    counters = added.select(F.explode(F.array(F.struct(F.concat("node_type", F.lit("s added")).alias("what"), F.col("added").alias("n")), F.struct(F.concat("node_type", F.lit("s merged")).alias("what"), (F.col("n") - F.col("added")).alias("n")))).alias("x")).select("x.*")
    new_links = wanted.select("src", "dst", "relation").distinct().join(before.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti")
    counters = counters.unionByName(new_links.agg(F.count(F.lit(1)).alias("n")).select(F.lit("structural edges added").alias("what"), "n"))
    return GraphResult(merged, structural.select(*shape).unionByName(semantic.select(*shape)), counters, warnings)


def linkables(nodes: DataFrame, types: tuple[str, ...] = ("topic", "subtopic", "content")) -> DataFrame:
    """(id, text) of nodes of these types: what is compared when links are looked for."""
    from quillspan.functions.text import node_text

    return nodes.where(F.col("node_type").isin(*types)).select(F.col("key").alias("id"), node_text("name", "summary").alias("text"))


def evidence_trail(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, chunk_id, ord): the chunks of a node's source_ids that are there, each once, in order."""
    rows = nodes.select("key", F.posexplode("source_ids").alias("pos", "chunk_id")).groupBy("key", "chunk_id").agg(F.min("pos").alias("pos"))
    found = rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return found.select("key", "chunk_id", F.row_number().over(Window.partitionBy("key").orderBy("pos")).alias("ord"))


def pending_assets(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, path) of contents with a hint and no picture: the best of their chunks' assets (chunk_id, path, priority; low first), null if there is none."""
    open_ = nodes.where("node_type = 'content' AND hint IS NOT NULL AND illustration_path IS NULL")
    assets = open_.select("key", F.explode("source_ids").alias("chunk_id")).join(chunks.where("path IS NOT NULL"), "chunk_id").groupBy("key").agg(F.min_by("path", F.struct("priority", "chunk_id")).alias("path"))
    return open_.select("key").join(assets, "key", "left")


#: Questions that may be asked of a node, by its kind.
TEMPLATES = {
    "topic": ("Which subjects does {name} cover?", "Sum up {name} for a newcomer."),
    "subtopic": ("Where does {name} fit in?", "Tell me more about {name}."),
    "definition": ("What exactly is meant by {name}?", "Put {name} in your own words."),
    "theorem": ("Under which conditions does {name} hold?", "What follows from {name}?"),
    "technique": ("When would I use {name}?", "Which steps does {name} take?"),
    "example": ("What can be learned from {name}?",),
    "question": ("Where should I begin with {name}?",),
    "figure": ("What should I notice in {name}?",),
    "default": ("What do the sources say on {name}?", "Why does {name} matter here?"),
}


def suggestions(nodes: DataFrame, n: int = 6, seed: int = 0) -> DataFrame:
    """(key, question) of n nodes with a name, in an order and with templates dealt by `seed`."""
    spark = nodes.sparkSession
    table = spark.createDataFrame([(kind, i, len(texts), text) for kind, texts in TEMPLATES.items() for i, text in enumerate(texts)], "kind string, turn int, turns int, template string")
    known = [k for k in TEMPLATES if k not in ("topic", "subtopic", "default")]
    kind = F.when(F.col("node_type").isin("topic", "subtopic"), F.col("node_type")).when(F.col("content_type").isin(*known), F.col("content_type")).otherwise("default")
    rows = nodes.where((strip(F.coalesce("name", F.lit(""))) != "") & F.col("node_type").isin("topic", "subtopic", "content")).withColumn("kind", kind).withColumn("deal", F.xxhash64("key", F.lit(seed)))
    first = rows.orderBy("deal", "key").limit(n).join(F.broadcast(table), "kind").where(F.pmod("deal", F.col("turns")) == F.col("turn"))
    return first.select("key", F.replace("template", F.lit("{name}"), strip("name")).alias("question"))


def _summary_rows(totals: DataFrame, warnings: DataFrame, most: int) -> DataFrame:
    texts = F.explode(F.array(F.concat(F.col("ok").cast("string"), F.lit(" files read")), F.concat(F.col("bad").cast("string"), F.lit(" files failed"))))
    first = warnings.orderBy("seq").limit(most).select(F.lit("warning").alias("kind"), "text")
    return totals.select(F.lit("total").alias("kind"), texts.alias("text")).unionByName(first)


def _outcomes() -> list[Column]:
    return [F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad")]


def ingest_summary(files: DataFrame, warnings: DataFrame, most: int = 20) -> DataFrame:
    """(kind, text): files read and failed (path, error), then the first warnings (seq, text)."""
    return _summary_rows(files.agg(*_outcomes()), warnings, most)


def write_with_summary(files: DataFrame, path: str, warnings: DataFrame, most: int = 20) -> DataFrame:
    """What was read of `files` (path, error and any other columns) written to `path`, and the summary: files are counted by the scan that writes those without an error."""
    seen = Observation()
    files.observe(seen, *_outcomes()).where("error IS NULL").drop("error").write.parquet(path)
    counts = seen.get
    return _summary_rows(files.sparkSession.createDataFrame([(counts["ok"], counts["bad"])], "ok long, bad long"), warnings, most)
