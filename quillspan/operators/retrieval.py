"""From ranked evidence to a packed context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import clock, parse_items, relationship_line, sigmoid4, strip, strip_fences, truthy
from quillspan.operators.prefix import cuts, running, up_to
from quillspan.operators.similarity import topk
from quillspan.sources.store import lookup


#: Questions to which a chunk's text goes at once.
ASKERS = 1024


def dense_retrieve(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest chunks of each query with their texts; vectors without a chunk are skipped, ranks stay."""
    return lookup(chunks, topk(vectors, queries, k).withColumnRenamed("id", "chunk_id"))


def sub_questions(questions: DataFrame, responses: DataFrame, max_sub: int = 4) -> DataFrame:
    """(query_id, sub_id, text): the first max_sub of a response's sub_questions without blanks; else the question itself.

    responses: (query_id, raw). Whatever can't be read as such a list counts as no response.
    """
    parsed = F.try_variant_get(F.try_parse_json(strip_fences("raw")), "$.sub_questions", "array<variant>")
    texts = F.transform(F.filter(F.slice(parsed, 1, max_sub), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: strip(F.try_variant_get(v, "$", "string")))
    kept = F.filter(texts, lambda t: t != "")
    joined = questions.join(responses.select("query_id", kept.alias("subs")), "query_id", "left")
    subs = F.when(F.size("subs") > 0, F.col("subs")).otherwise(F.array("text"))
    return joined.select("query_id", F.posexplode(subs).alias("sub_id", "text"))


def verdicts(responses: DataFrame) -> DataFrame:
    """(query_id, four flags) of responses (query_id, raw): flags that are missing are true, and all are where nothing can be read."""
    value = F.try_parse_json(strip_fences("raw"))

    def flag(name: str) -> Column:
        held = F.try_variant_get(value, f"$.{name}", "variant")
        return F.when(held.isNull(), True).otherwise(truthy(held)).alias(name)

    return responses.select("query_id", *map(flag, ("needs_retrieval", "is_relevant", "is_supported", "is_useful")))


def response_items(responses: DataFrame) -> DataFrame:
    """(prompt_id, pos, item) for each object of each response (prompt_id, raw).

    Responses are dealt among all tasks before they are parsed, as many of them stand in one block of a file.
    """
    dealt = responses.select("prompt_id", "raw").repartition("prompt_id")
    return dealt.select("prompt_id", F.posexplode(parse_items("raw")).alias("pos", "item"))


def hybrid_merge(dense: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, chunk_id, source, rank) of chunks found by either (query_id, chunk_id, rank): both or dense by rank, then graph only."""
    d, g = dense.select("query_id", "chunk_id", F.col("rank").alias("d")), graph.select("query_id", "chunk_id", F.col("rank").alias("g"))
    both = d.join(g, ["query_id", "chunk_id"], "full_outer")
    source = F.when(F.col("d").isNotNull() & F.col("g").isNotNull(), "both").when(F.col("d").isNotNull(), "dense").otherwise("graph")
    order = Window.partitionBy("query_id").orderBy(F.col("d").isNull(), F.coalesce("d", "g"), "chunk_id")
    return both.select("query_id", "chunk_id", source.alias("source"), F.row_number().over(order).alias("rank"))


def merge_evidence(parts: DataFrame) -> DataFrame:
    """(query_id, chunk_id, source, rank): each chunk once, as the first sub-question (sub_id, then rank) found it."""
    first = parts.groupBy("query_id", "chunk_id").agg(F.min(F.struct("sub_id", "rank", "source")).alias("at"))
    return first.select("query_id", "chunk_id", F.col("at.source").alias("source"), F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id")).alias("rank"))


def mode_rollup(parts: DataFrame, fallback: str = "dense") -> DataFrame:
    """(query_id, mode) of the modes of its sub-questions (query_id, mode)."""
    has = lambda m: F.max(F.col("mode") == m)
    flags = parts.groupBy("query_id").agg(has("hybrid").alias("hybrid"), has("graph").alias("graph"), has("dense").alias("dense"))
    mode = F.when(F.col("hybrid") | (F.col("dense") & F.col("graph")), "hybrid").when(F.col("graph"), "graph").when(F.col("dense"), "dense").otherwise(fallback)
    return flags.select("query_id", mode.alias("mode"))


def _bag(column: str) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def with_pair_scores(chunks: DataFrame, pair_score_fn: Callable[[pd.Series, pd.Series], np.ndarray] | None = None) -> DataFrame:
    """`chunks` with logit of (question, text): by pair_score_fn in batches, else four times the share of the question's words in the text, less two."""
    if pair_score_fn is None:
        share = F.size(F.array_intersect(_bag("question"), _bag("text"))) / F.greatest(F.size(_bag("question")), F.lit(1))
        return chunks.withColumn("logit", 4 * share - 2)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields if f.name != "logit")

    def run(frames):
        for pdf in frames:
            yield pdf.assign(logit=np.asarray(pair_score_fn(pdf["question"], pdf["text"]), np.float64))

    return chunks.drop("logit").mapInPandas(run, f"{schema}, logit double")


def scored_pairs(pairs: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """`pairs` (query_id, chunk_id, ...) with the logit that with_pair_scores gives without a function, of questions (query_id, question) and chunks (chunk_id, text).

    A question's words are made once, and a chunk's once for about ASKERS questions, to which its text goes once; no pair carries
    a text. Pairs whose question or chunk is not there are skipped. Ids are keys.
    """
    asked = pairs.select("query_id", "chunk_id").distinct()
    parts = asked.groupBy("chunk_id").agg(F.ceil(F.count(F.lit(1)) / ASKERS).alias("parts"))
    dealt = asked.join(parts, "chunk_id").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts"))
    dealt = dealt.join(questions.select("query_id", _bag("question").alias("bag")), "query_id")
    met = dealt.groupBy("chunk_id", "part").agg(F.collect_list(F.struct("query_id", "bag")).alias("asked")).join(chunks.select("chunk_id", "text"), "chunk_id")
    logit = lambda q, words: 4 * (F.size(F.array_intersect(q["bag"], words)) / F.greatest(F.size(q["bag"]), F.lit(1))) - 2
    # words stand in an array of one, so that they aren't made anew for each question
    scores = F.flatten(F.transform(F.array(_bag("text")), lambda words: F.transform("asked", lambda q: F.struct(q["query_id"].alias("query_id"), logit(q, words).alias("logit")))))
    found = met.select("chunk_id", F.explode(scores).alias("x")).select("x.query_id", "chunk_id", "x.logit")
    return pairs.join(found, ["query_id", "chunk_id"])


def rerank(chunks: DataFrame, score_col: str = "logit", min_relevancy: float = 0.0, max_sources: int | None = None) -> DataFrame:
    """Chunks (query_id, chunk_id, rank, ...) by relevancy, the sigmoid of a score at four digits; less relevant ones go if a minimum is set."""
    scored = chunks.withColumn("relevancy_score", sigmoid4(F.col(score_col)))
    if min_relevancy > 0:
        scored = scored.where(F.col("relevancy_score") >= min_relevancy)
    ranked = scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevancy_score"), "rank", "chunk_id")))
    ranked = ranked.where(F.col("new_rank") <= max_sources) if max_sources else ranked
    return ranked.drop("rank").withColumnRenamed("new_rank", "rank")


#: What stands in place of the first line that doesn't fit.
MORE = "[{rank}] … (more evidence than fits here)"


def pack_context(ranked: DataFrame, max_chars: int = 4000, marker: bool = True) -> DataFrame:
    """(query_id, rank, line) that fit: numbered lines until the first that would pass max_chars, in whose place a mark may stand.

    What fits is told from lengths alone, in ranges of each query's ranks; only lines that fit are then built. Ranks of a query are unique.
    """
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("modality"), F.lit(") "))
    summed = running(ranked.select("query_id", "rank", (F.length(head) + F.length("text")).cast("long").alias("_length")), "query_id", ["rank"], F.col("_length"))
    # totals grow, so the first line that doesn't fit is the one before which all did
    shown = summed.where((F.col("total") <= max_chars) | (F.lit(marker) & (F.col("total") - F.col("_length") <= max_chars)))
    shown = shown.select(F.col("query_id").alias("_query"), F.col("rank").alias("_rank"), (F.col("total") > max_chars).alias("_cut"))
    kept = ranked.join(shown, F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("rank") == F.col("_rank")))
    mark = F.replace(F.lit(MORE), F.lit("{rank}"), F.col("rank").cast("string"))
    return kept.select("query_id", "rank", F.when(F.col("_cut"), mark).otherwise(F.concat(head, "text")).alias("line"))


def prefix_by_length(ranked: DataFrame, by: str, max_chars: int, keep_first: bool = True) -> DataFrame:
    """Rows of each group in order of rank until their texts together would pass max_chars; the first one stays if keep_first. Rows of one rank stay or go together."""
    return up_to(ranked, cuts(ranked, by, ["rank"], F.length("text"), max_chars, keep_first), by, ["rank"])


def evidence(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, page, timestamp) as shown to readers: 500 characters, the page if not 0, m:ss of the start."""
    page = F.coalesce(F.nullif("page_number", F.lit(0)), F.nullif("page_start", F.lit(0)))
    return chunks.select("chunk_id", F.substring("text", 1, 500).alias("text"), page.alias("page"), F.when(F.col("start_time").isNotNull(), clock(F.col("start_time"))).alias("timestamp"))


def citations(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, chunk_id, ord): chunks that an answer cites as [rank], each once, in order of first mention; other numbers are ignored."""
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    cited = answers.select("query_id", F.posexplode(numbers).alias("pos", "rank"))
    first = cited.join(ranked.select("query_id", "rank", "chunk_id"), ["query_id", "rank"]).groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"))
    return first.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("ord"))


def relationship_lines(triples: DataFrame) -> DataFrame:
    """(query_id, lines): a query's relationships (head, relation, tail), distinct and in order."""
    lines = triples.select("query_id", relationship_line(F.col("head"), F.col("relation"), F.col("tail")).alias("line")).distinct()
    return lines.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))


#: Prompt texts by what a question comes with.
PROMPTS = {
    "plain": "Answer briefly and say when you are unsure.\nQuestion: {question}",
    "dense": "Answer from these passages and cite them by number.\n{context}\nQuestion: {question}",
    "graph": "Answer from these passages and relationships and cite passages by number.\n{context}\n{relationships}\nQuestion: {question}",
}


def prompts(asked: DataFrame) -> DataFrame:
    """(query_id, kind, prompt) of (query_id, question, mode, context, relationships): plain without mode or context, graph for graph and hybrid, else dense."""
    empty = F.coalesce("context", F.lit("")) == ""
    kind = F.when((F.col("mode") == "none") | empty, "plain").when(F.col("mode").isin("graph", "hybrid"), "graph").otherwise("dense")
    text = F.when(kind == "plain", PROMPTS["plain"]).when(kind == "graph", PROMPTS["graph"]).otherwise(PROMPTS["dense"])
    filled = F.replace(F.replace(F.replace(text, F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{relationships}"), F.coalesce("relationships", F.lit(""))), F.lit("{question}"), F.col("question"))
    return asked.select("query_id", kind.alias("kind"), filled.alias("prompt"))
