"""Quizzes: context, validation, grading, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import parse_items, strip, truthy
from quillspan.operators.graph_build import degrees
from quillspan.operators.prefix import cuts, running, up_to
from quillspan.operators.similarity import nearest_within


def stride_sample(chunks: DataFrame, budget: int = 24000) -> DataFrame:
    """All chunks (seq, text) if they fit the budget, else every max(1, n // (budget // 300))-th by seq."""
    total = chunks.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("_chars"))
    step = F.when(F.col("_chars") > budget, F.greatest(F.lit(1), F.floor(F.col("_n") / (budget // 300)).cast("long"))).otherwise(1)
    # positions are counted within ranges of seq first, so that no task sees all rows
    ranged = chunks.repartitionByRange("seq").withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    base = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy("seq")) - 1).join(F.broadcast(base), "_part").withColumn("_at", F.col("_base") + F.col("_row"))
    return placed.join(F.broadcast(total)).where(F.col("_at") % step == 0).select(*chunks.columns)


def focus_context(quizzes: DataFrame, vectors: DataFrame, chunks: DataFrame, max_chars: int = 24000) -> DataFrame:
    """(quiz_id, chunk_id, rank): for each quiz with a focus (quiz_id, embedding) the chunks nearest to it, as many as stay within max_chars.

    All chunks are ranked by score, ties by seq, those without a vector (id, embedding) last in order of seq; the first one that would
    pass the limit ends the list, but the first of all stays. Texts are not moved: lengths tell what fits, and only what may
    fit of each batch of chunks is ranked together.
    """
    sizes = chunks.select("chunk_id", F.col("seq").cast("long").alias("seq"), F.length("text").cast("long").alias("size"))
    sized = vectors.select(F.col("id").alias("chunk_id"), "embedding").join(sizes, "chunk_id").withColumnRenamed("chunk_id", "id")
    scored = nearest_within(sized, quizzes.select(F.col("quiz_id").alias("query_id"), "embedding"), max_chars).checkpoint()  # ranges are sampled before they are made
    ranked = scored.select(F.col("query_id").alias("quiz_id"), F.lit(0).alias("tier"), (-F.round("score", 9)).alias("behind"), "seq", F.col("id").alias("chunk_id"), "size")
    # each quiz has the same chunks behind its ranked ones: they are put in line once
    rest = sizes.join(vectors.where("embedding IS NOT NULL").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").withColumn("all", F.lit(0))
    rest = running(rest, "all", ["seq", "chunk_id"], F.col("size")).where((F.col("total") <= max_chars) | (F.col("place") == 1))
    every = quizzes.select("quiz_id", F.explode(F.array(F.lit(0))).alias("all"))
    behind = every.join(rest, "all").select("quiz_id", F.lit(1).alias("tier"), F.lit(0.0).alias("behind"), "seq", "chunk_id", "size")
    summed = running(ranked.unionByName(behind), "quiz_id", ["tier", "behind", "seq", "chunk_id"], F.col("size"))
    return summed.where((F.col("total") <= max_chars) | (F.col("place") == 1)).select("quiz_id", "chunk_id", F.col("place").alias("rank"))


def backfill(hits: DataFrame, sample: DataFrame, limit: int = 40) -> DataFrame:
    """(chunk_id, tier, ord): the first `limit` hits (chunk_id, rank), then sampled chunks (chunk_id, seq) that aren't among them."""
    first = hits.where(F.col("rank") <= limit).select("chunk_id", F.lit(0).alias("tier"), F.col("rank").cast("long").alias("ord"))
    rest = sample.join(first, "chunk_id", "left_anti").select("chunk_id", F.lit(1).alias("tier"), F.col("seq").cast("long").alias("ord"))
    return first.unionByName(rest)


def top_degree(nodes: DataFrame, edges: DataFrame, n: int = 50) -> DataFrame:
    """(key, degree) of the n nodes with most edges, by key on ties."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "key").limit(n)


def triples_near(top: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 50) -> DataFrame:
    """(head, relation, tail): the first n distinct triples by seq of edges with an end in top (key)."""
    keys = top.select("key").distinct()
    near = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").unionByName(edges.join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")).distinct()
    named = near.join(nodes.select(F.col("key").alias("src"), F.col("name").alias("head")), "src").join(nodes.select(F.col("key").alias("dst"), F.col("name").alias("tail")), "dst")
    return named.groupBy("head", "relation", "tail").agg(F.min("seq").alias("seq")).orderBy("seq", "head", "relation", "tail").limit(n).select("head", "relation", "tail")


def short_ids(chunks: DataFrame, by: str = "quiz_id") -> DataFrame:
    """`chunks` (ord) with citation ids C001, C002, ... by position. A group of any size is numbered in ranges; give keys rather than texts."""
    return running(chunks, by, ["ord", "chunk_id"], F.lit(0)).drop("total").withColumn("short_id", F.format_string("C%03d", "place")).drop("place")


def _id_lengths(place: Column) -> Column:
    """Characters of the citation ids up to a place: four each, and one more for each digit beyond three."""
    return sum((F.greatest(place - (10**d - 1), F.lit(0)) for d in range(3, 18)), 4 * place)


def validate_questions(items: DataFrame, id_map: DataFrame, wanted: list[str], num_questions: int = 10) -> DataFrame:
    """Of items (quiz_id, seq, question_type, question_text, options, correct_answer, sources) those that hold, num_questions a quiz.

    The type must be wanted, text and answer not blank, multiple choice needs two options, and a source must be known
    in id_map (quiz_id, short_id, chunk_id); sources become chunk ids in the order given.
    """
    sound = items.where(
        F.col("question_type").isin(*wanted)
        & (strip(F.coalesce("question_text", F.lit(""))) != "")
        & (strip(F.coalesce("correct_answer", F.lit(""))) != "")
        & ((F.col("question_type") != "multiple_choice") | (F.size("options") >= 2))
    )
    cited = sound.select("quiz_id", "seq", F.posexplode("sources").alias("pos", "short_id")).join(id_map, ["quiz_id", "short_id"])
    known = cited.groupBy("quiz_id", "seq").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))).alias("all")).select("quiz_id", "seq", F.transform("all", lambda x: x["chunk_id"]).alias("source_chunk_ids"))
    ranked = sound.drop("sources").join(known, ["quiz_id", "seq"]).withColumn("_turn", F.row_number().over(Window.partitionBy("quiz_id").orderBy("seq")))
    return ranked.where(F.col("_turn") <= num_questions).drop("_turn")


def grade(questions: DataFrame, submissions: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """(quiz_id, question_id, user_answer, is_correct, score): every question of every quiz, unanswered ones with a blank answer.

    True or false and multiple choice by equality without case or white space at the ends; choices also by their letter.
    Short answers by a judge's response (question_id, raw) if it can be read, else by one and a half times the share of
    the right answer's distinct words given, at most 1; half is enough. A blank answer is wrong.
    """
    joined = questions.join(submissions.select("quiz_id", "question_id", "user_answer"), ["quiz_id", "question_id"], "left").withColumn("user_answer", F.coalesce("user_answer", F.lit("")))
    if responses is None:
        joined = joined.withColumn("item", F.lit(None).cast("variant"))
    else:
        joined = joined.join(responses.select("quiz_id", "question_id", F.get(parse_items("raw"), F.lit(0)).alias("item")), ["quiz_id", "question_id"], "left")
    right, given = F.lower(strip("correct_answer")), F.lower(strip("user_answer"))
    exact = (given == right) | ((F.col("question_type") != "true_false") & (F.length(given) == 1) & F.startswith(right, F.concat(given, F.lit(")"))))
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"(?U)\s+"), lambda w: w != ""))
    n = F.size(bag("correct_answer"))
    overlap = F.when(n > 0, F.least(F.size(F.array_intersect(bag("correct_answer"), bag("user_answer"))) / n * 1.5, F.lit(1.0))).otherwise(0.0)
    verdict = F.try_variant_get("item", "$.is_correct", "variant")
    judged = F.coalesce(truthy(verdict), F.lit(False))
    judged_score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get("item", "$.score", "double"), F.when(judged, 1.0).otherwise(0.0))))
    short, blank = F.col("question_type") == "short_answer", F.col("user_answer") == ""
    score = F.when(~short, F.when(exact, 1.0).otherwise(0.0)).when(blank, 0.0).when(F.col("item").isNotNull(), judged_score).otherwise(overlap)
    correct = F.when(~short, exact).when(blank, False).when(F.col("item").isNotNull(), judged).otherwise(overlap >= 0.5)
    return joined.select("quiz_id", "question_id", "user_answer", correct.alias("is_correct"), score.alias("score"))


def quiz_totals(results: DataFrame) -> DataFrame:
    """(quiz_id, score, correct, total): the mean score in per cent to one digit, half to even."""
    return results.groupBy("quiz_id").agg(F.bround(F.avg("score") * 100, 1).alias("score"), F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total"))


def public_view(questions: DataFrame) -> DataFrame:
    """Questions without what gives their answers away."""
    return questions.drop("correct_answer", "rubric", "hint")


def sourced_first(evidence: DataFrame, sourced: DataFrame) -> DataFrame:
    """Evidence (question_id, chunk_id, rank) ranked anew: chunks that the question came from (sourced) before the others."""
    flagged = evidence.join(sourced.select("question_id", "chunk_id").distinct().withColumn("_own", F.lit(0)), ["question_id", "chunk_id"], "left")
    order = Window.partitionBy("question_id").orderBy(F.coalesce("_own", F.lit(1)), "rank", "chunk_id")
    return flagged.withColumn("new_rank", F.row_number().over(order)).drop("rank", "_own").withColumnRenamed("new_rank", "rank")


def quiz_context(chunks: DataFrame, triples: DataFrame, budget: int = 24000) -> tuple[DataFrame, DataFrame]:
    """(lines (quiz_id, ord, line), id map (quiz_id, short_id, chunk_id)): numbered chunks, then relationships, in one budget.

    chunks: quiz_id, chunk_id, ord, page, text. Relationships (quiz_id, ord, line) take what the chunks that fit leave.
    """
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" (p. "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    order = ["ord", "chunk_id"]
    # lines but for their ids, whose lengths follow from their places
    cut = cuts(chunks, "quiz_id", order, 3 + F.length(page) + F.length("text"), budget, extra=_id_lengths(F.col("place"))).checkpoint()
    # what fits is bounded by the budget, so numbers can be given within it
    position = F.row_number().over(Window.partitionBy("quiz_id").orderBy(*order))
    named = up_to(chunks, cut, "quiz_id", order).withColumn("short_id", F.format_string("C%03d", position))
    first = named.select("quiz_id", "ord", "short_id", "chunk_id", F.concat(F.lit("["), "short_id", F.lit("]"), page, F.lit(" "), "text").alias("line"), F.lit(0).alias("tier"))
    left = triples.join(cut.select("_group", "_fit"), F.col("quiz_id").eqNullSafe(F.col("_group")), "left").withColumn("_left", F.lit(budget) - F.coalesce("_fit", F.lit(0))).drop("_group", "_fit")
    below = cuts(left, "quiz_id", ["ord"], F.length("line"), F.col("_left"))
    rest = up_to(triples, below, "quiz_id", ["ord"]).withColumn("tier", F.lit(1))
    columns = ["quiz_id", "tier", "ord", "line"]
    return first.select(*columns).unionByName(rest.select(*columns)), first.select("quiz_id", "short_id", "chunk_id")


def deep_dive_context(dense: DataFrame, graph: DataFrame, sourced: DataFrame, chunks: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(question_id, chunk_id, rank): evidence of both kinds (question_id, chunk_id, rank), each chunk once, its own sources first, within max_chars."""
    both = dense.select("question_id", "chunk_id", F.struct(F.lit(0).alias("way"), F.col("rank").cast("long").alias("rank")).alias("at")).unionByName(graph.select("question_id", "chunk_id", F.struct(F.lit(1).alias("way"), F.col("rank").cast("long").alias("rank")).alias("at")))
    once = both.groupBy("question_id", "chunk_id").agg(F.min("at").alias("at"))
    ranked = once.select("question_id", "chunk_id", F.row_number().over(Window.partitionBy("question_id").orderBy("at", "chunk_id")).alias("rank"))
    sized = sourced_first(ranked, sourced).join(chunks.select("chunk_id", F.length("text").alias("_size")), "chunk_id")
    return running(sized, "question_id", ["rank"], F.col("_size")).where(F.col("total") <= max_chars).select("question_id", "chunk_id", "rank")
