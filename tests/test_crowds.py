"""Many queries at one node, many equal vectors, and texts that many questions meet: the cheaper ways give what the plain ones do."""

import numpy as np
from pyspark.sql import functions as F

from quillspan.operators import graph_walk as G
from quillspan.operators import retrieval as R
from quillspan.operators import similarity as V


def _plain_best(scores, k):
    rounded = np.nan_to_num(np.round(scores, 9), nan=-np.inf)
    out = [(r, c) for r, own in enumerate(rounded) for c in sorted(range(len(own)), key=lambda c: (-own[c], c))[:k]]
    return out


def test_best_is_what_sorting_all_gives():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (7, 3), (300, 5), (1000, 2), (1025, 7)):
        scores = np.round(rng.normal(size=(9, n)), 2) + rng.normal(size=(9, n)) * 1e-11
        scores[0, : n // 2], scores[1], scores[2, 0], scores[3, -1] = np.nan, 0.25, np.inf, -np.inf
        assert list(zip(*(x.tolist() for x in V._best(scores, k)), strict=True)) == _plain_best(scores, k)


def test_equal_vectors_give_as_many_rows_as_asked_for(spark):
    vectors = spark.range(60).select(F.col("id"), F.array((F.col("id") % 3).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    ids, classes = V.vector_classes(vectors)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id long, embedding array<float>")
    best = V.topk(classes.select(F.col("cls").alias("id"), "embedding"), queries, 5).select("query_id", F.col("id").alias("cls"), "score")
    sizes = ids.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    # 20 members in the nearest class: no other is needed
    assert sorted((r.query_id, r.cls) for r in V._enough(best, ("query_id",), sizes, ["cls"], 5).collect()) == [(1, 2), (2, 0)]
    found = V.topk_of_classes(ids, classes, queries, 5).select("query_id", "id", "rank")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, V.topk(vectors, queries, 5).select("query_id", "id", "rank").collect()))


def test_walk_is_the_same_where_queries_crowd(spark, monkeypatch):
    nodes = spark.range(40).select(F.concat(F.lit("n"), F.col("id")).alias("key"), F.lit("content").alias("node_type"), F.array((F.col("id") % 7).cast("float"), (F.col("id") % 5).cast("float")).alias("embedding"))
    edges = spark.range(40).select(F.concat(F.lit("n"), F.col("id")).alias("src"), F.explode(F.expr("transform(array(3, 7, 11), k -> 'n' || ((id * k + 1) % 40))")).alias("dst"), F.lit("RELATED_TO").alias("relation"), F.lit("x").alias("label"))
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 1.0])], "query_id long, embedding array<float>")
    starts = queries.select("query_id", F.explode(F.array(F.lit("n1"), F.lit("n2"))).alias("node"))
    plain = [sorted(map(tuple, x.collect()), key=str) for x in G.walk(queries, starts, nodes, edges, 2, 0.0, 3)]
    asked = []
    within = G.topk_within
    monkeypatch.setattr(G, "topk_within", lambda *a: (asked.append(1), within(*a))[1])
    monkeypatch.setattr(G, "PAIRS_AT_NODE", 0)
    assert [sorted(map(tuple, x.collect()), key=str) for x in G.walk(queries, starts, nodes, edges, 2, 0.0, 3)] == plain
    assert asked


def test_pairs_are_scored_without_their_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "ASKERS", 2)
    questions = spark.createDataFrame([(i, f"Mass and word{i} mass") for i in range(7)] + [(8, None), (9, " ")], "query_id long, question string")
    chunks = spark.createDataFrame([("a", "mass, WORD3 of things"), ("b", None), ("c", "and")], "chunk_id string, text string")
    pairs = questions.select("query_id").crossJoin(chunks.select("chunk_id")).unionByName(spark.createDataFrame([(1, "gone"), (77, "a")], "query_id long, chunk_id string")).withColumn("rank", F.lit(1))
    plain = R.with_pair_scores(pairs.join(chunks, "chunk_id").join(questions, "query_id")).select("query_id", "chunk_id", "rank", "logit")
    assert sorted(map(tuple, R.scored_pairs(pairs, questions, chunks).select("query_id", "chunk_id", "rank", "logit").collect())) == sorted(map(tuple, plain.collect()))
