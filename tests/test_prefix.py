"""Two-level running totals, and the budgets that use them."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.operators import prefix
from quillspan.operators import quiz as Q
from quillspan.operators import retrieval as R
from quillspan.operators import similarity as V


def test_running_totals_by_plain_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randint(0, 9)) for i in rng.sample(range(5000), 3000)]
    frame = spark.createDataFrame(rows, "g string, i long, n long")
    want, sums = [], {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        place, total = sums.get(g, (0, 0))
        sums[g] = (place + 1, total + n)
        want.append((g, i, n, *sums[g]))
    assert sorted(map(tuple, prefix.running(frame, "g", ["i"], F.col("n")).collect()), key=repr) == sorted(want, key=repr)
    assert prefix.running(frame.limit(0), "g", ["i"], F.col("n")).collect() == []


def test_a_hot_group_has_many_ranges(spark):
    frame = spark.range(40_000).select(F.lit("hot").alias("g"), F.col("id").alias("i"), F.lit(1).alias("n"))
    keys = [F.asc("g"), F.asc("i")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in frame.repartitionByRange(*keys).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 10_000
        assert prefix.running(frame, "g", ["i"], F.col("n")).where("place <> i + 1 OR total <> i + 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_contexts_end_where_the_budget_does(spark):
    ranked = spark.createDataFrame([(1, r, "pdf", "x" * n) for r, n in ((1, 10), (2, 10), (3, 1), (4, 1))] + [(2, 1, "pdf", "y" * 99), (None, 1, "pdf", "z")], "query_id long, rank int, modality string, text string")
    got = {(r.query_id, r.rank): r.line for r in R.pack_context(ranked, 45).collect()}
    assert got == {(1, 1): "[1] (pdf) " + "x" * 10, (1, 2): "[2] (pdf) " + "x" * 10, (1, 3): R.MORE.replace("{rank}", "3"), (2, 1): R.MORE.replace("{rank}", "1"), (None, 1): "[1] (pdf) z"}
    assert len(R.pack_context(ranked, 45, marker=False).collect()) == 3
    kept = {(r.query_id, r.rank) for r in R.prefix_by_length(ranked, "query_id", 20).collect()}
    assert kept == {(1, 1), (1, 2), (2, 1), (None, 1)} and len(R.prefix_by_length(ranked, "query_id", 20, keep_first=False).collect()) == 3


def test_quiz_ids_count_towards_the_budget(spark):
    assert spark.range(1).select(*(Q._id_lengths(F.lit(p)).alias(f"p{p}") for p in (1, 999, 1000, 10_001))).first() == (4, 3996, 4001, 4 * 10_001 + 9002 + 2)
    chunks = spark.createDataFrame([("q", f"c{i:04}", i, None, "t") for i in range(1200)], "quiz_id string, chunk_id string, ord long, page int, text string")
    lines, ids = Q.quiz_context(chunks, spark.createDataFrame([("q", 1, "- one"), ("q", 2, "- longer line"), ("r", 1, "- other")], "quiz_id string, ord long, line string"), budget=8 * 999 + 9 * 3 + 6)
    found = lines.orderBy("tier", "ord").collect()
    assert [r.line for r in found if r.tier == 1 and r.quiz_id == "q"] == ["- one"] and [r.line for r in found if r.quiz_id == "r"] == ["- other"]
    assert [r.line for r in found if r.tier == 0][-1] == "[C1002] t" and ids.count() == 1002


def test_blocks_out_of_the_band_are_never_multiplied(spark):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(scale=0.02, size=12)).tolist()) for i in range(240)]
    rows += [(1000, [0.0] * 12), (1001, [1.0, 2.0]), (1002, [2.0, 1.0]), (1003, None), (1004, [float("nan")] * 12)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    for lo, hi in ((0.5, 20.0), (-0.2, 0.4), (-9.0, -0.01)):
        held = [(i, np.array(x)) for i, x in rows if x is not None]
        want = {(a, b) for a, x in held for b, y in held if a < b and len(x) == len(y) and lo <= float(x @ y) <= hi}
        assert {(r.a, r.b) for r in V.band_join(table, lo, hi, blocks=20).collect()} == want
    pivots = V._directions(table, 24)
    meet = V.cells_that_meet(*V._cell_bounds(table.where("embedding IS NOT NULL"), pivots), 0.5, 20.0)
    used = {int(c) for c in V._placed(V._flat(table.where("embedding IS NOT NULL AND size(embedding) = 12").toArrow()["embedding"]), pivots)[0] if c < len(pivots)}
    pairs = [(c, d) for c in used for d in used if c <= d]
    assert all(meet[c, c] for c in used) and sum(meet[c, d] for c, d in pairs) < 0.4 * len(pairs)


def test_a_focus_ranks_only_what_may_fit(spark):
    """not every quiz with every chunk; ties, empty texts and the first text that passes the budget keep their places."""
    rng = np.random.default_rng(11)
    rows = [(f"c{i:04}", rng.integers(0, 3, 4).astype(float).tolist(), int(i * 7 % 2000), int(rng.choice([0, 1, 5, 90]))) for i in range(2000)]
    corpus = spark.createDataFrame(rows, "id string, embedding array<float>, seq long, size long").repartition(3)
    asked = spark.createDataFrame([(q, rng.integers(-1, 3, 4).astype(float).tolist()) for q in range(40)] + [(99, None)], "query_id long, embedding array<float>")
    quizzes = {r.query_id: r.embedding for r in asked.collect() if r.embedding}
    want = set()
    for q, focus in quizzes.items():
        total = 0
        for rank, (chunk, _, _, size) in enumerate(sorted(rows, key=lambda r: (-np.dot(r[1], focus), r[2], r[0])), 1):
            total += size
            if total > 200 and rank > 1:
                break
            want.add((q, chunk, rank))
    for limit in (32 << 20, 0):
        near = V.nearest_within(corpus, asked, 200, limit)
        assert near.count() < 40 * 2000 / 10
    chunks = corpus.select(F.col("id").alias("chunk_id"), "seq", F.expr("repeat('x', cast(size as int))").alias("text"))
    got = Q.focus_context(asked.withColumnRenamed("query_id", "quiz_id"), corpus.select("id", "embedding"), chunks, 200)
    assert {tuple(r) for r in got.collect()} == want


def _hub_graph(spark):
    rng = np.random.default_rng(3)
    kinds = {f"t{i}": "topic" for i in range(3)} | {f"s{i}": "subtopic" for i in range(4)} | {f"c{i:03}": "content" for i in range(300)}
    vectors = rng.normal(size=(40, 5))
    rows = [(k, kind, f"name {k}", i, vectors[i % 40].tolist(), ["gone"]) for i, (k, kind) in enumerate(kinds.items())]
    nodes = spark.createDataFrame(rows, "key string, node_type string, name string, seq long, embedding array<float>, key_terms array<string>")
    contents = [k for k in kinds if k[0] == "c"]
    links = [(f"t{i % 3}", f"s{i}", "HAS_SUBTOPIC") for i in range(4)] + [(f"s{i}", c, "HAS_CONTENT") for i in range(4) for j, c in enumerate(contents) if j % (i + 2) == 0]
    links += [(a, b, "RELATED_TO") for a, b in zip(contents, contents[7:])] + [links[5]]
    edges = spark.createDataFrame([(*x, "l") for x in links], "src string, dst string, relation string, label string")
    asked = spark.createDataFrame([(q, "about name c007", rng.normal(size=5).tolist()) for q in range(12)], "query_id long, text string, embedding array<float>")
    return nodes, edges, asked


def test_hubs_and_scopes_give_what_pair_by_pair_does(spark, monkeypatch):
    """queries at one hub or of one scope meet its different vectors as matrices; results are those of every pair."""
    from quillspan.operators import graph_walk as G

    nodes, edges, asked = _hub_graph(spark)
    starts = asked.select("query_id", F.concat(F.lit("s"), (F.col("query_id") % 4).cast("string")).alias("node"))
    found = []
    for hub in (10**9, 3):
        monkeypatch.setattr(G, "HUB", hub)
        reached, kept = G.walk(asked, starts, nodes, edges, 3, 0.1, 6)
        found.append((sorted((r.query_id, r.node, r.hop, r["rank"]) for r in reached.collect()), sorted(map(tuple, kept.collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 100
    open_to = G.scopes(asked, nodes, edges, 0.05)
    assert open_to.members.count() < G.scope_topics(asked, nodes, edges, 0.05).count() / 2
    pairs = G.scope_topics(asked, nodes, edges, 0.05)
    assert pairs.count() == pairs.distinct().count()
    assert sorted(G.anchors(asked, nodes, open_to).collect()) == sorted(G.anchors(asked, nodes, pairs).collect())
    pool, vector = pairs.groupBy("query_id").agg(F.collect_set("node").alias("p")).collect(), {r.key: r.embedding for r in nodes.collect()}
    got = {(r.query_id, r["rank"]): r.node for r in G.anchors(asked, nodes, open_to).collect()}
    question = {r.query_id: r.embedding for r in asked.collect()}
    for q, own in pool:
        best = sorted(own, key=lambda n: (n != "c007", -round(float(np.dot(np.float64(vector[n]), np.float64(question[q]))), 9), n))[:3]
        assert [got[q, i] for i in (1, 2, 3)] == best
