"""Graph, retrieval and quiz operators on small literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import graph_build as B
from quillspan.operators import graph_walk as G
from quillspan.operators import quiz as Q
from quillspan.operators import retrieval as R
from quillspan.operators import similarity as V

NODE = "key string, node_type string, name string, summary string, scope string, content_type string, raw_excerpt string, key_terms array<string>, source_ids array<string>, seq long"


def props(spark, *rows):
    return spark.createDataFrame([(k, "topic", n, s, scope, "other", "", terms, ids, seq) for k, n, s, scope, terms, ids, seq in rows], NODE)


def test_merging_twice_changes_nothing(spark):
    first = props(spark, ("k", "Old", "abc", "broad", ["X"], ["c1"], 1))
    new = props(spark, ("k", "New", "abcd", "narrow", ["x", "Y"], ["c2", "c1"], 2), ("k", "Third", "wxyz", "broad", None, ["c3"], 3), ("m", "M", "", None, [], [], 4))
    merged, counters = B.merge_nodes(first, new)
    row = {r.key: r for r in merged.collect()}
    assert (row["k"].name, row["k"].summary, row["k"].scope, row["k"].key_terms, row["k"].source_ids) == ("Old", "abcd", "narrow", ["X", "Y"], ["c1", "c2", "c3"])
    assert tuple(counters.first()) == (1, 2)
    from pyspark.sql import functions as F

    again, _ = B.merge_nodes(merged.withColumn("seq", F.lit(0).cast("long")).select(*first.columns), new)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))


def test_pruning_pyramids(spark):
    def graph(t, s, c):
        names = [("topic", i) for i in range(t)] + [("subtopic", i) for i in range(s)] + [("content", i) for i in range(c)]
        nodes = spark.createDataFrame([(f"{k}{i}", k, n) for n, (k, i) in enumerate(names)], "key string, node_type string, seq long")
        return nodes, spark.createDataFrame([("topic0", "subtopic0")], "src string, dst string")

    for size, want in (((1, 2, 3), (1, 2, 3)), ((3, 3, 4), (2, 3, 4)), ((1, 4, 4), (1, 3, 4))):
        kept = B.prune_to_ratio(*graph(*size))[0].groupBy("node_type").count().collect()
        counts = {r.node_type: r["count"] for r in kept}
        assert tuple(counts.get(k, 0) for k in ("topic", "subtopic", "content")) == want


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "HAS_SUBTOPIC"), ("b", "c", "HAS_SUBTOPIC"), ("c", "a", "HAS_SUBTOPIC"), ("a", "z", "RELATED_TO")], "src string, dst string, relation string")
    got = {(r.node, r.depth) for r in G.closure(edges, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("b", 1), ("c", 2)}


def test_walk_keeps_parallel_edges_and_thresholds(spark):
    nodes = spark.createDataFrame([("a", "topic", [1.0, 0.0]), ("b", "content", [1.0, 0.0]), ("c", "content", [0.0, 1.0]), ("d", "content", [0.9, 0.1])], "key string, node_type string, embedding array<float>")
    edges = spark.createDataFrame([("a", "b", "HAS_CONTENT", None), ("b", "a", "RELATED_TO", "x"), ("a", "b", "RELATED_TO", "y"), ("a", "c", "HAS_CONTENT", None), ("b", "d", "HAS_CONTENT", None)], "src string, dst string, relation string, label string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    reached, kept = G.walk(asked, spark.createDataFrame([(1, "a")], "query_id long, node string"), nodes, edges)
    assert {(r.node, r.hop) for r in reached.collect()} == {("a", 0), ("b", 1), ("d", 2)} and kept.count() == 4


def test_components_and_collapse(spark):
    nodes = spark.createDataFrame([(k, "topic" if k in "ad" else "content") for k in "abcdef"], "key string, node_type string")
    edges = spark.createDataFrame([("a", "b", "HAS_CONTENT"), ("c", "b", "RELATED_TO"), ("d", "b", "HAS_CONTENT"), ("a", "e", "HAS_CONTENT")], "src string, dst string, relation string")
    assert {r.key: r.component for r in G.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "f": "f"}
    shown, hidden = G.collapse(nodes, edges, spark.createDataFrame([("a",)], "key string"))
    assert {r.key for r in shown.collect()} == set("abcdf") and hidden.first().hidden == 1


def test_similarity_by_numpy(spark):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(60, 8))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id long, embedding array<double>")
    scores = matrix @ matrix.T
    got = {(r.query_id, r["rank"]): r.id for r in V.topk(rows, rows.withColumnRenamed("id", "query_id"), 3).collect()}
    assert all(got[(i, k + 1)] == np.argsort(-scores[i], kind="stable")[k] for i in range(60) for k in range(3))
    pairs = {(r.a, r.b) for r in V.band_join(rows, 0.4, 0.8, blocks=3).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if 0.4 <= scores[i, j] <= 0.8}


def test_embedding_hooks(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    assert abs(sum(x * x for x in V.embed(texts).orderBy("id").first().embedding) - 1) < 1e-6
    plugged = V.embed(texts, embed_fn=lambda s: np.array([[len(x), 1.0] for x in s])).orderBy("id").collect()
    assert abs(plugged[0].embedding[0] - 3 / 10**0.5) < 1e-6 and plugged[1].embedding == [0.0, 1.0]
    pairs = spark.createDataFrame([(1, "c", 1, "red fox", "the red fox ran"), (1, "d", 2, "red fox", "nothing")], "query_id int, chunk_id string, rank int, question string, text string")
    assert [r.chunk_id for r in R.rerank(R.with_pair_scores(pairs), min_relevancy=0.5).collect()] == ["c"]
    scored = R.with_pair_scores(pairs, lambda q, t: (t == "nothing") * 5.0)
    assert [r.chunk_id for r in R.rerank(scored).orderBy("rank").collect()] == ["d", "c"]


def test_hybrid_and_citations(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    graph = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], dense.schema)
    merged = R.hybrid_merge(dense, graph)
    assert [(r.chunk_id, r.source) for r in merged.orderBy("rank").collect()] == [("a", "dense"), ("b", "both"), ("c", "graph")]
    answers = spark.createDataFrame([(1, "x [3][1][3][99]")], "query_id int, answer string")
    assert [r.chunk_id for r in R.citations(answers, merged).orderBy("ord").collect()] == ["c", "a"]


def test_grading(spark):
    questions = spark.createDataFrame([("z", "1", "true_false", "True"), ("z", "2", "multiple_choice", "B) Paris"), ("z", "3", "short_answer", "the red fox ran"), ("z", "4", "short_answer", "water"), ("z", "5", "true_false", "false")], "quiz_id string, question_id string, question_type string, correct_answer string")
    given = spark.createDataFrame([("z", "1", " true "), ("z", "2", "b"), ("z", "3", "red fox"), ("z", "4", "ice")], "quiz_id string, question_id string, user_answer string")
    judged = spark.createDataFrame([("z", "4", '{"is_correct": true, "score": 7}')], "quiz_id string, question_id string, raw string")
    got = {r.question_id: (r.is_correct, r.score) for r in Q.grade(questions, given, judged).collect()}
    assert got == {"1": (True, 1.0), "2": (True, 1.0), "3": (True, 0.75), "4": (True, 1.0), "5": (False, 0.0)}
    assert tuple(Q.quiz_totals(Q.grade(questions, given, judged)).first()) == ("z", 75.0, 4, 5)


def test_ratio_query_over_the_whole_graph(spark):
    import __spark_entry__ as entry
    from quillspan.plans.fixtures import view

    sf = "/root/testdata/sf0.001"
    nodes = {r.key: ("topic" if r.node_type == "content" and r.seq % 3 == 0 else r.node_type, r.seq) for r in view(spark, sf, "nodes").collect()}
    edges = [(r.src, r.dst) for r in view(spark, sf, "tree").collect()]
    while True:
        tiers = {t: [k for k, (kind, _) in nodes.items() if kind == t] for t in ("topic", "subtopic", "content")}
        large = next(((u, v) for u, v in (("topic", "subtopic"), ("subtopic", "content")) if tiers[v] and len(tiers[u]) >= len(tiers[v])), None)
        if large is None:
            break
        upper, lower = (tiers[t] for t in large)
        degree = {k: sum((a == k) + (b == k) for a, b in edges) for k in upper}
        for k in sorted(upper, key=lambda k: (degree[k], nodes[k][1]))[: len(upper) - len(lower) + 1]:
            del nodes[k]
        edges = [(a, b) for a, b in edges if a in nodes and b in nodes]
    assert sorted(r.key for r in entry.queries()["g10_ratio_all"](spark, sf).collect()) == sorted(nodes)


def test_band_join_of_new_with_all_by_numpy(spark):
    matrix = np.random.default_rng(7).normal(size=(60, 8))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id long, embedding array<double>")
    scores, new = matrix @ matrix.T, {3, 10, 11, 59}
    ids = spark.createDataFrame([(i,) for i in [*new, 3, 999]], "id long")
    for blocks in (None, 3):
        got = [(r.a, r.b) for r in V.band_join(rows, 0.2, 0.8, blocks=blocks, new_ids=ids).collect()]
        assert sorted(got) == [(i, j) for i in range(60) for j in range(i + 1, 60) if 0.2 <= scores[i, j] <= 0.8 and {i, j} & new]
    assert V.band_join(rows, 0.2, 0.8, new_ids=ids.limit(0)).collect() == []


def test_synonyms_query_takes_every_vector(spark):
    import __spark_entry__ as entry
    from quillspan.plans.fixtures import view

    sf = "/root/testdata/sf0.001"
    rows = {r.id: np.array(r.embedding, np.float64) for r in view(spark, sf, "vectors").collect()}
    want = {}
    for i in (i for i in rows if i % 2):
        score, name = min((-round(float(rows[i] @ v), 9), f"v{j}") for j, v in rows.items() if j % 2 == 0)
        want[f"v{i}"] = name if -score >= 0.35 else f"v{i}"
    assert {r.name: r.resolved for r in entry.queries()["v7_synonyms_all"](spark, sf).collect()} == want


def test_components_query_keeps_every_edge(spark):
    import __spark_entry__ as entry
    from quillspan.plans.fixtures import view

    sf = "/root/testdata/sf0.001"
    label = {r.node: r.component for r in entry.queries()["g19_components"](spark, sf).select(F.col("key").alias("node"), "component").collect()}
    keys = {r.key for r in view(spark, sf, "nodes").collect()}
    assert set(label) == keys and all(label[r.src] == label[r.dst] for r in view(spark, sf, "tree").collect() if {r.src, r.dst} <= keys)


def test_topk_keeps_lengths_and_near_ties_and_closure_tells_its_bound(spark):
    import pytest

    # in one part: a malformed vector first, then copies that differ by less than the score's nine digits
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = spark.createDataFrame([(0, [1.0]), *((i, [1.0, i * 1e-12]) for i in range(1, 6))], "id long, embedding array<double>")
        asked = spark.createDataFrame([(7, [0.5, 1.0])], "query_id long, embedding array<double>")
        assert [r.id for r in V.topk(rows, asked, 2).orderBy("rank").collect()] == [1, 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "HAS_SUBTOPIC") for i in range(4)], "src string, dst string, relation string")
    roots = spark.createDataFrame([("n0",)], "root string")
    assert G.closure(chain, roots, max_depth=4).count() == 4
    with pytest.raises(ValueError):
        G.closure(chain, roots, max_depth=3)


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_topk_and_band_join_with_text_ids_and_empty_parts(spark, monkeypatch, limit):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "PART_VECTORS", 4)
    monkeypatch.setattr(V, "ROWS_AT_ONCE", 2)
    rng = np.random.default_rng(6)
    rows = [(f"v{i:02d}", [float(x) for x in rng.normal(size=4)]) for i in range(20)] + [("v00copy", None), ("short", [1.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    rows.append(("twin", rows[3][1]))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        corpus = spark.createDataFrame(rows, "id string, embedding array<double>")
        asked = corpus.withColumnRenamed("id", "query_id").where("query_id IS NOT NULL")
        sound = [(i, np.array(v)) for i, v in rows if i and v and len(v) == 4]
        want = {q: sorted((-round(float(v @ w), 9), i) for i, w in sound)[:3] for q, v in sound} | {"short": [(-1.0, "short")]}
        got = {}
        for r in V.topk(corpus, asked, 3, limit).collect():
            got.setdefault(r.query_id, []).append((r["rank"], -round(r.score, 9), r.id))
        assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want
        assert V.topk(corpus, asked.limit(0), 3, limit).collect() == V.topk(corpus.limit(0), asked, 3, limit).collect() == []
        pairs = {(r.a, r.b) for r in V.band_join(corpus, 0.5, 9.0).collect()}
        assert pairs == {(i, j) for i, v in sound for j, w in sound if i < j and 0.5 <= v @ w <= 9.0}
        assert V.band_join(corpus.limit(0)).collect() == []
        unit = corpus.where("size(embedding) = 4").withColumn("embedding", F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y))))
        exact, near = ({(r.a, r.b) for r in found.collect()} for found in (V.band_join(unit, 0.7, 1.1), V.near_band_join(unit, 0.7, 1.1)))
        assert near <= exact and len(near) >= 0.9 * len(exact)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_anchors_in_pools_out_of_pools_and_without_pools(spark):
    """By brute force: hits of the pool by seq, others by score, nodes outside only where the pool is short, with a boost."""
    rng = np.random.default_rng(8)
    unit = lambda: [float(x) for x in (lambda v: v / np.linalg.norm(v))(rng.normal(size=3))]
    names = ["cell", "Cell Wall", "", "gene", "RNA", "protein fold", "lipid", "enzyme", "acid", "base"]
    nodes = [(f"n{i}", "content", name, [" Mito ", "", "x" * 40] if i == 6 else None, i * 7 % 10, unit()) for i, name in enumerate(names)]
    queries = [(1, "the CELL wall and mito", unit()), (2, "rna", unit()), (3, None, unit()), (4, "enzyme acid base gene", unit()), (5, "Protein Fold", unit())]
    pool = [(1, n) for n in ("n0", "n4", "n5", "n6", "n7")] + [(2, "n3"), (4, "n7"), (4, "n8"), (4, "gone"), (5, "n1"), (5, "n5")]
    df = spark.createDataFrame(nodes, "key string, node_type string, name string, key_terms array<string>, seq int, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id int, text string, embedding array<double>")

    def brute(pools, k=3, boost=0.15):
        out = set()
        for q, text, v in queries:
            own = {n for i, n in pools if i == q} & {n[0] for n in nodes} or {n[0] for n in nodes}
            rows = []
            for key, _, name, terms, seq, w in nodes:
                low = (text or "").lower()
                hit = bool(text) and any(x and x in low for x in [name.lower(), *(t.strip().lower() for t in terms or [])])
                if key in own or len(own) < k:
                    first = key in own and hit
                    rows.append((not first, seq if first else 0, -round(float(np.dot(v, w)) + (boost if hit and key not in own else 0), 9), key))
            out |= {(q, r[3], k + 1) for k, r in enumerate(sorted(rows)[:k])}
        return out

    for pools in ([], pool):
        table = spark.createDataFrame(pools, "query_id int, node string") if pools else None
        assert {tuple(r) for r in G.anchors(asked, df, table).collect()} == brute(pools)
