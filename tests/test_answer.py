"""The flow from questions to contexts on a few rows whose results are plain to see."""

import numpy as np
from pyspark.sql import functions as F

from quillspan.operators import similarity as V
from quillspan.operators.answer import answer_context


def _inputs(spark):
    embed = lambda df: V.embed(df, features=4096)
    chunks = spark.createDataFrame([("c1", "pdf", "mass measures inertia"), ("c2", "pdf", "cells divide"), ("c3", "video", "apples fall down")], "chunk_id string, modality string, text string")
    vectors = embed(chunks.select(F.col("chunk_id").alias("id"), "text")).drop("text")
    nodes = spark.createDataFrame(
        [("topic:gravity", "topic", "gravity", 0, ["gravity"], ["c3", "gone"]), ("topic:cells", "topic", "cells", 1, ["cells"], ["c2"]), ("content:pull", "content", "gravity pull", 2, ["tides"], ["c1"])],
        "key string, node_type string, name string, seq long, key_terms array<string>, source_ids array<string>",
    )
    nodes = embed(nodes.withColumn("text", F.col("name"))).drop("text")
    edges = spark.createDataFrame([("topic:gravity", "content:pull", "RELATED_TO", "explains")], "src string, dst string, relation string, label string")
    questions = spark.createDataFrame([(1, "What is mass"), (2, "Why does gravity act"), (3, "  "), (4, "mass and gravity"), (5, "What is mass"), (None, "What is mass"), (6, None)], "query_id long, text string")
    responses = spark.createDataFrame([(4, '{"sub_questions": ["What is mass", "Why does gravity act"]}'), (2, "no list")], "query_id long, raw string")
    judged = spark.createDataFrame([(5, 0, '{"is_relevant": false}'), (1, 0, "not readable")], "query_id long, sub_id int, raw string")
    return questions, chunks, vectors, nodes, edges, embed, responses, None, judged


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_modes_evidence_and_gate(spark):
    found = answer_context(*_inputs(spark), k=1, threshold=0.3)
    assert _rows(found.modes, "query_id", "mode") == [(1, "dense"), (2, "graph"), (3, "dense"), (4, "hybrid"), (5, "dense"), (6, "dense")]
    kept = {(q, c): s for q, c, s in _rows(found.evidence, "query_id", "chunk_id", "source")}
    assert kept[1, "c1"] == "dense" and kept[2, "c3"] == "graph"
    # the first sub-question that found a chunk gives its source; a chunk that isn't stored is skipped
    assert kept[4, "c1"] == "dense" and kept[4, "c3"] == "graph"
    assert {q for q, _ in kept} == {1, 2, 4} and all(c != "gone" for _, c in kept)
    assert set(_rows(found.triples, "query_id", "head", "relation", "tail")) <= {(q, "gravity", "explains", "gravity pull") for q in (2, 4)}
    assert {q for q, _ in _rows(found.nodes, "query_id", "node")} == {2, 4}
    assert [line for q, r, line in _rows(found.context, "query_id", "rank", "line") if (q, r) == (1, 1)] == ["[1] (pdf) mass measures inertia"]


def test_a_forced_mode_skips_routing_and_gate(spark):
    found = answer_context(*_inputs(spark), forced_mode="dense", k=1)
    assert {m for _, m in _rows(found.modes, "query_id", "mode")} == {"dense"}
    assert (5, "c1", "dense") in _rows(found.evidence, "query_id", "chunk_id", "source")
    assert found.triples.count() == 0 and found.nodes.count() == 0


def test_no_questions_and_no_graph(spark):
    questions, chunks, vectors, nodes, edges, embed, responses, _, judged = _inputs(spark)
    none = answer_context(questions.limit(0), chunks, vectors, nodes, edges, embed)
    assert none.modes.count() == none.evidence.count() == none.context.count() == 0
    bare = answer_context(questions.where("query_id = 2"), chunks, vectors, nodes.limit(0), edges, embed)
    assert bare.evidence.count() == 0 and _rows(bare.modes, "query_id", "mode") == [(2, "graph")]


def test_variants_share_one_run_and_equal_their_own(spark):
    from quillspan.operators import evaluation as E

    questions, chunks, vectors, nodes, edges, embed, responses, classes, judged = _inputs(spark)
    got = E.variant_evidence(questions, chunks, vectors, nodes, edges, embed, responses, classes, judged, k=1, threshold=0.3).checkpoint()
    columns = ("query_id", "chunk_id", "source", "rank", "relevancy_score")
    for name, options in (("dense", {"forced_mode": "dense"}), ("graph", {"forced_mode": "graph"}), ("full", {"judged": judged})):
        alone = answer_context(questions, chunks, vectors, nodes, edges, embed, responses, classes, k=1, threshold=0.3, **options)
        assert _rows(got.where(f"variant = '{name}'"), *columns) == _rows(alone.evidence, *columns)
    # the gate drops what is judged irrelevant and nothing else
    gated, dense = (_rows(got.where(f"variant = '{v}'"), *columns) for v in ("gated", "dense"))
    assert gated == [r for r in dense if r[0] != 5] and len(gated) < len(dense)
    relevant = spark.createDataFrame([(1, "c1"), (2, "c3"), (5, "c1"), (6, "c9")], "query_id long, chunk_id string")
    verdicts = spark.createDataFrame([("full", True, True), ("full", False, True)], "system string, is_supported boolean, is_useful boolean")
    table = {r.metric: r for r in E.compare_variants(got, relevant, questions, verdicts).collect()}
    good = {(r.query_id, r.chunk_id) for r in relevant.collect()}
    for v in ("dense", "graph", "gated", "full"):
        rows = [(q, c, r) for q, c, _, r, _ in _rows(got.where(f"variant = '{v}'"), *columns)]
        first = {q: min([r for p, c, r in rows if p == q and (p, c) in good], default=None) for q in (1, 2, 3, 4, 5, 6)}
        assert abs(table["mrr"][v] - sum(1 / r for r in first.values() if r) / 6) < 1e-9
        assert abs(table["hit_rate"][v] - sum(r is not None and r <= 5 for r in first.values()) / 6) < 1e-9
        shares = [[(p, c) in good for p, c, _ in rows if p == q] for q in first]
        assert abs(table["precision"][v] - sum(sum(s) / len(s) for s in shares if s) / 6) < 1e-9
    assert table["supported"]["full"] == 0.5 and table["useful"]["dense"] is None


def test_an_encoder_is_fitted_once_and_kept(spark, tmp_path):
    corpus = spark.createDataFrame([("a b",), ("a c",), ("a a d",), (None,)], "text string")
    encoder = V.fit_encoder(corpus, 4096)
    encoder.save(str(tmp_path / "encoder"))
    asked = spark.createDataFrame([("b",), ("c d",), ("a",), ("",)], "text string")
    for e in (encoder, V.load_encoder(str(tmp_path / "encoder"))):
        b, cd, a, none = (r.embedding for r in e.encode(asked).collect())
        assert max(b) == 1.0 and sorted(x for x in cd if x) == [np.float32(0.5**0.5)] * 2 and max(none) == 0.0 and max(a) == 1.0
    # weights are the corpus's, whatever is encoded: log(5 / 4) for a, log(5 / 2) for b
    mixed = sorted((x for x in encoder.encode(spark.createDataFrame([("a b",)], "text string")).first().embedding if x), reverse=True)
    assert abs(mixed[1] / mixed[0] - np.log(5 / 4) / np.log(5 / 2)) < 1e-6


def test_relevance_is_asked_of_what_was_found(spark):
    """Pairs of equal labels that nothing found are not made."""
    from quillspan.plans import queries_graph as P

    embeddings = spark.range(400).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"))
    found = spark.createDataFrame([(10, 3), (10, 4), (10, 4), (20, 399), (5, 7)], "query_id long, id long")
    assert sorted(map(tuple, P._relevant(embeddings, found).collect())) == [(10, 4)]
