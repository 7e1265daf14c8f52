"""Queries of similarity, graph, retrieval and quiz operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import evaluation as E
from quillspan.operators import graph_build as B
from quillspan.operators import graph_walk as G
from quillspan.operators import metrics as M
from quillspan.operators import quiz as Q
from quillspan.operators import retrieval as R
from quillspan.operators import similarity as V
from quillspan.operators.answer import answer_context
from quillspan.plans.registered import Register
from quillspan.session import stored
from quillspan.sources import store as S

register = Register()

_DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
_TOP = f"""top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM (SELECT query_id, v.id, {_DOT.format("q.embedding", "v.embedding")} AS score FROM vector_queries q, vectors v) QUALIFY rank <= 5)"""


@register.add("v2_topk", "vectors", "vector_queries", oracle=f"WITH {_TOP} SELECT query_id, id, round(score, 6) AS score, rank FROM top")
def topk(vectors, queries):
    return V.topk(vectors, queries, 5).withColumn("score", F.round("score", 6))


def _chunk_vectors(vectors):
    return vectors.select(F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("id"), "embedding")


@register.add("v3_dense_retrieval", "vectors", "vector_queries", "chunks", oracle=f"""WITH {_TOP.replace("v.id, list", "'doc_' || CAST(v.id AS STRING) AS id, list")}
  SELECT query_id, chunk_id, rank, modality, length(text) AS size FROM top JOIN chunks ON id = chunk_id""")
def dense_retrieval(vectors, queries, chunks):
    return R.dense_retrieve(queries, _chunk_vectors(vectors), chunks).select("query_id", "chunk_id", "rank", "modality", F.length("text").alias("size"))


@register.add("v4_v8_focus", "vectors", oracle=f"SELECT a.id, round({_DOT.format('a.embedding', 'b.embedding')}, 6) AS score FROM vectors a JOIN vectors b ON b.id = (a.id * 7 + 3) % 500")
def focus(vectors):
    other = vectors.select(F.col("id").alias("other"), F.col("embedding").alias("query_embedding"))
    return V.score_pairs(vectors.withColumn("other", (F.col("id") * 7 + 3) % 500).join(other, "other")).select("id", F.round("score", 6).alias("score"))


@register.add("v8_focus_ranking", "vectors", "vector_queries", "chunks", oracle=f"""WITH s AS (SELECT q.query_id AS quiz_id, c.chunk_id, c.seq, length(c.text) AS size, CASE WHEN v.id IS NULL THEN 1 ELSE 0 END AS tier, coalesce(-round({_DOT.format("q.embedding", "v.embedding")}, 9), 0) AS behind
    FROM vector_queries q CROSS JOIN chunks c LEFT JOIN vectors v ON 'doc_' || CAST(v.id AS STRING) = c.chunk_id AND v.id % 9 > 0),
  t AS (SELECT *, row_number() OVER w AS rank, sum(size) OVER w AS total FROM s WINDOW w AS (PARTITION BY quiz_id ORDER BY tier, behind, seq, chunk_id))
  SELECT quiz_id, chunk_id, rank FROM t WHERE total <= 24000 OR rank = 1""")
def focus_ranking(vectors, queries, chunks):
    """The chunks nearest to each focus as far as a quiz's budget goes; every ninth vector is missing."""
    return Q.focus_context(queries.withColumnRenamed("query_id", "quiz_id"), _chunk_vectors(vectors.where("id % 9 > 0")), chunks)


_BAND = f"""SELECT a.id AS a, b.id AS b, round({_DOT.format('a.embedding', 'b.embedding')}, 6) AS score FROM vectors a JOIN vectors b ON a.id < b.id
  WHERE {_DOT.format('a.embedding', 'b.embedding')} BETWEEN 0.3 AND 0.9"""


@register.add("v5_band_join", "vectors", oracle=_BAND)
def band(vectors):
    return V.band_join(vectors, 0.3, 0.9).withColumn("score", F.round("score", 6))


@register.add("v6_labels", "vectors", oracle=f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) - 1 AS rank FROM ({_BAND}) QUALIFY rank < 80)
  SELECT a, b, 'label_' || CAST(rank // 10 AS STRING) AS label FROM p WHERE rank % 10 < 7 AND rank % 10 <> 3""")
def labels(vectors):
    from pyspark.sql import Window

    pairs = V.band_join(vectors, 0.3, 0.9, max_pairs=80)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), "a", "b")) - 1)
    grid = ranked.select(F.floor(F.col("rank") / 10).cast("long").alias("batch"), (F.col("rank") % 10).cast("long").alias("index")).distinct()
    responses = grid.select("batch", "index", F.expr("CASE WHEN index = 3 THEN ' ' ELSE 'Label ' || batch END").alias("label"), F.expr("CASE WHEN index < 7 THEN 0.5D ELSE 0.1D END").alias("confidence"))
    return V.label_pairs(ranked, responses).select("a", "b", "label")


@register.add("v7_synonyms", "vectors", oracle=f"""WITH e AS (SELECT id, embedding FROM vectors WHERE id % 2 = 0), n AS (SELECT id, embedding FROM vectors WHERE id % 10 = 1),
  s AS (SELECT n.id AS name, e.id AS nearest, {_DOT.format('n.embedding', 'e.embedding')} AS score FROM n, e QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY round(score, 9) DESC, 'v' || CAST(e.id AS STRING)) = 1)
  SELECT 'v' || CAST(name AS STRING) AS name, 'v' || CAST(CASE WHEN score >= 0.35 THEN nearest ELSE name END AS STRING) AS resolved, round(score, 6) AS score FROM s""")
def synonyms(vectors):
    named = vectors.select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), "embedding", "id")
    return V.resolve_synonyms(named.where("id % 10 = 1").select("name", "embedding"), named.where("id % 2 = 0").select("name", "embedding"), 0.35).withColumn("score", F.round("score", 6))


@register.add("v7_synonyms_all", "vectors", oracle=f"""WITH s AS (SELECT n.id AS name, e.id AS nearest, {_DOT.format('n.embedding', 'e.embedding')} AS score FROM vectors n, vectors e WHERE n.id % 2 <> 0 AND e.id % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY round(score, 9) DESC, 'v' || CAST(e.id AS STRING)) = 1)
  SELECT 'v' || CAST(name AS STRING) AS name, 'v' || CAST(CASE WHEN score >= 0.35 THEN nearest ELSE name END AS STRING) AS resolved, round(score, 6) AS score FROM s""")
def synonyms_all(vectors):
    """Every row takes part: odd ids are names, even ids exist."""
    named = vectors.select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), "embedding", "id")
    return V.resolve_synonyms(named.where("id % 2 <> 0").select("name", "embedding"), named.where("id % 2 = 0").select("name", "embedding"), 0.35).withColumn("score", F.round("score", 6))


# --- graph ---------------------------------------------------------------------------------------------------------


@register.add("g1_merge_nodes", "proposals", oracle="""WITH p AS (SELECT *, CAST(seq % 4 = 1 AS INT) AS age0 FROM proposals),
  s AS (SELECT key, seq, CASE WHEN seq % 4 = 1 THEN 0 ELSE 1 END AS age, summary, scope, content_type, name FROM proposals)
  SELECT key, arg_max(summary, (length(summary), -age, -seq)) AS summary, CASE WHEN bool_or(scope = 'narrow') THEN 'narrow' ELSE 'broad' END AS scope,
         coalesce(arg_min(content_type, (age, seq)) FILTER (WHERE content_type <> 'other'), 'other') AS content_type, count(DISTINCT seq // 10) AS sources, any_value(terms) AS terms
  FROM s JOIN (SELECT key AS k, CASE WHEN min(name) LIKE 'zz' THEN 0 ELSE 2 END AS terms FROM proposals GROUP BY 1) ON k = key GROUP BY key""")
def merge_nodes(proposals):
    old, new = proposals.where("seq % 4 = 1"), proposals.where("seq % 4 <> 1")
    nodes, _ = B.merge_nodes(old, new)
    return nodes.select("key", "summary", "scope", "content_type", F.size("source_ids").cast("long").alias("sources"), F.size("key_terms").alias("terms"))


@register.add("g2_counters", "proposals", oracle="""SELECT (SELECT count(DISTINCT key) FROM proposals WHERE seq % 1000 <> 1 AND key NOT IN (SELECT key FROM proposals WHERE seq % 1000 = 1)) AS added,
  (SELECT count(*) FROM proposals WHERE seq % 1000 <> 1) - (SELECT count(DISTINCT key) FROM proposals WHERE seq % 1000 <> 1 AND key NOT IN (SELECT key FROM proposals WHERE seq % 1000 = 1)) AS merged""")
def counters(proposals):
    return B.merge_nodes(proposals.where("seq % 1000 = 1"), proposals.where("seq % 1000 <> 1"))[1]


@register.add("g3_subtopics", "proposals", oracle="SELECT arg_min(name, seq) AS name, arg_max(summary, (length(summary), -seq)) AS summary, min(seq) AS seq, count(DISTINCT seq // 10) AS chunks FROM proposals GROUP BY lower(name)")
def subtopics(proposals):
    props = proposals.select("seq", F.expr("CASE WHEN seq % 2 = 0 THEN name ELSE '' || name END").alias("name"), "summary", F.col("source_ids").alias("source_chunk_ids"))
    return B.dedup_subtopics(props).select("name", "summary", "seq", F.size("source_chunk_ids").cast("long").alias("chunks"))


@register.add("g4_structural_edges", "tree", "nodes", oracle="SELECT src, dst, relation, CASE WHEN relation = 'HAS_CONTENT' THEN 2 END AS chunks FROM tree WHERE src <> 'topic:3' AND dst <> 'topic:3'")
def structural(tree, nodes):
    ids = F.array(F.concat(F.lit("c"), F.col("seq").cast("string")), F.lit("c"), F.lit("c"))
    wanted = tree.withColumn("source_chunk_ids", ids).unionByName(tree.limit(0).withColumn("source_chunk_ids", ids))
    edges, _ = B.structural_edges(wanted.unionByName(wanted), nodes.where("key <> 'topic:3'"))
    return edges.select("src", "dst", "relation", F.size("source_chunk_ids").alias("chunks")).withColumn("chunks", F.when(F.col("chunks") >= 0, F.col("chunks")))


@register.add("j4_j6_warnings", "tree", "nodes", oracle="SELECT src, dst, 'missing source' AS reason FROM tree WHERE src = 'topic:3'")
def warnings(tree, nodes):
    return B.structural_edges(tree.withColumn("source_chunk_ids", F.array(F.lit("c"))), nodes.where("key <> 'topic:3'"))[1]


@register.add("j5_attach", "tree", oracle="""SELECT src, dst FROM tree WHERE relation = 'HAS_CONTENT' AND src <> 'subtopic:1'
  UNION SELECT 'topic:9', dst FROM tree WHERE relation = 'HAS_CONTENT' GROUP BY dst HAVING bool_and(src = 'subtopic:1')""")
def attach(tree):
    contents = tree.where("relation = 'HAS_CONTENT'")
    links = contents.where("src <> 'subtopic:1'").select(F.col("dst").alias("content"), F.col("src").alias("parent"))
    return B.attach_contents(links, contents.select(F.col("dst").alias("content"), F.lit("topic:9").alias("parent")).distinct())


@register.add("g5_semantic_edges", "related", "nodes", oracle="""SELECT src, dst, regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g') AS label, max(confidence) AS confidence, 'RELATED_TO' AS relation
  FROM related WHERE src <> dst AND src <> 'content:7' AND dst <> 'content:7' GROUP BY 1, 2, 3""")
def semantic(related, nodes):
    empty = related.limit(0).select("src", "dst", "label", "confidence")
    return B.semantic_edges(empty, related, nodes.where("key <> 'content:7'"))[0].drop("source_chunk_ids")


@register.add("g7_remove", "nodes", "tree", oracle="SELECT src, dst FROM tree WHERE src <> 'subtopic:2' AND dst <> 'subtopic:2' AND src <> 'topic:1'")
def remove(nodes, tree):
    return B.remove_nodes(nodes, tree, nodes.where("key IN ('subtopic:2', 'topic:1')").select("key"))[1].select("src", "dst")


@register.add("g7_remove_edges", "related", oracle="SELECT src, dst, seq FROM related QUALIFY NOT (row_number() OVER (PARTITION BY src, dst ORDER BY seq) = 1 AND src < dst)")
def remove_edges(related):
    edges = related.withColumn("relation", F.lit("RELATED_TO"))
    return B.remove_edges(edges, edges.where("src < dst").drop("label")).select("src", "dst", "seq")


@register.add("g8_degrees", "nodes", "tree", oracle="SELECT key, (SELECT count(*) FROM tree WHERE src = key) + (SELECT count(*) FROM tree WHERE dst = key) AS degree FROM nodes")
def degrees(nodes, tree):
    return B.degrees(nodes, tree)


@register.add("g9_isolated", "nodes", "tree", oracle="SELECT key FROM nodes WHERE key IN (SELECT src FROM tree) OR key IN (SELECT dst FROM tree)")
def isolated(nodes, tree):
    return B.prune_isolated(nodes, tree).select("key")


@register.add("g10_ratio", "nodes", "tree", oracle="""WITH n AS (SELECT key, CASE WHEN node_type = 'content' AND seq % 3 = 0 THEN 'topic' ELSE node_type END AS kind, seq FROM nodes),
  d AS (SELECT *, (SELECT count(*) FROM tree WHERE src = key) + (SELECT count(*) FROM tree WHERE dst = key) AS degree FROM n),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY degree, seq) AS turn, count(*) OVER (PARTITION BY kind) AS size FROM d)
  SELECT key FROM r WHERE NOT (kind = 'topic' AND turn <= size - (SELECT count(*) FROM n WHERE kind = 'subtopic') + 1)""")
def ratio(nodes, tree):
    """One round over every node and edge; a third of the parts count as topics, so that their tier is too large."""
    return B.prune_to_ratio(nodes.withColumn("node_type", F.expr("CASE WHEN node_type = 'content' AND seq % 3 = 0 THEN 'topic' ELSE node_type END")), tree, max_rounds=1)[0].select("key")


@register.add("g10_ratio_all", "nodes", "tree")
def ratio_all(nodes, tree):
    """Every node and edge; a third of the parts count as topics, so that their tier is too large."""
    return B.prune_to_ratio(nodes.withColumn("node_type", F.expr("CASE WHEN node_type = 'content' AND seq % 3 = 0 THEN 'topic' ELSE node_type END")), tree)[0].select("key")


@register.add("f30_patch", "nodes", oracle="""SELECT key, CASE WHEN seq % 10 = 3 THEN 'patched' ELSE summary END AS summary, node_type, CASE WHEN seq % 10 = 3 THEN 'new' ELSE 'old' END AS terms,
  CASE WHEN seq % 10 = 3 THEN 's1|s2' ELSE key END AS sources, seq % 10 = 3 AS updated FROM nodes""")
def patch(nodes):
    patches = nodes.where("seq % 10 = 3").select("key", F.lit("patched").alias("summary"), F.lit("topic").alias("node_type"), F.array(F.lit("new")).alias("key_terms"), F.array(F.lit("s1"), F.lit("s2")).alias("source_ids"))
    patches = patches.unionByName(patches.limit(1).withColumn("key", F.lit("nowhere")))
    whole = nodes.withColumns({"key_terms": F.array(F.lit("old")), "source_ids": F.array("key"), "updated_at": F.lit("2024-01-01").cast("timestamp")})
    done = B.patch_nodes(whole, patches)
    return done.select("key", "summary", "node_type", F.array_join("key_terms", "|").alias("terms"), F.array_join("source_ids", "|").alias("sources"), (F.col("updated_at") > F.lit("2024-01-01").cast("timestamp")).alias("updated"))


@register.add("g22_edits", "nodes", "tree", oracle="""SELECT src, dst, CASE WHEN seq % 7 = 0 THEN 'missing source' WHEN seq % 7 = 1 THEN 'missing label' WHEN seq % 7 = 2 THEN 'conflict' ELSE NULL END AS reason FROM (SELECT seq, CASE WHEN seq % 7 = 0 THEN 'nowhere' ELSE src END AS src, dst FROM tree) WHERE seq % 7 < 3""")
def edits(nodes, tree):
    edges = tree.select("src", "dst", "relation", F.lit(None).cast("string").alias("label"))
    wanted = tree.select(
        F.expr("CASE WHEN seq % 7 = 0 THEN 'nowhere' ELSE src END").alias("src"), "dst", F.expr("CASE WHEN seq % 7 = 2 THEN relation ELSE 'RELATED_TO' END").alias("relation"), F.expr("CASE WHEN seq % 7 = 1 THEN ' ' ELSE 'fine' END").alias("label")
    )
    return B.apply_edits(nodes, edges, wanted)[1].select("src", "dst", "reason")


@register.add("g12_closure", "tree", oracle="""SELECT root, node, min(depth) AS depth FROM (
    SELECT src AS root, dst AS node, 1 AS depth FROM tree WHERE relation = 'HAS_SUBTOPIC' UNION ALL
    SELECT a.src, b.dst, 2 FROM tree a JOIN tree b ON a.dst = b.src WHERE a.relation = 'HAS_SUBTOPIC') GROUP BY 1, 2""")
def closure(tree):
    return G.closure(tree, tree.where("relation = 'HAS_SUBTOPIC'").select(F.col("src").alias("root")))


@register.add("g13_ancestors", "tree", oracle="SELECT DISTINCT b.dst AS root, a.src AS node FROM tree a JOIN tree b ON a.dst = b.src WHERE a.relation = 'HAS_SUBTOPIC'")
def ancestors(tree):
    up = G.closure(tree, tree.where("relation = 'HAS_CONTENT'").select(F.col("dst").alias("root")), "up")
    return up.where("node LIKE 'topic%'").select("root", "node")


def _embedded(nodes, embeddings):
    return nodes.join(embeddings.select(F.col("vec_id").alias("vec"), "embedding"), "vec").withColumn("key_terms", F.array(F.lower("name")))


_NODES = "n AS (SELECT key, node_type, name, nodes.seq, embedding FROM nodes JOIN embeddings ON vec_id = vec)"
_ASKED = "q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 25 = 0)"


def _asked(embeddings):
    return embeddings.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit("what of EUROPE and France").alias("text"))


@register.add("g11_scope", "nodes", "tree", "embeddings", oracle=f"""WITH {_NODES}, {_ASKED},
  s AS (SELECT query_id, key AS root, {_DOT.format('n.embedding', 'q.embedding')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS turn FROM q, n WHERE node_type = 'topic'),
  c AS (SELECT * FROM s WHERE turn = 1 OR (turn = 2 AND score > 0.05)),
  d AS (SELECT src AS root, dst AS node FROM tree WHERE relation = 'HAS_SUBTOPIC' UNION SELECT a.src, b.dst FROM tree a JOIN tree b ON a.dst = b.src WHERE a.relation = 'HAS_SUBTOPIC')
  SELECT DISTINCT query_id, node FROM c JOIN d USING (root)""")
def scope(nodes, tree, embeddings):
    return G.scope_topics(_asked(embeddings), _embedded(nodes, embeddings), tree, 0.05)


@register.add("g14_anchors", "nodes", "embeddings", oracle=f"""WITH {_NODES}, {_ASKED},
  s AS (SELECT query_id, key, seq, contains('what of europe and france', lower(name)) AS hit, {_DOT.format('n.embedding', 'q.embedding')} AS score FROM q, n)
  SELECT query_id, key AS node, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, CASE WHEN hit THEN seq END, round(score, 9) DESC, key) AS rank FROM s QUALIFY rank <= 3""")
def anchors(nodes, embeddings):
    return G.anchors(_asked(embeddings), _embedded(nodes, embeddings))


_ADJ = "adj AS (SELECT src AS node, dst AS next FROM tree UNION SELECT dst, src FROM tree)"


def _hop(k: int) -> str:
    seen = " UNION ".join(["SELECT query_id, node FROM h0", *(f"SELECT query_id, node FROM h{i}" for i in range(1, k))])
    return f"""h{k} AS (SELECT query_id, key AS node, {_DOT.format('n.embedding', 'q.embedding')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank
      FROM (SELECT DISTINCT query_id, next FROM h{k - 1} JOIN adj USING (node)) c JOIN n ON key = next JOIN q USING (query_id)
      WHERE (query_id, key) NOT IN ({seen}) QUALIFY rank <= 10 AND score >= 0.05)"""


@register.add("g16_walk_nodes", "nodes", "tree", "embeddings", oracle=f"""WITH {_NODES}, {_ASKED}, {_ADJ}, h0 AS (SELECT query_id, 'subtopic:' || CAST(query_id % 25 AS STRING) AS node FROM q), {_hop(1)}, {_hop(2)}
  SELECT query_id, node, 0 AS hop, NULL::DOUBLE AS score FROM h0 UNION ALL SELECT query_id, node, 1, round(score, 6) FROM h1 UNION ALL SELECT query_id, node, 2, round(score, 6) FROM h2""")
def walk_nodes(nodes, tree, embeddings):
    asked = _asked(embeddings)
    starts = asked.select("query_id", F.concat(F.lit("subtopic:"), (F.col("query_id") % 25).cast("string")).alias("node"))
    reached, _ = G.walk(asked, starts, _embedded(nodes, embeddings), tree.withColumn("label", F.lit(None).cast("string")), 2, 0.05)
    return reached.select("query_id", "node", "hop", F.round("score", 6).alias("score"))


@register.add("g17_triples", "nodes", "tree", "embeddings", oracle=f"""WITH {_NODES}, {_ASKED}, {_ADJ}, h0 AS (SELECT query_id, 'subtopic:' || CAST(query_id % 25 AS STRING) AS node FROM q), {_hop(1)}, {_hop(2)},
  e AS (SELECT h1.query_id, src, dst, relation FROM h0 JOIN h1 USING (query_id) JOIN tree ON (src = h0.node AND dst = h1.node) OR (dst = h0.node AND src = h1.node)
        UNION ALL SELECT h2.query_id, src, dst, relation FROM h1 JOIN h2 USING (query_id) JOIN tree ON (src = h1.node AND dst = h2.node) OR (dst = h1.node AND src = h2.node))
  SELECT query_id, a.name AS head, relation, b.name AS tail FROM e JOIN nodes a ON a.key = src JOIN nodes b ON b.key = dst""")
def triples(nodes, tree, embeddings):
    asked = _asked(embeddings)
    starts = asked.select("query_id", F.concat(F.lit("subtopic:"), (F.col("query_id") % 25).cast("string")).alias("node"))
    _, edges = G.walk(asked, starts, _embedded(nodes, embeddings), tree.withColumn("label", F.lit(None).cast("string")), 2, 0.05)
    return G.triples(edges, nodes)


@register.add("g19_components", "nodes", "tree")
def components(nodes, tree):
    return G.components(nodes, tree)


@register.add("g20_collapse", "nodes", "tree", oracle="""WITH d AS (SELECT src AS root, dst AS node FROM tree WHERE relation = 'HAS_SUBTOPIC' UNION SELECT a.src, b.dst FROM tree a JOIN tree b ON a.dst = b.src WHERE a.relation = 'HAS_SUBTOPIC')
  SELECT root, count(DISTINCT node) AS hidden FROM d WHERE root IN ('topic:1', 'topic:2') AND node NOT IN (SELECT node FROM d WHERE root NOT IN ('topic:1', 'topic:2')) GROUP BY root""")
def collapse(nodes, tree):
    return G.collapse(nodes, tree, nodes.where("key IN ('topic:1', 'topic:2')").select("key"))[1]


@register.add("g21_gaps", "nodes", "tree", "quiz", oracle="""WITH w AS (SELECT question_id, 'content:' || CAST(seq % 200 + 1 AS STRING) AS key FROM quiz WHERE seq % 3 = 0),
  d AS (SELECT DISTINCT a.src AS root, b.dst AS node FROM tree a JOIN tree b ON a.dst = b.src WHERE a.relation = 'HAS_SUBTOPIC')
  SELECT name AS topic, count(DISTINCT question_id) AS wrong FROM w JOIN d ON d.node = w.key JOIN nodes ON nodes.key = root GROUP BY name""")
def gaps(nodes, tree, quiz):
    wrong = quiz.where("seq % 3 = 0").select("question_id", F.array(F.concat(F.lit("content:"), (F.col("seq") % 200 + 1).cast("string"))).alias("source_node_keys"))
    return G.knowledge_gaps(wrong, nodes, tree)


@register.add("j12_neighbours", "nodes", "tree", oracle="""WITH b AS (SELECT src AS key, dst AS other, 0 AS way, seq FROM tree UNION ALL SELECT dst, src, 1, seq FROM tree),
  f AS (SELECT b.key, n.name AS neighbour, min((way, b.seq)) AS at_ FROM b JOIN nodes n ON n.key = other WHERE b.key LIKE 'subtopic:%' GROUP BY 1, 2)
  SELECT key, neighbour, row_number() OVER (PARTITION BY key ORDER BY at_, neighbour) AS rank FROM f QUALIFY rank <= 5""")
def neighbours(nodes, tree):
    return G.neighbours(nodes, tree, nodes.where("node_type = 'subtopic'").select("key"))


@register.add("j16_highlight", "nodes", "tree", oracle="SELECT src, dst FROM tree WHERE src IN (SELECT key FROM nodes WHERE seq % 2 = 0) AND dst IN (SELECT key FROM nodes WHERE seq % 2 = 0)")
def highlight(nodes, tree):
    return G.highlight(nodes, tree, nodes.where("seq % 2 = 0").select("key"))[1].select("src", "dst")


@register.add("j2_node_chunks", "nodes", "related", oracle="SELECT DISTINCT src AS query_id, 'c' || CAST(confidence AS STRING) AS chunk_id FROM related WHERE src IN (SELECT key FROM nodes)")
def node_chunks(nodes, related):
    sourced = related.select(F.col("src").alias("key"), F.array(F.concat(F.lit("c"), F.col("confidence").cast("string"))).alias("source_ids"))
    return G.node_chunks(nodes.select(F.col("key").alias("query_id"), F.col("key").alias("node")), sourced)


# --- evidence --------------------------------------------------------------------------------------------------------

_PARTS = """parts AS (SELECT user_id AS query_id, CAST(event_id % 3 AS INT) AS sub_id, 'c' || CAST(event_id % 40 AS STRING) AS chunk_id, event_id AS rank, event_type AS source FROM events)"""


def _parts(events):
    return events.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 3).cast("int").alias("sub_id"), F.expr("'c' || (event_id % 40)").alias("chunk_id"), F.col("event_id").alias("rank"), F.col("event_type").alias("source"))


@register.add("a1_merge_evidence", "events", oracle=f"""WITH {_PARTS}, f AS (SELECT query_id, chunk_id, min((sub_id, rank, source)) AS m FROM parts GROUP BY 1, 2)
  SELECT query_id, chunk_id, arg_min(source, (sub_id, rank)) AS source, any_value(turn) AS rank FROM parts JOIN (SELECT query_id AS qq, chunk_id AS cc, row_number() OVER (PARTITION BY query_id ORDER BY m, chunk_id) AS turn FROM f) ON qq = query_id AND cc = chunk_id GROUP BY 1, 2""")
def merge_evidence(events):
    return R.merge_evidence(_parts(events))


@register.add("a2_modes", "events", oracle="""WITH m AS (SELECT user_id AS query_id, CASE event_id % 50 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'graph' WHEN 2 THEN 'dense' ELSE 'none' END AS mode FROM events)
  SELECT query_id, CASE WHEN bool_or(mode = 'hybrid') OR (bool_or(mode = 'dense') AND bool_or(mode = 'graph')) THEN 'hybrid' WHEN bool_or(mode = 'graph') THEN 'graph' ELSE 'dense' END AS mode FROM m GROUP BY 1""")
def modes(events):
    return R.mode_rollup(events.select(F.col("user_id").alias("query_id"), F.expr("CASE event_id % 50 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'graph' WHEN 2 THEN 'dense' ELSE 'none' END").alias("mode")))


@register.add("j7_hybrid", "vectors", "vector_queries", oracle=f"""WITH {_TOP}, g AS (SELECT query_id, id + 1 AS id, rank FROM top UNION ALL SELECT query_id, id, rank + 10 FROM top WHERE rank = 2),
  g2 AS (SELECT query_id, id, min(rank) AS rank FROM g GROUP BY 1, 2),
  m AS (SELECT query_id, id, top.rank AS d, g2.rank AS g FROM top FULL JOIN g2 USING (query_id, id))
  SELECT query_id, id AS chunk_id, CASE WHEN d IS NOT NULL AND g IS NOT NULL THEN 'both' WHEN d IS NOT NULL THEN 'dense' ELSE 'graph' END AS source,
         row_number() OVER (PARTITION BY query_id ORDER BY d IS NULL, coalesce(d, g), id) AS rank FROM m""")
def hybrid(vectors, queries):
    dense = V.topk(vectors, queries, 5).withColumnRenamed("id", "chunk_id")
    graph = dense.select("query_id", (F.col("chunk_id") + 1).alias("chunk_id"), "rank").unionByName(dense.where("rank = 2").select("query_id", "chunk_id", (F.col("rank") + 10).alias("rank")))
    return R.hybrid_merge(dense, graph.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank")))


_RANKED = "ranked AS (SELECT source_id AS query_id, chunk_id, modality, text, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS rank FROM chunks)"


def _ranked(chunks):
    from pyspark.sql import Window

    return chunks.select(F.col("source_id").alias("query_id"), "chunk_id", "modality", "text", F.row_number().over(Window.partitionBy("source_id").orderBy("seq")).alias("rank"))


@register.add("w1_pack_context", "chunks", oracle=f"""WITH {_RANKED}, l AS (SELECT query_id, rank, '[' || CAST(rank AS STRING) || '] (' || modality || ') ' || text AS line FROM ranked),
  t AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM l), f AS (SELECT query_id, min(rank) AS first_over FROM t WHERE total > 4000 GROUP BY 1)
  SELECT t.query_id, rank, CASE WHEN total <= 4000 THEN line ELSE '[' || CAST(rank AS STRING) || '] … (more evidence than fits here)' END AS line FROM t LEFT JOIN f USING (query_id) WHERE total <= 4000 OR rank = first_over""")
def pack_context(chunks):
    return R.pack_context(_ranked(chunks))


@register.add("w2_prefix", "chunks", oracle=f"WITH {_RANKED}, t AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM ranked) SELECT query_id, chunk_id FROM t WHERE total <= 3000 OR rank = 1")
def prefix(chunks):
    return R.prefix_by_length(_ranked(chunks), "query_id", 3000).select("query_id", "chunk_id")


@register.add("w3_rerank", "lineitem", oracle="""WITH s AS (SELECT l_orderkey AS query_id, l_linenumber AS chunk_id, round_even(1 / (1 + exp(-(l_quantity - 25) / 10)), 4) AS relevancy_score FROM lineitem)
  SELECT query_id, chunk_id, relevancy_score, row_number() OVER (PARTITION BY query_id ORDER BY relevancy_score DESC, chunk_id) AS rank FROM s WHERE relevancy_score >= 0.3 QUALIFY rank <= 3""")
def rerank(lineitem):
    scored = lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_linenumber").alias("rank"), ((F.col("l_quantity") - 25) / 10).alias("logit"))
    return R.rerank(scored, "logit", 0.3, 3).drop("logit")


@register.add("f24_citations", "chunks", oracle=f"WITH {_RANKED} SELECT query_id, chunk_id, CASE rank WHEN 3 THEN 1 ELSE 2 END AS ord FROM ranked WHERE rank IN (1, 3)")
def citations(chunks):
    answers = chunks.select(F.col("source_id").alias("query_id")).distinct().withColumn("answer", F.lit("so [3], then [1][3] and [999999]"))
    return R.citations(answers, _ranked(chunks))


@register.add("f25_relationships", "nodes", "tree", oracle="""SELECT substring(src, 7) AS query_id, string_agg(DISTINCT '- ' || a.name || ' —[' || relation || ']→ ' || b.name, chr(10) ORDER BY '- ' || a.name || ' —[' || relation || ']→ ' || b.name) AS lines
  FROM tree JOIN nodes a ON a.key = src JOIN nodes b ON b.key = dst WHERE relation = 'HAS_SUBTOPIC' GROUP BY 1""")
def relationships(nodes, tree):
    edges = tree.where("relation = 'HAS_SUBTOPIC'").select(F.expr("substring(src, 7)").alias("query_id"), "src", "dst", "relation", F.lit(None).cast("string").alias("label"))
    return R.relationship_lines(G.triples(edges, nodes))


@register.add("f26_prompts", "questions", oracle=f"""SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'graph' WHEN 2 THEN 'dense' ELSE 'plain' END AS kind, CASE query_id % 4
  WHEN 1 THEN 'Answer from these passages and relationships and cite passages by number.' || chr(10) || 'ctx' || chr(10) || 'rel' || chr(10) || 'Question: ' || text
  WHEN 2 THEN 'Answer from these passages and cite them by number.' || chr(10) || 'ctx' || chr(10) || 'Question: ' || text
  ELSE 'Answer briefly and say when you are unsure.' || chr(10) || 'Question: ' || text END AS prompt FROM questions""")
def prompts(questions):
    return R.prompts(questions.select("query_id", F.col("text").alias("question"), F.expr("CASE query_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'graph' ELSE 'dense' END").alias("mode"), F.expr("CASE WHEN query_id % 4 = 3 THEN '' ELSE 'ctx' END").alias("context"), F.lit("rel").alias("relationships")))


# --- quiz and metrics -------------------------------------------------------------------------------------------------

_GIVEN = "lower(trim(coalesce(s.user_answer, '')))"
_GRADED = f"""g AS (SELECT z.quiz_id, z.question_id, coalesce(s.user_answer, '') AS user_answer, CASE z.question_type
    WHEN 'true_false' THEN CASE WHEN {_GIVEN} = lower(trim(correct_answer)) THEN 1.0 ELSE 0.0 END
    WHEN 'multiple_choice' THEN CASE WHEN {_GIVEN} = lower(trim(correct_answer)) OR (length({_GIVEN}) = 1 AND starts_with(lower(correct_answer), {_GIVEN} || ')')) THEN 1.0 ELSE 0.0 END
    ELSE CASE WHEN coalesce(s.user_answer, '') = '' THEN 0.0 ELSE least(len(list_intersect(list_distinct(string_split(lower(correct_answer), ' ')), list_distinct(string_split({_GIVEN}, ' '))))::DOUBLE
         / len(list_distinct(string_split(lower(correct_answer), ' '))) * 1.5, 1.0) END END::DOUBLE AS score
  FROM quiz z LEFT JOIN submissions s USING (quiz_id, question_id))"""


@register.add("q1_q4_grade", "quiz", "submissions", oracle=f"WITH {_GRADED} SELECT quiz_id, question_id, user_answer, score >= 0.5 AS is_correct, round(score, 6) AS score FROM g")
def grade(quiz, submissions):
    return Q.grade(quiz, submissions).withColumn("score", F.round("score", 6))


@register.add("a3_totals", "quiz", "submissions", oracle=f"WITH {_GRADED} SELECT quiz_id, round_even(avg(score) * 100, 1) AS score, count(*) FILTER (WHERE score >= 0.5) AS correct, count(*) AS total FROM g GROUP BY quiz_id")
def totals(quiz, submissions):
    return Q.quiz_totals(Q.grade(quiz, submissions))


@register.add("q6_public", "quiz", oracle="SELECT quiz_id, question_id, seq, question_type FROM quiz")
def public(quiz):
    return Q.public_view(quiz)


@register.add("w4_stride", "chunks", oracle="""WITH n AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place, count(*) OVER () AS n, sum(length(text)) OVER () AS chars FROM chunks)
  SELECT chunk_id FROM n WHERE place % (CASE WHEN chars > 24000 THEN greatest(1, n // 80) ELSE 1 END) = 0""")
def stride(chunks):
    return Q.stride_sample(chunks).select("chunk_id")


@register.add("w5_backfill", "chunks", oracle="SELECT chunk_id, 0 AS tier, seq AS ord FROM chunks WHERE seq BETWEEN 1 AND 40 UNION ALL SELECT chunk_id, 1, seq FROM chunks WHERE seq % 3 = 0 AND seq NOT BETWEEN 1 AND 40")
def backfill(chunks):
    return Q.backfill(chunks.where("seq > 0").select("chunk_id", F.col("seq").alias("rank")), chunks.where("seq % 3 = 0").select("chunk_id", "seq"))


@register.add("w6_top_degree", "nodes", "tree", oracle="SELECT key, (SELECT count(*) FROM tree WHERE src = key) + (SELECT count(*) FROM tree WHERE dst = key) AS degree FROM nodes ORDER BY degree DESC, key LIMIT 50")
def top_degree(nodes, tree):
    return Q.top_degree(nodes, tree)


@register.add("w8_triples", "nodes", "tree", oracle="""WITH d AS (SELECT key, (SELECT count(*) FROM tree WHERE src = key) + (SELECT count(*) FROM tree WHERE dst = key) AS degree FROM nodes),
  t AS (SELECT key FROM d ORDER BY degree DESC, key LIMIT 50), n AS (SELECT DISTINCT src, dst, relation, seq FROM tree WHERE src IN (SELECT key FROM t) OR dst IN (SELECT key FROM t))
  SELECT head, relation, tail FROM (SELECT a.name AS head, relation, b.name AS tail, min(n.seq) AS seq FROM n JOIN nodes a ON a.key = src JOIN nodes b ON b.key = dst GROUP BY 1, 2, 3) ORDER BY seq, head, relation, tail LIMIT 50""")
def quiz_triples(nodes, tree):
    """The triples around the nodes with most edges."""
    return Q.triples_near(Q.top_degree(nodes, tree), nodes, tree)


@register.add("w7_short_ids", "chunks", oracle="SELECT source_id AS quiz_id, chunk_id, 'C' || lpad(CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq, chunk_id) AS STRING), 3, '0') AS short_id FROM chunks")
def short_ids(chunks):
    return Q.short_ids(chunks.select(F.col("source_id").alias("quiz_id"), "chunk_id", F.col("seq").alias("ord"))).drop("ord")


@register.add("w10_validate", "quiz", oracle="""WITH v AS (SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY seq) AS turn FROM quiz WHERE seq % 5 <> 1 AND seq % 4 <> 2 AND question_type <> 'true_false' AND NOT (question_type = 'multiple_choice' AND seq % 2 = 1))
  SELECT quiz_id, question_id, 'doc_' || CAST(seq AS STRING) AS source FROM v WHERE turn <= 10""")
def validate(quiz):
    items = quiz.select(
        "quiz_id", "question_id", "seq", "question_type", F.expr("CASE WHEN seq % 5 = 1 THEN ' ' ELSE 'ask' END").alias("question_text"), F.expr("CASE WHEN seq % 2 = 1 THEN array('A') ELSE array('A', 'B') END").alias("options"), "correct_answer", F.expr("array('none', 'C' || seq)").alias("sources")
    )
    id_map = quiz.where("seq % 4 <> 2").select("quiz_id", F.expr("'C' || seq").alias("short_id"), F.expr("'doc_' || seq").alias("chunk_id"))
    return Q.validate_questions(items, id_map, ["multiple_choice", "short_answer"]).select("quiz_id", "question_id", F.get("source_chunk_ids", F.lit(0)).alias("source"))


@register.add("j14_priority", "events", oracle="""SELECT user_id AS question_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 <> 0, event_id) AS rank FROM events""")
def priority(events):
    rows = events.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("chunk_id"), F.col("event_id").alias("rank"))
    return Q.sourced_first(rows, rows.where("chunk_id % 10 = 0"))


_RELEVANT = "rel AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 10 = 0)"


def _relevant(embeddings, found):
    """Of the pairs found those whose labels are equal; other pairs can't count, and all of them together grow with the square."""
    labels = embeddings.select("vec_id", "label")
    asked = labels.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "label")
    pairs = found.select("query_id", "id").distinct().join(asked, "query_id")
    return pairs.join(labels.withColumnRenamed("vec_id", "id"), ["id", "label"]).select("query_id", "id")


def _others(vectors, queries):
    """The five nearest of each query without itself, found once for all that reads them."""
    return V.topk(vectors, queries, 5).where("id <> query_id").checkpoint()


@register.add("a4_hit_mrr", "vectors", "vector_queries", "embeddings", oracle=f"""WITH {_TOP}, {_RELEVANT}, f AS (SELECT query_id, min(rank) FILTER (WHERE (query_id, id) IN (SELECT query_id, id FROM rel)) AS first_rank FROM top WHERE id <> query_id GROUP BY 1)
  SELECT round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr FROM f""")
def hit_mrr(vectors, queries, embeddings):
    found = _others(vectors, queries)
    return M.hit_rate_mrr(found, _relevant(embeddings, found)).select(F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@register.add("a4_hit_mrr_all", "vectors", "vector_queries", "embeddings", oracle=f"""WITH {_TOP}, {_RELEVANT}, f AS (SELECT query_id, min(rank) FILTER (WHERE (query_id, id) IN (SELECT query_id, id FROM rel)) AS first_rank FROM top WHERE id <> query_id AND query_id % 30 <> 0 GROUP BY 1),
  a AS (SELECT query_id, first_rank FROM vector_queries LEFT JOIN f USING (query_id))
  SELECT round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr FROM a""")
def hit_mrr_all(vectors, queries, embeddings):
    """Over all queries; for every third nothing is found, which counts as a miss."""
    found = _others(vectors, queries).where("query_id % 30 <> 0")
    return M.hit_rate_mrr(found, _relevant(embeddings, found), queries=queries).select(F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@register.add("a5_precision", "vectors", "vector_queries", "embeddings", oracle=f"""WITH {_TOP}, {_RELEVANT}, f AS (SELECT query_id, avg(CASE WHEN (query_id, id) IN (SELECT query_id, id FROM rel) THEN 1.0 ELSE 0.0 END) AS share FROM top WHERE id <> query_id GROUP BY 1)
  SELECT round(avg(share), 6) AS precision FROM f""")
def precision(vectors, queries, embeddings):
    found = _others(vectors, queries)
    return M.context_precision(found, _relevant(embeddings, found)).select(F.round("precision", 6).alias("precision"))


@register.add("a6_rates", "labels", oracle="SELECT CASE doc_id % 2 WHEN 0 THEN 'dense' ELSE 'hybrid' END AS system, round(avg(quality), 6) AS supported, round(avg(1 - toxic), 6) AS useful FROM labels GROUP BY 1")
def rates(labels):
    judged = labels.select(F.expr("CASE doc_id % 2 WHEN 0 THEN 'dense' ELSE 'hybrid' END").alias("system"), (F.col("quality") == 1).alias("is_supported"), (F.col("toxic") == 0).alias("is_useful"))
    return M.verdict_rates(judged).select("system", F.round("supported", 6).alias("supported"), F.round("useful", 6).alias("useful"))


@register.add("a7_compare", "labels", oracle="""SELECT metric, round(avg(value) FILTER (WHERE s = 0), 6) AS dense, round(avg(value) FILTER (WHERE s = 1), 6) AS hybrid FROM (
  SELECT doc_id % 2 AS s, 'quality' AS metric, quality AS value FROM labels UNION ALL SELECT doc_id % 2, 'toxic', toxic FROM labels) GROUP BY metric""")
def compare(labels):
    system = F.expr("CASE doc_id % 2 WHEN 0 THEN 'dense' ELSE 'hybrid' END").alias("system")
    runs = labels.select(system, F.lit("quality").alias("metric"), F.col("quality").alias("value")).unionByName(labels.select(system, F.lit("toxic").alias("metric"), F.col("toxic").alias("value")))
    return M.compare_systems(runs, ["dense", "hybrid"]).select("metric", F.round("dense", 6).alias("dense"), F.round("hybrid", 6).alias("hybrid"))


@register.add("a9_entities", "lines", oracle="SELECT source_id AS chunk_id, arg_min(text, line_no) AS entity, min(line_no) AS pos FROM lines GROUP BY source_id, lower(text)")
def entities(lines):
    return M.distinct_entities(lines.select(F.col("source_id").alias("chunk_id"), F.col("text").alias("entity"), F.col("line_no").alias("pos")))


def _text_flow(chunks, nodes, tree, related, questions):
    """What the answer flow takes, for the first turn of every conversation, ids that 100 divides, and the whole graph; all texts are encoded by weights fitted on the chunks."""
    encoder, vectors = V.encode_corpus(chunks.select(F.col("chunk_id").alias("id"), "text"), 64)
    embed = encoder.encode
    # many nodes stand in one block of a file
    graph = embed(nodes.withColumn("text", F.concat_ws(" ", "name", "summary")).repartition("key")).drop("text").withColumns({"key_terms": F.array(F.lower("name")), "source_ids": F.array(F.concat(F.lit("doc_"), F.col("vec").cast("string")))})
    edges = tree.withColumn("label", F.lit(None).cast("string")).drop("seq").unionByName(related.select("src", "dst", F.lit("RELATED_TO").alias("relation"), "label"))
    # a walk goes along equal edges once, and triples are distinct; nodes are read for anchors, scopes and the walk, edges once for each of the last two
    return questions.where("query_id % 100 = 0"), chunks, vectors, stored(graph, "nodes"), edges, embed


_FLOW = {"max_sources": 8, "second_min": 0.05, "threshold": 0.1}


def _model_answers(questions):
    """(sub-question answers, verdicts) as a model might give them: two parts for every third question, every fifth judged irrelevant."""
    asked = questions.where("query_id % 100 = 0 AND text IS NOT NULL")
    parts = asked.where("(query_id DIV 100) % 3 = 0").select("query_id", F.to_json(F.struct(F.array(F.concat(F.lit("Why "), F.substring("text", 1, 80)), F.concat(F.lit("What is "), F.substring("text", -80, 80))).alias("sub_questions"))).alias("raw"))
    judged = asked.where("(query_id DIV 100) % 5 = 0").select("query_id", F.lit(0).alias("sub_id"), F.lit('{"is_relevant": false}').alias("raw"))
    return {"responses": parts, "judged": judged}


@register.add("p2_hybrid_retrieval", "chunks", "nodes", "tree", "related", "questions")
def hybrid_retrieval(chunks, nodes, tree, related, questions):
    """Questions to packed contexts: sub-questions, routing, dense and graph evidence, the gate, one reranked context each."""
    return answer_context(*_text_flow(chunks, nodes, tree, related, questions), **_model_answers(questions), **_FLOW).context


@register.add("p2_hybrid_forced", "chunks", "nodes", "tree", "related", "questions")
def hybrid_forced(chunks, nodes, tree, related, questions):
    """The same with both ways for every question and no gate: (query_id, chunk_id, source, rank)."""
    return answer_context(*_text_flow(chunks, nodes, tree, related, questions), forced_mode="hybrid", **_model_answers(questions), **_FLOW).evidence.select("query_id", "chunk_id", "source", "rank")


def _variants(chunks, nodes, tree, related, questions):
    return E.variant_evidence(*_text_flow(chunks, nodes, tree, related, questions), **_model_answers(questions), **_FLOW)


@register.add("p5_variant_evidence", "chunks", "nodes", "tree", "related", "questions")
def variant_evidence(chunks, nodes, tree, related, questions):
    """What four ways of retrieving find for the same questions, in one run."""
    return _variants(chunks, nodes, tree, related, questions).select("variant", "query_id", "chunk_id", "source", "rank")


@register.add("p5_variants", "chunks", "nodes", "tree", "related", "questions")
def variants(chunks, nodes, tree, related, questions):
    """The four ways measured over all these questions. As relevant count chunks of a third of the sources, dealt to questions by number."""
    asked = questions.where("query_id % 100 = 0")
    found = stored(_variants(chunks, nodes, tree, related, questions))
    # only pairs that a way found can count
    met = found.join(chunks.select("chunk_id", "seq"), "chunk_id").where("pmod(seq, 3) = pmod(query_id DIV 100, 3)").select("query_id", "chunk_id").distinct()
    answered = found.groupBy(F.col("variant").alias("system"), "query_id").agg((F.max("relevancy_score") >= 0.5).alias("is_supported"), (F.count(F.lit(1)) > 4).alias("is_useful"))
    return E.compare_variants(found, met, asked, answered)
