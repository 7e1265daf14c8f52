"""Queries of proposals, bundles, suggestions, quiz contexts and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import graph_build as B
from quillspan.operators import ingest as I
from quillspan.operators import metrics as M
from quillspan.operators import proposals as P
from quillspan.operators import quiz as Q
from quillspan.operators import similarity as V
from quillspan.plans.queries_build import _sql_key, bundle
from quillspan.plans.queries_graph import _RELEVANT, _TOP, _others, _relevant
from quillspan.plans.registered import Register
from quillspan.session import stored, working_path
from quillspan.sources.graph_store import EDGES, NODES

register = Register()


def _raw(part, body: str):
    return part.select(F.col("p_partkey").cast("string").alias("prompt_id"), F.expr(body).alias("raw"))


@register.add("f13_topic_entries", "part", oracle="SELECT CAST(p_partkey AS STRING) AS prompt_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'narrow' ELSE 'broad' END AS scope FROM part")
def topic_entries(part):
    responses = _raw(part, """to_json(array(named_struct('name', ' ' || p_name, 'scope', if(p_size % 2 = 0, 'narrow', 'wide')), named_struct('name', ' ', 'scope', 'x'), named_struct('name', 'beyond', 'scope', 'x')))""")
    return P.topic_entries(responses, responses.select("prompt_id", F.lit(2).alias("max_topics"))).select("prompt_id", "name", "scope")


@register.add("f15_subtopic_entries", "part", oracle="SELECT CAST(p_partkey AS STRING) AS prompt_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'all|topics' ELSE p_brand END AS parents, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS nested FROM part")
def subtopic_entries(part):
    responses = _raw(part, "to_json(named_struct('subtopics', array(named_struct('name', p_name, 'parent_topic', if(p_size % 2 = 0, ' ', p_brand), 'parent_subtopic', if(p_size % 3 = 0, p_type, null)))))")
    context = responses.select("prompt_id", F.array(F.lit("all"), F.lit("topics")).alias("topics"))
    return P.subtopic_entries(responses, context).select("prompt_id", "name", F.array_join("parents", "|").alias("parents"), F.array_join("parent_subtopics", "|").alias("nested"))


@register.add("f16_content_entries", "part", oracle="""SELECT CAST(p_partkey AS STRING) AS prompt_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'theorem' ELSE 'other' END AS content_type,
  rtrim(substring(repeat(p_name || ' ', 30), 1, 300)) AS raw_excerpt, p_type AS terms, 'c' || CAST(p_partkey AS STRING) AS evidence, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 's' END AS parents, CASE WHEN p_size % 4 = 1 THEN 'code: ' || p_type END AS picture FROM part""")
def content_entries(part):
    responses = _raw(part, "to_json(array(named_struct('title', p_name, 'content_type', if(p_size % 2 = 0, ' Theorem', 'poem'), 'parent_subtopic', if(p_size % 3 = 0, p_brand, ''), 'illustration_kind', if(p_size % 4 < 2, 'Code', 'chart'), 'illustration_hint', if(p_size % 4 > 0, p_type, ' '), 'raw_excerpt', repeat(p_name || ' ', 30), 'key_terms', array(p_type, lower(p_type), ' '))))")
    context = responses.select("prompt_id", F.concat(F.lit("c"), "prompt_id").alias("chunk_id"), F.array(F.lit("s")).alias("subtopics"), F.lit(3).alias("max_contents"))
    return P.content_entries(responses, context).select("prompt_id", "title", "content_type", "raw_excerpt", F.array_join("key_terms", "|").alias("terms"), F.get("evidence", F.lit(0)).alias("evidence"), F.array_join("parents", "|").alias("parents"), F.concat(F.col("illustration.kind"), F.lit(": "), F.col("illustration.hint")).alias("picture"))


@register.add("f31_to_text", "part", oracle="SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ' ' || p_type WHEN 1 THEN p_name ELSE '' END AS text FROM part")
def to_text(part):
    raw = F.expr("CASE p_size % 3 WHEN 0 THEN to_json(array(p_brand, p_type)) WHEN 1 THEN '\"' || p_name || '\"' ELSE 'null' END")
    return part.select("p_partkey", T.to_text(F.try_parse_json(raw)).alias("text"))


@register.add("f29_suggestions", "nodes")
def suggestions(nodes):
    return P.suggestions(nodes.withColumn("content_type", F.expr("CASE seq % 3 WHEN 0 THEN 'theorem' WHEN 1 THEN 'other' END")), 20)


@register.add("j3_evidence_trail", "nodes", "chunks", oracle="""SELECT key, 'doc_' || CAST(vec AS STRING) AS chunk_id, CASE WHEN vec % 2 = 0 THEN 1 ELSE 2 END AS ord FROM nodes WHERE vec IN (SELECT seq FROM chunks)
  UNION ALL SELECT key, 'doc_' || CAST(vec + 1 AS STRING), CASE WHEN vec % 2 = 0 THEN 2 ELSE 1 END FROM nodes WHERE vec + 1 IN (SELECT seq FROM chunks)""")
def evidence_trail(nodes, chunks):
    ids = F.expr("CASE WHEN vec % 2 = 0 THEN array('none', 'doc_' || vec, 'doc_' || (vec + 1), 'doc_' || vec) ELSE array('doc_' || (vec + 1), 'doc_' || vec) END")
    return P.evidence_trail(nodes.withColumn("source_ids", ids), chunks)


@register.add("j8_chunk_subtopics", "events", oracle="SELECT 'c' || CAST(user_id AS STRING) AS chunk_id, string_agg(DISTINCT lpad(CAST(event_id % 5 AS STRING), 2, '0'), ',' ORDER BY lpad(CAST(event_id % 5 AS STRING), 2, '0')) AS names FROM events GROUP BY 1")
def chunk_subtopics(events):
    rows = events.select((F.col("event_id") % 5).alias("seq"), F.lpad((F.col("event_id") % 5).cast("string"), 2, "0").alias("name"), F.array(F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("source_chunk_ids"))
    return P.subtopics_of_chunks(rows).select("chunk_id", F.array_join("names", ",").alias("names"))


@register.add("j15_pending_assets", "nodes", oracle="SELECT key, CASE WHEN vec % 4 = 0 THEN NULL ELSE 'slide' || CAST(vec AS STRING) END AS path FROM nodes WHERE node_type = 'content' AND seq % 3 > 0 AND seq % 5 > 0")
def pending_assets(nodes):
    marked = nodes.select("key", "node_type", F.expr("CASE WHEN seq % 3 > 0 THEN 'x' END").alias("hint"), F.expr("CASE WHEN seq % 5 = 0 THEN 'p' END").alias("illustration_path"), F.expr("array('c' || vec)").alias("source_ids"))
    found = nodes.select("vec").distinct()
    assets = found.where("vec % 4 > 0").select(F.expr("'c' || vec").alias("chunk_id"), F.explode(F.array(F.struct(F.expr("'slide' || vec").alias("path"), F.lit(0).alias("priority")), F.struct(F.expr("'file' || vec").alias("path"), F.lit(2).alias("priority")))).alias("a"))
    return P.pending_assets(marked, assets.select("chunk_id", "a.path", "a.priority"))


@register.add("v9_linkables", "nodes", oracle="SELECT key AS id, name || '. ' || summary AS text FROM nodes WHERE node_type IN ('topic', 'content')")
def linkables(nodes):
    return P.linkables(nodes, ("topic", "content"))


@register.add("p1_ingest_graph", "part", "nation", "region", oracle="SELECT 'content' AS node_type, count(*) AS nodes FROM part UNION ALL SELECT 'subtopic', count(*) FROM nation UNION ALL SELECT 'topic', count(*) FROM region")
def ingest_graph(part, nation, region):
    """Proposals to a pruned graph: merged twice over, which changes nothing, then without what stands alone."""
    once = bundle(part, nation, region)
    twice = bundle(part, nation, region, stored(once.nodes), stored(once.edges))
    return B.prune_isolated(twice.nodes, twice.edges).groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"))


_PART = "'Part ' || modality || ' ' || CAST({} % 8 AS STRING)"


def _ingested(chunks):
    """An ingest run over all documents' chunks with answers made by rule: two topics a source, a subtopic and a content a chunk."""
    said = lambda prompt, body: chunks.select(F.col(prompt).alias("prompt_id"), F.expr(body).alias("raw")).distinct()
    topics = said("source_id", "to_json(array(named_struct('name', 'About ' || source_id, 'scope', 'narrow'), named_struct('name', ' All ', 'scope', 'broad')))")
    subtopics = said("chunk_id", f"""to_json(array(named_struct('name', {_PART.format("seq")}, 'parent_topic', if(seq % 3 = 0, 'about ' || source_id, ''), 'parent_subtopic', if(seq % 7 = 0, {_PART.format("(seq + 1)")}, ''))))""")
    contents = said("chunk_id", "to_json(array(named_struct('title', 'Item ' || (seq % 100), 'content_type', 'definition', 'parent_subtopic', if(seq % 2 = 0, '', 'Part gone'), 'key_terms', array(modality, upper(modality)))))")
    spark = chunks.sparkSession
    labels = spark.range(20).select((F.col("id") * 0).alias("batch"), F.col("id").alias("index"), F.lit("Close to").alias("label"), F.lit(0.5).alias("confidence"))
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    return I.ingest(chunks, I.Responses(topics, subtopics, contents, labels), nodes, edges, lambda df: V.embed(df, features=64), band=(0.5, 0.95), max_pairs=10)


_P1_SQL = f"""s AS (SELECT chunk_id, source_id, seq, {_PART.format("seq")} AS part, {_PART.format("(seq + 1)")} AS above, 'Item ' || CAST(seq % 100 AS STRING) AS item FROM chunks),
  t AS (SELECT *, unnest(CASE WHEN seq % 3 = 0 THEN ['About ' || source_id] ELSE ['About ' || source_id, 'All'] END) AS topic FROM s),
  f AS (SELECT *, unnest(['About ' || source_id, 'All']) AS topic FROM s WHERE seq % 2 = 1)"""


@register.add("p1_ingest_edges", "chunks", oracle=f"""WITH {_P1_SQL}
  SELECT DISTINCT {_sql_key("topic", "topic")} AS src, {_sql_key("subtopic", "part")} AS dst, 'HAS_SUBTOPIC' AS relation, NULL AS chunks FROM t
  UNION ALL SELECT DISTINCT {_sql_key("subtopic", "above")}, {_sql_key("subtopic", "part")}, 'HAS_SUBTOPIC', NULL FROM s WHERE seq % 7 = 0 AND above IN (SELECT part FROM s)
  UNION ALL SELECT {_sql_key("subtopic", "part")} AS src, {_sql_key("content", "item")} AS dst, 'HAS_CONTENT', count(DISTINCT chunk_id) FROM s WHERE seq % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT {_sql_key("topic", "topic")} AS src, {_sql_key("content", "item")} AS dst, 'HAS_CONTENT', count(DISTINCT chunk_id) FROM f GROUP BY 1, 2""")
def ingest_edges(chunks):
    """The structural edges that the run leaves, with how many chunks stand behind each."""
    edges = _ingested(chunks).edges.where("relation <> 'RELATED_TO'")
    return edges.select("src", "dst", "relation", F.when(F.col("relation") == "HAS_CONTENT", F.size("source_chunk_ids").cast("long")).alias("chunks"))


@register.add("p1_ingest_warnings", "chunks", oracle=f"""WITH {_P1_SQL} SELECT 'Part gone' AS src, {_sql_key("content", "item")} AS dst, 'unknown subtopic' AS reason FROM s WHERE seq % 2 = 1""")
def ingest_warnings(chunks):
    return _ingested(chunks).warnings.select("src", "dst", "reason")


@register.add("w9_p3_quiz_context", "chunks", oracle="""WITH n AS (SELECT source_id AS quiz_id, seq AS ord, '[C' || lpad(CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) AS STRING), 3, '0') || ']' || CASE WHEN page_number IS NULL THEN '' ELSE ' (p. ' || CAST(page_number AS STRING) || ')' END || ' ' || text AS line FROM chunks),
  a AS (SELECT *, sum(length(line)) OVER (PARTITION BY quiz_id ORDER BY ord) AS total FROM n), f AS (SELECT * FROM a WHERE total <= 24000), m AS (SELECT quiz_id, max(total) AS taken FROM f GROUP BY 1),
  t AS (SELECT source_id AS quiz_id, seq AS ord, '- ' || modality AS line, sum(length('- ' || modality)) OVER (PARTITION BY source_id ORDER BY seq) AS total FROM chunks)
  SELECT quiz_id, 0 AS tier, ord, line FROM f UNION ALL SELECT t.quiz_id, 1, ord, line FROM t LEFT JOIN m USING (quiz_id) WHERE total + coalesce(taken, 0) <= 24000""")
def quiz_context(chunks):
    rows = chunks.select(F.col("source_id").alias("quiz_id"), "chunk_id", F.col("seq").alias("ord"), F.col("page_number").alias("page"), "text")
    lines = chunks.select(F.col("source_id").alias("quiz_id"), F.col("seq").alias("ord"), F.concat(F.lit("- "), "modality").alias("line"))
    return Q.quiz_context(rows, lines)[0]


@register.add("q5_deep_dive", "chunks", oracle="""WITH e AS (SELECT source_id AS question_id, chunk_id, text, seq, row_number() OVER (PARTITION BY source_id ORDER BY seq % 2, seq) AS r FROM chunks),
  o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq % 5 <> 0, r) AS rank FROM e), t AS (SELECT *, sum(length(text)) OVER (PARTITION BY question_id ORDER BY rank) AS total FROM o)
  SELECT question_id, chunk_id, rank FROM t WHERE total <= 4000""")
def deep_dive(chunks):
    rows = chunks.select(F.col("source_id").alias("question_id"), "chunk_id", F.col("seq").alias("rank"))
    graph = rows.withColumn("rank", F.col("rank") + 5)
    return Q.deep_dive_context(rows.where("rank % 2 = 0"), graph, rows.where("rank % 5 = 0"), chunks)


@register.add("a8_summary", "pages", "nation", oracle="""SELECT 'total' AS kind, CAST(count(*) FILTER (WHERE page_id % 10 > 0) AS STRING) || ' files read' AS text FROM pages
  UNION ALL SELECT 'total', CAST(count(*) FILTER (WHERE page_id % 10 = 0) AS STRING) || ' files failed' FROM pages UNION ALL SELECT 'warning', n_name FROM nation WHERE n_nationkey < 20""")
def summary(pages, nation):
    files = pages.select(F.col("url").alias("path"), F.expr("CASE WHEN page_id % 10 = 0 THEN 'bad' END").alias("error"))
    return P.ingest_summary(files, nation.select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("text")))


@register.add("a8_one_job", "pages", "nation", oracle="""SELECT 'total' AS kind, CAST(count(*) FILTER (WHERE page_id % 10 > 0) AS STRING) || ' files read' AS text FROM pages
  UNION ALL SELECT 'total', CAST(count(*) FILTER (WHERE page_id % 10 = 0) AS STRING) || ' files failed' FROM pages UNION ALL SELECT 'warning', n_name FROM nation WHERE n_nationkey < 20""")
def summary_in_one_job(pages, nation):
    """What was read is written, and counted by the same scan."""
    files = pages.select(F.col("url").alias("path"), "html", F.expr("CASE WHEN page_id % 10 = 0 THEN 'bad' END").alias("error"))
    return P.write_with_summary(files, working_path(pages.sparkSession, "files"), nation.select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("text")))


@register.add("p5_evaluation", "vectors", "vector_queries", "embeddings", oracle=f"""WITH {_TOP}, {_RELEVANT}, r AS (SELECT query_id, rank, (query_id, id) IN (SELECT query_id, id FROM rel) AS good FROM top WHERE id <> query_id),
  k AS (SELECT query_id, min(rank) FILTER (WHERE good) AS a, min(rank) FILTER (WHERE good AND rank <= 3) AS b FROM r GROUP BY 1)
  SELECT 'mrr' AS metric, round(avg(coalesce(1.0 / a, 0)), 6) AS top5, round(avg(coalesce(1.0 / b, 0)), 6) AS top3 FROM k""")
def evaluation(vectors, queries, embeddings):
    ranked = _others(vectors, queries)
    good = _relevant(embeddings, ranked)
    runs = [M.hit_rate_mrr(r, good, 5).select(F.lit(name).alias("system"), F.lit("mrr").alias("metric"), F.col("mrr").alias("value")) for name, r in (("top5", ranked), ("top3", ranked.where("rank <= 3")))]
    return M.compare_systems(runs[0].unionByName(runs[1]), ["top5", "top3"]).select("metric", F.round("top5", 6).alias("top5"), F.round("top3", 6).alias("top3"))


@register.add("v1_embed_search", "documents")
def embed_search(documents):
    """Hashed word vectors of all documents, and for those whose id 100 divides the five nearest of all."""
    embedded = V.embed(documents.select(F.col("doc_id").alias("id"), "text"), features=64).select("id", "embedding")
    return V.topk(embedded, embedded.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 5)
