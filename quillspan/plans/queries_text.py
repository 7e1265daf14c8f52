"""Queries of the text functions, the store and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.tables import register_table_functions
from quillspan.operators import chunking as C
from quillspan.operators import retrieval as R
from quillspan.plans.registered import Register
from quillspan.sources import store as S

register = Register()
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_WORDS = "list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+') AND NOT list_contains([{}], w))".replace("{{", "{").replace("}}", "}").replace("[{}]", "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]")


def _starts(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


def _has(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


_Q = f"lower({_strip('text')})"
_ROUTE = f"""CASE WHEN {_Q} = '' THEN 'none' WHEN {_starts(_Q, T.GRAPH_PREFIXES)} OR {_has(_Q, T.GRAPH_SIGNALS)} THEN 'graph'
  WHEN {_starts(_Q, T.DENSE_PREFIXES)} THEN 'dense' WHEN {_starts(_Q, T.GREETINGS)} THEN 'none' WHEN len({_WORDS}) < 3 THEN 'none' END"""


@register.add("f1_f2_keys", "part", oracle=f"""SELECT p_partkey, regexp_replace(lower({_strip('p_name')}), '\\s+', ' ', 'g') AS canonical,
  'content:' || substring(sha1(regexp_replace(lower({_strip('p_name')}), '\\s+', ' ', 'g')), 1, 12) AS key FROM part""")
def keys(part):
    return part.select("p_partkey", T.canon("p_name").alias("canonical"), T.make_key("content", "p_name").alias("key"))


@register.add("f3_labels", "part", oracle="""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'related_to') AS label FROM part""")
def labels(part):
    return part.select("p_partkey", T.norm_label("p_type").alias("label"))


@register.add("f4_node_text", "nodes", oracle=f"SELECT key, {_strip("name || '. ' || summary")} AS text FROM nodes")
def node_text(nodes):
    return nodes.select("key", T.node_text("name", "summary").alias("text"))


@register.add("f5_f6_hits", "questions", oracle="""SELECT query_id, contains(lower(text), 'on') OR contains(lower(text), 'er th') AS term_hit, contains(lower(text), 'the') AS hit FROM questions""")
def hits(questions):
    terms = F.array(F.lit(" On "), F.lit(""), F.lit("er th"))
    return questions.select("query_id", T.key_term_hit(terms, F.col("text")).alias("term_hit"), T.name_hit(F.lit("The"), F.col("text")).alias("hit"))


@register.add("f7_content_words", "questions", oracle=f"SELECT query_id, array_to_string({_WORDS}, ' ') AS words FROM questions")
def content_words(questions):
    return questions.select("query_id", F.array_join(T.content_words("text"), " ").alias("words"))


@register.add("f8_f9_routing", "questions", oracle=f"SELECT query_id, {_ROUTE} AS heuristic, coalesce({_ROUTE}, 'dense') AS mode FROM questions")
def routing(questions):
    return questions.select("query_id", T.route_heuristic("text").alias("heuristic"), T.route("text").alias("mode"))


@register.add("f10_mode_words", "events", oracle="""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'none' WHEN 2 THEN 'dense' ELSE 'graph' END AS mode FROM events""")
def mode_words(events):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN ' \"Graph\". ' WHEN 1 THEN 'I say none of ' || event_type WHEN 2 THEN event_type ELSE 'none? no: graph' END")
    return events.select("event_id", T.parse_mode(raw).alias("mode"))


@register.add("f11_f12_items", "responses", oracle="""SELECT query_id, CASE query_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END AS items FROM responses""")
def items(responses):
    return responses.select("query_id", F.size(T.parse_items("raw")).alias("items"))


@register.add("f14_f17_caps", "documents", oracle="""SELECT doc_id, CASE WHEN length(text) < 500 THEN 1 WHEN length(text) < 1500 THEN 2 ELSE 3 END AS topics,
  CASE WHEN length(text) < 500 THEN 3 WHEN length(text) < 1500 THEN 5 WHEN length(text) < 3000 THEN 7 ELSE 10 END AS contents FROM documents""")
def caps(documents):
    return documents.select("doc_id", T.topic_cap(F.length("text")).alias("topics"), T.content_cap(F.length("text")).alias("contents"))


@register.add("f18_terms", "part", oracle="SELECT p_partkey, p_brand || '|' || p_type || CASE WHEN lower(p_type) = lower(p_name) THEN '' ELSE '|' || p_name END AS terms FROM part")
def terms(part):
    raw = F.array(F.concat(F.lit(" "), "p_brand"), F.lit("  "), F.col("p_type"), F.upper("p_brand"), F.lower("p_type"), F.col("p_name"))
    return part.select("p_partkey", F.array_join(T.clean_terms(raw), "|").alias("terms"))


@register.add("f19_illustrations", "part", oracle="SELECT p_partkey, CASE WHEN p_size % 6 < 4 AND p_size % 5 > 0 THEN (['diagram', 'equation', 'code', 'image'])[p_size % 6 + 1] END AS kind FROM part")
def illustrations(part):
    kind = F.expr("element_at(array('diagram', ' Equation', 'CODE', 'image ', 'chart', 'table'), p_size % 6 + 1)")
    return part.select("p_partkey", T.illustration(kind, F.expr("CASE WHEN p_size % 5 = 0 THEN '  ' ELSE p_name END"))["kind"].alias("kind"))


@register.add("f20_sub_questions", "responses", oracle="""SELECT query_id, unnest(CASE WHEN query_id % 6 = 0 THEN ['a ' || text, 'b'] ELSE [text] END) AS text,
  CAST(unnest(CASE WHEN query_id % 6 = 0 THEN [0, 1] ELSE [0] END) AS INT) AS sub_id FROM responses""")
def sub_questions(responses):
    return R.sub_questions(responses.select("query_id", "text"), responses.select("query_id", "raw"))


@register.add("f21_verdicts", "responses", oracle="""SELECT query_id, true AS needs_retrieval, query_id % 6 <> 3 AS is_relevant, true AS is_supported, query_id % 6 <> 3 AS is_useful FROM responses""")
def verdicts(responses):
    return R.verdicts(responses)


@register.add("f22_evidence", "chunks", oracle="""SELECT chunk_id, substring(text, 1, 500) AS text, coalesce(nullif(page_number, 0), nullif(page_start, 0)) AS page,
  CASE WHEN start_time IS NOT NULL THEN CAST(CAST(floor(floor(start_time) / 60) AS BIGINT) AS STRING) || ':' || lpad(CAST(CAST(floor(start_time) AS BIGINT) % 60 AS STRING), 2, '0') END AS timestamp FROM chunks""")
def evidence(chunks):
    return R.evidence(chunks)


@register.add("f23_links", "chunks", oracle="""SELECT chunk_id, CASE WHEN modality IN ('pdf', 'slide') THEN source_id || '#page=' || CAST(page_number AS STRING)
  WHEN modality IN ('video', 'audio') THEN source_id || '#t=' || CAST(60 * (seq % 90) + 7 AS STRING) ELSE source_id END AS link FROM chunks""")
def links(chunks):
    stamp = F.concat((F.col("seq") % 90).cast("string"), F.lit(":07"))
    return chunks.select("chunk_id", T.deep_link(F.col("source_id"), F.col("modality"), F.col("page_number"), stamp).alias("link"))


@register.add("f27_sigmoid", "lineitem", oracle="SELECT l_orderkey, l_linenumber, round_even(1 / (1 + exp(-(l_quantity - 25) / 10)), 4) AS relevancy FROM lineitem")
def sigmoid(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", T.sigmoid4((F.col("l_quantity") - 25) / 10).alias("relevancy"))


@register.add("s2_modality", "pages", oracle="""WITH e(k, ext, kind) AS (VALUES (0, 'mp4', 'video'), (1, 'mkv', 'video'), (2, 'mov', 'video'), (3, 'avi', 'video'), (4, 'mp3', 'audio'), (5, 'wav', 'audio'), (6, 'm4a', 'audio'), (7, 'ogg', 'audio'), (8, 'flac', 'audio'),
  (9, 'aac', 'audio'), (10, 'wma', 'audio'), (11, 'jpg', 'image'), (12, 'jpeg', 'image'), (13, 'png', 'image'), (14, 'webp', 'image'), (15, 'pdf', 'pdf'))
  SELECT page_id, CASE WHEN kind = 'pdf' AND page_id % 40 = 15 THEN 'slide' ELSE kind END AS modality FROM pages JOIN e ON page_id % 20 = k""")
def modality(pages):
    files = pages.select("page_id", F.expr("url || '/' || page_id || element_at(array('.MP4', '.mkv', '.mov', '.avi', '.mp3', '.WAV', '.m4a', '.ogg', '.flac', '.aac', '.wma', '.jpg', '.jpeg', '.PNG', '.webp', '.pdf', '.webm', '.bmp', '.gif', '.txt'), CAST(page_id % 20 AS INT) + 1)").alias("path"))
    return S.classify_modality(files, pages.where("page_id % 40 = 15").select(F.expr("page_id || '.pdf'").alias("name"))).select("page_id", "modality")


@register.add("s4_lookup", "chunks", "embeddings", oracle="SELECT chunk_id, modality, length(text) AS size FROM chunks WHERE seq IN (SELECT vec_id FROM embeddings)")
def lookup(chunks, embeddings):
    ids = embeddings.select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("chunk_id"))
    return S.lookup(chunks, ids).select("chunk_id", "modality", F.length("text").alias("size"))


@register.add("u5_missing", "chunks", "embeddings", oracle="SELECT 'doc_' || CAST(vec_id * 2 + 100 AS STRING) AS chunk_id FROM embeddings WHERE vec_id * 2 + 100 NOT IN (SELECT seq FROM chunks)")
def missing(chunks, embeddings):
    return S.missing(chunks, embeddings.select(F.concat(F.lit("doc_"), (F.col("vec_id") * 2 + 100).cast("string")).alias("chunk_id")))


@register.add("s5_by_source", "chunks", oracle="SELECT source_id, count(*) AS chunks, min(seq) AS first_seq FROM chunks GROUP BY source_id")
def by_source(chunks):
    return chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("seq").alias("first_seq"))


@register.add("s6_upsert", "chunks", oracle="""SELECT chunk_id, CASE WHEN seq % 4 = 0 THEN 'new ' || modality ELSE modality END AS modality FROM chunks
  UNION ALL SELECT chunk_id || '_b', 'new ' || modality FROM chunks WHERE seq % 4 = 0 AND seq % 3 = 0""")
def upsert(chunks):
    old = chunks.select("chunk_id", "modality", "seq")
    changed = old.where("seq % 4 = 0").withColumn("modality", F.concat(F.lit("new "), "modality"))
    stale = changed.withColumn("modality", F.lit("stale")).withColumn("seq", F.col("seq") - 1)
    added = changed.where("seq % 3 = 0").withColumn("chunk_id", F.concat("chunk_id", F.lit("_b")))
    return S.upsert(old, changed.unionByName(stale).unionByName(added)).select("chunk_id", "modality")


@register.add("s7_delete", "chunks", "nation", oracle="""SELECT 'src' || CAST(n_nationkey AS STRING) AS source_id, (SELECT count(*) FROM chunks WHERE source_id = 'src' || CAST(n_nationkey AS STRING)) AS removed FROM nation WHERE n_nationkey % 3 = 0""")
def delete(chunks, nation):
    return S.delete_source(chunks, nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source_id")))[1]


@register.add("s9_counts", "chunks", "nodes", "tree", oracle="SELECT 'chunks' AS name, count(*) AS rows FROM chunks UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM tree")
def counts(chunks, nodes, tree):
    return S.table_counts(chunks=chunks, nodes=nodes, edges=tree)


@register.add("s11_export_edges", "nodes", "related", oracle="""SELECT src, dst, 'RELATED_TO' AS relation, label, confidence FROM related
  WHERE src IN (SELECT key FROM nodes WHERE seq % 3 > 0) AND dst IN (SELECT key FROM nodes WHERE seq % 3 > 0)""")
def export_edges(nodes, related):
    marked = nodes.withColumn("node_type", F.expr("CASE WHEN seq % 3 = 0 THEN 'chunk_ref' ELSE node_type END"))
    return S.export_graph(marked, related.withColumn("relation", F.lit("RELATED_TO")))[1]


@register.add("s13_image_chunks", "pages", oracle="SELECT CAST(page_id AS STRING) || '_image_0' AS chunk_id, CASE WHEN page_id % 3 = 0 THEN '[Image: ' || url || ']' ELSE 'picture of ' || url END AS text FROM pages")
def image_chunks(pages):
    images = pages.select(F.col("page_id").cast("string").alias("source_id"), F.col("url").alias("name"), F.expr("CASE WHEN page_id % 3 = 0 THEN '  ' ELSE 'picture of ' || url END").alias("caption"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    return S.image_chunks(images).select("chunk_id", "text")


@register.add("s14_slide_chunks", "documents", oracle=f"""SELECT source || '_slide_' || CAST(doc_id AS STRING) AS chunk_id,
  CASE WHEN doc_id % 2 = 0 THEN '[Visual: ' || lang || '] ' ELSE '' END || {_strip('text')} AS text, {_strip("string_split(text, chr(10))[1]")} AS slide_title FROM documents""")
def slide_chunks(documents):
    pages = documents.select(F.col("source").alias("source_id"), F.col("doc_id").alias("page_number"), "text", F.expr("CASE WHEN doc_id % 2 = 0 THEN lang END").alias("caption"))
    return S.slide_chunks(pages).select("chunk_id", "text", "slide_title")


@register.add("c1_sections", "lines", oracle="""WITH marked AS (SELECT *, font_size >= 14 AS heading, sum(CASE WHEN font_size >= 14 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_no) AS sec FROM lines)
  SELECT source_id, sec, max(text) FILTER (WHERE heading) AS title, string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE NOT heading) AS text,
         arg_min(page_number, line_no) AS page_start, arg_max(page_number, line_no) FILTER (WHERE NOT heading) AS page_end
  FROM marked GROUP BY source_id, sec HAVING count(*) FILTER (WHERE NOT heading) > 0""")
def sections(lines):
    return C.sectionize(lines)


_HARD = """RECURSIVE cuts AS (
    SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS rest, 0 AS part, NULL::VARCHAR AS piece FROM documents
    UNION ALL
    SELECT doc_id, CASE WHEN length(rest) <= 400 THEN '' ELSE regexp_replace(substring(rest, cut_at + 1), '^\\s+|\\s+$', '', 'g') END, part + 1,
           CASE WHEN length(rest) <= 400 THEN rest ELSE regexp_replace(substring(rest, 1, cut_at), '^\\s+|\\s+$', '', 'g') END
    FROM (SELECT *, CASE WHEN contains(substring(rest, 1, 400), '. ') THEN 400 - strpos(reverse(substring(rest, 1, 400)), ' .') ELSE 400 END AS cut_at FROM cuts) WHERE rest <> ''
  )"""


@register.add("c3_hard_split", "documents", oracle=f"WITH {_HARD} SELECT doc_id AS id, CAST(part - 1 AS INT) AS part, piece AS text FROM cuts WHERE part > 0", oracle_views=())
def hard_split(documents):
    return C.hard_split(documents.select(F.col("doc_id").alias("id"), T.strip("text").alias("text")), 400)


#: Sections longer than 400 characters, of paragraphs between blank lines: cut, then put together as far as they fit.
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PACKED = f"""RECURSIVE sections AS (SELECT doc_id, {{text}} AS text FROM documents WHERE text IS NOT NULL),
  paragraphs AS (SELECT doc_id, pos, {_STRIP.format("p")} AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS pos FROM sections WHERE length(text) > 400) WHERE {_STRIP.format("p")} <> ''),
  cuts AS (
    SELECT doc_id, pos, p AS rest, 0 AS part, NULL::VARCHAR AS piece FROM paragraphs
    UNION ALL
    SELECT doc_id, pos, CASE WHEN length(rest) <= 400 THEN '' ELSE {_STRIP.format("substring(rest, cut_at + 1)")} END, part + 1, CASE WHEN length(rest) <= 400 THEN rest ELSE {_STRIP.format("substring(rest, 1, cut_at)")} END
    FROM (SELECT *, CASE WHEN contains(substring(rest, 1, 400), '. ') THEN 400 - strpos(reverse(substring(rest, 1, 400)), ' .') ELSE 400 END AS cut_at FROM cuts) WHERE rest <> ''
  ), pieces AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS i FROM cuts WHERE part > 0),
  packed AS (
    SELECT doc_id, i, 0 AS part, length(piece) AS size, piece FROM pieces WHERE i = 1
    UNION ALL
    SELECT n.doc_id, n.i, CASE WHEN k.size + length(n.piece) <= 400 THEN k.part ELSE k.part + 1 END, CASE WHEN k.size + length(n.piece) <= 400 THEN k.size + length(n.piece) ELSE length(n.piece) END, n.piece
    FROM packed k JOIN pieces n ON n.doc_id = k.doc_id AND n.i = k.i + 1
  )
  SELECT doc_id, CAST(part AS INT) AS part, string_agg(piece, chr(10) || chr(10) ORDER BY i) AS text FROM packed GROUP BY doc_id, part
  UNION ALL SELECT doc_id, 0, text FROM sections WHERE length(text) <= 400"""

#: Windows of 1200 characters that share about 100: each ends behind the last sentence or line end in it, unless it is the last.
_SEG = "substring(text, start_at + 1, 1200)"
_WINDOWS = f"""RECURSIVE w AS (
    SELECT doc_id, text, CAST(0 AS BIGINT) AS start_at, CAST(-1 AS BIGINT) AS begun, NULL::VARCHAR AS piece FROM documents WHERE length(text) > 1200
    UNION ALL
    SELECT doc_id, text, CASE WHEN stop >= length(text) THEN length(text) ELSE greatest(start_at + 1, stop - 100) END, start_at, {_STRIP.format("substring(text, start_at + 1, stop - start_at)")}
    FROM (SELECT *, CASE WHEN start_at + 1200 < length(text) AND mark > 0 THEN start_at + mark + 1 ELSE start_at + 1200 END AS stop
      FROM (SELECT *, greatest(CASE WHEN contains({_SEG}, '. ') THEN 1199 - strpos(reverse({_SEG}), ' .') ELSE -1 END, CASE WHEN contains({_SEG}, '.' || chr(10)) THEN 1199 - strpos(reverse({_SEG}), chr(10) || '.') ELSE -1 END,
                               CASE WHEN contains({_SEG}, chr(10)) THEN 1200 - strpos(reverse({_SEG}), chr(10)) ELSE -1 END) AS mark FROM w WHERE start_at < length(text)))
  )
  SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY begun) - 1 AS INT) AS win_no, piece AS win_text FROM w WHERE piece <> ''
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 1200"""


@register.add("c2_split_sections", "documents", oracle=f"WITH {_PACKED.format(text='text')}", oracle_views=())
def split_sections(documents):
    return C.split_sections(documents.select("doc_id", "text"), 400)


@register.add("x4_section_parts", "documents", oracle=f"WITH {_PACKED.format(text='replace(text, chr(10), chr(10) || chr(10))')}", oracle_views=())
def section_parts(documents):
    """The same as a table function in SQL, over texts whose lines are paragraphs."""
    register_table_functions(documents.sparkSession)
    return documents.sparkSession.sql("SELECT d.doc_id, p.part, p.piece AS text FROM {documents} d, LATERAL section_parts(replace(d.text, '\n', '\n\n'), 400) p", documents=documents)


@register.add("c4_j9_chunk_images", "lines", "pages", oracle="""WITH marked AS (SELECT *, sum(CASE WHEN font_size >= 14 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_no) AS sec, font_size >= 14 AS heading FROM lines),
  s AS (SELECT source_id, sec, arg_min(page_number, line_no) AS page_start, arg_max(page_number, line_no) FILTER (WHERE NOT heading) AS page_end FROM marked GROUP BY source_id, sec HAVING count(*) FILTER (WHERE NOT heading) > 0),
  c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sec) - 1 AS seq FROM s),
  i AS (SELECT CAST(page_id AS STRING) AS source_id, CAST(unnest([1, 2, 3]) AS INT) AS page_number FROM pages)
  SELECT c.source_id || '_chunk_' || CAST(seq AS STRING) AS chunk_id, count(i.page_number) AS images FROM c LEFT JOIN i ON i.source_id = c.source_id AND i.page_number BETWEEN page_start AND page_end GROUP BY 1""")
def chunk_images(lines, pages):
    parts = C.sectionize(lines).withColumn("part", F.lit(0))
    images = pages.select(F.col("page_id").cast("string").alias("source_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page_number")).withColumn("path", F.concat_ws("_", "source_id", "page_number"))
    return C.section_chunks(parts, images).select("chunk_id", F.coalesce(F.size("image_paths"), F.lit(0)).cast("long").alias("images"))


@register.add("c5_windows", "segments", oracle="""WITH w AS (SELECT source_id, CAST(floor(start / 3600) AS BIGINT) AS slot, string_agg(text, ' ' ORDER BY seq) AS text, arg_max("end", seq) AS end_time FROM segments GROUP BY 1, 2)
  SELECT source_id || '_chunk_' || CAST(row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS STRING) AS chunk_id, source_id, text, CAST(slot * 3600 AS DOUBLE) AS start_time, end_time FROM w""")
def windows(segments):
    return C.window_chunks(segments, 3600.0)


@register.add("c6_j10_keyframes", "segments", oracle="""WITH k AS (SELECT source_id, start AS mark, max('kf ' || CAST(seq AS STRING)) AS caption FROM segments WHERE text = 'signup' GROUP BY 1, 2),
  b AS (SELECT source_id, mark, max(caption) AS caption FROM (SELECT * FROM k UNION ALL SELECT DISTINCT source_id, 0.0, NULL FROM segments) GROUP BY 1, 2),
  s AS (SELECT x.source_id, x.seq, x.text, x."end", (SELECT max(mark) FROM b WHERE b.source_id = x.source_id AND b.mark <= x.start) AS mark FROM segments x),
  g AS (SELECT b.source_id, b.mark AS start_time, coalesce(arg_max(s."end", s.seq), b.mark) AS end_time,
               concat_ws(' ', '[Visual: ' || any_value(b.caption) || ']', string_agg(s.text, ' ' ORDER BY s.seq)) AS text
        FROM b LEFT JOIN s ON s.source_id = b.source_id AND s.mark = b.mark GROUP BY 1, 2)
  SELECT source_id || '_chunk_' || CAST(row_number() OVER (PARTITION BY source_id ORDER BY start_time) - 1 AS STRING) AS chunk_id, source_id, text, start_time, end_time FROM g WHERE text <> ''""")
def keyframes(segments):
    frames = segments.where("text = 'signup'").select("source_id", F.col("start").alias("ts"), F.expr("'kf ' || seq").alias("caption"))
    return C.keyframe_chunks(segments, frames)


@register.add("c7_change_points", "embeddings", oracle="""WITH f AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings WHERE vec_id % 2 = 0)
  SELECT CAST(label AS STRING) AS video_id, vec_id AS frame_idx, vec_id / 2.0::DOUBLE AS ts, round(list_inner_product(embedding::DOUBLE[], before::DOUBLE[]), 6) AS similarity FROM f
  WHERE before IS NOT NULL AND list_inner_product(embedding::DOUBLE[], before::DOUBLE[]) < 0.05""")
def change_points(embeddings):
    frames = embeddings.select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("frame_idx"), F.lit(2.0).alias("fps"), F.col("embedding").alias("feature"))
    return C.change_points(frames, 0.05).withColumn("similarity", F.round("similarity", 6))


@register.add("c8_overlap_windows", "documents", oracle=f"WITH {_WINDOWS}", oracle_views=())
def overlap_windows(documents):
    return C.overlap_windows(documents.select(F.col("doc_id").alias("id"), "text"))


@register.add("x4_overlap_windows", "documents", oracle=f"WITH {_WINDOWS}", oracle_views=())
def overlap_windows_sql(documents):
    register_table_functions(documents.sparkSession)
    return documents.sparkSession.sql("SELECT d.doc_id AS id, p.* FROM {documents} d, LATERAL overlap_windows(d.text, 1200, 100) p", documents=documents)


@register.add("x4_hard_split", "documents", oracle=f"WITH {_HARD} SELECT doc_id AS id, CAST(part - 1 AS INT) AS part, piece FROM cuts WHERE part > 0", oracle_views=())
def hard_split_sql(documents):
    register_table_functions(documents.sparkSession)
    trimmed = documents.withColumn("text", T.strip("text"))
    return documents.sparkSession.sql("SELECT d.doc_id AS id, p.* FROM {documents} d, LATERAL hard_split(d.text, 400) p", documents=trimmed)


@register.add("c9_preview", "chunks", oracle="""SELECT source_id, substring('Source files: ' || string_agg(DISTINCT source_id || '_' || modality, ', ' ORDER BY source_id || '_' || modality) || chr(10) || chr(10)
  || string_agg(text, chr(10) || chr(10) ORDER BY seq) FILTER (WHERE trim(text) <> ''), 1, 3000) AS preview FROM chunks GROUP BY source_id""")
def preview(chunks):
    return C.doc_preview(chunks, files=chunks.select("source_id", F.concat("source_id", F.lit("_"), "modality").alias("name")))
