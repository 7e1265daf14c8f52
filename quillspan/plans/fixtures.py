"""Views of the given tables as chunks, lines, segments, graph, questions and quizzes, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import read_table, stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> SQL for both, or (Spark's, DuckDB's).
VIEWS: dict[str, str | tuple[str, str]] = {
    "chunks": """
        SELECT 'doc_' || CAST(doc_id AS STRING) AS chunk_id, source AS source_id, doc_id AS seq, text,
               CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'slide' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' ELSE 'image' END AS modality,
               CASE WHEN doc_id % 5 < 2 THEN CAST(doc_id % 7 AS INT) END AS page_number, CAST(doc_id % 3 AS INT) AS page_start,
               CASE WHEN doc_id % 5 IN (2, 3) THEN CAST(doc_id * 1.5 AS DOUBLE) END AS start_time
        FROM {documents}""",
    "lines": (
        """SELECT CAST(doc_id AS STRING) AS source_id, CAST(pos AS INT) AS line_no, CAST(pos DIV 4 AS INT) + 1 AS page_number,
                  CASE WHEN length(line) <= 40 THEN 16.0D ELSE 11.0D END AS font_size, line AS text
           FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) AS pos, line""",
        """SELECT CAST(doc_id AS STRING) AS source_id, CAST(pos AS INT) AS line_no, CAST(pos // 4 AS INT) + 1 AS page_number,
                  CASE WHEN length(line) <= 40 THEN 16.0 ELSE 11.0 END AS font_size, line AS text
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {documents})""",
    ),
    "segments": (
        """SELECT CAST(user_id AS STRING) AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
                  CAST((unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')) / 1000000 AS DOUBLE) AS start,
                  CAST((unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')) / 1000000 AS DOUBLE) + 5 AS `end`, event_type AS text
           FROM {events}""",
        """SELECT CAST(user_id AS STRING) AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
                  CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE) / 1000000 AS start,
                  CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE) / 1000000 + 5 AS "end", event_type AS text
           FROM {events}""",
    ),
    "questions": """
        SELECT conv_id * 100 + turn AS query_id,
               CASE (conv_id + turn) % 10 WHEN 0 THEN 'What is ' || text WHEN 1 THEN 'Why ' || text WHEN 2 THEN 'Hello ' || text WHEN 3 THEN '  '
                    WHEN 4 THEN 'the effect on ' || text WHEN 5 THEN 'List ' || text WHEN 6 THEN 'is it' ELSE text END AS text
        FROM {conversations}""",
    "nodes": """
        SELECT 'topic:' || CAST(r_regionkey AS STRING) AS key, 'topic' AS node_type, r_name AS name, 'region ' || r_name AS summary,
               CAST(r_regionkey AS BIGINT) AS seq, CAST(r_regionkey AS BIGINT) AS vec FROM {region}
        UNION ALL SELECT 'subtopic:' || CAST(n_nationkey AS STRING), 'subtopic', n_name, 'nation ' || n_name, CAST(n_nationkey AS BIGINT) + 100, CAST(n_nationkey AS BIGINT) + 10 FROM {nation}
        UNION ALL SELECT 'content:' || CAST(p_partkey AS STRING), 'content', p_name, p_type, p_partkey + 1000, p_partkey % 450 + 50 FROM {part}""",
    "tree": """
        SELECT 'topic:' || CAST(n_regionkey AS STRING) AS src, 'subtopic:' || CAST(n_nationkey AS STRING) AS dst, 'HAS_SUBTOPIC' AS relation, CAST(n_nationkey AS BIGINT) AS seq FROM {nation}
        UNION ALL
        SELECT DISTINCT 'subtopic:' || CAST(s_nationkey AS STRING), 'content:' || CAST(l_partkey AS STRING), 'HAS_CONTENT', 1000 + l_partkey * 100 + s_nationkey
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "related": """
        SELECT 'content:' || CAST(a.l_partkey AS STRING) AS src, 'content:' || CAST(b.l_partkey AS STRING) AS dst, p_type AS label, a.l_quantity / 50 AS confidence,
               a.l_orderkey * 10 + a.l_linenumber AS seq
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber JOIN {part} ON p_partkey = a.l_partkey""",
    "proposals": """
        SELECT 'content:' || p_brand || ' ' || p_type AS key, 'content' AS node_type, p_brand || ' ' || p_type AS name, p_name AS summary,
               CASE WHEN p_size > 45 THEN 'narrow' ELSE 'broad' END AS scope, CASE WHEN p_size % 2 = 0 THEN 'other' ELSE 'technique' END AS content_type,
               p_name AS raw_excerpt, array(p_type, lower(p_type), p_brand) AS key_terms, array('order_' || CAST(l_orderkey AS STRING)) AS source_ids, l_orderkey * 10 + l_linenumber AS seq
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "vectors": "SELECT vec_id AS id, embedding FROM {embeddings}",
    "vector_queries": "SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 10 = 0",
    "responses": (
        """SELECT event_id AS query_id, CASE event_id % 6
             WHEN 0 THEN '```json\n{{"sub_questions": ["a ' || event_type || '", "", 3, " b "]}}\n```' WHEN 1 THEN '{{"sub_questions": []}}' WHEN 2 THEN 'no json'
             WHEN 3 THEN '{{"is_relevant": false, "is_supported": "false", "is_useful": 0}}' WHEN 4 THEN '[{{"is_relevant": 1}}, 2]' ELSE '{{"items": [{{"x": 1}}, {{"x": 2}}, "z"]}}' END AS raw, event_type AS text
           FROM {events}""",
        """SELECT event_id AS query_id, CASE event_id % 6
             WHEN 0 THEN '```json' || chr(10) || '{{"sub_questions": ["a ' || event_type || '", "", 3, " b "]}}' || chr(10) || '```' WHEN 1 THEN '{{"sub_questions": []}}' WHEN 2 THEN 'no json'
             WHEN 3 THEN '{{"is_relevant": false, "is_supported": "false", "is_useful": 0}}' WHEN 4 THEN '[{{"is_relevant": 1}}, 2]' ELSE '{{"items": [{{"x": 1}}, {{"x": 2}}, "z"]}}' END AS raw, event_type AS text
           FROM {events}""",
    ),
    "quiz": """
        SELECT 'quiz_' || CAST(o_custkey % 50 AS STRING) AS quiz_id, 'q_' || CAST(o_orderkey AS STRING) AS question_id, o_orderkey AS seq,
               CASE o_orderkey % 3 WHEN 0 THEN 'true_false' WHEN 1 THEN 'multiple_choice' ELSE 'short_answer' END AS question_type,
               CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'B) ' || o_orderpriority ELSE o_orderpriority || ' priority order of customer ' || CAST(o_custkey AS STRING) END AS correct_answer
        FROM {orders}""",
    "submissions": """
        SELECT 'quiz_' || CAST(o_custkey % 50 AS STRING) AS quiz_id, 'q_' || CAST(o_orderkey AS STRING) AS question_id,
               CASE o_orderkey % 7 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'b' WHEN 2 THEN o_orderpriority || ' order' WHEN 3 THEN '' WHEN 4 THEN 'false' WHEN 5 THEN 'customer priority' ELSE 'b) ' || lower(o_orderpriority) END AS user_answer
        FROM {orders} WHERE o_orderkey % 11 <> 5""",
}


#: Views that are joins of large tables, and that most queries read several times: made once a query.
MADE_ONCE = ("tree", "related")


def tree(nation: DataFrame, supplier: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The rows of the view of this name: pairs of a nation and a part are made distinct as numbers, before they become keys of text."""
    key = lambda kind, number: F.concat(F.lit(kind), F.col(number).cast("string"))
    above = nation.select(key("topic:", "n_regionkey").alias("src"), key("subtopic:", "n_nationkey").alias("dst"), F.lit("HAS_SUBTOPIC").alias("relation"), F.col("n_nationkey").cast("long").alias("seq"))
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct().join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").select("s_nationkey", "l_partkey").distinct()
    below = pairs.select(key("subtopic:", "s_nationkey").alias("src"), key("content:", "l_partkey").alias("dst"), F.lit("HAS_CONTENT").alias("relation"), (F.lit(1000) + F.col("l_partkey") * 100 + F.col("s_nationkey")).alias("seq"))
    return above.unionByName(below)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the given tables by its own name."""
    if name in TABLES:
        return read_table(spark, sf_dir, name)
    text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    used = {t: read_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    made = tree(*(used[t] for t in ("nation", "supplier", "lineitem"))) if name == "tree" else spark.sql(text, **used)
    return stored(made, name) if name in MADE_ONCE else made


def sql(body: str, *views: str) -> str:
    """DuckDB SQL of `body` with the views in front of it."""
    parts = []
    for name in views:
        text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][1]
        text = text.replace("{{", "\0").replace("}}", "\1")
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        text = text.replace("\0", "{").replace("\1", "}").replace("array(", "list_value(")
        parts.append(f"{name} AS ({text})")
    body = body.strip()
    if not parts:
        return body
    return "WITH " + ("RECURSIVE " if body.startswith("RECURSIVE") else "") + ", ".join(parts) + (", " + body.removeprefix("RECURSIVE").strip().removeprefix("WITH").strip() if body.startswith(("WITH", "RECURSIVE")) else " " + body)
