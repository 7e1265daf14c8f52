"""The registered queries of this subpackage, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bpe, exact_dedup, line_dedup, main_text, merkle, ngram_join, packing, spotsigs, token_counts, toxicity, turn_repair, url_filter, warc_zip
from quillspan.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed tokenizer collection."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, row_no, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), common AS (
  SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, coalesce(c.keeper <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN common c USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row_no
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


#: In DuckDB: a text with A-Z lower-cased and nothing else.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.bpe_encode(read_table(spark, sf_dir, "documents"), path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside an edited form: its last quarter gives way to the beginning of the next document.

    Texts are shuffled once, into ranges of ids, and their signatures are worked out once. near_group is the smallest id
    among a document's near copies in the whole table; near_edited and near_next are given whole, also where they are
    below the similarity of near copies. Rows that repeat an id are documents of their own.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return edited_fingerprints(spotsigs.with_next(docs, "doc_id", ["text"], {"own": spotsigs.signatures(F.col("text"))}))


def edited_fingerprints(pairs: DataFrame) -> DataFrame:
    """The rows of op6_spotsigs, of (doc_id, text, own, following (text, own))."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("following.text"), F.lit(1), cut))
    sets = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), "own", spotsigs.signatures(edited).alias("edited"), F.col("following.own").alias("next")
    )
    # most signatures are those of the text itself, so the edited text's are kept as what it has lost and gained
    lost, gained = F.array_except("own", "edited").alias("lost"), F.array_except("edited", "own").alias("gained")
    rows = spotsigs.set_rows(
        sets.select("doc_id", "n_chars", "edited_sha256", "own", lost, gained, spotsigs.likeness(F.col("own"), F.col("edited")).alias("near_edited"), spotsigs.likeness(F.col("own"), F.col("next")).alias("near_next")), "doc_id", "own"
    )
    groups = spotsigs.near_groups(rows)
    # most documents are a group of their own; only the others are joined
    joined = groups.where(~F.col("near_group").eqNullSafe(F.col("id"))).select("row_no", F.struct("near_group").alias("joined"))
    return rows.join(joined, "row_no", "left").select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        spotsigs.fingerprint(F.col("signatures")).alias("fingerprint"),
        spotsigs.fingerprint(F.array_sort(F.concat(F.array_except("signatures", "lost"), "gained"))).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.when(F.col("joined").isNull(), F.col("id")).otherwise(F.col("joined.near_group")).alias("near_group"),
    )


#: The rules of the page query: verdict, host, path.
PAGE_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), [url_filter.host_rule(*r) for r in PAGE_RULES])


OP7_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/]*(.*)$', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (VALUES {", ".join(map(str, PAGE_RULES))}),
best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(r.verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN {" OR ".join(f"regexp_matches(p.host || p.path, '{r.pattern}')" for r in url_filter.DEFAULT_RULES)} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.toxicity_scores(docs, labels, ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"), words=3, numer=90, denom=100)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_zip.warc_round_trip(read_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p
), b AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''),
            lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM d
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT)
         + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT)
         + CAST(substr(bits, i * 5 + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII text in DuckDB, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"


def _row_fields(n_chars: Column) -> list[Column]:
    return [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language, and every document's proof; some are presented with one character too many counted."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    proved = merkle.manifest(docs, "doc_id", "lang", merkle.row_digest(_row_fields(F.col("n_chars"))), merkle.row_digest(_row_fields(more))).prove()
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


_OP11_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_OP11_LEAF.format(n="n_chars")} AS leaf, {_OP11_LEAF.format(n="bumped")} AS shown
  FROM (SELECT *, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS bumped
        FROM (SELECT *, {_crc32_sql('CAST(doc_id AS VARCHAR)')} AS crc FROM documents))
), langs AS (
  SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM d GROUP BY lang
), leaves AS (
  SELECT d.*, l.n, l.tree, l.trees, row_number() OVER (PARTITION BY l.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM d JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang
), nodes(tree, level, idx, n, digest) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
), tops(level, idx, n, digest) AS (
  SELECT 0, tree, (SELECT count(*) FROM langs), digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n
), steps AS (
  SELECT l.rid, n.level, n.digest, n.idx < xor(n.idx, 1) AS is_left
  FROM leaves l, unnest(range(40)) AS u(k) JOIN nodes n ON n.tree = l.tree AND n.level = u.k AND n.idx = xor(l.idx >> u.k, 1)
  UNION ALL
  SELECT l.rid, 1000 + t.level, t.digest, t.idx < xor(t.idx, 1)
  FROM leaves l, unnest(range(40)) AS u(k) JOIN tops t ON t.level = u.k AND t.idx = xor(l.tree >> u.k, 1)
), proofs AS (
  SELECT rid, sha256(string_agg(digest, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY rid
), folds(rid, level, n, crown, digest) AS (
  SELECT rid, 0, n, false, shown FROM leaves
  UNION ALL
  SELECT f.rid, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.n = 1 THEN l.trees ELSE (f.n + 1) // 2 END, f.crown OR f.n = 1,
         CASE WHEN f.n = 1 THEN f.digest WHEN s.digest IS NULL THEN sha256(f.digest) WHEN s.is_left THEN sha256(s.digest || f.digest) ELSE sha256(f.digest || s.digest) END
  FROM folds f JOIN leaves l USING (rid) LEFT JOIN steps s ON s.rid = f.rid AND s.level = f.level + CASE WHEN f.crown THEN 1000 ELSE 0 END AND f.n > 1
  WHERE NOT (f.crown AND f.n = 1)
), roots AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM leaves l CROSS JOIN roots JOIN nodes s ON s.tree = l.tree AND s.n = 1 JOIN folds f ON f.rid = l.rid AND f.crown AND f.n = 1 LEFT JOIN proofs p ON p.rid = l.rid
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by their crc32; rows taken out are not `present`."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"), F.monotonically_increasing_id().alias("tie"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "tie", copies, (F.col("kind") != 0).alias("present"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired."""
    turns = turn_repair.conversation_rows(damaged(read_table(spark, sf_dir, "conversations")), F.col("present"))
    return turn_repair.repair_digests(turns)


_OP12_TRIM = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

#: Between rows at most two turns are inserted; each step takes a row, and of what leads to one state the cheapest, then least audit stays.
OP12_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS tie,
         {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, tie,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(role[1]) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, tie, copy) > 1 AS seen, {_OP12_TRIM} AS trimmed
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, tie, copy)
), marked AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), forced(state, target) AS (VALUES ('b', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
kept(state, initial) AS (VALUES ('b', 's'), ('b', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
inserts(state, target, letters, price) AS (
  SELECT state, state, '', 0 FROM forced UNION ALL SELECT state, target, 'I', 5 FROM forced
  UNION ALL SELECT x.state, y.target, 'II', 10 FROM forced x JOIN forced y ON x.target = y.state
), moves(state, initial, goes, target, letters, price) AS (
  SELECT i.state, CAST(NULL AS VARCHAR), true, i.target, i.letters || 'D', i.price + 2 FROM inserts i
  UNION ALL SELECT i.state, CAST(NULL AS VARCHAR), false, f.target, i.letters || 'R', i.price + 1 FROM inserts i JOIN forced f ON f.state = i.target
  UNION ALL SELECT i.state, k.initial, false, k.initial, i.letters || 'K', i.price FROM inserts i JOIN kept k ON k.state = i.target
), best(conv_id, i, n, state, cost, audit) AS (
  SELECT DISTINCT conv_id, 0, n, 'b', 0, '' FROM marked
  UNION ALL
  SELECT conv_id, i, n, state, cost, audit FROM (
    SELECT b.conv_id, m.i, b.n, v.target AS state, b.cost + v.price + CASE WHEN m.fault = 'truncated' AND NOT v.goes THEN 5 ELSE 0 END AS cost, b.audit || v.letters AS audit,
           row_number() OVER (PARTITION BY b.conv_id, v.target ORDER BY b.cost + v.price + CASE WHEN m.fault = 'truncated' AND NOT v.goes THEN 5 ELSE 0 END, b.audit || v.letters) AS rank
    FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1
    JOIN moves v ON v.state = b.state AND (v.goes OR m.fault NOT IN ('blank', 'duplicate')) AND (v.initial IS NULL OR v.initial = m.role[1])
  ) WHERE rank = 1
), ends AS (
  SELECT b.conv_id, b.cost + i.price AS cost, b.audit || i.letters AS audit, row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + i.price, b.audit || i.letters) AS rank
  FROM best b JOIN inserts i ON i.state = b.state WHERE b.i = b.n AND i.target IN ('a', 'b')
), edits AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS spot FROM ends WHERE rank = 1 AND audit <> ''
), numbered AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) AS i FROM edits
), staying AS (
  SELECT e.conv_id, e.spot, e.edit, m.role, m.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.spot)
         - max(CASE WHEN e.edit = 'K' AND m.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS place
  FROM numbered e LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'
), texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY spot)) AS sha
  FROM staying GROUP BY conv_id
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM ends WHERE rank = 1) e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(read_table(spark, sf_dir, "pages"), carry=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_bpe": op4_bpe,
        "op5_packing": op5_packing,
        "op6_spotsigs": op6_spotsigs,
        "op7_url_filter": op7_url_filter,
        "op8_toxicity": op8_toxicity,
        "op9_ngram_join": op9_ngram_join,
        "op10_warc": op10_warc,
        "op11_merkle": op11_merkle,
        "op12_turn_repair": op12_turn_repair,
        "op13_main_text": op13_main_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op7_url_filter": OP7_SQL, "op10_warc": OP10_SQL, "op11_merkle": OP11_SQL, "op12_turn_repair": OP12_SQL}
