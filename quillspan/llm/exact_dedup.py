"""Exact deduplication: groups by a 128-bit content hash, whose members' bytes are compared."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import map_arrow, spool

#: Bits of a bitmap of hashes, two for each hash: six of its hexadecimal digits say which.
FILTER_BITS = 1 << 24


def _normal(column: pa.Array, fold_case: bool) -> pa.Array:
    text = pc.fill_null(column, "")
    return pc.ascii_lower(text) if fold_case else text


def _hash(data: bytes) -> bytes:
    """The 128-bit content hash."""
    return xxhash.xxh3_128_digest(data)


def hash_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with two of them set for each hash (hexadecimal). Built in Spark; at most 2^18 words come to the driver."""
    digits = lambda k: F.conv(F.substring(column, k, 6), 16, 10).cast("long")
    bits = hashes.select(F.explode(F.array(digits(1), digits(7))).alias("bit"))
    words = bits.groupBy(F.expr("bit DIV 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fold_case: bool = True) -> DataFrame:
    """One row for each row of `docs`: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z if `fold_case`. Their hashes (xxh3, 128 bits) are counted
    first. A text whose hash no other row has is alone. Texts of hashes met twice are grouped by hash and bytes together:
    the hash finds the group, and Spark's aggregation compares the bytes of its members, so that texts whose hashes
    collide stay in groups of their own. It combines before the shuffle, so a text that fills a third of the rows sends
    one row a task. Which texts are sent is told by a bitmap of fixed size; where very many hashes are met twice it lets
    more texts pass than need be, and changes nothing. Rows then find their group by hash and SHA-256, without their
    texts, in a join both of whose sides are shuffled for it, so that adaptive execution can split a group of any size.

    Null texts count as empty. Rows without an id come after all others and are kept only if no row of the group has
    an id. Rows that repeat an id and its text count each in group_size and are all kept where the id is. An empty
    table gives no rows. Other columns of `docs` are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    best = F.min if keep == "smallest" else F.max

    def digests(batch: pa.RecordBatch):
        keys = [(_hash(x) + hashlib.sha256(x).digest()).hex() for x in (v.as_buffer().to_pybytes() for v in _normal(batch.column(1), fold_case))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], ["id", "key"])

    members = spool(map_arrow(rows, digests, f"id {kind}, key string"), "digests")
    hash_of: Column = F.substring("key", 1, 32)
    twice = members.groupBy(hash_of.alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(twice, "hash"))

    def texts(batch: pa.RecordBatch):
        bits, text = shared.value, _normal(batch.column(1), fold_case)
        raw = [_hash(v.as_buffer().to_pybytes()) for v in text]
        at = np.array([(int.from_bytes(x[:3]), int.from_bytes(x[3:6])) for x in raw], np.int64).reshape(-1, 2)
        maybe = ((bits[at >> 6] >> (at & 63)) & 1).all(axis=1)
        chosen = pa.array(np.flatnonzero(maybe))
        text = text.take(chosen)
        keys = [(raw[i] + hashlib.sha256(v.as_buffer().to_pybytes()).digest()).hex() for i, v in zip(chosen.to_pylist(), text, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), pa.array(keys, pa.string()), text], ["id", "key", "norm"])

    groups = map_arrow(rows, texts, f"id {kind}, key string, norm string").groupBy("key", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").select("key", "keep_id", "group_size")
    alone = F.col("group_size").isNull()
    found = members.join(groups, "key", "left").withColumn("keep_id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.substring("key", 33, 64).alias("text_sha256"),
    )
