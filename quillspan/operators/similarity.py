"""Similarity search and joins over vectors (id, embedding array<float>)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, BucketedRandomProjectionLSH, HashingTF, IDFModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import canon, norm_label
from quillspan.operators.chunking import cosine
from quillspan.session import stored

#: Bytes of queries that go to all tasks, at most; queries of a block and vectors of a part beyond that.
QUERY_BYTES, QUERY_BLOCK, PART_VECTORS = 32 << 20, 8192, 16_384
#: Vectors of a block of band_join, and rows of a product of two matrices that are held at once.
BLOCK_VECTORS, ROWS_AT_ONCE = 2000, 256
#: Scores that a task holds at once, and rough ones, as many as stay in a core's cache.
SCORES_AT_ONCE, ROUGH_AT_ONCE = 1 << 20, 1 << 18
#: Rows of queries and vectors, and pairs of these, of a task in which groups meet; pairs of a group that has a task of its own.
ROWS_OF_TASK, PAIRS_OF_TASK, PAIRS_AT_ONCE = 1 << 15, 1 << 22, 1 << 18
#: Directions by which band_join tells which blocks can't meet; their angles to all cells are the driver's, a square of this number.
PIVOTS = 32


def embed(df: DataFrame, text_col: str = "text", embed_fn: Callable[[pd.Series], np.ndarray] | None = None, features: int = 256, idf: bool = False) -> DataFrame:
    """`df` with a unit vector of its text: by embed_fn in batches, else by hashed word counts. Null and empty texts give zeros.

    With `idf` counts are weighted by how rare their words are in `df`; fit_encoder keeps such weights for other texts.
    """
    if embed_fn is None:
        if idf:
            return fit_encoder(df, features, text_col).encode(df, text_col)
        return _counted(df, text_col, features).withColumn("embedding", _unit(vector_to_array("_counts"))).drop("_words", "_counts")

    def run(frames):
        for pdf in frames:
            rows = np.asarray(embed_fn(pdf[text_col].fillna("")), np.float32)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pdf.assign(embedding=list((rows / np.where(norm > 0, norm, 1)).astype(np.float32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "embedding")
    return df.drop("embedding").mapInPandas(run, f"{schema}, embedding array<float>")


_WORDS = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class TextEncoder:
    """Hashed word counts, weighted by how rare words are in the corpus that it was fitted on, as unit vectors.

    The corpus and whatever is compared with it are encoded by the same weights; fit_encoder makes one, `save` and
    `load_encoder` keep it.
    """

    model: IDFModel
    features: int

    def encode(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """`df` with the embedding of its text. Null and empty texts, and those of words that every row of the corpus has, give zeros."""
        weighed = self.model.transform(_counted(df, text_col, self.features))
        return weighed.withColumn("embedding", _unit(vector_to_array("_weighed"))).drop("_words", "_counts", "_weighed")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def _counted(df: DataFrame, text_col: str, features: int) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), _WORDS), lambda w: w != "")
    return HashingTF(numFeatures=features, inputCol="_words", outputCol="_counts").transform(df.withColumn("_words", words))


def fit_encoder(corpus: DataFrame, features: int = 256, text_col: str = "text") -> TextEncoder:
    """An encoder whose weights are log((n + 1) / (rows with the word + 1)) over `corpus`: one pass, and `features` numbers at the driver."""
    return TextEncoder(IDF(inputCol="_counts", outputCol="_weighed").fit(_counted(corpus.select(text_col), text_col, features)), features)


def encode_corpus(corpus: DataFrame, features: int = 256, text_col: str = "text") -> tuple[TextEncoder, DataFrame]:
    """An encoder fitted on a corpus, as fit_encoder makes it, and the corpus with embeddings in place of its texts, stored: words are made and counted once for both."""
    counted = stored(_counted(corpus, text_col, features).drop("_words", text_col), "counts")
    encoder = TextEncoder(IDF(inputCol="_counts", outputCol="_weighed").fit(counted), features)
    weighed = encoder.model.transform(counted).withColumn("embedding", _unit(vector_to_array("_weighed")))
    return encoder, stored(weighed.drop("_counts", "_weighed"), "vectors")


def load_encoder(path: str) -> TextEncoder:
    model = IDFModel.load(path)
    return TextEncoder(model, int(model.idf.size))


def _unit(counts: Column) -> Column:
    """The array over its length, as floats; zeros stay zeros."""
    with_norm = F.struct(counts.alias("x"), F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    return F.get(F.transform(F.array(with_norm), lambda s: F.transform(s["x"], lambda x: (x / F.greatest(s["norm"], F.lit(1e-30))).cast("float"))), F.lit(0))


def _same_length(ids: pa.Array, vectors: pa.Array, length: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and matrix of the vectors of that length, in ascending order of id."""
    fits = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(vectors), length), pc.is_valid(ids)), False)
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    order = pc.sort_indices(ids)
    flat = vectors.take(order).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids.take(order), flat.reshape(len(ids), length)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k highest scores at nine digits, the smaller column on ties; what isn't a number comes last.

    The k-th of the maxima of runs of columns is no higher than a row's k-th score, so only what reaches it is rounded and sorted.
    """
    n = scores.shape[1]
    if not np.isfinite(scores).all():
        scores = np.nan_to_num(scores, nan=-np.inf)
    if n > k:
        width = max(1, min(64, n // (4 * k)))
        runs = n // width
        tops = scores[:, : runs * width].reshape(len(scores), runs, width).max(axis=2) if width > 1 else scores
        floor = np.partition(tops, runs - k, axis=1)[:, runs - k]
        # numbers that are equal at nine digits lie no farther apart; large ones are less exact
        rows, cols = np.nonzero(scores >= (floor - 2e-9 - 1e-14 * np.abs(floor))[:, None])
    else:
        rows, cols = (x.ravel() for x in np.indices(scores.shape))
    rounded = np.round(scores[rows, cols], 9)
    order = np.lexsort((cols, -rounded, rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


def _hits(asked_ids: pa.Array, asked: pa.Array, ids: pa.Array, vectors: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of some vectors for each of some queries, a batch for each run of queries."""
    for length in pc.unique(pc.list_value_length(asked)).drop_null().to_pylist():
        q_ids, q = _same_length(asked_ids, asked, length)
        v_ids, v = _same_length(ids, vectors, length)
        for row, col, score in _nearest(q, v, k) if len(v_ids) else ():
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), v_ids.take(pa.array(col)), pa.array(score)], ["query_id", "id", "score"])


def _nearest(q: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of v, inner products) of the k best of v for each of q, as _best takes them, for one run of q after another.

    Single precision tells, with a margin for its rounding, which few products may be among the k best; these are worked out in
    double precision. Where that would leave many, or numbers are not finite or too large for it, all are.
    """
    n, width = v.shape
    norms = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0.0))
    rough = n >= 64 * k and np.isfinite(norms[0]).all() and norms[0].max(initial=0.0) < 1e15 and norms[1] < 1e15
    step = max(1, (ROUGH_AT_ONCE if rough else SCORES_AT_ONCE) // n)
    if rough:
        # inputs, products and sums are rounded, and the smallest numbers lost
        small, margin = (q.astype(np.float32), v.astype(np.float32).T), (width + 8) * 2.0**-23 * norms[0] * norms[1] + width * 1e-37
        run = min(64, n // (4 * k))
        runs = n // run
    for first in range(0, len(q), step):
        own = q[first : first + step]
        if rough:
            scores = small[0][first : first + step] @ small[1]
            tops = scores[:, : runs * run].reshape(len(own), run, runs).max(axis=1)
            floor = np.partition(tops, runs - k, axis=1)[:, runs - k].astype(np.float64)
            floor -= 2 * margin[first : first + step] + 2e-9 + 1e-14 * np.abs(floor)
            rows, cols = np.divmod(np.flatnonzero(scores >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]), n)
            if len(rows) <= scores.size // 32:
                exact = np.einsum("ij,ij->i", own[rows], v[cols])
                order = np.lexsort((cols, -np.round(exact, 9), rows))
                rows, cols, exact = rows[order], cols[order], exact[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                yield first + rows[keep], cols[keep], exact[keep]
                continue
        scores = own @ v.T
        row, col = _best(scores, k)
        yield first + row, col, scores[row, col]


def _scored(corpus: DataFrame, queries: DataFrame, k: int | None, broadcast_bytes: int) -> DataFrame:
    """(query_id, id, score): of each batch or part of the corpus the k best for each query, all of them without k."""
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double"
    return _met(corpus, queries, (), schema, lambda q_ids, q, ids, vectors: _hits(q_ids, q, ids, vectors, k or len(ids)), broadcast_bytes)


def _met(corpus: DataFrame, queries: DataFrame, more: tuple[str, ...], schema: str, hits: Callable[..., Iterator[pa.RecordBatch]], broadcast_bytes: int) -> DataFrame:
    """What `hits` gives for each batch or part of the corpus (id, embedding and `more`) and each block of queries, so that every query meets every vector once."""
    spark = corpus.sparkSession
    asked, held = queries.select("query_id", "embedding").where("embedding IS NOT NULL"), corpus.select("id", "embedding", *more).where("embedding IS NOT NULL")
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    if n * (8 * width + 64) <= broadcast_bytes:
        table = asked.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(tuple(_flat(table[c]) for c in ("query_id", "embedding")))

        def near(batches):
            for batch in batches:
                yield from hits(*shared.value, *batch.columns)

        found = held.mapInArrow(near, schema)
    else:
        blocks, parts = -(-n // QUERY_BLOCK), max(1, -(-held.count() // PART_VECTORS))
        every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        # new names, as both sides may come from one table
        held = held.select(F.col("id").alias("vector_id"), F.col("embedding").alias("vector"), *more)
        left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", every(parts))
        right = held.withColumn("part", F.pmod(F.xxhash64("vector_id"), F.lit(parts))).withColumn("block", every(blocks))
        empty = _arrow_schema(spark, schema)

        def meet(queries_: pa.Table, vectors: pa.Table) -> pa.Table:
            if not queries_.num_rows or not vectors.num_rows:
                return empty.empty_table()
            batches = hits(_flat(queries_["query_id"]), _flat(queries_["embedding"]), *(_flat(vectors[c]) for c in ("vector_id", "vector", *more)))
            return pa.Table.from_batches(batches, empty)

        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, schema)
    return found


def all_scores(corpus: DataFrame, queries: DataFrame, broadcast_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score): every query against every vector, as topk meets them. The result is as large as that; it is for few queries that rank all."""
    return _scored(corpus, queries, None, broadcast_bytes)


def _budgeted(scores: np.ndarray, sizes: np.ndarray, budget: int, first: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's highest scores at nine digits, the smaller column on ties, up to and with the one whose size passes the budget."""
    behind, n = -np.nan_to_num(np.round(scores, 9), nan=-np.inf), scores.shape[1]
    todo, k, out = np.arange(len(scores)), first, []
    while len(todo):
        own = behind[todo]
        rows, cols = np.nonzero(own <= np.partition(own, k - 1, axis=1)[:, k - 1, None]) if k < n else (x.ravel() for x in np.indices(own.shape))
        order = np.lexsort((cols, own[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        total = np.cumsum(sizes[cols])
        starts = np.searchsorted(rows, np.arange(len(todo)))
        before = total - sizes[cols] - (total - sizes[cols])[starts][rows]
        done = np.add.reduceat(sizes[cols], starts) > budget if k < n else np.ones(len(todo), bool)
        keep = done[rows] & (before <= budget)
        out.append((todo[rows[keep]], cols[keep]))
        todo, k = todo[~done], 4 * k
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def nearest_within(corpus: DataFrame, queries: DataFrame, budget: int, broadcast_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, seq, size, score): for each query what may be among the nearest of corpus (id, embedding, seq long, size long) whose sizes stay within the budget.

    By score at nine digits, then seq, then id. Each batch or part keeps for each query its own nearest up to and with the one that
    passes the budget: what comes later is beyond the budget among all too, and whatever stands behind a row that was
    dropped has a sum beyond the budget. So running totals over these rows tell what fits, and their number doesn't grow with the square.
    """
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, seq long, size long, score double"
    names = ["query_id", "id", "seq", "size", "score"]

    def near(asked_ids, asked, ids, vectors, seqs, sizes):
        order = pc.sort_indices(pa.table({"seq": seqs, "id": ids}), sort_keys=[("seq", "ascending"), ("id", "ascending")], null_placement="at_start")
        ids, vectors, seqs, sizes = (x.take(order) for x in (ids, vectors, seqs, sizes))
        known = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
        for length in pc.unique(pc.list_value_length(asked)).drop_null().to_pylist():
            q_ids, q = _same_length(asked_ids, asked, length)
            at, v = _same_length(pa.array(np.arange(len(ids))), vectors, length)
            place = at.to_numpy(zero_copy_only=False)
            step = max(1, SCORES_AT_ONCE // max(1, len(v)))
            for first in range(0, len(q_ids) if len(v) else 0, step):
                scores = q[first : first + step] @ v.T
                row, col = _budgeted(scores, known[place], budget)
                found = pa.array(place[col])
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(first + row)), ids.take(found), seqs.take(found), sizes.take(found), pa.array(scores[row, col])], names)

    return _met(corpus.where("id IS NOT NULL"), queries, ("seq", "size"), schema, near, broadcast_bytes)


def topk(corpus: DataFrame, queries: DataFrame, k: int = 5, broadcast_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, embedding) the k nearest of corpus by inner product, ties by id.

    Queries whose matrix takes up to broadcast_bytes, as measured, go to all tasks, and the corpus stays where it is
    read. More queries are dealt in blocks and the corpus in parts, and each block meets each part in one task; blocks
    and parts hold a bounded number of vectors. Either way a batch of vectors keeps its k best for each query, and only
    those are ranked together. Scores are compared at nine digits.

    Vectors that are null or of another length than the query's, and rows without an id, are left out. Repeated rows
    count each. An empty side gives no rows.
    """
    found = _scored(corpus, queries, k, broadcast_bytes)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, cls), (cls, embedding)) of vectors (id, embedding): equal vectors have one class, named by its smallest id; nulls have none.

    Vectors are dealt and put in order by hash first, so that whole ones are compared only where their hashes are equal.
    """
    held = stored(vectors.select("id", "embedding").where("id IS NOT NULL AND embedding IS NOT NULL").select(F.xxhash64("embedding").alias("hash"), "id", "embedding").repartition("hash"))
    classes = stored(held.groupBy("hash", "embedding").agg(F.min("id").alias("cls")))
    return stored(held.join(classes, ["hash", "embedding"]).select("id", "cls")), classes.select("cls", "embedding")


def _enough(best: DataFrame, by: tuple[str, ...], sizes: DataFrame, on: list[str], k: int) -> DataFrame:
    """Of each query's classes (by, on, score) those before which, by score at nine digits, stand fewer than k members; sizes: (on, size).

    So as many members come of a query's classes as asked for, not k of each where many vectors are equal.
    """
    rounded = F.round("score", 9)
    whole = Window.partitionBy(*by).orderBy(rounded.desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("size").over(whole) - F.sum("size").over(Window.partitionBy(*by, rounded))
    return best.join(sizes, on).withColumn("before", before).where(F.col("before") < k).drop("before", "size")


def topk_of_classes(ids: DataFrame, classes: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank) as topk gives it, of ids (id, cls) and classes (cls, embedding) of equal vectors: each different vector is scored once.

    The k highest ids lie in the k classes of highest score (by smallest id on ties), and are among the k smallest ids of each.
    """
    best = topk(classes.select(F.col("cls").alias("id"), "embedding"), queries, k).select("query_id", F.col("id").alias("cls"), "score")
    turn = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
    members = ids.withColumn("turn", turn).where(F.col("turn") <= k).drop("turn")
    best = _enough(best, ("query_id",), ids.groupBy("cls").agg(F.count(F.lit(1)).alias("size")), ["cls"], k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return best.join(members, "cls").select("query_id", "id", "score").withColumn("rank", rank).where(F.col("rank") <= k)


def topk_within(members: DataFrame, classes: DataFrame, queries: DataFrame, k: int, own_classes: int = 512, own_pairs: int = PAIRS_AT_ONCE, least: float | None = None) -> DataFrame:
    """(group, query_id, id, score): the k nearest members (group, id, cls; distinct) of a query's own group, for queries (group, query_id, embedding).

    As topk_of_classes, for each group by itself, without those that score below `least`. A group's queries go in blocks and its classes in
    parts, and each block meets each part in one task, with the first k ids of each class; so what a task gives is k rows a query.
    Groups of up to own_classes classes and own_pairs pairs of a class and a query share tasks.
    """
    spark = members.sparkSession
    turn = F.row_number().over(Window.partitionBy("group", "cls").orderBy("id"))
    held = stored(members.withColumn("turn", turn).where(F.col("turn") <= k).groupBy("group", "cls").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = stored(queries.select("group", "query_id", "embedding").where("embedding IS NOT NULL"))
    sizes = asked.groupBy("group").agg(F.count(F.lit(1)).alias("m")).join(held.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group")
    blocks, parts = F.ceil(F.col("m") / QUERY_BLOCK).cast("long"), F.ceil(F.col("n") / PART_VECTORS).cast("long")
    sizes = stored(sizes.select("group", "m", "n", blocks.alias("blocks"), parts.alias("parts"), ((F.col("n") > own_classes) | (F.col("m") * F.col("n") > own_pairs)).alias("own")))
    rows, pairs, split = sizes.agg(F.sum(F.col("m") + F.col("n")), F.sum(F.when(~F.col("own"), F.col("m") * F.col("n"))), F.max("parts")).first()
    shared = max(1, -(-(rows or 0) // ROWS_OF_TASK), -(-(pairs or 0) // PAIRS_OF_TASK))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    task = F.when(F.col("own"), F.xxhash64("group", "block", "part")).otherwise(F.pmod(F.xxhash64("group"), F.lit(shared)))
    dealt = lambda rows, *columns: rows.withColumn("task", task).select("task", "group", "block", "part", *columns)
    left = dealt(asked.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("part", every("parts")), "query_id", "embedding")
    right = held.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("cls"), "parts")).withColumn("block", every("blocks"))
    right = dealt(right.join(classes.select("cls", F.col("embedding").alias("vector")), "cls"), "ids", "vector")
    kinds = (members.schema["group"], queries.schema["query_id"], members.schema["id"])
    schema = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(("group", "query_id", "id"), kinds, strict=True)).replace("group ", "`group` ", 1) + ", score double"
    empty = _arrow_schema(spark, schema)

    def meet(queries_: pa.Table, held_: pa.Table) -> pa.Table:
        found = _within(queries_, held_, k, least) if queries_.num_rows and held_.num_rows else []
        return pa.concat_tables([empty.empty_table(), *(pa.table(x, schema=empty) for x in found)])

    found = left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(meet, schema)
    if split is None or split == 1:
        return found
    best = F.row_number().over(Window.partitionBy("group", "query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).drop("rank")


def _within(queries: pa.Table, held: pa.Table, k: int, least: float | None) -> Iterator[list[pa.Array]]:
    """[group, query_id, id, score] of the k best members for each query, for many groups (or a block and a part of one): the work of one task of topk_within."""
    groups = pc.unique(pa.concat_arrays([_flat(queries["group"]), _flat(held["group"])]))
    widest = [1 + max(pc.max(t[c]).as_py() for t in (queries, held)) for c in ("block", "part")]

    def coded(table: pa.Table) -> np.ndarray:
        group, block, part = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pc.index_in(_flat(table["group"]), groups), _flat(table["block"]), _flat(table["part"])))
        return (group * widest[0] + block) * widest[1] + part

    def sorted_rows(table: pa.Table, vector: str, length: int, *by: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        fits = pc.fill_null(pc.equal(pc.list_value_length(_flat(table[vector])), length), False).to_numpy(zero_copy_only=False)
        order = np.lexsort((*by, unit := coded(table)))
        order = order[fits[order]]
        rows = table.take(pa.array(order))
        flat = _flat(rows[vector]).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return rows, unit[order], flat.reshape(len(order), length)

    ids = _flat(held["ids"])
    place = pc.rank(ids.flatten(), sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    held = held.append_column("at", pa.array(starts[:-1])).append_column("size", pa.array(np.diff(starts)))
    ids = ids.flatten()
    for length in pc.unique(pc.list_value_length(_flat(queries["embedding"]))).drop_null().to_pylist():
        asked, q_unit, q = sorted_rows(queries, "embedding", length)
        # classes stand in order of their first ids, by which ties are broken
        rows, v_unit, v = sorted_rows(held, "vector", length, place[starts[:-1]])
        at, size = (_flat(rows[c]).to_numpy(zero_copy_only=False) for c in ("at", "size"))
        met = []
        for unit in np.intersect1d(q_unit, v_unit):
            (first, last), (low, high) = (np.searchsorted(x, [unit, unit + 1]) for x in (q_unit, v_unit))
            step = max(1, SCORES_AT_ONCE // (high - low))
            for start in range(first, last, step):
                scores = q[start : min(last, start + step)] @ v[low:high].T
                row, col = _best(scores, k)
                value = scores[row, col]
                if least is not None:
                    fine = value >= least
                    row, col, value = row[fine], col[fine], value[fine]
                met.append((row + start, col + low, value))
        if not met:
            continue
        row, col, score = (np.concatenate(x) for x in zip(*met, strict=True))
        rounded = np.nan_to_num(np.round(score, 9), nan=-np.inf)
        order = np.lexsort((col, -rounded, row))
        row, col, score, rounded = row[order], col[order], score[order], rounded[order]
        # of a query's classes those before which, by score, stand fewer than k members
        sizes = size[col]
        before = np.cumsum(sizes) - sizes
        run = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (rounded[1:] != rounded[:-1])]) if len(row) else np.zeros(0, np.int64)
        ahead = np.repeat(before[run], np.diff(np.r_[run, len(row)]))
        keep = ahead - before[np.searchsorted(row, row)] < k
        row, col, score, rounded, sizes = row[keep], col[keep], score[keep], rounded[keep], sizes[keep]
        each = np.repeat(np.arange(len(row)), sizes)
        member = at[col][each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((place[member], -rounded[each], row[each]))
        each, member = each[order], member[order]
        row = row[each]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        each, member, row = each[keep], member[keep], pa.array(row[keep])
        yield [_flat(asked["group"]).take(row), _flat(asked["query_id"]).take(row), ids.take(pa.array(member)), pa.array(score[each])]


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    """A schema as Arrow has it; no row is made for it."""
    return spark.range(1).select(F.from_json(F.lit("{}"), schema).alias("row")).select("row.*").where("false").toArrow().schema


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array, also of a column without chunks."""
    if isinstance(column, pa.Array):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def score_pairs(pairs: DataFrame, a: str = "embedding", b: str = "query_embedding") -> DataFrame:
    """`pairs` with the inner product of two of its columns, in double precision."""
    return pairs.withColumn("score", cosine(F.col(a), F.col(b)))


def _directions(vectors: DataFrame, count: int) -> np.ndarray:
    """Up to `count` vectors (those with the smallest hash of id) of the commonest length among them, as unit rows."""
    some = [r["embedding"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(count).select("embedding").collect()]
    if not some:
        return np.zeros((0, 0))
    width = max(sorted({len(x) for x in some}), key=[len(x) for x in some].count)
    rows = np.array([x for x in some if len(x) == width], np.float64)
    norm = np.linalg.norm(rows, axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    return rows[fine] / norm[fine, None]


def _placed(held: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, angles to all pivots, norm) of vectors; the cell is the nearest pivot, or one past the last for vectors that have no angles."""
    n, k = len(held), len(pivots)
    cell, angles, norms = np.full(n, k), np.zeros((n, k)), np.zeros(n)
    if k:
        fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(held), pivots.shape[1]), False).to_numpy(zero_copy_only=False))
        rows = held.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), pivots.shape[1])
        norm = np.linalg.norm(rows, axis=1)
        fine = np.isfinite(norm) & (norm > 0)
        fits, rows, norm = fits[fine], rows[fine], norm[fine]
        angles[fits] = np.arccos(np.clip((rows / norm[:, None]) @ pivots.T, -1, 1))
        norms[fits] = norm
        cell[fits] = angles[fits].argmin(axis=1)
    return cell, angles, norms


def cells_that_meet(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Which pairs of cells may hold vectors with lo <= inner product <= hi.

    low and high (cell, pivot): the smallest and largest angle of a cell's vectors to each pivot; least and most: their norms.
    By the triangle inequality the angle between vectors of two cells is at least the gap between their angles to any
    pivot and at most the sum of these. A margin covers rounding.
    """
    slack = 1e-6
    gap = np.maximum(low[:, None, :] - high[None, :, :], low[None, :, :] - high[:, None, :]).max(axis=2, initial=0.0)
    span = np.minimum(high[:, None, :] + high[None, :, :], math.pi).min(axis=2, initial=math.pi)
    nearest, farthest = np.cos(np.maximum(gap - slack, 0)), np.cos(np.minimum(span + slack, math.pi))
    big, small = most[:, None] * most[None, :], least[:, None] * least[None, :]
    best = np.where(nearest >= 0, big, small) * nearest
    worst = np.where(farthest >= 0, small, big) * farthest
    margin = slack * (1 + big)
    return (best + margin >= lo) & (worst - margin <= hi)


def _cell_bounds(vectors: DataFrame, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """low, high, least and most as cells_that_meet takes them, the last cell without bounds. A row a cell and pivot comes from each task."""
    k = len(pivots)

    def run(batches):
        low, high, least, most = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            cell, angles, norms = _placed(batch.column(0), pivots)
            for c in np.unique(cell[cell < k]):
                mine = cell == c
                low[c], high[c] = np.minimum(low[c], angles[mine].min(axis=0)), np.maximum(high[c], angles[mine].max(axis=0))
                least[c], most[c] = min(least[c], norms[mine].min()), max(most[c], norms[mine].max())
        c, p = (x.ravel() for x in np.indices((k, k)))
        seen = np.isfinite(least[c])
        yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (c, p, low[c, p], high[c, p], least[c], most[c])], ["c", "p", "low", "high", "least", "most"])

    rows = vectors.select("embedding").mapInArrow(run, "c long, p long, low double, high double, least double, most double")
    rows = rows.groupBy("c", "p").agg(F.min("low"), F.max("high"), F.min("least"), F.max("most")).collect()
    low, high, least, most = np.zeros((k + 1, k)), np.full((k + 1, k), math.pi), np.zeros(k + 1), np.full(k + 1, np.inf)
    for c, p, *x in rows:
        low[c, p], high[c, p], least[c], most[c] = x
    return low, high, least, most


def band_join(vectors: DataFrame, lo: float = 0.55, hi: float = 0.90, max_pairs: int | None = None, blocks: int | None = None, new_ids: DataFrame | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, score) of unordered pairs (a < b) with lo <= score <= hi; with max_pairs the highest, ties by a and b.

    Exact. Vectors go to the nearest of a few `pivots`, and a pivot's vectors to blocks of about BLOCK_VECTORS; each pair of
    blocks is one task's matrix product. Pairs of pivots whose vectors can't score within the band, as their angles to
    all pivots tell, are left out. The rest grows with the square of the vectors, as the task is stated; each vector
    travels once for each block that its own meets. With new_ids (id) only pairs with a new vector are given; old and
    new ones have blocks of their own, and old blocks don't meet. near_band_join takes less work and may miss pairs.

    Vectors that are null or of unequal lengths, and rows without an id, pair with nothing. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("id", "embedding").where("id IS NOT NULL AND embedding IS NOT NULL")
    kind = vectors.schema["id"].dataType.simpleString()
    ways = _directions(vectors, pivots)
    known = vectors.withColumn("new", F.lit(True)) if new_ids is None else vectors.join(new_ids.select("id", F.lit(True).alias("new")).distinct(), "id", "left").withColumn("new", F.coalesce("new", F.lit(False)))

    def to_cells(batches):
        for batch in batches:
            cell = _placed(batch.column(1), ways)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["id", "embedding", "new", "cell"])

    element = vectors.schema["embedding"].dataType.simpleString()
    marked = known.select("id", "embedding", "new").mapInArrow(to_cells, f"id {kind}, embedding {element}, new boolean, cell long")
    sizes = {(r["cell"], r["new"]): r["count"] for r in marked.groupBy("cell", "new").count().collect()}
    room = BLOCK_VECTORS if blocks is None else max(1, -(-sum(sizes.values()) // blocks))
    cells, at, first = len(ways) + 1, 0, {}
    for c in range(cells):
        for new in (False, True):
            parts = -(-sizes.get((c, new), 0) // room)
            first[c, new] = (at, parts)
            at += parts
    meet = cells_that_meet(*_cell_bounds(vectors, ways), lo, hi)
    table = []
    for (c, new), (start, parts) in first.items():
        others = [first[o, way] for o in range(cells) if meet[c, o] for way in ((False, True) if new else (True,))]
        if parts:
            table.append((c, new, start, parts, [(s, s + n - 1) for s, n in others if n]))
    placed = spark.createDataFrame(table, "cell long, new boolean, start long, parts long, runs array<struct<first:long,last:long>>")
    dealt = marked.join(F.broadcast(placed), ["cell", "new"]).withColumn("own", F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts")))
    met = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    pair = F.transform(met, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    schema = f"a {kind}, b {kind}, score double"
    empty = spark.createDataFrame([], schema).toArrow().schema

    def run(table: pa.Table) -> pa.Table:
        i, j, own = table["i"][0].as_py(), table["j"][0].as_py(), table["own"].to_numpy()
        ids, held = _flat(table["id"]), _flat(table["embedding"])
        out = []
        for length in pc.unique(pc.list_value_length(held)).to_pylist():
            left, right = (_same_length(ids.filter(pa.array(own == k)), held.filter(pa.array(own == k)), length) for k in (i, j))
            place = np.unique(pa.concat_arrays([left[0], right[0]]).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            x, y = place[: len(left[0])], place[len(left[0]) :]
            for first in range(0, len(x), ROWS_AT_ONCE):
                scores = left[1][first : first + ROWS_AT_ONCE] @ right[1].T
                r, c = np.nonzero((scores >= lo) & (scores <= hi))
                value, r = scores[r, c], r + first
                keep = x[r] < y[c] if i == j else x[r] != y[c]
                r, c, value = r[keep], c[keep], value[keep]
                swap = pa.array(x[r] > y[c])
                one, two = left[0].take(pa.array(r)), right[0].take(pa.array(c))
                out.append(pa.table([pc.if_else(swap, two, one), pc.if_else(swap, one, two), pa.array(value)], schema=empty))
        found = pa.concat_tables([empty.empty_table(), *out])
        return found.sort_by([("score", "descending"), ("a", "ascending"), ("b", "ascending")]).slice(0, max_pairs) if max_pairs else found

    found = dealt.withColumn("at", F.explode(pair)).select("id", "embedding", "own", "at.i", "at.j").groupBy("i", "j").applyInArrow(run, schema)
    return found.orderBy(F.desc("score"), "a", "b").limit(max_pairs) if max_pairs else found


def near_band_join(vectors: DataFrame, lo: float = 0.55, hi: float = 0.90, tables: int = 8, seed: int = 7) -> DataFrame:
    """(a, b, score) as band_join gives them, of the pairs that random projections bring together: for unit vectors too many to compare all.

    Unit vectors with an inner product of lo lie sqrt(2 - 2 lo) apart; candidates within that distance come from
    `tables` hash tables and are scored exactly. Pairs may be missing, none is wrong. Vectors shorter
    than the longest pair with nothing; otherwise rows as in band_join.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * lo)) + 1e-9
    rows = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    # Spark may filter after the conversion, which must hold for every row
    whole = F.when(F.size("embedding") == width, F.col("embedding").cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width))
    rows = rows.where(F.size("embedding") == width).withColumn("features", array_to_vector(whole))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=max(reach, 1e-3), numHashTables=tables, seed=seed).fit(rows)
    pairs = model.approxSimilarityJoin(rows, rows, reach, "distance").where("datasetA.id < datasetB.id")
    scored = score_pairs(pairs.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), F.col("datasetA.embedding").alias("x"), F.col("datasetB.embedding").alias("y")), "x", "y")
    return scored.where(F.col("score").between(lo, hi)).select("a", "b", "score")


def label_pairs(pairs: DataFrame, responses: DataFrame, batch: int = 10, min_confidence: float = 0.3) -> DataFrame:
    """Ranked pairs (rank from 0) with the labels given for them (batch, index, label, confidence); blank or unsure ones go."""
    placed = pairs.withColumn("batch", F.floor(F.col("rank") / batch).cast("long")).withColumn("index", (F.col("rank") % batch).cast("long"))
    good = responses.where((F.trim("label") != "") & (F.col("confidence") >= min_confidence))
    return placed.join(good, ["batch", "index"]).withColumn("label", norm_label("label"))


def resolve_synonyms(names: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """(name, resolved, score): the nearest existing (name, embedding) if at least as near as threshold, else the name itself.

    A name with the canonical form of an existing one is that one, with a score of 1.
    """
    exact = existing.groupBy(canon("name").alias("form")).agg(F.min("name").alias("same"))
    known = names.withColumn("form", canon("name")).join(exact, "form", "left").drop("form")
    near = topk(existing.select(F.col("name").alias("id"), "embedding"), names.select(F.col("name").alias("query_id"), "embedding"), 1)
    near = near.select(F.col("query_id").alias("name"), F.col("id").alias("nearest"), "score")
    close = F.col("score") >= threshold
    return known.join(near, "name", "left").select(
        "name",
        F.coalesce("same", F.when(close, F.col("nearest")), "name").alias("resolved"),
        F.when(F.col("same").isNotNull(), F.lit(1.0)).otherwise(F.col("score")).alias("score"),
    )
