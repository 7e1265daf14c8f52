"""Best-fit packing of documents into sequences, planned over the histogram of lengths."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm._common import file_bytes, map_arrow, shuffle_partitions, spool, text_slices, worker_keeps
from quillspan.llm.bpe import byte_alphabet
from quillspan.llm.words import splitter

CAPACITY = 2048
#: Bytes of text that a task holds as words at a time.
SLICE = 1_000_000
#: Bytes of words and ids that a worker remembers, what an entry takes besides its own, and characters of a word that is remembered.
CACHE_BYTES, ENTRY_BYTES, CACHED_CHARS = 64 << 20, 180, 64
#: Rows of one length that one task ranks, at most.
BUCKET_ROWS = 1_000_000


class WordBpe:
    """Ids as the tokenizers library gives them for a lower-casing vocabulary with word ends.

    The library's model encodes each distinct word once a worker; splitting a text into words follows the vocabulary's
    normalizer (NFC, white space, lower case) and split pattern. Texts with code points that this Python's tables don't
    know, which the library's may, are left to the library whole.
    """

    def __init__(self, data: bytes):
        import json

        import regex
        from tokenizers import Tokenizer

        spec = json.loads(data)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a lower-casing word vocabulary")
        self.library = Tokenizer.from_str(data.decode())
        self.findall = splitter(split["pattern"]["Regex"])
        self.letters = {b: c for b, c in byte_alphabet().items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")").split
        self.cache: dict[str | int, bytes] = {}
        self.held = 0
        self.fine: set[str] = set()

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # the library lower-cases character by character, without the rule for a sigma that ends a word
        return self.findall(self.library.normalizer.normalize_str(text) if "Σ" in text else text.lower())

    def known(self, text: str) -> bool:
        """Whether all characters of a text are in this Python's tables; those that are, are remembered."""
        if text.isascii():
            return True
        new = set(text) - self.fine
        self.fine.update(c for c in new if unicodedata.category(c) != "Cn")
        return new <= self.fine

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts: list[list] = []
        alien: dict[int, bytes] = {}
        for i, text in enumerate(texts):
            if not self.known(text):
                alien[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                parts.append([])
            elif any(x in text for x in self.added):
                own: list = []
                for piece in self.cut(text):
                    own += [self.added[piece]] if piece in self.added else self.words(piece)
                parts.append(own)
            else:
                parts.append(self.words(text))
        cache = self.cache
        fresh = set().union(*parts).difference(cache)
        model, letters = self.library.model.tokenize, self.letters
        for x in fresh:
            found = [x] if isinstance(x, int) else [t.id for t in model("".join([letters[b] for b in x.encode()]))]
            cache[x] = np.array(found, "<u4").tobytes()
        out = [alien[i] if i in alien else b"".join(map(cache.__getitem__, own)) for i, own in enumerate(parts)]
        for x in fresh:
            if isinstance(x, str) and len(x) > CACHED_CHARS:
                cache.pop(x)
            else:
                self.held += ENTRY_BYTES + len(cache[x])
        if self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        return out


def _worker(key: int, data: bytes) -> WordBpe:
    return worker_keeps("packing", key, lambda: WordBpe(data))


def token_pieces(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents' ids and an end id, cut only where they are longer than `capacity`.

    One row a piece: id_col, piece, start, length, ids_crc32, and ids (array of int) if `with_ids`. Null texts count as
    empty and give the end id alone. Null ids and repeated rows pass through. Other columns are not read.
    """
    data = file_bytes(vocabulary_path)
    key, shared = zlib.crc32(data), docs.sparkSession.sparkContext.broadcast(data)
    tail = np.array([end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch):
        own = _worker(key, shared.value)
        for first, texts in text_slices(batch.column(1), SLICE):
            found = [x + tail for x in own.ids(texts)]
            rows, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(found):
                for k, at in enumerate(range(0, len(x), 4 * capacity)):
                    part = x[at : at + 4 * capacity]
                    rows.append(first + i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.cumsum([0, *size]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(rows, work, schema, keeps=True).withColumnRenamed("id", id_col)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest length first: (length, first rank, end rank, first sequence, offset).

    Items of a length with ranks first..end-1 take the place at `offset` in as many consecutive sequences. Sequences
    filled alike are one run of them; each step either places all items of a length or fills a run once more, so the
    plan's size is bounded by the capacity and doesn't grow with the number of items.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # space left -> runs (first sequence, count)
    spaces: list[int] = []  # the keys of open_, ascending
    plan, sequences = [], 0

    def leave(space: int, first: int, count: int) -> None:
        if space not in open_:
            insort(spaces, space)
        open_.setdefault(space, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                # as many items to a new sequence as it can hold are placed by the next turns
                first, count = sequences, -(-left // (capacity // length))
                sequences += count
                space = capacity
            else:
                space = spaces[at]
                first, count = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            n = min(left, count)
            plan.append((length, rank, rank + n, first, capacity - space))
            if n < count:
                leave(space, first + n, count - n)
            if space > length:
                leave(space - length, first, n)
            rank, left = rank + n, left - n
    return plan


def pack(items: DataFrame, length_col: str = "length", tie_cols: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """`items` with sequence_id (long) and offset (long): no sequence holds more than `capacity`, none has gaps.

    Only the histogram (at most `capacity` rows) comes to the driver, where best fit decreasing is planned over its
    counts. Items then take the planned slots by joining on their rank within their length. Ranks are dealt in buckets
    of a length, in proportion to its count, so that no length meets in one task; the plan is broadcast, its size
    bounded by the capacity.

    `items` must be the same rows whenever it is read: spool it if it isn't a stored table. Items whose length is null
    or outside 1..capacity raise an error. Ties and repeated rows get slots of their own; an empty table gives none.
    Columns named sequence_id, offset or beginning with _pack are replaced.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset", *(c for c in items.columns if c.startswith("_pack")))
    counts = {r[0]: r[1] for r in items.groupBy(F.col(length_col).cast("long")).agg(F.count(F.lit(1))).collect()}
    if None in counts:
        raise ValueError("an item has no length")
    plan = plan_slots(counts, capacity)
    target = max(64, min(BUCKET_ROWS, sum(counts.values()) // (8 * shuffle_partitions(spark))))
    buckets = spark.createDataFrame([(k, -(-n // target)) for k, n in counts.items()], "_pack_length long, _pack_buckets long")
    order = [F.col(c) for c in (tie_cols or [c for c in items.columns if c != length_col])]
    dealt = (
        items.withColumn("_pack_length", F.col(length_col).cast("long"))
        .join(F.broadcast(buckets), "_pack_length")
        .withColumn("_pack_bucket", F.pmod(F.xxhash64(*order), F.col("_pack_buckets")))
    )
    sizes = dealt.groupBy("_pack_length", "_pack_bucket").agg(F.count(F.lit(1)).alias("_pack_n"))
    before = Window.partitionBy("_pack_length").orderBy("_pack_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_pack_length", "_pack_bucket", F.coalesce(F.sum("_pack_n").over(before), F.lit(0)).alias("_pack_base"))
    ranked = dealt.withColumn("_pack_row", F.row_number().over(Window.partitionBy("_pack_length", "_pack_bucket").orderBy(*order)) - 1)
    ranked = ranked.join(bases, ["_pack_length", "_pack_bucket"]).withColumn("_pack_rank", F.col("_pack_base") + F.col("_pack_row"))
    slots = spark.createDataFrame(plan, "_pack_l long, _pack_from long, _pack_to long, _pack_first long, _pack_offset long")
    fits = (F.col("_pack_length") == F.col("_pack_l")) & (F.col("_pack_rank") >= F.col("_pack_from")) & (F.col("_pack_rank") < F.col("_pack_to"))
    placed = ranked.join(F.broadcast(slots), fits)
    return placed.select(*items.columns, (F.col("_pack_first") + F.col("_pack_rank") - F.col("_pack_from")).alias("sequence_id"), F.col("_pack_offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """token_pieces in the sequences that pack gives them; the pieces are spooled in between."""
    pieces = spool(token_pieces(docs, vocabulary_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack(pieces, "length", [id_col, "piece", "start", "ids_crc32"], capacity)
