"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, then worker caches for the rest."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import file_bytes, lean, text_slices, worker_keeps
from quillspan.llm.mph import MinimalPerfectHash

#: Entries of the broadcast tier and of each partition's summary.
FREQUENT = 32_768
#: Bytes of pre-tokens and lengths that a worker remembers, what an entry takes beside its text, and the longest remembered.
CACHE_BYTES, ENTRY_BYTES, CACHED_CHARS = 48 << 20, 160, 64
#: Bytes of text that a task holds as pre-tokens at a time.
SLICE = 1_000_000
#: Words that the library encodes in one call.
TOGETHER = 64


class LengthTable:
    """Lengths of pre-tokens without an object for each: a perfect hash over them, and in the order of its slots their UTF-8
    bytes behind one another, where each ends, and their lengths. A pre-token is found only if its bytes are there."""

    def __init__(self, tokens: list[str], lengths: list[int]):
        raw = [x.encode() for x in tokens]
        keys = self._keys(raw)
        _, alone, n = np.unique(keys, return_index=True, return_counts=True)
        alone = alone[n == 1]  # tokens whose 64-bit hashes agree are left to the library
        self.slots = MinimalPerfectHash.build(keys[alone])
        order = np.empty(len(alone), np.int64)
        order[self.slots.slots(keys[alone])] = alone
        self.text = b"".join(raw[i] for i in order)
        self.ends = np.cumsum([0, *(len(raw[i]) for i in order)]).astype(np.uint32)
        self.lengths = np.array([lengths[i] for i in order], np.uint16)

    @staticmethod
    def _keys(raw: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))

    def find(self, tokens: list[str]) -> dict[str, int]:
        """Of tokens those in the table, with their lengths."""
        if not tokens or not len(self.lengths):
            return {}
        raw = [x.encode() for x in tokens]
        at = self.slots.slots(self._keys(raw))
        known = np.flatnonzero(at >= 0)
        place = at[known]
        first, last, length = self.ends[place].tolist(), self.ends[place + 1].tolist(), self.lengths[place].tolist()
        return {tokens[i]: n for i, a, b, n in zip(known.tolist(), first, last, length, strict=True) if self.text[a:b] == raw[i]}


class PieceCounter:
    """Counts tokens as a sentencepiece model gives them, one pre-token at a time.

    A pre-token is a run of spaces and what follows up to the next space or line feed, or a line feed and what follows.
    No piece crosses such a border if no piece has a space after another character and none has a line feed besides
    another; `cut` is None for models where that fails, and their texts are encoded whole.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, pieces = proto.normalizer_spec, [x.piece for x in proto.pieces]
        plain = spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        free = plain and proto.trainer_spec.model_type == 2 and not any(x.type == 4 for x in proto.pieces) and not any("▁" in x.lstrip("▁") or "\n" in x and len(x) > 1 for x in pieces)
        self.cut = re.compile(r" *[^ \n]+|\n[^ \n]*| +").findall if free else None
        self.opens = np.array([x.startswith("▁") for x in pieces])
        self.table: LengthTable | None = None
        self.cache: dict[str, int] = {}
        self.cache_bytes = 0

    def pre_tokens(self, text: str) -> list[str]:
        return self.cut(" " + text.replace("▁", " ")) if text else []

    def lengths(self, tokens: list[str]) -> list[int]:
        """Of pre-tokens. Those with one space in front and none elsewhere are encoded as one text of TOGETHER words and told apart by
        the spaces with which their first pieces begin, which saves a call of the library for each."""
        plain = [x for x in tokens if x[0] == " " and x[1:2] not in ("", " ")]
        rest = [x for x in tokens if not (x[0] == " " and x[1:2] not in ("", " "))]
        found: dict[str, int] = {}
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self.library.encode(["".join(x)[1:] for x in groups], num_threads=1), strict=True):
            first = np.flatnonzero(self.opens[ids])
            found.update(zip(group, np.diff(first, append=len(ids)).tolist(), strict=True))
        for x in rest:
            if x[0] == "\n":
                found[x] = len(self.library.encode(x)) - 1
            elif x.strip(" "):
                found[x] = len(self.library.encode(x[1:]))
            else:
                found[x] = len(self.library.encode("a" + x)) - len(self.library.encode("a"))
        return [found[x] for x in tokens]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. What this worker remembers needs no look-up; of the rest the table gives what it has, the library all misses at once."""
        if self.cut is None:
            return [len(x) for x in self.library.encode(texts)]
        parts = [self.pre_tokens(x) for x in texts]
        cache = self.cache
        if self.cache_bytes > CACHE_BYTES:
            cache.clear()
            self.cache_bytes = 0
        fresh = list(set().union(*parts).difference(cache))
        found = self.table.find(fresh) if self.table else {}
        missed = [x for x in fresh if x not in found]
        cache.update(found)
        cache.update(zip(missed, self.lengths(missed), strict=True))
        counts = [sum(map(cache.__getitem__, own)) for own in parts]
        for x in fresh:
            if len(x) > CACHED_CHARS:
                del cache[x]
            else:
                self.cache_bytes += ENTRY_BYTES + len(x)
        return counts


def _worker(key: int, model: bytes) -> PieceCounter:
    return worker_keeps("token_counts", key, lambda: PieceCounter(model))


def _pruned(counts: Counter, most: int) -> Counter:
    """Misra and Gries' summary: what is left after the (most + 1)-th count is taken from all."""
    if len(counts) <= most:
        return counts
    least = sorted(counts.values(), reverse=True)[most]
    return Counter({k: n - least for k, n in counts.items() if n > least})


def _packed(counts: Counter) -> bytes:
    return zlib.compress("\0".join(f"{n} {k}" for k, n in counts.items()).encode(), 1)


def _unpacked(data: bytes) -> Counter:
    text = zlib.decompress(data).decode()
    return Counter({k: int(n) for n, _, k in (x.partition(" ") for x in text.split("\0"))} if text else {})


def frequent_pre_tokens(docs: DataFrame, model: bytes, text_col: str = "text", most: int = FREQUENT) -> Counter:
    """The summary of all pre-tokens of all texts: any that makes up more than 1/most of them is in it.

    Each partition gives one summary of at most `most` entries; summaries are merged in groups of a bounded number,
    level by level, and one comes to the driver. No pre-token is shuffled by its own key.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    key = zlib.crc32(model)

    def summarise(batches):
        counts, own = Counter(), _worker(key, shared.value)
        for batch in batches:
            for _, texts in text_slices(batch.column(0), SLICE):
                for text in texts:
                    counts.update(x for x in own.pre_tokens(text) if len(x) <= CACHED_CHARS and "\0" not in x)
                    if len(counts) > 8 * most:
                        counts = _pruned(counts, most)
        yield pa.RecordBatch.from_arrays([pa.array([_packed(_pruned(counts, most))], pa.binary())], ["summary"])

    def merge(pdf):
        total = Counter()
        for data in pdf["summary"]:
            total = _pruned(total + _unpacked(data), most)
        return pdf.iloc[:1][["slot"]].assign(summary=[_packed(total)])

    level = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(summarise, keeps=True), "summary binary")
    for slots in (4096, 64, 1):
        slot = F.spark_partition_id() % slots if slots == 4096 else F.col("slot") % slots
        level = level.select(slot.alias("slot"), "summary").groupBy("slot").applyInPandas(merge, "slot int, summary binary")
    found = level.first()
    return _unpacked(found["summary"]) if found else Counter()


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id_col, n_bytes, n_tokens, as the sentencepiece model gives them.

    Tier one is a broadcast LengthTable of the corpus's frequent pre-tokens (at most FREQUENT entries of at most
    CACHED_CHARS characters whatever the corpus); what it misses is encoded by the library. The worker remembers both.
    Documents stay where they were read. The tiers only save time: any table gives the same counts.

    Null texts count as empty and have no tokens; texts of any length are counted whole, in memory for one text. Null
    ids and repeated rows pass through; an empty table gives no rows. Other columns are not read.
    """
    spark, model = docs.sparkSession, file_bytes(model_path)
    key, own = zlib.crc32(model), PieceCounter(model)
    frequent = list(frequent_pre_tokens(docs, model, text_col)) if own.cut else []
    shared = spark.sparkContext.broadcast((model, LengthTable(frequent, own.lengths(frequent))))

    def run(batches):
        own = _worker(key, shared.value[0])
        own.table = shared.value[1]
        for batch in batches:
            for start, texts in text_slices(batch.column(1), SLICE):
                sizes = [len(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(sizes, pa.int64()), pa.array(own.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, keeps=True), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
