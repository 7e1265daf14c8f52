"""Byte-level BPE encoding and decoding over a pair occurrence index."""

from __future__ import annotations

import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import file_bytes, map_arrow, runs, text_slices, worker_keeps
from quillspan.llm.words import splitter

#: Bytes of words and ids that a worker remembers, what an entry takes beside them, and the longest word remembered.
CACHE_BYTES, ENTRY_BYTES, CACHED_CHARS = 48 << 20, 220, 128
#: Bytes of text whose words are merged together.
SLICE = 1_000_000
NONE = np.int64(1 << 40)
#: Fixed value: the published pre-tokenizer pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stands for itself, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def _sorted_set(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, data: bytes):
        import regex

        spec = json.loads(data)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.findall = splitter(PATTERN)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        left, right, made = (np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        self.made, self.wide = made, np.int64(max(self.pieces) + 1)
        # ranks can be applied in ascending order over all words at once only if a merge's parts are made before it
        rank_of = np.full(self.wide, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge uses a token that is made later")
        key = left * self.wide + right
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.cache: dict[str | int, bytes] = {}
        self.cache_bytes = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers.

        The words lie behind one another. `index` maps each active rank, thus each pair, to all positions where that
        pair begins; the lowest rank is applied to all its positions at once, and the pairs beside them move to the
        lists of their new ranks. A position whose pair has changed since stays in its old list and is skipped there.
        """
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)
        after[ends - 1] = -1
        before[ends - size] = -1
        rank = np.full(n, NONE, np.int64)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            of = rank[at]
            at, of = at[of < NONE], of[of < NONE]
            if not len(at):
                return
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for part, r in zip(np.split(at, cuts), of[np.concatenate(([0], cuts))].tolist(), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        enter(inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else _sorted_set(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1 and sym[at[0]] == sym[after[at[0]]]:
                taken, gone = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != gone:
                        taken.append(p)
                        gone = q
                at = np.array(taken)
            mate = after[at]
            sym[at] = self.made[r]
            alive[mate] = False
            rank[mate] = NONE
            beyond = after[mate]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            prior = before[at]
            touched = _sorted_set(np.concatenate((at, prior[prior >= 0])))
            to = after[touched]
            rank[touched] = np.where(to >= 0, self.ranks(sym[touched], sym[to]), NONE)
            enter(touched)
        left = np.add.reduceat(alive, ends - size) if n else np.zeros(0, np.int64)
        ids = sym[alive].astype("<u4").tobytes()
        stops = (np.cumsum(left) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; strings of added tokens inside a text become those tokens."""
        parts: list[list[str | int]] = []
        for text in texts:
            if self.split and any(x in text for x in self.added):
                own: list[str | int] = []
                for piece in self.split(text):
                    own += [self.added[piece]] if piece in self.added else self.findall(piece)
                parts.append(own)
            else:
                parts.append(self.findall(text))
        known = self.cache
        if self.cache_bytes > CACHE_BYTES:
            known.clear()
            self.cache_bytes = 0
        fresh = set().union(*parts).difference(known)
        words = [x for x in fresh if isinstance(x, str)]
        if words:
            known.update(zip(words, self.encode_words(words), strict=True))
        for x in fresh:
            if isinstance(x, int):
                known[x] = x.to_bytes(4, "little")
        out = [b"".join(map(known.__getitem__, own)) for own in parts]
        for x in words:
            if len(x) > CACHED_CHARS:
                del known[x]
            else:
                self.cache_bytes += ENTRY_BYTES + len(x) + len(known[x])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids outside the vocabulary give nothing, broken UTF-8 gives U+FFFD."""
        get = self.pieces.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def _worker(key: int, data: bytes) -> ByteBpe:
    return worker_keeps("bpe", key, lambda: ByteBpe(data))


def bpe_encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row for each row of `docs`: id_col, ids (array of int), and decoded (string) if asked for.

    The vocabulary, a file of a few MB, goes to the executors by broadcast. A task takes about SLICE bytes of its texts
    at a time, gathers their distinct words that its worker hasn't met, and merges those together over one pair
    occurrence index. A word stands for all places where it occurs, in this slice and, by the worker's cache (of
    CACHE_BYTES), in later ones, so the index covers the partition's pairs without holding each of their positions: 26 MB
    of the given texts have 5.1 million words and 0.38 million distinct ones. An index over a whole partition would take
    some 60 bytes for each byte of text. Nothing is shuffled. `decoded` is worked out from the ids, as bpe_decode does,
    by the same worker.

    Null and empty texts have no ids; a text or word of any length is encoded whole. Null ids of documents and repeated
    rows pass through; an empty table gives no rows. Other columns are not read.
    """
    data = file_bytes(vocabulary_path)
    key, shared = zlib.crc32(data), docs.sparkSession.sparkContext.broadcast(data)

    def work(batch: pa.RecordBatch):
        own = _worker(key, shared.value)
        for start, texts in text_slices(batch.column(1), SLICE):
            found = own.encode(texts)
            ids = np.frombuffer(b"".join(found), "<i4")
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            columns, names = [batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["id", "ids"]
            if decoded:
                columns, names = [*columns, pa.array([own.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded, keeps=True).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of `encoded`: id_col, ids, decoded (string).

    Null ids arrays and null ids give empty text; special tokens are kept as their strings. Otherwise as bpe_encode.
    """
    data = file_bytes(vocabulary_path)
    key, shared = zlib.crc32(data), encoded.sparkSession.sparkContext.broadcast(data)

    def work(batch: pa.RecordBatch):
        own, ids = _worker(key, shared.value), batch.column(1)
        for start, stop in runs(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), SLICE // 4):
            texts = [own.decode(x or []) for x in ids.slice(start, stop - start).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), ids.slice(start, stop - start), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_arrow(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string", keeps=True).withColumnRenamed("id", id_col)
