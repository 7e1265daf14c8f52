"""Line deduplication: a sharded minimal perfect hash over line hashes, probed by documents."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import ASCII_SPACE, carried, lean, open_store, runs, scratch_path, shuffle_partitions, spool, text_slices, uncarried
from quillspan.llm.mph import MinimalPerfectHash

#: Keys a shard holds on average, and bytes of shards that a worker keeps open.
SHARD_KEYS, CACHE_BYTES = 200_000, 64 << 20
#: Bytes of text that a task holds as lines at a time.
SLICE = 2_000_000
NO_ID = np.iinfo(np.int64).min


def line_key(line: str, min_chars: int) -> bytes | None:
    """The line without ASCII white space at its ends, A-Z lower-cased; None if shorter than min_chars."""
    line = line.strip(ASCII_SPACE)
    return line.encode().lower() if len(line) >= min_chars else None


def _hashes(lines: list[str], min_chars: int) -> np.ndarray:
    """Two 64-bit words for each line; both zero for lines without a key."""
    digest = xxhash.xxh3_128_digest
    keys = [line_key(x, min_chars) for x in lines]
    return np.frombuffer(b"".join([digest(k) if k is not None else bytes(16) for k in keys]), np.uint64).reshape(-1, 2)


def _distinct(batch: pa.RecordBatch, texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the two words of each line key, once a row."""
    ids = [NO_ID if i is None else i for i in batch.column(0).to_pylist()]
    digest = xxhash.xxh3_128_digest
    own = [{digest(k) for x in text.split("\n") if (k := line_key(x, min_chars)) is not None} for text in texts]
    flat = np.frombuffer(b"".join([y for x in own for y in x]), np.int64).reshape(-1, 2)
    return np.repeat(np.array(ids, np.int64), [len(x) for x in own]), flat


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> bytes:
    """One shard: a perfect hash over the first words of keys, whose slots index the second words (the fingerprints), counts and
    keepers. Keys whose first words agree share no perfect hash: all but one of them follow in a list of their own."""
    _, first = np.unique(h1, return_index=True)
    rest = np.setdiff1d(np.arange(len(h1)), first)
    mph = MinimalPerfectHash.build(h1[first].view(np.uint64))
    slot = mph.slots(h1[first].view(np.uint64))
    arrays = np.empty((3, len(first)), np.int64)
    for array, column in zip(arrays, (h2, counts, keepers), strict=True):
        array[slot] = column[first]
    clashes = np.stack([x[rest] for x in (h1, h2, counts, keepers)], axis=1)
    head = mph.to_bytes()
    return np.array([len(first), len(rest), len(head)], np.int64).tobytes() + head + arrays.tobytes() + clashes.tobytes()


class Shard:
    """A shard's arrays, as they lie in its file."""

    def __init__(self, data):
        n, m, head = np.frombuffer(data, np.int64, 3).tolist()
        self.mph = MinimalPerfectHash.from_bytes(memoryview(data)[24 : 24 + head])
        self.prints, self.counts, self.keepers = np.frombuffer(data, np.int64, 3 * n, 24 + head).reshape(3, n)
        self.clashes = {(a, b): (c, d) for a, b, c, d in np.frombuffer(data, np.int64, 4 * m, 24 + head + 24 * n).reshape(m, 4).tolist()}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the line, and the id that keeps it; 0 documents for lines not indexed."""
        counts, keepers = np.zeros(len(h1), np.int64), np.full(len(h1), NO_ID)
        slot = self.mph.slots(h1.view(np.uint64))
        hit = slot >= 0
        hit[hit] = self.prints[slot[hit]] == h2[hit]
        counts[hit], keepers[hit] = self.counts[slot[hit]], self.keepers[slot[hit]]
        if self.clashes:
            for i in np.flatnonzero(~hit).tolist():
                counts[i], keepers[i] = self.clashes.get((int(h1[i]), int(h2[i])), (0, NO_ID))
        return counts, keepers


class ShardFiles:
    """The shards below a shared folder, opened when they are needed; those used last stay open, up to CACHE_BYTES.

    A file on a mounted disk is mapped, so that only pages that are probed are read; of other stores a shard is read whole.
    """

    def __init__(self, folder: str, shards: int):
        self.store, self.base = open_store(folder)
        self.shards, self.open, self.held = shards, OrderedDict(), 0

    def _load(self, shard: int) -> tuple[Shard | None, int]:
        path = shard_path(self.base, shard)
        size = self.store.get_file_info(path).size
        if size is None:  # no key falls there
            return None, 0
        if self.store.type_name == "local":
            return Shard(pa.memory_map(path).read_buffer()), size
        with self.store.open_input_file(path) as file:
            return Shard(file.read_buffer()), size

    def _shard(self, shard: int) -> Shard | None:
        if shard in self.open:
            self.open.move_to_end(shard)
        else:
            self.open[shard] = self._load(shard)
            self.held += self.open[shard][1]
            while self.held > CACHE_BYTES and len(self.open) > 1:
                self.held -= self.open.popitem(last=False)[1][1]
        return self.open[shard][0]

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of lines (two words each, both zero for a line without a key) what their shards hold; each shard is opened once."""
        counts, keepers = np.zeros(len(h), np.int64), np.full(len(h), NO_ID)
        asked = np.flatnonzero((h != 0).any(axis=1))
        shard = h[asked, 1] % self.shards
        order = np.argsort(shard, kind="stable")
        asked, shard = asked[order], shard[order]
        for at in np.split(asked, np.flatnonzero(np.diff(shard)) + 1) if len(asked) else []:
            found = self._shard(int(h[at[0], 1] % self.shards))
            if found is not None:
                counts[at], keepers[at] = found.probe(h[at, 0], h[at, 1])
        return counts, keepers


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/{shard % 1000:03d}/{shard}.shard"


def line_index(docs: DataFrame, folder: str, min_docs: int, min_chars: int) -> int:
    """Write the index of docs (id, text) below `folder`, a file a shard; the number of shards.

    It holds every distinct line key found in at least min_docs documents. Lines are counted by hash before the shuffle;
    a row counts a line once, and rows that share an id count it once together. Shards hold about SHARD_KEYS keys each,
    whatever the corpus. A file depends on its keys alone and takes its name when it is whole, so a task may run again.
    """

    def lines(batches):
        for batch in batches:
            for start, texts in text_slices(batch.column(1), SLICE):
                ids, h = _distinct(batch.slice(start, len(texts)), texts, min_chars)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["id", "h1", "h2"])

    found = docs.mapInArrow(lean(lines), "id long, h1 long, h2 long").withColumn("n", F.lit(1).cast("long"))
    ids = docs.select(F.coalesce("id", F.lit(int(NO_ID))).alias("id"))
    again = spool(ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id", F.lit(True).alias("again")), "repeated-ids")
    if not again.isEmpty():
        marked = found.join(again, "id", "left").groupBy("h1", "h2", F.when(F.col("again"), F.col("id")).alias("own")).agg(F.sum("n").alias("n"), F.max("id").alias("id"))
        found = marked.select("h1", "h2", "id", F.when(F.col("own").isNull(), F.col("n")).otherwise(1).alias("n"))
    counted = found.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    kept = spool(counted, "line-counts")
    n = kept.count()
    shards = max(1, -(-n // SHARD_KEYS), min(shuffle_partitions(docs.sparkSession), n // 2000))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        store, base = open_store(folder)
        shard = int(pdf["shard"].iloc[0])
        path = shard_path(base, shard)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as file:
            file.write(build_shard(*(pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "n_docs", "keeper"))))
        store.move(part, path)
        return pd.DataFrame({"shard": [shard], "keys": [len(pdf)]})

    table = kept.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards)).cast("long")).groupBy("shard")
    table.applyInPandas(write, "shard long, keys long").agg(F.sum("keys")).collect()
    return shards


def _rebuilt(text: str, drop: list[bool]) -> str:
    return "\n".join([x for x, d in zip(text.split("\n"), drop, strict=True) if not d])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of `docs`: id_col (long), text (without the dropped lines), n_lines, n_dropped, then `carry`.

    Texts are split at line feeds. Lines whose keys (see line_key) have at least min_chars code points and stand in at
    least min_docs documents are dropped, except in the document with the largest id that holds them; other lines stay.

    Lines are never joined nor sent to the index: documents stay where they are read, and a task probes the shards'
    arrays, files in the shared folder, by the hashes of an Arrow batch's lines in order of shard. A worker keeps shards
    of CACHE_BYTES at most, whatever the index. 128 bits of a line's hash decide.

    Null texts count as empty, which is one empty line. Rows that share an id are one document, and so are rows without
    one, whose id is below all others. Texts of any length are split whole. An empty table gives no rows. Columns in
    `carry` are passed on, but for names that the result uses itself; others are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), carried(carry, (id_col, "text", "n_lines", "n_dropped")))
    folder = scratch_path(docs.sparkSession, "line-index")
    shards = line_index(rows.select("id", "text"), folder, min_docs, min_chars)

    def run(batches):
        index = ShardFiles(folder, shards)
        for batch in batches:
            found, n_lines = [], []
            for _, texts in text_slices(batch.column(1), SLICE):
                parts = [x.split("\n") for x in texts]
                n_lines += map(len, parts)
                found.append(_hashes([y for x in parts for y in x], min_chars).view(np.int64))
            counts, keepers = index.probe(np.concatenate([*found, np.zeros((0, 2), np.int64)]))
            ids = pc.fill_null(batch.column(0), int(NO_ID)).to_numpy()
            drop = (counts > 0) & (keepers != np.repeat(ids, n_lines))
            ends = np.cumsum([0, *n_lines])
            n_dropped = np.diff(np.concatenate(([0], np.cumsum(drop)))[ends])
            text = pc.fill_null(batch.column(1), "")
            changed = n_dropped > 0
            at = np.flatnonzero(changed).tolist()
            if at:
                new = [_rebuilt(text[i].as_py(), drop[ends[i] : ends[i + 1]].tolist()) for i in at]
                text = pc.replace_with_mask(text, pa.array(changed), pa.array(new, text.type))
            out = pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(n_lines, pa.int64()), pa.array(n_dropped.astype(np.int64)), batch.column(2)], ["id", "text", "n_lines", "n_dropped", "carried"])
            for start, stop in runs(pc.binary_length(text).to_numpy(zero_copy_only=False), 2 * SLICE):
                yield out.slice(start, stop - start)

    done = rows.mapInArrow(lean(run), f"id long, text string, n_lines long, n_dropped long, carried {rows.schema['carried'].dataType.simpleString()}")
    return uncarried(done.withColumnRenamed("id", id_col), id_col, "text", "n_lines", "n_dropped")
