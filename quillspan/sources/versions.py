"""Tables that change by whole committed versions.

A version is a manifest in `_versions` that names, for each table and hash bucket of its key, the folder of its rows. Writers
put rows into new folders and then create the manifest under its final name in one step, so a reader sees a version whole or not
at all, a writer that dies leaves the last one as it is, and a table may be rewritten from itself. Only buckets with
changed keys are written; the rest of a version points at folders of versions before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class VersionConflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


def bucket_of(key: str, buckets: int) -> Column:
    """A row's bucket by its key; a null key has one too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """One version, to be read as often as needed; later versions don't change it."""

    spark: SparkSession
    root: str
    version: int
    content: dict

    @property
    def tables(self) -> list[str]:
        return sorted(self.content["tables"])

    def folders(self, name: str, buckets: Sequence[int] | None = None) -> list[str]:
        at = self.content["tables"][name]["folders"]
        return [at[k] for k in sorted(at, key=int) if buckets is None or int(k) in set(buckets)]

    def table(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """A table of this version, or only some of its buckets."""
        schema = self.content["tables"][name]["schema"]
        found = self.folders(name, buckets)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in found))

    def done(self, writer: str) -> int:
        """The last batch that `writer` has committed, -1 before the first."""
        return self.content["batches"].get(writer, -1)


class Versions:
    """The versions below a folder. tables: name -> (key column, schema as DDL); each has `buckets` hash buckets, a number of files that stays small."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, tuple[str, str]], buckets: int = 64):
        self.spark, self.root, self.buckets, self.keys = spark, root.rstrip("/"), buckets, {n: k for n, (k, _) in tables.items()}
        self._schemas = {n: s for n, (_, s) in tables.items()}
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("_versions")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def pin(self, version: int | None = None) -> Snapshot:
        """The latest version, or a given one. Before the first commit all tables are empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            empty = {n: {"schema": s, "folders": {}} for n, s in self._schemas.items()}
            return Snapshot(self.spark, self.root, 0, {"version": 0, "buckets": self.buckets, "batches": {}, "tables": empty})
        stream = self._fs().open(self._path(f"_versions/{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        content = json.loads(text)
        if content["buckets"] != self.buckets:
            raise ValueError(f"these tables have {content['buckets']} buckets, not {self.buckets}")
        return Snapshot(self.spark, self.root, version, content)

    def touched(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets that keys fall into: as many numbers at most as there are buckets."""
        return sorted(r["bucket"] for r in keys.select(bucket_of(key, self.buckets).alias("bucket")).distinct().collect())

    def write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Rows of some buckets, whole, into a new folder; bucket -> folder of each bucket that has rows. No version has them yet."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        placed = rows.withColumn("_bucket", bucket_of(self.keys[name], self.buckets))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        found = (f.getPath().getName() for f in self._fs().listStatus(self._path(folder)))
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in found if n.startswith("_bucket=")}

    def commit(self, base: Snapshot, changes: Mapping[str, tuple[Sequence[int], dict[str, str]]], writer: str = "", batch: int | None = None) -> Snapshot:
        """The version after `base`, in which for each table in `changes` (buckets, folders) these buckets are in those folders, or empty.

        Raises VersionConflict if that version is there already.
        """
        content = json.loads(json.dumps(base.content)) | {"version": base.version + 1}
        for name, (buckets, folders) in changes.items():
            kept = {k: f for k, f in content["tables"].get(name, {"folders": {}})["folders"].items() if int(k) not in set(buckets)}
            content["tables"][name] = {"schema": self._schemas[name], "folders": kept | folders}
        if batch is not None:
            content["batches"][writer] = batch
        self._create(f"_versions/{base.version + 1:012d}.json", json.dumps(content, sort_keys=True))
        return Snapshot(self.spark, self.root, base.version + 1, content)

    def _create(self, name: str, text: str) -> None:
        """A file that is there whole or not at all: written beside, then renamed, which fails where the name is taken."""
        draft = self._path(f"_drafts/{uuid.uuid4().hex}")
        out = self._fs().create(draft)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = self._path(name)
        self._fs().mkdirs(target.getParent())
        gateway = self.spark.sparkContext._gateway
        rename = self._hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        context = self._hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        try:
            context.rename(self._fs().makeQualified(draft), self._fs().makeQualified(target), options)
        except Exception as error:
            if self._fs().exists(target):
                raise VersionConflict(name) from error
            raise

    def change(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", batch: int | None = None) -> Snapshot:
        """A version in which merge(old rows, `rows`) stands in the buckets that `rows` touch; a batch that `writer` has committed changes nothing.

        `merge` gets and gives rows of these buckets only, and must leave keys as they are.
        """
        base = self.pin()
        if batch is not None and batch <= base.done(writer):
            return base
        buckets = self.touched(rows, self.keys[name])
        columns = [f.name for f in self.spark.createDataFrame([], self._schemas[name]).schema]
        merged = merge(base.table(name, buckets), rows).select(*columns)
        return self.commit(base, {name: (buckets, self.write(name, merged))}, writer, batch)

    def delete(self, name: str, column: str, values: Sequence[str]) -> tuple[Snapshot, dict[str, int]]:
        """A version without the rows that have one of a few `values` in a column, and how many went of each.

        Rows that stay are written and those that go are counted by the same scan. Buckets without such rows are found
        by the column alone and stay as they are.
        """
        base = self.pin()
        gone = F.coalesce(F.col(column).isin(*values), F.lit(False)) if values else F.lit(False)
        buckets = self.touched(base.table(name).where(gone), self.keys[name])
        if not buckets:
            return base, dict.fromkeys(values, 0)
        seen = Observation()
        counts = [F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(f"n{i}") for i, v in enumerate(values)]
        kept = base.table(name, buckets).observe(seen, *counts).where(~gone)
        after = self.commit(base, {name: (buckets, self.write(name, kept))})
        return after, {v: seen.get[f"n{i}"] for i, v in enumerate(values)}

    def replace(self, **tables: DataFrame) -> Snapshot:
        """A version with these tables whole in place of their rows; they may be read from the version before."""
        base = self.pin()
        every = list(range(self.buckets))
        return self.commit(base, {name: (every, self.write(name, rows)) for name, rows in tables.items()})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete buckets' folders that none of the last `keep` versions has, and older manifests; the folders deleted. Not while a writer is at work."""
        known = self.versions()
        last = known[-keep:]
        used = {f for v in last for name in self._schemas for f in self.pin(v).folders(name)}
        fs, gone = self._fs(), []
        for status in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            folder = f"data/{status.getPath().getName()}"
            held = [f"{folder}/{x.getPath().getName()}" for x in fs.listStatus(self._path(folder)) if x.isDirectory()]
            stale = [f for f in held if f not in used]
            # a folder without any bucket in use goes whole
            for f in stale if len(stale) < len(held) else [folder]:
                fs.delete(self._path(f), True)
                gone.append(f)
        for version in known[:-keep]:
            fs.delete(self._path(f"_versions/{version:012d}.json"), False)
        return sorted(gone)
