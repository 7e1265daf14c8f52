"""WARC records in ZIP-packaged archives: writing them, and reading records by range without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm._common import open_store, scratch_path, spool

#: Fixed values of the ZIP format: signatures and layouts of its records, little-endian.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
LOCAL_FORM, CENTRAL_FORM, END_FORM, END64_FORM, LOCATOR64_FORM = "<IHHHHHIIIHH", "<IHHHHHHIIIHHHHHII", "<IHHHHIIH", "<IQHHIIQQQQ", "<IIQI"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive, about, after which its writer begins another, and bytes of an archive that one task reads, about.
ARCHIVE_BYTES, READ_BYTES = 256 << 20, 16 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -----------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members behind one another; sizes are written after their data, so that nothing is held in memory.

    The directory is in ZIP64 form where a number needs it, and always if `zip64`.
    """

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.at, self.members, self.zip64 = sink, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name, self.at, 0, 0])
        # bit 3: the sizes follow the data; bit 11: the name is UTF-8
        self._put(struct.pack(LOCAL_FORM, LOCAL, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(name.encode()), 0) + name.encode())

    def write(self, data: bytes) -> None:
        self.members[-1][2] = zlib.crc32(data, self.members[-1][2])
        self.members[-1][3] += len(data)
        self._put(data)

    def end_member(self) -> None:
        name, _, crc, size = self.members[-1]
        wide = self.zip64 or size >= FULL32
        self._put(struct.pack("<IIQQ" if wide else "<IIII", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, offset, crc, size in self.members:
            wide = self.zip64 or size >= FULL32 or offset >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            self._put(
                struct.pack(CENTRAL_FORM, CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, *([FULL32] * 2 if wide else [size] * 2), len(name.encode()), len(extra), 0, 0, 0, 0, FULL32 if wide else offset) + name.encode() + extra
            )
        size, n = self.at - start, len(self.members)
        if self.zip64 or self.at >= FULL32 or n >= FULL16:
            at = self.at
            self._put(struct.pack(END64_FORM, END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack(LOCATOR64_FORM, LOCATOR64, 0, at, 1))
            self._put(struct.pack(END_FORM, END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self._put(struct.pack(END_FORM, END, 0, 0, n, n, size, start, 0))


def warc_record(page_id, url: str, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    """A response record, or a revisit record if refers_to is given: its HTTP head keeps the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join(url.split())}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])).encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, zip64: bool = False) -> DataFrame:
    """A WARC record for each row of `pages`, in ZIP archives below `folder`; the table of archives (path, records, bytes).

    Of equal payloads of min_revisit_bytes or more the row with the smallest id is a response, the others revisit it.
    Payloads are equal when SHA-1 and length are. Each task writes archives of its own, under names that no other
    attempt uses, and the table lists those of the attempts that count; it is spooled, so that a lost executor doesn't
    change it. An archive holds gzipped records as one stored member and their index as another.

    Null payloads are empty ones. Rows without an id are written as responses or revisit others, and are revisited
    only if no equal payload has an id. Rows that repeat id and payload: all with the smallest id are responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    groups = rows.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where((F.col("copies") > 1) & (F.col("size") >= min_revisit_bytes) & F.col("first").isNotNull())
    # only revisits need to find their group, and they go without payloads
    group = F.concat_ws(":", "digest", "size")
    firsts = groups.select(group.alias("group"), "first")
    revisits = rows.select("id", group.alias("group")).join(firsts, "group").where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("rid"), F.col("group").alias("rgroup"), F.col("first").alias("refers_to")).distinct()
    found = rows.withColumn("group", group).join(revisits, F.col("id").eqNullSafe(F.col("rid")) & (F.col("group") == F.col("rgroup")), "left").select("id", "url", "payload", "refers_to")

    def write(batches):
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        sink = out = None
        index: list[bytes] = []
        name, payload_bytes = "", 0

        def finish() -> pa.RecordBatch:
            out.end_member()
            out.begin(INDEX)
            out.write(b"".join(sorted(index)))
            out.end_member()
            out.close()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([out.at], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, index, payload_bytes = f"{uuid.uuid4().hex}.wacz", [], 0
                    sink = store.open_output_stream(f"{base}/{name}")
                    out = ZipWriter(sink, zip64)
                    out.begin(DATA)
                digest = base32_sha1(payload)
                record = gzipped(warc_record(page_id, url, payload, digest, len(payload), refers_to))
                index.append(json.dumps({"id": page_id, "offset": out.members[-1][3], "length": len(record)}).encode() + b"\n")
                out.write(record)
                payload_bytes += len(payload)
                if payload_bytes >= ARCHIVE_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return spool(found.mapInArrow(write, "path string, records long, bytes long"), "archives")


# --- reading -----------------------------------------------------------------------------------------------------


def read_range(file, offset: int, size: int) -> bytes:
    data = file.read_at(size, offset)
    if len(data) != size:
        raise ValueError(f"the archive ends within {size} bytes at {offset}")
    return data


def directory(file) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, offset of the data, stored size) of a ZIP archive's members.

    Reads the end of the file, the central directory that it points to, in ZIP64 form too, and members' local heads.
    """
    total = file.size()
    tail_at = max(0, total - 65557)
    tail = read_range(file, tail_at, total - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive")
    *_, n, size, start, _ = struct.unpack_from(END_FORM, tail, at)
    if FULL16 == n or FULL32 in (size, start):
        where = tail_at + at - 20
        mark, _, end64, _ = struct.unpack(LOCATOR64_FORM, read_range(file, where, 20))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        mark, *_, n, size, start = struct.unpack(END64_FORM, read_range(file, end64, 56))
        if mark != END64:
            raise ValueError("no ZIP64 directory")
    data, at = read_range(file, start, size), 0
    for _ in range(n):
        mark, _, _, _, method, _, _, _, packed, plain, n_name, n_extra, n_comment, _, _, _, offset = struct.unpack_from(CENTRAL_FORM, data, at)
        if mark != CENTRAL:
            raise ValueError("the central directory is broken")
        name = data[at + 46 : at + 46 + n_name].decode()
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:
            tag, length = struct.unpack_from("<HH", data, extra)
            if tag == 1:
                # only the numbers that overflow their fields stand here, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", data, extra + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra += 4 + length
        head = struct.unpack(LOCAL_FORM, read_range(file, offset, 30))
        if head[0] != LOCAL:
            raise ValueError(f"no member at {offset}")
        yield name, method, offset + 30 + head[9] + head[10], packed
        at = end + n_comment


def archive_index(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """(path, id, offset, length): where each record lies, from the index members of the archives in column path.

    Only directories and indexes are read. Members that are stored are located; compressed ones raise an error.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = open_store(path)
                with store.open_input_file(inner) as file:
                    members = {name: (method, at, size) for name, method, at, size in directory(file)}
                    for want in (DATA, INDEX):
                        if want not in members or members[want][0]:
                            raise ValueError(f"{path} has no stored member {want}")
                    _, base, _ = members[DATA]
                    _, at, size = members[INDEX]
                    found = [json.loads(x) for x in read_range(file, at, size).splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([x["id"] for x in found], pa.int64()), pa.array([base + x["offset"] for x in found], pa.int64()), pa.array([x["length"] for x in found], pa.int64())],
                    ["path", "id", "offset", "length"],
                )

    return archives.select("path").mapInArrow(run, "path string, id long, offset long, length long")


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of indexed records, each read by its range.

    Records are dealt by archive and place in it, so that many tasks read few archives.

    A response's payload is checked against its digest; a revisit's length and digest are those of the full payload,
    its own payload is null.
    """

    def run(batches):
        for batch in batches:
            rows = pd.DataFrame(dict(zip(("path", "id", "offset", "length"), (c.to_pylist() for c in batch.columns), strict=True))).sort_values(["path", "offset"])
            out = []
            for path, own in rows.groupby("path", sort=False):
                store, inner = open_store(path)
                with store.open_input_file(inner) as file:
                    for at, length in zip(own["offset"].tolist(), own["length"].tolist(), strict=True):
                        fields, http, payload = parse_record(zlib.decompress(read_range(file, at, length), 31))
                        digest, kind, page_id = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], fields["warc-record-id"][10:-1]
                        if kind == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"record at {at} of {path} is broken")
                        refers = fields.get("warc-refers-to", "")[10:-1]
                        size = len(payload) if kind == "response" else int(http["content-length"])
                        out.append((int(page_id) if page_id != "None" else None, fields.get("warc-target-uri", ""), kind, size, digest, int(refers) if refers else None, payload if with_payload and kind == "response" else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    dealt = index.repartition("path", F.expr(f"offset DIV {READ_BYTES}"))
    return dealt.mapInArrow(run, "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write archives of `pages` to `folder` (else to a new one in the shared folder) and read all their records back."""
    spark = pages.sparkSession
    archives = write_archives(pages, folder or scratch_path(spark, "warc"), id_col, url_col, payload_col)
    return read_records(archive_index(spark, archives), with_payload=False).drop("payload").withColumnRenamed("id", id_col)
