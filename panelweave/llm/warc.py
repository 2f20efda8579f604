"""Web archives: a deterministic sharded WARC writer and a reader.

Records are put in order of their ids by splitters drawn from the ids themselves, so the same pages give the same
files. A task writes its shards as files of one gzip member a record and begins a new file when the compressed size
reaches a limit. Files get temporary names; the table of what was written names one attempt of every task, only those
files are renamed, and the manifest is written last. A rerun task leaves files that no manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import new_folder, quoted, sent_along, written
from panelweave.operators.panel import number_rows

sent_along(__name__)

DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_COLUMNS = "shard int, part int, temporary string, name string, records long, bytes long, sha1 string"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(ident: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record: ``response`` with the payload, or ``revisit`` with its headers only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{_sha1(payload)}", f"WARC-Block-Digest: sha1:{_sha1(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


class _File:
    """One archive under a temporary name."""

    def __init__(self, folder: str, shard: int, part: int):
        self.shard, self.part, self.records, self.bytes = shard, part, 0, 0
        self.name = f"pages-{shard:06d}-{part:05d}.warc.gz"
        self.temporary = f"{self.name}.{uuid.uuid4().hex}.tmp"
        self.store, path = fs.FileSystem.from_uri(f"{folder}/{self.temporary}")
        self.out, self.digest = self.store.open_output_stream(path, compression=None), hashlib.sha1()

    def add(self, data: bytes) -> None:
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = member.compress(data) + member.flush()
        self.out.write(packed)
        self.digest.update(packed)
        self.records += 1
        self.bytes += len(packed)

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.digest.hexdigest()


def _splitters(ids: DataFrame, shards: int, per_shard: int = 100) -> list[int]:
    """Bounds of shards: quantiles of those ids whose hash is small, about ``per_shard`` for each shard.

    They are ranked by Spark; only the bounds, one number a shard, reach the driver.
    """
    rows = ids.count()
    if shards < 2 or not rows:
        return []
    share = min(1.0, per_shard * shards / rows)
    drawn = ids.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("id")
    ranked = number_rows(drawn, [F.col("id")], "rank", start=0).withColumns({"shards": F.lit(shards).cast("long"), "n": F.lit(drawn.count())})
    ranked = ranked.withColumn("k", F.expr("(rank * shards + n - 1) DIV n"))
    bounds = ranked.where("k BETWEEN 1 AND shards - 1 AND (k * n) DIV shards = rank").select("id")
    return sorted({r[0] for r in bounds.collect()})


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    shard_bytes: int = 256_000_000,
    file_bytes: int = 32_000_000,
) -> DataFrame:
    """Writes a record for each row of ``pages`` below ``folder`` and returns the manifest, a row per file.

    Payloads are written as UTF-8, null as empty. Of equal payloads of ``least_bytes`` or more, the record with the
    smallest id is a response and the others revisit it; smaller payloads are all responses. Of rows that repeat the
    smallest id one is the response. Rows without id come first, always as responses. An empty table gives an empty
    manifest. ``shard_bytes`` counts payload before and ``file_bytes`` after compression: a shard is what a task sorts and
    holds several files, each of which ends with the record that reaches the limit. Rows of one id are in one shard.
    """
    data = f"{folder}/data"
    store, path = fs.FileSystem.from_uri(data)
    store.create_dir(path, recursive=True)
    rows = pages.select(
        quoted(id_col).cast("long").alias("id"), quoted(url_col).alias("url"),
        F.coalesce(quoted(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha2("payload", 256))
    narrow = written(rows.select("id", "sha", F.octet_length("payload").alias("size")), folder, "digests")
    size = narrow.agg(F.sum("size")).first()[0] or 0
    groups = narrow.where((F.col("size") >= least_bytes) & F.col("id").isNotNull()).groupBy("sha").agg(
        F.min("id").alias("first"), F.count("*").alias("n")
    ).where("n > 1")
    again = narrow.where("id IS NOT NULL").join(groups, "sha").select("id", "sha", "first").distinct()
    shards = max(1, math.ceil(size / shard_bytes))
    bounds = np.array(_splitters(narrow, shards), np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), side="right"))

    # What a page revisits stands before the page in the same order, which spares a join of the payloads.
    merged = again.select(
        "id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha", "first",
        F.lit(0).alias("kind"),
    ).unionByName(rows.withColumn("first", F.lit(None).cast("long")).withColumn("kind", F.lit(1)))
    merged = merged.withColumn("shard", shard_of("id")).repartitionById(shards, F.col("shard")).sortWithinPartitions(
        F.col("shard"), F.col("id").asc_nulls_first(), "kind", "sha", F.col("url").asc_nulls_first()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done, at, nth, firsts, given = None, [], None, 0, {}, set()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                names = ("shard", "id", "url", "payload", "sha", "first", "kind")
                for shard, ident, url, payload, sha, first, kind in zip(*[part.column(c).to_pylist() for c in names]):
                    if (shard, ident) != at:
                        at, nth, firsts, given = (shard, ident), 0, {}, set()
                    if not kind:
                        firsts[sha] = first
                        continue
                    nth += 1
                    first = firsts.get(sha)
                    if first == ident and sha not in given:
                        given.add(sha)
                        first = None
                    if out is None or out.shard != shard or out.bytes >= file_bytes:
                        number = out.part + 1 if out is not None and out.shard == shard else 0
                        done += [out.close()] if out is not None else []
                        out = _File(data, shard, number)
                    name = "" if ident is None else str(ident)
                    out.add(record(name if nth == 1 else f"{name}:{nth}", url, payload, None if first is None else str(first)))
        done += [out.close()] if out is not None else []
        names = [c.split()[0] for c in FILE_COLUMNS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 7, kinds)], names=names)

    files = written(merged.mapInArrow(run, FILE_COLUMNS), folder, "written")

    def rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for old, new in zip(frame["temporary"], frame["name"]):
                store, target = fs.FileSystem.from_uri(f"{data}/{new}")
                if store.get_file_info(target).type == fs.FileType.NotFound:  # else an earlier attempt did it
                    store.move(fs.FileSystem.from_uri(f"{data}/{old}")[1], target)
            yield frame

    return written(files.mapInPandas(rename, FILE_COLUMNS).drop("temporary"), folder, "manifest")


def _records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    held = stream.read(chunk)
    while held:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not held:
                raise ValueError("the archive ends inside a record")
            parts.append(member.decompress(held))
            held = member.unused_data or (b"" if member.eof else stream.read(chunk))
        yield b"".join(parts)
        held = held or stream.read(chunk)


def parse(data: bytes) -> dict:
    """A record's id, url, type, what it refers to, payload length, digest and payload; wrong digests are errors."""
    head, _, rest = data.partition(CRLF + CRLF)
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    length = int(fields["Content-Length"])
    block = rest[:length]
    if rest[length:] != CRLF + CRLF or f"sha1:{_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError("a record's block isn't whole")
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(http.decode().rpartition("Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or _sha1(payload) != digest):
        raise ValueError("a payload isn't whole")
    number = lambda x: int(v) if (v := x.removeprefix("<urn:page:").rstrip(">").partition(":")[0]) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that ``manifest`` names; a file whose digest differs from the manifest's is an error."""
    data = f"{folder}/data"
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, want in ((n, w) for b in batches for n, w in zip(b.column("name").to_pylist(), b.column("sha1").to_pylist())):
            store, path = fs.FileSystem.from_uri(f"{data}/{name}")
            digest = hashlib.sha1()

            class Hashed:
                def __init__(self, raw):
                    self.raw = raw

                def read(self, n):
                    got = self.raw.read(n)
                    digest.update(got)
                    return got

            with store.open_input_stream(path, compression=None) as raw:
                rows, held = [], 0
                for data_of in _records(Hashed(raw)):
                    rows.append(parse(data_of))
                    held += len(data_of)
                    if held > 4_000_000 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names=names)
                        rows, held = [], 0
            if digest.hexdigest() != want:
                raise ValueError(f"{name} differs from what was written")
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    files = manifest.select("name", "sha1").repartition(max(1, manifest.count()), "name")
    return files.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def warc_query(spark, folder: str) -> DataFrame:
    place = new_folder(spark)
    manifest = write_archives(spark.read.parquet(f"{folder}/pages.parquet"), place)
    return read_archives(manifest, place, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
