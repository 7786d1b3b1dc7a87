"""WARC archives with payload dedup, and their capture index by external merge.

1. Payload digests are counted by value; rows whose payload a smaller id already holds become revisits (a small table).
2. Each task writes its pages as gzip-per-record WARC files in the shared folder; only names of finished files are kept, so a
   lost or repeated task leaves at most an orphan file.
3. The archives are read back, every record checked against its digest. A file's entries, sorted by (URL key, timestamp, id),
   are a run, cut at range borders (quantiles of a sample of about SAMPLES keys a range; ids split a hot URL).
4. The runs of a range undergo a k-way merge in a loser tree. Ranges follow each other in partition order, so the result is
   the globally ordered capture history.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import by_part, scratch, shuffle_partitions, stored

ROLL_BYTES = 128 << 20
SAMPLES = 40
LEVEL = 3
DEFAULT_DATE = "2020-01-01T00:00:00Z"  # of captures without a time of their own
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
_ENTRY = ["urlkey", "timestamp", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "offset", "length"]
_RUN = pa.schema([("part", pa.int32()), *[(c, pa.list_(pa.int64() if c in ("page_id", "payload_bytes", "refers_to", "offset", "length") else pa.string())) for c in _ENTRY]])
_RUN_TYPE = T.StructType([T.StructField("part", T.IntegerType()), *[
    T.StructField(c, T.ArrayType(T.LongType() if c in ("page_id", "payload_bytes", "refers_to", "offset", "length") else T.StringType())) for c in _ENTRY]])
_OUT = T.StructType([T.StructField(c, f.dataType.elementType) for c, f in zip(_ENTRY, _RUN_TYPE.fields[1:], strict=True)])


def shared_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors see (file, hdfs, s3, gs, ... or a plain path)."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3a?n?://", "s3://", uri))


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query: ``com,example,www)/a?b``; empty for a null URL."""
    if url is None:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = re.search(r"[/?]", rest)
    host, tail = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    return ",".join(reversed(host.lower().split("."))) + ")" + (tail or "/")


# --------------------------------------------------------------------------- records
def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: " + re.sub(r"[\r\n\x00]", lambda m: f"%{ord(m[0]):02X}", v) for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit carries the HTTP header of the full payload but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = _header([
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {refers_to}')}>"),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + bare_digest(payload)),
        ("WARC-Profile", None if refers_to is None else _PROFILE), ("Page-ID", None if page_id is None else str(page_id)),
        ("Refers-To-Page-ID", None if refers_to is None else str(refers_to)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush()


def read_records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of each gzip member of a WARC file, one record in memory at a time."""
    offset, rest = 0, b""
    while True:
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            chunk = rest or stream.read(1 << 20)
            if not chunk:
                if used:
                    raise ValueError(f"archive ends inside the record at {offset}")
                return
            rest = b""
            parts.append(inflate.decompress(chunk))
            used += len(chunk)
        rest = inflate.unused_data
        used -= len(rest)
        head, block = b"".join(parts).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield offset, used, fields, block[: int(fields["Content-Length"])]
        offset += used


def entry(fields: dict[str, str], block: bytes) -> dict:
    """Index entry of a record; raises if a response's payload doesn't have its digest."""
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or bare_digest(payload) != digest):
        raise ValueError(f"payload of page {fields.get('Page-ID')} doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return {"urlkey": url_key(url), "timestamp": fields["WARC-Date"], "page_id": number("Page-ID"), "url": url, "record_type": fields["WARC-Type"],
            "payload_bytes": size, "payload_digest": digest, "refers_to": number("Refers-To-Page-ID")}


# --------------------------------------------------------------------------- loser tree
class LoserTree:
    """k-way merge of sorted lists: inner nodes hold the loser of their match, so a step replays one path of log2(k)."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = [r for r in runs if r], key, len([r for r in runs if r])
        self.at = [0] * self.k
        self.heads = [key(r[0]) for r in self.runs]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        """Run a's head comes before run b's; a finished run loses, ties go to the lower run."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, leaf: int, filling: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if filling and other < 0:
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[w := self.tree[0]] is not None:
            run = self.runs[w]
            yield run[self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(run[self.at[w]]) if self.at[w] < len(run) else None
            self._play(w)


def sort_key(e: dict) -> tuple:
    """URL key, timestamp, id (null ids first), then what tells repeated rows apart."""
    return e["urlkey"], e["timestamp"], e["page_id"] is not None, e["page_id"] or 0, e["record_type"], e["url"] or "", e["file"], e["offset"]


# --------------------------------------------------------------------------- tasks
def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared_fs(folder)
        fs.create_dir(base, recursive=True)
        out, path, count, size, done = None, None, 0, 0, []
        for batch in batches:
            for page_id, url, date, html, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    path, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                data = record(page_id.as_py(), url.as_py(), date.as_py(), payload, first.as_py())
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    done.append((path.removeprefix(base + "/"), count, size))
        if out is not None:
            out.close()
            done.append((path.removeprefix(base + "/"), count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=_MANIFEST.names)
    return run


def _read(folder: str, borders: list[tuple]):
    def cut(run: list[dict]) -> Iterator[dict]:
        keys = [sort_key(e)[:4] for e in run]
        parts = [bisect_right(borders, k) for k in keys]
        a = 0
        while a < len(run):
            b = bisect_right(parts, parts[a], a)
            for c in range(a, b, 20_000):
                yield {"part": parts[a]} | {name: [e[name] for e in run[c : min(b, c + 20_000)]] for name in _ENTRY}
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    entries = [entry(fields, block) | {"file": name, "offset": at, "length": n} for at, n, fields, block in read_records(stream)]
                for row in cut(sorted(entries, key=sort_key)):
                    yield pa.RecordBatch.from_pylist([row], schema=_RUN)
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [f.type.value_type for f in list(_RUN)[1:]]
    for _, rows in by_part(batches):
        runs = [[dict(zip(_ENTRY, e, strict=True)) for e in zip(*(r[c] for c in _ENTRY), strict=True)] for r in rows]
        held = []
        for e in LoserTree(runs, sort_key):
            held.append(e)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in held], k) for c, k in zip(_ENTRY, kinds, strict=True)], names=_ENTRY)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in held], k) for c, k in zip(_ENTRY, kinds, strict=True)], names=_ENTRY)


# --------------------------------------------------------------------------- plan
def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds ``first``: the id that a row revisits, null for responses. Of rows that repeat an id and payload one is the response."""
    keyed = pages.withColumn("digest", F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))))
    seen = keyed.where(F.col("id").isNotNull() & (F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes)).groupBy("digest", "id").agg(F.count("*").alias("rows"))
    firsts = seen.groupBy("digest").agg(F.min("id").alias("first"), F.sum("rows").alias("all")).where("all > 1")
    again = stored(seen.join(firsts, "digest").where("id <> first OR rows > 1").select(
        F.col("digest").alias("d"), F.col("id").alias("i"), "first", (F.col("id") == F.col("first")).alias("tied")), "warc-revisits")
    joined = keyed.join(again, (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")), "left").select("id", "url", "date", "html", "first", "tied")
    if again.where("tied").isEmpty():
        return joined.drop("tied")
    rank = F.row_number().over(Window.partitionBy("id", "first").orderBy("url"))
    ties = joined.where("tied").withColumn("first", F.when(rank > 1, F.col("first")))
    return joined.where("tied IS NULL OR NOT tied").unionByName(ties).drop("tied")


def _borders(pages: DataFrame, parts: int) -> list[tuple]:
    """Range borders from a sample of about SAMPLES rows a range, drawn by a hash of the row."""
    rows = pages.count()
    if rows == 0 or parts < 2:
        return []
    share = min(1.0, SAMPLES * parts / rows)
    drawn = pages.where(F.pmod(F.xxhash64("id", "url"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("url", "date", "id").collect()
    keys = sorted((url_key(r.url), r.date, r.id is not None, r.id or 0) for r in drawn)
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            date_col: str | None = None) -> DataFrame:
    """Write every row as a WARC record under ``folder`` (a fresh shared one, if None), read the archives back, return their index.

    Columns: urlkey, timestamp, page_id, url, record_type, payload_bytes, payload_digest, refers_to, file, offset, length, ordered by
    (urlkey, timestamp, page_id) over all partitions. The payload is the html in UTF-8, empty for null. Of records with equal
    payloads of at least ``min_bytes`` the one with the smallest id is the response and the others revisit it; of rows that repeat an
    id and payload one is the response. Rows with a null id are responses that nothing refers to; null URLs have an empty key;
    without ``date_col`` (a timestamp) captures carry DEFAULT_DATE. Other columns (any names) are not read. An empty table gives no
    records and an empty index.
    """
    spark = pages.sparkSession
    date = F.lit(DEFAULT_DATE) if date_col is None else F.coalesce(F.date_format(F.col(date_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DEFAULT_DATE))
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), date.alias("date"), F.col(html_col).alias("html"))
    folder = folder or scratch(spark, "warc")
    manifest = stored(with_revisits(src, min_bytes).mapInArrow(_write(folder), _MANIFEST), "warc-manifest")
    parts = shuffle_partitions(spark)
    files = manifest.select("path").repartition(parts, "path")
    runs = stored(files.mapInArrow(_read(folder, _borders(src, parts)), _RUN_TYPE), "warc-runs")
    return runs.repartitionByRange(parts, "part").sortWithinPartitions("part").mapInArrow(_merge, _OUT)
