"""WARC archives: an index first, then coalesced byte-range reads of the selected records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm._common import map_arrow, table
from opinara.operators.skew import lookup_by_key
from opinara.storage import fresh_path, stored

#: A new archive begins when one has this many bytes; ranges are read up to RANGE_BYTES at once, across gaps up to
#: GAP_BYTES; a reading task gets about TASK_BYTES of records.
ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES, TASK_BYTES = 256 << 20, 4 << 20, 64 << 10, 16 << 20
#: Stands for a page_id that is null.
NO_PAGE = "none"
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has the response's headers and digest, but no payload."""
    page = NO_PAGE if page is None else page
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(x for x in url if x not in "\r\n"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record: headers, page_id, payload (empty for a revisit) and the Content-Length its HTTP head states."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    stated = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]
    name = lambda k: fields[k].removeprefix("<urn:page:").removesuffix(">") if k in fields else NO_PAGE
    page = lambda k: None if name(k) == NO_PAGE else int(name(k))
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": page("WARC-Refers-To"), "payload": payload, "bytes": int(stated)}


def filesystem(uri: str):
    """The file system of a URI and the path in it: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, hash, payload_bytes) per row, the hash as SHA-1 in hex; the html never leaves the scan."""
    return pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("hash"), F.octet_length("html").cast("long").alias("payload_bytes"))


def first_pages(digests: DataFrame, min_bytes: int) -> DataFrame:
    """(hash, first, copies) of payloads of at least min_bytes that more than one row has; first is null where none has a page_id."""
    rows = digests.filter(F.col("payload_bytes") >= min_bytes)
    return rows.groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row into archives under ``folder``; returns the index, itself stored as a table.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the smallest
    page_id is the response and the others revisit it. Of repeated rows with that smallest
    page_id each is a response. A null html is an empty payload, a null url an empty one. A
    null page_id stays null and stands after all others: such a row revisits the page with its
    payload, and is a response where only such rows have it. An empty table makes no archive. Each attempt of a task writes files of its own, and the index
    names those of the attempts that ended, so lost executors and repeated tasks do no
    harm. Each html is hashed once to find its first page, and the hashes are stored and
    grouped without it; one that many pages share is looked up in a broadcast of at most
    1000 keys.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digests = stored(with_digests(pages), "digests")
    found = lookup_by_key(digests.select("page_id", "hash"), first_pages(digests, min_revisit_bytes), ["hash"], "copies", "inner")
    refers = found.filter("first IS NOT NULL AND NOT first <=> page_id").select(F.col("page_id").alias("p"), F.col("hash").alias("h"), "first").distinct()
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1(F.encode("html", "UTF-8")) == F.col("h"))
    rows = pages.join(refers, same, "left").select("page_id", "url", "html", "first")
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def run(batches):
        fs, path = filesystem(folder)
        name, out, at = None, None, 0
        for b in batches:
            rows = []
            for page, url, html, first in zip(*(b.column(k).to_pylist() for k in range(4))):
                payload = html.encode()
                digest = digest_of(payload)
                member = record(page, url, payload, digest, first)
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(member)
                rows.append((page, url, digest, len(payload), "response" if first is None else "revisit", first, name, at, len(member)))
                at += len(member)
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield dict(zip(names, map(list, zip(*rows)) if rows else [[] for _ in names]))
        if out is not None:
            out.close()

    return stored(map_arrow(rows, run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(page_id, url, record_type, digest, refers_to, payload, payload_bytes) of the records that ``index`` selects.

    Records of one file and one stretch of ``range_bytes`` are gathered (a stretch bounds
    the group), sorted by offset, and read with one request per run without a gap over
    ``gap_bytes``. The stretches are dealt to as many tasks as the selected records have
    ``task_bytes``, a number that adaptive execution keeps although index rows are small.
    A response's digest and length are computed from its payload; a revisit states those
    of the payload it refers to. An empty index gives no rows, an index row that is
    repeated gives its record once.
    """
    entry = F.struct("offset", "length")
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    at = index.select("file", F.floor(F.col("offset") / range_bytes).alias("stretch"), entry.alias("at"))
    stretches = at.repartition(tasks, "file", "stretch").groupBy("file", "stretch").agg(F.sort_array(F.collect_set("at")).alias("records"))

    def runs(records):
        run = [records[0]]
        for r in records[1:]:
            if r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > gap_bytes:
                yield run
                run = []
            run.append(r)
        yield run

    def run(batches):
        fs, path = filesystem(folder)
        for b in batches:
            for file, records in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                with fs.open_input_file(f"{path}/{file}") as f:
                    for part in runs(records):
                        start = part[0]["offset"]
                        f.seek(start)
                        raw = f.read(part[-1]["offset"] + part[-1]["length"] - start)
                        got = [parse(raw[r["offset"] - start : r["offset"] - start + r["length"]]) for r in part]
                        yield {
                            "page_id": [x["page_id"] for x in got], "url": [x["url"] for x in got], "record_type": [x["type"] for x in got],
                            "digest": [digest_of(x["payload"]) if x["type"] == "response" else x["digest"] for x in got],
                            "refers_to": [x["refers_to"] for x in got], "payload": [x["payload"] for x in got],
                            "payload_bytes": [len(x["payload"]) if x["type"] == "response" else x["bytes"] for x in got],
                        }

    return map_arrow(stretches, run, "page_id long, url string, record_type string, digest string, refers_to long, payload binary, payload_bytes long")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    back = read_records(index, folder)
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""
