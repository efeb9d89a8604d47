"""Quoted CSV and JSON arrays of any size, read by as many tasks as a file has byte ranges.

Spark's text source cuts a file into ranges and gives each the chunks (lines, or stretches up
to a closing brace) that begin in it. Whether a range begins inside a quoted field or a JSON
object only what stands before it can say. So a first pass runs each range for both cases,
quoted or not, and tells how it leaves; the driver composes these, one small row a range; the
second pass cuts records with the state known. A record over several ranges leaves one
fragment in each, which are put together by the range where it begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.storage import fresh_path

#: The driver holds one row a range (as it does for any scan); beyond this many the ranges should be larger.
MOST_RANGES = 4_000_000
_BRACKET, _STRING = re.compile(r'["{}\[\]]'), re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_WRAPPED = re.compile(r'\s*\{\s*"reviews"\s*:\s*\[')

#: (chunk, quoted, depth) -> (quoted, depth) behind it.
Scan = Callable[[str, bool, int], tuple[bool, int]]


def scan_csv(line: str, quoted: bool, depth: int) -> tuple[bool, int]:
    """A field is quoted if a quote is its first character; a doubled quote stays inside; behind
    the closing one, and in fields that do not begin with one, quotes mean nothing."""
    if '"' not in line:
        return quoted, int(quoted)
    at = 0
    while True:
        if not quoted:
            if not line.startswith('"', at):
                comma = line.find(",", at)
                if comma < 0:
                    return False, 0
                at = comma + 1
                continue
            quoted, at = True, at + 1
        end = line.find('"', at)
        if end < 0:
            return True, 1
        if line.startswith('"', end + 1):
            at = end + 2
            continue
        comma = line.find(",", end + 1)
        if comma < 0:
            return False, 0
        quoted, at = False, comma + 1


def scan_json(chunk: str, quoted: bool, depth: int) -> tuple[bool, int]:
    """Brackets outside strings; a chunk ends with a closing brace, so no escape is ever cut."""
    at = 0
    while True:
        if quoted:
            m = _STRING.match(chunk, at)
            if not m:
                return True, depth
            quoted, at = False, m.end()
        m = _BRACKET.search(chunk, at)
        if not m:
            return False, depth
        at = m.end()
        if m[0] == '"':
            quoted = True
        else:
            depth += 1 if m[0] in "{[" else -1


@dataclass(frozen=True)
class Kind:
    """How records are cut: what ends a chunk, how its end is told, and the depth between records."""

    end: str
    scan: Scan
    base: int


def chunks(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    rows = spark.read.option("lineSep", end).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """((file, start), chunks) of each range of a task, as a stream."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
    for key, group in groupby(rows, lambda r: r[:2]):
        yield key, (r[2] for r in group)


def passages(rows: DataFrame, kind: Kind) -> DataFrame:
    """One row a range: for entry unquoted (0) and quoted (1), how it is left, and the change of depth at its end and at its lowest."""

    def run(batches):
        for (file, start), values in by_range(batches):
            state = {h: (bool(h), 0, 1 << 30) for h in (0, 1)}
            for v in values:
                v += kind.end
                for h, (quoted, depth, low) in state.items():
                    quoted, depth = kind.scan(v.removesuffix("\n") if kind.end == "\n" else v, quoted, depth)
                    state[h] = (quoted, depth, min(low, depth) if not quoted else low)
            yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], **{f"{n}{h}": [state[h][k]] for h in (0, 1) for k, n in enumerate(("quoted", "depth", "low"))}})

    columns = ", ".join(f"quoted{h} boolean, depth{h} long, low{h} long" for h in (0, 1))
    return rows.mapInArrow(run, f"file string, start long, {columns}")


def entries(told: list, csv: bool, base: int) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(file, start): (quoted, depth, start of the range where the record begun before lies, or -1)."""
    out, file, quoted, depth, opener = {}, None, False, 0, -1
    for r in sorted(told, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, quoted, depth, opener = r["file"], False, 0, -1
        out[file, r["start"]] = (quoted, depth, opener)
        h = int(quoted)
        low, left = r[f"low{h}"], r[f"quoted{h}"]
        after = r[f"depth{h}"] if csv else depth + r[f"depth{h}"]
        closed = low <= 0 if csv else depth + low <= base
        if left or after != base:
            opener = r["start"] if closed or opener < 0 else opener
        else:
            opener = -1
        quoted, depth = left, after
    return out


def records(spark: SparkSession, path: str | list[str], kind: Kind, skip_first: bool) -> DataFrame:
    """(record): every record's text; ``skip_first`` leaves out each file's first one."""
    rows = chunks(spark, path, kind.end)
    csv = kind.end == "\n"
    told = passages(rows, kind).limit(MOST_RANGES + 1).collect()
    if len(told) > MOST_RANGES:
        raise ValueError("raise spark.sql.files.maxPartitionBytes: a file has too many ranges")
    known = spark.sparkContext.broadcast(entries(told, csv, kind.base))

    def run(batches):
        out = {"file": [], "opener": [], "start": [], "text": [], "whole": []}

        def add(file, opener, start, text, whole):
            for name, x in zip(out, (file, opener, start, text, whole)):
                out[name].append(x)

        for (file, start), values in by_range(batches):
            quoted, depth, opener = known.value[file, start]
            held, first = [], skip_first and start == 0
            head = opener >= 0
            for v in values:
                v += kind.end
                quoted, depth = kind.scan(v.removesuffix("\n") if csv else v, quoted, depth)
                held.append(v)
                if not quoted and depth == kind.base:
                    if first:
                        first = False
                    else:
                        add(file, opener if head else -1, start, "".join(held), not head)
                    held, head = [], False
                if len(out["file"]) >= 4096:
                    yield pa.RecordBatch.from_pydict(out, schema=layout)
                    for x in out.values():
                        x.clear()
            if held:
                add(file, opener if head else start, start, "".join(held), False)
        if out["file"]:
            yield pa.RecordBatch.from_pydict(out, schema=layout)

    layout = pa.schema([("file", pa.string()), ("opener", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])
    cut = rows.mapInArrow(run, "file string, opener long, start long, text string, whole boolean")
    # a range has at most one fragment of each end, and a task's order is kept within it
    parts = cut.filter("NOT whole").groupBy("file", "opener").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    joined = parts.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("record"))
    return cut.filter("whole").select(F.col("text").alias("record")).unionByName(joined)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV in UTF-8 with a header (the first file's), all strings, quotes doubled inside quotes, as the plain reader gives it.

    Lines without anything are no rows. A header of more than one range is not expected.
    """
    columns = spark.read.csv(path, header=True, multiLine=True, escape='"').schema
    text = F.regexp_replace(F.regexp_replace("record", r"\r?\n$", ""), "\r\n", "\n")
    rows = records(spark, path, Kind("\n", scan_csv, 0), True).select(text.alias("record")).filter("record <> ''")
    # the parser ends a record at its first line break outside quotes, so none of these may be left
    return rows.select(F.from_csv("record", ", ".join(f"`{c.name}` string" for c in columns), {"escape": '"'}).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a JSON array, of ``{"reviews": [...]}``, or one after another, with the types that the plain reader infers.

    The objects are written one a line to the shared folder, where Spark reads them as JSON
    lines. What follows the array is not read.
    """
    head = "".join(r["value"] + "}" for r in chunks(spark, path, "}").filter("start = 0").limit(1).collect()).lstrip("﻿")
    base = 2 if _WRAPPED.match(head) else int(head.lstrip().startswith("["))
    found = records(spark, path, Kind("}", scan_json, base), False)
    body = F.regexp_replace("record", _WRAPPED.pattern, "") if base == 2 else F.col("record")
    one = F.regexp_extract(body, r"(?s)(\{.*)", 1)
    out = fresh_path(spark, "objects")
    found.select(F.regexp_replace(one, r"[\r\n]+", " ").alias("value")).filter(F.col("value").endswith("}")).write.text(out)
    return spark.read.json(out)
