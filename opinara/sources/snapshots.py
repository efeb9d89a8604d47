"""All tables of a run saved as one: immutable folders, and commits that readers go through."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from opinara.sources.sinks import TABLES, conform

_NAME = re.compile(r"^v(\d{12})\.json$")


class Conflict(Exception):
    """Another writer has committed the version that this one was to be."""


class Store:
    """Tables under ``path``. A run writes its rows into folders that nobody reads yet; then one file,
    ``_commits/v<number>.json``, which names every folder of every table, is moved into place. The
    move must succeed and never replaces a file: so a version is there wholly or not at all, and of
    two writers that aim at one version, one wins. Readers take the newest version, or a given one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs
        where, conf = self._fs.Path(self.path), spark._jsc.hadoopConfiguration()
        self._files = where.getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(self._files.makeQualified(where).toUri(), conf)
        self._files.mkdirs(self._path("_commits"))

    def _path(self, *parts: str):
        return self._fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._files.listStatus(self._path("_commits"))]
        return sorted(int(m[1]) for m in map(_NAME.match, names) if m)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "runs", "tables": {name: folders}} of a version, by default the newest; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "runs": [], "tables": {t: [] for t in TABLES}}
        stream = self._files.open(self._path("_commits", f"v{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        folders = self.manifest(version)["tables"][table]
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.path}/{f}" for f in folders])

    def save(self, tables: dict[str, DataFrame], run: str, clear: bool = False, retries: int = 5) -> int:
        """Adds the rows of all ``tables``, or none; returns the version that holds them.

        ``clear`` drops the former rows of every table, named or not. A ``run`` that was committed
        before is not saved again, so a caller may try as often as it likes. Rows are written
        once; if another writer is faster, adding is tried again on top of its version, but a
        run that clears raises Conflict, for it has not seen what it would drop.
        """
        known = self.manifest()
        if run in known["runs"]:
            return self._holds(run)
        folders = self._write(tables)
        for _ in range(retries + 1):
            try:
                return self._commit(known, folders, run, clear)
            except Conflict:
                if clear:
                    break
                known = self.manifest()
                if run in known["runs"]:
                    return self._holds(run)
        raise Conflict(f"version {known['version'] + 1} was committed by another writer")

    def _holds(self, run: str) -> int:
        return next(v for v in self.versions() if run in self.manifest(v)["runs"])

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Each table in a fresh folder under its own name; a failed write leaves folders that no commit names."""
        tag = uuid.uuid4().hex
        out = {name: f"{name}/{tag}" for name in tables}
        for name, rows in tables.items():
            conform(rows, name).write.mode("errorifexists").parquet(f"{self.path}/{out[name]}")
        return out

    def _commit(self, known: dict, folders: dict[str, str], run: str, clear: bool) -> int:
        version = known["version"] + 1
        tables = {t: ([] if clear else list(known["tables"][t])) + ([folders[t]] if t in folders else []) for t in TABLES}
        raw = json.dumps({"version": version, "runs": [*known["runs"], run], "tables": tables})
        draft = self._path("_commits", f"_draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(raw.encode()))
        stream.close()
        never_replace = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        never_replace[0] = getattr(self._fs.Options.Rename, "NONE")
        try:
            self._context.rename(draft, self._path("_commits", f"v{version:012d}.json"), never_replace)
        except Exception as e:
            self._files.delete(draft, False)
            if version in self.versions():
                raise Conflict(f"version {version} is there already") from e
            raise
        return version

    def expire(self, keep: int = 10) -> int:
        """Deletes commits older than the last ``keep`` and folders that no commit names; returns the number of folders.

        To be run while no writer is at work: what a writer has not committed yet looks unused.
        """
        for v in self.versions()[:-keep]:
            self._files.delete(self._path("_commits", f"v{v:012d}.json"), False)
        used = {f for v in self.versions() for folders in self.manifest(v)["tables"].values() for f in folders}
        gone = 0
        for t in TABLES:
            if self._files.exists(self._path(t)):
                for s in self._files.listStatus(self._path(t)):
                    if f"{t}/{s.getPath().getName()}" not in used:
                        gone += self._files.delete(s.getPath(), True)
        return gone
