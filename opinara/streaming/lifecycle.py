"""Lifecycle stages of issues as a stream: windows arrive in any batches and order, stages follow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opinara import schema as S
from opinara.operators.trends import KEYS
from opinara.storage import fresh_path

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
WINDOWS = "product_name string, feature string, window_no int, complaint_rate double"
STAGES = "product_name string, feature string, window_no int, from_stage string, stage string"


#: Stages by number; windows that one entry of the state holds.
NAMES = np.array(["detected", "resolved", "resolving", "persistent", "systemic", "growing"], object)
CHUNK = 4096
#: What a stage needs to know of the windows before: whether there are any, how many are over, the run over at their end and
#: the longest (each as far as it counts), the last rate and stage.
START = np.zeros(1, [("some", "?"), ("over", "i4"), ("run", "i4"), ("longest", "i4"), ("rate", "f8"), ("stage", "i1")])
#: A window in the state; ``was`` and ``stage`` are what was told of it, -1 at first.
WINDOW = np.dtype([("no", "i4"), ("rate", "f8"), ("was", "i1"), ("stage", "i1")])


def next_stages(rates: np.ndarray, base: float, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the stages after each window of a stretch, from its rates in order and what came before it; and what comes before the next."""
    if not len(rates):
        return np.zeros(0, np.int8), before
    c, i = before[0], np.arange(len(rates))
    above = rates > S.SYSTEMIC_FACTOR * base
    over = c["over"] + np.cumsum(above)
    below = np.maximum.accumulate(np.where(above, -1, i))
    run = i - below + np.where(below < 0, c["run"], 0)
    longest = np.maximum(c["longest"], np.maximum.accumulate(run))
    last = np.concatenate([[c["rate"] if c["some"] else rates[0]], rates[:-1]])
    first = (i == 0) & (not c["some"])
    out = np.select([first, rates <= base + S.SIGNIFICANT_POINTS, rates < last, over >= S.PERSISTENT_WINDOWS, longest >= S.SYSTEMIC_RUN, rates > last], [0, 1, 2, 3, 4, 5], 0).astype(np.int8)
    after = START.copy()
    after[0] = (True, min(over[-1], S.PERSISTENT_WINDOWS), min(run[-1], S.SYSTEMIC_RUN), min(longest[-1], S.SYSTEMIC_RUN), rates[-1], out[-1])
    return out, after


def stages(rates: list[float], base: float) -> list[str]:
    """The stage after each window of a series, from its rates in order."""
    return NAMES[next_stages(np.array(rates, float), base, START)[0]].tolist()


class IssueTracker(StatefulProcessor):
    """Per issue: the rates of its windows so far, and the stages that were told.

    A window that comes late, or again with another rate, takes its place in the series; the
    windows behind it whose stage changes by that are told again. So what was told last is
    the same in any batching. The state of an issue grows with its windows, 14 bytes each, in entries of
    ``CHUNK`` window numbers. A batch reads the entries from its first window on; one that it brings no
    window for is gone through only if what comes before it has changed.
    """

    def __init__(self, base: float):
        self.base = base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk int", "before binary, after binary, windows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        parts = [(p["window_no"].to_numpy(np.int32), p["complaint_rate"].to_numpy(float)) for p in rows]
        nos, rates = (np.concatenate(x) for x in zip(*parts))
        # of a window that comes twice the last rate counts
        nos, at = np.unique(nos[::-1], return_index=True)
        rates = rates[::-1][at]
        own = nos // CHUNK
        chunks = sorted({k[0] for k in self.chunks.keys()} | set(own.tolist()))
        start = chunks.index(int(own[0]))
        before = np.frombuffer(self.chunks.getValue((chunks[start - 1],))[1], START.dtype) if start else START
        for chunk in chunks[start:]:
            lo, hi = np.searchsorted(own, [chunk, chunk + 1])
            old = self.chunks.getValue((chunk,)) if self.chunks.containsKey((chunk,)) else None
            if old is not None and lo == hi and bytes(old[0]) == before.tobytes():
                before = np.frombuffer(old[1], START.dtype)
                continue
            have = np.frombuffer(old[2], WINDOW) if old is not None else np.zeros(0, WINDOW)
            add = np.zeros(hi - lo, WINDOW)
            add["no"], add["rate"], add["was"], add["stage"] = nos[lo:hi], rates[lo:hi], -1, -1
            place = np.searchsorted(have["no"], add["no"])
            same = np.zeros(len(add), bool)
            same[place < len(have)] = have["no"][place[place < len(have)]] == add["no"][place < len(have)]
            windows = np.insert(have, place[~same], add[~same])
            windows["rate"][np.searchsorted(windows["no"], add["no"])] = add["rate"]
            stage, after = next_stages(windows["rate"], self.base, before)
            was = np.concatenate([before["stage"], stage[:-1]])
            new = np.flatnonzero((windows["was"] != was) | (windows["stage"] != stage))
            windows["was"], windows["stage"] = was, stage
            self.chunks.updateValue((chunk,), (before.tobytes(), after.tobytes(), windows.tobytes()))
            before = after
            if len(new):
                product, feature = key
                yield pd.DataFrame({"product_name": product, "feature": feature, "window_no": windows["no"][new], "from_stage": NAMES[was[new]], "stage": NAMES[stage[new]]})

    def close(self) -> None:
        pass


def tracked(windows: DataFrame, base: float = S.BASELINE_RATE) -> DataFrame:
    """A stream of (product_name, feature, window_no, complaint_rate) as one of STAGES, of windows whose stage is new or changed.

    Rows without a product, feature, window or rate are left out.
    """
    rows = windows.select("product_name", "feature", "window_no", "complaint_rate").dropna()
    return rows.groupBy(*KEYS).transformWithStateInPandas(IssueTracker(base), outputStructType=STAGES, outputMode="Update", timeMode="None")


def follow(spark: SparkSession, source: str, out: str, base: float = S.BASELINE_RATE, files_per_batch: int = 1000) -> None:
    """Runs the stream over the Parquet files in ``source`` that it has not read yet; stages go to ``out``.

    Each batch writes a folder of its own and overwrites it when it is run again, so a restart
    after a failure tells nothing twice. The checkpoint stands beside ``out``.
    """
    old = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        stream = spark.readStream.schema(WINDOWS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        job = tracked(stream, base).writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").foreachBatch(write).queryName(f"lifecycle_{uuid.uuid4().hex}").trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], old)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last told stage of each window in ``out``."""
    rows = spark.read.schema(STAGES + ", batch long").parquet(out)
    last = Window.partitionBy(*KEYS, "window_no").orderBy(F.desc("batch"))
    return rows.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r", "batch")


def transitions(spark: SparkSession, out: str) -> DataFrame:
    return current(spark, out).filter("from_stage <> stage")


def run_lifecycle(spark: SparkSession, rates: DataFrame, base: float = S.BASELINE_RATE, files: int = 8, files_per_batch: int = 3) -> DataFrame:
    """Transitions of a table of window rates, dealt into files without any order and followed batch by batch."""
    source, out = fresh_path(spark, "windows"), fresh_path(spark, "stages")
    rates.select("product_name", "feature", "window_no", "complaint_rate").repartition(files, F.xxhash64("feature", "window_no")).write.parquet(source)
    follow(spark, source, out, base, files_per_batch)
    return transitions(spark, out)
