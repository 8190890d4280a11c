"""The assimilation cycle as one stateful stream: poll, known and late scenes, outcome and retraining per area.

A feed of scenes is keyed by area. Spark's state store keeps, for each area, the last scene taken, the last poll, and an index of the scenes met in recent
days; older ones lie before the poll window and are late by rule, so the index has a lifetime and no batch reads what was stored before. An area
that a poll brought nothing for is answered by a timer in event time. Outcome rows and accepted scenes leave the stream together; the sink extracts
the accepted ones and appends their rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators import selection

KEYS = ["aoi_id", "scene_id", "transect_index"]
#: Per area: last scene taken and last poll (microseconds since 1970), and the index of scenes with the day of each, an Arrow stream of ``INDEX``.
STATE = "last_scene bigint, last_poll bigint, scenes binary"
INDEX = pa.schema([("name", pa.large_string()), ("day", pa.int64())])
_HELD = pa.schema([("payload", pa.large_string())])
_OPTIONS = pa.ipc.IpcWriteOptions(compression="lz4")
#: Scenes told at one time with several payloads that are compared at once.
CONFLICTS = 50_000
OUTCOME = (
    "kind string, aoi_id bigint, scene_id string, at timestamp, status string, reason string, new_scenes bigint, late_scenes bigint, known_scenes bigint, "
    "last_scene timestamp, payload string"
)
SNAPSHOT = (
    "aoi_id bigint, last_assimilation_at timestamp, last_scene_datetime timestamp, last_run_id string, last_retrained_at timestamp, "
    "active_model_run_id string, timeseries_rows bigint"
)
_DAY = 86_400_000_000


def _time(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None else pd.Timestamp(micros, unit="us")


def packed(index: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, INDEX, options=_OPTIONS) as w:
        w.write_table(index)
    return out.getvalue().to_pybytes()


def unpacked(index: bytes | None) -> pa.Table:
    return INDEX.empty_table() if index is None else pa.ipc.open_stream(pa.py_buffer(bytes(index))).read_all()


class Told:
    """Scenes an area is told of, each at its earliest time and, of equal times, with the smallest payload.

    Names and times are held as columns; payloads lie in a temporary file and are read batch by batch, so memory holds a few numbers per scene.
    """

    def __init__(self, parts: Iterator[pd.DataFrame]):
        self.file, self.polled, self.sizes = tempfile.TemporaryFile(), None, []
        names, ats, marks = [pa.array([], pa.large_string())], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        with pa.ipc.new_stream(self.file, _HELD, options=_OPTIONS) as held:
            for part in parts:
                if part.empty:
                    continue
                self.polled = max(int(part["poll_at"].max()), -(1 << 62) if self.polled is None else self.polled)
                held.write_batch(pa.record_batch([pa.array(part["payload"], pa.large_string(), from_pandas=True)], schema=_HELD))
                names.append(pa.array(part["scene_id"], pa.large_string()))
                ats.append(part["scene_at"].to_numpy(np.int64))
                marks.append(part["mark"].to_numpy(np.int64))
                self.sizes.append(len(part))
        whole = pa.concat_arrays(names)
        del names
        coded = whole.dictionary_encode()
        del whole
        self.name, self.code = coded.dictionary, coded.indices.to_numpy()
        at, mark = np.concatenate(ats), np.concatenate(marks)
        del ats, marks
        self.at = np.full(len(self.name), np.iinfo(np.int64).max)
        np.minimum.at(self.at, self.code, at)
        rows = np.flatnonzero(at == self.at[self.code])
        self.row = np.zeros(len(self.name), np.int64)
        self.row[self.code[rows][::-1]] = rows[::-1]
        self._settle(rows[mark[rows] != mark[self.row[self.code[rows]]]], rows)

    def _settle(self, other: np.ndarray, rows: np.ndarray) -> None:
        """Of payloads that differ at one time the smallest is chosen; ``other`` are rows that differ from their scene's first of ``rows``."""
        several = np.unique(self.code[other])
        for k in range(0, len(several), CONFLICTS):
            wanted = np.zeros(len(self.code), bool)
            wanted[rows[np.isin(self.code[rows], several[k : k + CONFLICTS])]] = True
            least: dict[int, str] = {}
            for at, payloads in self.payloads(wanted):
                for row, payload in zip(at.tolist(), payloads.to_pylist()):
                    code = int(self.code[row])
                    if code not in least or payload < least[code]:
                        least[code], self.row[code] = payload, row

    def payloads(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Numbers and payloads of the rows where ``wanted`` is set, batch by batch."""
        self.file.seek(0)
        start = 0
        for size, batch in zip(self.sizes, pa.ipc.open_stream(self.file)):
            at = np.flatnonzero(wanted[start : start + size])
            if len(at):
                yield at + start, batch.column(0).take(pa.array(at))
            start += size

    def scenes(self, chosen: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
        """Names, times and payloads of the scenes where ``chosen`` is set, batch by batch."""
        wanted = np.zeros(len(self.code), bool)
        wanted[self.row[chosen]] = True
        for at, payloads in self.payloads(wanted):
            code = self.code[at]
            yield self.name.take(pa.array(code)), self.at[code], payloads


def outcomes(scenes: DataFrame, lookback_days: int = 45, poll_days: int = 5, index_days: int = 90, delay: str = "1 day") -> DataFrame:
    """Outcome rows (``kind`` 'status') and accepted scenes (``kind`` 'scene') of a stream of scenes.

    ``scenes``: ``aoi_id, scene_id, datetime, polled_at`` and any further columns, which travel as JSON in ``payload``. Of one poll, scenes from the day
    after the area's last scene (else ``lookback_days`` before the poll) to the day of the poll are taken once; earlier ones are late, those in the index are
    known, later ones wait for another poll. With no day left to ask for the area is ``up_to_date``. An area without a poll for ``poll_days`` of event time gets a
    ``no_new_scenes`` row. Polls that come more than ``delay`` behind the newest one are dropped, and timers wait as long. Rows without an area, scene or time are ignored.
    """
    told = scenes.where("aoi_id is not null and scene_id is not null and datetime is not null and polled_at is not null")
    narrow = told.select(
        F.col("aoi_id").cast("bigint").alias("aoi_id"), F.col("scene_id").cast("string").alias("scene_id"), F.unix_micros(F.col("datetime").cast("timestamp")).alias("scene_at"),
        F.col("polled_at").cast("timestamp").alias("polled_at"), F.unix_micros(F.col("polled_at").cast("timestamp")).alias("poll_at"), F.to_json(F.struct(*scenes.columns)).alias("payload"),
    ).withColumn("mark", F.xxhash64("payload")).withWatermark("polled_at", delay)

    def row(area: int, at: int, new: int, late: int, known: int, reason: str, last: int | None) -> dict:
        return {"kind": "status", "aoi_id": area, "scene_id": None, "at": _time(at), "status": "updated" if reason == "updated" else "no_update", "reason": reason, "new_scenes": new, "late_scenes": late, "known_scenes": known, "last_scene": _time(last), "payload": None}

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.strip().split()[0] for c in OUTCOME.split(",")])
        return out.astype({"at": "datetime64[us]", "last_scene": "datetime64[us]"})

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        area = int(key[0])
        last, polled, kept = state.get if state.exists else (None, None, None)
        if state.hasTimedOut:
            due, now = [], state.getCurrentWatermarkMs() * 1000
            while polled + poll_days * _DAY <= now:
                polled += poll_days * _DAY
                due.append(row(area, polled, 0, 0, 0, "no_new_scenes", last))
            state.update((last, polled, kept))
            state.setTimeoutTimestamp((polled + poll_days * _DAY) // 1000)
            yield frame(due)
            return
        index, told = unpacked(kept), Told(parts)
        polled = told.polled if polled is None else max(polled, told.polled)
        today = polled // _DAY
        start = today - lookback_days if last is None else last // _DAY + 1
        days = told.at // _DAY
        known = pc.is_in(told.name, value_set=index["name"].combine_chunks()).to_numpy(zero_copy_only=False)
        late = ~known & (days < start)
        taken = ~known & ~late & (days <= today) & (start <= today)
        n_taken = int(taken.sum())
        if n_taken:
            last = max(int(told.at[taken].max()), -(1 << 62) if last is None else last)
            index = pa.concat_tables([index, pa.table([told.name.filter(pa.array(taken)), pa.array(days[taken])], schema=INDEX)])
        if last is not None:
            index = index.filter(pc.greater_equal(index["day"], last // _DAY - index_days))
        state.update((last, polled, packed(index)))
        # the watermark may have passed the poll's own timer; the next one must lie ahead of it
        state.setTimeoutTimestamp(max((polled + poll_days * _DAY) // 1000, state.getCurrentWatermarkMs() + 1))
        reason = "up_to_date" if start > today else "updated" if n_taken else "no_new_scenes"
        yield frame([row(area, polled, n_taken, int(late.sum()), int(known.sum()), reason, last)])
        for names, at, payloads in told.scenes(taken):
            yield frame([]).assign(scene_id=names.to_pandas(), at=at.view("datetime64[us]"), payload=payloads.to_pandas(), kind="scene", aoi_id=area)
        told.file.close()
        del told, index, known, late, taken, days
        pa.default_memory_pool().release_unused()

    return narrow.groupBy("aoi_id").applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)


class Ledger:
    """What the stream has stored under ``root``: rows by batch, and after each batch one snapshot with a row per area, written last.

    A batch whose snapshot exists is done. A batch reads the snapshot before it and nothing else, so its cost does not grow with history.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def snapshot(self, batch_id: int) -> DataFrame | None:
        try:
            return self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshots/batch_id={batch_id}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def read(self, name: str) -> DataFrame:
        """Rows of all batches that are done, with ``batch_id``."""
        done = self.spark.read.parquet(f"{self.root}/snapshots").agg(F.max("batch_id")).first()[0]
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch_id") <= done)

    def areas(self) -> DataFrame:
        """The newest snapshot: one row per area."""
        done = self.spark.read.parquet(f"{self.root}/snapshots").agg(F.max("batch_id")).first()[0]
        return self.snapshot(int(done))


def follow(
    scenes: DataFrame, ledger: Ledger, checkpoint: str, extract: Callable[[DataFrame], DataFrame], transects: DataFrame | None = None, min_rows: int = 200,
    interval_days: int = 180, retrain: Callable[[DataFrame], DataFrame] | None = None, **rules: int,
) -> StreamingQuery:
    """Start the cycle over a stream of scenes and run what is available.

    ``extract`` gives observation rows (``KEYS``, ``datetime``, …) of accepted scenes, which have the stream's own columns. Per batch the ledger gets the rows (the last of a repeated key), one
    status row per area that was polled or timed out, and a snapshot. The retraining decision is that of ``twin.retrain_due``; areas that are due are handed to ``retrain``, which
    returns ``aoi_id, model_run_id`` of the ones it trained. ``rules`` are those of ``outcomes``. Batches that come again are skipped.
    """
    schema = scenes.schema

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            batch.count()  # the state of every partition is stored, also of a batch that was done before
            if ledger.snapshot(batch_id) is not None:
                return
            before = ledger.snapshot(batch_id - 1)
            before = spark.createDataFrame([], SNAPSHOT) if before is None else before
            status = batch.where("kind = 'status'")
            # an area may have been due several times: the last one decides
            status = status.groupBy("aoi_id").agg(F.max_by(F.struct("at", "status", "reason", "last_scene"), "at").alias("s"), *(F.sum(c).alias(c) for c in ("new_scenes", "late_scenes", "known_scenes")))
            fresh = batch.where("kind = 'scene'").select(F.from_json("payload", schema).alias("r")).select("r.*")
            rows = extract(fresh)
            ledger.write("series", batch_id, selection.upsert(rows.limit(0), rows, KEYS))
            added = spark.read.parquet(f"{ledger.root}/series/batch_id={batch_id}").groupBy("aoi_id").agg(F.count(F.lit(1)).alias("added"))
            placed = spark.createDataFrame([], "aoi_id bigint") if transects is None else transects.select(F.col("aoi_id").cast("bigint").alias("aoi_id")).distinct()
            both = before.join(status, "aoi_id", "full_outer").join(added, "aoi_id", "left").join(placed.withColumn("placed", F.lit(True)), "aoi_id", "left")
            updated, total = F.coalesce(F.col("s.reason") == "updated", F.lit(False)), F.coalesce("timeseries_rows", F.lit(0)) + F.coalesce("added", F.lit(0))
            recent = F.col("last_retrained_at").isNotNull() & (F.col("s.at") - F.col("last_retrained_at") < F.expr(f"INTERVAL {int(interval_days)} DAYS"))
            decision = F.when(~updated, None).when(total < min_rows, "insufficient_samples").when(recent, "not_due").when(F.col("placed").isNull(), "missing_transects").otherwise("due")
            both = both.withColumn("total", total.cast("bigint")).withColumn("retrain", decision)
            ledger.write("status", batch_id, both.where("s is not null").select(
                "aoi_id", F.col("s.at").alias("at"), F.col("s.status").alias("status"), F.col("s.reason").alias("reason"), "new_scenes", "late_scenes", "known_scenes",
                F.col("total").alias("timeseries_rows"), "retrain",
            ))
            trained = spark.createDataFrame([], "aoi_id bigint, model_run_id string") if retrain is None else retrain(both.where("retrain = 'due'").select("aoi_id", F.col("s.at").alias("at")))
            both = both.join(trained.select("aoi_id", "model_run_id"), "aoi_id", "left")
            touched = F.coalesce(F.col("s.reason") != "up_to_date", F.lit(False))
            ledger.write("snapshots", batch_id, both.select(
                "aoi_id", F.when(touched, F.col("s.at")).otherwise(F.col("last_assimilation_at")).alias("last_assimilation_at"), F.coalesce("s.last_scene", "last_scene_datetime").alias("last_scene_datetime"),
                F.when(updated, F.lit(f"assimilate_{batch_id}")).otherwise(F.col("last_run_id")).alias("last_run_id"),
                F.when(F.col("model_run_id").isNotNull(), F.col("s.at")).otherwise(F.col("last_retrained_at")).alias("last_retrained_at"), F.coalesce("model_run_id", "active_model_run_id").alias("active_model_run_id"),
                F.col("total").alias("timeseries_rows"),
            ))
        finally:
            batch.unpersist()

    return outcomes(scenes, **rules).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
