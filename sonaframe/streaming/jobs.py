"""Structured Streaming jobs.

Each job reads files incrementally, keeps its progress in a checkpoint
folder (restart skips finished input, as the reference skips finished
outputs), and writes its result with ``foreachBatch`` from the executors.
Folders default to the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import map_language
from ..session import ensure_checkpoint_dir
from ..sources.labels import parse_label_lines


def as_instant(c) -> F.Column:
    """Event time as a TIMESTAMP instant, independent of the session time zone.

    The tables store wall-clock ``TIMESTAMP_NTZ`` values meant as UTC; a plain
    cast would read them in the session zone.  Epoch micros of the wall clock
    rebuild the instant exactly."""
    col = F.col(c) if isinstance(c, str) else c
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              col.cast("timestamp_ntz"))
    return F.timestamp_micros(micros)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def _run(writer, trigger_once: bool = True):
    q = (writer.trigger(availableNow=True) if trigger_once else writer).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


#: Event time of the row that ends a finite input; it moves the watermark past every event.
END_OF_INPUT = "2250-01-01 00:00:00"
#: Rows that start or fall here belong to that row and are not written.
_END_US = 8_835_955_200_000_000


def _until_end(spark: SparkSession, plan: Callable[[DataFrame], DataFrame], start: Callable[[DataFrame], object],
               source: Callable[[], DataFrame], schema: T.StructType, ts_col: str, end_dir: str, finite: bool) -> None:
    """Run a stateful plan over a source, and for a finite one again over a single row at ``END_OF_INPUT``.

    Both runs share one checkpoint, so the source is read once; the second
    run reads only the end row, whose event time lets the watermark pass all
    open state, which is then written and dropped as in the stream.  A rerun
    after a failure goes on where it stopped.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(end_dir)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def once() -> None:
        ends = spark.readStream.schema(schema).parquet(end_dir)
        _run(start(plan(source().unionByName(ends))))

    once()
    if finite:
        kind = schema[ts_col].dataType
        row = spark.range(1).select(*[(F.lit(END_OF_INPUT).cast(kind) if f.name == ts_col else F.lit(None).cast(f.dataType)).alias(f.name)
                                      for f in schema.fields])
        row.write.mode("append").parquet(end_dir)
        once()


def _write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One partition a batch, overwritten when the batch is tried again."""
    (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def _batch_sink(path: str):
    return lambda batch, batch_id: _write_batch(batch, batch_id, path)


def latest_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of an update-mode output the last row of each key."""
    rest = [c for c in df.columns if c not in keys and c != "batch_id"]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


# X1 -------------------------------------------------------------------------------

def stream_ingest_labels(spark: SparkSession, input_dir: str, output_dir: str,
                         checkpoint: str | None = None, mapping: Mapping[str, str] | None = None,
                         gate: Callable[[DataFrame], DataFrame] | None = None, run: bool = True):
    """Label-list files → accepted and rejected parquet tables.

    Each micro-batch is parsed (S1) and language-mapped (F8); ``gate`` may
    set further reject reasons (F6).  A batch overwrites its own partition
    ``batch_id`` of ``output_dir/accepted`` and ``output_dir/rejected``, so a
    batch that is tried again leaves no row twice.  ``run``: process what is
    there now and stop.
    """
    ckpt = checkpoint or os.path.join(output_dir, "_checkpoint")
    lines = spark.readStream.text(input_dir).select(F.col("value").alias("line"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        parsed = map_language(parse_label_lines(batch, "line"), "lang", "lang_code", mapping)
        if gate is not None:
            parsed = gate(parsed)
        parsed = parsed.persist()  # two tables from one pass over the batch
        try:
            _write_batch(parsed.where(F.col("reject_reason").isNull()), batch_id, os.path.join(output_dir, "accepted"))
            _write_batch(parsed.where(F.col("reject_reason").isNotNull()), batch_id, os.path.join(output_dir, "rejected"))
        finally:
            parsed.unpersist()

    writer = lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    return _run(writer) if run else writer


# X2 -------------------------------------------------------------------------------

def gap_segments_stream(events: DataFrame, gap: str, key: str = "user_id", ts_col: str = "ts",
                        watermark: str = "1 hour") -> DataFrame:
    """X2 (plan): sessions of one key closed by an event gap longer than ``gap``."""
    e = events.withColumn("_ts", as_instant(ts_col)).withWatermark("_ts", watermark)
    s = e.groupBy(F.col(key), F.session_window("_ts", gap).alias("sw")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select(key, F.unix_micros(F.col("sw.start")).alias("start_us"),
                    F.unix_micros(F.col("sw.end")).alias("end_us"), "n_events")


def stream_gap_segments(spark: SparkSession, source_dir: str, output_dir: str, gap: str = "30 minutes",
                        glob: str = "events*.parquet", schema: T.StructType | None = None,
                        finite: bool = True, watermark: str = "1 hour", files_per_batch: int | None = None) -> str:
    """Run the session-window job over the event files; returns the output path.

    A session is written once the watermark passes its end, and its state is
    then dropped; an event later than the watermark is dropped, too.
    ``finite`` (a replay of files): the input's end closes the sessions that
    are still open (``_until_end``), from state and with the stream's own
    rules; the event files are read once.  (Events exactly ``gap`` apart are
    joined or not as Spark's session window does.)
    """
    sch = schema or spark.read.parquet(os.path.join(source_dir, glob)).schema
    out = os.path.join(output_dir, "segments")

    def source() -> DataFrame:
        reader = spark.readStream.schema(sch).option("pathGlobFilter", glob)
        return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(source_dir)

    def start(segments: DataFrame):
        return (segments.where(F.col("start_us") < _END_US).writeStream.outputMode("append").foreachBatch(_batch_sink(out))
                .option("checkpointLocation", os.path.join(output_dir, "_ckpt")))

    _until_end(spark, lambda events: gap_segments_stream(events, gap, watermark=watermark), start, source, sch, "ts",
               os.path.join(output_dir, "end_of_input"), finite)
    return out


def gap_segments_batch(events: DataFrame, gap_seconds: int, key: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """X2 batch twin: a new segment starts when the gap to the previous event
    of the key is at least ``gap``; segment end = last event + gap (as a
    session window).  Window per key ordered by time."""
    from pyspark.sql import Window
    us = F.unix_micros(as_instant(ts_col))
    w = Window.partitionBy(key).orderBy(us)
    e = events.withColumn("_us", us).withColumn("_prev", F.lag("_us").over(w))
    e = e.withColumn("_new", F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= gap_seconds * 1_000_000), 1).otherwise(0))
    e = e.withColumn("_seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(key, "_seg").agg(F.min("_us").alias("start_us"),
                                      (F.max("_us") + F.lit(gap_seconds * 1_000_000)).alias("end_us"),
                                      F.count(F.lit(1)).alias("n_events")).drop("_seg")


# X3 -------------------------------------------------------------------------------

TURN_OUT = "conv_id long, turn long, text string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TurnsUntilExit(StatefulProcessor):
    """Per conversation: turns are buffered until the watermark passes their time, then let through in order up to ``word``.

    State: the buffered turns, and whether the word was said.  A timer at the
    earliest buffered turn lets out what is due; one at the last turn's time
    plus ``expire_ms`` drops the state of a conversation that has gone quiet.
    """

    def __init__(self, word: str, expire_ms: int):
        self.word, self.expire_ms = word.lower(), expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, turn long, text string")
        self.status = handle.getValueState("status", "exited boolean, last long")

    def _status(self) -> tuple[bool, int]:
        got = self.status.get() if self.status.exists() else None
        return (bool(got[0]), int(got[1])) if got is not None else (False, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if frames and not pd.isna(key[0]):  # the row that ends the input leaves no state
            new = pd.concat(frames)
            exited, last = self._status()
            last = max(last, int(new["at"].max()))
            if not exited:
                self.pending.appendList([(int(a), None if pd.isna(t) else int(t), None if pd.isna(x) else x)
                                         for a, t, x in zip(new["at"], new["turn"], new["text"])])
                self.handle.registerTimer(int(new["at"].min()) + 1)
            self.status.update((exited, last))
            self.handle.registerTimer(last + self.expire_ms + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        exited, last = self._status()
        held = sorted((tuple(r) for r in self.pending.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0)) if self.pending.exists() else []
        due, later, out = [r for r in held if r[0] < now], [r for r in held if r[0] >= now], []
        for _, turn, text in due:
            exited = exited or (text is not None and text.lower() == self.word)
            if exited:
                break
            if text:
                out.append((key[0], turn, text))
        if exited or not later:
            self.pending.clear()
            later = []
        elif due:
            self.pending.put(later)
            self.handle.registerTimer(later[0][0] + 1)
        if not later and last + self.expire_ms < now:
            self.status.clear()
        else:
            self.status.update((exited, last))
        yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=kind) for i, (c, kind) in enumerate(
            (("conv_id", "int64"), ("turn", "Int64"), ("text", object)))})

    def close(self) -> None:
        pass


def turns_until_exit_stream(turns: DataFrame, word: str = "exit", ts_col: str = "ts", watermark: str = "1 hour",
                            expire: str = "1 day") -> DataFrame:
    """X3 (plan): per conversation, turns before the first ``exit``.

    Turns may arrive in any order over batches; ``ts_col`` is a turn's event
    time, ``watermark`` bounds how late one may be (a later one is dropped,
    as in every stream), and turns go out in order of time once the watermark
    has passed them.  A conversation is forgotten ``expire`` after its last
    turn.
    """
    timed = turns.withColumn("_ts", as_instant(ts_col)).withWatermark("_ts", watermark)
    rows = timed.select("conv_id", "turn", "text", "_ts", F.unix_millis("_ts").alias("at"))
    ms = int(turns.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {expire})").first()[0]) // 1000
    return rows.groupBy("conv_id").transformWithStateInPandas(TurnsUntilExit(word, ms), TURN_OUT, "append", "eventTime")


def stream_turns_until_exit(spark: SparkSession, source_dir: str, output_dir: str,
                            glob: str = "conversations*.parquet", prepare=None, word: str = "exit", ts_col: str = "ts",
                            watermark: str = "1 hour", expire: str = "1 day", finite: bool = True,
                            files_per_batch: int | None = None) -> str:
    """Run the stateful turn filter over conversation files; returns the output path.

    ``prepare`` makes the turns (conv_id, turn, text and the event time
    ``ts_col``) of what was read.  ``finite``: the input's end lets out all
    buffered turns and empties the state (``_until_end``).
    """
    sch = spark.read.parquet(os.path.join(source_dir, glob)).schema
    prepared = (prepare or (lambda d: d))(spark.createDataFrame([], sch)).select("conv_id", "turn", "text", ts_col).schema
    out = os.path.join(output_dir, "turns")

    def source() -> DataFrame:
        reader = spark.readStream.schema(sch).option("pathGlobFilter", glob)
        turns = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(source_dir)
        return (turns if prepare is None else prepare(turns)).select("conv_id", "turn", "text", ts_col)

    def plan(turns: DataFrame) -> DataFrame:
        return turns_until_exit_stream(turns.where(F.col("conv_id").isNotNull() | (as_instant(ts_col) >= F.lit(END_OF_INPUT).cast("timestamp"))),
                                       word, ts_col, watermark, expire)

    def start(kept: DataFrame):
        return (kept.where("conv_id is not null").writeStream.outputMode("append").foreachBatch(_batch_sink(out))
                .option("checkpointLocation", os.path.join(output_dir, "_ckpt")))

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, _ROCKSDB)  # the state store that timers need; a query keeps the setting it was started with
    try:
        _until_end(spark, plan, start, source, prepared, ts_col, os.path.join(output_dir, "end_of_input"), finite)
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return out


# X4 -------------------------------------------------------------------------------

def reject_counts_stream(gated: DataFrame, window: str = "1 hour", ts_col: str = "ts",
                         reason_col: str = "reject_reason", watermark: str = "1 hour") -> DataFrame:
    """X4 (plan): running counts per time window and reject reason."""
    e = gated.withColumn("_ts", as_instant(ts_col)).withWatermark("_ts", watermark)
    g = e.groupBy(F.window("_ts", window).alias("w"), F.coalesce(F.col(reason_col), F.lit("kept")).alias("reason"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_micros(F.col("w.start")).alias("window_start_us"), "reason", "n")


def stream_reject_counts(spark: SparkSession, source_dir: str, output_dir: str, gate,
                         glob: str = "events*.parquet", window: str = "1 hour") -> str:
    """``gate`` adds ``reject_reason`` to the event stream.

    Each batch writes the counts that it changed (``latest_rows`` gives the
    current ones); windows that the watermark has passed leave the state.
    """
    sch = spark.read.parquet(os.path.join(source_dir, glob)).schema
    events = spark.readStream.schema(sch).option("pathGlobFilter", glob).parquet(source_dir)
    out = os.path.join(output_dir, "reject_counts")
    writer = (reject_counts_stream(gate(events), window).writeStream.outputMode("update")
              .foreachBatch(_batch_sink(out)).option("checkpointLocation", os.path.join(output_dir, "_ckpt")))
    _run(writer)
    return out
