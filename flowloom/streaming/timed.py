"""Stateful streams in event time: rows wait for the watermark and are handled in order.

Each key holds the rows that may still be overtaken by earlier ones, and whatever its
operator remembers, in the state store.  A timer per key fires once the watermark has
reached the oldest waiting row; the rows up to the watermark then go through the
operator in time order, so disorder within the watermark's delay changes no result.  A
second timer removes what a key remembers after it has been idle.  State is written by
the store as it changes; a batch that is retried starts from the version before it.

Rows behind the watermark are dropped, so the delay must cover the disorder of the
source.  What lies within the delay of the newest row waits until a later row comes.
Spark's watermark starts at 1970, so rows of that instant count as late.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from flowloom.operators.asof import EVENT, POLLED, sample_age
from flowloom.operators.pairing import ENTER, EXIT, SEND, keep_target_enters
from flowloom.schemas import PACKET, require_columns

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME = "event_time"
# Rows of a key that a task handles at once, and rows of one value in the store.
ROWS_AT_ONCE = 250_000
BLOCK_ROWS = 8_192
PACKET_PROBE = StructType([*PACKET.fields, StructField("ord", LongType())])
COUNTED_PACKET = StructType(
    [*PACKET_PROBE.fields, StructField("neworkin", LongType()), StructField("neworkout", LongType())]
)


def _layout(**fields) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields.items()])


def with_event_time(rows: DataFrame, delay: str) -> DataFrame:
    """Add the event time of ``ts_ns`` in whole microseconds, and the watermark behind it."""
    require_columns(rows, ["ts_ns", "ord"], "a stream in event time")
    return rows.withColumn(TIME, F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark(TIME, delay)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``step`` in time order, once none can come before them.

    ``step`` gets the key and rows sorted by ``ts_ns`` and ``ord``, about ``ROWS_AT_ONCE`` of them at a time; rows of
    one instant always come together.  With ``idle_ms``, ``forget`` is called when a key had no row for longer than that.

    Rows wait in sorted blocks of ``BLOCK_ROWS``, one value of the store each, with an index of the times
    they span; so a row costs no call to the store, and a task holds a bounded number of a key's rows.
    """

    def __init__(self, rows: StructType, output: StructType, idle_ms: int | None = None) -> None:
        self.rows, self.output, self.idle_ms = rows, output, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _layout(block=LongType), _layout(rows=BinaryType))
        self.index = handle.getValueState("index", _layout(blocks=BinaryType))
        self.latest = handle.getValueState("latest", _layout(ms=LongType))
        self.arrow = to_arrow_schema(self.rows)
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Open the states of the operator."""

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        raise NotImplementedError

    def forget(self) -> None:
        """Clear the states of the operator."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, blocks, parts, held = None, None, [], 0
        for part in rows:
            if not len(part):
                continue
            oldest = int(part["ts_ns"].min())
            first = oldest if first is None else min(first, oldest)
            parts.append(pa.Table.from_pandas(part[self.rows.names], self.arrow, preserve_index=False))
            held += len(part)
            if held >= ROWS_AT_ONCE:
                blocks = self._keep(pa.concat_tables(parts), self._blocks() if blocks is None else blocks)
                parts, held = [], 0
        if parts:
            blocks = self._keep(pa.concat_tables(parts), self._blocks() if blocks is None else blocks)
        if first is not None:
            self._note_blocks(blocks)
            self.handle.registerTimer(_due_ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        newest = None
        for now in self._due(watermark * 1_000_000 + 999):
            found = self._in_pieces(key, now)
            newest = int(now["ts_ns"].iloc[-1]) // 1_000_000
            if self.idle_ms is not None:
                self.latest.update((newest,))
            if found is not None and len(found):
                yield found[self.output.names]
        if self.idle_ms is not None:
            if newest is not None:
                self.handle.registerTimer(newest + self.idle_ms + 1)
            if not self.index.exists() and self.latest.exists() and self.latest.get()[0] + self.idle_ms < watermark:
                self.latest.clear()
                self.forget()

    def _blocks(self) -> list[tuple[int, int, int]]:
        """First and last time and number of each block that waits."""
        return pickle.loads(bytes(self.index.get()[0])) if self.index.exists() else []

    def _note_blocks(self, blocks: list[tuple[int, int, int]]) -> None:
        if blocks:
            self.index.update((pickle.dumps(blocks),))
        else:
            self.index.clear()

    def _keep(self, rows: pa.Table, blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Put rows into blocks; the index with those."""
        rows = rows.sort_by([("ts_ns", "ascending"), ("ord", "ascending")])
        number = max((n for _, _, n in blocks), default=-1)
        added = []
        for begin in range(0, rows.num_rows, BLOCK_ROWS):
            block = rows.slice(begin, BLOCK_ROWS).combine_chunks()
            number += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.arrow, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(block)
            self.waiting.updateValue((number,), (sink.getvalue().to_pybytes(),))
            ts = block.column("ts_ns")
            added.append((ts[0].as_py(), ts[-1].as_py(), number))
        return [*blocks, *added]

    def _due(self, upto_ns: int) -> Iterator[pd.DataFrame]:
        """The waiting rows up to an instant, in order; they wait no longer.

        Blocks are read by their first times, and what lies before the first of the next is complete.
        """
        blocks = sorted(self._blocks())
        due = [b for b in blocks if b[0] <= upto_ns]
        if not due:
            return
        later = blocks[len(due) :]
        loaded, read = None, 0
        while read < len(due):
            parts = [] if loaded is None else [loaded]
            held = sum(p.num_rows for p in parts)
            begin = read
            while read < len(due) and (held < ROWS_AT_ONCE or read == begin):
                block = pa.ipc.open_stream(bytes(self.waiting.getValue((due[read][2],))[0])).read_all()
                parts.append(block)
                held += block.num_rows
                read += 1
            bound = min(upto_ns, due[read][0] - 1) if read < len(due) else upto_ns
            loaded = pa.concat_tables(parts)
            complete = pc.less_equal(loaded.column("ts_ns"), bound)
            now = loaded.filter(complete).sort_by([("ts_ns", "ascending"), ("ord", "ascending")])
            loaded = loaded.filter(pc.invert(complete))
            if now.num_rows:
                yield now.to_pandas()
        for _, _, number in due:
            self.waiting.removeKey((number,))
        if loaded.num_rows:
            later = self._keep(loaded, later)
        self._note_blocks(later)
        if later:
            self.handle.registerTimer(_due_ms(min(b[0] for b in later)))

    def _in_pieces(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Rows with longer silence between them are apart, however they fell into batches."""
        if self.idle_ms is None:
            return self.step(key, rows)
        ms = rows["ts_ns"].to_numpy("int64") // 1_000_000
        before = self.latest.get()[0] if self.latest.exists() else int(ms[0])
        breaks = np.flatnonzero(np.diff(ms, prepend=before) > self.idle_ms)
        found = []
        for begin, end in zip([0, *breaks], [*breaks, len(rows)]):
            if begin in breaks:
                self.forget()
            if begin < end:
                found.append(self.step(key, rows.iloc[begin:end].reset_index(drop=True)))
        found = [part for part in found if part is not None and len(part)]
        return pd.concat(found, ignore_index=True) if found else None


def _due_ms(ts_ns: int) -> int:
    """The watermark, in milliseconds, from which on nothing comes at or before an instant."""
    return -(-(ts_ns // 1000) // 1000)


def in_order(rows: DataFrame, keys: Sequence[str], operator: InOrder) -> DataFrame:
    """The operator over a stream that has the columns it holds, its keys and an event time.

    Sets the session's state store to RocksDB, which timers and lists need.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    names = [n for n in operator.rows.names if n not in keys]
    return (
        rows.select(*keys, TIME, *names)
        .groupBy(*keys)
        .transformWithStateInPandas(operator, operator.output, outputMode="Append", timeMode="EventTime")
    )


# JON-03: bytes of an address strictly before each of its packets ---------------------------


class Counters(InOrder):
    """Running bytes of an address; a row with a ``probe`` asks what came strictly before it."""

    def __init__(self) -> None:
        super().__init__(
            _layout(ts_ns=LongType, ord=LongType, bytes_in=LongType, bytes_out=LongType, probe=StringType),
            _layout(probe=StringType, neworkin=LongType, neworkout=LongType),
        )

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _layout(bytes_in=LongType, bytes_out=LongType))

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ts = rows["ts_ns"].to_numpy("int64")
        asked = rows["probe"].notna().to_numpy()
        before = np.searchsorted(ts, ts[asked], side="left")
        found = {"probe": rows["probe"][asked].tolist()}
        after = []
        for name, column, total in zip(("neworkin", "neworkout"), ("bytes_in", "bytes_out"), self.totals.get() if self.totals.exists() else (0, 0)):
            running = total + np.concatenate([[0], np.cumsum(rows[column].to_numpy("int64"))])
            found[name] = running[before]
            after.append(int(running[-1]))
        self.totals.update(tuple(after))
        return pd.DataFrame(found)


def counter_probes(packets: DataFrame, delay: str, lanes: int = 1) -> DataFrame:
    """JON-03 as a stream, in parts: for every packet, as JSON in ``probe``, the bytes of its source before it.

    The moves of an address are dealt to ``lanes`` keys, so that one address does not make one task; a packet asks
    all of them, and their answers - which come in the same batch - have to be added up.
    """
    timed = with_event_time(packets, delay)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    src, dst, size = F.col("source_ip"), F.col("destination_ip"), F.col("packet_size")
    lane = F.pmod(F.xxhash64("ts_ns", "ord"), F.lit(lanes)).cast("int")

    def row(ip: Column, at: Column, came: Column, left: Column, probe: Column) -> Column:
        return F.struct(ip.alias("ip"), at.alias("lane"), came.alias("bytes_in"), left.alias("bytes_out"), probe.alias("probe"))

    asked = F.to_json(F.struct(*PACKET_PROBE.names))
    moves = F.array(row(src, lane, zero, size, none), row(dst, lane, size, zero, none))
    asks = F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda at: row(src, at.cast("int"), zero, zero, asked))
    rows = timed.select(TIME, "ts_ns", "ord", F.inline(F.concat(moves, asks)))
    return in_order(rows, ["ip", "lane"], Counters())


def counted_packets(packets: DataFrame, folder: str, delay: str, lanes: int = 1) -> StreamingQuery:
    """Packets with ``neworkin`` and ``neworkout`` of their source, to ``<folder>/rows``, one sub-folder per batch.

    Packets that do not differ in any column are as many rows as there are of them.
    """

    def write(batch: DataFrame, number: int) -> None:
        copies = (F.count(F.lit(1)) / lanes).cast("int")
        summed = batch.groupBy("probe").agg(
            copies.alias("n"), F.sum("neworkin").alias("i"), F.sum("neworkout").alias("o")
        )
        packet = F.from_json("probe", PACKET_PROBE)
        rows = summed.select(
            F.explode(F.array_repeat(packet, F.col("n"))).alias("p"), F.expr("i div n").alias("neworkin"), F.expr("o div n").alias("neworkout")
        )
        rows.select("p.*", "neworkin", "neworkout").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    return (
        counter_probes(packets, delay, lanes)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


# AGG-02: running bytes of an address -------------------------------------------------------


class RunningBytes(InOrder):
    """Bytes in and out of an address up to and including each instant at which it moves any."""

    def __init__(self) -> None:
        super().__init__(
            _layout(ts_ns=LongType, ord=LongType, bytes_in=LongType, bytes_out=LongType),
            _layout(ip=StringType, ts_ns=LongType, in_cum=LongType, out_cum=LongType),
        )

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _layout(bytes_in=LongType, bytes_out=LongType))

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        before = self.totals.get() if self.totals.exists() else (0, 0)
        steps = rows.groupby("ts_ns", sort=True)[["bytes_in", "bytes_out"]].sum().cumsum()
        found = pd.DataFrame({"ip": key[0], "ts_ns": steps.index, "in_cum": steps["bytes_in"].to_numpy() + before[0]})
        found["out_cum"] = steps["bytes_out"].to_numpy() + before[1]
        self.totals.update((int(found["in_cum"].iloc[-1]), int(found["out_cum"].iloc[-1])))
        return found


def running_bytes_stream(packets: DataFrame, delay: str) -> DataFrame:
    """AGG-02 as a stream: the totals of every address at each instant, in any order within ``delay``.

    An address is one key; a task holds what it moved within the delay.
    """
    timed = with_event_time(packets, delay)
    size, zero = F.col("packet_size"), F.lit(0).cast("long")
    ends = F.array(
        F.struct(F.col("source_ip").alias("ip"), zero.alias("bytes_in"), size.alias("bytes_out")),
        F.struct(F.col("destination_ip").alias("ip"), size.alias("bytes_in"), zero.alias("bytes_out")),
    )
    return in_order(timed.select(TIME, "ts_ns", "ord", F.inline(ends)), ["ip"], RunningBytes())


# STR-06: socket writes of each thread -----------------------------------------------------


class Pairs(InOrder):
    """Socket writes of one thread; what is remembered is whether a call is open and has sent."""

    def __init__(self, idle_ms: int) -> None:
        super().__init__(
            _layout(ts_ns=LongType, ord=LongType, kind=StringType, ret=LongType),
            _layout(id=LongType, ts_ns=LongType, size=LongType, ord=LongType),
            idle_ms,
        )

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.phase = handle.getValueState("phase", _layout(phase=StringType))

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kinds = pd.Series([self.phase.get()[0] if self.phase.exists() else EXIT, *rows["kind"]])
        # an entry opens a call, an exit closes it; a send only matters inside one
        turn = kinds.where(kinds.isin([ENTER, EXIT, "sent"])).ffill()
        open_before, sent_before = turn.shift(1).isin([ENTER, "sent"]), kinds.shift(1).isin([SEND, "sent"])
        written = ((kinds == EXIT) & open_before & sent_before).iloc[1:].to_numpy()
        if turn.iloc[-1] in (ENTER, "sent"):
            self.phase.update(("sent" if kinds.iloc[-1] in (SEND, "sent") else ENTER,))
        else:
            self.phase.clear()
        done = rows[written]
        return pd.DataFrame({"id": int(key[0]), "ts_ns": done["ts_ns"], "size": done["ret"], "ord": done["ord"]})

    def forget(self) -> None:
        self.phase.clear()


def write_pairs(log: DataFrame, delay: str, idle_ms: int, pid: int | None = None) -> DataFrame:
    """STR-06: socket writes of a probe stream in any order within ``delay``.

    A thread that has had no probe for ``idle_ms`` leaves no state, whether or not its call has ended.
    """
    timed = with_event_time(log, delay)
    rows = keep_target_enters(timed.where(F.col("kind").isin(ENTER, SEND, EXIT)), pid)
    return in_order(rows.withColumn("ret", F.col("ret").cast("long")), ["id"], Pairs(idle_ms))


# STR-03: the latest samples at each flow start --------------------------------------------


class LastValues(InOrder):
    """The newest sample of every series of a pid; a row with a ``flow`` asks for them."""

    def __init__(self, series: Sequence[tuple[str, str]], idle_ms: int) -> None:
        self.series = list(series)
        output = [StructField("pid", StringType()), StructField("flow", StringType()), StructField("start_ts_ns", LongType())]
        for i in range(len(self.series)):
            output += [StructField(f"v{i}", DoubleType()), StructField(f"t{i}", LongType())]
        super().__init__(
            _layout(ts_ns=LongType, ord=LongType, kind=StringType, feature=StringType, value=DoubleType, flow=StringType),
            StructType(output),
            idle_ms,
        )

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", _layout(place=LongType), _layout(ts_ns=LongType, value=DoubleType))

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ts = rows["ts_ns"].to_numpy("int64")
        asked = np.flatnonzero(rows["flow"].notna())
        found = pd.DataFrame({"pid": key[0], "flow": rows["flow"].iloc[asked].tolist(), "start_ts_ns": ts[asked]})
        kinds, names = rows["kind"].to_numpy(object), rows["feature"].to_numpy(object)
        known = rows["value"].to_numpy("float64")
        for i, (kind, feature) in enumerate(self.series):
            mine = np.flatnonzero((kinds == kind) & (names == feature))
            times, values = ts[mine], known[mine]
            if self.newest.containsKey((i,)):
                held = self.newest.getValue((i,))
                times, values = np.append(held[0], times), np.append(np.nan if held[1] is None else held[1], values)
            place = np.searchsorted(times, ts[asked], side="right") - 1
            none = place < 0
            if len(times):
                at = np.maximum(place, 0)
                found[f"v{i}"] = pd.arrays.FloatingArray(values[at], none | np.isnan(values[at]))
                found[f"t{i}"] = pd.arrays.IntegerArray(times[at].astype("int64"), none)
            else:
                found[f"v{i}"] = pd.array([None] * len(asked), dtype="Float64")
                found[f"t{i}"] = pd.array([None] * len(asked), dtype="Int64")
            if len(mine):
                self.newest.updateValue((i,), (int(times[-1]), float(values[-1])))
        return found

    def forget(self) -> None:
        self.newest.clear()


def last_values(
    rows: DataFrame,
    polled: Sequence[str],
    events: Sequence[str],
    pids: Sequence[str],
    shared_to: Sequence[str],
    delay: str,
    idle_ms: int,
) -> DataFrame:
    """STR-03: every flow once per pid with its latest samples, in any order within ``delay``.

    ``rows`` has ``ts_ns``, ``ord``, and either a flow as JSON in ``flow`` or a sample as ``pid``, ``kind``,
    ``feature``, ``value``.  Flows go to all ``pids``; samples without a pid, of series that are
    system-wide, go to ``shared_to``.  A pid keeps one sample per series, and none once
    it has been idle for ``idle_ms``.
    """
    series = [(POLLED, f) for f in polled if f not in events] + [(EVENT, e) for e in events]
    listed = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    timed = with_event_time(rows, delay)
    to = F.when(F.col("flow").isNotNull(), listed(pids)).when(F.col("pid").isNull(), listed(shared_to)).otherwise(F.array("pid"))
    kept = F.col("flow").isNotNull() | F.struct("kind", "feature").isin(*[F.struct(F.lit(k), F.lit(f)) for k, f in series])
    placed = timed.where(kept).withColumn("pid", F.explode(to))
    found = in_order(placed, ["pid"], LastValues(series, idle_ms))
    columns = []
    for i, (kind, name) in enumerate(series):
        columns.append(F.round(f"v{i}", 6).alias(name))
        if kind == EVENT:
            columns.append(sample_age(F.col("start_ts_ns"), F.col(f"t{i}")).alias(f"tt_{name}"))
    return found.select("pid", "flow", *columns)
