"""Transcripts that arrive in any order, as a stream.

The rows of a terminal are numbered without gaps from 0. A row that is not the
next one waits in a map state by its number; the next one is read as it comes,
and with it all that had been waiting for it. So delivery in any order, and
repeated delivery, gives what delivery in order gives, and a terminal's rows of
a batch are read chunk by chunk. Waiting rows are stored in blocks of numbers,
so a chunk asks the state store once a block and not several times a row.

Two event-time timers end what would stay open for ever: one gives up the rows
missing in front of those that wait, the other lets a terminal expire that has
had no input. The first is set when the rows are found missing and stays where
it is until they come. A terminal that goes on after it expired begins with an empty
capture and no events counted, whether or not its timer has come yet, so the
result does not depend on how the input is cut into batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import batched
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from shelltrace.sources.transcripts import KEYS, decode_commands
from shelltrace.streaming.ingest import MAX_MARKER_BYTES, Terminal

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_COMMAND = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("terminal_id", T.StringType()),
        T.StructField("command", T.LongType()),
        T.StructField("output", T.BinaryType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("at", T.LongType()),
    ]
)
_OPEN = T.StructType(
    [
        T.StructField("pending", T.BinaryType()),
        T.StructField("capturing", T.BooleanType()),
        T.StructField("output", T.BinaryType()),
        T.StructField("n_markers", T.LongType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("last_seq", T.LongType()),
        T.StructField("last_at", T.LongType()),
        T.StructField("n_waiting", T.LongType()),
        T.StructField("gap_timer", T.LongType()),
        T.StructField("idle_timer", T.LongType()),
    ]
)
_ROW = Row(*_COMMAND.fieldNames())
_WAITING_KEY = T.StructType([T.StructField("place", T.LongType())])
_WAITING = T.StructType(
    [
        T.StructField("seqs", T.ArrayType(T.LongType())),
        T.StructField("payloads", T.ArrayType(T.BinaryType())),
        T.StructField("ats", T.ArrayType(T.LongType())),
    ]
)
_NEW = (b"", False, b"", 0, 0, -1, None, 0, None, None)


#: Numbers of a block of waiting rows.
BLOCK_ROWS = 64
#: A payload of more bytes waits outside its block.
BLOCK_PAYLOAD = 16 << 10
#: Rows of a terminal that are read and sorted together.
CHUNK_ROWS = 4096
#: Waiting rows of a terminal that are in memory at a time.
_ROWS_IN_MEMORY = 8192


class WaitingRows:
    """A map state's methods for rows, ``(payload, at)`` by number, on a map
    state of blocks of rows.

    A block has the key ``-1 - seq // BLOCK_ROWS``. A long payload has its
    number as key; in the block it is None. ``flush`` writes what has changed.
    The state is not asked where ``nothing`` is known to be stored.
    """

    def __init__(self, state: Any, nothing: bool = False):
        self.state, self.nothing = state, nothing
        self.stored: set[int] = set()
        self.blocks: dict[int, dict[int, tuple]] = {}
        self.changed: set[int] = set()
        self.n_rows = 0

    def _block(self, seq: int) -> dict[int, tuple]:
        place = -1 - seq // BLOCK_ROWS
        if place not in self.blocks:
            if self.n_rows > _ROWS_IN_MEMORY:
                self.flush()
            found = None if self.nothing else self.state.getValue((place,))
            if found:
                self.stored.add(place)
            columns = zip(*(found or ((), (), ())), strict=True)
            rows = {n: (payload, at) for n, payload, at in columns}
            self.n_rows += len(rows)
            self.blocks[place] = rows
        return self.blocks[place]

    def containsKey(self, key: tuple) -> bool:
        return key[0] in self._block(key[0])

    def getValue(self, key: tuple) -> tuple | None:
        payload, at = self._block(key[0]).get(key[0], (None, None))
        if at is not None and payload is None:
            payload = self.state.getValue(key)[1][0]
        return None if at is None else (payload, at)

    def updateValue(self, key: tuple, value: tuple) -> None:
        (seq,), (payload, at) = key, value
        rows = self._block(seq)
        self.n_rows += seq not in rows
        if len(payload) > BLOCK_PAYLOAD:
            self.state.updateValue(key, ([seq], [payload], [at]))
            payload = None
        rows[seq] = (payload, at)
        self.changed.add(-1 - seq // BLOCK_ROWS)

    def removeKey(self, key: tuple) -> None:
        payload, _ = self._block(key[0]).pop(key[0])
        if payload is None:
            self.state.removeKey(key)
        self.n_rows -= 1
        self.changed.add(-1 - key[0] // BLOCK_ROWS)

    def keys(self) -> Iterator[tuple]:
        """The numbers of the first block that has rows."""
        self.flush()
        first = max(key[0] for key in self.state.keys() if key[0] < 0)
        yield from ((seq,) for seq in self._block((-1 - first) * BLOCK_ROWS))

    def flush(self) -> None:
        for place in self.changed:
            if rows := self.blocks[place]:
                payloads, ats = zip(*rows.values(), strict=True)
                self.state.updateValue((place,), ([*rows], [*payloads], [*ats]))
                self.nothing = False
            elif place in self.stored:
                self.state.removeKey((place,))
        self.blocks, self.changed, self.stored, self.n_rows = {}, set(), set(), 0


class Reader:
    """One terminal's rows in the order of their numbers.

    ``waiting`` has the methods of a map state. Times are in microseconds.
    """

    def __init__(self, state: tuple, waiting: Any, limits: dict, idle: int | None):
        *terminal, self.last_at, self.n_waiting, self.gap_timer, self.idle_timer = state
        self.terminal = Terminal(tuple(terminal), **limits)
        self.waiting, self.idle = waiting, idle

    def state(self) -> tuple:
        return (
            *self.terminal.state(),
            self.last_at,
            self.n_waiting,
            self.gap_timer,
            self.idle_timer,
        )

    def offer(self, seq: int, payload: bytes, at: int) -> Iterator[tuple]:
        """Commands that end with this row or with those it had been missing to."""
        due = self.terminal.last_seq + 1
        if seq < due:
            return  # delivered again
        if seq > due:
            if not self.waiting.containsKey((seq,)):
                self.waiting.updateValue((seq,), (payload, at))
                self.n_waiting += 1
            return
        yield from self._read(payload, at)
        yield from self._drain()

    def _read(self, payload: bytes, at: int) -> Iterator[tuple]:
        if self.idle is not None and self.last_at is not None and at - self.last_at > self.idle:
            self.expire()
        self.terminal.last_seq += 1
        self.last_at = at if self.last_at is None else max(at, self.last_at)
        for command in self.terminal.read(payload):
            yield *command, at

    def _drain(self) -> Iterator[tuple]:
        while self.n_waiting:
            due = (self.terminal.last_seq + 1,)
            if not self.waiting.containsKey(due):
                return
            payload, at = self.waiting.getValue(due)
            self.waiting.removeKey(due)
            self.n_waiting -= 1
            yield from self._read(bytes(payload), at)

    def expire(self) -> None:
        """Forget what is open and what has been counted, not the place."""
        self.terminal.lose()
        self.terminal.n_events = 0

    def give_up(self) -> Iterator[tuple]:
        """Go on with the first of the rows that wait.

        ``waiting.keys()`` need not have more than the first of them.
        """
        self.terminal.lose()
        self.terminal.last_seq = min(key[0] for key in self.waiting.keys()) - 1
        yield from self._drain()


class Reorder(StatefulProcessor):
    """Per terminal, what is open between batches and which rows wait."""

    def __init__(self, limits: dict, idle_seconds: int | None, gap_seconds: int | None):
        self.limits = limits
        self.idle = None if idle_seconds is None else idle_seconds * 1_000_000
        self.gap = None if gap_seconds is None else gap_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getMapState("waiting", _WAITING_KEY, _WAITING)

    def _reader(self) -> Reader:
        state = self.open.get() or _NEW
        state = tuple(bytes(x) if isinstance(x, bytearray) else x for x in state)
        reader = Reader(state, None, self.limits, self.idle)
        reader.waiting = WaitingRows(self.waiting, nothing=reader.n_waiting == 0)
        return reader

    def _timer(self, old: int | None, at: int | None) -> int | None:
        """Move a timer, in milliseconds, to ``at`` microseconds or none."""
        new = None if at is None else at // 1000 + 1
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        return new

    def _keep(self, reader: Reader, latest: int, moved: bool) -> None:
        waits, at = reader.n_waiting > 0, reader.last_at
        # The timer stays where it is while the same rows are missing.
        if self.gap is not None and (moved or not waits or reader.gap_timer is None):
            gap_at = latest + self.gap if waits else None
            reader.gap_timer = self._timer(reader.gap_timer, gap_at)
        if self.idle is not None:
            idle_at = None if waits or at is None else at + self.idle
            reader.idle_timer = self._timer(reader.idle_timer, idle_at)
        reader.waiting.flush()
        self.open.update(reader.state())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        reader, latest = self._reader(), 0
        before = reader.terminal.last_seq
        for chunk in batched(rows, CHUNK_ROWS):
            if any(row.seq is None for row in chunk):
                raise ValueError("rows of a terminal without seq have no order")
            for row in sorted(chunk, key=lambda r: r.seq):
                latest = max(row.at, latest)
                payload = b"" if row.payload is None else row.payload
                yield from self._commands(key, reader.offer(row.seq, payload, row.at))
        self._keep(reader, latest, reader.terminal.last_seq != before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        reader, due = self._reader(), expiredTimerInfo.getExpiryTimeInMs()
        found = []
        if due == reader.gap_timer:
            reader.gap_timer = None
            if reader.n_waiting:
                found = list(reader.give_up())
            self._keep(reader, due * 1000, True)
        elif due == reader.idle_timer:
            reader.idle_timer = None
            reader.expire()
            self.open.update(reader.state())
        yield from self._commands(key, found)

    @staticmethod
    def _commands(key, found) -> Iterator[Row]:
        for row in found:
            yield _ROW(*key, *row)


def ingest_unordered(
    feed: DataFrame,
    max_output_bytes: int | None = None,
    max_events: int | None = None,
    max_marker_bytes: int = MAX_MARKER_BYTES,
    idle_seconds: int | None = None,
    gap_seconds: int | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Events from a stream of ``(session_id, terminal_id, seq, ts, payload)``.

    ``seq`` counts the rows of a terminal from 0; they may arrive in any order
    and more than once. ``idle_seconds`` without input end a terminal: what it
    has open is dropped and its events are counted anew. Rows missing for
    ``gap_seconds`` after the latest one that waits for them are given up.
    Both are in event time, ``lateness`` behind the latest ``ts``; rows later
    than that are dropped. Without either every row counts, however late.
    """
    limits = {
        "max_output": max_output_bytes,
        "max_events": max_events,
        "max_marker": max_marker_bytes,
    }
    timed = idle_seconds is not None or gap_seconds is not None
    rows = feed.select(
        *KEYS,
        "seq",
        "ts",
        F.unix_micros("ts").alias("at"),
        F.col("payload").cast("binary").alias("payload"),
    )
    if timed:
        rows = rows.withWatermark("ts", lateness)
    commands = rows.groupBy(*KEYS).transformWithState(
        Reorder(limits, idle_seconds, gap_seconds),
        _COMMAND,
        "append",
        "EventTime" if timed else "None",
    )
    return decode_commands(
        commands.withColumn("ts", F.timestamp_micros("at")).drop("at")
    )


def run_unordered(feed: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Append the events of the available input to a Parquet table."""
    conf = feed.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    # A map state needs this store; a query keeps the setting it started with.
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = (
            ingest_unordered(feed, **options)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)
