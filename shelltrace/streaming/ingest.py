"""Transcripts to events as a stream, with state per terminal.

The state is what a terminal has open between two batches: bytes that may be
the beginning of a marker, and the output captured so far. Input per batch is
bounded by the source's trigger options.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelltrace import schema as S
from shelltrace.functions import patterns as P
from shelltrace.sources.transcripts import KEYS, decode_commands

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENTS = S.with_engine_columns(S.EVENT)

_COMMAND = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("terminal_id", T.StringType()),
        T.StructField("command", T.LongType()),
        T.StructField("output", T.BinaryType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
_STATE = T.StructType(
    [
        T.StructField("pending", T.BinaryType()),
        T.StructField("capturing", T.BooleanType()),
        T.StructField("output", T.BinaryType()),
        T.StructField("n_markers", T.LongType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("last_seq", T.LongType()),
    ]
)

#: Bytes of an unfinished marker beyond which ingest stops with an error.
MAX_MARKER_BYTES = 64 << 20

_START, _END = P.MARKER_START.encode(), P.MARKER_END.encode()
_MARKER = re.compile(re.escape(_START) + rb"([^\x07]*)" + _END)


def _open_at(text: bytes) -> int:
    """Where an unfinished marker begins in ``text``, else its length."""
    at = text.find(_START)
    if at >= 0:
        return at
    at = text.rfind(b"\x1b")
    return at if at >= 0 and _START.startswith(text[at:]) else len(text)


class Terminal:
    """What is open in one terminal."""

    def __init__(
        self,
        state: tuple,
        max_output: int | None,
        max_events: int | None,
        max_marker: int = MAX_MARKER_BYTES,
    ):
        pending, self.capturing, output, self.n_markers, self.n_events, self.last_seq = state
        self.pending, self.output = bytearray(pending), bytearray(output)
        self.max_output, self.max_events, self.max_marker = max_output, max_events, max_marker

    def state(self) -> tuple:
        return (
            bytes(self.pending),
            self.capturing,
            bytes(self.output),
            self.n_markers,
            self.n_events,
            self.last_seq,
        )

    def _capture(self, text: bytes) -> None:
        if self.capturing:
            room = None if self.max_output is None else self.max_output - len(self.output)
            self.output += text[:room]

    def lose(self) -> None:
        """Drop what is open: bytes are missing, or no more will come."""
        self.pending.clear()
        self.output.clear()
        self.capturing = False

    def follow(self, seq: int) -> None:
        """Take note of the next row's place; rows out of order are an error."""
        if self.last_seq is not None and seq <= self.last_seq:
            raise ValueError(f"row {seq} of a terminal arrived after row {self.last_seq}")
        self.last_seq = seq

    def read(self, payload: bytes) -> Iterator[tuple[int, bytes, bytes]]:
        """``(command, output, body)`` of the commands that end in ``payload``."""
        if self.pending.startswith(_START) and _END not in payload:
            # Nothing but an end can follow, so nothing is searched again.
            self.pending += payload
            self._check_marker()
            return
        data, at = bytes(self.pending) + payload, 0
        for marker in _MARKER.finditer(data):
            self._capture(data[at : marker.start()])
            at, body = marker.end(), marker.group(1)
            ends = body.startswith(b"E;") and len(body) > 2
            if body != b"S" and not ends:
                continue
            if ends:
                self.n_events += 1
                if self.max_events is None or self.n_events <= self.max_events:
                    yield self.n_markers, bytes(self.output), body
            self.n_markers += 1
            self.capturing = not ends
            self.output.clear()
        rest = data[at:]
        keep = _open_at(rest)
        self._capture(rest[:keep])
        self.pending = bytearray(rest[keep:])
        self._check_marker()

    def _check_marker(self) -> None:
        if len(self.pending) > self.max_marker:
            raise ValueError(f"a marker is longer than {self.max_marker} bytes")


def ingest_stream(
    feed: DataFrame,
    max_output_bytes: int | None = None,
    max_events: int | None = None,
    idle_seconds: int | None = None,
    max_marker_bytes: int = MAX_MARKER_BYTES,
) -> DataFrame:
    """Events from a stream of ``(session_id, terminal_id, seq, ts, payload)``.

    The rows of a terminal arrive in ``seq`` order from batch to batch; a row
    that is late, repeated or without ``seq`` stops the stream with an error,
    as does an unfinished marker of more than ``max_marker_bytes``.
    ``max_output_bytes`` limits the output of a command, ``max_events`` the
    events per terminal; neither is set unless asked for. A terminal without input
    for ``idle_seconds`` is forgotten, with anything it has left open.
    """

    def advance(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start = state.get if state.exists else (b"", False, b"", 0, 0, None)
        terminal = Terminal(start, max_output_bytes, max_events, max_marker_bytes)
        rows = []
        for frame in frames:
            if frame["seq"].isna().any():
                raise ValueError("rows of a terminal without seq have no order")
            rows += zip(frame["seq"].tolist(), frame["payload"], frame["ts"])
        rows.sort(key=lambda row: row[0])
        found = []
        for seq, payload, ts in rows:
            terminal.follow(int(seq))
            found += [
                (*key, *command, ts)
                for command in terminal.read(b"" if payload is None else bytes(payload))
            ]
        state.update(terminal.state())
        if idle_seconds is not None:
            state.setTimeoutDuration(idle_seconds * 1000)
        if found:
            yield pd.DataFrame(found, columns=_COMMAND.fieldNames())

    timeout = (
        GroupStateTimeout.NoTimeout
        if idle_seconds is None
        else GroupStateTimeout.ProcessingTimeTimeout
    )
    commands = (
        feed.select(*KEYS, "seq", "ts", F.col("payload").cast("binary").alias("payload"))
        .groupBy(*KEYS)
        .applyInPandasWithState(advance, _COMMAND, _STATE, "append", timeout)
    )
    return decode_commands(commands)


def run_ingest(feed: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Append the events of the available input to a Parquet table."""
    query = (
        ingest_stream(feed, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
