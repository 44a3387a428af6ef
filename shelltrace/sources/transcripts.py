"""Events from raw terminal transcripts.

A transcript is the byte stream of a terminal, cut into rows at arbitrary
places. Shell hooks put markers into the stream: ``S`` when a command starts,
``E;exit;duration;cwd;command`` when it ends. Bytes between become the output.

Two narrow sets of columns, in stream order, decide everything that crosses
rows: where a marker cut in two is put together, and which capture a row's
text belongs to. While terminals are bounded they are worked out in windows
over the rows themselves, with one shuffle in all. A terminal beyond that is
worked out on narrow tables in slices; its bytes are only ever grouped by the
row or by the command they end in, so no task reads a whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace.functions import patterns as P
from shelltrace.functions import text as X
from shelltrace.operators.joins import join_by
from shelltrace.operators.ordered import (
    Before,
    LogOrder,
    choose_order,
    suffix_before,
)
from shelltrace.session import write_through

KEYS = ("session_id", "terminal_id")

# Terminals up to this many reads, and of so many bytes, stay in one window. In
# slices no window holds a payload, whatever size it is.
MAX_WINDOW_ROWS = 50_000
MAX_WINDOW_BYTES = 256 << 20
# Terminals of fewer rows are taken as small without being measured.
MEASURED_ROWS = 64

# Bytes are handled as Latin-1 text, one character per byte.
_BYTES = "ISO-8859-1"
_START, _END = P.MARKER_START, P.MARKER_END
_PARTIAL = len(_START) - 1
_CUT_START = r"\x1b(?:\](?:7(?:7(?:7(?:0)?)?)?)?)?\z"

# Marks around a marker body; not Latin-1, so never part of the stream.
_OPEN, _CLOSE = "ā", "Ă"
_MARKER = r"\x1b\]7770;(?:(S|E;[^\x07]+)|[^\x07]*)\x07"
_BODY = f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"


def _as_text(latin: Column) -> Column:
    return F.make_valid_utf8(F.encode(latin, _BYTES).cast("string"))


def _stream(transcripts: DataFrame) -> DataFrame:
    payload = F.col("payload").cast("binary")
    return transcripts.select(
        *KEYS, "seq", "ts", F.decode(payload, _BYTES).alias("bytes")
    ).where(F.length("bytes") > 0)


def _cut_start(before: Column) -> Column:
    """The beginning of a marker start that ``before`` ends in."""
    return F.regexp_extract(before, _CUT_START, 0)


def _completes(before: Column, first: Column) -> Column:
    """Whether ``first`` completes the marker start that ``before`` ends in."""
    lead = _cut_start(before)
    return (lead != "") & F.concat(lead, first).startswith(_START)


def _cuts(stream: DataFrame, order: LogOrder) -> DataFrame:
    """What crosses each row's borders: ``(keys, seq, lead, lag_length,
    in_marker, closes, closed_by)``.

    ``lead`` is a cut marker start taken from the rows before, ``lag_length``
    the length of one left to the rows after. ``in_marker`` tells that the row
    begins inside a marker, and ``closed_by`` is the next row with an end.
    Without slices the rows keep their bytes.
    """
    wide = [] if order.sliced else ["ts", "bytes"]
    after_end = F.substring_index("bytes", _END, -1)
    rows = stream.select(
        *KEYS,
        "seq",
        F.left("bytes", F.lit(_PARTIAL)).alias("head"),
        F.right("bytes", F.lit(_PARTIAL)).alias("tail"),
        F.contains("bytes", F.lit(_END)).alias("closes"),
        F.contains(after_end, F.lit(_START)).alias("opens"),
        *wide,
    )
    rows, order = order.gather(rows)
    rows = rows.withColumn(
        "_before", suffix_before(F.col("tail"), order.rows(), _PARTIAL)
    )
    opens = F.col("opens") | (
        ~F.col("closes") & _completes(F.col("_before"), F.col("head"))
    )
    # After the last end of a row the stream is outside any marker.
    state = F.when(opens, F.lit(1)).when(F.col("closes"), F.lit(0))
    closed = F.when(F.col("closes"), F.col("seq"))
    rows = rows.withColumn("_state", state)
    state_before = F.last("_state", ignorenulls=True).over(order.before())
    closed_by = F.last(closed, ignorenulls=True).over(order.after())
    before = F.col("_before")
    if order.sliced:
        # What a slice knows by itself is completed by what is carried into it.
        place = F.col("seq")
        short = F.length("_before") < _PARTIAL
        rows = order.carry_over(
            rows.withColumns({"_own_state": state_before, "_own_closed_by": closed_by}),
            _suffix=Before(
                F.max_by(F.right(F.concat("_before", "tail"), F.lit(_PARTIAL)), place),
                "suffix",
                _PARTIAL,
            ),
            # The slice's first bytes complete the marker start cut before it.
            _completed=Before(
                F.max_by(F.concat("_before", "head"), F.when(short, place)),
                "own",
                given=lambda first: _completes(F.col("_suffix"), first),
            ),
            # A state of its own is that of the row completed, or of a later one.
            _last_state=Before(
                F.max_by("_state", F.when(F.col("_state").isNotNull(), place)),
                "last",
                given=lambda last: F.coalesce(last, F.when(F.col("_completed"), 1)),
            ),
            _closed_by=Before(F.min(closed), "next"),
        )
        missing = len(_START) - F.length(_cut_start(F.col("_suffix")))
        completed = F.col("_completed") & (F.length("_before") >= missing)
        state_before = F.coalesce(
            "_own_state", F.when(completed, F.lit(1)), "_last_state"
        )
        closed_by = F.coalesce("_own_closed_by", "_closed_by")
        before = F.right(F.concat("_suffix", "_before"), F.lit(_PARTIAL))
    return rows.select(
        *KEYS,
        "seq",
        _cut_start(before).alias("lead"),
        F.length(_cut_start(F.concat(before, "tail"))).alias("lag_length"),
        (F.coalesce(state_before, F.lit(0)) == 1).alias("in_marker"),
        "closes",
        closed_by.alias("closed_by"),
        *wide,
    )


def _whole_markers(stream: DataFrame, order: LogOrder) -> DataFrame:
    """The stream with every marker in one row: the row that holds its end."""
    rows = _cuts(stream, order)
    if order.sliced:
        rows = join_by(stream, rows, (*KEYS, "seq"))
    shifted = F.concat("lead", "bytes")
    rows = rows.withColumn(
        "bytes",
        F.left(shifted, F.length(shifted) - F.col("lag_length")),
    )
    after_end = F.substring_index("bytes", _END, -1)
    opened_at = F.instr(after_end, _START)
    open_length = (
        F.when(F.col("in_marker") & ~F.col("closes"), F.length("bytes"))
        .when(opened_at > 0, F.length(after_end) - opened_at + 1)
        .otherwise(F.lit(0))
    )
    own_length = F.length("bytes") - open_length
    pieces = F.array(
        F.struct(
            F.col("seq").alias("to"), F.left("bytes", own_length).alias("piece")
        ),
        F.struct(
            F.col("closed_by").alias("to"),
            F.right("bytes", open_length).alias("piece"),
        ),
    )
    # An open marker that never ends is dropped with its bytes. A row that others
    # move bytes to keeps its marker end.
    return (
        rows.select(*KEYS, "seq", "ts", F.inline(pieces))
        .where("to is not null and piece != ''")
        .groupBy(*KEYS, F.col("to").alias("row"))
        .agg(
            F.expr("listagg(piece, '') within group (order by seq)").alias("bytes"),
            F.max(F.when(F.col("to") == F.col("seq"), F.col("ts"))).alias("ts"),
        )
        .withColumnRenamed("row", "seq")
    )


def _segments(rows: DataFrame) -> DataFrame:
    """Texts between start and end markers, and the markers' bodies."""
    marked = F.regexp_replace("bytes", _MARKER, f"{_OPEN}$1{_CLOSE}")
    marked = F.replace(marked, F.lit(_OPEN + _CLOSE), F.lit(""))
    return rows.withColumn("bytes", marked).select(
        *KEYS,
        "seq",
        "ts",
        F.split("bytes", _BODY).alias("texts"),
        F.regexp_extract_all("bytes", F.lit(_BODY), F.lit(1)).alias("bodies"),
    )


def _captures(segments: DataFrame, order: LogOrder) -> DataFrame:
    """The capture open at each row's start: ``(keys, seq, n_before,
    capturing, captured)``, with the bytes captured so far.

    Without slices the rows keep their texts.
    """
    wide = [] if order.sliced else ["ts", "texts", "bodies"]
    rows = segments.select(
        *KEYS,
        "seq",
        F.size("bodies").cast("long").alias("n"),
        (F.try_element_at("bodies", F.lit(-1)) == "S").alias("starts"),
        F.length(F.element_at("texts", -1)).cast("long").alias("open_length"),
        *wide,
    )
    rows, order = order.gather(rows)
    earlier = order.before()

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    rows = rows.withColumns(
        {"_own_n": total("n"), "_own_length": total("open_length")}
    )
    # Stream length at which the capture open after a row began.
    began = F.when(F.col("n") > 0, F.col("_own_length"))
    rows = rows.withColumns(
        {
            "_own_began": F.max(began).over(earlier),
            "_own_starts": F.last("starts", ignorenulls=True).over(earlier),
        }
    )
    n, length = F.col("_own_n"), F.col("_own_length")
    began_before, capturing = F.col("_own_began"), F.col("_own_starts")
    if order.sliced:
        # Lengths count from the slice's start until its own is known.
        rows = order.carry_over(
            rows,
            _n=Before(F.sum("n"), "sum"),
            _length=Before(F.sum("open_length"), "sum"),
            _starts=Before(
                F.max_by("starts", F.when(F.col("n") > 0, F.col("seq"))), "last"
            ),
            _began=Before(
                F.max(began), "last", given=lambda at: at + F.col("_length")
            ),
        )
        n, length = n + F.col("_n"), length + F.col("_length")
        began_before = F.coalesce(began_before + F.col("_length"), "_began")
        capturing = F.coalesce(capturing, "_starts")
    return rows.select(
        *KEYS,
        "seq",
        n.alias("n_before"),
        F.coalesce(capturing, F.lit(False)).alias("capturing"),
        (length - F.coalesce(began_before, F.lit(0))).alias("captured"),
        *wide,
    )


def _choose_order(transcripts: DataFrame) -> LogOrder:
    """One window per terminal while each is bounded in rows and in bytes.

    Rows are counted on the keys alone. Payloads are measured only where the
    counts leave the answer open, and their lengths are added up as they are read.
    """
    order = choose_order(transcripts, KEYS, max_window_rows=MAX_WINDOW_ROWS)
    if order.sliced:
        return order
    some = choose_order(transcripts, KEYS, max_window_rows=MEASURED_ROWS)
    if not some.sliced:
        return order
    size = F.sum(F.octet_length("payload").cast("long")).alias("size")
    large = transcripts.groupBy(*KEYS).agg(size).where(F.col("size") > MAX_WINDOW_BYTES)
    return order if large.isEmpty() else some


def read_transcripts(
    transcripts: DataFrame,
    max_output_bytes: int | None = None,
    order: LogOrder | None = None,
) -> DataFrame:
    """Events recorded in ``(session_id, terminal_id, seq, ts, payload)``.

    ``seq`` of the result numbers the markers of a terminal; an event's time
    is that of the row in which its end marker ends. ``max_output_bytes`` limits
    the output of a command; it is not set unless asked for.
    """
    order = order or _choose_order(transcripts)
    stream = _stream(transcripts)
    segments = _segments(_whole_markers(stream, order))
    if order.sliced:
        segments = write_through(segments, "transcript")
    rows = _captures(segments, order)
    if order.sliced:
        rows = join_by(segments, rows, (*KEYS, "seq"))
    body = F.get("bodies", F.col("i"))
    opened = F.when(F.col("i") == 0, F.col("capturing")).otherwise(
        F.get("bodies", F.col("i") - 1) == "S"
    )
    shown = F.col("piece")
    if max_output_bytes is not None:
        # At most max_output_bytes bytes and one body reach a command's group.
        room = F.greatest(
            F.lit(max_output_bytes)
            - F.when(F.col("i") == 0, F.col("captured")).otherwise(F.lit(0)),
            F.lit(0),
        )
        shown = F.left("piece", room.cast("int"))
    pieces = (
        rows.select(
            *KEYS,
            "seq",
            "ts",
            "bodies",
            "n_before",
            "capturing",
            "captured",
            F.posexplode("texts").alias("i", "piece"),
        )
        .select(
            *KEYS,
            "seq",
            (F.col("n_before") + F.col("i")).alias("command"),
            F.when(opened, shown).otherwise(F.lit("")).alias("piece"),
            body.alias("body"),
            F.when(body.isNotNull(), F.col("ts")).alias("ended"),
        )
        .where("piece != '' or body is not null")
    )
    commands = pieces.groupBy(*KEYS, "command").agg(
        F.expr("listagg(piece, '') within group (order by seq)").alias("output"),
        F.max("body").alias("body"),
        F.max("ended").alias("ts"),
    )
    return _events(commands.where(F.col("body").startswith("E;")))


def decode_commands(commands: DataFrame) -> DataFrame:
    """Events of commands whose ``output`` and ``body`` are bytes."""
    return _events(
        commands.withColumns(
            {c: F.decode(F.col(c), _BYTES) for c in ("output", "body")}
        )
    )


def _events(commands: DataFrame) -> DataFrame:
    parts = F.split(F.substring("body", F.lit(3), F.length("body")), ";", 4)
    fraction = r"\.?0+\z"
    stamp = F.concat(
        F.regexp_replace(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), fraction, ""
        ),
        F.lit("Z"),
    )
    return (
        commands.withColumn("_p", parts)
        .where(F.size("_p") == 4)
        .withColumn("stdin", X.decode_base64(F.get("_p", F.lit(3))))
        .where("stdin is not null")
        .select(
            stamp.alias("timestamp"),
            *KEYS,
            _as_text(F.get("_p", F.lit(2))).alias("cwd"),
            F.make_valid_utf8("stdin").alias("stdin"),
            _as_text(F.col("output")).alias("stdout"),
            F.lit("").alias("stderr"),
            X.parse_int(F.get("_p", F.lit(0))).alias("exit_code"),
            X.parse_int(F.get("_p", F.lit(1))).alias("duration_ms"),
            F.col("command").cast("long").alias("seq"),
            "ts",
        )
    )


def encode_transcripts(events: DataFrame) -> DataFrame:
    """The byte stream a terminal with shell hooks shows for each event."""
    command = F.base64(F.col("stdin").cast("binary"))
    body = F.concat_ws(
        ";",
        F.col("exit_code").cast("string"),
        F.col("duration_ms").cast("string"),
        F.col("cwd"),
        F.translate(command, "\r\n", ""),
    )
    payload = F.concat(
        F.lit(f"{_START}S{_END}"),
        F.col("stdout"),
        F.lit(f"{_START}E;"),
        body,
        F.lit(_END),
    )
    return events.select(
        "session_id", "terminal_id", "seq", "ts", payload.cast("binary").alias("payload")
    )
