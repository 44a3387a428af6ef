"""Command-line and terminal-output expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelltrace.functions import patterns as P
from shelltrace.functions import text as X

_ESC = "\x1b"
_CR = "\r"


def redact(text: Column) -> Column:
    """Replace secrets by ``[REDACTED]``.

    Each pattern is preceded by a plain search for what it cannot match
    without, which spares most texts the regex.
    """
    needs = (
        lambda t: F.contains(t, F.lit("=")),
        lambda t: F.contains(t, F.lit("AKIA")),
        lambda t: F.contains(F.lower(t), F.lit("bearer")),
    )

    def apply(pattern: str, may_match: Callable[[Column], Column]):
        return lambda t: F.when(
            may_match(t), F.regexp_replace(t, pattern, P.REDACTED)
        ).otherwise(t)

    # A lambda's argument is evaluated once, however often it is used.
    one = F.array(text)
    for pattern, may_match in zip(P.REDACT, needs):
        one = F.transform(one, apply(pattern, may_match))
    return one[0]


def is_blank(command: Column) -> Column:
    return X.trim_space(command) == ""


def is_trivial(command: Column) -> Column:
    """First word is one of the commands that carry no information."""
    return X.first_field(command).isin(*P.TRIVIAL)


def strip_escapes(text: Column) -> Column:
    """Remove terminal control sequences."""
    return F.when(
        F.contains(text, F.lit(_ESC)), F.regexp_replace(text, P.ANSI, "")
    ).otherwise(text)


def collapse_returns(text: Column) -> Column:
    """Per line, keep what is visible after carriage-return overwrites.

    Drops everything up to the last return that text follows, and the returns
    at the line's end.
    """
    visible = F.regexp_replace(
        text, r"(?dm)^[^\n]*\r(?=[^\r\n])|\r+(?=\n|\z)", ""
    )
    return F.when(F.contains(text, F.lit(_CR)), visible).otherwise(text)


def clean_output(text: Column) -> Column:
    """Control sequences stripped, then overwritten text dropped."""
    stripped = strip_escapes(text)
    # Bound once as a lambda argument so the regex is not evaluated twice.
    return F.transform(F.array(stripped), collapse_returns)[0]


def base_tool(command: Column) -> Column:
    """Base name of the program a command line runs, or ``''``.

    Flags and wrapper programs are passed over; a flag of exactly two bytes
    takes the following word with it.
    """
    first = X.first_field(command)
    direct = X.base_name(first)

    def step(state: Column, word: Column) -> Column:
        is_flag = word.startswith("-")
        takes_value = (
            is_flag & (F.octet_length(word) == 2) & ~word.isin("--", "-=")
        )
        name = X.base_name(word)
        found = ~state["skip"] & ~is_flag & ~name.isin(*P.WRAPPERS)
        return F.when(state["name"] != "", state).otherwise(
            F.struct(
                (~state["skip"] & takes_value).alias("skip"),
                F.when(found, name).otherwise(F.lit("")).alias("name"),
            )
        )

    walked = F.aggregate(
        X.fields(command),
        F.struct(F.lit(False).alias("skip"), F.lit("").alias("name")),
        step,
        lambda state: state["name"],
    )
    return (
        F.when(first == "", F.lit(""))
        .when(~first.startswith("-") & ~direct.isin(*P.WRAPPERS), direct)
        .otherwise(walked)
    )


@dataclass(frozen=True)
class Limits:
    """Byte budgets of outputs, by tool and for all other tools.

    A budget of None leaves the output whole.
    """

    by_tool: Mapping[str, int | None] = field(default_factory=lambda: dict(P.LIMITS))
    default: int | None = P.DEFAULT_LIMIT


NO_LIMITS = Limits({}, None)


def byte_limit(tool: Column, limits: Limits | None = None) -> Column:
    """Byte budget of a tool's output, null for none."""
    limits = limits or Limits()
    default = F.lit(limits.default).cast("int")
    known = {t: n for t, n in limits.by_tool.items() if n is not None}
    if known:
        table = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
        default = F.coalesce(F.try_element_at(table, tool), default)
    unlimited = [t for t, n in limits.by_tool.items() if n is None]
    if unlimited:
        default = F.when(tool.isin(*unlimited), F.lit(None).cast("int")).otherwise(default)
    return default


def truncate_bytes(text: Column, limit: Column | int) -> Column:
    """Cut text over ``limit`` bytes at its last line end, with a notice.

    Without a line end after the first byte the cut is at the limit itself. A
    null limit cuts nothing.
    """
    limit = F.lit(limit)
    head = X.head_bytes(text, limit)
    last_line = F.substring_index(head, "\n", -1)
    # Bytes before the last line end; negative when there is none.
    kept = F.octet_length(head) - F.octet_length(last_line) - 1
    cut = F.when(kept > 0, X.head_bytes(text, kept)).otherwise(head)
    omitted = F.octet_length(text) - F.when(kept > 0, kept).otherwise(
        F.octet_length(head)
    )
    notice = F.concat(
        F.lit("\n[...truncated "), omitted.cast("string"), F.lit(" bytes...]")
    )
    return F.when(limit.isNull() | (F.octet_length(text) <= limit), text).otherwise(
        F.concat(F.make_valid_utf8(cut), notice)
    )


def cap_output(text: Column, max_bytes: int = P.MAX_OUTPUT_BYTES) -> Column:
    """At most the first ``max_bytes`` bytes."""
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(
        F.make_valid_utf8(X.head_bytes(text, max_bytes))
    )
