"""Per-tool output extractors and their registries.

An extractor maps a column of cleaned output to a column of findings. Custom
extractors are ``Column -> Column`` functions, or Python functions over series
of texts, to which only the outputs of their tool are sent.

The built-in ones pick whole lines with one regex pass over the output, rather
than splitting it and testing line by line.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelltrace.functions import patterns as P
from shelltrace.functions import text as X

Extractor = Callable[[Column], Column]

# White space and blanks inside a line.
_SPACE = "[" + X.WHITESPACE.replace("\n", "") + "]"
_WORD = "[^" + X.WHITESPACE + "]"
_BLANK = r"[\t\f\r ]"
_REST = r"[^\n]*"


def _any(literals: tuple[str, ...]) -> str:
    return "|".join(re.escape(text) for text in literals)


def _lines_like(stdout: Column, pattern: str) -> Column:
    """Whole lines whose beginning matches ``pattern``."""
    return F.regexp_extract_all(
        stdout, F.lit(f"(?dm)^(?:{pattern}){_REST}"), F.lit(0)
    )


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _joined_or(kept: Column, placeholder: str) -> Column:
    return _bind(
        kept,
        lambda ls: F.when(F.size(ls) == 0, F.lit(placeholder)).otherwise(
            X.unlines(ls)
        ),
    )


# A trailing blank is trimmed before a line is tested, so a blank that has to
# follow is one with a word after it.
_BLANK_WITHIN = f"{_BLANK}{_SPACE}*{_WORD}"
_CODES = f"(?:{_any(P.STATUS_CODES)})"
_STATUS = f"{_REST}{P.STATUS_LABEL}{_BLANK}*{_CODES}"

_NMAP_PORT = f"{P.NMAP_PORT}{_BLANK}+{P.NMAP_OPEN}{_BLANK_WITHIN}"
_NMAP = f"{_SPACE}*(?:{_NMAP_PORT}|{_any(P.NMAP_STARTS)})"
_GOBUSTER = f"{_STATUS}|{_SPACE}*{_CODES}{_BLANK_WITHIN}"
_NIKTO = f"{_SPACE}*{re.escape(P.NIKTO_LINE)}"
_LINPEAS = f"{_REST}(?:{P.LINPEAS_HEADER}|(?iu:{P.LINPEAS_FINDING}))"
# Two words or more, the last of them not in brackets.
_KERNEL_THREAD = rf"{_REST}{_SPACE}\[{_WORD}*\]{_SPACE}*$"
_PROCESS = f"(?!{_KERNEL_THREAD}){_SPACE}*{_WORD}+{_SPACE}+{_WORD}"


def nmap(stdout: Column) -> Column:
    """Open ports, hosts, operating systems, script output."""
    return _joined_or(_lines_like(stdout, _NMAP), P.NO_PORTS)


def gobuster(stdout: Column) -> Column:
    """Paths found with an interesting status."""
    return _joined_or(_lines_like(stdout, _GOBUSTER), P.NO_STATUS)


def ffuf(stdout: Column) -> Column:
    """Trimmed result lines with an interesting status."""
    kept = _lines_like(stdout, _STATUS)
    return _joined_or(F.transform(kept, X.trim_space), P.NO_STATUS)


def nikto(stdout: Column) -> Column:
    """Trimmed finding lines."""
    kept = _lines_like(stdout, _NIKTO)
    return _joined_or(F.transform(kept, X.trim_space), P.NO_FINDINGS)


def ps(stdout: Column) -> Column:
    """Header and user-space processes."""
    header = F.substring_index(stdout, "\n", 1)
    rest = F.substring(stdout, F.length(header) + 2, F.length(stdout))
    kept = F.concat(
        F.when(X.trim_space(header) == "", F.array().cast("array<string>")).otherwise(
            F.array(header)
        ),
        _lines_like(rest, _PROCESS),
    )
    return _bind(
        kept,
        lambda ls: F.when(F.size(ls) <= 1, F.lit(P.NO_PROCESSES)).otherwise(
            X.unlines(ls)
        ),
    )


def git(stdout: Column) -> Column:
    """File and hunk headers of a diff; other output unchanged."""
    kept = _lines_like(stdout, _any(P.GIT_LINE))
    return F.when(
        F.contains(stdout, F.lit(P.GIT_DIFF)), _joined_or(kept, P.NO_DIFF)
    ).otherwise(stdout)


def linpeas(stdout: Column) -> Column:
    """Sections with findings: header, findings, blank line."""
    marked = F.transform(
        _lines_like(stdout, _LINPEAS),
        lambda line: F.struct(
            line.rlike(P.LINPEAS_HEADER).alias("header"),
            X.trim_space(line).alias("text"),
        ),
    )

    def from_first_header(rows: Column) -> Column:
        start = F.array_position(F.transform(rows, lambda r: r["header"]), True)
        return F.when(start == 0, F.filter(rows, lambda r: F.lit(False))).otherwise(
            F.slice(rows, start.cast("int"), F.size(rows))
        )

    def with_findings(rows: Column) -> Column:
        def keep(r: Column, i: Column) -> Column:
            following = F.get(rows, i + 1)["header"]
            return ~r["header"] | F.coalesce(~following, F.lit(False))

        return F.filter(rows, keep)

    def render(rows: Column) -> Column:
        text = F.transform(
            rows,
            lambda r, i: F.concat(
                F.when(r["header"] & (i > 0), F.lit("\n")).otherwise(F.lit("")),
                r["text"],
            ),
        )
        return F.when(F.size(rows) == 0, F.lit(P.NO_SECTIONS)).otherwise(
            F.concat(X.unlines(text), F.lit("\n"))
        )

    return _bind(_bind(_bind(marked, from_first_header), with_findings), render)


_extractors: dict[str, Extractor] = {
    "nmap": nmap,
    "gobuster": gobuster,
    "feroxbuster": gobuster,
    "linpeas": linpeas,
    "ps": ps,
    "git": git,
    "ffuf": ffuf,
    "nikto": nikto,
}
_signatures: list[tuple[str, str]] = list(P.SIGNATURES)


def register_extractor(tool: str, extractor: Extractor) -> None:
    """Add or replace the extractor of ``tool``."""
    _extractors[tool] = extractor


class SeriesExtractor:
    """An extractor in Python, from a series of texts to one of findings.

    Texts of other tools are nulls on their way to the Python worker and never
    reach the function.
    """

    def __init__(self, function: Callable[[pd.Series], pd.Series]):
        @F.pandas_udf(StringType())
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                mine = texts.notna()
                found = texts.astype(object)
                if mine.any():
                    found[mine] = function(texts[mine])
                yield found

        self._apply = apply

    def __call__(self, stdout: Column) -> Column:
        return self._apply(stdout)


def register_series_extractor(
    tool: str, function: Callable[[pd.Series], pd.Series]
) -> None:
    """Add or replace the extractor of ``tool`` by a Python function."""
    register_extractor(tool, SeriesExtractor(function))


def unregister_extractor(tool: str) -> None:
    _extractors.pop(tool, None)


def register_signature(pattern: str, tool: str) -> None:
    """Append a content signature that maps output to ``tool``'s extractor."""
    if tool not in _extractors:
        raise KeyError(f"no extractor for {tool!r}")
    _signatures.append((pattern, tool))


def unregister_signature(pattern: str) -> None:
    _signatures[:] = [s for s in _signatures if s[0] != pattern]


def has_extractor(tool: Column) -> Column:
    return tool.isin(*_extractors)


def is_passthrough(tool: Column) -> Column:
    return tool.isin(*P.PASSTHROUGH)


def classify_content(stdout: Column) -> Column:
    """Tool whose signature the start of ``stdout`` carries, else NULL."""
    sample = X.head_bytes(stdout, P.SIGNATURE_SAMPLE_BYTES)
    result = F.lit(None).cast("string")
    for pattern, tool in reversed(_signatures):
        result = F.when(sample.rlike(pattern), F.lit(tool)).otherwise(result)
    return result


def effective_tool(tool: Column, stdout: Column) -> Column:
    """``tool``, or for file viewers the tool whose output is shown."""
    return F.when(
        is_passthrough(tool) & ~has_extractor(tool),
        F.coalesce(classify_content(stdout), tool),
    ).otherwise(tool)


def extract(tool: Column, stdout: Column) -> Column:
    """Apply the extractor registered for ``tool``; others pass through."""
    tools_by_extractor: dict[Extractor, list[str]] = {}
    for name, extractor in _extractors.items():
        tools_by_extractor.setdefault(extractor, []).append(name)
    result = None
    for extractor, names in tools_by_extractor.items():
        chosen = tool.isin(*names)
        # A Python function is applied before the choice, so it gets nulls for
        # all other rows.
        in_python = isinstance(extractor, SeriesExtractor)
        findings = extractor(F.when(chosen, stdout) if in_python else stdout)
        result = F.when(chosen, findings) if result is None else result.when(chosen, findings)
    return stdout if result is None else result.otherwise(stdout)
