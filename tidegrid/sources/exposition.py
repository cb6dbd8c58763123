"""The text format that metric endpoints serve: ``name{label="value"} 1.5 time_ms`` lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NAME
from .lineprotocol import _ARROW, PARSED, BadLine, integer

_NAME = re.compile(r"[^{ \t]*")
_LABEL = re.compile(r'\s*([^="{}]+?)\s*=\s*"((?:[^"\\]|\\.)*)"[, ]*', re.S)
_NUMBERS = {"+Inf": float("inf"), "Inf": float("inf"), "-Inf": float("-inf"), "NaN": float("nan")}


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def number(text: str) -> float:
    if text in _NUMBERS:
        return _NUMBERS[text]
    try:
        return float(text)
    except ValueError:
        raise BadLine("bad number") from None


def parse_line(line: str, now: int, extra: dict[str, str] | None = None) -> tuple[dict[str, str], int, float] | None:
    """One sample, or None for an empty line, a comment or a name without a value."""
    line = line.strip()
    if not line or line[0] == "#":
        return None
    m = _NAME.match(line)
    labels, at = {NAME: m[0]}, m.end()
    if line[at : at + 1] == "{":
        at += 1
        while line[at : at + 1] != "}":
            found = _LABEL.match(line, at)
            if not found:
                raise BadLine("bad label")
            labels[found[1]] = unescaped(found[2])
            at = found.end()
        at += 1
    rest = line[at:].split()
    if not rest:
        return None
    value, t = number(rest[0]), integer(rest[1]) if len(rest) > 1 else now
    return {k: v for k, v in {**(extra or {}), **labels}.items() if v}, t, value


def parse(lines: DataFrame, now: int, extra: dict[str, str] | None = None) -> DataFrame:
    """(seq, labels, t, v, skipped, error) of the column ``value`` of lines; extra labels only where a line lacks them. No shuffle."""
    seq = F.col("seq").cast("long") if "seq" in lines.columns else F.monotonically_increasing_id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for n, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = parse_line(line or "", now, extra)
                except ValueError as e:
                    rows.append((n, None, None, None, 0, f"{e} in line: {line[:200]}"))
                    continue
                if found:
                    rows.append((n, list(found[0].items()), found[1], found[2], 0, None))
            yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    return lines.select(seq.alias("seq"), "value").mapInArrow(run, PARSED)
