"""Small helpers that write the DuckDB oracle text (plain strings, no engine of our own)."""

from __future__ import annotations

from collections.abc import Sequence


def r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def union_per_column(cols: Sequence[str], template: str, src: str) -> str:
    """``template`` is formatted with c (column), i (position); one SELECT per column."""
    return "\nUNION ALL\n".join(template.format(c=c, i=i, src=src) for i, c in enumerate(cols))


def lit_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def exact_mean(c: str, digits: int = 6) -> str:
    """Mean rounded half-up at ``digits`` from an exact decimal sum, in integer arithmetic."""
    s10 = f"CAST(sum(CAST({c} AS DECIMAL(38,10))) * 10000000000 AS HUGEINT)"
    n = f"count({c})"
    scale = 10 ** (10 - digits)
    q = f"sign({s10}) * ((2 * abs({s10}) + {n} * {scale}) // (2 * {n} * {scale}))"
    return f"CASE WHEN {n} > 0 THEN CAST({q} AS DOUBLE) / {10 ** digits} END"


def r_sig(expr: str, digits: int = 10) -> str:
    """Round to significant digits, as ``base.round_sig`` does."""
    x = f"CAST({expr} AS DOUBLE)"
    e = f"(floor(log10(abs({x}))) - {digits - 1})"
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} WHEN {e} >= 0 THEN round({x} / pow(10.0, {e})) * pow(10.0, {e}) "
            f"ELSE round({x} * pow(10.0, -{e})) / pow(10.0, -{e}) END")
