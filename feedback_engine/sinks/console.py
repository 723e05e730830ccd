"""Ranked reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def report(df: DataFrame, title: str, rows: int = 50, width: int = 48) -> str:
    """The first rows of a ranked result in columns of a fixed width."""
    head = df.limit(rows).collect()
    cell = lambda x: (f"{x:,.1f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else "" if x is None else str(x))[:width]
    lines = [[c for c in df.columns], *[[cell(x) for x in r] for r in head]]
    sizes = [max(len(line[i]) for line in lines) for i in range(len(df.columns))]
    kinds = dict(df.dtypes)
    numeric = [kinds[c] in ("int", "bigint", "double") for c in df.columns]
    put = lambda line: "  ".join(x.rjust(n) if right else x.ljust(n) for x, n, right in zip(line, sizes, numeric, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), *map(put, lines)]) + "\n"
