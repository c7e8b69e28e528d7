"""Reports of result frames as text, Markdown, CSV or JSON. A section shows ``most`` rows and says how many more there are; for
whole results use the sinks, which write from the executors."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)


def render(sections: dict[str, DataFrame], fmt: str = "markdown", most: int = 50) -> str:
    """One report of named frames. Formats: human, markdown, csv, json. A longer section ends in a row that tells what is left out."""
    tables = {}
    for k, df in sections.items():
        rows = [list(r) for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            rows = [*rows[:most], [f"... {df.count() - most} more rows", *[""] * (len(df.columns) - 1)]]
        tables[k] = (df.columns, rows)
    if fmt == "json":
        return json.dumps({k: [dict(zip(c, r)) for r in rows] for k, (c, rows) in tables.items()}, default=str, indent=2)
    if fmt == "csv":
        out = io.StringIO()
        w = csv.writer(out, quoting=csv.QUOTE_ALL)
        for k, (c, rows) in tables.items():
            w.writerow([k, *c])
            w.writerows([[k, *map(_cell, r)] for r in rows])
        return out.getvalue()
    if fmt == "markdown":
        parts = [f"## {k}\n\n| {' | '.join(c)} |\n|{'-|' * len(c)}\n" + "\n".join(f"| {' | '.join(map(_cell, r))} |" for r in rows) for k, (c, rows) in tables.items()]
        return "\n\n".join(parts) + "\n"
    if fmt == "human":
        lines = []
        for k, (c, rows) in tables.items():
            text = [c, *[[_cell(v) for v in r] for r in rows]]
            width = [max(len(x[i]) for x in text) for i in range(len(c))]
            lines += [k.upper(), *["  ".join(v.ljust(n) for v, n in zip(x, width)).rstrip() for x in text], ""]
        return "\n".join(lines)
    raise ValueError(f"unknown format {fmt}")
