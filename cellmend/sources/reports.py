"""Small result tables as Markdown, HTML, JSON and SVG, and what a run may tell of its configuration."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame

# fixed values: parts of names whose values are never shown
SECRET = ["api_key", "apikey", "authorization", "password", "secret", "token_value", "credential"]


def redacted(config: object) -> object:
    """A configuration without the values of secret names, at any depth."""
    if isinstance(config, Mapping):
        return {k: "<redacted>" if any(s in str(k).lower() for s in SECRET) else redacted(v) for k, v in config.items()}
    return [redacted(x) for x in config] if isinstance(config, list | tuple) else config


def read_env(path: str) -> dict[str, str]:
    """NAME=value lines of a file: comments and blank lines aside, `export` allowed, outer quotes taken off."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8-sig").splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.lstrip().startswith("#"):
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            out[name.strip()] = value
    return out


def _shown(v: object) -> str:
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def _rows(df: DataFrame) -> Iterable[list[str]]:
    """Row by row, so that a table is never held whole."""
    return ([_shown(v) for v in r] for r in df.toLocalIterator())


def markdown(df: DataFrame) -> str:
    cell = lambda s: s.replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in _rows(df))]) + "\n"


def html_table(df: DataFrame, title: str = "") -> str:
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in values) + "</tr>"
    return f"<table><caption>{html.escape(title)}</caption>\n" + "\n".join([row("th", df.columns), *(row("td", r) for r in _rows(df))]) + "\n</table>\n"


def json_rows(df: DataFrame) -> str:
    """One object per line, names sorted, numbers that aren't finite as null."""
    plain = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    return "".join(json.dumps({k: plain(v) for k, v in sorted(r.asDict(True).items())}, default=str, ensure_ascii=False) + "\n" for r in df.toLocalIterator())


def svg_lines(df: DataFrame, series: str, x: str, y: str, width: int = 640, height: int = 400) -> str:
    """A line per series over x, scaled to the values there are; an empty table gives an empty drawing."""
    lines: dict[str, list[tuple[float, float]]] = {}
    for r in df.select(series, x, y).dropna().toLocalIterator():
        lines.setdefault(str(r[0]), []).append((float(r[1]), float(r[2])))
    points = [p for v in lines.values() for p in v] or [(0.0, 0.0)]
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points))
    at = lambda p: f"{40 + (p[0] - x0) / ((x1 - x0) or 1) * (width - 60):.1f},{height - 30 - (p[1] - y0) / ((y1 - y0) or 1) * (height - 50):.1f}"
    body = "".join(f'<polyline fill="none" stroke="hsl({360 * i // max(1, len(lines))},60%,40%)" points="{" ".join(map(at, sorted(v)))}"><title>{html.escape(k)}</title></polyline>' for i, (k, v) in enumerate(sorted(lines.items())))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{body}</svg>\n'


FORMATS = {"md": markdown, "html": html_table, "jsonl": json_rows}
