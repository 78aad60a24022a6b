"""Writers: delimited text, FASTA, JSON and Markdown reports, charts, archives and logs."""

from __future__ import annotations

import hashlib
import io
import json
import logging
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """CSV with a header and a fixed order of columns; booleans as True and False, null as empty.  ``single`` is for small results."""
    out = df.select(*(F.initcap(F.col(c).cast("string")).alias(c) if dict(df.dtypes)[c] == "boolean" else F.col(c) for c in columns))
    (out.coalesce(1) if single else out).write.mode("error").csv(path, header=True, emptyValue="", nullValue="")


def write_fasta(df: DataFrame, path: str, name: list[str], sequence: str = "sequence") -> None:
    """Records ``>name...`` and the string on the next line."""
    df.select(F.concat(F.lit(">"), F.concat_ws(" ", *(F.col(c).cast("string") for c in name)), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("error").text(path)


def report_text(values: dict) -> str:
    """A JSON result document; numbers that are not finite raise."""
    return json.dumps(values, indent=2, sort_keys=True, allow_nan=False, ensure_ascii=False) + "\n"


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)]) + "\n"


def markdown_report(title: str, sections: list[tuple[str, list[str], list[tuple]]]) -> str:
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(columns, rows)}" for name, columns, rows in sections)


# --------------------------------------------------------------------------- charts


def _svg(width: int, height: int, body: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">' + "".join(body) + "</svg>\n"


def bar_chart(labels: list[str], values: list[float], width: int = 480, height: int = 240) -> str:
    top, step = max(values, default=0) or 1, (width - 40) / max(1, len(values))
    body = []
    for i, (label, v) in enumerate(zip(labels, values, strict=True)):
        h, x = (height - 40) * v / top, 20 + i * step
        body.append(f'<rect x="{x:.1f}" y="{height - 20 - h:.1f}" width="{step * 0.8:.1f}" height="{h:.1f}" fill="#4a6fa5"/><text x="{x:.1f}" y="{height - 6}" font-size="9">{label}</text>')
    return _svg(width, height, body)


def line_chart(values: list[float], width: int = 480, height: int = 240) -> str:
    top, step = max(values, default=0) or 1, (width - 40) / max(1, len(values) - 1)
    points = " ".join(f"{20 + i * step:.1f},{height - 20 - (height - 40) * v / top:.1f}" for i, v in enumerate(values))
    return _svg(width, height, [f'<polyline points="{points}" fill="none" stroke="#4a6fa5" stroke-width="1.5"/>'])


def heat_map(rows: list[list[float]], cell: int = 9) -> str:
    top = max((v for r in rows for v in r), default=0) or 1
    body = [f'<rect x="{j * cell}" y="{i * cell}" width="{cell}" height="{cell}" fill="#4a6fa5" fill-opacity="{v / top:.3f}"/>' for i, r in enumerate(rows) for j, v in enumerate(r)]
    return _svg(cell * max(map(len, rows), default=0), cell * len(rows), body)


# --------------------------------------------------------------------------- archives and logs


def deterministic_zip(files: dict[str, bytes]) -> bytes:
    """The same files always give the same bytes: sorted names and a fixed time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def manifest(files: dict[str, bytes]) -> dict[str, str]:
    return {name: hashlib.sha256(data).hexdigest() for name, data in sorted(files.items())}


def verify_zip(data: bytes, expected: dict[str, str]) -> None:
    """The archive holds exactly the manifest's files with their digests."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = manifest({n: z.read(n) for n in z.namelist()})
    if found != expected:
        odd = sorted(k for k in found.keys() | expected.keys() if found.get(k) != expected.get(k))
        raise ValueError(f"archive and manifest differ in {', '.join(odd)}")


def close_logger(log: logging.Logger) -> None:
    """Take off and close all handlers."""
    for handler in tuple(log.handlers):
        log.removeHandler(handler)
        handler.close()


def run_logger(name: str, folder: str, file: str = "pipeline.log", level: str = "INFO") -> logging.Logger:
    """A logger to the console and to a file of a run's own folder, which is made; asking again replaces both."""
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(name)
    close_logger(log)
    log.propagate = False
    log.setLevel(level.upper())
    for handler in (logging.StreamHandler(), logging.FileHandler(where / file, encoding="utf-8")):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
    return log
