"""Reports over results that are small: profiles, fingerprints, and a bundle of JSON and HTML."""

from __future__ import annotations

import hashlib
import html
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.sources.tables import docx_bytes, pdf_bytes, xlsx_bytes

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def profile(df: DataFrame, most: int = 20) -> DataFrame:
    """(column, mean, min, max) of the first numeric columns that have a value, in one pass."""
    names = [c for c, t in df.dtypes if t.split("(")[0] in NUMBERS][:most]
    row = lambda c: F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    return df.agg(F.array(*map(row, names)).alias("p")).select(F.explode("p").alias("p")).select("p.*").where("mean is not null")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest) of the rows as a multiset: row digests are summed, so no order and no single task is needed."""
    cells = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    row = F.conv(F.substring(F.sha2(cells, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("s")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), "s"), 256).alias("digest"))


def ordered_fingerprint(df: DataFrame, columns: list[str], order: list[str], most: int = 1_000_000) -> str:
    """SHA-256 over the rows in an order, cells apart by US and rows ended by LF: the digest that other tools give a small table."""
    cells = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    digest, n = hashlib.sha256(), 0
    for r in df.orderBy(*order).select(cells.alias("c")).limit(most + 1).toLocalIterator():
        n += 1
        digest.update(r.c.encode() + b"\n")
    if n > most:
        raise ValueError(f"over {most} rows: fingerprint() is for large tables")
    return digest.hexdigest()


def bundle(tables: dict[str, DataFrame], path: str, title: str, expected: tuple[str, ...] = (), preview: int = 100) -> dict:
    """Writes report.json, .html, .xlsx, .docx and .pdf into a ZIP file on the driver: the first rows of each table, as they say, and what is missing."""
    shown = {name: df.limit(preview).toPandas() for name, df in tables.items()}
    summary = {"title": title, "tables": {n: {"rows_shown": len(t), "columns": list(t.columns)} for n, t in shown.items()}, "missing": [e for e in expected if e not in tables]}
    heads = {n: f"{n} (first {preview} rows at most)" for n in shown}
    rows = {heads[n]: [list(t.columns), *t.astype(object).where(t.notna(), None).values.tolist()] for n, t in shown.items()}
    parts = [f"<h2>{html.escape(heads[n])}</h2>{t.to_html(index=False, escape=True)}" for n, t in shown.items()]
    gaps = "".join(f"<li>{html.escape(e)}</li>" for e in summary["missing"])
    page = f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{"".join(parts)}' + (f"<h2>Missing</h2><ul>{gaps}</ul>" if gaps else "")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("report.json", json.dumps(summary, ensure_ascii=False, indent=2, default=str))
        z.writestr("report.html", page)
        z.writestr("report.xlsx", xlsx_bytes({n: rows[heads[n]] for n in shown} or {"empty": []}))
        z.writestr("report.docx", docx_bytes(title, rows))
        z.writestr("report.pdf", pdf_bytes(title, rows))
    return summary
