"""Documents in files: Word, PDF, Excel, and JSON lines in archives, read on the executors from binary files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import cut

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def docx_text(data: bytes) -> str:
    """Paragraphs outside tables, then table rows with bars between cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = [_text_of(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        lines += [" | ".join("\n".join(_text_of(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")]
    return "\n".join(x for x in lines if x.strip())


def pdf_text(data: bytes) -> str:
    """Text page by page, by whichever PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def xlsx_rows(data: bytes, sheet: int = 1) -> list[list[str]]:
    """Cells of a sheet as strings, empty where there is none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_X}si")]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in root.iter(f"{_X}row"):
        cells: dict[int, str] = {}
        for place, c in enumerate(row.findall(f"{_X}c")):
            letters = re.match("[A-Z]+", c.get("r", ""))
            at = 0
            for letter in letters[0] if letters else "":
                at = at * 26 + ord(letter) - 64
            value, kind = c.findtext(f"{_X}v") or "", c.get("t")
            if kind == "s":
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_X}t"))
            cells[at - 1 if letters else place] = value
        out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return out


READERS = {"txt": lambda b: b.decode("utf-8", "replace"), "md": lambda b: b.decode("utf-8", "replace"), "docx": docx_text, "pdf": pdf_text}


def read_documents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(essay_id, prompt_id, text, read_error, path) of .txt, .md, .docx and .pdf files; an unreadable one has an empty text and its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{%s}" % ",".join(READERS)).load(folder)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, problems = [], []
            for path, data in zip(part["path"], part["content"]):
                try:
                    texts.append(READERS[path.rpartition(".")[2].lower()](bytes(data)))
                    problems.append(None)
                except Exception as e:  # any broken file becomes a row
                    texts.append("")
                    problems.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": part["path"], "text": texts, "read_error": problems})

    read_ = files.select("path", "content").mapInPandas(read, "path string, text string, read_error string")
    name, parent = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    root = folder.rstrip("/").rpartition("/")[2]
    return read_.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("essay_id"), F.when(parent == root, "").otherwise(parent).alias("prompt_id"), "text", "read_error", "path")


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A workbook's sheet, its first row the names; all columns are strings. A workbook has a million rows at most."""
    data = spark.read.format("binaryFile").load(path).select("content")
    cells = F.udf(lambda b: xlsx_rows(bytes(b), sheet), "array<array<string>>")("content")
    # parsed once: a workbook is read by one task, and its rows are used twice
    rows = cut(data.select(F.posexplode(cells).alias("at", "r")))
    head = rows.where("at = 0").first()
    head = head.r if head else []
    return rows.where("at > 0").select(*(F.get("r", F.lit(i)).alias(n or f"column_{i}") for i, n in enumerate(head)))


def dataset_member(names: list[str]) -> str:
    """Of an archive's .jsonl members: one with "dataset" in its name first, then the least deep, then the shortest."""
    found = [n for n in names if n.lower().endswith(".jsonl")]
    if not found:
        raise ValueError("no .jsonl member")
    return min(found, key=lambda n: ("dataset" not in n.lower(), n.count("/"), len(n), n))


def read_zip_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the dataset member of each archive; a line that isn't JSON fails the query with its number."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z, z.open(dataset_member(z.namelist())) as f:
                    block = []
                    for i, line in enumerate(io.TextIOWrapper(f, "utf-8-sig"), 1):
                        if line.strip():
                            block.append((name, i, line.strip()))
                        if len(block) == 10_000:
                            yield pd.DataFrame(block, columns=["path", "line", "value"])
                            block = []
                    if block:
                        yield pd.DataFrame(block, columns=["path", "line", "value"])

    rows = files.mapInPandas(lines, "path string, line long, value string")
    bad = F.raise_error(F.concat(F.lit("not JSON in line "), F.col("line").cast("string")))
    return rows.select(F.when(F.try_parse_json("value").isNull(), bad).otherwise(F.from_json("value", schema)).alias("r")).select("r.*")


def with_text_columns(df: DataFrame, texts=("text", "content", "essay", "answer", "bai_lam"), ids=("essay_id", "id", "mssv", "student")) -> DataFrame:
    """(essay_id, text, others...): the first column with a text word in its name, else the longest on average; ids likewise, else numbered HS0001…

    Rows without a text go after the numbering; blanks collapse.
    """
    from pyspark.sql import Window

    named = lambda words, skip: next((c for c in df.columns if c != skip and any(w in c.lower() for w in words)), None)
    text = named(texts, None)
    if text is None:
        strings = [c for c, t in df.dtypes if t == "string"]
        if not strings:
            raise ValueError("no text column")
        sizes = df.agg(*(F.avg(F.length(c)).alias(c) for c in strings)).first().asDict()
        text = max(strings, key=lambda c: sizes[c] or 0)
    key = named(ids, text)
    number = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # an upload: one small file
    essay = F.col(key).cast("string") if key else F.concat(F.lit("HS"), F.lpad(number.cast("string"), 4, "0"))
    d = df.withColumn("_id", essay).where(F.col(text).isNotNull())
    rest = [c for c in df.columns if c not in (text, key, "essay_id", "text")]
    return d.select(F.col("_id").alias("essay_id"), F.trim(F.regexp_replace(F.col(text), r"\s+", " ")).alias("text"), *rest)
