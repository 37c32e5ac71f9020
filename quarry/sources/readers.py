"""Readers: record files, texts with chunking, and formats that need a parser."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import QueryError
from quarry.operators.chunk import paragraph_chunks


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): a line that isn't a record of the schema is kept apart; blank lines are skipped."""
    return parse_jsonl(spark.read.text(path), schema)


def parse_jsonl(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The same of lines (value)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt IS NULL").select(*[F.col(f"r.{f.name}") for f in schema.fields]), parsed.where("r._corrupt IS NOT NULL").select(F.col("value").alias("line"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def read_texts(spark: SparkSession, path: str, limit: int = 2000, separator: str = "\n\n") -> DataFrame:
    """uri, name, chunk_ordinal, content of whole text files, in chunks of paragraphs."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), "value")
    chunks = paragraph_chunks(files, limit, separator, "uri", "value")
    file = F.element_at(F.split("id", "/"), -1)
    return chunks.select(F.col("id").alias("uri"), F.concat(file, F.lit(" (chunk "), F.col("ordinal").cast("string"), F.lit(")")).alias("name"), F.col("ordinal").alias("chunk_ordinal"), "content")


def sheets_to_markdown(content: bytes) -> tuple[str, float]:
    """A workbook's sheets as tables under their names; a sheet with formulas says so. The first row is the head."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        text_of = lambda node: "".join(t.text or "" for t in node.iter(_SHEET + "t"))
        shared = [text_of(s) for s in tree("xl/sharedStrings.xml").iter(_SHEET + "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        files = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in tree("xl/workbook.xml").iter(_SHEET + "sheet"):
            node = tree("xl/" + files[sheet.get(_RELATION + "id")].removeprefix("/xl/"))
            rows: list[dict[int, str]] = []
            for row in node.iter(_SHEET + "row"):
                cells = {}
                for at, c in enumerate(row.iter(_SHEET + "c")):
                    value = c.find(_SHEET + "v")
                    text = text_of(c) if c.get("t") == "inlineStr" else "" if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text or ""
                    cells[_column(c.get("r"), at)] = text.replace("|", "\\|").replace("\n", " ")
                rows.append(cells)
            width = max((k + 1 for r in rows for k in r), default=0)
            lines = ["| " + " | ".join(r.get(k, "") for k in range(width)) + " |" for r in rows]
            head = lines[:1] + ["| " + " | ".join(["---"] * width) + " |"] if width else []
            formulas = ["Some cells hold formulas; their last values are shown.", ""] if node.find(f".//{_SHEET}f") is not None else []
            out.append("\n".join([f"## {sheet.get('name')}", "", *formulas, *head, *lines[1:]]))
    return "\n\n---\n\n".join(out), 1.0


def _column(reference: str | None, at: int) -> int:
    """The number of the column that a cell's reference ("AB12") names."""
    n = 0
    for ch in re.match(r"[A-Z]*", reference or "")[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1 if n else at


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: MIME type -> function from bytes to (text, quality). PDF, audio and image parsers need libraries that aren't part of this package.
PARSERS: dict[str, Callable[[bytes], tuple[str, float]]] = {"text/plain": lambda b: (b.decode("utf-8", "replace"), 1.0), "text/markdown": lambda b: (b.decode("utf-8", "replace"), 1.0)}
#: File endings and their MIME types.
MIME = {"txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "wav": "audio/wav", "mp3": "audio/mpeg", "png": "image/png", "jpg": "image/jpeg"}


PARSERS[MIME["xlsx"]] = sheets_to_markdown


def register_parser(mime: str, parse: Callable[[bytes], tuple[str, float]]) -> None:
    PARSERS[mime] = parse


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """parse_files() of the binary files of a path."""
    return parse_files(spark.read.format("binaryFile").load(path))


def parse_files(files: DataFrame, ending: Column | None = None) -> DataFrame:
    """uri, mime, text, quality, error of files (path, content), each by the parser of its type; a type without one gives an error.
    ending: of the file's name, where the path doesn't tell it."""
    ending = F.lower(F.element_at(F.split("path", r"\."), -1)) if ending is None else ending
    mime = F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[ending], F.lit("application/octet-stream"))
    files = files.select(F.col("path").alias("uri"), mime.alias("mime"), "content")
    parsers = dict(PARSERS)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for uri, kind, content in zip(rows["uri"], rows["mime"], rows["content"]):
                try:
                    if kind not in parsers:
                        raise QueryError(f"no parser for {kind}")
                    out.append((uri, kind, *parsers[kind](bytes(content)), None))
                except Exception as e:  # a file that can't be parsed is a row with an error
                    out.append((uri, kind, None, None, str(e)))
            yield pd.DataFrame(out, columns=["uri", "mime", "text", "quality", "error"])

    return files.mapInPandas(parse, "uri string, mime string, text string, quality double, error string")


def transcript(segments: DataFrame, by: str) -> DataFrame:
    """by, text: lines "[MM:SS → MM:SS] text" of segments (start_s, end_s, text) in order."""
    from quarry.functions.scalar import minutes_seconds

    line = F.concat(F.lit("["), minutes_seconds("start_s"), F.lit(" → "), minutes_seconds("end_s"), F.lit("] "), F.trim("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_s", line.alias("line")))), lambda s: s["line"])
    return segments.groupBy(by).agg(F.array_join(ordered, "\n").alias("text"))


def ocr_quality(c: str):
    """Mean of the confidences (0 to 100) that aren't negative, as a share."""
    good = F.filter(c, lambda x: x >= 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.size(good) / 100).otherwise(0.0)
