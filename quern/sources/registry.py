"""Files as documents: binary files are read by Spark and parsed by what their names say.

A workbook or a presentation that its reader fails on is read once more for its plain texts, with a warning; one beyond
the limits of packages is not. Pictures of packages are a table of their own (``assets``), named by their content.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import images, markdown, office, units

SCHEMA = "path string, format string, status string, markdown string, sha256 string, n_blocks int, warnings array<string>, error string, structure string"
ASSETS = "path string, ordinal int, filename string, sha256 string, mime string, width int, height int, bytes long, content binary"

#: The text, the number of its blocks, warnings, and the structure (see ``structure.py``).
Parser = Callable[[bytes], tuple[str, int, list[str], dict]]


def _text(data: bytes) -> tuple[str, int, list[str], dict]:
    text = markdown.clean(data.decode("utf-8"))
    return text, len(markdown.blocks(text)), [], units.sectioned("markdown", text, [])


def _plain_after(read, data: bytes) -> tuple[list[dict], list[str]]:
    try:
        return read(data)
    except office.LimitError:
        raise
    except Exception as first:  # whatever a damaged part leads to
        try:
            blocks, warnings = office.plain(data)
        except office.LimitError:
            raise
        except Exception as second:
            raise ValueError(f"neither structure ({type(first).__name__}: {first}) nor texts ({type(second).__name__}: {second})") from first
        return blocks, [*warnings, f"read without its structure: {type(first).__name__}: {first}"]


def _office(file_format: str, read, again: bool = False) -> Parser:
    def parse(data: bytes) -> tuple[str, int, list[str], dict]:
        blocks, warnings = _plain_after(read, data) if again else read(data)
        text, places = office.laid_out(blocks)
        own = units.fixed(file_format, text, places, warnings) if places else units.sectioned(file_format, text, warnings)
        return text, len(blocks), warnings, units.enriched(own, blocks)

    return parse


#: By extension, then by MIME type. Further parsers are added here.
PARSERS: dict[str, Parser] = {"txt": _text, "md": _text, "markdown": _text, "docx": _office("docx", office.read_docx), "xlsx": _office("xlsx", office.read_xlsx, True), "pptx": _office("pptx", office.read_pptx, True)}
READERS = {"docx": office.read_docx, "xlsx": office.read_xlsx, "pptx": office.read_pptx}
MIME = {
    "text/plain": "txt",
    "text/markdown": "md",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}


def kind_of(name: str, mime: str | None = None) -> str | None:
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return extension if extension in PARSERS else MIME.get(mime or "")


def read_files(spark: SparkSession, path: str, max_bytes: int = 64 << 20, pattern: str = "*") -> DataFrame:
    """Files below a path; of longer ones no content is read: it is null."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    long = found.filter(F.col("length") > max_bytes).drop("content").withColumn("content", F.lit(None).cast("binary"))
    return found.filter(F.col("length") <= max_bytes).unionByName(long)


def parse(files: DataFrame) -> DataFrame:
    """One row a file. A file that can't be read has status 'failed' and its error, and fails nothing else; one too long to
    be read names its size. A column mime, where there is one, tells the format of names without a known extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data, size, mime in zip(pdf["path"], pdf["content"], pdf["length"], pdf["mime"], strict=True):
                kind = kind_of(path, mime)
                try:
                    if data is None:
                        raise ValueError(f"file of {size} bytes is too long")
                    if kind is None:
                        raise ValueError("unsupported format")
                    text, n, warnings, own = PARSERS[kind](data)
                    out.append((path, kind, "review" if warnings else "ready", text, hashlib.sha256(text.encode()).hexdigest(), n, warnings, None, json.dumps(own, ensure_ascii=False)))
                except Exception as e:  # any damage of a file is its own result
                    out.append((path, kind, "failed", None, None, 0, [], f"{type(e).__name__}: {e}"[:500], None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return _columns(files).mapInPandas(run, SCHEMA)


def _columns(files: DataFrame) -> DataFrame:
    size = F.col("length") if "length" in files.columns else F.length("content").cast("long")
    mime = F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")
    return files.select("path", "content", size.alias("length"), mime.alias("mime"))


def assets(files: DataFrame) -> DataFrame:
    """(path, ordinal, filename, sha256, mime, width, height, bytes, content) of the pictures of packages, in reading order.
    A picture shown several times is one row. Files that can't be read have none; ``parse`` says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ASSETS.split(", ")]
        for pdf in batches:
            for path, data, mime in zip(pdf["path"], pdf["content"], pdf["mime"], strict=True):
                kind = kind_of(path, mime)
                if data is None or kind not in READERS:
                    continue
                try:
                    blocks, package = READERS[kind](data)[0], office.open_package(data)
                    parts = list(dict.fromkeys((b["part"], b["text"]) for b in blocks if "part" in b))
                    pictures = [(unquote(text[len("![](asset://") : -1]), package.read(part)) for part, text in parts]
                except Exception:  # reported where the file is parsed
                    continue
                rows = [(path, n, name, hashlib.sha256(b).hexdigest(), images.sniff(b, "application/octet-stream"), *(images.dimensions(b) or (None, None)), len(b), b) for n, (name, b) in enumerate(pictures, 1)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32"})

    return _columns(files).mapInPandas(run, ASSETS)
