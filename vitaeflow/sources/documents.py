"""Documents of a folder to texts. A file that can't be parsed has a status, and fails nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.functions.filename import parse_filename
from vitaeflow.functions.text import clean_noise_lines
from vitaeflow.operators.layout import document_texts
from vitaeflow.sources import docx, pdf
from vitaeflow.sources.extractions import document_keys

_BLOCKS = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string,kind:int,width:double>>"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            text, blocks, status = None, None, "ok"
            try:
                kind = path.lower().rpartition(".")[2]
                if kind in ("docx", "doc"):
                    text = docx.to_markdown(content)
                elif kind == "pdf":
                    names = ("page", "x0", "y0", "x1", "y1", "text", "kind", "width")
                    blocks = [dict(zip(names, b, strict=True)) for b in pdf.page_blocks(content)]
                elif kind in ("md", "txt"):
                    text = content.decode("utf-8")
                else:
                    status = f"no parser for .{kind}"
            except Exception as e:  # a broken file is reported, the batch goes on
                status = f"{type(e).__name__}: {e}"
            out.append((path, text, blocks, status))
        yield pd.DataFrame(out, columns=["path", "text", "blocks", "status"])


def parse_files(files: DataFrame) -> DataFrame:
    """(path, text, blocks, status) of (path, content): a PDF has blocks, any other file a text."""
    return files.mapInPandas(_parse, f"path string, text string, blocks {_BLOCKS}, status string")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, source_file, text, status, meta) of the files in a folder; meta is what names say."""
    listed = spark.read.format("binaryFile").load(path)
    files = listed.select("path", "content")
    parsed = parse_files(files)
    blocks = parsed.filter(F.size("blocks") > 0).select(F.col("path").alias("doc_key"), F.explode("blocks").alias("b")).select("doc_key", "b.*")
    laid = document_texts(blocks).select(F.col("doc_key").alias("path"), F.col("text").alias("_laid"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return parsed.join(laid, "path", "left").join(document_keys(listed), "path").select(
        "doc_key", name.alias("source_file"), clean_noise_lines(F.coalesce("text", "_laid")).alias("text"), "status", parse_filename(name).alias("meta")
    )
