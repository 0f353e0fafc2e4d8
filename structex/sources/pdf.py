"""PDF text layers as page rows. The parser is a plug-in: bytes to a list of page texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, total_pages int, page_number int, text string, error string"


def extract_pages(content: bytes, parser: Callable[[bytes], list[str]]) -> list[str]:
    """Page texts; a scanned page is an empty text, an empty file an error."""
    if not content:
        raise ValueError("the PDF is empty")
    return [text or "" for text in parser(bytes(content))]


def read_pages(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """One row per page of the files below a path; an unreadable file is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    pages = extract_pages(content, parser)
                    rows += [(name, len(pages), i + 1, text, None) for i, text in enumerate(pages)]
                except Exception as e:
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(
                {"total_pages": "Int32", "page_number": "Int32"}
            )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
