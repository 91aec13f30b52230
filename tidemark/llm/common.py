"""What the training-data operators share: reading, settling intermediate tables, small Column helpers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import release, settle, shared_dir

__all__ = ["documents", "let", "portions", "release", "settle", "shared_dir", "ship", "text_of"]
#: ASCII white space, as the word rules of the digest queries have it.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_shipped: set[str] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents under sf_dir."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that would not find it on their own path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    on_path = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root and spark.sparkContext.master.startswith("local[")
    if on_path or app in _shipped or root not in sys.path or root.endswith(".zip"):
        return
    package = __name__.split(".")[0]
    out = os.path.join(tempfile.mkdtemp(prefix=f"{package}-ship-"), f"{package}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def text_of(df: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df["text"], F.lit(""))


def portions(batch: pa.RecordBatch, size: int, column: str | int = "text") -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in portions of about `size` bytes, with the number of the first row.

    Null is the empty text; bytes that are no UTF-8 count as replacement characters. Only one portion is held as Python strings.
    """
    texts = batch.column(column).cast(pa.binary())
    at = 0
    while at < len(texts):
        part: list[str] = []
        total = 0
        while at + len(part) < len(texts) and (not part or total < size):
            raw = texts[at + len(part)].as_py() or b""
            total += len(raw)
            part.append(raw.decode("utf-8", "replace"))
        yield at, part
        at += len(part)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)
