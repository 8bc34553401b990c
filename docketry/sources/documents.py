"""Reading filings and run files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketry.functions.text import header_of, source_format, strict_body, tolerant_body


def from_column(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tolerant: bool = False) -> DataFrame:
    """Filings (doc_id, header, text) of a table that holds texts; the export header is split off."""
    body = tolerant_body if tolerant else strict_body
    return df.select(F.col(doc_id).alias("doc_id"), header_of(F.col(text)).alias("header"), body(F.col(text)).alias("text"))


def read_text(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Filings of a folder of ``.txt`` files, one a file, named after its stem; an error if there is none."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))
    if files.isEmpty():
        raise FileNotFoundError(f"no .txt file in {path}")
    return from_column(files, tolerant=tolerant)


def filings_of(spark: SparkSession, source: str | Path, tolerant: bool = False) -> DataFrame:
    """Filings of one source: a ``str`` is a text itself (doc_id ``text``), a ``Path`` a file or folder of ``.txt`` files."""
    if isinstance(source, Path):
        return read_text(spark, str(source), tolerant)
    return from_column(spark.createDataFrame([("text", source)], "doc_id string, text string"), tolerant=tolerant)


def read_converted(spark: SparkSession, path: str) -> DataFrame:
    """Filings of PDF, office, HTML and Markdown files, by a converter that has to be installed (``docling``)."""
    import importlib

    importlib.import_module("docling")
    binary = spark.read.format("binaryFile").load(path)

    def convert(frames):
        import io

        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter

        converter = DocumentConverter()
        for f in frames:
            f["text"] = [converter.convert(DocumentStream(name=p.rpartition("/")[2], stream=io.BytesIO(c))).document.export_to_text() for p, c in zip(f["path"], f["content"], strict=True)]
            yield f[["path", "text"]]

    return binary.select("path", "content").mapInPandas(convert, "path string, text string").select(F.col("path").alias("doc_id"), source_format(F.col("path")).alias("format"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
