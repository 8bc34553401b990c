"""The extractor as a table function, for SQL alone:

    SELECT * FROM extract_citations(TABLE(SELECT doc_id, text FROM filings) PARTITION BY doc_id)

The columns of the table that are not ``text`` are handed on in front of the citation's; ``tolerant => true`` reads locators
whose parts are joined by any white space or none, ``repair => false`` leaves runs of blanks as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docketry.functions.grammar import FIELDS, cite_spans, repaired_spans

PLACES = ("start", "end", "locator_start", "locator_end")


class ExtractCitations:
    """One row a citation of each row's text; a null or empty text gives none."""

    @staticmethod
    def analyze(filings: AnalyzeArgument, tolerant: AnalyzeArgument | None = None, repair: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not filings.isTable:
            raise ValueError("the first argument of extract_citations must be a table")
        names = filings.dataType.names
        if "text" not in names or "doc_id" not in names:
            raise ValueError("the table must have the columns doc_id and text")
        schema = StructType([f for f in filings.dataType.fields if f.name != "text"])
        schema = schema.add("ordinal", IntegerType()).add("citation_id", StringType()).add("kind", StringType())
        for name in PLACES:
            schema = schema.add(name, IntegerType())
        for name in ("matched_text", *FIELDS):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema=schema)

    def eval(self, filings: Row, tolerant: bool = False, repair: bool = True) -> Iterator[tuple]:
        if not filings["text"]:
            return
        own = [filings[n] for n in filings.__fields__ if n != "text"]
        found = (repaired_spans if repair else cite_spans)(filings["text"], bool(tolerant))
        for ordinal, c in enumerate(found):
            name = ":".join(str(x) for x in (filings["doc_id"], c["start"], c["end"], c["kind"]) if x is not None)
            yield (*own, ordinal, hashlib.sha256(name.encode()).hexdigest()[:8], c["kind"], *(c[p] for p in PLACES), c["matched_text"], *(c[f] for f in FIELDS))


def register(spark: SparkSession, name: str = "extract_citations") -> None:
    """Make the function known to the session's SQL."""
    spark.udtf.register(name, udtf(ExtractCitations))
