"""Fill-in-the-middle transformation by rank and select over packed bitvectors.

A run of texts is one byte sequence.  Two bitvectors are laid over it, packed into 64-bit words with a
directory of set bits before every block of eight words: one marks where tokens
(``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``) begin, the other where code points do.  The
total popcount between a text's ends is its number of tokens, a select on two ranks gives the bytes at which the
text is cut, and ranks of those bytes give lengths in code points.

Where to cut and which form to write are read off the SHA-256 of ``seed:doc_id`` (a null id counts as the empty string),
so a re-run gives the same rows and rows that repeat an id and a text give equal rows.  Null text counts as empty: no
tokens, form plain, an empty output.  Texts that hold one of the marks stay plain, so :func:`restored` is exact.
Very long texts are cut whole, as a run of their own.  Other columns are not read; an empty table gives an empty result.
One narrow stage, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table
from docketry.llm.textbytes import SPACE, Run, runs

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of a block of the directory.
BLOCK = 8


class Bits:
    """A packed bitvector with rank and select, both over whole arrays of arguments."""

    def __init__(self, marks: np.ndarray):
        size = -(-(len(marks) + 1) // (64 * BLOCK)) * 64 * BLOCK
        self.words = np.packbits(np.pad(marks, (0, size - len(marks))), bitorder="little").view(np.uint64)
        in_words = np.bitwise_count(self.words).astype(np.int64)
        #: Set bits before every block, and after the last.
        self.blocks = np.append(0, np.cumsum(in_words.reshape(-1, BLOCK).sum(axis=1)))
        #: Set bits of a block before each of its words.
        self.inner = (np.cumsum(in_words.reshape(-1, BLOCK), axis=1) - in_words.reshape(-1, BLOCK)).astype(np.uint16).reshape(-1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.blocks[word // BLOCK] + self.inner[word] + np.bitwise_count(below)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of the set bit that ``rank`` others precede; there must be one."""
        block = np.searchsorted(self.blocks, rank, "right") - 1
        left = rank - self.blocks[block]
        word = block * BLOCK + (self.inner.reshape(-1, BLOCK)[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.inner[word]
        # Within a word: halve the span eight, four ... bits at a time by popcounts of its lower half.
        rest, at = self.words[word].copy(), np.zeros(len(rank), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(rest & ((np.uint64(1) << np.uint64(half)) - np.uint64(1))).astype(np.int64)
            up = low <= left
            left, at = left - np.where(up, low, 0), at + np.where(up, half, 0)
            rest = np.where(up, rest >> np.uint64(half), rest)
        return word * 64 + at


def token_starts(run: Run) -> np.ndarray:
    """Marks of the bytes at which tokens begin: a text's first byte, and white space after a word."""
    blank = SPACE[run.data]
    marks = blank.copy()
    marks[1:] &= ~blank[:-1]
    begins = run.at[:-1]
    marks[begins[begins < run.at[1:]]] = True
    return marks


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers of every id, from the hash of ``seed:id``."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, dtype=">u4").astype(np.int64).reshape(-1, 4)


def cut(run: Run, ids: list[int | None], seed: int, rate: int, spm: int) -> tuple[list, ...]:
    """n, form, prefix_chars, middle_chars and output of every text of a run."""
    tokens, points = Bits(token_starts(run)), Bits((run.data & 0xC0) != 0x80)
    h = draws(ids, seed)
    begin, end = run.at[:-1], run.at[1:]
    before = tokens.rank(begin)
    n = tokens.rank(end) - before
    first, second = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    places = []
    for units in (first, second):
        place = end.copy()
        inside = units < n  # a cut after all tokens is the text's end
        place[inside] = tokens.select((before + units)[inside])
        places.append(place)
    a, b = places
    code_points = [points.rank(x) for x in (begin, a, b)]
    plain = (n == 0) | (h[:, 2] % 100 >= rate)
    use_spm = h[:, 3] % 100 < spm
    data = run.data.tobytes()
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    forms, outputs = [], []
    for i, (x, y, z, w) in enumerate(zip(begin.tolist(), a.tolist(), b.tolist(), end.tolist(), strict=True)):
        text = data[x:w]
        if plain[i] or any(m in text for m in marks):
            plain[i] = True
            forms.append("plain")
            outputs.append(text)
        elif use_spm[i]:
            forms.append("spm")
            outputs.append(b"".join((marks[1], data[z:w], marks[0], data[x:y], marks[2], data[y:z])))
        else:
            forms.append("psm")
            outputs.append(b"".join((marks[0], data[x:y], marks[1], data[z:w], marks[2], data[y:z])))
    chars = [pa.array(u - v, pa.int64(), mask=plain) for u, v in ((code_points[1], code_points[0]), (code_points[2], code_points[1]))]
    return pa.array(n, pa.int64()), pa.array(forms, pa.string()), *chars, pa.array(outputs, pa.binary()).cast(pa.string())


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every row of ``docs`` (doc_id, text): of a hundred
    texts about ``rate`` are cut, of a hundred of those about ``spm`` begin with the suffix."""

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(1)):
                ids = batch.column(0).slice(run.first, run.n)
                yield pa.RecordBatch.from_arrays([ids, *cut(run, ids.to_pylist(), seed, rate, spm)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run_batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, by its form alone: the marks occur once each."""
    marks = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
    out = F.when(form == "plain", output)
    for name, (one, two, three) in marks.items():
        at_two, at_three = F.locate(two, output), F.locate(three, output)
        x = F.substring(output, F.lit(len(one) + 1), at_two - len(one) - 1)
        y = F.substring(output, at_two + len(two), at_three - at_two - len(two))
        z = F.substring(output, at_three + len(three), F.length(output))
        out = out.when(form == name, F.concat(x, z, y) if name == "psm" else F.concat(y, z, x))
    return out


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    output, text = F.col("output"), restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM base
), counted AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM counted
), parts AS (
  SELECT doc_id, n, form, text, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
