"""Token counts: the pieces of every distinct pre-token are counted once and joined to the documents' frequencies.

Texts are cut into pre-tokens as the vocabulary's library does.  Documents are taken in blocks of about ``BLOCK_BYTES``
of text; a block numbers its distinct pre-tokens, and a document keeps the numbers it uses and how often.  This table is
written once.  The blocks' word lists are dealt out by word and sorted, so the library counts each distinct pre-token
once; the counts go back to their blocks, are joined there to the frequencies, and every document's sum is taken.  No
ids are kept.  A word stands once in a block however often it occurs, so frequent words are no hot keys; those
that are tokens of the vocabulary (a table bounded by its file, each counted once when a worker starts) are summed
where they are met.

Special tokens written out in a text count as one token each and part the text, as the library has it.  Null text counts
as empty: no bytes, no tokens.  Repeated rows and ids (null ones too) are counted each for itself, very long texts whole, as
a block of their own; other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import cuts
from docketry.llm.common import table, written
from docketry.llm.textbytes import Run, runs

BLOCK_BYTES = 32 << 20
#: Words of a row of a block's list.
SLICE = 20_000
#: Counts that a task holds back to send them together.
KEEP = 2_000_000
LIMIT = 1024


class Vocabulary:
    """A byte-level BPE vocabulary as the tokenizers library reads it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        cutter = file["pre_tokenizer"] or {}
        if file["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("pre-tokens are cut for byte-level vocabularies without a normalizer only")
        added = file["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in what is around them are not supported")
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in sorted(added, key=lambda t: -len(t["content"]))) or b"(?!)")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._whole: np.ndarray | None = None

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def whole(self) -> np.ndarray:
        """Hashes, ascending, of the pre-tokens that are one token."""
        if self._whole is None:
            tokens = self.tokenizer.decode_batch([[i] for i in range(self.tokenizer.get_vocab_size())], skip_special_tokens=False)
            tokens = [t for t, n in zip(tokens, self.pieces(tokens), strict=True) if n == 1 and not self.special.search(t.encode())]
            data = [t.encode() for t in tokens]
            at = np.append(0, np.cumsum([len(t) for t in data]))
            run = Run(np.frombuffer(b"".join(data), dtype=np.uint8), at, 0)
            self._whole = np.unique(Run.spans(run.prefix(), at[:-1], at[1:]))
        return self._whole

    def segments(self, run: Run) -> tuple[Run, np.ndarray]:
        """``run`` without special tokens, and for each text that is left which one of ``run`` it is of (a text with k
        special tokens leaves k + 1)."""
        data = run.data.tobytes()
        spans = [m.span() for m in self.special.finditer(data)]
        if not spans:
            return run, np.arange(run.n)
        a, b = np.array(spans, dtype=np.int64).T
        owner = np.searchsorted(run.at, a, "right") - 1
        inside = b <= run.at[owner + 1]
        a, b, owner = a[inside], b[inside], owner[inside]
        keep = np.ones(len(run.data), dtype=bool)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            keep[x:y] = False
        before = np.append(0, np.cumsum(keep))
        order = np.argsort(np.concatenate([b, run.at[:-1]]), kind="stable")  # what follows a text's last special token comes before the next text
        begins = np.concatenate([before[b], before[run.at[:-1]]])[order]
        return Run(run.data[keep], np.append(begins, before[-1]), run.first), np.concatenate([owner, np.arange(run.n)])[order]


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


FREQUENCIES = "block long, doc_id long, n_bytes long, known long, ids binary, n binary, first int, words array<binary>"
_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("ids", pa.binary()), ("n", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.binary()))])


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of numbers (``at``: where each begins, one more than rows) as bytes, seven bits of a number in each."""
    sizes = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    begin = np.append(0, np.cumsum(sizes))
    out = np.zeros(begin[-1], dtype=np.uint8)
    for k in range(5):
        more = np.flatnonzero(sizes > k)
        out[begin[more] + k] = values[more] >> 7 * k & 127 | np.where(sizes[more] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(begin[at].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where each row's begin."""
    column = column.cast(pa.large_binary())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    _, places, content = column.buffers()
    at = np.frombuffer(places, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(content, dtype=np.uint8)[at[0] : at[-1]] if content else np.zeros(0, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    last = data < 128
    before = np.append(0, np.cumsum(last))  # numbers that end before each byte
    starts = np.append(0, np.flatnonzero(last)[:-1] + 1)
    shift = np.arange(len(data)) - starts[before[:-1]]
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, starts), before[at - at[0]]


def steps(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ascending numbers of rows as differences, each row's first as it is."""
    out = np.diff(ids, prepend=0)
    begin = at[:-1][at[:-1] < at[1:]]
    out[begin] = ids[begin]
    return out


def sums(differences: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What :func:`steps` was made of."""
    total = np.append(0, np.cumsum(differences))
    return total[1:] - np.repeat(total[at[:-1]], np.diff(at))


class Block:
    """The distinct words of consecutive texts, numbered in order of their first occurrence."""

    def __init__(self, name: int):
        self.name, self.bytes, self.numbers, self.words = name, 0, {}, []

    def add(self, run: Run, ids: pa.Array, vocabulary: Vocabulary) -> pa.RecordBatch:
        """A row a text: its tokens known already, and the numbers and frequencies of its other words."""
        parts, owner = vocabulary.segments(run)
        starts, first = cuts(parts)
        ends = np.append(starts[1:], len(parts.data))
        text = np.repeat(owner, np.diff(first))
        unique, where, inverse = np.unique(Run.spans(parts.prefix(), starts, ends), return_index=True, return_inverse=True)
        whole = vocabulary.whole()
        known = whole[np.minimum(np.searchsorted(whole, unique), len(whole) - 1)] == unique
        data, numbers = parts.data.tobytes(), np.zeros(len(unique), dtype=np.int64)
        for k in np.flatnonzero(~known).tolist():
            h = int(unique[k])
            number = self.numbers.get(h)
            if number is None:
                number = self.numbers[h] = len(self.words)
                self.words.append(data[starts[where[k]] : ends[where[k]]])
            numbers[k] = number
        settled = np.bincount(owner, minlength=run.n) - 1 + np.bincount(text[known[inverse]], minlength=run.n)
        rest = ~known[inverse]
        pairs, n = np.unique(text[rest] << 32 | numbers[inverse][rest], return_counts=True)
        at = np.searchsorted(pairs, np.arange(run.n + 1) << 32)
        self.bytes += len(run.data)
        columns = {
            "block": pa.array([self.name] * run.n, pa.int64()), "doc_id": ids, "n_bytes": pa.array(np.diff(run.at), pa.int64()), "known": pa.array(settled, pa.int64()),
            "ids": packed(steps(pairs & 0xFFFFFFFF, at), at), "n": packed(n - 1, at),
            "first": pa.nulls(run.n, pa.int32()), "words": pa.nulls(run.n, pa.list_(pa.binary())),
        }
        return pa.RecordBatch.from_pydict(columns, schema=_ARROW)

    def lists(self) -> Iterator[pa.RecordBatch]:
        """The words, a slice a row."""
        for first in range(0, len(self.words), SLICE):
            row = {f.name: [None] for f in _ARROW} | {"block": [self.name], "first": [first], "words": [self.words[first : first + SLICE]]}
            yield pa.RecordBatch.from_pydict(row, schema=_ARROW)


def frequencies(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``FREQUENCIES``: a row for every document and, with first and words, rows for the word lists of the blocks."""

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, count = _vocabulary(path), 0
        task = TaskContext.get().partitionId() << 32
        block = Block(task)
        for batch in batches:
            for run in runs(batch.column(1)):
                if block.bytes and block.bytes + len(run.data) > block_bytes:
                    yield from block.lists()
                    count += 1
                    block = Block(task + count)
                yield block.add(run, batch.column(0).slice(run.first, run.n), vocabulary)
        yield from block.lists()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run_batches, FREQUENCIES)


class Counted:
    """Counts of a task's words by block, until they are sent back."""

    def __init__(self):
        self.of, self.ids, self.n, self.size = [], [], [], 0

    def add(self, of: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        self.of.append(of)
        self.ids.append(ids)
        self.n.append(n)
        self.size += len(of)

    def rows(self) -> pa.RecordBatch:
        """A row a block: its words' numbers, ascending, and their pieces."""
        of, ids, n = (np.concatenate(x) for x in (self.of, self.ids, self.n))
        order = np.lexsort((ids, of))
        of, ids, n = of[order], ids[order], n[order]
        blocks, begin = np.unique(of, return_index=True)
        at = np.append(begin, len(of))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), packed(steps(ids, at), at), packed(n, at)], names=["of", "ids", "pieces"])


def pieces(lists: DataFrame, path: str) -> DataFrame:
    """Of ``lists`` (of, id, word) the blocks' numbers and pieces of words: of, ids and pieces, both packed.  Equal words come
    one after another, so each distinct one is counted once."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counted = _vocabulary(path), Counted()
        last: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # the library makes an object of each word
                words = batch.column(2).slice(at, SLICE).dictionary_encode()
                distinct = words.dictionary.to_pylist()
                new = [w for w in distinct if w not in last]
                last |= dict(zip(new, vocabulary.pieces([w.decode() for w in new]), strict=True))
                each = np.array([last[w] for w in distinct], dtype=np.int64)
                last = {distinct[-1]: last[distinct[-1]]}
                of, ids = (batch.column(k).slice(at, SLICE).to_numpy().astype(np.int64) for k in (0, 1))
                counted.add(of, ids, each[words.indices.to_numpy()])
            if counted.size > KEEP:
                yield counted.rows()
        if counted.size:
            yield counted.rows()

    # By number, so that small lists still go to all cores: their bytes are few, the work on them is not.
    return lists.select("of", "id", "word").repartition(n, "word").sortWithinPartitions("word").mapInArrow(run_batches, "of long, ids binary, pieces binary")


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text)."""
    made = written(frequencies(docs, path), "frequencies")
    lists = made.where("first IS NOT NULL").select(F.col("block").alias("of"), "first", F.posexplode("words").alias("at", "word")).select("of", "word", (F.col("first") + F.col("at")).alias("id"))

    def total(documents: pa.Table, words: pa.Table) -> pa.Table:
        numbers, at = unpacked(words["ids"])
        numbers = sums(numbers, at)
        each = np.zeros(len(numbers), dtype=np.int64)
        each[numbers] = unpacked(words["pieces"])[0]
        ids, at = unpacked(documents["ids"])
        product = np.append(0, np.cumsum(each[sums(ids, at)] * (unpacked(documents["n"])[0] + 1)))
        tokens = product[at[1:]] - product[at[:-1]] + documents["known"].to_numpy()
        return pa.table({"doc_id": documents["doc_id"], "n_bytes": documents["n_bytes"], "n_tokens": pa.array(tokens, pa.int64())})

    documents = made.where("first IS NULL").select("block", "doc_id", "n_bytes", "known", "ids", "n")
    out = documents.groupBy("block").cogroup(pieces(lists, path).groupBy("of")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
