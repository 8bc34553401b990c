"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents.  In each round a source is given ``seq_len * share`` tokens of
credit; a document leaves its queue in the first round whose credit, with the deficit carried so
far, covers it.  Credit only ever adds up, so the round of a document is a closed form of the tokens
of its queue up to its end: ``ceil(tokens / (seq_len * share))``.  Rounds follow each other, within
a round sources in order, within a source the queue; cutting that stream every ``seq_len`` tokens
gives windows that hold the target proportions up to one document a source, with nothing lost
between windows or partitions and no padding but in the last window.  All running sums are done in
blocks: sums within a block, then over the blocks' totals.

The default shares are the sources' shares of all tokens, so all queues end together; with other
weights a queue that ends leaves the later windows to the rest.  Null text counts as empty (its only
id is ``end_id``), a null source is a queue of its own, repeated rows are packed each for itself.
A null id is an id like any other, very long texts are cut over windows like others.  An empty table
gives no pieces.  Only doc_id, text and source are read.

The totals of blocks and chunks are summed in one task: two numbers for every 4,096 rows of a source or
two million tokens of the stream.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import table, written
from docketry.llm.textbytes import LOWER, Run, runs

SEQ_LEN, END_ID = 2048, 1
#: Rows of a block of running sums, and rounds of a chunk of the stream.
BLOCK_ROWS, CHUNK_ROUNDS = 4_096, 1_024
CACHE_WORDS = 800_000
#: Marks that are cut off the end of a word whose core ends in an ASCII letter: the vocabulary's pattern
#: ends a match there anyway, and fewer different strings are left to encode.
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b".,!?;:#$%&*")] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def _units(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, cut before the marks at their end; lower-cases A-Z in ``run`` (the vocabulary has lower case only)
    except in words with "<", which may hold special tokens."""
    starts, ends, first = run.words()
    if not len(starts):
        return starts, ends, first
    data = run.data
    angle = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(data == ord("<"), out=angle[1:])
    exact = angle[ends] > angle[starts]
    lowered = LOWER[data]
    for i in np.flatnonzero(exact):
        lowered[starts[i] : ends[i]] = data[starts[i] : ends[i]]
    core = np.maximum.accumulate(np.where(_MARKS[data], -1, np.arange(len(data))))[ends - 1]
    cut = (core >= starts) & (core + 1 < ends) & ~exact
    cut[cut] = _LETTERS[data[core[cut]]]
    run.data = lowered
    row = np.repeat(np.arange(len(starts)), 1 + cut)
    tail = np.zeros(len(row), dtype=bool)
    tail[1:] = row[1:] == row[:-1]
    begin, end = np.where(tail, core[row] + 1, starts[row]), np.where(cut[row] & ~tail, core[row] + 1, ends[row])
    total = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(1 + cut, out=total[1:])
    return begin, end, total[first]


class WordIds:
    """Token ids of words.  The vocabulary never crosses white space, so a text's ids are its words' ids in a row;
    each word a worker meets is encoded once (the cache starts anew beyond ``CACHE_WORDS``)."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self._clear()

    def _clear(self) -> None:
        # Sorted hashes and their slots: some 30 bytes a word, where a dict takes 150.
        self.hashes, self.slots, self.n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), 0
        self.ids, self.at, self.full = np.zeros(1 << 20, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), 0

    def _learn(self, words: list[str]) -> None:
        """Encode ``words`` into the next slots."""
        # The pattern and the normaliser leave a word of lower-case ASCII letters as it is: the model alone will do.
        plain = [w.isascii() and w.isalpha() and w.islower() for w in words]
        rest = iter(self.tokenizer.encode_batch([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        model = self.tokenizer.model
        for w, p in zip(words, plain, strict=True):
            ids = [t.id for t in model.tokenize(w)] if p else next(rest).ids
            while self.full + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            if self.n + 2 > len(self.at):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.ids[self.full : self.full + len(ids)] = ids
            self.full += len(ids)
            self.n += 1
            self.at[self.n] = self.full

    def encode(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a run, and where each text's begin (one more than texts)."""
        starts, ends, first = _units(run)
        unique, where, inverse = np.unique(Run.spans(run.prefix(), starts, ends), return_index=True, return_inverse=True)
        if self.n + len(unique) > CACHE_WORDS:
            self._clear()
        place = np.searchsorted(self.hashes, unique)
        new = np.append(self.hashes, np.uint64(0))[place] != unique
        new |= place == len(self.hashes)
        if new.any():
            data, before = run.data.tobytes(), self.n
            self._learn([data[starts[k] : ends[k]].decode() for k in where[new].tolist()])
            self.hashes = np.insert(self.hashes, place[new], unique[new])
            self.slots = np.insert(self.slots, place[new], np.arange(before, self.n, dtype=np.int32))
            place = np.searchsorted(self.hashes, unique)
        known = self.slots[place][inverse] if len(unique) else np.zeros(0, dtype=np.int32)
        begin, size = self.at[known], self.at[known + 1] - self.at[known]
        total = np.zeros(len(known) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        return self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])], total[first]


_workers: dict[int, WordIds] = {}


def _word_ids(vocabulary: str) -> WordIds:
    """One for each vocabulary and Python worker, so tasks that follow each other share what they learned."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _workers:
        _workers[key] = WordIds(vocabulary)
    return _workers[key]


def tokenized(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """uid, doc_id, source, n and ids (little-endian, two bytes each where the vocabulary allows, else four) of every row."""
    spark = docs.sparkSession
    with open(vocabulary_path) as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a tokenizer's file: a few MB, whatever the corpus
    from tokenizers import Tokenizer

    kind = "<u2" if max(Tokenizer.from_str(vocabulary.value).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(vocabulary.value)
        for b in batches:
            for run in runs(b.column(1)):
                ids, at = words.encode(run)
                full = np.insert(ids, at[1:], end_id).astype(kind)
                at = at + np.arange(len(at))
                places = pa.py_buffer((at * full.itemsize).astype(np.int32).tobytes())
                binary = pa.Array.from_buffers(pa.binary(), run.n, [None, places, pa.py_buffer(full.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(run.first, run.n), b.column(2).slice(run.first, run.n), pa.array(np.diff(at)), binary], names=["doc_id", "source", "n", "ids"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).mapInArrow(run_batches, "doc_id long, source string, n long, ids binary")
    return out.withColumn("uid", F.monotonically_increasing_id())


def _running(df: DataFrame, value: str, group: list[str], block: Column, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of the group, in order of block and ``order``."""
    df = df.withColumn("block", block)
    within = Window.partitionBy(*group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*group, "block").agg(F.sum(value).alias("block_sum")).withColumn("base", F.coalesce(F.sum("block_sum").over(before), F.lit(0)))
    placed = df.withColumn("within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return placed.join(blocks.drop("block_sum"), [*group, "block"]).withColumn(name, F.col("base") + F.col("within")).drop("base", "within", "block")


def schedule(lengths: DataFrame, seq_len: int = SEQ_LEN, weights: dict[str, float] | None = None) -> DataFrame:
    """The place of every document (uid, source, n) in the packed stream: adds ``at``, the tokens before it."""
    lengths = lengths.withColumn("source", F.coalesce("source", F.lit("\x00")))
    rows = lengths.count()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    totals = lengths.groupBy("source").agg(F.sum("n").alias("source_tokens"))
    if weights:
        share = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))[F.col("source")]
        totals = totals.withColumn("weight", F.coalesce(share, F.lit(min(weights.values()))))
    else:
        totals = totals.withColumn("weight", F.col("source_tokens").cast("double"))
    whole = totals.agg(F.sum("weight").alias("w")).first()["w"] or 1.0
    queued = _running(lengths, "n", ["source"], F.pmod(F.xxhash64("uid"), F.lit(blocks)), ["uid"], "queue_at").join(totals, "source")
    rounds = queued.withColumn("round", F.ceil((F.col("queue_at") + F.col("n")) / (F.col("weight") * F.lit(seq_len / whole))).cast("long"))
    # Within a round a queue goes in its own order, which queue_at is.
    placed = _running(rounds, "n", [], F.floor(F.col("round") / CHUNK_ROUNDS).cast("long"), ["round", "source", "queue_at"], "at")
    return placed.select("uid", "at")


def pack(tokens: DataFrame, seq_len: int = SEQ_LEN, weights: dict[str, float] | None = None, wide: bool = False) -> DataFrame:
    """Pieces of the documents of a written :func:`tokenized` table.  ``wide``: ids take four bytes."""
    places = schedule(tokens.select("uid", "source", "n"), seq_len, weights)
    kind = "<u4" if wide else "<u2"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at, n = (np.asarray(b.column(k), dtype=np.int64) if b.column(k).null_count == 0 else None for k in (0, 1, 2))
            first, last = at // seq_len, (at + n - 1) // seq_len
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + k
            begin = np.maximum(at[row], sequence * seq_len)
            length = np.minimum(at[row] + n[row], (sequence + 1) * seq_len) - begin
            start = begin - at[row]
            _, offsets, content = b.column(3).cast(pa.large_binary()).buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64, count=len(n) + 1, offset=8 * b.column(3).offset)
            ids = np.frombuffer(content, dtype=kind, offset=offsets[0], count=(offsets[-1] - offsets[0]) // np.dtype(kind).itemsize).astype("<u4")
            low = (offsets[:-1] - offsets[0])[row] // np.dtype(kind).itemsize + start
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(low.tolist(), (low + length).tolist(), strict=True)]
            ids_of = b.column(0).take(pa.array(row)) if doc is None else pa.array(doc[row])
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(x) for x in (start, length, np.array(crc, dtype=np.int64), n[row], sequence, begin - sequence * seq_len))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    joined = tokens.select("uid", "doc_id", "n", "ids").join(places, "uid").select("doc_id", "at", "n", "ids")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return pack(written(tokenized(docs, public_tokenizers.path("word_bpe_49k.json")), "tokens"))
