"""Byte-level BPE: ranked merges are folded over the byte arrays of distinct words.

Texts are cut into words by the vocabulary's pattern.  A word that a Python worker has not met before
is folded once: from single bytes, the adjacent pair of lowest rank (leftmost on ties) is merged
until no pair has a rank.  All new words of a run of texts are folded together, a merge of every
word in each round, on flat arrays; ranks are read off a literal map of token pairs.  Decoding joins
the binary pieces of the ids.  Words of over ``LONG`` bytes, on which rounds would be quadratic, are
merged with a heap instead; the result is the same.

:func:`fold` is the same fold as a column expression of higher-order functions.  It gives the same
ids, but each word costs it some 200 microseconds, and corpora hold too many distinct words for
that (see the README for figures), so :func:`encode` folds in Arrow batches.  Either way encoding is
one narrow stage without a shuffle.

Null text counts as empty: no tokens, digests of the empty string.  A null doc_id stays null.  Repeated rows are encoded
each for itself, very long texts whole; an empty table gives an empty result; other columns than doc_id and text are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table
from docketry.llm.textbytes import Run, runs

LONG = 192
#: Factors that scatter pairs of ids over the slots.
LEFT, RIGHT = 611_953, 424_243
#: Words a worker remembers before it starts anew.
REMEMBER = 500_000
NONE = np.iinfo(np.int32).max
# The pattern that :func:`cuts` follows, and the white space of Unicode.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, BLANK = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def rank_pairs(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, rank) of every pair of tokens that joins to a token."""
    cut = ((ranks.get(token[:k]), ranks.get(token[k:]), rank) for token, rank in ranks.items() for k in range(1, len(token)))
    return [x for x in cut if x[0] is not None and x[1] is not None]


class PairRanks:
    """The ranks by the pair of tokens that a merge joins, as one literal array with open addressing: an entry
    is left, right and rank in 20 bits each, 0 is an empty slot, and ``reach`` slots are looked at."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = rank_pairs(ranks)
        self.slots, self.reach = 4 * len(pairs) + 7 | 1, 1
        entries = [0] * self.slots
        for left, right, rank in pairs:
            at, tries = (left * LEFT + right * RIGHT) % self.slots, 1
            while entries[at]:
                at, tries = (at + 1) % self.slots, tries + 1
            entries[at] = left << 40 | right << 20 | rank
            self.reach = max(self.reach, tries)
        self.literal = F.from_json(F.lit(json.dumps(entries, separators=(",", ":"))), "array<bigint>")

    def merged(self, entries: Column, left: Column, right: Column) -> Column:
        """The rank of the merged token, which is also its id; null where the pair does not merge."""
        key = F.shiftleft(left.cast("long"), 20).bitwiseOR(right.cast("long"))
        out, found = None, None
        for tries in range(self.reach):
            entry = entries[((left.cast("long") * LEFT + right.cast("long") * RIGHT + tries) % self.slots).cast("int")]
            found = F.shiftright(entry, 20) == key
            out = (F.when(entry == 0, None) if out is None else out.when(entry == 0, None)).when(found, entry.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))
        return out


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def fold(tokens: Column, pairs: PairRanks, entries: Column) -> Column:
    """Token ids (array<int>) of one word given as the ids of its bytes; ``entries``: the literal."""

    def step(acc: Column, _: Column) -> Column:
        def join(found: Column) -> Column:  # of each token with the next; null where they do not merge
            def at(i: Column) -> Column:
                return F.concat(F.slice(acc, F.lit(1), i - 1), F.array(F.array_min(found)), F.slice(acc, i + 2, F.size(acc)))

            return F.when(F.array_min(found).isNull(), acc).otherwise(_let(F.array_position(found, F.array_min(found)).cast("int"), at))

        return _let(F.transform(acc, lambda t, i: pairs.merged(entries, t, F.get(acc, i + 1))), join)

    return F.aggregate(F.slice(tokens, 2, F.size(tokens)), tokens, step)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, by a heap of pairs over a linked list."""
    n = len(word)
    end, left, right, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] < n and (r := ranks.get(word[i : end[right[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[right[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or right[i] >= n or end[right[i]] != stop:
            continue
        j = right[i]
        live[j], end[i], right[i] = False, stop, right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = right[i]
    return out


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point as the tokenizers' own pattern engine has it (its version of Unicode, not that of
    another library); kept for the worker's life."""
    if not _kinds:
        from tokenizers import pre_tokenizers

        cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        white = set(WHITE)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in white and c != 0x27]
        out = np.full(0x110000, OTHER, dtype=np.uint8)
        # Cut into runs of one kind; each run's kind shows in which of three characters its first one joins.
        for _, (a, b) in cut("".join(map(chr, points))):
            kind = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "%")) if len(cut(x + chr(points[a]))) == 1), BLANK)
            out[points[a:b]] = kind
        out[WHITE] = BLANK
        _kinds.append(out)
    return _kinds[0]


def cuts(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Where ``PATTERN``'s words begin in the bytes of a run, and for each text the number of words before it (one more than texts).

    The pattern leaves no gaps, so words end where the next one begins: where the kind of character changes, but a
    blank joins the word after it, the last of several white spaces stands apart from those before it, and a
    contraction that no blank or mark precedes is a word of its own."""
    data = run.data
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(run.n + 1, dtype=np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    kind, n = kinds()[points], len(points)
    first = np.searchsorted(at, run.at[:-1])
    edge = np.zeros(n + 4, dtype=bool)  # a text begins here (or nothing is left)
    edge[first[first < n]] = True
    edge[n:] = True
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:n]
    begin = np.append(change, [True] * 4)
    after = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~edge[1:n]) + 1
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & change & begin[:n])
    letter = lambda k: np.where(edge[quote + k], 0, points[np.minimum(quote + k, n - 1)])
    one = letter(1)
    two = np.where(edge[quote + 1], 0, letter(2))
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (two == ord("e")) & np.isin(one, [ord("r"), ord("v")]) | (one == ord("l")) & (two == ord("l"))
    begin[quote[short | long] + 1] = False
    begin[quote[short] + 2] = True
    begin[quote[long] + 3] = True
    starts = at[np.flatnonzero(begin[:n])]
    return starts, np.append(np.searchsorted(starts, run.at[:-1]), len(starts))


class Encoder:
    """Encodes runs of texts; every word a worker meets is folded once (the memory starts anew beyond ``REMEMBER`` words)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.own = ranks, pattern == PATTERN
        if not self.own:
            import regex

            self.pattern = regex.compile(pattern)
        left, right, rank = np.array(rank_pairs(ranks), dtype=np.int64).reshape(-1, 3).T
        order = np.argsort(left << 20 | right)
        self.pairs, self.rank_of = (left << 20 | right)[order], rank[order].astype(np.int32)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pairs = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.pieces, self.texts = {r: t for t, r in ranks.items()}, {r: str(r) for r in ranks.values()}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids: list[bytes] = []
        self.decimal: list[str] = []
        self.binary: list[bytes] = []

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that a pair joins to, which is also its id; ``NONE`` where there is none."""
        if not len(self.pairs):
            return np.full(len(left), NONE, dtype=np.int32)
        key = left << 20 | right
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.rank_of[place], NONE)

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin (one more than words): rounds of one merge a word, over all words at once."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        number, token = np.arange(len(words)), self.byte_ids[data]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(data), NONE, dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.byte_pairs[data[inner] << 8 | data[inner + 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sizes):
            begin = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, begin)
            ready = low == NONE
            if ready.mean() > 0.2 or ready.all():
                gone = np.repeat(ready, sizes)
                done.append((np.repeat(number, sizes)[gone], token[gone]))
                token, rank = token[~gone], rank[~gone]
                number, sizes, low = number[~ready], sizes[~ready], low[~ready]
                if not len(sizes):
                    break
            word = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero((rank == low[word]) & (rank != NONE))
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            token[hit] = rank[hit]
            ends = np.cumsum(sizes)
            more = hit[hit + 2 < ends[word[hit]]]
            rank[hit] = NONE
            rank[more] = self.rank(token[more], token[more + 2])
            some = hit[(hit > 0) & (word[hit - 1] == word[hit])]
            rank[some - 1] = self.rank(token[some - 1], token[some])
            sizes[word[hit]] -= 1
            stay = np.ones(len(token), dtype=bool)
            stay[hit + 1] = False
            token, rank = token[stay], rank[stay]
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, dtype=np.int64),) * 2
        return ids[np.argsort(owner, kind="stable")], np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        long = [len(w) > LONG for w in words]
        if any(long):
            for h, w in zip(hashes, words, strict=True):
                if len(w) > LONG:
                    ids = merge_long(w, self.ranks)
                    self._add([h], np.array(ids), [0, len(ids)])
            hashes, words = [h for h, x in zip(hashes, long, strict=True) if not x], [w for w, x in zip(words, long, strict=True) if not x]
        if words:
            ids, at = self.fold(words)
            self._add(hashes, ids, at.tolist())

    def _add(self, hashes: list[int], ids: np.ndarray, at: list[int]) -> None:
        self.known.update(zip(hashes, range(len(self.ids), len(self.ids) + len(hashes)), strict=True))
        flat, raw = ids.tolist(), ids.astype("<u4").tobytes()
        texts, pieces = list(map(self.texts.__getitem__, flat)), list(map(self.pieces.__getitem__, flat))
        spans = list(zip(at[:-1], at[1:], strict=True))
        self.ids += [raw[4 * a : 4 * b] for a, b in spans]
        self.decimal += [" ".join(texts[a:b]) for a, b in spans]
        self.binary += [b"".join(pieces[a:b]) for a, b in spans]

    def words(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.own:
            starts, first = cuts(run)
            return starts, np.append(starts[1:], len(run.data)), first
        spans, first, data = [], [0], run.data.tobytes()
        for a, b in zip(run.at[:-1].tolist(), run.at[1:].tolist(), strict=True):
            for m in self.pattern.findall(data[a:b].decode()):
                size = len(m.encode())
                a = data.index(m.encode(), a)
                spans.append((a, a + size))
                a += size
            first.append(len(spans))
        both = np.array(spans, dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1], np.array(first)

    def encode(self, run: Run) -> Iterator[tuple[int, bytes, str, str]]:
        """n_tokens, ids, ids_sha256 and decoded_sha256 of every text of a run."""
        starts, ends, first = self.words(run)
        unique, where, inverse = np.unique(Run.spans(run.prefix(), starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self._clear()
        keys = unique.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.known]
        if new:
            data = run.data.tobytes()
            self._learn([keys[k] for k in new], [data[starts[where[k]] : ends[where[k]]] for k in new])
        numbers = np.array([self.known[h] for h in keys], dtype=np.int64)[inverse].tolist() if keys else []
        first = first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            words = numbers[a:b]
            ids, decimal, binary = (list(map(x.__getitem__, words)) for x in (self.ids, self.decimal, self.binary))
            ids = b"".join(ids)
            yield len(ids) // 4, ids, hashlib.sha256(" ".join(decimal).encode()).hexdigest(), hashlib.sha256(b"".join(binary)).hexdigest()


_workers: dict[tuple, Encoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One for each vocabulary and Python worker, so tasks that follow each other share what they learned."""
    key = (pattern, len(ranks), zlib.crc32(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])[:1000])))
    if key not in _workers:
        _workers[key] = Encoder(ranks, pattern)
    return _workers[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), ids_sha256 and decoded_sha256 of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: bounded by its file

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for b in batches:
            for run in runs(b.column(1)):
                columns = zip(*encoder.encode(run), strict=True)
                types = [pa.int64(), pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(run.first, run.n), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run_batches, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).drop("ids")
