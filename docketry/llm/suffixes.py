"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts anywhere else are removed.

Every window of ``LENGTH`` bytes is assigned to an anchor, the ``GRAM``-byte string in it with the
least hash (leftmost on ties).  Equal windows have equal anchors at equal places, so anchors deal the
work: an anchor's segment is the bytes of the windows assigned to it, and only segments of equal
anchors can hold equal windows.  Segments that are byte for byte the same, with the anchor at the
same place, repeat as a whole.  Segments of one anchor that differ are put in one shard (those of an
anchor with over ``MANY`` are compared window by window instead), and the shard's suffix array is
built by induced sorting: suffixes are classified, leftmost-smaller
substrings sorted recursively, all else induced from them in linear time.  Permuted common prefixes
(capped at ``LENGTH``) then tell which windows start twice.

Null text counts as empty.  Rows that repeat an id are documents of their own: they are told apart by
the hash of their text, and equal rows repeat each other.  A null id is an id like any other.  Texts shorter than ``LENGTH`` bytes lose
nothing.  An empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table, written
from docketry.llm.textbytes import Run, mix, runs

LENGTH, GRAM = 200, 64
SHARD_BYTES = 1 << 20
#: Segments of a task that are brought together, distinct segments of an anchor that one suffix array holds at most,
#: and rows of an anchor that are held at once.
CHUNK, MANY, HOLD = 1 << 20, 4_096, 1 << 20
#: Stands for a null id, so that joins keep its rows.
NO_ID = -(1 << 63)
#: Symbols from which on an alphabet is too wide to go through it bucket by bucket.
WIDE = 512


# Induced sorting


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol is a unique least one."""
    step = np.sign(np.diff(t.astype(np.int64)))
    where = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    return np.append(np.append(step, 1)[nearest] > 0, True)


def _deal(out: list[list[np.ndarray]], symbol: np.ndarray, suffix: np.ndarray) -> None:
    """Append suffixes to their symbols' buckets, keeping their order."""
    order = np.argsort(symbol, kind="stable")
    symbol, suffix = symbol[order], suffix[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    for s, part in zip(symbol[np.append(0, cuts)].tolist(), np.split(suffix, cuts), strict=True):
        out[s].append(part)


def _induce_buckets(t: np.ndarray, k: int, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from sorted leftmost-smaller ones; a bucket's suffixes are handled in waves."""
    nothing = np.zeros(0, dtype=np.int64)
    seeded: list[list[np.ndarray]] = [[] for _ in range(k)]
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(seeded, t[seeds], seeds)
    for c in range(k):
        at = 0
        while True:
            if at < len(larger[c]):
                wave = larger[c][at] if at == len(larger[c]) - 1 else np.concatenate(larger[c][at:])
                at = len(larger[c])
            elif at >= 0 and seeded[c]:
                wave, at = np.concatenate(seeded[c]), -1
            else:
                break
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _deal(larger, t[before], before)
            if at < 0:
                break
    below = [np.concatenate(x) if x else nothing for x in larger]
    lesser: list[list[np.ndarray]] = [[] for _ in range(k)]  # from each bucket's end backwards
    lesser[int(t[-1])].append(np.array([len(t) - 1]))
    for c in range(k - 1, -1, -1):
        at = 0
        while at < len(lesser[c]):
            wave = np.concatenate(lesser[c][at:])
            at = len(lesser[c])
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _deal(lesser, t[before], before)
        before = below[c][::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _deal(lesser, t[before], before)
    return np.concatenate([x for c in range(k) for x in (below[c], np.concatenate(lesser[c])[::-1] if lesser[c] else nothing)])


def _induce_scan(t: np.ndarray, k: int, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same for wide alphabets, one suffix after the other."""
    counts = np.bincount(t, minlength=k)
    ends = np.cumsum(counts)
    symbols, less, out = t.tolist(), smaller.tolist(), [-1] * len(t)
    tail = ends.tolist()
    for i in seeds[::-1].tolist():
        tail[symbols[i]] -= 1
        out[tail[symbols[i]]] = i
    head = (ends - counts).tolist()
    for at in range(len(out)):
        i = out[at] - 1
        if i >= 0 and not less[i]:
            out[head[symbols[i]]] = i
            head[symbols[i]] += 1
    tail = ends.tolist()
    for at in range(len(out) - 1, -1, -1):
        i = out[at] - 1
        if i >= 0 and less[i]:
            tail[symbols[i]] -= 1
            out[tail[symbols[i]]] = i
    out[0] = len(out) - 1
    return np.array(out, dtype=np.int64)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """The suffixes of ``t`` (symbols below k, the last one 0 and found nowhere else) in order."""
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    induce = _induce_buckets if k <= WIDE else _induce_scan
    smaller = _smaller(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = induce(t, k, smaller, leftmost)
    is_left = np.zeros(n, dtype=bool)
    is_left[leftmost] = True
    ordered = order[is_left[order]]
    # Name the substrings from one leftmost-smaller suffix to the next, equal ones alike.
    stop = np.zeros(n, dtype=np.int64)
    stop[leftmost] = np.append(leftmost[1:], n - 1) + 1
    a, b = ordered[:-1], ordered[1:]
    differ = stop[a] - a != stop[b] - b
    live = np.flatnonzero(~differ)
    at = 0
    while len(live):
        live = live[at < (stop[a[live]] - a[live])]
        new = t[a[live] + at] != t[b[live] + at]
        differ[live[new]] = True
        live = live[~new]
        at += 1
    names = np.zeros(n, dtype=np.int64)
    names[ordered] = np.append(0, np.cumsum(differ))
    reduced = names[leftmost]
    kinds = int(names[ordered[-1]]) + 1
    if kinds < len(leftmost):
        ordered = leftmost[suffix_array(reduced, kinds)]
    else:
        ordered = leftmost[np.argsort(reduced)]
    return induce(t, k, smaller, ordered)


def common_prefixes(run: Run, order: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """For every suffix in text order, the prefix it shares with the one before it in ``order``, at most ``cap``:
    the permuted form, found for all suffixes at once by halving steps over prefix hashes."""
    before = np.empty(len(order), dtype=np.int64)
    before[order[1:]], before[order[0]] = order[:-1], order[0]
    here, prefix, n = np.arange(len(order)), run.prefix(), len(run.data)
    shared = np.zeros(len(order), dtype=np.int64)
    step = 1 << max(cap, 1).bit_length() - 1
    while step:
        longer = shared + step
        fits = (longer <= cap) & (np.maximum(here, before) + longer <= n)
        i = np.flatnonzero(fits)
        same = Run.spans(prefix, here[i] + shared[i], here[i] + longer[i]) == Run.spans(prefix, before[i] + shared[i], before[i] + longer[i])
        shared[i[same]] += step
        step >>= 1
    shared[order[0]] = 0
    return shared


def repeats(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the places where a window of ``length`` bytes begins that also begins elsewhere among the segments."""
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(s + b"\0" for s in segments), dtype=np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    t = data.astype(np.int64) + 2
    t[begin + sizes] = 1  # between segments: below all bytes, above the end
    order = suffix_array(np.append(t, 0), 258)[1:]
    # Bytes alone are hashed below: a separator would pass for a zero byte, but no window reaches over one.
    shared = common_prefixes(Run(data, np.array([0, len(data)]), 0), order, length)
    twice = np.zeros(len(data), dtype=bool)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    after = np.append(order, len(data))[place + 1]
    twice |= shared >= length
    twice |= (after < len(data)) & (np.append(shared, 0)[np.minimum(after, len(data))] >= length)
    return [np.flatnonzero(twice[b : b + max(s - length + 1, 0)]) for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


# Spark


def _anchors(run: Run, length: int) -> tuple[np.ndarray, ...]:
    """Per segment: row, anchor hash, context hash, first window and size in bytes."""
    data, prefix = run.data, run.prefix()
    n, span = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    grams = np.arange(n - GRAM + 1)
    hashes = Run.spans(prefix, grams, grams + GRAM)
    bits = np.uint64(max(n, 2).bit_length())
    least = ((hashes >> bits) << bits) | grams.astype(np.uint64)
    done, window = 1, least
    while done < span:
        step = min(done, span - done)
        window = np.minimum(window[:-step], window[step:])
        done += step
    anchor = (window & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window that begins at each byte
    doc = np.searchsorted(run.at, np.arange(len(anchor)), "right") - 1
    inside = np.arange(len(anchor)) + length <= run.at[doc + 1]
    begins = np.flatnonzero(inside)
    if not len(begins):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    a, d = anchor[begins], doc[begins]
    new = np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]))
    first = begins[new]
    last = begins[np.append(np.flatnonzero(new)[1:], len(begins)) - 1]
    at, row = a[new], d[new]
    stop = last + length
    context = mix(Run.spans(prefix, first, stop) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row + run.first, hashes[at].view(np.int64), context.view(np.int64), first - run.at[row], stop - first


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """Segments, equal ones of a chunk of a task brought together: the first stands for all ``n`` of them, the others
    (n = 0) are known to repeat and get a key of their own instead of the anchor, so none of them meet in one task."""

    def settle(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, version, anchor, context, first, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((context, anchor))
        new = np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1]))
        n = np.zeros(len(order), dtype=np.int32)
        n[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
        own = mix(context.view(np.uint64) ^ mix(np.arange(len(order), dtype=np.uint64))).view(np.int64)
        columns = (doc, version, np.where(n > 0, anchor, own), context, first, size, n)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "version", "anchor", "context", "first", "size", "n"])

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, full = [], 0
        for b in batches:
            ids, versions = np.asarray(b.column(0)), np.asarray(b.column(1))
            for run in runs(b.column(2)):
                row, anchor, context, first, size = _anchors(run, length)
                if len(row):
                    parts.append((ids[row], versions[row], anchor, context, first.astype(np.int32), size.astype(np.int32)))
                    full += len(row)
                if full > CHUNK:
                    yield settle(parts)
                    parts, full = [], 0
        if parts:
            yield settle(parts)

    return docs.mapInArrow(run_batches, "doc_id long, version int, anchor long, context long, first int, size int, n int")


def _meet(segments: DataFrame) -> DataFrame:
    """Segments whose anchor is found again.  ``whole``: an equal segment exists.  ``compare``: the anchor has
    segments that differ, and this row stands for all that equal it: 1, or 2 where they are over ``MANY``."""
    names = ["doc_id", "version", "anchor", "context", "first", "size"]

    def settle(cols: list[np.ndarray], known: tuple[int, int] | None) -> pa.RecordBatch:
        """``known``: an anchor that has over ``MANY`` segments, and the last of their contexts that was given out."""
        anchor, context, n = cols[2], cols[3], cols[6]
        begin = np.append(True, anchor[1:] != anchor[:-1])
        fresh = begin | np.append(True, context[1:] != context[:-1])
        group, kind = np.cumsum(begin) - 1, np.cumsum(fresh) - 1
        alone = n == 0
        total = np.bincount(kind, weights=n)[kind]
        whole = (total > 1) | alone
        contexts = np.bincount(group[fresh & ~alone], minlength=group[-1] + 1)[group]
        if known is not None:
            contexts[anchor == known[0]] += MANY
            given = (anchor == known[0]) & (context == known[1])
            whole |= given
            fresh &= ~given
        compare = np.where(fresh & ~alone, np.where(contexts > MANY, 2, np.where(contexts > 1, 1, 0)), 0).astype(np.int32)
        use = whole | (compare > 0)
        return pa.RecordBatch.from_arrays([*(pa.array(c[use]) for c in cols[:6]), pa.array(whole[use]), pa.array(compare[use])], names=[*names, "whole", "compare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        known = None
        for b in batches:
            if not b.num_rows:
                continue
            held.append([np.asarray(b.column(k)) for k in range(7)])
            rows = sum(len(h[0]) for h in held)
            if held[0][2][0] == held[-1][2][-1] and rows < HOLD:
                continue  # one anchor goes on
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[2], cols[2][-1]))
            if cut:
                yield settle([c[:cut] for c in cols], known)
                cols = [c[cut:] for c in cols]
            if len(cols[0]) >= HOLD:  # give out what is there but for the last context, so no anchor fills the memory
                same = cols[3] == cols[3][-1]
                cut = int(np.argmax(same)) or len(same)
                anchor, context = int(cols[2][0]), int(cols[3][cut - 1])
                yield settle([c[:cut] for c in cols], known if known and known[0] == anchor else (anchor, None))
                known, cols = (anchor, context), [c[cut:] for c in cols]
            held = [cols] if len(cols[0]) else []
        if held:
            yield settle([np.concatenate(c) for c in zip(*held, strict=True)], known)

    ordered = segments.repartition("anchor").sortWithinPartitions("anchor", "context", "doc_id", "version", "first")
    return ordered.mapInArrow(run, "doc_id long, version int, anchor long, context long, first int, size int, whole boolean, compare int")


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of bytes covered by windows that begin at ``starts``."""
    gaps = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, gaps + 1)].tolist(), (starts[np.append(gaps, len(starts) - 1)] + length).tolist(), strict=True))


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of ``wanted`` segments."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, version, text, segments in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data = (text or "").encode()
                out += [(doc, version, s["anchor"], s["first"], s["whole"], data[s["first"] : s["first"] + s["size"]]) for s in segments]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=["doc_id", "version", "anchor", "first", "whole", "bytes"])

    per_doc = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "first", "size", "whole")).alias("segments"))
    cut = docs.join(per_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "segments").dropDuplicates(["doc_id", "version"])
    return cut.mapInArrow(take, "doc_id long, version int, anchor long, first int, whole boolean, bytes binary")


def _windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc_id, version, begin, stop) of the repeats among segments of anchors that have more of them than one suffix
    array should hold: their windows are met one by one, by hash, so no task holds an anchor."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in runs(b.column(5)):
                prefix, sizes = run.prefix(), np.diff(run.at)
                n = np.maximum(sizes - length + 1, 0)
                row = np.repeat(np.arange(run.n), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                starts = run.at[:-1][row] + place
                window = Run.spans(prefix, starts, starts + length)
                rows = pa.array(row + run.first)
                begin = np.asarray(b.column(3))[row + run.first] + place
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in (0, 1, 2, 4)), pa.array(begin.astype(np.int32)), pa.array(window.view(np.int64))], names=["doc_id", "version", "anchor", "whole", "begin", "window"])

    every = written(_cut(docs, wanted).mapInArrow(each, "doc_id long, version int, anchor long, whole boolean, begin int, window long"), "windows")
    twice = every.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    return every.where("NOT whole").join(twice, ["anchor", "window"]).select("doc_id", "version", "begin", (F.col("begin") + length).alias("stop"))


def _compared(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc_id, version, begin, stop) of the repeats that suffix arrays find among ``wanted`` segments."""

    def sort(rows: list[dict]) -> pa.RecordBatch:
        found = []
        for r, starts in zip(rows, repeats([r["bytes"] for r in rows], length), strict=True):
            if len(starts) and not r["whole"]:
                found += [(r["doc_id"], r["version"], r["first"] + a, r["first"] + b) for a, b in _spans(starts, length)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, types, strict=True)], names=["doc_id", "version", "begin", "stop"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, full, last = [], 0, None
        for b in batches:
            for r in b.to_pylist():
                if full > SHARD_BYTES and r["anchor"] != last:
                    yield sort(rows)
                    rows, full = [], 0
                rows.append(r)
                full += len(r["bytes"])
                last = r["anchor"]
        if rows:
            yield sort(rows)

    each = _cut(docs, wanted)
    return each.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shards, "doc_id long, version int, begin int, stop int")


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of every row."""
    own = F.col("doc_id").cast("long")
    named = documents.select(own.alias("own_id"), F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), F.hash(F.coalesce("text", F.lit(""))).alias("version"), "text")
    docs = named.drop("own_id")
    met = written(_meet(_segments(docs, length)), "segments")
    equal = met.where("whole").select("doc_id", "version", F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("stop"))
    covered = equal.unionByName(_compared(docs, met.where("compare = 1"), length))
    many = met.where("compare = 2")
    if not many.isEmpty():
        covered = covered.unionByName(_windows(docs, many, length))
    spans = covered.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, kept, at, removed, n = (text or "").encode(), [], 0, 0, 0
                end = -1
                for s in found or ():
                    if s["begin"] > end:
                        kept.append(data[at : s["begin"]])
                        n += 1
                        removed -= s["begin"]
                        removed += s["stop"]
                        end = s["stop"]
                    elif s["stop"] > end:
                        removed += s["stop"] - end
                        end = s["stop"]
                    at = end
                kept.append(data[at:])
                whole = b"".join(kept)
                rows.append((len(data), removed, n, whole, hashlib.sha256(whole).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = named.join(spans, ["doc_id", "version"], "left").select("own_id", "text", "spans")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


# Bytes as pairs of hexadecimal digits; windows are taken from blocks, so no long text is walked for each of them.
OP2_SQL = f"""
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
    SELECT doc_id, b, substr(h, 2 * b + 1, {2 * (1000 + LENGTH - 1)}) AS part FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0), 1000)) AS b FROM d)
), windows AS (
    SELECT doc_id, b + i AS pos, md5(substr(part, 2 * i + 1, {2 * LENGTH})) AS w FROM (SELECT doc_id, b, part, unnest(range(0, least(1000, length(part) // 2 - {LENGTH - 1}))) AS i FROM blocks)
), twice AS (
    SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), marked AS (
    SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {LENGTH} THEN 0 ELSE 1 END AS opens FROM windows WHERE w IN (SELECT w FROM twice)
), spans AS (
    SELECT doc_id, span, min(pos) AS a, max(pos) + {LENGTH} AS z FROM (SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked) GROUP BY doc_id, span
), gaps AS (
    SELECT doc_id, span, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY span), 0) AS after, lead(a) OVER (PARTITION BY doc_id ORDER BY span) IS NULL AS is_last FROM spans
), kept AS (
    SELECT g.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * after + 1, 2 * (a - after)) || CASE WHEN is_last THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY span) AS h
    FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
