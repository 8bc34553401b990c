"""N-gram Jaccard join by prefix filtering and set-relation skipping.

A document's set is its distinct five-word shingles; documents with equal sets are one class.  Tokens
are ordered rare first by a sketch of ``2**CELL_BITS`` counters over the whole corpus (any order that
all share is exact; the sketch only keeps passages that many documents share out of the prefixes).
Two sets with Jaccard ``PERCENT`` or more share tokens of their prefixes, so they meet in those
tokens' lists.  The first set of a list in order of size is its pivot; every set of the list belongs
to the pivot's home, once however many lists lead there.  First only the prefix tokens that sets
share go to their homes: a linked pair shares a number of them that follows from its sizes, so sets
that merely hold a common passage drop out there.  Then the texts of those left go to the homes they
were left in, and all pairs of a home are decided:

* lists are sorted by set size, and each is entered at the first position a set's size allows;
* a set highly similar to the one just answered derives its overlaps from that one's: the lists of
  the tokens that differ are added or taken away, all others are skipped.

A home of more than ``BLOCK`` sets or ``BLOCK_TOKENS`` shingles is dealt over pairs of blocks, so no
task holds more than two blocks.  A pair of sets is counted in its first common home only.  Classes are joined to components
by label propagation in Spark.

Null or empty texts, and texts without words, have the empty set and are linked with nothing; fewer
words than five count as one shingle.  Repeated rows are copies, rows that repeat an id with another
text are documents of their own; a null id comes after all others.  Very long texts are compared
whole: blocks are bounded by their shingles too.  An empty table gives an empty result.  Only doc_id
and text are read.

Links are counted exactly, so a group of near copies of many different texts costs the square of its
texts; copies with equal sets cost nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import fresh, table, written
from docketry.llm.textbytes import Run, mix, runs

WORDS, PERCENT = 5, 75
CELL_BITS, CHUNK_BITS, SALTS = 22, 16, 32
#: Sets of a block, and shingles of a block's sets, before a home is dealt over more blocks.
BLOCK, BLOCK_TOKENS = 2_048, 1 << 22


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for run in runs(column, lower=True):
        starts, ends, first = run.words()
        hashes = Run.spans(run.prefix(), starts, ends)
        whole = hashes[: max(len(hashes) - WORDS + 1, 0)].copy()
        for k in range(1, WORDS):
            whole = mix(whole * np.uint64(3) + hashes[k : k + len(whole)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(whole[a : b - WORDS + 1])
            elif b > a:
                short = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    short = mix(short * np.uint64(5) + hashes[k : k + 1])
                yield short
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set (0 for the empty one)."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        key = mix(np.array([tokens.sum(dtype=np.uint64) * np.uint64(31) + np.bitwise_xor.reduce(mix(tokens)) + np.uint64(len(tokens))]))
    return int(key.view(np.int64)[0]) or 1


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def version_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def classes_and_sketch(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: (doc_id, version, n, key) of every row, and the counters of each task in packed chunks.
    ``version``, a hash of the text, tells rows apart that bear the same doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << CELL_BITS, dtype=np.uint32), set()
        names = ["doc_id", "version", "n", "key", "chunk", "salt", "packed"]
        for b in batches:
            ns, keys = [], []
            for tokens in shingles(b.column(1)):
                key = set_key(tokens)
                ns.append(len(tokens))
                keys.append(key)
                if key not in seen:
                    seen.add(key)
                    counts[_cells(tokens)] += 1  # distinct tokens of one set may share a cell; order is all that depends on it
            nothing = pa.nulls(len(ns), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), nothing, nothing, pa.nulls(len(ns), pa.binary())], names=names)
        if seen:
            parts = counts.reshape(-1, 1 << CHUNK_BITS)
            salt = TaskContext.get().partitionId() % SALTS
            n = len(parts)
            packed = [zlib.compress(p.tobytes(), 1) for p in parts]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array(packed, pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", version_of(F.col("text")).alias("version"))
    both = written(rows.mapInArrow(run, "doc_id long, version long, n long, key long, chunk int, salt int, packed binary"), "classes")
    return both.where("chunk IS NULL").select("doc_id", "version", "n", "key"), both.where("chunk IS NOT NULL").select("chunk", "salt", "packed")


def token_ranks(sketch: DataFrame) -> np.ndarray:
    """For each cell the power of two by which it exceeds twice the mean: 0 for all but frequent tokens.
    Chunks are summed salt by salt, then together; ``2**CELL_BITS`` bytes reach the driver, whatever the corpus."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << CHUNK_BITS, dtype=np.uint64)
        for x in f["packed"]:
            raw = zlib.decompress(x)
            total += np.frombuffer(raw, dtype=np.uint32 if len(raw) == 4 << CHUNK_BITS else np.uint64)
        return pd.DataFrame({"chunk": f["chunk"].iloc[:1], "salt": f["salt"].iloc[:1] * 0, "packed": [zlib.compress(total.tobytes(), 1)]})

    schema = "chunk int, salt int, packed binary"
    summed = sketch.groupBy("chunk", "salt").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    cells = np.zeros(1 << CELL_BITS, dtype=np.uint64)
    for row in summed.toLocalIterator():
        cells[row["chunk"] << CHUNK_BITS : (row["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(zlib.decompress(row["packed"]), dtype=np.uint64)
    usual = 2 * cells.mean() + 8
    return np.where(cells > usual, np.floor(np.log2(np.maximum(cells, 1) / usual)) + 1, 0).astype(np.uint8)


def _prefixes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(token, n, key): the prefix of every distinct set (once for each task that meets it)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for b in batches:
            tokens_of, ns, keys, full = [], [], [], 0
            for tokens in shingles(b.column(0)):
                key, n = set_key(tokens), len(tokens)
                if n == 0 or key in seen:
                    continue
                seen.add(key)
                size = n - -(-PERCENT * n // 100) + 1
                of = rank[_cells(tokens)]
                order = np.argsort(of, kind="stable")[:size] if of.any() else slice(size)  # tokens ascend already
                tokens_of.append(tokens[order])
                ns.append(n)
                keys.append(key)
                full += size
                if full > 1 << 17:
                    yield _rows(tokens_of, ns, keys)
                    tokens_of, ns, keys, full = [], [], [], 0
            if ns:
                yield _rows(tokens_of, ns, keys)

    return docs.select("text").mapInArrow(run, "token long, n int, key long")


def _rows(tokens_of: list[np.ndarray], ns: list[int], keys: list[int]) -> pa.RecordBatch:
    sizes = [len(t) for t in tokens_of]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens_of).view(np.int64)), pa.array(np.repeat(np.array(ns, dtype=np.int32), sizes)), pa.array(np.repeat(np.array(keys, dtype=np.int64), sizes))], names=["token", "n", "key"])


def _lists(prefixes: DataFrame) -> DataFrame:
    """(key, home, token, n): the members of every token's list of two or more sets, and the list's pivot, its smallest set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_token, pivot, last_key = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            token, n, key = (np.asarray(b.column(k)) for k in range(3))
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            fresh[0] = token[0] != last_token or key[0] != last_key
            first = np.ones(len(token), dtype=bool)
            first[1:] = token[1:] != token[:-1]
            first[0] = token[0] != last_token
            of = np.append(key[first], pivot)[np.cumsum(first) - 1]  # -1: goes on from the last batch
            # Some other member must be of a size that fits: in order of size, a neighbour.
            before, after = np.zeros(len(n), dtype=bool), np.ones(len(n), dtype=bool)
            fits = 100 * n[:-1].astype(np.int64) >= PERCENT * n[1:].astype(np.int64)
            before[1:] = ~first[1:] & fits
            before[0] = not first[0]
            after[:-1] = ~first[1:] & fits
            use = fresh & (before | after)
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (key, of, token, n)], names=["key", "home", "token", "n"])
            last_token, last_key, pivot = token[-1], key[-1], of[-1]

    ordered = prefixes.repartition("token").sortWithinPartitions("token", "n", "key")
    return ordered.mapInArrow(run, "key long, home long, token long, n int")


def _dealt(members: DataFrame) -> DataFrame:
    """A row of all homes of a set for each of its homes (key, home, n) and pair of blocks (a, b); homes of one set are left out."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")
    sizes = members.groupBy("home").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1").select("home", blocks.alias("blocks"))
    of = members.join(sizes, "home").groupBy("key").agg(F.collect_list(F.struct("home", "blocks")).alias("homes"))
    return of.select("key", F.col("homes.home").alias("homes"), F.explode("homes").alias("h")).select("key", "homes", "h.home", F.pmod(F.xxhash64("key"), F.col("h.blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("h.blocks") - 1).cast("array<long>")).alias("other")).select(
        "key", "homes", "home", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    )


def _needed(n: np.ndarray, m: int) -> np.ndarray:
    """The least number of tokens that prefixes of sets of sizes n and m share if the sets are linked: of the overlap
    that is asked for, what the larger set's tokens beyond its prefix cannot hold."""
    overlap = -(-PERCENT * (n + m) // (100 + PERCENT))
    return overlap + 1 - -(-PERCENT * np.maximum(n, m) // 100)


def _may_link(keys: np.ndarray, side: np.ndarray, across: bool, sizes: np.ndarray, homes: list[np.ndarray], home: int, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which sets of a home share enough prefix tokens with another, in a pair whose first common home this is."""
    m, live = len(keys), np.zeros(len(keys), dtype=bool)
    row = np.repeat(np.arange(m), np.diff(at))
    ids = np.unique(tokens, return_inverse=True)[1].ravel()
    by = np.argsort(ids, kind="stable")
    rows, list_at = row[by], np.append(0, np.cumsum(np.bincount(ids)))
    for i in range(m):
        own = ids[at[i] : at[i + 1]]
        size = list_at[own + 1] - list_at[own]
        begin = np.cumsum(size) - size
        entries = rows[np.repeat(list_at[own] - begin, size) + np.arange(size.sum())]
        count = np.bincount(entries, minlength=m)
        partner = count >= _needed(sizes, int(sizes[i]))
        partner &= (100 * sizes >= PERCENT * sizes[i]) & (PERCENT * sizes <= 100 * sizes[i])
        partner[i] = False
        if across:
            partner &= side != side[i]
        mine = None
        for j in np.flatnonzero(partner).tolist():
            if live[i] and live[j]:
                continue
            mine = mine if mine is not None else set(homes[i].tolist())
            if min(mine.intersection(homes[j].tolist())) == home:
                live[i] = live[j] = True
    return live


def _candidates(lists: DataFrame) -> DataFrame:
    """(key, home, n) of the sets that a home's prefix tokens leave as possible partners.  Only tokens move, no texts."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        keys, home, block, a, b, n = (t.column(c).to_numpy() for c in ("key", "home", "block", "a", "b", "n"))
        lists_of = lambda c: (t.column(c).chunk(0).flatten().to_numpy(), np.append(0, np.cumsum(t.column(c).chunk(0).value_lengths().to_numpy())))
        (tokens, at), (all_homes, homes_at) = lists_of("tokens"), lists_of("homes")
        cut = np.flatnonzero(np.append(True, (home[1:] != home[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        use = np.zeros(len(keys), dtype=bool)
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
            if y - x > 1:
                own = [all_homes[homes_at[i] : homes_at[i + 1]] for i in range(x, y)]
                use[x:y] = _may_link(keys[x:y], block[x:y], bool(a[x] != b[x]), n[x:y].astype(np.int64), own, int(home[x]), tokens[at[x] : at[y]], at[x : y + 1] - at[x])
        return pa.RecordBatch.from_arrays([pa.array(keys[use]), pa.array(home[use]), pa.array(n[use])], names=["key", "home", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = lambda b, i: tuple(b.column(b.schema.get_field_index(c))[i].as_py() for c in ("home", "a", "b"))
        for b in batches:
            if not b.num_rows:
                continue
            last = group(b, b.num_rows - 1)
            home, x, y = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("home", "a", "b"))
            cut = int(np.argmax((home == last[0]) & (x == last[1]) & (y == last[2])))
            if cut or held and group(held[-1], 0) != last:
                if held or cut:
                    yield settle([*held, b.slice(0, cut)] if cut else held)
                held = []
            held.append(b.slice(cut))
        if held:
            yield settle(held)

    members = lists.select("key", "home", "n").distinct()
    tokens = lists.groupBy("key").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens"))
    rows = _dealt(members).join(tokens, "key").select("key", "home", "block", "a", "b", "n", "tokens", "homes")
    ordered = rows.repartition("home", "a", "b").sortWithinPartitions("home", "a", "b")
    return ordered.mapInArrow(run, "key long, home long, n int").distinct()


def _decide(keys: np.ndarray, side: np.ndarray, across: bool, weight: np.ndarray, homes: list[set[int]], home: int, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For the sets of a home (of one block, or ``across`` two told apart by ``side``): each set's root among
    those linked to it, and the rows it is linked with in pairs whose first common home this is."""
    order = np.lexsort((keys, [len(s) for s in sets]))
    sets, sizes, m = [sets[i] for i in order], np.array([len(sets[i]) for i in order]), len(order)
    side = side[order]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    by = np.argsort(ids, kind="stable")
    list_at = np.searchsorted(ids[by], np.arange(ids.max() + 2))
    rows = row[by]  # each list in order of set size
    set_at = np.concatenate([[0], np.cumsum(sizes)])
    long_lists = np.diff(list_at) > 1
    root, linked = np.arange(m), np.zeros(m, dtype=np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def entries(tokens: np.ndarray, low: int) -> np.ndarray:
        parts = []
        for t in tokens[long_lists[tokens]].tolist():
            part = rows[list_at[t] : list_at[t + 1]]
            parts.append(part[np.searchsorted(part, low) :] if low else part)
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    done, at, count, tokens = np.zeros(m, dtype=bool), -1, None, None
    for start in range(m):
        i = start
        while i >= 0 and not done[i]:
            own = ids[set_at[i] : set_at[i + 1]]
            low = int(np.searchsorted(sizes, -(-PERCENT * sizes[i] // 100)))  # smaller sets cannot be partners
            if at >= 0 and count is not None and low >= at:
                taken, given = np.setdiff1d(tokens, own, assume_unique=True), np.setdiff1d(own, tokens, assume_unique=True)
            else:
                taken, given = None, own
            if taken is not None and len(taken) + len(given) < len(own):
                count = count + np.bincount(entries(given, at), minlength=m) - np.bincount(entries(taken, at), minlength=m)
            else:
                count, at = np.bincount(entries(own, low), minlength=m), low
            tokens = own
            overlap = count.copy()
            overlap[:low] = 0
            union = sizes[i] + sizes - overlap
            partner = (100 * overlap >= PERCENT * union) & (overlap > 0)
            partner[i] = False
            if across:
                partner &= side != side[i]
            done[i] = True
            near = np.flatnonzero(partner)
            for j in near.tolist():
                if j > i or not done[j]:
                    a, b = find(i), find(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                mine, theirs = homes[order[i]], homes[order[j]]
                if min(mine & theirs) == home:
                    linked[i] += weight[order[j]]
            rest = near[~done[near]]
            i = int(rest[np.argmax(overlap[rest] - sizes[rest] / 2)]) if len(rest) else -1
            if i >= 0 and i < start:
                i = -1
    out_root, out_linked = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for k in range(m):
        out_root[order[k]], out_linked[order[k]] = order[find(k)], linked[k]
    return out_root, out_linked


def _links(docs: DataFrame, candidates: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, root, linked) for every set of every home of ``candidates`` (key, home, n); ``copies``: doc_id, version, key, weight.
    A text is found by its id and its version, so many texts under one id, or none, do not meet each other's sets."""

    def decide(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["key", "text"])
        sets = list(shingles(pa.array(f["text"], pa.string())))
        good = np.array([set_key(x) == k for x, k in zip(sets, f["key"].tolist(), strict=True)])  # another text may bear the same doc_id
        good[good] = ~f["key"][good].duplicated().to_numpy()
        f, sets = f[good], [x for x, g in zip(sets, good, strict=True) if g]
        keys, side = f["key"].to_numpy(np.int64), f["block"].to_numpy()
        if len(f) < 2:
            return pd.DataFrame({"key": [], "root": [], "linked": []}).astype("int64")
        root, linked = _decide(keys, side, bool(f["a"].iloc[0] != f["b"].iloc[0]), f["weight"].to_numpy(np.int64), [set(h) for h in f["homes"]], int(f["home"].iloc[0]), sets)
        return pd.DataFrame({"key": keys, "root": keys[root], "linked": linked})

    dealt = _dealt(candidates).join(copies, "key")
    wanted = dealt.groupBy(F.col("doc_id").alias("of"), F.col("version").alias("of_version")).agg(F.collect_list(F.struct("key", "weight", "homes", "home", "block", "a", "b")).alias("to"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", version_of(docs["text"]).alias("version"))
    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")))
    return joined.select("text", F.explode("to").alias("to")).select("text", "to.*").groupBy("home", "a", "b").applyInPandas(decide, "key long, root long, linked long")


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of every node of ``edges`` (key, root): the smallest key reachable.  Each round takes the least
    label around a node, then the label's own label; rounds double the reach of a label along stars."""
    both = written(edges.select("key", "root").unionByName(edges.select(F.col("root").alias("key"), F.col("key").alias("root"))).distinct(), "edges")
    labels = written(both.groupBy("key").agg(F.min("root").alias("root")).select("key", F.least("key", "root").alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("key", "root"), "root").groupBy("key").agg(F.min("label").alias("near"))
        lower = labels.join(around, "key").select("key", "label", F.least("label", "near").alias("next"))
        jumped = lower.join(labels.select(F.col("key").alias("next"), F.col("label").alias("beyond")), "next").select("key", "label", F.least("next", "beyond").alias("next"))
        done = written(jumped, "labels")
        labels = done.select("key", F.col("next").alias("label"))
        if done.where("next <> label").isEmpty():
            return labels


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, n, key) of every row, and (key, label, component_id, n_links) of every set that is not empty."""
    classes, sketch = classes_and_sketch(docs)
    lists = written(_lists(_prefixes(docs, token_ranks(sketch))), "lists")
    candidates = written(_candidates(lists), "candidates")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("first")
    copies = classes.where("n > 0").groupBy("key").agg(first, F.count("*").alias("weight")).select("key", "first.doc_id", "first.version", "weight")
    found = written(_links(docs, candidates, copies), "links")
    labels = components(found.where("key <> root").select("key", "root"))
    counted = found.groupBy("key").agg(F.sum("linked").alias("linked"))
    named = copies.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")).join(counted, "key", "left")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return classes, named.join(smallest, "label").select("key", "label", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents linked with it, copies included) of every row."""
    classes, by_key = labelled(docs)
    own = F.col("n") == 0
    return classes.join(by_key, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, 0).otherwise(F.col("n_links")).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest doc_id (a null id comes last), then the
    least hash of its text; of rows equal in both, any one.  Rows without words are linked with nothing and all stay."""
    classes, by_key = labelled(docs)
    rows = classes.groupBy("doc_id", "version", "n", "key").agg(F.count("*").alias("times"))
    words = rows.where("n > 0")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "times")).alias("first")
    # A set that a third of all rows share is one row before it meets its label.
    first = words.groupBy("key").agg(order).join(by_key.select("key", "label"), "key").groupBy("label").agg(F.min("first").alias("first"))
    without = rows.where("n = 0").select("doc_id", "version", F.lit(1).alias("times"))
    id_of, version, times = (fresh(docs, c) for c in ("stays_id", "stays_version", "stays_times"))
    stays = written(first.select("first.doc_id", "first.version", "first.times").unionByName(without).toDF(id_of, version, times), "stays")

    def kept(of: DataFrame) -> DataFrame:
        return docs.join(of, docs["doc_id"].cast("long").eqNullSafe(of[id_of]) & (version_of(docs["text"]) == of[version]))

    out = kept(stays.where(F.col(times) == 1)).select(*docs.columns)
    again = stays.where(F.col(times) > 1)
    return out if again.isEmpty() else out.unionByName(kept(again).dropDuplicates([id_of, version]).select(*docs.columns))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingled AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - {WORDS - 1}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')) END) AS s FROM worded
), tokens AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS token FROM shingled
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id, (SELECT count(*) FROM links WHERE x = doc_id)::BIGINT AS n_links FROM shingled
"""
