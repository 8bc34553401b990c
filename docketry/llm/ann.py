"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Rotations are learned on a sample of at most ``MAX_FIT`` vectors (those with the smallest hash of their
row): principal directions, then alternating signs and orthogonal fits from
several starts until ``BITS`` bits are there.  Signs of the rotated vector are its code.  Codes are cut
into substrings of 16 bits, and every vector is indexed by each of them.  If two codes differ in at
most r bits, some substring j differs in at most its share of r (the pigeonhole), so a query probes the
buckets whose substring lies within that share and retrieves every code within r.  Retrieved codes
farther than a second radius in all bits go; what is left is reranked by cosine in double precision.
Both radii come from ``FIT_QUERIES`` rows of the sample and their true neighbours in the whole table, found
in one pass over it: the first is the least whose probes find ``FOUND`` of them, the second holds ``NEAR``.

A bucket key is the first ``PREFIX`` bits of a substring, or as many more as leave ``GROUP_ROWS`` codes to a
bucket; the rest of the substring is compared inside.  Only codes move to the buckets, vectors meet
after the second radius.  A bucket of over ``HOT_ROWS`` codes is salted by its own size; queries
stream past a bucket's codes, so their number is not bounded.  A pair is reported by the first
substring that finds it.  Queries that find fewer than k rows search again with wider radii, at last
with one that takes in every code.

Every row is a query or candidate of its own, known by a row number: a query never meets its own row,
but rows that repeat its id or vector are candidates.  Equal vectors are one index entry with their k+1
smallest ids (all that can ever be returned), so a vector held by a third of all rows costs one entry.
Vectors of any finite length count alike: they are scaled by powers of two before anything is squared.
Distinct vectors too close for their codes to differ are all reranked, against the queries among them.
Rows with a null id, null or zero vectors, those with null or non-finite components or another
dimension than the sample's commonest take no part.  Ties go to the smaller id.  An empty table gives
no rows.  Only vec_id, vector and what ``is_query`` names are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import table, written

MAX_FIT, FIT_QUERIES, ROUNDS = 4_096, 256, 10
BITS, SUB_BITS, FOUND, NEAR, K = 256, 16, 0.97, 0.98, 5
#: Codes that a bucket is to hold, codes from which on it is salted, queries met at once, and bits of a bucket key.
GROUP_ROWS, HOT_ROWS, STEP, PREFIX = 4_096, 16_384, 128, 8
WORDS = ["c0", "c1", "c2", "c3"]
#: Shares that are added when a query found too few; the last takes in every code.
WIDER = (1, 3, 7, SUB_BITS)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to about 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """A learned coder: ``centre``, ``directions`` (dimension x bits), ``radius`` for probes, ``reach`` for whole codes."""

    def __init__(self, centre: np.ndarray, directions: np.ndarray, radius: int, reach: int):
        self.centre, self.directions, self.bits, self.radius, self.reach = centre, directions, directions.shape[1], radius, reach
        self.m = max(1, -(-self.bits // SUB_BITS))

    def shares(self, radius: int) -> list[int]:
        """Sub-radii that leave no pair within ``radius`` out: radius - m + 1 bits in all, dealt evenly (-1: none)."""
        whole, rest = divmod(radius - self.m + 1, self.m)
        return [min(whole + (j < rest), SUB_BITS) for j in range(self.m)]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Four words a row; bits that are not there are 0."""
        bits = np.zeros((len(x), BITS), dtype=np.uint8)
        bits[:, : self.bits] = (unit(x) - self.centre) @ self.directions > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def subs(codes: np.ndarray) -> np.ndarray:
    """The substrings of codes, one a column."""
    return np.ascontiguousarray(codes).view("<u2")


def _rotation(low: np.ndarray, seed: int) -> np.ndarray:
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(low.shape[1], low.shape[1])))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ w).T
    return turn


def fit(x: np.ndarray) -> Codes:
    """Codes for the sample ``x``; their radii take in everything."""
    directions = unit(x)
    centre = directions.mean(axis=0)
    size = min(BITS, x.shape[1])
    _, _, v = np.linalg.svd(directions - centre, full_matrices=False)
    axes = np.zeros((x.shape[1], size))
    axes[:, : min(size, len(v))] = v[:size].T
    low = (directions - centre) @ axes
    return Codes(centre, np.concatenate([axes @ _rotation(low, seed) for seed in range(BITS // size)], axis=1), BITS + SUB_BITS, BITS)


def calibrate(coder: Codes, asked: np.ndarray, query: np.ndarray, found: np.ndarray) -> None:
    """Set the radii so that probes and whole codes hold the true neighbours ``found`` (codes) of ``asked[query]``."""
    apart = np.bitwise_count(subs(asked)[query] ^ subs(found))[:, : coder.m].astype(int)
    coder.reach = int(np.quantile(apart.sum(axis=1), NEAR, method="higher"))
    coder.radius = next(r for r in range(coder.m - 1, BITS + SUB_BITS + 1) if (apart <= coder.shares(r)).any(axis=1).mean() >= FOUND)


def true_neighbours(rows: DataFrame, coder: Codes, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, code) of the k nearest of a few vectors ``asked`` in the whole table, vectors equal to them apart."""
    own = unit(asked)
    dimension = own.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, codes = np.full((len(own), 0), 0.0), np.zeros((len(own), 0, len(WORDS)), dtype="<u8")
        for b in batches:
            if b.num_rows:
                x = _vectors(b, 0, dimension)
                near = own @ unit(x).T
                near[near > 1 - 1e-9] = -np.inf
                some = np.argpartition(-near, min(k, len(x)) - 1, axis=1)[:, :k]
                both = np.concatenate([best, np.take_along_axis(near, some, axis=1)], axis=1)
                all_codes = np.concatenate([codes, coder.encode(x)[some]], axis=1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best, codes = np.take_along_axis(both, top, axis=1), np.take_along_axis(all_codes, top[:, :, None], axis=1)
        q, i = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, i]), *_words(codes[q, i])], names=["query", "score", *WORDS])

    each = rows.select("vector").mapInArrow(run, "query long, score double, " + ", ".join(f"{c} long" for c in WORDS))
    order = Window.partitionBy("query").orderBy(F.desc("score"), *WORDS)
    top = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", *WORDS).toArrow()
    return top.column("query").to_numpy(), np.column_stack([top.column(c).to_numpy().view("<u8") for c in WORDS])


def _valid(vector: str) -> Column:
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)


def _vectors(b: pa.RecordBatch, column: int, dimension: int) -> np.ndarray:
    return np.asarray(b.column(column).flatten(), dtype="<f8").reshape(-1, dimension) + 0.0  # -0.0 becomes 0.0


def _words(codes: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(codes[:, i]).view("<i8")) for i in range(len(WORDS))]


def entries(rows: DataFrame, coder: Codes, keep_ids: int) -> DataFrame:
    """entry, code, vector (binary doubles) and the ``keep_ids`` smallest (vec_id, uid) of every distinct vector."""
    dimension = len(coder.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            uids, ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _vectors(b, 2, dimension)
            raw = np.ascontiguousarray(x).view(f"V{8 * dimension}").ravel()
            order = np.lexsort((uids, ids, np.unique(raw, return_inverse=True)[1]))
            new = np.append(True, raw[order][1:] != raw[order][:-1])
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            few = order[rank < keep_ids]
            yield pa.RecordBatch.from_arrays([*_words(coder.encode(x[few])), pa.array([v.tobytes() for v in x[few]], pa.binary()), pa.array(ids[few]), pa.array(uids[few])], names=[*WORDS, "vector", "vec_id", "uid"])

    each = rows.select("uid", "vec_id", "vector").mapInArrow(run, ", ".join(f"{c} long" for c in WORDS) + ", vector binary, vec_id long, uid long")
    gathered = each.groupBy(*WORDS, "vector").agg(F.slice(F.array_sort(F.collect_set(F.struct("vec_id", "uid"))), 1, keep_ids).alias("ids"))
    return gathered.withColumn("entry", F.monotonically_increasing_id())


def _at_most(bits: int) -> Callable[[Column], Column]:
    return lambda x: F.bit_count(x) <= bits


def probe(index: DataFrame, queries: DataFrame, coder: Codes, n: int, shares: list[int], reach: int, compared: Accumulator | None = None) -> DataFrame:
    """(uid, entry) of every pair that some substring retrieves and that differs in at most ``reach`` bits.

    ``index`` (entry, code) holds ``n`` codes, ``queries`` are (uid, code); ``compared`` counts whole codes compared."""
    prefix = min(SUB_BITS, max(PREFIX, int(np.ceil(np.log2(max(n / GROUP_ROWS, 1))))))
    low = (1 << prefix) - 1
    places = [j for j in range(coder.m) if shares[j] >= 0]
    head = lambda j: F.shiftrightunsigned(F.col(WORDS[j // 4]), SUB_BITS * (j % 4)).bitwiseAND(F.lit(low))
    # Only prefixes within the substring's share can hold a match: the query's own, altered by these masks.
    masks = {share: F.filter(F.sequence(F.lit(0), F.lit(low)), _at_most(share)) for share in set(shares)}
    cells = F.array(*(F.struct(F.lit(j).alias("j"), head(j).alias("head")) for j in places))
    near = lambda j: F.transform(masks[shares[j]], lambda x: F.struct(F.lit(j).alias("j"), head(j).bitwiseXOR(x.cast("long")).alias("head")))
    probes = F.concat(*map(near, places))
    at = lambda df, name, where, side: df.select(F.explode(where).alias("cell"), F.col(name).alias("id"), *WORDS).select("cell.j", "cell.head", F.lit(side).alias("side"), "id", *WORDS)
    indexed, asked = at(index, "entry", cells, 0), at(queries, "uid", probes, 1)
    sizes = indexed.groupBy("j", "head").agg(F.count("*").alias("size")).where(F.col("size") > HOT_ROWS)
    # At most one row a bucket key: coder.m << SUB_BITS of them, some 16 MB, whatever the table's size.
    hot = F.broadcast(written(sizes.select("j", "head", F.ceil(F.col("size") / HOT_ROWS).cast("int").alias("salts")), "hot"))
    salted = indexed.join(hot, ["j", "head"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    spread = asked.join(hot, ["j", "head"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    columns = ["j", "head", "salt", "side", "id", *WORDS]
    ordered = salted.select(*columns).unionByName(spread.select(*columns)).repartition("j", "head", "salt").sortWithinPartitions("j", "head", "salt", "side")
    limits = np.array(shares)

    def meet(j: int, ids: np.ndarray, codes: np.ndarray, asking: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        directory, slot = np.unique(subs(codes)[:, j], return_inverse=True)
        by = np.argsort(slot, kind="stable")
        begin = np.append(0, np.cumsum(np.bincount(slot, minlength=len(directory))))
        for i in range(0, len(asking), STEP):
            q, d = np.nonzero(np.bitwise_count(subs(own[i : i + STEP])[:, j][:, None] ^ directory) <= shares[j])
            size = begin[d + 1] - begin[d]
            q = np.repeat(q, size) + i
            e = by[np.repeat(begin[d] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            if compared is not None:
                compared.add(len(e))
            away = np.bitwise_count(own[q] ^ codes[e]).sum(axis=1, dtype=np.int32)
            q, e = q[away <= reach], e[away <= reach]
            # The first substring that finds a pair reports it.
            earlier = [p for p in places if p < j]
            fresh = ~(np.bitwise_count(subs(own[q])[:, earlier] ^ subs(codes[e])[:, earlier]) <= limits[earlier]).any(axis=1)
            yield asking[q[fresh]], ids[e[fresh]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, codes = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([np.asarray(b.column(i)).astype(np.int64) for i in range(4)])
            own, code = np.asarray(b.column(4)), np.column_stack([np.asarray(b.column(5 + i)).view("<u8") for i in range(len(WORDS))])
            cut = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
                here, side = tuple(key[x, :3].tolist()), int(key[x, 3])
                if here != bucket:
                    bucket, ids, codes = here, [], []
                if not side:
                    ids.append(own[x:y])
                    codes.append(code[x:y])
                elif ids:
                    if len(ids) > 1:
                        ids, codes = [np.concatenate(ids)], [np.concatenate(codes)]
                    for asking, met in meet(here[0], ids[0], codes[0], own[x:y], code[x:y]):
                        if len(met):
                            yield pa.RecordBatch.from_arrays([pa.array(asking), pa.array(met)], names=["uid", "entry"])

    return ordered.mapInArrow(run, "uid long, entry long")


def rerank(pairs: DataFrame, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of every query among ``pairs``, by cosine of the original vectors."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (scaled(np.frombuffer(b"".join(b.column(i).to_pylist()), dtype="<f8").reshape(b.num_rows, -1)) for i in (2, 3))
                cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosine), b.column(4)], names=["uid", "query_id", "score", "ids"])

    vectors = index.select("entry", F.col("vector").alias("other"), "ids")
    met = pairs.join(vectors, "entry").join(queries.select("uid", "query_id", "vector"), "uid").select("uid", "query_id", "vector", "other", "ids")
    scored = met.mapInArrow(score, "uid long, query_id long, score double, ids array<struct<vec_id:bigint,uid:bigint>>")
    each = scored.select("uid", "query_id", "score", F.explode("ids").alias("of")).where("of.uid <> uid").select("uid", "query_id", "score", "of.vec_id")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("uid", "query_id", "rank", "vec_id", "score")


def _sample(rows: DataFrame, n: int, max_fit: int) -> np.ndarray:
    """Vectors of the commonest dimension among at most ``max_fit`` rows."""
    hashed = F.pmod(F.xxhash64("vec_id", "uid"), F.lit(1 << 20))
    share = min(1.0, 1.2 * max_fit / max(n, 1))
    drawn = rows.where(hashed <= int(share * (1 << 20))).select("vector", hashed.alias("h"), "vec_id", "uid").orderBy("h", "vec_id", "uid").limit(max_fit).toArrow()
    column = drawn.column("vector").combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if not len(sizes):
        return np.zeros((0, 0))
    dimension = int(np.bincount(sizes).argmax())
    return np.asarray(column.filter(pa.array(sizes == dimension)).flatten(), dtype="<f8").reshape(-1, dimension)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, max_fit: int = MAX_FIT, compared: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, vector: array of numbers) where ``is_query`` holds."""
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & _valid("vector"))
    rows = written(valid.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    sample = _sample(rows, rows.count(), max_fit)
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder, dimension = fit(sample), sample.shape[1]
    rows = rows.where(F.size("vector") == dimension)
    asked_by = sample[:FIT_QUERIES]
    query, near = true_neighbours(rows, coder, asked_by, k)
    if len(query):
        calibrate(coder, coder.encode(asked_by), query, near)
    index, n_rows = written(entries(rows, coder, k + 1), "codes"), rows.count()
    n = index.count()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b, 2, dimension)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_words(coder.encode(x)), pa.array([v.tobytes() for v in x], pa.binary())], names=["uid", "query_id", *WORDS, "vector"])

    asked = rows.where("asks").select("uid", F.col("vec_id").alias("query_id"), "vector")
    queries = written(asked.mapInArrow(coded, "uid long, query_id long, " + ", ".join(f"{c} long" for c in WORDS) + ", vector binary"), "queries")
    done, wanted, shares = [], min(k, n_rows - 1), coder.shares(coder.radius)
    for more in (0, *WIDER) if n_rows > 4 * k else (SUB_BITS,):
        wide = [min(s + more, SUB_BITS) for s in shares]
        found = written(rerank(probe(index, queries, coder, n, wide, min(coder.reach + coder.m * more, BITS), compared), index, queries, k), "found")
        enough = found.where(F.col("rank") == wanted).select("uid")
        done.append(found.join(enough, "uid", "left_semi"))
        if more == SUB_BITS:
            break
        queries = written(queries.join(enough, "uid", "left_anti"), "short")
        if queries.isEmpty():
            break
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out.select("query_id", "rank", "vec_id", "score")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), F.col("vec_id") % 50 == 0)
