"""Line dedup by distinct-site spread.

Each non-blank line is known by the hash of its trimmed text.  A HyperLogLog sketch of the sites a
line appears on is kept per line hash and merged by aggregation (partial sketches are built before
the shuffle, so a line on a third of all pages costs one row a task).  Lines whose estimate lies
within ``BAND`` of the threshold get an exact distinct count.  Lines on ``MIN_SITES`` sites or more
are boilerplate and go from every document; the first occurrence (smallest doc_id, then place)
stays, so text that only exists as copies is not lost.

A row is known by its doc_id and the hash of its text: rows that repeat an id with another text are
documents of their own, equal rows share their fate, and a null id is an id that comes after all
others.  Null text counts as empty; a null source is a site of its own.  Blank lines are never
removed; very long texts and lines are handled whole.  An empty table gives an empty result; only
doc_id, text and source are read, other columns pass through :func:`dedup` unchanged (n_chars is set
anew where present).

A boilerplate line may stand on a third of all rows.  Up to ``BROADCAST_ROWS`` boilerplate lines are
sent to every task (two numbers each, some 100 MB); more of them are joined salted, so no task meets
all rows of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import fresh, table, written

MIN_SITES = 10
#: Three standard errors of a sketch with 2**12 registers are 4.9 %; the band is far wider.
BAND, LG_K = 0.25, 12
BLANK = " \t\r\f\v"
#: Boilerplate lines that are broadcast at most, and salts beyond.
BROADCAST_ROWS, SALTS = 1 << 20, 32


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(df: DataFrame) -> list[Column]:
    """What a row is known by: doc_id, and the hash of its text."""
    return [df["doc_id"], F.xxhash64(F.coalesce(df["text"], F.lit("")))]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), site, place (from 0) and key of every non-blank line."""
    doc_id, version = _row(docs)
    each = docs.select(doc_id, version.alias("version"), F.coalesce("source", F.lit("\x00")).alias("site"), F.posexplode(_split(F.col("text"))).alias("place", "line"))
    trimmed = each.select("doc_id", "version", "site", "place", F.btrim("line", F.lit(BLANK)).alias("line"))
    return trimmed.where("line <> ''").select("doc_id", "version", "site", "place", F.xxhash64("line").alias("key"))


def _met(each: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``each`` joined with the written table ``keys`` on key: by broadcast up to ``BROADCAST_ROWS`` keys, else salted."""
    if keys.count() <= BROADCAST_ROWS:
        return each.join(F.broadcast(keys), "key", how)
    salted = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "version", "place"), F.lit(SALTS)))
    spread = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(spread, ["key", "salt"], how).drop("salt")


def boilerplate(each: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key and first (the row that keeps it) of the lines that are found on ``min_sites`` sites or more, as a written table."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("first")
    spread = each.groupBy("key").agg(F.count("*").alias("n"), first, F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.where(F.col("n") >= min_sites)  # fewer occurrences than sites cannot be
    estimate = F.hll_sketch_estimate("sketch")
    likely = written(spread.select("key", "first", estimate.alias("sites")).where(F.col("sites") > min_sites * (1 - BAND)), "spread")
    sure = likely.where(F.col("sites") >= min_sites * (1 + BAND))
    near = likely.where(F.col("sites") < min_sites * (1 + BAND))
    exact = _met(each, near.select("key"), "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return written(sure.select("key", "first").unionByName(near.join(exact, "key", "left_semi").select("key", "first")), "boilerplate")


def dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from text, and a struct ``line_dedup`` of n_lines and n_removed."""
    each = lines(docs)
    hits = _met(each, boilerplate(each, min_sites), "inner").groupBy("doc_id", "version", "key", "first").agg(F.array_sort(F.collect_set("place")).alias("places"))
    keeps = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    gone = F.when(keeps, F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0)))).otherwise(F.col("places"))
    id_of, version_of, gone_of = (fresh(docs, n) for n in ("drop_doc", "drop_version", "drop_lines"))
    drops = hits.select(F.col("doc_id").alias(id_of), F.col("version").alias(version_of), gone.alias("gone")).groupBy(id_of, version_of).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias(gone_of))
    doc_id, version = _row(docs)
    joined = docs.join(drops, doc_id.eqNullSafe(drops[id_of]) & (version == drops[version_of]), "left")
    all_lines, some = _split(F.col("text")), F.size(F.col(gone_of)) > 0
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(gone_of))
    kept = F.transform(stay, lambda i: F.get(all_lines, i))
    text = F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text"))
    counts = F.struct(F.size(all_lines).cast("long").alias("n_lines"), F.when(some, F.size(gone_of)).otherwise(0).cast("long").alias("n_removed"))
    out = {c: docs[c] for c in docs.columns} | {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*(v.alias(c) for c, v in out.items()), counts.alias("line_dedup"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH each AS (
    SELECT doc_id, source, place, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line, line AS whole
    FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)
), spread AS (
    SELECT line, arg_min({{'d': doc_id, 'p': place}}, {{'d': doc_id, 'p': place}}) AS first FROM each WHERE line <> ''
    GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}
), marked AS (
    SELECT e.doc_id, e.place, e.whole, s.line IS NOT NULL AND NOT (s.first.d = e.doc_id AND s.first.p = e.place) AS gone
    FROM each e LEFT JOIN spread s ON e.line = s.line
), texts AS (
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed, coalesce(string_agg(whole, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars, sha256(text) AS kept_sha256 FROM texts
"""
