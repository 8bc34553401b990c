"""Scoring runs against benchmarks: both sides are DataFrames of occurrences (document, start, end, identity)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claims(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(document, identity, expected_start, observed_start): each expected occurrence, in order, claims the first
    unclaimed observed one of its document and identity that overlaps it.  Where both sides have ``courts`` (an array,
    null for what is no docket), dockets must have a court in common too."""
    columns = ["document", "identity", "start", "end"]
    if "courts" in expected.columns and "courts" in observed.columns:
        columns.append("courts")
    else:
        expected, observed = expected.withColumn("courts", F.lit(None).cast("array<string>")), observed.withColumn("courts", F.lit(None).cast("array<string>"))
        columns.append("courts")
    both = expected.select(*columns).withColumn("side", F.lit(0)).unionByName(observed.select(*columns).withColumn("side", F.lit(1)))

    def claim(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("start", kind="stable")
        found = list(f.loc[f["side"] == 1, ["start", "end", "courts"]].itertuples(index=False))
        name, identity = f["document"].iloc[0], f["identity"].iloc[0]
        # A sweep: what has begun and may still be claimed is ``live``; what ends before one that is expected is over for all later ones.
        out, claimed, live, begun = [], set(), [], 0
        for a, b, courts in f.loc[f["side"] == 0, ["start", "end", "courts"]].itertuples(index=False):
            while begun < len(found) and found[begun][0] < b:
                live.append(begun)
                begun += 1
            hit, rest = None, []
            for i in live:
                start, end, own = found[i]
                meets = own is None and courts is None or own is not None and courts is not None and not set(own).isdisjoint(courts)
                if hit is None and a < end and start < b and meets:
                    hit = i
                elif a < end:
                    rest.append(i)
            live = rest
            claimed.add(hit)
            out.append((name, identity, a, None if hit is None else found[hit][0]))
        out += [(name, identity, None, x[0]) for i, x in enumerate(found) if i not in claimed]
        return pd.DataFrame(out, columns=["document", "identity", "expected_start", "observed_start"]).astype({"expected_start": "Int64", "observed_start": "Int64"})

    # Most identities are found once in a document on either side at most: they need no order, and no Python.
    one = lambda side, column: F.min(F.when(F.col("side") == side, F.col(column)))
    counts = [F.count(F.when(F.col("side") == side, 1)).alias(name) for side, name in ((0, "n_expected"), (1, "n_observed"))]
    groups = both.groupBy("document", "identity").agg(*counts, one(0, "start").alias("a"), one(0, "end").alias("b"), one(1, "start").alias("c"), one(1, "end").alias("d"), F.first(F.when(F.col("side") == 0, F.col("courts")), ignorenulls=True).alias("e_courts"), F.first(F.when(F.col("side") == 1, F.col("courts")), ignorenulls=True).alias("o_courts"))
    plain = (F.col("n_expected") <= 1) & (F.col("n_observed") <= 1)
    same_court = (F.col("e_courts").isNull() & F.col("o_courts").isNull()) | F.coalesce(F.arrays_overlap("e_courts", "o_courts"), F.lit(False))
    meet = (F.col("a") < F.col("d")) & (F.col("c") < F.col("b")) & same_court
    pair = lambda x, y: F.struct(x.cast("long").alias("expected_start"), y.cast("long").alias("observed_start"))
    nothing = F.lit(None)
    outcomes = F.when(meet, F.array(pair(F.col("a"), F.col("c")))).otherwise(F.filter(F.array(pair(F.col("a"), nothing), pair(nothing, F.col("c"))), lambda x: x["expected_start"].isNotNull() | x["observed_start"].isNotNull()))
    settled = groups.where(plain).select("document", "identity", F.explode(outcomes).alias("x")).select("document", "identity", "x.*")
    document = expected.schema["document"].dataType.simpleString()
    ordered = both.join(groups.where(~plain).select("document", "identity"), ["document", "identity"], "left_semi")
    return settled.unionByName(ordered.groupBy("document", "identity").applyInPandas(claim, f"document {document}, identity string, expected_start long, observed_start long"))


def scores(claimed: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1; 0 where a quotient has no base."""
    e, o = F.col("expected_start").isNotNull(), F.col("observed_start").isNotNull()
    counts = claimed.agg(F.count(F.when(e & o, 1)).alias("tp"), F.count(F.when(~e & o, 1)).alias("fp"), F.count(F.when(e & ~o, 1)).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def confusion(expected: DataFrame, observed: DataFrame, verdicts: tuple[str, ...] = ("match", "mismatch")) -> DataFrame:
    """observed and one column for each expected verdict: counts of ids.  A benchmark id without a run row is an error."""
    joined = expected.join(observed, "id", "left")
    seen = F.coalesce("verdict", F.raise_error(F.concat(F.lit("no verdict for "), F.col("id").cast("string"))).cast("string"))
    return joined.select(seen.alias("observed"), "expected_verdict").groupBy("observed").pivot("expected_verdict", list(verdicts)).count().fillna(0)


def disagreements(expected: DataFrame, observed: DataFrame, verdicts: tuple[str, ...] = ("match", "mismatch")) -> DataFrame:
    """id, reason, expected_verdict and verdict of what :func:`confusion` counts off its diagonal: run verdicts outside
    ``verdicts`` are ``non_confident_verdict``, others that differ ``verdict_disagreement``."""
    joined = expected.join(observed, "id", "left")
    seen = F.coalesce("verdict", F.raise_error(F.concat(F.lit("no verdict for "), F.col("id").cast("string"))).cast("string"))
    told = joined.select("id", "expected_verdict", seen.alias("verdict"))
    reason = F.when(~F.col("verdict").isin(*verdicts), "non_confident_verdict").when(F.col("verdict") != F.col("expected_verdict"), "verdict_disagreement")
    return told.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason", "expected_verdict", "verdict")


def repeated_keys(records: DataFrame, *key: str) -> DataFrame:
    return records.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
