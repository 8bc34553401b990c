"""Filings and authority tables made from the star-schema tables, whose texts hold no citations of their own.

Every order with a first line gives one citation.  ``damage`` (0 to 6) says what is wrong with how it is
written: 1 a doubled blank, 2 a line end within the locator, 3 another party or one with a word more, 4 another year, 5 another
court, else nothing.  Some suppliers are companies (``X & Co., Inc.``), some pins name a note (``12 n.3``), some locators of
U.S. name the reporter who wrote them (``5 U.S. (1 Cranch) 137``).  Arithmetic on keys only, so any engine gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.authority import Authority
from docketry.tables import written

# What citations are made of.
REPORTERS = ["U.S.", "F.2d", "F.3d", "S.W.2d", "N.E.2d"]
COURTS = [("2d Cir.", "ca2"), ("9th Cir.", "ca9"), ("S.D.N.Y.", "nysd"), ("D. Mass.", "mad"), ("Fed. Cir.", "cafc")]
HEAD, JOIN, TAIL = " see ", "; see ", ".\n"
#: Where citations are put into a document; the SQL counts from here.
PLACE = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], i: Column) -> Column:
    return F.array(*map(F.lit, values))[i.cast("int")]


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a citation: cite_no, doc_id, the true fields, the written ones (w_...) and the text ``cite``."""
    n_docs = table(spark, sf_dir, "documents").count()
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    orders, customer, supplier = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    joined = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    n, court = F.col("o_orderkey"), F.col("c_nationkey") % len(COURTS)
    rows = joined.select(
        n.alias("cite_no"), (n % n_docs).alias("doc_id"), (n % 7).alias("damage"),
        F.replace("c_name", F.lit("#"), F.lit(" ")).alias("plaintiff"), F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.when(F.col("l_suppkey") % 4 == 1, " & Co., Inc.").otherwise("")).alias("defendant"),
        (F.col("l_partkey") % 900 + 1).cast("string").alias("volume"), _pick(REPORTERS, F.col("l_suppkey") % len(REPORTERS)).alias("reporter"),
        (n % 1500 + 1).cast("string").alias("page"), (n % 1500 + 2).cast("string").alias("pin"), F.year("o_orderdate").cast("string").alias("year"),
        _pick([c for c, _ in COURTS], court).alias("court"), _pick([i for _, i in COURTS], court).alias("court_id"),
        _pick([c for c, _ in COURTS], F.when(n % 7 == 5, (court + 1) % len(COURTS)).otherwise(court)).alias("w_court"),
    )
    damage = F.col("damage")
    rows = rows.withColumn("w_plaintiff", F.when((damage == 3) & (F.floor(F.col("cite_no") / 7) % 2 == 0), "Wrong Party").when(damage == 3, F.concat("plaintiff", F.lit(" Company"))).otherwise(F.col("plaintiff"))).withColumn("w_year", F.when(damage == 4, (F.col("year").cast("int") + 1).cast("string")).otherwise(F.col("year")))
    form = F.floor(F.col("cite_no") / 7) % 4
    rows = rows.withColumn("w_pin", F.when(form == 1, F.concat("pin", F.lit(" n.3"))).otherwise(F.col("pin")))
    by = F.when((form == 2) & (F.col("reporter") == "U.S.") & ~damage.isin(1, 2), " (1 Cranch) ").otherwise(" ")
    gap = F.when(damage == 1, "  ").when(damage == 2, "\n").otherwise(" ")
    return rows.withColumn("cite", F.concat("w_plaintiff", F.lit(" v. "), "defendant", F.lit(", "), "volume", gap, "reporter", by, "page", F.lit(", "), "w_pin", F.lit(" ("), "w_court", F.lit(" "), "w_year", F.lit(")")))


def _listed(spark: SparkSession, sf_dir: str, cites: DataFrame | None) -> DataFrame:
    cites = injected(spark, sf_dir).select("doc_id", "cite_no", "cite") if cites is None else cites
    return cites.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cite_no", "cite"))), lambda x: x["cite"]).alias("cites"))


def filings(spark: SparkSession, sf_dir: str, cites: DataFrame | None = None) -> DataFrame:
    """doc_id and text: every document whole; its citations, if any, stand in order after its first ``PLACE`` characters."""
    text = F.coalesce("text", F.lit(""))
    rest = F.substring(text, PLACE + 1, 1 << 30)
    written = F.concat(F.substring(text, 1, PLACE), F.lit(HEAD), F.array_join("cites", JOIN), F.when(rest != "", F.concat(F.lit(TAIL), rest)).otherwise(""))
    return table(spark, sf_dir, "documents").join(_listed(spark, sf_dir, cites), "doc_id", "left").select("doc_id", F.when(F.col("cites").isNull(), text).otherwise(written).alias("text"))


@dataclass(frozen=True)
class Made(Authority):
    """Authority tables: locators of every fifth order are unknown, some stand for two clusters, some for five."""


def authority(spark: SparkSession, sf_dir: str, cites: DataFrame | None = None) -> Made:
    cites = written(injected(spark, sf_dir), "cites") if cites is None else cites
    known = cites.where("cite_no % 5 <> 0").groupBy("volume", "reporter", "page").agg(F.min_by(F.struct("cite_no", "plaintiff", "defendant", "year", "court_id", "pin"), "cite_no").alias("of"))
    k = F.col("of.cite_no")
    copies = F.when(k % 13 == 0, 5).when(k % 11 == 0, 2).otherwise(1)
    each = known.select("volume", "reporter", "page", "of", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    each = each.withColumn("cluster_id", F.concat(F.lit("c"), k.cast("string"), F.lit("-"), F.col("copy").cast("string")))
    name = F.concat("of.plaintiff", F.lit(" v. "), "of.defendant")
    clusters = each.select("cluster_id", name.alias("case_name"), F.concat("of.year", F.lit("-06-15")).alias("date_filed"), F.col("of.court_id").alias("court_id"), F.when(k % 17 != 0, F.concat(F.lit("d"), k.cast("string"))).alias("docket_id"))
    n = F.col("cite_no")
    dockets = cites.select(F.concat(F.lit("d"), n.cast("string")).alias("docket_id"), F.when(n % 19 != 0, F.col("court_id")).alias("court_id"), F.concat("plaintiff", F.lit(" v. "), "defendant").alias("case_name"))
    marker = lambda label, text: F.concat(F.lit('<b citation-index="1" label="'), label, F.lit('">*'), label, F.lit("</b> "), text)
    html = F.concat(F.lit("<p>head "), marker(F.col("page"), F.concat(F.lit("first &amp; plain "), k.cast("string"))), F.lit(" <i>x</i></p><p>"), marker(F.col("of.pin"), F.concat(F.lit("cited  rule "), k.cast("string"))), F.lit("</p>"))
    opinions = each.select(F.concat(F.lit("o"), F.col("cluster_id")).alias("opinion_id"), "cluster_id", F.when(k % 3 == 0, "dissent").when(k % 3 == 1, "lead").otherwise("combined").alias("opinion_type"), html.alias("html"))
    return Made(clusters, each.select("cluster_id", "volume", "reporter", "page"), dockets, opinions)
