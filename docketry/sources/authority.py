"""Authority data as tables: payloads of a case-law service are decoded into clusters, citations, dockets and opinions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import resource_id
from docketry.functions.verdicts import failure_class, retryable

CITATION = "struct<volume:string,reporter:string,page:string>"
CLUSTER = f"struct<id:bigint,cluster_id:bigint,case_name:string,caseName:string,date_filed:string,dateFiled:string,court_id:string,docket_id:bigint,docket:string,absolute_url:string,citations:array<{CITATION}>,sub_opinions:array<string>>"
LOOKUP = f"array<struct<citation:string,status:int,clusters:array<{CLUSTER}>,error_message:string>>"


@dataclass(frozen=True)
class Authority:
    """The tables that lookups and searches join."""

    clusters: DataFrame
    cluster_citations: DataFrame
    dockets: DataFrame
    opinions: DataFrame


def clusters_of(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Cluster rows of JSON cluster payloads: keys in either spelling, ids as strings, ids from URLs where only those are given."""
    p = F.from_json(column, CLUSTER)
    decoded = payloads.select(p.alias("p"))
    tail = lambda x, kind: resource_id(x, kind)
    return decoded.select(
        F.coalesce("p.cluster_id", "p.id").cast("string").alias("cluster_id"), F.coalesce("p.case_name", "p.caseName").alias("case_name"), F.coalesce("p.date_filed", "p.dateFiled").alias("date_filed"), F.col("p.court_id").alias("court_id"),
        F.coalesce(F.col("p.docket_id").cast("string"), tail(F.col("p.docket"), "dockets")).alias("docket_id"), F.col("p.absolute_url").alias("absolute_url"), F.col("p.citations").alias("citations"),
        F.transform("p.sub_opinions", lambda u: tail(u, "opinions")).alias("sub_opinion_ids"),
    )


def citations_of(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.explode("citations").alias("c")).select("cluster_id", "c.volume", "c.reporter", "c.page")


def lookup_results(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """status, n_clusters and message of lookup payloads, which must hold exactly one result each."""
    results = F.from_json(column, LOOKUP, {"mode": "FAILFAST"})
    one = F.when(F.size(results) == 1, results[0]).otherwise(F.raise_error(F.lit("a lookup must have one result")).cast(LOOKUP[6:-1]))
    return payloads.withColumn("r", one).select(*payloads.columns, F.col("r.status").alias("status"), F.size("r.clusters").alias("n_clusters"), F.expr("nullif(r.error_message, '')").alias("message"))


def only_text(payload: Column, path: str) -> Column:
    """A field as text where it is a string or a whole number, null where it is anything else."""
    kind = F.schema_of_variant(F.variant_get(payload, path, "variant"))
    return F.when(kind.isin("STRING", "BIGINT"), F.try_variant_get(payload, path, "string"))


def opinions_of(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Opinion rows of JSON opinion payloads; the cluster's id is taken from its URL where only that is given."""
    p = F.try_parse_json(column)
    return payloads.select(p.alias("p")).select(
        only_text(F.col("p"), "$.id").alias("opinion_id"), F.coalesce(only_text(F.col("p"), "$.cluster_id"), resource_id(only_text(F.col("p"), "$.cluster"), "clusters")).alias("cluster_id"),
        only_text(F.col("p"), "$.type").alias("opinion_type"), only_text(F.col("p"), "$.html_with_citations").alias("html"), F.try_variant_get("p", "$.ordering_key", "int").alias("ordering_key"),
    )


def dockets_of(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Docket rows of JSON docket payloads: keys in either spelling, the court's id from its URL where only that is given."""
    p, v = F.try_parse_json(column), F.col("p")
    return payloads.select(p.alias("p")).select(
        only_text(v, "$.id").alias("docket_id"), F.coalesce(only_text(v, "$.court_id"), resource_id(only_text(v, "$.court"), "courts")).alias("court_id"), F.coalesce(only_text(v, "$.case_name"), only_text(v, "$.caseName")).alias("case_name")
    )


def search_results_of(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Hits of JSON search payloads, numbered from 1: found_id, retrieved_name, date_filed, court_id, docket_id, url, and the
    payload's total and cursors.  Opinions are known by their cluster, docket entries by their docket."""
    p = F.try_parse_json(column)
    hits = payloads.select(p.alias("p")).select("p", F.posexplode_outer(F.try_variant_get("p", "$.results", "array<variant>")).alias("i", "hit"))
    h = F.col("hit")
    link = lambda name: F.try_variant_get("p", f"$.{name}", "string")
    return hits.where(h.isNotNull()).select(
        (F.col("i") + 1).alias("candidate"), F.when(only_text(h, "$.cluster_id").isNotNull(), "opinion").otherwise("recap").alias("source"), F.coalesce(only_text(h, "$.cluster_id"), only_text(h, "$.docket_id")).alias("found_id"),
        F.coalesce(only_text(h, "$.caseName"), only_text(h, "$.case_name")).alias("retrieved_name"), F.coalesce(only_text(h, "$.dateFiled"), only_text(h, "$.date_filed")).alias("date_filed"), only_text(h, "$.court_id").alias("court_id"),
        only_text(h, "$.docket_id").alias("docket_id"), F.coalesce(only_text(h, "$.absolute_url"), only_text(h, "$.docket_absolute_url")).alias("url"), F.try_variant_get("p", "$.count", "bigint").alias("total"),
        next_cursor(link("next")).alias("next_cursor"), next_cursor(link("previous")).alias("previous_cursor"),
    )


def http_errors(responses: DataFrame) -> DataFrame:
    """failure, can_retry and detail (500 characters at most) of failed responses (status, body)."""
    kind = failure_class(F.col("status"))
    return responses.where("status >= 400").withColumn("failure", kind).withColumn("can_retry", retryable(kind)).withColumn("detail", F.substring("body", 1, 500))


def next_cursor(url):
    """The cursor parameter of a next or previous link."""
    return F.parse_url(url, F.lit("QUERY"), F.lit("cursor"))
