"""Outcomes of checks and how they add up, as column expressions.

What is not there is ``unavailable``, never a mismatch; a step that failed is ``failed``, never a finding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import normal_case_name, null_if_blank

# Value sets.
CASE_KINDS = ("full_case",)
FULL_KINDS = ("full_case", "full_law", "full_journal")
GUARD = 3
BASE_OPINIONS = {"unanimous": 1, "lead": 2, "plurality": 3, "combined": 4}


def agree(left: Column, right: Column) -> Column:
    """match, mismatch, or unavailable where a side is null."""
    return F.when(left.isNull() | right.isNull(), "unavailable").when(left == right, "match").otherwise("mismatch")


def case_name_check(extracted: Column, retrieved: Column) -> Column:
    """Empty names count as absent."""
    return agree(normal_case_name(null_if_blank(extracted)), normal_case_name(null_if_blank(retrieved)))


def lookup_outcome(kind: Column, volume: Column, reporter: Column, page: Column, status: Column, clusters: Column) -> Column:
    """Of an exact lookup; any other pairing of status and number of clusters is an error."""
    complete = (F.coalesce(volume, F.lit("")) != "") & (F.coalesce(reporter, F.lit("")) != "") & (F.coalesce(page, F.lit("")) != "")
    return (
        F.when(~kind.isin(*CASE_KINDS), "unsupported_citation")
        .when(~complete, "incomplete_locator")
        .when((status == 200) & (clusters == 1), "found")
        .when(status.isin(404, 400) & (clusters == 0), "not_found")
        .when((status == 300) & (clusters > 1), "ambiguous")
        .otherwise(F.raise_error(F.concat(F.lit("lookup status "), status, F.lit(" with clusters: "), clusters)))
    )


def lookup_status(clusters: Column) -> Column:
    return F.when(clusters == 0, 404).when(clusters == 1, 200).otherwise(300)


def guard(total: Column, most: int = GUARD) -> Column:
    """All candidates or none."""
    return F.when(total <= most, "all_selected").otherwise("deferred_over_limit")


def failure_class(status: Column) -> Column:
    return F.when(status == 429, "api_limit").when(status.isin(401, 403), "authentication").when(status == 404, "not_found").when(status.between(400, 499), "request_rejected").otherwise("upstream_error")


def retryable(failure: Column) -> Column:
    return failure.isin("api_limit", "upstream_error")


def docket_court_outcome(docket_id: Column, error: Column, court_id: Column) -> Column:
    return F.when(docket_id.isNull(), "skipped").when(error.isNotNull(), "failed").when(court_id.isNull(), "unavailable").otherwise("found")


def last_conclusion(*names: Column) -> Column:
    """The case-name conclusion that counts: the first of ``names`` that is there, latest step first."""
    return F.coalesce(*names)


def locator_verdict(name: Column, court: Column, year: Column) -> Column:
    return F.when((name == "mismatch") | (court == "mismatch"), "mismatch").when((name == "match") & (year != "mismatch"), "match").otherwise("partial_match")


def search_verdict(source: Column, name: Column, court: Column, year: Column) -> Column:
    """Opinions need name, court and year; docket entries name and court."""
    both = (name == "match") & (court == "match")
    return F.when(both & ((source == "recap") | (year == "match")), "possible_match").otherwise("mismatch")


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "mismatch", 1).when(verdict.isin("partial_match", "possible_match"), 2).when(verdict == "match", 3)


def strongest(rank: Column) -> Column:
    """The summary named by the greatest :func:`verdict_rank`; null without candidates."""
    return F.when(rank == 3, "match").when(rank == 2, "possible_match").when(rank == 1, "mismatch")


def search_summary(any_possible: Column) -> Column:
    return F.when(F.coalesce(any_possible, F.lit(False)), "possible_match").otherwise("not_found")


def needs_pinpoint_review(route: Column, matched: Column, all_supported: Column) -> Column:
    return F.when((route == "found") & (matched > 0), ~all_supported)
