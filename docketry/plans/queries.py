"""The named queries: each takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions import verdicts as V
from docketry.functions.alignment import aligned
from docketry.functions.grounding import grounded, located_candidate
from docketry.operators import extraction as X
from docketry.operators import adjudication, frontier, recovery, scoring, table_function, validation, verdict
from docketry.operators import search as find
from docketry.operators.judge import Answers, RuleJudge, judged_names, propositions
from docketry.plans.fixtures import authority, filings, injected, table
from docketry.sources import artifacts
from docketry.sources import authority as service
from docketry.sources.documents import from_column
from docketry.tables import shared_dir, spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    exported = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" source "), "lang", F.lit(f" \n\n{T.MARKER}\n"), body)).otherwise(body).alias("text"))
    done = from_column(exported, tolerant=True)
    return done.select("doc_id", "header", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("body_md5"))


@query
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*map(F.lit, ["txt", "PDF", "docx", "Htm", "md", "zip"]))
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("a.b/filing_"), F.col("p_partkey").cast("string"), F.lit("."), endings[(F.col("p_partkey") % 6).cast("int")]).alias("path"))
    reader = F.when(T.source_format(F.col("path")) == "unknown", "none").otherwise(T.reader_of(F.col("path")))
    return paths.select(T.source_format(F.col("path")).alias("format"), T.is_converted_format(F.col("path")).alias("converted"), reader.alias("reader")).groupBy("format", "converted", "reader").agg(F.count("*").alias("n"))


@query
def http_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = F.array(*map(F.lit, [200, 400, 401, 403, 404, 418, 429, 500, 503]))
    responses = table(spark, sf_dir, "events").select(statuses[(F.col("event_id") % 9).cast("int")].alias("status"), F.concat("props", F.repeat(F.lit("x"), (F.col("event_id") % 700).cast("int"))).alias("body"))
    done = service.http_errors(responses)
    return done.groupBy("status", "failure", "can_retry").agg(F.count("*").alias("n"), F.max(F.length("detail")).cast("long").alias("longest"))


@query
def decoded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    odd = F.col("p_partkey") % 2 == 1
    payload = F.concat(
        F.lit("{"), F.when(odd, F.concat(F.lit('"cluster_id": '), n, F.lit(', "case_name": "A v. '), n, F.lit('"'))).otherwise(F.concat(F.lit('"id": '), n, F.lit(', "caseName": "B v. '), n, F.lit('"'))),
        F.lit(', "docket": "https://h.example/api/dockets/'), n, F.lit('/", "sub_opinions": ["https://h.example/api/opinions/'), n, F.lit('/", "https://h.example/other/7/"], "citations": [{"volume": "'), n, F.lit('", "reporter": "U.S.", "page": "1"}]}'),
    )
    got = service.clusters_of(table(spark, sf_dir, "part").select(payload.alias("payload")))
    return got.select("cluster_id", "case_name", "docket_id", F.array_join("sub_opinion_ids", ",", "null").alias("opinions"), F.col("citations")[0]["volume"].alias("volume"))


@query
def lookup_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    payload = F.concat(F.lit('[{"citation": "1 U.S. 1", "status": '), F.when(n % 3 == 0, "404").otherwise("200"), F.lit(', "clusters": ['), F.when(n % 3 == 0, "").otherwise('{"id": 1}'), F.lit('], "error_message": "'), F.when(n % 2 == 0, "none").otherwise(""), F.lit('"}]'))
    done = service.lookup_results(table(spark, sf_dir, "events").select(payload.alias("payload")))
    return done.groupBy("status", F.col("n_clusters").cast("long").alias("n_clusters"), "message").agg(F.count("*").alias("n"))


@query
def link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    links = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h.example/api/dockets/"), n, F.lit("/")).alias("docket"), F.concat(F.lit("https://h.example/s?q=a&cursor=c"), n).alias("next"), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("/docket/"), n)).otherwise("").alias("path"))
    return links.select("page_id", T.resource_id(F.col("docket"), "dockets").alias("docket_id"), T.resource_id(F.col("docket"), "opinions").alias("opinion_id"), service.next_cursor(F.col("next")).alias("cursor"), T.absolute_url("https://h.example", F.col("path")).alias("url"))


@query
def collapsed_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = T.collapse_spaces(F.regexp_replace(F.coalesce("text", F.lit("")), "e", " \t "))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(flat).cast("long").alias("n_chars"), F.md5(flat).alias("flat_md5"))


@query
def extracted_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.full_citations(X.extract(filings(spark, sf_dir)))
    return found.select("doc_id", "ordinal", "start", "end", "kind", "plaintiff", "defendant", "volume", "reporter", "page", "pin_cite", "year", "court")


@query
def span_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = filings(spark, sf_dir)
    both = X.extract(texts).join(texts, "doc_id")
    right = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("matched_text")
    return both.agg(F.count("*").alias("n"), F.count(F.when(right, 1)).alias("n_right"), F.count(F.when((F.col("start") < F.col("end")) & (F.col("locator_start") >= F.col("start")) & (F.col("locator_end") <= F.col("end")), 1)).alias("n_valid"))


@query
def extraction_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.extract_arms(filings(spark, sf_dir), tuple(X.ARMS)).where("kind = 'full_case'")
    return found.groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


@query
def arms_first_of_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = filings(spark, sf_dir)
    arms = [X.ARMS[a](texts).select(F.lit(i).alias("arm_order"), F.col("document").alias("doc_id"), "start", "end") for i, a in enumerate(X.ARMS)]
    return X.first_of_span(arms[0].unionByName(arms[1]).unionByName(arms[2])).groupBy("arm_order").agg(F.count("*").alias("n"))


@query
def antecedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = injected(spark, sf_dir).where("damage <> 2")
    back = F.when(F.col("cite_no") % 3 == 0, F.concat(F.lit("; Id. at "), "pin")).when(F.col("cite_no") % 3 == 1, F.concat(F.lit("; "), "w_plaintiff", F.lit(", "), "volume", F.lit(" "), "reporter", F.lit(", at "), "pin")).otherwise("")
    texts = filings(spark, sf_dir, cites.select("doc_id", "cite_no", F.concat("cite", back).alias("cite")))
    found = X.resolve(X.extract(texts))
    full = found.where("kind = 'full_case'").select("doc_id", F.col("citation_id").alias("resolves_to"), F.col("page").alias("to_page"), F.col("volume").alias("to_volume"))
    return found.where("kind <> 'full_case'").join(full, ["doc_id", "resolves_to"], "left").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.count("to_page").alias("n_resolved"), F.sum(F.col("to_page").cast("long")).alias("pages"))


@query
def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that filings use, with all their fields: In re, sections of a code, parallel locators, electronic reporters with
    a date, a name and a page, nominative reporters and notes."""
    n, lit = F.col("cite_no") % 6, F.lit
    case = F.concat("plaintiff", lit(" v. "), "defendant", lit(", "))
    locator = F.concat("volume", lit(" "), "reporter", lit(" "), "page")
    cite = (
        F.when(n == 0, F.concat(lit("In re "), "defendant", lit(", "), locator, lit(" ("), "court", lit(" "), "year", lit(")")))
        .when(n == 1, F.concat("volume", lit(" U.S.C. § "), "page", lit("(b)(1) ("), "year", lit(")")))
        .when(n == 2, F.concat(case, locator, lit(", "), "pin", lit(" S. Ct. "), "page", lit(" ("), "year", lit(")")))
        .when(n == 3, F.concat(case, "year", lit(" WL "), "page", lit(", at *"), "pin", lit(" ("), "court", lit(" Jan. 5, "), "year", lit(")")))
        .when(n == 4, F.concat(case, locator, lit(" ("), "year", lit("); "), "plaintiff", lit(" at "), "pin"))
        .otherwise(F.concat("volume", lit(" U.S. (2 Cranch) "), "page", lit(", "), "pin", lit(" n.4")))
    )
    texts = filings(spark, sf_dir, injected(spark, sf_dir).select("doc_id", "cite_no", cite.alias("cite")))
    found = X.extract(texts)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", "plaintiff", "defendant", "volume", "reporter", "page", "pin_cite", "extra", "year", "court")


@query
def reference_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of cases that stand again with a page, and the page of the one case they can mean (null: several)."""
    lit = F.lit
    cite = F.concat("plaintiff", lit(" v. "), "defendant", lit(", "), "volume", lit(" "), "reporter", lit(" "), "page", lit(" ("), "year", lit(")"))
    again = F.when(F.col("cite_no") % 3 == 0, F.concat(lit("; see "), "plaintiff", lit(" at "), "pin")).otherwise("")
    texts = filings(spark, sf_dir, injected(spark, sf_dir).select("doc_id", "cite_no", F.concat(cite, again).alias("cite")))
    found = X.resolve(X.extract(texts))
    full = found.where("kind = 'full_case'").select("doc_id", F.col("citation_id").alias("resolves_to"), F.col("page").alias("to_page"))
    return found.where("kind = 'reference'").join(full, ["doc_id", "resolves_to"], "left").select("doc_id", "start", "pin_cite", "to_page")


@query
def locator_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = injected(spark, sf_dir).select("cite_no", F.concat("volume", F.lit(" "), "reporter", F.lit(" "), "page", F.lit(", 9-10, "), "pin", F.lit(" S.Ct. "), "page").alias("text"))
    each = texts.select("cite_no", F.posexplode(T.locators(F.col("text"))).alias("place", "locator"))
    return each.select("cite_no", F.col("place").cast("long").alias("place"), "locator", T.identity_part(F.col("locator")).alias("identity"), T.implausible_locator(F.col("locator")).alias("implausible"))


@query
def masked_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = filings(spark, sf_dir)
    found = X.full_citations(X.extract(texts))
    gone = X.mask(X.documents(texts, found))
    return gone.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("citations").cast("long").alias("n_citations"), F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("long").alias("n_left"))


@query
def suspected_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.functions.grammar import CASE_REPORTERS

    texts = filings(spark, sf_dir)
    rest = X.mask(X.documents(texts, X.full_citations(X.extract(texts)))).select("doc_id", "text")
    return X.suspected_locators(rest, CASE_REPORTERS).select("doc_id", "start", "end", "reporter")


@query
def docket_courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("cite_no")
    text = F.concat(F.lit("In Civil Action No. 1:"), F.lpad((n % 90 + 10).cast("string"), 2, "0"), F.lit("-cv-"), F.lpad((n % 90000 + 10000).cast("string"), 5, "0"), F.lit(" ("), "court", F.lit(" 2001), filed."))
    sites = X.suspected_dockets(injected(spark, sf_dir).select(n.alias("doc_id"), text.alias("text")), X.court_table(spark))
    return sites.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "docket", F.array_join(F.transform("courts", lambda c: c["court_id"]), ",").alias("courts"))


@query
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = X.sliding_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return windows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("start").cast("long").alias("last"), F.sum(F.length("window")).cast("long").alias("n_chars"))


@query
def scalar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = F.array(*map(F.lit, ["442", "627-8", "627–8", "n.3", " 12 ", "12, 14", ""]))
    pin = pins[(F.col("cite_no") % 7).cast("int")]
    rows = injected(spark, sf_dir).withColumn("gone", F.when(F.col("damage") == 0, "").otherwise(F.col("defendant")))
    return rows.select(
        "cite_no", T.numeric_pin(pin).alias("pin"), T.case_name(F.col("plaintiff"), F.col("gone")).alias("case_name"), T.slug(F.concat_ws(" ", "volume", "reporter", "page")).alias("slug"),
        T.search_term(F.concat("plaintiff", F.lit('"x\\'))).alias("term"), T.normal_court(F.col("court")).alias("court"), T.without_docket_label(T.identity_part(F.concat(F.lit("Case No. 1:"), "page", F.lit("-CV")))).alias("docket"),
        T.window_start(F.col("cite_no") % 3000, F.col("cite_no") % 3000 + 60, F.lit(3060)).cast("long").alias("low"), T.window_end(F.col("cite_no") % 3000, F.col("cite_no") % 3000 + 60, F.lit(3060)).cast("long").alias("high"),
    )


def _looked_up(spark: SparkSession, sf_dir: str):
    """Looked-up citations, the authority tables and the filings, all made of one table of citations."""
    cites = written(injected(spark, sf_dir), "cites")
    made = authority(spark, sf_dir, cites)
    texts = written(filings(spark, sf_dir, cites.select("doc_id", "cite_no", "cite")), "filings")
    found = X.extract(texts).where("kind = 'full_case'")
    with_court = found.join(X.court_table(spark), "court", "left")
    # Candidates, searches and summaries all read the lookups: they are computed once.
    return written(validation.lookup(with_court, made.cluster_citations), "looked"), made, texts


@query
def lookup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, _, _ = _looked_up(spark, sf_dir)
    return looked.groupBy("lookup", F.col("status").cast("long").alias("status"), F.size("clusters").cast("long").alias("n_clusters"), V.guard(F.size("clusters")).alias("selection")).agg(F.count("*").alias("n"))


def _assessed(spark: SparkSession, sf_dir: str):
    looked, made, texts = _looked_up(spark, sf_dir)
    return looked, made, verdict.assessed_candidates(looked, texts, made, RuleJudge())


@query
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, assessed = _assessed(spark, sf_dir)
    return assessed.groupBy("lookup", "name_check", "year_check", "court_check", "verdict").agg(F.count("*").alias("n"))


@query
def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, made, _ = _looked_up(spark, sf_dir)
    return validation.search(looked, made.clusters, made.dockets).select("doc_id", "start", "source", F.col("candidate").cast("long").alias("candidate"), "found_id", "verdict")


@query
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two pages of two results each for every customer, by name among the opinions of all courts."""
    made = authority(spark, sf_dir)
    of = find.index(made.clusters.select(F.lit("opinion").alias("scope"), F.col("cluster_id").alias("found_id"), F.col("case_name").alias("name")))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("opinion").alias("scope"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("text"))
    results = written(find.ranked(asked, of), "ranked")
    first = find.page(results, 2)
    second = find.page(results, 2, find.cursors(first, 2))
    return first.withColumn("page", F.lit(1)).unionByName(second.withColumn("page", F.lit(2))).select("query_id", "page", "rank", "found_id", "score")


@query
def aligned_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a miswritten citation lies in the text around it, by the best partial alignment."""
    texts = filings(spark, sf_dir)
    found = X.extract(texts).where("kind = 'full_case' AND plaintiff IS NOT NULL")
    windows = X.windows_around(texts, found, 150, 150)
    near = aligned(F.col("window"), F.replace("matched_text", F.lit(" v. "), F.lit(" w. ")))
    return windows.withColumn("a", near).select("doc_id", (F.col("low") + F.col("a.start")).cast("long").alias("start"), (F.col("low") + F.col("a.end")).cast("long").alias("end"), F.col("a.distance").cast("long").alias("distance"), F.round("a.score", 6).alias("score"))


def _summaries(spark: SparkSession, sf_dir: str):
    looked, made, assessed = _assessed(spark, sf_dir)
    searched, _, _ = verdict.judged_searches(looked, made, RuleJudge())
    return looked, assessed, validation.summaries(looked, assessed, searched)


@query
def summary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, made, assessed = _assessed(spark, sf_dir)
    address = lambda kind, key, has: F.when(has, F.concat(F.lit(f"/{kind}/"), key, F.lit("/")))
    clusters = made.clusters.withColumn("absolute_url", address("opinion", "cluster_id", F.endswith("cluster_id", F.lit("-0"))))
    dockets = made.dockets.withColumn("absolute_url", address("docket", "docket_id", ~F.endswith("docket_id", F.lit("3"))))
    done = validation.summary_candidates(assessed, validation.search(looked, made.clusters, made.dockets), clusters, dockets, "https://h.example")
    return done.select("doc_id", F.col("start").cast("long").alias("start"), F.col("place").cast("long").alias("place"), "provenance", "found_id", "outcome", "opinion_url", "docket_url")


@query
def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: how many citations each lookup and each overall verdict has."""
    _, _, overall = _summaries(spark, sf_dir)
    return overall.groupBy("lookup", "overall").agg(F.count("*").alias("n"), F.sum("n_candidates").alias("n_candidates"))


@query
def exported_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, _, overall = _summaries(spark, sf_dir)
    return validation.exported(looked, overall)


@query
def step_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, _, assessed = _assessed(spark, sf_dir)
    return validation.nodes(looked, assessed).groupBy("node_type", "status", "outcome").agg(F.count("*").alias("n"), F.sum(F.size("depends_on")).alias("n_parents"))


@query
def search_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, made, _ = _looked_up(spark, sf_dir)
    searched, totals, terms = verdict.judged_searches(looked, made, RuleJudge())
    return validation.search_nodes(looked, searched, totals, terms).groupBy("node_type", "status", "outcome").agg(F.count("*").alias("n"), F.sum(F.size("depends_on")).alias("n_parents"))


@query
def step_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, _, assessed = _assessed(spark, sf_dir)
    up = validation.ancestors(validation.nodes(looked, assessed))
    return up.groupBy(F.element_at(F.split("ancestor", ":"), 2).alias("ancestor_type"), F.col("distance").cast("long").alias("distance")).agg(F.count("*").alias("n"))


@query
def step_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of how many steps each kind of child depends, and on how many of them exactly one."""
    looked, _, assessed = _assessed(spark, sf_dir)
    return validation.children(validation.nodes(looked, assessed)).groupBy("parent_type", "child_type").agg(F.count("*").alias("n_parents"), F.count("only").alias("n_single"))


@query
def step_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, made, assessed = _assessed(spark, sf_dir)
    searched, totals, terms = verdict.judged_searches(looked, made, RuleJudge())
    return validation.broken_invariants(written(validation.nodes(looked, assessed).unionByName(validation.search_nodes(looked, searched, totals, terms)), "steps"))


@query
def pinpoint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, made, _ = _looked_up(spark, sf_dir)
    return recovery.reporter_pages(looked, made.opinions).select("doc_id", "start", "page_text")


def _alone(spark: SparkSession, sf_dir: str, before: Column, plaintiff: Column, versus: Column):
    """Filings that hold one citation each (doc_id: its number), their looked-up citations and the authority tables."""
    made = authority(spark, sf_dir)
    cite = F.concat(plaintiff, versus, "defendant", F.lit(", "), "volume", F.lit(" "), "reporter", F.lit(" "), "page", F.lit(", "), "pin", F.lit(" ("), "court", F.lit(" "), "year", F.lit(")."))
    texts = written(injected(spark, sf_dir).select(F.col("cite_no").alias("doc_id"), F.concat(F.lit("Costs were paid. "), before, cite).alias("text")), "alone")
    found = X.extract(texts).where("kind = 'full_case'").join(X.court_table(spark), "court", "left")
    return texts, written(validation.lookup(found, made.cluster_citations), "looked"), made


@query
def recovered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("cite_no") % 4
    name = F.when(kind == 1, F.concat("plaintiff", F.lit(" Co"))).when(kind == 2, "Wrong Party").otherwise(F.col("plaintiff"))
    texts, looked, made = _alone(spark, sf_dir, F.lit("See "), name, F.when(kind == 3, " v.\n").otherwise(" v. "))
    checked = validation.field_checks(validation.candidates(looked, made.clusters), made.dockets)
    done = recovery.recovered_names(checked, texts, RuleJudge())
    return done.groupBy("name_check", "semantic_check", "reextraction", "reextracted_check", "name_outcome", "name_evidence").agg(F.count("*").alias("n"))


@query
def searched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked, made, _ = _looked_up(spark, sf_dir)
    odd = F.regexp_extract("cluster_id", "c([0-9]+)-", 1).cast("long") % 2 == 1
    named = made.clusters.withColumn("case_name", F.when(odd, F.replace("case_name", F.lit(" v. "), F.lit(" et al. v. "))).otherwise(F.col("case_name")))
    done = recovery.assessed_search(validation.search(looked, named, made.dockets), RuleJudge())
    return done.groupBy("source", "name_check", "semantic_check", "verdict", "message").agg(F.count("*").alias("n"))


@query
def pinpoint_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.when(F.col("cite_no") % 2 == 0, "The cited rule governs here, see ").otherwise("Nothing else was said, see ")
    texts, looked, made = _alone(spark, sf_dir, before, F.col("plaintiff"), F.lit(" v. "))
    found = looked.where("lookup = 'found'")
    pages = found.select("doc_id", "citation_id").join(recovery.reporter_pages(looked, made.opinions).drop("start"), ["doc_id", "citation_id"], "left")
    pinpoints = written(recovery.supported(pages, propositions(found, texts, RuleJudge()), RuleJudge()), "pinpoints")
    assessed = validation.assess(validation.field_checks(validation.candidates(found, made.clusters), made.dockets))
    reviews = recovery.pinpoint_reviews(assessed, pinpoints)
    return pinpoints.join(reviews, ["doc_id", "citation_id"]).groupBy("pinpoint", "needs_review").agg(F.count("*").alias("n"), F.count("evidence_start").alias("n_placed"))


@query
def assessment_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, assessed = _assessed(spark, sf_dir)
    return assessed.groupBy("verdict", recovery.locator_message(F.col("verdict"), F.col("name_outcome"), F.col("court_check")).alias("message")).agg(F.count("*").alias("n"))


@query
def validated_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with every kind of step, through their artifact and back: how many steps of each kind and outcome the
    citations of each verdict have, how many of them call for a review, and how many payloads name what they are about."""
    made = authority(spark, sf_dir)
    n = F.col("cite_no").cast("string")
    said = F.when(F.col("cite_no") % 2 == 0, F.concat(F.lit("Costs were paid. The cited rule "), n, F.lit(" holds, see "))).otherwise(F.concat(F.lit("Costs were paid. Nothing else was said of "), n, F.lit(", see ")))
    texts = written(filings(spark, sf_dir, injected(spark, sf_dir).select("doc_id", "cite_no", F.concat(said, "cite").alias("cite"))), "filings")
    found = written(X.extract(texts).where("kind = 'full_case'"), "citations")
    looked = written(validation.lookup(found.join(X.court_table(spark), "court", "left"), made.cluster_citations), "looked")
    done = verdict.validate(looked, texts, made, RuleJudge())
    whole = X.documents(texts, found)
    back = artifacts.read_validated(artifacts.validated_json(whole, done.nodes, done.summaries), whole.schema["citations"].dataType.simpleString())
    steps = artifacts.typed_steps(back)
    about = F.coalesce(*(F.col("fields")[k] for k in ("message", "page_text", "proposition", "retrieved", "cluster_id", "found_id", "court_id", "page")))
    return steps.groupBy("aggregation.overall", "node_type", "outcome").agg(F.count("*").alias("n"), F.count(F.when(F.col("aggregation.needs_review"), 1)).alias("n_review"), F.count(about).alias("n_about"))


@query
def prompts_asked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many case names differ from the retrieved ones, how many of these questions are distinct, and how many answers are
    kept after the same names have been judged twice."""
    rows = written(injected(spark, sf_dir), "cites")
    made = authority(spark, sf_dir, rows)
    pairs = rows.select(F.col("cite_no"), F.col("w_plaintiff").alias("plaintiff"), "defendant", "year")
    named = pairs.join(made.dockets.select(F.regexp_extract("docket_id", "[0-9]+", 0).cast("long").alias("cite_no"), F.col("case_name").alias("retrieved_name")), "cite_no")
    checked = written(named.withColumn("name_check", V.case_name_check(T.case_name(F.col("plaintiff"), F.col("defendant")), F.col("retrieved_name"))), "checked")
    answers = Answers(f"{shared_dir(spark)}/docketry-answers-{uuid.uuid4().hex}")
    for _ in range(2):
        judged = written(judged_names(checked, RuleJudge(), answers), "judged")
    kept = spark.read.parquet(f"{answers.path}/same_case").select(F.get_json_object("answer", "$.outcome").alias("semantic_check")).groupBy("semantic_check").agg(F.count("*").alias("n_answers"))
    differ = judged.where("semantic_check IS NOT NULL")
    return differ.groupBy("semantic_check").agg(F.count("*").alias("n"), F.countDistinct("plaintiff", "defendant", "retrieved_name").alias("n_distinct")).join(kept, "semantic_check")


@query
def model_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge alone finds in whole filings, window by window; windows with over three citations are split."""
    found = frontier.model_citations(filings(spark, sf_dir), RuleJudge(), proposals=3)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind")


@query
def extracted_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_function.register(spark)
    filings(spark, sf_dir).createOrReplaceTempView("docketry_filings")
    names = "doc_id, ordinal, start, end, kind, plaintiff, defendant, volume, reporter, page, pin_cite, year, court"
    return spark.sql(f"SELECT {names} FROM extract_citations(TABLE(SELECT doc_id, text FROM docketry_filings) PARTITION BY doc_id) WHERE kind IN ('full_case', 'full_law', 'full_journal')")


@query
def recovered_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudication.recovered_occurrences(filings(spark, sf_dir), RuleJudge())
    return found.select(F.col("document").alias("doc_id"), "start", "end", "volume", "reporter", "page")


@query
def recovery_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every arm of the extraction study finds, those with a judge included."""
    every = adjudication.all_arms(filings(spark, sf_dir), RuleJudge())
    return every.groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("document").alias("n_documents"))


def _docket_text(court: str) -> Column:
    n = F.col("cite_no")
    return F.concat(F.lit("In Civil Action No. 1:"), F.lpad((n % 90 + 10).cast("string"), 2, "0"), F.lit("-cv-"), F.lpad((n % 90000 + 10000).cast("string"), 5, "0"), F.lit(" ("), court, F.lit(" 2001), filed."))


@query
def recovered_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = injected(spark, sf_dir).select(F.col("cite_no").alias("doc_id"), _docket_text("w_court").alias("text"))
    return adjudication.adjudicated_dockets(X.suspected_dockets(texts, X.court_table(spark)), RuleJudge()).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "docket", "court_id")


@query
def docket_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dockets are claimed only where courts meet: the expected court against the one that is written."""
    rows = injected(spark, sf_dir)
    seen = recovered_dockets(spark, sf_dir)
    same = F.regexp_replace(T.identity_part(F.col("docket")), "^civilactionno", "")
    observed = seen.select(F.col("doc_id").alias("document"), same.alias("identity"), "start", "end", F.array("court_id").alias("courts"))
    n = F.col("cite_no")
    identity = F.concat(F.lit("1"), (n % 90 + 10).cast("string"), F.lit("cv"), (n % 90000 + 10000).cast("string"))
    expected = rows.select(n.alias("document"), identity.alias("identity"), F.lit(3).cast("long").alias("start"), F.lit(36).cast("long").alias("end"), F.array("court_id").alias("courts"))
    return scoring.scores(scoring.claims(expected, observed)).select("tp", "fp", "fn")


@query
def courts_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every court of a window counts, the same one several times."""
    text = F.concat("court", F.lit(" ruled. "), _docket_text("court"), F.lit(" Later "), "w_court", F.lit(" too."))
    sites = X.docket_sites(injected(spark, sf_dir).select(F.col("cite_no").alias("doc_id"), text.alias("text")))
    return X.courts_near(sites, X.court_table(spark)).select("doc_id", F.col("at").cast("long").alias("at"), "court_id")


@query
def decoded_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    odd = F.col("p_partkey") % 2 == 1
    payload = F.concat(F.lit('{"id": '), n, F.when(odd, F.concat(F.lit(', "cluster_id": "'), n, F.lit('"'))).otherwise(F.concat(F.lit(', "cluster": "https://h.example/api/clusters/'), n, F.lit('/"'))), F.lit(', "type": "lead", "ordering_key": 3, "html_with_citations": '), F.when(odd, F.lit('"<p>x</p>"')).otherwise("1.5"), F.lit("}"))
    return service.opinions_of(table(spark, sf_dir, "part").select(payload.alias("payload")))


@query
def decoded_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    odd = F.col("p_partkey") % 2 == 1
    payload = F.concat(F.lit('{"id": "'), n, F.when(odd, F.lit('", "court_id": "ca2", "case_name": "A v. B"')).otherwise(F.lit('", "court": "https://h.example/api/courts/ca9/", "caseName": true')), F.lit("}"))
    return service.dockets_of(table(spark, sf_dir, "part").select(payload.alias("payload")))


@query
def decoded_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    payload = F.concat(F.lit('{"count": 2, "next": "https://h.example/s?q=a&cursor=c'), n, F.lit('", "previous": null, "results": [{"cluster_id": '), n, F.lit(', "caseName": "A v. B", "dateFiled": "2001-02-03", "court_id": "ca2", "absolute_url": "/o/1"}, {"docket_id": '), n, F.lit(', "case_name": "C v. D", "court_id": "ca9", "docket_absolute_url": "/d/1"}]}'))
    return service.search_results_of(table(spark, sf_dir, "part").select(payload.alias("payload"))).drop("docket_id")


@query
def located_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed citations by the step that finds them."""
    n = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    chunk = F.concat(F.lit("It was held in Roe v. Doe "), n, F.when(kind == 2, ",\n 9F.2d\n").otherwise(", 9 F.2d "), n, F.lit(" (1973) and not since."))
    quote = F.concat(F.when(kind == 3, "Coe v. Moe").otherwise("Roe v. Doe"), F.lit(" "), n, F.lit(", 9 F.2d "), n, F.when(kind == 1, " (1974)").when(kind == 3, "").otherwise(" (1973)"))
    got = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", located_candidate(chunk, F.when(kind == 2, F.concat(F.lit("9 F.2d "), n)).otherwise(quote)).alias("g"), chunk.alias("chunk"))
    whole = F.substring("chunk", F.col("g.start") + 1, F.col("g.end") - F.col("g.start")) == F.col("g.text")
    return got.select("p_partkey", F.col("g.start").cast("long").alias("start"), "g.method", whole.alias("whole"))


@query
def grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    source = F.concat(F.lit("“Held”: the  rule of part "), n, F.lit(" shall not be read to exceed its plain terms. Costs follow."))
    quote = F.concat(F.when(kind == 1, "THE RULE OF PART ").when(kind == 2, "the old rule of part ").otherwise("rule of part "), F.when(kind == 3, "x").otherwise(n), F.when(kind == 2, " shall now be read to exceed its plain terms").otherwise(" shall"))
    got = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", source.alias("source"), quote.alias("quote")).withColumn("g", grounded(F.col("source"), F.col("quote")))
    return got.select("p_partkey", F.col("g.start").cast("long").alias("start"), F.col("g.end").cast("long").alias("end"), "g.method")


@query
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = written(X.extract_arms(filings(spark, sf_dir), ("layout_tolerant", "production")), "arms")
    of = lambda arm: X.occurrences(both.where(F.col("arm") == arm))
    return scoring.scores(scoring.claims(of("layout_tolerant"), of("production")))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected and observed verdicts by id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "match").otherwise("mismatch").alias("expected_verdict"))
    rule = F.when(F.coalesce(F.length("text"), F.lit(0)) < 200, "not_found").when(F.contains("text", F.lit("###")), "mismatch").otherwise("match")
    return labels, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), rule.alias("verdict"))


@query
def verdict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(*_labelled(spark, sf_dir))


@query
def verdict_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.disagreements(*_labelled(spark, sf_dir))


@query
def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    path = F.when(n % 3 == 0, F.concat(F.lit("runs/"), n.cast("string"), F.lit(".json"))).otherwise(F.concat(F.lit("runs/a__b/"), F.lpad(n.cast("string"), 9, "0"), F.lit("__roe-v-doe__2.json")))
    return table(spark, sf_dir, "part").select("p_partkey", T.run_document(path).alias("document"))


@query
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.repeated_keys(injected(spark, sf_dir), "volume", "reporter")


@query
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = filings(spark, sf_dir)
    whole = X.documents(texts, X.full_citations(X.extract(texts)))
    back = artifacts.read_extracted(artifacts.extracted_json(whole), whole.schema["citations"].dataType.simpleString())
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.size("citations").cast("long").alias("n"), F.array_join(F.transform("citations", lambda c: c["page"]), ",").alias("pages"))


@query
def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.resolve(X.full_citations(X.extract(filings(spark, sf_dir))))
    return artifacts.annotation_rows(found).groupBy("row_type", "name").agg(F.count("*").alias("n"), F.sum(F.length("value")).cast("long").alias("n_chars"))
