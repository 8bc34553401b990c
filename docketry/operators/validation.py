"""From citations to verdicts: lookups and searches are joins against authority tables, checks are columns.

Authority tables: clusters (cluster_id, case_name, date_filed, court_id, docket_id), cluster_citations
(cluster_id, volume, reporter, page), dockets (docket_id, court_id, case_name).  All joins are left
to the optimizer; none is forced to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import absolute_url, case_name, identity_part, locator_text, year_of
from docketry.functions.verdicts import GUARD, agree, case_name_check, guard, locator_verdict, lookup_outcome, lookup_status, search_summary, search_verdict, strongest, verdict_rank
from docketry.operators import search as find
from docketry.tables import written

KEY = ["doc_id", "citation_id"]


def lookup(citations: DataFrame, cluster_citations: DataFrame) -> DataFrame:
    """Adds clusters (ids in order), status and lookup: the exact lookup of volume, reporter and page."""
    key = ["volume", "reporter", "page"]
    by_locator = cluster_citations.groupBy(*key).agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters"))
    whole = F.col("volume").isNotNull() & F.col("reporter").isNotNull() & F.col("page").isNotNull()
    # Citations without a whole locator go round the join: null keys would all be one task's.
    joined = citations.where(whole).join(by_locator, key, "left").unionByName(citations.where(~whole), allowMissingColumns=True)
    clusters = F.coalesce("clusters", F.array().cast("array<string>"))
    out = joined.withColumn("clusters", clusters).withColumn("status", lookup_status(F.size("clusters")))
    return out.withColumn("lookup", lookup_outcome(F.col("kind"), F.col("volume"), F.col("reporter"), F.col("page"), F.col("status"), F.size("clusters")))


def candidates(looked_up: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row a candidate of found and ambiguous citations within the guard, numbered from 1."""
    routed = looked_up.where(F.col("lookup").isin("found", "ambiguous") & (guard(F.size("clusters")) == "all_selected"))
    each = routed.select(*routed.columns, F.posexplode("clusters").alias("candidate", "cluster_id")).withColumn("candidate", F.col("candidate") + 1)
    return each.join(clusters.select("cluster_id", F.col("case_name").alias("retrieved_name"), "date_filed", F.col("court_id").alias("cluster_court"), "docket_id"), "cluster_id")


def field_checks(candidates_of: DataFrame, dockets: DataFrame, court_id: Column | None = None) -> DataFrame:
    """Adds name_check, year_check and court_check.  The docket's court counts, or the cluster's where it names no docket."""
    of = candidates_of.join(dockets.select("docket_id", F.col("court_id").alias("docket_court")), "docket_id", "left")
    written = F.col("court_id") if court_id is None else court_id
    found = F.coalesce("docket_court", F.when(F.col("docket_id").isNull(), F.col("cluster_court")))
    return (
        of.withColumn("name_check", case_name_check(case_name(F.col("plaintiff"), F.col("defendant")), F.col("retrieved_name")))
        .withColumn("year_check", agree(F.col("year"), year_of(F.col("date_filed"))))
        .withColumn("court_check", agree(written, found))
    )


def assess(checked: DataFrame) -> DataFrame:
    """Adds verdict: by the last conclusion on the case name (``name_outcome``, where names were recovered), court and year."""
    name = "name_outcome" if "name_outcome" in checked.columns else "name_check"
    return checked.withColumn("verdict", locator_verdict(F.col(name), F.col("court_check"), F.col("year_check")))


def searches(looked_up: DataFrame, clusters: DataFrame, dockets: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates of citations that were not found (a case name that holds both parties, or the ``terms`` prepared for them, in
    the same court; opinions first, then docket entries, each within the guard) with source, candidate, the field checks and
    verdict; and how many each search found, the guard aside: doc_id, citation_id, source, total."""
    asked = looked_up.where((F.col("lookup") == "not_found") & F.col("court_id").isNotNull() & (F.col("plaintiff") != "") & (F.col("defendant") != ""))
    scope = lambda source, court: F.concat(F.lit(f"{source} "), court)
    opinions = clusters.select(scope("opinion", F.col("court_id")).alias("scope"), F.col("cluster_id").alias("found_id"), F.col("case_name").alias("name"), F.substring("date_filed", 1, 4).alias("about"))
    recap = dockets.select(scope("recap", F.col("court_id")).alias("scope"), F.col("docket_id").alias("found_id"), F.col("case_name").alias("name"), F.lit(None).cast("string").alias("about"))
    if terms is None:
        worded = asked.select(*KEY, "plaintiff", "defendant", "court_id")
    else:
        ready = terms.where("preparation = 'prepared'").select(*KEY, F.col("plaintiff_term").alias("plaintiff"), F.col("defendant_term").alias("defendant"))
        worded = asked.select(*KEY, "court_id").join(ready, KEY)
    each = worded.select(*KEY, "plaintiff", "defendant", "court_id", F.explode(F.array(F.lit("opinion"), F.lit("recap"))).alias("source"))
    query_id = F.concat_ws("\n", F.col("doc_id").cast("string"), "citation_id", "source")
    each = written(each.withColumn("query_id", query_id), "asked")
    terms = each.select("query_id", F.concat("source", F.lit(" "), "court_id").alias("scope"), F.concat_ws(" ", "plaintiff", "defendant").alias("text"))
    met = find.matches(terms, find.index(opinions.unionByName(recap))).select("query_id", "found_id", "name", "about", "terms")
    said = F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" "))
    holds = F.contains(said, _words(F.col("plaintiff"))) & F.contains(said, _words(F.col("defendant")))
    held = written(met.join(each, "query_id").where(holds).select(*KEY, "source", "found_id", F.col("name").alias("retrieved_name"), F.col("about").alias("found_year")), "held")
    totals = held.groupBy(*KEY, "source").agg(F.count("*").alias("total"))
    # What is over the guard never becomes rows of citations.
    within = held.join(totals.where(F.col("total") <= GUARD), [*KEY, "source"])
    number = F.row_number().over(Window.partitionBy(*KEY, "source").orderBy("found_id"))
    kept = asked.join(within.withColumn("candidate", number), KEY).withColumn("found_court", F.col("court_id"))
    name, court, year = case_name_check(case_name(F.col("plaintiff"), F.col("defendant")), F.col("retrieved_name")), agree(F.col("court_id"), F.col("found_court")), agree(F.col("year"), F.col("found_year"))
    checked = kept.withColumn("name_check", name).withColumn("court_check", court).withColumn("year_check", year)
    return checked.withColumn("verdict", search_verdict(F.col("source"), F.col("name_check"), F.col("court_check"), F.col("year_check"))), totals


def search(looked_up: DataFrame, clusters: DataFrame, dockets: DataFrame) -> DataFrame:
    return searches(looked_up, clusters, dockets)[0]


def _words(x: Column) -> Column:
    """Lower-case words between blanks, so that containment is of whole words."""
    return F.concat(F.lit(" "), F.array_join(find.words_of(x), " "), F.lit(" "))


def summaries(looked_up: DataFrame, assessed: DataFrame, searched: DataFrame) -> DataFrame:
    """doc_id, citation_id, lookup and overall: found and ambiguous citations by their strongest candidate (null beyond
    the guard), those not found by their search, null for the rest."""
    by_locator = assessed.groupBy(*KEY).agg(F.max(verdict_rank(F.col("verdict"))).alias("rank"), F.count("*").alias("n_candidates"))
    by_search = searched.groupBy(*KEY).agg(F.max(F.col("verdict") == "possible_match").alias("possible"))
    joined = looked_up.join(by_locator, KEY, "left").join(by_search, KEY, "left")
    overall = F.when(F.col("lookup") == "not_found", search_summary(F.col("possible"))).otherwise(strongest(F.col("rank")))
    return joined.select(*KEY, "lookup", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), overall.alias("overall"))


def summary_candidates(assessed: DataFrame, searched: DataFrame, clusters: DataFrame, dockets: DataFrame, origin: str) -> DataFrame:
    """The candidates of each citation's summary in order: doc_id, citation_id, start, place (from 1; by locator, then
    opinions, then docket entries), provenance, found_id, outcome, opinion_url and docket_url.

    Only opinions have an opinion's address and only docket entries a docket's, made from ``absolute_url`` of clusters and
    dockets; null where that is null or empty."""
    row = lambda df, rank, found, provenance: df.select(*KEY, "start", rank.alias("rank"), "candidate", F.col(found).alias("found_id"), provenance.alias("provenance"), F.col("verdict").alias("outcome"))
    by_locator = row(assessed, F.lit(0), "cluster_id", F.lit("opinion"))
    by_search = row(searched, F.when(F.col("source") == "opinion", 1).otherwise(2), "found_id", F.col("source"))
    address = lambda df, key, provenance: df.select(F.col(key).alias("found_id"), F.lit(provenance).alias("provenance"), absolute_url(origin, F.col("absolute_url")).alias("url"))
    known = address(clusters, "cluster_id", "opinion").unionByName(address(dockets, "docket_id", "recap")).where("url IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("rank", "candidate"))
    joined = by_locator.unionByName(by_search).join(known, ["found_id", "provenance"], "left").withColumn("place", place)
    only = lambda provenance: F.when(F.col("provenance") == provenance, F.col("url"))
    return joined.select(*KEY, "start", "place", "provenance", "found_id", "outcome", only("opinion").alias("opinion_url"), only("recap").alias("docket_url"))


def _payload(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _check(name: str, outcome: Column, extracted: Column, retrieved: Column) -> tuple[str, Column, Column]:
    return name, outcome, _payload(extracted.alias("extracted"), retrieved.alias("retrieved"))


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


#: Places of a candidate's steps: the candidate itself, its checks, its assessment.
STRIDE = 8


def nodes(looked_up: DataFrame, assessed: DataFrame) -> DataFrame:
    """The long table of steps: doc_id, citation_id, seq, node_id, node_type, status, outcome, depends_on, payload (JSON of the
    step's own fields, see ``artifacts.STEPS``).  Names that were recovered (:mod:`docketry.operators.recovery`) add their steps."""
    cite = F.col("citation_id")
    root = F.concat(cite, F.lit(":exact_locator_lookup"))
    skipped = F.col("lookup").isin("unsupported_citation", "incomplete_locator")
    empty = F.array().cast("array<string>")
    about = _payload("volume", "reporter", "page", F.col("status").cast("int").alias("status"), "clusters")
    looked = looked_up.select(*KEY, F.lit(0).alias("seq"), root.alias("node_id"), F.lit("exact_locator_lookup").alias("node_type"), F.when(skipped, "skipped").otherwise("succeeded").alias("status"), F.col("lookup").alias("outcome"), empty.alias("depends_on"), about.alias("payload"))
    candidate = F.concat(cite, F.lit(":locator_candidate_evaluation:"), F.col("candidate").cast("string"))
    name, again = case_name(F.col("plaintiff"), F.col("defendant")), case_name(_has(assessed, "re_plaintiff"), _has(assessed, "re_defendant"))
    court = F.coalesce("docket_court", F.when(F.col("docket_id").isNull(), F.col("cluster_court")))
    from docketry.operators.recovery import locator_message

    last = F.col("name_outcome") if "name_outcome" in assessed.columns else F.col("name_check")
    said = locator_message(F.col("verdict"), last, F.col("court_check"))
    below = [
        ("locator_candidate_evaluation", F.lit("ready"), _payload("candidate", "cluster_id")),
        _check("exact_case_name_check", F.col("name_check"), name, F.col("retrieved_name")),
        _check("semantic_case_name_check", _has(assessed, "semantic_check"), name, F.col("retrieved_name")),
        ("local_party_reextraction", _has(assessed, "reextraction"), _payload(_has(assessed, "re_plaintiff").alias("plaintiff"), _has(assessed, "re_defendant").alias("defendant"))),
        _check("reextracted_case_name_check", _has(assessed, "reextracted_check"), again, F.col("retrieved_name")),
        _check("year_check", F.col("year_check"), F.col("year"), year_of(F.col("date_filed"))),
        _check("court_check", F.col("court_check"), F.col("court_id"), court),
        ("locator_candidate_assessment", F.col("verdict"), _payload("cluster_id", F.col("retrieved_name").alias("case_name"), "date_filed", said.alias("message"))),
    ]
    first = (F.col("candidate") - 1) * STRIDE + 1
    return looked.unionByName(_steps(assessed, first, candidate, root, [(F.lit(n), o, p) for n, o, p in below]))


def _steps(rows: DataFrame, first: Column, start: Column, root: Column, below: list[tuple[Column, Column, Column]]) -> DataFrame:
    """The steps of candidates: ``below`` holds name, outcome (null: not taken) and payload, the candidate's own first."""
    step = lambda at, n, o, p: F.struct((first + at).cast("int").alias("seq"), (F.concat(start, F.lit(":"), n) if at else start).alias("node_id"), n.alias("node_type"), o.alias("outcome"), F.array(start if at else root).alias("depends_on"), p.alias("payload"))
    taken = F.filter(F.array(*(step(at, *x) for at, x in enumerate(below))), lambda x: x["outcome"].isNotNull())
    status = F.when(F.col("s.outcome") == "failed", "failed").otherwise("succeeded")
    return rows.select(*KEY, F.explode(taken).alias("s")).select(*KEY, "s.seq", "s.node_id", "s.node_type", status.alias("status"), "s.outcome", "s.depends_on", "s.payload")


def search_nodes(looked_up: DataFrame, searched: DataFrame, totals: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Steps of citations that were not found, to follow those of :func:`nodes`: the preparation of ``terms``, a search of opinions and one of docket
    entries (skipped without a court or a party; outcome ``candidates``, ``none``, or ``deferred_over_limit`` for more than the
    guard lets through), then each candidate of :func:`searches` with its checks and its assessment."""
    cite, missing = F.col("citation_id"), looked_up.where("lookup = 'not_found'")
    named = F.col("court_id").isNotNull() & (F.coalesce("plaintiff", F.lit("")) != "") & (F.coalesce("defendant", F.lit("")) != "")
    place = F.when(F.col("source") == "opinion", 0).otherwise(1)
    root, search_id = F.concat(cite, F.lit(":exact_locator_lookup")), F.concat(cite, F.lit(":"), "source", F.lit("_search"))
    asked = missing.select(*KEY, named.alias("named"), "plaintiff", "defendant", "court_id", F.explode(F.array(F.lit("opinion"), F.lit("recap"))).alias("source")).join(totals, [*KEY, "source"], "left")
    outcome = F.when(~F.col("named"), "missing_terms").when(F.col("total").isNull(), "none").when(F.col("total") <= GUARD, "candidates").otherwise("deferred_over_limit")
    before = root if terms is None else F.concat(cite, F.lit(":search_term_preparation"))
    found = asked.select(
        *KEY, (place + 2).cast("int").alias("seq"), search_id.alias("node_id"), F.concat("source", F.lit("_search")).alias("node_type"),
        F.when(F.col("named"), "succeeded").otherwise("skipped").alias("status"), outcome.alias("outcome"), F.array(before).alias("depends_on"),
        _payload("plaintiff", "defendant", "court_id", F.when(F.col("named"), F.coalesce("total", F.lit(0))).alias("total")).alias("payload"),
    )
    candidate = F.concat(search_id, F.lit("_candidate:"), F.col("candidate").cast("string"))
    name = case_name(F.col("plaintiff"), F.col("defendant"))
    message = _has(searched, "message")
    below = [
        (F.concat("source", F.lit("_search_candidate")), F.lit("ready"), _payload("candidate", "found_id")),
        *((F.lit(n), o, p) for n, o, p in (
            _check("exact_case_name_check", F.col("name_check"), name, F.col("retrieved_name")),
            _check("semantic_case_name_check", _has(searched, "semantic_check"), name, F.col("retrieved_name")),
            _check("year_check", F.col("year_check"), F.col("year"), F.col("found_year")),
            _check("court_check", F.col("court_check"), F.col("court_id"), F.col("found_court")),
        )),
        (F.concat("source", F.lit("_search_candidate_assessment")), F.col("verdict"), _payload("found_id", F.col("retrieved_name").alias("case_name"), F.col("found_year").alias("year"), F.col("found_court").alias("court_id"), message.alias("message"))),
    ]
    steps = found.unionByName(_steps(searched, 4 + STRIDE * (place * GUARD + F.col("candidate") - 1), candidate, search_id, below))
    if terms is None:
        return steps
    status = F.when(F.col("preparation") == "prepared", "succeeded").when(F.col("preparation") == "failed", "failed").otherwise("skipped")
    ready = missing.select(*KEY, "court_id").join(terms, KEY)
    prepared = ready.select(*KEY, F.lit(1).alias("seq"), before.alias("node_id"), F.lit("search_term_preparation").alias("node_type"), status.alias("status"), F.col("preparation").alias("outcome"), F.array(root).alias("depends_on"), _payload("plaintiff_term", "defendant_term", "court_id").alias("payload"))
    return steps.unionByName(prepared)


def pinpoint_nodes(looked_up: DataFrame, pages: DataFrame, propositions: DataFrame, pinpoints: DataFrame) -> DataFrame:
    """Steps of found citations that name a page, to follow those of :func:`nodes`: the page, the proposition the citation
    stands for, and whether the one supports the other.  Without a page the later steps are not taken."""
    cite, root = F.col("citation_id"), F.concat("citation_id", F.lit(":exact_locator_lookup"))
    of = looked_up.where("lookup = 'found'").select(*KEY, F.col("pin_cite").alias("pin"), F.get("clusters", F.lit(0)).alias("cluster_id"))
    said = propositions.select(*KEY, F.col("outcome").alias("said"), "proposition", F.col("start").alias("said_start"), F.col("end").alias("said_end"))
    rows = of.join(pages.select(*KEY, "page_text"), KEY, "left").join(said, KEY, "left").join(pinpoints, KEY, "left")
    page = F.col("page_text").isNotNull()
    ids = [F.concat(cite, F.lit(f":{n}")) for n in ("reporter_page_retrieval", "citing_proposition", "pinpoint_support")]
    kinds = [
        (F.when(page, "found").otherwise("unavailable"), F.array(root), _payload("cluster_id", "pin", "page_text")),
        (F.when(page, F.coalesce("said", F.lit("failed"))), F.array(ids[0]), _payload("proposition", F.col("said_start").alias("start"), F.col("said_end").alias("end"))),
        (F.when(page, F.col("pinpoint")), F.array(ids[0], ids[1]), _payload("evidence_start", "evidence_end")),
    ]
    after = 1 + STRIDE * GUARD
    steps = F.array(*(F.struct(F.lit(after + at).alias("seq"), i.alias("node_id"), F.element_at(F.split(i, ":"), 2).alias("node_type"), o.alias("outcome"), d.alias("depends_on"), p.alias("payload")) for at, (i, (o, d, p)) in enumerate(zip(ids, kinds, strict=True))))
    taken = F.filter(steps, lambda x: x["outcome"].isNotNull())
    status = F.when(F.col("s.outcome") == "failed", "failed").otherwise("succeeded")
    return rows.select(*KEY, F.explode(taken).alias("s")).select(*KEY, "s.seq", "s.node_id", "s.node_type", status.alias("status"), "s.outcome", "s.depends_on", "s.payload")


def ancestors(nodes_of: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor, distance) over the graphs of dependencies, each of one document: one join a level, until a
    level adds nothing."""
    edges = nodes_of.select("doc_id", "node_id", F.explode("depends_on").alias("ancestor")).distinct()
    edges = written(edges, "edges")
    up = edges.select("doc_id", "node_id", "ancestor", F.lit(1).alias("distance"))
    level, distance = up, 1
    while True:
        distance += 1
        step = edges.select("doc_id", F.col("node_id").alias("ancestor"), F.col("ancestor").alias("next"))
        nearer = up.select("doc_id", "node_id", "ancestor")
        further = level.join(step, ["doc_id", "ancestor"]).select("doc_id", "node_id", F.col("next").alias("ancestor")).distinct()
        level = further.join(nearer, ["doc_id", "node_id", "ancestor"], "left_anti").withColumn("distance", F.lit(distance))
        level = written(level, "level")
        if level.isEmpty():
            return up
        up = up.unionByName(level)


def children(nodes_of: DataFrame) -> DataFrame:
    """doc_id, citation_id, parent, parent_type, child_type, n and only (the child, null unless there is exactly one) of every
    parent step and type of steps that depend on it."""
    edges = nodes_of.select(*KEY, F.col("node_id").alias("child"), F.col("node_type").alias("child_type"), F.explode(F.array_distinct("depends_on")).alias("parent"))
    parents = nodes_of.select(*KEY, F.col("node_id").alias("parent"), F.col("node_type").alias("parent_type"))
    grouped = edges.join(parents, [*KEY, "parent"]).groupBy(*KEY, "parent", "parent_type", "child_type").agg(F.count("*").alias("n"), F.min("child").alias("only"))
    return grouped.withColumn("only", F.when(F.col("n") == 1, F.col("only")))


def broken_invariants(nodes_of: DataFrame) -> DataFrame:
    """(rule, n): how often each rule of the step table is broken; all 0 for a sound table."""
    known = nodes_of.groupBy(*KEY).agg(F.collect_set("node_id").alias("known"))
    rule = lambda name, broken: broken.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    repeated = rule("repeated node id", nodes_of.groupBy("doc_id", "node_id").count().where("count > 1"))
    blank = rule("empty node id", nodes_of.where("coalesce(node_id, '') = ''"))
    loose = rule("unknown dependency", nodes_of.join(known, KEY).where(F.size(F.array_except("depends_on", "known")) > 0))
    lookups = rule("not one lookup", nodes_of.groupBy(*KEY).agg(F.count(F.when(F.col("node_type") == "exact_locator_lookup", 1)).alias("n")).where("n <> 1"))
    # Every candidate has one assessment; what a search says it selected is what follows it.
    candidate = F.col("node_type").isin("locator_candidate_evaluation", "opinion_search_candidate", "recap_search_candidate")
    by_child = children(nodes_of)
    settled = by_child.where(F.endswith("child_type", F.lit("_assessment")) & F.col("only").isNotNull()).select(*KEY, F.col("parent").alias("node_id"))
    open_ones = rule("not one assessment", nodes_of.where(candidate).join(settled, [*KEY, "node_id"], "left_anti"))
    every = repeated.unionByName(blank).unionByName(loose).unionByName(lookups).unionByName(open_ones)
    if "payload" not in nodes_of.columns:
        return every
    said = nodes_of.where("outcome = 'candidates'").select(*KEY, "node_id", F.get_json_object("payload", "$.total").cast("long").alias("total"))
    follow = by_child.where(F.endswith("child_type", F.lit("_search_candidate"))).select(*KEY, F.col("parent").alias("node_id"), F.col("n").alias("selected"))
    return every.unionByName(rule("selection and total differ", said.join(follow, [*KEY, "node_id"], "left").where("coalesce(selected, 0) <> coalesce(total, -1)")))


def citation_index(citations: Column, volume: Column, reporter: Column) -> Column:
    """The 1-based place of a cluster's own citation (array of volume, reporter, page) in the cited reporter; of the
    cited volume where several fit; null unless exactly one does."""
    places = F.sequence(F.lit(1), F.size(citations))
    zipped = F.when(F.size(citations) > 0, F.arrays_zip(places.alias("i"), citations.alias("c")))
    exact = F.filter(zipped, lambda x: (identity_part(x["c"]["reporter"]) == identity_part(reporter)) & (x["c"]["volume"] == volume))
    by_volume = F.filter(zipped, lambda x: x["c"]["volume"] == volume)
    return F.when(F.size(exact) == 1, exact[0]["i"]).when((F.size(exact) == 0) & (F.size(by_volume) == 1), by_volume[0]["i"])


def exported(citations: DataFrame, summaries_of: DataFrame) -> DataFrame:
    """Public verdict rows: id, locator_id, start, end, verdict (unavailable where there is no summary)."""
    joined = citations.join(summaries_of.select(*KEY, "overall"), KEY)
    full = (F.coalesce("volume", F.lit("")) != "") & (F.coalesce("reporter", F.lit("")) != "") & (F.coalesce("page", F.lit("")) != "")
    from docketry.functions.text import slug

    locator = F.when(full, slug(locator_text(F.col("volume"), F.col("reporter"), F.col("page"))))
    name = F.concat(F.lit("cite:"), F.col("doc_id").cast("string"), F.lit(":"), F.coalesce(locator, F.lit("none")), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return joined.select(name.alias("id"), locator.alias("locator_id"), "start", "end", F.coalesce("overall", F.lit("unavailable")).alias("verdict"))
