"""Kernels and operators on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.functions import grammar, grounding
from docketry.functions import text as T
from docketry.functions import verdicts as V
from docketry.operators import extraction as X
from docketry.operators import judge, scoring, validation
from docketry.sources import artifacts, documents


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


PARAGRAPH = "In Roe v. Doe, 410 U.S. 113, 120 (2d Cir. 1973), the rule was set. See 42 U.S.C. § 1983; Roe, 410 U.S. at 121; Id. at 122. Roe, supra, at 5."


def test_kinds_and_fields():
    found = grammar.cite_spans(PARAGRAPH)
    assert [c["kind"] for c in found] == ["full_case", "full_law", "short_case", "id", "supra"]
    case = found[0]
    assert (case["volume"], case["reporter"], case["page"], case["pin_cite"], case["year"], case["court"]) == ("410", "U.S.", "113", "120", "1973", "2d Cir.")
    assert PARAGRAPH[case["locator_start"] : case["locator_end"]] == "410 U.S. 113"
    assert (found[1]["volume"], found[1]["page"]) == ("42", "1983")


def test_spans_are_places_of_the_text_as_it_is():
    text = "😀 see  Roe v. Doe,  284  S.W.3d  303 (1999).\t\tId."
    found = grammar.repaired_spans(text)
    assert [c["kind"] for c in found] == ["full_case", "id"]
    assert text[found[0]["locator_start"] : found[0]["locator_end"]] == "284  S.W.3d  303"
    assert all(text[c["start"] : c["end"]] == c["matched_text"] for c in found)


def test_tolerant_grammar_reads_over_line_ends():
    assert not grammar.repaired_spans("at 214 F.3d\n\n1 there")
    assert grammar.cite_spans("at 214 F.3d\n\n1\n\n2 there", tolerant=True)[0]["page"] == "1"


def test_back_references(spark):
    out = X.resolve(X.extract(spark.createDataFrame([(1, PARAGRAPH), (2, "Id. at 3."), (3, None), (4, "")], "doc_id long, text string"))).orderBy("doc_id", "start").collect()
    first = out[0]["citation_id"]
    # The nearest citation before ``Id.`` is the short case, which stands for the first.
    assert [(r["kind"], r["resolves_to"]) for r in out if r["doc_id"] == 1] == [("full_case", None), ("full_law", None), ("short_case", first), ("id", first), ("supra", first)]
    assert [(r["kind"], r["resolves_to"]) for r in out if r["doc_id"] == 2] == [("id", None)]


@pytest.mark.parametrize(
    "source, quote, want",
    [
        ("The court held it so.", "court held", (4, 14, "exact")),
        ("The “court” — held  It so.", "the \"court\" - held it", (0, 22, "normalized")),
        ("one two three four five six seven eight nine ten eleven notice thirteen.", "one two three four five six seven eight nine ten eleven knowledge thirteen", (0, 72, "fuzzy")),
        ("He can go there by the road now. He can go there by the road now.", "He can go there by the road now.", (0, 32, "fuzzy")),
        ("They can be read to reach this case at all.", "They cannot be read to reach this case at all.", None),
        ("twice twice", "twice", None),
        (None, "x", None), ("x", None, None), ("x", "  ", None),
    ],
)
def test_quotes(source, quote, want):
    got = grounding.ground_quote(source, quote)
    assert (got and (got[0], got[1], got[3])) == want


def test_reporter_page_runs_to_the_next_marker_of_its_citation():
    html = '<p>a<i citation-index="1" label="622">*622</i> x</p><span citation-index="1" label="623">*623</span> target &amp; rule<b citation-index="2" label="9">*9</b> more<a citation-index="1" label="624">*624</a> after'
    assert grounding.reporter_page(html, 1, "623") == "*623 target & rule*9 more"
    assert grounding.reporter_page(html, 1, "700") is None and grounding.reporter_page(None, 1, "1") is None


@pytest.mark.parametrize("start, end, want", [(1000, 1100, (100, 1300)), (50, 100, (0, 1200)), (1950, 2000, (800, 2000))])
def test_citing_window(spark, start, end, want):
    args = (F.lit(start), F.lit(end), F.lit(2000))
    assert (value(spark, T.window_start(*args)), value(spark, T.window_end(*args))) == want


def test_scalars(spark):
    assert value(spark, F.array(*(T.numeric_pin(F.lit(p)) for p in ("442", "627-8", "627–8", "n. 3", "")))) == ["442", "627", "627", None, None]
    assert value(spark, T.case_name(F.lit("Ex Parte Young"), F.lit(""))) == "Ex Parte Young"
    assert value(spark, T.locators(F.lit("370 U.S. 626, 629-30, 82 S.Ct. 1386, 8 L.Ed.2d 734 (1962)"))) == ["370 U.S. 626", "82 S.Ct. 1386", "8 L.Ed.2d 734"]
    key = lambda *x: T.locator_key(*map(F.lit, x))
    assert value(spark, key("30", "F. App'x", "931") == key("30", "F.Appx", "931")) and not value(spark, key("320", "U.S.", "81") == key("3320", "U.S.", "81"))
    assert value(spark, T.masked(F.lit("abcdef"), F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"))))) == "a  def"


def test_header_and_body(spark):
    rows = [(1, "head \n\n--- Plain text ---\n body"), (2, "no marker"), (3, "\n--- Plain text ---\nx"), (4, None)]
    out = documents.from_column(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["header"], r["text"]) for r in out] == [("head", " body"), (None, "no marker"), (None, "x"), (None, None)]
    with pytest.raises(Exception, match="line end"):
        documents.from_column(spark.createDataFrame([(1, "x --- Plain text --- y")], "doc_id long, text string")).collect()


@pytest.mark.parametrize(
    "name, court, year, want",
    [("mismatch", "match", "match", "mismatch"), ("match", "mismatch", "match", "mismatch"), ("match", "unavailable", "match", "match"), ("match", "match", "mismatch", "partial_match"), ("unavailable", "match", "match", "partial_match"), ("failed", "match", "mismatch", "partial_match")],
)
def test_locator_verdicts(spark, name, court, year, want):
    assert value(spark, V.locator_verdict(*map(F.lit, (name, court, year)))) == want


def test_claims_are_made_once_and_in_order(spark):
    schema = "document long, identity string, start int, end int"
    expected = spark.createDataFrame([(1, "a", 10, 22), (1, "b", 0, 5), (2, "a", 0, 4), (2, "a", 5, 9)], schema)
    observed = spark.createDataFrame([(1, "a", 10, 23), (1, "a", 12, 20), (1, "c", 1, 2), (2, "a", 3, 8)], schema)
    got = scoring.scores(scoring.claims(expected, observed)).first()
    assert (got["tp"], got["fp"], got["fn"]) == (2, 2, 2)
    nothing = scoring.scores(scoring.claims(expected.limit(0), observed.limit(0))).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (0.0, 0.0, 0.0)


def test_claims_of_one_identity_equal_the_plain_way_and_take_linear_time(spark):
    import random
    import time

    rng = random.Random(5)
    schema = "document long, identity string, start int, end int, courts array<string>"
    made = lambda n: [(d, "x", a := rng.randint(0, 60), a + rng.randint(1, 9), rng.choice([None, ["p"], ["p", "q"], ["q"]])) for d in range(40) for _ in range(n)]
    expected, observed = made(6), made(7)
    want = []
    for d in range(40):
        free = sorted((r for r in observed if r[0] == d), key=lambda r: r[2])
        for e in sorted((r for r in expected if r[0] == d), key=lambda r: r[2]):
            hit = next((o for o in free if e[2] < o[3] and o[2] < e[3] and (o[4] is None and e[4] is None or o[4] is not None and e[4] is not None and set(o[4]) & set(e[4]))), None)
            free = [o for o in free if o is not hit]
            want.append((d, e[2], hit and hit[2]))
        want += [(d, None, o[2]) for o in free]
    got = scoring.claims(spark.createDataFrame(expected, schema), spark.createDataFrame(observed, schema)).collect()
    assert sorted(((r["document"], r["expected_start"], r["observed_start"]) for r in got), key=str) == sorted(want, key=str)
    many = spark.createDataFrame([(1, "x", 10 * i, 10 * i + 5) for i in range(50_000)], "document long, identity string, start int, end int")
    began = time.monotonic()
    assert scoring.scores(scoring.claims(many, many)).first()["tp"] == 50_000 and time.monotonic() - began < 60


def test_greedy_choice_of_longest(spark):
    rows = [(1, 0, 5), (1, 3, 12), (1, 11, 14), (2, 0, 1)]
    out = X.greedy_longest(spark.createDataFrame(rows, "doc_id long, start int, end int")).collect()
    assert sorted(map(tuple, out)) == [(1, 3, 12), (2, 0, 1)]


def test_own_citation_index(spark):
    own = F.array(*(F.struct(F.lit(v).alias("volume"), F.lit(r).alias("reporter"), F.lit("1").alias("page")) for v, r in (("5", "U.S."), ("6", "S. Ct."), ("7", "L. Ed."), ("7", "F.2d"))))
    index = lambda v, r: value(spark, validation.citation_index(own, F.lit(v), F.lit(r)))
    assert (index("6", "S.Ct."), index("5", "other"), index("7", "other"), index("9", "U.S.")) == (2, 1, None, None)


def test_judge_is_asked_again_and_must_be_grounded(spark):
    class Stubborn:
        def __call__(self, task, prompt):
            return "not json" if task == "same_case" else json.dumps({"outcome": "identified", "quote": "words that are nowhere"})

    checked = spark.createDataFrame([("A", "B", "A v. C", "mismatch"), ("A", "B", "A v. B", "match")], "plaintiff string, defendant string, retrieved_name string, name_check string")
    assert sorted((r["name_check"], r["semantic_check"]) for r in judge.judged_names(checked, Stubborn()).collect()) == [("match", None), ("mismatch", "failed")]
    text = "It is settled. Costs follow the event, see Roe v. Doe, 410 U.S. 113 (1973)."
    filings = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = X.extract(filings)
    assert [r["outcome"] for r in judge.propositions(found, filings, Stubborn()).collect()] == ["failed"]
    got = judge.propositions(found, filings, judge.RuleJudge()).first()
    assert (got["outcome"], text[got["start"] : got["end"]]) == ("identified", "Costs follow the event, see")


def test_artifacts_keep_null_fields_and_refuse_others(spark):
    filings = spark.createDataFrame([(1, PARAGRAPH)], "doc_id long, text string")
    whole = X.documents(filings, X.extract(filings))
    made = artifacts.extracted_json(whole)
    assert json.loads(made.first()["artifact"])["citations"][1]["plaintiff"] is None
    with pytest.raises(Exception, match="this version"):
        artifacts.read_extracted(made.withColumn("artifact", F.replace("artifact", F.lit('"schema_version":2'), F.lit('"schema_version":1'))), whole.schema["citations"].dataType.simpleString()).collect()


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from docketry.streaming.filings import read_stream, write_citations

    filings = spark.createDataFrame([(i, PARAGRAPH) for i in range(5)], "doc_id long, text string")
    filings.write.parquet(str(tmp_path / "in"))
    write_citations(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, X.extract(filings).collect()))


def test_search_finds_names_that_hold_both_parties(spark):
    asked = spark.createDataFrame([(1, "a", "not_found", "ca2", "Brown", "Board of Education", "1954"), (1, "b", "not_found", "ca2", "Brow", "Board", "1954"), (1, "c", "found", "ca2", "Brown", "Board", "1954"), (1, "d", "not_found", None, "Brown", "Board", "1954")], "doc_id long, citation_id string, lookup string, court_id string, plaintiff string, defendant string, year string")
    clusters = spark.createDataFrame([("1", "Oliver Brown v. Board of Education of Topeka", "1954-05-17", "ca2"), ("2", "Brown v. Board of Education", "1954-05-17", "ca9"), ("3", "Brown v. Education Board", "1954-05-17", "ca2")], "cluster_id string, case_name string, date_filed string, court_id string")
    dockets = spark.createDataFrame([("9", "ca2", "BROWN v. BOARD OF EDUCATION")], "docket_id string, court_id string, case_name string")
    got = validation.search(asked, clusters, dockets).collect()
    assert sorted((r["citation_id"], r["source"], r["found_id"], r["verdict"]) for r in got) == [("a", "opinion", "1", "mismatch"), ("a", "recap", "9", "possible_match")]


def test_quotes_of_a_small_file_are_read_by_all_cores(spark):
    from docketry.plans.queries import QUERIES

    for name in ("located_candidates", "grounded_quotes"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_a_worker_hands_back_its_rows_in_parts():
    import pandas as pd

    from docketry.functions.batches import ROWS, parts

    sizes = [len(p[0]) for p in parts([(pd.Series(range(2 * ROWS + 1)), pd.Series(range(2 * ROWS + 1)))])]
    assert sizes == [ROWS, ROWS, 1]
