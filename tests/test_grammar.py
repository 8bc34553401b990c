"""The citation grammar on forms that filings use, on very long texts, and against brute force; search and alignment."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docketry.functions import alignment, grammar
from docketry.functions.gazetteer import Gazetteer
from docketry.operators import extraction as X
from docketry.operators import search, validation
from docketry.tables import written


def fields(text, *names, tolerant=False):
    return [tuple(c[n] for n in ("kind", *names)) for c in grammar.repaired_spans(text, tolerant)]


CASE = ("plaintiff", "defendant", "volume", "reporter", "page", "pin_cite", "year", "court")


@pytest.mark.parametrize(
    "text, want",
    [
        ("See United States v. Smith & Co., Inc., 410 U.S. 113, 115 n.3 (1973).", ("United States", "Smith & Co., Inc.", "410", "U.S.", "113", "115 n.3", "1973", None)),
        ("Under Norton v. Shelby County, 118 U.S. 425, 442 (1886), an act", ("Norton", "Shelby County", "118", "U.S.", "425", "442", "1886", None)),
        ("in Cracker Barrel Old  Country  Store,  Inc.  v.  Epperson ,  284  S.W.3d  303,  312 (Tenn. 2009) held", ("Cracker Barrel Old Country Store, Inc.", "Epperson", "284", "S.W.3d", "303", "312", "2009", "Tenn.")),
        ("as In re Winship, 397 U.S. 358, 364 (1970), says", (None, "In re Winship", "397", "U.S.", "358", "364", "1970", None)),
        ("Ex parte Young, 209 U.S. 123 (1908)", (None, "Ex parte Young", "209", "U.S.", "123", None, "1908", None)),
        ("cf. 5 U.S. (1 Cranch) 137, 177 (1803)", (None, None, "5", "U.S.", "137", "177", "1803", None)),
        ("Smith v. Jones, 2005 WL 123456, at *3 (S.D.N.Y. Jan. 5, 2005)", ("Smith", "Jones", "2005", "WL", "123456", "*3", "2005", "S.D.N.Y.")),
        ("The motion was filed. UNITED STATES V. DOE, 12 F. 2d 5, 7-9 (2d Cir. 1930)", ("UNITED STATES", "DOE", "12", "F. 2d", "5", "7-9", "1930", "2d Cir.")),
        ("It was denied. Smith v. Doe, 12 Cal. App. 4th 5, 7, 9-10 (1999) (citing Roe v. Poe (1990))", ("Smith", "Doe", "12", "Cal. App. 4th", "5", "7, 9-10", "1999", None)),
        ("no name here 12 F.2d 5", (None, None, "12", "F.2d", "5", None, None, None)),
    ],
)
def test_full_cases(text, want):
    assert fields(text, *CASE) == [("full_case", *want)]


def test_other_kinds():
    text = "Roe v. Wade, 410 U.S. 113 (1973). See id. at 115; Ibid.; 28 U.S.C. § 636(b)(1)(A); Roe, 410 U.S. at 120, 122 n.5. 12 Yale L.J. 34 (1990). Wade, supra, at 9. Later Roe at 116, and Poe at 3."
    assert fields(text, "plaintiff", "defendant", "page", "pin_cite") == [
        ("full_case", "Roe", "Wade", "113", None), ("id", None, None, None, "115"), ("id", None, None, None, None), ("full_law", None, None, "636", "(b)(1)(A)"), ("short_case", "Roe", None, None, "120, 122 n.5"),
        ("full_journal", None, None, "34", None), ("supra", "Wade", None, None, "9"), ("reference", "Roe", None, None, "116"),
    ]


def test_parallel_locators_share_name_and_year():
    text = "Roe v. Wade, 410 U.S. 113, 93 S. Ct. 705, 35 L. Ed. 2d 147 (1973)"
    assert fields(text, *CASE) == [("full_case", "Roe", "Wade", v, r, p, None, "1973", None) for v, r, p in (("410", "U.S.", "113"), ("93", "S. Ct.", "705"), ("35", "L. Ed. 2d", "147"))]
    assert [c["matched_text"] for c in grammar.cite_spans(text)] == ["Roe v. Wade, 410 U.S. 113", "93 S. Ct. 705", "35 L. Ed. 2d 147 (1973)"]


def test_white_space_of_any_kind_when_tolerant():
    assert fields("410\u00a0U.S.\u00a0113 and 12\u2003F.\n2d\x1c5", "volume", "page", tolerant=True) == [("full_case", "410", "113"), ("full_case", "12", "5")]
    assert fields("410\u00a0U.S.\u00a0113") == []


def test_own_reporters():
    assert [c["reporter"] for c in grammar.cite_spans("see 3 Zork. Rep. 12 and 1 U.S. 2", names=("Zork. Rep.",))] == ["Zork. Rep."]


@pytest.mark.parametrize("part", ["UPPER ", "Capital ", "12 F.2d ", "Smith v. Doe, 12 F.2d 5, 7 (1999); id. at 5; Smith, supra, at 6; Smith at 9; ", "a" * 50 + ", supra ", "v. ", "1 U.S. (", "In re ", "1 U.S.C. § 1(a)"])
def test_time_grows_with_the_text(part):
    began = time.perf_counter()
    for tolerant in (False, True):
        grammar.repaired_spans(part * (1_000_000 // len(part)), tolerant)
    assert time.perf_counter() - began < 20


def test_a_hundred_thousand_capitals_take_under_a_second():
    for word in ("UPPER", "Capital"):
        began = time.perf_counter()
        assert len(grammar.cite_spans(" ".join([word] * 100_000) + ", 410 U.S. 113")) == 1
        assert time.perf_counter() - began < 1


def test_gazetteer_finds_what_brute_force_finds():
    rng = random.Random(4)
    strings = tuple({"".join(rng.choices("abc.", k=rng.randint(1, 5))) for _ in range(400)})
    for _ in range(60):
        text = "".join(rng.choices("abc. ", k=200))
        every = sorted(((i, i + len(s)) for s in strings if len(s) > 1 for i in range(len(text)) if text.startswith(s, i)), key=lambda h: (h[0], -h[1]))
        own = Gazetteer(strings)
        assert own.hits(text) == every
        kept = []
        for a, b in every:
            if not any(x <= a and b <= y and y - x > b - a for x, y in kept[-6:]):
                kept.append((a, b))
        assert own.maximal(text) == kept


def test_five_thousand_strings_in_linear_time():
    strings = tuple(f"Rep. {i}x" for i in range(5_000))
    own, text = Gazetteer(strings), "12 Rep. 77x 5 and Rep. 4999x; " * 40_000
    began = time.perf_counter()
    assert len(own.maximal(text)) == 80_000 and time.perf_counter() - began < 5


def test_the_prefilter_loses_nothing(spark):
    rng = random.Random(6)
    pieces = ["410", "U.S.", "113", " ", "\u00a0", "\u2003", "\x1c", "\x85", "\n", "F.", "2d", "id.", "Id.", "ibid.", "said.", "supra", ", ", "Roe", "v.", "at 5", "U.S.C.", "§", "é", "_id.", "12"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(2, 9))) for _ in range(20_000)]
    found = [t for t in texts if grammar.repaired_spans(t, True) or grammar.repaired_spans(t)]
    assert len(found) > 500
    assert spark.createDataFrame([(t,) for t in found], "text string").where(~F.col("text").rlike(X.HINT)).count() == 0


def test_references_resolve_to_one_case(spark):
    text = "Roe v. Wade, 410 U.S. 113, 93 S. Ct. 705 (1973). Roe at 115. Roe v. Doe, 1 F.2d 2 (1990). Roe at 3. Doe at 4. Id. at 5."
    out = X.resolve(X.extract(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("start").collect()
    to = {r["citation_id"]: r["page"] for r in out}
    assert [(r["kind"], to.get(r["resolves_to"])) for r in out] == [("full_case", None), ("full_case", None), ("reference", "705"), ("full_case", None), ("reference", None), ("reference", "2"), ("id", "2")]


def test_a_text_of_many_docket_numbers(spark):
    text = "x " * 200 + " ".join(f"Case No. 1:{i % 90 + 10}-cv-{i:05d} (S.D.N.Y.) and so on, é" for i in range(20_000))
    filings = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    began = time.perf_counter()
    sites = X.suspected_dockets(filings, X.court_table(spark))
    assert sites.count() == 20_000 and time.perf_counter() - began < 60
    first = sites.orderBy("site").first()
    assert text[first["start"] : first["end"]] == first["docket"] and [c["court_id"] for c in first["courts"]][0] == "nysd"


def test_windows_of_a_text_are_cut_together(spark):
    text = "".join(chr(97 + i % 26) for i in range(1_000))
    filings = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    places = spark.createDataFrame([(1, 0, 3, "a"), (1, 500, 510, "b"), (1, 990, 1000, "c"), (2, 1, 2, "d")], "doc_id long, start int, end int, name string")
    got = {r["name"]: (r["low"], r["window"]) for r in X.windows_around(filings, places, 20, 30).collect()}
    assert got == {"a": (0, text[:33]), "b": (480, text[480:540]), "c": (970, text[970:]), "d": (0, "short")}


def test_masking_many_spans(spark):
    from docketry.functions.text import masked

    text = "😀" + "abcdefghij" * 20_000
    spans = [(1 + 10 * i, 1 + 10 * i + 4) for i in range(20_000)]
    df = spark.createDataFrame([(text, spans), (None, spans), ("abc", []), ("abc", None), ("abc", [(1, 9)])], "text string, spans array<struct<start:int,end:int>>")
    got = [r["m"] for r in df.select(masked(F.col("text"), F.col("spans")).alias("m")).collect()]
    assert got == ["😀" + "    efghij" * 20_000, None, "abc", "abc", "a  "]


def plain_partial(quote, text):
    """The dynamic programme, all of it."""

    def last_row(a, b, free):
        row = [0] * (len(b) + 1) if free else list(range(len(b) + 1))
        for i in range(1, len(a) + 1):
            new = [i]
            for j in range(1, len(b) + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1])))
            row = new
        return row

    ends = last_row(quote, text, True)
    least = min(ends)
    end = ends.index(least)
    return next((s, end, least) for s in range(end, -1, -1) if last_row(quote, text[s:end], False)[-1] == least)


def test_partial_alignment_equals_the_dynamic_programme():
    rng = random.Random(1)
    for _ in range(1_500):
        quote, text = "".join(rng.choices("abc", k=rng.randint(1, 9))), "".join(rng.choices("abcd", k=rng.randint(0, 16)))
        assert alignment.best_partial(quote, text) == plain_partial(quote, text), (quote, text)
    assert alignment.best_partial("", "x") is None and alignment.best_partial("x", None) is None and alignment.best_partial(None, "x") is None


def test_partial_alignment_column(spark):
    df = spark.createDataFrame([("it was held in Roe v. Wade, 410 U.S. 113", "Roe w. Wade"), ("", "abc"), (None, "a"), ("a", None)], "t string, q string")
    got = [r["a"] and tuple(r["a"]) for r in df.select(alignment.aligned(F.col("t"), F.col("q")).alias("a")).collect()]
    assert got[0][:4] == (15, 26, "Roe v. Wade", 1) and abs(got[0][4] - 10 / 11) < 1e-9
    assert got[1][:4] == (0, 0, "", 3) and got[2:] == [(None,) * 5] * 2


def test_pages_of_a_search_join_without_gaps(spark):
    rng = random.Random(3)
    common = ["united", "states", "county", "smith", "jones", "doe", "board"]
    names = [("a" if i % 3 else "b", f"n{i}", " ".join(rng.choices(common, k=rng.randint(2, 5)) + ([f"rare{i % 40}"] if i % 2 else []))) for i in range(300)]
    df = spark.createDataFrame([*names, ("a", "none", None), ("a", "empty", " "), (None, "lost", "united")], "scope string, found_id string, name string")
    asked = [(0, "a", "United STATES"), (1, "a", "smith"), (2, "b", "doe, rare7!"), (3, "a", "nowhere"), (4, "a", ""), (5, "a", None), (6, "c", "smith"), (7, "b", "united states county smith")]
    queries = spark.createDataFrame(asked, "query_id long, scope string, text string")
    of = search.index(df, frequent=20, hot=7)  # most words are frequent, their lists dealt over salts
    assert of.postings.agg(F.max("salt")).first()[0] > 3
    results = search.ranked(queries, of).cache()
    want = {(q, i) for q, s, t in asked for scope, i, n in names if scope == s and t and t.strip() and set(t.lower().replace(",", "").replace("!", "").split()) <= set(n.split())}
    assert {(r["query_id"], r["found_id"]) for r in results.collect()} == want
    paged, after = [], None
    while True:
        shown = written(search.page(results, 25, after), "page")
        rows = shown.orderBy("query_id", "rank").collect()
        if not rows:
            break
        paged += rows
        after = search.cursors(shown, 25)
    whole = sorted(results.collect(), key=lambda r: (r["query_id"], -r["score"], r["found_id"]))
    assert sorted(((r["query_id"], -r["score"], r["found_id"]) for r in paged)) == [(r["query_id"], -r["score"], r["found_id"]) for r in whole]
    rare = {r["found_id"]: r["score"] for r in whole if r["query_id"] == 2}
    assert len(rare) and min(rare.values()) > 0


def test_search_says_when_it_found_too_many(spark):
    clusters = spark.createDataFrame([(f"c{i}", "Roe v. Doe", "1990-01-01", "ca2", None) for i in range(5)] + [("d1", "Poe v. Moe", "1990-01-01", "ca2", None)], "cluster_id string, case_name string, date_filed string, court_id string, docket_id string")
    dockets = spark.createDataFrame([], "docket_id string, court_id string, case_name string")
    rows = [(1, "a", "Roe", "Doe"), (1, "b", "Poe", "Moe"), (1, "c", "Zoe", "Noe"), (2, "a", "Poe", "Moe"), (2, "d", "Poe", None)]
    looked = spark.createDataFrame([(d, c, 0, p, q, "ca2", "1990", "not_found") for d, c, p, q in rows], "doc_id long, citation_id string, start int, plaintiff string, defendant string, court_id string, year string, lookup string")
    found, totals = validation.searches(looked, clusters, dockets)
    assert {(r["doc_id"], r["citation_id"], r["found_id"], r["verdict"]) for r in found.collect()} == {(1, "b", "d1", "possible_match"), (2, "a", "d1", "possible_match")}
    steps = {(r["doc_id"], r["citation_id"]): r["outcome"] for r in validation.search_nodes(looked, found, totals).where("node_type = 'opinion_search'").collect()}
    assert steps == {(1, "a"): "deferred_over_limit", (1, "b"): "candidates", (1, "c"): "none", (2, "a"): "candidates", (2, "d"): "missing_terms"}


def test_equal_ids_of_two_documents_stay_apart(spark):
    rows = [(1, "x:a", []), (1, "x:b", ["x:a"]), (2, "x:b", []), (2, "x:c", ["x:b"]), (2, "x:d", ["x:c"])]
    up = validation.ancestors(spark.createDataFrame(rows, "doc_id long, node_id string, depends_on array<string>"))
    assert sorted(map(tuple, up.collect())) == [(1, "x:b", "x:a", 1), (2, "x:c", "x:b", 1), (2, "x:d", "x:b", 2), (2, "x:d", "x:c", 1)]


@pytest.mark.parametrize("tolerant", [False, True])
@pytest.mark.parametrize("text", ["call +1 (258) 555-4892 La. 71 more", "4771431686562174 Or. 66", "see 13 Or. 71.23.45.67 there", "12 La. 4771431686562174", "221 Del. 4063 4152 7601 9474", "4063 4152 7601 9474 La. 71", "132 Stat. 71.23.45.67"])
def test_parts_of_other_numbers_are_no_locators(text, tolerant):
    assert grammar.cite_spans(text, tolerant) == []


@pytest.mark.parametrize("text", ["5 La. 71", "1999 WL 12345678", "21 Or. 71.", "17 C.F.R. § 240.10b-5", "9999 La. 71"])
def test_whole_numbers_are_locators(text):
    assert [c["matched_text"].rstrip(".") for c in grammar.cite_spans(text)] == [text.rstrip(".")]


@pytest.mark.parametrize("text", ["528\nF.3d", "382 N.E. 2d", "528 F. 3d; see Roe"])
@pytest.mark.parametrize("tolerant", [False, True])
def test_a_series_is_no_page_of_the_shorter_reporter(text, tolerant):
    assert grammar.cite_spans(text, tolerant) == []
