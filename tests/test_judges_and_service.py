"""Answers kept by prompt, citations a judge finds alone, the table function, and a service read as a data source."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from docketry.functions.grammar import cite_spans
from docketry.operators import extraction as X
from docketry.operators import frontier, judge, recovery, table_function
from docketry.sources import authority, service


def counting(folder):
    """The rules, with a file for every question."""

    class Counting(judge.RuleJudge):
        def __call__(self, task, prompt):
            import uuid

            open(f"{folder}/{task}-{uuid.uuid4().hex}", "w").close()
            return super().__call__(task, prompt)

    return Counting()


def test_each_distinct_prompt_is_asked_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    asked = lambda: len(list((tmp_path / "calls").iterdir()))
    asks, answers = counting(str(tmp_path / "calls")), judge.Answers(str(tmp_path / "answers"))
    rows = [(i, f"A{i % 7}", "B", f"A{i % 7} v. B", "mismatch") for i in range(200)] + [(300, None, "B", "x", "mismatch"), (301, "A", "B", "A v. B", "match")]
    checked = spark.createDataFrame(rows, "id int, plaintiff string, defendant string, retrieved_name string, name_check string")
    first = judge.judged_names(checked, asks, answers)
    plain = judge.judged_names(checked, judge.RuleJudge())
    key = lambda df: sorted((r["id"], r["semantic_check"]) for r in df.collect())
    assert key(first) == key(plain) and asked() == 8
    assert key(first) == key(plain) and key(judge.judged_names(checked, asks, answers)) == key(plain) and asked() == 8
    more = checked.unionByName(spark.createDataFrame([(400, "New", "B", "New v. B", "mismatch")], checked.schema))
    assert len(key(judge.judged_names(more, asks, answers))) == 203 and asked() == 9


def test_answers_that_do_not_hold_are_asked_again_later(spark, tmp_path):
    class Silent:
        def __call__(self, task, prompt):
            return "no json"

    answers = judge.Answers(str(tmp_path / "answers"))
    checked = spark.createDataFrame([("A", "B", "A v. B", "mismatch")], "plaintiff string, defendant string, retrieved_name string, name_check string")
    assert judge.judged_names(checked, Silent(), answers).first()["semantic_check"] == "failed"
    assert judge.judged_names(checked, judge.RuleJudge(), answers).first()["semantic_check"] in ("match", "mismatch")
    assert judge.judged_names(checked, Silent(), answers).first()["semantic_check"] != "failed"


def filing(n, gap=90):
    """A text with n citations."""
    return " ".join(f"{'word ' * (gap // 5)}as in Roe{'abcdefghij'[i % 10]} v. Doe, {i + 1} F.2d {i + 10}, 12 (1999)." for i in range(n))


def test_a_frontier_finds_what_is_in_the_windows(spark):
    texts = [filing(40), "no citation here " * 300, "", None, filing(1), filing(12, 10)]
    filings = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for proposals in (64, 3):  # the second makes windows split
        got = sorted((r["doc_id"], r["start"], r["end"]) for r in frontier.model_citations(filings, judge.RuleJudge(), proposals=proposals).collect())
        assert got == sorted((i, c["start"], c["end"]) for i, t in enumerate(texts) for c in cite_spans(t or "", True) if c["kind"] == "full_case")


def test_windows_that_fail_are_split_and_nothing_is_lost(spark):
    class Shortsighted(judge.RuleJudge):
        """Answers for short windows alone, and gives more than it saw."""

        def __call__(self, task, prompt):
            if task in ("gate", "citations") and len(prompt["window"]) > 700:
                return "too long"
            said = super().__call__(task, prompt)
            return json.dumps({"citations": [*json.loads(said)["citations"], "Nobody v. Noone, 9 U.S. 9", " "]}) if task == "citations" else said

    text = filing(30)
    got = frontier.model_citations(spark.createDataFrame([(1, text)], "doc_id long, text string"), Shortsighted(), least=400).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(c["start"], c["end"]) for c in cite_spans(text, True)] and {r["kind"] for r in got} == {"unknown"}
    with pytest.raises(ValueError, match="split"):
        frontier.proposed(spark.createDataFrame([(1, text)], "doc_id long, text string"), Shortsighted(), least=300)


def test_listed_citations_are_put_where_they_align_best(spark):
    class Sloppy(judge.RuleJudge):
        def __call__(self, task, prompt):
            return json.dumps({"citations": ["Roea w. Doe, 1 F.2d 10"]})

    text = filing(3)
    got = frontier.listed_citations(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), Sloppy()).collect()
    assert [(r["doc_id"], r["matched_text"], round(r["score"], 4)) for r in got] == [(1, "Roea v. Doe, 1 F.2d 10", round(1 - 1 / 22, 4))]


def test_the_table_function_gives_what_the_extractor_gives(spark):
    rows = [(1, filing(5), "x"), (2, None, "y"), (3, "", "z"), (None, "410 U.S. 113", "n")]
    filings = spark.createDataFrame(rows, "doc_id long, text string, source string")
    filings.createOrReplaceTempView("filings_of_a_test")
    table_function.register(spark)
    names = ["doc_id", "ordinal", "citation_id", "kind", "start", "end", "locator_start", "locator_end", "matched_text", "plaintiff", "page"]
    for options, tolerant in (("", False), (", tolerant => true", True)):
        got = spark.sql(f"SELECT * FROM extract_citations(TABLE(SELECT doc_id, source, text FROM filings_of_a_test) PARTITION BY doc_id{options})")
        assert got.columns[:3] == ["doc_id", "source", "ordinal"]
        want = X.extract(filings, tolerant=tolerant)
        assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect())) and want.count() == 5 + tolerant
    with pytest.raises(Exception, match="doc_id and text"):
        spark.sql("SELECT * FROM extract_citations(TABLE(SELECT doc_id FROM filings_of_a_test))").collect()


class Service(BaseHTTPRequestHandler):
    def _answer(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        key = self.path.rstrip("/").rpartition("/")[2]
        if key == "slow":
            time.sleep(3)
        statuses = {"limit": 429, "gone": 404, "down": 503, "locked": 403, "odd": 418}
        if key in statuses:
            return self._answer(statuses[key], "e" * 900)
        if key == "text":
            return self._answer(200, "<html>")
        self._answer(200, json.dumps({"id": int(key) if key.isdigit() else 0, "case_name": f"A v. B{key}", "agent": self.headers["User-Agent"], "auth": self.headers["Authorization"]}))

    def do_POST(self):
        self._answer(200, json.dumps({"form": self.rfile.read(int(self.headers["Content-Length"])).decode()}))

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def address():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_service_is_read_in_parallel_and_failures_stay_apart(spark, address):
    keys = [str(i) for i in range(20)] + ["limit", "gone", "down", "locked", "odd", "text", "slow", "7", "a b/c", None]
    got = service.responses(spark.createDataFrame([(k,) for k in keys], "key string"), base=address, path="/clusters/{key}/", token="t", timeout="1").cache()
    assert got.rdd.getNumPartitions() > 1 and got.count() == 28
    failed = {r["key"]: (r["status"], r["failure"], r["can_retry"], len(r["detail"])) for r in got.where("failure IS NOT NULL").collect()}
    assert {k: v[:3] for k, v in failed.items()} == {
        "limit": (429, "api_limit", True), "gone": (404, "not_found", False), "down": (503, "upstream_error", True), "locked": (403, "authentication", False),
        "odd": (418, "request_rejected", False), "text": (200, "invalid_response", False), "slow": (None, "timeout", True),
    }
    assert failed["limit"][3] == 500
    clusters = authority.clusters_of(got.where("failure IS NULL"))
    assert clusters.where("cluster_id = '7'").first()["case_name"] == "A v. B7"
    assert json.loads(got.where("key = '3'").first()["payload"])["auth"] == "Token t"


def test_lookups_are_posted(spark, address):
    got = service.responses(spark.createDataFrame([(json.dumps({"volume": "1", "reporter": "U.S.", "page": "2"}),)], "key string"), base=address, path="/citation-lookup/", method="POST").first()
    assert json.loads(got["payload"])["form"] == "volume=1&reporter=U.S.&page=2"


def test_a_service_that_is_not_there(spark, tmp_path, monkeypatch):
    keys = spark.createDataFrame([("1",), ("2",)], "key string")
    assert {r["failure"] for r in service.responses(keys, base="http://127.0.0.1:9", timeout="2").collect()} == {"transport"}
    (tmp_path / "1.json").write_text('{"id": 1}')
    monkeypatch.setenv("DOCKETRY_BASE", f"file://{tmp_path}")
    assert {(r["key"], r["failure"]) for r in service.responses(keys, path="/{key}.json").collect()} == {("1", None), ("2", "not_found")}
    monkeypatch.delenv("DOCKETRY_BASE")
    with pytest.raises(Exception, match="base must name"):
        service.responses(keys).collect()
    with pytest.raises(Exception, match="must be positive"):
        service.responses(keys, base="http://x", timeout="0").collect()


def test_pages_of_an_opinion_are_read_together(spark):
    html = '<p>a <b citation-index="1" label="5">*5</b> five <b citation-index="2" label="5">x</b> more <b citation-index="1" label="6">*6</b> six &amp;</p>'
    looked = spark.createDataFrame([(1, "a", 0, "5", ["c"]), (1, "b", 9, "6", ["c"]), (2, "c", 0, "7", ["c"]), (2, "d", 0, "5 n.3", ["c"]), (3, "e", 0, "5", ["none"])], "doc_id long, citation_id string, start int, pin_cite string, clusters array<string>").withColumn("lookup", F.lit("found"))
    opinions = spark.createDataFrame([("o2", "c", "lead", html), ("o1", "c", "dissent", "no"), ("o9", "none", "dissent", html)], "opinion_id string, cluster_id string, opinion_type string, html string")
    got = {r["citation_id"]: r["page_text"] for r in recovery.reporter_pages(looked, opinions).collect()}
    assert got == {"a": "*5 five x more", "b": "*6 six &", "c": None, "d": None}


def test_a_window_goes_out_once_for_gate_and_list_with_the_same_answers(spark, tmp_path):
    class Moody:
        """A gate that fails for some windows and shuts for others, lists that are not valid for some."""

        def __call__(self, task, prompt):
            text = prompt["window"]
            if task == "gate":
                return "no json" if "fails" in text else json.dumps({"has_citation": "shut" not in text})
            return "no json" if "bad" in text else json.dumps({"citations": [text]})

    texts = ["open", "shut", "gate fails", "bad", "shut, bad", "gate fails, bad"]
    windows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, start int, window string")
    once = frontier._listed(windows, Moody(), None)
    assert once._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    told = lambda df: sorted((r["doc_id"], r["__said"]["answer"]) for r in df.collect())
    want = [(0, '{"citations": ["open"]}'), (2, '{"citations": ["gate fails"]}'), (3, None), (5, None)]
    assert told(once) == told(frontier._listed(windows, Moody(), judge.Answers(str(tmp_path / "answers")))) == want
