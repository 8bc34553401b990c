"""Files that are read and written: texts, JSON lines, run files; proposals that bear another locator."""

import json
from pathlib import Path

import pytest

from docketry.functions import grounding
from docketry.operators import adjudication, extraction
from docketry.operators.judge import RuleJudge
from docketry.sources import artifacts, documents


def test_texts_of_a_folder_are_known_by_their_stems(spark, tmp_path):
    (tmp_path / "006__roe.txt").write_text("head\n--- Plain text ---\nRoe v. Doe, 410 U.S. 113 (1973)", encoding="utf-8")
    (tmp_path / "b.txt").write_text("only a body, é", encoding="utf-8")
    (tmp_path / "c.md").write_text("not read")
    got = sorted(map(tuple, documents.read_text(spark, str(tmp_path)).collect()))
    assert got == [("006__roe", "head", "Roe v. Doe, 410 U.S. 113 (1973)"), ("b", None, "only a body, é")]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError, match="no .txt file"):
        documents.read_text(spark, str(tmp_path / "none"))


def test_a_string_is_a_text_and_a_path_a_place(spark, tmp_path):
    text = "See Roe v. Doe, 410 U.S. 113 (1973)."
    (tmp_path / "a.txt").write_text(text)
    kinds = [[(r["kind"], r["page"]) for r in extraction.extract(documents.filings_of(spark, s)).collect()] for s in (text, tmp_path / "a.txt", Path(tmp_path))]
    assert kinds == [[("full_case", "113")]] * 3
    assert documents.filings_of(spark, str(tmp_path / "a.txt")).first()["text"] == str(tmp_path / "a.txt")


def test_json_lines_skip_blank_ones_and_refuse_broken_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "verdict": "match"}\n\n   \n{"id": 2, "verdict": null}\n')
    assert sorted(map(tuple, documents.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, verdict string").collect())) == [(1, "match"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed|bad record|parse"):
        documents.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id long, verdict string").collect()


def test_run_files_come_back_and_are_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "match"), (2, "b", None)], "document long, id string, verdict string")
    artifacts.write_runs(rows, str(tmp_path / "runs"), by="document")
    back = spark.read.schema("document long, id string, verdict string").json(str(tmp_path / "runs"))
    assert sorted(map(tuple, back.select("document", "id", "verdict").collect())) == [(1, "a", "match"), (2, "b", None)]
    one = next((tmp_path / "runs" / "document=1").glob("*.json"))
    assert json.loads(one.read_text().splitlines()[0]) == {"id": "a", "verdict": "match"}
    with pytest.raises(Exception, match="(?i)already exists"):
        artifacts.write_runs(rows, str(tmp_path / "runs"))


def test_a_proposal_counts_only_with_its_own_locator():
    chunk = "as the court held long ago in Roe v. Wade, 410 U.S. 113 (1973), and again"
    assert grounding.locate_candidate(chunk, "Roe v. Wade, 410 U.S. 113 (1973)")[3] == "exact"
    assert grounding.locate_candidate(chunk, "Roe v. Wade, 410 U. S. 113")[2] == "Roe v. Wade, 410 U.S. 113"
    for other in ("Roe v. Wade, 411 U.S. 113 (1973)", "Roe v. Wade, 410 U.S. 114 (1973)"):
        assert grounding.locate_candidate(chunk, other) is None


def test_arms_with_a_judge_find_what_is_damaged(spark):
    filings = spark.createDataFrame([(1, "See Roe v. Doe, 410 U.S. 113 (1973). Cf. 7 F.2d\n8 (1999).")], "doc_id long, text string")
    got = {name: sorted(r["page"] for r in arm(filings).collect()) for name, arm in adjudication.recovery_arms(RuleJudge()).items()}
    assert got == {"baseline": ["113"], "production": ["113"], "layout_tolerant": ["113", "8"], "production_recovery": ["113", "8"], "layout_tolerant_recovery": ["113", "8"]}
    both = extraction.extract_arms(filings, ("baseline", "layout_tolerant"))
    assert sorted((r["arm"], r["page"]) for r in both.collect()) == [("baseline", "113"), ("layout_tolerant", "113"), ("layout_tolerant", "8")]


def test_all_arms_in_one_pass_equal_each_arm_alone(spark, monkeypatch):
    texts = ["See Roe v. Doe, 410 U.S. 113 (1973). Cf. 7 F.2d\n8 (1999).", "Roe v. Doe, 410  U.S. 113 (1973); see Coe v. Moe, 7\nF.2d\n8 (9th Cir. 1999); 12 U.S.C. § 3", "+1 (988) 555-2485 La. 4984250489669609", "", None]
    filings = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    key = lambda r: (r["document"], r["start"], r["end"], r["identity"])
    alone = sorted((name, *key(r)) for name, arm in adjudication.recovery_arms(RuleJudge()).items() for r in arm(filings).collect())
    together = adjudication.all_arms(filings, RuleJudge())
    assert sorted((r["arm"], *key(r)) for r in together.collect()) == alone
    assert len({a for a, *_ in alone}) == 5
    # Texts are read by Python once for the five arms, and each arm's own reading is no more than a row of its answer.
    read = []
    monkeypatch.setattr(extraction.F, "arrow_udf", lambda f, t, make=extraction.F.arrow_udf: read.append(f.__qualname__) or make(f, t))
    adjudication.all_arms(filings, RuleJudge())
    assert [q for q in read if "arms_and_suspects" in q or "_spans" in q or "suspected" in q] == ["arms_and_suspects.<locals>.run"]
