"""Filings hold the whole text of every document."""

from docketry.operators import extraction as X
from docketry.plans.fixtures import PLACE, filings

SF = "/root/testdata/sf0.001"


def test_filings_keep_every_character_and_every_document(spark, tmp_path):
    late = "x" * 300 + " see 12 U.S. 34 and more"
    rows = [(0, late), (1, "short"), (2, None), (3, "y" * 900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cites = spark.createDataFrame([(0, 1, "A v. B, 1 F.2d 2"), (1, 2, "C v. D, 3 F.3d 4"), (1, 3, "E v. F, 5 F.3d 6")], "doc_id long, cite_no long, cite string")
    made = filings(spark, str(tmp_path), cites)
    got = {r["doc_id"]: r["text"] for r in made.collect()}
    assert got == {0: late[:PLACE] + " see A v. B, 1 F.2d 2.\n" + late[PLACE:], 1: "short see C v. D, 3 F.3d 4; see E v. F, 5 F.3d 6", 2: "", 3: "y" * 900}
    found = [(r["doc_id"], r["volume"], r["start"]) for r in X.extract(made).orderBy("doc_id", "start").collect()]
    assert found == [(i, v, got[i].index(s)) for i, v, s in [(0, "1", "A v. B"), (0, "12", "12 U.S."), (1, "3", "C v. D"), (1, "5", "E v. F")]]


def test_filings_of_the_tables_are_whole(spark):
    texts = {r["doc_id"]: r["text"] for r in filings(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        text = r["text"] or ""
        assert texts[r["doc_id"]].startswith(text[:PLACE]) and texts[r["doc_id"]].endswith(text[PLACE:])
