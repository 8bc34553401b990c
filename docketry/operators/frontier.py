"""Citations that a judge alone finds: windows are asked in rounds, split where one answer cannot hold them.

The frontier is a table of windows still to be asked.  In a round a gate says which hold a citation, those are asked for all
they hold, word for word; a window with more than ``PROPOSALS`` answers, or without a valid one, is split in two halves that
overlap and goes into the next round, until it is no longer than ``LEAST``.  What is proposed counts where it is found
in its window and, if asked for, confirmed there; of overlapping places the longest stays.  Every round is a written table, so a
lost executor repeats one round at most, and with ``answers`` none of its questions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.alignment import aligned
from docketry.functions.batches import parts, structs
from docketry.functions.grounding import located_candidates
from docketry.operators import extraction as X
from docketry.operators.judge import Answers, Judge, answered, with_answers
from docketry.tables import written

SIZE, OVERLAP, LEAST, PROPOSALS = 1500, 300, 450, 64


def _boolean(name: str):
    return lambda a: isinstance(a.get(name), bool)


def _texts(answer: dict) -> bool:
    return isinstance(answer.get("citations"), list) and all(isinstance(c, str) for c in answer["citations"])


def _halves(windows: DataFrame, overlap: int) -> DataFrame:
    """Two windows for each, that share ``overlap`` characters."""
    size = F.length("window")
    half = F.ceil((size + overlap) / 2).cast("int")
    parts = F.array(F.struct(F.col("start").alias("start"), F.substring("window", F.lit(1), half).alias("window")), F.struct((F.col("start") + size - half).alias("start"), F.substring("window", size - half + 1, half).alias("window")))
    return windows.select("doc_id", F.explode(parts).alias("w")).select("doc_id", "w.start", "w.window")


def _listed(frontier: DataFrame, judge: Judge, answers: Answers | None) -> DataFrame:
    """The windows that pass the gate, with the judge's answer on what they hold.  A gate that failed lets its window pass: nothing
    is lost for want of an answer.  Where answers are kept each question has its table, else a window goes out once for both."""
    if answers is not None:
        gated = with_answers(frontier, judge, "gate", F.struct("window"), _boolean("has_citation"), answers=answers)
        held = gated.where(F.coalesce(F.get_json_object("__said.answer", "$.has_citation"), F.lit("true")) == "true").drop("__said")
        return with_answers(held, judge, "citations", F.struct("window"), _texts, answers=answers)

    def both(window: str) -> dict:
        gate, _ = answered(judge, "gate", {"window": window}, _boolean("has_citation"))
        passed = gate is None or json.loads(gate)["has_citation"]
        answer, error = answered(judge, "citations", {"window": window}, _texts) if passed else (None, None)
        return {"passed": passed, "answer": answer, "error": error}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for windows in parts(batches):
            yield structs([both(w) for w in windows.to_pylist()], {"passed": pa.bool_(), "answer": pa.string(), "error": pa.string()})

    said = F.arrow_udf(run, "struct<passed:boolean,answer:string,error:string>").asNondeterministic()
    return frontier.withColumn("__said", said("window")).where("__said.passed")


def proposed(filings: DataFrame, judge: Judge, answers: Answers | None = None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, proposals: int = PROPOSALS) -> DataFrame:
    """doc_id, start (of the window), window and candidates of every window that is settled, round by round."""
    if least <= overlap:
        raise ValueError("windows no longer than their overlap cannot be split")
    frontier, found = written(X.sliding_windows(filings, size, overlap), "frontier"), None
    while True:
        listed = _listed(frontier, judge, answers)
        texts = F.from_json(F.get_json_object("__said.answer", "$.citations"), "array<string>")
        each = F.array_distinct(F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), F.btrim), lambda c: c != ""))
        asked = written(listed.select("doc_id", "start", "window", each.alias("candidates"), F.col("__said.answer").isNull().alias("failed")), "round")
        more = (F.col("failed") | (F.size("candidates") > proposals)) & (F.length("window") > least)
        settled = asked.where(~more).where(F.size("candidates") > 0).select("doc_id", "start", "window", "candidates")
        found = settled if found is None else found.unionByName(settled)
        frontier = written(_halves(asked.where(more), overlap), "frontier")
        if frontier.isEmpty():
            return found


def model_citations(filings: DataFrame, judge: Judge, answers: Answers | None = None, confirm: bool = True, **how: int) -> DataFrame:
    """doc_id, start, end, matched_text, method and kind (``unknown``) of the citations a judge finds in ``filings``."""
    settled = proposed(filings, judge, answers, **how).select("doc_id", "start", "candidates", located_candidates(F.col("window"), F.col("candidates")).alias("found"))
    each = settled.select("doc_id", "start", F.explode(F.arrays_zip("candidates", "found")).alias("x"))
    places = each.select("doc_id", "start", F.col("x.candidates").alias("candidate"), F.col("x.found").alias("at")).where("at.start IS NOT NULL")
    if confirm:
        said = with_answers(places, judge, "confirm", F.struct("candidate", F.col("at.text").alias("excerpt")), _boolean("matches"), answers=answers)
        places = said.where(F.get_json_object("__said.answer", "$.matches") == "true")
    spans = places.select("doc_id", (F.col("start") + F.col("at.start")).cast("int").alias("start"), (F.col("start") + F.col("at.end")).cast("int").alias("end"), F.col("at.text").alias("matched_text"), F.col("at.method").alias("method"))
    return X.greedy_longest(spans).withColumn("kind", F.lit("unknown"))


def listed_citations(filings: DataFrame, judge: Judge, answers: Answers | None = None) -> DataFrame:
    """The plain way: a judge lists the citations of a whole text, each is put where it aligns best, however poorly."""
    said = with_answers(filings.where("text <> ''").select("doc_id", F.col("text").alias("window")), judge, "citations", F.struct("window"), _texts, answers=answers)
    texts = F.from_json(F.get_json_object("__said.answer", "$.citations"), "array<string>")
    each = said.select("doc_id", "window", F.explode(F.array_distinct(texts)).alias("candidate")).withColumn("at", aligned(F.col("window"), F.col("candidate"))).where("at.start IS NOT NULL")
    return each.select("doc_id", "at.start", "at.end", F.col("at.text").alias("matched_text"), F.col("at.score").alias("score"), F.lit("unknown").alias("kind"))
