"""Steps that ask for judgement.  A judge answers prompts; what it says counts only once it is grounded in the source.

:class:`RuleJudge` is a stand-in made of rules, for tests and dry runs.  It is not a model's equal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.batches import parts, structs
from docketry.functions.grammar import cite_spans, located_spans
from docketry.functions.grounding import grounded
from docketry.functions.text import normal_case_name, window_end, window_start
from docketry.operators.extraction import windows_around
from docketry.tables import exists

BUDGET = 2
_NAME = r"[A-Z][\w.&'’-]*(?:,?\s+(?:&|[A-Z0-9][\w.&'’-]*)){0,40}"
_NAMED = re.compile(rf"({_NAME})\s+v\.\s+({_NAME})\s*,")


class Judge(Protocol):
    """Answers one prompt with JSON text."""

    def __call__(self, task: str, prompt: dict) -> str: ...


@lru_cache(maxsize=8)
def _cases(window: str) -> list[str]:
    """The full cases of a window, which the gate and the list of citations ask for."""
    return [c["matched_text"] for c in located_spans(window, True) if c["kind"] == "full_case"]


class RuleJudge:
    """Answers by plain rules: names agree when their longer words do; the proposition is the sentence before the citation."""

    def __call__(self, task: str, prompt: dict) -> str:
        if task == "same_case":
            words = [{w.strip(".,").lower() for w in (prompt[k] or "").split() if len(w) > 3} for k in ("written", "retrieved")]
            return json.dumps({"outcome": "match" if words[0] and words[0] <= words[1] or words[1] and words[1] <= words[0] else "mismatch"})
        if task == "proposition":
            before = prompt["window"][: prompt["at"]].rstrip()
            sentence = before.rpartition(". ")[2].strip()
            return json.dumps({"outcome": "identified" if sentence else "inconclusive", "quote": sentence or None})
        if task == "parties":
            named = list(_NAMED.finditer(prompt["before"]))
            if not named:
                return json.dumps({"classification": "no_case_name", "plaintiff": None, "defendant": None})
            return json.dumps({"classification": "complete_case_name", "plaintiff": named[-1][1], "defendant": named[-1][2]})
        if task == "pinpoint":
            words = [{w.strip(".,*").lower() for w in prompt[k].split() if len(w) > 3} for k in ("proposition", "page")]
            holds = bool(words[0]) and 2 * len(words[0] & words[1]) >= len(words[0])
            return json.dumps({"verdict": "supports" if holds else "inconclusive", "reasoning": "shared words", "evidence_quote": prompt["page"] if holds else None})
        if task == "locators":
            found = [c for c in cite_spans(prompt["window"], True) if c["kind"] == "full_case" and 0 < c["locator_start"] and c["locator_end"] < len(prompt["window"])]  # not cut off
            return json.dumps({"locators": [{"text": prompt["window"][c["locator_start"] : c["locator_end"]], "volume": c["volume"], "reporter": c["reporter"], "page": c["page"]} for c in found]})
        if task == "docket":
            offered = json.loads(prompt["offered"]) if prompt.get("offered") else []
            after = prompt["window"].partition(prompt["docket"])[2]
            near = sorted((after.find(c), c) for c in offered if c in after)
            return json.dumps({"is_docket_citation": True, "docket": prompt["docket"], "court": near[0][1] if near else next(iter(offered), None)})
        if task == "search_terms":
            return json.dumps({f"{side}_term": re.sub(r",? Inc\.$", "", prompt[side]) for side in ("plaintiff", "defendant")})
        if task == "gate":
            return json.dumps({"has_citation": bool(_cases(prompt["window"]))})
        if task == "citations":
            return json.dumps({"citations": _cases(prompt["window"])})
        if task == "confirm":
            return json.dumps({"matches": prompt["candidate"].split() == prompt["excerpt"].split()})
        raise ValueError(f"no rule for {task}")


def answered(judge: Judge, task: str, prompt: dict, valid: Callable[..., bool], with_prompt: bool = False) -> tuple[str | None, str | None]:
    """A judge's valid answer to one prompt, else null and why, within ``BUDGET``."""
    error = None
    for _ in range(BUDGET + 1):
        try:
            said = judge(task, prompt)
            if valid(json.loads(said), *([prompt] if with_prompt else [])):
                return said, None
            error = "not valid"
        except ValueError as e:
            error = str(e)
    return None, error


SAID = "struct<answer:string,error:string>"


def asked(judge: Judge, task: str, prompt: Column, valid: Callable[..., bool], with_prompt: bool = False) -> Column:
    """struct<answer, error>: the judge's answer as JSON, asked again up to ``BUDGET`` times while it is not valid;
    ``valid`` sees the answer, and the prompt too if told so."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prompts in parts(batches):
            said = [answered(judge, task, p, valid, with_prompt) for p in prompts.to_pylist()]
            yield structs([{"answer": answer, "error": error} for answer, error in said], {"answer": pa.string(), "error": pa.string()})

    # A judge may answer differently each time, and each answer costs: it is not to be evaluated once a use.
    return F.arrow_udf(run, SAID).asNondeterministic()(prompt)


@dataclass(frozen=True)
class Answers:
    """A table of answers by prompt, for one judge: what was answered once is not asked again, in this run or a later one.

    ``path`` is a folder that all executors share.  A prompt's key is the hash of its task and its JSON; failed prompts are
    not kept, so a later run asks them again."""

    path: str

    def known(self, rows: DataFrame, task: str) -> DataFrame | None:
        """key and answer of the task's answers; null if there are none yet."""
        folder = f"{self.path.rstrip('/')}/{task}"
        if not exists(rows.sparkSession, folder):
            return None
        # A run that was cut off may have left answers that a later one asked for again: one of each key counts.
        return rows.sparkSession.read.schema("key string, answer string").parquet(folder).groupBy("key").agg(F.min("answer").alias("answer"))

    def ask(self, rows: DataFrame, judge: Judge, task: str, prompt: Column, valid: Callable[..., bool], with_prompt: bool) -> DataFrame:
        keyed = rows.withColumn("__prompt", prompt).withColumn("__key", F.sha2(F.concat(F.lit(f"{task}\n"), F.to_json("__prompt", {"ignoreNullFields": "false"})), 256))
        new = keyed.select("__key", "__prompt").dropDuplicates(["__key"])
        before = self.known(rows, task)
        if before is not None:
            new = new.join(before.withColumnRenamed("key", "__key"), "__key", "left_anti")
        asked_now = new.select(F.col("__key").alias("key"), asked(judge, task, F.col("__prompt"), valid, with_prompt).alias("said"))
        asked_now.where("said.answer IS NOT NULL").select("key", "said.answer").write.mode("append").parquet(f"{self.path.rstrip('/')}/{task}")
        answers = self.known(rows, task).select(F.col("key").alias("__key"), "answer")
        said = F.struct(F.col("answer"), F.when(F.col("answer").isNull(), "not valid").alias("error"))
        return keyed.join(answers, "__key", "left").withColumn("__said", said).drop("__prompt", "__key", "answer")


def with_answers(rows: DataFrame, judge: Judge, task: str, prompt: Column, valid: Callable[..., bool], with_prompt: bool = False, answers: Answers | None = None) -> DataFrame:
    """``rows`` with __said: the judge's answer to each row's prompt, asked a row, or a distinct prompt with ``answers``."""
    if answers is None:
        return rows.withColumn("__said", asked(judge, task, prompt, valid, with_prompt))
    return answers.ask(rows, judge, task, prompt, valid, with_prompt)


def judged_names(checked: DataFrame, judge: Judge, answers: Answers | None = None) -> DataFrame:
    """Adds semantic_check for rows whose exact name check is a mismatch: match, mismatch or failed; null elsewhere."""
    prompt = F.struct(F.concat_ws(" v. ", "plaintiff", "defendant").alias("written"), F.col("retrieved_name").alias("retrieved"))
    rows = with_answers(checked.where("name_check = 'mismatch'"), judge, "same_case", prompt, lambda a: a.get("outcome") in ("match", "mismatch"), answers=answers)
    outcome = F.coalesce(F.get_json_object("__said.answer", "$.outcome"), F.lit("failed"))
    return rows.withColumn("semantic_check", outcome).drop("__said").unionByName(checked.where("name_check <> 'mismatch'").withColumn("semantic_check", F.lit(None).cast("string")))


def propositions(citations: DataFrame, filings: DataFrame, judge: Judge, answers: Answers | None = None) -> DataFrame:
    """doc_id, citation_id, outcome and the grounded span of the proposition a citation stands for."""
    near = windows_around(filings, citations.select("doc_id", "citation_id", "start", "end"), 1200, 1200)
    low, high = (f(F.col("start"), F.col("end"), F.col("n_chars")) for f in (window_start, window_end))
    windows = near.select("doc_id", "citation_id", low.alias("low"), F.substring("window", low - F.col("low") + 1, high - low).alias("window"), (F.col("start") - low).alias("at"))
    said = with_answers(windows, judge, "proposition", F.struct("window", "at"), lambda a: a.get("outcome") in ("identified", "inconclusive") and (a["outcome"] == "identified") == bool(a.get("quote")), answers=answers)
    placed = said.withColumn("quote", F.get_json_object("__said.answer", "$.quote")).withColumn("place", grounded(F.col("window"), F.col("quote")))
    found = F.col("place.start").isNotNull()
    outcome = F.when(F.col("__said.answer").isNull(), "failed").when(F.col("quote").isNotNull() & ~found, "failed").when(found, "identified").otherwise("inconclusive")
    return placed.select("doc_id", "citation_id", outcome.alias("outcome"), F.col("place.text").alias("proposition"), (F.col("low") + F.col("place.start")).alias("start"), (F.col("low") + F.col("place.end")).alias("end"), F.col("place.method").alias("method"))


def grounded_parties(windows: DataFrame) -> DataFrame:
    """Adds is_grounded: whether each proposed party (plaintiff, defendant) occurs in ``before``, whatever its white space."""
    folded = normal_case_name(F.col("before"))
    holds = lambda c: F.col(c).isNull() | F.contains(folded, normal_case_name(F.col(c)))
    return windows.withColumn("is_grounded", holds("plaintiff") & holds("defendant"))
