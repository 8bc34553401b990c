"""Conversation structure repair by error-correcting Earley parsing.

A weighted grammar of roles says what a conversation is: nothing, or an optional system turn and pairs of user and
assistant.  Its terminals are rows: a row may be kept, reroled (to user or assistant) or deleted, and an empty user or
assistant row inserted, each at a cost.  A column of the chart holds items (production, dot) with the least (cost, audit) that
leads to them; the grammar is left-recursive, so every item begins at the first row and the next column needs none
but the last one.  The completed chart's audit (the initials of the edits in order) is the repair: which role a reroled or
inserted row takes follows from its place.

Only a symbol a row (role initial, first fault) goes to the parser; the least audits are shared lists, so a conversation of
any length takes a few of them.  Rows equal in conv_id, role and text are found on these three, so a
long conversation is dealt out; its symbols and then its repaired rows stream through one task, as one digest of all its texts
in order is asked for, and are never held.  Texts are shuffled once.

Null role or text counts as one space, a null conv_id is a conversation of its own, null turns come first, rows of one turn
go by role, then by the digest of their text; equal rows are duplicates.  Blank rows (empty or white space) and duplicates
are always deleted.  Extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table

# The grammar: (left side, right side).
GRAMMAR = (
    ("conversation", ()),
    ("conversation", ("dialogue",)),
    ("dialogue", ("user", "assistant")),
    ("dialogue", ("system", "user", "assistant")),
    ("dialogue", ("dialogue", "user", "assistant")),
)
ROLES = {"s": "system", "u": "user", "a": "assistant"}
FREE = ("user", "assistant")
#: Signatures of up to so many rows are parsed once a worker, of which it remembers so many.
SHORT, REMEMBER = 64, 100_000
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNCATED, NONE = "bdt-"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Audit:
    """An audit as a list from its last letter to its first; lists share their beginnings."""

    __slots__ = ("before", "letter", "size")

    def __init__(self, before: Audit | None, letter: str):
        self.before, self.letter, self.size = before, letter, before.size + 1 if before else 1

    @staticmethod
    def less(a: Audit | None, b: Audit | None) -> bool:
        """Whether ``a`` sorts before ``b``.  Back to where they part; what lies before is the same list.  Neither of two audits
        of one item and cost is a beginning of the other: more letters for the same rows are inserts, which cost."""
        out = False
        while a is not b:
            if b is None or a is not None and a.size > b.size:
                a, out = a.before, False  # so far ``b`` is the shorter one
            elif a is None or b.size > a.size:
                b, out = b.before, True
            else:
                if a.letter != b.letter:
                    out = a.letter < b.letter
                a, b = a.before, b.before
        return out

    @staticmethod
    def text(a: Audit | None) -> str:
        out = []
        while a is not None:
            out.append(a.letter)
            a = a.before
        return "".join(reversed(out))


class Chart:
    """The last column of the chart, fed a row at a time."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.made: dict[tuple[int, str], Audit] = {}
        self.column: dict[tuple[int, int], tuple[int, Audit | None]] = {(p, 0): (0, None) for p in range(len(GRAMMAR))}  # predicted
        self._close()

    def _longer(self, audit: Audit | None, letter: str) -> Audit:
        """One list for one sequence of letters, so that equal audits are the same object."""
        key = (id(audit), letter)
        if key not in self.made:
            self.made[key] = Audit(audit, letter)
        return self.made[key]

    @staticmethod
    def _offer(column: dict, item: tuple[int, int], cost: int, audit: Audit | None) -> bool:
        have = column.get(item)
        if have is not None and (have[0] < cost or have[0] == cost and not Audit.less(audit, have[1])):
            return False
        column[item] = (cost, audit)
        return True

    def _close(self) -> None:
        """Complete and insert until nothing gets better."""
        agenda = list(self.column)
        while agenda:
            item = agenda.pop()
            p, dot = item
            cost, audit = self.column[item]
            left, right = GRAMMAR[p]
            if dot == len(right):
                # Complete: productions that begin with this symbol were predicted in the first column, where it begins.
                for q, (_, other) in enumerate(GRAMMAR):
                    if other[:1] == (left,) and self._offer(self.column, (q, 1), cost, audit):
                        agenda.append((q, 1))
            elif right[dot] in FREE and self._offer(self.column, (p, dot + 1), cost + self.costs.insert, self._longer(audit, "I")):
                agenda.append((p, dot + 1))

    def feed(self, initial: str, fault: str) -> None:
        """The next column: the row of this role initial and first fault is deleted, kept or reroled."""
        column: dict[tuple[int, int], tuple[int, Audit | None]] = {}
        self.made = {}
        extra = self.costs.truncated if fault == TRUNCATED else 0
        for (p, dot), (cost, audit) in self.column.items():
            right = GRAMMAR[p][1]
            if dot == 0 and right[:1] == ("dialogue",):
                continue  # a completion looks for it in the first column
            self._offer(column, (p, dot), cost + self.costs.delete, self._longer(audit, "D"))
            if dot < len(right) and fault not in (BLANK, DUPLICATE) and right[dot] != "dialogue":
                if ROLES.get(initial) == right[dot]:
                    self._offer(column, (p, dot + 1), cost + extra, self._longer(audit, "K"))
                elif right[dot] in FREE:
                    self._offer(column, (p, dot + 1), cost + extra + self.costs.rerole, self._longer(audit, "R"))
        self.column = column
        self._close()
        # What a finished dialogue beats by more than any later row can win back goes: its audits need not be kept.
        least = min(c for (p, dot), (c, _) in self.column.items() if dot == len(GRAMMAR[p][1]) and dot)
        slack = 2 * self.costs.insert + self.costs.delete + self.costs.rerole
        self.column = {item: v for item, v in self.column.items() if v[0] <= least + slack}

    def result(self) -> tuple[int, str]:
        """Least cost and its least audit."""
        out: dict[tuple[int, int], tuple[int, Audit | None]] = {}
        for (p, dot), (cost, audit) in self.column.items():
            if GRAMMAR[p][0] == "conversation" and dot == len(GRAMMAR[p][1]):
                self._offer(out, (0, 0), cost, audit)
        cost, audit = out[0, 0]
        return cost, Audit.text(audit)


_known: dict[tuple[Costs, str], tuple[int, str]] = {}


def parsed(symbols: str, costs: Costs = Costs()) -> tuple[int, str]:
    """Cost and audit of a conversation, two letters a row: initial and fault."""
    out = _known.get((costs, symbols))
    if out is None:
        chart = Chart(costs)
        for i in range(0, len(symbols), 2):
            chart.feed(symbols[i], symbols[i + 1])
        if len(_known) >= REMEMBER:
            _known.clear()
        out = _known[costs, symbols] = chart.result()
    return out


def _summary(costs: Costs):
    """A function of sorted rows (conv_id, turn, initial, fault; fault null: no row) to the summaries of their conversations."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    class Conversation:
        def __init__(self, conv_id: int | None):
            self.id, self.faults, self.illegal = conv_id, dict.fromkeys("bdt-", 0), 0
            self.first = self.last = None
            self.turns, self.before = 0, None
            self.symbols: list[str] = []
            self.chart: Chart | None = None

        def add(self, turn: int | None, initial: str, fault: str) -> None:
            if turn is not None:
                if turn != self.last:
                    self.turns += 1
                if self.first is None:
                    self.first = turn
                self.last = turn
            self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + initial not in LEGAL
            self.before = initial
            self.symbols.append((initial if initial in ROLES else "-") + fault)
            if len(self.symbols) > SHORT:
                self.chart = self.chart or Chart(costs)
                for s in self.symbols:
                    self.chart.feed(s[0], s[1])
                self.symbols.clear()

        def row(self) -> tuple:
            if self.chart:
                for s in self.symbols:
                    self.chart.feed(s[0], s[1])
                cost, audit = self.chart.result()
            else:
                cost, audit = parsed("".join(self.symbols), costs)
            gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
            return self.id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        now, out = None, []
        for b in batches:
            for conv_id, turn, initial, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = Conversation(conv_id)
                if fault is not None:
                    now.add(turn, initial, fault)
            if len(out) > 1000:
                yield batch(out)
                out = []
        if now is not None:
            out.append(now.row())
        if out:
            yield batch(out)

    return run


def _plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text without nulls in the last two, and the text's digest."""
    space = F.lit(" ")
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return out.withColumn("digest", F.unhex(F.sha2("text", 256)))


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, nth (of equal rows of a conversation, from 1), initial and first fault of every row."""
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    truncated = text.rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*+\z")
    each = _plain(rows).select("conv_id", "turn", "role", "digest", blank.alias("blank"), truncated.alias("truncated"))
    fault = F.expr("CASE WHEN blank THEN 'b' WHEN nth > 1 THEN 'd' WHEN truncated THEN 't' ELSE '-' END")
    counted = each.withColumn("nth", F.expr("row_number() OVER (PARTITION BY conv_id, role, digest ORDER BY turn ASC NULLS FIRST)"))
    return counted.select("conv_id", "turn", "role", "digest", "nth", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def repair(rows: DataFrame, ids: DataFrame | None = None, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation in ``rows`` (conv_id, turn,
    role, text), and of those that only ``ids`` (conv_id) names, which have no rows."""
    each = symbols(rows)
    if ids is not None:
        each = each.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)
    stream = each.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "nth")
    return stream.select("conv_id", "turn", "initial", "fault").mapInArrow(_summary(costs), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """conv_id, turn (null: inserted), role, text and edit of every row that is left or inserted; the rows of a
    conversation follow each other in order, within one partition."""
    each = _plain(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "digest", "text")
    both = each.unionByName(summary.select("conv_id", "audit"), allowMissingColumns=True)
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, at, out, place, system, conv_id = "", 0, [], 0, 0, None

        def role() -> str:
            return "system" if place < system else FREE[(place - system) % 2]

        def inserts() -> None:
            nonlocal at, place
            while at < len(letters) and letters[at] == "I":
                out.append((conv_id, None, role(), "", "I"))
                at, place = at + 1, place + 1

        types = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], names=list(types))
            out.clear()
            return made

        for b in batches:
            for i, audit, turn, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if audit is not None:
                    inserts()
                    # An odd number of rows is left: the first one is a system turn.
                    letters, at, place, conv_id, system = audit, 0, 0, i, (len(audit) - audit.count("D")) % 2
                    continue
                inserts()
                edit, at = letters[at], at + 1
                if edit != "D":
                    out.append((i, turn, own if edit == "K" else role(), text, edit))
                    place += 1
                if len(out) >= 5000:
                    yield batch()
        inserts()
        if out:
            yield batch()

    return stream.select("conv_id", "audit", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and sha256 of the rows of :func:`repaired`, each as ``role:text``, joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, None
        for b in batches:
            ids, out = [], []
            for i, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or i != of:
                    if now is not None:
                        ids.append(of)
                        out.append(now.hexdigest())
                    now, of = hashlib.sha256(), i
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([now.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, sha256 string")


def _of(conv_id: Column, turn: Column) -> Column:
    return F.crc32(F.concat_ws(":", F.coalesce(conv_id.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut of their sentence ends, repeated or given another role, by the checksum of conversation and turn."""
    d = F.col("damage")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), _of(F.col("conv_id"), F.col("turn")).alias("damage")).where(d != 0)
    text = F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), d)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(d == 3, 2).otherwise(1)))).drop("damage", "copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    summary = repair(rows, conversations.select("conv_id"))
    hashed = digests(repaired(rows, summary)).withColumnRenamed("conv_id", "of")
    sha = F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return summary.join(hashed, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*summary.columns, sha.alias("repaired_sha256"))
