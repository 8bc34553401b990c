"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score.

Everything is a column expression: no Python runs on the executors.  For each kind the text is split
at the pattern and the matches are extracted; as both walk the same matches, running sums of their
lengths give each match's place in code points.  Base kinds (email, ip, card, phone) are reported
whenever their validator holds.  The kinds the method adds (iban: mod-97; ssn and secret) need a
score of ``THRESHOLD``, which context words in the 48 characters before a match raise.

Null text counts as empty and has no spans.  Rows are handled one by one: repeated rows, repeated and
null ids change nothing.  Very long texts are searched whole, in time that grows with their length.
An empty table gives an empty result.  Extra columns do not matter; helper columns live in structs of
their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import fresh, table

# Starting only at the head of a run of class characters (or right after the last match) finds the
# same leftmost matches without trying every character of a long run again.  Groups that repeat
# without bound are possessive: java.util.regex walks others by recursion and overflows its stack.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}+(?:\.{_HOST}+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,64}(?![A-Za-z0-9_])",
}
BASE = ("email", "ip", "card", "phone")
#: A cheap test that must hold for a kind to match at all, so most texts never reach the pattern.
_HINTS = {"email": "@", "phone": "+", "ssn": "-"}


def _words(names: str) -> str:
    """A pattern of whole words; edges are ASCII's, whatever the JVM's own are."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{names})(?![A-Za-z0-9_])"


CONTEXT = {
    "email": _words("e-?mail|contact|write to"),
    "ip": _words("ip|address|host|server"),
    "card": _words("card|visa|mastercard|credit|payment"),
    "phone": _words("phone|call|tel|mobile|fax"),
    "iban": _words("iban|account|bank|transfer"),
    "ssn": _words("ssn|social|security"),
    "secret": _words("token|secret|password|passwd|key|apikey|api_key"),
}
#: Score without and with a context word; a checksum or strict shape carries the base kinds alone.
SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.9, 1.0), "phone": (0.7, 0.9), "iban": (0.9, 1.0), "ssn": (0.4, 0.8), "secret": (0.3, 0.9)}
THRESHOLD = 0.6
BEFORE = 48
#: Matches that are folded at once.
BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    marks = F.split(F.reverse(digits), "")
    marks = F.filter(marks, lambda c: c != "")
    weighed = F.transform(marks, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN (blanks allowed) leaves 1 modulo 97 once its first four characters go last."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    marks = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda a, c: F.when(c <= "9", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(marks, F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(000|666|9[0-9]{2})-|-00-|-0000$")
    if kind == "secret":  # of mixed letters and digits
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """struct(parts, matches) for one kind; null where the text cannot match."""
    pattern = F.lit(PATTERNS[kind])
    can = text.contains(_HINTS[kind]) if kind in _HINTS else text.rlike("[0-9]")
    return F.when(can, F.struct(F.split(text, PATTERNS[kind], -1).alias("parts"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches")))


def _spans(found: Column, kind: str) -> Column:
    """array<struct<start, end, value, score>> of the matches that hold, in order."""
    parts, matches = found["parts"], found["matches"]
    items = F.arrays_zip(F.slice(parts, 1, F.size(matches)).alias("part"), matches.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")

    def step(acc: Column, item: Column) -> Column:
        start = acc["at"] + F.length(item["part"])
        end = start + F.length(item["value"])
        plain, helped = SCORES[kind]
        near = F.right(item["part"], F.lit(BEFORE)).rlike(CONTEXT[kind])
        span = F.struct(start.alias("start"), end.alias("end"), item["value"].alias("value"), F.when(near, helped).otherwise(plain).alias("score"))
        return F.struct(end.alias("at"), F.when(_valid(kind, item["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    # Spans are gathered in blocks: adding one copies what its block holds, not all spans of a text.
    starting = lambda acc: F.struct(acc["at"].alias("at"), empty.alias("out"))

    def block(acc: Column, low: Column) -> Column:
        done = F.aggregate(F.slice(items, low, F.lit(BLOCK)), starting(acc), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    blocks = F.array().cast("array<array<struct<start:int,end:int,value:string,score:double>>>")
    lows = F.sequence(F.lit(1), F.greatest(F.size(matches), F.lit(1)), F.lit(BLOCK))
    folded = F.aggregate(lows, F.struct(F.lit(0).alias("at"), blocks.alias("out")), block, lambda acc: F.flatten(acc["out"]))
    kept = folded if kind in BASE else F.filter(folded, lambda s: s["score"] >= THRESHOLD)
    return F.when(F.size(matches) > 0, kept).otherwise(empty)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``pii``: a struct with an array of spans for each kind."""
    name = fresh(docs, "found")
    text = F.coalesce(F.col("text"), F.lit(""))
    proposed = docs.withColumn(name, F.struct(*(_found(text, k).alias(k) for k in PATTERNS)))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")
    return proposed.withColumn("pii", F.struct(*(F.coalesce(_spans(F.col(name)[k], k), empty).alias(k) for k in PATTERNS))).drop(name)


def _joined(pii: Column, kinds: tuple[str, ...]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(pii[kind], lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Every confirmed span replaced by ``[KIND]``; spans of any kind that overlap are merged and named after the first."""
    columns = docs.columns

    def named(kind: str) -> Column:
        return F.transform(F.col("pii")[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.upper()).alias("kind")))

    spans = F.array_sort(F.concat(*map(named, PATTERNS)))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), s["kind"], F.lit("]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, 1 << 30))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    found = find(docs)
    return found.withColumn("text", F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)).select(*columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pii = F.col("pii")
    return found.select("doc_id", *(F.size(pii[k]).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_joined(pii, BASE), 256).alias("base_sha256"), _joined(pii, tuple(PATTERNS)).alias("spans"))


# The same spans in SQL: patterns without looking around, runs of characters in place of it.
_RUNS = {"iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", "ssn": "[0-9-]+", "secret": "[A-Za-z0-9_]+"}
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
} | _RUNS
_SHAPES = {"ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", "secret": "length(m) BETWEEN 20 AND 64"}
_NEAR = "regexp_matches(near, '(?i)\\b(?:{})\\b')"
_HOLDS = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0",
    "card": """length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(generate_series(1, length(digits)), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)::INT
        WHEN substr(reverse(digits), i, 1)::INT > 4 THEN 2 * substr(reverse(digits), i, 1)::INT - 9 ELSE 2 * substr(reverse(digits), i, 1)::INT END)) % 10 = 0""",
    "phone": "length(digits) BETWEEN 8 AND 15",
    "iban": """list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda c: c::INT)), lambda a, d: (10 * a + d) % 97) = 1""",
    "ssn": "NOT regexp_matches(m, '^(000|666|9[0-9]{2})-|-00-|-0000$') AND " + _NEAR.format("ssn|social|security"),
    "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND " + _NEAR.format("token|secret|password|passwd|key|apikey|api_key"),
}


def _kind_sql(place: int, kind: str) -> str:
    pattern, text = _PLAIN[kind], "replace(t, '_', '.')" if kind == "iban" else "t"
    return f"""
{kind}_0 AS (
    SELECT doc_id, t, unnest(regexp_extract_all({text}, '{pattern}')) AS m, unnest(list_slice(string_split_regex({text}, '{pattern}'), 1, -2)) AS p, generate_subscripts(regexp_extract_all({text}, '{pattern}'), 1) AS i
    FROM d WHERE regexp_matches({text}, '{pattern}')
), {kind}_1 AS (
    SELECT doc_id, t, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM {kind}_0
), {kind}_2 AS (
    SELECT doc_id, t, m, stop - length(m) AS start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY stop), 0) AS last, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM {kind}_1 WHERE {_SHAPES.get(kind, "true")}
), {kind}_3 AS (
    SELECT doc_id, m, digits, start, stop, substr(t, (greatest(last, start - {BEFORE}) + 1)::BIGINT, (start - greatest(last, start - {BEFORE}))::BIGINT) AS near FROM {kind}_2
), {kind} AS (
    SELECT doc_id, {place} AS place, '{kind}' AS kind, start, '{kind}:' || start::BIGINT || ':' || stop::BIGINT AS span FROM {kind}_3 WHERE {_HOLDS[kind]}
)"""


OP8_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + ", ".join(_kind_sql(i, k) for i, k in enumerate(PATTERNS)) + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in PATTERNS) + f"""), per AS (
    SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(span, ',' ORDER BY place, start) FILTER (place < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY place, start) AS spans
    FROM every GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""
)
