"""Scalar functions on text, as column expressions.

White space is Unicode's (``(?U)``), as the JVM's ``\\s`` alone is ASCII's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.batches import parts

MARKER = "--- Plain text ---"
#: White space as Python's patterns and ``str.split`` have it, for the JVM's patterns.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Suffixes of the formats that are read, and the names they go by.
FORMATS = {"txt": "plain_text", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "html": "html", "htm": "html", "md": "markdown"}
# Patterns of locators and docket numbers.
REPORTER_WORD = r"(?:[A-Za-z][A-Za-z.'’]*|\.?[0-9]+[a-z]+)"
LOCATOR = rf"([0-9]+)\s+({REPORTER_WORD}(?:\s*{REPORTER_WORD}){{0,3}})\s*([0-9]+)(?![0-9])"
DOCKET = r"(?i)\b(?:No|Case No|Civil Action No|Civ\.? A\.? No|Docket No)\.?\s*[0-9]{1,2}[:\-][0-9]{2}[-\s]?[a-zA-Z]{2,4}[-\s]?[0-9]{2,6}(?:-[A-Za-z]{2,4})*"


def null_if_blank(x: Column) -> Column:
    return F.when(x != "", x)


def header_of(text: Column, marker: str = MARKER) -> Column:
    """The trimmed export header before the marker line; null where there is none or it is empty."""
    at = F.locate(marker + "\n", text)
    return null_if_blank(F.regexp_replace(F.when(at > 0, F.substring(text, F.lit(1), at - 1)), r"(?U)^\s+|\s+$", ""))


def strict_body(text: Column, marker: str = MARKER) -> Column:
    """The body after the marker line.  A marker that no line end follows is an error."""
    at = F.locate(marker + "\n", text)
    broken = (F.locate(marker, text) > 0) & (at == 0)
    return F.when(broken, F.raise_error(F.lit("the marker is not followed by a line end"))).when(at > 0, F.substring(text, at + len(marker) + 1, F.length(text))).otherwise(text)


def tolerant_body(text: Column, marker: str = MARKER) -> Column:
    """The body after the marker line, or the whole text."""
    at = F.locate(marker + "\n", text)
    return F.when(at > 0, F.substring(text, at + len(marker) + 1, F.length(text))).otherwise(text)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def source_format(path: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, suffix(path)), F.lit("unknown"))


def is_converted_format(path: Column) -> Column:
    return suffix(path).isin(sorted(set(FORMATS) - {"txt"}))


def reader_of(path: Column) -> Column:
    """Which reader a path goes to; an error for formats none reads."""
    return F.when(suffix(path) == "txt", "plain_text").when(is_converted_format(path), "converter").otherwise(F.raise_error(F.concat(F.lit("no reader for "), path)))


def collapse_spaces(text: Column) -> Column:
    """Runs of two or more blanks or tabs become one blank; line ends stay."""
    return F.regexp_replace(text, "[ \t]{2,}", " ")


def normal_case_name(x: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(x, r"(?U)\s+", " ")))


def normal_page_text(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def letters_and_digits(x: Column) -> Column:
    """Lower case, Unicode letters and digits only."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def identity_part(x: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def without_docket_label(x: Column) -> Column:
    """An identity without the labels it may begin with."""
    return F.regexp_replace(x, "^(?:nos?|case|civilaction|civ|cv|docket)+", "")


def normal_court(x: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_replace(x, r"[. ]+$", "")))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def search_term(x: Column) -> Column:
    """A quoted search term: backslashes first, then quotes are escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def case_name(plaintiff: Column, defendant: Column) -> Column:
    """``P v. D``; one party alone where the other is empty or null; else null."""
    p, d = null_if_blank(plaintiff), null_if_blank(defendant)
    return F.when(p.isNotNull() & d.isNotNull(), F.concat(p, F.lit(" v. "), d)).otherwise(F.coalesce(p, d))


def locator_text(volume: Column, reporter: Column, page: Column) -> Column:
    """``volume reporter page``; null if any part is."""
    return F.concat(volume, F.lit(" "), reporter, F.lit(" "), page)


def locator_key(volume: Column, reporter: Column, page: Column) -> Column:
    """Identity of a locator: spelling of the reporter does not count, digits do."""
    return F.concat_ws("|", F.coalesce(volume, F.lit("")), identity_part(F.coalesce(reporter, F.lit(""))), F.coalesce(page, F.lit("")))


def locators(text: Column) -> Column:
    """All locators in order, as they are written."""
    return F.regexp_extract_all(text, F.lit(LOCATOR), F.lit(0))


def dockets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DOCKET), F.lit(0))


def numeric_pin(pin: Column) -> Column:
    """The first page of a plain page or page range; null for anything else."""
    return null_if_blank(F.regexp_extract(F.btrim(pin), r"^([0-9]+)(?:[-–—][0-9]+)?$", 1))


def implausible_locator(text: Column) -> Column:
    """Without letters, begun inside a token, or of four numbers and more."""
    numbers = F.filter(F.split(text, r"\s+"), lambda w: w.rlike("^[0-9]+[.,]?$"))
    return ~text.rlike("[A-Za-z]") | text.rlike("^[^A-Za-z0-9]") | (F.size(numbers) >= 4)


def year_of(date: Column) -> Column:
    return F.substring(null_if_blank(date), 1, 4)


def absolute_url(origin: str, path: Column) -> Column:
    return F.concat(F.lit(origin), null_if_blank(path))


def resource_id(url: Column, resource: str) -> Column:
    """The last part of a URL's path, where the part before it names ``resource``."""
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    return F.when(F.try_element_at(parts, F.lit(-2)) == resource, F.try_element_at(parts, F.lit(-1)))


def run_document(path: Column) -> Column:
    """The document's number that a run file's name begins with (``006__name.json`` or ``6.json``), by which run files are
    ordered; any other name is an error."""
    number = F.regexp_extract(path, r"(?:^|/)([0-9]+)(?:__[^/]*)?\.[A-Za-z0-9]+$", 1)
    return F.when(number != "", number.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no document number: "), path)).cast("long"))


def window_start(start: Column, end: Column, length: Column, before: int = 900, size: int = 1200) -> Column:
    """Where the bounded window around a citation begins: ``before`` ahead of it, moved so the window stays in the text and holds the citation."""
    least = F.greatest(start - before, F.lit(0))
    return F.greatest(F.least(least, F.greatest(length - size, F.lit(0))), F.lit(0))


def window_end(start: Column, end: Column, length: Column, before: int = 900, size: int = 1200) -> Column:
    return F.least(F.greatest(window_start(start, end, length, before, size) + size, end), length)


def failed_quote_reason(quote: Column) -> Column:
    """Why a quote could not be found: what may be seen in it alone."""
    return F.when(quote.rlike(r"\.\.\.|…"), "ellipsis").when(quote.rlike("^[\"“].*[\"”]$"), "wrapped_quotes").otherwise("not_unique_or_absent")


def char_windows(text: Column, size: int = 1500, overlap: int = 300) -> Column:
    """Starts of sliding character windows; the last one is the first to reach the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap below it")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int") * step
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with every span blanked out."""
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = max(a, at), min(b, len(text))
        if a < b:
            out += [text[at:a], " " * (b - a)]
            at = b
    return "".join([*out, text[at:]])


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span (array of start and end, none overlapping) blanked out, its length unchanged: one pass over
    the pieces between."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, cuts in parts(batches):
            yield pd.Series([t if t is None or c is None else blanked(t, [(x["start"], x["end"]) for x in c]) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    return F.when(F.size(spans) > 0, F.pandas_udf(run, "string")(text, spans)).otherwise(text)
