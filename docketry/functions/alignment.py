"""The best place of a quote in a text by edit distance, however poor: semi-global alignment, bit-parallel.

A column of the dynamic programme is kept as two integers of as many bits as the quote has characters (where it steps up and
where it steps down), so a character of the text costs a few operations on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.batches import parts

ALIGNED = "start int, end int, text string, distance int, score double"


def _distances(quote: str, text: str, anchored: bool) -> Iterator[int]:
    """After each character of ``text``, the least edits that turn ``quote`` into what ends there; what is compared begins
    anywhere, or ``anchored`` at the text's start."""
    m = len(quote)
    whole, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(quote):
        places[c] = places.get(c, 0) | 1 << i
    up, down, distance = whole, 0, m
    for c in text:
        same = places.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        right_up = down | ~(horizontal | up) & whole
        right_down = up & horizontal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        right_up = (right_up << 1 | anchored) & whole
        right_down = right_down << 1 & whole
        up = right_down | ~(vertical | right_up) & whole
        down = right_up & vertical
        yield distance


def best_partial(quote: str | None, text: str | None) -> tuple[int, int, int] | None:
    """Start, end and edit distance of the span of ``text`` nearest to ``quote``: the earliest end of the least distance, then
    the shortest span.  Null for a null or empty quote or a null text; where nothing agrees the span is empty, at 0."""
    if not quote or text is None:
        return None
    if (at := text.find(quote)) >= 0:
        return at, at + len(quote), 0
    least, end = len(quote), 0
    for i, d in enumerate(_distances(quote, text, False)):
        if d < least:
            least, end = d, i + 1
    if not end:
        return 0, 0, least
    # Backwards from that end: how little of the text gives this distance.
    back = text[max(0, end - len(quote) - least) : end][::-1]
    size = next(k + 1 for k, d in enumerate(_distances(quote[::-1], back, True)) if d == least)
    return end - size, end, least


def aligned(text: Column, quote: Column) -> Column:
    """struct<start, end, text, distance, score> of the span nearest to the quote; score: the share of the quote that needs no edit."""

    def one(t: str | None, q: str | None) -> dict | None:
        found = best_partial(q, t)
        return found and {"start": found[0], "end": found[1], "text": t[found[0] : found[1]], "distance": found[2], "score": 1 - found[2] / len(q)}

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, quotes in parts(batches):
            rows = [one(t, q) or dict.fromkeys(("start", "end", "text", "distance", "score")) for t, q in zip(texts, quotes, strict=True)]
            yield pd.DataFrame(rows, columns=["start", "end", "text", "distance", "score"]).astype({"start": "Int32", "end": "Int32", "distance": "Int32", "score": "Float64"})

    return F.pandas_udf(run, ALIGNED)(text, quote)
