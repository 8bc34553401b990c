"""The citation grammar: citations are read outwards from their locators.

A gazetteer finds the reporters of a text in one pass, whatever white space they are written with.  Where a volume stands
before one and a page after it, that is a locator: the case name is read leftwards from it, a word at a time, pin, court and
year rightwards, both within fixed bounds.  Time grows with the text, not with what its words look like.

The table of reporters is this library's own, made of base names and series by rule; others may be given.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np

from docketry.functions.gazetteer import Gazetteer, gazetteer

# Public abbreviations of reporters that come in series, with the number of series.
SERIES = {
    "F.": 4, "F. Supp.": 3, "L. Ed.": 2, "A.": 3, "P.": 3, "N.E.": 3, "N.W.": 2, "S.E.": 2, "S.W.": 3, "So.": 3, "N.Y.": 3, "N.Y.S.": 3, "A.D.": 3, "Misc.": 3,
    "Cal.": 5, "Cal. App.": 5, "Cal. Rptr.": 3, "Ill.": 2, "Ill. App.": 3, "Ohio St.": 3, "Ohio App.": 3, "Wash.": 2, "Wis.": 2, "Kan. App.": 2, "T.C.": 2, "Haw. App.": 1,
}
# Reporters of one series, and states whose name alone, or with App., is a reporter.
SINGLE = ["U.S.", "S. Ct.", "F. App'x", "F. App’x", "Fed. Appx.", "Fed. Cl.", "Ct. Cl.", "Cl. Ct.", "Ct. Int'l Trade", "C.C.P.A.", "F.R.D.", "B.R.", "M.J.", "C.M.A.", "Vet. App.", "T.C.M.", "U.S.L.W.", "U.S.P.Q.", "WL", "LEXIS", "U.S. LEXIS", "U.S. App. LEXIS", "U.S. Dist. LEXIS", "Mass. App. Ct.", "Pa. Super.", "Pa. Commw.", "N.J. Super.", "N.C. App.", "S.C.", "N.C.", "N.D.", "S.D.", "N.H.", "N.J.", "N.M.", "R.I.", "W. Va.", "Tex. Crim.", "Tex. Sup. Ct. J.", "Okla. Crim.", "D.C."]
STATES = ["Ala.", "Alaska", "Ariz.", "Ark.", "Colo.", "Conn.", "Del.", "Fla.", "Ga.", "Haw.", "Idaho", "Ind.", "Iowa", "Kan.", "Ky.", "La.", "Me.", "Md.", "Mass.", "Mich.", "Minn.", "Miss.", "Mo.", "Mont.", "Neb.", "Nev.", "Okla.", "Or.", "Pa.", "Tenn.", "Tex.", "Utah", "Vt.", "Va.", "Wyo."]
CODES = ["U.S.C.", "U.S.C.A.", "U.S.C.S.", "C.F.R.", "Fed. Reg.", "Stat."]
JOURNALS = ["Harv. L. Rev.", "Yale L.J.", "Stan. L. Rev.", "Colum. L. Rev.", "Mich. L. Rev.", "U. Chi. L. Rev.", "Cal. L. Rev.", "Geo. L.J.", "Va. L. Rev.", "N.Y.U. L. Rev.", "U. Pa. L. Rev.", "Tex. L. Rev.", "Duke L.J.", "Nw. U. L. Rev.", "Cornell L. Rev.", "Minn. L. Rev.", "Iowa L. Rev."]
# Court strings and the ids they stand for; the first spelling wins.
COURTS = {
    "1st Cir.": "ca1", "2d Cir.": "ca2", "3d Cir.": "ca3", "4th Cir.": "ca4", "5th Cir.": "ca5", "6th Cir.": "ca6", "7th Cir.": "ca7", "8th Cir.": "ca8", "9th Cir.": "ca9", "10th Cir.": "ca10", "11th Cir.": "ca11",
    "D.C. Cir.": "cadc", "Fed. Cir.": "cafc", "S.D.N.Y.": "nysd", "E.D.N.Y.": "nyed", "D. Mass.": "mad", "N.D. Cal.": "cand", "C.D. Cal.": "cacd", "N.D. Ill.": "ilnd", "E.D. Pa.": "paed", "D.N.J.": "njd", "D.D.C.": "dcd",
}
# Words before a case name that are not part of it ("In re" is), words within one that have no capital, and
# words that a comma may stand before.
SIGNALS = set("In See Accord Cf. But Also Compare Contra And Under Per Like Unlike As Thus While Although When Where Because Since Citing Quoting Following Both From With By On At If That This Here After Before Then Yet Moreover Similarly E.g. E.g., See, See,e.g.,".split())
CONNECTORS = set("of the and for in ex rel. rel & de la le del der den van von on behalf et al. al to a an d/b/a".split())
SUFFIXES = set("Inc. Inc LLC L.L.C. Ltd. Ltd Co. Co Corp. Corp L.P. LP LLP L.L.P. N.A. P.C. S.A. PLC Jr. Sr. II III IV et Trustee Warden Secretary Commissioner".split())
VERSUS = {"v.", "vs.", "V.", "VS.", "v"}
#: How far a name reaches to the left, in characters and in words.
REACH, WORDS = 400, 40
FIELDS = ("plaintiff", "defendant", "volume", "reporter", "page", "pin_cite", "extra", "year", "court", "publisher", "parenthetical")
# For texts that are searched by pattern alone.
PARTY = r"[A-Z][\w.&'’-]*(?: (?:of|the|and|for|in|ex|rel\.|&|[A-Z0-9][\w.&'’-]*)){0,40}"


def _ordinals(base: str, n: int) -> list[str]:
    """A base name and its series, written with and without blanks: ``F.``, ``F.2d``, ``F. 2d``."""
    series = ["", "2d", "3d", *(f"{k}th" for k in range(4, n + 1))][:n]
    return [f"{form}{gap}{s}" if s else form for form in dict.fromkeys((base, base.replace(". ", "."))) for s in series for gap in (("", " ") if s else ("",))]


@lru_cache
def case_reporters() -> tuple[str, ...]:
    bases = {**SERIES, **dict.fromkeys(SINGLE, 1), **dict.fromkeys(STATES, 2), **dict.fromkeys((f"{s} App." for s in STATES), 2)}
    return tuple(dict.fromkeys(form for base, n in bases.items() for form in _ordinals(base, n)))


CASE_REPORTERS = list(case_reporters())
CASE, LAW, JOURNAL = "full_case", "full_law", "full_journal"


class Table:
    """Reporters, codes and journals by their letters without white space."""

    def __init__(self, cases: tuple[str, ...], codes: tuple[str, ...], journals: tuple[str, ...]):
        self.kinds: dict[str, str] = {}
        self.spellings = {*cases, *codes, *journals}
        for kind, names in ((CASE, cases), (JOURNAL, journals), (LAW, codes)):
            self.kinds |= {"".join(n.split()): kind for n in names}
        self.gazetteer: Gazetteer = gazetteer(tuple(sorted(self.kinds)), 1)


@lru_cache
def table(cases: tuple[str, ...] | None = None) -> Table:
    return Table(cases or case_reporters(), tuple(CODES), tuple(JOURNALS))


# The numbers of a locator are whole ones: no parts of telephone, card or IP numbers, which may stand around a word that is
# a reporter's name too (``La.``, ``Or.``).
_VOLUME = r"(?<![\w.])(?<!\d-)(?:\d{1,3}|(?:1[6-9]|20)\d\d|(?<!\d )\d{4})"
_PAGE = r"(?P<page>\d{1,9})(?!\d| \d{4} \d{4}|\.\d{1,3}\.\d)"
_WHOLE = r"(?!\d{10}|\d{1,3}(?:\.\d{1,3}){3}(?!\w)|\d{4} \d{4} \d{4})"
_PIN = r"\*?\d+(?:[-–—]\*?\d+)?(?:,?[ ]?(?:&[ ])?(?:nn?|¶¶?)\.?[ ]?\d+(?:[-–—]\d+)?)?"
_PINS = rf"{_PIN}(?:, ?{_PIN}){{0,8}}(?!\w)"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|June?|July?|Aug|Sept?|Oct|Nov|Dec)[a-z]{0,6}\.? \d{1,2}, "


@lru_cache
def _patterns(tolerant: bool) -> dict[str, re.Pattern]:
    gap, must = (r"\s*", r"\s*") if tolerant else (" ", " ")
    aside = r"\((?P<parenthetical>(?:[^()]|\([^()]{0,200}\)){1,300})\)"
    forms = {
        "volume": rf"{_VOLUME}{must}\Z",
        "page": rf"(?:{gap}\((?P<extra>\d+ [A-Z][A-Za-z.' ]{{1,30}})\))?{must}{_PAGE}",
        "short": rf",?{gap if tolerant else ' '}at (?P<pin_cite>{_PINS})",
        "pin": rf",{gap}(?:at )?(?P<pin_cite>{_PINS})",
        "year": rf"{gap}\((?:(?P<court>[A-Z0-9][A-Za-z0-9.' ]{{0,80}}?){gap})?(?:{_MONTH})?(?P<year>\d{{4}})\)",
        "aside": rf"{gap}{aside}",
        "section": rf"{gap}(?:§+{gap})?{_WHOLE}(?P<page>\d[\w.-]{{0,60}}\w|\d)(?P<pin_cite>(?:\([A-Za-z0-9]{{1,5}}\)){{1,8}})?(?:{gap}\((?:(?P<publisher>[A-Z][A-Za-z. ]{{0,60}}?){gap})?(?P<year>\d{{4}})\))?",
        "comma": rf" ?,{must if not tolerant else r'\s+'}\Z",
        "parallel": rf",{gap}\Z",
    }
    return {k: re.compile(p) for k, p in forms.items()}


_ID = re.compile(rf"(?<!\w)(?:[Ii]d|[Ii]bid)\.(?:,? at (?P<pin_cite>{_PINS}))?")
_SUPRA = re.compile(rf", supra(?!\w)(?:,? at (?P<pin_cite>{_PINS}))?")
_REFERENCE = re.compile(rf",? at (?P<pin_cite>{_PINS})")
_AT = re.compile(r" at \*?\d")
_OPENING = re.compile("(?:[Ii]n re|[Ee]x parte) ")


_BLANK = np.array([chr(c).isspace() for c in range(1 << 16)])


def _marks(text: str) -> np.ndarray:
    """Where the characters of a text stand that are no white space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.flatnonzero(~_BLANK[np.minimum(codes, 0xFFFF)])


@lru_cache(maxsize=4)  # each reading of a text asks for them
def _hits(text: str, names: Table) -> tuple[str, list[tuple[int, int]], dict[int, int], np.ndarray | None]:
    """The text without white space, the reporters in it that a digit stands before, the end of the longest one of each place,
    and where the characters stand in the text."""
    flat = "".join(text.split())
    hits = [(a, b) for a, b in names.gazetteer.hits(flat) if a and flat[a - 1] in "0123456789"]
    longest: dict[int, int] = {}
    for a, b in hits:
        longest.setdefault(a, b)
    return flat, hits, longest, _marks(text) if hits else None


def _locators(text: str, tolerant: bool, names: Table) -> list[tuple[int, int, int, str, re.Match | None]]:
    """(volume start, reporter start, reporter end, kind, match of the page) of every reporter with a volume before it and something like a
    page after it, the longest reporter of a place, in order."""
    flat, hits, longest, places = _hits(text, names)
    found = []

    def place(i: int) -> int:
        return int(places[i])

    pattern = _patterns(tolerant)
    reached = -1
    for a, b in hits:
        if a < reached or b == len(flat):
            continue
        start, end = place(a), place(b - 1) + 1
        if not tolerant and text[start:end] not in names.spellings:
            continue
        volume = pattern["volume"].search(text, max(0, start - 40), start)
        if volume is None:
            continue
        kind = names.kinds[flat[a:b]]
        page = None if kind == LAW else pattern["page"].match(text, end)
        follows = page or (pattern["section"].match(text, end) if kind == LAW else kind == CASE and pattern["short"].match(text, end))
        # ``F.3d`` without a page is not page 3 of ``F.``: a page is no part of a longer reporter's last word.
        at = follows.end("page") if follows and "page" in follows.re.groupindex else None
        if at is not None and longest[a] > b and at < place(longest[a] - 1) + 1 and not text[at].isspace():
            continue
        if follows:
            found.append((volume.start(), start, end, kind, page))
            reached = b
    return found


def _name_like(word: str) -> bool:
    first = word[:1]
    if first in "(\"'“‘[":
        word = word.lstrip("(\"'“‘[")
        if not word:
            return False
        first = word[0]
    return (first.isupper() or first.isdigit() or first == "&" or word.rstrip(",") in CONNECTORS) and word[-1] != ")" and ";" not in word and ":" not in word


def _ends_sentence(word: str) -> bool:
    """A number, or a longer word, with a full stop and none within: not an abbreviation."""
    return word.endswith(".") and (word[:-1].isdigit() or len(word) > 6 and "." not in word[:-1] and "'" not in word and "’" not in word)


def _words_before(text: str, low: int, end: int) -> list[tuple[str, int, int]]:
    """Up to ``WORDS`` words between blanks that end at ``end``, none begun before ``low``; from the last line only."""
    begin = max(low, end - REACH)
    line = 0 if text[begin:end].isprintable() else max(text.rfind(c, begin, end) for c in "\n\r\t\f\v\x85  ") + 1
    begin = max(begin, line)
    words, at = [], begin
    for word in text[begin:end].split(" "):
        if word:
            words.append((word, at, at + len(word)))
        at += len(word) + 1
    if words and begin > max(low, line) and text[begin - 1] != " ":
        words = words[1:]  # cut off
    return words[-WORDS:]


def _trim(words: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without signals and connectors in front."""
    k = 0
    while k < len(words):
        word = words[k][0]
        after = words[k + 1][0] if k + 1 < len(words) else ""
        if word in ("In", "Ex") and after in ("re", "parte"):
            break
        if word in SIGNALS or word.rstrip(",") in SIGNALS or word in CONNECTORS or not (word[0].isupper() or word[0].isdigit()):
            k += 1
            continue
        break
    return words[k:]


def _left_of(words: list[tuple[str, int, int]]) -> int:
    """From which of ``words`` on they are one party: back to a word that no name holds, a sentence's end, or a comma
    that stands before no suffix."""
    k = len(words)
    while k:
        word = words[k - 1][0]
        after = words[k][0].rstrip(",") if k < len(words) else None
        joint = word in ("re", "parte") and k > 1 and words[k - 2][0] in ("In", "in", "Ex", "ex")
        if not joint and not _name_like(word) or word in VERSUS:
            break
        if after is not None and (_ends_sentence(word) or word.endswith(",") and after not in SUFFIXES):
            break
        k -= 1
    return k


def _parties(text: str, low: int, end: int) -> tuple[int, str | None, str | None] | None:
    """Start, plaintiff and defendant of the case name that ends at ``end``: ``P v. D``, or ``In re D`` and its like."""
    begin = max(low, end - REACH - 1)
    found = _parties_in(text[begin:end])
    return found and (begin + found[0], *found[1:])


@lru_cache(maxsize=4096)  # readings and windows of a text share names
def _parties_in(text: str) -> tuple[int, str | None, str | None] | None:
    """:func:`_parties` that end where ``text`` does."""
    words = _words_before(text, 0, len(text))
    k = len(words)
    while k and words[k - 1][0] not in VERSUS and (_name_like(words[k - 1][0]) or words[k - 1][0] in ("re", "parte")):
        k -= 1
    span = lambda part: text[part[0][1] : part[-1][2]].rstrip(",")
    if 0 < k < len(words) and words[k - 1][0] in VERSUS:
        left = words[: k - 1]
        left = _trim(left[_left_of(left) :])
        if left:
            return left[0][1], span(left), span(words[k:])
    for i in range(len(words) - 1, max(k, 1) - 1, -1):
        opening = words[i - 1][0], words[i][0]
        if opening in (("In", "re"), ("Ex", "parte"), ("in", "re"), ("ex", "parte")) and i + 1 < len(words):
            return words[i - 1][1], None, span(words[i - 1 :])
    return None


def _party(text: str, low: int, end: int) -> tuple[int, str] | None:
    """Start and text of the one party that ends at ``end``."""
    words = _words_before(text, low, end)
    words = _trim(words[_left_of(words) :])
    return (words[0][1], text[words[0][1] : words[-1][2]].rstrip(",")) if words else None


_NO_FIELDS = dict.fromkeys(FIELDS)


def _made(kind: str, text: str, start: int, end: int, inner: tuple[int, int], **fields: str | None) -> dict:
    return {"kind": kind, "start": start, "end": end, "locator_start": inner[0], "locator_end": inner[1], "matched_text": text[start:end], **_NO_FIELDS, **fields}


def _case(text: str, pattern: dict[str, re.Pattern], anchor: tuple, low: int, bound: int) -> dict | None:
    """The full or short case, or journal article, at a locator; ``low``: the end of what is before it, ``bound``: where the next begins."""
    volume_at, start, end, kind, page = anchor
    fields = {"volume": text[volume_at:start].rstrip(), "reporter": text[start:end]}
    short = pattern["short"].match(text, end, bound) if kind == CASE and page is None else None  # a page or ``at``, never both
    before = pattern["comma"].search(text, max(low, volume_at - 8), volume_at)
    if short:
        name = _party(text, low, before.start()) if before else None
        return _made("short_case", text, name[0] if name else volume_at, short.end(), (volume_at, short.end()), plaintiff=name and name[1], pin_cite=short["pin_cite"], **fields)
    if page is None:
        return None
    fields |= {"page": page["page"], "extra": page["extra"]}
    stop = page.end()
    if (pin := pattern["pin"].match(text, stop, bound)) is not None:
        fields["pin_cite"], stop = pin["pin_cite"], pin.end()
    if (year := pattern["year"].match(text, stop, bound)) is not None:
        fields |= {"court": year["court"], "year": year["year"]}
        stop = year.end()
        if (aside := pattern["aside"].match(text, stop, bound)) is not None:
            fields["parenthetical"], stop = aside["parenthetical"], aside.end()
    named = _parties(text, low, before.start()) if before and kind == CASE else None
    if named:
        fields |= {"plaintiff": named[1], "defendant": named[2]}
    return _made(kind, text, named[0] if named else volume_at, stop, (volume_at, page.end()), **fields)


def _law(text: str, pattern: dict[str, re.Pattern], anchor: tuple, bound: int) -> dict | None:
    volume_at, start, end, _, _ = anchor
    m = pattern["section"].match(text, end, bound) or pattern["section"].match(text, end)
    fields = {k: m[k] for k in ("page", "pin_cite", "publisher", "year")}
    return _made(LAW, text, volume_at, m.end(), (volume_at, m.end("page")), volume=re.match(r"\d+", text[volume_at:start])[0], reporter=text[start:end], **fields)


def _share(run: list[dict]) -> None:
    """Parallel locators of one case have one name, court and year."""
    for c in run[1:]:
        for f in ("plaintiff", "defendant"):
            c[f] = run[0][f]
    for c in run[:-1]:
        for f in ("court", "year", "parenthetical"):
            c[f] = run[-1][f]


def cite_spans(text: str, tolerant: bool = False, names: tuple[str, ...] | None = None) -> list[dict]:
    """Citations of a text in order, none overlapping.  ``tolerant``: the parts of a locator may be joined by any white space
    or none; ``names``: case reporters instead of the built-in ones."""
    return _with_back_references(text, located_spans(text, tolerant, names))


def located_spans(text: str, tolerant: bool = False, names: tuple[str, ...] | None = None) -> list[dict]:
    """Those of :func:`cite_spans` that have a locator of their own."""
    pattern = _patterns(tolerant)
    anchors = _locators(text, tolerant, table(names))
    out: list[dict] = []
    run: list[dict] = []
    for i, anchor in enumerate(anchors):
        low = out[-1]["end"] if out else 0
        if anchor[0] < low:
            continue
        bound = anchors[i + 1][0] if i + 1 < len(anchors) else len(text)
        made = _law(text, pattern, anchor, bound) if anchor[3] == LAW else _case(text, pattern, anchor, low, bound)
        if made is None:
            continue
        joined = run and made["kind"] == CASE and made["start"] == anchor[0] and run[-1]["year"] is None and pattern["parallel"].fullmatch(text, run[-1]["end"], anchor[0])
        if not joined:
            _share(run)
            run = []
        if made["kind"] == CASE:
            run.append(made)
        out.append(made)
    _share(run)
    return out


def _with_back_references(text: str, out: list[dict]) -> list[dict]:
    """``out`` with the citations that have no locator of their own: Id., supra and the names of its own cases."""
    begins, stops = [c["start"] for c in out], [c["end"] for c in out]

    def free(a: int, b: int) -> bool:
        i = bisect_right(stops, a)
        return i == len(begins) or b <= begins[i]

    more = [_made("id", text, m.start(), m.end(), m.span(), pin_cite=m["pin_cite"]) for m in _ID.finditer(text) if free(m.start(), m.end())] if "id." in text or "Id." in text else []
    out = sorted([*out, *more], key=lambda c: c["start"])
    begins, stops, more, last = [c["start"] for c in out], [c["end"] for c in out], [], 0
    for m in _SUPRA.finditer(text):
        i = bisect_right(stops, m.start())
        party = _party(text, max(last, stops[i - 1] if i else 0), m.start())
        if party and free(party[0], m.end()):
            more.append(_made("supra", text, party[0], m.end(), (party[0], m.end()), plaintiff=party[1], pin_cite=m["pin_cite"]))
            last = m.end()
    return _with_references(text, sorted([*out, *more], key=lambda c: c["start"]))


def _with_references(text: str, out: list[dict]) -> list[dict]:
    """Names of cases cited in full that stand again later with a page: ``Roe at 115``."""
    since: dict[str, tuple[int, str, str]] = {}
    for c in out:
        for f in ("plaintiff", "defendant"):
            if c["kind"] == CASE and c[f]:
                for name in dict.fromkeys((c[f], _OPENING.sub("", c[f]))):
                    since.setdefault(name, (c["end"], f, c[f]))
    if not since or not _AT.search(text):
        return out
    begins, stops = [c["start"] for c in out], [c["end"] for c in out]
    more = []
    for a, b in Gazetteer(tuple(since)).maximal(text):
        name = text[a:b]
        m = _REFERENCE.match(text, b)
        if m is None or a < since[name][0] or a and (text[a - 1].isalnum() or text[a - 1] in "&-'’"):
            continue
        i = bisect_right(stops, a)
        if i == len(begins) or m.end() <= begins[i]:
            more.append(_made("reference", text, a, m.end(), (a, m.end()), **{since[name][1]: since[name][2]}, pin_cite=m["pin_cite"]))
    return sorted([*out, *more], key=lambda c: c["start"])


_RUNS = re.compile("[ \t]{2,}")


@lru_cache(maxsize=4)
def collapse(text: str) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with runs of blanks and tabs made one blank, and (place in the result, characters left out up to there)."""
    parts, cuts, at, gone = [], [], 0, 0
    if "  " not in text and "\t" not in text:
        return text, cuts
    for m in _RUNS.finditer(text):
        parts.append(text[at : m.start()])
        parts.append(" ")
        gone += m.end() - m.start() - 1
        at = m.end()
        cuts.append((m.end() - gone, gone))
    parts.append(text[at:])
    return "".join(parts), cuts


def repaired_spans(text: str, tolerant: bool = False) -> list[dict]:
    """Citations found with runs of blanks collapsed, in places of the text as it is."""
    flat, cuts = collapse(text)
    found = cite_spans(flat, tolerant)
    if not cuts:
        return found
    places = [p for p, _ in cuts]

    def back(i: int) -> int:
        k = bisect_right(places, i)
        return i + (cuts[k - 1][1] if k else 0)

    for c in found:
        for a, b in (("start", "end"), ("locator_start", "locator_end")):
            c[a], c[b] = back(c[a]), back(c[b] - 1) + 1
        c["matched_text"] = text[c["start"] : c["end"]]
    return found
