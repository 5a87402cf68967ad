"""Personal data in whole texts, also where it is disguised, at the places of the source characters."""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm.common import append, texts_of
from matchweave.llm.endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")

# The patterns below match what the plain ones match, but never try a run of characters twice:
# a look behind allows a start only where a run starts, and possessive repeats don't step back.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str):
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def _ips(text: str):
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain identifiers, by kind and then place."""
    finders = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}
    return [(kind, a, b) for kind in KINDS for a, b in finders[kind](text)]


class Rewritten:
    """A text after some replacements, which maps its places back to the places before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.new, self.old, self.old_end, pieces = [], [], [], []  # of segments: starts, and ends in the old text
        at = length = 0
        for start, end, by in [*edits, (len(text), len(text), "")]:
            for a, b, words, same in ((at, start, text[at:start], True), (start, end, by, False)):
                if words:
                    self.new.append(length)
                    self.old.append(a)
                    self.old_end.append(-1 if same else b)
                    pieces.append(words)
                    length += len(words)
            at = end
        self.text = "".join(pieces)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The old characters that made the new characters ``start`` to ``end``."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        first = self.old[i] + (start - self.new[i] if self.old_end[i] < 0 else 0)
        return first, self.old[j] + end - self.new[j] if self.old_end[j] < 0 else self.old_end[j]


# Letters of other scripts that look like a Latin one, in pairs.
_LOOKALIKES = (
    "аa еe оo рp сc уy хx іi ѕs јj ԁd һh ԛq ԝw ѵv АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЅS ЈJ "
    "αa οo νv ρp ιi κk τt ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ɑa ɡg ıi օo")
# Spelled digits of four languages, 0 to 9 (with the spoken 0 of telephone numbers).
_SPELLED = (
    "zero one two three four five six seven eight nine", "oh one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve")
_AT, _DOT = r"(?:at|@|arobase|arroba|ät)", r"(?:dot|\.|punkt|point|punto)"

_LOOKALIKE = {pair[0]: pair[1] for pair in _LOOKALIKES.split()}
_DIGIT = {word: str(i) for words in _SPELLED for i, word in enumerate(words.split())}
_WORD = "|".join(sorted(_DIGIT, key=len, reverse=True))
_UNIT = rf"(?:{_WORD}|[0-9]+)"
_GAP = r"(?:[ ,-]{1,2}|[ -]?(?:dash|minus)[ -]| ?(?:dot|point|punkt|punto) |[.])"
_NUMBER = re.compile(rf"(?<![^\W_])(?:plus[ -]|\+ ?)?{_UNIT}(?:{_GAP}{_UNIT})+(?![^\W_])", re.I)
_SOME_NUMBER = re.compile(rf"(?:(?<![^\W_])(?:{_WORD}){_GAP}{_UNIT}|[0-9]{_GAP}(?:{_WORD}))(?![^\W\d_])", re.I)
_PART = re.compile(rf"(?P<word>{_WORD})|(?P<own>[0-9]+)|(?P<plus>plus[ -]|\+ ?)|(?P<dash>[ -]?(?:dash|minus)[ -])"
                   r"|(?P<dot> ?(?:dot|point|punkt|punto) |[.])|(?P<gap>[ ,-]{1,2})", re.I)
_BRACKETED = re.compile(rf" ?[\[({{<] ?(?:(?P<at>{_AT})|{_DOT}) ?[\])}}>] ?", re.I)
_SAID_DOT = r" (?:dot|punkt|point|punto) "
_SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]++(?:(?:{_SAID_DOT}|\.)[A-Za-z0-9_%+-]++){{0,4}})"
                     rf"(?P<at> {_AT} |@)(?P<domain>[A-Za-z0-9-]++(?:(?:{_SAID_DOT}|\.)[A-Za-z0-9-]++){{1,6}})(?![A-Za-z0-9-])", re.I)
_SPOKEN_DOT = re.compile(_SAID_DOT, re.I)
_ANY_DOT = re.compile(rf"{_SAID_DOT}|\.", re.I)
# Endings that are common words of English, where "at this point in" is no address.
_ALSO_WORDS = frozenset("am as at be best by call case cool day deal do fast free fun go here help how in is it life live me "
                        "my new next no now off one open play read run so to today top us watch work world you".split())


@functools.lru_cache(1 << 16)
def _plain(character: str) -> str:
    """The ASCII character that another one stands for, itself if none, nothing if it is invisible."""
    if (found := _LOOKALIKE.get(character)) is not None:
        return found
    kind = unicodedata.category(character)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(character))
    if kind == "Pd":
        return "-"
    if kind == "Zs":
        return " "
    if character in "․。｡·":
        return "."
    same = unicodedata.normalize("NFKC", character)
    return same if len(same) == 1 and same.isascii() and kind not in ("No",) else character


def _glyphs(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    changed = "".join(c for c in set(text) if c > "\x7f" and _plain(c) != c)
    return [(m.start(), m.end(), _plain(m[0])) for m in re.finditer(f"[{re.escape(changed)}]", text)] if changed else []


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Runs with spelled digits, as digits; with one or two of them, the gaps next to other digits stay."""
    edits = []
    if not _SOME_NUMBER.search(text):
        return edits
    for run in _NUMBER.finditer(text):
        parts = [(m.lastgroup, m) for m in _PART.finditer(text, *run.span())]
        words = sum(kind == "word" for kind, _ in parts)
        if not words:
            continue
        say = {"own": None, "plus": "+", "dash": "-", "dot": ".", "gap": ""}
        for i, (kind, m) in enumerate(parts):
            by = _DIGIT[m[0].lower()] if kind == "word" else say[kind]
            if kind == "gap" and words < 3 and "own" in (parts[i - 1][0], parts[i + 1][0]):
                by = None
            if by is not None:
                edits.append((*m.span(), by))
    return edits


def _brackets(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)]


def _domain_end(text: str, m: re.Match) -> int:
    """Where the longest domain of a spoken address ends that has a known ending and a spoken dot, or 0."""
    at = m["at"].strip(" ").lower()
    start, end = m.span("domain")
    dots = list(_ANY_DOT.finditer(text, start, end))
    said_before = at == "@" == m["at"] and " dot " in m["local"].lower()
    for i in reversed(range(len(dots))):
        ending = text[dots[i].end():end].lower()
        said = {d[0].strip(" ").lower() for d in dots[:i + 1]} - {"."}
        word = "point" in said and at in ("at", "@") and ending in _ALSO_WORDS
        if ending in ENDINGS and not word and (said or said_before):
            return end
        end = dots[i].start()
    return 0


def _spoken(text: str) -> list[tuple[int, int, str]]:
    """The words for "@" and "." in an address that has a known ending.

    The domain has a word for the dot, or the local part " dot " in front of a plain "@".
    """
    edits, place = [], 0
    low = text.lower()
    if not any(f" {dot} " in low for dot in ("dot", "punkt", "point", "punto")):
        return edits
    while m := _SPOKEN.search(text, place):
        if not (end := _domain_end(text, m)):
            place = m.end("at")
            continue
        place = end
        edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(text, *m.span("local"))]
        if m["at"] != "@":
            edits.append((*m.span("at"), "@"))
        edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(text, m.start("domain"), end)]
    return edits


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers of the normalised text at their source characters, without those inside a base one of their kind."""
    steps, now = [], text
    for transducer in (_glyphs, _numbers, _brackets, _spoken):
        if edits := transducer(now):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    found = []
    own = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}  # of one kind: in order, apart
    for kind, start, end in detect(now) if steps else []:
        for step in reversed(steps):
            start, end = step.back(start, end)
        i = bisect_right(own[kind], start, key=lambda s: s[0]) - 1
        if i < 0 or end > own[kind][i][1]:
            found.append((kind, start, end))
    return found


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("disguised", T.BooleanType())])


def _spans(text: str) -> list[dict]:
    base = detect(text)
    found = [(*s, False) for s in base] + [(*s, True) for s in disguised(text, base)]
    found.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return [dict(zip(SPAN.names, s)) for s in found]


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``spans``: kind, start and end in code points, and whether the identifier is disguised.

    Spans are ordered by kind (email, ip, card, phone), then place.  Null and empty texts have none.
    Each text is read whole, in time proportional to its length.
    """
    def compute(batch):
        return [pa.array([_spans(t) for t in texts_of(batch, text)], _ARROW_SPANS)]

    return append(df, text, [T.StructField("spans", T.ArrayType(SPAN))], compute)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; spans that overlap become one.

    Null texts stay null.
    """
    def clean(words):
        if words is None:
            return None
        edits = []
        for s in sorted(_spans(words), key=lambda s: (s["start"], -s["end"])):
            if edits and s["start"] < edits[-1][1]:
                edits[-1][1] = max(edits[-1][1], s["end"])
            else:
                edits.append([s["start"], s["end"], f"[{s['kind'].upper()}]"])
        return Rewritten(words, [tuple(e) for e in edits]).text if edits else words

    def compute(batch):
        return [pa.array([clean(t) for t in batch.column(text).to_pylist()], pa.string())]

    names = df.columns
    return append(df, text, [df.schema[text]], compute).select(*names)


def joined(spans, only_base: bool):
    """The spans as one string: kind:start:end, comma-joined."""
    some = F.filter(spans, lambda s: ~s["disguised"]) if only_base else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


