"""String expressions shared by cleaning, extraction and ranking.

All are JVM-side Column expressions.  Whitespace means every Unicode space and the four
separator control characters; the default ``\\s`` class knows only the ASCII ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# Every whitespace character other than the plain space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")

# Keyword tables become literals in the plan, so they must stay configuration-sized.
MAX_LITERAL_ENTRIES = 5000


def check_literal_size(entries: Sequence | dict, what: str) -> None:
    if len(entries) > MAX_LITERAL_ENTRIES:
        raise ValueError(
            f"{what} has {len(entries)} entries; above {MAX_LITERAL_ENTRIES} join it as a table"
        )


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(col: Column) -> Column:
    """Turn each whitespace run into one space and trim."""
    return F.trim(F.regexp_replace(col, WHITESPACE, " "))


def title(col: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
    return F.when(col.isNotNull(), cased)


def title_if_shouting(col: Column) -> Column:
    """Title-case a text only if it has letters and all of them are upper case."""
    shouting = (col == F.upper(col)) & col.rlike(r"\p{L}")
    return F.when(shouting, title(col)).otherwise(col)


def slugify(col: Column) -> Column:
    runs = F.regexp_replace(F.lower(strip(col)), "[^a-z0-9]+", "_")
    return F.regexp_replace(runs, "^_+|_+$", "")


def spaced(col: Column) -> Column:
    """Lower-cased text with every whitespace character turned into a plain space.

    A character map and a split on one character are several times faster than splitting on
    a Unicode-aware pattern.
    """
    return F.translate(F.lower(F.coalesce(col, F.lit(""))), SPACES, " " * len(SPACES))


def tokens(col: Column) -> Column:
    """Lower-cased whitespace tokens, repeats kept."""
    return F.array_remove(F.split(spaced(col), " "), "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it.

    Branches of CASE and OR are evaluated lazily, so a shared sub-expression inside them (the
    lower-cased text of every keyword test) would be computed again in each.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(col: Column, phrases: Sequence[str]) -> Column:
    check_literal_size(phrases, "phrase list")
    return once(col, lambda text: reduce(
        lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False)))


def all_tags(text: Column, keywords: Sequence[tuple[str, str]]) -> Column:
    """Tags of every keyword inside ``text``, in table order, each once."""
    check_literal_size(keywords, "keyword table")
    return once(text, lambda t: F.when(t.isNotNull(), F.array_distinct(F.array_compact(F.array(
        *[F.when(F.contains(t, F.lit(k)), F.lit(tag)) for k, tag in keywords])))))


def first_tag(text: Column, keywords: Sequence[tuple[str, str]]) -> Column:
    """Tag of the first keyword in table order that is inside ``text``, else NULL."""
    check_literal_size(keywords, "keyword table")
    return once(text, lambda t: F.coalesce(
        *[F.when(F.contains(t, F.lit(k)), F.lit(tag)) for k, tag in keywords]))


def strip_tags(html: Column) -> Column:
    """Visible text of an HTML fragment: scripts, styles and comments out, tags to spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return collapse(unescape_basic(F.regexp_replace(bare, r"<[^>]+>", " ")))


def unescape_basic(col: Column) -> Column:
    """The five named entities every page uses; ``&amp;`` last so it is not unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def request_key(free_text: Column, criteria_json: Column) -> Column:
    """Cache key of a request: first 16 hex digits of the hash of its normalised content."""
    content = F.concat(F.lower(strip(free_text)), F.lit("|"), criteria_json)
    return F.substring(F.sha2(content, 256), 1, 16)


def percent(col: Column) -> Column:
    """``0.123`` as ``12.3%``; NULL as ``n/a``."""
    return F.coalesce(F.format_string("%.1f%%", col.cast("double") * 100), F.lit("n/a"))


def and_list(items: Column) -> Column:
    """``[a, b, c]`` as ``a, b and c``."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return (F.when(F.size(items) == 0, F.lit(""))
            .when(F.size(items) == 1, last)
            .otherwise(F.concat(head, F.lit(" and "), last)))


def distinct_ignoring_case(items: Column) -> Column:
    """Keep the first of entries that differ only in case, in order.

    Entries are sorted by their lower-cased text, so long lists take no pairwise comparison.
    """
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(
        F.lower(x).alias("key"), i.alias("at"), x.alias("value"))))
    first = once(keyed, lambda s: F.filter(
        s, lambda e, i: (i == 0) | (F.get(s, i - 1)["key"] != e["key"])))
    ordered = F.array_sort(F.transform(first, lambda e: F.struct(e["at"].alias("at"), e["value"].alias("value"))))
    return F.transform(ordered, lambda e: e["value"])
