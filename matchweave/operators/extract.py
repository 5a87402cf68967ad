"""Profile fields from landed HTML pages.

Patterns that need no nesting are Column expressions over the page text.  Sections, prose
blocks and paragraphs need the element tree, so one Arrow pass parses each page once and
returns its pieces as columns; everything after that is Column expressions again.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from matchweave import vocab
from matchweave.functions.text import (
    all_tags, collapse, contains_any, distinct_ignoring_case, first_tag, once, strip, strip_tags, title,
    unescape_basic)
from matchweave.operators.clean import page_completeness
from matchweave.session import ship


# ---------------------------------------------------------------- title: name and credentials
def page_title(html: Column) -> Column:
    """Text before the site suffix in the title, or else the first h1."""
    raw = strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    head = strip(F.get(F.split(raw, r" \| "), F.lit(0)))
    h1 = strip_tags(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    return F.coalesce(F.nullif(head, F.lit("")), F.nullif(h1, F.lit("")), F.lit(""))


def _title_parts(text: Column) -> Column:
    return F.transform(F.split(text, ","), strip)


def name_from_title(text: Column) -> Column:
    """Comma parts before the first one with a credential, credentials removed."""
    def head(parts: Column) -> Column:
        first = F.array_position(F.transform(parts, lambda p: p.rlike(vocab.CREDENTIAL_PATTERN)), True)
        return once(first, lambda n: F.when(n == 0, parts).otherwise(F.slice(parts, 1, F.greatest(n.cast("int") - 1, F.lit(0)))))

    def joined(parts: Column) -> Column:
        return once(head(parts), lambda before: F.when(F.size(before) > 0, F.array_join(before, ", ")).otherwise(F.get(parts, F.lit(0))))

    name = once(_title_parts(text), joined)
    bare = strip(F.regexp_replace(strip(name), vocab.CREDENTIAL_PATTERN, ""))
    return strip(F.regexp_replace(bare, "^,+|,+$", ""))


def credentials_from_title(text: Column) -> Column:
    found = F.transform(_title_parts(text), lambda p: F.regexp_extract_all(
        p, F.lit(vocab.CREDENTIAL_PATTERN), F.lit(1)))
    return F.flatten(found)


# ---------------------------------------------------------------- tags, insurance, flags
def padded_lower(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def modality_tags(text: Column, keywords=vocab.MODALITY_KEYWORDS) -> Column:
    return all_tags(padded_lower(text), keywords)


def specialization_tags(text: Column, keywords=vocab.SPECIALIZATION_KEYWORDS) -> Column:
    return all_tags(F.lower(text), keywords)


def embedded_profile(html: Column, script_id: str = "__NEXT_DATA__") -> Column:
    """(sliding, insurers) struct of the JSON blob in a page script; NULL if absent or broken."""
    blob = F.regexp_extract(
        html, rf"(?is)<script[^>]*\bid=[\"']{script_id}[\"'][^>]*>(.*?)</script>", 1)
    profile = F.try_parse_json(F.nullif(blob, F.lit("")))
    root = "$.props.pageProps.profile"
    present = F.try_variant_get(profile, root, "variant").isNotNull()
    return F.when(present, F.struct(
        F.coalesce(F.try_variant_get(profile, f"{root}.slidingScale", "boolean"), F.lit(False))
        .alias("sliding"),
        F.coalesce(F.try_variant_get(profile, f"{root}.insuranceCompaniesList", "array<string>"),
                   F.array().cast("array<string>")).alias("insurers")))


def providers_from_names(names: Column) -> Column:
    """Insurer names to providers: the first fragment of each name wins, providers once."""
    return F.array_distinct(F.array_compact(
        F.transform(names, lambda n: first_tag(F.lower(n), vocab.INSURER_NAMES))))


def insurance_from_text(text: Column) -> Column:
    """(providers, sliding) from the text of an insurance or fee section."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = all_tags(lowered, vocab.INSURER_KEYWORDS)
    sliding = F.array_contains(found, "sliding_scale")
    listed = F.array_remove(found, "sliding_scale")
    none = F.array().cast("array<string>")
    default = (F.when(contains_any(lowered, vocab.OUT_OF_NETWORK_PHRASES), F.array(F.lit("out_of_network")))
               .when(contains_any(lowered, vocab.SELF_PAY_PHRASES), F.array(F.lit("self_pay")))
               .otherwise(none))
    refused = contains_any(lowered, vocab.INSURANCE_REFUSALS)
    providers = (F.when(refused, F.array(F.lit("self_pay")))
                 .when((F.size(listed) > 0) | sliding, listed).otherwise(default))
    return F.struct(providers.alias("providers"), (sliding & ~refused).alias("sliding"))


def session_format(text: Column, has_badge: Column | None = None) -> Column:
    lowered = F.lower(text)
    online = contains_any(lowered, vocab.ONLINE_PHRASES)
    if has_badge is not None:
        online = online | F.coalesce(has_badge, F.lit(False))
    office = contains_any(lowered, vocab.IN_PERSON_PHRASES)
    return (F.when(online & office, F.array(F.lit("both")))
            .when(online, F.array(F.lit("telehealth"))).otherwise(F.array(F.lit("in_person"))))


def accepting(page_text: Column, badge_text: Column | None = None) -> Column:
    """Whether new clients are taken: the badge decides, else the page; open by default."""
    open_ = ~contains_any(F.lower(F.coalesce(page_text, F.lit(""))), vocab.PAGE_CLOSED_PHRASES)
    if badge_text is None:
        return open_
    badge = F.lower(F.coalesce(badge_text, F.lit("")))
    return (F.when(contains_any(badge, vocab.BADGE_CLOSED_PHRASES), False)
            .when(F.contains(badge, F.lit("accepting")), True).otherwise(open_))


# ---------------------------------------------------------------- fees, city
def _fee(match: Column) -> Column:
    lo = F.nullif(F.regexp_extract(match, vocab.FEE_PATTERN, 1), F.lit("")).cast("int")
    hi = F.nullif(F.regexp_extract(match, vocab.FEE_PATTERN, 2), F.lit("")).cast("int")
    return F.when(lo.isNotNull(), F.struct(lo.alias("fee_min"), F.coalesce(hi, lo).alias("fee_max")))


def fee_range(fee_text: Column, page_text: Column) -> Column:
    """First fee of the fee or insurance text, else the first plausible one of the page."""
    direct = _fee(F.regexp_extract(F.coalesce(fee_text, F.lit("")), vocab.FEE_PATTERN, 0))
    everywhere = F.transform(
        F.regexp_extract_all(page_text, F.lit(vocab.FEE_PATTERN), F.lit(0)), _fee)
    plausible = F.filter(everywhere, lambda f: f["fee_min"].between(20, 1000))
    return F.coalesce(direct, F.get(plausible, F.lit(0)))


def slug_to_city(slug: Column) -> Column:
    return title(F.replace(slug, F.lit("-"), F.lit(" ")))


def city_from_page(html: Column, page_text: Column, state: str = "ca") -> Column:
    """(city, zip) from a breadcrumb link, else from ``Some City, CA 90000`` in the text."""
    slug = F.regexp_extract(html, rf"(?i)<a\b[^>]*href=[\"'][^\"']*/therapists/{state}/([^/?#\"']+)", 1)
    pattern = rf"\b([A-Za-z][A-Za-z\s]{{2,30}}),\s*{state.upper()}\s*(\d{{5}})?\b"
    city = strip(F.regexp_extract(page_text, pattern, 1))
    zip_code = F.nullif(F.regexp_extract(page_text, pattern, 2), F.lit(""))
    none = F.lit(None).cast("string")
    return (F.when(slug != "", F.struct(slug_to_city(slug).alias("city"), none.alias("zip_code")))
            .when(city != "", F.struct(city.alias("city"), zip_code.alias("zip_code"))))


# ---------------------------------------------------------------- lists
def populations(items: Column, section_text: Column) -> Column:
    """Short list items, else short comma parts; differing only in case counts once."""
    def short(values: Column) -> Column:
        return F.filter(F.transform(values, strip), lambda v: (v != "") & (F.length(v) < 60))

    listed = short(F.coalesce(items, F.array().cast("array<string>")))
    parts = short(F.split(F.coalesce(section_text, F.lit("")), ","))
    return distinct_ignoring_case(F.when(F.size(listed) > 0, listed).otherwise(parts))


def split_labels(text: Column, labels=vocab.ETHNICITY_LABELS) -> Column:
    """Comma list whose known labels may hold commas: longest known label first."""
    ordered = sorted(labels, key=len, reverse=True)
    known = "|".join(f"\\Q{label}\\E" for label in ordered)
    pieces = F.transform(
        F.regexp_extract_all(strip(text), F.lit(rf"(?i)[,\s]*({known}|.+?(?=, |$))"), F.lit(1)), strip)
    canonical = F.create_map(*[F.lit(x) for label in ordered for x in (label.lower(), label)])
    named = F.transform(pieces, lambda p: F.coalesce(F.try_element_at(canonical, F.lower(p)), p))
    return F.filter(named, lambda p: p != "")


def labelled_fields(html: Column) -> Column:
    """MAP of label (lower case) to value of ``<p><span>Label</span><br>Value</p>`` blocks."""
    pattern = r"(?is)<p[^>]*>\s*<span[^>]*>(.*?)</span>\s*<br\s*/?>(.*?)</p>"
    blocks = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    entries = F.transform(blocks, lambda b: F.struct(
        F.lower(strip_tags(F.regexp_extract(b, pattern, 1))).alias("key"),
        strip(unescape_basic(F.regexp_replace(F.regexp_extract(b, pattern, 2), "<[^>]+>", "")))
        .alias("value")))
    return F.filter(entries, lambda e: e["value"] != "")


def gender_and_ethnicity(html: Column) -> Column:
    fields = labelled_fields(html)

    def last(label: str) -> Column:
        hits = F.filter(fields, lambda e: e["key"] == label)
        return F.try_element_at(F.transform(hits, lambda e: e["value"]), F.lit(-1))

    lines = F.split(F.coalesce(last("race/ethnicity"), F.lit("")), "\n")
    return F.struct(last("gender").alias("gender"),
                    F.flatten(F.transform(lines, lambda line: split_labels(line))).alias("ethnicity"))


# ---------------------------------------------------------------- links
_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def _without_dots(segments: Column) -> Column:
    """A path from its segments, ``.`` left out and ``..`` taking the one before with it."""
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(
        s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    ends_open = F.element_at(segments, -1).isin(".", "..")
    path = F.array_join(F.when(ends_open, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def resolve(base: Column, reference: Column) -> Column:
    """The address that a reference on the page ``base`` leads to, without its fragment (RFC 3986, section 5.2).

    As ``urllib.parse.urljoin`` has it: an address with a scheme or a host of its own stays as it is, empty segments of a
    merged path go.  NULL if the base is no address with a host.
    """
    part = lambda n: F.regexp_extract(base, _ABSOLUTE, n)
    scheme, host, base_path, base_query = part(1), part(2), part(3), part(4)
    ref = F.regexp_replace(reference, "(?s)#.*", "")
    path, asks = F.regexp_extract(ref, r"^[^?]*", 0), F.regexp_extract(ref, r"(?s)\?.*", 0)
    before = F.split(F.regexp_replace(base_path, "[^/]*$", ""), "/")
    segments = F.concat(F.slice(before, F.lit(1), F.size(before) - 1), F.split(path, "/"))
    merged = F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == F.size(segments) - 1))
    rest = (F.when(path == "", F.concat(base_path, F.when(asks == "", base_query).otherwise(asks)))
            .when(F.startswith(path, F.lit("/")), F.concat(_without_dots(F.split(path, "/")), asks))
            .otherwise(F.concat(_without_dots(merged), asks)))
    return (F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(host == "", F.lit(None))
            .when(F.startswith(ref, F.lit("//")), F.concat(scheme, ref)).otherwise(F.concat(scheme, host, rest)))


def links(pages: DataFrame, base_url: str | None = None, *, url: str = "url", html: str = "html") -> DataFrame:
    """(page, link): every link target of a page, made absolute, once per page.

    References are resolved against ``base_url`` or, without one, against the page's own address.
    """
    raw = pages.select(F.col(url).alias("page"), F.explode(F.array_distinct(F.regexp_extract_all(
        F.col(html), F.lit(r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']+)[\"']"), F.lit(1)))).alias("_href"))
    base = F.col("page") if base_url is None else F.lit(base_url)
    link = resolve(base, strip(unescape_basic(F.col("_href"))))
    return raw.select("page", link.alias("link")).where(F.col("link").isNotNull()).distinct()


def city_listing_links(found: DataFrame, state: str = "ca") -> DataFrame:
    """Distinct links with a /therapists/<state>/<city> path."""
    path = F.try_parse_url(F.col("link"), F.lit("PATH"))
    shaped = path.rlike(rf"(?i)^/therapists/{state}/[^/]+/?$") & ~F.contains(path, F.lit("profile"))
    return found.where(shaped).select("link").distinct()


def profile_links(found: DataFrame, marker: str = "/therapists/profile/") -> DataFrame:
    """Distinct profile links over all listings."""
    return found.where(F.contains("link", F.lit(marker))).select("link").distinct()


def union_links(*listings: DataFrame) -> DataFrame:
    """Links of several listings, each once."""
    out = listings[0]
    for more in listings[1:]:
        out = out.union(more)
    return out.distinct()


# ---------------------------------------------------------------- element tree
PIECES = (
    "sections array<struct<heading: string, text: string, body: string, items: array<string>, "
    "parts: array<string>>>, prose array<string>, paragraph string, about array<string>, "
    "page_text string, fee_text string, badge_text string, telehealth_badge boolean"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
         "track", "wbr"}
_UNSEEN = {"script", "style", "template"}
_HEADINGS = {"h2", "h3", "h4", "strong", "b"}
_ABOUT = [("div", "box2-content"), ("div", "about"), ("section", "about"), ("div", "description")]
MIN_PROSE = 30


class _Element:
    """An element as a range of the page's visible text pieces, and the sections it stands in.

    Unclosed elements nest, so texts are cut out only for the elements that are asked for.
    """

    def __init__(self, page: list[str], tag: str, classes: str, sections: list):
        self.page, self.tag, self.classes, self.sections = page, tag, classes, sections
        self.start, self.end = len(page), None

    def is_section(self) -> bool:
        return self.tag == "div" and "mb-6" in self.classes.split()

    def parts(self) -> list[str]:
        return self.page[self.start:self.end]

    def spaced(self) -> str:
        return " ".join(self.parts())

    def tight(self) -> str:
        return "".join(self.parts())


class _Collector(HTMLParser):
    """All elements of a page in document order; an unclosed element lasts until its parent ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.elements, self.page = [], [], []
        self.sections = []  # the open ones
        self.unseen = 0     # open elements whose text is not shown

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        element = _Element(self.page, tag, dict(attrs).get("class") or "", list(self.sections))
        self.open.append(element)
        self.elements.append(element)
        self.unseen += tag in _UNSEEN
        if element.is_section():
            self.sections.append(element)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                for element in self.open[at:]:
                    element.end = len(self.page)
                    self.unseen -= element.tag in _UNSEEN
                    if element in self.sections:
                        self.sections.remove(element)
                del self.open[at:]
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not self.unseen:
            self.page.append(text)

    def first(self, matches) -> _Element | None:
        return next((e for e in self.elements if matches(e)), None)

    def longest(self, elements: list[_Element]) -> str:
        """Spaced text of the longest element, the first of equals."""
        lengths = [0]
        for piece in self.page:
            lengths.append(lengths[-1] + len(piece) + 1)

        def size(e: _Element) -> int:
            return lengths[len(self.page) if e.end is None else e.end] - lengths[e.start]

        return max(elements, key=size).spaced() if elements else ""


def _section_row(section: _Element, elements: list[_Element]) -> dict:
    inside = [e for e in elements if section in e.sections]
    heading = next((e.tight() for e in inside if e.tag in _HEADINGS), "")
    paragraphs = [e.tight() for e in inside if e.tag == "p"]
    body = " ".join(paragraphs) if paragraphs else section.spaced().removeprefix(heading).strip()
    return {"heading": heading.lower(), "text": section.spaced(), "body": unescape(body),
            "items": [e.tight() for e in inside if e.tag == "li"], "parts": section.parts()}


def parse_page(html: str | None) -> dict:
    page = _Collector()
    page.feed(html or "")
    page.close()
    elements = page.elements
    fee = page.first(lambda e: e.tag == "div" and (
        "profileTour_fitToContent" in e.classes.split() or "fee" in e.classes))
    badge = page.first(lambda e: e.tag in ("div", "span") and "accepting" in e.classes)
    online = page.first(lambda e: (e.tag in ("div", "span") and "telehealth" in e.classes)
                        or (e.tag == "div" and "online" in e.classes))
    return {
        "sections": [_section_row(e, elements) for e in elements if e.is_section()],
        "prose": [unescape(e.spaced()) for e in elements
                  if e.tag == "div" and "whitespace-pre-line" in e.classes and len(e.tight()) > MIN_PROSE],
        "paragraph": page.longest([e for e in elements if e.tag == "p"]),
        "about": [e.spaced() for tag, mark in _ABOUT for e in elements if e.tag == tag and mark in e.classes],
        "page_text": " ".join(page.page), "fee_text": fee and fee.tight(), "badge_text": badge and badge.tight(),
        "telehealth_badge": online is not None,
    }


#: Pages taken apart at a time.
PAGES_AT_ONCE = 256


def pieces(html: Column) -> Column:
    """The sections, prose blocks, longest paragraph and visible text of a page, as a struct; one pass over its elements."""
    ship()

    kind = to_arrow_type(StructType.fromDDL(PIECES))

    @F.arrow_udf(f"struct<{PIECES}>")
    def parsed(pages: pa.Array) -> pa.Array:
        # only some pages are Python objects at a time
        return pa.concat_arrays([pa.array([], kind), *(pa.array(map(parse_page, pages.slice(at, PAGES_AT_ONCE).to_pylist()), kind)
                                                       for at in range(0, len(pages), PAGES_AT_ONCE))])

    return parsed.asNondeterministic()(html)  # a filter on a field must not parse the page once more


def page_pieces(pages: DataFrame, *, key: str = "url", html: str = "html") -> DataFrame:
    """One row per page with its sections, prose blocks, longest paragraph and visible text."""
    return pages.select(key, pieces(F.col(html)).alias("_pieces")).select(key, "_pieces.*")


def section(keyword: str) -> Column:
    """First section whose heading holds the keyword."""
    return F.get(F.filter("sections", lambda s: F.contains(s["heading"], F.lit(keyword))), F.lit(0))


def bio_from_sections() -> Column:
    """Prose blocks joined, else the longest section that is not structured data."""
    free = F.filter("sections", lambda s: ~contains_any(s["heading"], vocab.STRUCTURED_HEADINGS)
                    & ~s["text"].rlike("^(< ?Back|> ?Find)"))
    return F.when(F.size("prose") > 0, F.array_join("prose", " ")).otherwise(
        _longest(F.transform(free, lambda s: s["body"])))


def _longest(texts: Column) -> Column:
    """Longest text, the earliest of equals."""
    ranked = F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    return F.coalesce(F.array_max(ranked)["t"], F.lit(""))


def bio_from_about(minimum: int = 80) -> Column:
    """First long enough about block without its heading, else the longest paragraph."""
    def body(text: Column) -> Column:
        rest = strip(F.regexp_replace(strip(F.substring(text, 6, F.length(text))), r"^\S+\s*", ""))
        return F.when(F.startswith(text, F.lit("About")), rest).otherwise(text)

    about = F.filter(F.transform("about", lambda t: body(collapse(t))), lambda t: F.length(t) >= minimum)
    paragraph = F.when(F.length("paragraph") >= minimum, F.col("paragraph"))
    return F.coalesce(F.get(about, F.lit(0)), paragraph, F.lit(""))


def page_profiles(pages: DataFrame, source: str, *, key: str = "url", html: str = "html",
                  state: str = "ca", fetched: str = "fetched_at") -> DataFrame:
    """Profile rows from pages; pages without a name or a place are dropped.

    Title, script, breadcrumb and elements are read in one pass, and only the fields that come out of it are
    shuffled: of a key with several pages the one fetched last counts, by column ``fetched`` if there is one, of equal ones the longest.
    """
    when = [F.col(fetched).alias("fetched")] if fetched in pages.columns else []
    rows = pages.select(
        key, F.struct(*when, F.length(html).alias("size"), F.xxhash64(html).alias("hash")).alias("_version"),
        page_title(F.col(html)).alias("_title"), embedded_profile(F.col(html)).alias("_embedded"),
        F.regexp_extract(F.col(html), rf"(?i)<a\b[^>]*href=[\"'][^\"']*/therapists/{state}/[^/?#\"']+", 0)
        .alias("_crumb"), pieces(F.col(html)).alias("_pieces")).select("*", "_pieces.*").drop("_pieces")
    place = city_from_page(F.concat(F.col("_crumb"), F.lit('"')), F.col("page_text"), state)
    approaches, insurance = section("approaches"), section("insurance")
    all_text = F.array_join(F.transform("sections", lambda s: s["text"]), " ")
    html_insurance = insurance_from_text(F.coalesce(insurance["text"], F.col("fee_text")))
    groups = section("groups")
    rows = rows.withColumns({
        "name": name_from_title(F.col("_title")), "credentials": credentials_from_title(F.col("_title")),
        "_place": place, "bio": bio_from_sections(),
        "modalities": modality_tags(F.coalesce(approaches["text"], all_text)),
        "specializations": F.coalesce(specialization_tags(section("challenges")["text"]),
                                      F.array().cast("array<string>")),
        "_ins": F.when(F.col("_embedded").isNotNull(), F.struct(
            providers_from_names(F.col("_embedded.insurers")).alias("providers"),
            F.col("_embedded.sliding").alias("sliding"))).otherwise(html_insurance),
        "_fee": fee_range(F.coalesce(F.nullif(F.col("fee_text"), F.lit("")), insurance["text"]),
                          F.col("page_text")),
        "populations_served": F.when(groups.isNotNull(), populations(
            groups["items"], F.array_join(groups["parts"], ",")))
        .otherwise(F.array().cast("array<string>")),
    })
    fields = rows.select(
        "_version", "_place", F.lit(source).alias("source"), F.col(key).alias("source_url"),
        F.try_element_at(F.split(F.regexp_replace(F.col(key), "/+$", ""), "/"), F.lit(-1)).alias("source_id"),
        "name", "credentials", "modalities", "specializations", "populations_served",
        F.col("_place.city").alias("city"), F.lit(state.upper()).alias("state"),
        F.col("_place.zip_code").alias("zip_code"),
        session_format(F.col("page_text"), F.col("telehealth_badge")).alias("session_formats"),
        F.col("_ins.providers").alias("insurance_providers"), F.col("_ins.sliding").alias("sliding_scale"),
        F.col("_fee.fee_min").alias("fee_min"), F.col("_fee.fee_max").alias("fee_max"),
        accepting(F.col("page_text"), F.col("badge_text")).alias("accepting_new_clients"), "bio",
        page_completeness(F.col("bio"), F.col("modalities"), F.col("specializations"),
                          F.col("_ins.providers")).alias("profile_completeness"))
    names = [c for c in fields.columns if c not in ("_version", "source_url")]
    last = fields.groupBy("source_url").agg(F.max_by(F.struct(*names), "_version").alias("_last"))
    kept = last.select("source_url", "_last.*").where((F.col("name") != "") & F.col("_place").isNotNull())
    return kept.select(*[c for c in fields.columns if c not in ("_version", "_place")])
