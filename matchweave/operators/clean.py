"""Cleaning, normalisation and projection of profile rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.text import collapse, strip, title, title_if_shouting

MIN_BIO = 20
MAX_BIO = 5000
MAX_FEE = 1000


def reject_reason(name: Column, state: Column, url: Column, home_state: str = "CA") -> Column:
    """Why a raw profile is not usable; NULL for a usable one."""
    return (F.when(F.length(strip(F.coalesce(name, F.lit("")))) < 2, "name")
            .when(~F.coalesce(state == home_state, F.lit(False)), "state")
            .when(F.coalesce(url, F.lit("")) == "", "url"))


def clean_name(name: Column) -> Column:
    return title_if_shouting(collapse(name))


def clean_text(text: Column) -> Column:
    """Tags to spaces, whitespace collapsed, non-printing characters dropped."""
    bare = collapse(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))
    return F.regexp_replace(bare, r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}", "")


def clean_bio(bio: Column) -> Column:
    """Cleaned bio; too-short ones become empty, long ones are cut to the stored width."""
    text = clean_text(bio)
    return F.when(F.length(text) < MIN_BIO, F.lit("")).otherwise(F.substring(text, 1, MAX_BIO))


def clean_fees(fee_min: Column, fee_max: Column) -> tuple[Column, Column]:
    """An implausible minimum clears both fees; an excessive maximum becomes the minimum."""
    bad = F.coalesce((fee_min < 0) | (fee_min > MAX_FEE), F.lit(False))
    none = F.lit(None).cast("int")
    lo = F.when(bad, none).otherwise(fee_min)
    hi = F.when(bad, none).otherwise(fee_max)
    return lo, F.when(F.coalesce(hi > MAX_FEE, F.lit(False)), lo).otherwise(hi)


def clean_city(city: Column) -> Column:
    bare = F.regexp_replace(city, "[\\x00-\\x1f\\u200b-\\u200f]", "")
    cut = F.regexp_replace(strip(bare), ",+$", "")
    return F.nullif(title(strip(cut)), F.lit(""))


def clean_languages(languages: Column) -> Column:
    return F.transform(languages, lambda x: strip(F.lower(x)))


def clean_credentials(credentials: Column) -> Column:
    return F.filter(F.transform(credentials, lambda x: F.upper(strip(x))), lambda x: x != "")


def clean_profiles(raw: DataFrame, home_state: str = "CA") -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) profiles; the rejected rows keep their reason."""
    judged = raw.withColumn(
        "reject_reason", reject_reason(F.col("name"), F.col("state"), F.col("source_url"), home_state))
    fee_min, fee_max = clean_fees(F.col("fee_min"), F.col("fee_max"))
    good = judged.where(F.col("reject_reason").isNull()).drop("reject_reason").withColumns({
        "name": clean_name(F.col("name")), "bio": clean_bio(F.col("bio")),
        "fee_min": fee_min, "fee_max": fee_max, "city": clean_city(F.col("city")),
        "languages": clean_languages(F.col("languages")),
        "credentials": clean_credentials(F.col("credentials")),
    })
    return good, judged.where(F.col("reject_reason").isNotNull())


# ---------------------------------------------------------------- derived texts
def _joined(items: Column, sep: str) -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), sep)


def embedding_text() -> Column:
    """The labelled text a profile's vector is computed from."""
    place = F.concat(
        F.when(F.coalesce(F.col("city"), F.lit("")) != "", F.concat("city", F.lit(", ")))
        .otherwise(F.lit("")), F.col("state"))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Therapist: "), F.col("name")),
        F.concat(F.lit("Specializations: "), _joined(F.col("specializations"), ", ")),
        F.concat(F.lit("Modalities: "), _joined(F.col("modalities"), ", ")),
        F.concat(F.lit("Bio: "), F.coalesce("bio", F.lit(""))),
        F.concat(F.lit("Populations: "), _joined(F.col("populations_served"), ", ")),
        F.concat(F.lit("Location: "), place))


def search_document() -> Column:
    """The text keyword scoring reads."""
    return F.concat_ws(
        " ", F.col("name"), F.coalesce("bio", F.lit("")),
        *[_joined(F.col(c), " ")
          for c in ("specializations", "modalities", "populations_served", "credentials")])


def fee_label(fee_min: Column, fee_max: Column, sliding: Column) -> Column:
    lo = F.coalesce(fee_min, F.lit(0)) != 0
    hi = F.coalesce(fee_max, F.lit(0)) != 0
    return (F.when(lo & hi, F.format_string("$%d-$%d", fee_min, fee_max))
            .when(lo, F.format_string("from $%d", fee_min))
            .when(sliding, F.lit("Sliding scale available")))


def bio_excerpt(bio: Column) -> Column:
    return F.when(F.length(bio) > 300, F.concat(F.substring(bio, 1, 300), F.lit("..."))).otherwise(bio)


# ---------------------------------------------------------------- read coercion
def known_only(values: Column, domain: Sequence[str]) -> Column:
    """Array without values outside the domain; NULL becomes empty."""
    allowed = F.array(*[F.lit(d) for d in domain])
    kept = F.filter(values, lambda x: F.array_contains(allowed, x))
    return F.coalesce(kept, F.array().cast("array<string>"))


def coerce_profiles(df: DataFrame) -> DataFrame:
    """Profiles as the ranker expects them: no NULL arrays, texts or counts."""
    empty = F.array().cast("array<string>")
    out = {c: F.coalesce(F.col(c), empty) for c in (
        "credentials", "ethnicity", "populations_served", "languages", "session_formats",
        "insurance_providers") if c in df.columns}
    out["modalities"] = known_only(F.col("modalities"), vocab.MODALITIES)
    out["specializations"] = known_only(F.col("specializations"), vocab.SPECIALIZATIONS)
    out["bio"] = F.coalesce("bio", F.lit(""))
    out["rating"] = F.nullif(F.col("rating").cast("double"), F.lit(0.0))
    out["review_count"] = F.coalesce("review_count", F.lit(0))
    out["profile_completeness"] = F.coalesce(F.col("profile_completeness").cast("double"), F.lit(0.0))
    return df.withColumns(out)


# ---------------------------------------------------------------- completeness
def _filled(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def _points(parts: Sequence[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for condition, points in parts:
        total = total + F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    return F.round(total, 2)


def structured_completeness(modalities: Column, specializations: Column, credentials: Column,
                            languages: Column, fee_min: Column) -> Column:
    """Score of a profile built from directory records."""
    return _points([(_filled(modalities), 0.30), (_filled(specializations), 0.30),
                    (_filled(credentials), 0.20), (_filled(languages), 0.10),
                    (fee_min.isNotNull(), 0.10)])


def with_bio_bonus(completeness: Column, bio: Column) -> Column:
    found = F.coalesce(bio, F.lit("")) != ""
    return F.when(found, F.least(F.lit(1.0), completeness + 0.15)).otherwise(completeness)


def page_completeness(bio: Column, modalities: Column, specializations: Column,
                      insurance: Column) -> Column:
    """Score of a profile built from a page."""
    return _points([(F.coalesce(F.length(bio) > 50, F.lit(False)), 0.35),
                    (_filled(modalities), 0.25), (_filled(specializations), 0.25),
                    (_filled(insurance), 0.15)])


def safe_int(value: Column, default: int) -> Column:
    """An integer from loose text; anything unreadable gives the default."""
    return F.coalesce(strip(value.cast("string")).try_cast("int"), F.lit(default))


# ---------------------------------------------------------------- requests
FILTER_FIELDS = ["city", "zip_code", "insurance", "session_format", "max_budget",
                 "preferred_gender", "preferred_language", "preferred_ethnicity", "age_group"]


def merge_filters(requests: DataFrame, explicit: str = "explicit", inferred: str = "inferred",
                  fields: Sequence[str] = FILTER_FIELDS) -> DataFrame:
    """Explicit filter values override inferred ones, field by field."""
    merged = [F.coalesce(F.col(f"{explicit}.{f}"), F.col(f"{inferred}.{f}")).alias(f) for f in fields]
    rest = [c for c in requests.columns if c not in (explicit, inferred)]
    return requests.select(*rest, *merged)


def has_content(fields: Sequence[str] = FILTER_FIELDS) -> Column:
    """A request needs free text or at least one filter."""
    text = F.coalesce(F.col("free_text"), F.lit("")) != ""
    return text | F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()
