"""Search criteria as predicates over (criteria, profile) rows.

``Predicates`` builds one boolean Column per criterion, TRUE where the criterion is unset.
Query-side values may be columns of a joined row or literals; with literals the simple
equalities reach the parquet scan.  A NULL predicate rejects the row, as a WHERE does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave import vocab

# Order in which criteria are given up, first to last.
RELAX_ORDER = ["budget", "format", "insurance", "city", "gender", "ethnicity", "language"]
SAFETY_LEVEL = len(RELAX_ORDER) + 1
LEVEL = {name: i + 1 for i, name in enumerate(RELAX_ORDER)}


def _given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _sliding(profile) -> Column:
    return F.coalesce(profile("sliding_scale"), F.lit(False))


def matches_age(populations: Column, group: str) -> Column:
    hit = F.lit(False)
    for pattern in vocab.AGE_GROUP_PATTERNS[group]:
        hit = hit | F.coalesce(F.exists(populations, lambda p: p.ilike(pattern)), F.lit(False))
    return hit


@dataclass(frozen=True)
class Predicates:
    """``q``/``p`` turn a field name into the query-side / profile-side Column."""

    q: callable
    p: callable
    home_state: str = "CA"

    def state(self) -> Column:
        return self.p("state") == self.home_state

    def accepting(self) -> Column:
        return self.p("accepting_new_clients")

    def embedded(self) -> Column:
        return self.p("embedding").isNotNull()

    def city(self) -> Column:
        want = self.q("city")
        return F.when(_given(want), F.lower(self.p("city")) == F.lower(want)).otherwise(True)

    def zip(self) -> Column:
        want = self.q("zip_code")
        return F.when(_given(want), self.p("zip_code") == want).otherwise(True)

    def insurance(self) -> Column:
        want = self.q("insurance")
        return (F.when(~_given(want) | (want == "self_pay"), True)
                .when(want == "sliding_scale", _sliding(self.p))
                .otherwise(F.coalesce(F.array_contains(self.p("insurance_providers"), want),
                                      F.lit(False)) | _sliding(self.p)))

    def format(self) -> Column:
        want, have = self.q("session_format"), self.p("session_formats")
        return (F.when(~_given(want) | (want == "both"), True)
                .otherwise(F.array_contains(have, want) | F.array_contains(have, "both")))

    def budget(self) -> Column:
        limit, fee = self.q("max_budget"), self.p("fee_min")
        return (F.when(F.coalesce(limit, F.lit(0)) == 0, True)
                .otherwise(fee.isNull() | (fee <= limit) | _sliding(self.p)))

    def gender(self) -> Column:
        want = self.q("preferred_gender")
        return F.when(_given(want), F.lower(self.p("gender")) == F.lower(want)).otherwise(True)

    def ethnicity(self) -> Column:
        want = self.q("preferred_ethnicity")
        return F.when(_given(want), F.exists(
            self.p("ethnicity"), lambda e: F.lower(e) == F.lower(want))).otherwise(True)

    def language(self) -> Column:
        want = self.q("preferred_language")
        return F.when(_given(want), F.array_contains(self.p("languages"), F.lower(want))).otherwise(True)

    def age_group(self) -> Column:
        want = F.lower(self.q("age_group"))
        out = F.lit(True)
        for group in vocab.AGE_GROUP_PATTERNS:
            out = F.when(want == group, matches_age(self.p("populations_served"), group)).otherwise(out)
        return out

    def hard(self) -> Column:
        """What is never given up: cheap equalities first, array scans last."""
        return self.state() & self.accepting() & self.embedded() & self.age_group()

    def all(self) -> Column:
        return (self.hard() & self.budget() & self.gender() & self.city() & self.zip()
                & self.insurance() & self.format() & self.language() & self.ethnicity())

    def need(self) -> Column:
        """Level at which the pair becomes admissible (0: all criteria met); NULL: never."""
        def fails(name: str, level) -> Column:
            return F.when(~F.coalesce(getattr(self, name)(), F.lit(False)), level).otherwise(0)

        zip_level = F.when(_given(self.q("city")), LEVEL["city"]).otherwise(SAFETY_LEVEL)
        levels = [fails(n, F.lit(LEVEL[n])) for n in RELAX_ORDER] + [fails("zip", zip_level)]
        return F.when(F.coalesce(self.hard(), F.lit(False)), F.greatest(*levels))


def literal_criteria(criteria: dict):
    """Query-side accessor for one search given as plain values."""
    types = {"max_budget": "int"}
    return lambda name: F.lit(criteria.get(name)).cast(types.get(name, "string"))


def filter_profiles(profiles: DataFrame, criteria: dict, home_state: str = "CA") -> DataFrame:
    """Profiles that pass one search's criteria; unset criteria leave no trace in the plan."""
    preds = Predicates(literal_criteria(criteria), lambda c: F.col(c), home_state)
    named = {"city": "city", "zip_code": "zip", "insurance": "insurance", "session_format": "format",
             "max_budget": "budget", "preferred_gender": "gender",
             "preferred_ethnicity": "ethnicity", "preferred_language": "language",
             "age_group": "age_group"}
    out = profiles.where(preds.state()).where(preds.accepting())
    for field, name in named.items():
        if criteria.get(field):
            out = out.where(getattr(preds, name)())
    return out


def explain_filters(q=F.col) -> Column:
    """Texts that describe the set criteria, in a fixed order."""
    parts = [
        F.when(_given(q("city")), F.concat(F.lit("Location: "), q("city"), F.lit(", CA"))),
        F.when(_given(q("insurance")), F.concat(F.lit("Insurance: "), q("insurance"))),
        F.when(F.coalesce(q("max_budget"), F.lit(0)) != 0,
               F.format_string("Budget: up to $%d/session", q("max_budget"))),
        F.when(_given(q("session_format")), F.concat(F.lit("Format: "), q("session_format"))),
        F.when(_given(q("preferred_language")), F.concat(F.lit("Language: "), q("preferred_language"))),
    ]
    return F.array_compact(F.array(*parts))


# ---------------------------------------------------------------- facets
# A profile's filterable properties as a set of tokens, and a search's criteria as the tokens
# each of its levels asks for.  Batch search compares these instead of materialising pairs.
def profile_facets(p=F.col) -> Column:
    """Distinct facet tokens of a profile."""
    def tagged(array: Column, prefix: str, lower: bool = False) -> Column:
        return F.transform(F.coalesce(array, F.array().cast("array<string>")),
                           lambda x: F.concat(F.lit(prefix), F.lower(x) if lower else x))

    singles = F.array(
        F.concat(F.lit("city:"), F.lower(p("city"))),
        F.concat(F.lit("zip:"), p("zip_code")),
        F.concat(F.lit("gender:"), F.lower(p("gender"))),
        F.when(_sliding(p), F.lit("sliding")),
        *[F.when(matches_age(p("populations_served"), g), F.lit(f"age:{g}"))
          for g in vocab.AGE_GROUP_PATTERNS])
    return F.array_sort(F.array_distinct(F.filter(F.concat(
        F.array_compact(singles), tagged(p("insurance_providers"), "ins:"),
        tagged(p("session_formats"), "fmt:"), tagged(p("ethnicity"), "eth:", lower=True),
        tagged(p("languages"), "lang:")), lambda x: x.isNotNull())))


def fee_floor(p=F.col) -> Column:
    """Fee a budget is compared with; free passes (no fee, sliding scale) get the lowest value."""
    return F.when(p("fee_min").isNull() | _sliding(p), F.lit(-2147483648)).otherwise(p("fee_min"))


def query_demands(q=F.col) -> Column:
    """ARRAY<STRUCT<level, any_of>>: each set criterion, its level, and tokens that satisfy it.

    Level 0 marks what is never given up.  No-op criteria make no demand.
    """
    def demand(when: Column, level, *tokens: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(level).cast("int").alias("level") if isinstance(level, int) else
            level.cast("int").alias("level"), F.array(*tokens).alias("any_of")))

    city, zip_code, ins = q("city"), q("zip_code"), q("insurance")
    fmt, age = q("session_format"), F.lower(q("age_group"))
    zip_level = F.when(_given(city), LEVEL["city"]).otherwise(SAFETY_LEVEL)
    return F.array_compact(F.array(
        demand(age.isin(*vocab.AGE_GROUP_PATTERNS), 0, F.concat(F.lit("age:"), age)),
        demand(_given(fmt) & (fmt != "both"), LEVEL["format"],
               F.concat(F.lit("fmt:"), fmt), F.lit("fmt:both")),
        demand(ins == "sliding_scale", LEVEL["insurance"], F.lit("sliding")),
        demand(_given(ins) & ~ins.isin("self_pay", "sliding_scale"), LEVEL["insurance"],
               F.concat(F.lit("ins:"), ins), F.lit("sliding")),
        demand(_given(city), LEVEL["city"], F.concat(F.lit("city:"), F.lower(city))),
        demand(_given(zip_code), zip_level, F.concat(F.lit("zip:"), zip_code)),
        demand(_given(q("preferred_gender")), LEVEL["gender"],
               F.concat(F.lit("gender:"), F.lower(q("preferred_gender")))),
        demand(_given(q("preferred_ethnicity")), LEVEL["ethnicity"],
               F.concat(F.lit("eth:"), F.lower(q("preferred_ethnicity")))),
        demand(_given(q("preferred_language")), LEVEL["language"],
               F.concat(F.lit("lang:"), F.lower(q("preferred_language")))),
    ))


def set_levels(q=F.col) -> Column:
    """Levels of the criteria a search sets, no-ops included, ascending."""
    flags = {"budget": F.coalesce(q("max_budget"), F.lit(0)) != 0,
             "format": _given(q("session_format")), "insurance": _given(q("insurance")),
             "city": _given(q("city")), "gender": _given(q("preferred_gender")),
             "ethnicity": _given(q("preferred_ethnicity")),
             "language": _given(q("preferred_language"))}
    return F.array_compact(F.array(*[F.when(flags[n], F.lit(LEVEL[n])) for n in RELAX_ORDER]))


# ---------------------------------------------------------------- catalogue predicates
def active() -> Column:
    return F.col("is_active")


def active_accepting() -> Column:
    return F.col("is_active") & F.col("accepting_new_clients")


def has_city() -> Column:
    return F.col("city").isNotNull() & (F.col("city") != "")


def count_filtered(profiles: DataFrame, criteria: dict, home_state: str = "CA") -> DataFrame:
    return filter_profiles(profiles, criteria, home_state).agg(F.count("*").alias("n"))
