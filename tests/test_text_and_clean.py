"""Text functions and cleaning: golden values and edge cases."""

import pytest
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions import text as X
from matchweave.operators import clean as C


@pytest.mark.parametrize("raw, expected", [
    ("O'BRIEN-SMITH la JOLLA", "O'Brien-Smith La Jolla"), ("ångström élan", "Ångström Élan"), ("", ""), (None, None)])
def test_title(one, raw, expected):
    assert one(X.title(F.lit(raw).cast("string"))) == expected


def test_request_key(one):
    assert one(X.request_key(F.lit(" Panic Attacks "), F.lit("{}"))) == "ab3acf533dda9d0e"


def test_tokens_split_on_every_whitespace(one):
    text = "A\tb C　d\x1ce  f\n"
    assert one(X.tokens(F.lit(text))) == text.lower().split()
    assert one(X.tokens(F.lit(None).cast("string"))) == []


def test_tags_keep_table_order_and_drop_repeats(one):
    table = [("b", "x"), ("a", "y"), ("bb", "x")]
    assert one(X.all_tags(F.lit("a bb"), table)) == ["x", "y"]
    assert one(X.first_tag(F.lit("a bb"), table)) == "x"
    assert one(X.first_tag(F.lit("zzz"), table)) is None


def test_literal_tables_are_bounded():
    with pytest.raises(ValueError):
        X.check_literal_size([0] * (X.MAX_LITERAL_ENTRIES + 1), "table")


def test_strip_tags_drops_scripts_and_unescapes_once(one):
    html = "<p>a &amp;lt; b</p><script>var t='</p>';</script><!-- c --><style>p{}</style>d"
    assert one(X.strip_tags(F.lit(html))) == "a &lt; b d"


@pytest.mark.parametrize("bio, expected", [
    ("x" * 19, ""), ("x" * 20, "x" * 20), ("y" * 6000, "y" * 5000),
    ("<p>a</p>b <b>long enough text here</b>", "a b long enough text here"), (None, "")])
def test_bio(one, bio, expected):
    assert one(C.clean_bio(F.lit(bio).cast("string"))) == expected


def test_clean_text_drops_non_printing(one):
    assert one(C.clean_text(F.lit("a​b\u0007c d e"))) == "abc d e"


@pytest.mark.parametrize("lo, hi, expected", [
    (1500, 1600, (None, None)), (80, 1500, (80, 80)), (None, 1500, (None, None)), (0, 50, (0, 50)),
    (-5, 50, (None, None)), (80, 120, (80, 120))])
def test_fees(one, lo, hi, expected):
    assert one(*C.clean_fees(F.lit(lo).cast("int"), F.lit(hi).cast("int"))) == expected


@pytest.mark.parametrize("city, expected", [
    ("los angeles,", "Los Angeles"), ("\x01\x02​", None), (None, None), (" san diego , ,", "San Diego ,")])
def test_city(one, city, expected):
    assert one(C.clean_city(F.lit(city).cast("string"))) == expected


def test_name(one):
    assert one(C.clean_name(F.lit("  JANE   O'NEIL "))) == "Jane O'Neil"
    assert one(C.clean_name(F.lit("Jane  van der Berg"))) == "Jane van der Berg"
    assert one(C.clean_name(F.lit("123"))) == "123"


@pytest.mark.parametrize("name, state, url, reason", [
    ("Jo", "CA", "u", None), (" J ", "CA", "u", "name"), ("Jo", "NV", "u", "state"), ("Jo", None, "u", "state"),
    ("Jo", "CA", "", "url"), (None, "CA", "u", "name")])
def test_reject_reason(one, name, state, url, reason):
    assert one(C.reject_reason(*[F.lit(v).cast("string") for v in (name, state, url)])) == reason


def test_fee_label_and_excerpt(one):
    def label(lo, hi, sliding):
        return one(C.fee_label(F.lit(lo).cast("int"), F.lit(hi).cast("int"), F.lit(sliding)))

    assert [label(80, 120, False), label(80, None, True), label(None, 9, True), label(0, 50, False)] == [
        "$80-$120", "from $80", "Sliding scale available", None]
    assert one(C.bio_excerpt(F.lit("a" * 300))) == "a" * 300
    assert one(C.bio_excerpt(F.lit("a" * 301))) == "a" * 300 + "..."


def test_completeness(one):
    some, none = F.array(F.lit("a")), F.array().cast("array<string>")
    assert one(C.structured_completeness(some, some, some, some, F.lit(50))) == 1.0
    assert one(C.structured_completeness(none, some, none, none, F.lit(50))) == 0.4
    assert one(C.with_bio_bonus(F.lit(0.9), F.lit("bio"))) == 1.0
    assert one(C.page_completeness(F.lit("x" * 51), some, none, some)) == 0.75
    assert one(C.page_completeness(F.lit("x" * 50), none, none, none)) == 0.0


@pytest.mark.parametrize("raw, expected", [("70", 70), (" 70 ", 70), ("", 50), (None, 50), ("abc", 50), ("7.5", 50)])
def test_safe_int(one, raw, expected):
    assert one(C.safe_int(F.lit(raw).cast("string"), 50)) == expected


def test_read_coercion(spark):
    df = spark.createDataFrame(
        [(None, ["anxiety", "nope"], None, None, 0.0, None, None)],
        "modalities array<string>, specializations array<string>, languages array<string>, bio string, "
        "rating double, review_count int, profile_completeness double")
    row = C.coerce_profiles(df).first()
    assert (row.modalities, row.specializations, row.languages, row.bio, row.rating, row.review_count,
            row.profile_completeness) == ([], ["anxiety"], [], "", None, 0, 0.0)


def test_embedding_text_and_document(spark):
    df = spark.createDataFrame(
        [("Jo", ["anxiety", "grief"], ["emdr"], "Bio.", ["Adults"], None, "CA", ["LMFT"])],
        "name string, specializations array<string>, modalities array<string>, bio string, "
        "populations_served array<string>, city string, state string, credentials array<string>")
    row = df.select(C.embedding_text().alias("e"), C.search_document().alias("d")).first()
    assert row.e == ("Therapist: Jo | Specializations: anxiety, grief | Modalities: emdr | Bio: Bio. | "
                     "Populations: Adults | Location: CA")
    assert row.d == "Jo Bio. anxiety grief emdr Adults LMFT"


def test_fixed_tables():
    pairs = [(c, m) for c, ms in vocab.KNOWLEDGE.items() for m in ms]
    assert (len(vocab.KNOWLEDGE), len(pairs), len({m for _, m in pairs}), len(vocab.ALIASES)) == (25, 142, 23, 21)
    assert len({m for _, m in pairs} - set(vocab.MODALITIES)) == 4
    assert (len(vocab.MODALITIES), len(vocab.INSURERS), len(vocab.CITY_CORRECTIONS)) == (22, 11, 19)


def test_distinct_ignoring_case(one):
    words = ["Teens", "adults", "TEENS", "Adults", "b", "teens"]
    assert one(X.distinct_ignoring_case(F.lit(words))) == ["Teens", "adults", "b"]
    assert one(X.distinct_ignoring_case(F.array().cast("array<string>"))) == []
    many = F.transform(F.sequence(F.lit(1), F.lit(50000)), lambda i: F.when(i % 2 == 0, "A").otherwise(i.cast("string")))
    assert one(F.size(X.distinct_ignoring_case(many))) == 25001
