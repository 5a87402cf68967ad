"""Page and record extraction on small snippets."""

import pytest
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.operators import extract as H
from matchweave.sources import directory as D


def lit(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("title, name, creds", [
    ("Pat Doe, Marriage Therapist, LMFT, PhD | Directory", "Pat Doe, Marriage Therapist", ["LMFT", "PhD"]),
    ("Jane Smith LMFT, Counselor | D", "Jane Smith", ["LMFT"]), ("Solo | D", "Solo", [])])
def test_title(one, title, name, creds):
    text = H.page_title(lit(f"<html><title>{title}</title>"))
    assert one(H.name_from_title(text), H.credentials_from_title(text)) == (name, creds)


def test_title_falls_back_to_heading(one):
    assert one(H.page_title(lit("<title></title><h1>Pat <b>Doe</b></h1>"))) == "Pat Doe"


def test_modality_and_specialization_tags(one):
    text = "EMDR, CBT and Dialectical Behavior; a cbt too; mindfulness"
    assert one(H.modality_tags(lit(text))) == ["cognitive_behavioral_therapy", "dialectical_behavior_therapy", "emdr", "mindfulness_based"]
    assert one(H.modality_tags(lit("I use ACT and CBT"))) == ["acceptance_commitment_therapy", "cognitive_behavioral_therapy"]
    assert one(H.specialization_tags(lit("Teen anxiety, PTSD & post-trauma stress"))) == [
        "anxiety", "trauma", "ptsd", "stress_burnout", "adolescents"]


BLOB = ('<script id="__NEXT_DATA__">{"props":{"pageProps":{"profile":{"slidingScale":true,'
        '"insuranceCompaniesList":["Anthem Blue Cross","Aetna","BlueCross X","Nobody"]}}}}</script>')


def test_embedded_profile(one):
    blob = H.embedded_profile(lit(BLOB))
    assert one(H.providers_from_names(blob["insurers"]), blob["sliding"]) == (["blue_cross", "aetna"], True)
    assert one(H.embedded_profile(lit("<p>none</p>"))) is None
    assert one(H.embedded_profile(lit('<script id="__NEXT_DATA__">{"props": </script>'))) is None


@pytest.mark.parametrize("text, providers, sliding", [
    ("We do not accept insurance. Aetna", ["self_pay"], False), ("Aetna and a sliding scale", ["aetna"], True),
    ("Sliding scale", [], True), ("Out-of-network", ["out_of_network"], False), ("Private pay", ["self_pay"], False),
    ("Blue Cross, bluecross, United", ["blue_cross", "united_healthcare"], False), (None, [], False)])
def test_insurance_text(one, text, providers, sliding):
    found = H.insurance_from_text(lit(text))
    assert one(found["providers"], found["sliding"]) == (providers, sliding)


def test_session_format(one):
    got = [one(H.session_format(lit(t)))[0] for t in ("Telehealth and In-Person", "video sessions", "my office", "")]
    assert got == ["both", "telehealth", "in_person", "in_person"]


def test_accepting(one):
    assert one(H.accepting(lit("Currently NOT accepting new clients"))) is False
    assert one(H.accepting(lit("not accepting new clients"), lit("Accepting!"))) is True
    assert one(H.accepting(lit("hello"), lit("Unavailable"))) is False
    assert one(H.accepting(lit("hello"))) is True


@pytest.mark.parametrize("fee_text, page, expected", [
    ("Fee: $120 - $180", "", (120, 180)), ("Fee: $120", "", (120, 120)), (None, "no currency", None),
    (None, "$2000 deposit, $95–$110 a session", (95, 110)), ("$ 15", "", (15, 15)), (None, "$15 or $1500", None)])
def test_fees(one, fee_text, page, expected):
    got = one(H.fee_range(lit(fee_text), lit(page)))
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize("html, expected", [
    ('<a href="/therapists/ca/long-beach">x</a>', ("Long Beach", None)),
    ("<p>Offices in San Jose, CA 95112 </p>", ("Offices in San Jose", "95112")), ("<p>nowhere</p>", None)])
def test_city(one, html, expected):
    from matchweave.functions.text import strip_tags
    got = one(H.city_from_page(lit(html), strip_tags(lit(html))))
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize("text, expected", [
    ("Native American, Indigenous, or Alaska Native, White, Foo",
     ["Native American, Indigenous, or Alaska Native", "White", "Foo"]),
    ("White, Native American, Indigenous, or Alaska Native, Foo Bar",
     ["White", "Native American, Indigenous, or Alaska Native", "Foo Bar"]),
    ("hispanic or latino", ["Hispanic or Latino"]), ("", [])])
def test_label_split(one, text, expected):
    assert one(H.split_labels(lit(text))) == expected


def test_labelled_fields(one):
    html = ("<p><span>Gender</span><br>Woman</p><p><span>Race/ethnicity</span><br/>White, Asian or Asian American</p>"
            "<p><span>Other</span>x</p>")
    assert tuple(one(H.gender_and_ethnicity(lit(html)))) == ("Woman", ["White", "Asian or Asian American"])
    assert tuple(one(H.gender_and_ethnicity(lit("<p>none</p>")))) == (None, [])


PAGE = """<html><head><title>Pat Doe, LCSW | Directory</title><script>var a = "<p>no</p>";</script></head><body>
<a href="/therapists/ca/long-beach">Long Beach</a>
<div class="mb-6"><h3>Client Challenges &amp; Concerns</h3><p>Anxiety</p><p>Grief</p></div>
<div class="mb-6"><h3>Therapeutic Approaches</h3><li>EMDR</li><li>Somatic</li></div>
<div class="mb-6"><h3>Insurance</h3>Aetna. Fee: $120 - $180</div>
<div class="mb-6"><h3>Groups I Work With</h3><li>Adults</li><li>adults</li><li>Teens</li></div>
<div class="mb-6"><h3>About me</h3><p>Short.</p><p>I like long walks &amp; talks.</p></div>
<div class="x whitespace-pre-line">I help people find calm &amp; strength every day.</div>
<span class="accepting-badge">Accepting new clients</span> <div class="telehealth">Telehealth</div>
</body></html>"""


def test_whole_page(spark):
    pages = spark.createDataFrame([("http://x/profile/pat-doe/", PAGE), ("http://x/none", "<p>nothing</p>")], "url string, html string")
    rows = H.page_profiles(pages, "src").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.name, r.credentials, r.source_id, r.city) == ("Pat Doe", ["LCSW"], "pat-doe", "Long Beach")
    assert r.bio == "I help people find calm & strength every day."
    assert r.modalities == ["emdr", "somatic"] and r.specializations == ["anxiety", "grief"]
    assert (r.insurance_providers, r.sliding_scale, r.fee_min, r.fee_max) == (["aetna"], False, 120, 180)
    assert r.populations_served == ["Adults", "Teens"] and r.accepting_new_clients
    assert r.session_formats == ["telehealth"] and r.profile_completeness == 0.65


def test_bio_fallbacks(spark):
    def bios(html):
        df = H.page_pieces(spark.createDataFrame([("u", html)], "url string, html string"))
        return tuple(df.select(H.bio_from_sections(), H.bio_from_about()).first())

    no_prose = PAGE.replace("whitespace-pre-line", "plain")
    assert bios(no_prose)[0] == "Short. I like long walks & talks."
    bare = '<div class="mb-6"><h3>My way</h3>Plain words <i>only</i></div><div class="mb-6"><h3>Services</h3>' + "x" * 99 + "</div>"
    assert bios(bare)[0] == "Plain words only"
    long = "I have worked with families for many years and I enjoy helping them talk to each other openly."
    assert bios(f'<div class="box2-content">About Pat {long}</div>')[1] == long
    assert bios(f"<p>short</p><p>{long}</p>")[1] == long
    assert bios("<p>short</p>") == ("", "")


def test_unclosed_and_nested_elements():
    pieces = H.parse_page("<div class='mb-6'><h2>Groups</h2><p>one<p>two <b>bold</b></div><p>three<script>x</script>")
    assert pieces["paragraph"] == "one two bold"
    assert pieces["sections"][0]["heading"] == "groups" and pieces["sections"][0]["parts"] == ["Groups", "one", "two", "bold"]
    assert pieces["page_text"] == "Groups one two bold three"
    outer = H.parse_page("<div class='fee-box'>From <div class='fee'>$90</div></div><div class='x whitespace-pre-line'>"
                         + "a &amp;amp; b " * 5 + "</div><div class='whitespace-pre-line'>short</div></p>")
    assert outer["fee_text"] == "From$90" and len(outer["prose"]) == 1 and "&amp;" not in outer["prose"][0]


def test_references_are_resolved(spark):
    """As ``urljoin`` does, without the fragment."""
    from urllib.parse import urldefrag, urljoin
    bases = ["http://s.org", "http://s.org/", "http://s.org/a", "http://s.org/a/b", "http://s.org/a/b/", "http://s.org/a/b/c.html?q=1&r=/x/#frag", "https://u@s.org:80/a/./b/../c"]
    refs = ["", "c", "./c", "../c", "../../c", "../../../../c", "/c", "/a/../c", "/./c/.", "/c/..", "c/", "c/.", "c/..", ".", "..", "./", "../", "?page=2", "c?x=1#y", "#top",
            "//other.org/x/../y", "http://other.org/a/../b#z", "mailto:a@b.c", "tel:+1", "javascript:void(0)", "a//b", "../a//b/", "c;p=1", "...", "..c", "c?u=http://x/../y", "g?y/../x", "é/ü"]
    rows = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(rows, "base string, ref string")
    got = {(x.base, x.ref): x.link for x in df.select("base", "ref", H.resolve(F.col("base"), F.col("ref")).alias("link")).collect()}
    want = {(b, r): urldefrag(urljoin(b, r))[0] if ":" not in r.split("/")[0].split("?")[0] else r.split("#")[0] for b, r in rows}
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, wrong
    pages = spark.createDataFrame([("http://s.org/a/b", "<a href='../c'>x</a><a href=\"?page=2\">y</a><a href='#top'>z</a><a href=' /d '>w</a>")], "url string, html string")
    assert {r.link for r in H.links(pages).collect()} == {"http://s.org/c", "http://s.org/a/b?page=2", "http://s.org/a/b", "http://s.org/d"}


def test_links(spark):
    html = ('<a href="/therapists/ca/fresno">f</a><a class=x href="https://other.org/therapists/profile/a">a</a>'
            '<a href="/therapists/profile/a">b</a><a href="/therapists/ca/fresno">again</a><a href="/therapists/ca/profile-x">n</a>')
    pages = spark.createDataFrame([("p1", html), ("p2", html)], "url string, html string")
    found = H.links(pages, "http://site.org/")
    assert found.count() == 8
    assert [r.link for r in H.city_listing_links(found).collect()] == ["http://site.org/therapists/ca/fresno"]
    assert {r.link for r in H.profile_links(found).collect()} == {
        "https://other.org/therapists/profile/a", "http://site.org/therapists/profile/a"}


# ---------------------------------------------------------------- directory records
HITS = [
    '{"post_id":"1","post_title":" Ann ","permalink":"http://x/1","credentials":"AMFT, APCC,","online":["CA"],"in_person":[],'
    '"new_clients":0,"cost":{"individual_min":"60","individual_max":""},"tax_ids":{"orientation":[5,4,9],"specialty":[7],"language":[1],'
    '"age":[2],"therapist_modality":[734,999],"client_gender":[3]},"locations":[{"city":"Reno","state":"","online":true},'
    '{"city":" Davis ","state":"CA","in_person":true,"zip":"95616","lat":38.5,"lng":-121.7}]}',
    '{"post_id":"2","post_title":"Bob","permalink":"http://x/2","locations":[{"city":"Fresno","online":true,"in_person":true}]}',
    '{"post_id":"3","post_title":"  ","permalink":"http://x/3"}', '{"post_title":"No id","permalink":"http://x/4"}']

STRICT = ('<script>var z=1;</script><script>var cfg = {"a": 1, "taxonomies": {"orientation": {"4": "CBT skills", "5": "EMDR / DBT mix", '
          '"x": "no"}, "specialty": {"7": "Eating Disorders"}, "language": {"1": {"label": "english", "n": 2}}, "age": {"2": "Adults"}, '
          '"client_gender": {"3": "Women"}}};</script>')
LENIENT = '<script>window.cfg = {taxonomies: {"orientation":{4:"CBT skills",5:"EMDR / DBT mix",},"age":{2:"Adults"}},}</script>'


@pytest.mark.parametrize("html, n", [(STRICT, 6), (LENIENT, 3), ("<script>var other = {}</script>", 0)])
def test_taxonomy(spark, html, n):
    rows = D.parse_taxonomy(spark.createDataFrame([(html,)], "html string"), "html", "cfg").collect()
    assert len(rows) == n
    if n:
        assert ("orientation", 5, "EMDR / DBT mix") in {tuple(r) for r in rows}


def test_directory_hits(spark, tmp_path):
    (tmp_path / "hits.json").write_text("\n".join(HITS))
    hits = D.read_hits(spark, str(tmp_path))
    taxonomy = D.parse_taxonomy(spark.createDataFrame([(STRICT,)], "html string"), "html", "cfg")
    ann, bob = D.hits_to_profiles(hits, taxonomy, "directory").orderBy("source_id").collect()
    assert (ann.name, ann.credentials, ann.city, ann.zip_code) == ("Ann", ["AMFT", "APCC"], "Davis", "95616")
    assert ann.modalities == ["dialectical_behavior_therapy", "cognitive_behavioral_therapy"]
    assert ann.specializations == ["eating_disorders"] and ann.languages == ["english"]
    assert ann.populations_served == ["individuals", "Adults", "Women"]
    assert (ann.session_formats, ann.fee_min, ann.fee_max, ann.accepting_new_clients) == (["telehealth"], 60, 80, False)
    assert ann.profile_completeness == 1.0
    assert (bob.session_formats, bob.city, bob.fee_min, bob.profile_completeness) == (["both"], "Fresno", 50, 0.1)
    assert bob.insurance_providers == ["self_pay"] and bob.accepting_new_clients


def test_label_tables_point_into_the_domains():
    assert {t for _, t in vocab.MODALITY_KEYWORDS + vocab.ORIENTATION_LABELS} <= set(vocab.MODALITIES)
    assert {t for _, t in vocab.SPECIALIZATION_KEYWORDS + vocab.SPECIALTY_LABELS} <= set(vocab.SPECIALIZATIONS)
    assert {t for _, t in vocab.INSURER_NAMES + vocab.INSURER_KEYWORDS} <= set(vocab.INSURERS)


def test_large_pages_do_not_exhaust_the_pattern_stack(spark):
    filler = "x = 1; " * 300_000
    entries = ", ".join(f'"{i}": "label {i}"' for i in range(20_000))
    html = (f'<script>{filler}</script><script>{filler} var cfg = {{"taxonomies": {{"age": {{{entries}}}}}}};</script>'
            f'<script id="__NEXT_DATA__">{{"props":{{"pageProps":{{"profile":{{"slidingScale":true,"pad":"{filler}"}}}}}}}}</script>'
            "<!-- " + "c " * 500_000 + "--><p>kept</p>")
    page = spark.createDataFrame([(html,)], "html string")
    assert D.parse_taxonomy(page, "html", "cfg").count() == 20_000
    from matchweave.functions.text import strip_tags
    row = page.select(H.embedded_profile(F.col("html")).alias("e"), strip_tags(F.col("html")).alias("t")).first()
    assert row.e.sliding is True and row.t == "kept"


def test_title_is_split_once(spark):
    rows = spark.createDataFrame([("Jane Doe, LMFT, PhD",), (" ,  Ann Lee , Therapist",), ("LMFT, x",), (None,)], "t string")
    got = rows.select(H.name_from_title(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == ["Jane Doe", "Ann Lee, Therapist", "", None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_pages_are_parsed_in_bounded_parts(spark):
    """More pages in a batch than are taken apart at a time, null ones among them."""
    n = 2 * H.PAGES_AT_ONCE + 7
    rows = [(i, None if i % 50 == 0 else f'<div class="mb-6"><h3>My Groups</h3><ul><li>x{i}</li></ul></div><p>p{i}</p>') for i in range(n)]
    got = {r.k: r for r in H.page_pieces(spark.createDataFrame(rows, "k int, html string").coalesce(1), key="k").collect()}
    assert len(got) == n
    for k, html in rows:
        want, row = H.parse_page(html), got[k].asDict(recursive=True)
        assert {c: row[c] for c in want} == want
