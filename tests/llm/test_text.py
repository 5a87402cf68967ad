"""Personal data, chat formatting, toxicity and quality."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.llm import chat, cotraining, pii, toxicity

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_detect_equals_the_plain_patterns():
    rnd = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+", "+1 (555) 010-0200",
             " ", "  ", "é", "%", "_", "10.0.0.1", "0010.1.2.3", "..", "@@", "\n", "00000000000000"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25)))
        assert pii.detect(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "a.b" * 100_000 + "@", "+1" + " " * 300_000,
                 "one " * 80_000, "[at] " * 60_000, "a dot " * 50_000):
        pii.disguised(text, pii.detect(text))


@pytest.mark.parametrize("text, kind, found", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("mail john.doe(at)example(dot)co(dot)uk now", "email", "john.doe(at)example(dot)co(dot)uk"),
    ("ask jane dot doe at example dot org today", "email", "jane dot doe at example dot org"),
    ("ask jаne@exаmple.com today", "email", "jаne@exаmple.com"),
    ("write to ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ please", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("a joe@​example.com b", "email", "joe@​example.com"),
    ("call plus one five five five zero one zero two zero zero now", "phone", "plus one five five five zero one zero two zero zero"),
    ("call +1 five five five, oh one oh, two oh oh", "phone", "+1 five five five, oh one oh, two oh oh"),
    ("host one nine two dot one six eight dot zero dot one is up", "ip", "one nine two dot one six eight dot zero dot one"),
    ("host 10[.]0[.]0[.]1 is up", "ip", "10[.]0[.]0[.]1"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four" + " one" * 15),
    ("card 4111‑1111‑1111‑1111 ok", "card", "4111‑1111‑1111‑1111"),
    ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    assert pii.detect(text) == plain_base(text)
    spans = pii.disguised(text, pii.detect(text))
    assert (kind, text.index(found), text.index(found) + len(found)) in spans


@pytest.mark.parametrize("text", ["meet me at noon. Then go", "look at this dot on the i", "one two three and four", "", "été à 12 h, 3.5 % [x]",
                                  "at at dot dot", "a joe@example.com b", "seven at nine dot"])
def test_plain_texts_have_no_disguises(text):
    assert pii.disguised(text, pii.detect(text)) == []


def test_find_and_redact(spark):
    rows = [(1, "x joe@example.com, jim [at] example [dot] com, 10.0.0.1"), (2, None), (3, ""), (4, "clean"), (4, "clean"), (None, "+1 555 010 0200 é")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = pii.redact(df).collect()
    assert [(r.doc_id, r.text, r.spans) for r in got] == [
        (1, "x [EMAIL], [EMAIL], [IP]", "s"), (2, None, "s"), (3, "", "s"), (4, "clean", "s"), (4, "clean", "s"), (None, "[PHONE] é", "s")]
    joined = pii.find(df).select("doc_id", pii.joined(F.col("spans"), True).alias("b"), pii.joined(F.col("spans"), False).alias("a")).collect()
    assert (joined[0].b, joined[0].a) == ("email:2:17,ip:47:55", "email:2:17,email:19:45,ip:47:55") and joined[1].a == ""
    assert pii.redact(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rnd = random.Random(8)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\s", "<", "]", "] ", "%5D", "%", "a", "é", "\n", " ", "$1", "\U0001f642", "<s>["]
    text = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
    roles = ["system", "user", "assistant", "tool", "", "x] y", "</s>", "a%5Db]", None]
    rows = [(c, t, rnd.choice(roles), rnd.choice([None, text(), text()]), "extra") for c in range(60) for t in range(rnd.randrange(1, 9))]
    rows += [(None, 1, "user", "no id", ""), (None, None, "user", "first", ""), (0, 0, "user", "again", ""), (0, 0, "user", "again", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(df).withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_texts(F.col("segments"))})
    got = {r.conv_id: r for r in done.collect()}
    assert got.keys() == {r[0] for r in rows}
    for key, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x, _ in rows if c == key))
        assert [tuple(t) for t in r.turns] == [o[2:] for o in own]
        assert r.loss == [o[3] for o in own if o[2] == "assistant"]
        assert r.formatted == "".join(s.text for s in r.segments)
        for _, _, _, x in own:
            assert r.formatted.count("</s>") == len(own) and r.formatted.count("<s>") == len(own) and "[INST]" not in r.formatted
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_machine_checks_the_order(spark):
    orders = {1: "system user assistant", 2: "user assistant user", 3: "assistant user", 4: "user user assistant", 5: "user system", 6: "user robot user"}
    rows = [(c, t, role, "x") for c, o in orders.items() for t, role in enumerate(o.split())]
    got = {r.conv_id: (r.final_state, r.broken_turn)
           for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: ("assistant", 0), 2: ("user", 0), 3: ("user", 1), 4: ("assistant", 2), 5: ("system", 2), 6: ("user", 2)}


def test_machine_emits_the_segments(spark):
    """Flags come from the states a template names, and long conversations keep all their turns."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(1000)]
    rows += [(2, 0, "assistant", "too soon"), (2, 1, "tool", "never"), (2, 2, "user", "asked"), (2, 3, "assistant", "said")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = F.col("segments.text")
    got = {r.conv_id: r for r in chat.format_conversations(df).select("*", chat.loss_texts(F.col("segments")).alias("loss"), texts.alias("texts")).collect()}
    assert got[1].loss == [f"text {t}" for t in range(1, 1000, 2)] and len(got[1].texts) == 3000 and got[1].broken_turn == 0
    assert got[2].loss == ["too soon", "said"] and (got[2].broken_turn, got[2].final_state) == (1, "assistant")
    other = chat.Template(loss_states=("user",), moves=(("start", "user", "user"), ("user", "user", "user")))
    got = {r.conv_id: r for r in chat.format_conversations(df, other).select("*", chat.loss_texts(F.col("segments")).alias("loss")).collect()}
    assert got[2].loss == ["asked"] and got[1].broken_turn == 2


def test_query_runs_the_machine(spark):
    from matchweave.llm import queries
    folder = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(folder):
        pytest.skip("driver tables are not here")
    plan = queries.QUERIES["op8_chat_format"](spark, folder).select("loss_sha256")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("start>user") >= 1 and "aggregate(" in plan


def corpus(n=600, seed=1):
    """(doc_id, text, toxic, quality, lang, source, n_chars); every toxic text has one toxic sentence."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic, poor = i % 7 == 0, i % 5 == 1
        sentences = [" ".join(rnd.choices(words, k=rnd.randrange(4, 12))).capitalize() + "." for _ in range(rnd.randrange(3, 20))]
        if poor:
            sentences = [s.upper().replace(" ", "!! ") for s in sentences] if i % 2 else [s.replace(" ", " | ") for s in sentences]
        if toxic:
            sentences.insert(rnd.randrange(len(sentences)), f"You {rnd.choice(['vilewordish', 'grimfoulest'])} one.")
        text = "\n".join(sentences)
        rows.append((i, text, int(toxic), int(not poor), rnd.choice(["en", "fr"]), rnd.choice(["s0", "s1"]), len(text)))
    return rows


def test_noisy_or_learns_sentences(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int, lang string, source string, n_chars long")
    labels = df.select("doc_id", "toxic")
    model = toxicity.fit(df.select("doc_id", "text"), labels)
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "...!\n"), (0, rows[0][1])], "doc_id long, text string")
    scored = toxicity.score(df.select("doc_id", "text", F.lit("x").alias("score")).unionByName(odd.withColumn("score", F.lit(""))), model)
    got = {r.doc_id: r for r in scored.collect()}
    assert got[None].score == got[-1].score == got[-2].score == 0.0
    for i, text, toxic, *_ in rows:
        assert 0 <= got[i].score <= 1 and (got[i].score >= 0.5) == bool(toxic)
        if toxic:
            assert any("vilewordish" in text[s.start:s.end] or "grimfoulest" in text[s.start:s.end] for s in got[i].offending)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    drawn = {r.doc_id for r in toxicity.training_rows(df, labels, "toxic", 1000).collect()}
    assert drawn == {r[0] for r in rows} - held
    nothing = toxicity.fit(df.limit(0), labels)
    assert [r.score for r in toxicity.score(odd, nothing).collect()][:3] == [0.0, 0.0, 0.0]


def test_gradient_of_the_likelihood(spark):
    """The likelihood against a loop over texts and sentences, its gradient against differences."""
    rows = corpus(60)
    texts, labels = [r[1] for r in rows], [r[2] for r in rows]
    index = {w: i for i, w in enumerate(sorted({f for t in texts for f in toxicity.text_features(t)}))}
    bags = toxicity.Bags.join([toxicity.numbered(t, index) for t in texts], labels)
    rng = np.random.default_rng(2)
    w, b, wrong = rng.normal(0, 0.5, len(index)), -2.0, 0.05
    loss, grad, by_bias = bags.gradient(w, b, wrong)
    total = 0.0
    for text, label in zip(texts, labels):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = set(re.findall(r"\w+", sentence))
            if words:
                z = b + sum(w[index[f]] for x in words for f in [x] + [x[:n] + "*" for n in (5, 7) if len(x) > n])
                clean *= 1 - 1 / (1 + np.exp(-z))
        total -= np.log(wrong + (1 - wrong) * (1 - clean)) if label else np.log(clean)
    assert loss == pytest.approx(total / len(texts))
    for i in [*rng.integers(0, len(index), 20)]:
        step = np.zeros(len(index))
        step[i] = 1e-5
        assert grad[i] == pytest.approx((bags.gradient(w + step, b, wrong)[0] - bags.gradient(w - step, b, wrong)[0]) / 2e-5, abs=1e-7)
    assert by_bias == pytest.approx((bags.gradient(w, b + 1e-5, wrong)[0] - bags.gradient(w, b - 1e-5, wrong)[0]) / 2e-5, abs=1e-7)


def test_fit_in_spark_equals_training_in_memory(spark):
    rows = corpus(300) + [(1000 + i, r[1], 0, 1, "en", "s0", 1) for i, r in enumerate(corpus(300)[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int, lang string, source string, n_chars long")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    drawn = {}
    for i, text, toxic, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            drawn[text] = max(toxic, drawn.get(text, 0))
    order = sorted(drawn, key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    want = toxicity.train(order, np.array([drawn[t] for t in order]))
    assert model == want and model.weights
    few = toxicity.training_texts(df, df.select("doc_id", "toxic"), 6000, 20_000).collect()
    assert 0 < sum(len(r.text.encode()) for r in few) <= 20_000 and len(few) < len(drawn)


def test_sentences_of_other_scripts():
    model = toxicity.Model({"\u6bd2": 9.0}, -4.0)
    z = model.sentences("\u597d\u3002\u6bd2\uff01\u597d \u597d\u0964\u597d\u061f", toxicity.Words(model.weights))
    assert len(z) == 4 and (z > 0).tolist() == [False, True, False, False]


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = corpus(200)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, toxic int")
    flipped = df.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    models = [toxicity.fit(df.select("doc_id", "text"), x.select("doc_id", "toxic")) for x in (df, flipped)]
    assert models[0] == models[1]


def test_co_training_scores_held_out_rows(spark):
    rows = corpus(700, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int, lang string, source string, n_chars long").drop("toxic")
    labels = df.where("doc_id % 2 = 0").select("doc_id", "quality")
    docs = df.drop("quality")
    model = cotraining.fit(docs, labels)
    got = {r.doc_id: r for r in cotraining.score(docs, model).collect()}
    wrong = sum((got[i].keep != bool(quality)) for i, _, _, quality, *_ in rows)
    assert wrong <= 0.02 * len(rows)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s0", 0), (2, " ", None, "new", -5)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r.score, r.keep) for r in cotraining.score(odd, model).collect()] == [(0.5, True)] * 3
    assert cotraining.fit(docs, labels.limit(0)) is None and cotraining.score(docs, None).where("not keep").count() == 0
    assert cotraining.score(docs.drop("lang", "source"), model).where("keep").count() > 0


def test_content_view_knows_words_not_shapes(spark):
    """Good and poor texts of one shape, told apart by their words; nothing of the text is in the other view."""
    rnd = random.Random(12)
    good, poor = (["".join(rnd.choice("abcdefghijklm") for _ in range(5)) for _ in range(60)] for _ in range(2))
    rows = [(f"id {i}", " ".join(rnd.choices((good, poor)[i % 2], k=60)) + ".", "en", "s", 361, f"http://host/{i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long, url string")
    labels = docs.selectExpr("doc_id", "cast(split(doc_id, ' ')[1] % 2 = 0 as int) as quality").where("split(doc_id, ' ')[1] < 300")
    got = {r.doc_id: r.keep for r in cotraining.score(docs, cotraining.fit(docs, labels)).collect()}
    assert sum(got[f"id {i}"] != (i % 2 == 0) for i in range(300, 500)) <= 4
    hashes = cotraining.Hashes()
    views = cotraining.text_view([rows[0][1], rows[1][1]], hashes)
    assert np.abs(views[0, :cotraining.WORDS] - views[1, :cotraining.WORDS]).sum() > 5
    a, b = cotraining.page_view(["en", "de"], ["s", "s"], [10, 10], [None, "http://other/x?y"])
    assert (a != b).any() and cotraining.page_view(["en"], ["s"], [10], [None]).tolist() == [a.tolist()]


def test_scores_beside_columns_of_the_same_name(spark):
    rows = corpus(200, 3)
    df = spark.createDataFrame([(*r, "mine", -1) for r in rows], "doc_id long, text string, toxic int, quality int, lang string, source string, n_chars long, score string, keep int")
    model = cotraining.fit(df, df.select("doc_id", "quality"))
    own = cotraining.score(df, model, "__score", "__keep")
    assert own.columns == [*df.columns, "__score", "__keep"] and own.where("score <> 'mine' or keep <> -1").count() == 0
    assert cotraining.score(df, model).schema["score"].dataType.typeName() == "double"
    own = toxicity.score(df, toxicity.fit(df, df.select("doc_id", "toxic")), score="__score", offending="__spans")
    assert own.columns == [*df.columns, "__score", "__spans"] and own.where("score <> 'mine'").count() == 0


def test_long_and_unbroken_texts_are_scored(spark):
    rows = corpus(200, 3)
    long = [(1000, "word " * 400_000), (1001, "q" * 2_000_000), (1002, " ".join(r[1] for r in rows) * 20)]
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, toxic int, quality int")
    odd = spark.createDataFrame(long, "doc_id long, text string")
    quality, bad = cotraining.fit(df, df.select("doc_id", "quality")), toxicity.fit(df, df.select("doc_id", "toxic"))
    for scored in (cotraining.score(odd, quality), toxicity.score(odd, bad), cotraining.score(odd.limit(0), quality), toxicity.score(odd.limit(0), bad)):
        assert all(0 <= r.score <= 1 for r in scored.collect())
    hashes = cotraining.Hashes()
    cotraining.text_view([r[1] for r in long], hashes)
    assert all(len(w) <= cotraining._MEMO_LETTERS for w in hashes)


def test_exchange_helps_the_weaker_view():
    rng = np.random.default_rng(6)
    y = (rng.random(3000) < 0.6).astype(float)
    strong = np.column_stack([y + rng.normal(0, 0.25, 3000), rng.normal(size=3000)])
    weak = np.column_stack([(2 * y - 1)[:, None] * 0.35 + rng.normal(size=(3000, 40))])
    few, held = np.arange(60), np.arange(60) % 3 == 0
    before = cotraining.co_train([strong[few], weak[few]], y[few], [strong[:0], weak[:0]], held)
    after = cotraining.co_train([strong[few], weak[few]], y[few], [strong[60:2000], weak[60:2000]], held)
    right = [((m.views[1].odds(weak[2000:]) > 0) == (y[2000:] > 0)).mean() for m in (before, after)]
    assert right[1] > right[0]


def test_pool_holds_each_unlabelled_text_once(spark):
    rows = [(i, f"text {i % 40 if i < 400 else i}", "en", "s", 7) for i in range(6000)] + [
        (7000, "b", "en", "s", 1), (7000, "a", "en", "s", 1), (None, "no id", "en", "s", 1), (None, None, "en", "s", 1), (7001, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1), (1, 0), (500, 1), (501, None)], "doc_id long, quality int")
    drawn = cotraining._digests(docs.where("doc_id in (0, 1)")).select("digest")
    pool = cotraining.unlabelled(docs, labels, drawn)
    assert pool.count() == 38 + 5600 - 1 + 1 + 2  # texts 0, 1 are drawn, 500 has a label, 7000 counts once
    assert pool.where("lot < 0 or lot >= 1 or draw < 0 or draw >= 1").count() == 0


def test_labelled_copies_are_one_row(spark):
    docs = spark.createDataFrame([(i, "copy" if i < 300 else f"text {i}") for i in range(600)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) as quality")
    rows = cotraining.labelled_rows(docs, labels, 100).collect()
    assert len(rows) == len({r.digest for r in rows}) == 100
    found = [r for r in cotraining.labelled_rows(docs, labels, 1000).collect() if int(r.who) < 300]
    assert len(found) == 1 and found[0].label == 1


def test_exchange_in_spark_equals_the_one_in_memory(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(5000) < 0.5).astype(float)
    x = np.zeros((5000, sum(cotraining._WIDTHS)))
    x[:, 0], x[:, cotraining._WIDTHS[0]] = y + rng.normal(0, 0.2, 5000), y + rng.normal(0, 0.2, 5000)
    x = x.astype("<f2").astype(np.float64)
    views = [x[:, :cotraining._WIDTHS[0]], x[:, cotraining._WIDTHS[0]:]]
    trained = [cotraining.Regression.fit(v[:300], y[:300]) for v in views]
    memory = cotraining.Matrices(views)
    df = spark.createDataFrame([(float(a), float(b), bytearray(r.astype("<f2").tobytes())) for a, b, r in zip(memory.lots, memory.draws, x)],
                               "lot double, draw double, views binary")
    past = []
    for _ in range(2):
        counts = memory.tally(trained, past, 2.94)
        assert (counts == cotraining.Documents(df).tally(trained, past, 2.94)).all() and counts[0, :, 0].sum() == 5000
        new = cotraining._surest(counts, trained, 0.1, 50)
        every = [len(t[0]) for t in memory.take(new, past, 2.94, 5000)]
        assert len(new) == 4 and all(abs(n - 0.1 * c) <= 12 for n, c in zip(every, counts[:, :, 0].ravel()))
        got, want = cotraining.Documents(df).take(new, past, 2.94, 50), memory.take(new, past, 2.94, 50)
        assert all((a == b).all() and len(a) == 50 for g, w in zip(got, want) for a, b in zip(g, w))
        past += new


@pytest.mark.parametrize("text, kind, found", [
    ("mail anna at firma dot it now", "email", "anna at firma dot it"),
    ("mail anna at firma dot xyz", "email", "anna at firma dot xyz"),
    ("schreib anna at firma punkt de bitte", "email", "anna at firma punkt de"),
    ("schreib anna punkt meier ät firma punkt de", "email", "anna punkt meier ät firma punkt de"),
    ("escribe ana arroba empresa punto es hoy", "email", "ana arroba empresa punto es"),
    ("ecris a jean arobase societe point fr", "email", "jean arobase societe point fr"),
    ("ecris a jean at societe point fr", "email", "jean at societe point fr"),
    ("mail anna at firma dot de dot thanks", "email", "anna at firma dot de"),
    ("look at this dot ok anna at firma dot nz", "email", "anna at firma dot nz"),
    ("host 10.0.0.one is up", "ip", "10.0.0.one"),
    ("host ten 10 dot zero.0.1 is up", "ip", "10 dot zero.0.1"),
    ("call +1 555 010 02 zero zero now", "phone", "+1 555 010 02 zero zero"),
    ("card 4111 1111 1111 111 one ok", "card", "4111 1111 1111 111 one"),
])
def test_few_spelled_digits_and_other_languages(text, kind, found):
    assert (kind, text.index(found), text.index(found) + len(found)) in pii.disguised(text, pii.detect(text))


@pytest.mark.parametrize("text", ["was at this point in time", "at some point it was", "we met at that point now", "este punto juan@ejemplo.es",
                                  "host 10.0.0.1, one of many", "server one 10.0.0.1", "call +1 555 010 0200, one of us", "one of 2 or three, 4"])
def test_words_around_plain_identifiers_are_none(text):
    assert pii.disguised(text, pii.detect(text)) == []


def test_long_runs_of_words_take_linear_time():
    for text in ("a punkt " * 50_000, "a at b dot " * 40_000, "x at " + "a" * 300_000 + " dot b", "1 one " * 60_000, "1." * 150_000 + "one", "one. " * 60_000):
        pii.disguised(text, pii.detect(text))
