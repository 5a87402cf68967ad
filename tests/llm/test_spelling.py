"""Spelling variants against comparisons of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from matchweave.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def plain_vocabulary(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def words_of(seed, n, letters="abé"):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(n)}
    words |= {"prefix" + w for w in list(words)[:n // 3]}  # one hot cell
    return {w: rnd.choice([5, 5, 6, 30, 31, 200, 4000]) for w in sorted(words)}


@pytest.mark.parametrize("block_rows,tile_rows", [(2048, 8192), (7, 20)])
def test_variants_equal_all_pairs(spark, block_rows, tile_rows):
    n = words_of(block_rows, 500)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain_variants(n)
    found = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df, block_rows, tile_rows).collect()}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    assert found == {w: (len(v), max(map(n.get, v)), min(v, key=lambda x: (-n[x], x))) for w, v in near.items() if v}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df).collect()}
    assert got == want and any(v[4] not in (w, v[2]) for w, v in got.items())


def test_strips_and_words_of_any_width(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ENTRIES", 1 << 9)
    monkeypatch.setattr(spelling, "LETTERS", 1 << 9)
    long = "w" * 3000
    n = {**words_of(3, 120), "x": 7, "y": 9, "": 5, "日本語文字列": 8, "日本語文字": 50, long: 10, long + "z": 60, "a" + long: 5}
    rows = [(w, c) for w, c in n.items() if w]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == plain_variants(dict(rows))


def test_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 50)
    rnd = random.Random(5)
    pool = ["Straße", "ÉTÉétéÿ", "letters", "LETTERS", "a×b÷cdef", "abcdef日ghijkl", "ab-cdefgh", "short", "ǅabcdef", "İstanbul"] + [
        "".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(30)]
    rows = [(i, " ".join(rnd.choices(pool, k=rnd.randint(0, 60)))) for i in range(300)]
    rows += [(None, "letters letters"), (7, None), (8, ""), (9, "longword " * 20_000), (9, "letters"), (9, "letters"), (10, "q" * 100_000)]
    df = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, word string, n int")
    got = {r.word: r.n for r in spelling.vocabulary(df).collect()}
    assert got == plain_vocabulary(rows) and "straße" in got


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    words = spelling.vocabulary(empty)
    assert words.count() == 0 and spelling.variants(words).count() == 0
    lone = spark.createDataFrame([("lonely", 5)], "word string, n long")
    assert [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(lone).collect()] == [
        ("lonely", None, "lonely", 5, 0, None)]
