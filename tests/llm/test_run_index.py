"""Repeats of long strings against comparisons of all of them."""

import random

import numpy as np
import pytest

from matchweave.llm import run_index


def plain_repeats(docs, length):
    """{(doc_id, text): (removed runs, kept)} of distinct (doc_id, text) in order."""
    seen, out = set(), {}
    for doc_id, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i:i + length] in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(data[i:i + length])
        edges = [i for i in range(len(data) + 1) if (gone[i] if i < len(data) else 0) != (gone[i - 1] if i else 0)]
        out[doc_id, text] = (list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(data, gone) if not g))
    return out


def test_index_rows_matches_and_runs():
    rnd = random.Random(2)
    for case in range(120):
        texts = [bytes(rnd.choice(b"ab" if case % 2 else b"a\0\xff") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 12))]
        texts += texts[:3] if case % 3 == 0 else []
        raw, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts)))
        ends, owner = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(sizes)), sizes)
        suffixes = sorted(range(len(raw)), key=lambda i: (bytes(raw[i:ends[i]]), owner[i]))
        row = run_index.suffix_rows(raw, ends, owner)
        assert [row[i] for i in suffixes] == list(range(len(raw)))
        index = run_index.RunIndex.build(raw, sizes)
        starts = set((np.cumsum(sizes) - sizes).tolist())
        transform = [256 if i in starts else int(raw[i - 1]) for i in suffixes]
        assert np.repeat(index.symbols, index.lengths).tolist() == transform
        lengths, match = index.stream(len(raw))
        for before, i in zip(suffixes, suffixes[1:]):
            a, b = bytes(raw[i:ends[i]]), bytes(raw[before:ends[before]])
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert (match[i], lengths[i]) == (before, same)
        for length in (1, 2, 5):
            seen, want = set(), []
            for t in texts:
                for i in range(len(t)):
                    string = t[i:i + length]
                    want.append(len(string) == length and string in seen)
                    seen.add(string)
            assert run_index.earlier_copies(lengths, match, np.arange(len(raw)), length).tolist() == want


def passages(seed, n=120):
    """Texts that share passages, with changes, inside long and short texts, in several scripts."""
    rnd = random.Random(seed)
    letters = "abcdefghij éß日 \n"
    words = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    shared = [words(rnd.randint(20, 140)) for _ in range(6)]
    texts = []
    for i in range(n):
        parts = [rnd.choice([words(rnd.randint(0, 60)), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 30):]]) for _ in range(rnd.randint(0, 6))]
        texts.append("".join(parts))
    texts[7] = texts[5]
    texts[8] = texts[5][:50] + "x" + texts[5][50:]
    texts[9] = "ab" * 200
    texts[10] = " " * 3000
    texts[11] = shared[0] * 40
    return list(enumerate(texts))


@pytest.mark.parametrize("length,gram,shard_bytes,most", [(20, 7, 1 << 20, 8192), (20, 7, 500, 3), (33, 32, 2000, 0), (100, 32, 1 << 20, 8192), (8, 1, 4000, 50)])
def test_repeats_equal_all_strings(spark, monkeypatch, length, gram, shard_bytes, most):
    monkeypatch.setattr(run_index, "STRIP", 1 << 11)
    monkeypatch.setattr(run_index, "CHUNK", 1 << 13)
    rows = passages(length)
    shuffled = random.Random(1).sample(rows, len(rows))
    df = spark.createDataFrame([(t, d, 1, "x") for d, t in shuffled], "text string, doc_id long, pos int, kept string").repartition(5)
    got = {r.doc_id: ([tuple(s) for s in r.removed], bytes(r.kept), r.n_bytes) for r in run_index.without_repeats(df, length, gram, shard_bytes, most).collect()}
    want = {d: (runs, kept, len(t.encode())) for (d, t), (runs, kept) in plain_repeats(rows, length).items()}
    assert got == want and any(runs for runs, _, _ in want.values())


def test_nulls_repeated_rows_ties_and_no_rows(spark):
    text = "a passage that is long enough to be found again in another text"
    rows = [(3, text), (3, text), (None, text + "!"), (1, "lead " + text), (2, None), (4, ""), (5, text), (5, text + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = run_index.without_repeats(df, 30, 8).collect()
    assert len(got) == len(rows) and set(got[0].__fields__) == {"doc_id", "n_bytes", "removed", "kept"}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_bytes, bytes(r.kept)))
    n = len(text)
    assert by[3] == [(n, b"")] * 2 and by[2] == by[4] == [(0, b"")] and by[None] == [(n + 1, b"!")]
    assert by[1] == [(n + 5, b"lead " + text.encode())]
    assert sorted(k for _, k in by[5])[0] == b"" and len(by[5]) == 2
    assert run_index.without_repeats(df.limit(0)).count() == 0


def test_long_text(spark):
    rnd = random.Random(4)
    part = "".join(rnd.choice("abcdefgh ") for _ in range(200_000))
    long = part + "".join(rnd.choice("abcdefgh ") for _ in range(100_000)) + part[1000:150_000]
    df = spark.createDataFrame([(1, long), (2, "x" + long[5:])], "doc_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.removed], bytes(r.kept)) for r in run_index.without_repeats(df).collect()}
    assert got[1] == ([(300_000, 449_000)], long[:300_000].encode())
    assert got[2] == ([(1, len(long) - 4)], b"x")
