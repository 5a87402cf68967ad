"""Near-duplicate operators against all pairs."""

import itertools
import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from matchweave.llm import cells, range_join, simhash
from tests.llm.plain import components


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [
        (rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    edges += [(5, 5)]
    got = dict(map(tuple, cells.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    want = components(400, edges)
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]}
    assert cells.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text)
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "one TWO", "ÉTÉ a\x0bb\x1cc d", "a b c d a b c d", "x " * 500]
    for text in texts[1:]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    words = [str(i % 977) for i in range(70_000)]
    parts = np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(69_998)], "u8")
    bits = [int((parts >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert simhash.fingerprint(" ".join(words)) == sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(df).collect()}
    assert got == {i: int(np.uint64(plain_fingerprint(t or "")).view(np.int64)) for i, t in enumerate(texts)}


def near_values(n=3000):
    rng = np.random.default_rng(11)
    values = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for k in range(n // 2):  # chains of small changes, and one large group around the first value
        base = values[0] if k % 3 == 0 else values[rng.integers(n)]
        for bit in rng.integers(0, 64, rng.integers(1, 4)):
            base ^= np.uint64(1) << np.uint64(bit)
        values[n // 2 + k] = base
    return np.unique(np.append(values, np.uint64(0)))


def test_vantage_tree_meets_every_pair_once():
    values = near_values()
    tree = simhash.VantageTree(values[::5], 5, 3)
    rows, shards, home = tree.route(values)
    assert tree.shards > 8 and home.sum() == len(values) and len(rows) < len(values) * tree.shards
    own = np.empty(len(values), int)
    own[rows[home]] = shards[home]
    at = {(r, s) for r, s in zip(rows.tolist(), shards.tolist())}
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= 3) + i + 1:
            meet = [s for s in {own[i], own[j]} if (i, s) in at and (j, s) in at]
            assert len(meet) == 1


def test_every_pair_meets_in_the_tree_of_some_band():
    values = near_values()
    met = [set() for _ in values]
    for n, tree in enumerate(simhash.grove(values[::5], 4.5, 3, 2)):
        rows, shards, home = tree.route(values)
        assert tree.reach == 1 and home.sum() == len(values)
        for r, s in zip(rows.tolist(), shards.tolist()):
            met[r].add((n, s))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= 3) + i + 1:
            assert met[i] & met[j]


def test_forest_names_components_by_their_smallest_row():
    rng = np.random.default_rng(4)
    left, right = np.sort(rng.integers(0, 400, 260)), rng.integers(0, 400, 260)
    forest = cells.Forest(400)
    for at in range(0, 260, 40):
        forest.link(left[at:at + 40], right[at:at + 40])
    assert forest.find(np.arange(400)).tolist() == components(400, zip(left.tolist(), right.tolist()))


def test_near_components(spark):
    values = near_values()
    signed = values.view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in signed], "key long")
    pairs = [(i, j) for i in range(len(values)) for j in
             (np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= 3) + i + 1).tolist()]
    want = components(len(values), pairs)
    got = dict(map(tuple, simhash.near_components(df, 3, shard_rows=200, sample_rows=500, block_rows=100).collect()))
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, set()).add(int(signed[i]))
    assert got == {v: min(g) for g in groups.values() if len(g) > 1 for v in g}


def test_near_pairs_meet_by_values_of_bands():
    rng = np.random.default_rng(8)
    for reach, bands in itertools.product((0, 1, 3, 8, 11), (1, 2, 5, 9, 20)):
        base = rng.integers(0, 1 << 64, 40, np.uint64)
        flipped = [sum(1 << int(b) for b in rng.choice(64, reach, replace=False)) for _ in base]
        values = np.concatenate([base, base ^ np.array(flipped, np.uint64)])
        met = set()
        for tree in simhash.band_values(len(values), reach, bands, 4):
            rows, at, home = tree.route(values)
            assert np.array_equal(np.sort(rows[home]), np.arange(len(values)))  # one home each
            for shard in np.unique(at):
                here, its = rows[at == shard], home[at == shard]
                met |= {frozenset(p) for p in itertools.product(here[its].tolist(), here.tolist())}
        assert all(frozenset((i, i + 40)) in met for i in range(40))


def test_near_components_by_values_at_a_wide_reach(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 64, 500, np.uint64)
    near = [base[i % 60] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 5 + i % 6, replace=False))) for i in range(400)]
    signed = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(255), np.uint64((1 << 64) - 1)]])).view(np.int64)
    values = signed.view(np.uint64)
    pairs = [(i, j) for i in range(len(values)) for j in
             (np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= 8) + i + 1).tolist()]
    want = {}
    for i, c in enumerate(components(len(values), pairs)):
        want.setdefault(c, set()).add(int(signed[i]))
    df = spark.createDataFrame([(int(v),) for v in signed], "key long")
    for block_rows in (4096, 3):
        got = dict(map(tuple, simhash.near_components(df, block_rows=block_rows, **corpus_pipeline.NEAR).collect()))
        assert got == {v: min(g) for g in want.values() if len(g) > 1 for v in g} and len(got) > 300
    assert simhash.near_components(df.limit(0), **corpus_pipeline.NEAR).count() == 0


def test_routed_rows_of_the_pipeline_follow_the_input(spark):
    """With a tree for each of three bands and shards of 65,536 five times the fingerprints made 21.7 times the rows."""
    made = []
    for n in (10_000, 50_000):
        df = spark.range(n).select(F.xxhash64("id").alias("key"))
        made.append(cells.in_block_pairs(simhash.routed(df, **corpus_pipeline.NEAR), 4096).count())
    assert made[0] <= 27 * 10_000 and made[1] <= 5.3 * made[0]


def test_near_duplicates_of_odd_rows(spark):
    same = "some words that are said more than once in this small corpus of texts"
    rows = [(9, same), (4, same.upper()), (4, same), (None, same), (7, None), (8, ""), (2, "other words entirely here"), (None, "alone here")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(9, 4), (4, 4), (4, 4), (None, 4), (7, 7), (8, 7), (2, 2), (None, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    vectors = [centres[i % 12] + rng.normal(size=8) * rng.choice([0.1, 0.25, 0.6]) for i in range(500)]
    vectors += [centres[0] + rng.normal(size=8) * 0.05 for _ in range(250)]
    vectors += [vectors[3]] * 60 + [vectors[3] * 2]
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    units = np.array([r[1] for r in rows])
    units /= np.linalg.norm(units, axis=1)[:, None]
    linked = units @ units.T >= 0.9
    np.fill_diagonal(linked, False)
    want = components(len(rows), zip(*map(np.ndarray.tolist, np.nonzero(linked))))
    got = sorted(map(tuple, range_join.similar(df, 0.9, cell_rows=60, sample_rows=300, block_rows=64).collect()))
    assert got == [(i, int(linked[i].sum()), want[i], want[i] == i) for i in range(len(rows))]


def test_range_join_prunes_separated_cells():
    pivots = np.eye(16)
    units = np.repeat(pivots, 5, axis=0)
    rows, at, home = range_join.assign(units, pivots, math.sqrt(0.2))
    assert len(rows) == len(units) and home.all()


def test_range_join_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, -0.0]), (11, [-1.0, 0.0]), (12, [1e-200, 0.0]), (13, [1e200, 1e190])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, range_join.similar(df).collect()), key=str)
    near = {1: 4, 2: 4, 12: 4, 13: 4}
    want = []
    for i, _ in rows:
        c = 1 if i in near else 10 if i == 11 else i
        want.append((i, near.get(i, 1 if i in (10, 11) else 0), c, i is not None and i == c))
    assert got == sorted(want, key=str)
    assert range_join.similar(df.limit(0)).count() == 0
