"""Byte-level BPE and packing against the public libraries."""

import json
import pickle
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchweave.llm import bpe, chunks, packing
from matchweave.llm.perfect_hash import PerfectHash, hashes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a ", " a", "a  b", "a \n b", "it's we'RE", "<|endoftext|> x", "\x1c \x85 　x", "世界 \U0001f642\U0001f642",
       "x" * 5000, "été " * 50, "\n\n \t a", "1 23 456"]


def random_texts(n=3000):
    rnd, letters = random.Random(5), " \n\t'sdtrelmv1abé¼²٣　\x85\x1c.,世\U0001f642"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal(codec):
    slots = codec.hash.slots(hashes(codec.tokens))
    assert sorted(slots) == list(range(len(codec.tokens)))
    for n in (0, 1, 2, 7):
        keys = [str(i).encode() for i in range(n)]
        assert sorted(PerfectHash(keys).slots(hashes(keys))) == list(range(n))
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


def test_merges_equal_the_public_encoder(codec):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(codec.tokens)})
    texts = ODD + random_texts()
    got = chunks.encode(pa.array(texts), codec.encode_chunks)
    for text, ids in zip(texts, got):
        assert ids.tolist() == plain.encode_ordinary(text), repr(text)
        assert codec.decode(ids.tolist()) == text.encode()
    for token in codec.tokens[:2000]:
        assert codec.merge(token) == [codec.rank[token]]


def test_memo_keeps_lately_used():
    memo = chunks.Memo(2)
    for k in "abcd":
        memo.put(k, k.encode())
    assert memo.find(["a", "c", "d"])[1:] == [b"c", b"d"] and len(memo.young) <= 2


def test_encode_and_decode_documents(spark):
    texts = [None, *ODD, "x y"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, "  ", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    coded = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids", "n_tokens"]
    for r in bpe.decode_documents(coded, RANKS).collect():
        assert bytes(r.decoded) == (r.text or "").encode() and len(r.ids) == 4 * r.n_tokens
    assert bpe.encode_documents(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_of_lengths():
    for n in range(1, 5000, 7):
        cuts = packing.pieces_of(n, 2048)
        assert sum(cuts) == n and all(c & (c - 1) == 0 and c <= 2048 for c in cuts)
        assert len(cuts) == n // 2048 + bin(n % 2048).count("1")


def test_pack_holds_each_id_once(spark, tmp_path):
    library = Tokenizer.from_file(FILE)
    texts = [None, *ODD, "word " * 6000, "a  <|endoftext|><|endoftext|>  b <|endoftext|", *random_texts(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (1, "", 1)],
                               "doc_id long, text string, start long")
    packed = packing.pack(df, FILE)
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(len(r.ids) == 4 * r.length and r.length == 1 << r.bucket <= 2048 for r in rows)
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        own = own[:1] if i == 1 else own  # the repeated row is packed twice
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == want
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert {r.doc_tokens for r in own} == {len(want)}
    packing.write_buckets(packed, str(tmp_path / "packed"))
    again = spark.read.parquet(str(tmp_path / "packed"))
    assert again.where("length != shiftleft(1, bucket)").count() == 0 and again.count() == len(rows)
    assert packing.pack(df.limit(0), FILE).count() == 0


def test_long_white_space_equals_the_library():
    library, own = Tokenizer.from_file(FILE), packing.Encoder(open(FILE, encoding="utf-8").read())
    own = pickle.loads(pickle.dumps(own))
    assert own.by_chunks
    n = 3_000_000
    for text in (" " * n, "\n" * n, "a" + " " * n + "b", "a" + "\n" * n + "b", "it's" + " \n" * (n // 2) + "\u3000'll",
                 " " * 200_000 + "<|endoftext|>" + "\n" * 200_000 + "\x1c" + "\xa0" * 99_999 + "  .", " " * 99_999 + "x" + " " * 100_000 + "x"):
        assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_of_another_kind_get_whole_texts():
    described = json.loads(open(FILE, encoding="utf-8").read())
    described["normalizer"] = {"type": "Lowercase"}
    own = packing.Encoder(json.dumps(described))
    assert not own.by_chunks
    texts = ["A b  C", None, "x <|endoftext|> Y"]
    library = Tokenizer.from_str(json.dumps(described))
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_sequences_are_numbered_by_bucket(spark):
    df = spark.createDataFrame([(i, "word " * (i * 37 % 3000)) for i in range(60)] + [(None, "no id"), (3, "word " * 111)], "doc_id long, text string")
    pieces = packing.pack(df.repartition(7), FILE).drop("ids").withColumn("total", F.lit("mine"))
    rows = sorted(packing.number(pieces.drop("total")).collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in rows] == list(range(len(rows))) and len(rows) == pieces.count()
    key = [(r.bucket, r.doc_id is not None, r.doc_id or 0, r.start) for r in rows]
    assert key == sorted(key)
    again = packing.number(packing.pack(df.repartition(3), FILE).drop("ids"))
    assert [tuple(r[c] for c in ("doc_id", "start", "length", "bucket")) for r in sorted(again.collect(), key=lambda r: r.sequence_id)] == [
        tuple(r[c] for c in ("doc_id", "start", "length", "bucket")) for r in rows]


def test_memo_is_bounded_by_bytes():
    """Text without spaces is one chunk: 50,000 such texts leave next to nothing behind."""
    memo = chunks.Memo(1 << 20)
    for i in range(50_000):
        memo.put(f"{i:05d}" * (1600 if i % 2 else 30), b"ids " * 40)
    held = sum(len(k) + len(v) for part in (memo.young, memo.old) for k, v in part.items())
    assert held <= 2 << 20 and max(map(len, memo.young)) <= memo.longest
