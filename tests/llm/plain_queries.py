"""The contracts of the queries without SQL, in plain Python."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
import tokenizers

from matchweave.llm.bpe import read_ranks
from tests.llm.plain import components


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def media(rows, texts):
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


_BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _good(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans(rows, texts):
    for r in rows:
        found = [(k, m.start(), m.end()) for k, p in _BASE for m in re.finditer(p, texts[r.doc_id]) if _good(k, m.group())]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in _BASE] == [sum(f[0] == k for f in found) for k, _ in _BASE]
        assert set(said.split(",")) <= set(r.spans.split(","))


def tokens(rows, texts):
    ranks = {t: i for i, t in enumerate(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def packed(rows, texts):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(by) == sorted(texts) and len({r.sequence_id for r in rows}) == len(rows)
    for doc_id, own in by.items():
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            piece = ids[at:at + r.length]
            assert (r.start, r.offset, r.doc_tokens, r.ids_crc32) == (at, 0, len(ids), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)))
            assert r.length & (r.length - 1) == 0 and r.length <= 2048
            at += r.length
        assert at == len(ids)


def near(rows, texts):
    import xxhash
    keys = sorted(texts)
    prints = []
    for k in keys:
        words = [w for w in regex.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[k])) if w]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    values = np.array(prints, np.uint64)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)) if i < j]
    top = components(len(keys), pairs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{p:016x}", keys[t]) for k, p, t in zip(keys, prints, top)}


def vectors(rows, table):
    name = next(f for f in table[0].__fields__ if isinstance(table[0][f], list))
    ids = [r.vec_id for r in table]
    x = np.array([r[name] for r in table], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(close)) if i < j]
    order = np.argsort(ids)
    place = np.empty(len(ids), int)
    place[order] = np.arange(len(ids))
    top = components(len(ids), [(place[i], place[j]) for i, j in pairs])
    links = close.sum(1) - 1
    want = {ids[i]: (int(links[i]), ids[order[top[place[i]]]]) for i in range(len(ids))}
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
