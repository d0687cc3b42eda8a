import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from domainsieve.llm import bpe
from llm_helpers import docs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "  a  b\n\n c\t", "don't  we'LL 'sx", "x" * 3000, "日本語 テキスト é́ \U0001F600", "a\n b", "a \n\nb ",
       "\x1c\x1d a\x1cb", "\x00 nul \x00", "q" * 63 + " " + "z" * 64 + " " + "k" * 65, "　  x", "١٢٣ 12a_b"]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_agrees_with_the_library(reference):
    enc, rng = bpe.encoder(PATH, public_tokenizers.PATTERN), random.Random(5)
    alphabet = " \n\tab'sdé日1_ \x1f​"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    for text, packed in zip(texts, enc.encode(texts)):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == reference.encode_ordinary(text), text
        assert enc.decode(packed) == text.encode()


def test_batch_and_single_merges_agree():
    ranks, rng = bpe.encoder(PATH, public_tokenizers.PATTERN).ranks, random.Random(6)
    units = ["".join(rng.choice("abcdeth é") for _ in range(rng.randrange(1, 32))).encode() for _ in range(400)]
    assert bpe.merge_batch(units, ranks) == [bpe.merge_one(u, ranks) for u in units]


def test_digests(spark, reference):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "Twice, twice"), (3, "Twice, twice")] + list(enumerate(ODD, 10))
    got = bpe.digests(docs(spark, rows), PATH).collect()
    want = []
    for i, text in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.digests(docs(spark, []), PATH).count() == 0


def test_encode_and_decode_keep_other_columns(spark):
    rows = [(1, "Some text, again.", "old", 7), (2, None, "x", None)]
    d = docs(spark, rows, "doc_id long, text string, ids string, `n tokens` int")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(d, PATH), PATH).collect()}
    assert bytes(got[1]["decoded"]) == b"Some text, again." and got[1]["n tokens"] == 7
    assert got[2]["ids"] == [] and bytes(got[2]["decoded"]) == b""


def test_memory_is_bounded_by_bytes(monkeypatch):
    rng = random.Random(5)
    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "REMEMBERED", 50_000)
    texts = [" ".join("".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(rng.choice([2, 5, 3000]))) for _ in range(8))
             for _ in range(40)]
    first = [enc.encode([t])[0] for t in texts]
    assert max(map(len, enc.seen)) <= bpe.LONGEST and enc.size <= 50_000 + 10_000
    assert [enc.decode(p).decode() for p in first] == texts
    assert enc.encode(texts) == first
