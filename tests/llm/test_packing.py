import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from domainsieve.llm import packing
from llm_helpers import docs, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("histogram", [
    {}, {1: 10 ** 9}, {3000: 5, 1: 3}, {2048: 7, 10: 100_000}, {4096: 3}, {1: 5},
    {n: n % 7 + 1 for n in range(1, 4097)}, {n: 10 ** 6 + n for n in range(3, 4096, 5)}])
def test_shortest_pack_first(histogram):
    placed, packs = Counter(), 0
    for count, content in packing.shortest_pack_first(dict(histogram)):
        at, packs = 0, packs + count
        for length, copies, offset in content:
            assert offset == at
            at += length * copies
            placed[length] += count * copies
        assert 0 < at <= 4096 and count > 0
    assert placed == Counter(histogram)
    tokens = sum(k * v for k, v in histogram.items())
    assert packs <= 1.02 * tokens / 4096 + 2 or max(histogram) > 2048


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([1, 3, 40, 40, 700]))) for i in range(120)]
    rows += [(500, prose(rng, 9000)), (501, None), (502, ""), (503, "Ünïcode TEXT, don't! 12"),
             (None, "without an id"), (7, rows[7][1]), (504, "x<|endoftext|>Y")]
    got = packing.pack(docs(spark, rows), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at:at + 4096]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_words_of_letters_and_bounded_memory(monkeypatch):
    """Ids equal the tokenizer's for odd letters; long words and a full memory change nothing."""
    rng = random.Random(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, plain = packing.WordTokenizer(path), Tokenizer.from_file(path)
    odd = ["".join(chr(rng.choice([*range(0xC0, 0x250), *range(97, 123)])) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    odd += ["İstanbul", "straße.", "naïve,", "don't", "x²", "½", "été", "ŉ", "ǅungla", "ﬁn", "1a2", "日本語", "…"]
    odd += ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(3000)) for _ in range(5)]
    texts = [" ".join(rng.choices(odd, k=60)) + rng.choice(["", ".", "\n"]) for _ in range(60)]
    monkeypatch.setattr(packing, "REMEMBERED", 100_000)
    for at in range(0, len(texts), 20):
        part = texts[at:at + 20]
        ids, bounds = tok.encode(pa.array(part))
        want = [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
        # What is kept after a full memory are the short words of the texts at hand.
        assert max(map(len, tok.seen)) <= packing.LONGEST
        assert tok.size <= 100_000 + sum(len(w) * 13 + packing.OVERHEAD for t in part for w in set(t.split()) if len(w) <= 64)


def test_units_are_tokenised_once(monkeypatch):
    """Marks and case make no new words, and a memory of 1 MB holds most of 8000 words over several slices."""
    rng = random.Random(6)
    monkeypatch.setattr(packing, "REMEMBERED", 1 << 20)
    tok = packing.WordTokenizer(PATH)

    class Counted:
        words, t = 0, tok.t

        def encode_batch_fast(self, texts, **more):
            self.words += sum(len(x.split()) for x in texts)
            return self.t.encode_batch_fast(texts, **more)

    tok.t = counted = Counted()
    tok.encode(pa.array(["storm Storm STORM storm, Storm!! (storm) storm-storm 'storm"]))
    # The word, five kinds of marks, and the one word with an apostrophe.
    assert counted.words <= 7
    words = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(8000)]
    texts = [" ".join(words[at:at + 1000]) for at in range(0, 8000, 1000)]
    first = [tok.encode(pa.array([t]))[0].tolist() for t in texts]
    counted.words = 0
    assert [tok.encode(pa.array([t]))[0].tolist() for t in texts] == first
    assert counted.words < 4000


def test_odd_units():
    """Ids equal the tokenizer's where letters, marks, apostrophes, special tokens and other scripts meet."""
    rng = random.Random(7)
    tok, plain = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    parts = [*map(chr, range(1, 0x260)), *"''''||<>IJKST019.,&_-" * 4, "̌", "́", "̇", "K", "日本", "ж", "’", "\x85",
             "\x1c", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "n't", "long" * 9, "&" * 40]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)] + ["", " ", "\n a \t"]
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        ids, bounds = tok.encode(pa.array(part))
        want = [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert max(len(w.encode()) for w in tok.seen) <= packing.LONGEST
