import random
import zlib

import numpy as np

from domainsieve.llm import langid
from llm_helpers import docs

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ra"], "bb": ["sch", "ein", "ung", "ße", "ter"], "cc": ["ção", "não", "es", "que"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.choice([5, 30, 300])), lang) for i, lang in enumerate(list(SYLLABLES) * 80)]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "", None), (None, text(rng, "bb", 20), "bb"),
             (1003, "Это совсем другой язык и другая письменность " * 10, None), (5, rows[5][1], "cc")]
    d = docs(spark, [(*r, 3) for r in rows], "doc_id long, text string, lang string, score int")
    model = langid.learn(d, sample=40, clusters=3)
    assert sorted(set(model.langs)) == list(SYLLABLES)
    got = langid.predict(d, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score", "rejected"}
    by = {r.doc_id: r for r in got}
    held = [(i, lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(by[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert not any(by[i].rejected for i, *_ in rows[:240])
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by[1003].rejected and by[1003].lang_pred in SYLLABLES
    named = langid.predict(d, model, names=("a", "b", "c"))
    assert named.columns == [*d.columns, "a", "b", "c"]


def test_hexadecimal_words_and_gibberish_are_rejected(spark):
    """Also where a few sampled texts are mislabelled."""
    rng = random.Random(6)
    junk = (lambda n: " ".join("%08x" % rng.getrandbits(32) for _ in range(n)))
    rows = [(i, text(rng, lang, rng.choice([8, 40, 300])), lang) for i, lang in enumerate(list(SYLLABLES) * 100)]
    rows += [(500 + i, text(rng, list(SYLLABLES)[1], 200), list(SYLLABLES)[0]) for i in range(2)]
    odd = [(900, junk(4)), (901, junk(60)), (902, junk(400)), (903, "zzq xkw vvj qqx " * 5), (904, "wq zx"), (905, "x" * 500)]
    model = langid.learn(docs(spark, rows, "doc_id long, text string, lang string"))
    every = langid.predict(docs(spark, [(i, t, None) for i, t, *_ in rows + odd], "doc_id long, text string, lang string"), model)
    rejected = {r.doc_id for r in every.filter("rejected").collect()}
    assert {900, 901, 902, 903, 904, 905} <= rejected
    assert not rejected & set(range(3 * 100))


def test_no_learning_rows(spark):
    d = docs(spark, [(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.learn(d)
    assert model.langs == []
    assert [(r.lang_pred, r.rejected) for r in langid.predict(d, model).collect()] == [("und", True)]
    empty = d.limit(0)
    assert langid.predict(empty, langid.learn(empty)).count() == 0


def test_counts_of_a_long_text_add_up(monkeypatch):
    whole = langid.counts("Straße und Weg " * 500)
    monkeypatch.setattr(langid, "WINDOW", 97)
    assert np.array_equal(whole, langid.counts("Straße und Weg " * 500))
