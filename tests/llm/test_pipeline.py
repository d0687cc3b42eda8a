"""The pipeline on the smallest tables, each stage against brute force on its own input."""

import zlib
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from domainsieve.sources.workdir import new_folder, written
from llm_helpers import components, shingles, words
from test_dedup import strip

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "substring dedup", "packing"]
    tables, columns = [docs.collect()], docs.columns
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = written(stage(spark, docs, SF), new_folder(spark, "stage"))
        tables.append(docs.collect())
        assert i == 4 or docs.columns == columns
    start, language, exact, near, substring, packed = tables
    assert {r.doc_id for r in language} == {r.doc_id for r in start if any(c.isalpha() for c in r.text or "")}
    best = {}
    for r in language:
        key = strip(r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert {r.doc_id for r in exact} == {i for _, i in best.values()}
    sets = {r.doc_id: shingles(r.text, 5) for r in exact}
    comp = components(sets, [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
                             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r.doc_id for r in near} == {i for i, c in comp.items() if i == c}
    left = {r.doc_id: r for r in substring}
    seen = set()
    for r in sorted(near, key=lambda r: r.doc_id):
        for line in r.text.split("\n"):
            if len(words(line)) >= 20:
                if line in seen:
                    assert r.doc_id not in left or line not in left[r.doc_id].text.split("\n")
                seen.add(line)
    assert all(r.n_chars == len(r.text) for r in substring)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in substring}
    assert sum(r.length for r in packed) == sum(tokens.values())
    assert {(r.doc_id, r.doc_tokens) for r in packed} == set(tokens.items())


def test_clashing_columns_and_empty_table(spark):
    names = ("lang_pred", "score", "rejected", "kept", "n_removed", "text_kept", "id", "n", "digest", "label", "sha", "h", "i")
    extra = ", ".join(f"{n} string" for n in names)
    d = spark.createDataFrame([(1, "some words to keep", "en", *names), (2, None, None, *names), (3, "some words  to keep", "en", *names)],
                              f"doc_id long, text string, lang string, {extra}")
    for table in (d, d.limit(0)):
        docs = table
        for _, stage in cp.STAGES[:4]:
            docs = written(stage(spark, docs, SF), new_folder(spark, "stage"))
            assert docs.columns == d.columns
        assert [r.score for r in docs.collect()] == ["score"] * (1 if table is d else 0)
        assert zlib.crc32(b"") == 0
