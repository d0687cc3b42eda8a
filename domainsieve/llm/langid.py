"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (one to three bytes, letters lower-cased, all other
ASCII blank), weighted by 1 + log of the count and inverse document frequency, of length one.
Document frequencies cover all learning documents. Centroids are spherical k-means clusters of
a bounded sample of each language. A text gets the language of the centroid with the largest
cosine; one that is far from every centroid is marked as rejected.

What the tasks get to know is bounded by the parameters: an array of DIMENSIONS weights and
CLUSTERS centroids per language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from domainsieve.llm.common import Steps, is_true, released, text_batches, with_fields

DIMENSIONS = 1 << 14
CLUSTERS = 4
# Sampled learning documents per language: those with the smallest hash of the doc_id.
SAMPLE = 400
# A text is rejected below this share of the lowest cosine that is usual for its length.
REJECT_BELOW = 0.5
# Share of sampled texts that may lie lower than usual, and texts that a quantile is taken from.
LOW, ENOUGH = 0.02, 50
# Bytes of one text that are counted at a time.
WINDOW = 1 << 22
ROUNDS = 8
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}").search
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    raw = b" " + text.encode().translate(_KEEP) + b" "
    out = np.zeros(DIMENSIONS, np.float32)
    for at in range(0, len(raw), WINDOW):
        b = np.frombuffer(raw[at:at + WINDOW + 2], np.uint8).astype(np.uint32)
        own = min(WINDOW, len(raw) - at)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F) + np.uint32(7)
        for h in (b[:own] * np.uint32(0x165667B1), two[:own], three[:own]):
            out += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(18), minlength=DIMENSIONS)
    return out


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of count rows."""
    seen = rows > 0
    v = np.zeros_like(rows)
    np.log(rows, out=v, where=seen)
    v += seen
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(norm, 1e-12)[:, None]


def _texts(column: pa.Array, rows: int = 128) -> Iterator[list[str | None]]:
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


@dataclass
class Model:
    """What a learner knows: weights, centroids, their languages, and how near own texts lie.

    usual[l, i] is what nearly all sampled texts of the l-th centroid's language and about 2**i bytes
    reach, see usual_cosines().
    """
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    usual: np.ndarray


def _learning(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return docs.filter((fold != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def frequencies(learning: DataFrame, steps: Steps) -> tuple[np.ndarray, dict[str, int]]:
    """Inverse document frequencies, and the number of learning documents per language."""
    def run(batches):
        released()
        df, n, langs = np.zeros(DIMENSIONS, np.int64), 0, Counter()
        for batch in batches:
            langs.update(batch.column(1).to_pylist())
            for texts in _texts(batch.column(0)):
                for t in texts:
                    df += counts(t) > 0
                    n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([[n, *df.tolist()]], pa.list_(pa.int64())),
             pa.array([list(langs.items())], pa.map_(pa.string(), pa.int64()))], names=["df", "langs"])

    text_batches(learning.sparkSession)
    parts = steps.save(learning.select("text", "lang").mapInArrow(run, "df array<long>, langs map<string,long>"), "counts")
    # DIMENSIONS + 1 rows, and a row per language.
    sums = parts.select(F.posexplode("df").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    langs = parts.select(F.explode("langs").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1)
    for r in sums:
        df[r.i] = r.n
    return (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32), {r.lang: r.n for r in langs}


def _cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; each start is the text farthest from the starts before."""
    mean = v.mean(axis=0)
    at = [int(np.argmax(v @ mean))]
    near = v @ v[at[0]]
    while len(at) < min(k, len(v)):
        at.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[at[-1]])
    c = v[at]
    for _ in range(ROUNDS):
        own = np.argmax(v @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                m = v[own == i].sum(axis=0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    return c


def learn(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Fit on rows whose crc32(doc_id as text) mod 3 is not 1 and whose text and lang are known.

    All such rows count for the document frequencies, at most `sample` per language for the
    centroids. No learning row gives a model without languages.
    """
    learning = _learning(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                                     F.col("lang").cast("string")))
    idf, sizes = frequencies(learning, Steps(docs.sparkSession, "language-id"))
    # The sampled rows lie below a hash bound that about twice as many rows reach; so only those,
    # and not some of every partition, meet in the task of their language.
    place, bound = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), F.lit(0)
    for lang, n in sizes.items():
        reach = min(1 << 30, int((2 * sample + 50) * (1 << 30) / n) + 1)
        bound = F.when(F.col("lang") == lang, F.lit(reach)).otherwise(bound)
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "text")
    picked = learning.filter(place < bound).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf["text"] if _LETTER(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centroids": [], "near": [], "bytes": []})
        v = weighted(np.stack([counts(t) for t in texts]), idf)
        c = _cluster(v, clusters)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centroids": [c.astype("<f4").tobytes()],
                             "near": [(v @ c.T).max(axis=1).astype("<f4").tobytes()],
                             "bytes": [np.array([len(t.encode()) for t in texts], "<i8").tobytes()]})

    rows = sorted(picked.select("lang", "text").groupBy("lang").applyInPandas(
        fit, "lang string, centroids binary, near binary, bytes binary").collect(), key=lambda r: r.lang)
    if not rows:
        return Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros((0, 64)))
    parts = [np.frombuffer(r.centroids, "<f4").reshape(-1, DIMENSIONS) for r in rows]
    near = np.concatenate([np.frombuffer(r.near, "<f4") for r in rows])
    band = np.log2(np.maximum(np.concatenate([np.frombuffer(r.bytes, "<i8") for r in rows]), 1)).astype(int)
    of_text = np.repeat(np.arange(len(rows)), [len(r.near) // 4 for r in rows])
    usual = usual_cosines(near, band, of_text, len(rows))
    return Model(idf, np.concatenate(parts), [r.lang for r, p in zip(rows, parts) for _ in p],
                 np.repeat(usual, [len(p) for p in parts], axis=0))


def usual_cosines(near: np.ndarray, band: np.ndarray, lang: np.ndarray, langs: int) -> np.ndarray:
    """For each language and length band, the cosine that all but LOW of the sampled texts of that
    language and of the bands beside reach; of all languages where those are fewer than ENOUGH. So
    single odd texts do not move it. Where those are still too few, the lowest of more bands."""
    out = np.zeros((langs, 64))
    for i in range(64):
        for k in range(langs):
            some = (np.abs(band - i) <= 1) & (lang == k)
            reach = 1
            while some.sum() < ENOUGH and reach < 64:
                some = np.abs(band - i) <= reach
                reach += 1
            out[k, i] = np.quantile(near[some], LOW if reach <= 2 else 0)
    return out


def predict(docs: DataFrame, model: Model, reject_below: float = REJECT_BELOW,
            names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid) and rejected, or other `names`.

    A text that is null or has no letter is `und`, scored 0 and rejected; so is every text when
    the model knows no language. Of equal cosines the first language by name wins. Columns of
    these names in docs are replaced; all others stay.
    """
    text_batches(docs.sparkSession)
    kept = docs.drop(*names)
    langs, idf, centroids, usual = model.langs, model.idf, model.centroids, model.usual

    def run(batches):
        released()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            found, scores, out = [], [], []
            for texts in _texts(column):
                known = [i for i, t in enumerate(texts) if t is not None and langs and _LETTER(t)]
                lang, score, far = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if known:
                    cos = weighted(np.stack([counts(texts[i]) for i in known]), idf) @ centroids.T
                    best = np.argmax(cos, axis=1)
                    for i, b, row in zip(known, best.tolist(), cos):
                        c = min(1.0, max(0.0, float(row[b])))
                        lang[i], score[i] = langs[b], c
                        far[i] = c < reject_below * usual[b, len(texts[i].encode()).bit_length() - 1]
                found += lang
                scores += score
                out += far
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(out, pa.bool_())], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, with_fields(kept, dict(zip(names, ("string", "double", "boolean")))))


def op8_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = docs.select("doc_id", "text")
    return predict(rows, learn(docs)).select(
        "doc_id", is_true(fold == 1).alias("held_out"), "lang_pred", "score", "rejected")
