"""Near-duplicate embeddings by a forest of random-projection trees.

Every node of a tree splits its rows at the median of a random projection; rows near the
median go to both sides. Rows that meet in a leaf are compared, and trees are many enough that
a pair at the threshold meets in some leaf but for a chance of about 1e-5. Trees are fitted on
bounded samples of a node's rows; all rows are routed. A leaf that has grown too large is split
further in the next round, with its own sample.

Equal vectors are one class with a count. Each pair is looked at in many leaves but counted in
one, the smallest leaf that both share, so what leaves a task is a count per vector and the few
links that join components, never the pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from domainsieve.llm.common import Steps, components, hot_join

TREES = 8
# Rows of a leaf, and of a block where a leaf cannot be split.
LEAF = 1024
# Rows on which the splits of a node are fitted, and levels fitted at a time.
SAMPLE = 8192
LEVELS = 10
# Rows routed in one task.
CHUNK = 1 << 16
# Half width of the overlap, in standard deviations of the projected gap of a pair at the threshold.
SPILL = 0.55
# A side that keeps more than this share of its node does not count as split.
SHRINK = 0.9


@dataclass
class Subtree:
    """Node i has children 2i+1 and 2i+2. A leaf has no cut; `open` leaves may be split further."""
    directions: np.ndarray
    cuts: np.ndarray
    spill: float
    open: np.ndarray


def spill_width(threshold: float, dim: int) -> float:
    return SPILL * math.sqrt(2 * (1 - threshold) / dim)


def fit(v: np.ndarray, rows: float, spill: float, seed: int) -> Subtree:
    """Split a sample of unit vectors that stands for `rows` rows."""
    rng, nodes = np.random.default_rng(seed), 2 ** (LEVELS + 1) - 1
    directions = np.zeros((nodes, v.shape[1]), np.float32)
    cuts, open_ = np.full(nodes, np.nan), np.zeros(nodes, bool)
    scale, todo = rows / max(1, len(v)), [(0, np.arange(len(v)), 0)]
    while todo:
        at, own, level = todo.pop()
        if len(own) * scale <= LEAF or len(own) < 16:
            continue
        if level == LEVELS:
            open_[at] = True
            continue
        d = rng.normal(size=(4, v.shape[1]))
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        x = v[own] @ d.T
        best = int(np.argmax(x.std(axis=0)))
        cut, x = float(np.median(x[:, best])), x[:, best]
        left, right = own[x < cut + spill], own[x >= cut - spill]
        if max(len(left), len(right)) > SHRINK * len(own):
            continue
        directions[at], cuts[at] = d[best], cut
        todo += [(2 * at + 1, left, level + 1), (2 * at + 2, right, level + 1)]
    return Subtree(directions, cuts, spill, open_)


def route(v: np.ndarray, tree: Subtree) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) for every leaf that rows reach."""
    out, todo = [], [(0, np.arange(len(v)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if np.isnan(tree.cuts[at]):
            out.append((at, own))
            continue
        x = v[own] @ tree.directions[at].astype(np.float64)
        todo.append((2 * at + 1, own[x < tree.cuts[at] + tree.spill]))
        todo.append((2 * at + 2, own[x >= tree.cuts[at] - tree.spill]))
    return out


def unit(vectors) -> np.ndarray:
    v = np.stack(list(vectors)).astype(np.float64)
    size = np.abs(v).max(axis=1, keepdims=True)
    # Where a square would over- or underflow, by the largest component first.
    v = np.where((size > 1e100) | (size < 1e-100), v / size, v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _child(node: int, leaf: int) -> int:
    """Identifier of a leaf below a node, as a signed 64-bit integer."""
    h = (node * 0x9E3779B97F4A7C15 + leaf + 1) & (2 ** 64 - 1)
    h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & (2 ** 64 - 1)
    h ^= h >> 32
    return h - 2 ** 64 if h >> 63 else h


def _routed(ids: np.ndarray, v: np.ndarray, node: int, tree: Subtree) -> pd.DataFrame:
    parts = [pd.DataFrame({"id": ids[own], "node": _child(node, leaf), "open": bool(tree.open[leaf])})
             for leaf, own in route(v, tree)]
    return pd.concat(parts) if parts else pd.DataFrame({"id": [], "node": [], "open": []})


def leaves_of(vectors: DataFrame, dim: int, threshold: float, steps: Steps, trees: int = TREES) -> DataFrame:
    """(id, node): the leaves that every vector (id, v) of length `dim` reaches in all trees."""
    total, spill = vectors.count(), spill_width(threshold, dim)
    # At most SAMPLE vectors, those with the smallest hashes.
    share = min(1.0, 1.2 * SAMPLE / max(total, 1))
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = vectors.filter(mark).orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()
    first = [fit(unit(r.v for r in sample), total, spill, t) for t in range(trees)]

    def roots(frames):
        for pdf in frames:
            if len(pdf):
                v, ids = unit(pdf["v"]), pdf["id"].to_numpy()
                for t, tree in enumerate(first):
                    yield _routed(ids, v, t, tree)

    kind = "id long, node long, open boolean"
    done = [steps.save(vectors.select("id", "v").mapInPandas(roots, kind), "routed")]
    while True:
        open_ = done[-1].filter("open").groupBy("node").count().filter(F.col("count") > LEAF)
        open_ = steps.save(open_.select("node", "count", F.ceil(F.col("count") / CHUNK).alias("chunks")), "open-nodes")
        if not open_.limit(1).count():
            break
        rows = done[-1].join(open_, "node").join(vectors, "id")
        sampled = rows.filter(F.pmod(F.xxhash64("id", "node"), F.col("count")) < SAMPLE)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            node = int(pdf["node"].iloc[0])
            t = fit(unit(pdf["v"]), float(pdf["count"].iloc[0]), spill, abs(node))
            return pd.DataFrame({"node": [node], "d": [t.directions.tobytes()], "c": [t.cuts.tobytes()],
                                 "o": [t.open.tobytes()]})

        subtrees = steps.save(sampled.select("node", "count", "v").groupBy("node").applyInPandas(
            grow, "node long, d binary, c binary, o binary").join(open_, "node").select(
            "node", "d", "c", "o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")),
            "subtrees")

        def down(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"id": [], "node": [], "open": []})
            r = right.iloc[0]
            tree = Subtree(np.frombuffer(r["d"], np.float32).reshape(-1, dim), np.frombuffer(r["c"]), spill,
                           np.frombuffer(r["o"], bool))
            return _routed(left["id"].to_numpy(), unit(left["v"]), int(r["node"]), tree)

        placed = rows.select("node", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), "id", "v")
        routed = placed.groupBy("node", "chunk").cogroup(subtrees.groupBy("node", "chunk")).applyInPandas(down, kind)
        kept = done[-1].join(open_.select("node"), "node", "left_anti").select("id", "node", F.lit(False).alias("open"))
        done = [steps.save(routed.unionByName(kept), "routed")]
    return done[-1].select("id", "node")


def _leaf_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts per vector, and links that join components, of one pair of blocks of a leaf."""
    node, i, j = int(pdf["node"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    a = np.flatnonzero((pdf["own"] == i).to_numpy())
    b = a if i == j else np.flatnonzero((pdf["own"] == j).to_numpy())
    v, ids, n = unit(pdf["v"]), pdf["id"].to_numpy(), pdf["n"].to_numpy()
    x, y = np.nonzero(v[a] @ v[b].T >= threshold)
    if i == j:
        x, y = x[x < y], y[x < y]
    x, y = a[x], b[y]
    sets = [frozenset(s.tolist()) for s in pdf["nodes"]]
    mine = np.fromiter((min(sets[p] & sets[q]) == node for p, q in zip(x.tolist(), y.tolist())), bool, len(x))
    x, y = x[mine], y[mine]
    links = np.zeros(len(pdf), np.int64)
    np.add.at(links, x, n[y])
    np.add.at(links, y, n[x])
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while k in up:
            k = up[k]
        return k

    edges = []
    for p, q in zip(x.tolist(), y.tolist()):
        r, s = root(p), root(q)
        if r != s:
            up[max(r, s)] = min(r, s)
            edges.append((ids[p], ids[q]))
    some = np.flatnonzero(links)
    return pd.concat([
        pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), "Int64"), "links": links[some]}),
        pd.DataFrame({"a": [e[0] for e in edges], "b": pd.array([e[1] for e in edges], "Int64"), "links": 0})])


def class_links(classes: DataFrame, dim: int, threshold: float, steps: Steps) -> DataFrame:
    """Rows (a, null, links) and (a, b, 0) of classes (id, v, n), see _leaf_links."""
    leaves = steps.save(leaves_of(classes, dim, threshold, steps), "leaves")
    sizes = leaves.groupBy("node").agg(F.ceil(F.count("*") / LEAF).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), "blocks").alias("own")
    rows = (leaves.join(sizes, "node").select("id", "node", "blocks", own).join(
        leaves.groupBy("id").agg(F.collect_set("node").alias("nodes")).join(classes.select("id", "v", "n"), "id"), "id"))
    pairs = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).select(
        "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v", "n", "nodes")
    return pairs.groupBy("node", "i", "j").applyInPandas(
        lambda pdf: _leaf_links(pdf, threshold), "a long, b long, links long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per vector (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs of rows with cosine >= threshold in double precision. A vector that is null
    or zero, or holds null or non-finite components, links with nothing, and so does a row
    without a vec_id, whose component is null. Vectors of different lengths do not link.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "rp-forest")
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & fine & F.exists(v, lambda x: x != 0.0), F.lit(False))
    rows = steps.save(rows.withColumn("usable", usable).withColumn(
        "key", F.when(F.col("usable"), F.sha2(F.array_join(v, ","), 256))), "vectors")
    linked = rows.filter("usable")
    classes = steps.save(linked.groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    found = None
    # One length in practice; each is a forest of its own.
    for r in classes.select(F.size("v").alias("dim")).distinct().collect():
        part = class_links(classes.filter(F.size("v") == r.dim), r.dim, threshold, steps)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    found = steps.save(found, "links")
    labels = components(found.filter("b IS NOT NULL").select("a", "b"), steps)
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    of_class = steps.save(classes.join(counts, "id", "left").join(labels, "id", "left").select(
        "key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("label", "id").alias("component_id")), "components")
    joined = hot_join(linked.select("vec_id", "key"), of_class, "key", "n", linked.count()).select(
        "vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_rp_forest(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
