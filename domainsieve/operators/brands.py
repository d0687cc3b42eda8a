"""Brand names: deriving them from a ranked list, and finding look-alikes.

The similarity join is exact without comparing every name with every brand.
Two keyed, broadcast hash joins produce the pairs to check:

* a brand inside a candidate must start somewhere in it, so the first characters
  of the brand equal the characters at some position of the candidate;
* for a brand of L characters, at most L·(1−m)/m edits can keep the similarity at
  m. Cut the brand into one piece more than that: one piece stays untouched, and
  edits move it only a little, so it is met at a known few positions.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.fixed import LEET_FROM, LEET_TO, SEED_BRANDS
from domainsieve.functions.literals import literal_table
from domainsieve.functions.names import explode_if
from domainsieve.operators.names import TailIndex, with_host_labels
from domainsieve.params import DEFAULTS, Params

CONTAINS_CONFIDENCE = 0.85  # fixed value: lowest confidence of a brand inside a name
SMALL_BRANDS = 20_000       # brands up to which the table is broadcast
_PREFIX = 5                 # characters of a brand used as its containment key
_START = 0                  # tag of such a key; pieces are tagged size * _PIECES + number
_PIECES = 1024
_TABLE_LENGTH = 255         # candidate lengths with a row in the table of places


def brand_label(brand: Column) -> Column:
    """Title case of a token: each run of letters capitalised."""
    runs = F.regexp_extract_all(brand, F.lit(r"([a-z]+|[^a-z]+)"))
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


def top_ranked(popular: DataFrame, max_rank: int) -> DataFrame:
    """Names with a rank up to max_rank."""
    return popular.filter(F.col("rank") <= max_rank)


def seed_brands(spark, seed=SEED_BRANDS) -> DataFrame:
    rows = [(b, apex, i) for i, (b, apex) in enumerate(seed)]
    return literal_table(spark, rows, "brand string, official_apex string, position int")


def brand_map(popular: DataFrame, index: TailIndex, extra: DataFrame,
              params: Params = DEFAULTS) -> DataFrame:
    """(brand, official_apex, brand_order) from a ranked list and a seed.

    The best rank wins a shared token. A seed row replaces the official name of a
    token it shares and otherwise comes after all ranked tokens.
    """
    top = top_ranked(popular, params.brand_max_rank)
    ranked = (with_host_labels(top, index)
              .filter(F.length("host_label") >= params.brand_min_len)
              .groupBy(F.col("host_label").alias("brand"))
              .agg(F.min(F.struct("rank", F.col("domain").alias("apex"))).alias("best")))
    seed = extra.select("brand", F.col("official_apex").alias("seed_apex"), "position")
    return (ranked.join(seed, "brand", "full_outer")
            .select("brand",
                    F.coalesce("seed_apex", "best.apex").alias("official_apex"),
                    F.coalesce(F.col("best.rank"),
                               F.col("position") + params.brand_max_rank + 1)
                    .cast("int").alias("brand_order")))


@dataclass(frozen=True)
class BrandIndex:
    """Brands with what the joins need to know about them."""

    table: DataFrame      # brand, official_apex, brand_order, brand_label, size
    lengths: tuple        # distinct token lengths
    small: bool           # few enough to broadcast


def brand_index(brands: DataFrame) -> BrandIndex:
    """Measure a brand table, once. Up to SMALL_BRANDS rows it becomes a literal table,
    so that the plans that use it do not derive it again."""
    brands = brands.select("brand", "official_apex", "brand_order")
    rows = brands.limit(SMALL_BRANDS + 1).collect()
    small = len(rows) <= SMALL_BRANDS
    if small:
        lengths = {len(r["brand"]) for r in rows}
        brands = literal_table(brands.sparkSession, [tuple(r) for r in rows], brands.schema)
    else:
        lengths = {r[0] for r in brands.select(F.length("brand")).distinct().collect()}
    table = brands.withColumns({"brand_label": brand_label(F.col("brand")),
                                "size": F.length("brand")})
    return BrandIndex(table, tuple(sorted(lengths)), small)


def official_brand_join(d: DataFrame, brands: BrandIndex) -> DataFrame:
    """Add `official` (brand, brand_label) where the apex is a brand's own."""
    table = brands.table.coalesce(1) if brands.small else brands.table
    own = table.groupBy(F.col("official_apex").alias("_apex")).agg(
        F.min_by(F.struct("brand", "brand_label"), F.struct("brand_order", "brand"))
        .alias("official"))
    own = F.broadcast(own) if brands.small else own
    return d.join(own, F.col("apex") == F.col("_apex"), "left").drop("_apex")


def brand_candidates(d: DataFrame) -> DataFrame:
    """Strings of a name to compare with brands, in order.

    For the host label, then the ICANN label if it differs: the label without
    hyphens, that with digits decoded, each hyphen part, each part decoded.
    """
    def entry(text, leet, part):
        return F.struct(text.alias("candidate"), F.lit(leet).alias("via_leet"),
                        F.lit(part).alias("via_part"))

    def decoded(c):
        return F.translate(c, LEET_FROM, LEET_TO)

    def of(label):
        base = F.replace(label, F.lit("-"), F.lit(""))
        parts = F.filter(F.split(label, "-"), lambda x: (x != "") & (x != base))
        whole = F.array(entry(base, False, False),
                        F.when(decoded(base) != base, entry(decoded(base), True, False)))
        pieces = F.flatten(F.transform(parts, lambda x: F.array(
            entry(x, False, True), F.when(decoded(x) != x, entry(decoded(x), True, True)))))
        return F.concat(whole, pieces)

    host, icann = F.col("host_label"), F.col("icann_label")
    nothing = F.array().cast("array<struct<candidate:string,via_leet:boolean,via_part:boolean>>")
    entries = F.array_compact(F.concat(of(host), F.when(icann != host, of(icann)).otherwise(nothing)))
    return (d.select("domain", F.posexplode(entries).alias("candidate_order", "_c"))
            .select("domain", "candidate_order", "_c.*"))


def _edits_allowed(length: int, match: float) -> int:
    """Most edits with which some string can still match a brand of this length."""
    return floor(length * (1 - match) / match + 1e-9)


def _pieces(length: int, edits: int) -> list[tuple[int, int]]:
    cuts = [i * length // (edits + 1) for i in range(edits + 2)]
    return list(zip(cuts, cuts[1:]))


def _near_probes(lengths, match: float) -> dict[int, list[tuple]]:
    """For each candidate length, where to look for the pieces of brands of each length."""
    found = defaultdict(list)
    for size in lengths:
        edits = _edits_allowed(size, match)
        for n in range(max(size - edits, 1), size + edits + 1):
            gap = n - size
            if 1 - abs(gap) / max(n, size) < match:
                continue
            for i, (start, end) in enumerate(_pieces(size, edits)):
                # At most i edits left of the piece and the rest right of it.
                low, high = max(-i, gap - (edits - i)), min(i, gap + (edits - i))
                for at in range(start + low, start + high + 1):
                    if 0 <= at <= n - (end - start):
                        found[n].append((size * _PIECES + i, at + 1, end - start))
    return found


def _brand_keys(brands: BrandIndex, match: float) -> DataFrame:
    """One row per brand and key (tag, text): its pieces, and its first characters."""
    size = F.col("size")
    edits = F.floor(size * (1 - match) / match + 1e-9).cast("int")

    def piece(i):
        start = F.floor(i * size / (edits + 1)).cast("int")
        end = F.floor((i + 1) * size / (edits + 1)).cast("int")
        return F.struct((size * _PIECES + i).alias("tag"),
                        F.substring(F.col("brand"), start + 1, end - start).alias("text"))

    pieces = F.transform(F.sequence(F.lit(0), edits), piece)
    start = F.struct(F.lit(_START).alias("tag"), F.substring("brand", 1, _PREFIX).alias("text"))
    keyed = brands.table.drop("official_apex").withColumn(
        "_k", F.explode(F.concat(pieces, F.array(start)))).select("*", "_k.*").drop("_k")
    return F.broadcast(keyed) if brands.small else keyed


def _candidate_keys(candidates: DataFrame, brands: BrandIndex, match: float) -> DataFrame:
    """Candidates, one row per key under which a matching brand is found.

    Which parts of a candidate to look up depends on its length alone, so the
    places come from a literal table with a row per length.
    """
    spark, size = candidates.sparkSession, F.length("candidate")
    widths = sorted({min(n, _PREFIX) for n in brands.lengths})
    near = _near_probes(brands.lengths, match)
    rows = [(n, [dict(zip(("tag", "at", "width"), p)) for p in near.get(n, []) + [
        (_START, at, w) for w in widths if n > w for at in range(1, n - w + 2)]])
        for n in range(1, max([_TABLE_LENGTH, *near]) + 1)]
    kind = "array<struct<tag: int, at: int, width: int>>"
    places = F.broadcast(literal_table(spark, rows, f"_n int, _places {kind}"))
    # Longer than any DNS name: the places of the first characters, computed per row.
    longer = F.flatten(F.array(*[F.transform(
        F.sequence(F.lit(1), size), lambda at, w=w: F.struct(
            F.lit(_START).alias("tag"), at.cast("int").alias("at"), F.lit(w).alias("width")))
        for w in widths])) if widths else F.array().cast(kind)
    places_of = F.coalesce("_places", F.when(size > 0, longer))
    return (candidates.join(places, size == F.col("_n"), "left")
            .withColumn("_p", F.explode(places_of))
            .withColumns({"tag": F.col("_p.tag"), "text": F.substring(
                F.col("candidate"), F.col("_p.at"), F.col("_p.width"))})
            .drop("_n", "_places", "_p"))


def brand_similarity_join(candidates: DataFrame, brands: BrandIndex,
                          params: Params = DEFAULTS) -> DataFrame:
    """Best brand per name: contained in a candidate, or within the edit limit.

    One row per matching name: brand, brand_label, confidence, edit_distance, match_type.
    """
    match = params.brand_match
    if match <= 0.5:
        raise ValueError("brand_match must be above 0.5")
    text, brand = F.col("candidate"), F.col("brand")
    gap = F.length(text) - F.col("size")
    longer = F.greatest(F.length(text), F.col("size"))
    pairs = (_candidate_keys(candidates, brands, match)
             .join(_brand_keys(brands, match), ["tag", "text"])
             .withColumn("inside", F.contains(text, brand) & (gap > 0))
             .filter(F.col("inside") | (1 - F.abs(gap) / longer >= match)))
    # A brand inside a candidate is as many edits away as the candidate is longer. For others
    # the distance is computed once, and only up to the limit.
    limit = F.floor(longer * (1 - match) + 1e-9).cast("int")
    distance = F.when(F.col("inside"), gap).otherwise(
        F.call_function("levenshtein", text, brand, limit))
    pairs = pairs.withColumn("edit_distance", explode_if(distance, lambda x: F.col("inside") | (
        (x >= 0) & (1.0 - x / longer >= match))))
    similarity = 1.0 - F.col("edit_distance") / longer
    confidence = F.when(F.col("inside"), F.greatest(similarity, F.lit(CONTAINS_CONFIDENCE))
                        ).otherwise(similarity)
    kind = (F.when(F.col("via_leet"), "leet").when(F.col("via_part"), "embedded")
            .when(F.col("edit_distance") == 0, "exact")
            .when(F.col("inside"), "contains").otherwise("fuzzy"))
    best = F.min_by(
        F.struct("brand", "brand_label", "confidence", "edit_distance", kind.alias("match_type")),
        F.struct(-F.col("confidence"), "brand_order", "brand", "candidate_order"))
    return (pairs.withColumn("confidence", confidence)
            .groupBy("domain").agg(best.alias("_best")).select("domain", "_best.*"))


def with_brand_match(d: DataFrame, brands: BrandIndex, params: Params = DEFAULTS,
                     only: Column | None = None) -> DataFrame:
    """Add struct `brand` to distinct names: official, else best similar brand, else nulls.

    `only` limits the similarity search to some rows.
    """
    d = official_brand_join(d, brands)
    open_names = d.filter(F.col("official").isNull())
    if only is not None:
        open_names = open_names.filter(only)
    similar = brand_similarity_join(brand_candidates(open_names), brands, params).select(
        "domain", F.struct("brand", "brand_label", "confidence", "edit_distance",
                           "match_type").alias("_similar"))
    own = F.struct("official.brand", "official.brand_label", F.lit(1.0).alias("confidence"),
                   F.lit(0).alias("edit_distance"), F.lit("official").alias("match_type"))
    none = F.struct(F.lit(None).cast("string").alias("brand"),
                    F.lit(None).cast("string").alias("brand_label"),
                    F.lit(0.0).alias("confidence"), F.lit(None).cast("int").alias("edit_distance"),
                    F.lit(None).cast("string").alias("match_type"))
    return (d.join(similar, "domain", "left")
            .withColumn("brand", F.when(F.col("official").isNotNull(), own)
                        .otherwise(F.coalesce("_similar", none)))
            .drop("official", "_similar"))
