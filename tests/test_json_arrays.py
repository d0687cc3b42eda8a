"""JSON arrays cut into many splits, against the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from domainsieve.sources import json_arrays
from domainsieve.sources.json_files import read_json_feed


@pytest.fixture()
def splits_of(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        for k in old:
            spark.conf.set(k, f"{size}b")
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def nasty(rng):
    """Strings with brackets, quotes, commas, escapes and the character that files are cut at."""
    return "".join(rng.choice(['}', '{', '[', ']', '"', '\\', ',', ':', 'é', '\n', 'a', ' ', '}}', '\\"', '😀'])
                   for _ in range(rng.randrange(12)))


def value(rng, deep=2):
    kind = rng.randrange(7 if deep else 4)
    if kind < 2:
        return nasty(rng)
    if kind == 2:
        return rng.choice([None, True, False, 7, -1.5])
    if kind == 3:
        return {}
    if kind == 4:
        return [value(rng, deep - 1) for _ in range(rng.randrange(4))]
    return {nasty(rng): value(rng, deep - 1) for _ in range(rng.randrange(4))}


def elements(spark, path):
    return sorted(json.dumps(json.loads(r["element"]), sort_keys=True) for r in json_arrays.read_elements(spark, str(path)).collect())


def whole(*texts):
    out = []
    for t in texts:
        try:
            parsed = json.loads(t.lstrip("﻿"))
        except ValueError:
            continue
        out += parsed if isinstance(parsed, list) else []
    return sorted(json.dumps(e, sort_keys=True) for e in out)


@pytest.mark.parametrize("size", [64, 1000])
def test_equal_to_the_json_module(spark, tmp_path, splits_of, size):
    rng, texts = random.Random(size), []
    for i in range(12):
        array = [value(rng) for _ in range(rng.choice([0, 1, 2, 30]))]
        text = json.dumps(array, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        texts.append(rng.choice(["", " \n", "﻿"]) + text + rng.choice(["", "\n ", "\n"]))
    texts += ["", "  ", "[]", "[ ]", "5", '"["', '{"a": [1, 2]}', "[1, 2", "[1, 2] x", "[1,,2]", "[1, 2,]", "[1] [2]",
              '[{"a": 1}, {"b"}]', '[{"a": 1}}', ',[1]', '["a]', "[[1], [2, {}]]", '[{"url": "x"}]\n[{"url": "y"}]']
    for i, t in enumerate(texts):
        (tmp_path / f"{i:02d}.json").write_text(t, encoding="utf-8")
    splits_of(size)
    assert elements(spark, tmp_path) == whole(*texts)


def test_one_array_is_read_by_several_tasks(spark, tmp_path, splits_of):
    rng = random.Random(9)
    items = [{"id": i, "note": nasty(rng), "url": f"http://n{i}.example.com/{{x}}", "more": {"url": "http://no.example.org/"}}
             for i in range(3000)]
    (tmp_path / "feed.json").write_text(json.dumps(items))
    splits_of(20_000)
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
    used = pieces.groupBy(F.spark_partition_id()).count().collect()
    assert len(used) >= 10 and max(r["count"] for r in used) < 3 * min(sorted(r["count"] for r in used)[1:])
    got = [r["domain"] for r in read_json_feed(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(f"n{i}.example.com" for i in range(3000))
    parts = json_arrays.read_elements(spark, str(tmp_path))
    assert parts.count() == 3000


def test_no_files_of_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    assert read_json_feed(spark, str(tmp_path)).count() == 0
