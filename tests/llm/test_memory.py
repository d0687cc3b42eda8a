import random
import subprocess
import sys
from collections import defaultdict

import pytest

from domainsieve.llm import common, minhash
from domainsieve.llm.common import Steps

WORKER = """
import glob, re, sys
import numpy as np
sys.path.insert(0, sys.argv[1])
from domainsieve.llm import common, minhash, packing, shingles
import public_tokenizers
def mb():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
tok = packing.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
for x in tok.slots():
    x[:] = 1
small = [np.ones(10_000) for _ in range(500)]
last = np.ones(10_000)
del tok, small
before = mb()
common.released("shingles")
print(before - mb(), packing.word_tokenizer.cache_info().currsize)
minhash.permutations(60), shingles._kept_powers()
common.released("shingles")
print(minhash.permutations.cache_info().currsize, shingles._kept_powers.cache_info().currsize)
common.released()
print(minhash.permutations.cache_info().currsize, shingles._kept_powers.cache_info().currsize)
"""


def test_a_worker_gives_back_what_other_tasks_have_kept():
    """32 MB of units and 40 MB of freed small arrays go back to the system; a task's own tables stay."""
    root = common.__file__.rsplit("/domainsieve/", 1)[0]
    out = subprocess.run([sys.executable, "-c", WORKER, root], capture_output=True, text=True, timeout=120)
    assert not out.returncode, out.stderr
    first, second, third = out.stdout.splitlines()
    assert float(first.split()[0]) > 60 and first.split()[1] == "0"
    assert second == "1 1"
    assert third == "0 0"


@pytest.mark.parametrize("task_keys", [1 << 18, 500])
def test_bucket_members_in_tasks_of_bounded_keys(spark, monkeypatch, task_keys):
    """Many keys go to more tasks than the session's four; the members are the same."""
    monkeypatch.setattr(minhash, "TASK_KEYS", task_keys)
    monkeypatch.setattr(minhash, "SLOT_KEYS", min(minhash.SLOT_KEYS, task_keys // 8))
    rng = random.Random(8)
    rows = [(i, [rng.randrange(300) * 2 ** 44 - 2 ** 50 for _ in range(36)]) for i in range(150)]
    got = minhash.bucket_members(spark.createDataFrame(rows, "id long, bands array<long>").repartition(3),
                                 len(rows), Steps(spark, "members"))
    buckets = defaultdict(list)
    for i, keys in rows:
        for k in keys:
            buckets[k].append(i)
    want = [(k, i, min(ids), len(ids)) for k, ids in buckets.items() if len(ids) > 1 for i in ids]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if task_keys == 500:
        assert len(got.inputFiles()) > 4
