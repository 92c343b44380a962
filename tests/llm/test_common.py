"""Shared folders, and hashes of spans."""

from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from sigloom.llm import common as C
from sigloom.llm import registry

SF = "/root/testdata/sf0.001"


def held(spark):
    return set(C.names(spark, spark.conf.get("spark.checkpoint.dir")))


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op3_token_counts", "op7_line_dedup", "op8_decontamination", "op9_suffix_dedup", "pipeline"])
def test_only_results_stay_in_the_shared_folder(spark, name):
    before = held(spark)
    got = (corpus_pipeline.run if name == "pipeline" else registry.queries()[name])(spark, SF)
    assert got.count() > 0 and len(held(spark) - before) == 1


def test_a_failure_leaves_nothing(spark):
    before = held(spark)

    def make():
        C.materialise(spark.range(3), "x")
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        C.finished(spark, make, "y")
    assert held(spark) == before and not C._on_the_way


def test_span_hash_of_thue_morse_strings():
    """Strings on which sums of powers modulo 2 ** 64 collide whatever the base."""
    t = np.array([bin(i).count("1") % 2 for i in range(1 << 13)], np.uint8)
    a, b = t + 97, (1 - t) + 97
    hashes = [C.span_hash(C.prefix_hash(x), np.array([0]), np.array([len(x)]))[0] for x in (a, b)]
    assert hashes[0] != hashes[1]
    sums = [C.prefix_hash(x)[-1] for x in (a, b)]
    assert sums[0] == sums[1]  # what the blocks are for


def test_span_hash_does_not_depend_on_the_place():
    r = np.random.default_rng(0)
    raw = r.integers(0, 256, 5000).astype(np.uint8)
    twice = np.concatenate([raw, r.integers(0, 256, 77).astype(np.uint8), raw])
    for n in (1, 255, 256, 257, 1000, 5000):
        one, two = C.span_hash(C.prefix_hash(twice), np.array([0, 5077]), np.array([n, 5077 + n]))
        assert one == two


def test_a_finished_task_holds_no_memory():
    """Blocks below glibc's mmap threshold stay with the process once freed, if one that is in use lies above them."""
    script = """
import psutil
from sigloom.llm import common as C

def work(batches):
    held = [bytes(60_000) for _ in range(5_000)]
    above.append(bytes(60_000))
    yield len(held)

above, me = [], psutil.Process()
list(C.freed(work)(iter([])))
before = me.memory_info().rss
list(C.freed(work)(iter([])))
print(before >> 20, me.memory_info().rss >> 20)
"""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert max(map(int, out.stdout.split())) < 250, out.stdout
