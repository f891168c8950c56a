import numpy as np
import pytest
import xxhash

from gapscore.llm import simhash
from gapscore.llm.components import component_roots
from gapscore.llm.simhash import near_duplicates, without_near_duplicates
from gapscore.llm.work import Scratch

from llm_tables import ROWS


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, radius=4):
    label = list(range(len(fps)))
    changed = True
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return label


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [fingerprint(t) for _, t in rows]
    return sorted(
        ((i, f"{fp:016x}", rows[r][0]) for (i, _), fp, r in zip(rows, fps, roots(fps))), key=repr
    )


def test_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted((tuple(r) for r in near_duplicates(documents).collect()), key=repr) == expected(rows)


def test_awkward_rows(awkward):
    got = sorted((tuple(r) for r in near_duplicates(awkward).collect()), key=repr)
    assert got == expected([(r[0], r[1]) for r in ROWS])
    kept = without_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 8, None}


@pytest.mark.parametrize("group_rows", [4096, 20])
def test_all_links_in_dense_groups(spark, group_rows):
    """Chains and clouds of fingerprints; groups are split or not with the same components."""
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    for _ in range(300):
        flips = rng.choice(64, int(rng.integers(1, 7)), replace=False)
        fps.append(fps[int(rng.integers(len(fps)))] ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(f - (1 << 64) if f >= 1 << 63 else f for f in fps))
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    scratch = Scratch(spark, "test")
    found = {r["node"]: r["root"] for r in component_roots(simhash.links(table, 4, group_rows), scratch).collect()}
    mask = (1 << 64) - 1
    want = roots([f & mask for f in fps])
    assert [found.get(f, f) for f in fps] == [fps[w] for w in want]


def test_links_of_a_cloud_are_not_all_pairs(spark):
    rows = [(sum(1 << b for b in (i, j)),) for i in range(40) for j in range(i)]  # all within 4 bits
    found = simhash.links(spark.createDataFrame(rows, "fp long"))
    assert found.count() <= 5 * len(rows)


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    got = {r["node"]: r["root"] for r in component_roots(links, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 201)}


def test_empty_table(nothing):
    assert near_duplicates(nothing).collect() == [] and without_near_duplicates(nothing).collect() == []
