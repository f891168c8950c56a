import re
from collections import Counter

import pytest

from gapscore.llm import mixing
from gapscore.llm.mixing import mixed_documents, mixed_words, source_targets

from llm_tables import ROWS

SIZES = "source string, source_size long, rows long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def fill(sizes, weights):
    """Targets by the rule itself: share by weight, stop at three times the size, share the excess again."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        shares = {i: left * weights[i] / total for i in open_}
        left = 0.0
        for i, share in shares.items():
            target[i] += share
            if target[i] >= 3 * sizes[i]:
                left += target[i] - 3 * sizes[i]
                target[i] = 3.0 * sizes[i]
                open_.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[100, 1, 50, 0, 7], [5, 5, 5, 5], [1, 1, 1000], [0, 0]])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], SIZES)
    got = [r["target"] for r in source_targets(table).orderBy("source_rank").collect()]
    assert got == pytest.approx(fill(sizes, [i % 3 + 1 for i in range(len(sizes))]))


def test_documents_are_taken_near_their_targets(documents):
    rows = mixed_words(documents).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    taken, target = Counter(), {}
    for r, source in zip(sorted(rows), [d["source"] for d in sorted(documents.select("doc_id", "source").collect())]):
        taken[source] += r["taken"]
        target[source] = r["target"]
    assert all(abs(taken[s] - t) <= 3 * mixing.BLOCK_WORDS for s, t in target.items())
    assert sorted(rows) == sorted(mixed_words(documents).collect())


def three_sources(spark):
    rows = [("a", 100_000, 9), ("b", 7000, 2), ("c", 300_000, 40)]
    return source_targets(spark.createDataFrame(rows, SIZES)).cache()


def test_every_slot_has_one_block(spark):
    targets = three_sources(spark)
    rows = spark.createDataFrame([(1, 0, 100_000), (2, 0, 7000), (3, 0, 300_000)], "source_rank long, start long, size long")
    mixed = mixing.mix(rows, targets).collect()
    blocks = Counter((s["source_rank"], s["block"]) for s in mixed)
    for t in targets.collect():
        times = [blocks[(t["source_rank"], b)] for b in range(t["blocks"])]
        assert sum(times) == t["draws"] and max(times) - min(times) <= 1
    assert len({(s["source_rank"], s["draw"]) for s in mixed}) == len(mixed)


def test_counts_of_shards_are_multinomial(spark):
    """Given the draws of the sources, their counts in the shards scatter as independent draws would."""
    targets = three_sources(spark)
    counts = mixing.shard_counts(mixing.slots(targets)).collect()
    draws = {t["source_rank"]: t["draws"] for t in targets.collect()}
    shards = -(-sum(draws.values()) // mixing.SHARD_SLOTS)
    for rank, n in draws.items():
        own = {c["shard"]: c["slots"] for c in counts if c["source_rank"] == rank}
        assert sum(own.values()) == n and set(own) <= set(range(shards))
        deviation = sum((own.get(k, 0) - n / shards) ** 2 / (n / shards) for k in range(shards))
        assert deviation < shards + 6 * (2 * shards) ** 0.5
    assert sorted(counts) == sorted(mixing.shard_counts(mixing.slots(targets)).collect())


def test_permutations_have_no_runs(spark):
    rows = mixing.permuted_blocks(three_sources(spark)).collect()
    for rank in (1, 2, 3):
        own = [r["block"] for r in sorted((r for r in rows if r["source_rank"] == rank), key=lambda r: r["index"])]
        assert sorted(own) == list(range(len(own)))
        steps = Counter((b - a) % len(own) for a, b in zip(own, own[1:]))
        assert max(steps.values()) < 8


def test_slots_and_blocks_come_from_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    monkeypatch.setattr(mixing, "CHUNKS_PER_TASK", 4)
    targets = three_sources(spark)
    for table in (mixing.slots(targets), mixing.permuted_blocks(targets).select("block")):
        assert table.count() == sum(t["draws"] if "shard" in table.columns else t["blocks"] for t in targets.collect())
    assert mixing.slots(targets).rdd.getNumPartitions() > 20


def test_null_and_repeated_ids_are_spread(spark):
    rows = [(None, f"text {i} " * (i % 7), "a") for i in range(300)] + [(5, "same words here", "a")] * 40 + [(5, f"{i} other", "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    first = sorted(mixed_words(docs).collect(), key=repr)
    assert first == sorted(mixed_words(docs.repartition(3)).collect(), key=repr)
    assert len(first) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in first)
    assert all((r["first_shard"] is None) == (r["taken"] == 0) for r in first)


def test_mixed_texts_hold_the_words_taken(documents):
    out = mixed_documents(documents)
    assert out.columns == documents.columns
    words, taken = Counter(), {r["doc_id"]: r["taken"] for r in mixed_words(documents).collect()}
    for r in out.collect():
        words[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_whole_documents_keep_their_white_space(spark):
    docs = spark.createDataFrame([(1, "  two\n\nwords ", "a")], "doc_id long, text string, source string")
    assert {r["text"] for r in mixed_documents(docs).collect()} == {"  two\n\nwords "}


def test_awkward_rows(awkward):
    rows = mixed_words(awkward).collect()
    assert sorted(((r["doc_id"] or -1), r["size"]) for r in rows) == sorted(((r[0] or -1), size(r[1])) for r in ROWS)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert set(mixed_documents(awkward).columns) == set(awkward.columns)
    assert sum(size(r["text"]) for r in mixed_documents(awkward).collect()) == sum(r["taken"] for r in rows)


def test_empty_tables(spark, nothing):
    assert mixed_words(nothing).collect() == [] and mixed_documents(nothing).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(r["taken"] for r in mixed_words(blank).collect()) == [0, 0]
