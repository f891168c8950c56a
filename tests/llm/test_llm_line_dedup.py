from hashlib import md5

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import line_dedup as stage
from gapscore.llm import line_dedup
from gapscore.llm.line_dedup import without_repeated_chunks, without_repeated_passages


def chunks(text):
    lines = (text or "").split("\n")
    hashes = [int(md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    zero = [(h + line_dedup.BASE * (hashes[i - 1] if i else 0)) % line_dedup.DIVISOR == 0 for i, h in enumerate(hashes)]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (i and zero[i] and not zero[i - 1]):
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def expected(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        kept = []
        for chunk in chunks(text):
            body = "\n".join(chunk)
            if sum(x.strip(" ") != "" for x in chunk) >= line_dedup.MIN_LINES:
                if body in seen:
                    continue
                seen.add(body)
            kept.append(body)
        out[doc_id] = None if text is None else "\n".join(kept)
    return out


def test_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = without_repeated_chunks(documents)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == expected(rows)
    assert got.agg(F.sum("n_removed")).first()[0] > 0


def test_passage_shifted_to_another_place(spark):
    passage = "\n".join(f"line {i} of the passage" for i in range(40))
    docs = spark.createDataFrame(
        [(1, "one\n" + passage + "\nend one"), (2, "two\nother lines\nhere\n" + passage + "\nend two")],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in without_repeated_chunks(docs).collect()}
    assert got[1]["n_removed"] == 0
    assert got[2]["n_removed"] >= 30 and got[2]["text"].startswith("two") and got[2]["text"].endswith("end two")


def test_colliding_hashes_remove_nothing(spark):
    docs = spark.createDataFrame(
        [(1, "a\nb\nc\nd\ne\nf"), (2, "g\nh\ni\nj\nk\nl")], "doc_id long, text string"
    )
    same = lambda c: F.lit("0")
    assert {r["n_removed"] for r in without_repeated_chunks(docs, hash_of=same).collect()} == {0}


def test_awkward_rows(awkward):
    got = without_repeated_chunks(awkward)
    assert got.columns == [*(c for c in awkward.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    rows = got.collect()
    assert len(rows) == awkward.count()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[2] is None and texts[3] == ""
    assert len(texts[5]) > 100_000 and len(texts[6]) < 200  # a copy
    assert without_repeated_chunks(awkward, counts=False).columns == awkward.columns


def test_empty_table(nothing):
    assert without_repeated_chunks(nothing).collect() == []


def without_passages(rows):
    """All pairs of lines in the order of the table, one after the other."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        lines, gone = (text or "").split("\n"), set()
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
        for a, b in zip(solid, solid[1:]):
            first = seen.setdefault((lines[a], lines[b]), (doc_id, a, b))
            if first != (doc_id, a, b):
                gone.update(range(a + (first[0] == doc_id and first[2] == a), b + 1))
        out[doc_id] = None if text is None else "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def test_passages_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: r["text"] for r in without_repeated_passages(documents).collect()}
    want = without_passages(rows)
    assert got == want
    lines = lambda texts: {line for t in texts for line in (t or "").split("\n")}
    assert {x for x in lines(t for _, t in rows) if x.strip()} <= lines(want.values())  # each line is left somewhere


@pytest.mark.parametrize("gap", ["\n", "\n\n"])
def test_passages_of_any_length_and_place_go(spark, gap):
    rows = []
    for n in range(2, 9):
        passage = gap.join(f"line {i} of {n}" for i in range(n))
        rows += [(2 * n + k, gap.join([f"before {n} {k}"] * (k + 1) + [passage, f"after {n} {k}"])) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in without_repeated_passages(docs).collect()}
    for n in range(2, 9):
        assert got[2 * n] == dict(rows)[2 * n]
        assert [x for x in got[2 * n + 1].split("\n") if x] == [f"before {n} 1"] * 2 + [f"after {n} 1"]


def test_runs_of_equal_and_alternating_lines(spark):
    docs = spark.createDataFrame([(1, "a\na\na\na"), (2, "x\ny\n" * 50 + "z"), (3, "a\na\nb")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in without_repeated_passages(docs).collect()}
    assert got == {1: "a\na", 2: "x\ny\nz", 3: "b"}


def test_awkward_passages(awkward, nothing, spark):
    rows = without_repeated_passages(awkward).collect()
    assert without_repeated_passages(awkward).columns == awkward.columns and len(rows) == awkward.count()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[2] is None and texts[3] == "" and len(texts[5]) > 100_000 and texts[6] == ""
    assert without_repeated_passages(nothing).collect() == []
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c\nd")], "doc_id long, text string")
    same = lambda c: F.lit("0")
    assert {r["text"] for r in without_repeated_passages(docs, hash_of=same).collect()} == {"a\nb", "c\nd"}


def without_both(rows):
    """Lines of repeated chunks and of repeated pairs, both judged on the input in the order of id and text."""
    seen, pairs, out = set(), {}, []
    for key in sorted(rows, key=lambda r: (r[0] is None, r[0], md5((r[1] or "").encode()).hexdigest())):
        doc_id, text = key
        gone, start = set(), 0
        lines = (text or "").split("\n")
        for chunk in chunks(text):
            body = "\n".join(chunk)
            if sum(x.strip(" ") != "" for x in chunk) >= line_dedup.MIN_LINES:
                if body in seen:
                    gone.update(range(start, start + len(chunk)))
                seen.add(body)
            start += len(chunk)
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
        for a, b in zip(solid, solid[1:]):
            first = pairs.setdefault((lines[a], lines[b]), (key, a, b))
            if first != (key, a, b):
                gone.update(range(a + (first[0] == key and first[2] == a), b + 1))
        out.append((doc_id, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] is None, r[1]))


def test_stage_cuts_the_chunks_of_operator_7(spark):
    """What a chunk holds besides pairs of lines goes too: blank lines at its ends, and lines of tabs, which it counts."""
    rows = [(1, "head\n\t"), (2, "head\n\t"), (3, "\nred\nblue\n"), (4, "\nred\nblue\n"), (5, "other\nlines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in stage(spark, docs, "").collect()}
    cut = {r["doc_id"]: r["text"] for r in without_repeated_chunks(docs).collect()}
    assert cut[2] == cut[4] == "" and got == {**dict(rows), 2: "", 4: ""}


def test_stage_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    # passages that begin and end within chunks, copies, null and repeated ids, whose texts have their passages at different places
    passage = "\n".join(f"line {i} of a passage" for i in range(12))
    rows += [(10_000_000 + k, "\n".join([f"before {k}"] * (k % 5 + 1) + [passage, f"after {k}"])) for k in range(12)]
    rows += [(doc_id, f"{k}\n" * (3 * k + 1) + passage + f"\n\t\n\nafter {k}") for k in range(8) for doc_id in (20_000_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in stage(spark, docs, "").collect()]
    assert in_order(got) == in_order(without_both(rows))
    lines = lambda texts: {line for t in texts for line in (t or "").split("\n")}
    assert {x for x in lines(t for _, t in rows) if x.strip()} <= lines(t for _, t in got)  # each line is left somewhere


def test_stage_of_awkward_rows(spark, awkward, nothing):
    got = stage(spark, awkward, "")
    assert got.columns == awkward.columns and got.count() == awkward.count()
    assert stage(spark, nothing, "").collect() == []
