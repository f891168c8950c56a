import hashlib

import numpy as np
import pytest

from gapscore.llm.substring_dedup import PART, without_repeats
from gapscore.llm.suffixes import common_prefixes, suffix_array

from llm_tables import ROWS, with_clashes


def expected(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body, spans = (text or "").encode(), []
        for k in range(len(body) - 99):
            window = body[k : k + 100]
            if window not in seen:
                seen.add(window)
            elif spans and k <= spans[-1][1]:
                spans[-1][1] = k + 100
            else:
                spans.append([k, k + 100])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + body[at:a], b
        kept += body[at:]
        digest = hashlib.sha256(kept).hexdigest()
        out[doc_id] = (len(body), sum(b - a for a, b in spans), len(spans), digest, kept)
    return out


def found(df):
    return {r["doc_id"]: tuple(r[1:5]) + (bytes(r["kept"]),) for r in df.collect()}


@pytest.mark.parametrize("hot", [4000, 3])
def test_documents(documents, hot):
    want = expected([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert found(without_repeats(documents, hot=hot)) == want


@pytest.mark.parametrize("hot", [4000, 2])
def test_common_line_in_many_contexts(spark, hot):
    """A line shorter than a window with other text around, and passages that begin and end inside it."""
    rng = np.random.default_rng(4)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    line, passage = noise(80), noise(150)
    rows = [(i, noise(60) + line + noise(70)) for i in range(20)]
    rows += [(30 + i, noise(40) + line + passage + noise(30)) for i in range(5)]
    rows += [(40, "ab" * 200), (41, "b" + "ab" * 150 + "c"), (42, line + line + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(without_repeats(docs, hot=hot)) == expected(rows)


def test_awkward_rows(spark, awkward, nothing):
    small = [(r[0], r[1]) for r in ROWS if r[0] not in (5, 6, 8)]
    docs = with_clashes(spark.createDataFrame([*small, (12, "é" * 120), (13, "x" + "é" * 120)], "doc_id long, text string"))
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(without_repeats(docs)) == want
    got = without_repeats(awkward, with_kept=False).collect()
    assert len(got) == awkward.count()
    assert {r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] == 6} == {True}  # both rows copy document 5
    assert without_repeats(nothing).collect() == []


def test_text_longer_than_a_part(spark):
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, PART + 5000).astype(np.uint8)).decode()
    rows = [(1, text), (2, text[PART - 300 : PART + 400]), (3, text[: PART // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in without_repeats(docs, with_kept=False).collect()}
    assert got == {1: 0, 2: 700, 3: PART // 2}


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    text = rng.integers(0, int(rng.integers(1, 4)), n).astype(np.uint8)
    body = text.tobytes()
    order = suffix_array(text)
    assert order.tolist() == sorted(range(n), key=lambda i: body[i:])
    starts = np.unique(np.append(rng.integers(0, n, 3), 0))
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    want = [0] + [min(30, common(body[i:], body[j:])) for i, j in zip(order[1:], order)]
    assert common_prefixes(text, order, starts, 30).tolist() == want


def test_whole_copies_go_from_end_to_end(spark):
    """Copies of a text, short and long, of one id and of several, beside texts that share a part of it."""
    rng = np.random.default_rng(7)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    text, short = noise(700), noise(99)
    rows = [(9, text), (3, text), (5, text), (1, noise(50) + text[100:400]), (7, text[:300] + noise(20)), (4, short), (6, short), (2, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(without_repeats(docs)) == expected(rows)
    again = docs.unionByName(spark.createDataFrame([(3, text), (None, text), (None, text)], docs.schema))
    got = found(without_repeats(again))
    assert got[3] == expected(rows)[3] and got[None][1] == 700
