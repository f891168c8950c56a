"""Spelling variants equal a brute-force reading of their definition."""

import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gapscore.llm.queries import QUERIES
from gapscore.llm.spelling import disjoint, gram_order, near_pairs, spelling_variants
from gapscore.llm.work import Scratch

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(words):
    """Words one edit apart, by the words that are left when one letter is deleted."""
    by_rest = defaultdict(set)
    for w in words:
        by_rest[w].add(w)
        for i in range(len(w)):
            by_rest[w[:i] + w[i + 1 :]].add(w)
    out = defaultdict(set)
    for group in by_rest.values():
        for a in group:
            out[a] |= {b for b in group if a != b and one_edit(a, b)}
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def expected(rows):
    n = counts(rows)
    neighbours, form = near(n), {}
    for w in n:
        if neighbours[w]:
            best = min(neighbours[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(neighbours[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(df):
    assert df.columns[:6] == COLUMNS
    return sorted(tuple(r)[:6] for r in df.collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    assert found(QUERIES["op11_spelling"](spark, sf)) == want
    assert sum(r[1] is not None for r in want) > 100


def variants(draw, n_words, letters):
    """Words with many edits of each other, in geometric numbers so that forms make chains."""
    rows, doc_id = [], 0
    for _ in range(n_words):
        word = "".join(draw.choice(letters) for _ in range(draw.randint(6, 10)))
        n = 5
        for _ in range(draw.randint(1, 5)):
            for _ in range(n):
                rows.append((doc_id := doc_id + 1, word))
            at = draw.randrange(len(word))
            word = draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at + 1 :], word[:at] + draw.choice(letters) + word[at:]])
            n *= draw.choice([1, 3, 5])
    return rows


@pytest.mark.parametrize("letters", ["ab", "abcdé", string.ascii_lowercase + "ÀÿÉ"])
def test_random_words(spark, letters):
    draw = random.Random(len(letters))
    rows = variants(draw, 40, letters)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert found(spelling_variants(df)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # some chain has two steps


def test_near_pairs_are_all_found(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abc") for _ in range(draw.randint(6, 9))) for _ in range(600)}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    got = {(r["word"], r["other"]) for r in near_pairs(df, Scratch(spark, "t")).collect()}
    assert got == {(a, b) for a, others in near(words).items() for b in others} and got


def test_disjoint_takes_the_lightest():
    draw = random.Random(1)
    for _ in range(300):
        places = draw.sample(range(8), draw.randint(3, 6))
        grams = [(p, draw.randint(1, 9)) for p in places]
        chosen = disjoint(grams, 2)
        assert abs(grams[chosen[0]][0] - grams[chosen[1]][0]) >= 2
        pairs = [(a[1] + b[1]) for a in grams for b in grams if b[0] - a[0] >= 2]
        assert sum(grams[i][1] for i in chosen) == min(pairs)


def test_gram_order(spark):
    df = spark.createDataFrame([("aaaaab", 5), ("aabbbb", 5)], "word string, n long")
    assert gram_order(df) == [("ab", 2), ("bb", 3), ("aa", 5)]


def test_awkward_rows(awkward, nothing):
    many = awkward
    for _ in range(3):
        many = many.unionByName(awkward)
    rows = [(r["doc_id"], r["text"]) for r in many.collect()]
    want = expected(rows)
    assert want and found(spelling_variants(many)) == want
    clashing = many.select("doc_id", "text", *(F.lit("x").alias(c) for c in "word n run h gram place len last form root".split()))
    assert found(spelling_variants(clashing)) == want
    assert spelling_variants(nothing).collect() == []


def test_short_words_are_refused(nothing):
    with pytest.raises(ValueError, match="bigrams"):
        spelling_variants(nothing, min_length=3)
