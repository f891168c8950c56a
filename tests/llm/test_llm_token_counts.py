"""Token counts equal those of the library's own encoding of whole texts."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapscore.llm.queries import QUERIES
from gapscore.llm.token_counts import PreTokens, _frequent, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def n_tokens(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def expected(rows, limit=2048):
    out = []
    for doc_id, text in rows:
        n = n_tokens(text)
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


def found(df):
    assert df.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def own():
    return PreTokens(PATH)


def total(own, text):
    words, added = own.frequencies(text)
    return added + sum(n * own.pieces(word) for word, n in words.items())


def test_every_character(own):
    points = [*range(0x3000), *range(0x3000, 0x110000, 41)]
    for point in points:
        if not 0xD800 <= point < 0xE000:
            text = f"a{chr(point)}B{chr(point)}{chr(point)}9 's"
            assert total(own, text) == n_tokens(text), hex(point)


def test_random_texts(own):
    draw = random.Random(5)
    pools = ["abcABC 123!?", " 'stremvld", [chr(c) for c in range(0x300)], "’“–… 中文Σς́가🙂ᴬÅΩ", ["<|endoftext|>", "<|startoftext|> ", "<|EndOfText|>"]]
    for _ in range(5000):
        text = "".join(draw.choice(draw.choice(pools)) for _ in range(draw.randint(0, 40)))
        assert total(own, text) == n_tokens(text), text


def test_whole_table(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(QUERIES["op12_token_counts"](spark, sf)) == expected(rows)


@pytest.mark.parametrize("frequent", [0, 40])
def test_rare_words_come_by_the_join(documents, frequent):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(token_counts(documents, PATH, limit=100, frequent=frequent)) == expected(rows, 100)


def test_frequent_words_are_bounded(spark):
    pieces = spark.createDataFrame([(f"w{i}", i + 1, 2) for i in range(100)], "word string, n long, pieces long")
    assert len(_frequent(pieces, 50)) == 37 and len(_frequent(pieces, 1000)) == 100 and _frequent(pieces, 10) == {}
    assert _frequent(spark.createDataFrame([("w" * 100, 9, 1)], pieces.schema), 10) == {}


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(token_counts(awkward, PATH, frequent=5)) == expected(rows)
    clashing = awkward.select("doc_id", "text", *(F.lit("x").alias(c) for c in "no n n_bytes word pieces".split()))
    assert found(token_counts(clashing, PATH)) == expected(rows)
    assert token_counts(nothing, PATH).collect() == []


def test_other_types_of_ids(spark):
    df = spark.createDataFrame([("b", "Some text"), ("a", "x" * 200_000), (None, " ")], "doc_id string, text string")
    assert found(token_counts(df, PATH, frequent=0)) == expected([tuple(r) for r in df.collect()])
