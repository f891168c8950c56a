import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gapscore.llm import packing
from gapscore.llm.packing import best_cuts, cut_places, packed
from gapscore.llm.queries import vocabulary
from gapscore.llm.tokens import encoder

from llm_tables import ROWS

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs):
    """Pieces are a partition of the ids, sequences are gapless and short enough."""
    bodies, left = {}, {}
    for doc_id, text in docs:
        ids = np.array(ids_of(text), dtype="<u4")
        bodies.setdefault(doc_id, []).append(ids)
    for r in rows:
        whole = [b for b in bodies[r["doc_id"]] if len(b) == r["doc_tokens"]]
        piece = slice(r["start"], r["start"] + r["length"])
        assert r["ids_crc32"] in {zlib.crc32(b[piece].tobytes()) for b in whole}
        left[r["doc_id"]] = left.get(r["doc_id"], 0) + r["length"]
    assert left == {k: sum(map(len, v)) for k, v in bodies.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        sizes.append(at)
    return sizes


def test_documents(documents):
    rows = packed(documents, *vocabulary()).collect()
    sizes = check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()])
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) < 0.02 * sum(sizes)


def test_awkward_rows(awkward, nothing):
    rows = packed(awkward, *vocabulary()).collect()
    check(rows, [(r[0], r[1]) for r in ROWS])
    assert packed(nothing, *vocabulary()).collect() == []


def test_segments_are_packed_one_after_the_other(documents, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT_TOKENS", 5000)
    rows = packed(documents, *vocabulary()).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()])


def exhaustive(places, cost, window):
    n = len(places)
    best = [0.0] + [np.inf] * (n - 1)
    for j in range(1, n):
        for i in range(j):
            length = places[j] - places[i]
            if length <= window:
                padding = 0 if length in packing.UNPADDED and length < window else window - length
                best[j] = min(best[j], best[i] + padding + cost[j])
    return best[-1]


def price(cuts, places, cost, window):
    by_place = dict(zip(places.tolist(), cost.tolist()))
    lengths = np.diff(cuts)
    assert lengths.max() <= window
    padding = [0 if n in packing.UNPADDED and n < window else window - n for n in lengths.tolist()]
    return sum(padding) + sum(by_place[c] for c in cuts[1:].tolist())


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_best(seed):
    rng = np.random.default_rng(seed)
    places = np.concatenate([[0], np.cumsum(rng.integers(1, 60, 60))])
    cost = rng.choice([0.0, 4.0, 16.0], len(places))
    cuts = best_cuts(places, cost, 300)
    assert price(cuts, places, cost, 300) == pytest.approx(exhaustive(places, cost, 300))


def test_places_are_never_a_window_apart():
    ids = np.full(5000, 7, dtype="<u4")
    places, _ = cut_places(ids, np.array([3000, 5000]), np.zeros(10, bool), 32)
    assert np.diff(places).max() <= 32 and {0, 3000, 5000} <= set(places.tolist())


@pytest.mark.parametrize(
    "text",
    ["", " ", "  two  spaces ", "a\n b", "a \n b", "tab\t\tx  y", "don't we'll 12 345 ...!?", "é ü 漢字 🙂 x", " lead", "a  b", "<|endoftext|"],
)
def test_words_are_encoded_as_in_the_text(text):
    found = np.frombuffer(encoder(*vocabulary())(text), dtype="<u4").tolist()
    assert found == ids_of(text)[:-1]


@pytest.mark.parametrize(
    "text", ["a<|endoftext|>b", "a <|endoftext|> b", "  <|endoftext|>\n\nx", "<|endoftext|><|endoftext|>", "<|endoftext|>x <|endoftext|"]
)
def test_added_tokens_have_their_ids(text, spark):
    found = np.frombuffer(encoder(*vocabulary())(text), dtype="<u4").tolist()
    assert found == ids_of(text)[:-1] and 50256 in found
    check(packed(spark.createDataFrame([(1, text)], "doc_id long, text string"), *vocabulary()).collect(), [(1, text)])


def test_frequent_words_are_remembered(monkeypatch):
    """Rare words in any number do not push out a frequent one, and odd spaces go to the vocabulary's pattern as a whole."""
    from gapscore.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    encode = tokens.Encoder(*vocabulary())
    asked = []
    plain = encode.spaced.encode
    encode.spaced.encode = lambda word: asked.append(word) or plain(word)
    for i in range(200):
        text = f"start often w{i} often"
        assert encode(text) == np.array(ids_of(text)[:-1], dtype="<u4").tobytes()
        assert len(encode.spaced) + len(encode.spaced.older) <= 20
    assert asked.count(" often") == 1
    for text in ("", " ", "a  b", "a ", "a \nb", " a", "a  b", "\n a", "a\n b", "a " + "x" * 70 + " b", "a \x1cb  c"):
        assert encode(text) == np.array(ids_of(text)[:-1], dtype="<u4").tobytes()


def test_texts_of_new_words_are_encoded_as_a_whole(monkeypatch):
    """Words are looked up again after a while, and texts of known words stay looked up; the ids are the same either way."""
    from gapscore.llm import tokens

    monkeypatch.setattr(tokens, "TRIED", 100)
    encode = tokens.Encoder(*vocabulary())
    asked = []
    plain = encode.spaced.encode
    encode.spaced.encode = lambda word: asked.append(word) or plain(word)
    for i in range(400):
        text = f"start n{i} often  m{i}." if i % 50 == 0 else f"start n{i} often m{i}.\n k{i}"
        assert encode(text) == np.array(ids_of(text)[:-1], dtype="<u4").tobytes()
    assert 0 < len(asked) < 400
    for i in range(400):
        encode("start often often often often")
    asked.clear()
    for _ in range(400):
        encode("start often often often often")
    assert encode.spared <= 0 and not asked
