import random

from gapscore.llm import near_copies
from gapscore.llm.near_copies import are_near, can_be_near, prefix_length, shingles, without_near_copies


def near(a, b):
    a, b = (shingles((t or "").encode()) for t in (a, b))
    return len(a & b) >= 0.8 * len(a | b)


def check(rows, kept):
    """No two rows that stay are near; each that goes has a near row before it."""
    key = lambda r: (r[0] is None, r[0] or 0)
    rows, kept, left = sorted(rows, key=key), sorted(kept, key=key), []
    for i, a in enumerate(kept):
        assert not any(near(a[1], b[1]) for b in kept[:i])
    waiting = list(kept)
    for i, row in enumerate(rows):
        if row in waiting:
            waiting.remove(row)
        else:
            assert any(near(row[1], b[1]) for b in rows[:i] + rows[i + 1 :] if key(b) <= key(row))
            left.append(row)
    assert not waiting
    return left


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    kept = without_near_copies(documents)
    assert kept.columns == documents.columns
    assert check(rows, [(r["doc_id"], r["text"]) for r in kept.collect()])


def test_similarity_of_08_and_dense_groups(spark):
    """Texts of 100 runs with 10 to 13 runs of their own on each side, and a cloud of near copies."""
    rng, rows = random.Random(1), []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(104)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[11:] + [f"v{k}x{i}" for i in range(11)]))]
        rows += [(3 * k + 2, " ".join(words[13:] + [f"u{k}x{i}" for i in range(13)]))]
    cloud = [f"c{i}" for i in range(200)]
    for k in range(150):
        own = list(cloud)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(200)] = f"d{rng.randrange(1000)}"
        rows.append((1000 + k, " ".join(own)))
    kept = {r["doc_id"] for r in without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check(rows, [r for r in rows if r[0] in kept])
    assert all(3 * k in kept and 3 * k + 1 not in kept for k in range(30))


def test_rows_not_ids(awkward, nothing, spark):
    from llm_tables import ROWS

    kept = without_near_copies(awkward)
    assert kept.columns == awkward.columns
    check([(r[0], r[1]) for r in ROWS], [(r["doc_id"], r["text"]) for r in kept.collect()])
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (None, text), (None, "other"), (None, "other"), (2, None), (3, "")]
    kept = [tuple(r) for r in without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=repr) == sorted([(1, text), (None, "other"), (2, None)], key=repr)
    assert without_near_copies(nothing).collect() == []


def test_exact_ratio():
    assert are_near({b"a", b"b", b"c", b"d"}, {b"a", b"b", b"c", b"d", b"e"}) and are_near(set(), set())
    assert not are_near({b"a", b"b", b"c"}, {b"a", b"b", b"c", b"d"}) and not are_near(set(), {b"a"})


def test_prefixes_and_places_lose_no_near_pair():
    """In any order, near sets have their first common element in both prefixes, at places that pass."""
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 40)
        base = set(rng.sample(range(60), n))
        other = {x for x in base if rng.random() < 0.93} | set(rng.sample(range(60), rng.randint(0, 3)))
        if not other or not are_near(base, other):
            continue
        order = list(range(60))
        rng.shuffle(order)
        a, b = ([x for x in order if x in s] for s in (base, other))
        common = next(x for x in a if x in other)
        i, j = a.index(common), b.index(common)
        assert i < prefix_length(len(a)) and j < prefix_length(len(b)) and can_be_near(len(a), i, len(b), j)


def test_a_common_passage_brings_no_pairs(spark, monkeypatch):
    """3,000 texts of which two thirds are one passage: few pairs, and near copies among them are found."""
    seen = []
    checked = near_copies.Scratch.keep

    def keep(self, df, name):
        out = checked(self, df, name)
        if name.startswith("dealt"):
            seen.append(out.where("leader IS NOT NULL").count())
        return out

    monkeypatch.setattr(near_copies.Scratch, "keep", keep)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(k, passage + " " + " ".join(f"w{k}x{i}" for i in range(40))) for k in range(3000)]
    rows += [(5000 + k, rows[k][1] + " more") for k in range(20)]
    kept = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(3000))
    assert sum(seen) < 3000


def test_links_of_fingerprints_are_compared_exactly(spark, monkeypatch):
    """The stage takes its first pairs from SimHash; linked rows go only if they are near the first row of their component."""
    asked = []

    def all_linked(docs, text, doc_id, words):
        asked.append(words)
        return docs.selectExpr(f"{doc_id} AS doc_id", "'' AS fingerprint", "0L AS component_id")

    monkeypatch.setattr(near_copies, "near_duplicates", all_linked)
    words = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(words[:-1])), (1, " ".join(words)), (2, "something else in five words"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in without_near_copies(docs).collect()) == [1, 2, 3] and asked == [5]
