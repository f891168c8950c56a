import re
from collections import defaultdict
from hashlib import sha256

from gapscore.llm.exact_dedup import duplicate_groups

from llm_tables import ROWS


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for body, members in groups.items():
        best = min(range(len(members)), key=lambda n: (-len(members[n][1]), members[n][0] is None, members[n][0] or 0, n))
        sha = sha256(body.encode()).hexdigest()
        out += [(i, members[best][0], len(members), n == best, sha) for n, (i, _) in enumerate(members)]
    return sorted(out, key=repr)


def test_awkward_rows(awkward):
    got = sorted((tuple(r) for r in duplicate_groups(awkward).collect()), key=repr)
    assert got == expected([(r[0], r[1]) for r in ROWS])


def test_longer_original_stays(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, " ab"), (4, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in duplicate_groups(docs).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (2, False), 4: (4, True)}


def test_hot_group_is_counted_before_the_shuffle(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'the same text' AS text")
    out = duplicate_groups(docs)
    assert out.where("kept").count() == 1 and out.first()["group_size"] == 5000
    assert "collect_" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_empty_table(nothing):
    assert duplicate_groups(nothing).collect() == []


def test_one_row_of_a_group_is_kept(spark):
    rows = [(5, "a b"), (5, "ab"), (5, "ab"), (7, "a b"), (5, "a b"), (None, "x"), (None, "x"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in duplicate_groups(docs).collect()), key=repr) == expected(rows)
    assert duplicate_groups(docs.unionByName(docs)).where("kept").count() == 3
