"""Repaired conversations equal a plain reading of the rules, and audits the least of all edits."""

import functools
import hashlib
import random
import sys
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gapscore.llm.conversations import audits, repaired_conversations
from gapscore.llm.queries import QUERIES
from gapscore.llm.trails import Trails

sys.setrecursionlimit(20_000)  # for the plain reading below

SPACES = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, role, text


def repair(rows):
    """(faults, cost, audit, text) by trying every edit from the end."""
    seen, faults = set(), []
    for role, text in rows:
        end = text.rstrip(SPACES)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, said, puts):
        """The least (cost, audit) of the rest; ``said``: initials so far as far as they matter."""
        out = []
        if i == len(rows) and said in ("", "a"):
            out.append((0, ""))
        speaker = "a" if said == "u" else "u"
        if puts < 3:
            cost, rest = best(i, speaker, puts + 1)
            out.append((cost + 3, "I" + rest))
        if i < len(rows):
            initial, fault = rows[i][0][:1], faults[i]
            cost, rest = best(i + 1, said, 0)
            out.append((cost + 4, "D" + rest))
            if fault not in ("blank", "duplicate"):
                left = 3 if fault == "truncated" else 0
                if initial == speaker or (initial == "s" and said == ""):
                    cost, rest = best(i + 1, initial, 0)
                    out.append((cost + left, "K" + rest))
                cost, rest = best(i + 1, speaker, 0)
                out.append((cost + left + 3, "R" + rest))
        return min(out, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    out, i, said = [], 0, ""
    for letter in audit:
        speaker = "a" if said == "u" else "u"
        if letter in "IR":
            out.append(("assistant:" if speaker == "a" else "user:") + (rows[i][1] if letter == "R" else ""))
            said = speaker
        elif letter == "K":
            out.append(":".join(rows[i]))
            said = rows[i][0][0]
        i += letter != "I"
    return faults, cost, audit, "\n".join(out)


def text_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def expected(rows, with_damage=True):
    groups = {conv: [] for conv, *_ in rows}
    for row in damage(rows) if with_damage else ((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows):
        groups[row[0]].append(row)
    out = []
    for conv, own in groups.items():
        own = text_order(own)
        turns = {r[1] for r in own if r[1] is not None}
        faults, cost, audit, text = repair([r[2:] for r in own])
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns[:9] == COLUMNS
    return sorted((tuple(r)[:9] for r in df.collect()), key=str)


def spoiled(draw, n_convs, longest):
    rows = []
    for conv in range(n_convs):
        for turn in range(draw.randint(0, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "usher", "", None])
            text = draw.choice(["Yes.", "No!", "Well", "", " \n", None, f"Line {turn}.", f"Line {turn}", f"One {draw.random()}?"])
            rows.append((conv if conv else None, draw.choice([turn, turn, turn, turn + 5]) if turn else None, role, text))
    return rows


def unique_turns(rows):
    """One row a turn, so that no order is left open."""
    return list({(r[0], r[1]): r for r in rows}.values())


def test_whole_table(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert found(QUERIES["op13_conversations"](spark, folder)) == expected(rows)


@pytest.mark.parametrize("part_rows", [1, 2, 5, 4096])
@pytest.mark.parametrize("with_damage", [True, False])
def test_random_conversations(spark, part_rows, with_damage):
    rows = unique_turns(spoiled(random.Random(part_rows), 60, 14))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = found(repaired_conversations(df, with_damage, part_rows))
    assert got == expected(rows, with_damage)


def test_a_conversation_over_many_tasks(spark):
    draw = random.Random(2)
    rows = [(7, t, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice(["Yes.", "So", f"Line {t}.", f"And {t}"])) for t in range(200)]
    rows += [(8, 0, "user", "Short."), (8, 1, "assistant", "Yes."), (6, 3, "user", "Alone.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(repaired_conversations(spark.createDataFrame(rows, SCHEMA), part_rows=50))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected(rows)


def test_equal_rows_and_dropped_conversations(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(5, 1, "user", "Same.")] * 50 + [(5, 2, "assistant", "Yes.")] + [(gone, 0, "user", "Lost.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(repaired_conversations(df, part_rows=8)) == expected(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in expected(rows)
    by_turn = {r["conv_id"]: r["audit"] for r in repaired_conversations(df, with_damage=False).collect()}
    assert by_turn[5] == "K" + "D" * 49 + "K"


def test_clashes_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    clashing = df.select("*", *(F.lit("x").alias(c) for c in "n kind first seen head tail task no digest audit conv said_by".split()))
    assert found(repaired_conversations(clashing)) == found(repaired_conversations(df))
    assert repaired_conversations(df.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, SCHEMA)
    assert found(repaired_conversations(nulls)) == expected([(None, None, None, None)] * 3)


def test_trails_order_as_their_strings():
    draw = random.Random(4)
    for longest in (1, 3):
        trails, nodes = Trails(), [0]
        for _ in range(300):
            nodes.append(trails.add(draw.choice(nodes[-40:]), "".join(draw.choice("ab") for _ in range(draw.randint(1, longest)))))
        texts = [trails.text(n) for n in nodes]
        for _ in range(3000):
            a, b = draw.randrange(len(nodes)), draw.randrange(len(nodes))
            assert trails.less(nodes[a], nodes[b]) == (texts[a] < texts[b])


def test_colliding_hashes_change_nothing(monkeypatch):
    draw = random.Random(9)
    rows = [(draw.choice("sua"), draw.random() < 0.2, draw.choice([0, 3])) for _ in range(60)]
    want = [audits(rows, start) for start in range(4)]
    monkeypatch.setattr("gapscore.llm.trails._PRIME", 3)
    assert [audits(rows, start) for start in range(4)] == want
