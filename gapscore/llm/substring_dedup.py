"""Repeated substrings: suffix arrays of the places where texts may repeat, merged over the whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscore.llm.features import bytes_of, mixed
from gapscore.llm.suffixes import common_prefixes, suffix_array
from gapscore.llm.work import Scratch

#: A string of so many bytes that occurs earlier goes.
WINDOW = 100
#: Bytes of an anchor. Of the grams of a window the one with the least hash is its anchor, so equal windows
#: have equal anchors at equal places, and a text has an anchor about every 37 bytes.
GRAM = 28
SPAN = WINDOW - GRAM + 1
#: Bytes that are hashed at once; less than 2^20, as places take 20 bits.
PART = 1 << 18
#: Bytes of a suffix array.
SHARD = 1 << 20
#: Contexts of one anchor that go into one shard; more are dealt to several, which are merged.
HOT = 4_000
_NO_ID = 2**63 - 1

_BASE = 0x5851F42D4C957F2D
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    factors = np.full(PART + 4 * WINDOW, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


class _Hashes:
    """Hashes of any ranges of a part, from the sums over its beginnings."""

    def __init__(self, part: np.ndarray):
        self.sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[: len(part)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * _INVERSE[start] + (end - start).astype(np.uint64))


def _anchors(part: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, _Hashes]:
    """Places of the anchors of the windows that start at ``valid``, their hashes, and the part's hashes."""
    hashes = _Hashes(part)
    at = np.arange(len(part) - GRAM + 1)
    gram = hashes(at, at + GRAM)
    least = (gram & ~np.uint64(0xFFFFF)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    places = np.unique((least[valid] & np.uint64(0xFFFFF)).astype(np.int64))
    return places, gram[places], hashes


def _parts(body: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """(bytes, document of each byte range, range starts, ranges' offset in the document, valid window starts)."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, side="right")) - 1)
        low, high = int(at[i]), int(at[j])
        if high - low <= PART:
            starts, ends = at[i:j] - low, at[i + 1 : j + 1] - low
            room = np.maximum(ends - starts - WINDOW + 1, 0)
            valid = np.arange(int(room.sum())) + np.repeat(starts - (np.cumsum(room) - room), room)
            yield body[low:high], np.arange(i, j), starts, np.zeros(j - i, np.int64), valid
        else:
            for first in range(low, high - WINDOW + 1, PART):
                begin = max(low, first - SPAN + 1)
                end = min(high, first + PART + 2 * WINDOW)
                valid = np.arange(first - begin, min(first + PART, high - WINDOW + 1) - begin)
                yield body[begin:end], np.array([i]), np.zeros(1, np.int64), np.array([begin - low]), valid
        i = j


def _identified(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.crc32(body).alias("crc"),
        body.alias("body"),
        F.col(doc_id).alias("doc_id"),
    )


def anchors(docs: DataFrame, keys_only: bool = False) -> DataFrame:
    """(key, context, id, crc, place) of each anchor: its hash, and that of the 72 bytes on either side."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, crcs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for part, document, starts, offset, valid in _parts(*bytes_of(batch.column(2))):
                if not len(valid):
                    continue
                places, gram, hashes = _anchors(part, valid)
                if keys_only:
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["key"])
                    continue
                owner = np.searchsorted(starts, places, side="right") - 1
                ends = np.append(starts[1:], len(part))
                context = hashes(
                    np.maximum(places - SPAN + 1, starts[owner]), np.minimum(places + WINDOW, ends[owner])
                )
                columns = (
                    gram.view(np.int64),
                    context.view(np.int64),
                    ids[document[owner]],
                    crcs[document[owner]],
                    places - starts[owner] + offset[owner],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["key", "context", "id", "crc", "place"]
                )

    own = docs.select("id", "crc", "body")
    if keys_only:
        return own.mapInArrow(find, "key long")
    # a long text's parts overlap and may both report an anchor; doubled rows do no harm
    return own.mapInArrow(find, "key long, context long, id long, crc long, place long")


_JUDGED = pa.schema(
    [
        ("id", pa.int64()),
        ("crc", pa.int64()),
        ("first", pa.int64()),
        ("last", pa.int64()),
        ("key", pa.int64()),
        ("bucket", pa.int32()),
        ("windows", pa.binary()),
        ("owners", pa.binary()),
    ]
)
_JUDGED_DDL = "id long, crc long, first long, last long, key long, bucket int, windows binary, owners binary"


def _runs(ids: np.ndarray, crcs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window starts joined to runs: (id, crc, first, last)."""
    order = np.lexsort((starts, crcs, ids))
    ids, crcs, starts = ids[order], crcs[order], starts[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(ids)) - 1
    return ids[first], crcs[first], starts[first], starts[last]


def _judge(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One shard: rows (key, buckets, id, crc, place, left, bytes) of contexts that share anchors with others."""
    keys, buckets, ids, crcs, places, left = (np.array(c, dtype=np.int64) for c in list(zip(*rows))[:6])
    pieces = [r[6] for r in rows]
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    order = suffix_array(text)
    group = np.cumsum(common_prefixes(text, order, starts, WINDOW) < WINDOW)
    # the windows that lie in a context and hold its anchor, in suffix order
    room = np.minimum(left, sizes - WINDOW) + 1
    room = np.maximum(room, 0)
    window = np.zeros(len(text), dtype=bool)
    window[np.arange(int(room.sum())) + np.repeat(starts - (np.cumsum(room) - room), room)] = True
    mine = window[order]
    at, group = order[mine], group[mine]
    owner = np.searchsorted(starts, at, side="right") - 1
    begin = places[owner] - left[owner] + at - starts[owner]
    rank = np.lexsort((begin, crcs[owner], ids[owner], group))
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = group[rank[1:]] != group[rank[:-1]]
    leader = np.empty(len(at), np.int64)
    leader[rank] = rank[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(at) else rank
    # contexts of one text overlap, so a window may be here twice; it is not its own copy
    later = (
        (ids[owner] != ids[owner[leader]]) | (crcs[owner] != crcs[owner[leader]]) | (begin != begin[leader])
    )
    if later.any():
        columns = _runs(ids[owner[later]], crcs[owner[later]], begin[later])
        empty = [pa.nulls(len(columns[0]), f.type) for f in list(_JUDGED)[4:]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *empty], schema=_JUDGED)
    # an anchor with more shards: each of its strings once, in suffix order, with the first owner here
    split = np.flatnonzero(buckets[owner] > 1)
    if len(split):
        _, once = np.unique(np.stack([group[split], keys[owner[split]]]), axis=1, return_index=True)
        split = split[np.sort(once)]
        split = split[np.argsort(group[split], kind="stable")]
        where, own, first = at[split], owner[split], leader[split]
        strings = np.lib.stride_tricks.sliding_window_view(text, WINDOW)[where]
        bucket = (mixed(_sums(strings)) % buckets[own].astype(np.uint64)).astype(np.int64)
        owners = np.stack([ids[owner[first]], crcs[owner[first]], begin[first]], axis=1)
        for key in np.unique(keys[own]):
            for b in np.unique(bucket[keys[own] == key]):
                some = (keys[own] == key) & (bucket == b)
                values = (None, None, None, None, int(key), int(b), strings[some].tobytes(), owners[some].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _JUDGED)], schema=_JUDGED)


def _sums(strings: np.ndarray) -> np.ndarray:
    return (_BYTE[strings] * _POWER[: strings.shape[1]]).sum(axis=1, dtype=np.uint64)


def _judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and part; shards end between two groups."""
    rows, size, group = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if (row[0], row[1]) != group:
                if size >= SHARD:
                    yield from _judge(rows)
                    rows, size = [], 0
                group = (row[0], row[1])
            rows.append((row[0], *row[2:]))
            size += len(row[7])
    if rows:
        yield from _judge(rows)


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Sorted runs of strings, merged one after the other by binary search; of equal strings the first owner stays."""
    strings, owners, lost = np.empty(0, f"S{WINDOW}"), np.empty((0, 3), np.int64), []
    for windows, own in zip(group["windows"], group["owners"]):
        run = np.frombuffer(windows, f"S{WINDOW}")
        who = np.frombuffer(own, np.int64).reshape(-1, 3)
        at = np.searchsorted(strings, run)
        met = np.flatnonzero(at < len(strings))
        met = met[strings[at[met]] == run[met]]
        old, new = owners[at[met]], who[met]
        earlier = (new[:, 0] < old[:, 0]) | (
            (new[:, 0] == old[:, 0]) & ((new[:, 1] < old[:, 1]) | ((new[:, 1] == old[:, 1]) & (new[:, 2] < old[:, 2])))
        )
        same = (new == old).all(axis=1)
        lost.append(np.where(earlier[:, None], old, new)[~same])
        owners[at[met[earlier]]] = new[earlier]
        rest = np.setdiff1d(np.arange(len(run)), met, assume_unique=True)
        strings = np.insert(strings, at[rest], run[rest])
        owners = np.insert(owners, at[rest], who[rest], axis=0)
    gone = np.concatenate(lost)
    columns = _runs(*gone.T) if len(gone) else [[]] * 4
    return pd.DataFrame(dict(zip(("id", "crc", "first", "last"), columns)), dtype="int64")


def _contexts(docs: DataFrame, wanted: DataFrame, hot: int) -> DataFrame:
    """(key, part, buckets, id, crc, place, left, piece): the bytes around the wanted anchors (id, crc, place, key, n)."""
    # a part is chosen by the place itself, and one anchor's contexts are dealt evenly
    parts = F.ceil(F.col("n") / hot).cast("int")
    listed = wanted.groupBy("id", "crc").agg(
        F.collect_list(
            F.struct(
                "key", F.pmod(F.xxhash64("id", "crc", "place"), parts).cast("int").alias("part"), parts.alias("buckets"), "place"
            )
        ).alias("anchors")
    )
    left = F.least(F.col("a.place"), F.lit(SPAN - 1))
    return (
        docs.join(listed, ["id", "crc"])
        .select("id", "crc", "body", F.explode("anchors").alias("a"))
        .select(
            "a.key",
            "a.part",
            F.col("a.buckets").cast("long").alias("buckets"),
            "id",
            "crc",
            "a.place",
            left.alias("left"),
            F.substring("body", (F.col("a.place") - left + 1).cast("int"), (left + WINDOW).cast("int")).alias("piece"),
        )
    )


def repeated_runs(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(id, crc, first, last): runs of starts of windows that also start earlier. ``docs`` as from ``_identified``.

    0. Of texts that are equal as a whole all but the first are repeats from end to end; only the first goes on.
    1. Anchors that occur once in the table hold no repeat and are left out. This is exact: equal windows have
       equal anchors.
    2. Of the occurrences of an anchor with the same bytes around, all but the first are repeats.
    3. Where an anchor has different bytes around, the first occurrence of each goes to the shard of the
       anchor. Its suffix array and common prefixes show which windows are equal; the earliest stays.
    4. An anchor with more contexts than ``hot`` has several shards, whose sorted strings are merged by
       binary search, in parts by content.
    """
    # Equal by SHA-256; rows with the same id and CRC-32 are one document.
    equal = docs.groupBy(F.unhex(F.sha2("body", 256)).alias("sha")).agg(
        F.min(F.struct("id", "crc")).alias("at"), F.max(F.struct("id", "crc")).alias("last")
    )
    equal = scratch.keep(equal.where("at < last").select("sha", "at"), "equal")
    whole = (
        docs.select("id", "crc", F.unhex(F.sha2("body", 256)).alias("sha"), F.octet_length("body").cast("long").alias("size"))
        .join(equal, "sha")
        .where(F.struct("id", "crc") != F.col("at"))
        .select("id", "crc", F.lit(0).cast("long").alias("first"), (F.col("size") - WINDOW).alias("last"))
    )
    whole = scratch.keep(whole.distinct(), "whole")
    scratch.drop("equal")
    docs = docs.join(whole.select("id", "crc"), ["id", "crc"], "left_anti").select("id", "crc", "body")
    whole = whole.where("last >= 0")
    counted = anchors(docs, keys_only=True).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    twice = scratch.keep(counted.select("key"), "twice")
    found = scratch.keep(anchors(docs).join(twice, "key"), "found")
    scratch.drop("twice")
    first = found.groupBy("key", "context").agg(F.min(F.struct("id", "crc", "place")).alias("at"))
    first = scratch.keep(first, "first")
    copies = (
        found.join(first, ["key", "context"])
        .where(F.struct("id", "crc", "place") != F.col("at"))
        .select("id", "crc", (F.col("place") - SPAN + 1).alias("first"), F.col("place").alias("last"))
    )
    copies = scratch.keep(copies, "copies")
    contested = first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    wanted = first.join(contested, "key").select("at.id", "at.crc", "at.place", "key", "n")
    judged = (
        _contexts(docs, wanted, hot)
        .repartition("key", "part")
        .sortWithinPartitions("key", "part")
        .mapInArrow(_judge_all, _JUDGED_DDL)
    )
    judged = scratch.keep(judged, "judged")
    scratch.drop("found", "first")
    merged = (
        judged.where(F.col("windows").isNotNull())
        .groupBy("key", "bucket")
        .applyInPandas(_merge, "id long, crc long, first long, last long")
    )
    own = judged.where(F.col("windows").isNull()).select("id", "crc", "first", "last")
    return whole.unionByName(copies).unionByName(own).unionByName(merged)


def _cut(body: bytes, runs: list[dict] | None) -> tuple[int, int, bytes]:
    """Bytes and maximal runs of bytes removed, and what is left."""
    last = len(body) - WINDOW
    spans: list[list[int]] = []
    for a, b in sorted((max(0, r["first"]), min(r["last"], last) + WINDOW) for r in runs or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(body[at:a])
        at = b
    kept.append(body[at:])
    return sum(b - a for a, b in spans), len(spans), b"".join(kept)


def without_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_kept: bool = True, hot: int = HOT
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept, for each document.

    Each byte goes that is covered by a string of 100 bytes which also starts earlier: in a document with a smaller id,
    or before in the same. Texts are UTF-8 bytes, strings end with their document, and all are judged on the input;
    ``kept`` is binary, as a cut may fall inside a character.

    Defined cases: null and empty texts have no bytes; texts under 100 bytes stay whole; null ids come last, and
    among equal ids the order is that of the text's CRC-32; rows that repeat id and text are one document and have one
    answer, in which neither is a copy of the other; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    own = _identified(docs, text, doc_id)
    runs = repeated_runs(own, scratch, hot).groupBy("id", "crc").agg(
        F.collect_list(F.struct("first", "last")).alias("runs")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(b), *_cut(b, r)) for b, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            size, gone, spans, kept = zip(*rows) if rows else ((),) * 4
            columns = [
                batch.column(0),
                *(pa.array(c, pa.int64()) for c in (size, gone, spans)),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = own.join(runs, ["id", "crc"], "left").select("doc_id", "body", "runs")
    return joined.mapInArrow(cut, schema + (", kept binary" if with_kept else ""))
