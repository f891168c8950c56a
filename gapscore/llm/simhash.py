"""Near duplicates: SimHash fingerprints, compared in tiles with exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscore.llm.components import component_roots
from gapscore.llm.work import Scratch

WORDS = 4
RADIUS = 4
SEED = 42
TILE = 256
#: A band value with more fingerprints is split into parts that are compared two by two.
GROUP_ROWS = 4096
#: Shingle hashes whose bits are counted at once.
_COUNTED = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of the word shingles of a UTF-8 text: bit k is 1 if set in over half the hashes."""
    tokens = text.lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    if len(hashes) == 1:
        return int(hashes[0])
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _COUNTED):
        part = hashes[at : at + _COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], schema=out)

    return own.mapInArrow(score, "doc_id long, fp long")


def _tile_links(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of the first of its component in this group.

    Sorted by population count and cut into tiles; two tiles are compared only if their counts come
    within the radius of each other, since each differing bit changes the count by one.
    """
    count = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order]
    label, n = np.arange(len(fps)), len(fps)
    near = []
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            if count[j] - count[min(i + TILE, n) - 1] > radius:
                break
            hit = np.bitwise_count(fps[i : i + TILE, None] ^ fps[None, j : j + TILE]) <= radius
            if (hit.sum() > len(hit)) if i == j else hit.any():
                near.append((i, j, hit))
    changed = bool(near)
    while changed:
        was = label.copy()
        for i, j, hit in near:
            a, b = label[i : i + TILE], label[j : j + TILE]
            np.minimum(a, np.where(hit, b[None, :], n).min(axis=1), out=a)
            np.minimum(b, np.where(hit, a[:, None], n).min(axis=0), out=b)
        label = label[label]
        changed = bool((label != was).any())
    first = np.empty(n, dtype=np.int64)
    first[order] = order[label]
    return first


def _compare(radius: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch may go on in the next."""
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in _then_none(batches):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            edges = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate([[0], edges, [len(keys)]])
            whole = len(bounds) - 1 if batch is None else len(bounds) - 2
            us, vs = [], []
            for a, b in zip(bounds[:whole], bounds[1 : whole + 1]):
                if b - a < 2:
                    continue
                group = fps[a:b]
                first = _tile_links(group, radius)
                moved = np.flatnonzero(first != np.arange(b - a))
                us.append(group[moved])
                vs.append(group[first[moved]])
            keys, fps = keys[bounds[whole] :], fps[bounds[whole] :]
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], schema=out
                )

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _bands(fp: Column, radius: int) -> Column:
    """An array with one number for each of radius + 1 bands: the band and its bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    part = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(
        *(F.struct(F.lit(k).alias("band"), part(a, b).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    )


def links(classes: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links between distinct fingerprints (column fp) that join all those within the radius.

    Two words of 64 bits that differ in at most ``radius`` bits agree in one of radius + 1 bands, so
    fingerprints are compared where a band agrees. In each such group the links form stars, not all pairs.
    A group of over ``group_rows`` is split by population count and a hash, and every two parts whose
    counts can come within the radius are compared in a group of their own.
    """
    banded = classes.select("fp", F.explode(_bands(F.col("fp"), radius)).alias("b")).select("fp", "b.band", "b.bits")
    large = banded.groupBy("band", "bits").agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    large = large.select("band", "bits", F.ceil(2 * F.col("n") / group_rows).cast("int").alias("parts"))
    step = radius + 1
    level = F.floor(F.bit_count("fp") / step).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    own = level * F.col("parts") + part
    lowest, highest = F.greatest(level - 1, F.lit(0)) * F.col("parts"), (level + 2) * F.col("parts") - 1
    other = F.sequence(lowest, highest)
    dealt = banded.join(large, ["band", "bits"], "left").select(
        "fp",
        "band",
        "bits",
        F.explode(
            F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
                F.transform(other, lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
            )
        ).alias("pair"),
    )
    keyed = dealt.select(F.xxhash64("band", "bits", "pair.a", "pair.b").alias("key"), "fp")
    return (
        keyed.repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_compare(radius), "u long, v long")
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for each document.

    Two documents are linked if their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest id that can be reached by links. Equal fingerprints are one class, counted before the
    shuffle; classes are linked, and each document looks up its class.

    Defined cases: null and empty texts have fingerprint zero and are linked like any other; a text of
    fewer words than a shingle is one shingle; rows that repeat an id each get an answer; a null id is never
    the smallest unless the component has no other, and then component_id is null; other columns
    are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, text, doc_id, words), "fingerprints")
    classes = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = component_roots(links(classes, radius), scratch)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay."""
    found = near_duplicates(docs, text, doc_id, **how)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own_id"))
    return own.join(gone, F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")
