"""Near copies by their word shingles: rows meet at a rare shingle, each pair is checked for its exact Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscore.llm.features import mixed
from gapscore.llm.simhash import near_duplicates
from gapscore.llm.work import Scratch

WORDS = 5
#: Similarity of near copies, as a ratio of whole numbers.
NEAR = (4, 5)
SEED = 42
#: Rows of a bucket that the others are compared with: one in the first round, and so many times more in each further one.
LEADERS = 8
#: Shingles are counted in so many cells, which fixes their order from rare to frequent.
CELLS = 1 << 16
_LAST = 2**63 - 1
_REMEMBERED = 200_000
_TIMES = np.random.default_rng(SEED).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> set[bytes]:
    """The runs of five words of a UTF-8 text; a shorter text is one run, and one without words has none."""
    tokens = text.lower().split()
    if not tokens:
        return set()
    return {b" ".join(tokens[i : i + WORDS]) for i in range(max(1, len(tokens) - WORDS + 1))}


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_hashes(text: bytes, words: _WordHashes) -> np.ndarray:
    """The distinct hashes of the runs of five words, sorted."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    of_word = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = max(1, len(tokens) - WORDS + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(WORDS, len(tokens))):
        total += of_word[k : k + n] * _TIMES[k]
    return np.unique(mixed(total))


def prefix_length(size: int) -> int:
    """Of two near sets in one order, each has a common element among so many first ones."""
    return size - -(-NEAR[0] * size // NEAR[1]) + 1


def are_near(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row the digest of its set of shingles; at the end of the task the counts of shingles by cell."""
    words, counts = _WordHashes(), np.zeros(CELLS, dtype=np.int64)
    names = ["id", "no", "digest", "cell", "n"]
    for batch in batches:
        digests = []
        for text in batch.column(2):
            found = shingle_hashes(text.as_py(), words)
            counts += np.bincount(cells(found), minlength=CELLS)
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
        none = pa.nulls(len(batch), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), none, none], names)
    at = np.flatnonzero(counts)
    none = pa.nulls(len(at), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(counts[at])], names)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _prefixes(counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each shingle of a prefix: the rarest shingles of a set, with their place in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            keys, places, sizes = [], [], []
            for text in batch.column(2):
                found = shingle_hashes(text.as_py(), words)
                n = prefix_length(len(found)) if len(found) else 0
                keys.append(found[np.argsort(counts[cells(found)], kind="stable")[:n]])  # ties by hash
                places.append(np.arange(n))
                sizes.append(len(found))
            if not keys:
                continue
            lengths = [len(k) for k in keys]
            repeated = lambda column: pa.array(np.repeat(np.asarray(column, dtype=np.int64), lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    *(repeated(c.to_numpy(zero_copy_only=False)) for c in batch.columns[:2]),
                    repeated(sizes),
                    pa.array(np.concatenate(places).astype(np.int64)),
                ],
                ["key", "id", "no", "size", "place"],
            )

    return run


def can_be_near(n: int, i: int, m: int, j: int) -> bool:
    """Whether sets of n and m elements, of which the first common ones are the i-th and the j-th, can be near."""
    near, whole = NEAR
    return (near + whole) * min(n - i, m - j) >= near * (n + m)


def _dealt(leaders: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by key, id and no. The first rows of a bucket are its leaders; each other, and each leader after the
    first, is paired with the leaders before it that it can be near to. ``rest`` marks one row for each that is no leader."""
    names = ["key", "id", "no", "size", "place", "leader", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            # a key that stands alone meets nothing; at the ends of a batch it may go on
            again = keys[1:] == keys[:-1]
            alone = ~np.concatenate([[True], again]) & ~np.concatenate([again, [True]])
            rows = []
            for key, id_, no, size, place in zip(*(c.to_pylist() for c in batch.filter(pa.array(~alone)).columns)):
                if key != now:
                    now, first = key, []
                rows += [(key, id_, no, size, place, a, False) for a, n, i in first if can_be_near(n, i, size, place)]
                if len(first) >= leaders:
                    rows.append((key, id_, no, size, place, None, True))
                else:
                    first.append((no, size, place))
                if len(rows) > 1 << 16:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of rows whose text is near that of their leader."""
    last, own = None, set()
    for batch in batches:
        found = []
        for no, a, b in zip(*batch.columns):
            if (text := a.as_py()) != last:
                last, own = text, shingles(text)
            if are_near(own, shingles(b.as_py())):
                found.append(no.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["no"])


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without those that are near copies of an earlier row.

    Near are two texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

    Equal sets are merged first. Then SimHash fingerprints, compared in tiles as by operator 9, link rows; each is compared
    exactly with the first row of its component, and near ones go. Fingerprints within 4 bits are a similarity of about 0.97,
    so what is left goes on to a search that is exact for 0.8. The shingles of the table are put into one order, rare before frequent, by counts in
    a fixed number of cells. Two near sets have a common shingle among the first fifth of both, so rows meet there, in
    the bucket of that shingle, and only if their places in both orders leave enough for a similarity of 0.8. A passage
    that many texts share is frequent, so it brings none together unless it is most of them. In a bucket the first
    row is compared with all others, exactly; near ones go. What is left goes on with more leaders, until all that
    stay have been compared. A large group of near copies costs a comparison a row, and a task holds a bucket's leaders only.

    Defined cases: earlier is by id, null ids last, and rows with the same id in the order in which they are read; rows
    count one by one, so a repeated row goes like any other copy; null and texts without words are near each other and
    nothing else; a text of fewer than five words is one run; upper and lower case (A-Z) are the same; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near_copies")
    id_, body = F.coalesce(F.col(f"row.{doc_id}").cast("long"), F.lit(_LAST)), F.coalesce(F.col(f"row.{text}"), F.lit("")).cast("binary")
    identified = lambda df: df.select(id_.alias("id"), "no", body.alias("text"))
    numbered = scratch.keep(
        docs.select(F.struct("*").alias("row")).withColumn("no", F.monotonically_increasing_id()), "numbered"
    )
    profiles = scratch.keep(identified(numbered).mapInArrow(_profiles, "id long, no long, digest binary, cell long, n long"), "profiles")
    counts = np.zeros(CELLS, dtype=np.int64)  # fixed in size
    summed = profiles.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    digests = profiles.where("digest IS NOT NULL")
    groups = digests.groupBy("digest").agg(F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = digests.join(groups.select("digest", F.col("first.no").alias("kept")), "digest").where("no <> kept").select("no")
    # Lists of numbers are written first: Spark then knows their size, and sends a short one to the texts.
    copies = scratch.keep(copies, "copies")
    scratch.drop("profiles")
    classes = scratch.keep(numbered.join(copies, "no", "left_anti").select("no", "row"), "classes")
    scratch.drop("numbered")

    def near_of(pairs: DataFrame, mark: str | int) -> DataFrame:
        """The numbers of the rows of (no, leader) that are near their leader."""
        pairs = scratch.keep(pairs, f"pairs{mark}")
        met = scratch.keep(pairs.select("no").union(pairs.select("leader")).distinct(), f"met{mark}")
        texts = scratch.keep(identified(classes).select("no", "text").join(met, "no", "left_semi"), f"texts{mark}")
        of_leader = texts.select(F.col("no").alias("leader"), F.col("text").alias("leader_text"))
        # the leader's text comes last, so it is shuffled once and each task sees the pairs of a leader in a row
        both = pairs.join(texts, "no").join(of_leader, "leader").select("no", "leader_text", "text")
        near = scratch.keep(both.mapInArrow(_checked, "no long").distinct(), f"near{mark}")
        scratch.drop(f"pairs{mark}", f"met{mark}", f"texts{mark}")
        return near

    linked = near_duplicates(classes.select("no", F.col(f"row.{text}").alias("text")), "text", "no", WORDS)
    of_component = linked.select(F.col("doc_id").alias("no"), "component_id").join(identified(classes).select("no", "id"), "no")
    of_component = scratch.keep(of_component, "components")
    first = of_component.groupBy("component_id").agg(F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("n")).where("n > 1")
    led = of_component.join(first.select("component_id", F.col("first.no").alias("leader")), "component_id").where("no <> leader")
    linked_near = near_of(led.select("no", "leader"), "linked")
    scratch.drop("components")
    own = identified(classes.join(linked_near, "no", "left_anti"))
    buckets = own.mapInArrow(_prefixes(counts), "key long, id long, no long, size long, place long")
    gone, leaders, n = linked_near, 1, 0
    while True:
        sorted_rows = buckets.repartition("key").sortWithinPartitions("key", "id", "no")
        types = "key long, id long, no long, size long, place long, leader long, rest boolean"
        dealt = scratch.keep(sorted_rows.mapInArrow(_dealt(leaders), types), f"dealt{n}")
        scratch.drop(f"dealt{n - 1}")
        if dealt.isEmpty():
            break
        near = near_of(dealt.where(F.col("leader").isNotNull()).select("no", "leader").distinct(), n)
        gone = gone.union(near)
        rest = dealt.where("rest").select("key", "id", "no", "size", "place")
        buckets = rest.join(near, "no", "left_anti").select("key", "id", "no", "size", "place")
        leaders, n = leaders * LEADERS, n + 1
    scratch.drop(f"dealt{n}")
    return classes.join(scratch.keep(gone.distinct(), "gone"), "no", "left_anti").select("row.*")
