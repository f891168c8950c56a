"""Pack documents into training sequences by an order-preserving dynamic program."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscore.llm.tokens import encoder

WINDOW = 1024
END_ID = 0
#: Costs of a cut, in padded tokens: after a sentence, and elsewhere in a document.
SENTENCE_CUT = 4.0
INNER_CUT = 16.0
#: Inside documents each so many tokens are a place for a cut, besides the ends of sentences.
STRIDE = 32
#: Sequences of these lengths need no padding, as powers of two; shorter ones are not worth a place.
UNPADDED = (128, 256, 512)
#: Tokens that are planned together; a longer document is planned by itself.
SEGMENT_TOKENS = 1 << 20

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a sequence may end in a run of documents, ascending, and what a cut there costs."""
    cost = np.full(len(ids) + 1, np.inf)
    starts = np.concatenate([[0], doc_ends[:-1]])
    inner = np.arange(1, len(ids))
    inner = inner[(inner - starts[np.searchsorted(doc_ends, inner, side="right")]) % stride == 0]
    cost[inner] = INNER_CUT
    cost[1:][sentence_end[np.minimum(ids, len(sentence_end) - 1)] & (ids < len(sentence_end))] = SENTENCE_CUT
    cost[doc_ends] = 0.0
    cost[0] = 0.0
    places = np.flatnonzero(np.isfinite(cost))
    return places, cost[places]


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The cuts, among ``places``, of least padding plus cost, with at most ``window`` tokens between.

    A sequence from place i to place j pads window - (j - i) tokens, so the best way to j takes the
    least value of best(i) - padding saved among the places inside the window. Those values wait in a
    monotone queue, which gives the least of a sliding window in constant time. Sequences of an
    unpadded length are tried beside.
    """
    n = len(places)
    at, price = places.tolist(), cost.tolist()
    short = []
    for length in (x for x in UNPADDED if x < window):
        found = np.minimum(np.searchsorted(places, places - length), n - 1)
        short.append(np.where(places[found] == places - length, found, -1).tolist())
    best, came = [0.0] * n, [0] * n
    queue = deque([(float(at[0]), 0)])
    for j in range(1, n):
        end = at[j]
        while at[queue[0][1]] < end - window:
            queue.popleft()
        value, i = queue[0]
        value += window - end
        for lengths in short:
            k = lengths[j]
            if k >= 0 and best[k] < value:
                value, i = best[k], k
        value += price[j]
        best[j], came[j] = value, i
        key = value + end
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = came[j]
        cuts.append(j)
    return places[cuts[::-1]]


def _pieces(doc_ids: list, bodies: list[bytes], first_sequence: int, sentence_end: np.ndarray, stride: int) -> pa.RecordBatch:
    buffer = b"".join(bodies)
    ids = np.frombuffer(buffer, dtype="<u4")
    doc_ends = np.cumsum([len(b) // 4 for b in bodies])
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    cuts = best_cuts(*cut_places(ids, doc_ends, sentence_end, stride))
    bounds = np.union1d(cuts, np.concatenate([[0], doc_ends]))
    starts, ends = bounds[:-1], bounds[1:]
    doc = np.searchsorted(doc_ends, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right") - 1
    view = memoryview(buffer)
    crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
    columns = (
        pa.array(doc_ids, pa.int64()).take(pa.array(doc)),
        pa.array(starts - doc_starts[doc]),
        pa.array(ends - starts),
        pa.array(crcs, pa.int64()),
        pa.array((doc_ends - doc_starts)[doc]),
        pa.array(sequence + first_sequence),
        pa.array(starts - cuts[sequence]),
    )
    return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], schema=_OUT)


def packed(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    added: tuple[tuple[str, int], ...] = (),
    text: str = "text",
    doc_id: str = "doc_id",
    stride: int = STRIDE,
) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 1024 tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. A document is its ids and the
    end id 0; ``added`` are the vocabulary's added tokens and their ids. Each input partition packs its documents in their order, about a million tokens
    at a time, so nothing is shuffled and a task holds one segment. sequence_id counts within the partition,
    whose number it carries above bit 40; a task that runs again gives the same rows.

    Defined cases: null and empty texts are the end id alone; a long text goes on over many sequences;
    rows that repeat an id are packed one by one; a null id stays null; other columns are ignored; an empty
    table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern, added)
        sequence = TaskContext.get().partitionId() << 40
        doc_ids, bodies, held = [], [], 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                body = encode(value.as_py()) + end
                doc_ids.append(key.as_py())
                bodies.append(body)
                held += len(body) // 4
                if held >= SEGMENT_TOKENS:
                    yield (done := _pieces(doc_ids, bodies, sequence, encode.sentence_end, stride))
                    sequence = done.column(5)[-1].as_py() + 1
                    doc_ids, bodies, held = [], [], 0
        if bodies:
            yield _pieces(doc_ids, bodies, sequence, encode.sentence_end, stride)

    return own.mapInArrow(pack, ", ".join(f"{f.name} long" for f in _OUT))
