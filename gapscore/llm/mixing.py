"""Mix sources to target weights, in blocks of words.

Every source is a stream of words cut into blocks of fixed length. The mix is a sequence of slots in
output shards; each slot takes one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscore.llm.work import Scratch

# Fixed value: a word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
#: Slots of an output shard, on average.
SHARD_SLOTS = 4096
MAX_REPEATS = 3
SEED = "mix"
#: Rows that are put into order together, and parts whose sums are added up together.
BUCKET_ROWS, PARTS = 1024, 1024
#: Slots, or blocks, that one row gives rise to, and so many such rows a task.
CHUNK, CHUNKS_PER_TASK = 4096, 64
_KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets in words, from one row (source, source_size, rows) for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. No
    target exceeds MAX_REPEATS times its size. What is left over is shared by weight again until
    none does: sources fill up in the order of cap over weight, and those after the last full one
    share what remains at one level. Returns source, source_rank, source_size, rows, target, blocks (in
    the source) and draws (blocks that the mix takes).
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    filling = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    level = lambda cap, w: (F.col("total") - cap).cast("double") / (F.col("weights") - w).cast("double")
    ranked = (
        sizes.withColumn("source_rank", F.row_number().over(in_order).cast("long"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", MAX_REPEATS * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("full", F.col("ratio") <= level(before("cap"), before("weight")))
        .withColumn("full_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("full_weight", F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        level(F.col("full_cap"), F.col("full_weight")) * F.col("weight").cast("double")
    )
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)).cast("long")
    draws = F.when(F.col("source_size") == 0, 0).otherwise(
        F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)
    )
    return ranked.withColumn("target", target).withColumn("blocks", blocks).select(
        "source", "source_rank", "source_size", "rows", "target", "blocks", draws.cast("long").alias("draws")
    )


def drawn_key(*parts: Column) -> Column:
    """A number of 60 bits for the parts and the seed, by MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("long")


def _bucket(key: Column, buckets: Column) -> Column:
    """The part of the key's range, of ``buckets`` equal ones, that a key lies in."""
    # 30 bits are enough for the product to fit; more buckets than that share one now and then
    return F.shiftright(F.shiftright(key, _KEY_BITS - 30) * buckets.cast("long"), 30)


def _starts(rows: DataFrame, keys: list[str], bucket: str, value: Column) -> DataFrame:
    """(keys, bucket, first): the sum of ``value`` over the buckets before, in two levels, so that no task sees all buckets."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("n")).withColumn("part", F.floor(F.col(bucket) / PARTS))
    before = lambda part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("inside", F.coalesce(F.sum("n").over(before([*keys, "part"]).orderBy(bucket)), F.lit(0)))
    parts = sums.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    parts = parts.select(*keys, "part", F.coalesce(F.sum("n").over(before(keys).orderBy("part")), F.lit(0)).alias("outside"))
    return inside.join(parts, [*keys, "part"]).select(*keys, bucket, (F.col("inside") + F.col("outside")).cast("long").alias("first"))


def placed(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds source_rank and start: the words of the source before this row, in the order of ``key``.

    ``docs`` has source, size and key, a pseudorandom number of the row's id and text, so rows fall evenly into
    buckets of about ``BUCKET_ROWS`` whatever the ids are. Buckets are summed by themselves, and then one number for each.
    """
    ranked = docs.join(
        targets.select(F.col("source").alias("t_source"), "source_rank", F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets")),
        F.col("source").eqNullSafe(F.col("t_source")),
    ).select(*docs.columns, "source_rank", _bucket(F.col("key"), F.col("buckets")).alias("bucket"))
    firsts = _starts(ranked, ["source_rank"], "bucket", F.col("size"))
    inside = Window.partitionBy("source_rank", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(firsts, ["source_rank", "bucket"])
        .select(*docs.columns, "source_rank", (F.col("first") + F.col("inside")).cast("long").alias("start"))
    )


def _numbered(targets: DataFrame, count: str, name: str) -> DataFrame:
    """One row for each number below the column ``count``, made by many tasks."""
    total = targets.agg(F.sum(F.ceil(F.col(count) / CHUNK))).first()[0] or 0  # one row a source
    chunks = targets.where(F.col(count) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col(count) - 1, F.lit(CHUNK))))
    dealt = chunks.repartition(max(1, math.ceil(total / CHUNKS_PER_TASK)), "source_rank", "chunk")
    last = F.least(F.col("chunk") + CHUNK, F.col(count)) - 1
    return dealt.withColumn(name, F.explode(F.sequence(F.col("chunk"), last))).drop("chunk")


def slots(targets: DataFrame) -> DataFrame:
    """One row for each slot of the mix: shard, source_rank, draw, index.

    Each draw of a source goes to a pseudorandom output shard, so the counts of the sources in the shards are multinomial
    under the condition that those of the whole mix come out at the targets. ``index`` is the draw's place in
    the source's permutation, from the start again when all blocks are used.
    """
    total = targets.agg(F.sum("draws")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_SLOTS))
    shard = _bucket(drawn_key(F.lit("draw"), F.col("source_rank"), F.col("draw")), F.lit(shards))
    draws = _numbered(targets.select("source_rank", "blocks", "draws"), "draws", "draw")
    return draws.select(shard.alias("shard"), "source_rank", "draw", (F.col("draw") % F.col("blocks")).alias("index"))


def shard_counts(drawn: DataFrame) -> DataFrame:
    """The multinomial counts: slots of each source in each output shard."""
    return drawn.groupBy("shard", "source_rank").agg(F.count("*").alias("slots"))


def permuted_blocks(targets: DataFrame) -> DataFrame:
    """One row for each block: source_rank, block, index. The index is a pseudorandom permutation of each source.

    Blocks are in the order of a keyed number; buckets of its range are ordered by themselves and then added up.
    """
    own = _numbered(targets.select("source_rank", "blocks"), "blocks", "block")
    keyed = own.withColumn("key", drawn_key(F.lit("block"), F.col("source_rank"), F.col("block")))
    keyed = keyed.withColumn("bucket", _bucket(F.col("key"), F.ceil(F.col("blocks") / BUCKET_ROWS)))
    place = F.row_number().over(Window.partitionBy("source_rank", "bucket").orderBy("key", "block")) - 1
    firsts = _starts(keyed, ["source_rank"], "bucket", F.lit(1))
    return keyed.withColumn("place", place).join(firsts, ["source_rank", "bucket"]).select(
        "source_rank", "block", (F.col("first") + F.col("place")).alias("index")
    )


def pieces(rows: DataFrame, key: list[str]) -> DataFrame:
    """The part of each row in each block of its source: ``key``, block, from_word and words."""
    end = F.col("start") + F.col("size")
    block = F.explode(
        F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS)).cast("array<long>")
    )
    first = F.greatest(F.col("block") * BLOCK_WORDS, F.col("start"))
    last = F.least((F.col("block") + 1) * BLOCK_WORDS, end)
    return (
        rows.where(F.col("size") > 0)
        .select(*key, "size", block.alias("block"))
        .select(*key, "block", (first - F.col("start")).alias("from_word"), (last - first).alias("words"))
    )


_ROW = ["source_rank", "start", "size"]


def mix(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix itself: shard, draw, the row it reads (source_rank, start, size), from_word, words."""
    # A few rows of chunks become all slots; by the size of those rows Spark would broadcast them.
    dealt = slots(targets).hint("merge").join(permuted_blocks(targets).hint("merge"), ["source_rank", "index"])
    return dealt.join(pieces(rows, _ROW).hint("merge"), ["source_rank", "block"])


def _sized(docs: DataFrame, columns: list[str | Column], text: str, source: str, doc_id: str) -> DataFrame:
    """The columns with source, size and key."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = drawn_key(F.lit("row"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(body))
    return docs.select(*columns, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"))


def _targets(rows: DataFrame, scratch: Scratch) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    return scratch.keep(source_targets(sizes), "targets")


def mixed_words(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source_size, target, taken and first_shard, a row for each row of ``docs``. ``taken`` counts
    repeats; as no block is drawn more than MAX_REPEATS times, it is at most that often the size. ``first_shard`` is the first
    output shard that takes words of the row, or null.

    Defined cases: a null source is a source, the last; a null text has no words and is taken zero
    times; ids may be null or repeated, as rows are ordered by a number of id and text; equal rows lie one after the
    other; without any words all targets are zero; other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    rows = scratch.keep(_sized(own, ["doc_id"], "text", "source", "doc_id"), "sized")
    targets = _targets(rows, scratch)
    rows = scratch.keep(placed(rows, targets).drop("key"), "placed")
    scratch.drop("sized")
    taken = mix(rows, targets).groupBy(*_ROW).agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    return (
        rows.join(taken, _ROW, "left")
        .join(targets.select("source_rank", "source_size", "target"), "source_rank")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")
    )


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix as documents: a row for each time that (part of) a document is taken.

    The first copy of a document holds its blocks that are drawn at all, the second those drawn at
    least twice, and so on, in the document's order. White space between kept words stays as it is.
    A document that is not drawn is left out. The columns are those of ``docs``, with ``text`` cut to
    the copy and ``n_chars``, if there is one, counted anew. Defined cases as in ``mixed_words``.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = _sized(docs, [F.struct("*").alias("row")], text, source, doc_id)
    targets = _targets(own, scratch)
    rows = scratch.keep(placed(own, targets).drop("key"), "placed")
    # all blocks of a source are drawn equally often, and the first of its permutation once more
    per_block = targets.select("source_rank", F.col("blocks").alias("of"), "draws")
    times = F.floor(F.col("draws") / F.col("of")) + (F.col("index") < F.col("draws") % F.col("of")).cast("long")
    drawn = permuted_blocks(targets).join(per_block, "source_rank").select("source_rank", "block", times.alias("times"))
    drawn = drawn.where("times > 0")
    parts = (
        pieces(rows.select(*_ROW), _ROW)
        .hint("merge")
        .join(drawn.hint("merge"), ["source_rank", "block"])
        .groupBy(*_ROW)
        .agg(F.array_sort(F.collect_list(F.struct("from_word", "words", "times"))).alias("parts"))
    )
    parts = scratch.keep(parts, "parts")
    copy = F.explode(F.sequence(F.lit(1), F.array_max(F.col("parts.times")).cast("int")))
    words = F.regexp_extract_all(F.col("whole"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    kept = F.filter("parts", lambda p: p["times"] >= F.col("copy"))
    piece = lambda w, p: F.array_join(F.slice(w, (p["from_word"] + 1).cast("int"), p["words"].cast("int")), "")
    # The words are split inside an array of one, so once a row, and only for copies that are not whole.
    cut = F.get(F.transform(F.array(words), lambda w: F.array_join(F.transform("kept", lambda p: piece(w, p)), "")), 0)
    whole = F.aggregate("kept", F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("size")
    cut = F.when(whole, F.col("whole")).otherwise(cut)
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out[text] = F.col("cut")
    if "n_chars" in out:
        out["n_chars"] = F.char_length("cut").cast(docs.schema["n_chars"].dataType)
    return (
        rows.join(parts, _ROW)
        .select("row", "size", "parts", copy.alias("copy"))
        .select("row", "size", F.col(f"row.{text}").alias("whole"), kept.alias("kept"))
        .select("row", cut.alias("cut"))
        .select(*(v.alias(k) for k, v in out.items()))
    )
