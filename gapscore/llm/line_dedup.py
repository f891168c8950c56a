"""Repeated passages: content-defined chunks of lines, compared over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscore.llm.work import Scratch

#: A chunk ends after a line where the rolling hash of this line and the one before is a multiple of DIVISOR, but
#: not so one line earlier. Where it ends depends on three lines only, and between two ends lie at least two
#: lines, four on average.
DIVISOR = 2
BASE = 31
#: A chunk is compared if it has so many lines that are not blank.
MIN_LINES = 2
#: The column in which ``without_repeated_passages`` finds the places of chunks.
GONE = "_chunks_gone"
_LAST = 2**63 - 1


def _chunked(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, whole (the text's MD5), lines, and starts: the first line of each chunk."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    number = lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    rolled = lambda i: F.element_at("hashes", i) + BASE * F.coalesce(F.get("hashes", i - 2), F.lit(0))
    # line i starts a chunk if one ends with line i-1; the first always does, the second never
    starts = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: (i == 0)
        | F.when(i > 1, (rolled(i) % DIVISOR == 0) & (rolled(i - 1) % DIVISOR != 0)).otherwise(False),
    )
    return (
        docs.select(
            F.col(doc_id).alias("id"),
            F.md5(F.coalesce(F.col(text), F.lit(""))).alias("whole"),
            lines.alias("lines"),
            F.transform(lines, number).alias("hashes"),
        )
        .select("id", "whole", "lines", starts.alias("starts"))
    )


def _chunk_text(k: Column) -> Column:
    """The text of the k-th chunk, from 0."""
    start = F.get("starts", k)
    end = F.coalesce(F.get("starts", k + 1), F.size("lines"))
    return F.array_join(F.slice("lines", start + 1, end - start), "\n")


def _occurrences(chunked: DataFrame, by_text: bool) -> DataFrame:
    """A row for each chunk with enough lines: id, whole, k, at (its place in the order of the table), body.

    Places are ordered by id and k, or with ``by_text`` by id, text and k.
    """
    first = F.coalesce(F.col("id"), F.lit(_LAST)).cast("decimal(20,0)")
    at = (first * F.lit(2**31).cast("decimal(11,0)") + F.col("k")).cast("decimal(38,0)")
    if by_text:
        at = F.struct(F.col("id").isNull().alias("no_id"), "id", "whole", "k")
    solid = F.size(F.filter(F.split("body", "\n"), lambda line: F.trim(line) != ""))
    return (
        chunked.select("id", "whole", "lines", "starts", F.explode(F.sequence(F.lit(0), F.size("starts") - 1)).alias("k"))
        .select("id", "whole", "k", _chunk_text(F.col("k")).alias("body"))
        .where(solid >= MIN_LINES)
        .withColumn("at", at)
    )


def without_repeated_chunks(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    hash_of=F.md5,
    counts: bool = True,
    gone: str | None = None,
) -> DataFrame:
    """Every chunk of two or more lines stays where it occurs first, by id and place, and goes elsewhere.

    Returns ``docs`` with ``text`` cut, ``n_chars`` (if there is one) counted anew, and with ``counts`` two new
    columns, n_lines and n_removed, the lines before and those removed; columns of these names are replaced.
    With ``gone`` nothing is cut: a new column of that name has the first and last line, from 0, of each chunk that
    would go (null: none), and of rows with the same id the order is that of the text's MD5.

    Chunks meet under their MD5 (``hash_of``) with their text beside it as a grouping key, so Spark compares
    the bytes; they are counted before the shuffle. If a hash stands for two different texts, its chunks
    are kept. Places to remove are looked up by hash, without the texts.

    Defined cases: a null text has one empty line and stays null; null ids come last; rows with the same
    id and text share their answer; of rows with the same id but different texts the order is that of the
    chunk's place; chunks of blank lines are left alone; a text whose chunks all go becomes empty and its
    row stays; an empty table gives no rows.
    """
    occurrences = _occurrences(_chunked(docs, text, doc_id), gone is not None)
    repeated = (
        occurrences.select(hash_of("body").alias("hash"), "body", "at")
        .groupBy("hash", "body")
        .agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .groupBy("hash")
        .agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n"))
        .where((F.col("texts") == 1) & (F.col("n") > 1))
        .select("hash", "first")
    )
    removed = (
        occurrences.select("id", "whole", "k", "at", hash_of("body").alias("hash"))
        .join(repeated, "hash")
        .where(F.col("at") > F.col("first"))
        .groupBy(F.col("id").alias("r_id"), F.col("whole").alias("r_whole"))
        .agg(F.collect_set("k").alias("gone"))
    )
    own = docs.select(
        F.struct("*").alias("row"),
        F.col(doc_id).alias("id"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("whole"),
    )
    joined = own.join(
        removed, (F.col("whole") == F.col("r_whole")) & F.col("id").eqNullSafe(F.col("r_id")), "left"
    ).select(
        F.struct("row", "gone").alias("kept"),
        F.when(F.col("gone").isNotNull(), F.col(f"row.{text}")).alias("body"),  # the rest is not cut up again
    )
    stay = F.filter(F.sequence(F.lit(0), F.size("starts") - 1), lambda k: ~F.array_contains("gone", k))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("lines"))
    lost = F.aggregate("gone", F.lit(0), lambda n, k: n + end(k) - F.get("starts", k))
    places = F.transform("gone", lambda k: F.struct(F.get("starts", k).alias("a"), (end(k) - 1).alias("b")))
    before = F.col("row").getField(text)
    again = _chunked(joined, "body", "kept").select("id.row", "id.gone", "lines", "starts")
    if gone:
        placed = again.select("row", places.alias("places"))
        return placed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != gone), F.col("places").alias(gone))
    cut = (
        again.select(
            "row",
            F.when(F.col("gone").isNull(), before)
            .otherwise(F.array_join(F.transform(stay, _chunk_text), "\n"))
            .alias("cut"),
            F.size(F.split(F.coalesce(before, F.lit("")), "\n")).alias("n_lines"),
            F.coalesce(lost, F.lit(0)).alias("n_removed"),
        )
    )
    added = ["n_lines", "n_removed"] if counts else []
    out = {c: F.col("row").getField(c) for c in docs.columns if c not in added}
    out[text] = F.col("cut")
    if "n_chars" in out:
        out["n_chars"] = F.char_length(F.coalesce("cut", F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(v.alias(c) for c, v in out.items()), *added)


def _pairs(docs: DataFrame, text: str, doc_id: str, hash_of) -> DataFrame:
    """A row for each two lines of a document with only blank lines between: at (its place in the order of the
    table, ending with the numbers of both lines) and hash."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    solid = F.filter(numbers, lambda i: F.btrim(F.get("lines", i), F.lit(" \t\r")) != "")
    own = docs.select(
        F.col(doc_id).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("whole"), lines.alias("lines")
    ).select("id", "whole", "lines", solid.alias("solid"))
    pairs = F.transform(
        F.slice(F.sequence(F.lit(0), F.size("solid")), 1, F.greatest(F.size("solid") - 1, F.lit(0))),
        lambda j: F.struct(
            F.get("solid", j).alias("a"),
            F.get("solid", j + 1).alias("b"),
            hash_of(_pair_text(F.get("solid", j), F.get("solid", j + 1))).alias("hash"),
        ),
    )
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "whole", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    return own.select("id", "whole", F.explode(pairs).alias("pair")).select(at.alias("at"), "pair.hash")


def _pair_text(a: Column, b: Column) -> Column:
    return F.concat_ws("\n", F.get("lines", a), F.get("lines", b))


def without_repeated_passages(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    hash_of=lambda body: F.unhex(F.md5(body)),
    with_chunks: DataFrame | None = None,
) -> DataFrame:
    """Every passage of two or more lines that are not blank stays where it occurs first, by id, and goes elsewhere.

    A passage is repeated where each two lines in a row, blank lines aside, are; so a row of the shuffle is a
    pair's hash and place, and passages of any length are found wherever they begin. Both lines of a repeated pair go,
    and the blank lines between. No line's only copy goes: where a line occurs first, so do its pairs.
    Hashes that repeat are then compared by their text (a grouping key); one that stands for different
    texts removes nothing.

    ``with_chunks``, the documents from ``without_repeated_chunks`` with their places in a column GONE, cuts its chunks as
    well. They are judged on the same texts in the same order, so that what a chunk leaves of a passage is still found.

    Returns ``docs`` with ``text`` cut and ``n_chars`` (if there is one) counted anew. Defined cases: a null text
    stays null; null ids come last; of rows with the same id the order is that of the text's MD5, and
    rows with the same id and text share their answer; in a run of equal lines the first two stay; a text whose lines
    all go becomes empty and its row stays; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    pairs = _pairs(docs, text, doc_id, hash_of)
    first = pairs.groupBy("hash").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    found = scratch.keep(pairs.join(first.select("hash", "first"), "hash"), "found")
    own = docs.select(
        F.struct("*").alias("row"),
        F.col(doc_id).alias("own_id"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("own_whole"),
    )

    def beside(places: DataFrame, how: str) -> DataFrame:
        """``own`` with what ``places`` has for the document."""
        same = (F.col("own_whole") == F.col("whole")) & F.col("own_id").eqNullSafe(F.col("id"))
        return own.join(places, same, how)

    lines = F.split(F.coalesce(F.col("row").getField(text), F.lit("")), "\n")
    marked = found.groupBy("at.id", "at.whole").agg(F.collect_set(F.struct("at.a", "at.b", "hash")).alias("marks"))
    texts = (
        beside(marked, "inner")
        .select(lines.alias("lines"), F.explode("marks").alias("m"))
        .select("m.hash", _pair_text(F.col("m.a"), F.col("m.b")).alias("body"))
        .groupBy("hash", "body")
        .agg(F.lit(1).alias("one"))
    )
    clashing = scratch.keep(texts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "clashing")
    # in a run of equal lines a pair may begin inside its first occurrence, which stays
    inside = (F.col("at.id").eqNullSafe(F.col("first.id"))) & (F.col("at.whole") == F.col("first.whole")) & (F.col("at.a") == F.col("first.b"))
    gone = (
        found.where("at > first")
        .join(clashing, "hash", "left_anti")
        .select("at.id", "at.whole", (F.col("at.a") + inside.cast("int")).alias("a"), F.col("at.b").alias("b"))
    )
    if with_chunks is not None:
        whole = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("whole")
        # written whole: a filter would be moved into the steps that compute the places, which would then run for each chunk
        chunks = scratch.keep(with_chunks.select(F.col(doc_id).alias("id"), whole, GONE), "chunks")
        gone = gone.unionByName(chunks.select("id", "whole", F.explode(GONE).alias("chunk")).select("id", "whole", "chunk.a", "chunk.b"))
    gone = gone.groupBy("id", "whole").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    stay = F.array_except(
        F.sequence(F.lit(0), F.size("lines") - 1), F.flatten(F.transform("gone", lambda g: F.sequence(g.a, g.b)))
    )
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    before = F.col("row").getField(text)
    cut = (
        beside(gone, "left")
        .select("row", "gone", F.when(F.col("gone").isNotNull(), lines).alias("lines"))
        .select("row", F.when(F.col("gone").isNull(), before).otherwise(left).alias("cut"))
    )
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out[text] = F.col("cut")
    if "n_chars" in out:
        out["n_chars"] = F.char_length(F.coalesce("cut", F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(v.alias(c) for c, v in out.items()))
