"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import WORDS, in_arrow, materialize


def _size(text_col: str) -> Column:
    return F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(WORDS))).cast("long")


def _source(source_col: str) -> list[Column]:
    source = F.col(source_col).cast("string")
    return [source.isNull().alias("s0"), F.coalesce(source, F.lit("")).alias("s1")]


def _turn(id_col: str, text_col: str, seed: str) -> Column:
    """What a source's rows are taken in the order of: a seeded hash of the id, then a hash of the text."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))))
    return F.struct(key.alias("h"), F.xxhash64(text_col).alias("t"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """s0, s1, source_size, target: what each source gives to a mix of as many words as there are.

    Sources in code-point order, null last, weigh ``weights`` in turn. Filled in the order of cap / weight, where the cap
    is ``max_epochs`` times the size, a source is clamped if the level that is left for it and those after it lies above
    its own; the first that isn't sets the level of all that follow. That is the fixed point of clamping and resharing.
    Works on one row for each source; sums are whole numbers, so reruns agree to the bit."""
    whole = sizes.groupBy("s0", "s1").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy("s0", "s1")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int") + 1)
    known = whole.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    known = known.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "s0", "s1").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("cap") / F.col("weight"), "s0", "s1").rowsBetween(0, Window.unboundedFollowing)
    room = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    known = known.withColumn("level", room.cast("double") / F.sum("weight").over(after))
    clamped = F.col("level") > F.col("cap") / F.col("weight")
    known = known.withColumn("own", F.when(~clamped, F.col("level"))).withColumn("height", F.first("own", ignorenulls=True).over(Window.orderBy(F.col("cap") / F.col("weight"), "s0", "s1").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(clamped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("height"))
    return known.select("s0", "s1", "source_size", target.alias("target"))


def shares(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, buckets: int = 3) -> DataFrame:
    """One row for each source of ``sizes`` (s0, s1, turn, size): source_size, target, whole (full repetitions), cut and
    part. Once more are taken the rows whose turn comes before ``cut``, and of those at ``cut`` ``part`` words each, so
    that the source's words equal its target rounded down.

    Sums by the first ``buckets`` hex digits of the hash come first; only the one bucket in which a source's quota ends
    is ordered row by row, so a source with most of the rows isn't one task's work."""
    goal = targets(sizes, weights, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("quota", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    goal = materialize(goal, "targets")
    bucket = F.substring("turn.h", 1, buckets).alias("bucket")
    sums = sizes.groupBy("s0", "s1", bucket).agg(F.sum("size").alias("sum"))
    run = F.sum("sum").over(Window.partitionBy("s0", "s1").orderBy("bucket"))
    ends = sums.withColumn("upto", run).join(goal.select("s0", "s1", "quota"), ["s0", "s1"])
    ends = ends.where("upto >= quota and upto - sum < quota").select("s0", "s1", "bucket", (F.col("quota") - F.col("upto") + F.col("sum")).alias("room"))
    rows = sizes.select("s0", "s1", bucket, "turn", "size").join(ends, ["s0", "s1", "bucket"]).groupBy("s0", "s1", "room", "turn").agg(F.sum("size").alias("all"), F.count("*").alias("n"))
    ahead = F.sum("all").over(Window.partitionBy("s0", "s1").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("all")
    last = rows.withColumn("ahead", ahead).where("ahead < room and room <= ahead + all")
    last = last.select("s0", "s1", F.col("turn").alias("cut"), F.floor((F.col("room") - F.col("ahead")) / F.col("n")).cast("long").alias("part"))
    return materialize(goal.drop("quota").join(last, ["s0", "s1"], "left"), "shares")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", buckets: int = 3) -> DataFrame:
    """doc_id, size, source, source_size, target, whole (full repetitions), part (words of one more) and taken of each row.

    Every document of a source is repeated as often as its target holds the whole source; the words still missing come
    from its documents in the order of a seeded hash, each at most once, the last one only in part (:func:`shares`). So a
    source's taken words equal its target rounded down, and no document exceeds ``max_epochs`` times its size. Texts are
    read once; a row finds its share by its source, among one row for each source, without a shuffle by row.

    Null and blank texts have size 0 and nothing is taken from them; a null source is a source of its own, after all
    others; rows that repeat id and text share equally what the quota leaves for them, rounded down. A null id is hashed
    as an empty one. An empty table gives an empty one. Only DataFrame functions are used."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_source(source_col), _turn(id_col, text_col, seed).alias("turn"), _size(text_col).alias("size"))
    rows = materialize(rows, "sizes")
    both = rows.join(shares(rows, weights, max_epochs, buckets), ["s0", "s1"])
    part = F.when(F.col("turn") < F.col("cut"), F.col("size")).when(F.col("turn") == F.col("cut"), F.col("part")).otherwise(F.lit(0).cast("long"))
    both = both.withColumn("part", part)
    return both.select("doc_id", "size", F.when(~F.col("s0"), F.col("s1")).alias("source"), "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def _prefixes(batches):
    import re

    import pyarrow as pa

    word = re.compile(WORDS)
    for batch in batches:
        texts, words = batch.column("text"), batch.column("words")
        out = []
        for i in range(batch.num_rows):
            text, n = texts[i].as_py(), words[i].as_py()
            if text is not None and n is not None:
                end = 0
                for k, found in enumerate(word.finditer(text)):
                    if k == n:
                        break
                    end = found.end()
                text = text[:end]
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])


def mixed_rows(docs: DataFrame, cut_last: bool = True, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs`` (doc_id, text, source and any others; n_chars fitted to the text):
    each row as many times as it is repeated, then once more with its first words if a part of it is taken. Without
    ``cut_last`` the document in which a source's quota ends is taken whole, so a source may exceed its target by less
    than that text, and all is done by DataFrame functions.

    Rows of which nothing is taken are left out: those without words, and those behind the cut of a source whose target
    is below its size. Rows that repeat an id or are equal, null ids and null sources are all mixed as :func:`mix` says.
    Texts stay where they are: a row finds its share by its source. Columns may have any names; an empty table gives an
    empty one."""
    schema = docs.schema
    sizes = docs.select(*_source("source"), _turn("doc_id", "text", seed).alias("turn"), _size("text").alias("size"))
    known = shares(materialize(sizes, "sizes"), weights, max_epochs)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *_source("source"), _turn("doc_id", "text", seed).alias("turn")).where(F.col("row.text").rlike(WORDS)).join(known, ["s0", "s1"])
    none, full, cut = (F.array().cast("array<long>"), F.array(F.lit(None).cast("long")), F.array("part"))
    last = full if not cut_last else F.when(F.col("part") < F.regexp_count(F.col("row.text"), F.lit(WORDS)), cut).otherwise(full)
    last = F.when(F.col("turn") < F.col("cut"), full).when((F.col("turn") == F.col("cut")) & (F.col("part") > 0), last).otherwise(none)
    rows = rows.select("row", F.explode(F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("whole").cast("int")), last)).alias("words"))
    if not cut_last:
        return rows.select("row.*")
    rows = in_arrow(rows.select("row", F.col("row.text").alias("text"), "words"), _prefixes, StructType([StructField("row", schema), StructField("text", StringType())]))
    values = {c: F.col("row")[c] for c in schema.names} | {"text": F.col("text")}
    if "n_chars" in schema.names:
        values["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(schema["n_chars"].dataType)
    return rows.select(*(values[c].alias(c) for c in schema.names))
