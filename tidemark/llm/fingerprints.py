"""Canonical exact digests of documents: normal form, folded case and white space, wide hash, byte comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions


def canonical(text: Column) -> Column:
    """Unicode form NFKC, folded case (lower of upper, so that final forms agree), white space runs as one
    space, trimmed. Null is empty."""
    form = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.trim(F.regexp_replace(F.lower(F.upper(form)), r"[\s\p{Z}]+", " "))


def wide(canon: Column) -> Column:
    """128 bits as 32 hex digits: two runs of xxhash64, the second seeded by the hash of another column."""
    part = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("second"), canon)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fingerprint, canon, group_id and copies of each canonical text: rows of a fingerprint compared byte by byte."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col)).alias("canon")).withColumn("fingerprint", wide(F.col("canon")))
    return rows.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id (smallest id with the same canonical text) and copies of every row.

    Rows meet by fingerprint and their canonical bytes are compared there: a fingerprint whose smallest and largest
    bytes differ holds several groups, which are then told apart by the bytes themselves. Partial aggregation leaves one
    row of a text for each task, so a text that a third of all rows share isn't one task's work. Null texts are like
    empty ones; rows may repeat; a null id never names a group unless all its ids are null."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col)).alias("canon")).withColumn("fingerprint", wide(F.col("canon")))
    texts = _texts(docs, id_col, text_col)
    kinds = texts.groupBy("fingerprint").agg(F.count("*").alias("kinds"), F.min("group_id").alias("one"), F.max("copies").alias("n"))
    single = rows.select("doc_id", "fingerprint").join(kinds.where("kinds = 1"), "fingerprint").select("doc_id", "fingerprint", F.col("one").alias("group_id"), F.col("n").alias("copies"))
    mixed = rows.join(kinds.where("kinds > 1").select("fingerprint"), "fingerprint").join(texts, ["fingerprint", "canon"]).select("doc_id", "fingerprint", "group_id", "copies")
    return single.unionByName(mixed)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and next_text: the text of the row with the next id, the first row's after the last.

    Ids are cut at quantiles into ranges; the first row of each range is copied to the range before it, the first of
    all to the last range, behind all others. So each range is complete in itself, and no task orders more than one.
    Null ids come before all others; rows with equal ids follow each other in the order of their texts' hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = 4 * partitions(docs.sparkSession)
    lowest = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "tie"))
    edge = rows.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(-(1 << 63))), [i / parts for i in range(1, parts)], 20 * parts), lowest).first()
    first = edge[1]
    bounds = sorted(set(edge[0] or []) - {first["k"]} if first else [])
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    # a range begins at each bound, which is an id of the table; the range of an id is found by binary search
    firsts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>") if bounds else F.array().cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length())))) if bounds else F.array().cast("array<int>")
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(firsts, at + step - 1) <= key, at + step).otherwise(at))
    placed = rows.withColumn("k", key).withColumn("part", part)
    begins = (F.col("part") > 0) & (F.get(firsts, F.col("part") - 1) == F.col("k"))
    halo = F.when(begins, F.array(F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("role")))).otherwise(F.array().cast("array<struct<part:int,role:int>>"))
    top = len(bounds)
    if first is None:
        return rows.select("doc_id", "text", F.lit("").alias("next_text"))
    wrap = F.when((F.col("k") == F.lit(first["k"])) & (F.col("tie") == F.lit(first["tie"])), F.array(F.struct(F.lit(top).alias("part"), F.lit(2).alias("role")))).otherwise(F.array().cast("array<struct<part:int,role:int>>"))
    copies = placed.withColumn("at", F.explode(F.concat(F.array(F.struct(F.col("part"), F.lit(0).alias("role"))), halo, wrap))).select("doc_id", "text", "k", "tie", F.col("at.part").alias("part"), F.col("at.role").alias("role"))
    order = Window.partitionBy("part").orderBy("role", "k", "tie")
    return copies.withColumn("next_text", F.lead("text").over(order)).where("role = 0").select("doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last half (rounded down) of its code points gives
    way to as many of the next document's first ones, or all of them. A digest is exact, so likenesses are 1.0 where the
    canonical bytes agree and 0.0 elsewhere. Null and empty texts are edited to empty ones."""
    both = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.withColumn("edited", edited)
    canon = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("own"), canonical(F.col("edited")).alias("other"), canonical(F.col("next_text")).alias("after"))
    like = lambda c: (F.col("own") == F.col(c)).cast("double")
    return canon.select("doc_id", "n_chars", "edited_sha256", wide(F.col("own")).alias("fingerprint"), wide(F.col("other")).alias("edited_fingerprint"), like("other").alias("near_edited"), like("after").alias("near_next"), *[F.sha2("own", 256).alias("check")] * check)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`edited_fingerprints` with group_id and copies of :func:`exact_groups`."""
    texts = _texts(docs, id_col, text_col).withColumn("check", F.sha2("canon", 256))
    kinds = texts.groupBy("fingerprint").agg(F.collect_list(F.struct("check", "group_id", "copies")).alias("kinds"))
    rows = edited_fingerprints(docs, id_col, text_col, check=True).join(kinds, "fingerprint")
    mine = F.filter("kinds", lambda k: k["check"] == F.col("check"))[0]
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", mine["group_id"].alias("group_id"), mine["copies"].alias("copies"))
