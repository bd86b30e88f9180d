"""I-Match fingerprints: hashes of a document's terms within a band of frequency, over several random lexicons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkcomm.llm.common import SPACE, let
from sparkcomm.session import materialize

#: Terms go by their md5: its first DIGITS hexadecimal digits are a feature (2^20, whose lexicon is a bit map of 128 KB), the
#: next one deals the terms over DRAWINGS random lexicons, and the three after that thin each lexicon to the shares LIMITS / 4,096;
#: the first takes in every term, so the drawings together hold the whole band.
DIGITS, DRAWINGS, LIMITS = 5, 16, ("g", "400", "100", "040", "010")
#: The band: in at least LEAST documents, and at most one of MOST documents (two in small tables).
LEAST, MOST = 2, 20
SIZE, NONE = 6, "------"


def terms(text: Column) -> Column:
    """md5 of the distinct lower-case words; null counts as empty."""
    return F.transform(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)), lambda t: F.md5(t))


def in_lexicon(h: Column, limit: str) -> Column:
    return F.substring(h, DIGITS + 2, 3) < limit


def _number(h: Column) -> Column:
    return F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("int")


def lexicon(docs: DataFrame, *, text: str = "text", least: int = LEAST, most: int = MOST) -> Column:
    """The band of all rows as a constant array of 64-bit words, a bit per feature. At most 16,384 words come to the driver."""
    n = docs.count()
    number = F.transform(terms(F.col(text)), _number)
    features = docs.select(F.explode(F.array_distinct(number)).alias("f"))
    band = features.groupBy("f").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") <= max(2, n // most)))
    bits = band.groupBy(F.shiftright("f", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("f").bitwiseAND(63))).alias("bits"))
    table = [0] * (16**DIGITS // 64)
    for r in bits.collect():
        table[r["at"]] = r["bits"]
    return F.from_json(F.lit(str(table)), "array<bigint>")


def fingerprint(text: Column, band: Column) -> Column:
    """SIZE digits for each lexicon: a hash of the sorted terms of the text that it holds, NONE if it holds none.

    A text none of whose terms is in any lexicon has a hash of all its terms instead.
    """

    def known(h: Column) -> Column:
        return F.getbit(F.element_at(band, F.shiftright(_number(h), 6) + 1), _number(h).bitwiseAND(63)) == 1

    def thinned(limit: str) -> Callable[[Column], Column]:
        return lambda h: in_lexicon(h, limit)

    def of_drawing(held: Column, drawing: int) -> Column:
        mine = F.filter(held, lambda h: F.substring(h, DIGITS + 1, 1) == f"{drawing:x}")
        each = lambda x: F.concat(*[_hash(x) if limit == LIMITS[0] else let(F.filter(x, thinned(limit)), _hash) for limit in LIMITS])
        return let(mine, lambda x: F.when(F.size(x) == 0, F.lit(NONE * len(LIMITS))).otherwise(each(x)))

    def lexicons(held: Column) -> Column:
        return F.concat(*[of_drawing(held, d) for d in range(DRAWINGS)])

    def whole(every: Column) -> Column:
        held = F.array_sort(F.filter(every, known))
        return let(held, lambda x: F.when(F.size(x) == 0, F.concat(F.lit("all-"), F.md5(F.array_join(F.array_sort(every), "")))).otherwise(lexicons(x)))

    return let(terms(text), whole)


def _hash(held: Column) -> Column:
    return F.when(F.size(held) == 0, F.lit(NONE)).otherwise(F.substring(F.md5(F.array_join(held, "")), 1, SIZE))


def packed(text: Column) -> Column:
    """A fingerprint in three quarters of its bytes, for exchanges: its characters are read as digits to base 64, whose alphabet has / for -."""
    return F.unbase64(F.translate(text, "-", "/"))


def unpacked(value: Column) -> Column:
    return F.translate(F.base64(value), "/\r\n", "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of the drawings in which some lexicon holds the same terms, one at least, of both texts; 1 for equal fingerprints.

    Drawings none of whose lexicons holds a term of either text do not count.
    """
    one = SIZE * len(LIMITS)

    def hashes(text: Column, seed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(LIMITS) - 1)), lambda i: F.substring(text, seed * one + i * SIZE + 1, F.lit(SIZE)))

    drawings = F.transform(F.sequence(F.lit(0), F.lit(DRAWINGS - 1)), lambda s: F.arrays_zip(hashes(a, s).alias("a"), hashes(b, s).alias("b")))
    held = F.filter(drawings, lambda d: F.exists(d, lambda x: (x["a"] != NONE) | (x["b"] != NONE)))
    equal = let(held, lambda d: F.size(F.filter(d, lambda e: F.exists(e, lambda x: (x["a"] == x["b"]) & (x["a"] != NONE)))) / F.size(d))
    return F.when(a == b, F.lit(1.0)).when(a.startswith("all-") | b.startswith("all-"), F.lit(0.0)).otherwise(equal)


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, kk (the key as text), h (a hash of the text), n_chars, copies, text, next_kk, next_h, edited.

    The next document by key (null keys last, ties by hash; after the last the first), and the text whose last half, rounded
    down, gives way to as many first characters of the next. Rows with equal key and text are one row with ``copies``.
    Only keys are ordered; texts meet by equal keys.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    base = base.withColumn("kk", F.coalesce(F.col("k").cast("string"), F.lit("null")))
    ids = base.select("k", "kk", "h", F.length("text").alias("n_chars")).groupBy("k", "kk", "h", "n_chars").agg(F.count("*").alias("copies"))
    order = [F.col("k").asc_nulls_last(), F.col("h")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = materialize(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    one = F.struct("kk", "h")
    heads = ids.groupBy("part").agg(F.min_by(one, F.struct(F.col("k").isNull(), "k", "h")).alias("head"))  # a row for each part
    everything = W.partitionBy(F.lit(0)).orderBy("part")
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(everything), F.first("head").over(everything)))
    follows = ids.withColumn("next", F.lead(one).over(W.partitionBy("part").orderBy(*order))).join(heads, "part")
    follows = follows.withColumn("next", F.coalesce("next", "after")).select("k", "kk", "h", "n_chars", "copies", F.col("next.kk").alias("next_kk"), F.col("next.h").alias("next_h"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    texts = base.select("kk", "h", "text").dropDuplicates(["kk", "h"])
    lead = follows.select(F.struct("k", "kk", "h").alias("own"), "n_chars", "copies", "half", F.col("next_kk").alias("kk"), F.col("next_h").alias("h"))
    lead = texts.join(lead, ["kk", "h"]).select("own.*", "n_chars", "copies", "half", F.col("kk").alias("next_kk"), F.col("h").alias("next_h"), F.expr("substring(text, 1, half)").alias("lead"))
    out = texts.join(lead, ["kk", "h"])
    return out.select("k", "kk", "h", "n_chars", "copies", "text", "next_kk", "next_h", F.concat(F.expr("substring(text, 1, n_chars - half)"), "lead").alias("edited"))


def compare_with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see ``with_next`` and ``likeness``)."""
    band = lexicon(docs, text=text)
    rows = with_next(docs, key=key, text=text)
    marked = materialize(
        rows.select("k", "n_chars", "copies", "kk", "h", "next_kk", "next_h", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), packed(fingerprint(F.col("text"), band)).alias("fingerprint"), packed(fingerprint(F.col("edited"), band)).alias("edited_fingerprint"))
    )
    after = marked.select(F.col("kk").alias("next_kk"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next_fingerprint"))
    out = marked.join(after, ["next_kk", "next_h"]).withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))
    out = out.withColumns({c: unpacked(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    out = out.select(
        F.col("k").alias(key), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "copies",
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy", "copies")
