"""Quality rules: repetition inside a document, and lines repeated over the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcomm.llm.common import let, row_key, words
from sparkcomm.session import materialize

#: Base rules: fewest words; most words, in percent, that stand in windows of WINDOW words found twice or more.
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: A line is boilerplate of its host if it stands in more than LINE_DOCUMENTS distinct documents there and in more than
#: LINE_SHARE of them.
LINE_DOCUMENTS, LINE_SHARE = 10, 0.001
#: A document is depleted if fewer than MIN_WORDS words or less than this share of them are left without such lines.
LEFT_SHARE = 0.2


def repeated_words(w: Column) -> Column:
    """Words that stand in a window of WINDOW words which occurs twice or more in the array of words."""

    def covered(keys: Column) -> Column:
        def positions(pairs: Column) -> Column:
            again = F.filter(pairs, lambda p, i: (p["k"] == F.get(pairs, i - 1)["k"]) | F.coalesce(p["k"] == F.get(pairs, i + 1)["k"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda p: p["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end"))
        pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        count = F.aggregate(let(pairs, positions), start, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(count)

    windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "_words": of_words,
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def normal_lines(text: Column) -> Column:
    """(h, words) of the lines with a word: lower case, digits as 0, white space as one space; a hash of each."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "123456789", "000000000")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    lines = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.substring(F.md5(x), 1, 16).alias("h"), F.size(F.split(x, " ")).alias("words")))
    return lines


def assess(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Key, base measures, base_failed, n_boilerplate_words, kept.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT percent of them repeated. kept: not base_failed, and not
    depleted once the boilerplate lines of the host (``source``; null is one host) are gone. Distinct documents of a
    line differ in their normalised lines, by a hash of all of them, so that copies of one document count once and their own
    lines are not taken for boilerplate; edited copies count each. Null and empty texts have no words and fail.
    """
    return _verdicts(docs, key, text, source).drop("_k", "_h")


def keep(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs that ``assess`` keeps, with all their columns."""
    kept = _verdicts(docs, key, text, source).where("kept").select("_k", "_h").distinct()
    rows = docs.select(*row_key(key, text), F.struct("*").alias("row"))
    return rows.join(kept, ["_k", "_h"], "left_semi").select("row.*")


def _verdicts(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    host = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("-"))
    measures = [c.alias(n) for n, c in base_measures(F.col(text)).items()]
    measured = docs.select(F.monotonically_increasing_id().alias("row"), *row_key(key, text), F.col(key).alias("key"), host.alias("host"), normal_lines(F.col(text)).alias("lines"), *measures)
    document = F.substring(F.md5(F.array_join(F.transform("lines", lambda x: x["h"]), "")), 1, 16)
    measured = materialize(measured.withColumn("document", document))
    lines = measured.select("row", "host", "document", F.explode("lines").alias("line")).select("row", "host", "document", "line.h", "line.words")
    sizes = measured.groupBy("host").agg(F.count("*").alias("documents"))
    often = lines.groupBy("host", "h", "document").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > LINE_DOCUMENTS)
    often = often.join(sizes, "host").where(F.col("n") > LINE_SHARE * F.col("documents")).select("host", "h")
    gone = lines.join(often, ["host", "h"]).groupBy("row").agg(F.sum("words").alias("gone"))
    n, gone_words = F.col("_words.n_words"), F.coalesce("gone", F.lit(0)).cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col("_words.n_repeat_words") > MAX_REPEAT * n)
    depleted = (n - gone_words < MIN_WORDS) | (n - gone_words < LEFT_SHARE * n)
    return measured.join(gone, "row", "left").select(
        "_k", "_h", F.col("key").alias(key), n.alias("n_words"), F.col("_words.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("_words.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"), gone_words.alias("n_boilerplate_words"), (~failed & ~depleted).alias("kept"),
    )
