"""Small tables and brute-force versions for the operator tests."""

from __future__ import annotations

import random
import re
import uuid
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def crc(doc_id: int | None) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def prose(seed: int, n: int, stock: int = 400) -> str:
    rng = random.Random(seed)
    pool = ["".join(rng.choice(["an", "the", "or", "ti", "el", "ou", "é", "ñ", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(stock)]
    return " ".join(rng.choice(pool) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    text = prose(1, 60)
    return [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n\x0b\f\r ", "en", None, 7),
        (None, text, "en", "a", 5),
        (None, text, "en", "a", 5),
        (None, None, None, None, None),
        (4, text, "en", "b", 5),
        (4, text, "en", "b", 5),
        (5, text.upper(), "en", "b", 5),
        (6, "one", "fr", "b", 3),
        (7, "É ñ 你好 \U0001f600 \xa0 x", "fr", "c", 9),
        (8, prose(2, 60_000), "fr", "c", 1),
        (9, "a" * 20_000, "de", "c", 20_000),
        (10, "<s> </s> <|endoftext|> ▁ a▁b  c   d ", "de", None, 1),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The table with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = "size row key _k _h ids spans kept h n rep bands host lines text_ th node root score rare fine name take position n_tokens".split()
    return df.withColumns({n: F.lit("x") for n in names})


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shuffled_bytes(spark, run) -> int:
    """Bytes that the stages of run() write for exchanges."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
