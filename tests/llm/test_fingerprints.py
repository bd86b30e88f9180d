import hashlib

from helpers import clashing, empty, odd, odd_rows, prose
from pyspark.sql import functions as F

from sparkcomm.llm import fingerprints as fp


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def terms(text):
    import re

    return {md5(w) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower())}


def brute_band(texts):
    df: dict = {}
    for t in texts:
        for f in {h[: fp.DIGITS] for h in terms(t) if h[fp.DIGITS + 1 : fp.DIGITS + 4] < fp.LIMITS[0]}:
            df[f] = df.get(f, 0) + 1
    return {f for f, n in df.items() if fp.LEAST <= n <= max(2, len(texts) // fp.MOST)}


def brute(text, band):
    held = sorted(h for h in terms(text) if h[: fp.DIGITS] in band and h[fp.DIGITS + 1 : fp.DIGITS + 4] < fp.LIMITS[0])
    if not held:
        return "all-" + md5("".join(sorted(terms(text))))
    out = ""
    for d in range(fp.DRAWINGS):
        for limit in fp.LIMITS:
            part = [h for h in held if h[fp.DIGITS] == f"{d:x}" and h[fp.DIGITS + 1 : fp.DIGITS + 4] < limit]
            out += md5("".join(part))[: fp.SIZE] if part else fp.NONE
    return out


def test_fingerprints_equal_brute_force(spark):
    table = [(i, prose(i, 300, 3000)) for i in range(60)] + [(r[0], r[1]) for r in odd_rows()]
    docs = clashing(spark.createDataFrame(table, "doc_id long, text string"))
    band = brute_band([t for _, t in table])
    got = docs.select("text", fp.fingerprint(F.col("text"), fp.lexicon(docs)).alias("f")).collect()
    assert all(r["f"] == brute(r["text"], band) for r in got)
    assert sum(not r["f"].startswith("all-") for r in got) >= 60


def test_edits_and_next_documents(spark):
    table = [(10 * i, prose(i, n)) for i, n in enumerate([40, 3, 0, 200, 41])] + [(5, "abc"), (25, None)]
    got = {r["doc_id"]: r for r in fp.compare_with_edits(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(table)
    assert set(got) == {k for k, _ in order}
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[k]["n_chars"] == len(t)
        assert got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1


def test_odd_rows(spark):
    got = fp.compare_with_edits(clashing(odd(spark))).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())
    by: dict = {}
    for r in got:  # equal texts, equal fingerprints
        if r["doc_id"] in (4, None) and r["n_chars"]:
            by.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert fp.compare_with_edits(empty(spark)).count() == 0
    one = fp.compare_with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1


def test_edits_are_nearer_than_strangers(spark):
    got = fp.compare_with_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.9


def test_fingerprints_are_packed_without_loss(spark):
    texts = ["", "a b", "one two three four", "é ü \U0001f600", "x " * 50] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    band = fp.lexicon(docs)
    rows = docs.select(fp.fingerprint(F.col("text"), band).alias("f")).union(spark.createDataFrame([("------0a1b2c",), (None,)], "f string"))
    for r in rows.select("f", fp.packed(F.col("f")).alias("p"), fp.unpacked(fp.packed(F.col("f"))).alias("g")).collect():
        assert r["f"] == r["g"] and (r["f"] is None or len(r["p"]) * 4 == len(r["f"]) * 3)
