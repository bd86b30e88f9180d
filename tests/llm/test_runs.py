import hashlib
import random

import pytest
from helpers import clashing, crc, empty, odd_rows, prose, rows, words

from sparkcomm.llm import queries, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(w, least=12):
    """Runs by comparing every word with the one q words on, for each q."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                out.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def cut(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def rebuilt(doc_id, text):
    h, w = crc(doc_id), words(text)
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def made(rng):
    w = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randint(0, 80))]
    if w and rng.random() < 0.5:
        w = (w[: rng.randint(1, len(w))] * 20)[: rng.randint(1, 150)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "z"
    return w


@pytest.mark.parametrize("together", [1, 100, 1 << 19])
def test_runs_equal_brute_force(monkeypatch, together):
    monkeypatch.setattr(runs, "TOGETHER", together)
    rng = random.Random(together)
    for least in (3, 5, 12):
        texts = [made(rng) for _ in range(400)]
        for w, (split, found) in zip(texts, runs.runs_of([" ".join(w) for w in texts], least), strict=True):
            assert found == brute(w, least), w
            assert runs.collapsed(split, found).decode() == cut(w, found)


def test_long_texts():
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 3_000:
        fib.append(fib[-1] + fib[-2])
    both = runs.runs_of([" ".join(fib[-1]), "x " * 200_000, None, ""])
    assert both[0][1] == brute(fib[-1]) and both[1][1] == [(0, 200_000, 1)] and both[2] == both[3] == ([], [])


def test_odd_rows_and_rebuilt_tails(spark):
    table = [r for r in odd_rows() if len(r[1] or "") < 100_000] + [(i, prose(i, 40 + i), "en", "a", 0) for i in range(30, 90)] + [(30, "one two " * 9, "en", "a", 0), (31, "A a " * 9, "en", "a", 0)]
    docs = clashing(spark.createDataFrame(table, SCHEMA))
    got = rows(runs.find_runs(runs.repeat_tails(docs)).selectExpr("doc_id", "transform(runs, r -> array(r.start, r.length, r.period)) AS runs", "collapsed"))
    want = []
    for r in table:
        w = rebuilt(r[0], r[1])
        found = brute(w)
        want.append((r[0], [list(x) for x in found], cut(w, found)))
    assert got == sorted(want, key=repr) and sum(bool(x[1]) for x in want) > 5
    assert runs.find_runs(runs.repeat_tails(empty(spark))).count() == 0


def test_driver_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        w = rebuilt(r["doc_id"], docs[r["doc_id"]])
        if len(w) > 3_000:
            continue
        found = brute(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(cut(w, found).encode()).hexdigest()
