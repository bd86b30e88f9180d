import hashlib
import random
import re

import pytest
from helpers import clashing, empty, lower, odd, odd_rows, prose, rows

from sparkcomm.llm import contamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall(lower(text))


def brute(text, items, window=10):
    """n_words, hit words, items."""
    w = words(text)
    hit, seen = set(), set()
    for item, item_text in items:
        x = words(item_text)
        n = min(len(x), window)
        for k in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else ():
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == k]
            hit.update(i + j for i in at for j in range(n))
            if at:
                seen.add("null" if item is None else str(item))
    return len(w), hit, sorted(seen)


def told(r):
    return str(r["doc_id"]), r["n_words"], [i for s in r["spans"] for i in range(s["start"], s["end"])], list(r["items"])


def made(seed, n, stock, longest):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefgh"[:stock]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "window", "stock"), [(1, 3, 2), (2, 4, 3), (3, 5, 2), (4, 10, 2), (5, 2, 4)])
def test_automaton_equals_brute_force(seed, window, stock):
    items = list(enumerate(made(seed, 12, stock, 14)))
    automaton = contamination.Automaton([(str(i), contamination.normal_words(t)) for i, t in items], window)
    for text in made(seed + 100, 150, stock + 1, 40):
        spans, seen = automaton.hits(contamination.normal_words(text))
        got = [i for a, b in spans for i in range(a, b)]
        n, hit, want = brute(text, items, window)
        assert (got, sorted(seen)) == (sorted(hit), want), (text, items)


@pytest.mark.parametrize("block", [10, 60, 200_000])
def test_blocks_pieces_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(contamination, "PIECE_WORDS", 7)
    monkeypatch.setattr(contamination, "CHAIN", 2)
    text = prose(1, 60)
    items = [(1, text), (2, " ".join(text.split()[20:45]).upper()), (10, "one"), (11, ""), (12, None), (None, "Ñ é-你好!"), (13, "a"), (3, prose(77, 40)), (3, text)]
    if block == 10:
        items = items[2:7]
    table = [*odd_rows(), (20, f"x {prose(77, 40)} y one", "en", "a", 0), (21, "ñ É 你好 é 你好", "en", "a", 0), (22, "one ñ é 你好", "en", "a", 0)]
    docs = clashing(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long"))
    got = contamination.scan(docs, spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' AS w", "'x' AS at")).collect()
    want = sorted(((str(r[0]), n, sorted(hit), seen) for r in table for n, hit, seen in [brute(r[1], items)]), key=repr)
    assert sorted(map(told, got), key=repr) == want


def test_empty_tables(spark):
    items = spark.createDataFrame([], ITEMS)
    assert contamination.scan(empty(spark), items).count() == 0
    got = contamination.scan(odd(spark), items).collect()
    assert all(not r["spans"] and not r["items"] for r in got) and len(got) == len(odd_rows())
    assert contamination.decontaminate(empty(spark), items).count() == 0


def test_spans_are_cut_and_covered_rows_go(spark):
    test = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"Before, we go.  {test.title()}! After that; {'more ' * 20}", "a"), (2, f"so {test}", "b"), (3, None, "c"), (4, "clean", "d")], "doc_id long, text string, row string")
    got = rows(contamination.decontaminate(docs, spark.createDataFrame([(1, test)], ITEMS)))
    assert got == [(1, f"Before, we go.  After that; {'more ' * 20}", "a"), (3, None, "c"), (4, "clean", "d")]


def test_driver_documents(spark):
    sf = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op13_benchmark_spans"](spark, sf).collect()
    assert len(got) == len(docs) and any(r["contaminated"] for r in got)
    for r in got[:60]:
        n, hit, seen = brute(docs[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, len(hit), len(seen), hashlib.sha256(",".join(seen).encode()).hexdigest())
