import math
from collections import Counter

import numpy as np
from helpers import clashing, crc, empty, lower, odd, odd_rows, prose, shuffled_bytes, words

from sparkcomm.llm import scoring


def tokens(text):
    return [*words(lower(text)), "\n"]


def brute_base(texts, train):
    c = Counter(t for text in train for t in tokens(text))
    room = sum(c.values()) + 0.1 * (len(c) + 1)
    return [(len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), sum(math.log10((c[x] + 0.1) / room) for x in tokens(t))) for t in texts]


def check(got, table, train):
    want = sorted((str(r[0]), *x) for r, x in zip(table, brute_base([r[1] for r in table], train), strict=True))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_base_scores_equal_brute_force(spark, monkeypatch):
    table = odd_rows() + [(100 + i, prose(i, 70), "en", "a", 0) for i in range(30)]
    docs = clashing(spark.createDataFrame(table, odd(spark).schema))
    train = [r[1] for r in table[:30]]
    trained = docs.sparkSession.createDataFrame([(t,) for t in train], "text string")
    check(scoring.score(docs, scoring.train(trained)).collect(), table, train)
    monkeypatch.setattr(scoring, "MAX_FREQUENT", 20)  # most tokens meet their counts in the join
    model = scoring.train(trained)
    assert len(model.frequent[0]) <= 20
    check(scoring.score(docs, model).collect(), table, train)
    none = scoring.train(empty(spark))
    got = scoring.score(docs, none).collect()
    assert none.tokens == 0 and all(r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 and math.isfinite(r["score"]) for r in got)
    assert scoring.score(empty(spark), model).count() == 0


def test_filter_never_reads_less_than_was_put_in(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63, 20_000)
    level = rng.integers(1, 12, len(h)).astype(np.int32)
    import pandas as pd

    items = spark.createDataFrame(pd.DataFrame({"h": h, "level": level})).repartition(5)
    segments = int(level.sum() * scoring.BITS_PER_LEVEL / scoring.SEGMENT) + 1
    f = scoring.build_filter(items, segments)
    read = f.levels(h.view(np.uint64))
    assert (read >= level).all() and (read > level).mean() < 0.1
    other = f.levels(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    assert (other > 0).mean() < 0.1


def test_filter_keeps_to_its_bound(spark):
    docs = spark.createDataFrame([(prose(i, 300, 5000),) for i in range(40)], "text string")
    small = scoring.train(docs, max_filter_bytes=16 << 10)
    assert small.filter.bits.nbytes <= (16 << 10) + scoring.SEGMENT // 8
    assert small.tokens == scoring.train(docs).tokens


def test_held_out_texts_score_better_than_the_base(spark):
    from sparkcomm.llm import queries

    got = queries.op7(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    train = [r.text for r in docs.itertuples() if crc(r.doc_id) % 10 != 0]
    want = dict(zip(docs["doc_id"], brute_base(docs["text"], train), strict=True))
    assert all(math.isclose(r.base_score, want[r.doc_id][2], rel_tol=1e-9) and r.n_known == want[r.doc_id][1] for r in got.itertuples())
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    assert (got["train_tokens"] == sum(len(tokens(t)) for t in train)).all()


def test_estimates_lie_in_their_levels():
    for n in (1, 2, 3, 7, 100, 12_345, 10**9):
        level = int(math.floor(math.log(n) / math.log(scoring.BASE) + 1e-9)) + 1
        got = float(scoring.estimate(np.array([level]))[0])
        assert n / scoring.BASE <= got <= n * scoring.BASE
    assert scoring.estimate(np.array([0]))[0] == 0


def brute_score(texts, train):
    """Scores from the levels of all words and pairs, each as often as it stands in the training texts."""
    level = lambda n: int(math.floor(math.log(n) / math.log(scoring.BASE) + 1e-9)) + 1 if n else 0
    mid = lambda n: float(scoring.estimate(np.array([level(n)]))[0])
    one = Counter(t for text in train for t in tokens(text))
    two = Counter(p for text in train for p in zip(["\n", *tokens(text)], tokens(text), strict=False))
    room = sum(one.values()) + 0.1 * (len(one) + 1)
    out = []
    for text in texts:
        rest = lambda w: scoring.PRIOR * (mid(one[w]) + 0.1) / room
        pairs = zip(["\n", *tokens(text)], tokens(text), strict=False)
        out.append(sum(math.log10((min(mid(two[a, b]), mid(one[a]), mid(one[b])) + rest(b)) / (mid(one[a]) + scoring.PRIOR)) for a, b in pairs))
    return out


def test_no_ngram_is_lost_beyond_the_filter(spark):
    table = odd_rows() + [(100 + i, prose(i, 200, 3000), "en", "a", 0) for i in range(40)]
    docs = clashing(spark.createDataFrame(table, odd(spark).schema))
    train = [r[1] for r in table[:40]]
    trained = spark.createDataFrame([(t,) for t in train], "text string")
    want = sorted((str(r[0]), s) for r, s in zip(table, brute_score([r[1] for r in table], train), strict=True))
    for bound, far in ((0, 1e-9), (3000, 0.01), (scoring.MAX_FILTER_BYTES, 0.1)):  # nothing, part and all in the filter, whose bits may read too high
        model = scoring.train(trained, max_filter_bytes=bound)
        got = sorted((str(r["doc_id"]), r["score"]) for r in scoring.score(docs, model).collect())
        assert [k for k, _ in got] == [k for k, _ in want]
        assert all(math.isclose(a[1], b[1], rel_tol=far) for a, b in zip(got, want, strict=True)), bound
    assert model.rare_pairs is None and model.low == (1, 1)


def test_open_pairs_travel_packed(spark, monkeypatch):
    """Pairs that the filter has no room for: right scores, for less than 20 bytes a pair over training and scoring."""
    monkeypatch.setattr(scoring, "MAX_PAIR_BYTES", 0)
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", 50_000)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 2_000, 3_000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {}

    def run():
        model = scoring.train(docs.where("doc_id % 10 != 0"))
        assert model.rare_pairs is not None and model.rare_words is None
        got.update((r["doc_id"], r["score"]) for r in scoring.score(docs, model).collect())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        moved = shuffled_bytes(spark, run)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = brute_score(texts, [t for i, t in enumerate(texts) if i % 10])
    assert all(math.isclose(got[i], x, rel_tol=0.1) for i, x in enumerate(want))  # words are read from the filter, too high at times
    assert moved / (60 * 3_000) < 20


def test_lots_and_blocks_of_pairs(spark, monkeypatch):
    """Exact scores from the tables with many small lots and blocks, null and repeated keys, counts beyond a byte."""
    monkeypatch.setattr(scoring, "FLUSH", 300)
    monkeypatch.setattr(scoring, "TEXTS", 5)
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", 200)
    table = odd_rows() + [(2**60 + i, prose(i, 100, 900), "en", "a", 0) for i in range(30)] + [(7, "la " * 700, "en", "a", 0)]
    docs = clashing(spark.createDataFrame(table, odd(spark).schema))
    train = [r[1] for r in table[5:]]
    model = scoring.train(spark.createDataFrame([(t,) for t in train], "text string").coalesce(3), max_filter_bytes=0)
    assert model.blocks > 4
    got = sorted((str(r["doc_id"]), r["score"]) for r in scoring.score(docs, model).collect())
    want = sorted((str(r[0]), s) for r, s in zip(table, brute_score([r[1] for r in table], train), strict=True))
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_packed_counts_come_back():
    n = np.array([1, 2, 254, 255, 256, 10**12, 1])
    assert scoring.unpack_counts(scoring.pack_counts(n), len(n)).tolist() == n.tolist()
    h = np.unique(np.random.default_rng(4).integers(0, 2**48, 5_000)).astype(np.uint64) << np.uint64(16)
    for blocks in (1, 2, 64):
        assert np.concatenate([scoring.undealt(x, blocks, b) for b, _, x in scoring.dealt(h, blocks)]).tolist() == h.tolist()


def test_texts_are_not_copied_for_rare_words(spark, monkeypatch):
    """Words beyond the filter: no table with the texts is written."""
    docs = spark.createDataFrame([(i, prose(i, 100, 900)) for i in range(20)], "doc_id long, text string")
    model = scoring.train(docs, max_filter_bytes=0)
    written, write = [], scoring.materialize
    monkeypatch.setattr(scoring, "materialize", lambda df: (written.append(df.columns), write(df))[1])
    assert model.rare_words is not None and scoring.score(docs, model).count() == 20
    assert written and not any("text" in c for c in written)
