import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from helpers import clashing, empty, odd, odd_rows, prose

from sparkcomm.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, encoding):
    got = bpe.decode(bpe.encode(clashing(odd(spark)), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = sorted((str(r[0]), encoding.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in odd_rows())
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in got) == want
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_merge_of_long_and_random_pieces(encoding, monkeypatch):
    import random

    rng, ranks = random.Random(3), bpe.read_ranks(RANKS)
    pieces = ["".join(rng.choice("abcehinorst") for _ in range(n)) for n in (1, 2, 3, 17, 200, 3000)] + ["aaaaaaa", "abababab", "ééé", "thethethe"]
    pieces += ["".join(rng.choice("aehinorst \0é") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    pieces += ["".join(rng.choice(["ab", "a", "the", "x", "ing"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    want = [encoding._encode_single_piece(p.encode()) for p in pieces]
    for short in (0, 40, bpe.SHORT, 10_000):
        monkeypatch.setattr(bpe, "SHORT", short)
        ids, sizes = bpe.merge([p.encode() for p in pieces], bpe.Vocabulary(ranks))
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))


def test_texts_beyond_the_piecewise_limit(encoding, monkeypatch):
    for limit in (10, 700, 5_000):
        monkeypatch.setattr(bpe, "LONG_TEXT", limit)
        texts = [prose(5, 500), None, "", *(prose(i, 90) for i in range(20)), prose(6, 600), ""]
        got = bpe.encode_texts(texts, *bpe.encoder(RANKS, public_tokenizers.PATTERN))
        assert [x.tolist() for x in got] == [encoding.encode_ordinary(t or "") for t in texts]


def test_cache_stays_bounded(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 40)
    cache = bpe.Cache(bpe.read_ranks(RANKS))
    for i in range(40):
        pieces = [*prose(i, 30).split(), "x" * 100]
        ids, sizes = cache.ids(pieces)
        want = [encoding.encode_ordinary(p) for p in pieces]
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))
        assert len(cache) <= 40


def test_rank_queue_pops_the_bucket_of_the_smallest_rank():
    import random

    rng, queue, held = random.Random(1), bpe.RankQueue(), {}
    for _ in range(3000):
        if held and rng.random() < 0.4:
            rank, bucket = queue.pop()
            assert rank == min(held) and sorted(bucket) == sorted(held.pop(rank))
        else:
            rank, position = rng.choice([0, 63, 64, 255, 256, 4095, 4096, 49_999, rng.randrange(50_000)]), rng.randrange(100)
            held.setdefault(rank, []).append(position)
            queue.push(rank, position)
    while held:
        assert queue.pop()[0] == min(held)
        held.pop(min(held))
    assert queue.pop() is None


def test_with_ids_keeps_columns(spark):
    out = bpe.with_ids(clashing(odd(spark)), RANKS, public_tokenizers.PATTERN)
    assert out.count() == len(odd_rows()) and out.where("round_trip").count() == len(odd_rows())
    assert {"lang", "source", "root", "ids", "n_tokens"} <= set(out.columns)


def test_token_counts_are_the_library_s(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    more = [(100 + i, t, "en", "a", 0) for i, t in enumerate([" ", "  ", "   ", "a ", " a", "a  ", "  a b", "▁", "▁▁a", "a▁ b", "\n a\n\n", "a\x00b \x00", "x  \t y", "ﬁ ａ é"])]
    table = clashing(spark.createDataFrame(odd_rows() + more, odd(spark).schema))
    got = token_counts.count_tokens(table, MODEL).collect()
    want = sorted((str(r[0]), len(model.encode(r[1] or ""))) for r in odd_rows() + more)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    assert token_counts.count_tokens(empty(spark), MODEL).count() == 0


def test_table_only_saves_time(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(30)], "doc_id long, text string")
    packed = token_counts.frequent(docs, MODEL)
    assert len(token_counts.unpack(packed)) > 50
    plain = token_counts.Lengths(MODEL, {})
    assert all(n == plain[p] for p, n in token_counts.unpack(packed).items())


def test_digests_of_the_query(spark, encoding):
    from sparkcomm.llm import queries

    got = {r["doc_id"]: r for r in queries.op2(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = encoding.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
