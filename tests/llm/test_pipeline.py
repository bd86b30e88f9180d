"""Every stage against brute force on the documents that reach it."""

import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
from helpers import SCHEMA, clashing, empty, odd_rows, prose
from test_near_duplicates import brute as groups
from test_quality import brute as measures
from test_secrets import brute as spans_of

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from sparkcomm.llm import bpe, mixing, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).persist())
    return frames


def test_stages_on_the_driver_table(spark):
    docs, good, single, clean, mixed, last = stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    for frame in (good, single, clean, mixed):
        assert frame.columns == docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    verdict = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    base = {r["doc_id"] for r in docs.collect() if not (measures(r["text"])[0] < 20 or 100 * measures(r["text"])[4] > 30 * measures(r["text"])[0])}
    assert ids(good) == sorted(k for k, r in verdict.items() if r["kept"]) and set(ids(good)) <= base
    want = groups([(r["doc_id"], r["text"]) for r in good.collect()])
    assert ids(single) == sorted(k for k, (n, c) in want.items() if k == c or n == 0)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: r for r in clean.collect()}
    assert set(before) == set(after)
    for k, text in before.items():
        found, out, at = spans_of(text), [], 0
        for kind, start, end in found:
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        assert after[k]["text"] == ("".join(out) + text[at:] if found else text)
    wanted = Counter()
    for r in mixing.plan(clean).collect():
        wanted[r["doc_id"]] += sum(2 * t["words"] >= r["size"] for t in r["takes"])
    assert Counter(ids(mixed)) == +wanted
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    splitter, cache = bpe.encoder(ranks, public_tokenizers.PATTERN)
    for r in last.collect():
        assert r["round_trip"] and r["ids"] == bpe.encode_text(r["text"], splitter, cache).tolist()


def test_odd_and_empty_tables_pass_all_stages(spark):
    rows = [*odd_rows(), (20, prose(3, 90), "en", None, 1), (None, prose(4, 90), None, None, None), (20, prose(3, 90), "en", None, 1)]
    frames = stages(spark, clashing(spark.createDataFrame(rows, SCHEMA)))
    assert frames[1].where("doc_id = 20").count() == 2 and frames[2].where("doc_id = 20").count() == 1
    assert frames[-1].count() > 0
    assert stages(spark, empty(spark))[-1].count() == 0


def test_run_and_registration(spark):
    from sparkcomm.llm import queries

    assert queries.QUERIES["pipeline"](spark, SF).count() == stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))[-1].count()
    assert [s[0] for s in corpus_pipeline.STAGES][:2] == ["quality rules", "near duplicates"] and corpus_pipeline.ORACLE_SQL is None
