"""The classifier against a plain version of counts, weights, clusters and nearest centroids."""

import math

from helpers import clashing, odd_rows, prose

from sparkcomm.llm import language


def plain_counts(text: str) -> dict[int, int]:
    folded = [32, *[b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()], 32]
    line = [b for i, b in enumerate(folded) if b != 32 or i == 0 or folded[i - 1] != 32]
    found: dict[int, int] = {}
    for size, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        for i in range(len(line) - size + 1):
            gram = int.from_bytes(bytes(line[i : i + size]), "big")
            at = ((gram * salt) % 2**32) >> 18
            found[at] = found.get(at, 0) + 1
    return found


def unit(v: dict[int, float]) -> dict[int, float]:
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else v


def dot(a: dict[int, float], b: dict[int, float]) -> float:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def mean(vectors: list[dict[int, float]]) -> dict[int, float]:
    total: dict[int, float] = {}
    for v in vectors:
        for k, x in v.items():
            total[k] = total.get(k, 0.0) + x
    return {k: x / len(vectors) for k, x in total.items()}


def plain_clusters(x: list[dict[int, float]], k: int) -> list[dict[int, float]]:
    seeds = [mean(x)]
    while len(seeds) < min(k, len(x)):
        near = [max(dot(v, s) for s in seeds) for v in x]
        seeds.append(x[near.index(min(near))])
    for _ in range(12):
        seeds = [unit(s) for s in seeds]
        own = [max(range(len(seeds)), key=lambda i: dot(v, seeds[i])) for v in x]
        seeds = [mean([v for v, o in zip(x, own, strict=True) if o == i]) for i in sorted(set(own))]
    return [unit(s) for s in seeds]


def plain_model(rows: list[tuple[str, str]]):
    counted = [(plain_counts(t), lang) for t, lang in rows]
    df: dict[int, int] = {}
    for c, _ in counted:
        for k in c:
            df[k] = df.get(k, 0) + 1
    idf = {k: math.log((1 + len(rows)) / (1 + n)) + 1 for k, n in df.items()}

    def weighed(c: dict[int, int]) -> dict[int, float]:
        return unit({k: math.log1p(n) * idf.get(k, 0.0) for k, n in c.items()})

    centroids = []
    for lang in sorted({lang for _, lang in counted}):
        x = [weighed(c) for c, l in counted if l == lang]
        x.sort(key=lambda v: [v.get(i, 0.0) for i in reversed(range(64))])
        found = plain_clusters(x, language.CENTROIDS)
        own = [max(range(len(found)), key=lambda i: dot(v, found[i])) for v in x]
        for i, c in enumerate(found):
            near = sorted(dot(v, c) for v, o in zip(x, own, strict=True) if o == i)
            centroids.append((lang, c, near[int(0.005 * len(near))] if near else 0.0))
    return weighed, centroids


def plain_answer(text: str | None, weighed, centroids) -> tuple[str, float, float]:
    """Language, cosine, and how far the cosine lies above the centroid's radius."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0, -1.0
    v = weighed(plain_counts(text))
    near = [dot(v, c) for _, c, _ in centroids]
    i = near.index(max(near))
    return centroids[i][0], min(max(near[i], 0.0), 1.0), near[i] - centroids[i][2]


def test_counts_equal_a_plain_version():
    for text in ("", "a", "Ab  cd-é 你好 x", prose(5, 300), "12 34", *[r[1] for r in odd_rows()[:9] if r[1]]):
        got = language.counts(text)
        assert {int(k): int(got[k]) for k in got.nonzero()[0]} == plain_counts(text)


def test_every_row_equals_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()  # 200 documents
    train = [d for d in docs if d["lang"] is not None and d["text"] is not None and d["doc_id"] % 3]
    weighed, centroids = plain_model([(d["text"], d["lang"]) for d in train])
    schema = "doc_id long, text string, lang string"
    model = language.fit(clashing(spark.createDataFrame([(d["doc_id"], d["text"], d["lang"]) for d in train], schema)))
    assert [model.languages[i] for i in model.owner] == [lang for lang, _, _ in centroids]
    table = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"]) for d in docs], schema)
    got = {r["doc_id"]: r for r in language.predict(table, model).collect()}
    assert len(got) == len(docs)
    for d in docs:
        lang, score, above = plain_answer(d["text"], weighed, centroids)
        row = got[d["doc_id"]]
        assert row["lang_pred"] == lang and abs(row["score"] - score) < 1e-4
        assert abs(above) < 1e-4 or row["rejected"] == (above < 0)
