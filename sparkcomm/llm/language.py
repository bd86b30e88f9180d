"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcomm.llm.common import crc_mod

#: Features are hashed byte bigrams and trigrams. Fixed sizes bound what is broadcast: languages x CENTROIDS x FEATURES floats.
FEATURES, CENTROIDS, MAX_LANGUAGES = 1 << 14, 4, 256
#: Labelled rows a language is fitted on (about; chosen by a hash of the id), and characters joined per step of a long text.
SAMPLE_ROWS, STEP = 1_500, 1 << 20

#: Bytes other than letters of ASCII count as a space; bytes of other characters stay.
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


@dataclass
class Centroids:
    """Unit vectors with the language and the rejection radius (a cosine) of each."""

    languages: list[str]
    owner: np.ndarray
    vectors: np.ndarray
    radius: np.ndarray
    idf: np.ndarray


def counts(text: str) -> np.ndarray:
    """N-gram counts of a whole text. Runs of non-letters are one space."""
    total = np.zeros(FEATURES, np.int64)
    for at in range(0, len(text), STEP):
        b = _FOLD[np.frombuffer(b" " + text[at : at + STEP].lower().encode() + b" ", np.uint8)]
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
        two = (b[:-1] << 8) | b[1:]
        three = (two[:-1] << 8) | b[2:]
        for gram, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
            total += np.bincount((gram * np.uint32(salt)) >> np.uint32(18), minlength=FEATURES)
    return total


def weigh(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(total).astype(np.float32) * idf
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; seeds are the mean's farthest rows in turn. Returns centroids and each row's own."""
    seeds = [x.mean(0)]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[(x @ np.stack(seeds).T).max(1).argmin()])
    c = np.stack(seeds)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(1)
        used = np.unique(own)
        c = np.stack([x[own == i].mean(0) for i in used])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, (x @ c.T).argmax(1)


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, reject_share: float = 0.005) -> Centroids:
    """Fit on about ``sample_rows`` rows of each language, whole texts.

    Rows without a text or a language are left out. A document is outside (see ``predict``) if its cosine
    falls below that of all but ``reject_share`` of the centroid's own rows. Languages without a usable row
    are not learned; more than MAX_LANGUAGES of them is an error.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages.")
    empty = Centroids([], np.zeros(0, int), np.zeros((0, FEATURES), np.float32), np.zeros(0), np.ones(FEATURES, np.float32))
    if not sizes:
        return empty
    share = F.coalesce(*[F.when(F.col("l") == name, F.lit(int(min(1.0, sample_rows / n) * 2**31))) for name, n in sizes.items()])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for t in batch.column(1).to_pylist():
                c = counts(t)
                ids.append(np.flatnonzero(c))
                values.append(c[ids[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["l", "ids", "n"])

    sample = rows.where(crc_mod(F.col("k"), 2**31) < share).select("l", "t").repartition(16).mapInArrow(features, "l string, ids array<int>, n array<int>")
    sample = sample.persist()
    try:
        seen = {r["f"]: r["n"] for r in sample.select(F.explode("ids").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()}  # FEATURES rows at most
        df = np.zeros(FEATURES)
        df[list(seen)] = list(seen.values())
        n = sample.count()
        idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)

        def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros((len(pdf), FEATURES), np.float32)
            for i, (ids, values) in enumerate(zip(pdf["ids"], pdf["n"], strict=True)):
                x[i, ids] = values
            x = np.stack([weigh(row, idf) for row in x])
            x = x[np.lexsort(x[:, :64].T)]
            c, own = cluster(x, CENTROIDS)
            near = [np.sort((x[own == i] @ c[i]))[int(reject_share * (own == i).sum())] if (own == i).any() else 0.0 for i in range(len(c))]
            return pd.DataFrame({"l": pdf["l"].iloc[0], "c": [v.tolist() for v in c], "r": near})

        found = sample.groupBy("l").applyInPandas(centroids, "l string, c array<float>, r double").collect()  # bounded by MAX_LANGUAGES
    finally:
        sample.unpersist()
    if not found:
        return empty
    found.sort(key=lambda r: r["l"])
    names = sorted({r["l"] for r in found})
    return Centroids(names, np.array([names.index(r["l"]) for r in found]), np.array([r["c"] for r in found], np.float32), np.array([r["r"] for r in found]), idf)


def predict(docs: DataFrame, model: Centroids, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred, score (cosine to the nearest centroid), rejected (further away than its radius).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Ties go to the first
    language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores, outside = [], [], []
            for t in batch.column(1).to_pylist():
                name, score, far = "und", 0.0, True
                if t and len(m.owner) and any(map(str.isalpha, t)):
                    near = m.vectors @ weigh(counts(t), m.idf)
                    i = int(near.argmax())
                    name, score, far = m.languages[m.owner[i]], float(min(max(near[i], 0.0), 1.0)), bool(near[i] < m.radius[i])
                names.append(name)
                scores.append(score)
                outside.append(far)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(outside, pa.bool_())], [key, "lang_pred", "score", "rejected"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
