"""Near duplicates: SuperMinHash bands, verification on full shingle sets, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcomm.llm.common import row_key
from sparkcomm.llm.signatures import forget, shingle_sets, super_min_hash
from sparkcomm.session import materialize

#: Words of a shingle; similarity that links, in hundredths.
WIDTH, PERCENT = 5, 85
#: Bands and slots of a band: at 0.85 a pair shares no band in 8 of a million cases.
BANDS, ROWS = 20, 5
#: Pairs whose signatures agree on a smaller share of the slots are not compared further: 5 standard deviations below 0.85.
AGREE = 0.66
#: Different texts that one task compares with each other; larger families meet block by block.
BLOCK = 1_000
#: Texts a worker hashes together.
TOGETHER = 256


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, th (a hash of the text), n_shingles, set_id (a 128-bit hash of the set), bands (a hash each)."""
    m = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                sets = shingle_sets(batch.column(2).to_pylist(), WIDTH)
                slots = np.ascontiguousarray(super_min_hash(sets, m)).reshape(len(sets), BANDS, ROWS)
                bands = [[xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(row)] for row in slots]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:2],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]),
                        pa.array(np.array(bands, np.uint64).view(np.int64).tolist(), pa.list_(pa.int64())),
                    ],
                    ["id", "th", "n_shingles", "set_id", "bands"],
                )
        forget()

    return docs.select(F.col(key).cast("long"), F.xxhash64(text), text).mapInArrow(run, "id long, th long, n_shingles long, set_id string, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that can be reached, for all nodes of the undirected edges a-b.

    Partitions first reduce their edges to a forest by union-find. Then every node takes the smallest label around it
    and hooks onto that label's own, until nothing changes: a number of rounds in the logarithm of the longest path.
    No edge list or component ever stands in one task.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                join(parent, a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array([root(parent, x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    edges = materialize(edges.mapInArrow(forest, "a long, b long").where("a <> b").distinct())
    while True:
        # large star: neighbours above a node go to the least one around it
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        new = materialize(large.join(small, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        a, b = (e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first() for e in (edges, new))
        edges = new
        if a == b:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def root(parent: dict[int, int], x: int) -> int:
    parent.setdefault(x, x)
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def join(parent: dict[int, int], a: int, b: int) -> bool:
    a, b = root(parent, a), root(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)
    return a != b


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A forest of verified links between the sets at ``left`` and those at ``right`` (positions).

    Pairs are taken by falling agreement of their signatures; a pair that is already connected is passed over.
    """
    sizes = np.array([len(s) for s in sets])
    slots = (super_min_hash(sets, BANDS * ROWS) & np.uint64(0xFFFF)).astype(np.uint16)
    found: list[tuple[int, int, int]] = []
    for i in left.tolist():
        others = right[right > i] if right is left else right
        small, big = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[100 * small >= PERCENT * big]
        agree = (slots[others] == slots[i]).sum(1)
        near = agree >= AGREE * slots.shape[1]
        found += [(-int(g), i, j) for g, j in zip(agree[near], others[near].tolist(), strict=True)]
    found.sort()
    parent: dict[int, int] = {}
    out = []
    for _, i, j in found:
        if root(parent, i) == root(parent, j):
            continue
        both = np.concatenate((sets[i], sets[j]))
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        if 100 * common >= PERCENT * (len(both) - common):
            join(parent, i, j)
            out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key (long), n_shingles, component_id (the smallest key of the component), kept (it is the key's own).

    Documents are linked if 100 x intersection >= PERCENT x union of their shingle sets. Those without words are
    linked with nothing. Each row goes by its own text, also where rows share a key; a row with a null key is in no
    component (null) and kept. Equal sets are one class from the start. Classes that share bands, directly or through others, are a
    family; within a family all pairs that size and signature admit are verified on the full sets, in blocks,
    so a link is lost only if no band of the pair agrees. Work grows with the square of a family's *different*
    sets, divided over tasks.
    """
    return _grouped(docs, key, text).select(F.col("id").alias(key), "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, with all their columns; of equal rows with words and a key, one."""
    kept = _grouped(docs, key, text).where("kept").select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("_k"), F.col("th").alias("_h"), (F.col("id").isNotNull() & (F.col("n_shingles") > 0)).alias("one")).distinct()
    rows = docs.select(*row_key(key, text), F.struct("*").alias("row")).join(kept, ["_k", "_h"])
    copy = F.when(F.col("one"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())
    return rows.withColumn("_copy", copy).dropDuplicates(["_k", "_h", "_copy"]).select("row.*")


def _grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    signs = materialize(signed(docs, key, text))
    named = signs.where("id IS NOT NULL AND n_shingles > 0")
    classes = materialize(named.groupBy("set_id").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")))
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    least = buckets.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    families = materialize(components(buckets.join(least, "band").select(F.col("least").alias("a"), F.col("rep").alias("b"))))
    sizes = families.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = families.join(sizes, "root").select("node", "root", blocks.alias("blocks"), F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(0).cast("int").alias("block"))
    # by shuffle at every size: the members grow with the documents
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t")).join(members.hint("merge"), "node")
    meetings = texts.select("node", "t", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meetings = meetings.select("node", "t", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        node, block = pdf["node"].to_numpy(), pdf["block"].to_numpy()
        sets = [s for at in range(0, len(pdf), TOGETHER) for s in shingle_sets(pdf["t"].iloc[at : at + TOGETHER].tolist(), WIDTH)]
        forget()
        left = np.flatnonzero(block == pdf["i"].iloc[0])
        pairs = links(sets, left, left if pdf["i"].iloc[0] == pdf["j"].iloc[0] else np.flatnonzero(block == pdf["j"].iloc[0]))
        return pd.DataFrame({"a": node[[i for i, _ in pairs]], "b": node[[j for _, j in pairs]]}, dtype="int64")

    found = meetings.groupBy("root", "i", "j").applyInPandas(verify, "a long, b long")
    roots = components(found)
    # a class's representative has its least key, so the least representative of a component is its least key
    tops = classes.select("set_id", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("root", "rep").alias("top"))
    top = F.when(F.col("id").isNotNull(), F.coalesce("top", "id"))
    return signs.join(tops, "set_id", "left").select("id", "th", "n_shingles", top.alias("component_id"), F.coalesce(F.col("id") == top, F.lit(True)).alias("kept"))
