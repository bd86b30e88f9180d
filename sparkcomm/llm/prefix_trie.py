"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcomm.session import materialize

#: Sorted conversations that become one forest; forests are contracted to their borders and merged.
SEGMENT = 20_000
#: Conversation ids in one piece of a node's list of ends.
PIECE = 50_000
#: Bytes of a turn's digest in a path.
STEP = 16

_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: kind: 0 a closed node, 1 a node on the border of a forest, 2 a piece of the ends of such a node. A border node has what the closed
#: nodes below it add to n_children, n_leaves and saved_tokens; ``at`` and ``side`` name the border.
_PART = "kind int, conv_id long, depth long, parent_conv_id long, parent binary, node binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, n_bytes long, at long, side int, ends string"
_COLUMNS = [f.split()[0] for f in _PART.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _PART.split(", ")])


def conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id (long) and turns: an array of (digest, n_bytes) in the order of turn (null first, equal ones by digest).

    Null role and text count as empty. Rows without a conversation id belong to no conversation. Only digests and sizes are shuffled.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes")).alias("one"))
    ordered = F.sort_array(F.collect_list("one"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["digest"].alias("digest"), x["n_bytes"].alias("n_bytes"))).alias("turns"))


def rebuilt(convs: DataFrame, *, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations with the first h turns of conversation c - c % ``family`` in place of their own; h is crc32(c as text) % ``heads``."""
    base = convs.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_head")).where(F.col("_base") % family == 0)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", F.lit(1), F.lit(0)))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return convs.join(base, F.col("conv_id") - F.pmod("conv_id", F.lit(family)) == F.col("_base"), "left").select("conv_id", F.concat(head, own).alias("turns"))


def shared_prefixes(turn: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns that each conversation shares with the next one; ``turn`` has their digests one after the other, two numbers each."""
    least = np.minimum(size[1:], size[:-1])
    total = int(least.sum())
    first = np.cumsum(least) - least
    step = np.arange(total) - np.repeat(first, least)
    unlike = (turn[np.repeat(start[:-1], least) + step] != turn[np.repeat(start[1:], least) + step]).any(1)
    out = least.copy()
    where = np.flatnonzero(unlike)
    pair = np.repeat(np.arange(len(least)), least)[where]
    pair, at = np.unique(pair, return_index=True)
    out[pair] = step[where[at]]
    return out


class Forest:
    """Nodes of the compact trie of sorted conversations: those where conversations end or part, and the root.

    Edges between neighbours are taken by falling length of the shared prefix. Components are stretches of
    conversations, each with one top node. An edge of depth d joins two of them under a node of depth d: the top of the
    left one if that is at d (its conversations end there, or an equal edge came before), else a new branching node.
    """

    def __init__(self, size: np.ndarray, shared: np.ndarray) -> None:
        n = len(size)
        self.depth, self.low, self.high = size.tolist(), list(range(n)), list(range(n))
        self.ends, self.up, self.same = [1] * n, [-1] * n, list(range(n))
        component, top = list(range(n)), list(range(n))

        def find(x: int) -> int:
            while component[x] != x:
                component[x] = component[component[x]]
                x = component[x]
            return x

        for i in np.argsort(-shared, kind="stable").tolist():
            d = int(shared[i])
            a, b = find(i), find(i + 1)
            component[b] = a
            x, y = top[a], top[b]
            if self.depth[x] == d:
                self.high[x] = self.high[y]
                if self.depth[y] == d:  # one more conversation that ends here
                    self.same[y] = x
                    self.ends[x] += 1
                else:
                    self.up[y] = x
            else:
                top[a] = self._branch(d, x, y)
        if n and self.depth[top[find(0)]]:
            self._branch(0, top[find(0)], top[find(0)])

    def _branch(self, depth: int, left: int, right: int) -> int:
        node = len(self.depth)
        self.depth.append(depth)
        self.low.append(self.low[left])
        self.high.append(self.high[right])
        self.ends.append(0)
        self.up.append(-1)
        self.same.append(node)
        self.up[left] = self.up[right] = node
        return node


def _prefixes(path: bytes) -> list[bytes]:
    """Digest of every prefix of a path, the empty one first."""
    h = hashlib.md5()
    out = [h.digest()]
    for i in range(0, len(path), STEP):
        h.update(path[i : i + STEP])
        out.append(h.digest())
    return out


def contracted(conv: np.ndarray, paths: list[bytes], sizes: np.ndarray, n_bytes: np.ndarray) -> dict[str, list]:
    """The forest of a stretch of sorted conversations: its closed nodes whole, the prefixes of its first and last conversation in part.

    All other conversations with a closed node's prefix lie in the stretch, so that node is settled here.
    """
    start = np.cumsum(sizes) - sizes
    words = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
    f = Forest(sizes, shared_prefixes(words, start, sizes))
    last = len(conv) - 1
    edges = (_prefixes(paths[0]), _prefixes(paths[last]))
    n = len(f.depth)
    alive = sorted((v for v in range(n) if f.same[v] == v), key=lambda v: -f.depth[v])
    least = [min(conv[f.low[v] : f.low[v] + f.ends[v]].tolist(), default=None) for v in range(n)]
    children, leaves, saved = [0] * n, [0] * n, [0] * n  # of the closed nodes below
    out: dict[str, list] = {c: [] for c in _COLUMNS}
    chains: list[tuple[int, list[int]]] = []

    def put(**values) -> None:
        for c, column in out.items():
            column.append(values.get(c))

    for v in alive:
        p = f.up[v]
        if p >= 0:
            least[p] = least[v] if least[p] is None else min(least[p], least[v])
        if f.low[v] == 0 or f.high[v] == last:
            continue
        leaves[v] = leaves[v] or 1
        at, text = f.depth[v], start[f.low[v]] - 1
        chain = []
        for d in range(at, f.depth[p], -1):  # from the node up to the child of its parent
            saved[v] += (f.high[v] - f.low[v]) * int(n_bytes[text + d])
            chain.append(saved[v])
        chains.append((v, chain))
        children[p] += 1
        leaves[p] += leaves[v]
        saved[p] += saved[v]
    for v, chain in chains:
        p, members = f.up[v], f.high[v] - f.low[v] + 1
        side = 0 if f.low[p] == 0 else 1 if f.high[p] == last else None
        for d, sum_ in zip(range(f.depth[v], f.depth[p], -1), chain, strict=True):
            own, first = d == f.depth[v], d == f.depth[p] + 1
            ends = conv[f.low[v] : f.low[v] + f.ends[v]].tolist() if own else []
            put(
                kind=0, conv_id=least[v], depth=d, n_convs=members, n_children=children[v] if own else 1, n_leaves=leaves[v], saved_tokens=sum_,
                parent_conv_id=least[v] if not first else least[p] if side is None else None, parent=edges[side][f.depth[p]] if first and side is not None else None,
                ends_sha256=hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _NO_ENDS,
            )
    for side, row in ((0, 0), (1, last)):
        v = f.same[row]
        below = sizes[row]
        while v >= 0:
            mine = side == 0 or f.low[v] > 0  # a prefix of both borders counts on the left one
            top = f.depth[f.up[v]] + 1 if f.up[v] >= 0 else 0
            for d in range(int(below), top - 1, -1):
                own = mine and d == f.depth[v]
                put(
                    kind=1, at=int(conv[0]), side=side, depth=d, node=edges[side][d], parent=edges[side][d - 1] if d else None, n_bytes=int(n_bytes[start[row] + d - 1]) if d else 0,
                    conv_id=least[v] if mine else None, n_convs=f.high[v] - f.low[v] + 1 if mine else 0,
                    n_children=children[v] if own else 0, n_leaves=leaves[v] if own else 0, saved_tokens=saved[v] if own else 0,
                )
            if mine:
                for i in range(f.low[v], f.low[v] + f.ends[v], PIECE):
                    piece = conv[i : min(i + PIECE, f.low[v] + f.ends[v])].tolist()
                    put(kind=2, node=edges[side][f.depth[v]], at=piece[0], ends=",".join(map(str, piece)))
            below, v = top - 1, f.up[v]
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracted forests of the sorted conversations of a partition (conv_id, path, sizes), stretch by stretch."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        conv, path, sizes = pa.Table.from_batches(held).combine_chunks().columns
        paths = path.to_pylist()
        n_bytes = sizes.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out = contracted(conv.to_numpy(), paths, np.array([len(p) // STEP for p in paths], np.int64), n_bytes)
        return pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in _SCHEMA], schema=_SCHEMA)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SEGMENT - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == SEGMENT:
                yield told(held)
                held, rows = [], 0
    if rows:
        yield told(held)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces (node, ends) of every node, in their order, as they stream by."""
    node, h = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends_sha256"])
    for batch in batches:
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node:
                if h is not None:
                    yield row()
                node, h = key, hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
    if h is not None:
        yield row()


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv_id long, turns array of (digest, n_bytes), as ``conversations`` gives them).

    A node is a distinct sequence of first turns, the empty one included; its members are the conversations that begin with
    it. Columns: conv_id (smallest member), depth, parent_conv_id (its parent's conv_id; null for the root), n_convs (members),
    n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens ((n_convs - 1) x bytes of the last
    turn, summed over the subtree), ends_sha256 (of the ids of members that end here, ascending, joined by commas). No
    conversations, no nodes; conversations without turns are members of the root.

    Conversations are sorted by path over all partitions, copies by id, so a group of copies of any size is dealt over
    tasks. Stretches of ``SEGMENT`` of them become forests; only prefixes of a stretch's first and last conversation
    can have members elsewhere. These are summed by node over the stretches. Their subtree sums run along the border paths: each
    node's own share goes to one path that has it, and from there to the prefixes on that path.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = materialize(convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes")))
    parts = materialize(rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_forests, _PART))
    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    border = parts.where("kind = 1")
    nodes = border.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"), F.min(F.struct("at", "side")).alias("path"), *sums.values())
    more = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    nodes = nodes.join(more, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own_leaf = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))
    nodes = materialize(nodes.withColumns({"n_leaves": own_leaf.cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")}))
    share = nodes.select("node", "path", F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
    on_path = border.select("node", "depth", F.struct("at", "side").alias("here")).join(share, "node")
    mine = F.col("here") == F.col("path")
    upward = Window.partitionBy("here").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = on_path.select("node", F.sum(F.when(mine, F.col("l")).otherwise(0)).over(upward).alias("l"), F.sum(F.when(mine, F.col("s")).otherwise(0)).over(upward).alias("s"))
    below = below.groupBy("node").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    ends = parts.where("kind = 2").select("node", "ends", "at").repartition("node").sortWithinPartitions("node", "at").select("node", "ends").mapInArrow(_hashed_ends, "node binary, ends_sha256 string")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")]
    on_border = nodes.drop("n_leaves", "saved_tokens").join(below, "node").join(ends, "node", "left").join(above, "parent", "left").select(*columns)
    closed = parts.where("kind = 0")
    hung = closed.where("parent IS NOT NULL").drop("parent_conv_id").join(above, "parent", "left").select(*columns)
    return closed.where("parent IS NULL").select(*columns).unionAll(hung).unionAll(on_border)
