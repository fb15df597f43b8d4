"""Operator 13: the prefix trie of conversations, from a global sort.

A conversation is an array of turn digests, so texts are never collected. Arrays are dealt by ranges and sorted; in each
task a stack sweep over the common prefixes of neighbours turns their LCP intervals into nodes. Nodes that a task's first
or last array lies under may go on in a neighbouring task, so they stay open: a task hands on its first and last array
with the open nodes along them (a Run), and runs of neighbours are stitched in rounds until one is left. A sweep and a
stitch are the same step, as a single array is the smallest run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import workspace, written

#: Bytes of a turn's digest (of SHA-256) in the sort key.
WIDTH = 16
#: Runs that one task stitches, ids in a block, and nodes in a batch.
FAN, BLOCK, BATCH = 32, 4096, 4096
#: What a sweep gives: closed nodes, a run, and blocks of ids that end at one of its edges.
SWEPT = "kind string, part long, seq long, node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, blob binary, ids array<long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b"\0" * WIDTH


class Node:
    """A prefix; what its closed children and the conversations that end at it have added up to.

    ends: a hash of the latter, None where their ids are given out in blocks, as more of them may follow in another task.
    """

    __slots__ = ("children", "ends", "key", "least", "leaves", "n", "saved", "size")

    def __init__(self, key: bytes, size: int, n: int = 0, least: int | None = None, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = NO_ENDS):
        self.key, self.size, self.n, self.least, self.children, self.leaves, self.saved, self.ends = key, size, n, least, children, leaves, saved, ends

    def add(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def join(self, other: Node) -> None:
        """other: the same prefix in the run that follows."""
        self.add(other.n, other.least)
        self.children, self.leaves, self.saved = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        if self.ends is not None and other.ends != NO_ENDS:
            self.ends = other.ends

    def dump(self) -> list:
        return [self.key.hex(), self.size, self.n, self.least, self.children, self.leaves, self.saved, self.ends]

    @classmethod
    def load(cls, x: list) -> Node:
        return cls(bytes.fromhex(x[0]), *x[1:])


class Run:
    """Arrays that follow each other, as their first and last one and the open nodes along both, from the root on.

    A node that both lie under is one object in both paths.
    """

    def __init__(self, first: list[bytes], last: list[bytes], left: list[Node], right: list[Node]):
        self.first, self.last, self.left, self.right = first, last, left, right

    def meet(self, other: Run, close: Callable[[Node, Node | None, int], None]) -> None:
        """Take in the run that follows, and close the nodes that lie along neither edge any more, children first."""
        common = shared(self.last, other.first)
        for d in range(common + 1):
            mine, its = self.right[d], other.left[d]
            mine.join(its)
            other.left[d] = mine
            if d < len(other.right) and other.right[d] is its:
                other.right[d] = mine

        def fold(path: list[Node], low: int) -> None:
            for d in range(len(path) - 1, low - 1, -1):
                if not any(d < len(edge) and edge[d] is path[d] for edge in (self.left, other.right)):
                    shut(path, d, close)

        fold(self.right, common + 1)
        fold(other.left, common + 1)
        fold(self.right[: common + 1], 0)
        self.last, self.right = other.last, other.right

    def finish(self, close: Callable[[Node, Node | None, int], None]) -> None:
        """Close all that is open, as no run precedes or follows."""
        for d in range(len(self.right) - 1, -1, -1):
            if not (d < len(self.left) and self.left[d] is self.right[d]):
                shut(self.right, d, close)
        for d in range(len(self.left) - 1, -1, -1):
            shut(self.left, d, close)

    def dump(self) -> bytes:
        stem = sum(a is b for a, b in zip(self.left, self.right, strict=False))
        keys = [[x.hex() for x in path] for path in (self.first, self.last)]
        return json.dumps([*keys, stem, [n.dump() for n in self.left], [n.dump() for n in self.right[stem:]]]).encode()

    @classmethod
    def load(cls, blob: bytes) -> Run:
        first, last, stem, left, right = json.loads(blob)
        left = [Node.load(x) for x in left]
        return cls([bytes.fromhex(x) for x in first], [bytes.fromhex(x) for x in last], left, left[:stem] + [Node.load(x) for x in right])


def shared(a: list[bytes], b: list[bytes]) -> int:
    """The length of the longest common prefix."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return k
    return min(len(a), len(b))


def shut(path: list[Node], d: int, close: Callable[[Node, Node | None, int], None]) -> None:
    """Close the node at depth d, whose descendants are closed, and add it to its parent."""
    node, parent = path[d], path[d - 1] if d else None
    node.leaves = node.leaves or 1
    node.saved += (node.n - 1) * node.size
    if parent:
        parent.add(node.n, node.least)
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + node.leaves, parent.saved + node.saved
    close(node, parent, d)


class Output:
    """Rows of SWEPT, in batches."""

    def __init__(self, part: int):
        self.part, self.seq, self.rows = part, 0, []

    def node(self, node: Node, parent: Node | None, depth: int) -> None:
        self.rows.append(("node", self.part, None, node.key, parent and parent.key, depth, node.least, node.n, node.children, node.leaves, node.saved, node.ends, None, None))

    def block(self, node: Node, ids: list[int]) -> None:
        """Ids that end at a node, to be hashed later with those before and after them."""
        node.ends = None
        self.rows.append(("ids", self.part, self.seq, node.key, *[None] * 9, ids))
        self.seq += 1

    def run(self, run: Run) -> None:
        self.rows.append(("run", self.part, *[None] * 10, run.dump(), None))

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], NAMES)
            self.rows = []


NAMES, TYPES = zip(*(x.rsplit(" ", 1) for x in SWEPT.split(", ")), strict=True)
KINDS = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[x] for x in TYPES]


def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a task's sorted arrays that no other task can add to, its run, and blocks of ids."""
    out = Output(TaskContext.get().partitionId())
    run, ids, groups = None, [], 0

    def ended(edge: bool) -> None:
        """All equal arrays have been seen here; edge: they may go on in another task."""
        node = run.right[-1]
        if edge or node.ends is None:
            out.block(node, ids)
        else:
            node.ends = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

    for batch in batches:
        for conv, digests, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digests", "sizes")), strict=True):
            if run and digests == run.last:
                run.right[-1].add(1, conv)
                ids.append(conv)
                if len(ids) == BLOCK:
                    out.block(run.right[-1], ids)
                    ids = []
                continue
            if run:
                ended(edge=groups == 1)
            known = shared(run.last, digests) if run else -1
            path = [Node(ROOT, 0)]
            for d, (x, size) in enumerate(zip(digests, sizes, strict=True), 1):
                path.append(Node(run.right[d].key if d <= known else hashlib.sha256(path[-1].key + x).digest()[:WIDTH], size))
            path[-1].add(1, conv)
            one = Run(digests, digests, path, list(path))
            if run:
                run.meet(one, out.node)
            else:
                run = one
            ids, groups = [conv], groups + 1
            yield from out.batches(BATCH)
    if run:
        ended(edge=True)
        out.run(run)
    yield from out.batches(1)


def stitch(last: bool, fan: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of neighbouring tasks become one, and the nodes between them are closed; the last one closes all."""

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "blob")), strict=True))
        out, run = Output(rows[0][0] // fan), None
        for _, blob in rows:
            if run:
                run.meet(Run.load(blob), out.node)
            else:
                run = Run.load(blob)
        run.finish(out.node) if last else out.run(run)
        return pa.Table.from_batches(out.batches(1))

    return joined


def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and ends from blocks in order, a block at a time."""
    now, sha = None, None
    done: list[tuple] = []
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            text = ",".join(map(str, ids)).encode()
            if node == now:
                sha.update(b"," + text)
            else:
                if sha:
                    done.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(text)
    if sha:
        done.append((now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "ends"])


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, digests and sizes (array: a turn's digest, the UTF-8 bytes of its text) of each conversation, after its first h
    turns are replaced by those of the first conversation of its family (conv_id - conv_id % family, the remainder never
    negative), h = crc32(conv_id) % heads.

    Turns are ordered by turn, null first, and turns that tie by their digests, so repeated rows are turns each. Null roles
    and texts are empty. Rows without conv_id belong to no conversation and are left out. A conversation's digests have to
    fit in a task (about 40 bytes a turn); its texts don't.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.substring(F.unhex(F.sha2(said, 256)), 1, WIDTH).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    # One shuffle by family serves the arrays and what is taken from the family's first conversation.
    rows = rows.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).repartition("base")
    arrays = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("own"))
    lead = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads - 1)))
    arrays = arrays.withColumn("lead", F.coalesce(lead.over(Window.partitionBy("base")), F.slice("own", 1, 0)))
    h: Column = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    whole = F.concat(F.slice("lead", 1, h), F.slice("own", h + 1, F.size("own")))
    arrays = arrays.select("conv_id", whole.alias("turns"))
    return arrays.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))


def trie(arrays: DataFrame, folder: str | None = None, fan: int = FAN) -> DataFrame:
    """The nodes of the prefix trie of arrays (conv_id, digests, sizes): node, parent, depth, conv_id (the smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. No arrays give no nodes.

    Empty arrays are members of the root alone. Equal arrays are dealt by conv_id too, so that a conversation that very many
    repeat is no task's; the ids that end at a node are hashed in blocks of bounded size, in one task for each node, as a
    hash is sequential. A task stitches fan runs a round. The ranges are cut by a sample of at most a million keys of 16 bytes a turn.
    """
    spark = arrays.sparkSession
    folder = folder or workspace(spark, "trie")
    arrays = written(arrays, folder, "arrays")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = arrays.repartitionByRange(parts, "digests", "conv_id")
    parts = dealt.rdd.getNumPartitions()
    swept = written(dealt.sortWithinPartitions("digests", "conv_id").mapInArrow(sweep, SWEPT), folder, "swept")
    found = [swept]
    while parts > 0:
        parts = -(-parts // fan) if parts > fan else 0
        runs = found[-1].where("kind = 'run'").select("part", "blob", F.floor(F.col("part") / fan).alias("g"))
        found.append(written(runs.groupBy("g").applyInArrow(stitch(not parts, fan), SWEPT), folder, f"stitched-{len(found)}"))
    nodes = found[0].where("kind = 'node'")
    for more in found[1:]:
        nodes = nodes.unionByName(more.where("kind = 'node'"))
    blocks = swept.where("kind = 'ids'").select("node", "part", "seq", "ids").repartition("node").sortWithinPartitions("node", "part", "seq")
    ends = blocks.select("node", "ids").mapInArrow(hashed, "node binary, ends string").withColumnsRenamed({"node": "at", "ends": "late"})
    # Only the few nodes at tasks' edges, or with very many equal conversations, are joined.
    late = nodes.where("ends IS NULL").join(ends, F.col("node") == F.col("at")).withColumn("ends", F.col("late")).drop("at", "late")
    nodes = nodes.where("ends IS NOT NULL").unionByName(late)
    nodes = nodes.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    nodes = written(nodes, folder, "nodes")
    above = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, F.col("parent") == F.col("above"), "left").drop("above")


def prefix_trie(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """trie() of the rebuilt conversations of turns (conv_id, turn, role, text); more columns are ignored."""
    return trie(rebuilt(turns, family, heads))
