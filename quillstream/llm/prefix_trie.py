"""The trie of the prefixes of sequences of turns: sorted arrays of turns, adjacent common prefixes, a stack swept over them.

Every sequence becomes an array of 16-byte digests of its turns. The arrays are range-sorted over all tasks, ties by id. In that
order the sequences below a node are neighbours, and the length of the prefix that two neighbours share says which nodes end
between them and which begin: each task sweeps its stretch with a stack of open nodes and gives out a node when it ends.

A stretch cuts nodes. Those on the path of its first sequence may have begun in a stretch before, those on the path of its last
one may go on in the next. A task gives these out as parts, at most two paths a stretch, and a second sweep over the parts alone
closes them, in the order of stretches, with the same stack. Nodes hold their parent's id once it is closed; children of a cut
node get it by a join on (stretch, slot), which deals the many children of a hot node out by stretch.

Repeated sequences are one run of neighbours, so a group of copies is spread over as many stretches as it fills. A sequence's
array must fit a row (16 bytes a turn); a task holds its open path, the children of open nodes, and the ids of the current run.
Texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions
from .streams import through

#: Bytes of a run's ids in one row.
PIECE = 1 << 20
NODE = "part long, kind string, slot long, parent_slot long, digest binary, words long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTS = f"{NODE}, seq long, ids string"
NOTHING = hashlib.sha256(b"").hexdigest()


class Open:
    """An open node. Sums are over what is closed below it."""

    __slots__ = ("children", "digest", "ends", "first", "held", "leaves", "least", "n", "run", "saved", "slots", "words")

    def __init__(self, digest: bytes, words: int, first: bool = False) -> None:
        self.digest, self.words, self.first = digest, words, first
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.held: list[list] = []
        self.ends, self.run = None, None
        self.slots: list[tuple[int, int]] = []

    def close(self) -> None:
        """Adds what the node itself counts, once nothing more comes below it."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words

    def member(self, conv_id: int) -> None:
        self.n += 1
        self.least = conv_id if self.least is None else min(self.least, conv_id)

    def sha(self) -> str:
        return NOTHING if self.ends is None else self.ends if isinstance(self.ends, str) else self.ends.hexdigest()


def _row(part: int, kind: str, slot: int, parent_slot: int | None, node: Open, depth: int, ends: str | None) -> list:
    return [part, kind, slot, parent_slot, node.digest, node.words, node.least, depth, None, node.n, node.children, node.leaves, node.saved, ends]


def sweep(rows: Iterator[tuple], part: int | None = None) -> Iterator[tuple]:
    """The nodes of a stretch of sorted sequences (conv_id, digests, words): kind `node`, `part` for cut ones, `ids` for cut runs.

    A part counts only what is closed below it: not its child on the same path, nor itself as a leaf.
    """
    part = TaskContext.get().partitionId() if part is None else part
    stack: list[Open] = []
    path: list[bytes] = []
    seq = 0

    def cut(node: Open, depth: int, slot: int, parent_slot: int | None) -> Iterator[tuple]:
        """A node that may go on beyond the stretch; the ids of a run that may are given out themselves."""
        nonlocal seq
        yield *_row(part, "part", slot, parent_slot, node, depth, node.sha() if node.run is None and node.ends is not None else None), None, None
        for row in node.held:
            row[3] = slot
            yield *row, None, None
        ids, size = [], 0
        for conv_id in node.run or ():
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
            if size >= PIECE:
                yield part, "ids", slot, *[None] * 11, (seq := seq + 1), ",".join(ids)
                ids, size = [], 0
        if ids:
            yield part, "ids", slot, *[None] * 11, (seq := seq + 1), ",".join(ids)

    def down_to(depth: int) -> Iterator[tuple]:
        """Closes the open nodes deeper than that."""
        while len(stack) > depth + 1:
            node, above, at = stack.pop(), stack[-1], len(stack)
            if node.first:
                yield from cut(node, at, at, at - 1)
                continue
            node.close()
            node.ends, node.run = _added(node.ends, node.run), None
            for row in node.held:
                row[8] = node.least
                yield *row, None, None
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            row = _row(part, "node", at, None, node, at, node.sha())
            if above.first:
                row[3] = at - 1
                yield *row, None, None
            else:
                above.held.append(row)

    for conv_id, digests, words in rows:
        if not stack:
            stack.append(Open(b"", 0, True))
            stack += [Open(d, w, True) for d, w in zip(digests, words, strict=True)]
            stack[-1].run = []  # may have begun before
        else:
            shared = next((k for k, (a, b) in enumerate(zip(path, digests, strict=False)) if a != b), min(len(path), len(digests)))
            if len(path) > shared or len(digests) > shared:
                yield from down_to(shared)
                top = stack[-1]
                if top.run is not None and not top.first:
                    top.ends, top.run = _added(top.ends, top.run), None  # the run is over, and began in this stretch
                for d, w in zip(digests[shared:], words[shared:], strict=True):
                    stack.append(Open(d, w))
                if len(digests) > shared:
                    stack[-1].run = []
        path = digests
        for node in stack:
            node.member(conv_id)
        stack[-1].run.append(conv_id)
    if stack:
        cut_at = next((k for k, node in enumerate(stack) if not node.first), len(stack))
        for depth in range(len(stack) - 1, -1, -1):
            slot = depth if depth < cut_at else -depth
            above = None if not depth else depth - 1 if depth - 1 < cut_at else 1 - depth
            yield from cut(stack[depth], depth, slot, above)


def _added(ends, ids: list[int] | None):
    """A hash of ids in order, comma-joined, with more ids."""
    if not ids:
        return ends
    return _more(ends, ",".join(map(str, ids)))


def _more(ends, ids: str):
    if ends is None:
        return hashlib.sha256(ids.encode())
    ends.update(b"," + ids.encode())
    return ends


def stitch(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Closes cut nodes: rows of PARTS in order of stretch, path and depth give nodes and, for each part, its node's conv_id (`is`)."""
    stack: list[Open] = []
    stretch = None
    cut_at = 0

    def down_to(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            node.close()
            parent = (None, None)
            if stack:
                above = stack[-1]
                above.leaves += node.leaves
                above.saved += node.saved
                parent = above.slots[0]
            yield _row(parent[0], "node", None, parent[1], node, len(stack), node.sha())
            for part, slot in node.slots:
                yield [part, "is", slot, None, None, None, node.least, *[None] * 7]

    matching = False
    for part, kind, slot, _, digest, words, least, depth, _, n, children, leaves, saved, ends, _, ids in rows:
        if kind == "ids":
            stack[abs(slot)].ends = _more(stack[abs(slot)].ends, ids)
            continue
        if part != stretch:
            stretch, matching, cut_at = part, bool(stack), 0
        if slot < 0:
            if cut_at == 0:
                cut_at = depth
                yield from down_to(depth)
            matching = False
        elif matching and not (depth < len(stack) and stack[depth].digest == digest):
            matching = False
            yield from down_to(depth)
        if not matching:
            if stack:
                stack[-1].children += 1
            stack.append(Open(digest, words))
        node = stack[depth]
        node.n += n
        node.least = least if node.least is None else min(node.least, least)
        node.children += children
        node.leaves += leaves
        node.saved += saved
        node.slots.append((part, slot))
        if ends is not None:
            node.ends = ends
    yield from down_to(0)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, words>>) of conversations (conv_id, turn, role, text), by turn (null first).

    A null role or text is empty. Ties are ordered by role and text (their first 64 characters, then a digest of both). Rows
    without a conv_id belong to no conversation and are left out.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).filter("conv_id IS NOT NULL")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    each = F.struct("turn", F.substring("role", 1, 64).alias("r64"), F.substring("text", 1, 64).alias("t64"), digest.alias("digest"), words.alias("words"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(found: DataFrame, base: Column, head: Column) -> DataFrame:
    """Sequences whose first `head` turns are those of the conversation `base`: all of them if it has fewer, none if it is absent."""
    asks = found.withColumns({"base": base, "head": head.cast("int")})
    most = asks.agg(F.max("head")).first()[0] or 0
    heads = found.select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(most, 1)).alias("given"))
    given = F.coalesce(F.expr("slice(given, 1, head)"), F.array().cast(dict(found.dtypes)["turns"]))
    own = F.expr("slice(turns, head + 1, greatest(size(turns) - head, 0))")
    return asks.join(heads, "base", "left").select("conv_id", F.concat(given, own).alias("turns"))


def prefix_trie(found: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the sequences (conv_id, turns array<struct<digest, words>>), the empty one included.

    conv_id is a node's smallest member (an id whose sequence starts with it) and parent_conv_id its parent's (null for the
    root); n_convs counts members, n_children the nodes one turn longer, n_leaves the childless nodes below it or itself.
    saved_tokens sums, over the subtree, words of a node's last turn times members but one: what sharing prefixes saves.
    ends_sha256 hashes the comma-joined ascending ids of members that end here. No sequence, no row; a null array is empty.
    """
    spark = found.sparkSession
    rows = found.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("turns", F.array().cast(dict(found.dtypes)["turns"])).alias("turns"))
    rows = rows.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    order = ("digests", "conv_id")
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    made = materialise(through(dealt.select("conv_id", "digests", "words"), sweep, PARTS, lambda row: 200 + len(row[-1] or "")), "trie")
    cut = made.filter("kind <> 'node'").repartition(1).sortWithinPartitions("part", F.col("slot") < 0, F.abs("slot"), F.desc("kind"), "seq")
    closed = materialise(through(cut, stitch, NODE), "stitched")
    ids = closed.filter("kind = 'is'").select("part", F.col("slot").alias("parent_slot"), F.col("conv_id").alias("known"))
    nodes = made.filter("kind = 'node'").select(closed.columns).unionByName(closed.filter("kind = 'node'"))
    columns = ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return nodes.join(ids, ["part", "parent_slot"], "left").select("conv_id", "depth", F.coalesce("parent_conv_id", "known").alias("parent_conv_id"), *columns)
