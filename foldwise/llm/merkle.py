"""A Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Leaves are digests of rows. Per language they stand in order of doc_id (null first, equal ids by digest); every two neighbours
become the digest of their concatenated hex digests, a last odd one becomes the digest of itself, until one
remains: the subroot. Subroots in order of language (null first) are the leaves of one more tree, whose top is the root.

Aligned runs of 2^``HEIGHT`` leaves are the *blocks* of a language: one row each in the manifest, ``nodes`` holding all digests of
the block's subtree, which is split at half its height again and again: the upper half stands first, then the lower
subtrees one after another. ``address`` gives a node's place from its level and index alone; building and the
retrieval of siblings both go through it. The roots of blocks are the leaves of blocks one tier up, until one block
holds a whole language; the languages' subroots are dealt with the same way.

No group holds more than 2^``HEIGHT`` rows: places inside a language come from a sort of all leaves by range and prefix sums, so
a language of any size is as good as many. Texts never move; only digests do. Levels count up from the leaves.

Nulls in any column have their own mark (``-``), so a null and an empty text differ. Repeated rows are leaves of their own. A table
of one row has itself as subroot and root, without siblings; an empty table gives empty tables. Texts of any length are
hashed whole. Extra columns, also of the names used here, don't enter a leaf and don't come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.plans.ordering import sorted_index
from foldwise.session import written

HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = 64  # characters of a digest


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(n_chars: Column | None = None) -> Column:
    """Digest of a row, optionally with another value of n_chars."""
    fields = []
    for name in FIELDS:
        value = (n_chars if name == "n_chars" and n_chars is not None else F.col(name)).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


@lru_cache(maxsize=64)
def _splits(levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per depth d of a tree of ``levels`` levels: nodes of the upper part above d's cut, nodes of a lower part at d, depth of that upper part's root."""
    upper, lower, root = (np.zeros(levels, np.int64) for _ in range(3))

    def split(top: int, height: int) -> None:
        if height > 1:
            above = height // 2
            below = height - above
            at = top + above
            upper[at], lower[at], root[at] = (1 << above) - 1, (1 << below) - 1, top
            split(top, above)
            split(at, below)

    split(0, levels)
    return upper, lower, root


def address(levels: int, level: int, index: np.ndarray | int) -> np.ndarray | int:
    """Place of the node ``index`` of a level in the stored order of a full tree of ``levels`` levels.

    A node that heads a lower part stands behind the upper part it hangs from and behind the lower parts to its left; how
    many those are is the end of its path, so the place adds up over the O(log levels) cuts above it.
    """
    upper, lower, root = _splits(levels)
    depth = levels - 1 - level
    place = 0
    while depth > 0:
        # inside the tree whose root is at root[depth], this node heads lower part number (path below that root)
        place = place + upper[depth] + (index & upper[depth]) * lower[depth]
        index = index >> (depth - root[depth])
        depth = int(root[depth])
    return place


def levels_for(n: int) -> int:
    """Levels of a tree over n leaves."""
    return max(n - 1, 0).bit_length() + 1


@lru_cache(maxsize=64)
def addresses(levels: int) -> list[list[int]]:
    """Byte positions of all nodes of a full tree, by level and index."""
    full = [np.arange(1 << (levels - 1 - level)) for level in range(levels)]
    return [((address(levels, level, index) + 0 * index) * NODE).tolist() for level, index in enumerate(full)]


class Block:
    """The subtree over up to 2^HEIGHT aligned leaves, digests in stored order; places beyond the last node of a level stay empty."""

    def __init__(self, n: int, nodes: bytes | bytearray):
        self.n, self.nodes, self.levels = n, nodes, levels_for(n)

    @classmethod
    def build(cls, leaves: list[bytes]) -> Block:
        self = cls(len(leaves), bytearray(NODE * ((1 << levels_for(len(leaves))) - 1)))
        row, level = leaves, 0
        while True:
            for at, value in zip(addresses(self.levels)[level], row):
                self.nodes[at:at + NODE] = value
            if len(row) == 1:
                return self
            row = [digest(*row[i:i + 2]) for i in range(0, len(row), 2)]
            level += 1

    def node(self, level: int, index: int) -> bytes:
        at = addresses(self.levels)[level][index]
        return bytes(self.nodes[at:at + NODE])

    def top(self, lifted: int) -> bytes:
        """The root, hashed alone for ``lifted`` levels more where the block is a short last one."""
        value = self.node(self.levels - 1, 0)
        for _ in range(lifted):
            value = digest(value)
        return value

    def siblings(self, index: int) -> list[tuple[str, bytes]]:
        """From the leaf to below the root: the side the sibling stands on (``L``, ``R``, or ``-`` without one) and its digest."""
        path = []
        for level in range(self.levels - 1):
            other, width = index ^ 1, -(-self.n // (1 << level))
            path.append(("-", b"") if other >= width else ("LR"[other > index], self.node(level, other)))
            index >>= 1
        return path


def pack(path: list[tuple[str, bytes]]) -> bytes:
    return b"".join(side.encode() + value for side, value in path)


def unpack(path: bytes) -> list[tuple[str, bytes]]:
    out, at = [], 0
    while at < len(path):
        step = 1 if path[at:at + 1] == b"-" else 1 + NODE
        out.append((path[at:at + 1].decode(), path[at + 1:at + step]))
        at += step
    return out


def fold(value: bytes, path: list[tuple[str, bytes]]) -> bytes:
    for side, other in path:
        value = digest(other, value) if side == "L" else digest(value, other)
    return value


BLOCK = "tree string, tier int, block bigint, n bigint, total bigint, nodes binary, top string"


def _tier(leaves: DataFrame, tier: int, height: int, extra: list[str]) -> DataFrame:
    """Blocks over rows of tree, total (leaves of the tree in this tier), place and digest; ``extra`` columns become arrays in leaf order."""
    types = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        total, place = group.column("total")[0].as_py(), group.column("place")[0].as_py()
        built = Block.build([v.encode() for v in group.column("digest").to_pylist()])
        height_here = min(height, levels_for(total) - 1)
        row = {"tree": [group.column("tree")[0].as_py()], "tier": [tier], "block": [place >> height], "n": [built.n], "total": [total],
               "nodes": [bytes(built.nodes)], "top": [built.top(height_here - built.levels + 1).decode()]}
        return pa.Table.from_pydict(row | {c: [group.column(c).to_pylist()] for c in extra}, schema=target)

    fields = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    target = pa.schema([("tree", pa.string()), ("tier", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("total", pa.int64()),
                        ("nodes", pa.binary()), ("top", pa.string()), *[(c, pa.list_(fields[types[c]])) for c in extra]])
    schema = BLOCK + "".join(f", {c} array<{types[c]}>" for c in extra)
    return leaves.withColumn("_block", F.shiftright("place", height)).groupBy("tree", "_block").applyInArrow(lambda g: run(g.drop(["_block"])), schema)


def _forest(leaves: DataFrame, height: int, extra: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of blocks over all trees, from the leaves up, and tree, subroot, tier (where the tree ends).

    A tier is written before the next reads it. Trees that fit a block are done; the others' block roots go on. The number of
    tiers is that of the largest tree: log(leaves) / height.
    """
    tiers, rows, done = [], leaves, None
    while True:
        tier = written(_tier(rows, len(tiers), height, extra), "merkle")
        tiers.append(tier)
        last = tier.filter(F.col("total") <= 1 << height).select("tree", F.col("top").alias("subroot"), F.lit(len(tiers) - 1).alias("tier"))
        done = last if done is None else done.unionByName(last)
        more = tier.filter(F.col("total") > 1 << height)
        if more.isEmpty():
            return tiers, done
        size = F.shiftright(F.col("total") + ((1 << height) - 1), height)
        rows, extra = more.select("tree", size.alias("total"), F.col("block").alias("place"), F.col("top").alias("digest")), []


def _descend(tiers: list[DataFrame], ends: DataFrame, height: int) -> DataFrame:
    """The lowest blocks with path (packed siblings of the block's root up to the root of all) and subroot.

    ``ends`` has tree, tier, path and subroot for the one block in which each tree ends. From there a tier's blocks hand
    their children what they need: every join is on a block of a tree, none on a tree alone, however large it is.
    """
    above = None
    for number in range(len(tiers) - 1, -1, -1):
        heads = ends.filter(F.col("tier") == number).select("tree", F.lit(0).cast("bigint").alias("block"), "path", "subroot")
        above = heads if above is None else above.unionByName(heads)
        named = above.select(F.col("tree").alias("_tree"), F.col("block").alias("_at"), "path", "subroot")
        known = tiers[number].join(named, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_at"))).drop("_tree", "_at")
        if number:
            above = _leaf_paths(known, height).withColumnRenamed("place", "block")
    return known


def _leaf_paths(blocks: DataFrame, height: int) -> DataFrame:
    """tree, place, path, subroot of every leaf of blocks with path and subroot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held = Block(r["n"], r["nodes"])
                above = pack(_lift(held, r["total"], height)) + r["path"]
                first = r["block"] << height
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([r["tree"]] * r["n"], pa.string()), "place": pa.array(range(first, first + r["n"]), pa.int64()),
                    "path": pa.array([pack(held.siblings(i)) + above for i in range(r["n"])], pa.binary()), "subroot": pa.array([r["subroot"]] * r["n"], pa.string())})

    return blocks.select("tree", "block", "n", "total", "nodes", "path", "subroot").mapInArrow(run, "tree string, place bigint, path binary, subroot string")


def _lift(held: Block, total: int, height: int) -> list[tuple[str, bytes]]:
    """Steps without siblings between the root of a short last block and the height of its tier."""
    return [("-", b"")] * (min(height, levels_for(total) - 1) - held.levels + 1)


class Manifest:
    """Stored blocks of all languages (``tiers``) and of the tree over their subroots (``crown``), with ``subroots`` and ``root``.

    ``subroots`` has tree, subroot, tier (where the tree ends) and place; ``root`` has one row (none for an empty table).
    """

    def __init__(self, tiers: list[DataFrame], crown: list[DataFrame], subroots: DataFrame, crown_end: DataFrame, height: int):
        self.tiers, self.crown, self.subroots, self.crown_end, self.height = tiers, crown, subroots, crown_end, height
        self.root = crown_end.select(F.col("subroot").alias("root"))


def manifest(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """``leaves``: lang, doc_id, digest and columns to keep beside the leaves in their blocks.

    They are written once: the sort looks at its input twice. Rows alike are told apart by where they are stored, so that a
    range can end between them.
    """
    extra = [c for c in leaves.columns if c not in ("lang", "digest")]
    stored = written(leaves.withColumnRenamed("lang", "tree").withColumn("_row", F.monotonically_increasing_id()), "leaves")
    ordered = sorted_index(stored, [F.col("tree").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "digest", "_row"], "_at").drop("_row")
    sizes = ordered.groupBy(F.col("tree").alias("_tree")).agg(F.count(F.lit(1)).alias("total"), F.min("_at").alias("_first"))
    placed = ordered.join(sizes, F.col("tree").eqNullSafe(F.col("_tree"))).withColumn("place", F.col("_at") - F.col("_first")).drop("_tree", "_at", "_first")
    tiers, found = _forest(placed, height, extra)
    # subroots: one row per language, in their order the leaves of the crown
    subroots = written(sorted_index(found, [F.col("tree").asc_nulls_first()], "place"), "subroots")
    total = subroots.count()
    above = subroots.select(F.lit(None).cast("string").alias("tree"), F.lit(total).cast("bigint").alias("total"), "place", F.col("subroot").alias("digest"))
    crown, root = _forest(above, height, [])
    return Manifest(tiers, crown, subroots, root, height)


def proofs(held: Manifest) -> DataFrame:
    """Leaf blocks with ``path``, the packed siblings of the block's root up to the root, and the block's subroot and root."""
    top = held.crown_end.select("tree", "tier", F.lit(b"").alias("path"), "subroot")
    crown = _leaf_paths(_descend(held.crown, top, held.height), held.height).select(F.col("place").alias("_place"), "path")
    ends = held.subroots.join(crown, F.col("place") == F.col("_place")).select("tree", "tier", "path", "subroot")
    return _descend(held.tiers, ends, held.height).crossJoin(F.broadcast(held.root))  # one row


def audit(docs: DataFrame, tampered: Column, height: int = HEIGHT) -> DataFrame:
    """Builds the manifest of ``docs`` and checks rows whose n_chars ``tampered`` raises by one against it.

    Gives doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    other = F.when(tampered & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1))
    leaves = docs.select("lang", F.col("doc_id").cast("bigint").alias("doc_id"), leaf().alias("digest"), other.alias("changed"))
    held = manifest(leaves, height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["n"], r["nodes"])
                above = _lift(block, r["total"], height) + unpack(r["path"])
                n, root = r["n"], r["root"]
                paths = [block.siblings(i) + above for i in range(n)]
                own = [block.node(0, i) for i in range(n)]
                folded = [fold(c.encode() if c else o, p).decode() for c, o, p in zip(r["changed"], own, paths)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(r["doc_id"], pa.int64()), "lang": pa.array([r["tree"]] * n, pa.string()), "leaf": [o.decode() for o in own],
                    "subroot": [r["subroot"]] * n, "root": [root] * n, "proof_sha256": [digest(*(v for _, v in p)).decode() for p in paths],
                    "folded_root": folded, "verified": [f == root for f in folded]})

    return proofs(held).select("tree", "n", "total", "nodes", "path", "subroot", "root", "doc_id", "changed").mapInArrow(
        run, "doc_id bigint, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
