"""Exact Jaccard join on word shingles that skips by set relations.

A document is the set of hashes of its ``width``-word shingles; documents with equal sets are one node. Sets are
sorted by hash and cut into blocks by position in the hash range. Two linked sets differ in at most d shingles, so of more than
d blocks at least one is equal: index lists are kept by (size class, block, content of the block), and whatever differs
in a block is skipped with the whole block, unread. A size class spans a factor of 100 / percent; a set stands in its own class and
the next, where its larger partners are.

In every list the first node leads. Leaders are compared with the members of their lists; linked ones form
components. Only lists that still hold several components go on: the answers of their other pairs are derived from the
leader's. Two members' overlap follows from what each differs in from the leader, so a pair can only be linked if it
shares enough of these few differences; pairs that do are found by lists of differences and compared.

Links are counted afterwards, inside components: each set is seen from a common text of its component, pairs whose few
differences can't part them are counted by sums, and only the others that share a difference are compared. So a crowd
of copies around one text costs as much as its differences.

Null and empty texts have no shingles and are linked with nothing; a text with fewer than ``width`` words is one shingle.
Documents without doc_id take part but can't name a component (it is null if all are). Repeated rows are equal sets. An empty
table gives an empty table. Other columns are not looked at. Hashes have 64 bits; two different sets or shingles
that agree in all of them count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.text import hashed_words, mix, pieces, shingles
from foldwise.session import written

SEEN = 500_000  # nodes a task remembers, to index copies once
FILTER_BITS = 23
_LEAST = -(2**63)


def sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each text (ascending), their offsets, and the texts' nodes (0: no shingle)."""
    values, offsets = shingles(*hashed_words(column), width)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(0x51ED270B)), dtype=np.uint64)])
    sizes = np.diff(offsets)
    nodes = mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return values, offsets, np.where(sizes > 0, nodes | np.uint64(1), np.uint64(0))


def size_classes(most: int, percent: int) -> np.ndarray:
    """Largest size of each class, up to one class beyond ``most``. Linked sets lie in one class or in neighbours."""
    tops, low = [], 1
    while not tops or tops[-1] < most * 100 // percent + 1:
        tops.append(max(low, low * 100 // percent))
        low = tops[-1] + 1
    return np.array([*tops, max(low, low * 100 // percent)], np.int64)


def block_keys(values: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all blocks of all sets in both classes, the set each belongs to, and twice its spare lists plus the class (0 or 1).

    A set with f filled blocks that differs in at most d shingles from any partner in the class has f - d blocks or more in
    common with each: one of them is met even if f - d - 1 of its lists are spared.
    """
    sizes = np.diff(offsets)
    tops = size_classes(int(sizes.max(initial=1)), percent)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners, tags = [], [], []
    for step in (0, 1):
        of = np.searchsorted(tops, np.maximum(sizes, 1)) + step
        apart = 2 * tops[of] * (100 - percent) // (100 + percent)  # shingles that linked sets may differ in
        blocks = np.where(sizes > 0, apart + apart // 16 + 3, 0)
        base = np.concatenate([[0], np.cumsum(blocks)])
        place = base[owner] + ((values >> np.uint64(32)) * blocks[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(place, minlength=base[-1])
        ends = np.cumsum(held)
        content = np.diff(sums[np.concatenate([[0], ends])])
        mine = np.repeat(np.arange(len(sizes)), blocks)
        index = (np.arange(base[-1]) - base[mine]).astype(np.uint64)
        # With more filled blocks than may differ, one that is equal is filled: empty blocks need no list.
        filled = np.bincount(mine[held > 0], minlength=len(sizes))
        keep = (held > 0) | (filled <= apart)[mine]
        largest = np.minimum(tops[of], sizes * 100 // percent)  # partner
        spare = np.maximum(filled - (sizes + largest) * (100 - percent) // (100 + percent) - 1, 0)
        keys.append(mix(content + mix(index + (of[mine].astype(np.uint64) << np.uint64(40)) + np.uint64(77)))[keep])
        owners.append(mine[keep])
        tags.append((2 * spare + step)[mine[keep]])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(tags).astype(np.int32)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def nodes(docs: DataFrame, width: int) -> DataFrame:
    """n_shingles and node of every document, and its other columns but the text."""
    kept = [c for c in docs.columns if c != "text"]
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            _, offsets, node = sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.diff(offsets), pa.int64()), signed(node)],
                                             names=[*kept, "n_shingles", "node"])

    return docs.select(*kept, "text").mapInArrow(run, kinds + "n_shingles bigint, node bigint")


def lists(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key, node, leader: index lists with at least two nodes.

    A set leaves as many of its longest lists as it has to spare, so what many texts share alone brings no two together:
    of the blocks that two linked sets share, both keep the one in the shortest list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            values, offsets, node = sets(batch.column("text"), width)
            keep = np.zeros(len(node), bool)
            for i, n in enumerate(node.tolist()):
                if n and n not in seen:
                    keep[i] = True
                    seen.add(n)
            if len(seen) > SEEN:
                seen.clear()
            sizes = np.diff(offsets)
            values = values[np.repeat(keep, sizes)]
            offsets, node = np.concatenate([[0], np.cumsum(sizes[keep])]), node[keep]
            if len(node):
                keys, owner, tags = block_keys(values, offsets, percent)
                yield pa.RecordBatch.from_arrays([signed(keys), signed(node[owner]), pa.array(tags)], names=["key", "node", "tag"])

    rows = docs.select("text").mapInArrow(run, "key bigint, node bigint, tag int")
    ordered = Window.partitionBy("key").orderBy("node")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag("node").over(ordered)
    placed = rows.select("key", "node", "tag", F.first("node").over(whole).alias("_first"), F.last("node").over(whole).alias("_last"),
                         F.count(F.lit(1)).over(whole).alias("_long"), before.alias("_before"))
    shared = placed.filter((F.col("_first") != F.col("_last")) & (F.col("_before").isNull() | (F.col("_before") != F.col("node"))))
    own = Window.partitionBy("node", "tag").orderBy(F.desc("_long"), "key")
    kept = shared.select("key", "node", "tag", F.row_number().over(own).alias("_at")).filter(F.col("_at") > F.shiftright("tag", 1))
    led = kept.select("key", "node", F.min("node").over(Window.partitionBy("key")).alias("leader"),
                      F.max("node").over(Window.partitionBy("key")).alias("_last"))
    return led.filter(F.col("leader") != F.col("_last")).select("key", "node", "leader")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, items (array) for the nodes of ``wanted`` (node, _k: the least doc_id that has it, null as the least number).

    A bitmap of 2^23 bits, at most 131,072 words, drops most other documents before their texts move.
    """
    bit = F.pmod(F.xxhash64("_k"), F.lit(1 << FILTER_BITS))
    bits = wanted.select(bit.alias("_b")).select(F.shiftright("_b", 6).alias("_word"), F.expr("shiftleft(1L, cast(_b & 63 as int))").alias("_bit"))
    bitmap = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("_k"), "text").withColumn("_b", bit)
    near = keyed.join(F.broadcast(bitmap), F.shiftright("_b", 6) == F.col("_word")).filter(
        F.expr("(_bits & shiftleft(1L, cast(_b & 63 as int))) != 0")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values, offsets, node = sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [signed(node), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), signed(values))], names=["node", "items"])

    found = near.mapInArrow(run, "node bigint, items array<bigint>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def linked(overlap: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def compared(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with size_a, size_b and overlap."""
    one = items.select(F.col("node").alias("a"), F.col("items").alias("_x"))
    two = items.select(F.col("node").alias("b"), F.col("items").alias("_y"))
    return pairs.join(two, "b").join(one, "a").select(
        "a", "b", F.size("_x").alias("size_a"), F.size("_y").alias("size_b"), F.size(F.array_intersect("_x", "_y")).alias("overlap"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) from edges a, b: least labels spread and jump until every edge agrees."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root")), "roots")
    while True:
        label = state.select(F.col("node").alias("b"), F.col("root").alias("_r"))
        heard = both.join(label, "b").groupBy(F.col("a").alias("node")).agg(F.min("_r").alias("_n"), F.max("_r").alias("_x"))
        heard = written(state.join(heard, "node"), "heard")
        if heard.filter((F.col("_n") != F.col("root")) | (F.col("_x") != F.col("root"))).isEmpty():
            return state
        # Roots hear what their members hear, then everyone jumps to the root's root.
        lower = heard.select("root", F.least("_n", "root").alias("_n")).groupBy("root").agg(F.min("_n").alias("_n"))
        lower = lower.select(F.col("root").alias("_old"), "_n")
        moved = heard.select("node", F.least("root", "_n").alias("root")).join(lower, F.col("node") == F.col("_old"), "left").select(
            "node", F.least("root", "_n").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        state = written(moved.join(jump, "root", "left").select("node", F.least("root", "_up").alias("root")), "roots")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' ``nodes``, root of every node that is linked with another, and the sets of these nodes (and more)."""
    found = written(nodes(docs, width), "nodes")
    index = written(lists(docs, width, percent), "lists")
    in_lists = index.select("node").distinct()
    least = found.filter(F.col("node") != 0).groupBy("node").agg(
        F.min(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST))).alias("_k"))
    items = written(sets_of(docs, written(least.join(in_lists, "node", "left_semi"), "wanted"), width), "items")
    edges = written(compared(index.filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(),
                             items), "answers")
    good = edges.filter(linked(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent))
    roots = components(good)
    rest = written(compared(open_pairs(index, roots, edges, items, percent), items).filter(
        linked(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent)).select("a", "b"), "late")
    if not rest.isEmpty():
        roots = components(good.select("a", "b").unionByName(rest))
    return found, roots, items


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, node, component_id and n_links, the number of other documents it is linked with, of every document."""
    found, roots, items = classes(docs.select("doc_id", "text"), width, percent)
    copies = found.filter(F.col("node") != 0).groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    counted = links(written(roots.join(copies, "node"), "weighted"), items, percent)
    counted = copies.join(counted, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"))
    nodes_ = rooted(found.filter(F.col("node") != 0).groupBy("node").agg(F.min("doc_id").alias("_id")), roots)
    named = nodes_.join(nodes_.groupBy("root").agg(F.min("_id").alias("component_id")), "root").select("node", "component_id")
    return found.join(named.join(counted, "node"), "node", "left").select(
        "doc_id", "n_shingles", "node", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("_links", F.lit(0)).alias("n_links"))


def open_pairs(index: DataFrame, roots: DataFrame, answers: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of lists with several components that their leader's answers leave open.

    Seen from the leader L, a set x is L without R(x) and with A(x), both known once L and x are compared, so
    overlap(a, b) = |L| - |R(a)| - |R(b)| + what the differences D = R + A of a and b share. A link needs them to share at least
    m = ((percent - 100) |L| + g(a) + g(b)) / (100 + percent), with g(x) = percent (|x| - |L|) + (100 + percent) |R(x)|. Where m is
    at most 0, a and b are both linked with L, so two components mean m >= 1: only pairs that share a difference
    are left, found by lists of differences. Rare differences come first, and as m grows with the differences, those that
    everyone shares (what is peculiar to L) lie beyond the part of D that has to be listed.
    """
    scale, per = F.lit(100 + percent), F.lit(percent)
    rows = rooted(index, roots)
    several = rows.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo != _hi").select("key")
    members = rows.join(several, "key", "left_semi").filter(F.col("node") != F.col("leader")).select("leader", "node", "root").distinct()
    told = answers.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("size_a").alias("_l"), F.col("size_b").alias("_s"), F.col("overlap").alias("_o"))
    members = members.join(told, ["leader", "node"]).withColumns({
        "near": linked(F.col("_o"), F.col("_l"), F.col("_s"), percent),
        "g": per * (F.col("_s") - F.col("_l")) + scale * (F.col("_l") - F.col("_o")), "n": F.col("_l") + F.col("_s") - 2 * F.col("_o")})
    members = written(members, "members")
    least = members.groupBy("leader").agg(F.min("g").alias("_all"), F.min(F.when(~F.col("near"), F.col("g"))).alias("_far")).filter("_far is not null")
    shared = F.ceil(((per - 100) * F.col("_l") + F.col("g") + F.when(F.col("near"), F.col("_far")).otherwise(F.col("_all"))) / scale)
    listed = members.join(least, "leader").withColumn("_most", F.col("n") - F.greatest(shared, F.lit(1)) + 1).filter("_most > 0")
    one = items.select(F.col("node").alias("leader"), F.col("items").alias("_x"))
    two = items.select("node", F.col("items").alias("_y"))
    both = listed.join(two, "node").join(one, "leader")
    gone, came = F.array_except("_x", "_y"), F.transform(F.array_except("_y", "_x"), lambda h: F.bitwise_not(h))
    spread = both.select("leader", "node", F.explode(F.concat(gone, came)).alias("d"))
    # How many members share a difference; those that nobody shares come first in the order and are only counted.
    shared_ = spread.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy("leader", "d"))).filter("_df > 1")
    mine = Window.partitionBy("leader", "node")
    ranked = shared_.withColumns({"_at": F.row_number().over(mine.orderBy("_df", "d")), "_shared": F.count(F.lit(1)).over(mine)})
    known = listed.select("leader", "node", "root", "near", "_l", "g", "n", "_most")
    placed = ranked.join(known, ["leader", "node"]).withColumn("_at", F.col("_at") + F.col("n") - F.col("_shared")).filter(
        F.col("_at") <= F.col("_most")).select("leader", "d", "node", "root", "near", "_l", "g", (F.col("n") - F.col("_at") + 1).alias("_left"))
    placed = written(placed, "placed")
    far = placed.filter(~F.col("near")).select("leader", "d", "_l", F.col("node").alias("a"), F.col("root").alias("_ra"), F.col("g").alias("_ga"), F.col("_left").alias("_fa"))
    any_ = placed.select("leader", "d", "near", F.col("node").alias("b"), F.col("root").alias("_rb"), F.col("g").alias("_gb"), F.col("_left").alias("_fb"))
    enough = scale * F.least("_fa", "_fb") >= (per - 100) * F.col("_l") + F.col("_ga") + F.col("_gb")
    met = far.join(any_, ["leader", "d"]).filter((F.col("_ra") != F.col("_rb")) & (F.col("near") | (F.col("a") < F.col("b"))) & enough)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti")


def links(members: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """node, links: documents of other nodes that a node of ``members`` (node, root, copies) is linked with.

    All links lie inside components. A component's sets are seen from one text L that holds what most of them hold: with R(x),
    A(x), D(x) and g(x) as in ``open_pairs``, which hold for any L, a and b are linked if and only if
    (100 + percent) |D(a) & D(b)| >= g(a) + g(b) - (100 - percent) |L|. Pairs with no more than 0 on the right are
    linked whatever they share, and counted by sums over g; of the others, only those that share a difference are left.
    """
    scale, per = F.lit(100 + percent), F.lit(percent)
    one = items.select(F.col("node").alias("root"), F.col("items").alias("_x"))
    two = items.select("node", F.col("items").alias("_y"))
    both = members.join(two, "node").join(one, "root")
    gone, came = F.array_except("_x", "_y"), F.transform(F.array_except("_y", "_x"), lambda h: F.bitwise_not(h))
    seen = written(both.select("root", "node", "copies", F.size("_x").alias("_l"), F.size("_y").alias("_s"), F.size(gone).alias("_r"),
                               F.concat(gone, came).alias("_d")), "seen")
    # What more than half of the members differ in from their root belongs to the common text.
    most = seen.select("root", "_r", F.posexplode("_d").alias("_at", "d")).groupBy("root", "d").agg(
        F.count(F.lit(1)).alias("_df"), F.max(F.when(F.col("_at") < F.col("_r"), -1).otherwise(1)).alias("_more"))
    many = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    turned = most.join(many, "root").filter(2 * F.col("_df") > F.col("_n")).groupBy("root").agg(F.collect_list("d").alias("_m"), F.sum("_more").alias("_more"))
    none = F.array().cast("array<bigint>")
    seen = seen.join(turned, "root", "left").withColumns({"_m": F.coalesce("_m", none), "_l": F.col("_l") + F.coalesce("_more", F.lit(0))})
    seen = seen.withColumn("d", F.concat(F.array_except("_d", "_m"), F.transform(F.array_except("_m", "_d"), lambda h: F.bitwise_not(h))))
    left = (F.size("d") - F.col("_s") + F.col("_l")) / 2
    seen = written(seen.select("root", "node", "copies", "d", F.size("d").alias("n"), ((100 - per) * F.col("_l")).cast("bigint").alias("free"),
                               (per * (F.col("_s") - F.col("_l")) + scale * left).cast("bigint").alias("g")), "differences")
    slim = seen.select("root", "node", "copies", "n", "free", "g")
    # How many documents have at most a value of g: running sums over a component's values and the bounds asked for.
    values = slim.groupBy("root", F.col("g").alias("_v")).agg(F.sum("copies").alias("_w")).withColumn("_asked", F.lit(0))
    asked = slim.select("root", (F.col("free") - F.col("g")).alias("_v"), F.lit(0).cast("bigint").alias("_w"), F.lit(1).alias("_asked")).distinct()
    upto = values.unionByName(asked).withColumn("_sum", F.sum("_w").over(
        Window.partitionBy("root").orderBy("_v", "_asked").rowsBetween(Window.unboundedPreceding, 0))).filter("_asked = 1")
    upto = upto.select(F.col("root").alias("_root"), "_v", "_sum")
    sure = slim.join(upto, (F.col("root") == F.col("_root")) & (F.col("free") - F.col("g") == F.col("_v"))).select(
        "node", (F.col("_sum") - F.when(2 * F.col("g") <= F.col("free"), F.col("copies")).otherwise(0)).alias("links"))
    # Open pairs share a difference among the rarest n - m + 1 of each; those that nobody shares come first and are only counted.
    ends = slim.groupBy("root").agg(F.min("g").alias("_lo"), F.max("g").alias("_hi"))
    need = F.greatest(F.ceil((F.col("g") + F.col("_lo") - F.col("free")) / scale), F.lit(1))
    listed = seen.join(ends, "root").filter(F.col("g") + F.col("_hi") > F.col("free")).withColumn("_most", F.col("n") - need + 1).filter("_most > 0")
    listed = written(listed.select("root", "node", "copies", "n", "free", "g", "d", "_most"), "listed")
    spread = listed.select("root", "node", F.explode("d").alias("d"))
    shared = spread.groupBy("root", "d").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    mine = Window.partitionBy("node")
    ranked = spread.join(shared, ["root", "d"]).withColumns({"_at": F.row_number().over(mine.orderBy("_df", "d")), "_shared": F.count(F.lit(1)).over(mine)})
    known = listed.select("node", "n", "free", "g", "_most")
    placed = ranked.join(known, "node").withColumn("_at", F.col("_at") + F.col("n") - F.col("_shared")).filter(F.col("_at") <= F.col("_most"))
    placed = written(placed.select("root", "d", "node", "free", "g", (F.col("n") - F.col("_at") + 1).alias("_left")), "placed")
    a = placed.select("root", "d", "free", F.col("node").alias("a"), F.col("g").alias("_ga"), F.col("_left").alias("_fa"))
    b = placed.select("root", "d", F.col("node").alias("b"), F.col("g").alias("_gb"), F.col("_left").alias("_fb"))
    bound = F.col("_ga") + F.col("_gb") - F.col("free")
    met = a.join(b, ["root", "d"]).filter((F.col("a") < F.col("b")) & (bound > 0) & (scale * F.least("_fa", "_fb") >= bound))
    pairs = met.groupBy("a", "b").agg(F.first(bound).alias("_bound"))
    x = listed.select(F.col("node").alias("a"), F.col("d").alias("_x"), F.col("copies").alias("_ca"))
    y = listed.select(F.col("node").alias("b"), F.col("d").alias("_y"), F.col("copies").alias("_cb"))
    true = written(pairs.join(y, "b").join(x, "a").filter(scale * F.size(F.array_intersect("_x", "_y")) >= F.col("_bound")).select("a", "b", "_ca", "_cb"), "links")
    late = true.select(F.col("a").alias("node"), F.col("_cb").alias("links")).unionByName(true.select(F.col("b").alias("node"), F.col("_ca").alias("links")))
    return sure.unionByName(late).groupBy("node").agg(F.sum("links").alias("links"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: of least doc_id (null last), then of least hash. Rows without shingles stay.

    Rows go by doc_id and a hash of all columns (but maps); of rows that agree in both, one stays.
    """
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    marked = docs.withColumn("_row", F.xxhash64(*[x for c in columns for x in (c.isNull(), c)]))
    found, roots, _ = classes(marked.select("doc_id", "_row", "text"), width, percent)
    rows = rooted(found.filter(F.col("n_shingles") > 0).select("doc_id", "_row", "node"), roots)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row")).alias("_first"))
    stays = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_row") == F.col("_first._row"))
    judged = written(rows.join(first, "root").select(F.col("doc_id").alias("_id"), F.col("_row").alias("_hash"), stays.alias("_stays")), "judged")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hash"))
    kept = marked.join(judged.filter(~F.col("_stays")).select("_id", "_hash").distinct(), same, "left_anti")
    again = written(judged.filter("_stays").groupBy("_id", "_hash").count().filter("count > 1").select("_id", "_hash"), "again")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_row"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
