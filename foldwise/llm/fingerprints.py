"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, long ones cut after every ``PARAGRAPH`` words. The distinct 64-bit digests are
dealt to blocks by the low bits of a hash, as many blocks (a power of two) as leave a block ``FILL`` digests or fewer
on average. A block is a sketch of ``CELLS`` cells (count, xor of digests, xor of check hashes), in which each digest
is in one cell of each of four sub-tables. The fingerprint is the number of digests and all these cells.

Two fingerprints are compared by their cells. The one of more blocks folds onto the other: blocks that agree in the
remaining bits add up, cell by cell. Then they subtract: what both texts have cancels, and cells left with a single
digest are peeled until none is left. Then the digests of either side alone are known, and with the sizes the
likeness, shared / all. Where peeling stops early (a much longer text beside a short one, a knot of digests in the same
cells), each fingerprint is peeled by itself, which lists its digests, and sketches of 96, then 192 and 384 cells a
block are made of both lists under other hashes (``retried``). Only where a fingerprint can't even list its own
digests are those of the text taken (``by_digests``); ``compare`` works on two fingerprints without the texts.

Everything is SQL functions on columns. A null text counts as empty; a text without words has no paragraphs, and
two such texts have likeness 1. Texts with equal paragraphs have equal fingerprints. Repeated rows are versions of
their own; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.text import bind, words
from foldwise.session import written

PARAGRAPH = 32
FILL = 12
CELLS = 48
TABLES = 4
BLOCK = 24
RETRIES = (96, 192, 384)
ROUNDS = 14
BUCKET_ROWS = 1_000
MOST_BUCKETS = 32_768
_ZERO = "cast(0 as bigint)"


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(PARAGRAPH))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, PARAGRAPH)))

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_distinct(F.flatten(F.transform(lines, lambda line: bind(words(line), cut))))


def _power(n: Column) -> Column:
    """The least power of two that is at least ``n``, and 1."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n)))).cast("int")


def dealt(keys: Column, blocks: Column) -> Column:
    """``keys`` in ``blocks`` arrays (a power of two) by the low bits of a hash; in about its root of parts first."""
    def deal(n: Column, width: Column) -> Column:
        hashed = F.transform(keys, lambda k: F.struct(k.alias("k"), F.pmod(F.xxhash64(k, F.lit(-2)), n).cast("int").alias("at")))
        own = lambda part, j: F.transform(F.filter(part, lambda x: x["at"] % width == j), lambda x: x["k"])
        split = lambda part: F.transform(F.sequence(F.lit(0), width - 1), lambda j: own(part, j))
        return bind(hashed, lambda x: F.flatten(F.transform(
            F.sequence(F.lit(0), (n / width).cast("int") - 1), lambda h: bind(F.filter(x, lambda y: F.floor(y["at"] / width) == h), split))))

    return bind(blocks, lambda n: bind(F.pow(F.lit(2.0), F.floor(F.log2(n) / 2)).cast("int"), lambda width: deal(n, width)))


def _slots(key: Column, cells: int) -> list[Column]:
    """The key's cell in each sub-table, numbered through."""
    part = cells // TABLES
    return [(F.pmod(F.xxhash64(key, F.lit(cells * 8 + t)), F.lit(part)) + t * part).cast("int").alias(f"s{t}") for t in range(TABLES)]


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1)).bitwiseAND(F.lit(2**32 - 1)).alias("c")


def _xor(values: Column, name: str) -> Column:
    return F.aggregate(values, F.expr(_ZERO), lambda a, x: a.bitwiseXOR(x[name]))


def sketch(keys: Column, cells: int) -> Column:
    """Array of ``cells`` cells (n, k, c)."""
    part = cells // TABLES
    keyed = F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k), *_slots(k, cells)))

    def build(own: Column) -> Column:
        cell = lambda t: lambda j: bind(F.filter(own, lambda x: x[f"s{t}"] == j), lambda f: F.struct(
            F.size(f).alias("n"), _xor(f, "k").alias("k"), _xor(f, "c").alias("c")))
        return F.concat(*[F.transform(F.sequence(F.lit(t * part), F.lit((t + 1) * part - 1)), cell(t)) for t in range(TABLES)])

    return bind(keyed, build)


def sketches(keys: Column) -> Column:
    """The blocks of a set of digests, a sketch each."""
    return F.transform(dealt(keys, _power(F.size(keys) / F.lit(float(FILL)))), lambda own: sketch(own, CELLS))


def _combine(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] + y["n"] * sign).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def subtract(a: Column, b: Column) -> Column:
    return _combine(a, b, -1)


def folded(blocks: Column, n: Column) -> Column:
    """The same set in ``n`` blocks, at most as many as there are."""
    def gather(j: Column) -> Column:
        return F.aggregate(F.filter(blocks, lambda _, i: (i >= n) & (i % n == j)), blocks[j], lambda x, y: _combine(x, y, 1))

    return F.when(F.size(blocks) == n, blocks).otherwise(F.transform(F.sequence(F.lit(0), n - 1), gather))


def peel(cells: Column, count: int) -> Column:
    """(done, left, right): whether every cell became empty, and the digests that only the first and only the second has."""
    part = count // TABLES
    none = F.array().cast("array<bigint>")

    def rounds(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(
            F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"]))),
            lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), *_slots(x["k"], count))))

        def take(found: Column) -> Column:
            def clear(t: int, x: Column, j: Column) -> Column:
                mine = F.filter(found, lambda p: p[f"s{t}"] == j + t * part)
                return bind(mine, lambda m: F.when(F.size(m) == 0, x).otherwise(F.struct(
                    F.aggregate(m, x["n"], lambda a, p: a - p["n"]).alias("n"),
                    F.aggregate(m, x["k"], lambda a, p: a.bitwiseXOR(p["k"])).alias("k"),
                    F.aggregate(m, x["c"], lambda a, p: a.bitwiseXOR(p["c"])).alias("c"))))

            def table(t: int) -> Column:
                return F.transform(F.slice(state["cells"], t * part + 1, part), lambda x, j: clear(t, x, j))

            side = lambda n: F.transform(F.filter(found, lambda p: p["n"] == n), lambda p: p["k"])
            ended = F.struct(*[state[c].alias(c) for c in ("cells", "left", "right")], F.lit(True).alias("over"))
            return F.when(F.size(found) == 0, ended).otherwise(F.struct(
                F.concat(*[table(t) for t in range(TABLES)]).alias("cells"),
                F.concat(state["left"], side(1)).alias("left"), F.concat(state["right"], side(-1)).alias("right"), F.lit(False).alias("over")))

        return F.when(state["over"], state).otherwise(bind(pure, take))

    start = F.struct(cells.alias("cells"), none.alias("left"), none.alias("right"), F.lit(False).alias("over"))
    empty = lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, rounds, lambda s: F.struct(
        F.forall(s["cells"], empty).alias("done"), s["left"].alias("left"), s["right"].alias("right")))


def serialised(keys: Column, blocks: Column) -> Column:
    """The fingerprint as text: number of digests, then the cells of all blocks, 14 bytes each."""
    part = lambda x: F.concat(F.lpad(F.hex(x["n"]), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["c"]), 8, "0"))
    packed = F.base64(F.unhex(F.array_join(F.transform(F.flatten(blocks), part), "")))
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.regexp_replace(packed, r"\s", ""))


def parsed(fingerprint: Column) -> Column:
    """The blocks of a fingerprint's text."""
    def read(digits: Column) -> Column:
        number = lambda at, width: F.conv(F.substr(digits, at.cast("int"), F.lit(width)), 16, -10).cast("bigint")
        cell = lambda at: F.struct(number(at, 4).cast("int").alias("n"), number(at + 4, 16).alias("k"), number(at + 20, 8).alias("c"))
        block = lambda b: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: cell((b * CELLS + i) * 28 + 1))
        return F.transform(F.sequence(F.lit(0), (F.length(digits) / (28 * CELLS)).cast("int") - 1), block)

    return bind(F.hex(F.unbase64(F.substring_index(fingerprint, ":", -1))), read)


def _listed(blocks: Column, keys: Column) -> Column:
    """(own, keys): the digests that the blocks give by themselves, or else ``keys``."""
    def read(peeled: Column) -> Column:
        own = F.forall(peeled, lambda p: p["done"])
        return F.struct(own.alias("own"), F.when(own, F.flatten(F.transform(peeled, lambda p: p["left"]))).otherwise(keys).alias("keys"))

    return bind(F.transform(blocks, lambda x: peel(x, CELLS)), read)


def _sums(found: Column, retried: Column, by_digests: Column) -> Column:
    total = lambda side: F.aggregate(found, F.lit(0), lambda n, x: n + F.size(x[side]))
    return F.struct(total("left").alias("left"), total("right").alias("right"), retried.alias("retried"), by_digests.alias("by_digests"))


def with_difference(df: DataFrame, a: Column, b: Column, cells_a: str, cells_b: str, out: str) -> DataFrame:
    """``df`` with ``out``: (left, right, retried, by_digests), the numbers of digests that only the first and only the second has.

    ``a`` and ``b`` are the digests, for blocks that can't list them; where these are null, ``left`` and ``right`` are.
    """
    one, two = F.col(cells_a), F.col(cells_b)
    df = df.withColumn("_peeled", bind(F.least(F.size(one), F.size(two)), lambda n: F.zip_with(
        folded(one, n), folded(two, n), lambda x, y: peel(subtract(x, y), CELLS))))
    df = df.withColumn("_done", F.forall("_peeled", lambda p: p["done"]))
    df = df.withColumns({"_l": F.when(~F.col("_done"), _listed(one, a)), "_r": F.when(~F.col("_done"), _listed(two, b))})
    left, right = F.col("_l.keys"), F.col("_r.keys")
    dealt_pairs = bind(_power((F.size(left) + F.size(right)) / F.lit(float(BLOCK))), lambda n: F.zip_with(
        dealt(left, n), dealt(right, n), lambda x, y: F.struct(x.alias("a"), y.alias("b"))))
    df = df.withColumn("_blocks", F.when(left.isNotNull() & right.isNotNull(), dealt_pairs))
    tries = lambda p, cells: peel(subtract(sketch(p["a"], cells), sketch(p["b"], cells)), cells)
    df = df.withColumn("_found", F.transform("_blocks", lambda p: tries(p, RETRIES[0])))

    def again(df: DataFrame, cells: int) -> DataFrame:
        return df.withColumn("_found", F.zip_with("_blocks", "_found", lambda p, r: F.when(r["done"], r).otherwise(tries(p, cells))))

    for cells in RETRIES[1:]:
        df = again(df, cells)
    last = F.zip_with("_blocks", "_found", lambda p, r: F.when(r["done"], r).otherwise(F.struct(
        F.lit(True).alias("done"), F.array_except(p["a"], p["b"]).alias("left"), F.array_except(p["b"], p["a"]).alias("right"))))
    by_digests = ~(F.col("_l.own") & F.col("_r.own"))
    first = _sums(F.col("_peeled"), F.lit(False), F.lit(False))
    return df.withColumn("_found", last).withColumn(out, F.when(F.col("_done"), first).otherwise(
        _sums(F.col("_found"), F.lit(True), by_digests))).drop("_peeled", "_done", "_l", "_r", "_blocks", "_found")


def likeness(n_a: Column, n_b: Column, diff: Column) -> Column:
    union = n_a + diff["right"]
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a - diff["left"]) / F.when(union > 0, union))


def compare(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with ``out``: the likeness of two columns of fingerprints; null where one is null or can't list its digests."""
    size = lambda c: F.substring_index(c, ":", 1).cast("int")
    none = F.lit(None).cast("array<bigint>")
    df = with_difference(df.withColumns({"_a": parsed(F.col(a)), "_b": parsed(F.col(b))}), none, none, "_a", "_b", "_diff")
    return df.withColumn(out, likeness(size(F.col(a)), size(F.col(b)), F.col("_diff"))).drop("_a", "_b", "_diff")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``key``: a coarse list first, then one of its stretches."""
    if not bounds:
        return F.lit(0)
    width = 128
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    coarse = at_most(longs(bounds[::width]))
    fine = F.array(*[longs(bounds[i:i + width]) for i in range(0, len(bounds), width)])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + at_most(F.element_at(fine, F.greatest(coarse, F.lit(1)))))


def with_next(docs: DataFrame) -> DataFrame:
    """Every row with the text and digests of the next one in order of doc_id (the last one has the first).

    Ranges of doc_id are windows of about ``BUCKET_ROWS`` rows; the first document of a range also goes to the end
    of the range before. Rows of one doc_id stand in the order of their texts; null stands first.
    """
    spot = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)).cast("bigint")))
    low, n = spot.agg(F.min("_k"), F.count(F.lit(1))).first()
    buckets = min(MOST_BUCKETS, -(-n // BUCKET_ROWS))
    found = spot.agg(F.percentile_approx("_k", [i / buckets for i in range(1, buckets)], 4 * buckets)).first()[0] if buckets > 1 else []
    cuts = sorted({x for x in found if x > low})
    # Quantiles pass through doubles; the least id beyond each is where its range begins.
    begins = spot.groupBy(_place(F.col("_k"), cuts).alias("_at")).agg(F.min("_k").alias("_first")).collect() if cuts else []
    bounds = sorted(r["_first"] for r in begins if r["_first"] > low)
    place = _place(F.col("_k"), bounds)
    last = len(bounds)
    firsts = F.col("_k").isin(*bounds) if 0 < last <= 64 else F.array_contains(F.array(*[F.lit(b).cast("bigint") for b in bounds]), F.col("_k")) if last else F.lit(False)
    entry = lambda bucket, turn: F.struct(bucket.cast("int").alias("bucket"), F.lit(turn).alias("turn"))
    where = F.array(entry(place, 0))
    where = F.when(firsts, F.concat(where, F.array(entry(place - 1, 1)))).otherwise(where)
    if low is not None:
        where = F.when(F.col("_k") == F.lit(low).cast("bigint"), F.concat(where, F.array(entry(F.lit(last), 2)))).otherwise(where)
    dealt = spot.withColumn("_at", F.explode(where))
    order = Window.partitionBy("_at.bucket").orderBy("_at.turn", "_k", "_text")
    ahead = dealt.withColumns({"_next": F.lead("_text").over(order), "_next_keys": F.lead("_keys").over(order)})
    return ahead.filter(F.col("_at.turn") == 0).drop("_at", "_k")


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, retried and by_digests."""
    new = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "retried", "by_digests")
    keep = [c for c in docs.columns if c not in {*new, "text"}]
    source = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    ahead = with_next(source.withColumn("_keys", digests(F.col("_text"))))
    n = F.length("_text")
    moved = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.col("_text").substr(F.lit(1), n - moved), F.col("_next").substr(F.lit(1), moved))
    made = ahead.withColumns({"n_chars": n.cast("bigint"), "_edited": edited}).withColumns({
        "edited_sha256": F.sha2(F.col("_edited").cast("binary"), 256), "_edited_keys": digests(F.col("_edited"))})
    # Written once: the sketches read every digest many times.
    made = written(made.drop("_text", "_next", "_edited"), "digests").withColumns({
        "_cells": sketches(F.col("_keys")), "_edited_cells": sketches(F.col("_edited_keys")), "_next_cells": sketches(F.col("_next_keys"))})
    made = with_difference(made, F.col("_keys"), F.col("_edited_keys"), "_cells", "_edited_cells", "_d")
    made = with_difference(made, F.col("_keys"), F.col("_next_keys"), "_cells", "_next_cells", "_e")
    return made.select(
        *keep, "n_chars", "edited_sha256", serialised(F.col("_keys"), F.col("_cells")).alias("fingerprint"),
        serialised(F.col("_edited_keys"), F.col("_edited_cells")).alias("edited_fingerprint"),
        likeness(F.size("_keys"), F.size("_edited_keys"), F.col("_d")).alias("near_edited"),
        likeness(F.size("_keys"), F.size("_next_keys"), F.col("_e")).alias("near_next"),
        (F.col("_d.retried") | F.col("_e.retried")).alias("retried"), (F.col("_d.by_digests") | F.col("_e.by_digests")).alias("by_digests"))
