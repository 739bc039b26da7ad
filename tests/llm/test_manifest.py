"""The Merkle manifest and the sharding against plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import hashlib

import __spark_entry__ as entry
from foldwise.llm import merkle, rendezvous
from tests.harness import DATA, compare, connect
from tests.llm import brute

NAMES = ("doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0


def column():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def audited(docs, height):
    return sorted((tuple(r[c] for c in NAMES) for r in merkle.audit(docs, column(), height).collect()), key=str)


def plain(docs):
    return brute.merkle([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()], tampered)


@pytest.mark.parametrize("levels", range(1, 9))
def test_addresses(levels):
    """Upper half first, lower subtrees behind it from left to right, again inside each."""
    def order(level_top, index, height):
        if height == 1:
            return [(level_top, index)]
        above = height // 2
        out = order(level_top, index, above)
        for k in range(1 << above):
            out += order(level_top - above, (index << above) + k, height - above)
        return out
    for place, (level, index) in enumerate(order(levels - 1, 0, levels)):
        assert merkle.address(levels, level, index) == place == merkle.addresses(levels)[level][index] // merkle.NODE


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_manifest(spark, height):
    rows = [(i if i % 11 else None, f"text {i}", lang, None if i % 5 == 0 else "s", i if i % 4 else None)
            for lang, n in (("en", 37), ("de", 1), (None, 2), ("fr", 8), ("", 3)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got, want = audited(docs, height), plain(docs)
    assert got == want and not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_many_languages(spark):
    """The tree over the subroots takes several tiers as well."""
    docs = spark.createDataFrame([(i, str(i), f"l{i % 23}", "s", i) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    assert audited(docs, 2) == plain(docs)


def test_manifest_edges(spark, odd_docs, no_docs):
    assert audited(odd_docs, 2) == plain(odd_docs)
    assert merkle.audit(no_docs, column()).count() == 0
    one = odd_docs.filter("doc_id = 3")
    [row] = audited(one, 2)
    assert row[2] == row[3] == row[4] == row[6] and row[5] == hashlib.sha256(b"").hexdigest()


def test_sql(spark):
    con = connect("0.001")
    for name in ("op12_merkle_manifest", "op13_rendezvous"):
        assert compare(entry.queries()[name](spark, DATA.format("0.001")), con, entry.oracle_sql()[name]) is None


def shard(key, weights):
    def score(i):
        u = (int(hashlib.md5(f"{'null' if key is None else key}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return weights[i] / -math.log(u)
    return max((i for i, w in enumerate(weights) if w > 0), key=score)


def test_weighted_shards(spark):
    weights = [1.0, 0.0, 3.0, 2.0]
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = rendezvous.assign(docs.repartition(5), weights, [*weights, 2.0]).collect()
    assert all(r["shard"] == shard(r["doc_id"], weights) for r in out)
    assert all(r["grown_shard"] in (r["shard"], 4) for r in out)
    n = Counter(r["shard"] for r in out)
    assert n[1] == 0 and all(abs(n[i] / 6000 - w / 6) < 0.02 for i, w in enumerate(weights))
    moved = sum(r["grown_shard"] == 4 for r in out)
    assert abs(moved / 6000 - 2 / 8) < 0.02
    slots = defaultdict(list)
    for r in sorted(out, key=lambda r: r["doc_id"]):
        slots[r["shard"]].append(r["slot"])
    assert all(s == list(range(len(s))) for s in slots.values())
    with pytest.raises(ValueError):
        rendezvous.assign(docs, [0.0])


def test_hot_key(spark):
    """A third of the rows without key, half of those alike."""
    rows = [(None if i % 3 == 0 else i, "same" if i % 2 else f"t{i}") for i in range(900)]
    out = rendezvous.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), [1.0] * 4).collect()
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1 and all(r["grown_shard"] is None for r in out)
    for k in range(4):
        own = sorted((r for r in out if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"]) for r in own]
        assert order == sorted(order)


def test_shard_edges(odd_docs, no_docs):
    out = rendezvous.assign(odd_docs, [1.0] * 8, [1.0] * 9).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None and r["text"])
    got = sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None and r["size"] > 1)
    assert got == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts) and len(out) == odd_docs.count()
    assert all(r["text_crc32"] == 0 for r in out if r["size"] == 1) and np.unique([r["law"] for r in out]).tolist() == ["key"]
    assert rendezvous.assign(no_docs, [1.0] * 8).count() == 0
