"""The parts that the operators are built on."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from foldwise.llm import bpe, fingerprints, jaccard, text
from foldwise.llm.elias_fano import EliasFano
from tests.llm import brute


@given(st.lists(st.integers(0, 2**63), max_size=300), st.integers(1, 2**40))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, scale):
    values = np.array(sorted(v // scale for v in values), np.uint64)
    header, arrays = EliasFano.arrays(values)
    series = EliasFano(**header, **arrays)
    assert (series.all() == values).all() and (series.get(np.arange(len(values))) == values).all()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), np.array([0, 2**50], np.uint64)]))
    at, there = series.successor(asked)
    assert (at[there] == np.searchsorted(values, asked)[there]).all() and (there == np.isin(asked, values)).all()


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def machine(ranks):
    return bpe.Transducer(ranks)


@given(st.text(max_size=60) | st.text(alphabet="aeinorst", max_size=80))
@settings(max_examples=200, deadline=None)
def test_transducer_equals_merging(ranks, machine, s):
    piece = s.encode()
    if piece:
        want = (ranks[piece],) if piece in ranks else tuple(ranks[t] for t in brute.merged(piece, ranks))
        assert machine.encode(piece) == want


def test_transducer_lag_is_bounded(machine):
    """Owed tokens of live paths never reach back further than the longest token."""
    number = 0
    for byte in b"internationalisation" * 50:
        number, _ = machine.step(number, byte)
        assert all(len(path[2]) <= machine.longest for path in machine.sets[number])
        assert max(len(path[0]) for path in machine.sets[number]) <= machine.longest


@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=40))
@settings(max_examples=200, deadline=None)
def test_streaming_decoder(data, cuts):
    table = [bytes([i]) for i in range(256)]
    decoder, out, at = bpe.Decoder(table), "", 0
    for n in cuts:
        out += decoder.push(data[at:at + n])
        at += n
    out += decoder.push(data[at:]) + decoder.close()
    assert out == data.decode("utf-8", "replace")


@given(st.lists(st.none() | st.text(alphabet="ab \n\tCé\x0b\u00a0", max_size=30), max_size=12), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_hashed_words_and_shingles(texts, width):
    hashes, offsets = text.hashed_words(pa.array(texts, pa.string()))
    known = {}
    for i, t in enumerate(texts):
        ws = brute.words(t, True)
        assert offsets[i + 1] - offsets[i] == len(ws)
        for w, h in zip(ws, hashes[offsets[i]:offsets[i + 1]].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    values, to = text.shingles(hashes, offsets, width)
    assert np.diff(to).tolist() == [len(brute.shingle_set(t, width)) for t in texts]


@given(st.integers(1, 400), st.integers(0, 60), st.sampled_from([80, 90]), st.integers(0, 2**32))
@settings(max_examples=80, deadline=None)
def test_linked_sets_share_a_block(size, edits, percent, seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    keep = base[rng.random(len(base)) >= edits / 1000]
    other = np.unique(np.concatenate([keep, rng.integers(0, 2**64, edits // 8, dtype=np.uint64)]))
    if len(other) == 0:
        return
    shared = len(np.intersect1d(base, other))
    values = np.concatenate([base, other])
    keys, owner, tags = jaccard.block_keys(values, np.array([0, len(base), len(values)]), percent)
    if 100 * shared >= percent * (len(base) + len(other) - shared):
        one, two = ({k: t for k, t, o in zip(keys.tolist(), tags.tolist(), owner.tolist()) if o == i} for i in (0, 1))
        met = Counter((one[k], two[k]) for k in one.keys() & two.keys())  # by class
        assert met and all(n > max(a >> 1, b >> 1) for (a, b), n in met.items())


def test_jaccard_with_passages_that_many_share(spark):
    """Long passages in most texts make the lists long that are spared; links around the threshold stay."""
    rng = np.random.default_rng(23)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    passages = [[word() for _ in range(n)] for n in (50, 90, 120)]
    rows = []
    for k in range(60):
        own = [word() for _ in range(int(rng.integers(5, 160)))]
        t = own[: len(own) // 2] + passages[k % 3] + own[len(own) // 2:] + (passages[(k + 1) % 3] if k % 2 else [])
        rows.append(" ".join(t))
        for i in rng.choice(len(t), int(rng.integers(0, 6)), replace=False):
            t[i] = word()
        rows.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    for width, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, width, percent).collect()}
        assert got == {d: v[:2] for d, v in brute.jaccard_components(list(enumerate(rows)), width, percent).items()}


def test_jaccard_on_chains_and_crowds(spark):
    """Chains, a crowd of copies edited apart, and strangers, at two thresholds."""
    rng = np.random.default_rng(5)
    rows, word = [], lambda: f"w{rng.integers(0, 10**6)}"
    base = [word() for _ in range(200)]
    for k in range(40):
        t = list(base)
        for i in rng.choice(200, int(rng.integers(0, 4)), replace=False):
            t[i] = word()
        rows.append(" ".join(t))
    chain = [word() for _ in range(120)]
    for k in range(10):
        rows.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    rows += [" ".join(word() for _ in range(int(rng.integers(1, 90)))) for _ in range(40)] + rows[:7]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    for width, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, width, percent).collect()}
        assert got == {d: v[:2] for d, v in brute.jaccard_components(list(enumerate(rows)), width, percent).items()}


def test_jaccard_links(spark):
    """Link counts: copies, crowds around a text with few and many edits, edits in common, and a chain, at two thresholds."""
    rng = np.random.default_rng(11)
    rows, word = [], lambda: f"w{rng.integers(0, 10**6)}"
    for size, edits in ((60, 4), (200, 9), (300, 4)):
        base, common = [word() for _ in range(size)], [word() for _ in range(3)]
        for k in range(40):
            t = list(base)
            if k % 2:
                t[5:8] = common
            for i in rng.choice(size, int(rng.integers(0, edits)), replace=False):
                t[i] = word()
            rows.append(" ".join(t))
    chain = [word() for _ in range(120)]
    for k in range(12):
        rows += [" ".join(chain)] * (1 + k % 3)
        chain = chain[1:] + [word()]
    rows += ["", "one", "one", *rows[:7]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    for width, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(df, width, percent).collect()}
        assert got == brute.jaccard_components(list(enumerate(rows)), width, percent)


def test_peeling_recovers_differences(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        common = rng.integers(-2**62, 2**62, int(rng.integers(0, 60))).tolist()
        rows.append((i, common + rng.integers(-2**62, 2**62, int(rng.integers(0, 40))).tolist(), common + rng.integers(-2**62, 2**62, int(rng.integers(0, 40))).tolist()))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    df = df.withColumns({"ca": fingerprints.sketches(F.col("a")), "cb": fingerprints.sketches(F.col("b"))})
    out = fingerprints.with_difference(df, F.col("a"), F.col("b"), "ca", "cb", "d").select("i", "d.*").collect()
    for r in out:
        _, a, b = rows[r["i"]]
        assert (r["left"], r["right"]) == (len(set(a) - set(b)), len(set(b) - set(a)))
    assert {r["retried"] for r in out} == {True, False}
    assert sum(r["by_digests"] for r in out) <= 3


def test_fingerprints_compare_without_texts(spark):
    """Sets of very different sizes, equal, empty and disjoint ones, from the fingerprints' text alone."""
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(-2**62, 2**62, n).tolist()
    long = draw(700)
    rows = [([], []), ([], draw(5)), (long, long), (long, long[:650] + draw(50)), (long, draw(3)), (long, draw(700)), (draw(40), long), (long[:9], long)]
    rows += [(own + draw(int(rng.integers(0, 30))), own + draw(int(rng.integers(0, 90)))) for own in (draw(int(rng.integers(0, 50))) for _ in range(40))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<bigint>, b array<bigint>")
    text = lambda c: fingerprints.serialised(F.col(c), fingerprints.sketches(F.col(c)))
    stored = df.select("i", text("a").alias("x"), text("b").alias("y")).union(spark.createDataFrame([(-1, None, "0:")], "i int, x string, y string"))
    got = {r["i"]: r["near"] for r in fingerprints.compare(stored, "x", "y", "near").collect()}
    assert got.pop(-1) is None
    want = [len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0 for a, b in rows]
    known = [i for i in range(len(rows)) if got[i] is not None]
    assert [got[i] for i in known] == pytest.approx([want[i] for i in known]) and len(known) >= len(rows) - 2


def test_driver_holds_four_byte_features(spark):
    """The documents a view is fitted on come to the driver as they leave the tasks, and score as eight-byte numbers do."""
    from foldwise.llm import quality

    docs = spark.createDataFrame([(i, f"w{i} w{i % 3} common W{i}" if i else None, "s", "en", i) for i in range(9)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    ids, x, _ = quality.features(docs, docs.select("doc_id").filter("doc_id <> 4"))
    assert ids.tolist() == [0, 1, 2, 3, 5, 6, 7, 8] and x.slots.dtype == np.int32 and x.values.dtype == np.float32
    w = np.random.default_rng(1).normal(size=quality.CONTENT_SLOTS)
    wide = quality.Sparse(x.slots.astype(np.int64), x.values.astype(float), x.offsets)
    for rows in (np.arange(8), np.array([5, 2, 2])):
        assert np.array_equal(x.take(rows).dot(w), wide.take(rows).dot(w))


def test_fitting_needs_little_beside_two_bytes_an_entry(spark):
    """The driver's memory for a fit doesn't hold the entries of all documents in wider numbers, and the weights are those of wide ones."""
    import tracemalloc

    from foldwise.llm import quality

    texts = [" ".join(f"w{(i * 7919 + k * 31) % 9973}" for k in range(2000)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "s", "en", i) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    _, x, _ = quality.features(docs, docs.select("doc_id"))
    rows, y = np.arange(1000) % 40, np.arange(1000) % 40 % 3 // 2 * 1.0
    tracemalloc.start()
    many = x.take(rows)
    w = quality.fit(many, y, quality.CONTENT_SLOTS, np.ones(1000), steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    entries = many.offsets[-1]
    assert entries > 1_900_000 and peak < 12 * entries
    wide = quality.Sparse(many.slots.astype(np.int64), many.values.astype(float), many.offsets)
    assert np.allclose(w, quality.fit(wide, y, quality.CONTENT_SLOTS, np.ones(1000), steps=3), rtol=0, atol=1e-12)
