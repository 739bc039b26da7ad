"""Placement by shared pieces against sliding every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import alignment


@pytest.mark.parametrize("least", [0.9, 0.75, 1.0])
def test_equals_sliding_all_pairs(spark, least):
    rng = np.random.default_rng(13)
    word = lambda n, letters="ACDE": "".join(rng.choice(list(letters), n))
    longs = [(i, word(int(n))) for i, n in enumerate(rng.integers(1, 120, 40))] + [(100, "A" * 60), (101, ""), (102, None), (0, word(50)), (103, "ACDÉ" * 9)]
    shorts = [(200, "A" * 30), (201, ""), (202, None), (203, "A"), (204, "DÉACDÉAC")]
    for i, (_, t) in enumerate(x for x in longs if x[1] and len(x[1]) > 8):
        a = int(rng.integers(0, len(t) // 2))
        s = list(t[a:a + int(rng.integers(5, len(t) - a + 1))])
        for k in rng.integers(0, len(s), int(rng.integers(0, max(2, len(s) // 8)))):
            s[k] = "C"
        shorts.append((i, "".join(s)))
    a = spark.createDataFrame(longs, "long_id int, long string").repartition(3)
    b = spark.createDataFrame(shorts, "short_id int, short string").repartition(3)
    key = lambda rows: sorted((r["long_id"], r["short_id"], r["start"], round(r["identity"], 9)) for r in rows)
    got = key(alignment.place_everywhere(a, b, least).collect())
    want = alignment.best_offset(a.crossJoin(b), None).filter(F.col("identity") >= least - 1e-9)
    assert got == key(want.collect()) and len(got) > 20
    assert alignment.place_everywhere(a.limit(0), b).count() == alignment.place_everywhere(a, b.limit(0)).count() == 0


def test_messages(spark):
    """The registered query against sliding all pairs, over the whole smallest table."""
    import __spark_entry__ as entry
    from foldwise.plans import bindings as B

    sf = "/root/testdata/sf0.001"
    msgs = B.table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), B.letters("text").alias("t")).collect()
    whole = {i: t for i, t in msgs}
    want = set()
    for i, t in msgs:
        s = t[len(t) // 4:len(t) // 4 + len(t) // 2].replace("W", "C")
        for j, l in msgs:
            best = max(((sum(x == y for x, y in zip(s, l[k:])), -k) for k in range(len(l) - len(s) + 1)), default=(0, 0)) if s and (i == j or s[:4] in l or s[-4:] in l) else (0, 0)
            if s and best[0] >= 0.9 * len(s):
                want.add((j, i, -best[1]))
    got = {(r["long_id"], r["short_id"], r["start"]) for r in entry.queries()["corpus_alignment"](spark, sf).collect()}
    assert want <= got and {(i, i) for i, t in whole.items() if len(t) > 1} <= {(a, b) for a, b, _ in got}
    for a, b, k in got - want:
        t = whole[b]
        s = t[len(t) // 4:len(t) // 4 + len(t) // 2].replace("W", "C")
        assert sum(x == y for x, y in zip(s, whole[a][k:])) >= 0.9 * len(s)


def test_lots_of_shorts_give_the_same_and_no_candidate_travels(spark, monkeypatch):
    """Several lots, small slabs and equal ids; what is kept grows with the texts, not with the pieces that agree by chance."""
    import os

    kept = []

    def noted(df, name, write=alignment.written):
        kept.append(write(df, name))
        return kept[-1]

    rng = np.random.default_rng(14)
    word = lambda n: "".join(rng.choice(list("AC"), n))
    longs = [(i % 30, word(200)) for i in range(40)]
    shorts = [(i % 35, t[50:110] if i % 2 else word(60)) for i, (_, t) in enumerate(longs)]
    a, b = spark.createDataFrame(longs, "long_id int, long string"), spark.createDataFrame(shorts, "short_id int, short string")
    key = lambda rows: sorted((r["long_id"], r["short_id"], r["start"], round(r["identity"], 9)) for r in rows)
    want = key(alignment.best_offset(a.crossJoin(b), None).filter(F.col("identity") >= 0.9 - 1e-9).collect())
    monkeypatch.setattr(alignment, "_SLAB", 50)
    monkeypatch.setattr(alignment, "written", noted)
    for letters in (10**6, 500):
        assert key(alignment.place_everywhere(a, b, letters=letters).collect()) == want
    assert len(want) >= 20 and len(kept) > 6
    assert sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for df in kept for f in df.inputFiles()) < 400_000
