import re

import pytest
from pyspark.sql import functions as F

from foldwise.functions import sequences as S
from foldwise.functions import substitutions as U
from foldwise.operators import folds as X
from foldwise.operators import keyed as K
from foldwise.operators import variants as V
from foldwise.operators.leakage import leakage_report


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("d", str(i), f"A{1 + i % 50}C" + (f":D{1 + (i * 7) % 50}E" if i % 3 == 0 else ""), str(i * 0.5), None) for i in range(60)]
    rows += [("d", "x1", "Z5C", "1.0", None), ("d", "x2", "A5C", "nan", None), ("d", "x3", "A5C", "bad", None),
             ("d", "x4", "A5C", "inf", None), ("d", "x5", "A0C:A51C", "1", None), ("d", "x6", "A5C", "1", "AC"),
             ("d", "x7", "A5C:AxC:A60D", "2", None), ("d", "x8", "A5C", None, None)]
    rows += [("tiny", str(i), "A1C", "1", None) for i in range(4)]
    rows += [("few", str(i), "A1C", "1", None) for i in range(6)]
    refs = [("d", 50), ("tiny", 50), ("few", 50)]
    return (spark.createDataFrame(rows, "dataset string, variant_id string, mut_info string, fitness string, seq string"),
            spark.createDataFrame(refs, "dataset string, seq_len int"))


def test_filters_and_gates(tables):
    rows = V.substitution_rows(*tables, None, None)
    got = rows.toPandas()
    assert set(got["dataset"]) == {"d"}
    bad = set(got["variant_id"]) & {f"x{i}" for i in range(1, 9)}
    assert bad == {"x7"}
    assert got[got["variant_id"] == "x7"][["pos", "n_parsed"]].to_numpy().tolist() == [[5, 2]]


def test_caps_are_exact_and_stable(tables):
    a = V.substitution_rows(*tables, 20, 15).toPandas()
    b = V.substitution_rows(tables[0].repartition(9), tables[1], 20, 15).toPandas()
    assert len(a) == 15 and a["capped"].all() and set(a["row_id"]) == set(b["row_id"])
    one = V.substitution_rows(*tables, 20, None, single_site_only=True).toPandas()
    assert len(one) == 20 and one["variant_id"].nunique() == 20


@pytest.mark.parametrize("scheme", X.SCHEMES)
def test_fold_invariants(tables, scheme):
    rows = V.substitution_rows(*tables, None, None)
    got = X.assign_fold(rows, scheme).toPandas()
    assert len(got) == rows.count() and got["fold"].between(0, 4).all()
    unit = "variant_id" if scheme == "random" else "pos"
    assert (got.groupby(unit)["fold"].nunique() == 1).all()
    if scheme == "position_groupkfold":
        sizes = got.groupby("fold").size()
        assert sizes.max() - sizes.min() <= got.groupby("pos").size().max()


def test_few_positions_give_few_folds(spark):
    rows = spark.createDataFrame([("a", p, f"{p}-{i}") for p in (1, 5, 9) for i in range(10)], "dataset string, pos int, variant_id string")
    assert X.position_groups(rows).select("fold").distinct().count() == 3


def test_random_split_never_leaks(tables):
    rows = X.assign_fold(V.substitution_rows(*tables, None, None), "random", out="fold_random")
    total = leakage_report(rows, ["random"]).filter("dataset is null").collect()[0]
    assert total["leaked_random"] == 0 and total["rows_with_sibling"] > 0


def test_text_functions(spark):
    df = spark.createDataFrame([("ACDEF", "pqrst", "ac.D-e")], "wt string, st string, al string")
    subs = U.parse_substitutions(F.lit("A1W:C2Y:D3"))
    r = df.select(
        U.apply_substitutions(F.col("wt"), subs).alias("seq"), U.model_input(F.col("wt")).alias("plain"),
        U.model_input(F.col("wt"), F.col("st"), True).alias("paired"), U.model_input(F.col("wt"), None, True).alias("bare"),
        U.masked_input(U.model_input(F.col("wt")), F.lit(3)).alias("mask"),
        U.masked_input(U.model_input(F.col("wt"), F.col("st"), True), F.lit(5), True).alias("mask2"),
        S.strip_insertions(F.col("al")).alias("strip"), S.gap_pad(F.lit("abc"), F.lit(2), F.lit(7)).alias("pad"),
        U.index_distance(F.lit("A"), F.lit("Y")).alias("far"), U.index_distance(F.lit("X"), F.lit("C")).alias("odd"),
    ).collect()[0]
    assert r["seq"] == "WYDEF" and r["plain"] == "A C D E F" and r["paired"] == "Ap Cq Dr Es Ft" and r["bare"] == "A# C# D# E# F#"
    assert r["mask"] == "A C <mask> E F" and r["mask2"] == "Ap Cq Dr Es <mask>"
    assert r["strip"] == "-D-" and r["pad"] == "##abc##" and r["far"] == 1.0 and abs(r["odd"] - 1 / 19) < 1e-12


def test_feature_sets(spark):
    df = spark.createDataFrame([([1.0], [2.0], [3.0])], "e array<double>, a array<double>, s array<double>")
    sets = {n: U.feature_set(n, F.col("e"), F.col("a"), F.col("s")) for n in ("combined", "embedding_only", "auxiliary_only", "seq_struct", "struct")}
    r = df.select(*[c.alias(n) for n, c in sets.items()]).collect()[0]
    assert r["combined"] == [1, 2] and r["embedding_only"] == [1] and r["auxiliary_only"] == [2]
    assert r["seq_struct"] == [1, 3, 2] and r["struct"] == [3, 2]


def test_shard_covers_all_once(spark):
    df = spark.createDataFrame([(f"n{i:02d}",) for i in range(23) for _ in range(2)], "dataset string")
    parts = [set(r[0] for r in K.shard(df, s, 3).collect()) for s in range(3)]
    assert set.union(*parts) == {f"n{i:02d}" for i in range(23)} and sum(map(len, parts)) == 23
    assert parts[1] == {f"n{i:02d}" for i in range(1, 23, 3)}


def test_references_are_built_once_per_dataset(spark, tmp_path):
    """A filter on the reference text may not move below the aggregate: there it would build one text per order."""
    from foldwise.plans import bindings as B

    spark.createDataFrame([(i, f"{i % 2 + 1}-X" if i % 3 else None) for i in range(9)], "o_orderkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(30)], "vec_id bigint").write.parquet(f"{tmp_path}/embeddings.parquet")
    refs = B.references(spark, str(tmp_path)).filter(F.length("wt") > 0)
    below = refs._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert "array_join" not in below and "sequence" not in below
    assert {(r.dataset, r.seq_len, len(r.wt)) for r in refs.collect()} == {("1-X", 25, 25), ("2-X", 20, 20)}


def test_substitutions_by_bytes_and_by_characters(spark):
    """Texts of single bytes are changed as bytes; others, and letters of more bytes, by characters; nulls stay null."""
    rows = [("ACDEF", "A1W:C2Y:A1V"), ("éCDéF", "A1W:C4Y"), ("ACDEF", "A9W"), (None, "A1W"), ("ACDEF", None), ("ACDEF", "A2é"), ("", "A1W")]
    df = spark.createDataFrame(rows, "wt string, s string")
    out = df.select(U.apply_substitutions(F.col("wt"), U.parse_substitutions(F.col("s"), strict=False)).alias("seq"))
    assert [r.seq for r in out.collect()] == ["VYDEF", "WCDYF", "ACDEFW", None, None, "AéDEF", "W"]
    assert "as binary" in out._jdf.queryExecution().optimizedPlan().toString()


def test_masked_inputs_are_spread_over_tasks(spark, tmp_path):
    from foldwise.plans.catalog.features import SPOTS, model_input_tokens

    n = 2 * SPOTS + 7
    spark.createDataFrame([(1, "1-X"), (2, "9-Y")], "o_orderkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).withColumnRenamed("id", "vec_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = model_input_tokens(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = [(r.dataset, r.pos) for r in out.select("dataset", "pos").collect()]
    assert len(got) == len(set(got)) == 2 * n - 50 and set(got) == {("1-X", i + 1) for i in range(n - 5)} | {("9-Y", i + 1) for i in range(n - 45)}
    odd = spark.createDataFrame([("éCD",)], "wt string").select(U.masked_input(U.model_input(F.col("wt")), F.lit(2)).alias("m")).collect()[0]
    assert odd.m == "é <mask> D"


def test_characters_are_counted_once_per_reference(spark):
    """No variant asks whether its whole reference takes one byte a character; given or found, the sequence is the same."""
    from foldwise.plans.catalog import features

    plan = features.apply_substitutions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    hashing = [line for line in plan.splitlines() if "md5(" in line]
    assert len(hashing) == 1 and not re.search(r"octet_length\(wt#", hashing[0]) and plan.count("octet_length") >= 2
    df = spark.createDataFrame([("ACDEF",), ("AéDEF",), (None,)], "wt string").withColumn("s", U.single_bytes(F.col("wt"))).withColumn(
        "subs", U.parse_substitutions(F.lit("A1C:D3W:D3Y")))
    for a, b in df.select(U.apply_substitutions(F.col("wt"), F.col("subs")), U.apply_substitutions(F.col("wt"), F.col("subs"), F.col("s"))).collect():
        assert a == b
