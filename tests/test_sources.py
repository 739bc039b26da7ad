import gzip
import json

from foldwise.sources import results as R
from foldwise.sources import text as T
from foldwise.sources import variants as V


def test_csv_keeps_the_last(spark, tmp_path):
    (tmp_path / "set1.csv").write_text(
        "mutant,DMS_score,mutated_sequence\nA1C,0.5,CAAA\nA2C,bad,ACAA\nA1C,0.7,CAAA\nA3C,1,AAC\nA9C,1,AAAA\nA4D:A2E,2,AEAD\n")
    variants, refs = V.read_csv_variants(spark, str(tmp_path))
    assert [(r["dataset"], r["seq_len"]) for r in refs.collect()] == [("set1", 4)]
    assert {r["variant_id"]: r["fitness"] for r in variants.collect()} == {"A1C": "0.7", "A4D:A2E": "2.0"}


def test_records(spark, tmp_path):
    lines = [("d", "wild_type", '"ACD"'), ("d", "0", '{"mut_info": "A1C", "fitness": 1.5}'), ("d", "length", "3"),
             ("d", "1", "not json"), ("d", "2", '{"mut_info": "C2D", "fitness": "x", "seq": "ADD"}')]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(dict(zip(("dataset", "key", "value"), x, strict=True))) for x in lines))
    variants, refs = V.read_records(spark, str(tmp_path))
    assert refs.collect()[0]["wt"] == "ACD"
    assert {(r["variant_id"], r["fitness"], r["seq"]) for r in variants.collect()} == {("0", "1.5", None), ("2", "x", "ADD")}


def test_result_payloads(spark, tmp_path):
    (tmp_path / "v4__mutant__combined__modulo.json").write_text(json.dumps(
        {"a": {"n_rows": 9, "n_variants": 8, "capped": True, "result": {"0": {"spearman": 0.1, "n": 9, "alphas": [1.0]}, "1": {"spearman": float("nan"), "n": 9}}}}))
    (tmp_path / "v4__aux__auxiliary_only__random__shard3.json").write_text('{"a": {"n_rows": 9, "result": {"spearman": NaN, "n": 9, "alphas": []}}}')
    (tmp_path / "v4__random_position__combined__random.json").write_text('{"b": {"result": {"rho_mean": 0.25, "rho_std": 0.1, "n_draws": 8}}}')
    got = {(r["arm"], r["split"], r["shard"], r["dataset"], r["layer"]): (r["rho"], r["n"]) for r in R.read_results(spark, str(tmp_path)).collect()}
    assert got == {("mutant", "modulo", None, "a", 0): (0.1, 9), ("mutant", "modulo", None, "a", 1): (None, 9),
                   ("aux", "random", 3, "a", None): (None, 9), ("random_position", "random", None, "b", None): (0.25, 8)}


def test_pooling_payload(spark, tmp_path):
    doc = {"a": {"n_rows": 5, "capped": False, "arms": {"mutant": {"modulo": {
        "last_layer__combined": {"ridge": {"spearman": 0.5, "n": 5}, "rf": {"spearman": None, "n": 5}},
        "attention__combined": {"rho": {"ridge": {"spearman": 0.4, "n": 5}}, "layer_weights_per_fold": [[0.1, 0.9]]}}}}}}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    got = {(r["strategy"], r["readout"]): r["rho"] for r in R.parse_pooling(R.read_documents(spark, str(tmp_path))).collect()}
    assert got == {("last_layer", "ridge"): 0.5, ("last_layer", "rf"): None, ("attention", "ridge"): 0.4}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.a2m").write_text(">q one\nACd.\nE-F\n>t > two\nGG\nHH\n")
    with gzip.open(tmp_path / "b.a2m.gz", "wt") as fh:
        fh.write(">z\nKKK\n")
    got = {r["name"]: r["seq"] for r in T.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"q one": "AC-E-F", "t > two": "GGHH", "z": "KKK"}


def test_structure_tokens(spark, tmp_path):
    (tmp_path / "d1.3di.txt").write_text(">h\n##pq\nabcd\nabc\n")
    (tmp_path / "d2").mkdir()
    (tmp_path / "d2" / "structure.3di").write_text("zzzz\n")
    (tmp_path / "d2" / "query.3di").write_text("yy yy\n")
    (tmp_path / "d3.3di.txt").write_text("short\n")
    refs = spark.createDataFrame([("d1", 4), ("d2", 4), ("d3", 4)], "dataset string, seq_len int")
    got = {r["dataset"]: r["tokens"] for r in T.read_structure_tokens(spark, str(tmp_path), refs).collect()}
    assert got == {"d1": "abcd", "d2": "yyyy"}


def test_ca_residues_names_metrics_matrix(spark, tmp_path):
    rec = "ATOM  {:5d} {:<4s}{}{:>3s} A"
    (tmp_path / "m.pdb").write_text("\n".join([
        rec.format(1, " N", " ", "ALA"), rec.format(2, " CA", " ", "ALA"), rec.format(3, " CA", "B", "GLY"),
        rec.format(4, " CA", "A", "TRP"), rec.format(5, " CA", " ", "UNK"), "HETATM"]))
    assert T.read_ca_residues(spark, str(tmp_path / "m.pdb")).collect()[0]["seq"] == "AW"
    (tmp_path / "names.txt").write_text("b\n\na \n")
    assert sorted(r[0] for r in T.read_names(spark, str(tmp_path / "names.txt")).collect()) == ["a", "b"]
    (tmp_path / "m.tsv").write_text("id\tSpearman_rho\trho2\nx\t0.5\t9\ny\t-\t9\nz\t0.1\t9\n")
    r = T.read_metric_mean(spark, str(tmp_path / "m.tsv")).collect()[0]
    assert abs(r["mean"] - 0.3) < 1e-12 and r["n"] == 2
    (tmp_path / "scores").write_text("# note\n   A  R  N\nA  4 -1 -2\nR -1  5  0\nN -2  0  6\n")
    got = {(r["from_aa"], r["to_aa"]): r["score"] for r in T.read_score_matrix(spark, str(tmp_path / "scores")).collect()}
    assert got[("R", "R")] == 5 and got[("A", "N")] == -2 and len(got) == 9


def test_markdown(spark):
    cells = spark.createDataFrame([("m", "random", "+0.1"), ("m", "modulo", "+0.2"), ("k", "random", "+0.3")], "model string, split string, cell string")
    lines = [r["value"] for r in R.markdown(cells, ["model"], "split", ["random", "modulo"]).collect()]
    assert lines == ["| k | +0.3 | — |", "| m | +0.1 | +0.2 |"]
