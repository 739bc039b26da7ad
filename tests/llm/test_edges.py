"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from foldwise.llm import bpe, fingerprints, jaccard, lm, mixing, quality, quotes, rules, token_files, urls
from foldwise.llm.text import word_count
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_host_rules(odd_docs, no_docs):
    measured = rules.measure(odd_docs)
    out = rules.judge(measured, rules.host_rates(measured)).collect()
    assert len(out) == odd_docs.count() and {"key", "copies"} <= set(out[0].asDict())
    for r in out:
        assert {c: r[c] for c in rules.MEASURES} == brute.rules(r["text"])
    kept = brute.host_verdicts([(r["source"], r["base_failed"]) for r in out])
    assert [r["kept"] for r in out] == kept
    empty = rules.measure(no_docs)
    assert rules.judge(empty, rules.host_rates(empty)).count() == 0


def test_hot_host_is_rejected(spark):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, good if i % 3 else "x", "bad" if i % 3 == 0 or i % 7 == 0 else "fine") for i in range(300)]
    measured = rules.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = rules.judge(measured, rules.host_rates(measured)).collect()
    assert not any(r["kept"] for r in out if r["source"] == "bad") and all(r["kept"] for r in out if r["source"] == "fine")
    assert any(not r["base_failed"] for r in out if r["source"] == "bad")


def test_bad_hosts_of_the_given_table_are_rejected(spark):
    """Two hosts of the given documents, three quarters of their texts spoilt, go; all others stay, also a small one that failed once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    spoilt = docs.withColumn("text", F.expr("case when source in ('src3', 'src7') and crc32(cast(doc_id as string)) % 4 > 0 then 'Too short.' else text end"))
    more = spark.createDataFrame([(10**9 + i, "tiny", t) for i, t in enumerate(["too short", " ".join(f"w{k}" for k in range(40))])], spoilt.schema)
    for table, gone in ((docs, set()), (spoilt.unionByName(more), {"src3", "src7"})):
        measured = rules.measure(table)
        out = rules.judge(measured, rules.host_rates(measured)).collect()
        assert [r["kept"] for r in out] == brute.host_verdicts([(r["source"], r["base_failed"]) for r in out])
        lost = {r["source"] for r in out if not r["kept"] and not r["base_failed"]}
        assert lost == gone and not any(r["kept"] for r in out if r["source"] in gone)


def test_mixing(odd_docs, no_docs):
    slim = odd_docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    goals = mixing.targets(slim)
    sizes = {r["source"]: r["source_size"] for r in goals.collect()}
    assert {r["source"]: pytest.approx(r["target"]) for r in goals.collect()} == brute.targets(sizes)
    out = mixing.copies(slim, goals).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["copies"] <= 2 for r in out)
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(no_docs).count() == 0


def test_byte_bpe(odd_docs, no_docs):
    out = bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    want = brute.byte_bpe(texts, RANKS, public_tokenizers.PATTERN)
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out] == want
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write(odd_docs, path, 2, 49_408)
    order = sorted((tuple(r) for r in odd_docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = brute.token_ids(order, path)
    assert sorted(map(tuple, token_files.digest(manifest).collect()), key=lambda r: r[1]) == want
    whole = [i for r in manifest.orderBy("shard").collect() for i in token_files.whole(spark, manifest, r["shard"]).tolist()]
    assert len(whole) == want[-1][1] + want[-1][2] and whole[-1] == 2
    assert token_files.digest(token_files.write(no_docs, path, 2, 49_408)).count() == 0


def test_token_files_tell_null_from_minus_one(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(-1, "one two"), (None, "three"), (0, "")], "doc_id long, text string")
    got = token_files.digest(token_files.write(docs, path, 2, 49_408)).orderBy("start").collect()
    assert list(map(tuple, got)) == brute.token_ids([(None, "three"), (-1, "one two"), (0, "")], path)


@given(st.lists(st.text("aAhHzÉé×ßÿ\u0331\u0301İKǅ'’_-,.!09 \t\n\x1f\u00a0\u2028ªµ²\U0001F600<|", max_size=12), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_of_odd_texts(texts):
    words = _WORDS.get("words") or _WORDS.setdefault("words", token_files.Words(public_tokenizers.path("word_bpe_49k.json"), "<u2"))
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert ids == b"".join(i.to_bytes(2, "little") for i in words.tokenizer.encode(text, add_special_tokens=False).ids)


_WORDS = {}


def test_words_with_special_tokens():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = token_files.Words(path, "<u2")
    for text in ("a<|endoftext|>b <|startoftext|> c", "<|endoftext|>", "A\u0301\u00a0b \u2028c  ", "it's 1234 e\u0301t\u00e9", "\x1c x"):
        [(_, _, n, _)] = brute.token_ids([(0, text)], path)
        [ids] = words.encode([text])
        assert len(ids) // 2 == n - 1
        assert ids == b"".join(i.to_bytes(2, "little") for i in words.tokenizer.encode(text, add_special_tokens=False).ids)


def test_jaccard(odd_docs, no_docs):
    out = jaccard.join(odd_docs).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in out)
    n = len(brute.shingle_set(brute.words and " ".join(["lorem ipsum dolor"] * 9), 3))
    full = len(brute.shingle_set("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", 3))
    assert got == sorted([(1, full, 1), (1, full, 1), (2, 0, 2), (3, 0, 3), (4, n, 4), (-1, full + 1, 1), (5, 0, 5), (6, 1, 6), (7, full, 1),
                          (8, next(r["n_shingles"] for r in out if r["doc_id"] == 8), 8), (-1, 0, -1)])
    assert jaccard.join(no_docs).count() == 0
    kept = jaccard.one_of_each(odd_docs, 5, 80)
    assert kept.columns == odd_docs.columns and jaccard.one_of_each(no_docs, 5, 80).count() == 0


def test_one_of_each(spark, odd_docs):
    """Null ids, an id with two texts, repeated rows; one row of each component and all without shingles."""
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in jaccard.one_of_each(odd_docs, 3, 90).filter("text is not null").collect())
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    assert kept == [(d, texts[d]) for d in (1, 3, 4, 5, 6, 8)]
    assert sorted(r["doc_id"] or -1 for r in jaccard.one_of_each(odd_docs, 3, 90).filter("text is null").collect()) == [-1, 2]
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(1, a, 1), (5, a, 1), (5, b, 1), (6, b, 1), (None, c, 1), (None, c, 1), (None, b, 1), (None, None, 1), (None, None, 1), (None, a + " x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in jaccard.one_of_each(docs, 5, 80).collect()))
    assert got == sorted([(1, a), (5, b), (-1, c), (-1, ""), (-1, "")])


def test_fingerprints(odd_docs, no_docs):
    rows = sorted((tuple(r) for r in odd_docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = fingerprints.fingerprint(odd_docs).collect()
    want = []
    for i, (d, t) in enumerate(rows):
        text, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        want.append((str(d), len(text), hashlib.sha256(edited.encode()).hexdigest(), round(brute.paragraph_likeness(text, edited), 9), round(brute.paragraph_likeness(text, after), 9)))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out) == sorted(want)
    assert fingerprints.fingerprint(no_docs).count() == 0


def test_next_over_many_ranges(spark, monkeypatch):
    """Ranges of a few ids, ids beyond the precision of a double, and a repeated first id."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    ids = sorted([2**60 + 3 * i for i in range(150)] + [2**60, -5, -5])
    docs = spark.createDataFrame([(d, f"text {i:04d} of {d}") for i, d in enumerate(ids)], "doc_id long, _text string").withColumn("_keys", F.array(F.lit(1)))
    got = sorted((r["doc_id"], r["_text"], r["_next"]) for r in fingerprints.with_next(docs.repartition(6)).collect())
    texts = [f"text {i:04d} of {d}" for i, d in enumerate(ids)]
    assert got == [(d, t, texts[(i + 1) % len(ids)]) for i, (d, t) in enumerate(zip(ids, texts))]


def test_language_model(odd_docs, no_docs):
    rows = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    model = lm.train(rows)
    out = {r["doc_id"]: r for r in lm.score(rows, model).collect()}
    for d, (held, n, known, total, base) in brute.base_scores([(r["doc_id"], r["text"]) for r in rows.collect()]).items():
        assert (out[d]["held_out"], out[d]["n_tokens"], out[d]["n_known"], out[d]["train_tokens"]) == (held, n, known, total)
        assert out[d]["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-12) and out[d]["score"] < 0
    assert lm.score(odd_docs, lm.train(odd_docs)).count() == odd_docs.count()
    assert lm.score(no_docs, lm.train(no_docs)).count() == 0
    assert all(r["n_known"] == 0 for r in lm.score(rows, lm.train(no_docs)).collect())


def test_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    out = quality.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["quality_probability"] <= 1 for r in out)
    nothing = quality.train(odd_docs, labels.limit(0))
    assert nothing is None and all(r["accepted"] for r in quality.score(odd_docs, nothing).collect())
    assert quality.score(no_docs, model).count() == 0 and quality.train(no_docs, labels) is None


def test_quality_decision():
    held = np.arange(6)
    y = np.array([0, 0, 0, 1, 1, 1])
    assert quality.decision(np.array([0.1, 0.2, 0.3, 0.4, 0.8, 0.9]), y, held) == 0.4
    assert quality.decision(np.array([0.1, 0.3, 0.45, 0.6, 0.8, 0.9]), y, held) == 0.5
    assert quality.decision(np.array([0.3, 0.35, 0.4, 0.01, 0.8, 0.9]), y, held) == 0.5


def test_quality_learns_from_rare_sources(spark):
    """Three documents of a source without labels, among hundreds of others, have their place in what a view of 8 is taught."""
    good, bad = "the river runs past quiet fields and old mills", "$$$ WIN!!! 100 % cash >> click << now $$$ 777"
    rows = [(i, (bad if i % 2 else good) + f" {i}", "en", "b" if i % 2 else "a", 50) for i in range(400)]
    rows += [(1000 + i, good + f" {i}", "en", "rare", 50) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels, 60, 8)
    slot = quality.metadata(*[pa.array(x) for x in (["rare"], ["en"], [50])]).slots[0]
    assert model.metadata[slot] > 0


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?y#z"), (2, "https://example.net/en"), (3, None), (4, "no scheme/net/"), (5, "x://net"), (6, "x://net/"),
            (7, "http://b.example.com/de/1"), (8, "http://fr.org/fr/2"), (9, "http://fr.org/fr/2"), (10, "http://planet/"), (11, "a://b://c/d"),
            (12, "http://example.org/" + "long" * 5000), (13, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("html", F.lit("x"))
    out = urls.judge(pages).collect()
    assert len(out) == len(rows) and "html" in out[0].asDict()
    for r in out:
        host, path, rule, verdict = brute.url_rule(dict(rows)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0
    lone = urls.judge(pages.filter("page_id in (3, 13)")).collect()
    assert all(r["verdict"] == "allow" and r["ratio"] is None for r in lone)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "The plan is to ship on Friday.\nIs that fine?"), (1, 1, "assistant", "> The  plan is to ship on FRIDAY.\nNo, on Monday."),
        (1, 2, "user", "On Tue, X wrote:\n> No, on Monday.\n>> The plan is to ship on Friday.\nAgreed."), (1, 3, "user", "> Is that fine?\nYes"),
        (1, 3, "user", "> Is that fine?\nYes"), (1, 4, "user", "> never said"), (2, 0, "user", "> The plan is to ship on Friday."),
        (None, 1, "user", "> Is that fine?"), (1, None, "user", "> Is that fine?"), (3, 0, None, None), (3, 1, "user", ""), (3, 2, "user", "> > >"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x"))
    out = quotes.reply_ordered(messages).collect()
    assert len(out) == len(rows)
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert got[1, 1]["parent_turn"] == 0 and got[1, 1]["body"] == "No, on Monday."
    assert got[1, 2]["parent_turn"] == 1 and got[1, 2]["max_level"] == 2 and got[1, 2]["n_linked"] == 2 and got[1, 2]["body"] == "Agreed."
    assert got[1, 3]["parent_turn"] == 0 and got[1, 4]["parent_turn"] is None and (got[1, 4]["n_quoted"], got[1, 4]["n_linked"]) == (1, 0)
    assert got[2, 0]["parent_turn"] is None and got[None, 1]["reply_path"] is None and got[3, 2]["n_quoted"] == 0
    order = [r["turn"] for r in sorted((r for r in out if r["conv_id"] == 1 and r["turn"] is not None), key=lambda r: r["reply_path"])]
    assert order == [0, 1, 2, 3, 3, 4] and got[1, 2]["depth"] == 2
    assert quotes.reply_ordered(messages.limit(0)).count() == 0


def test_deep_replies(spark):
    rows = [(1, 0, "line 0")] + [(1, t, f"> line {t - 1}\nline {t}") for t in range(1, 40)]
    out = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert sorted((r["turn"], r["depth"], r["reply_path"].count("/")) for r in out) == [(t, t, t) for t in range(40)]


def test_wide_and_negative_turns(spark):
    """Turns of any size keep their order and identity in the path."""
    turns = [-(2**63), -50, -5, 0, 7, 1_700_000_000_000, 1_700_000_000_001, 2**63 - 1]
    out = quotes.reply_ordered(spark.createDataFrame([(1, t, f"line {t}") for t in turns[::-1]], "conv_id long, turn long, text string")).collect()
    assert [r["turn"] for r in sorted(out, key=lambda r: r["reply_path"])] == turns and len({r["reply_path"] for r in out}) == len(turns)


def test_pieces_of_texts_take_little_memory():
    """Hashing takes some forty bytes a byte of text in every worker; cuts change no rows."""
    import tracemalloc

    import pyarrow as pa

    from foldwise.llm import jaccard, text

    batch = pa.RecordBatch.from_arrays([pa.array([f"{i} some words of text " * 40 for i in range(8000)])], ["text"])
    whole = jaccard.sets(batch.column("text"), 5)[2].tolist()
    tracemalloc.start()
    found = [n for piece in text.pieces([batch], "text") for n in jaccard.sets(piece.column("text"), 5)[2].tolist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == whole and peak < 60 << 20, peak
