"""Cross-tokenizer alignment against loops over bytes, and the sparse products against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import public_tokenizers
from foldwise.llm import csr, token_links
from tests.harness import DATA
from tests.llm import brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256")
ODD = ["", None, " ", "a", "  two  spaces ", "tab\tline\n\n end", "<|endoftext|> and <s> </s> <unk>", "▁ is a space to B", "é́ ﬁ １２ ½", "\U0001F600中文 ทั้ง",
       "x" * 3000, "\x00\x01", "don't they'LL 1234567", "aÿĀɏʀ", " 　\xa0 wide"]


def dense(m):
    out = np.zeros((m.rows, m.cols), int)
    for r in range(m.rows):
        out[r, m.idx[m.ptr[r]:m.ptr[r + 1]]] = 1
    return out


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_products(block):
    draw = np.random.default_rng(5)
    for rows, inner, cols in ((1, 1, 1), (7, 5, 9), (0, 4, 3), (6, 0, 2), (12, 20, 4)):
        def some(n, m):
            cells = draw.random((n, m)) < 0.4
            return csr.Csr(np.concatenate([[0], np.cumsum(cells.sum(1))]).astype(int), np.nonzero(cells)[1], m)
        a, b = some(rows, inner), some(inner, cols)
        got = np.zeros((rows, cols), int)
        seen = []
        for r, c, v in csr.product(a, b, block):
            got[r, c] = v
            seen += list(zip(r.tolist(), c.tolist()))
        assert np.array_equal(got, dense(a) @ dense(b)) and seen == sorted(set(seen))
        assert np.array_equal(csr.product_sizes(a, b), (dense(a) @ dense(b)).sum(1))
        assert np.array_equal(dense(a.transpose()), dense(a).T)


def test_spans_and_owners():
    sizes = np.array([2, 1, 3])
    assert np.array_equal(dense(csr.spans(sizes)).T, dense(csr.owners(sizes)))


def test_query(spark):
    sf = DATA.format("0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: w for (d, _), w in zip(docs, brute.token_links([t for _, t in docs], A, B))}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in entry.queries()["op11_cross_tokenizer"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("frequent", [1, 40, 1 << 20])
def test_odd_texts(spark, frequent):
    """Also with few or hardly any pairs looked up in the task: the join gives the same."""
    docs = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(ODD + ODD[4:7])], "doc_id long, text string, n_a int")
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "pairs", "times", "count", "best")})
    got = [(r["doc_id"], *(r[c] for c in COLUMNS)) for r in token_links.align(docs, A, B, frequent=frequent).collect()]
    want = [(d, *w) for d, w in zip([r["doc_id"] for r in docs.collect()], brute.token_links(ODD + ODD[4:7], A, B))]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[1] for w in want)


def test_edge_tables(spark, odd_docs, no_docs):
    got = sorted(([r["doc_id"], *(r[c] for c in COLUMNS)] for r in token_links.align(odd_docs, A, B).collect()), key=str)
    rows = odd_docs.select("doc_id", "text").collect()
    assert got == sorted(([d, *w] for (d, _), w in zip(rows, brute.token_links([t for _, t in rows], A, B))), key=str)
    assert token_links.align(no_docs, A, B).count() == 0 and token_links.occurrences(no_docs, A, B).count() == 0


def test_occurrences(spark):
    texts = ["hello wonderful world", "un texte français"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split_a, split_b = brute.token_bytes(A, B)
    for kind in ("overlap", "group"):
        got = sorted(tuple(r) for r in token_links.occurrences(docs, A, B, kind=kind).collect())
        if kind == "overlap":
            want = []
            for d, t in enumerate(texts):
                a, b = split_a(t), split_b(t)
                of = [[(k, i) for k, (i, x) in enumerate(s) for _ in x] for s in (a, b)]
                cells = list(zip(*of))
                want += [(d, x[0], y[0], x[1], y[1], cells.count((x, y))) for x, y in sorted(set(cells))]
            assert got == sorted(want)
        else:
            sizes = [w[4] for w in brute.token_links(texts, A, B)]
            assert [sum(r[0] == d for r in got) for d in range(2)] == sizes and len(set(got)) == len(got)


def test_slow_way_agrees():
    """The rank-table library and the file's own library give the same ids."""
    tokens = token_links.ByteTokens(A)
    assert tokens.fast is not None
    texts = [t for t in ODD if t]
    fast, at = tokens.encode(texts, [True] * len(texts))
    slow, at2 = tokens.encode(texts, [False] * len(texts))
    assert np.array_equal(fast, slow) and np.array_equal(at, at2)
