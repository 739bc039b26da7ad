"""Two tokenizers of one text, aligned through its bytes.

Both split ``prefix + text``: A a byte-level vocabulary, B a piece vocabulary that adds the prefix itself. A token is a
row of a token-byte incidence matrix (``csr``). The product A Bᵀ has an entry wherever an A and a B token overlap, its value
the shared bytes. Offsets where both end cut the text into groups; products of group incidences link all tokens
of a group, of which only the number is formed unless asked for.

``align`` adds corpus-wide statistics of linked id pairs. Each document's distinct pairs are written once, counted by
a plain aggregate, and looked up again: pairs with at least 2^-20 of all links, so at most 2^20 of them, travel to every
task; each rarer pair has less than 2^-20 of all links and meets its count in a join, which so has no hot key. Both
ways give the same numbers.

Null and empty texts, and those whose tokens' bytes don't spell prefix + text (a vocabulary that normalises), have no
tokens: zeros and empty strings. Repeated rows are documents of their own and each counts. Any doc_id may be null. An empty
table gives an empty table. A text is held whole in its task, with about 60 bytes of work space a byte. Of the
columns only doc_id and text are read; extra ones, also of the names used here, neither matter nor come out.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.csr import Csr, owners, product, product_sizes, spans
from foldwise.llm.text import pieces, text_bytes
from foldwise.session import scratch_path, written

FREQUENT = 1 << 20
#: The split of byte-level vocabularies whose file asks for the standard one (a fixed value of their format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lead byte of U+0280: below it, letters and digits are the same in all Unicode tables in use.
OLD_LETTERS = 0xCA


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes of every id, flat."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = len(tokens)
        self.names = [f"{i}{sign}".encode() for i in range(len(tokens)) for sign in ",|;"]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.flat[at + np.arange(len(at))] if len(at) else np.zeros(0, np.uint8)


class ByteTokens(Vocabulary):
    """A byte-level vocabulary file. Special tokens' strings are plain text.

    Where the merges stand in the order of the ids they make, a faster library for rank tables gives the same ids; it is
    used if it agrees on every token of the vocabulary, and on texts of letters that all Unicode tables know.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark fills the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        named = self.library.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(named.values()) + 1)
        for name, i in named.items():
            tokens[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        super().__init__(tokens)
        self.fast = self._ranked(path, tokens)

    def _ranked(self, path: str, tokens: list[bytes]):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, model = file["pre_tokenizer"] or {}, file["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file["normalizer"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        if not plain or [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        ranks = {tokens[i]: i for i in model["vocab"].values() if i < 256 + len(merges)}
        fast = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = [t.decode() for t in ranks if _is_text(t)]
        same = all(e.ids == fast.encode_ordinary(w) for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)))
        return fast if same else None

    def encode(self, texts: list[str], old: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast is not None and old[i]:
                found[i] = self.fast.encode_to_numpy(text, disallowed_special=())
            else:
                rest.append(i)
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, np.int64)
        return _joined(found)


class PieceTokens(Vocabulary):
    """A piece vocabulary file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        get = self.library
        super().__init__([bytes([int(get.id_to_piece(i)[3:-1], 16)]) if get.is_byte(i) else get.id_to_piece(i).replace("▁", " ").encode()
                          for i in range(get.get_piece_size())])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(texts, num_threads=1)
        sizes = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        return ids, np.concatenate([[0], np.cumsum(sizes)])


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


_loaded: dict[tuple[type, str], Vocabulary] = {}  # a worker serves many tasks


def vocabulary(kind: type, path: str) -> Vocabulary:
    return _loaded.get((kind, path)) or _loaded.setdefault((kind, path), kind(path))


class Aligned:
    """Tokens of a batch of texts by both vocabularies, texts without tokens left out, and their groups."""

    def __init__(self, texts: pa.Array, a: ByteTokens, b: PieceTokens, prefix: str):
        filled = texts.cast(pa.large_string()).fill_null("")
        data, offsets = text_bytes(filled)
        lengths = np.diff(offsets)
        full = np.flatnonzero(lengths)
        self.n = len(filled)
        strings = filled.take(pa.array(full)).to_pylist()
        highest = np.maximum.reduceat(data, offsets[:-1][full]) if len(full) else np.zeros(0, np.uint8)
        a_ids, a_at = a.encode([prefix + s for s in strings], (highest < OLD_LETTERS).tolist())
        b_ids, b_at = b.encode(strings)
        lead = np.frombuffer(prefix.encode(), np.uint8)
        wanted = lengths[full] + len(lead)
        covered = [np.diff(np.concatenate([[0], np.cumsum(v.sizes[ids])])[at]) for v, ids, at in ((a, a_ids, a_at), (b, b_ids, b_at))]
        good = (covered[0] == wanted) & (covered[1] == wanted)
        for k in np.flatnonzero(good):  # text by text: the spelled bytes of one at a time
            text = data[offsets[full[k]]:offsets[full[k] + 1]]
            for v, ids, at in ((a, a_ids, a_at), (b, b_ids, b_at)):
                spelled = v.spell(ids[at[k]:at[k + 1]])
                if not (np.array_equal(spelled[:len(lead)], lead) and np.array_equal(spelled[len(lead):], text)):
                    good[k] = False
        keep = np.flatnonzero(good)
        self.doc = full[keep]  # place in the batch of every text with tokens
        self.a_ids, self.a_at = _kept(a_ids, a_at, keep)
        self.b_ids, self.b_at = _kept(b_ids, b_at, keep)
        self.a_sizes, self.b_sizes = a.sizes[self.a_ids], b.sizes[self.b_ids]
        a_ends, b_ends = np.cumsum(self.a_sizes), np.cumsum(self.b_sizes)
        where = np.searchsorted(b_ends, a_ends)
        common = a_ends[b_ends[np.minimum(where, len(b_ends) - 1)] == a_ends] if len(b_ends) else a_ends
        self.a_group = np.searchsorted(common, a_ends)
        self.b_group = np.searchsorted(common, b_ends)
        self.n_groups = len(common)
        self.text_of_a = np.repeat(np.arange(len(keep)), np.diff(self.a_at))

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A Bᵀ of the token-byte matrices: A tokens, B tokens and the bytes they share."""
        return product(spans(self.a_sizes), owners(self.b_sizes))

    def groups(self) -> tuple[Csr, Csr]:
        """Tokens by group, for A and for B."""
        return tuple(Csr(np.arange(len(g) + 1), g, self.n_groups) for g in (self.a_group, self.b_group))

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of tokens of one group, block by block: the product of the group matrices."""
        a, b = self.groups()
        return product(a, b.transpose())

    def shared_sizes(self) -> np.ndarray:
        """Pairs of one group that each A token is in, none of them formed."""
        a, b = self.groups()
        return product_sizes(a, b.transpose())

    def group_texts(self, a: Vocabulary, b: Vocabulary) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text with tokens."""
        pick = []
        for ids, group, sign in ((self.a_ids, self.a_group, 1), (self.b_ids, self.b_group, 2)):
            last = np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)
            pick.append(ids * 3 + np.where(last, sign, 0))
        n_a, n_b = (np.bincount(g, minlength=self.n_groups) for g in (self.a_group, self.b_group))
        a_before, b_before = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        line = np.empty(len(self.a_ids) + len(self.b_ids), np.int64)
        a_to = np.arange(len(self.a_ids)) + b_before[self.a_group]
        b_to = np.arange(len(self.b_ids)) + (a_before + n_a)[self.b_group]
        line[a_to], line[b_to] = pick[0], pick[1] + 3 * a.size
        names = a.names + b.names
        for start, stop in zip(self.a_at[:-1] + self.b_at[:-1], self.a_at[1:] + self.b_at[1:]):
            yield b"".join([names[i] for i in line[start:stop].tolist()])[:-1]


def _kept(ids: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(at)
    if len(keep) < len(sizes):
        use = np.zeros(len(sizes), bool)
        use[keep] = True
        ids = ids[np.repeat(use, sizes)]
    return ids, np.concatenate([[0], np.cumsum(sizes[keep])])


def per_text(values: np.ndarray, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by the text that owns them, at the texts' places in the batch."""
    out = np.zeros(n, np.int64)
    out[place] = np.bincount(owner, weights=values, minlength=len(place)).astype(np.int64) if len(place) else 0
    return out


def occurrences(docs: DataFrame, a_path: str, b_path: str, prefix: str = " ", kind: str = "overlap") -> DataFrame:
    """One row per linked pair of tokens: doc_id, a_at, b_at (places in the text), a, b (ids), weight.

    ``kind`` is ``overlap`` (weight: shared bytes) or ``group`` (all pairs of a group, formed block by block).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabulary(ByteTokens, a_path), vocabulary(PieceTokens, b_path)
        for batch in pieces(batches, "text", 1 << 18):
            found = Aligned(batch.column("text"), a, b, prefix)
            for row, col, value in found.overlaps() if kind == "overlap" else found.shared():
                text = found.text_of_a[row]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(found.doc[text])),
                    "a_at": pa.array(row - found.a_at[text], pa.int64()), "b_at": pa.array(col - found.b_at[text], pa.int64()),
                    "a": pa.array(found.a_ids[row], pa.int64()), "b": pa.array(found.b_ids[col], pa.int64()), "weight": pa.array(value, pa.int64())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, a_at bigint, b_at bigint, a bigint, b bigint, weight bigint")


SHAPES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string"


def shapes(docs: DataFrame, a_path: str, b_path: str, prefix: str = " ") -> DataFrame:
    """Per document its counts and groups, and its distinct id pairs with how often it links them.

    ``row`` tells rows apart; pairs are ``a * (size of B's vocabulary) + b``, ascending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabulary(ByteTokens, a_path), vocabulary(PieceTokens, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text", 1 << 20):
            found = Aligned(batch.column("text"), a, b, prefix)
            n, place = batch.num_rows, found.doc
            linked = [(found.text_of_a[i] * (a.size * b.size)) + found.a_ids[i] * b.size + found.b_ids[j] for i, j, _ in found.overlaps()]
            key = np.sort(np.concatenate(linked)) if linked else np.zeros(0, np.int64)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(key)))
            text, pair = np.divmod(key[new], a.size * b.size)
            at = np.concatenate([[0], np.cumsum(per_text(np.ones(len(text)), text, place, n))]).astype(np.int32)
            count = lambda offsets: per_text(np.diff(offsets), np.arange(len(place)), place, n)
            first_group = np.concatenate([found.a_group, [found.n_groups]])[found.a_at]
            digests = [""] * n
            for k, text_groups in zip(place.tolist(), found.group_texts(a, b)):
                digests[k] = hashlib.sha256(text_groups).hexdigest()
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(row + np.arange(n)), "doc_id": batch.column("doc_id"),
                "n_a": count(found.a_at), "n_b": count(found.b_at), "n_groups": count(first_group),
                "n_links": per_text(times, text, place, n), "n_shared": per_text(found.shared_sizes(), found.text_of_a, place, n),
                "groups_sha256": pa.array(digests, pa.string()), "pairs": pa.ListArray.from_arrays(pa.array(at), pa.array(pair, pa.int64())),
                "times": pa.ListArray.from_arrays(pa.array(at), pa.array(times, pa.int64()))})
            row += n

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, f"row bigint, doc_id bigint, {SHAPES}, pairs array<bigint>, times array<bigint>")


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """pair, count over all documents, best: whether no pair of the same B id counts more."""
    each = found.select(F.posexplode("pairs").alias("_k", "pair"), "times").select("pair", F.get("times", F.col("_k")).alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("_b", F.col("pair") % b_size)
    counts = written(counts, "pair_counts")
    highest = counts.groupBy(F.col("_b").alias("_of")).agg(F.max("count").alias("_highest"))  # at most one row per B id
    return counts.join(F.broadcast(highest), F.col("_b") == F.col("_of")).select("pair", "count", (F.col("count") == F.col("_highest")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, prefix: str = " ", frequent: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256.

    Both files must exist on every worker.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token_links")
    shaped = shapes(docs, a_path, b_path, prefix)
    # sorted pairs take a third of the room as differences
    shaped.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(path)
    found = spark.read.schema(shaped.schema).parquet(path)
    counts = pair_counts(found, vocabulary(PieceTokens, b_path).size)
    total = found.agg(F.sum("n_links")).first()[0] or 0
    often = F.col("count") * frequent >= total
    hot = counts.filter(often).toArrow()  # at most ``frequent`` rows: each has that share of the total
    order = np.argsort(hot.column("pair").to_numpy())
    table = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy()[order] for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            pair, n = (x.flatten().to_numpy(zero_copy_only=False) for x in (pairs, times))
            sizes = pc.list_value_length(pairs).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            here = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            at, of = at[here], owner[here]
            rare = ~here
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "_best": _sums(n[here] * best[at], of, len(sizes)), "_sum": _sums(n[here] * count[at], of, len(sizes)),
                "pairs": pa.ListArray.from_arrays(pa.array(ends), pa.array(pair[rare], pa.int64())),
                "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(n[rare], pa.int64()))})

    first = written(found.select("row", "pairs", "times").mapInArrow(run, "row bigint, _best bigint, _sum bigint, pairs array<bigint>, times array<bigint>"), "frequent_pairs")
    rare = first.select("row", F.posexplode("pairs").alias("_k", "_pair"), "times").select("row", "_pair", F.get("times", F.col("_k")).alias("_n"))
    late = rare.join(counts.filter(~often), F.col("_pair") == F.col("pair")).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("_n")).otherwise(0)).alias("_best"), F.sum(F.col("_n") * F.col("count")).alias("_sum"))
    sums = first.select("row", "_best", "_sum").unionByName(late).groupBy(F.col("row").alias("_row")).agg(
        F.sum("_best").alias("n_best"), F.sum("_sum").alias("count_sum"))
    return found.drop("pairs", "times").join(sums, F.col("row") == F.col("_row")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256")


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by owner; owners ascend."""
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return np.diff(total[np.searchsorted(owner, np.arange(n + 1))])
