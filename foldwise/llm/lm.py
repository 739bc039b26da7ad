"""Language-model scores from an Elias-Fano trie of n-grams.

Level 1 has the words: sorted 64-bit hashes and their counts. An entry of level k is an n-gram below its first k - 1
words, which are an entry of level k - 1. Its word is written relative to its context: level 2 has the word's number, higher
levels its place among the successors of the context without its first word. All successors of an entry stand
together, as an ascending Elias-Fano sequence; pointers to where they begin are another. Every entry has its
interpolated probability (absolute discounting down to add-one words) and every context its back-off weight, both
quantised to a byte of equal steps in the logarithm.

Each level lies in shards of consecutive contexts, files in the shared folder that tasks map. Counting is one pass a level:
tasks send sorted, packed counts per shard, a shard's task merges them, and the shard's first entry number is the
prefix sum of the sizes before it. Scoring looks up sorted distinct n-grams, shard by shard.

Training documents are those whose crc32 of doc_id as text leaves another remainder than 2 by 7. Null and empty
texts are the end token alone; a null doc_id counts as empty text for the split. Repeated rows are counted and scored each.
An empty table gives an empty table. Without training documents every token is unknown. Other columns are not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.elias_fano import EliasFano, opened, packed
from foldwise.llm.text import hashed_words, pieces
from foldwise.llm.token_files import mapped, store
from foldwise.session import scratch_path, written

ORDER = 3
DISCOUNT = 0.75
SHARD_BYTES = 32 << 20  # text per shard of a level
CHUNK_WORDS = 700_000  # words looked up together
END = np.uint64(0xE4D0FD0C5E4D0FD1)
_open: dict[str, tuple] = {}


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in doc_ids], bool)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text with the end token behind, and offsets."""
    hashes, offsets = hashed_words(column)
    texts = len(offsets) - 1
    out = np.full(len(hashes) + texts, END, np.uint64)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    out[np.arange(len(hashes)) + owner] = hashes
    return out, offsets + np.arange(texts + 1)


def squeezed(values: np.ndarray) -> bytes:
    """Ascending or small numbers: differences, byte by byte, compressed."""
    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def counted(parent: np.ndarray, word: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order and their counts."""
    width = int(word.max(initial=0)).bit_length()
    if int(parent.max(initial=0)).bit_length() + width <= 64:
        code = (parent << np.uint64(width)) | word
        order = np.argsort(code, kind="stable") if n is not None else None
        code = code[order] if order is not None else np.sort(code)
        new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
        pairs = code[new] >> np.uint64(width), code[new] & np.uint64((1 << width) - 1)
    else:
        order = np.lexsort((word, parent))
        p, w = parent[order], word[order]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
        pairs = p[new], w[new]
    weights = n[order] if n is not None else None
    sums = np.add.reduceat(weights, new) if weights is not None and len(new) else np.diff(np.append(new, len(parent)))
    return *pairs, sums.astype(np.uint64)


@dataclass
class Level:
    """Shards of a level: file, first context, first entry. The last two lists have an end more."""

    files: list[str] = field(default_factory=list)
    contexts: list[int] = field(default_factory=lambda: [0])
    entries: list[int] = field(default_factory=lambda: [0])

    def shard(self, i: int) -> tuple:
        path = self.files[i]
        if path not in _open:
            header, arrays = opened(mapped(path, "u1"))
            series = lambda k: EliasFano(**header[k], **{f: arrays[f"{k}.{f}"] for f in ("low", "high", "ones", "zeros")}) if k in header else None
            _open[path] = (series("words"), series("starts"), arrays)
        return _open[path]

    def cut(self, bounds: list[int], values: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Shards that ascending ``values`` fall in, and where."""
        at = np.searchsorted(values, np.array(bounds, np.uint64 if values.dtype == np.uint64 else np.int64))
        for i in range(len(self.files)):
            if at[i + 1] > at[i]:
                yield i, slice(int(at[i]), int(at[i + 1]))

    def gather(self, name: str, entries: np.ndarray, bounds: list[int]) -> np.ndarray:
        """Array ``name`` at ascending entry (or context) numbers."""
        out = np.zeros(len(entries))
        for i, part in self.cut(bounds, entries):
            out[part] = self.shard(i)[2][name][entries[part] - bounds[i]]
        return out

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """For ascending (context, word): entry (-1: none), place among the context's successors, and the codes of the
        entry's probability and the context's back-off (0: the context has no successors)."""
        entry, place = np.full(len(context), -1), np.full(len(context), -1)
        probability, backoff = np.zeros(len(context), np.uint8), np.zeros(len(context), np.uint8)
        for i, part in self.cut(self.contexts, context):
            words, starts, arrays = self.shard(i)
            below = context[part] - self.contexts[i]
            new = np.r_[True, below[1:] != below[:-1]]
            own, inverse = below[new], np.cumsum(new) - 1
            first, last = starts.get(own).astype(np.int64), starts.get(own + 1).astype(np.int64)
            base = np.where(first > 0, words.get(np.maximum(first - 1, 0)), np.uint64(0))  # what the successors are written above
            at, there = words.successor(base[inverse] + word[part] + np.uint64(1))
            there &= (at >= first[inverse]) & (at < last[inverse])
            hit = np.flatnonzero(there)
            entry[part.start + hit] = at[hit] + self.entries[i]
            place[part.start + hit] = at[hit] - first[inverse[hit]]
            probability[part.start + hit] = arrays["probability"][at[hit]]
            backoff[part] = arrays["backoff"][own][inverse]
        return entry, place, probability, backoff


@dataclass
class Model:
    order: int
    n: int
    step: float
    vocabulary: Level
    levels: list[Level]
    shard_bits: int

    @property
    def v(self) -> int:
        return self.vocabulary.entries[-1]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ascending word hashes, -1 for unknown words, and their counts."""
        out, counts = np.full(len(hashes), -1), np.zeros(len(hashes))
        top = (hashes >> np.uint64(64 - self.shard_bits)).astype(np.int64) if self.shard_bits else np.zeros(len(hashes), np.int64)
        at = np.searchsorted(top, np.arange(len(self.vocabulary.files) + 1))
        for i in range(len(self.vocabulary.files)):
            if at[i + 1] > at[i]:
                series, _, arrays = self.vocabulary.shard(i)
                spot, there = series.successor(hashes[at[i]:at[i + 1]])
                hit = np.flatnonzero(there)
                out[at[i] + hit] = spot[hit] + self.vocabulary.entries[i]
                counts[at[i] + hit] = arrays["counts"][spot[hit]]
        return out, counts

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of word hashes in any order."""
        codes, distinct = pd.factorize(hashes)
        order = np.argsort(distinct)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers, counts = self.numbers(distinct[order])
        codes = place[codes]
        return numbers[codes], counts[codes]

    def walk(self, words: np.ndarray, offsets: np.ndarray, upto: int, ask_all: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """Look up the n-grams that end at each token, level by level up to ``upto``: (tokens, entries, codes of probabilities,
        codes of back-offs) in order of their contexts. The last item is (tokens, contexts, relative words) of the level above.

        With ``ask_all`` tokens whose shorter n-gram is unknown are looked up too, for their back-off.
        """
        inner = np.ones(len(words), bool)
        inner[offsets[:-1][offsets[:-1] < len(words)]] = False
        entry, relative, none = words, words, self.v
        for k in range(2, upto + 2):
            context = np.full(len(words), -1)
            context[1:] = entry[:-1]
            asked = np.flatnonzero(inner & (context >= 0) & ((relative >= 0) | (ask_all and k <= upto)))
            c, w = context[asked].astype(np.uint64), np.where(relative[asked] < 0, none, relative[asked]).astype(np.uint64)
            if k > upto:
                yield asked, c, w
                return
            width = int(none).bit_length()
            wide = int(c.max(initial=0)).bit_length() + width > 64
            order = np.lexsort((w, c)) if wide else np.argsort((c << np.uint64(width)) | w)
            level = self.levels[k - 2]
            found, place, probability, backoff = level.find(c[order].astype(np.int64), w[order])
            asked = asked[order]
            entry, relative, none = np.full(len(words), -1), np.full(len(words), -1), level.entries[-1]
            entry[asked], relative[asked] = found, place
            yield asked, found, probability, backoff

    def score(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        words, count = self.words(hashes)
        base = np.log10((count + 1) / (self.n + self.v + 1))
        value = base.copy()
        for _, (asked, found, probability, backoff) in zip(self.levels, self.walk(words, offsets, len(self.levels) + 1, True)):
            shorter = np.where(backoff > 0, value[asked] - (backoff.astype(float) - 1) * self.step, value[asked])
            value[asked] = np.where(found >= 0, -probability.astype(float) * self.step, shorter)
        sums = lambda x: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
        return np.diff(offsets), sums((words >= 0).astype(np.int64)), sums(base), sums(value)

    @staticmethod
    def _at(level: Level, name: str, entries: np.ndarray, bounds: list[int]) -> np.ndarray:
        """Values at entry numbers in any order, 0 for -1."""
        codes, distinct = pd.factorize(entries)
        order = np.argsort(distinct)
        values = np.zeros(len(distinct))
        skip = int((distinct < 0).sum())
        values[order[skip:]] = level.gather(name, distinct[order[skip:]], bounds)
        return values[codes]


def _chunks(batches: Iterator[pa.RecordBatch], train: bool) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Hashes, offsets and doc_ids of so many whole texts at a time; only training texts if asked."""
    held: list[tuple] = []
    size = 0
    for batch in pieces(batches, "text", 2 << 20):
        if train:
            batch = batch.filter(pa.array(~held_out(batch.column("doc_id").to_pylist())))
        if batch.num_rows:
            held.append((*tokens(batch.column("text")), batch.column("doc_id")))
            size += len(held[-1][0])
        if size >= CHUNK_WORDS:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    sizes = np.concatenate([np.diff(o) for _, o, _ in held])
    return np.concatenate([h for h, _, _ in held]), np.concatenate([[0], np.cumsum(sizes)]), pa.concat_arrays([d for _, _, d in held])


_ROW = "shard bigint, context binary, word binary, n binary"
_DONE = "shard bigint, file string, contexts bigint, entries bigint, total bigint"


def _sent(shards: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row per shard for pairs in order of their shards."""
    ids, first = np.unique(shards, return_index=True)
    ends = np.append(first[1:], len(shards))
    cut = lambda x: pa.array([squeezed(x[a:b]) for a, b in zip(first, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), cut(context), cut(word), cut(n)], names=["shard", "context", "word", "n"])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    load = lambda c: np.concatenate([spread(x) for x in table.column(c).to_pylist()])
    return counted(load("context"), load("word"), load("n"))


def _listed(done: DataFrame, shards: int) -> tuple[Level, int]:
    """The level's shards in order: one row each; shards without entries have no file."""
    rows = {r["shard"]: r for r in done.collect()}  # one row per shard
    level, total = Level(), 0
    for shard in range(shards):
        if (r := rows.get(shard)) is not None:
            level.files.append(r["file"])
            level.contexts.append(r["contexts"])
            level.entries.append(level.entries[-1] + r["entries"])
            total += r["total"]
    return level, total


def _saved(folder: str, level: int, shard: int, header: dict, arrays: dict) -> str:
    path = f"{folder}/{level}-{shard:06d}-{TaskContext.get().taskAttemptId()}"
    store(path, packed(header, arrays))
    return path


def _series(name: str, values: np.ndarray, header: dict, arrays: dict) -> None:
    header[name], own = EliasFano.arrays(values)
    arrays.update({f"{name}.{k}": v for k, v in own.items()})


def train(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count, smooth and write the trie of the training documents (doc_id, text)."""
    if order not in (1, 2, 3):
        raise ValueError("orders 1 to 3")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    folder = scratch_path(spark, "trie")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(-(-size // shard_bytes) - 1).bit_length())

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, _ in _chunks(batches, True):
            distinct, n = np.unique(hashes, return_counts=True)
            shard = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
            yield _sent(shard, np.zeros(len(distinct), np.uint64), distinct, n)

    def write_words(key: tuple, table: pa.Table) -> pa.Table:
        load = lambda c: np.concatenate([spread(x) for x in table.column(c).to_pylist()])
        hashes, n = load("word"), load("n")
        order_ = np.argsort(hashes, kind="stable")
        hashes, n = hashes[order_], n[order_]
        new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        n, hashes = np.add.reduceat(n, new), hashes[new]
        header, arrays = {}, {"counts": n.astype("<u4") if int(n.max()) < 1 << 32 else n}
        _series("words", hashes, header, arrays)
        shard = key[0].as_py()
        path = _saved(folder, 1, shard, header, arrays)
        return pa.table({"shard": [shard], "file": [path], "contexts": pa.array([0], pa.int64()), "entries": [len(n)], "total": [int(n.sum())]})

    done = written(docs.mapInArrow(count_words, _ROW).groupBy("shard").applyInArrow(write_words, _DONE), "words")
    rows = {r["shard"]: r for r in done.collect()}  # one row per shard
    vocabulary, n = Level(), 0
    if rows:
        for shard in range(1 << bits):
            r = rows.get(shard)
            vocabulary.files.append(r["file"] if r else "")
            vocabulary.entries.append(vocabulary.entries[-1] + (r["entries"] if r else 0))
            n += r["total"] if r else 0
        if "" in vocabulary.files:  # a tiny vocabulary: one shard holds nothing
            header, arrays = {}, {"counts": np.zeros(0, "<u4")}
            _series("words", np.zeros(0, np.uint64), header, arrays)
            store(f"{folder}/none", packed(header, arrays))
            vocabulary.files = [f or f"{folder}/none" for f in vocabulary.files]
    model = Model(order, n, (np.log10(n + vocabulary.entries[-1] + 1) + 0.5) / 254, vocabulary, [], bits)
    for k in range(2, order + 1 if n else 2):
        model.levels.append(_level(docs, model, k, folder, discount))
    return model


def _bounds(model: Model, k: int) -> np.ndarray:
    """First contexts of the shards of level k, with the end."""
    if k == 2:
        # As many shards as the vocabulary has; words come in hash order, so contexts are spread evenly.
        return np.array(model.vocabulary.entries, np.int64)
    return np.array(model.levels[k - 3].entries, np.int64)


def _level(docs: DataFrame, model: Model, k: int, folder: str, discount: float) -> Level:
    bounds = _bounds(model, k)
    shards = len(bounds) - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of files and two numbers per shard

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, offsets, _ in _chunks(batches, True):
            words, _ = shared.value.words(hashes)
            *_, (asked, c, w) = shared.value.walk(words, offsets, k - 1, False)
            if len(asked):
                c, w, n = counted(c, w)
                yield _sent(np.searchsorted(bounds, c.astype(np.int64), "right") - 1, c, w, n)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        shard, m = key[0].as_py(), shared.value
        context, word, n = _merged(table)
        first, last = int(bounds[shard]), int(bounds[shard + 1])
        own = context.astype(np.int64) - first
        sizes = np.bincount(own, minlength=last - first)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        total = np.bincount(own, n.astype(float), last - first)
        if k == 2:
            lower = (m._at(m.vocabulary, "counts", word.astype(np.int64), m.vocabulary.entries) + 1) / (m.n + m.v + 1)
        else:
            # The context's last word, from its own entry; successors of that word are numbered as ``word`` is.
            below = m.levels[-1]
            words, heads, _ = below.shard(shard)
            values, head = words.all(), heads.all().astype(np.int64)
            parent = np.repeat(np.arange(len(head) - 1), np.diff(head))
            base = np.where(head[:-1] > 0, values[np.maximum(head[:-1] - 1, 0)], np.uint64(0))
            last_word = (values - base[parent] - np.uint64(1)).astype(np.int64)
            used = np.flatnonzero(sizes)
            del values, heads, head, parent, base
            distinct, inverse = np.unique(last_word[used], return_inverse=True)
            begin = np.zeros(len(distinct), np.int64)
            for i, part in below.cut(below.contexts, distinct):
                begin[part] = below.shard(i)[1].get(distinct[part] - below.contexts[i]).astype(np.int64) + below.entries[i]
            of_context = np.zeros(last - first, np.int64)
            of_context[used] = begin[inverse]
            del last_word, used, distinct, inverse, begin
            lower = 10 ** (-m._at(below, "probability", of_context[own] + word.astype(np.int64), below.entries) * m.step)
        weight = np.where(total > 0, discount * sizes / np.maximum(total, 1), 1.0)
        p = np.maximum(n.astype(float) - discount, 0) / total[own] + weight[own] * lower
        del lower
        code = lambda x, least: np.clip(np.round(-np.log10(x) / m.step), least, 254).astype(np.uint8)
        # Ascending over the whole shard: each context's words are written above the last value of the one before.
        ends = np.where(sizes > 0, word[np.maximum(starts[1:] - 1, 0)] + np.uint64(1), np.uint64(0))
        base = np.concatenate([[np.uint64(0)], np.cumsum(ends, dtype=np.uint64)[:-1]])
        values = base[own] + word + np.uint64(1)
        entries, all_ = len(word), int(n.sum())
        del own, word, context, n, base, ends
        header, arrays = {}, {"probability": code(p, 0), "backoff": np.where(sizes > 0, code(weight, 0) + np.uint8(1), np.uint8(0)).astype(np.uint8)}
        del p, weight, total
        _series("words", values, header, arrays)
        _series("starts", starts.astype(np.uint64), header, arrays)
        path = _saved(folder, k, shard, header, arrays)
        return pa.table({"shard": [shard], "file": [path], "contexts": pa.array([last], pa.int64()), "entries": [entries], "total": [all_]})

    rows = docs.mapInArrow(count, _ROW)
    missing = docs.sparkSession.range(shards).select(F.col("id").alias("shard"), *[F.lit(squeezed(np.zeros(0, np.uint64))).alias(c) for c in ("context", "word", "n")])
    done = written(rows.unionByName(missing).groupBy("shard").applyInArrow(write, _DONE), f"level{k}")
    return _listed(done, shards)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, offsets, doc_ids in _chunks(batches, False):
            total, known, base, value = shared.value.score(hashes, offsets)
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(held_out(doc_ids.to_pylist())), pa.array(total, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(np.full(len(total), shared.value.n), pa.int64()), pa.array(base), pa.array(value)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, "
                                                         "train_tokens bigint, base_score double, score double")
