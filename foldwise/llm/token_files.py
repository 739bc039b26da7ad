"""Token ids in flat binary files.

A folder holds shards. ``<shard>.bin`` has the ids of its documents behind one another as little-endian
unsigned integers of 16 bits where the vocabulary fits, else 32. ``<shard>.off`` has one 64-bit integer per
document, the number of ids before it in the whole collection, and a last one for the end. ``<shard>.doc``
has the 64-bit document ids and ``<shard>.nul`` a byte per document, 1 where its id is null. Shards follow each other in document order. Readers map the files.

Documents are dealt into ranges of doc_id; a task writes the ids of one range and reports their number.
The numbers' prefix sums are the shards' bases, with which a second, short pass writes the offsets. File names
hold the task attempt, so a repeated task never touches files that another one reported.

Null and empty texts hold the end id alone. Documents without doc_id stand first and keep none. Repeated doc_ids are
documents of their own, in the order of their texts. An empty table gives no shards. Extra columns are not written.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.text import pieces, span_hashes, text_bytes, word_spans
from foldwise.session import scratch_path, written

MEMO = 1_000_000  # units whose ids are kept
BATCH = 2_000
_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LETTER[[c for c in range(128) if chr(c).isalnum()]] = True
_TWO = 0xC3  # leads the letters from U+00C0 to U+00FF, bar the signs 0x97 and 0xB7
_ABOVE = 0xC4  # leads U+0100 and, with the bytes above it, all that follows
SHARD_ROWS = 8_000  # documents of a shard, about; more where that would make too many shards
MOST_SHARDS = 20_000


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def store(uri: str, data: bytes | memoryview) -> None:
    fs, path = opened(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped where it lies on a mounted disk, read where a store has no maps."""
    fs, path = opened(uri)
    size = fs.get_file_info(path).size
    if not size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def units(data: np.ndarray, offsets: np.ndarray, special: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the units of texts, and the texts' n + 1 offsets into them.

    A unit is a word without the ASCII signs at its end, or these signs. The hash is that of the unit in lower case
    if all of its characters are below U+0100. Words with a special token stay whole and as they are.
    """
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    starts, ends = word_spans(data, offsets)
    before = np.concatenate([data[:1] * 0, data[:-1]])
    two = (before == _TWO) & (data != 0x97) & (data != 0xB7)
    core = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(len(data))))[ends - 1]
    middle = np.where((core >= starts) & (_LETTER[data[core]] | two[core]), core + 1, ends)
    low = data + np.where((data >= 65) & (data <= 90) | two & (data >= 0x80) & (data <= 0x9E), 32, 0).astype(np.uint8)
    above = np.concatenate([[0], np.cumsum(data >= _ABOVE)])
    asis = above[ends] > above[starts]
    if special is not None and (found := [m.start() for m in special.finditer(data.tobytes())]):
        own = np.searchsorted(starts, found, "right") - 1
        asis[own], middle[own] = True, ends[own]
    if asis.any():
        edge = np.zeros(len(data) + 1, np.int64)
        edge[starts[asis]] += 1
        edge[ends[asis]] -= 1
        low = np.where(np.cumsum(edge[:-1]) > 0, data, low)
    head, tail = np.stack([starts, middle], 1).ravel(), np.stack([middle, ends], 1).ravel()
    kept = tail > head
    places = np.concatenate([[0], np.cumsum(kept)])[2 * np.searchsorted(starts, offsets)]
    head, tail = head[kept], tail[kept]
    return span_hashes(low, head, tail), head, tail, places


class Words:
    """Ids of whole texts from the ids of their units.

    White space in ASCII ends every unit of the tokenizer (its pattern drops white space, and no normal form joins
    across it), and so does a change from a letter or digit to an ASCII sign other than the apostrophe. A text's ids are
    therefore its units' ids in a row; the tokenizer puts them in lower case, so capitals don't matter. New units are
    encoded a few thousand at a time, behind one another with a special token between (the library cuts there first),
    and their ids kept in one array, up to a bound. All else is array work on whole batches.
    """

    def __init__(self, path: str, dtype: str, end_id: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark fills the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.end_id = dtype, end_id
        added = self.tokenizer.get_added_tokens_decoder()
        cuts = [(t.content, i) for i, t in added.items() if t.special and not t.normalized and not t.single_word]
        self.cut, self.cut_id = cuts[-1] if cuts else ("", -1)
        self.special = [t.content for t in added.values()]
        self.pattern = re.compile(b"|".join(re.escape(t.encode()) for t in self.special)) if self.special else None
        self.forget()

    def forget(self) -> None:
        """Keep the end id alone, in place 0."""
        self.places: dict[int, int] = {}
        self.ids_of = np.array([self.end_id], self.dtype)
        self.starts, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def learn(self, keys: list[int], texts: list[str]) -> np.ndarray:
        """Places of new units."""
        alone = [not self.cut or any(t in text for t in self.special) for text in texts]
        groups = [[i] for i, own in enumerate(alone) if own]
        rest = [i for i, own in enumerate(alone) if not own]
        groups += [rest[i:i + BATCH] for i in range(0, len(rest), BATCH)]
        arrays, starts, sizes = [self.ids_of], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        used = len(self.ids_of)
        for group in groups:
            ids = self.ids(self.cut.join(texts[i] for i in group))
            at = np.flatnonzero(ids == self.cut_id) if len(group) > 1 else np.zeros(0, np.int64)
            if len(at) + 1 != len(group):
                raise ValueError("the tokenizer doesn't cut at its special token")
            begin, end = np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]])
            starts[group], sizes[group] = used + begin, end - begin
            arrays.append(ids.astype(self.dtype))
            used += len(ids)
        places = np.arange(len(self.starts), len(self.starts) + len(texts))
        self.places.update(zip(keys, places.tolist()))
        self.ids_of = np.concatenate(arrays)
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        return places

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, each text's followed by the end id, and how many each text has."""
        data, offsets = text_bytes(column)
        hashes, starts, ends, texts = units(data, offsets, self.pattern)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.places) + len(keys) > MEMO:
            self.forget()
        listed, get = keys.tolist(), self.places.get
        place = np.array([get(k, -1) for k in listed], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            at = first[new]
            raw = data.tobytes()
            place[new] = self.learn(keys[new].tolist(), [raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
        place = np.insert(place[inverse], texts[1:], 0)
        sizes = self.sizes[place]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids_of[np.arange(total) + np.repeat(self.starts[place] - (stops - sizes), sizes)]
        return ids, np.diff(stops[texts[1:] + np.arange(len(column))], prepend=0)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, without the end id."""
        ids, sizes = self.batch(pa.array(texts, pa.large_string()))
        return [own[:-1].tobytes() for own in np.split(ids, np.cumsum(sizes)[:-1])[:len(texts)]]


_words: dict[tuple[str, str, int], Words] = {}  # a worker serves many tasks


def write(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, folder: str | None = None) -> DataFrame:
    """Write all documents; gives the manifest: shard (its place), name, folder, dtype, base, n_docs, n_ids.

    ``tokenizer_path`` must exist on every worker.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    key = (tokenizer_path, dtype, end_id)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ranges = max(1, min(MOST_SHARDS, -(-slim.count() // SHARD_ROWS)))
    ordered = slim.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():08d}-{task.taskAttemptId()}"
        words = _words.get(key) or _words.setdefault(key, Words(*key))
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        docs_seen, nulls, sizes = [], [], []
        out = None
        for batch in pieces(batches, "text", 1 << 20):
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}.bin")
            ids, own = words.batch(batch.column("text"))
            out.write(ids.tobytes())
            sizes.append(own)
            nulls.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype("u1"))
            docs_seen.append(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        sizes = np.concatenate(sizes).astype("<i8")
        store(f"{folder}/{name}.doc", np.concatenate(docs_seen).tobytes())
        store(f"{folder}/{name}.nul", np.concatenate(nulls).tobytes())
        store(f"{folder}/{name}.len", sizes.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "name": [name],
                                          "n_docs": pa.array([len(sizes)], pa.int64()), "n_ids": pa.array([int(sizes.sum())], pa.int64())})

    shards = written(ordered.mapInArrow(run, "shard bigint, name string, n_docs bigint, n_ids bigint"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    manifest = shards.withColumns({"base": F.coalesce(F.sum("n_ids").over(before), F.lit(0)), "folder": F.lit(folder), "dtype": F.lit(dtype)})

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = mapped(f"{row['folder']}/{row['name']}.len", "<i8")
                at = np.concatenate([[row["base"]], row["base"] + np.cumsum(sizes)]).astype("<i8")
                store(f"{row['folder']}/{row['name']}.off", at.tobytes())
            yield batch

    spread = manifest.repartition(max(1, min(ranges, 200)), "shard")
    return written(spread.mapInArrow(offsets, spread.schema), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of a manifest: doc_id, start, ids (bytes, little-endian, unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{row['folder']}/{row['name']}"
                ids, offsets, docs = mapped(f"{at}.bin", row["dtype"]), mapped(f"{at}.off", "<i8"), mapped(f"{at}.doc", "<i8")
                nulls = mapped(f"{at}.nul", "u1").astype(bool)
                local = offsets - row["base"]
                for i in range(0, len(docs), 256):
                    stop = min(i + 256, len(docs))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(docs[i:stop], pa.int64(), mask=nulls[i:stop]), "start": pa.array(offsets[i:stop], pa.int64()),
                        "ids": pa.array([ids[local[k]:local[k + 1]].astype("<u4").tobytes() for k in range(i, stop)], pa.binary())})

    # A number of tasks by the shards: the manifest itself is so small that it would all go to one.
    return manifest.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def digest(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "start": batch.column("start"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())})

    return read(manifest).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def whole(spark: SparkSession, manifest: DataFrame, shard: int) -> np.ndarray:
    """The ids of one shard, mapped."""
    row = manifest.filter(F.col("shard") == shard).first()
    return mapped(f"{row['folder']}/{row['name']}.bin", row["dtype"])
