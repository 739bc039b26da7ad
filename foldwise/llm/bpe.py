"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Merges compile into a machine over bytes. A path of the machine is (last token, bytes read since); a
path whose bytes form a token that may follow the last one ends that token. For every prefix exactly one
path has no open bytes, and it holds the merge result of that prefix: a token row is a merge result
just when each neighbouring pair is one. Determinising keeps the set of live paths with what they still
owe; whatever all of them agree on is emitted. A path dies when its open bytes start no token, so
output lags by at most the longest token. Sets and steps are made when first needed and kept.

Texts are cut by the tokenizer's pattern first. Null and empty texts have no tokens. Repeated rows are
encoded alike, an empty table gives an empty table, extra columns stay.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldwise.llm.text import pieces

MEMO = 400_000  # pattern matches whose output is kept
STATES = 200_000  # determinised sets that are kept


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes a token of several bytes: what is left before its last merge."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        _, at = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Transducer:
    """Bytes to token ids. ``step`` is the determinised transition; ``encode`` runs a whole match."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.starts = {token[:k] for token in ranks for k in range(1, len(token))}  # of tokens that go on
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.edges: tuple[dict[bytes, list], dict[bytes, list]] = ({}, {})  # left and right edges of tokens met so far
        self._clear()

    def _clear(self) -> None:
        # A set of live paths: (tokens owed, last token, open bytes); None is the last token at the start.
        self.sets = [((((), None, b""),))]
        self.numbers = {self.sets[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at the left (0) or right (1) end of a token while it is built, each with the rank at which it is merged on."""
        found = self.edges[side].get(token)
        if found is None:
            found = [(token, float("inf"))]
            if len(token) > 1:
                inner = self.edge(halves(token, self.ranks)[side], side)
                found = [*inner[:-1], (inner[-1][0], self.ranks[token]), *found]
            self.edges[side][token] = found
        return found

    def may_follow(self, last: bytes | None, token: bytes) -> bool:
        """Whether neither token loses an end to the other: no merge across the border comes before the ones that build the two.

        Both are built side by side, always by the next merge of lower rank. A pair across the border goes first if its rank is lower than that of
        the left end's next merge, and not higher than the right end's: of equal ranks the leftmost is merged.
        """
        if last is None:
            return True
        known = self.follows.get((last, token))
        if known is None:
            left, right, i, j = self.edge(last, 1), self.edge(token, 0), 0, 0
            while known is None:
                (x, next_x), (y, next_y) = left[i], right[j]
                across = self.ranks.get(x + y)
                if across is not None and across < next_x and across <= next_y:
                    known = False
                elif i + 1 == len(left) and j + 1 == len(right):
                    known = True
                elif next_x <= next_y:
                    i += 1
                else:
                    j += 1
            self.follows[last, token] = known
        return known

    def step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        key = number << 8 | byte
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self._determinise(number, bytes((byte,)))
        return found

    def _determinise(self, number: int, byte: bytes) -> tuple[int, tuple[int, ...]]:
        paths, starts, ranks, follows = [], self.starts, self.ranks, self.follows.get
        for owed, last, open_bytes in self.sets[number]:
            read = open_bytes + byte
            if read in starts:
                paths.append((owed, last, read))
            rank = ranks.get(read)
            if rank is not None:
                known = follows((last, read))
                if self.may_follow(last, read) if known is None else known:
                    paths.append(((*owed, rank), read, b""))
        first = paths[0][0]
        shared = len(first)
        for owed, _, _ in paths[1:]:
            if not shared:
                break
            while owed[:shared] != first[:shared]:
                shared -= 1
        state = tuple([(owed[shared:], last, open_bytes) for owed, last, open_bytes in paths]) if shared else tuple(paths)
        found = self.numbers.setdefault(state, len(self.sets))
        if found == len(self.sets):
            self.sets.append(state)
        return found, first[:shared]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.sets) > STATES:
            self._clear()
        if len(self.follows) > 2 * MEMO:
            self.follows.clear()
        number, out, known = 0, [], self.steps.get
        for byte in piece:
            number, emitted = known(number << 8 | byte) or self.step(number, byte)
            if emitted:
                out.extend(emitted)
        for owed, _, open_bytes in self.sets[number]:
            if not open_bytes:
                return (*out, *owed)
        raise ValueError("a byte without a token")


class Encoder:
    """Texts to ids, match by match; outputs of short matches are kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        encode = self.machine.encode

        class Memo(dict):
            def __missing__(self, match: str) -> tuple[int, ...]:
                ids = encode(match.encode("utf-8", "surrogatepass"))
                if len(match) <= 64:
                    if len(self) >= MEMO:
                        self.clear()
                    self[match] = ids
                return ids

        self.memo = Memo()

    def encode(self, text: str) -> np.ndarray:
        return np.array(list(chain.from_iterable(map(self.memo.__getitem__, self.find(text)))), "<u4")


class Decoder:
    """Ids to text in chunks of any size: a state machine holds back the bytes of an unfinished character.

    ``state`` is the number of continuation bytes still due; bytes that can't belong to a character become U+FFFD.
    """

    def __init__(self, table: list[bytes]):
        self.table = table
        self.held = b""
        self.state = 0

    @staticmethod
    def due(tail: bytes) -> int:
        """Continuation bytes still missing at the end of ``tail``; 0 when it ends with a whole or a broken character."""
        for back in range(1, min(4, len(tail) + 1)):
            byte = tail[-back]
            if byte & 0xC0 == 0x80:
                continue
            length = 2 if 0xC2 <= byte <= 0xDF else 3 if byte & 0xF0 == 0xE0 else 4 if 0xF0 <= byte <= 0xF4 else 1
            if back > 1 and not {0xE0: 0xA0 <= tail[1 - back] <= 0xBF, 0xED: 0x80 <= tail[1 - back] <= 0x9F,
                                 0xF0: 0x90 <= tail[1 - back] <= 0xBF, 0xF4: 0x80 <= tail[1 - back] <= 0x8F}.get(byte, True):
                return 0
            return max(0, length - back)
        return 0

    def push(self, ids) -> str:
        data = self.held + b"".join(map(self.table.__getitem__, ids))
        self.state = self.due(data[-3:])
        keep = 0
        if self.state:
            keep = next(back for back in range(1, 4) if data[-back] & 0xC0 != 0x80)
        self.held = data[len(data) - keep:]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held, self.state = self.held.decode("utf-8", "replace"), b"", 0
        return rest


CHUNK = 8192


def decoded(ids: np.ndarray, table: list[bytes]) -> str:
    decoder, values = Decoder(table), ids.tolist()
    return "".join([decoder.push(values[i:i + CHUNK]) for i in range(0, len(values), CHUNK)]) + decoder.close()


_encoders: dict[tuple[str, str], tuple[Encoder, list[bytes]]] = {}  # a worker serves many tasks


def loaded(ranks_path: str, pattern: str) -> tuple[Encoder, list[bytes]]:
    """The encoder and the ids' bytes, made once a worker."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        ranks = read_ranks(ranks_path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _encoders[key] = (Encoder(ranks, pattern), table)
    return _encoders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but text by default), ids as bytes (``<u4``), n_tokens, ids_sha256, decoded_sha256.

    The rank file must lie at ``ranks_path`` on every worker. decoded_sha256 is the hash of the ids' own bytes
    decoded as a stream.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    new = [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    keep = [c for c in keep if c not in {n for n, _ in new}]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in new]])
    inner = docs.select(*keep, docs["text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = loaded(ranks_path, pattern)
        for batch in pieces(batches, "_text"):
            # What the encoder keeps holds no cycles; looking for some took a fifth of its time.
            gc.disable()
            try:
                rows = [encoder.encode(text or "") for text in batch.column("_text").to_pylist()]
            finally:
                gc.enable()
            sha = lambda b: hashlib.sha256(b).hexdigest()
            packed = [ids.tobytes() for ids in rows]
            arrays = [batch.column(c) for c in keep] + [
                pa.array(packed, pa.binary()), pa.array([len(ids) for ids in rows], pa.int64()),
                pa.array(map(sha, packed), pa.string()),
                pa.array([sha(decoded(ids, table).encode("utf-8", "surrogatepass")) for ids in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[n for n, _ in new]])

    return inner.mapInArrow(run, schema)
