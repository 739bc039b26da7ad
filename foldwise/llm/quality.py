"""Quality classifier by co-training two views of a document.

The content view sees words and the style of the text, the metadata view sees source, language and length. Both
start from the labelled documents. In every round each view scores all unlabelled documents, and those it is
confident about teach the *other* view: a sample of them in which every source that the metadata view can tell apart has its
place in both classes, weighted by how many each row stands for. They weigh as much together as the labelled ones. At the end each view is calibrated on labelled documents that no round has
used, and their calibrated log-odds are added, less the prior's. All documents are scored; the labelled ones set the probability below
which a document is rejected (``decision``).

Views are fitted on at most ``LABELLED`` labelled documents, those of smallest hash of their id, and about ``TAUGHT`` of the
confident ones, one of each source's slot and class at least; no document is left out of the scoring. Scores cover every document and whole texts. Null and empty texts
have no words; null metadata is a value of its own. Documents labelled twice take the mean label, at least one half being
good. Without labels of both classes there is no model: the probability is null and everything is accepted. Repeated rows
are scored alike, an empty table gives an empty table, extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.text import hashed_words, mix, pieces, shingles, text_bytes
from foldwise.session import written

LABELLED = 6_000
TAUGHT = 6_000  # confident documents that each view is fitted on
ROUNDS = 3
CONFIDENT = 0.95
MOST = 0.5  # documents of this probability of being good are never rejected
WORD_SLOTS = 1 << 14
STYLE_BINS = 16
META_SLOTS = 1 << 12
STYLES = 12
BLOCK = 1 << 18  # entries of a sparse matrix that are worked on together

_CLASS = np.zeros(256, np.uint8)  # 0 other
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[ord(c) for c in "#*$%&|<>@^~=_{}[]\\/"]] = 3
_CLASS[[ord(c) for c in "!?"]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_CLASS[[*range(97, 123), *range(128, 256)]] = 6
_CLASS[[ord(c) for c in ".,;:"]] = 7
CONTENT_SLOTS = WORD_SLOTS + STYLES * STYLE_BINS  # below 2^15: a slot fits two bytes


@dataclass
class Sparse:
    """Rows of slots and values behind one another."""

    slots: np.ndarray
    values: np.ndarray
    offsets: np.ndarray

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.offsets[:-1][rows] - offsets[:-1], sizes) + np.arange(offsets[-1])
        return Sparse(self.slots[at], self.values[at], offsets)

    def stacked(self, other: Sparse) -> Sparse:
        return Sparse(np.concatenate([self.slots, other.slots]), np.concatenate([self.values, other.values]),
                      np.concatenate([self.offsets, self.offsets[-1] + other.offsets[1:]]))

    def entries(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values of the rows from ``first`` to before ``last``."""
        part = slice(self.offsets[first], self.offsets[last])
        return self.slots[part], self.values[part]

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Runs of rows of about ``BLOCK`` entries, so that no step needs memory for the entries of all rows."""
        cut = self.offsets[:-1] // BLOCK
        bounds = [0, *(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), len(cut)]
        return ((a, b) for a, b in zip(bounds[:-1], bounds[1:]) if b > a)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.offsets) - 1)
        for a, b in self.blocks():
            slots, values = self.entries(a, b)
            product, sums, at = w[slots], np.zeros(len(slots) + 1), self.offsets[a:b + 1] - self.offsets[a]
            product *= values
            np.cumsum(product, out=sums[1:])
            out[a:b] = sums[at[1:]] - sums[at[:-1]]
        return out

    def summed(self, g: np.ndarray, slots: int) -> np.ndarray:
        """Per slot the sum of its values times the number that ``g`` has for their row."""
        out = np.zeros(slots)
        for a, b in self.blocks():
            at, values = self.entries(a, b)
            out += np.bincount(at, values * np.repeat(g[a:b], np.diff(self.offsets[a:b + 1])), slots)
        return out


class Held(Sparse):
    """Content of documents in two bytes an entry: the values follow from the number of a row's words."""

    def __init__(self, narrow: np.ndarray, offsets: np.ndarray):
        self.narrow, self.offsets = narrow, offsets

    @property
    def slots(self) -> np.ndarray:
        return self.narrow.astype(np.int32)

    @property
    def values(self) -> np.ndarray:
        return self.entries(0, len(self.offsets) - 1)[1]

    def entries(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        ends = self.offsets[first:last + 1]
        sizes = np.diff(ends)
        values = np.repeat((1 / np.sqrt(np.maximum(sizes - STYLES, 1))).astype(np.float32), sizes)
        values[(ends[:-1, None] - ends[0] + np.arange(STYLES)).ravel()] = 1.0
        return self.narrow[ends[0]:ends[-1]], values

    def take(self, rows: np.ndarray) -> Held:
        starts, ends = self.offsets[:-1][rows], self.offsets[1:][rows]
        lists = [self.narrow[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        return Held(np.concatenate([self.narrow[:0], *lists]), np.concatenate([[0], np.cumsum(ends - starts)]))

    def stacked(self, other: Held) -> Held:
        return Held(np.concatenate([self.narrow, other.narrow]), np.concatenate([self.offsets, self.offsets[-1] + other.offsets[1:]]))


def _binned(share: np.ndarray) -> np.ndarray:
    """0 for none, then two bins for every factor of two below one."""
    with np.errstate(divide="ignore"):
        return np.where(share <= 0, 0, np.clip(STYLE_BINS - 1 + np.ceil(2 * np.log2(np.maximum(share, 1e-9))), 1, STYLE_BINS - 1)).astype(np.int64)


def content(texts: pa.Array) -> Sparse:
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8) if n else np.zeros((0, 8))
    hashes, at = hashed_words(texts)
    distinct, to = shingles(hashes, at, 1)
    n_words, n_distinct = np.diff(at), np.diff(to)
    chars = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 6], 1)
    shares = [kinds[:, 1] / letters, kinds[:, 2] / chars, kinds[:, 3] / chars, kinds[:, 4] / chars, kinds[:, 5] / chars,
              kinds[:, 7] / chars, 1 - n_distinct / np.maximum(n_words, 1), kinds[:, 6] / chars,
              n_words / chars, np.minimum(1, n_words / 4096), np.minimum(1, chars / np.maximum(n_words, 1) / 64),
              n_distinct / np.maximum(n_words, 1)]
    style = np.stack([k * STYLE_BINS + _binned(s) for k, s in enumerate(shares)], 1) if n else np.zeros((0, len(shares)), np.int64)
    width = style.shape[1]
    out = np.concatenate([[0], np.cumsum(n_distinct + width)])
    slots, values = np.empty(out[-1], np.int64), np.empty(out[-1])
    spots = (out[:-1, None] + np.arange(width)).ravel()
    slots[spots], values[spots] = style.ravel(), 1.0
    rest = np.ones(out[-1], bool)
    rest[spots] = False
    slots[rest] = STYLES * STYLE_BINS + (distinct % np.uint64(WORD_SLOTS)).astype(np.int64)
    values[rest] = np.repeat(1 / np.sqrt(np.maximum(n_distinct, 1)), n_distinct)
    return Sparse(slots, values, out)


def metadata(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> Sparse:
    columns = []
    for k, column in enumerate((source, lang)):
        values = column.cast(pa.string()).to_pylist()
        known = {v: i for i, v in enumerate(dict.fromkeys(values))}
        from zlib import crc32

        hashed = np.array([crc32(repr((k, v)).encode()) for v in known], np.uint64)
        columns.append(mix(hashed)[[known[v] for v in values]] if len(values) else np.zeros(0, np.uint64))
    size = n_chars.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
    columns.append(mix((np.round(2 * np.log2(np.maximum(size, 0) + 1)) + np.where(size < 0, 5000, 1000)).astype(np.uint64)))
    columns.append(mix(np.full(len(size), 7, np.uint64)))
    slots = (np.stack(columns, 1) % np.uint64(META_SLOTS)).astype(np.int64)
    return Sparse(slots.ravel(), np.ones(slots.size), np.arange(len(size) + 1) * slots.shape[1])


def fit(x: Sparse, y: np.ndarray, slots: int, weight: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Logistic regression with a bias in the last place, classes weighted equally; Adagrad on the whole sample."""
    weight = weight * np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y <= 0].sum()))
    w, seen = np.zeros(slots + 1), np.full(slots + 1, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + w[-1], -40, 40)))
        g = weight * (p - y)
        gradient = np.append(x.summed(g, slots), g.sum())
        gradient[:-1] += ridge * 1e-4 * w[:-1]
        seen += gradient**2
        w -= 0.5 * gradient / np.sqrt(seen)
    return w


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and intercept of a logistic curve."""
    z, beta = np.c_[score, np.ones(len(score))], np.array([0.5, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, z.T @ (y - p) - 1e-1 * beta), -2, 2)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    if beta[0] < 0:
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        return 0.0, float(np.log(rate / (1 - rate)))
    return float(beta[0]), float(beta[1])


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    content_curve: tuple[float, float]
    metadata_curve: tuple[float, float]
    prior: float
    least: float = MOST  # documents below this probability are rejected

    def probability(self, a: Sparse, b: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(a, b)[2], -40, 40)))

    def log_odds(self, a: Sparse, b: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = self.content_curve[0] * (a.dot(self.content) + self.content[-1]) + self.content_curve[1]
        two = self.metadata_curve[0] * (b.dot(self.metadata) + self.metadata[-1]) + self.metadata_curve[1]
        return one, two, one + two - self.prior


def decision(p: np.ndarray, y: np.ndarray, held: np.ndarray) -> float:
    """Probability below which documents are rejected, ``MOST`` at most: no labelled good one is lost if 90% of the held-out bad ones still go.

    Else it is the bound of least error on the ``held`` rows, both classes weighing the same.
    """
    least = min(MOST, p[y > 0].min())
    q, good = p[held], y[held] > 0
    if (q[~good] < least).mean() >= 0.9:
        return float(least)
    bounds = np.unique(np.append(q[q < MOST], MOST))
    return float(bounds[np.argmin([(q[good] < t).mean() + (q[~good] >= t).mean() for t in bounds])])


def parted(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit on and, for the calibration, every fourth of each class; all for both if they are few."""
    rows = np.argsort(label, kind="stable")
    return (np.sort(np.delete(rows, np.s_[::4])), np.sort(rows[::4])) if len(rows) >= 40 else (rows, rows)


def confident(docs: DataFrame, known: np.ndarray, weights: list[np.ndarray], curves: list[tuple[float, float]], taught: int) -> pa.Table:
    """view, mark, doc_id, weight: a sample of all documents but ``known`` that a view is confident about.

    Strata are the view, the mark and the slot of the source. Of each the rows of least hash are taken, in equal numbers as far as
    they go: about ``taught`` a view, one of a stratum at least.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights, curves, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, curves, known = shared.value
        kept, counts = np.zeros((0, 3), np.int64), {}
        for batch in pieces(batches, "text"):
            views = content(batch.column("text")), metadata(batch.column("source"), batch.column("lang"), batch.column("n_chars"))
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            place = views[1].slots[views[1].offsets[:-1]]
            new = ~np.isin(ids, known)
            for view, (x, w, c) in enumerate(zip(views, weights, curves)):
                p = 1 / (1 + np.exp(-np.clip(c[0] * (x.dot(w) + w[-1]) + c[1], -40, 40)))
                sure = new & (np.maximum(p, 1 - p) >= CONFIDENT)
                stratum = (view * 2 + (p > 0.5)) * META_SLOTS + place
                kept = np.concatenate([kept, np.stack([stratum, mix(ids.astype(np.uint64) + np.uint64(1)).view(np.int64), ids], 1)[sure]])
                for k, n in zip(*np.unique(stratum[sure], return_counts=True)):
                    counts[int(k)] = counts.get(int(k), 0) + int(n)
            kept = kept[np.lexsort((kept[:, 2], kept[:, 1], kept[:, 0]))]
            first = np.searchsorted(kept[:, 0], kept[:, 0])
            kept = kept[np.arange(len(kept)) - first < taught]
        if len(kept):
            lead = np.searchsorted(kept[:, 0], kept[:, 0]) == np.arange(len(kept))
            n = np.array([counts[int(k)] for k in kept[:, 0]]) * lead  # once for each stratum
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*kept.T, n)], names=["stratum", "_h", "doc_id", "_n"])

    fields = docs.select("doc_id", "text", "source", "lang", "n_chars").filter("doc_id is not null")
    rows = written(fields.mapInArrow(run, "stratum bigint, _h bigint, doc_id bigint, _n bigint"), "confident")
    sizes = rows.groupBy("stratum").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_there")).toArrow()  # 4 META_SLOTS rows at most
    if not sizes.num_rows:
        return pa.table({"view": [], "mark": [], "doc_id": pa.array([], pa.int64()), "weight": pa.array([], pa.float64())})
    stratum, whole, there = (sizes.column(c).to_numpy() for c in ("stratum", "_all", "_there"))
    most = np.ones(2, np.int64)
    for view in (0, 1):
        mine = np.minimum(there[stratum // (2 * META_SLOTS) == view], taught)
        low, high = 1, taught
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if np.minimum(mine, mid).sum() <= taught else (low, mid - 1)
        most[view] = low
    last = F.when(F.col("stratum") < 2 * META_SLOTS, int(most[0])).otherwise(int(most[1]))
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy("stratum").orderBy("_h", "doc_id"))).filter(F.col("_at") <= last)
    taken = ranked.select("stratum", "doc_id").toArrow().sort_by([("stratum", "ascending"), ("doc_id", "ascending")])
    of, ids = taken.column("stratum").to_numpy(), taken.column("doc_id").to_numpy()
    totals = dict(zip(stratum.tolist(), whole.tolist()))
    share = np.array([totals[k] for k in of.tolist()]) / np.bincount(np.searchsorted(np.unique(of), of))[np.searchsorted(np.unique(of), of)]
    return pa.table({"view": of // (2 * META_SLOTS), "mark": of // META_SLOTS % 2, "doc_id": ids, "weight": share.astype(float)})


def features(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, Sparse, Sparse]:
    """doc_id (ascending) and both views of the documents of ``ids``, a few thousand.

    The driver holds the slots of their words once, in the two bytes that come from the tasks (:class:`Held`).
    """
    picked = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = content(batch.column("text"))
            slots = pa.ListArray.from_arrays(pa.array(x.offsets, pa.int32()), pa.array(x.slots, pa.int16()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), slots], names=[*names, "slots"])

    names = ["doc_id", "source", "lang", "n_chars"]
    fields = {f.name: f.dataType.simpleString() for f in picked.schema}
    rows = picked.mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in names) + ", slots array<smallint>").toArrow()
    rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending")])).combine_chunks()
    one = lambda c: rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c)
    slots = one("slots")
    x = Held(slots.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(slots).to_numpy())]).astype(np.int64))
    return one("doc_id").to_numpy(), x, metadata(one("source"), one("lang"), one("n_chars"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, taught: int = TAUGHT) -> Model | None:
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("_label"))
    first = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).toArrow()
    if not first.num_rows:
        return None
    spark, of = docs.sparkSession, dict(zip(first.column("doc_id").to_pylist(), first.column("_label").to_pylist()))
    listed = lambda ids: spark.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())}))
    ids, *views = features(docs, listed(list(of)))
    label = np.array([of[d] for d in ids.tolist()], float)
    train, held = parted(label)
    if len(np.unique(label[train])) < 2 or len(np.unique(label[held])) < 2:
        return None
    slots, own = (CONTENT_SLOTS, META_SLOTS), np.array(sorted(of), np.int64)
    base, y = [v.take(train) for v in views], label[train]
    weights = [fit(v, y, s, np.ones(len(y))) for v, s in zip(base, slots)]
    for _ in range(ROUNDS):
        curves = [calibrated(v.dot(w) + w[-1], y) for v, w in zip(base, weights)]
        sure = confident(docs, own, weights, curves, taught)
        if not sure.num_rows:
            break
        found, *more = features(docs, listed(np.unique(sure.column("doc_id").to_numpy())))
        weights = []
        for k in (0, 1):  # each is taught by the other
            given = sure.filter(pa.compute.equal(sure.column("view"), 1 - k))
            order = np.argsort(given.column("doc_id").to_numpy(), kind="stable")
            theirs, mark, share = (given.column(c).to_numpy()[order] for c in ("doc_id", "mark", "weight"))
            rows = np.flatnonzero(np.isin(found, theirs))  # repeated documents stand for the rows they are
            at = np.searchsorted(theirs, found[rows])
            m, w = mark[at].astype(float), share[at] / np.bincount(np.searchsorted(theirs, found[rows]), minlength=len(theirs))[at]
            for c in (0.0, 1.0):
                w[m == c] *= (y == c).sum() / max(w[m == c].sum(), 1e-9)
            weights.append(fit(base[k].stacked(more[k].take(rows)), np.concatenate([y, m]), slots[k], np.concatenate([np.ones(len(y)), w])))
    y = label[held]
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    curves = [calibrated(v.take(held).dot(w) + w[-1], y) for v, w in zip(views, weights)]
    model = Model(weights[0], weights[1], *curves, float(np.log(rate / (1 - rate))))
    model.least = decision(model.probability(*views), label, held)
    return model


def score(docs: DataFrame, model: Model | None, least: float | None = None) -> DataFrame:
    """``docs`` with content_odds, metadata_odds, quality_probability and accepted: at least ``least``, or else the model's own bound."""
    new = [("content_odds", T.DoubleType()), ("metadata_odds", T.DoubleType()), ("quality_probability", T.DoubleType()), ("accepted", T.BooleanType())]
    docs = docs.drop(*[n for n, _ in new])
    if model is None:
        return docs.withColumns({n: F.lit(n == "accepted" or None).cast(t) for n, t in new})
    least = model.least if least is None else least
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of thousands of numbers
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            one, two, odds = shared.value.log_odds(
                content(batch.column("text")), metadata(batch.column("source"), batch.column("lang"), batch.column("n_chars")))
            p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (one, two, p, p >= least))],
                                             names=[*batch.schema.names, *[n for n, _ in new]])

    return docs.mapInArrow(run, schema)
