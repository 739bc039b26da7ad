"""URL filter: rules first, then the ratio of two character language models.

Rules (host, path) allow or block a host with its subdomains below a path; the longest that fits wins. URLs that
rules decide also teach two variable-order Markov models of characters, one of accepted and one of rejected
URLs. Contexts of zero to ``ORDER`` bytes interpolate by Witten-Bell; contexts seen once are left to shorter ones. The
difference of log-likelihoods per character is calibrated by a logistic curve on URLs held out from the models.

The models learn from at most ``TRAIN`` distinct URLs a class, those of smallest hash. Without URLs of both classes
there is no model and the method allows. A null URL, or one without ``://``, has an empty host and path; it is
judged by its characters. Repeated rows are judged alike, an empty table gives an empty table, extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.text import pieces, text_bytes

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
TRAIN = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN, _CLOSE, _SYMBOLS = 256, 257, 258


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path, both empty where the URL is null or has no ``://``."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), "path": F.coalesce(path, F.lit(""))})


def ruled(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, word in sorted(rules, key=lambda r: len(r[0])):
        domain, _, below = name.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + below)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All URLs as symbols with ORDER openings before and one close after, and the places to be predicted."""
    data, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(sizes)) * (ORDER + 1) + ORDER
    out = np.full(len(data) + len(sizes) * (ORDER + 1), _OPEN, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(data)) + owner * (ORDER + 1) + ORDER] = data
    out[starts + sizes] = _CLOSE
    wanted = np.ones(len(out), bool)
    for k in range(1, ORDER + 1):
        wanted[starts - k] = False
    return out, np.flatnonzero(wanted)


def _contexts(symbols: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    code = np.zeros(len(places), np.uint64)
    for back in range(k, 0, -1):
        code = code * np.uint64(_SYMBOLS + 1) + symbols[places - back] + np.uint64(1)
    return code


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Markov:
    """Counts of symbols after contexts of each length, as sorted codes."""

    levels: list = field(default_factory=list)

    @classmethod
    def fit(cls, urls: Sequence[str]) -> Markov:
        symbols, places = _symbols(pa.array(urls, pa.string()))
        model = cls()
        for k in range(ORDER + 1):
            context = _contexts(symbols, places, k)
            grams, n = np.unique(context * np.uint64(_SYMBOLS + 1) + symbols[places], return_counts=True)
            contexts, first, kinds = np.unique(grams // np.uint64(_SYMBOLS + 1), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            kept = (total > 1) | (k == 0)
            model.levels.append((grams, n, contexts[kept], total[kept], kinds[kept]))
        return model

    def score(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 probability of every predicted symbol."""
        p = np.full(len(places), 1.0 / _SYMBOLS)
        for k, (grams, n, contexts, total, kinds) in enumerate(self.levels):
            context = _contexts(symbols, places, k)
            at, seen = _find(contexts, context)
            if not seen.any():
                continue
            spot, there = _find(grams, context * np.uint64(_SYMBOLS + 1) + symbols[places])
            count = np.where(there, n[spot], 0)
            p = np.where(seen, (count + kinds[at] * p) / (total[at] + kinds[at]), p)
        return np.log10(p)


@dataclass
class Filter:
    accepted: Markov
    rejected: Markov
    slope: float = 1.0
    intercept: float = 0.0

    def ratio(self, urls: pa.Array) -> np.ndarray:
        """Log-likelihood difference per character, the end counted."""
        symbols, places = _symbols(urls)
        if not len(places):
            return np.zeros(0)
        diff = self.accepted.score(symbols, places) - self.rejected.score(symbols, places)
        starts = np.flatnonzero(symbols[places - 1] == _OPEN)
        starts = starts[np.r_[True, np.diff(starts) > 0]]
        sizes = np.diff(text_bytes(urls)[1]) + 1
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(diff, first) / sizes

    def probability(self, urls: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratio(urls) + self.intercept, -60, 60)))

    def calibrate(self, accepted: Sequence[str], rejected: Sequence[str]) -> None:
        """Logistic curve by Newton's method, both classes with equal weight and a weak pull to no slope."""
        x = np.concatenate([self.ratio(pa.array(accepted, pa.string())), self.ratio(pa.array(rejected, pa.string()))])
        y = np.r_[np.ones(len(accepted)), np.zeros(len(rejected))]
        w = np.r_[np.full(len(accepted), 0.5 / max(1, len(accepted))), np.full(len(rejected), 0.5 / max(1, len(rejected)))] * len(y)
        z, beta = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -60, 60)))
            gradient = z.T @ (w * (y - p)) - 1e-2 * beta
            hessian = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            beta = beta + np.clip(step, -20, 20)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.intercept = map(float, beta)


def train(judged: DataFrame, most: int = TRAIN) -> Filter | None:
    """Models from the URLs that rules decided; every fifth URL of the sample calibrates."""
    found = {}
    for word in ("allow", "block"):
        sample = judged.filter((F.col("_ruled") == word) & F.col("url").isNotNull()).select("url").distinct()
        found[word] = [r[0] for r in sample.orderBy(F.xxhash64("url"), "url").limit(most).collect()]
    if min(map(len, found.values())) == 0:
        return None
    fit = {k: [u for i, u in enumerate(v) if i % 5 or len(v) < 5] for k, v in found.items()}
    held = {k: v[::5] for k, v in found.items()}
    model = Filter(Markov.fit(fit["allow"]), Markov.fit(fit["block"]))
    model.calibrate(held["allow"], held["block"])
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, least: float = 0.5, most: int = TRAIN) -> DataFrame:
    """``pages`` with host, path, rule, verdict, ratio and accept_probability."""
    new = ("host", "path", "rule", "verdict", "ratio", "accept_probability")
    keep = [c for c in pages.columns if c not in new]
    rule, verdict = ruled(rules)
    judged = with_parts(pages.select(*keep)).withColumns({"rule": rule, "_ruled": verdict})
    model = train(judged, most)
    if model is None:
        none = F.lit(None).cast("double")
        return judged.select(*keep, "host", "path", "rule", F.coalesce("_ruled", F.lit("allow")).alias("verdict"),
                             none.alias("ratio"), none.alias("accept_probability"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the size of the sample
    schema = T.StructType([*judged.schema.fields, T.StructField("ratio", T.DoubleType()), T.StructField("accept_probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "url", 1 << 20):
            ratio = shared.value.ratio(batch.column("url"))
            p = 1 / (1 + np.exp(-np.clip(shared.value.slope * ratio + shared.value.intercept, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio), pa.array(p)], names=[*batch.schema.names, "ratio", "accept_probability"])

    scored = judged.mapInArrow(run, schema)
    word = F.when(F.col("accept_probability") >= least, "allow").otherwise("block")
    return scored.select(*keep, "host", "path", "rule", F.coalesce("_ruled", word).alias("verdict"), "ratio", "accept_probability")
