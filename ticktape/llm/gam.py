"""Quality scores from a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one per binned feature, and one per chosen pair of features.  The tables are learnt by
cyclic boosting: round after round, each feature in turn gets a shallow tree over its bins, fitted to what the sum of
all tables still misses; then the pairs whose four-quadrant cut gains most get theirs the same way.  A score is a sum
of table entries through the logistic function, added up for whole batches at once.

Features are counts of the whole text; labels, keys, languages and sources are none.  The model is fitted on the driver
from at most about ``SAMPLE`` labelled rows, chosen by a hash of their key and, if a key has many texts, by a hash of key and
text; equal rows teach once.  Everything else covers every row.

Defined cases: a null text is an empty text, and empty texts are scored like any other; a key with several labels counts as
good if at least half of them are; null keys and labels teach nothing; without labelled rows every score is 1.0, as
nothing speaks against any text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ticktape.llm.spotsigs import ANCHORS
from ticktape.llm.tables import sampled, text_of

SAMPLE = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, RATE, SMOOTH = 150, 0.15, 2.0

FEATURES = (
    "log_words word_length distinct_words top_word symbols bars digits capitals marks shouts double_lines "
    "line_words twice_pairs common_words ended_words longest_word foreign guiraud capital_words"
).split()
_COMMON = frozenset(w.encode() for w in ANCHORS)
_SYMBOLS, _MARKS = list(b"#*$%&<>"), list(b".,;:?")


def features(text: str) -> list[float]:
    """Counts of one whole text, as shares, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    pairs = len(words) - 1
    lower = Counter(raw.lower().split())
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        at[_SYMBOLS].sum() / n,
        at[124] / n,
        at[48:58].sum() / size,
        at[65:91].sum() / size,
        at[_MARKS].sum() / n,
        at[33] / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 0.0,
        sum(lower[w] for w in _COMMON if w in lower) / n,
        sum(c for w, c in counts.items() if w[-1:] in b".,!?;:") / n,
        float(np.log1p(max(map(len, counts), default=0))),
        at[128:].sum() / size,
        len(counts) / n**0.5,
        sum(c for w, c in counts.items() if w.isupper()) / n,
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges:
            bins = self.bins(x)
            for j, table in enumerate(self.tables):
                total += table[bins[:, j]]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[bins[:, i], bins[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Step of a shallow regression tree over ordered bins with gradients ``g`` and curvatures ``h``."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = left_g**2 / (left_h + SMOOTH) + (all_g - left_g) ** 2 / (all_h - left_h + SMOOTH) - all_g**2 / (all_h + SMOOTH)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted({*cuts, best[1]})
    step = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four quadrants: its gain and its step."""
    corner = lambda t: t.cumsum(0).cumsum(1)
    cg, ch = corner(g), corner(h)
    parts_g = [cg, cg[:, -1:] - cg, cg[-1:, :] - cg, cg[-1, -1] - cg[:, -1:] - cg[-1:, :] + cg]
    parts_h = [ch, ch[:, -1:] - ch, ch[-1:, :] - ch, ch[-1, -1] - ch[:, -1:] - ch[-1:, :] + ch]
    gain = sum(a**2 / (np.maximum(b, 0) + SMOOTH) for a, b in zip(parts_g, parts_h))[:-1, :-1]
    if not gain.size:
        return 0.0, np.zeros_like(g)
    r, c = np.unravel_index(gain.argmax(), gain.shape)
    step = np.zeros_like(g)
    for rows in (slice(0, r + 1), slice(r + 1, None)):
        for columns in (slice(0, c + 1), slice(c + 1, None)):
            step[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + SMOOTH)
    whole = g.sum() ** 2 / (h.sum() + SMOOTH)
    return float(gain[r, c] - whole), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """Learns the tables from features ``x`` and labels ``y`` (0 or 1)."""
    if not len(y):
        return Model(60.0)
    good = y.sum()
    model = Model(float(np.log((good + 1) / (len(y) - good + 1))))
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins, total = model.bins(x), np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), 3)
            table += step
            total += step[bins[:, j]]

    def crossed(i: int, j: int, values: np.ndarray) -> np.ndarray:
        wide = len(model.tables[j])
        return np.bincount(bins[:, i] * wide + bins[:, j], values, len(model.tables[i]) * wide).reshape(-1, wide)

    g, h = slopes()
    gains = {(i, j): _quadrants(crossed(i, j, g), crossed(i, j, h))[0] for i in range(x.shape[1]) for j in range(i)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _quadrants(crossed(i, j, g), crossed(i, j, h))[1]
            table += step
            total += step[bins[:, i], bins[:, j]]
    return model


def held_out(key: str = "doc_id") -> Column:
    """Rows that must not teach: the remainder of their key's CRC-32 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from the labelled rows of ``docs`` that are not held out."""
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    n = known.count()
    part = known.where(sampled(F.xxhash64("key"), sample, n))

    @pandas_udf("array<double>")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(t) for t in batch])

    # the sampled keys are bounded by the parameter, so they may be broadcast; their distinct texts are bounded in turn
    body = text_of(text)
    texts = docs.select(F.col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("hash")).join(F.broadcast(part), "key")
    m = texts.select("key", "hash").distinct().count()
    some = texts.where(sampled(F.xxhash64("key", "hash"), sample, m))
    rows = some.select("key", "hash", "y", measured("text").alias("x")).dropDuplicates(["key", "hash"]).collect()
    rows.sort(key=lambda r: (r["key"], r["x"]))
    return fit(np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], float))


def score_udf(model: Model):
    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(feature_matrix(batch)))

    return score


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (the input row, whatever its columns are called) and its ``score``."""
    return docs.select(F.struct("*").alias("row"), score_udf(model)(text_of(text)).alias("score"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= threshold).select("row.*")
