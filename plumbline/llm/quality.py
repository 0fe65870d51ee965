"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features in turn, each
time fitting a shallow tree to the gradient and adding its leaves to the
feature's lookup table; then the pairs whose joint table would gain most get
two-dimensional tables the same way. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.common import slices, split_words

#: Labelled rows the driver fits on; more are thinned by a hash of their id.
FIT_ROWS = 60_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, RATE, SHRINK = 120, 0.1, 1.0

FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "newline", "other_letters",
    "sentence_marks", "bangs", "bars", "symbols", "marked_words", "upper_words", "distinct_words",
    "top_word", "repeated_lines", "words_per_line",
]


def _classes() -> np.ndarray:
    """Which of the counted classes each byte belongs to, one row per class."""
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", bytes(range(128, 256)), b".,;:?", b"!", b"|", b"#$%&*@^~=+_<>\\/{}[]`"]
    table = np.zeros((len(groups), 256))
    for row, group in enumerate(groups):
        table[row, list(group)] = 1
    return table


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = [t.encode() for t in texts.to_pylist()]
    counts = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in raw], float).reshape(-1, 256)
    size = np.maximum(counts.sum(axis=1), 1)
    shares = counts @ _classes().T / size[:, None]
    ends, codes, words = split_words(texts)
    n = np.diff(ends)
    at_least = np.maximum(n, 1)
    owner = np.repeat(np.arange(len(raw)), n)
    lengths = np.array([len(w) for w in words], float)
    marked = np.array([not w[-1:].isalpha() and w[-1:] not in ".,;:?'\")" for w in words], float)
    shouted = np.array([len(w) > 1 and w.isupper() for w in words], float)
    per_text = lambda of_word: np.bincount(owner, of_word[codes] if len(codes) else None, minlength=len(raw)) / at_least
    distinct, top, repeated, lines = (np.zeros(len(raw)) for _ in range(4))
    for i, text in enumerate(raw):
        own = codes[ends[i] : ends[i + 1]]
        if len(own):
            found = np.unique(own, return_counts=True)[1]
            distinct[i], top[i] = len(found), found.max()
        parts = [x for x in text.split(b"\n") if x.strip()]
        lines[i] = len(parts)
        repeated[i] = (len(parts) - len(set(parts))) / max(1, len(parts))
    return np.column_stack(
        [
            np.log1p(counts.sum(axis=1)), np.log1p(n), per_text(lengths), *shares[:, :5].T, *shares[:, 5:].T,
            per_text(marked), per_text(shouted), distinct / at_least, top / at_least, repeated, n / np.maximum(lines, 1),
        ]
    )


@dataclass
class Model:
    """Lookup tables: one per feature, one per chosen pair of features."""

    prior: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.prior)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, rows[:, i], side="right")]
        for (i, j), table in self.pairs.items():
            a = np.searchsorted(self.pair_edges[i], rows[:, i], side="right")
            b = np.searchsorted(self.pair_edges[j], rows[:, j], side="right")
            total += table[a, b]
        return total

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features(texts)), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + SHRINK)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """Where a run of bins splits best; 0 if nowhere."""
    if len(g) < 2:
        return 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    best = int(np.argmax(gains))
    return best + 1 if gains[best] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, per bin, of a tree of at most ``depth`` levels over ordered bins."""
    cut = _cut(g, h) if depth else 0
    if not cut:
        return np.full(len(g), _step(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A split along one feature and one along the other on each side, the best of all first splits."""

    def best(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        found, out = -1.0, np.zeros_like(g)
        for cut in range(len(g)):
            parts, gain = [], 0.0
            for a, b in ((g[:cut], h[:cut]), (g[cut:], h[cut:])) if cut else ((g, h),):
                across = a.sum(axis=0)
                values = _tree(across, b.sum(axis=0), 1)
                gain += float((values * across).sum())
                parts.append(np.broadcast_to(values, a.shape))
            if gain > found:
                found, out = gain, np.concatenate(parts)
        return found, out

    one, two = best(g, h), best(g.T, h.T)
    return one[1] if one[0] >= two[0] else two[1].T


def train(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Fit the tables; with one class or no row, the smoothed share of label 1 alone."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(labels)) < 2:
        return model

    def cuts(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))

    width = rows.shape[1]
    model.edges = [cuts(rows[:, i], BINS) for i in range(width)]
    model.pair_edges = [cuts(rows[:, i], PAIR_BINS) for i in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(model.pair_edges)]
    total = np.full(len(labels), model.prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(width):
            g, h = slopes()
            size = len(model.tables[i])
            step = RATE * _tree(np.bincount(fine[i], g, size), np.bincount(fine[i], h, size))
            model.tables[i] += step
            total += step[fine[i]]

    def joint(i: int, j: int, of: np.ndarray) -> np.ndarray:
        a, b = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], of, a * b).reshape(a, b)

    g, h = slopes()
    gains = {(i, j): _gain(joint(i, j, g), joint(i, j, h)).sum() for i, j in combinations(range(width), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pairs = {(i, j): np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in chosen}
    for _ in range(ROUNDS // 2):
        for i, j in chosen:
            g, h = slopes()
            step = RATE * _pair_tree(joint(i, j, g), joint(i, j, h))
            model.pairs[i, j] += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS
) -> Model:
    """Model of ``label`` (1 or 0; others and nulls are left out) from rows that are not held out.

    Features of labelled documents are counted by Spark; at most about
    ``fit_rows`` feature rows, chosen by a hash of the id, come to the driver.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marks = marks.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("mark"))
    share = min(1.0, fit_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["doc_id", "x"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = given.mapInArrow(run, "doc_id long, x array<double>").join(marks, "doc_id").select("doc_id", "x", "mark").toPandas()
    found = found.sort_values(["doc_id", "mark"])
    rows = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return train(rows, found["mark"].to_numpy(float))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at 0.5 or more); null text counts as empty.

    Every row gets a score, repeated rows too. Input columns of these names are
    replaced. The model is a few thousand numbers and travels with the task.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                made = model.scores(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made)], names=[*part.schema.names, "score"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
