"""Quality of documents: histogram gradient-boosted trees over statistics of the whole text.

The trees are flattened into arrays, and all trees of all texts of a batch are
walked at once, a level at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The trees are fitted on a hash-drawn sample of about so many labelled rows; scoring covers every row.
MOST_TRAINING_ROWS = 50_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, RIDGE = 120, 4, 64, 0.1, 8, 1.0

FEATURES = (
    "chars", "words", "word_length", "long_words", "upper", "letters", "digits", "spaces", "exclaims", "bars", "signs",
    "stops", "commas", "others", "beyond_ascii", "entropy", "distinct", "top_word", "echoes", "pairs_repeated", "upper_words",
    "word_ends", "lines", "line_length", "lines_repeated", "line_ends", "short_lines", "bullets", "links", "deepest_run",
)

_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = (
        1 if 65 <= _c <= 90 else 0 if 97 <= _c <= 122 else 2 if 48 <= _c <= 57 else 3 if _c in b" \t\r\n\x0b\x0c"
        else 4 if _c == 33 else 5 if _c == 124 else 6 if _c in b"*#$%&@^~=+<>{}[]\\/_" else 7 if _c in b".?:;"
        else 8 if _c == 44 else 10 if _c >= 128 else 9
    )
_LINK = re.compile(rb"https?://|www\.|@[a-z0-9]+\.")


def statistics(text: bytes | None) -> list[float]:
    """The FEATURES of one whole text; an empty or null one has zeros."""
    data = text or b""
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=seen, minlength=11)
    p = seen[seen > 0] / n
    words = data.split()
    lower = data.lower().split()
    count = len(words)
    each = Counter(lower)
    lengths = np.fromiter(map(len, words), np.int64, count) if count else np.zeros(1, np.int64)
    number = {w: i for i, w in enumerate(each)}
    codes = np.fromiter(map(number.__getitem__, lower), np.int64, count)
    echoes = int((codes[1:] == codes[:-1]).sum())
    pairs = codes[1:] * len(each) + codes[:-1]
    repeated_pairs = 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0
    change = np.flatnonzero(np.diff(codes)) if count else codes
    runs = np.diff(np.concatenate([[-1], change, [count - 1]])) if count else np.zeros(1)
    lines = [x for x in (y.strip() for y in data.split(b"\n")) if x]
    same = len(lines) - len(set(lines))
    m, k, w = max(len(lines), 1), max(count, 1), float(n)
    letters = kinds[0] + kinds[1]
    return [
        np.log1p(w), np.log1p(count), float(lengths.mean()), float((lengths > 12).mean()), kinds[1] / max(letters, 1), letters / w,
        kinds[2] / w, kinds[3] / w, kinds[4] / k, kinds[5] / k, kinds[6] / k, kinds[7] / k, kinds[8] / k, kinds[9] / k, kinds[10] / w,
        float(-(p * np.log2(p)).sum()), len(each) / k, max(each.values(), default=0) / k, echoes / k, repeated_pairs,
        sum(map(bytes.isupper, words)) / k, sum(x[-1] in b"!*#$%&|" for x in words) / k, np.log1p(len(lines)), w / m / 100, same / m,
        sum(x[-1] in b".!?:" for x in lines) / m, sum(len(x) < 30 for x in lines) / m, sum(x[0] in b"-*|>" for x in lines) / m,
        len(_LINK.findall(data)) / k, float(runs.max()),
    ]


def statistics_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; a leaf has itself as both children."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray  # (nodes, 2)
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            above = (x[rows, self.feature[node]] > self.threshold[node]).astype(np.int64)
            node = self.children[node, above]
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def _split(hist: np.ndarray, count: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's best cut; hist is (features, bins, [gradient, hessian])."""
    left, below = hist.cumsum(axis=1)[:, :-1], count.cumsum(axis=1)[:, :-1]
    total, everything = hist[0].sum(axis=0), count[0].sum()
    right = total - left
    worth = lambda h: h[..., 0] ** 2 / (h[..., 1] + RIDGE)
    gain = worth(left) + worth(right) - worth(total)
    gain[(below < LEAST_LEAF) | (everything - below < LEAST_LEAF)] = -1
    best = int(np.argmax(gain))
    return float(gain.flat[best]), *divmod(best, gain.shape[1])


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost logistic loss; one class or no rows give its smoothed rate everywhere."""
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    roots, feature, threshold, children, value = [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        children.append([len(value), len(value)])
        value.append(v)
        return len(value) - 1

    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        offset = np.arange(x.shape[1]) * BINS
        raw = np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            roots.append(node(0.0))
            open_nodes = [(roots[-1], np.arange(len(y)), 0)]
            while open_nodes:
                at, rows, level = open_nodes.pop()
                step = float(RATE * g[rows].sum() / (h[rows].sum() + RIDGE))
                value[at] = step
                found = (0.0, 0, 0)
                if level < depth and len(rows) >= 2 * LEAST_LEAF:
                    flat = (binned[rows] + offset).ravel()
                    size = x.shape[1] * BINS
                    own = lambda w: np.bincount(flat, np.repeat(w, x.shape[1]), size).reshape(-1, BINS)
                    hist = np.stack([own(g[rows]), own(h[rows])], axis=2)
                    found = _split(hist, np.bincount(flat, minlength=size).reshape(-1, BINS))
                if found[0] <= 1e-6:
                    raw[rows] += step
                    continue
                _, f, cut = found
                feature[at], threshold[at] = f, float(cuts[f][cut])
                above = binned[rows, f] > cut
                children[at] = [node(0.0), node(0.0)]
                value[at] = 0.0
                open_nodes += [(children[at][0], rows[~above], level + 1), (children[at][1], rows[above], level + 1)]
    arrays = (np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, float), np.array(children, np.int64).reshape(-1, 2), np.array(value, float))
    return Trees(start, *arrays, depth)


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    keep: Column | None = None, most_rows: int = MOST_TRAINING_ROWS,
) -> Trees:
    """Fit on labelled rows (those with ``keep`` of the id), a sample of about ``most_rows`` drawn by a hash of the id;
    the sample is bounded, so it goes to every task.

    Rows without a label or an id are left out; a repeated row counts again.  Only the
    sample's statistics, a bounded table, reach the driver.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    if keep is not None:
        marked = marked.where(keep)
    share = most_rows / max(marked.count(), 1)
    drawn = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(min(share, 1.0) * (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_matrix(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(drawn), "id").select("id", "text", F.col("y").cast("int").alias("y"))
    kind = docs.schema[id_col].dataType.simpleString()
    table = sample.mapInArrow(run, f"id {kind}, y int, x array<double>").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = table.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T[::-1]))  # the same trees whatever the order of arrival
    return fit(x[order], y[order])


def quality(spark: SparkSession, model: Trees, text: Column) -> Column:
    """A double column: how likely a text is of quality, from 0 to 1; null and empty texts have a score too."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the number of trees and their depth

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        own = texts.cast(pa.binary())
        scores = [shared.value.score(statistics_matrix(own.slice(at, 512).to_pylist())) for at in range(0, len(own), 512)]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return run(text)
