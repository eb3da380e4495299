"""Toxicity by compression distance: windows of a text under two zstandard dictionaries.

The ordinary dictionary is trained on windows of ordinary text.  The toxic one
has the same content and, before it, the segments that toxic text repeats in many
contexts and ordinary text hardly does; so a window that compresses shorter with
it repeats toxic segments, and other windows compress alike.  A text's score is a
logistic function, calibrated on labelled texts that trained no dictionary, of
what its windows save.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so many bytes of labelled toxic text, and twice as many of ordinary, are drawn by a hash for training.
MOST_TRAINING_BYTES = 8 << 20
#: Nor more than about so many rows of each, however short; the ids of the sample go to every task.
MOST_TRAINING_ROWS = 20_000
#: Words of a window; a text is covered from its first to its last word.
WINDOW = 4
DICTIONARY_BYTES = 8192
#: A toxic segment: in this many contexts for each that ordinary text lets expect, and so many deviations above it.
RATIO, DEVIATIONS = 8.0, 12.0
#: A window is counted at each of these numbers of bytes saved.
SAVED = (2, 3, 4, 5, 6, 7, 8, 10)
#: Ends every window and both dictionaries, so that no window is stored uncompressed.
TAIL = bytes(range(128, 192)) * 2
FEATURES = 2 * len(SAVED) + 1

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_CLEAN).split()


def windows_of(words: list[bytes], tail: bytes = b"", size: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " + tail for i in range(0, len(words), size)]


def contexts(texts: Iterable[bytes | None]) -> Counter:
    """In how many different pairs of neighbours each word stands; copies of a text add nothing."""
    number: dict[bytes, int] = {b"": 0}
    found = []
    for text in texts:
        codes = [0, *(number.setdefault(w, len(number)) for w in words_of(text)), 0]
        if len(codes) > 2:
            c = np.array(codes, np.int64)
            found.append(np.stack([c[1:-1], c[:-2], c[2:]], axis=1))
    if not found:
        return Counter()
    triples = np.concatenate(found)
    order = np.lexsort(triples.T[::-1])
    triples = triples[order]
    new = np.ones(len(triples), bool)
    new[1:] = (triples[1:] != triples[:-1]).any(axis=1)
    each = np.bincount(triples[new, 0], minlength=len(number))
    return Counter({w: int(each[i]) for w, i in number.items() if i})


def toxic_segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of toxic text that stand in far more contexts than ordinary text lets expect, the most frequent last."""
    ours, theirs = contexts(toxic), contexts(ordinary)
    scale = sum(ours.values()) / max(sum(theirs.values()), 1)
    kept = []
    for word, n in ours.items():
        expected = max((theirs[word] + 1) * scale, 0.05)
        if len(word) > 2 and n >= RATIO * expected and n - expected >= DEVIATIONS * expected**0.5:
            kept.append((n, word))
    return [w for _, w in sorted(kept)]


def ordinary_content(ordinary: list[bytes]) -> bytes:
    """What the dictionary trainer keeps of different windows of ordinary text."""
    windows = list(dict.fromkeys(w for t in ordinary for w in windows_of(words_of(t), size=8)))
    windows = [windows[i] for i in np.random.RandomState(42).permutation(len(windows))[:40_000]]
    try:
        return zstandard.train_dictionary(2 * DICTIONARY_BYTES, windows, level=3).as_bytes()[-DICTIONARY_BYTES:]
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(windows)[-DICTIONARY_BYTES:]


@dataclass
class ToxicityModel:
    segments: tuple[bytes, ...]
    base: bytes
    weights: np.ndarray  # of the features, the constant last

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return {"segments": self.segments, "base": self.base, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"_pair": None}

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        if self._pair is None:
            options = zstandard.ZstdCompressionParameters(
                window_log=16, hash_log=15, chain_log=15, search_log=4, min_match=6, strategy=zstandard.STRATEGY_GREEDY,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            pair = []
            for content in (b" " + b" ".join(self.segments) + b" " + self.base + TAIL, b" " + self.base + TAIL):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=options)
                pair.append(zstandard.ZstdCompressor(compression_params=options, dict_data=own))
            self._pair = tuple(pair)
        return self._pair

    def features(self, text: bytes | None) -> list[float]:
        """Number and share of windows by the bytes they save under the toxic dictionary, and the most that one saves."""
        toxic, ordinary = self.compressors()
        words = words_of(text)
        parts = [np.zeros(0, np.int64)]
        for at in range(0, len(words), WINDOW * 4096):
            windows = windows_of(words[at : at + WINDOW * 4096], TAIL)
            pair = [c.multi_compress_to_buffer(windows, threads=1) for c in (ordinary, toxic)]
            parts.append(np.array([len(a) - len(b) for a, b in zip(*pair)], np.int64))
        saved = np.concatenate(parts)
        counts = [int((saved >= s).sum()) for s in SAVED]
        n = max(len(saved), 1)
        return [*np.log1p(counts), *(10 * c / n for c in counts), float(saved.max(initial=0)) / 5]

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights with a small ridge, by Newton's method."""
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(design.shape[1])
    ridge = np.full(len(w), 0.1)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p) + 1e-9)) @ design + np.diag(ridge), design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[bytes, int, int]]) -> ToxicityModel:
    """From (text, label, draw): two thirds of the draws train the dictionaries, the rest calibrate their savings.

    Without texts of both kinds the score is the smoothed rate of the labels.
    """
    rows = sorted(rows, key=lambda r: (r[2], r[0]))

    def dictionaries(part: list[tuple[bytes, int, int]]) -> ToxicityModel:
        toxic, ordinary = ([t for t, label, _ in part if label == y] for y in (1, 0))
        segments = toxic_segments(toxic, ordinary) if toxic and ordinary else []
        return ToxicityModel(tuple(segments), ordinary_content(ordinary), np.zeros(FEATURES + 1))

    model, held = dictionaries([r for r in rows if r[2] % 3 != 2]), [r for r in rows if r[2] % 3 == 2]
    y = np.array([float(r[1]) for r in held])
    if 0 < y.sum() < len(y) and model.segments:
        model.weights = calibrated(np.array([model.features(r[0]) for r in held]), y)
    else:
        rate = (sum(r[1] for r in rows) + 1) / (len(rows) + 2)
        model.weights[-1] = np.log(rate / (1 - rate))
    return model


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    keep: Column | None = None, most_bytes: int = MOST_TRAINING_BYTES, most_rows: int = MOST_TRAINING_ROWS,
) -> ToxicityModel:
    """Fit on labelled rows (those with ``keep`` of the id), about ``most_bytes`` of toxic text and twice that of ordinary.

    Only this bounded sample reaches the driver.  Rows without label, id or text are left out.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    if keep is not None:
        marked = marked.where(keep)
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = texts.select("id", F.octet_length("text").alias("n")).join(marked, "id").groupBy("y").agg(F.sum("n"), F.count("*"))
    wanted = {0: 2 * most_bytes, 1: most_bytes}
    share = {y: min(1.0, wanted.get(y, 0) / max(n, 1), most_rows / rows) for y, n, rows in sizes.collect()}
    limit = F.when(F.col("y") == 1, int(share.get(1, 0) * (1 << 20))).otherwise(int(share.get(0, 0) * (1 << 20)))
    drawn = marked.select("id", "y", draw.alias("draw")).where(F.col("draw") < limit)
    table = texts.join(F.broadcast(drawn), "id").select(F.col("text").cast("binary").alias("text"), "y", "draw").toArrow()
    return fit(list(zip(table.column("text").to_pylist(), table.column("y").to_pylist(), table.column("draw").to_pylist())))


def toxicity(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """A double column: how likely a whole text is toxic, from 0 to 1; null and empty texts have the score of no window."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the dictionaries' size

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            texts = batch.cast(pa.binary())
            scores = [own.score(texts.slice(at, 512).to_pylist()) for at in range(0, len(texts), 512)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return run(text)
