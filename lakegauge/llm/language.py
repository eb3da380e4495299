"""Language identification by error-correcting output codes over letter n-grams.

Each learned language has a codeword.  For each bit a binary classifier weighs
every n-gram by the logarithm of its share in the languages with that bit over
its share in the others.  A text's margins are compared with all codewords by a
logistic loss in which a bit counts by how well it separates the languages; the
nearest codeword wins, and a near second is flagged as ambiguous.

The n-gram counts come from all labelled documents, summed in each task and then
by key; what reaches the driver is bounded by the alphabet and the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Symbols of an n-gram: a separator, 26 letters, and 32 classes of bytes beyond ASCII.
SYMBOLS = 64
GRAMS = SYMBOLS**3
#: Up to so many languages every useful code bit is used; beyond, so many random bits for each doubling.
EXHAUSTIVE, BITS_PER_DOUBLING = 7, 10
#: Texts are read by parts of this many bytes, which bounds memory and drops nothing.
PART_BYTES = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_SYMBOL = np.zeros(256, np.uint8)
for _c in range(26):
    _SYMBOL[65 + _c] = _SYMBOL[97 + _c] = 1 + _c
_SYMBOL[128:] = 27 + np.arange(128) % 32


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Codes of all three-symbol grams of a whole text, with a separator before and after it."""
    padded = b" " + text + b" "
    for at in range(0, max(1, len(padded) - 2), PART_BYTES):
        s = _SYMBOL[np.frombuffer(padded, np.uint8, min(PART_BYTES + 2, len(padded) - at), at)].astype(np.int32)
        yield (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def codebook(languages: int) -> np.ndarray:
    """Codewords (languages, bits) of -1 and 1, with no constant and no repeated bit."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        columns = range(1, 1 << (languages - 1))
        return np.array([[1 if (c << 1) >> row & 1 else -1 for c in columns] for row in range(languages)], np.int8)
    draw = np.random.RandomState(42)
    bits: set[tuple] = set()
    while len(bits) < BITS_PER_DOUBLING * int(np.ceil(np.log2(languages))):
        column = draw.permutation(languages) < languages // 2
        bits.add(tuple(column ^ column[0]))
    return np.array(sorted(bits), np.int8).T * 2 - 1


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (GRAMS, bits)
    bit_weight: np.ndarray

    def margins(self, text: bytes) -> tuple[np.ndarray, int]:
        """The bits' mean log-odds, and the number of grams they come from."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for codes in grams(text):
            codes = codes[codes != 0]  # three separators say nothing
            for at in range(0, len(codes), 1 << 16):
                total += self.weights[codes[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / max(n, 1), n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous); a text without a letter is undetermined."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        mean, n = self.margins(text.encode("utf-8", "surrogatepass"))
        z = np.clip(mean * np.sqrt(n), -30, 30)
        loss = np.log1p(np.exp(-self.code * z)) @ self.bit_weight
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        order = np.argsort(loss, kind="stable")
        return self.languages[order[0]], float(share[order[0]]), bool(share[order[1]] > 0.25)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: Column | None = None
) -> LanguageModel:
    """Learn from all rows of ``docs`` with a language (and ``keep``); repeated rows count as often as they stand.

    Every language weighs the same, however many texts it has.  Without labelled
    text nothing is learned and every prediction is undetermined.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if keep is None else keep))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                own = sums.setdefault(lang, np.zeros(GRAMS, np.int64))
                for codes in grams(text.as_py()):
                    if len(codes) < 20_000:
                        np.add.at(own, codes, 1)
                    else:
                        own += np.bincount(codes, minlength=GRAMS)
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(own[seen])], ["lang", "gram", "n"])

    counts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, gram int, n long")
    table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = table.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    if not languages:
        return LanguageModel((), np.zeros((0, 0), np.int8), np.zeros((GRAMS, 0), np.float32), np.zeros(0))
    number = {lang: i for i, lang in enumerate(languages)}
    seen = np.zeros((len(languages), GRAMS))
    seen[np.array([number[x] for x in names], np.int64), table.column("gram").to_numpy()] = table.column("n").to_numpy()
    seen[:, 0] = 0
    # shares with a little of the languages' mean, so that a gram of one language is evidence but not proof
    share = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    share = 0.98 * share + 0.02 * share.mean(axis=0, keepdims=True) + 1e-8
    code = codebook(len(languages))
    weights = np.zeros((GRAMS, code.shape[1]), np.float32)
    apart = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        one, other = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log(one / other)
        apart[b] = min(abs(float(s @ weights[:, b])) for s in share)  # the language that this bit tells worst
    used = seen.sum(axis=0) > 0
    weights[~used] = 0
    total = apart.sum()
    return LanguageModel(languages, code, weights, apart / total * len(apart) if total else np.ones(len(apart)))


def identify(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A struct column (lang_pred, score, ambiguous) of the whole text; null and letterless texts are ``und``."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the alphabet and the code

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [shared.value.predict(t.as_py()) for t in texts]
        columns = list(zip(*rows)) if rows else [[], [], []]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang_pred", "score", "ambiguous"])

    return run(text)
