"""Importance resampling towards a target's distribution of hashed word runs.

A text's bytes go through a table of 256 entries that lower-cases A-Z and blanks
every separator, so that splitting at blanks gives its words.  A run of words is
hashed by carrying the CRC-32 of its first words on over a blank and the next
word.  Counters in the tasks reduce the hashes to one count a bucket; buckets
are summed for the documents and for the target, and a document weighs what its
runs gain on average.  Noise by a hash of the id turns the weights into a draw
without replacement.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakegauge.llm.common import written

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

#: Bytes of words stay, A-Z in lower case; all other ASCII bytes are blanks.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def run_hashes(words: list[bytes], longest: int = LONGEST) -> Iterator[list[int]]:
    """CRC-32 of the runs of one word, of two, and so on; a run's words are joined by a blank."""
    hashes = list(map(crc32, words))
    yield hashes
    if longest > 1:
        spaced = [b" " + w for w in words]
        for size in range(2, longest + 1):
            hashes = list(map(crc32, spaced[size - 1 :], hashes))
            yield hashes


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): runs of 1 to ``longest`` words in each bucket, over whole texts.

    Each task sends at most a row a bucket; empty buckets have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            seen: Counter[int] = Counter()
            for text in batch.column("text").to_pylist():
                for hashes in run_hashes(words_of(text), longest):
                    seen.update(hashes)
                if len(seen) > 1 << 20:
                    _reduce(seen, total, buckets)
            _reduce(seen, total, buckets)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def _reduce(seen: Counter[int], total: Counter[int], buckets: int) -> None:
    for value, n in seen.items():
        total[value % buckets] += n
    seen.clear()


def gains(docs: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's floor(1000 * ln of its share of the target over its share of the documents), with one run added to every bucket."""
    all_docs, all_target = float(sum(docs.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (target.get(b, 0) + 1.0) * all_docs / ((docs.get(b, 0) + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def draw_noise(id_column: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2**32))) of the first 8 hex digits h of sha256 of seed and id; a null id draws as ``null``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score), one for each row of ``docs``.

    ``weight`` is the floored mean of the gains of the document's runs, 0 without
    any.  Null and empty texts have no words.  With an empty target, or empty
    documents, buckets keep their added run, so gains stay finite.  What the
    driver gathers is a number a bucket.
    """
    sums = [{r.bucket: r.n for r in bucket_counts(t, c, longest, buckets).collect()} for t, c in ((docs, text_col), (target, target_col))]
    gain = gains(*sums, buckets)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, weights = [], [], []
            for text in batch.column("text").to_pylist():
                words, total, n = words_of(text), 0, 0
                for hashes in run_hashes(words, longest):
                    total += int(gain[np.array(hashes, np.int64) % buckets].sum())
                    n += len(hashes)
                sizes.append(len(words))
                counts.append(n)
                weights.append(total // n if n else 0)
            values = [batch.column("id"), *(pa.array(v, pa.int64()) for v in (sizes, counts, weights))]
            yield pa.RecordBatch.from_arrays(values, ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + draw_noise(F.col("id"), seed))


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT, **options
) -> DataFrame:
    """``weighed`` rows with their ``rank`` in the draw, null where they are not drawn.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100)
    with the highest scores are drawn, the smaller id first among equals (null
    ids last, then fewer runs, then the smaller weight; rows equal in all of
    these draw in any order).  Scores are whole numbers of a narrow range: their
    counts, a row a score, say how many rows stand above each score, so that
    rows are numbered only within a score.
    """
    rows = written(weighed(docs, target, id_col, **options), "weighed")
    able = rows.where(F.col("n_words") >= least_words)
    counts = able.groupBy("score").agg(F.count("*").alias("n"))
    falling = W.orderBy(F.desc("score"))
    above = written(
        counts.select("score", (F.sum("n").over(falling) - F.col("n")).alias("above"), F.sum("n").over(W.partitionBy()).alias("all")), "above"
    )
    above = above.select("score", "above", F.expr(f"all * {int(percent)} div 100").alias("wanted")).where("above < wanted")
    rank = F.col("above") + F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "weight"))
    drawn = able.join(above, "score").withColumn("rank", rank.cast("long"))
    last = above.agg(F.min("score")).first()[0]
    columns = ["id", "n_words", "n_features", "weight", "score"]
    rest = rows.where((F.col("n_words") < least_words) | (F.col("score") < F.lit(last)) | F.lit(last is None))
    return drawn.select(*columns, F.when(F.col("rank") <= F.col("wanted"), F.col("rank")).alias("rank")).union(
        rest.select(*columns, F.lit(None).cast("long").alias("rank"))
    )
