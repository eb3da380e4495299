"""Registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.llm import (
    decontaminate, extraction, importance, language, mixing, phrases, pieces, quality, simhash, tokens, toxicity, vectors, warc,
)
from lakegauge.llm.common import crc_bucket, read

#: File of the tokenizer in the public collection that the workers have.
TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.train(docs, labels, keep=crc_bucket(F.col("id"), 5) != 0)
    scored = docs.select(
        "doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), quality.quality(spark, model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = language.train(docs, keep=~held_out)
    found = docs.select("doc_id", held_out.alias("held_out"), language.identify(spark, model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")


def toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, keep=crc_bucket(F.col("id"), 5) != 0)
    scored = docs.select(
        "doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.toxicity(spark, model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_tokens", "n_repeated")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.planned(read(spark, sf_dir, "documents"))
    mix = F.col("mix")
    return planned.select(
        "doc_id", mix["size"].alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"),
        (mix["size"] * mix["copies"]).alias("taken"),
    )


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_files(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = warc.record_facts(warc.archived(read(spark, sf_dir, "pages")))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")
    return facts.select(
        page("origin").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"),
    )


def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(read(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))
    return found.select(
        F.col("id").alias("doc_id"), pieces.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.frequent_phrases(read(spark, sf_dir, "documents")))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_simhash_near_dedup": simhash_near_dedup,
    "op2_quality_classifier": quality_classifier,
    "op3_language_id": language_id,
    "op4_mixture": mixture,
    "op5_html_extraction": html_extraction,
    "op6_decontamination": decontamination,
    "op7_embedding_near_dedup": embedding_near_dedup,
    "op8_token_files": token_files,
    "op9_warc": warc_archive,
    "op10_toxicity": toxicity_classifier,
    "op11_sentencepiece": sentencepiece_ids,
    "op12_collocations": phrase_collocations,
    "op13_importance_resampling": importance_resampling,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op4_mixture": """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source
), total AS (SELECT sum(size) AS size, sum(weight) AS weight FROM sources
), rounds AS (
  SELECT 0 AS round, t.size AS rest, t.weight AS rest_weight, CAST([] AS VARCHAR[]) AS stopped FROM total t
  UNION ALL
  SELECT r.round + 1, r.rest - 3 * s.size, r.rest_weight - s.weight, s.names
  FROM rounds r, LATERAL (
    SELECT sum(size) - sum(CASE WHEN list_contains(r.stopped, coalesce('s' || source, 'n')) THEN size ELSE 0 END) AS size,
           sum(weight) - sum(CASE WHEN list_contains(r.stopped, coalesce('s' || source, 'n')) THEN weight ELSE 0 END) AS weight,
           list(coalesce('s' || source, 'n')) AS names
    FROM sources
    WHERE r.rest * weight > 3 * size * r.rest_weight OR list_contains(r.stopped, coalesce('s' || source, 'n'))
  ) s WHERE len(s.names) > len(r.stopped)
), last AS (SELECT * FROM rounds ORDER BY round DESC LIMIT 1
), goals AS (
  SELECT source, CAST(size AS BIGINT) AS source_size,
         CASE WHEN list_contains(l.stopped, coalesce('s' || source, 'n')) THEN CAST(3 * size AS DOUBLE)
              ELSE CAST(l.rest * weight AS DOUBLE) / CAST(l.rest_weight AS DOUBLE) END AS target
  FROM sources, last l
), rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0.0 ELSE g.target / g.source_size END AS rate
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
                                        / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
""",
    "op6_decontamination": f"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS phrase, least(len(w), 13) AS size
  FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM item_windows
), found AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM doc_words, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)
), occurring AS (
  SELECT f.doc_id, f.i, f.size, t.item_id FROM found f JOIN item_windows t ON f.phrase = t.phrase AND f.size = t.size
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM occurring, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurring) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached AS (
  SELECT a AS vec_id, b AS other FROM links
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
), lowest AS (SELECT vec_id, min(other) AS low FROM reached GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN lowest USING (vec_id)
""",
    "op9_warc": """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload FROM pages
), firsts AS (SELECT payload, min(page_id) AS first FROM hashed GROUP BY payload
), digits AS (
  SELECT page_id, h.payload, first, sha1(h.payload) AS hex FROM hashed h JOIN firsts f ON h.payload = f.payload
)
SELECT page_id, strlen(payload) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (CAST('0x' || substr(hex || '00', 1 + CAST(floor(5 * k / 4) AS INTEGER), 3) AS BIGINT) >> (7 - (5 * k) % 4)) & 31 AS INTEGER), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digits
""",
    "op12_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), runs AS (
  SELECT lang, size, w[i : i + size - 1] AS p
  FROM worded, range(1, 5) AS s(size), unnest(range(1, len(w) - size + 2)) AS r(i)
), frequent AS MATERIALIZED (SELECT lang, size, p, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30
), halves AS MATERIALIZED (
  SELECT lang, p, size, f AS a, k, p[1:k] AS head, p[k + 1 : size] AS tail FROM frequent, range(1, 4) AS g(k) WHERE k < size
), cuts AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, k, 2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS score
  FROM halves c JOIN frequent x ON x.lang = c.lang AND x.p = c.head JOIN frequent y ON y.lang = c.lang AND y.p = c.tail
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, p[i : i + part - 1] AS p, max(f) AS longer
  FROM frequent, range(2, 4) AS g(part), unnest(range(1, size - part + 2)) AS r(i) WHERE part < size GROUP BY ALL
), kept AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN inner_parts USING (lang, p)
  WHERE longer IS NULL OR 100 * longer < 80 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op13_importance_resampling": f"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), doc_words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item_words AS (
  SELECT unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark
), doc_counts AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM doc_words) GROUP BY ALL
), words AS (SELECT word FROM doc_counts UNION SELECT word FROM item_words
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(range(strlen(word)), lambda c, i: xor(c >> 8,
    t[(xor(c, CAST('0x' || substr(hex(word), 2 * i + 1, 2) AS BIGINT)) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM words, steps
), sums AS (
  SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM (
    SELECT word, n AS s, 0 AS t FROM doc_counts UNION ALL SELECT word, 0, 1 FROM item_words
  ) JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS gain
  FROM sums
), weighed AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM doc_counts JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
           CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM doc_words LEFT JOIN weighed USING (row)
), ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS able
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= able * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)
""",
}
