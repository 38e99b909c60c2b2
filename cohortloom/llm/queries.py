"""One registered query per operator, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import divergence, language, lexical, line_dedup, mixing, packing, page_text, personal_data, sharding, simhash, token_counts, top_k, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


@query
def op2_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces)


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return grouped.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.read_tokenizer(tokenizer_path("word_bpe_49k.json")))


@query
def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), weights=(1.0,) * 8, grown=(1.0,) * 9)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    allowed = language.allowed_to_learn("doc_id")
    found = language.detect(documents, language.learn(documents, allowed))
    return found.select("doc_id", F.coalesce(~allowed, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")


@query
def op9_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(line_dedup.kept_text("text", F.col("drop_bits")), F.lit(""))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


# Whole texts as arrays of lines; keys of two documents or more lose their lines but in the first.
ORACLE["op9_dedup_lines"] = r"""
WITH split_up AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split_up),
firsts AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id <> first_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = winnow.edited_likeness(table(spark, sf_dir, "documents"))
    marks, edited, following = F.col("marks"), F.col("edited_marks"), F.col("next_marks")
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        winnow.as_text(marks).alias("fingerprint"), winnow.as_text(edited).alias("edited_fingerprint"),
        winnow.likeness(marks, edited).alias("near_edited"), winnow.likeness(marks, following).alias("near_next"),
    )


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


# Every document that holds a term of an item is scored.
ORACLE["op11_lexical_search"] = r"""
WITH tokens AS (
  SELECT d, doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM documents)),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT d, count(*) AS n FROM tokens GROUP BY 1),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
items AS (
  SELECT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL),
scored AS (
  SELECT i.item_id, tf.d, tf.doc_id,
         CAST(sum(i.times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
                  * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + ((75 * s.n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM items i JOIN tf USING (term) JOIN df USING (term) JOIN sizes s ON s.d = tf.d, total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the digest are of base spans; ``spans`` has the disguised ones too."""
    found = personal_data.find(table(spark, sf_dir, "documents"))
    counts = [personal_data.count_of(kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.as_text(True), 256).alias("base_sha256"), personal_data.as_text().alias("spans"))


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


# Every group meets every kept term of its language, zero counts included, in 128-bit integers.
ORACLE["op13_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
counts AS (
  SELECT d, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n
  FROM (SELECT d, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM counts GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_sum FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT c.lang, c.source, c.term, CAST(sum(c.n) AS HUGEINT) AS n FROM counts c JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
cells AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(h.n, 0) AS n, s.v, s.lang_sum,
         sum(coalesce(h.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_sum
  FROM grp g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
shares AS (
  SELECT *, 1 + (1000000000 * (n + 1)) // CAST(n_sum + v AS HUGEINT) AS p, 1 + (1000000000 * (lang_n + 1)) // CAST(lang_sum + v AS HUGEINT) AS q FROM cells),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every_pair AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(p.value, 0) AS value
  FROM grp g JOIN grp o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source),
term_part AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM term_part))
WHERE part = 'pair' OR rank <= 200"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
