"""The operators bound to the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import collocations, language_id, lattice_dedup, licenses, lm_scoring, ngram_join, packing, pieces, quality, spelling, suffix_dedup, topk_search, toxicity
from tallyspark.llm.common import read_table, remainder

#: A score of at least this predicts label 1.
CUT = 0.7


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSE_SQL = f"""
WITH files AS (
  SELECT doc_id, '/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || CAST(doc_id AS VARCHAR) AS path, text
  FROM documents
), templates(template, licence, sentence) AS (
  VALUES {", ".join(f"({i}, {_quoted(name)}, {_quoted(sentence)})" for i, (name, sentence) in enumerate(licenses.TEMPLATES))}
), held AS (
  SELECT token, ln((1.0 + (SELECT count(*) FROM files)) / (1 + count(*))) + 1 AS idf FROM (SELECT unnest(list_distinct({_words_sql("text")})) AS token FROM files) GROUP BY token
), terms AS (
  SELECT template, licence, token, count(*) AS ttf FROM (SELECT template, licence, unnest({_words_sql("sentence")}) AS token FROM templates) GROUP BY template, licence, token
), weights AS (
  SELECT template, licence, token, ttf, coalesce(idf, ln(1.0 + (SELECT count(*) FROM files)) + 1) AS idf FROM terms LEFT JOIN held USING (token)
), lengths AS (
  SELECT template, sqrt(sum(pow(ttf * idf, 2))) AS length FROM weights GROUP BY template
), split AS (
  SELECT path, len({_words_sql("text")}) AS size, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\n[^a-zA-Z0-9\n]*\n') AS paragraphs FROM files WHERE text IS NOT NULL
), units AS (
  SELECT path, size, 0 AS kind, unnest(lines) AS content, generate_subscripts(lines, 1) AS place FROM split
  UNION ALL SELECT path, size, 1, lines[i] || ' ' || lines[i + 1], i FROM split, unnest(range(1, len(lines))) t(i)
  UNION ALL SELECT path, size, 2, unnest(paragraphs), generate_subscripts(paragraphs, 1) FROM split
), tokens AS (
  SELECT path, size, kind, place, unnest({_words_sql("content")}) AS token FROM units
), counted AS (
  SELECT path, size, kind, place, token, count(*) AS tf, any_value(idf) AS idf FROM tokens JOIN held USING (token) GROUP BY path, size, kind, place, token
), owned AS (
  SELECT path, size, kind, place, sqrt(sum(pow(tf * idf, 2))) AS own FROM counted GROUP BY path, size, kind, place
), matched AS (
  SELECT path, size, kind, place, licence, sum(tf) AS long, round(sum(tf * ttf * weights.idf * weights.idf) / (any_value(own) * any_value(length)), {licenses.DIGITS}) AS score
  FROM counted JOIN weights USING (token) JOIN owned USING (path, size, kind, place) JOIN lengths USING (template)
  GROUP BY path, size, kind, place, template, licence HAVING count(*) >= {licenses.LEAST_SHARED}
), best AS (
  SELECT * FROM matched WHERE score >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY path, size, kind, place ORDER BY score DESC, licence, long DESC) = 1
), claims AS (
  SELECT path, size, licence, max(score) AS score, coalesce(sum(long) FILTER (kind = 0), 0) AS lines, coalesce(sum(long) FILTER (kind = 1), 0) AS pairs, coalesce(sum(long) FILTER (kind = 2), 0) AS paragraphs
  FROM best GROUP BY path, size, licence
), own AS (
  SELECT path, arg_min(licence, row(-greatest(lines, pairs, paragraphs), -score, licence)) AS licence, arg_min(score, row(-greatest(lines, pairs, paragraphs), -score, licence)) AS score,
    2 * greatest(sum(lines), sum(paragraphs)) >= any_value(size) AS whole
  FROM claims GROUP BY path
), holders AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS holder, path, licence, score FROM own WHERE whole
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path) = 1
), near AS (
  SELECT folder, arg_max(row(licence, score, h.path), length(holder)) AS h
  FROM (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM files) JOIN holders h ON folder = holder OR starts_with(folder, holder || '/')
  GROUP BY folder
)
SELECT doc_id, coalesce(own.licence, h[1]) AS licence, coalesce(own.score, h[2]) AS score,
  CASE WHEN own.licence IS NOT NULL THEN 'header' WHEN h IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.licence IS NOT NULL THEN files.path ELSE h[3] END AS licence_path
FROM files LEFT JOIN own USING (path) LEFT JOIN near ON folder = regexp_replace(files.path, '/[^/]*$', '')
"""


COLLOCATION_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS words FROM pieces
), grams AS (
  SELECT lang, size, words[i : i + size - 1] AS words
  FROM split, unnest(range(1, {collocations.MOST_WORDS + 1})) s(size), unnest(range(1, len(words) - size + 2)) t(i)
), counted AS MATERIALIZED (
  SELECT lang, size, words, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {collocations.LEAST_COUNT}
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, size, words, f AS a FROM counted WHERE size > 1
), cuts AS (
  SELECT c.lang, c.size, c.words, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.words = c.words[1 : k] JOIN counted y ON y.lang = c.lang AND y.words = c.words[k + 1 : c.size]
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inside AS (
  SELECT lang, words[i : i + part - 1] AS words, max(a) AS longer
  FROM candidates, unnest(range(2, size)) p(part), unnest(range(1, size - part + 2)) t(i)
  GROUP BY ALL
), kept AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM scored LEFT JOIN inside USING (lang, words) WHERE longer IS NULL OR 100 * longer < {collocations.ABSORBED} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= {collocations.TOP}
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.LanguageMixture.fit(docs.where(~held_out))
    return model.transform(docs.select("doc_id", "text")).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    scored = toxicity.scores(docs, read_table(spark, sf_dir, "labels"), learn=docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``/source/lang/doc_id``."""
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    files = read_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    found = licenses.scan(files)
    return licenses.inherit(files.select("doc_id", "path"), found).select("doc_id", "licence", "score", "origin", "licence_path")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; ids as a digest, and whether decoding gives the text back."""
    model = pieces.PieceModel.load(tokenizer_path("piece_bpe_32k.model"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.decode(pieces.encode(docs, model), model)
    # A marker character of the text itself comes back as a blank.
    same = F.col("decoded") == F.replace("text", F.lit(pieces.MARK), F.lit(" "))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), same.alias("restored"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), learn=docs.where(~held_out))
    return model.transform(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.top_k(vectors, F.col("id") % 50 == 0)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.lattice_dedup(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = remainder("doc_id", 7) != 2
    return lm_scoring.lm_scores(docs, learn).withColumn("held_out", remainder("doc_id", 7) == 2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    digest = F.sha2("kept", 256).alias("kept_sha256")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return suffix_dedup.remove_repeats(docs).select("doc_id", n_bytes, removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), digest)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_toxicity, op3_license_scan, op4_sentencepiece, op5_quality, op6_topk_search, op7_ngram_jaccard_join, op8_lattice_dedup, op9_lm_scoring, op10_best_fit_packing, op11_suffix_dedup, op12_spelling_variants, op13_phrase_collocations]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": LICENSE_SQL, "op6_topk_search": TOP_K_SQL, "op13_phrase_collocations": COLLOCATION_SQL}
