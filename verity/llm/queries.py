"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm import quality, toxicity
from verity.llm.backoff import PRIOR, score_texts
from verity.llm.common import id_crc, known_labels, labelled_sample, table
from verity.llm.exact_dedup import exact_dedup
from verity.llm.filter_audit import filter_audit
from verity.llm.html_wrapper import extract_main_text
from verity.llm.importance import resample
from verity.llm.language_id import identify, learn_languages
from verity.llm.line_dedup import line_dedup
from verity.llm.mixing import learn_domains, memberships, mix
from verity.llm.packing import pack_documents
from verity.llm.simhash_dedup import simhash_groups
from verity.llm.tiff import text_media


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Words that packing remembers in a task when it runs alone, about 90 MB for each of its two memories.
PACKING_WORDS = 400_000


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), cached_words=PACKING_WORDS)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), width=3, max_distance=3)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def fifth_held_out():
    return F.coalesce(F.pmod(id_crc(), F.lit(5)) == 0, F.lit(False))


def quarter_held_out():
    return F.coalesce(F.pmod(id_crc(), F.lit(4)) == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "toxic", toxicity.PER_CLASS, fifth_held_out())
    languages = learn_languages(docs.where(~fifth_held_out()))
    scored = toxicity.score_toxicity(docs, toxicity.learn_toxicity(sample, languages), known=known_labels(labels, "toxic", fifth_held_out()))
    return scored.select("doc_id", fifth_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Wanted shares of tokens by domain; a domain is a class of the labelled table.
TARGET_WEIGHTS = {"q1t0": 0.90, "q1t1": 0.03, "q0t0": 0.06, "q0t1": 0.01}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of rows with both labels."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("int").cast("string"), F.lit("t"), F.col("toxic").cast("int").cast("string")).alias("domain"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_domains(docs, domains_of(table(spark, sf_dir, "labels")))
    return mix(memberships(docs, model), model, TARGET_WEIGHTS).select("doc_id", "tokens", "posterior", "domain", "share", "rate", "target_gap")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(~quarter_held_out()))
    told = identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", quarter_held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", quality.PER_CLASS, fifth_held_out())
    scored = quality.score_quality(docs, quality.learn_quality(docs, sample))
    return scored.select("doc_id", fifth_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), order=2, buckets=10_000, percent=25, min_words=20, seed=7)


def op12_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(id_crc(), F.lit(5)) == 1, F.lit(False))
    scored = score_texts(table(spark, sf_dir, "documents").withColumn("learns", ~held_out), order=2)
    return scored.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_simhash_near_dedup, op3_exact_dedup, op4_line_dedup, op5_toxicity, op6_source_mixing, op7_language_id, op8_tiff_media, op9_quality_classifier, op10_html_extraction, op11_importance_resampling, op12_backoff_scores, op13_filter_audit]
    return {f.__name__: f for f in found}


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


#: Words of a line as a set; rarest words first; prefixes meet; sets are compared whole.
OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS n
  FROM documents
), firsts AS (
  SELECT line, min({'d': doc_id, 'n': n}) AS at,
         list_filter(list_distinct(string_split_regex(lower(line), '[ \t\x0B\f\r]+')), lambda x: x <> '') AS words
  FROM lines GROUP BY line
), sets AS (SELECT * FROM firsts WHERE len(words) > 0),
tokens AS (SELECT line, unnest(words) AS word FROM sets),
rarity AS (SELECT word, count(*) AS df FROM tokens GROUP BY word),
places AS (
  SELECT line, word, row_number() OVER (PARTITION BY line ORDER BY df, word) AS pos FROM tokens JOIN rarity USING (word)
), prefixes AS (
  SELECT line, word FROM places JOIN sets USING (line) WHERE pos <= len(words) - (len(words) * 80 + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT a.line AS late, b.line AS early FROM prefixes a JOIN prefixes b USING (word)
  JOIN sets s ON s.line = a.line JOIN sets t ON t.line = b.line
  WHERE s.at > t.at AND len(s.words) * 100 >= len(t.words) * 80 AND len(t.words) * 100 >= len(s.words) * 80
), similar_lines AS (
  SELECT DISTINCT late AS line FROM pairs JOIN sets s ON s.line = late JOIN sets t ON t.line = early
  WHERE len(list_intersect(s.words, t.words)) * 100 >= (len(s.words) + len(t.words) - len(list_intersect(s.words, t.words))) * 80
), marked AS (
  SELECT l.doc_id, l.n, l.line,
         s.line IS NOT NULL AND (s.at <> {'d': l.doc_id, 'n': l.n} OR r.line IS NOT NULL) AS gone
  FROM lines l LEFT JOIN sets s ON s.line = l.line LEFT JOIN similar_lines r ON r.line = l.line
)
SELECT m.doc_id, CASE WHEN bool_or(d.text IS NOT NULL) THEN coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') END AS text,
       count(d.text)::INT AS n_lines, count(*) FILTER (WHERE gone)::INT AS n_removed
FROM marked m JOIN documents d USING (doc_id) GROUP BY m.doc_id
"""


#: The 256 remainders of CRC-32, worked out bit by bit, and the checksum of the bytes in hexadecimal.
CRC_TABLE = "crc_table AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r FROM range(256) AS b(i)))"


def crc_sql(text: str) -> str:
    hexes = f"hex(encode({text}))"
    each = f"list_transform(range(1, len({hexes}), 2), lambda i: ('0x' || substr({hexes}, i, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))"


OP11_SQL = rf"""
WITH {CRC_TABLE},
texts AS (SELECT doc_id, false AS target, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
split AS (
  SELECT row_number() OVER () AS n, doc_id, target,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM texts
), features AS (
  SELECT n, doc_id, target, unnest(words) AS f FROM split
  UNION ALL
  SELECT n, doc_id, target, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM split
), dictionary AS (
  SELECT f, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM features GROUP BY f
), hashed AS (SELECT d.f, d.s, d.t, {crc_sql("d.f").replace("t[", "c.t[")} % 10000 AS bucket FROM dictionary d, crc_table c),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM buckets),
gains AS (
  SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((b.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS gain FROM buckets b, totals a
), weights AS (
  SELECT n, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight
  FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY n
), scored AS (
  SELECT n, doc_id, len(words) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (n) WHERE NOT target
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS place, 25 * count(*) OVER (PARTITION BY able) // 100 AS drawn FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END::BIGINT AS rank FROM ranked
"""


#: The rule of the model, order 2: (count + prior x unigram) / (count of the history + prior).
OP12_SQL = rf"""
WITH {CRC_TABLE},
split AS (
  SELECT row_number() OVER () AS n, doc_id, {crc_sql("coalesce(doc_id::VARCHAR, '')")} % 5 = 1 AND doc_id IS NOT NULL AS held_out,
         list_concat(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), [chr(13)]) AS words
  FROM documents, crc_table
), tokens AS (
  SELECT n, held_out, unnest(words) AS word, unnest(list_prepend(chr(9), words[:-2])) AS history FROM split
), words AS (SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
sums AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS types FROM words),
histories AS (SELECT history, count(*) AS h FROM tokens WHERE NOT held_out GROUP BY history),
pairs AS (SELECT history, word, count(*) AS p FROM tokens WHERE NOT held_out GROUP BY history, word),
each AS (
  SELECT n, coalesce(c, 0) AS c, (coalesce(c, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * (types + 1)) AS base, coalesce(h, 0) AS h, coalesce(p, 0) AS p
  FROM tokens LEFT JOIN words USING (word) LEFT JOIN histories USING (history) LEFT JOIN pairs USING (history, word), sums
), told AS (
  SELECT n, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, sum(log10(base)) AS base_score,
         sum(log10((p + {PRIOR[0]}::DOUBLE * base) / (h + {PRIOR[0]}::DOUBLE))) AS score
  FROM each GROUP BY n
)
SELECT doc_id, held_out, n_tokens, n_known, total AS train_tokens, base_score, score FROM split JOIN told USING (n), sums
"""


#: Each kind of document meets every step of every order: what fails first there is removed.
OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         concat(CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS fails
  FROM texts LEFT JOIN marks USING (doc_id)
), kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders(o) AS (SELECT x FROM letters UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, k AS step, o[k] AS own, o[:k - 1] AS before FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5),
met AS (
  SELECT part, filter_order, step, own, n, good, bad, fails = own AS sole, contains(fails, own) AS failed,
         translate(fails, before, '') <> fails AS gone
  FROM kinds, steps
), told AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op11_importance_resampling": OP11_SQL, "op12_backoff_scores": OP12_SQL, "op13_filter_audit": OP13_SQL}
