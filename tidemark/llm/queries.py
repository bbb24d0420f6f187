"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import decontamination, licenses, line_dedup, packing, quality_model, quality_rules, secrets, simhash, token_counts, token_files
from tidemark.llm.common import shared_folder, table
from tidemark.llm.registry import query

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"


BARE = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""WITH own AS (SELECT source, text, unnest(list_distinct(list_transform({LINES}, lambda x: {BARE}))) AS line FROM documents),
total AS (SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source),
counted AS (SELECT source, line, count(DISTINCT text) AS pages, len(string_split_regex(line, '[\\x20\\x09-\\x0D]+')) AS words FROM own GROUP BY source, line),
drop_ AS (SELECT c.source, list(line) AS lines FROM counted c JOIN total ON c.source IS NOT DISTINCT FROM total.source
    WHERE pages >= CASE WHEN words > 50 THEN 3 ELSE 5 END AND pages > 0.05 * n * least(1, (10.0 / words) ** 2) GROUP BY c.source),
kept AS (SELECT doc_id, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)),
    lambda x: NOT list_contains(coalesce(drop_.lines, []::VARCHAR[]), {BARE})) AS kept
    FROM documents LEFT JOIN drop_ ON documents.source IS NOT DISTINCT FROM drop_.source)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM kept""")
def op1_line_dedup(spark, sf_dir):
    """Every document without the lines that more than 5 % of its source's texts (5 at least) hold; long lines take fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = line_dedup.without_boilerplate(docs, "source", "text", max_ratio=0.05, min_pages=5, counts=("n_lines", "n_dropped"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


@query()
def op2_quality_model(spark, sf_dir):
    """A score of every document by a model of labels.quality that never saw the labels held out here."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model.learn(docs, table(spark, sf_dir, "labels"), "quality", max_rows=20_000)
    scores = quality_model.with_scores(docs, model)
    return scores.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""WITH d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS place FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, place, place + k - 1), ' ') AS win FROM i), sizes AS (SELECT DISTINCT k FROM win),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS place FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT doc_id, place, k, item_id FROM (SELECT doc_id, place, k, array_to_string(list_slice(w, place, place + k - 1), ' ') AS win FROM p) JOIN win USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + k)) AS word FROM hits) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""")
def op3_decontamination(spark, sf_dir):
    """Words of every document that stand in a 13-word window of a test item, and the items."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, coverage=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op4_secrets(spark, sf_dir):
    """Spans of secrets in every document, by the base patterns and by the character models."""
    docs = table(spark, sf_dir, "documents")
    ratios = secrets.log_ratios(secrets.labelled_samples(docs, max_samples=5_000))
    found = secrets.find_secrets(docs, ratios, min_ratio=12.0)
    base = secrets.spans_text(F.col("base"))
    return found.select("doc_id", *(secrets.count_of(F.col("base"), k).alias(f"n_{kind}") for k, (kind, _, _) in enumerate(secrets.BASE)),
                        F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(F.array_sort(F.concat("base", "model"))).alias("spans"))


@query()
def op5_simhash(spark, sf_dir):
    """Fingerprint of 3-word shingles and component at 2 or fewer differing bits of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, size=3)


@query()
def op6_token_files(spark, sf_dir):
    """Every document's ids, followed by id 1, from Arrow files of 2048-token sequences in ascending doc_id."""
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), WORDS, end_id=1)


@query()
def op7_licenses(spark, sf_dir):
    """License phrases and texts in every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"), threshold=0.9)
    base = F.transform("base", lambda b: b["label"])
    starts = F.transform("base", lambda b: b["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "labels")), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.col("containment")).alias("score"))


@query()
def op8_token_counts(spark, sf_dir):
    """Bytes and tokens of every document by way of a digest cache, which is empty when the query starts."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), WORDS, shared_folder(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query()
def op9_best_fit_packing(spark, sf_dir):
    """Every document's pieces of at most 2048 tokens, each in a slot of a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), BYTES, end_id=0)


@query()
def op10_quality_rules(spark, sf_dir):
    """Measures of every document, the base rule, and the verdict of thresholds per language and source."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))
