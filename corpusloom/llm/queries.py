"""Named queries of the training-data operators with their SQL counterpart."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import (
    decontaminate, exact_dedup, license_scan, line_crf, masked_lm, nearest_toxic, packing, periodic_runs, prefix_trie, sharding,
    simhash, substring_dedup, warc,
)
from corpusloom.llm.base import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def word_vocabulary() -> str:
    """Place of the given vocabulary file of word pieces."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op7_bloom_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf, "documents"))


SQL["op7_bloom_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""


@query
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


SQL["op10_decontaminate"] = r"""
WITH words AS (
    SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
          FROM items WHERE len(w) > 0)),
grams AS (
    SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT id, i, n, item_id FROM grams JOIN windows USING (n, gram)),
cover AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY id),
found AS (SELECT id, count(DISTINCT item_id) AS n_items,
                 sha256(coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '')) AS s
          FROM hits GROUP BY id)
SELECT words.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN cover ON cover.id = words.id LEFT JOIN found ON found.id = words.id"""


@query
def op4_sampled_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents"))


@query
def op1_warc_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"), new_folder(spark))


SQL["op1_warc_ranges"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
             CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d"""


@query
def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf, "documents"), word_vocabulary()))


@query
def op2_license_templates(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(table(spark, sf, "documents"))


@query
def op3_simhash_pigeonhole(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op9_doubling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).drop("longest")


SQL["op9_doubling_windows"] = r"""
WITH d AS (SELECT doc_id, string_split_regex(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                             '[\x20\x09-\x0D]+') AS w0 FROM documents),
w AS (SELECT doc_id, CASE WHEN len(w0) = 1 AND w0[1] = '' THEN []::VARCHAR[] ELSE w0 END AS w FROM d),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS gram
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
starts AS (SELECT gram, min(doc_id) AS first FROM grams GROUP BY gram),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM grams JOIN starts USING (gram) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t
         FROM words LEFT JOIN gone USING (doc_id, k) WHERE gone.k IS NULL GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


@query
def op5_line_crf(spark: SparkSession, sf: str) -> DataFrame:
    return line_crf.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_masked_lm(spark: SparkSession, sf: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf, "conversations"), prefix_trie.by_checksum)


# The CRC-32 of a decimal number, bit by bit.
SQL["op11_prefix_trie"] = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS i, sha, size FROM (
               SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
                      left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS sha
               FROM conversations WHERE conv_id IS NOT NULL)),
c0 AS (SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, byte: list_reduce(
               [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda a, b: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h
       FROM t GROUP BY conv_id),
c AS (SELECT a.conv_id, a.h, a.conv_id - a.conv_id % 5 AS base, least(a.h, coalesce(b.n, 0)) AS m
      FROM c0 a LEFT JOIN c0 b ON b.conv_id = a.conv_id - a.conv_id % 5),
r AS (SELECT c.conv_id, t.i AS j, sha, size FROM c JOIN t ON t.conv_id = base WHERE t.i <= h
      UNION ALL SELECT c.conv_id, m + t.i - h, sha, size FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.i > h),
p AS (SELECT conv_id, 0 AS d, '' AS k, 0 AS size FROM c
      UNION ALL SELECT conv_id, j, string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY j), size FROM r),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
n AS (SELECT p.d, k, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
             sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE p.d = l.d), '')) AS ends_sha256
      FROM p JOIN l USING (conv_id) GROUP BY p.d, k),
kids AS (SELECT d - 1 AS d, left(k, 32 * (d - 1)) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
up AS (SELECT unnest(range(0, n.d + 1)) AS d, n.k, n_convs, size, kids.n IS NULL AS leaf FROM n LEFT JOIN kids USING (d, k)),
sums AS (SELECT d, left(k, 32 * d) AS k, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
         FROM up GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM n JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN n above ON above.d = n.d - 1 AND above.k = left(n.k, 32 * (n.d - 1))"""


@query
def op12_nearest_toxic(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_toxic.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op13_factor_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.planted(table(spark, sf, "documents")))
