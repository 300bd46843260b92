"""The training-data operators as queries over the input tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtflow.llm import bpe, classifier, decontamination, html_text, jaccard, licenses, media, pii, sharding, warc
from adtflow.llm.shared import table

#: The quality from which a document counts as good.
QUALITY_THRESHOLD = 0.3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels"), "quality"))
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_html_extraction,
        op3_quality_classifier,
        op4_bpe_codec,
        op5_license_scan,
        op6_media_columns,
        op7_ngram_jaccard,
        op8_pii,
        op9_warc,
        op10_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {
    # the CRC is that of IEEE 802.3: its table from the polynomial, then a step for each byte
    "op1_sharding": """
WITH t AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
s AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 16), lambda i: ('0x' || substr(hex(b), (2 * i + 1)::BIGINT, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM s, t),
p AS (SELECT doc_id, size, text_crc32, sum(size) OVER (ORDER BY doc_id, text_crc32) AS e, sum(size) OVER () AS total FROM c),
q AS (SELECT *, ((2 * e - size) * 40 // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM q
""",
    # the WAV form in hexadecimal: a header with two lengths in little-endian bytes, then the padded text
    "op6_media_columns": """
WITH t AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
s AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
p AS (SELECT doc_id, n_bytes, CASE WHEN n_bytes = 0 THEN 64 ELSE (n_bytes + 63) // 64 * 64 END AS n, b FROM s),
h AS (SELECT doc_id, n_bytes, n, hex(b) || repeat('00', (n - n_bytes)::BIGINT) AS h, printf('%08X', n) AS a, printf('%08X', n + 36) AS r FROM p),
m AS (SELECT *, '52494646' || r[7:8] || r[5:6] || r[3:4] || r[1:2] || '57415645666D742010000000' || '01000100401F0000401F000001000800' || '64617461' || a[7:8] || a[5:6] || a[3:4] || a[1:2] || h AS w FROM h)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 64), lambda i: ('0x' || substr(h, 2 * n - 127 + 2 * i, 2))::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS tail_crc32,
  n + 44 AS media_bytes, sha256(unhex(w)) AS media_sha256, 'type=audio/wav;corrected=1;body=44;embedded=0' AS feature FROM m, t
""",
    "op7_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * o >= 85 * (n + m - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON s.doc_id = c.x
""",
    "op9_warc": """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> m THEN m END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
""",
    # the definition without seeds: every diagonal with three words in a row in common
    "op10_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
bg AS (SELECT item_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
c AS (SELECT doc_id, item_id, dg.i - bg.i AS k FROM dg JOIN bg USING (g) GROUP BY ALL),
m AS (SELECT c.doc_id, c.item_id, len(b.w) AS n, list_transform(range(1, len(b.w) + 1), lambda j: CASE WHEN k + j >= 1 AND d.w[k + j] = b.w[j] THEN 1 ELSE 0 END) AS m
  FROM c JOIN d USING (doc_id) JOIN b USING (item_id)),
x AS (SELECT doc_id, item_id, n, list_sum(m) AS matched, list_max(list_transform(range(1, n - least(n, 13) + 2), lambda s: list_sum(m[s:s + least(n, 13) - 1]))) / least(n, 13) AS similarity FROM m)
SELECT doc_id, item_id, n::INTEGER AS n_words, max(matched)::INTEGER AS matched, max(similarity) AS similarity FROM x WHERE similarity >= 0.8 GROUP BY doc_id, item_id, n
""",
}
