"""The operators as queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_public
from .decontaminate import overlaps
from .exact_dedup import exact_dedup
from .language_id import language_id
from .line_dedup import line_dedup, whole_lines
from .near_dedup import near_duplicates
from .pii import find_pii
from .sharding import sampled_shards
from .url_filter import url_filter
from .warc import read_archives, write_archives

#: Fixed values of the contract.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_shards(_table(spark, sf_dir, "documents"), shards=8)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_public(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op5_whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rule; op5_line_dedup keeps to its SQL, which has no fingerprints of single lines."""
    out = whole_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(_table(spark, sf_dir, "pages"), min_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_sharding, op4_bpe, op5_line_dedup, op5_whole_lines, op6_near_dedup, op7_url_filter, op8_pii, op9_warc, op10_decontaminate, pipeline)}

_RULE_SQL = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for h, p, v in URL_RULES)

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_sharding": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k, strlen(coalesce(text, '')) + 1 AS size FROM documents),
        b AS (SELECT t, regexp_extract_all(hex(encode(t)), '..') AS bytes FROM (SELECT DISTINCT t FROM d)),
        crc AS (SELECT t, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(bytes, lambda h: ('0x' || h)::BIGINT),
                    lambda c, y: list_reduce([xor(c, y)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS z FROM b),
        o AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS own, sum(size) OVER (PARTITION BY k) AS grp, sum(size) OVER () AS total FROM d),
        e AS (SELECT *, CASE WHEN grp * 512 <= total THEN max(own) OVER (PARTITION BY k) ELSE own END AS fin FROM o),
        s AS (SELECT *, least(7, ((fin - 1) * 8) // total)::INT AS shard, row_number() OVER (ORDER BY k, doc_id) - 1 AS idx FROM e)
        SELECT doc_id, size, z AS text_crc32, 'bytes' AS law, shard, idx - min(idx) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s JOIN crc USING (t)""",
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, u.i - 1 AS pos, ('0x' || md5(l[u.i])[1:15])::BIGINT AS h FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
        grams AS (SELECT doc_id, pos, h, lag(h) OVER w AS l1, lead(h, 1) OVER w AS h2, lead(h, 2) OVER w AS r1 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        fps AS (SELECT *, ('0x' || md5(h || ',' || h2)[1:15])::BIGINT AS fp FROM grams WHERE h2 IS NOT NULL),
        picked AS (SELECT *, lag(fp) OVER w AS before, lead(fp) OVER w AS after FROM fps WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        picks AS (SELECT * FROM picked WHERE fp < after OR fp <= before OR before IS NULL AND after IS NULL),
        firsts AS (SELECT fp, doc_id AS fd, pos AS fpos, l1 AS fl, r1 AS fr FROM picks QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id, pos) = 1),
        met AS (SELECT doc_id, pos - coalesce((l1 = fl)::INT, 0) AS lo, pos + 1 + coalesce((r1 = fr)::INT, 0) AS hi FROM picks JOIN firsts USING (fp) WHERE (doc_id, pos) <> (fd, fpos)),
        cut AS (SELECT DISTINCT doc_id, x AS pos FROM met, unnest(range(lo, hi + 1)) AS u(x)),
        parts AS (SELECT doc_id, u.i - 1 AS pos, l[u.i] AS line FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM parts ANTI JOIN cut USING (doc_id, pos) GROUP BY doc_id)
        SELECT d.doc_id, len(d.l) AS n_lines, len(d.l) - coalesce(kept.n, 0) AS n_removed, md5(coalesce(kept.t, '')) AS text_md5
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_url_filter": f"""
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        r AS ({_RULE_SQL}),
        m AS (SELECT page_id, rh || rp AS rule, rv FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
              QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, rh || rp) = 1)
        SELECT p.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '0' AS x FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, max(page_id) OVER (PARTITION BY x) AS keep, x FROM p)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, i * 5 // 4 + 1, 2))::INT >> (3 - i * 5 % 4) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM q""",
}
