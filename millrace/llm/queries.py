"""The thin ``opN_<name>`` queries with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.divergence import oracle as divergence_sql
from millrace.llm.filter_audit import oracle as audit_sql
from millrace.llm.mixing import oracle as mixing_sql
from millrace.llm.shared import table


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import warc_archive

    archive = warc_archive.write(table(spark, sf_dir, "pages"), min_bytes=0)
    told = warc_archive.describe(warc_archive.read(archive))
    return told.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_id").cast("long").alias("refers_to"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.url_filter import Rule, filter_urls

    rules = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality_crf import judge, train, training_sample

    docs = table(spark, sf_dir, "documents")
    model = train(training_sample(docs, table(spark, sf_dir, "labels")))
    return judge(docs.select("doc_id", "text"), model).select("doc_id", "_quality.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_lines.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.secrets import scan

    n = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2("_base", 256).alias("base_sha256"), F.col("_all").alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pii import find

    n = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return find(table(spark, sf_dir, "documents")).select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2("_base", 256).alias("base_sha256"), F.col("_all").alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.filter_audit import audit, failures

    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least=10, top=10)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import remainder, score, train, training_sample

    docs, fold = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"))
    net = train(training_sample(docs, table(spark, sf_dir, "labels").where(fold != 1)))
    return score(docs.select("doc_id", "text"), net).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "_toxicity.*")


QUERIES = {f.__name__: f for f in (op1_warc_archive, op2_simhash, op3_url_filter, op4_quality_crf, op5_decontaminate, op6_line_dedup, op7_mixing, op8_token_counts, op9_secrets, op10_pii, op11_filter_audit, op12_divergence, op13_toxicity)}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_archive": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, sha256(body) AS k FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY k) AS first FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM f""",
    "op6_line_dedup": """
        WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
        c AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
        w AS (SELECT a.doc_id, a.ord, a.line AS x, b.line AS y, d.line AS z FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1 JOIN c d ON a.doc_id = d.doc_id AND d.ord = a.ord + 2),
        r AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, ord) AS n FROM w),
        gone AS (SELECT DISTINCT r.doc_id, c.pos FROM r JOIN c ON r.doc_id = c.doc_id AND c.ord BETWEEN r.ord AND r.ord + 2 WHERE n > 1),
        k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
            FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
        SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, text FROM k""",
    "op7_mixing": mixing_sql(),
    "op11_filter_audit": audit_sql(),
    "op12_divergence": divergence_sql(),
}
