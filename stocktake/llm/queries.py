"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stocktake.llm import ann, divergence, exact_dedup, jaccard_join, lloyd, mixing, packing, pipeline as stages, resampling, secrets, token_files, toxicity, url_filter, warc
from stocktake.llm.shared import table
from stocktake.llm.tokens import tokenizer_path


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; owner: source, repository: source and language."""
    scanned = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda rank: F.size(F.filter("_base", lambda s: s["rank"] == rank)).cast("bigint")
    return scanned.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                          F.sha2(secrets.spans_text(F.col("_base")), 256).alias("base_sha256"), secrets.spans_text(F.col("_spans")).alias("spans"), "n_live", "n_copied", "most_owners", "most_repos")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id shards of every document, read back."""
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), spaced=True, end_id=0))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the whole size takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, by a model of its labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC packages and back."""
    return warc.read_packages(warc.write_packages(table(spark, sf_dir, "pages"))).drop("url")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return divergence.judge(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the distribution of the benchmark texts."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors."""
    return lloyd.lloyd(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts among all documents, and which of them stays."""
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation of ``documents``."""
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_ids, op3_ann, op4_jaccard_join, op5_mixing, op6_url_filter, op7_packing, op8_toxicity, op9_warc, op10_quality, op11_resampling, op12_lloyd, op13_exact_dedup, pipeline)}

def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """The clustering rounds, one after the other."""
    assign = lambda c: f"""SELECT vec_id, v.q AS q, min({{'d': CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c.c}}) AS n
        FROM v, {c} c GROUP BY vec_id, v.q"""  # noqa: E731
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k}))"""]
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({assign(f'c{i}')}),
        x{i} AS (SELECT n.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}),
        m{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x{i} GROUP BY c, i),
        c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(f.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM m{i} GROUP BY c) f ON f.c = c.c)""")
    return f"""WITH {", ".join(steps)}, last AS (SELECT vec_id, n.c AS cluster, n.d AS distance FROM ({assign(f'c{rounds}')}))
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM last JOIN c{rounds} c ON c.c = last.cluster"""


ORACLE_SQL = {
    "op12_lloyd": _lloyd_sql(),
    "op13_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
}
