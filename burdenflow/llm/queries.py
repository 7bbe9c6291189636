"""The queries of the operators in this package, with the parameters they have in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenflow.llm import audits, licenses, main_text, mixing, near_copies, packing, quality, ranked, search, spots, token_planes, toxicity, web_archives
from burdenflow.llm.store import new_folder
from burdenflow.llm.tokens import default_vocabulary

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as byte planes and read back."""
    folder = new_folder(spark, "token-planes")
    token_planes.write_tokens(table(spark, sf_dir, "documents"), folder, default_vocabulary(), end=2)
    return token_planes.token_digests(spark, folder)


@query
def op2_probminhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies that each document belongs to."""
    return near_copies.class_members(table(spark, sf_dir, "documents"))


@query
def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return spots.fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix with the given weights takes."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document after deobfuscation."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows by integer inner product for every 50th vector."""
    return search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


ORACLE["op6_exact_top_k"] = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""


@query
def op8_recurrent_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.main_text(table(spark, sf_dir, "pages"))


@query
def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), default_vocabulary(), end=1)


@query
def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from preferences between labelled ones."""
    return quality.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_persistent_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the audit of its cheapest repair."""
    return audits.repair_audits(table(spark, sf_dir, "conversations"))


@query
def op12_zip_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record of every page, written into ZIP packages and read back by ranges."""
    folder = new_folder(spark, "web-archives")
    web_archives.write_packages(table(spark, sf_dir, "pages"), folder, zip64=True)
    found = web_archives.read_records(spark, folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op12_zip_packaged_warc"] = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), groups AS (
    SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS parts, min(page_id) OVER (PARTITION BY html) AS first
    FROM payloads
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM groups
"""


@query
def op13_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", k=20)


ORACLE["op13_range_maximum_search"] = r"""
WITH split AS (
    SELECT row_number() OVER () AS doc, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), held AS (
    SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM split WHERE len(terms) > 0
), totals AS (
    SELECT count(DISTINCT doc) AS n_all, count(*) AS l_all FROM held
), postings AS (
    SELECT doc, doc_id, n, term, count(*) AS tf FROM held GROUP BY doc, doc_id, n, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_all
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
), repeated AS (
    SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY item_id, term
), scored AS (
    SELECT item_id, doc, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_all) // l_all))))) AS BIGINT) AS score
    FROM repeated JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""
