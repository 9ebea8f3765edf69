"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import bpe, conversation, elkan, imatch, langid, license, media, mixing, quality, sentencepiece, simhash, substring, urlfilter
from braidwork.shared import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 4 = 2 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = langid.identify(docs.select("doc_id", "text"), docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    found = sentencepiece.encode_and_read(docs, keep=["doc_id", "sha"], form="packed")
    read = F.sha2(F.col("text").cast("binary"), 256)
    return found.select("row.doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), read.alias("decoded_sha256"), (read == F.col("row.sha")).alias("round_trip"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once repeated 35-word windows are cut out."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows with crc32(doc_id) mod 3 = 1 teach nothing."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = quality.score(docs, quality.learnable(labels))
    held_out = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 3 == 1
    return found.select("row.doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's copies stand in the mixture of sources."""
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id", "source"])
    return found.select("row.*", "tokens", "exponent", "weight", "epoch", "block", "start_token")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures of every document."""
    return license.scan(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of every document stored as media."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation, after faults are planted in it."""
    rows = table(spark, sf_dir, "conversations")
    turns, summary = conversation.repair(conversation.damage(rows))
    every = rows.select("conv_id").distinct()
    named = lambda df, c: df.withColumnRenamed("conv", c)
    found = every.join(named(summary, "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    found = found.join(named(conversation.digests(turns), "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    found = bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"], form="packed")
    return found.select("row.doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds, with the exact inertia."""
    found, centroids = elkan.cluster(table(spark, sf_dir, "embeddings"))
    return elkan.with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op8_sql() -> str:
    labels = "|".join(urlfilter.AD_LABELS)
    domains = "|".join(d.replace(".", "[.]") for d in urlfilter.AD_DOMAINS)
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                         WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM s)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN path LIKE '/%' AND regexp_matches('.' || host, '[.]({labels})[.]({domains})$') THEN 'block' ELSE 'allow' END AS verdict
    FROM r"""


def op13_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain k-means: every distance of every round."""
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM (
            SELECT x.vec_id, x.v, y.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i]))) AS BIGINT) AS d FROM kept x, c{r} y) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (SELECT m.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY m.c, i)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f, v) AS v FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS f FROM s{r} GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(q.v, ',')) AS centroid_sha256
    FROM (SELECT vec_id, m, m.c AS c FROM a{rounds}) JOIN c{rounds} q USING (c)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_simhash": op2_simhash,
    "op3_imatch": op3_imatch,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substring": op5_substring,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_urlfilter": op8_urlfilter,
    "op9_license": op9_license,
    "op10_media": op10_media,
    "op11_repair": op11_repair,
    "op12_bpe": op12_bpe,
    "op13_elkan": op13_elkan,
}
ORACLES: dict[str, str] = {"op8_urlfilter": op8_sql(), "op13_elkan": op13_sql()}
