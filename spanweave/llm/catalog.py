"""The registered queries of this subpackage and their SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import (
    backtrack, cover_tree, language, piece_lattice, pii, quality, simhash, suffixes, token_archive, url_filter, vantage, warc, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL_TEXT: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; ``sql`` where SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL_TEXT[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to, true AS verified
FROM p LEFT JOIN k ON p.d = k.d
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written to an archive and read back."""
    folder = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_facts(spark, folder).withColumnRenamed("id", "page_id")


#: fixed values: the rules of the contract
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query("""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM u),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM r),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
         FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN fits ON s.page_id = fits.page_id AND n = 1
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    index = url_filter.build_index(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    return url_filter.judge(table(spark, sf_dir, "pages"), index).withColumnRenamed("id", "page_id")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 10
""")
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return cover_tree.topk(rows, rows.where(F.col("vec_id") % 100 == 0))


@query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs), keep=["doc_id"])
    return found.select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.col("__lang.name").alias("lang_pred"),
        F.col("__lang.score").alias("score"), F.col("__lang.ambiguous").alias("ambiguous"),
    )


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to its text."""
    import public_tokenizers

    pieces = piece_lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = piece_lattice.encode(table(spark, sf_dir, "documents"), pieces, keep=["doc_id"], verify=True)
    return encoded.select(
        "doc_id", F.size("__ids").cast("bigint").alias("n_pieces"), F.col("__ids").alias("ids"), F.col("__whole").alias("round_trip")
    )


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: 3-word shingles, 2 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query()
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token archive of every document, read back."""
    import public_tokenizers

    folder = token_archive.write_archive(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_archive.read_documents(spark, folder).select(
        F.col("id").alias("doc_id"), "start", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS k, least(len(w), 13) AS n FROM bs),
sizes AS (SELECT DISTINCT n FROM win),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, i, ds.n FROM ds JOIN win ON ds.n = win.n AND array_to_string(w[i : i + ds.n - 1], ' ') = k),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in every document."""
    judged = suffixes.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col("__found.items")
    return judged.select(
        "doc_id", F.col("__found.n_words").alias("n_words"), F.col("__found.n_hit").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(F.transform(items, lambda x: x.cast("string")))), 256).alias("items_sha256"),
        F.col("__found.contaminated").alias("contaminated"),
    )


@query()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, their digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.train(docs)).select("doc_id", "__spans")
    base = F.filter("__spans", lambda c: c["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter(base, lambda c: c["kind"] == kind)).cast("bigint").alias(f"n_{pii.KINDS[kind]}")

    return found.select(
        "doc_id", *map(count, range(len(pii.KINDS))), F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("__spans")).alias("spans")
    )


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )


def _clusters_sql(rounds: int = 10) -> str:
    """The rounds written out: assignment and exact means, one pair of views for each."""
    steps = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM v QUALIFY c < 8)"]
    nearest = """SELECT vec_id, v, c AS cluster, d AS distance FROM (SELECT vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d
  FROM v CROSS JOIN {c}) QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) = 1"""
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN
  (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n
    FROM (SELECT cluster, v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) n ON n.cluster = c{r}.c)""")
    steps.append(f"a AS MATERIALIZED ({nearest.format(c=f'c{rounds}')})")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a JOIN c{rounds} ON c = cluster"""


@query(_clusters_sql())
def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds, and the inertias."""
    return vantage.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query()
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    import public_tokenizers

    encoder = backtrack.load(public_tokenizers.path("word_bpe_49k.json"))
    coded = backtrack.encode(table(spark, sf_dir, "documents"), encoder, keep=["doc_id"], ids_col="ids", decoded_col="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
