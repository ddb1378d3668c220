"""Transcript and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as se
from . import fixtures as fx
from .registry import query


@query(
    "se_exact",
    fx.with_sql("dialogues")
    + """SELECT concat('c', CAST(video_id AS VARCHAR), ':', CAST(CAST(start_sec AS BIGINT) AS VARCHAR)) AS row_id, start_sec, end_sec, source
FROM dialogues WHERE end_sec > 10 AND start_sec < 60 AND contains(lower(text), lower('The th'))""",
)
def _(spark, sf):
    rows = fx.dialogues(spark, sf).withColumn(
        "row_id", F.concat(F.lit("c"), "video_id", F.lit(":"), F.col("start_sec").cast("bigint"))
    )
    return se.exact_matches(rows, "The th", 10.0, 60.0).select("row_id", "start_sec", "end_sec", "source")


@query(
    "se_vector",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum([v.e[i] * q.e[i] for i in range(1, 65)]) / (sqrt(list_sum([x * x for x in v.e])) * sqrt(list_sum([x * x for x in q.e]))) AS similarity
  FROM v, v q WHERE q.vec_id % 100 = 7 AND v.vec_id + 10 > 50)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank BETWEEN 11 AND 60""",
)
def _(spark, sf):
    """The second page of 50 of several queries, after the first 10, in a time range."""
    vectors = fx.table(spark, sf, "embeddings")
    rows = vectors.selectExpr("vec_id AS row_no", "embedding", "CAST(vec_id AS DOUBLE) AS start_sec", "CAST(vec_id + 10 AS DOUBLE) AS end_sec")
    asked = vectors.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    ranked = se.vector_topk(se.in_time(rows, 50.0, None), asked, 60).filter("rank > 10")
    return ranked.select("query_id", "rank", F.col("row_no").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(
    "se_materials",
    fx.with_sql("seg", "dialogues")
    + """SELECT video_id, concat('visual_', CAST(seg_no AS VARCHAR), '_', CAST(i AS VARCHAR)) AS row_id, 'visual' AS channel, round(start_sec + i * (end_sec - start_sec) / n, 6) AS start_sec,
  round(start_sec + (i + 1) * (end_sec - start_sec) / n, 6) AS end_sec, NULL AS text
FROM (SELECT *, CAST(ceil((end_sec - start_sec) / 8) AS BIGINT) AS n, unnest(range(0, CAST(ceil((end_sec - start_sec) / 8) AS BIGINT))) AS i FROM seg)
UNION ALL SELECT video_id, concat('dialogue_', CAST(CAST(start_sec / 8 AS BIGINT) AS VARCHAR)), 'transcript', start_sec, end_sec, text FROM dialogues""",
)
def _(spark, sf):
    scenes = fx.seg(spark, sf).withColumnRenamed("seg_no", "scene_no")
    transcript = fx.dialogues(spark, sf).withColumn("row_no", (F.col("start_sec") / 8).cast("bigint"))
    out = se.materials(scenes, transcript, 8.0)
    return out.withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec")})


@query(
    "se_rerank_join",
    """WITH p AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200),
s AS (SELECT doc_id, quality + toxic * 0.5 AS r FROM labels UNION ALL SELECT doc_id, quality * 2.0 FROM labels WHERE doc_id % 7 = 0)
SELECT p.doc_id, n_chars, coalesce(c, 0) AS score_count, CAST(r AS DOUBLE) AS relevance FROM p LEFT JOIN (SELECT doc_id, count(*) AS c, max(r) AS r FROM s GROUP BY doc_id) x ON x.doc_id = p.doc_id""",
)
def _(spark, sf):
    shown = se.page(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 0, 200)
    labels = fx.table(spark, sf, "labels")
    scores = labels.selectExpr("doc_id", "CAST(quality + toxic * 0.5D AS DOUBLE) AS relevance").unionByName(
        labels.filter("doc_id % 7 = 0").selectExpr("doc_id", "CAST(quality * 2 AS DOUBLE) AS relevance")
    )
    scores = scores.join(shown.select("doc_id"), "doc_id", "left_semi")
    return se.rerank(shown, scores, ["doc_id"])


@query(
    "se_read_coverage",
    fx.with_sql(
        "timeline", "f AS (SELECT job, k AS row_id, min(pos) AS pos FROM timeline GROUP BY job, k)",
        "n AS (SELECT job, pos, count(*) AS new_rows FROM f GROUP BY job, pos)",
        "m AS (SELECT job, kind, sum(new_rows) AS new_rows FROM n JOIN timeline USING (job, pos) GROUP BY job, kind)",
    )
    + """SELECT c.job, c.kind AS query, c.rows_read, c.total, c.rows_read = c.total AS complete, CAST(coalesce(m.new_rows, 0) AS BIGINT) AS new_rows FROM
  (SELECT job, kind, count(DISTINCT k) AS rows_read, 12 + job % 3 AS total FROM timeline GROUP BY job, kind) c LEFT JOIN m ON m.job = c.job AND m.kind = c.kind""",
)
def _(spark, sf):
    reads = fx.timeline(spark, sf).select(
        "job", F.col("kind").alias("query"), F.col("k").alias("row_id"), "pos", (F.col("job") % 3 + 12).alias("total")
    )
    fresh = se.new_rows(reads).join(reads.select("job", "pos", "query"), ["job", "pos"]).groupBy("job", "query").agg(
        F.sum("new_rows").alias("new_rows")
    )
    return se.read_coverage(reads).join(fresh, ["job", "query"], "left").na.fill(0, ["new_rows"])
