"""Transcript and vector search with time filters and paging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot, folded_contains, l2_normalize, usable_vector
from .tiles import equal_parts

MAX_BROADCAST_QUERIES = 4096
QUERIES_AT_ONCE = 256


def in_time(df: DataFrame, start: float, end: float | None) -> DataFrame:
    kept = df.filter(F.col("end_sec") > start)
    return kept if end is None else kept.filter(F.col("start_sec") < end)


def page(rows: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    """One page of a total order: a bounded top-k per task, merged; never a full sort."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_info(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """(total, next_offset) of the paged rows; the next offset is null on the last page."""
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total")).withColumn(
        "next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("bigint"))
    )


def exact_matches(rows: DataFrame, query: str, start: float = 0.0, end: float | None = None) -> DataFrame:
    """Transcript rows overlapping the time range that contain the query (empty: all rows)."""
    kept = in_time(rows, start, end)
    return kept.filter(folded_contains("text", F.lit(query))) if query else kept


def vector_ranking(materials: DataFrame, query: Sequence[float], start: float = 0.0, end: float | None = None, digits: int | None = None) -> DataFrame:
    """Cosine similarity of one query vector with every usable row in the time range."""
    norm = float(np.sqrt(np.dot(np.asarray(query, dtype=float), np.asarray(query, dtype=float))))
    if not query or not np.isfinite(norm) or norm <= 0:
        raise ValueError("the query vector is empty, not finite or zero")
    unit = F.array(*[F.lit(float(x) / norm) for x in query])
    similarity = dot(l2_normalize("embedding"), unit)
    rows = in_time(materials, start, end).filter(usable_vector("embedding"))
    return rows.withColumn("similarity", F.round(similarity, digits) if digits is not None else similarity)


def vector_topk(materials: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k rows (row_no, embedding) for each of many query vectors (query_id, unique, and embedding).

    A block of at most ``MAX_BROADCAST_QUERIES`` queries travels to the tasks as one matrix; each task
    multiplies it with its Arrow batches and keeps k rows per query, so tasks emit k rows per query
    instead of every pair. Every block is one pass over the materials. Zero and non-finite vectors match nothing.
    """
    spark = materials.sparkSession
    asked = queries.filter(usable_vector("embedding")).select("query_id", "embedding")
    blocks = max(1, -(-asked.count() // MAX_BROADCAST_QUERIES))
    out = None
    for at in range(blocks):
        # blocks by hash of the id: no order over all queries, and no query in two blocks
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at).orderBy("query_id").collect()
        matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
        if rows:
            matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        part = _block_topk(materials, spark.sparkContext.broadcast(([r["query_id"] for r in rows], matrix)), k)
        out = part if out is None else out.unionByName(part)
    return out


def _block_topk(materials: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        sims, rows = [np.empty(0)] * len(ids), [np.empty(0, np.int64)] * len(ids)
        worst = np.full(len(ids), -np.inf)
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            vectors = np.stack([np.asarray(v, dtype=np.float64) for v in batch["embedding"]])
            norms = np.linalg.norm(vectors, axis=1)
            good = np.isfinite(norms) & (norms > 0)
            vectors, numbers = vectors[good] / norms[good, None], batch["row_no"].to_numpy()[good]
            for at in range(0, len(ids), QUERIES_AT_ONCE):
                for q, row in enumerate(matrix[at : at + QUERIES_AT_ONCE] @ vectors.T, at):
                    places = np.flatnonzero(row >= worst[q])
                    if len(places) > k:
                        least = np.partition(row[places], len(places) - k)[len(places) - k]
                        places = places[row[places] >= least]
                    sim, number = np.concatenate([sims[q], row[places]]), np.concatenate([rows[q], numbers[places]])
                    order = np.lexsort((number, -sim))[:k]
                    sims[q], rows[q] = sim[order], number[order]
                    if len(order) == k:
                        worst[q] = sims[q][-1]
        yield pd.DataFrame(
            {
                "query_id": np.repeat(np.asarray(ids, np.int64), [len(x) for x in sims]),
                "row_no": np.concatenate([*rows, np.empty(0, np.int64)]), "similarity": np.concatenate([*sims, np.empty(0)]),
            }
        )

    local = materials.select("row_no", "embedding").mapInPandas(run, "query_id long, row_no long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "row_no")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def materials(scenes: DataFrame, transcript: DataFrame, segment_sec: float) -> DataFrame:
    """Search corpus: equal visual parts of the scenes and the transcript rows, with channel and id.

    ``scenes``: video_id, scene_no, start_sec, end_sec. ``transcript``: video_id, row_no, start_sec,
    end_sec, text. Ids are built from the row's own keys, so no global numbering is needed."""
    visual = equal_parts(scenes, segment_sec).select(
        "video_id",
        F.concat_ws("_", F.lit("visual"), F.col("scene_no"), F.col("part_no")).alias("row_id"),
        F.lit("visual").alias("channel"),
        F.col("part_start").alias("start_sec"),
        F.col("part_end").alias("end_sec"),
        F.lit(None).cast("string").alias("text"),
    )
    spoken = transcript.select(
        "video_id",
        F.concat_ws("_", F.lit("dialogue"), F.col("row_no")).alias("row_id"),
        F.lit("transcript").alias("channel"),
        "start_sec", "end_sec", "text",
    )
    return visual.unionByName(spoken)


def rerank(page_rows: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Supplied relevance per page row; ``score_count`` other than 1 marks a broken page."""
    per = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("score_count"), F.max("relevance").alias("relevance"))
    return page_rows.join(per, list(keys), "full").withColumn("score_count", F.coalesce("score_count", F.lit(0)))


def read_coverage(reads: DataFrame, keys: Sequence[str] = ("job", "query")) -> DataFrame:
    """Per query: distinct rows returned so far and whether all were. ``reads``: keys, row_id, total."""
    keys = list(keys)
    rows = reads.groupBy(*keys, "row_id").agg(F.max(F.struct("pos", "total")).alias("_t"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_read"), F.max("_t").alias("_t")
    ).select(*keys, "rows_read", F.col("_t.total").alias("total"), (F.col("rows_read") == F.col("_t.total")).alias("complete"))


def new_rows(reads: DataFrame, scope: Sequence[str] = ("job",)) -> DataFrame:
    """Rows each read call returned for the first time in its job (first position wins)."""
    first = reads.groupBy(*scope, "row_id").agg(F.min("pos").alias("pos"))
    return first.groupBy(*scope, "pos").agg(F.count(F.lit(1)).alias("new_rows"))
