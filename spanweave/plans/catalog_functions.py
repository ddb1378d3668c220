"""Scalar functions exercised over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import labels as lb
from ..functions import parsing as ps
from ..functions import scalars as sc
from . import fixtures as fx
from .catalog_intervals import BAD_START, keyed, pairs, psql
from .registry import query


def answers(spark, sf):
    """One model answer per lineitem: valid, no JSON, boolean, NaN, reversed, no list, two spans."""
    df = pairs(spark, sf)
    span = F.format_string('{"start_sec": %.1f, "end_sec": %.1f}', "start_sec", "end_sec")
    text = (
        F.when(F.col("line") == 1, F.concat(F.lit('{"segments": ['), span, F.lit("]}")))
        .when(F.col("line") == 2, F.lit("no answer"))
        .when(F.col("line") == 3, F.lit('{"segments": [{"start_sec": true, "end_sec": 9}]}'))
        .when(F.col("line") == 4, F.lit('{"segments": [{"start_sec": 1, "end_sec": NaN}]}'))
        .when(F.col("line") == 5, F.lit('{"segments": [{"start_sec": 9, "end_sec": 3}]}'))
        .when(F.col("line") == 6, F.lit('{"segments": {"start_sec": 1, "end_sec": 2}}'))
        .otherwise(F.concat(F.lit('{"segments": ['), span, F.lit(', '), span, F.lit("]}")))
    )
    return df.withColumn("text", text)


@query(
    "fn_parse_prediction",
    psql(
        """line BETWEEN 2 AND 6 AS parse_error, CAST(CASE line WHEN 1 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS BIGINT) AS n,
  CASE WHEN line IN (1, 7) THEN end_sec END AS last_end"""
    ),
)
def _(spark, sf):
    df = ps.parse_strict(answers(spark, sf))
    return keyed(
        df, parse_error=F.col("parse_error"), n=F.size("segments").cast("bigint"),
        last_end=F.array_max(F.transform("segments", lambda x: x["end_sec"])),
    )


@query(
    "fn_parse_lenient",
    psql(
        """line NOT IN (2, 6) AS format_valid, CAST(CASE line WHEN 2 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS BIGINT) AS predicted_count,
  CAST(CASE WHEN line IN (3, 4, 5) THEN 1 WHEN line = 1 AND end_sec > 50 THEN 1 WHEN line = 7 AND end_sec > 50 THEN 2 ELSE 0 END AS BIGINT) AS invalid_segments"""
    ),
)
def _(spark, sf):
    df = answers(spark, sf).withColumns({"d": F.lit(50.0), "cs": F.lit(0.0), "ce": F.lit(50.0)})
    df = ps.parse_lenient(df, "d", "cs", "ce")
    return df.select("video_id", "seg_no", "format_valid", "predicted_count", "invalid_segments")


@query("fn_finite", psql("line > 2 AS finite"))
def _(spark, sf):
    return keyed(pairs(spark, sf), finite=iv.is_finite(F.expr(BAD_START)))


@query("fn_round6", psql("round(start_sec / 7, 6) AS value"))
def _(spark, sf):
    return keyed(pairs(spark, sf), value=F.round(F.col("start_sec") / 7, 6))


@query("fn_round3", psql("round(start_sec / 7, 3) AS value"))
def _(spark, sf):
    return keyed(pairs(spark, sf), value=F.round(F.col("start_sec") / 7, 3))


@query("fn_norm_ws", "SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS text FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", sc.strip_space("text").alias("text"))


@query("fn_casefold_contains", "SELECT doc_id, contains(lower(text), lower('The ')) AS hit FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", sc.folded_contains("text", F.lit("The ")).alias("hit"))


@query("fn_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "fn_hash_bucket",
    "SELECT c_custkey, CAST(concat('0x', substr(sha256(c_name), 1, 8)) AS BIGINT) % 10 AS bucket FROM customer",
)
def _(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", lb.group_bucket("c_name").alias("bucket"))


NORM_SQL = "sqrt(list_sum([x * x for x in v]))"
VECS = "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(
    "fn_l2_normalize",
    f"""WITH {VECS} SELECT vec_id, round({NORM_SQL}, 6) AS norm, round(v[1] / {NORM_SQL}, 6) AS first,
  round(v[64] / {NORM_SQL}, 6) AS last, round(list_sum(v) / {NORM_SQL}, 6) AS total FROM vecs""",
)
def _(spark, sf):
    unit = sc.l2_normalize("embedding")
    total = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x)
    return fx.table(spark, sf, "embeddings").select(
        "vec_id", F.round(sc.l2_norm("embedding"), 6).alias("norm"), F.round(F.element_at(unit, 1), 6).alias("first"),
        F.round(F.element_at(unit, 64), 6).alias("last"), F.round(total, 6).alias("total"),
    )


@query(
    "fn_dot",
    f"WITH {VECS} SELECT vec_id, round(list_sum([v[i] * v[65 - i] for i in range(1, 65)]), 6) AS value FROM vecs",
)
def _(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        "vec_id", F.round(sc.dot("embedding", F.reverse("embedding")), 6).alias("value")
    )


@query("fn_array_hull", psql("least(start_sec, t_start) AS hull_start, greatest(end_sec, t_end) AS hull_end"))
def _(spark, sf):
    spans = F.array(
        F.struct("start_sec", "end_sec"), F.struct(F.col("t_start").alias("start_sec"), F.col("t_end").alias("end_sec"))
    )
    lo, hi = iv.hull(spans)
    return keyed(pairs(spark, sf), hull_start=lo, hull_end=hi)


@query(
    "fn_array_distinct_join",
    """SELECT l_orderkey, string_agg(concat(l_returnflag, l_linestatus), ' / ' ORDER BY first_line, concat(l_returnflag, l_linestatus)) AS joined
FROM (SELECT l_orderkey, l_returnflag, l_linestatus, min(l_linenumber) AS first_line FROM
  (SELECT l_orderkey, min(l_linenumber * 1000 + l_quantity) AS l_linenumber, l_returnflag, l_linestatus FROM
   (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem)
   GROUP BY l_orderkey, l_returnflag, l_linestatus) GROUP BY l_orderkey, l_returnflag, l_linestatus) GROUP BY l_orderkey""",
)
def _(spark, sf):
    # texts of one order by their first place, then by themselves, reduced to it before they are listed
    place = F.col("l_linenumber") * 1000 + F.col("l_quantity")
    first = fx.table(spark, sf, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("t")).agg(F.min(place).alias("p"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("p", "t"))), lambda x: x["t"])
    return first.groupBy("l_orderkey").agg(sc.distinct_join(texts, " / ").alias("joined"))


@query("fn_truncate", "SELECT doc_id, left(trim(text, ' '), 120) AS title FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", sc.truncate("text", 120).alias("title"))
