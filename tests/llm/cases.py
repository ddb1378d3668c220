"""Rows that every operator on texts must stand: nulls, empty and long texts, repeats, clashing columns."""

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, None, "x"), (2, "", "x"), (3, "   \n\t", None), (4, "one two three four five six", "x"), (5, "one two three four five six", "x"),
    (5, "one two three four five six", "x"), (6, "ONE two\tthree four five six", "y"), (None, "loose words without an id", "z"),
    (7, "word " * 30_000 + "end", "x"), (8, "é" * 5000, "x"), (9, "...!!! ###", "x"),
]


def odd_rows(spark):
    """Columns named as the operators name their own."""
    return spark.createDataFrame(
        [(i, t, s, 1, s, 2.0) for i, t, s in ROWS],
        "doc_id bigint, text string, source string, id int, component string, score double",
    )


def no_rows(spark):
    return odd_rows(spark).where("1 = 0")


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
