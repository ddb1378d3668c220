import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from cases import SF, no_rows, odd_rows
from test_jaccard import slow_classes
from test_suffixes import slow as contaminated

from spanweave.llm import pii, simhash


@pytest.fixture(scope="module")
def stages(spark):
    """Documents before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(spark, stages):
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [len(after.columns) for _, after in stages.values()] == [5, 5, 5, 5, 7]
    assert all(after.columns[:5] == names for _, after in stages.values())


def test_quality_keeps_good_documents(spark, stages):
    before, after = map(rows, stages["quality"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k in after for k, q in labels.items() if q == 1]
    bad = [k in after for k, q in labels.items() if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad) and all(before[k] == r for k, r in after.items())


def test_one_of_each_class_stays(stages):
    before, after = map(rows, stages["near_copies"])
    classes = slow_classes((k, r["text"]) for k, r in before.items())
    assert set(after) == {k for k, root in classes.items() if k == root} and all(before[k] == r for k, r in after.items())


def test_copies_that_only_fingerprints_link_go(spark):
    """Copies under four fifths of common 5-word shingles whose fingerprints differ in at most 2 bits, and chains over links of both kinds."""
    draw, rows_, gone, bits = random.Random(11), [(None, "loose"), (1, "alone"), (2, None)], set(), lambda t: simhash.fingerprint(t.encode())
    while len(gone) < 12:
        base = [f"w{draw.randrange(10**6)}" for _ in range(160)]
        for _ in range(60):
            now = list(base)
            for place in draw.sample(range(5, 150), 5):
                now[place] = f"w{draw.randrange(10**6)}"
            texts_ = [" ".join(base), " ".join(now), " ".join([*now, "end"])]
            if (bits(texts_[0]) ^ bits(texts_[1])).bit_count() <= 2:
                a, b, c = slow_classes(enumerate(texts_)).values()
                assert a != b == c  # the shingles link only the last two
                at = len(rows_) * 10
                rows_ += [(at + 2, texts_[0]), (at + 1, texts_[1]), (at, texts_[2])]
                gone |= {at + 2, at + 1}
                break
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string").repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([k for k, _ in rows_ if k not in gone], key=str)


def test_contaminated_documents_go(spark, stages):
    before, after = map(rows, stages["decontaminate"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = contaminated([(k, r["text"]) for k, r in before.items()], items)
    assert set(after) == {k for k, *_, bad in judged if not bad}


def test_personal_data_is_gone(stages):
    before, after = map(rows, stages["personal_data"])
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == before[k]["text"] or re.search(r"\[(%s)\]" % "|".join(pii.KINDS).upper(), r["text"])


def test_encoding_round_trips(stages):
    before, after = map(rows, stages["encode"])
    assert before.keys() == after.keys() and all(r["round_trip"] and r["ids"] for r in after.values() if r["text"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_may_have_any_name(spark, name):
    """Names that the operators give to columns of their own are left alone in the input."""
    names = ["__score", "__found", "__spans", "__keeper", "__ids", "__whole", "ids", "round_trip", "id", "key", "component", "a.b", "other3"]
    docs = odd_rows(spark).select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows_ = got.collect()
    assert rows_ and all(list(r)[2 : 2 + len(names)] == list(range(len(names))) for r in rows_)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd_rows(spark), SF)
    assert got.columns[:6] == odd_rows(spark).columns and got.count() <= 11
    assert stage(spark, no_rows(spark), SF).collect() == []
