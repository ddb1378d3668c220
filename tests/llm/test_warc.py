import hashlib

from pyspark.sql import functions as F

from spanweave.llm import warc

BIG = "<p>" + "x" * 2000


def pages(spark):
    rows = [
        (1, "http://a", BIG), (2, "http://b", BIG), (2, "http://b", BIG), (3, None, "small"), (4, "http://d\r\nX: y", "small"), (5, "http://e", None),
        (6, "http://f", ""), (None, "http://g", BIG), (7, "http://h", "é" * 500), (8, "http://i", "é" * 500), (9, "http://j", "é" * 499),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")


def test_archive(spark):
    folder = warc.write_archive(pages(spark))
    got = sorted((tuple(r) for r in warc.read_facts(spark, folder).select("id", "payload_bytes", "record_type", "refers_to", "verified").collect()), key=repr)
    assert got == sorted([
        (1, 2003, "revisit", 2, True), (2, 2003, "response", None, True), (2, 2003, "response", None, True), (3, 5, "response", None, True),
        (4, 5, "response", None, True), (5, 0, "response", None, True), (6, 0, "response", None, True), (None, 2003, "revisit", 2, True),
        (7, 1000, "revisit", 8, True), (8, 1000, "response", None, True), (9, 998, "response", None, True),
    ], key=repr)
    assert warc.read_payloads(spark, folder).count() == 5  # each distinct payload once


def test_records_are_whole(spark):
    folder = warc.write_archive(pages(spark))
    for r in warc.read_records(spark, folder).where("id is not null").collect():
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = body[: int(fields[b"Content-Length"])]
        assert body[len(block) :] == b"\r\n\r\n" and fields[b"WARC-Type"].decode() == r["record_type"]
        payload = block.split(b"\r\n\r\n", 1)[1]
        assert payload == (bytes(r["payload"]) if r["record_type"] == "response" else b"")
        assert fields[b"WARC-Payload-Digest"].decode() == "sha1:" + hashlib.sha1(bytes(r["payload"])).hexdigest()
        assert r["target"] == {3: None, 4: "http://d%0D%0AX: y"}.get(r["id"], r["target"])


def test_broken_payloads_are_not_used(spark, tmp_path):
    folder = warc.write_archive(pages(spark), str(tmp_path / "a"))
    bad = warc.read_payloads(spark, folder).select("address", F.encode(F.lit("other"), "UTF-8").alias("payload"))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    assert warc.read_payloads(spark, str(tmp_path / "b")).where("intact").count() == 0


def test_damaged_records_stay(spark, tmp_path):
    """One payload is changed where it is stored and one is gone: their records are told, not dropped."""
    folder = warc.write_archive(pages(spark), str(tmp_path / "a"))
    stored = spark.read.parquet(f"{folder}/payloads")
    kept = stored.where(F.octet_length("payload") != 5)
    other = F.when(F.octet_length("payload") == 2003, F.encode(F.lit("changed"), "UTF-8")).otherwise(F.col("payload"))
    kept.withColumn("payload", other).write.parquet(str(tmp_path / "b/payloads"))
    warc.read_headers(spark, folder).select("address", "header").write.parquet(str(tmp_path / "b/headers"))
    facts = warc.read_facts(spark, str(tmp_path / "b")).collect()
    assert len(facts) == 11
    for r in facts:
        assert r["verified"] == (r["id"] in (5, 6, 7, 8, 9)), r
        assert r["payload_bytes"] == {3: None, 4: None, 5: 0, 6: 0, 7: 1000, 8: 1000, 9: 998}.get(r["id"], 7)
    records = warc.read_records(spark, str(tmp_path / "b")).collect()
    assert len(records) == 11 and {r["id"] for r in records if r["record"] is None} == {1, 2, 3, 4, None}


def test_very_long_payloads_and_a_payload_of_a_third_of_all_rows(spark):
    long = "0123456789é" * 400_000
    rows = [(i, "http://x", long if i < 2 else BIG if i % 3 == 0 else f"page {i}") for i in range(300)]
    folder = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4))
    got = {r["id"]: r for r in warc.read_facts(spark, folder).collect()}
    assert len(got) == 300 and all(r["verified"] for r in got.values())
    assert (got[0]["payload_bytes"], got[0]["record_type"], got[0]["refers_to"]) == (len(long.encode()), "revisit", 1)
    assert {got[i]["refers_to"] for i in range(3, 297, 3)} == {297} and warc.read_payloads(spark, folder).where("not intact").count() == 0


def test_empty(spark):
    folder = warc.write_archive(pages(spark).where("1 = 0"))
    assert warc.read_facts(spark, folder).collect() == []
