import zlib

import numpy as np
import public_tokenizers
from cases import SF, no_rows, odd_rows, texts
from tokenizers import Tokenizer

from spanweave.llm import catalog, token_archive

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow(rows):
    """rows: (id, text) in order."""
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_matches_the_library(spark):
    got = sorted(map(tuple, catalog.QUERIES["op8_token_ids"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == slow(sorted(texts(spark).items()))


def test_levels():
    draw = np.random.default_rng(0)
    for top in (200, 40_000, 1 << 31):
        ids = draw.integers(0, top, 3000).astype(np.uint32)
        levels = token_archive.pack(ids)
        assert (token_archive.unpack(levels) == ids).all()
        assert [token_archive.token_at(levels, i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    assert token_archive.unpack(token_archive.pack(np.empty(0, np.uint32))).tolist() == []


def test_unusual_texts():
    odd = [
        "İstanbul J̌ é́ <|endoftext|> <|EndOfText|> a<|startoftext|>b it's I'LL we're 's' don't!! ... a_b 12a3", "ÀÉÎ× ÷ ŉ ſ ΑΣ ΑΣ. 日本 ½  x",
        "x y\x1cz\x85w​ ﬁ \x00", "", " \t\n", "!" * 300 + "a" * 300,
    ]
    encoder, tokenizer = token_archive.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    for text, ids in zip(odd, encoder.encode([t.encode() for t in odd])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_table_keeps_what_is_in_use(monkeypatch):
    encoder, tokenizer = token_archive.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    encoder.open()
    encoder.known.half = encoder.words.half = 40
    for i in range(60):
        lines = [" ".join(["often used", *(f"word{i * 10 + k}x!" for k in range(9))]), "in don't 12a3 " * 3]
        for text, ids in zip(lines, encoder.encode([t.encode() for t in lines])):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known.now) <= 40


def test_one_id_or_row_fills_several_parts(spark):
    rows = [(None, f"text number {i}") for i in range(300)] + [(5, "the same text")] * 300 + [(i, f"t{i}") for i in range(100, 400)]
    folder = token_archive.write_archive(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), PATH, parts=6)
    segments = spark.read.parquet(folder).select("part", "ids").collect()
    assert max(len(s["ids"]) for s in segments) < 350
    got = sorted(map(tuple, token_archive.read_documents(spark, folder).collect()), key=lambda r: r[1])
    tie = {t: k for k, t in enumerate(r["t"] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").distinct().selectExpr("t", "xxhash64(t) AS h").orderBy("h").collect())}
    assert got == slow(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]])))


def test_odd_rows(spark, monkeypatch):
    folder = token_archive.write_archive(odd_rows(spark), PATH, parts=3)
    got = sorted(map(tuple, token_archive.read_documents(spark, folder).collect()), key=lambda r: r[1])
    order = sorted(((r["doc_id"], r["text"]) for r in odd_rows(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == slow(order)
    empty = token_archive.write_archive(no_rows(spark), PATH)
    assert token_archive.read_documents(spark, empty).collect() == []
