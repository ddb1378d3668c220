import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import SF, no_rows, odd_rows

from spanweave.llm import catalog, piece_lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a  b   c\t\td\n\n e", "日本語 テキスト Ａﬁ ½ é é", "x" * 3000, " " * 100 + "q", "\x00\x01", "🙂🙂 <s> </s> <unk> <0x0A>",
    "a" * 50 + " " * 33 + "\n", "();\r\n{\r\n", "tail ", "▁a▁▁b", "aaaa bbbb " * 2000,
]


@pytest.fixture(scope="module")
def pieces():
    return piece_lattice.load_pieces(PATH)


def test_ids_are_the_library_s(spark, pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, ids in zip(ODD + docs, piece_lattice.Encoder(pieces).encode(ODD + docs)):
        assert ids.tolist() == model.encode(text), text[:60]
        assert piece_lattice.decode_ids(ids, pieces) == text.replace("▁", " ")


def test_query(spark):
    rows = catalog.QUERIES["op5_sentencepiece"](spark, SF).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r["round_trip"] and r["ids"] == model.encode(docs[r["doc_id"]]) and r["n_pieces"] == len(r["ids"]) for r in rows)


def test_odd_rows(spark, pieces):
    encoded = piece_lattice.encode(odd_rows(spark), pieces)
    decoded = piece_lattice.decode(encoded, pieces)
    assert decoded.columns == [*odd_rows(spark).columns, "__ids", "__text"] and decoded.count() == 11
    assert all(r["__text"] == (r["text"] or "") for r in decoded.collect())
    checked = piece_lattice.encode(odd_rows(spark), pieces, keep=["doc_id"], verify=True)
    assert checked.columns == ["doc_id", "__ids", "__whole"] and [r["__whole"] for r in checked.collect()] == [True] * 11
    assert piece_lattice.decode(piece_lattice.encode(no_rows(spark), pieces), pieces).collect() == []


def test_cache_is_emptied(pieces, monkeypatch):
    monkeypatch.setattr(piece_lattice, "KNOWN_WORDS", 5)
    encoder = piece_lattice.Encoder(pieces)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("one two three four five six seven", "one two", "eight nine ten"):
        assert encoder.encode([text, text])[1].tolist() == model.encode(text)


def test_unknown_characters_without_byte_pieces():
    own = piece_lattice.make_pieces([("▁a", 1, -1.0), ("a", 2, -2.0), ("▁", 3, -3.0)], np.full(256, -1), 0, [b"", b" a", b"a", b" "])
    assert piece_lattice.Encoder(own).encode(["aéa"])[0].tolist() == [1, 0, 2]


def test_viterbi_fold(spark):
    table = [("a", 1, -2.0), ("b", 2, -2.0), ("ab", 3, -3.5), ("ba", 4, -2.5), ("aba", 5, -4.0), ("bab", 6, -6.5), ("c", 7, -9.0)]
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)] + ["abx", "", "c"]

    def slow(word):
        best = {0: (0.0, ())}
        for end in range(1, len(word) + 1):
            options = [(best[end - len(p)][0] + s, len(p), (*best[end - len(p)][1], i)) for p, i, s in table if word[:end].endswith(p) and end - len(p) in best]
            if options:
                top = max(options)
                best[end] = (top[0], top[2])
        return best.get(len(word))

    got = piece_lattice.viterbi_words(
        spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(table, "piece string, id int, score double"), 3
    ).collect()
    assert {r["word"] for r in got} == {w for w in words if w}
    for r in got:
        want = slow(r["word"])
        assert (r["score"] is None) == (want is None)
        if want:
            assert abs(r["score"] - want[0]) < 1e-9 and "".join({i: p for p, i, _ in table}[i] for i in r["ids"]) == r["word"]
