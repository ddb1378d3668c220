import hashlib
import json
import random

import pytest
import public_tokenizers
from cases import SF, no_rows, odd_rows, texts
from tokenizers import Tokenizer

from spanweave.llm import backtrack, catalog

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return backtrack.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def slow(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_query_matches_the_library(spark, library):
    got = sorted(map(tuple, catalog.QUERIES["op13_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(k, slow(library, t)) for k, t in sorted(texts(spark).items())]
    assert got == [(k, len(ids), digest(" ".join(map(str, ids))), digest(decoded)) for k, (ids, decoded) in want]


def test_unusual_texts(encoder, library):
    draw = random.Random(0)
    odd = [
        "İstanbul J̌ é́ <|endoftext|> <|EndOfText|> a<|startoftext|>b it's I'LL we're 's' don't!! ... a_b 12a3", "ÀÉÎ× ÷ ŉ ſ ΑΣ ΑΣ. 日本 ½  x",
        "x y\x1cz\x85w​ ﬁ \x00", "", " \t\n", "!" * 300 + "a" * 300, "<|endoftext|>" * 3, "a　b　", "́x é e ́",
        "".join(draw.choice("thein") for _ in range(20_000)), "".join(draw.choice("ab") for _ in range(5000)),
        " ".join("".join(draw.choice("abcinthest'!.e1é") for _ in range(draw.randint(1, 30))) for _ in range(2000)),
    ]
    for text, ids in zip(odd, encoder.encode([t.encode() for t in odd])):
        want, decoded = slow(library, text)
        assert ids.tolist() == want and encoder.decode(ids).decode() == decoded


def merged(merges, word):
    """The earliest merge first, leftmost first."""
    parts, rank = [*word[:-1], word[-1] + "</w>"], {tuple(m): i for i, m in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]


@pytest.mark.parametrize("seed", range(6))
def test_any_merge_list(tmp_path, seed):
    """Merge lists that make greedy cutting wrong, tokens that are never reached, equal letters in a row."""
    draw = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    vocab = [*letters, *(c + "</w>" for c in letters)]
    merges = []
    while len(merges) < 25:
        a, b = draw.choice([v for v in vocab if not v.endswith("</w>")]), draw.choice(vocab)
        if a + b not in vocab:
            merges.append([a, b])
            vocab.append(a + b)
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["added_tokens"], spec["model"]["merges"], spec["model"]["vocab"] = [], merges, {v: i for i, v in enumerate(vocab)}
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec), "utf-8")
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 24))) for _ in range(400)]
    got = backtrack.load(str(path)).tables.encode_words(words)
    assert [[vocab[i] for i in ids] for ids in got] == [merged(merges, w) for w in words]


def test_time_is_linear(encoder):
    """Each place of a word is given up once at most."""
    steps = []
    tables = encoder.tables
    for n in (2000, 8000):
        calls = 0
        real = tables.fits

        def counted(a, b, limit=backtrack.NEVER):
            nonlocal calls
            calls += 1
            return real(a, b, limit)

        tables.fit, tables.fits = {}, counted
        tables.encode_words(["abcdefgh" * (n // 8)])
        tables.fits = real
        steps.append(calls)
    assert steps[1] <= steps[0] + 8


def test_odd_rows(spark, encoder, library):
    rows = odd_rows(spark)
    got = backtrack.encode(rows, encoder, decoded_col="__decoded").collect()
    assert sorted(got[0].asDict()) == sorted([*rows.columns, "__ids", "__decoded"])
    want = sorted(((r["doc_id"], *slow(library, r["text"])) for r in rows.collect()), key=repr)
    assert sorted(((r["doc_id"], r["__ids"], r["__decoded"]) for r in got), key=repr) == want
    assert backtrack.encode(no_rows(spark), encoder).collect() == []
    back = backtrack.decode(backtrack.encode(rows, encoder, keep=["doc_id"]), encoder)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == [(k, d) for k, _, d in want]
    with pytest.raises(ValueError, match="other names"):
        backtrack.encode(rows, encoder, ids_col="score")
