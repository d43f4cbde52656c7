"""SentencePiece encoding against the library: random and odd texts, long words, the table's turnover, rows of a frame."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from calibra.llm import pieces
from calibra.llm.queries import QUERIES, piece_model

PARTS = ["a", "b", "ab", "e", "er", "th", "the", " ", "  ", "\n", "▁", "é", "È", "ȿ", "ɏ", "漢", "字", "🎉", "0", "12", "\t",
         "'", "̀", "ing", "\x00", "A", "<s>", "</s>", "<0x41>", "    ", ".”", "²", "़", "क"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def same(model, library, texts):
    for t, ids in zip(texts, model.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(t), repr(t[:200])


def test_random_texts(library):
    rng, m = random.Random(3), pieces.PieceModel(piece_model())
    same(m, library, ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(4000)])
    same(m, library, ["".join(rng.choice("abcdefghij"[:rng.randint(1, 10)]) for _ in range(rng.randint(1, 90)))
                      for _ in range(4000)])


def test_runs_and_empty_texts(library):
    m = pieces.PieceModel(piece_model())
    same(m, library, ["", " ", ""] + [c * n for c in (" ", "a", "\n", "=", "-", "é", "漢", "▁", "0") for n in range(1, 70)])
    assert [len(i) for i in m.encode([b"", b""])] == [0, 0]


@pytest.mark.parametrize("long", [pieces.LONG, 8])
def test_long_words(library, monkeypatch, long):
    """Both ways of merging: rounds alone, and the heap for words above the bound."""
    monkeypatch.setattr(pieces, "LONG", long)
    rng, m = random.Random(5), pieces.PieceModel(piece_model())
    same(m, library, ["".join(rng.choice("abcdefgh") for _ in range(9000)), "ab" * 5000 + "漢" * 3000, " " * 9000, "x" * 9001,
                      "the" * 2000, "y" * 63, "y" * 64, "y" * 65])


@pytest.mark.parametrize("level", [0, 1, 2])
def test_every_split_gives_the_same_ids(library, level):
    m = pieces.PieceModel(piece_model())
    m.level = level
    if level:
        m.kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xC9), *range(0x30, 0x3A)]] = 3
    rng = random.Random(7)
    same(m, library, ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(800)])


def test_word_table_turns_over(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 64)
    rng, m = random.Random(9), pieces.PieceModel(piece_model())
    for _ in range(60):
        same(m, library, [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 4))) for _ in range(30))])
    assert m.words.n <= 64 + 31 * 2


def test_equal_first_hashes(library):
    m = pieces.PieceModel(piece_model())
    m.words.of_byte[0] = m.words.of_byte[0][0]  # the first hash sees only lengths
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 4))) for _ in range(30)) for _ in range(20)]
    same(m, library, texts)
    same(m, library, texts)


def test_documents(spark, frame, library):
    texts = ["Hello  world", None, "", "a\nb", "Hello  world", "x" * 300_000, "word " * 50_000]
    rows = {r.doc_id: r for r in pieces.encode_documents(frame(texts, clash=["ids", "decoded", "text_"]), piece_model()).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert list(rows[i].ids) == library.encode(t or "")
        assert rows[i].decoded == library.decode(library.encode(t or ""))
    assert pieces.encode_documents(frame([]), piece_model()).count() == 0


def test_repeated_and_null_ids(spark, library):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "c"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in pieces.encode_documents(df, piece_model()).collect())
    ab, c = library.encode("ab"), library.encode("c")
    assert got == sorted([(False, 1, ab), (False, 1, ab), (True, 0, c), (True, 0, [])])


def test_query_on_given_table(spark, library):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = QUERIES["op13_pieces"](spark, path).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_words_of_both_generations_keep_their_ids(library):
    table = pieces.WordTable()
    one, two = np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint64)
    table.add(one, two, np.arange(5), np.ones(5, np.int64), np.arange(5, dtype=np.int32))
    slots = table.find(one, two)
    assert (table.ids[table.begin[slots]] == np.arange(5)).all()
    assert (table.find(one, two + np.uint64(1)) == -1).all()
