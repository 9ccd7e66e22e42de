"""Encoding and decoding equal the sentencepiece library, id for id."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from stockspark.llm import spm

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return spm.Codec(spm.load(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


CASES = ["", " ", "  ", "\n", " \n ", "a", "▁a", "a▁▁b", "<s></s><unk><0x0A>", "x\n y\n\n z  ", "é😀\x00",
         " " * 40 + "hello" + " " * 33, "a" * 5000, "ab" * 3000, "=" * 777, "aaa bbb " * 50, "\t\r\n\x0b",
         "日本語のテキスト", "Ünïcödé ßtraße", "thththththeheheheerererer" * 40, "1234567890" * 30]


def check(codec, lib, text):
    want = lib.encode(text)
    got = codec.encode(text)
    assert got == want, text[:80]
    assert codec.decode(got) == lib.decode(want)
    n, ids, decoded = codec.digest(text)
    assert n == len(want)
    assert ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert decoded == hashlib.sha256(lib.decode(want).encode()).hexdigest()


def test_fixed_cases(both):
    for text in CASES:
        check(*both, text)


def test_random_texts(both):
    rnd = random.Random(7)
    alphabets = ["ab ", "the rnoi", "  \n.,aeiou", "0123456789-+ ", "éèàüß ñ", "".join(map(chr, range(32, 400))),
                 "日本語😀 ab▁"]
    for _ in range(1500):
        a = rnd.choice(alphabets)
        check(*both, "".join(rnd.choice(a) for _ in range(rnd.randint(0, 60))))


def test_random_pieces(both):
    """Texts glued from vocabulary pieces, where merges compete most."""
    codec, lib = both
    pieces = [lib.id_to_piece(i) for i in range(259, 32000)]
    rnd = random.Random(11)
    for _ in range(1500):
        check(codec, lib, "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 8))))


def test_decode_of_any_ids(both):
    codec, lib = both
    rnd = random.Random(3)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(259, 32000), 0]) for _ in range(rnd.randint(0, 9))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_dataframe_cases(spark):
    rows = [(1, "Hello  world\n", "x"), (2, None, "y"), (3, "", None), (None, "tail", "z"), (1, "Hello  world\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = spm.encode(docs, MODEL)
    want = {(i, tuple(lib.encode(t or ""))) for i, t, _ in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.collect()} == want
    texts = {(r.doc_id, r.text) for r in spm.decode(encoded, MODEL).collect()}
    assert texts == {(i, t or "") for i, t, _ in rows}
    assert spm.encode_digests(docs, MODEL).count() == 5
    assert spm.encode_digests(docs.limit(0), MODEL).count() == 0
    assert spm.decode(encoded.limit(0), MODEL).count() == 0


def test_invalid_bytes_decode_one_by_one():
    from stockspark.llm.spm import _utf8
    assert _utf8(b"\xff" * 5000) == "\ufffd" * 5000
    for raw in (b"a\xe4\xb8b", b"\xf0\x9f\x98", "é€😀".encode() + b"\xc3", b"\xed\xa0\x80x"):
        out, at = "", 0
        while at < len(raw):
            for n in (4, 3, 2, 1):
                try:
                    piece = raw[at:at + n].decode()
                    if len(piece) == 1:
                        break
                except UnicodeDecodeError:
                    pass
            else:
                piece, n = "\ufffd", 1
            out, at = out + piece, at + n
        assert _utf8(raw) == out
