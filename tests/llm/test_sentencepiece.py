import random
import zlib

import numpy as np
import pytest

from graphloom.llm.sentencepiece import Codec, decode, encode

spm = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b\n c ", "a▁b", "   ", "\t\tx", "ゼ梦 ゼ", "<s> </s> <0x0A>", "a" * 40, "Hello   world!!!!", "\x00x", "🎉🎉", "é́", " " * 37 + "x", "ab" * 3000]


def test_equals_the_library():
    rng, lib, codec = random.Random(1), spm.SentencePieceProcessor(model_file=PATH), Codec(PATH)
    texts = ODD + ["".join(rng.choice("ab the  ng\n.,é1ß") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(text), repr(text)[:60]
        assert codec.decode(ids.tolist()) == lib.decode(ids.tolist())


def test_words_without_a_compatible_piece_are_merged_by_definition(monkeypatch):
    lib, codec = spm.SentencePieceProcessor(model_file=PATH), Codec(PATH)
    monkeypatch.setattr(codec, "compatible", lambda pair: False)
    texts = [t for t in ODD if len(t) < 100] + ["hello hellish help", "été 梦x"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(text), repr(text)


def unigram(scores):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.pieces.add(piece="<unk>", score=0.0, type=2)
    for p, s in scores.items():
        m.pieces.add(piece=p, score=s, type=1)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    return m


def brute_best(text, scores, low):
    best = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        best[end] = max(((best[s][0] + (scores[text[s:end]] if text[s:end] in scores else low), [*best[s][1], text[s:end]]) for s in range(end) if text[s:end] in scores or end - s == 1), key=lambda x: x[0])
    return best[len(text)]


def test_unigram_models_get_the_best_path():
    rng = random.Random(2)
    scores = {"▁": -4.0, "▁a": -2.5, "▁ab": -3.1, "a": -3.0, "b": -3.3, "ab": -2.9, "ba": -3.05, "abb": -4.4, "bab": -4.1}
    codec = Codec(model=unigram(scores))
    lib = spm.SentencePieceProcessor(model_proto=unigram(scores).SerializeToString())
    names = ["<unk>", *scores]
    for _ in range(300):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 14)))
        ids = codec.encode([text])[0].tolist()
        total = sum(scores[names[i]] for i in ids)
        assert abs(total - brute_best("▁" + text.replace(" ", "▁"), scores, codec.lowest)[0]) < 1e-6
        assert abs(total - sum(scores[names[i]] for i in lib.encode(text))) < 1e-6


def test_rows(spark):
    lib = spm.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None])] + [(None, "twice", "y"), (None, "twice", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df.select("doc_id", "text"), PATH, ["doc_id"]).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), lib.encode(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) for r in got)
    back = decode(encode(df.select("doc_id", "text"), PATH, ["doc_id", "text"]), PATH, ["doc_id", "text"]).collect()
    assert all(r.decoded == lib.decode(lib.encode(r.text or "")) for r in back)  # a mark in a text comes back as a space
    none = spark.createDataFrame([(1, None), (2, [None, 5]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode(none, PATH, ["doc_id"]).collect()}[1] == ""
    assert encode(df.where("doc_id = -1"), PATH, ["doc_id"]).count() == 0
