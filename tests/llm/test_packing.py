import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import packing


def naive_bins(lengths, most):
    left = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i in range(len(left)) if left[i] >= x]
        if fit:
            left[min(fit, key=lambda i: left[i])] -= x
        else:
            left.append(most - x)
    return len(left)


def check_places(rows, most):
    by = {}
    for seq, offset, length in rows:
        by.setdefault(seq, []).append((offset, length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= most
    return len(by)


def places(lengths, most):
    """(bin, offset, length) of every length."""
    counts = Counter(lengths)
    runs = packing.best_fit(counts, most)
    out = []
    for n, count in counts.items():
        own = [x for x in runs if x[0] == n]
        for r in range(count):
            _, rank, first, each, offset = max((x for x in own if x[1] <= r), key=lambda x: x[1])
            bin_, nth = divmod(r - rank, each)
            out.append((first + bin_, offset + nth * n, n))
    return out


def test_best_fit_equals_the_plain_search():
    rng = random.Random(7)
    for most in (1, 7, 20, 1024):
        for _ in range(60):
            lengths = [rng.randint(1, most) for _ in range(rng.randint(0, 80))]
            assert check_places(places(lengths, most), most) == naive_bins(lengths, most)


def test_best_fit_of_many_alike():
    counts = {1024: 10**12, 700: 10**12, 300: 3 * 10**11, 24: 10**12, 1: 5 * 10**13}
    runs = packing.best_fit(counts, 1024)
    assert len(runs) < 100
    assert packing.best_fit({}, 1024) == []


def test_pieces_cover_a_document():
    for n in (1, 5, 1023, 1024, 1025, 2048, 5000):
        parts = packing.cut(n, 1024)
        assert sum(length for _, length in parts) == n
        assert all(length == 1024 for _, length in parts[1:]) and parts[0][1] <= 1024
        assert [s for s, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]


def test_odd_rows_and_exact_ids(spark):
    files = packing.files()
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(files["path"])
    long = "Grüße, wörld! 12 " * 600
    texts = [None, "", "a", long, long, "one <|endoftext|> two", "  \n\n x\t", "日本語 🎉", "a" * 3000]
    df = spark.createDataFrame([(i if i != 2 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack(df, **files).collect()
    assert check_places([(r.sequence_id, r.offset, r.length) for r in got], 1024) == len({r.sequence_id for r in got})
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in got if r.doc_id == (i if i != 2 else None)), key=lambda r: r.piece)
        assert [r.start for r in own] == [s for s, _ in packing.cut(len(ids), 1024)]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(df.where("doc_id = -1"), **files).count() == 0
    assert {tuple(r)[:5] for r in packing.pack(df, files["path"]).collect()} == {tuple(r)[:5] for r in got}


def test_whole_tables_pack_as_the_plain_search(spark):
    from graphloom.llm.common import load

    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = packing.pack(docs.repartition(7), **packing.files()).collect()
    assert check_places([(r.sequence_id, r.offset, r.length) for r in got], 1024) == naive_bins([r.length for r in got], 1024)


def test_the_faster_library_gives_the_same_ids():
    files = packing.files()
    encoder, tok = packing.Encoder(**files), pytest.importorskip("tokenizers").Tokenizer.from_file(files["path"])
    rng = random.Random(3)
    for _ in range(3000):
        kinds = [lambda: rng.randint(32, 126), lambda: rng.choice([9, 10, 13, 32, 160, 0x2003]), lambda: rng.randint(0x80, 0xD7FF), lambda: rng.randint(0xE000, 0x10FFFF)]
        text = "".join(chr(rng.choice(kinds)()) for _ in range(rng.randint(0, 60)))
        assert encoder.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_workers_let_go_of_the_vocabulary(spark):
    files = packing.files()
    df = spark.createDataFrame([(i, "some text") for i in range(80)], "doc_id long, text string").repartition(8)
    assert packing.pieces(df, 1024, 2, **files).count() == 80

    def run(batches):
        import gc

        import pyarrow as pa

        n = sum(type(x).__name__ == "Encoder" and type(x).__module__.startswith("graphloom.") for x in gc.get_objects())
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    assert sum(r.n for r in spark.range(0, 8, 1, 8).mapInArrow(run, "n long").collect()) == 0
