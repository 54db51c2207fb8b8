import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

EN = "the cat sat on that mat and then ran home with her old friend from town".split()
DE = "der hund und die katze sind mit dem ball im haus das ist nicht für alle".split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng, d = random.Random(6), str(tmp_path_factory.mktemp("sf"))
    docs, labels = [], []
    for i in range(160):
        lang, words = ("en", EN) if i % 2 else ("de", DE)
        docs.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 90))), lang))
        labels.append((i, int(i % 3 > 0), 0))
    labels = [(i, 1, t) for i, q, t in labels if q]
    copy, near = docs[7][1], docs[8][1].split()
    docs += [(300, copy, "en"), (301, copy + "\n", "en"), (302, " ".join(near), "de"), (303, "%%% @@@ qqx### " * 30, "en"), (304, "12 34", "en"), (305, None, "en"), (306, "", "de"), (7, copy, "en"), (None, " ".join(rng.choice(EN) for _ in range(60)), None)]
    rows = [(i, t, lang, "src0" if (i or 0) % 3 else "src1", len(t or ""), "extra") for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_and_run(spark, data, tmp_path):
    d, rows = data
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert docs.columns == COLUMNS
        kept.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.select("doc_id").collect()))
    everyone = sorted(r[0] if r[0] is not None else -1 for r in rows)
    assert kept[0] == [i for i in everyone if i not in (304, 305, 306)]
    assert [i for i in kept[0] if i not in kept[1]] == [303]
    gone = [i for i in kept[1] if i not in kept[2]]
    assert {300, 301, 302} <= set(gone) and kept[2].count(7) == 1 and -1 in kept[2] and not set(gone) & (set(range(160)) - {7, 8})
    assert set(kept[3]) == set(kept[2])
    whole = sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, d).collect())
    assert whole == sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in docs.collect())
