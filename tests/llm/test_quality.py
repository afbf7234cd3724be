import random

from barloom.llm.quality import keep_quality, quality_scores


def _corpus(docs, spark, n=400):
    r = random.Random(1)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 120))]
        good = i % 3 > 0
        texts.append(" ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words))
        labels.append((i, int(good)))
    return docs(texts), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(docs, spark):
    df, labels = _corpus(docs, spark)
    rows = quality_scores(df, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert 60 < len(held) < 140 and len(rows) == 400
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.97
    kept = keep_quality(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= 0.7}
    assert sorted(map(str, rows)) == sorted(map(str, quality_scores(df.repartition(5), labels).collect()))


def test_held_out_labels_teach_nothing(docs, spark):
    import zlib

    df, labels = _corpus(docs, spark)
    flip = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.quality) for r in labels.collect()]
    a = sorted(map(str, quality_scores(df, labels).collect()))
    assert a == sorted(map(str, quality_scores(df, spark.createDataFrame(flip, labels.schema)).collect()))


def test_odd(odd, docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_scores(odd, none).collect()
    assert len(rows) == 9 and all(r.score == (0.0 if r.doc_id in (1, 2) else 0.5) for r in rows)
    _, labels = _corpus(docs, spark)
    assert keep_quality(odd, labels).columns == odd.columns
    assert quality_scores(docs([]), labels).collect() == []
    mixed = spark.createDataFrame([(5, 0), (5, 1), (4, None), (None, 1), (6, 7)], "doc_id long, quality int")
    assert len(quality_scores(odd, mixed).collect()) == 9
