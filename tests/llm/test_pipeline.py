"""The pipeline against its stages by brute force, on a small fixture."""

import random

import corpus_pipeline


def _texts():
    r = random.Random(1)
    lang = {"en": ["the", "thing", "and", "with", "over", "house"], "de": ["der", "und", "über", "schule", "nicht", "straße"]}
    make = lambda k, n: " ".join(r.choice(lang[k]) + str(r.randrange(50)) for _ in range(n))
    rows = [(i, make("en" if i % 2 else "de", 60), "en" if i % 2 else "de", f"s{i % 3}") for i in range(120)]
    item = make("en", 30)
    rows += [(200, rows[0][1], "de", "s0"), (201, rows[1][1] + " end", "en", "s1"), (202, item, "en", "s1"), (203, "12345 !!", "en", "s2"), (204, None, "en", "s2")]
    return rows, item


def test_stages_take_effect(spark, tmp_path):
    rows, item = _texts()
    df = spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == 4 or out.columns == df.columns
        out.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        ids.append(sorted(r.doc_id for r in docs.collect()))
    every = sorted(i for i, *_ in rows)
    assert ids[0] == [i for i in every if i not in (203, 204)]
    assert ids[1] == [i for i in ids[0] if i not in (200, 201)]
    assert ids[2] == [i for i in ids[1] if i != 202]
    assert set(ids[3]) <= set(ids[2]) and len(set(ids[3])) > 100
    assert ids[4] == ids[3]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids[4]


def test_stages_with_odd_and_with_no_rows(spark, tmp_path):
    rows, item = _texts()
    odd = [*rows, (None, None, None, None), (None, "ein Satz ohne Nummer über die Schule", None, None), (None, "ein Satz ohne Nummer über die Schule", None, None), (300, "", "de", "s0"),
           (301, "wort " * 100_000, "de", "s1"), rows[5], rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in odd], schema).selectExpr("*", "1 as id", "2 as d", "3 as h", "4 as src", "5 as k", "'x' as __guess_", "6 as shard")
    spark.createDataFrame([(1, item), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for n, table in enumerate((df, df.limit(0))):
        docs = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert i == 4 or out.columns == df.columns
            out.write.parquet(str(tmp_path / f"{n}-{i}"))
            docs = spark.read.schema(out.schema).parquet(str(tmp_path / f"{n}-{i}"))
            ids = [r.doc_id for r in docs.collect()]
            if n:
                assert ids == []
            elif i == 1:
                assert ids.count(None) == ids.count(5) == ids.count(301) == 1
