import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    rows = [(k, text(60), "en", "s", 0, "extra") for k in range(30)]
    rows += [(100, rows[3][1], "en", "s", 0, "e"), (101, rows[4][1] + " more", "de", "s", 0, "e"), (102, text(20) + " " + item + " " + text(20), None, "s", 0, "e"), (103, text(30) + " mail a.b@mail.example.com " + text(10), "en", None, None, None), (104, "too short", "en", "s", 0, "e"), (105, None, "en", "s", None, None), (5, rows[5][1], "en", "s", 0, "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], f"file://{tmp_path}"))
    ids = [sorted(r["doc_id"] for r in x.select("doc_id").collect()) for x in kept]
    assert ids[1] == sorted([*range(30), 100, 101, 102, 103, 5])
    assert ids[2] == [*range(30), 102, 103] and ids[3] == ids[4] == [*range(30), 103]
    assert all(x.columns == docs.columns for x in kept[:-1])
    masked = {r["doc_id"]: r for r in kept[4].collect()}[103]
    assert "<EMAIL>" in masked["text"] and masked["n_chars"] == len(masked["text"])
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {r["doc_id"] for r in out.collect()} == {*range(30), 103}


def test_near_duplicates_go_by_text(spark, nothing):
    """One id with unlinked texts keeps them all, linked ones and copies keep one, on any partitioning."""
    long = lambda c, n=50: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, long("a"), "x"), (1, long("b"), "x"), (2, long("c"), "x"), (1, long("a") + " more", "y"), (1, long("a"), "w"), (1, long("a"), "x"), (None, long("d"), "x"), (None, long("d"), "x"), (None, long("e"), "x"), (3, long("c") + " end", "x"), (-5, long("f"), "x"), (4, "", "x"), (4, "", "x"), (5, None, "x"), (None, None, "x"), (6, long("g", 30_000), "x"), (7, long("g", 30_000) + " z", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"_id": F.lit(1), "_node": F.lit(2), "_kept": F.lit("clash")})
    outcomes = []
    for n in (1, 5):
        got = corpus_pipeline.near_duplicates(spark, frame.repartition(n), "")
        assert got.columns == frame.columns
        outcomes.append(sorted(map(repr, got.collect())))
    assert outcomes[0] == outcomes[1]
    kept = sorted(((r["doc_id"], (r["text"] or "")[:3], r["lang"]) for r in got.collect()), key=repr)
    assert [(d, t) for d, t, _ in kept] == sorted([(-5, "f0 "), (1, "a0 "), (1, "b0 "), (2, "c0 "), (4, ""), (4, ""), (5, ""), (6, "g0 "), (None, ""), (None, "d0 "), (None, "e0 ")], key=repr)
    assert corpus_pipeline.near_duplicates(spark, nothing, "").count() == 0


def test_every_stage_takes_awkward_rows(spark, nothing, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns and empty tables, stage by stage."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(n))
    item, long = text(30), text(40_000)
    rows = [(1, text(60), "en", "s", 0), (1, text(60), None, None, None), (None, text(60), "en", "s", 0), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n ", "en", "s", 3), (5, long, "de", "s", 0), (6, f"{text(20)} {item}", "en", "s", 0), (6, text(40) + " x.y@mail.example.com", "en", "s", 0)]
    rows += [rows[0], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("kept", "row", "base", "item_id", "piece", "_text", "changed")})
    spark.createDataFrame([(0, item), (1, None), (None, text(12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, sf = dict(corpus_pipeline.STAGES), f"file://{tmp_path}"
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    of = lambda *ks: sorted(((rows[k][0], rows[k][1]) for k in ks), key=repr)
    assert texts(stages["quality_rules"](spark, docs, sf)) == of(0, 1, 2, 6, 7, 8, 9)
    assert texts(stages["near_duplicates"](spark, docs, sf)) == of(0, 1, 2, 3, 4, 5, 6, 7, 8, 10)
    assert texts(stages["decontamination"](spark, docs, sf)) == of(0, 1, 2, 3, 4, 5, 6, 8, 9, 10)
    masked = stages["personal_data"](spark, docs, sf)
    assert masked.columns == docs.columns and texts(masked) == sorted([*of(0, 1, 2, 3, 4, 5, 6, 7, 9, 10), (6, rows[8][1].replace("x.y@mail.example.com", "<EMAIL>"))], key=repr)
    packed = stages["packing"](spark, docs, sf).collect()
    assert sorted((r["doc_id"] or -1) for r in packed if r["piece"] == 0) == sorted((r[0] or -1) for r in rows)
    assert sum(r["length"] == 1 for r in packed) >= 4 and max(r["piece"] for r in packed if r["doc_id"] == 5) > 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0, name
