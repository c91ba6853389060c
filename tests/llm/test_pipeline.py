import pytest

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, make_docs, words, tmp_path):
    good = [(i, words(120, i) + ".", "en", f"s{i % 2}", 1) for i in range(60)]
    copy = [(100, good[0][1] + " more.", "en", "s0", 1)]
    junk = [(101, " ".join(w + "###$$" for w in words(80, 1).split()), "en", "s0", 1), (102, "too short", "en", "s0", 1), (103, None, None, None, None)]
    private = [(104, words(60, 500) + " mail to jo.x@mail1.example.com now. " + words(60, 501), "en", "s1", 1)]
    repeat = [(105, words(90, 502) + " " + good[3][1][:300] + " " + words(90, 503), "en", "s1", 1)]
    make_docs(good + copy + junk + private + repeat).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == {*range(60), 100, 104, 105} and set(seen[1]) == set(seen[0]) - {100}
    assert good[3][1][:300] not in seen[2][105].text and seen[2][105].n_chars == len(seen[2][105].text)
    assert "jo.x@mail1.example.com" in seen[2][104].text and "jo.x@mail1" not in seen[3][104].text
    assert all(seen[3][i].text == g[1] for i, g in enumerate(good))
    pieces = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(seen[3])
    packed = pipeline.packing_stage(spark, docs, str(tmp_path))
    assert packed.agg({"length": "sum"}).first()[0] == pieces.agg({"length": "sum"}).first()[0]


def test_empty_corpus(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
