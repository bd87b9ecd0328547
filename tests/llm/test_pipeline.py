import corpus_pipeline
from tests.llm.test_jaccard import brute
from wingtally.llm import decontamination, secrets


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    at = docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in at.collect()]
        out = stage(spark, at, sf).cache()
        ids = {r.doc_id for r in out.collect()}
        if name != "source_mix":
            assert out.columns == names
        if name == "language_id":
            assert len(ids) > 0.97 * len(rows)
        elif name == "jaccard_join":
            assert ids == {d for d, _, c in brute(rows) if d == c}
        elif name == "decontamination":
            matcher = decontamination.Matcher(bench, decontamination.BUDGET)
            assert ids == {d for d, t in rows if not matcher.find(t)} and all(decontamination.normal(b) not in decontamination.normal(t) for d, t in rows if d in ids for _, b in bench)
        elif name == "secret_scan":
            assert ids == {d for d, _ in rows} and not any(secrets.spans(r.text.encode()) for r in out.collect())
        else:
            assert ids == {d for d, _ in rows} and out.selectExpr("sum(taken) / sum(size) r").first().r > 0.99
        at = out


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and 50 < out.count() < 200


def test_pipeline_on_odd_rows(spark, odd):
    sf, at = "/root/testdata/sf0.001", odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == odd.columns, name
    empty = odd.limit(0)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_one_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, a), (5, b), (None, "x y z"), (None, "u v w"), (9, a + " end"), (None, b + " end")]
    out = corpus_pipeline.join_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(5, a), (5, b), (0, "x y z"), (0, "u v w")])
