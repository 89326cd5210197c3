import corpus_pipeline
from corpusloom.llm import catalog, op2_language, op4_quality, op7_decontaminate, op8_simhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, small):
    """Each stage against its operator's decisions, applied by hand."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "SimHash near-dedup", "benchmark decontamination", "packing"]
    step = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    model = op4_quality.train(docs, op4_quality.training_labels(spark, small))
    scores = {r.doc_id: r.score for r in op4_quality.score(docs, model, ["doc_id"]).collect()}
    good = step["quality classifier"](spark, docs, small)
    assert good.columns == COLUMNS and ids(good) == {d for d, s in scores.items() if s >= 0.7}

    known = op2_language.train(good, op2_language.training_labels(good))
    told = op2_language.predict(good, known, ["doc_id"]).collect()
    spoken = step["language ID"](spark, good, small)
    assert spoken.columns == COLUMNS and ids(spoken) == {r.doc_id for r in told if r.lang_pred != "und" and r.score >= known.threshold}

    groups = op8_simhash_dedup.near_duplicates(spoken).collect()
    single = step["SimHash near-dedup"](spark, spoken, small)
    assert single.columns == COLUMNS and ids(single) == {r.component_id for r in groups} and single.count() == len(ids(single))

    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    held = {r.doc_id for r in op7_decontaminate.contaminated(single, bench).collect()}
    clean = step["benchmark decontamination"](spark, single, small)
    assert clean.columns == COLUMNS and ids(clean) == ids(single) - held

    packed = step["packing"](spark, clean, small)
    assert ids(packed) == ids(clean)
    whole = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))


def test_odd_documents_pass(spark, odd, folder):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, folder(documents=docs.limit(0), labels=labels, benchmark=bench)).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, folder(labels=labels, benchmark=bench)).columns == COLUMNS


def test_odd_documents_go_through_all_stages(spark, odd, folder):
    """Nulls, repeated ids, empty and very long texts from the first stage to the last."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    run = " " * 1_000_000
    docs = docs.unionByName(spark.createDataFrame([(7, f"words before{run}and after a long run of white space", "en", "s", 0)], docs.schema))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "another text with the same id"), (2, None)], "item_id long, text string")
    rows = corpus_pipeline.run(spark, folder(documents=docs, labels=labels, benchmark=bench)).collect()
    ids = [r.doc_id for r in rows if r.piece == 0]
    assert {2, 3, 5}.isdisjoint(ids) and ids.count(1) == 1 and ids.count(6) <= 1 and {1, 4} <= set(ids) and len(ids) == len(set(ids))


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 11))
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
