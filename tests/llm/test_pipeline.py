"""The pipeline's stages against plain versions."""

import corpus_pipeline
from longpanel.llm import op2_toxicity, op3_secrets, op4_near_dedup, op9_decontamination


def test_stages_take_effect(spark, sf_dir):
    """Each stage on its own input, against the operator's report on that input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark", "secrets", "tokens"]
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())

    kept = stages["toxicity"](spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    scored = op2_toxicity.score(docs, op2_toxicity.fit(docs, labels))
    assert ids(kept) == ids(scored.where("score < 0.5")) and 0 < kept.count() < docs.count()

    unique = stages["near_duplicates"](spark, kept, sf_dir).cache()
    assert unique.columns == docs.columns
    assert ids(unique) == ids(op4_near_dedup.near_duplicates(kept).where("doc_id = component_id"))
    assert unique.count() < kept.count()

    clean = stages["benchmark"](spark, unique, sf_dir).cache()
    assert clean.columns == docs.columns
    assert ids(clean) == ids(op9_decontamination.report(unique, bench).where("n_hit = 0"))

    hidden = stages["secrets"](spark, clean, sf_dir).cache()
    assert hidden.columns == docs.columns and ids(hidden) == ids(clean)
    assert all(r["n_chars"] == len(r["text"] or "") for r in hidden.select("text", "n_chars").collect() if r["n_chars"] is not None)
    spans = {r["doc_id"]: len(r["spans"]) for r in op3_secrets.scan(clean.select("doc_id", "text")).collect()}
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in hidden.collect():
        assert (r["text"] != before[r["doc_id"]]) == (spans[r["doc_id"]] > 0)

    last = stages["tokens"](spark, hidden, sf_dir)
    assert ids(last) == ids(hidden)
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(hidden)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, base int, weak int, spans string, score double, passages string, hit_id int, hit_key long, _found int, _tox int, ids string, root long, component_id long, n_tokens int"
TEXTS = [None, "", " ", "plain words of a clean text that nobody minds at all today", "password=hunter2hunter2 in a text of its own with some more words", "word " * 40_000, "the benchmark window of ten words that must not be trained on here", "é漢字 🙂 text"]


def folder_of(spark, folder, docs, labels):
    spark.createDataFrame(docs, CLASHING).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, score double").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b", "benchmark window of ten words that must not be trained on", 1), (None, None, None)][: 2 * bool(docs)], "item_id string, text string, at int").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, and columns named as the operators' own."""
    rest = (7, 8, "s", 0.9, "p", 1, 2, 3, 4, "i", 5, 6, 7)
    docs = [(i, t, "en", None, None, *rest) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None, 1, *[None] * 13), (3, TEXTS[3], "en", None, None, *rest), (20, TEXTS[3], "en", None, None, *rest)]
    folder = folder_of(spark, tmp_path, docs, [(3, 0, 1.0), (None, 1, None), (4, None, None)])
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = kept.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder).cache()
        if name != "tokens":
            assert kept.columns == names
            assert all(tuple(r)[5:] == rest for r in kept.where("doc_id IS NOT NULL").collect())
        seen[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    every = [(False, i) for i in (0, 1, 2, 3, 3, 4, 5, 6, 7, 20)] + [(True, 0)]
    assert seen["toxicity"] == every
    assert seen["near_duplicates"] == [x for x in every if x != (False, 20)]
    assert seen["benchmark"] == seen["secrets"] == seen["tokens"] == [x for x in seen["near_duplicates"] if x != (False, 6)]


def test_empty_tables_pass_all_stages(spark, tmp_path):
    found = corpus_pipeline.run(spark, folder_of(spark, tmp_path, [], []))
    assert found.count() == 0 and found.columns == ["doc_id", "n_tokens", "ids"]
