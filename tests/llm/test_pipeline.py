"""The pipeline against a stage-by-stage brute-force version."""

import os

import corpus_pipeline
from lectern.llm import language, quality
from lectern.llm.shared import shared_dir

from tests.llm import helpers as H


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    labels = spark.read.parquet(f"{H.SF}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    named = {r["doc_id"] for r in language.predict(docs, language.fit(docs), ["doc_id"]).where("lang_pred <> 'und' and score >= 0.5").collect()}
    left = docs.where(docs["doc_id"].isin(list(named)))
    good = {r["doc_id"] for r in quality.classify(left, labels, held_out_fold=None).where("good").collect()}
    classes = H.near_duplicate_classes({i: text[i] for i in good})
    first = {i for i, c in classes.items() if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{H.SF}/benchmark.parquet").collect()]
    want = first - H.contaminated({i: text[i] for i in first}, items)
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    rows = corpus_pipeline.run(spark, H.SF).collect()
    left_over = [x for x in set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before if x.startswith(("lectern", "pipeline"))]
    assert len(left_over) == 1  # the result
    assert {r["doc_id"] for r in rows} == want
    assert len(want) > 0.5 * len(text)


def test_stages_keep_columns_and_survive_awkward_rows(spark):
    docs = H.awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality":
            out = quality.keep_good(docs, H.labels(spark))
        elif name == "decontamination":
            out = stage(spark, docs, H.SF)
        else:
            out = stage(spark, docs, H.SF)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), H.SF).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, H.SF).collect()
    assert sum(r["doc_id"] in (1, 2) for r in kept) == 1
    assert sum(r["doc_id"] == 12 for r in kept) == 2


def test_packing_stage_on_awkward_rows(spark):
    docs = H.awkward(spark)
    stage = dict(corpus_pipeline.STAGES)["packing"]
    out = stage(spark, docs, H.SF)
    assert sum(r["piece"] == 0 for r in out.collect()) == docs.count()
    assert stage(spark, docs.limit(0), H.SF).count() == 0


def test_entry_imports_without_the_pipeline(tmp_path):
    import shutil
    import subprocess
    import sys

    for name in ("lectern", "__spark_entry__.py"):
        (shutil.copytree if name == "lectern" else shutil.copy)(name, tmp_path / name)
    shutil.rmtree(tmp_path / "lectern" / "llm")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False"] and int(said.stdout.split()[0]) > 100, said.stderr
