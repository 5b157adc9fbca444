"""The pipeline on planted cases, and the registered queries' shapes."""

from __future__ import annotations

import random

import corpus_pipeline as C

SOUNDS = {"en": "the and ing tion er wh".split(), "de": "sch ung keit ver zu".split()}


def write(spark, path, rows, bench):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rng = random.Random(9)
    text = lambda lang, n=60: " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(60)]
    item = text("en", 25)
    near = rows[3][1].split()
    near[10] = "changed"
    planted = [(100, rows[1][1], "en"), (101, rows[2][1].replace(" ", "\t"), "de"), (102, " ".join(near), "en"), (103, text("en") + " " + item.upper(), "en"), (104, "12 34 !!", "en"), (105, None, "en"), (5, rows[5][1], "en")]
    path = f"file://{tmp_path}/in"
    write(spark, path, [(i, t, lang, "s", len(t or "")) for i, t, lang in rows + planted], [(1, item), (2, None)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    gone = []
    for _, stage in C.STAGES[:-1]:
        new = stage(spark, docs, path)
        assert new.columns == docs.columns
        before, after = sorted(r.doc_id for r in docs.collect()), sorted(r.doc_id for r in new.collect())
        for i in after:
            before.remove(i)
        gone.append(before)
        docs = C.materialize(new, "stage")
    assert gone == [[104, 105], [5, 100, 101], [102], [103]]
    assert docs.where("doc_id = 5").count() == 1
    last = C.run(spark, path)
    assert {r.doc_id for r in last.collect()} == set(range(60))


def test_empty_documents(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    write(spark, path, [], [(1, "some text")])
    assert C.run(spark, path).count() == 0
