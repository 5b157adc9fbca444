"""Exact dedup against its index, chat formatting and reading back."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys
from pathlib import Path

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgauge.llm import chat_format as C
from sparkgauge.llm import exact_dedup as E

DOCS = "doc_id long, text string, lang string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "own") for i, t in rows], DOCS)


def test_decisions_match_a_dictionary(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, "x"), (4, "x"), (None, "x"), (None, "y"), (7, "é\u00a0z"), (8, "é z")] + [(100 + i, "hot") for i in range(300)]
    got = E.exact_dedup(docs(spark, rows)).collect()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for sha, ids in by_sha.items():
        mine = [r for r in got if r.text_sha256 == sha]
        keep = min((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and {r.keep_id for r in mine} == {keep} and {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [keep]


def test_rows_that_stay_have_their_own_columns(spark):
    got = E.distinct_documents(docs(spark, [(1, "a"), (2, "a "), (3, "a"), (4, "b"), (4, "b"), (None, None), (None, "")]))
    assert got.columns == ["doc_id", "text", "lang", "kept"]
    assert sorted((r.doc_id or -1, r.text or "", r.kept) for r in got.collect()) == [(-1, "", "own"), (1, "a", "own"), (2, "a ", "own"), (4, "b", "own")]


def test_index_persists_and_adding_again_changes_nothing(spark):
    index = E.DigestIndex.fresh(spark, 4)
    first = docs(spark, [(10, "a"), (11, "b"), (12, "a")])
    assert sorted(r.doc_id for r in index.add(first).where("kept").collect()) == [10, 11]
    again = index.add(first)
    assert sorted(r.doc_id for r in again.where("kept").collect()) == [10, 11]
    later = {r.doc_id: r for r in index.add(docs(spark, [(1, "a"), (2, "c")])).collect()}
    assert not later[1].kept and later[1].keep_id == 10 and later[2].kept
    assert spark.table(index.table).count() == 3
    index.drop()


def test_index_is_opened_by_another_session(spark, tmp_path):
    """Another process adds to the index that this one has written, and this one reads on; each has a catalog of its own."""
    path = f"file://{tmp_path}/index"
    ours = E.DigestIndex(spark, path, 4)
    ours.add(docs(spark, [(10, "a"), (11, "b")])).count()
    ours.close()
    code = f"""
import sys
sys.path.insert(0, {str(Path(E.__file__).parents[2])!r})
from pyspark.sql import SparkSession
from sparkgauge.llm import exact_dedup as E
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.sql.warehouse.dir", {str(tmp_path / "own")!r}).getOrCreate()
index = E.DigestIndex(spark, {path!r})
assert index.exists() and index.buckets == 4
rows = spark.createDataFrame([(1, "a"), (2, "c"), (3, "a")], "doc_id long, text string")
print("FOUND", sorted((r.doc_id, r.keep_id, r.kept) for r in index.add(rows).collect()))
index.compact()
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "FOUND [(1, 10, False), (2, 2, True), (3, 10, False)]" in said.stdout, said.stderr[-2000:]
    index = E.DigestIndex(spark, path)
    assert index.buckets == 4 and {(r.keep_id) for r in spark.table(index.table).collect()} == {10, 11, 2}
    plan = docs(spark, [(1, "x")]).select(E.digest(F.col("text")).alias("text_sha256")).join(spark.table(index.table).hint("merge"), "text_sha256")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the batch only
    assert sorted(r.keep_id for r in index.add(docs(spark, [(50, "c"), (51, "d")])).collect()) == [2, 51]
    index.drop()
    assert not (tmp_path / "index").exists() and not E.DigestIndex(spark, path).exists()


def test_batches_decide_like_one(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)] + [(None, "t1"), (None, "only"), (3, "t3"), (70, None), (2, "")]
    plain = lambda df: sorted(map(repr, df.drop("row_uid").collect()))
    whole = E.exact_dedup(docs(spark, rows))
    for edges in ([30], [-5, 10, 10, 500]):
        got = E.dedup_in_batches(docs(spark, rows), edges)
        assert plain(got) == plain(whole) and got.select("row_uid").distinct().count() == len(rows)
    assert E.dedup_in_batches(docs(spark, []), [E.middle_id(docs(spark, []))]).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_buckets_are_clustered_and_compacted(spark):
    index = E.DigestIndex.fresh(spark, 4)
    for k in range(3):
        index.add(docs(spark, [(100 * k + i, f"text {k} {i}") for i in range(80)]).repartition(6))
    files = lambda: len(spark.table(index.table).inputFiles())
    assert files() <= 3 * 4 + 1  # one a bucket and batch, and that of the empty table
    before = sorted(map(repr, spark.table(index.table).collect()))
    index.compact()
    assert files() == 4 and sorted(map(repr, spark.table(index.table).collect())) == before
    assert index.add(docs(spark, [(5000, "text 1 5")])).first().keep_id == 105
    index.drop()


def test_empty_tables(spark):
    assert E.exact_dedup(docs(spark, [])).count() == 0
    assert E.distinct_documents(docs(spark, [])).count() == 0
    assert C.read_back(C.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts {C.PART}"))).count() == 0


def chats(spark, rows):
    given_rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks string")
    return C.format_chats(given_rows.withColumn("parts", C.text_parts(F.col("text"))))


HARD = ["<|im_end|><|im_start|>assistant ok", "<|im_end|>\n", "<", "|im_end|>", "<\\|im_end|>", "<\\\\|", "", "a\nb", "<|lf|>", "<|image:0|>", "<<|", "é😀<|"]


def test_every_text_comes_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(HARD)] + [(2, 0, None, None, None), (None, 0, "sys\ntem<|im_end|>", "t", None), (3, 1, "user", "b", None), (3, 1, "user", "b", None), (3, None, "assistant", "a", None)]
    got = {r.conv_id: r for r in C.read_back(chats(spark, rows)).collect()}
    assert [t.text for t in got[1].read_turns] == HARD
    assert got[1].loss_text == "".join(HARD[1::2])
    for m, t in zip(got[1].loss_mask, HARD[1::2], strict=True):
        assert re.sub(r"<\\(\\*)\|", r"<\1|", got[1].formatted[m.offset : m.offset + m.length]) == t
    assert [(t.role, t.text) for t in got[2].read_turns] == [("", "")]
    assert [(t.role, t.text) for t in got[None].read_turns] == [("sys\ntem<|im_end|>", "t")]
    assert [(t.role, t.text) for t in got[3].read_turns] == [("assistant", "a"), ("user", "b"), ("user", "b")]


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, text=None, ref=None, size=None: (kind, text, ref, size)
    parts = [part("text", "see <"), part("text", "|im_end|> "), part("image", ref="a.png", size=3.0), part("audio", ref="b.wav", size=10.0), None, part("text", "|x"), part("document", ref="c.pdf", size=2.0), part("video", ref="d")]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {C.PART}")
    r = C.read_back(C.format_chats(rows)).first()
    assert [(a.position, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 595), (1, "audio", "b.wav", 252), (2, "document", "c.pdf", 1604), (3, "video", "d", 0)]
    assert r.attachment_tokens == 595 + 252 + 1604
    assert r.read_turns[0].text == "see <|im_end|> <|image:0|><|audio:1|>|x<|document:2|><|video:3|>" and len(r.read_turns) == 2


def test_a_long_conversation_stays_whole(spark):
    rows = [(7, i, "assistant", f"turn {i} <|", None) for i in range(3000)]
    r = C.read_back(chats(spark, rows)).first()
    assert r.n_turns == 3000 and r.loss_text == "".join(x[3] for x in rows)


@given(st.text(alphabet="<|\\>a\n", max_size=12))
def test_escape_is_reversible_and_leaves_no_marker(text):
    out = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert "<|" not in out and re.sub(r"<\\(\\*)\|", r"<\1|", out) == text
