"""The WARC archive and the URL filter."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import url_rules as U
from sparkgauge.llm import warc as W

BIG = "é" * 600  # 1200 bytes
PAGES = [(1, "http://a/x", BIG), (2, "http://a/y", BIG), (3, None, BIG), (4, "u\r\nEvil: 1", "small"), (5, "v", "small"), (6, "w", None), (7, "w", ""), (8, "z", BIG + "."), (3, None, BIG), (None, "n", "q" * 1000), (9, "n", "q" * 1000), (10, "e", "x\r\n\r\ny" * 300)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "sha") for r in rows], "page_id long, url string, html string, sha256 string")


def test_records_and_revisits(spark):
    got = W.verify(W.write_archive(pages(spark))).collect()
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        r = [x for x in got if x.id == i][0]
        body = (html or "").encode()
        owner = max((j for j, _, h in PAGES if h == html and j is not None), default=None)
        assert r.payload_digest == hashlib.sha1(body).hexdigest() and r.payload_bytes == len(body)
        revisit = len(body) >= 1000 and i != owner
        assert (r.record_type, r.refers_to) == (("revisit", owner) if revisit else ("response", None))


def test_records_are_rebuilt_byte_for_byte(spark):
    archive = W.write_archive(pages(spark))
    assert archive.payloads.count() == len({h or "" for _, _, h in PAGES})
    full = {r.id: bytes(r.payload) for r in W.reconstruct(archive).collect()}
    assert full[1] == BIG.encode() and full[6] == b"" and full[10] == ("x\r\n\r\ny" * 300).encode()
    record = {r.id: bytes(r.record) for r in W.export_records(archive).collect()}
    assert record[8].endswith((BIG + ".").encode() + b"\r\n\r\n") and b"Content-Length: 1201\r\n\r\n" in record[8]
    assert b"u%0D%0AEvil: 1" in record[4] and record[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_plain_warc_files(spark, tmp_path):
    W.export_files(W.write_archive(pages(spark)), f"file://{tmp_path}/out")
    data = b"".join(gzip.open(p).read() for p in sorted(Path(tmp_path, "out").glob("*.gz")))
    seen = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        data, seen = rest[n + 4 :], seen + 1
    assert seen == len(PAGES)


def test_files_are_read_back(spark, tmp_path):
    hard = [(20, "h", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n" * 30), (21, "h", "\r\n\r\n"), (22, "h", "\x00\x1f\x8b\ufeff"), (23, "h", "x" * 300_000)] + [(100 + i, "c", "y" * 999) for i in range(90)] + [(300 + i, "c", "z" * 1000) for i in range(90)]
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before = tables()
    for codec in ("gzip", "none"):
        archive, path = W.write_archive(pages(spark, PAGES + hard)), f"file://{tmp_path}/{codec}"
        W.export_files(archive, path, codec)
        want = sorted(map(repr, W.verify(archive).select("id", "record_type", "refers_to", "payload_digest", "payload_bytes", "header").collect()))
        assert sorted(map(repr, W.read_files(spark, path).select("id", "record_type", "refers_to", "payload_digest", "payload_bytes", "header").collect())) == want
        W.drop_archive(archive)
    assert tables() == before


def test_damaged_files_stop_the_job(spark, tmp_path):
    W.export_files(W.write_archive(pages(spark)), f"file://{tmp_path}/out", "none")
    whole = b"".join(p.read_bytes() for p in sorted(Path(tmp_path, "out").glob("part*")))
    assert len(list(W.parse_records(whole))) == len(PAGES) and list(W.parse_records(b"")) == []
    for i, broken in enumerate((whole[:-1], whole.replace(b"small", b"smalL"), b"x" + whole, whole.replace(b"Refers-To: <urn:page:9>", b"Refers-To: <urn:page:8>").replace(b"Refers-To: <urn:page:3>", b"Refers-To: <urn:page:8>"))):
        Path(tmp_path, f"b{i}").mkdir()
        Path(tmp_path, f"b{i}", "x.warc").write_bytes(broken)
        with pytest.raises(Exception, match="WARC|no response"):
            W.read_files(spark, f"file://{tmp_path}/b{i}").collect()


def test_damage_stops_the_job(spark):
    archive = W.write_archive(pages(spark))
    broken = W.Archive(archive.records, archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="damaged"):
        W.verify(broken).collect()
    with pytest.raises(Exception, match="damaged"):
        W.export_records(broken).collect()


def test_empty_archive(spark):
    assert W.verify(W.write_archive(pages(spark, []))).count() == 0


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_hand_rules_and_parts(spark):
    urls = ["http://Ex.NET/a", "https://m.example.net/en/1", "http://example.com/de/x?y", "http://shop.org/fr/", "http://org/fr/", "http://xorg/fr/", "http://example.net/en", "http://example.net", "nothing", None, "", "http://a.com?p=/de/", "x://h/p#f://g", "http://example.com/DE/"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in U.judge_urls(p, labels(spark, [])).collect()}
    assert len(got) == len(urls)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("ex.net", "/a", "net/", "block")
    assert [got[i].rule for i in range(1, 9)] == ["example.net/en/", "example.com/de/", "org/fr/", "org/fr/", None, "net/", None, None]
    assert [got[i].verdict for i in range(1, 9)] == ["allow", "block", "allow", "allow", "allow", "block", "allow", "allow"]
    assert all((got[i].host, got[i].path, got[i].verdict) == ("", "", "allow") for i in (8, 9, 10))
    assert (got[11].host, got[11].path) == ("a.com", "") and (got[12].host, got[12].path) == ("h", "/p") and got[13].rule is None


def test_mined_rules_block_what_goes_with_bad_labels(spark):
    rows = [(i, f"http://s{i}.example.io/{'casino/win' if i % 4 == 0 else 'news/a'}/{i}") for i in range(400)] + [(1000, "http://other.io/casino/win"), (1001, "http://other.io/win"), (1002, "http://other.io/poker"), (None, "http://q.io/casino/win/1")]
    p = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, tokens string")
    known = labels(spark, [(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(None, 0, 1), (5, None, None), (99999, 0, 1)])
    got = U.judge_urls(p, known)
    verdict = {r.page_id: r.verdict for r in got.collect()}
    assert verdict[0] == verdict[1000] == verdict[1001] == verdict[None] == "block" and verdict[1] == verdict[1002] == "allow"
    # brute force: every rule against every url
    rules = U.mine_rules(p.drop("tokens").withColumn("tokens", U.url_tokens(F.col("url"))).join(known.withColumn("page_id", F.col("doc_id")), "page_id").select("tokens", (F.col("quality") == 0).alias("bad")).na.fill(False))
    needed = [[set(g) for g in r.needed] for r in rules.collect()]
    assert needed and all(len(n) == 1 for n in needed)  # a longer rule adds nothing to a part of it that is as sure
    for r in p.drop("tokens").select("page_id", U.url_tokens(F.col("url")).alias("t")).collect():
        assert (verdict[r.page_id] == "block") == any(all(g & set(r.t) for g in n) for n in needed)


def wilson(hits, body, z=1.96):
    p = hits / body
    return (p + z * z / (2 * body) - z * math.sqrt((p * (1 - p) + z * z / (4 * body)) / body)) / (1 + z * z / body)


@pytest.mark.parametrize("seed", range(3))
def test_rules_match_all_combinations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        tokens = sorted({t for t in "abcdefg" if rng.random() < 0.35} | ({"x", "y"} if rng.random() < 0.3 else set()))
        bad = {"a", "b"} <= set(tokens) and rng.random() < 0.95 or "x" in tokens and "c" in tokens or rng.random() < 0.1
        rows.append((tokens, bad if rng.random() < 0.97 else None))
    got = U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_support=0.03).collect()
    sets = [(set(t), bool(b)) for t, b in rows]
    where = {t: tuple(i for i, (s, _) in enumerate(sets) if t in s) for t in "abcdefgxy"}
    assert where["x"] == where["y"]
    items = "abcdefgx"  # x and y are one item, named x
    rules = {}
    for size in range(1, len(items) + 1):
        for body in itertools.combinations(items, size):
            held = [b for s, b in sets if s >= set(body)]
            if held and sum(held) >= 0.03 * len(sets) and wilson(sum(held), len(held)) >= 0.5:
                rules[body] = (sum(held), len(held), wilson(sum(held), len(held)))
    minimal = {b: v for b, v in rules.items() if not any(set(o) < set(b) and w[2] >= v[2] for o, w in rules.items())}
    assert {tuple(r.items): (round(r.support * len(sets)), r.confidence, r.sure) for r in got} == {b: (h, pytest.approx(h / n), pytest.approx(w)) for b, (h, n, w) in minimal.items()}
    assert {tuple(sorted(map(tuple, r.needed))) for r in got} == {tuple(sorted(("x", "y") if t == "x" else (t,) for t in b)) for b in minimal}


@pytest.mark.parametrize("seed", range(3, 5))
def test_items_that_a_row_leaves_out_are_searched(spark, monkeypatch, seed):
    """Rows bring two or no items to FP-growth, so nearly all rules are beyond it; the order of sets in parts doesn't matter."""
    monkeypatch.setattr(U, "COUNTS", 40)
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        tokens = sorted({t for t in "abcdefg" if rng.random() < 0.35} | ({"x", "y"} if rng.random() < 0.3 else set()))
        bad = {"a", "b"} <= set(tokens) and rng.random() < 0.95 or "x" in tokens and "c" in tokens or rng.random() < 0.1
        rows.append((tokens, bad if rng.random() < 0.97 else None))
    got = U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_support=0.03, max_items=2 * (seed % 2)).collect()
    sets = [(set(t), bool(b)) for t, b in rows]
    where = {t: tuple(i for i, (s, _) in enumerate(sets) if t in s) for t in "abcdefgxy"}
    assert where["x"] == where["y"]
    items = "abcdefgx"  # x and y are one item, named x
    rules = {}
    for size in range(1, len(items) + 1):
        for body in itertools.combinations(items, size):
            held = [b for s, b in sets if s >= set(body)]
            if held and sum(held) >= 0.03 * len(sets) and wilson(sum(held), len(held)) >= 0.5:
                rules[body] = (sum(held), len(held), wilson(sum(held), len(held)))
    minimal = {b: v for b, v in rules.items() if not any(set(o) < set(b) and w[2] >= v[2] for o, w in rules.items())}
    assert {tuple(r.items): (round(r.support * len(sets)), r.confidence, r.sure) for r in got} == {b: (h, pytest.approx(h / n), pytest.approx(w)) for b, (h, n, w) in minimal.items()}
    assert {tuple(sorted(map(tuple, r.needed))) for r in got} == {tuple(sorted(("x", "y") if t == "x" else (t,) for t in b)) for b in minimal}


def test_long_templates_do_not_explode(spark):
    rng = random.Random(3)
    names = [f"part{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    urls = [(i, "http://t.io/" + "/".join(n for n in names[:30] if rng.random() < 0.97) + ("/" + "/".join(names[30:]) if i % 5 == 0 else "")) for i in range(600)]
    p = spark.createDataFrame(urls, "page_id long, url string")
    got = U.judge_urls(p, labels(spark, [(i, 1, int(i % 5 == 0)) for i in range(600)]))
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(0, 600, 5))


def test_urls_of_odd_shapes(spark):
    tokens = lambda u: spark.createDataFrame([(u,)], "u string").select(U.url_tokens(F.col("u"))).first()[0]
    assert tokens("https://A.b.io/x1y/x22y?q=ä&http=1#f") == ["a", "b", "io", "x0y", "q", "ä", "http", "0", "f"]
    assert tokens(None) == tokens("") == tokens("://") == [] and len(tokens("http://a.b/" + "/".join(f"p{chr(97 + i % 26)}{'z' * (i // 26)}" for i in range(5000)))) > 4000


def test_no_pages(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), labels(spark, [])).count() == 0
