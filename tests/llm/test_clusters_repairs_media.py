"""Centroid clustering, conversation repair and JPEG columns against plain versions, and JPEG against the JVM's own codec."""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgauge.llm import centroids as C
from sparkgauge.llm import jpeg as J
from sparkgauge.llm import media as M
from sparkgauge.llm import queries as Q
from sparkgauge.llm import repair as R

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_conversation_repair"])
def test_same_rows_as_duckdb(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql, df = con.sql(Q.oracle_sql()[name]), Q.queries()[name](spark, SF)
    order = [df.columns.index(c) for c in sql.columns]
    assert sorted(repr(r) for r in sql.fetchall()) == sorted(repr(tuple(r[i] for i in order)) for r in df.collect())


# Clusters


def lloyd(rows, k, rounds, dims, scale):
    """Plain version: (vec_id, cluster, distance, centroid) for every usable row, in order."""
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    centroids = [v for _, v in seeds]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in good]
        for j in range(len(centroids)):
            mine = [v for (_, v), f in zip(good, found, strict=True) if f == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0], centroids[nearest(v)[1]]) for i, v in good] if centroids else []


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, cluster int")


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_are_those_of_a_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 4)) * 3
    rows = [(int(i), [float(x) for x in middles[i % 5] + rng.normal(size=4) * 0.2]) for i in range(400)]
    rows += [(7, [1.0, 1.0, 1.0, 1.0])] * 150 + [(None, [0.5, -0.5, 0.25, 0.0]), (3, [0.0] * 4), (3, [0.0, 0.0, 0.0, -0.001])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, float("nan"), 1.0, 1.0]), (905, [float("-inf"), 0.0, 0.0, 0.0])]
    got = C.cluster(vectors(spark, rows).repartition(3), k=6, rounds=2, dims=4, scale=8).collect()
    want = lloyd(rows, 6, 2, 4, 8)
    assert sorted(map(repr, want)) == sorted(repr((r.vec_id, r.cluster, r.distance, list(r.centroid))) for r in got)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d, _ in want if c == r.cluster) and r.inertia == sum(d for _, _, d, _ in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()


def test_few_vectors_ties_huge_components_and_empty_tables(spark):
    assert C.cluster(vectors(spark, []), dims=2).collect() == []
    assert C.cluster(vectors(spark, [(None, [1.0, 1.0]), (1, None)]), dims=2).collect() == []
    same = C.cluster(vectors(spark, [(i, [1.0, 1.0]) for i in range(40)]), k=3, dims=2).collect()
    assert {r.cluster for r in same} == {0} and {r.distance for r in same} == {0} and len(same) == 40
    huge = C.cluster(vectors(spark, [(1, [1e300, -1e300]), (2, [0.0, 0.0])]), k=1, rounds=1, dims=2, scale=64).collect()
    assert {list(r.centroid)[0] for r in huge} == {C.limit(2) // 2} and all(r.distance > 0 for r in huge)


@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 9), st.sampled_from([0, 1, 30]))
@settings(max_examples=60, deadline=None)
def test_filtering_gives_every_point_to_the_nearest(seed, n, k, spread):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (n, 3)) + 40 * rng.integers(0, 3, (n, 1))
    order, nodes = C.build(points)
    points, centroids = points[order], points[rng.integers(0, n, k)]
    given_away, inside, nearest = C.walk(points, nodes, centroids)
    found = np.full(n, -1)
    found[inside] = nearest
    for node, a, b, c in given_away:
        found[a:b] = c
        assert nodes["counts"][node] == b - a and (nodes["sums"][node] == points[a:b].sum(0)).all()
    assert (found == np.argmin(((points[:, None] - centroids[None]) ** 2).sum(2), axis=1)).all()


# Repairs


def cheapest(symbols: str) -> tuple[int, str]:
    """Search by cost, then audit, over whole edit sequences; no automaton but the pattern itself."""
    queue, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, kept = heapq.heappop(queue)
        if (i, kept[-2:] if len(kept) > 3 else kept, audit) in done:
            continue
        done.add((i, kept[-2:] if len(kept) > 3 else kept, audit))
        if i == len(symbols) and re.fullmatch(r"(s?(ua)+)?", kept):
            return cost, audit
        possible = lambda k: re.fullmatch(r"s?(ua)*u?", k)
        for r in "ua":
            if possible(kept + r) and audit[-3:] != "III":
                heapq.heappush(queue, (cost + 3, audit + "I", i, kept + r))
        if i < len(symbols):
            s = symbols[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, kept))
            if s != "x":
                more = 3 * s.isupper()
                if s.lower() in "sua" and possible(kept + s.lower()):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, kept + s.lower()))
                for r in "ua":
                    if possible(kept + r):
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, kept + r))


AUTOMATON = R.Determinised()


@given(st.text("xsuaoSUAO", max_size=6))
@settings(max_examples=150, deadline=None)
def test_repair_is_the_least_of_the_cheapest(symbols):
    cost, states = AUTOMATON.scan(symbols)
    assert (cost, AUTOMATON.trace(symbols, states)) == cheapest(symbols)


def test_automaton_stays_small():
    rng = np.random.default_rng(3)
    for _ in range(50):
        AUTOMATON.scan("".join(rng.choice(list("xsuaoSUAO"), 2000)))
    assert len(AUTOMATON.vectors) < 100


def plain_repair(rows):
    """(role, text, turn) rows in order -> the query's columns but conv_id."""
    seen, symbols, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for role, text, _ in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
    cost, audit = cheapest(symbols)
    out, at, kept = [], 0, ""
    for letter in audit:
        if letter != "D":
            want = symbols[at].lower() if letter == "K" else next(r for r in "ua" if re.fullmatch(r"s?(ua)*u?", kept + r))
            kept += want
            role = rows[at][0] if letter == "K" else {"u": "user", "a": "assistant"}[want]
            out.append(f"{role}:{'' if letter == 'I' else rows[at][1]}")
        at += letter != "I"
    turns = [t for *_, t in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def test_damaged_conversations_are_repaired_like_plain_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), int(t), str(rng.choice(["user", "assistant", "system", "tool"], p=[0.45, 0.4, 0.1, 0.05])), str(rng.choice(["Yes.", "No", " \n", "é!?", "Well. ", "So\n."])) ) for c in range(60) for t in range(int(rng.integers(1, 7)))]
    rows += [(None, None, None, None), (None, 3, "user", "Hm."), (70, None, "user", "A."), (70, None, "assistant", "B."), (70, 2, None, "C."), (71, 1, "user", None)]
    rows += [(80, 1, "user", "Same."), (80, 1, "user", "Same."), (80, 2, "user", "Same."), (81, 0, "user", "x" * 300_000), (81, 1, "assistant", "y" * 300_000 + ".")]
    rows += [(next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Goes.")]
    hurt: dict = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = role or " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        hurt[c] += [("user" if fate == 4 else role, text, t)] * {0: 0, 3: 2}.get(fate, 1)
    chats = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, what int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in R.repair(R.damage(chats)).collect()}
    texts: dict = {}
    for r in R.repaired_rows(R.damage(chats)).orderBy("conv_id", "position").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got.keys() == hurt.keys()
    assert any(not v for v in hurt.values())
    for c, mine in hurt.items():
        want, out = plain_repair(sorted(mine, key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1])))
        assert got[c] == want, c
        assert texts.get(c, []) == out


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damage(empty)).collect() == [] and R.repaired_rows(empty).collect() == []


def test_long_conversation_waits_in_a_file(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i} " + "z" * 40_000 + ".") for i in range(600)]
    (row,) = R.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert row.audit == "K" * 600 and row.cost == 0
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in turns).encode()).hexdigest()


# Media


@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_payloads_come_back(texts):
    payloads = [M.padded(t) for t in texts]
    files = J.encode(payloads)
    for p, f, image in zip(payloads, files, J.decode(files), strict=True):
        assert image.error is None and J.payload(image) == p and J.encode([p]) == [f]
        thumb, blocks = image.thumbnail(), np.frombuffer(p, np.int8)[::64]
        assert (thumb.ravel()[: len(blocks)].astype(int) - 128 == blocks).all() and (thumb.ravel()[len(blocks) :] == 128).all()


def test_sparse_blocks_and_many_pieces():
    rng = np.random.default_rng(4)
    sparse = [(rng.integers(0, 256, 64 * 300) * (rng.random(64 * 300) < share)).astype(np.uint8).tobytes() for share in (0, 0.01, 0.05, 0.5)]
    long = b"\xff\x00\x80\x7f" * (16 * (J.BLOCKS_AT_ONCE + 77))
    files = J.encode([*sparse, long, sparse[1]])
    assert [J.payload(i) for i in J.decode(files)] == [*sparse, long, sparse[1]]
    assert files[1] == files[-1]


def jvm_image(spark, data: bytes):
    """Samples of the first channel, by the JVM's codec."""
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    raster, w, h = image.getRaster(), image.getWidth(), image.getHeight()
    return np.array(list(raster.getSamples(0, 0, w, h, 0, spark.sparkContext._gateway.new_array(jvm.int, w * h)))).reshape(h, w)


def test_stored_images_are_images(spark):
    """A block's mean is its first byte, where no sample leaves the range."""
    text = ("a" + " " * 63 + "B" + "\t" * 63 + "\0" * 64) * 3
    (data,) = J.encode([M.padded(text.encode())])
    samples = jvm_image(spark, data)
    image = J.parse(data)
    assert samples.shape == (image.height, image.width)
    flat = M.padded(bytes([200 - 256 & 255] + [0] * 63 + [90] + [0] * 63))
    (data,) = J.encode([flat])
    assert np.abs(jvm_image(spark, data).reshape(8, 2, 8).mean((0, 2)) - next(J.decode([data])).thumbnail()[0]).max() <= 1


@pytest.mark.parametrize(("w", "h", "colour"), [(64, 48, True), (37, 29, True), (8, 8, False), (100, 9, False)])
def test_other_writers_images(spark, w, h, colour):
    """Colour images of the JVM's writer have halved chroma in one scan; their thumbnail is the mean luminance of the blocks."""
    jvm = spark.sparkContext._jvm
    kind = jvm.java.awt.image.BufferedImage
    picture = kind(w, h, kind.TYPE_INT_RGB if colour else kind.TYPE_BYTE_GRAY)
    for y in range(h):
        for x in range(w):
            picture.setRGB(x, y, (min(255, 2 * x) << 16) | (min(255, 3 * y) << 8) | (x * y % 200))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    data = bytes(out.toByteArray())
    (image,) = J.decode([data])
    assert image.error is None and (image.width, image.height, len(image.parts)) == (w, h, 3 if colour else 1)
    if colour:
        rgb = np.array([[picture.getRGB(x, y) for x in range(w)] for y in range(h)])
        grey = 0.299 * (rgb >> 16 & 255) + 0.587 * (rgb >> 8 & 255) + 0.114 * (rgb & 255)
    else:
        grey = jvm_image(spark, data)
    for y in range(h // 8):
        for x in range(w // 8):
            assert abs(grey[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].mean() - image.thumbnail()[y, x]) < 3
    assert image.thumbnail().shape == (-(-h // 8), -(-w // 8))


def test_bad_images_have_an_error(spark):
    (good,) = J.encode([M.padded(b"hello" * 100)])
    at = good.index(b"\xff\xda")
    bad = [b"", b"x", good[:-2], good[:at], good[: at + 40], good.replace(b"\xff\xd3", b"\xff\xd4", 1), good.replace(b"\xff\xc0", b"\xff\xc2", 1), good[: at + 12] + b"\xfe" * 30 + good[at + 42 :]]
    assert all(i.error for i in J.decode(bad))
    table = spark.createDataFrame([(n, bytearray(x) if x is not None else None, "own") for n, x in enumerate([*bad, good, None, good])], "id long, media binary, image string")
    rows = M.describe(table).orderBy("id").collect()
    assert [r.image.error is None for r in rows] == [False] * len(bad) + [True, False, True]
    assert rows[-1].image == rows[-3].image and rows[-1].image.width == 24 and len(rows[-1].image.thumbnail) == 9


def test_stored_documents(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "line\n" * 30_000, "a", "\0" * 70]
    docs = spark.createDataFrame([(i if i != 4 else None, t, b"own") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    stored = M.store(docs, F.col("doc_id"), F.col("text"))
    media = {r.id: bytes(r.media) for r in stored.collect()}
    got = {r.id: r for r in M.features(stored).collect()}
    for i, t in enumerate(texts):
        r, data = got[i if i != 4 else None], (t or "").encode()
        held = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[r.id]), hashlib.sha256(media[r.id]).hexdigest())
    assert (got[2].feature, got[2].media_sha256) == (got[6].feature, got[6].media_sha256) and got[0].media_sha256 == got[1].media_sha256
    empty = M.store(docs.limit(0), F.col("doc_id"), F.col("text"))
    assert M.features(empty).collect() == [] and M.describe(empty).collect() == []
