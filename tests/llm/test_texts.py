"""Packing, secrets, repeats, languages, near duplicates and benchmark leaks, against brute force."""

from __future__ import annotations

import bisect
import math
import random
import re
import time
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import decontaminate as D
from sparkgauge.llm import language_id as L
from sparkgauge.llm import ngram_join as J
from sparkgauge.llm import packing as P
from sparkgauge.llm import secret_scan as S
from sparkgauge.llm import substring_dedup as R
from sparkgauge.llm.components import connected_components
from sparkgauge.llm.queries import tokenizer

CLASH = "doc_id long, text string, lang string, kept boolean, leaks string, node long, component long, row_uid_x long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, True, "own", 7, 7, 1) for i, t, lang in rows], CLASH)


def plain(spark, rows):
    return docs(spark, [(i, t, "en") for i, t in rows])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# packing


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    from sparkgauge.llm.tokens import encoder

    whole, encode = Tokenizer.from_file(tokenizer()), encoder(tokenizer())
    texts = ["", " ", "a  b\n\n c", "it's I'LL 1234 x² ½ straße_é", "<|endoftext|> a", "日本語 текст", "tab\t\x1c\x1dx", "a  b", "emoji 😀!!", "__init__ = '''x'''", "é", "…—“q”", "\r\n\r\n  end  "]
    for t in texts:
        assert array("I", encode(t)).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_quick_ids_are_the_librarys():
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    from sparkgauge.llm import tokens as T

    spec, whole, rng = json.loads(Path(tokenizer()).read_text("utf-8")), Tokenizer.from_file(tokenizer()), random.Random(21)
    quick = T.quick_encoder(spec, whole.model.tokenize)
    assert quick is not None
    vocab = [whole.decode([rng.randrange(50_000)]) for _ in range(3000)]
    for _ in range(2000):  # tokens put together at random, seams and all
        text = "".join(rng.choice(vocab) for _ in range(rng.randint(1, 12)))
        if T.is_common(text):
            assert quick.encode_ordinary(text) == whole.encode(text, add_special_tokens=False).ids, text
    # files for which it isn't shown
    assert T.quick_encoder(spec | {"normalizer": {"type": "NFC"}}, whole.model.tokenize) is None
    assert T.quick_encoder(spec | {"pre_tokenizer": {"type": "Whitespace"}}, whole.model.tokenize) is None
    merges = spec["model"]["merges"]
    assert T.quick_encoder(spec | {"model": spec["model"] | {"merges": merges[1:2] + merges[:1] + merges[2:]}}, whole.model.tokenize) is None
    assert not T.is_common("x" * 500) and not T.is_common("a" + " " * 900 + "b") and not T.is_common("日本") and T.is_common("Straße 12, año – ok\n")


def best_fit_decreasing(sizes, capacity):
    bins: list[int] = []
    for n in sorted(sizes, reverse=True):
        at = bisect.bisect_left(bins, n)
        if at < len(bins):
            rest = bins.pop(at) - n
        else:
            rest = capacity - n
        bisect.insort(bins, rest)
    return len(bins)


SIZES = {
    "exponential": lambda rng: min(100, int(rng.expovariate(1 / 25)) + 1),
    "tiny": lambda rng: rng.randint(1, 3),
    "one size": lambda rng: 34,
    "middling": lambda rng: rng.randint(15, 45),
}


#: Two or three, or three or four pieces a sequence, where an early choice of partners costs most; for sequences of 2048.
NARROW = {
    "halves and quarters": lambda rng: rng.randint(500, 1024),
    "thirds to fifths": lambda rng: rng.randint(400, 700),
    "near a quarter": lambda rng: max(1, round(rng.gauss(560, 60))),
    "wide": lambda rng: rng.randint(300, 900),
}


@pytest.mark.parametrize("kind", NARROW)
def test_packing_of_narrow_sizes_is_within_a_hundredth(spark, kind):
    rng = random.Random(24)
    sizes = [NARROW[kind](rng) for _ in range(5000)]
    given = P.materialize(spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(sizes)], P.PIECES), "pieces")
    got = P.best_fit(given).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sum(r.n for r in got) == sum(sizes) and all(r.n == r.end <= 2048 for r in got)
    assert len(got) <= 1.01 * best_fit_decreasing(sizes, 2048)


@pytest.mark.parametrize("kind", SIZES)
def test_packing_is_close_to_best_fit_decreasing(spark, kind, monkeypatch):
    rng = random.Random(22)
    sizes = [SIZES[kind](rng) for _ in range(2500)]
    given = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(sizes)], P.PIECES).repartition(3)
    monkeypatch.setattr(P, "RANGE_ROWS", 700)  # several ranges
    got: dict[int, list] = {}
    for r in P.best_fit(P.materialize(given, "pieces"), 100).collect():
        got.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter(n for v in got.values() for _, n in v) == Counter(sizes)
    for v in got.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 100
    assert len(got) <= 1.01 * best_fit_decreasing(sizes, 100) + 2


def test_ranges_do_not_change_the_outcome(spark, monkeypatch):
    rng = random.Random(23)
    waiting = spark.createDataFrame([(i, 0, rng.randint(1, 50)) for i in range(900)], "row_uid long, piece int, length int")
    gaps = spark.createDataFrame([(i, rng.randint(5, 50)) for i in range(700)], "seq long, gap int")
    rows = lambda: sorted(map(tuple, P._match(waiting, gaps, 50, 900, 700).collect()))
    whole = rows()
    monkeypatch.setattr(P, "RANGE_ROWS", 500)
    assert rows() == whole
    # by hand: every gap, the smallest first, takes the largest piece that is left and fits
    left, free, n = sorted(r.length for r in waiting.collect()), 0, Counter()
    for gap in sorted(r.gap for r in gaps.collect()):
        at = bisect.bisect_right(left, gap) - 1
        if at < 0:
            free += 1
        else:
            n[gap, left.pop(at)] += 1
    assert Counter((r[5], r[3]) for r in whole if r[0] == P.PLACED) == n
    assert sum(r[0] == P.FREE for r in whole) == free and sorted(r[3] for r in whole if r[0] == P.WAITING) == left


def test_documents_are_packed_whole(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(80)] + [(100, None), (101, ""), (101, ""), (None, "x"), (102, words(rng, 900))]
    got = P.pack_documents(plain(spark, rows), tokenizer(), capacity=128, keep_ids=True).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for v in by.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == [sum(x.length for x in v[:i]) for i in range(len(v))] and sum(r.length for r in v) <= 128
    assert len(by) <= 1.01 * best_fit_decreasing([r.length for r in got], 128) + 1
    assert len({(r.doc_id, r.row_uid) for r in got}) == len(rows)
    from sparkgauge.llm.tokens import encoder

    encode = encoder(tokenizer())
    for i, t in rows:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.row_uid, r.piece))[: None if i != 101 else 1]
        assert b"".join(bytes(r.ids) for r in mine) == encode(t or "") + bytes(4)
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in mine) and all(r.length == 128 for r in mine if r.piece)
    assert P.pack_documents(plain(spark, []), tokenizer()).count() == 0


# secrets


def base_by_hand(text):
    out = [("assign", m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.span()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[1][0], ("assign", "access", "hex").index(x[0])))


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(2)
    bits = ["password", "PassWord = ", "secret", "token", ":", "=", " ", '"', "api_key", "apikey: ", "AKIA", "ABCDEFGH12345678", "deadbeef0123456789abcdef", "é😀", "short", "\n", "ſecret=", "toKen=abcdefgh"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["secret=token:abcdefgh", "", None, "x" * 50000 + " token=" + "a1" * 30]
    got = plain(spark, list(enumerate(texts))).select("doc_id", S.secret_spans(F.col("text")).alias("s")).collect()
    for r in got:
        t = texts[r.doc_id]
        assert [(s.kind, (s.start, s.end)) for s in r.s if s.kind != "guess"] == base_by_hand(t or "")
        assert [(s.start, S.KINDS.index(s.kind)) for s in r.s] == sorted((s.start, S.KINDS.index(s.kind)) for s in r.s)


def test_guess_costs():
    assert S.guess_cost("password") < S.guess_cost("P@ssword1") < S.guess_cost("xK9#mQ2$vLz8")
    assert S.guess_cost("qwertyuiop") < 5 and S.guess_cost("aaaaaaaaaaaaaaaaaaaa") < 5 and S.guess_cost("2019-03-04") < 6 and S.guess_cost("") == 0
    found = S.scan("db pwd => xK9#mQ2$vLz8 and login: password1 then passphrase is qwertyuiop; auth = '9f!Lk2@pQ7zR'")
    assert [(k, s, e) for k, s, e, _ in found] == [("guess", 10, 22), ("guess", 83, 95)]
    assert S.guess_cost("a1" * 20000) < 10  # a repeat, and linear time


def test_a_value_that_outlasts_its_base_span_is_judged():
    text = "password=abcdef#9Lk2$pQ7zR"
    found = [(k, s, e) for k, s, e, _ in S.scan(text)]
    assert ("guess", 9, len(text)) in found and [x for x in found if x[0] == "assign"] == [("assign", 0, 15)]


def every_cut(n):
    """All segmentations of n characters, as lists of (start, end)."""
    if not n:
        yield []
    for i in range(n):
        for rest in every_cut(i):
            yield [*rest, (i, n)]


def pieces_by_hand(value):
    """The least cost of every span that is one pattern or brute force, read off the definitions."""
    low, out = value.lower(), {(i, j): float(j - i) for i in range(len(value)) for j in range(i + 1, len(value) + 1)}
    put = lambda i, j, c: out.__setitem__((i, j), min(out[i, j], c))
    for i, j in list(out):
        plain = "".join({"4": "a", "@": "a", "8": "b", "0": "o", "3": "e", "1": "i", "!": "i", "$": "s", "5": "s", "+": "t", "7": "t"}.get(c, c) for c in low[i:j])
        for word in {low[i:j], plain} & set(S.WORDS):
            put(i, j, math.log10(S.WORDS.index(word) + 1) + math.log10(2) * sum(a != b for a, b in zip(value[i:j], plain, strict=True)))
    for m in S.DATE.finditer(value):
        put(*m.span(), math.log10(365 * 60 * 4 if len(m[0]) > 4 else 120))
    return out


def test_costs_match_every_segmentation():
    rng = random.Random(12)
    bits = ["pass", "root", "sun", "1999", "2001-02-03", "#", "K", "9z", "moon", "m00n", "x"]
    for _ in range(60):
        value = "".join(rng.choice(bits) for _ in range(4))[:11]
        if any(value[i : i + n] == value[i + n : i + 2 * n] for n in range(1, 6) for i in range(len(value))) or any(S._near(a, b) and S._near(b, c) for a, b, c in zip(value.lower(), value.lower()[1:], value.lower()[2:], strict=False)):
            continue  # repeats and walks have tests of their own
        cost = pieces_by_hand(value)
        brute = lambda a, b: cost[a, b] == b - a
        best = min(sum(cost[x] for x in cut) + math.log10(2) * (len(cut) - 1) for cut in every_cut(len(value)) if not any(brute(*p) and brute(*q) for p, q in zip(cut, cut[1:], strict=False)))
        assert S.guess_cost(value) == pytest.approx(best), value


def test_repeats_and_walks():
    assert S.guess_cost("7x" * 6) == pytest.approx(2 + math.log10(6))  # its unit by brute force, and how often
    assert S.guess_cost("qwerty") == pytest.approx(min(math.log10(2), math.log10(47 * 6)))  # a word beats the walk
    assert S.guess_cost("zxcvb") == pytest.approx(math.log10(47 * 5) + math.log10(4))  # one direction
    assert S.guess_cost("zxcde") == pytest.approx(min(math.log10(47 * 5) + 2 * math.log10(4), 3 + math.log10(47 * 3) + math.log10(4)))


def test_very_many_secrets_in_one_text_take_linear_time():
    text = "\n".join(f"password=abcdef{i}" + " pwd => xK9#mQ2$vLz" * (i % 25 == 0) for i in range(50_000))
    began = time.perf_counter()
    kinds = Counter(k for k, *_ in S.scan(text))
    assert kinds["assign"] == 50_000 and kinds["guess"] == 2_000 and time.perf_counter() - began < 30


# repeats


def test_repeats_match_a_dictionary(spark):
    rng = random.Random(3)
    common = words(rng, 24) + "."
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(1, 30)) + "." for _ in range(rng.randint(0, 4))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), common.upper() if i % 2 else common.replace(" ", "  "))
        rows.append((100 - i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(200, None), (201, ""), (None, common), (100, rows[0][1]), (300, common + "\n" + common)]
    got = R.repeated_units(plain(spark, rows)).collect()
    seen: dict = {}
    for i, t in rows:
        for level, a, b, n, d in R.units(t):
            seen.setdefault(d, []).append((i is None, i, a, b, level))
    expect = Counter()
    for v in seen.values():
        first = min(v, key=lambda x: (x[0], x[1] or 0, x[2]))
        rest = list(v)
        rest.remove(first)
        for _, i, a, b, level in rest:
            expect[(level, i, a, b, first[1], first[2], len(v))] += 1
    assert Counter((r.level, r.doc_id, r.start, r.end, r.keep_doc_id, r.keep_start, r.copies) for r in got) == expect
    clean = {(r.doc_id, r.text) for r in R.remove_repeats(plain(spark, rows)).collect()}
    assert sum(common.lower() in " ".join((t or "").lower().split()) for _, t in clean) == 1 and (200, None) in clean and (201, "") in clean
    assert R.remove_repeats(plain(spark, rows)).columns == [*plain(spark, []).columns, "removed"]
    assert R.repeated_units(plain(spark, [])).count() == 0


def test_passages_match_all_windows(spark):
    rng = random.Random(11)
    passage, short = words(rng, 60).split(), [". ".join(words(rng, 4) for _ in range(14)) + "."]
    rows = []
    for i in range(24):
        body = words(rng, rng.randint(0, 90)).split()
        put = passage[rng.randint(0, 10) :][: rng.choice([49, 50, 55])] if i % 3 else " ".join(short).split()
        at = rng.randint(0, len(body))
        body = body[:at] + (["X" + put[0].upper()] if i == 7 else []) + put + body[at:]
        rows.append((50 - i, "".join(w + rng.choice([" ", "  ", "\n", " \n\n"]) for w in body)))
    rows += [(90, rows[3][1]), (91, rows[3][1].upper()), (None, rows[4][1]), (93, "spam " * 130), (94, "İ " + " ".join(passage)), (95, None), (96, " ".join(passage[:49]))]
    first, repeated = {}, {}
    for uid, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0])):
        own = t.lower().split() if t else []
        for p in range(len(own) - 49):
            k = first.setdefault(tuple(own[p : p + 50]), (uid, p))
            if k != (uid, p):
                repeated.setdefault(uid, set()).update(range(p, p + 50))
    given = spark.createDataFrame([(i, uid, t) for uid, (i, t) in enumerate(rows)], "doc_id long, row_uid long, text string")
    got: dict = {}
    low = lambda t, a, b: t[a:b].lower().split()
    by_doc: dict = {}
    for i, t in rows:
        by_doc.setdefault(i, []).append(t)
    spans = []
    for r in R.repeated_passages(given.repartition(5), uid="row_uid").collect():
        text = rows[r.row_uid][1]
        places = [m.span() for m in re.finditer(r"\S+", text)]
        inside = [n for n, (a, b) in enumerate(places) if r.start <= a and b <= r.end]
        assert r.level == "passage" and len(inside) == r.words and places[inside[0]][0] == r.start and places[inside[-1]][1] == r.end and r.copies > 1
        mine = low(text, r.start, r.end)
        assert r.doc_id == 93 or any(low(t, r.keep_start, len(t))[: r.words] == mine and r.words >= 36 for t in by_doc[r.keep_doc_id])
        spans.append((r, inside))
        got.setdefault(r.row_uid, set()).update(inside)
    for r, inside in spans:  # as far as both agree, or to words that another span has
        own, keeps = rows[r.row_uid][1].lower().split(), [t for t in by_doc[r.keep_doc_id] if r.doc_id != 93]
        for t in keeps:
            at, keep = len(t[: r.keep_start].split()), t.lower().split()
            if keep[at : at + r.words] == own[inside[0] : inside[-1] + 1]:
                before, after = own[: inside[0]][-1:] == keep[:at][-1:] != [], own[inside[-1] + 1 :][:1] == keep[at + r.words :][:1] != []
                assert (not before or inside[0] - 1 in got[r.row_uid]) and (not after or inside[-1] + 1 in got[r.row_uid])
    assert len(repeated) > 10 and set(repeated) - set(got) == set()
    for uid, at in repeated.items():
        if rows[uid][0] == 93:
            assert at - got[uid] == set(range(1, 36))
            continue
        missing = at - got[uid]  # at the ends of a run only, where several earlier places hold parts of it
        assert all(not set(range(p - 14, p + 15)) <= at for p in missing) and len(missing) <= 14
    assert sum(not at - got[uid] for uid, at in repeated.items()) > 0.3 * len(repeated)
    clean = R.remove_repeats(given.drop("row_uid")).collect()
    assert sum(" ".join(short) in " ".join((r.text or "").split()) for r in clean) == 1 and R.repeated_passages(given.where("false")).count() == 0


def units_by_hand(text):
    """Lines and sentences of 20 words or more, read off the definition character by character."""
    out, at = [], 0
    for line in text.split("\n"):
        cuts, i = [0], 0
        while i < len(line):
            if line[i] in ".!?" and i + 1 < len(line) and line[i + 1].isspace():
                j = i + 1
                while j < len(line) and line[j].isspace():
                    j += 1
                cuts += [i + 1, j]
                i = j
            else:
                i += 1
        cuts.append(len(line))
        spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b]
        for level, (a, b) in [("line", (0, len(line)))] * bool(line) + [("sentence", x) for x in spans] * (len(spans) > 1):
            if len(line[a:b].split()) >= 20:
                out.append((level, at + a, at + b, len(line[a:b].split())))
        at += len(line) + 1
    return out


def test_units_match_their_definition():
    rng = random.Random(16)
    for _ in range(50):
        text = "".join(words(rng, rng.randint(1, 25)) + rng.choice([". ", "! ", "?\t", "\n", "\n\n", ".x "]) for _ in range(12))
        assert [u[:4] for u in R.units(text)] == units_by_hand(text)


def test_places_of_words_are_those_of_the_pattern():
    rng = random.Random(19)
    letters = "ab \t\n\x1c\u00a0\u2003\u3000.\u0e01\u4e00\u30ab\uac00\U00020000\U0001f600\u0130"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert [tuple(x) for x in R.word_places(text).tolist()] == [m.span() for m in R.WORD.finditer(text)]
        assert len(R.word_places(text)) == len(R.split_words(text))


def test_wide_stops_end_sentences_in_spaced_lines():
    rng = random.Random(20)
    first, second = words(rng, 24) + "\u3002", words(rng, 22) + "."
    text = first + second
    assert [(level, text[a:b], n) for level, a, b, n, _ in R.units(text)] == [("line", text, 45), ("sentence", first, 24), ("sentence", second, 22)]


def test_scripts_without_spaces_have_units(spark):
    rng = random.Random(17)
    zh = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    passage, line = zh(70), zh(25) + "。"
    rows = [(1, zh(40) + passage + zh(30)), (2, zh(9) + passage + zh(80)), (3, line + "\n" + zh(60)), (4, zh(60) + "。" + line + zh(50)), (5, zh(500))]
    got = {(r.level, r.doc_id): rows[r.doc_id - 1][1][r.start : r.end] for r in R.repeats(plain(spark, rows)).collect()}
    assert got == {("passage", 2): passage, ("sentence", 4): line}


def test_a_very_long_text_and_a_hot_passage(spark):
    rng = random.Random(18)
    passage = words(rng, 60)
    rows = [(i, words(rng, 20) + " " + passage + " " + words(rng, 20)) for i in range(200)] + [(999, words(rng, 150_000) + " " + passage)]
    got = R.repeated_passages(plain(spark, rows)).collect()
    text = dict(rows)
    assert sorted({r.doc_id for r in got}) == [*range(1, 200), 999]
    whole = {r.doc_id for r in got if passage in text[r.doc_id][r.start : r.end] and r.keep_doc_id == 0 and r.copies > 1}
    assert whole == {*range(1, 200), 999} and all(r.words < 70 for r in got)


# languages


def test_languages_are_told_apart_on_held_out_rows(spark):
    rng = random.Random(4)
    sounds = {"aa": "kato lumi neva sori".split(), "bb": "sch ung keit ver".split(), "cc": "eaux oire trem pluie".split()}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choice(list(sounds)) for _ in range(300))]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", "cc"), (903, text("aa"), None), (None, text("bb"), "bb"), (0, rows[0][1], rows[0][2]), (904, text("cc") * 300, "cc"), (905, "a", "aa")]
    got = L.identify(docs(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == r.lang for r in test) / len(test) > 0.98 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "aa", "cc", "bb"]
    # every prototype and prediction by plain Python
    def by_hand(t):
        total = [0] * L.DIMENSIONS
        padded = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        for x in zip(padded, padded[1:], padded[2:], strict=False):
            if x[1] != " ":
                a, b, c = (L._letter_vector(0 if y == " " else ord(y)).tolist() for y in x)
                total = [n + a[i - 2] * b[i - 1] * c[i] for i, n in enumerate(total)]
        return total

    few = rows[:45]
    vectors = {i: by_hand(t) for i, t, _ in few}
    protos: dict = {}
    for i, _, lang in few:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            protos[lang] = [x + y for x, y in zip(protos.get(lang, [0] * L.DIMENSIONS), vectors[i], strict=True)]
    learned = {r.lang: list(r.vector) for r in L.learn(docs(spark, few).where(~L.held_out(F.col("doc_id"))).select("lang", "text")).collect()}
    assert learned == protos
    cosine = lambda v, w: sum(x * y for x, y in zip(v, w, strict=True)) / math.sqrt(sum(x * x for x in v) * sum(y * y for y in w))
    for r in L.identify(docs(spark, few)).collect():
        score, lang = max((cosine(vectors[r.doc_id], p), lang) for lang, p in protos.items())
        assert r.lang_pred == lang and r.score == pytest.approx(score)
    kept = L.in_some_language(docs(spark, rows + odd))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(rows) + len(odd) - 3
    foreign = [(2000, "zzxq qxxz " * 40, None)]
    assert 2000 not in {r.doc_id for r in L.in_some_language(docs(spark, rows + foreign)).collect()}
    assert L.identify(docs(spark, [])).count() == 0
    assert [r.lang_pred for r in L.identify(docs(spark, [(1, "abc", None)])).collect()] == ["und"]
    # nothing to learn from: only texts without a letter go
    assert sorted(r.doc_id for r in L.in_some_language(docs(spark, [(i, t, None) for i, t, _ in rows[:9] + odd[:3]])).collect()) == list(range(9))
    assert L.in_some_language(docs(spark, [])).count() == 0


def test_any_number_of_languages(spark, monkeypatch):
    rng = random.Random(14)
    rows = [(i, words(rng, 12), f"l{i % 23:02}") for i in range(92)]
    judged = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.identify(docs(spark, rows)).collect())
    whole = judged()
    for name, value in (("MAX_LANGUAGES", 5), ("MAX_SUMS", 2), ("FOLD_AT", 50)):
        monkeypatch.setattr(L, name, value)
    assert judged() == whole


def test_learning_holds_sums_only(monkeypatch):
    import pyarrow as pa

    rng = random.Random(15)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400)) for _ in range(10)]
    batch = pa.record_batch({"lang": pa.array(["zh"] * 10), "text": pa.array(texts)})
    whole = [b.column(2).to_pylist() for b in L._partial(iter([batch]))]
    monkeypatch.setattr(L, "FOLD_AT", 1000)
    assert [b.column(2).to_pylist() for b in L._partial(iter([batch]))] == whole


# near duplicates


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([0, 1, 3, 5, 40, 120]))) for i in range(60)]
    base = words(rng, 100).split()
    for i in range(330):  # one large group of near copies, in more than one block
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000 + i, "The  same\ntext five times over and over") for i in range(40)] + [(6000, None), (6001, "  "), (None, rows[5][1] or "x"), (1000, rows[60][1]), (7000, " ".join(base[:90]).upper())]
    got = J.jaccard_join(plain(spark, rows)).collect()
    assert len(got) == len(rows)
    shingle = lambda t: frozenset(tuple(w[j : j + 5]) for w in [(t or "").lower().split()] for j in range(max(1, len(w) - 4)) if w)
    classes: dict = {}
    for i, t in rows:
        classes.setdefault(shingle(t), []).append(i)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    reps = list(classes)
    links = {s: [o for o in reps if o is not s and s and len(s & o) >= 0.8 * len(s | o) - 1e-9] for s in reps}
    group: dict = {}
    for s in reps:
        if s not in group:
            todo, found = [s], {s}
            while todo:
                for o in links[todo.pop()]:
                    if o not in found:
                        found.add(o)
                        todo.append(o)
            for o in found:
                group[o] = found
    of = {i: s for i, t in rows for s in [shingle(t)]}
    assert len(links[shingle(rows[60][1])]) > 200
    for r in got:
        s = of[r.doc_id]
        ids = [i for o in group[s] for i in classes[o]]
        assert (r.class_id, r.class_size, r.n_links, r.n_link_docs) == (low(classes[s]), len(classes[s]), len(links[s]), sum(len(classes[o]) for o in links[s])), r
        assert (r.group_id, r.group_size) == (low(ids), len(ids))
    kept = J.one_of_each_group(plain(spark, rows))
    assert kept.columns == plain(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({low([i for o in g for i in classes[o]]) for g in group.values()})
    assert J.jaccard_join(plain(spark, [])).count() == 0 and J.one_of_each_group(plain(spark, [(1, None)])).count() == 1


def test_shared_passages_do_not_chain_into_candidates(spark):
    rng = random.Random(19)
    shared = [words(rng, 44) for _ in range(20)]
    rows = [(i, " ".join([shared[i % 20], words(rng, 40), shared[(i + 1 + rng.randrange(19)) % 20]])) for i in range(500)]
    rows += [(1000 + i, rows[i][1].rsplit(" ", 2)[0]) for i in range(10)]
    seen = []
    real, J.candidates = J.candidates, lambda *a: seen.append(real(*a)) or seen[-1]
    try:
        got = {r.doc_id: r for r in J.jaccard_join(plain(spark, rows)).collect()}
    finally:
        J.candidates = real
    assert {i: r.n_links for i, r in got.items() if r.n_links} == {i: 1 for k in range(10) for i in (k, 1000 + k)} and all(got[1000 + i].group_id == i for i in range(10))
    # most share a band with another, but few survive the pruning, and those don't form one component
    held = Counter(r.component for r in seen[0].collect())
    assert sum(held.values()) < 100 and max(held.values()) < 20


@pytest.mark.parametrize("seed", range(3))
def test_forests_of_surviving_pairs(seed):
    rng = np.random.default_rng(seed)
    n, limits = 150, J.prune_limits(0.8, 1e-6)
    signs = rng.integers(0, 2**16, (n, J.HASHES), dtype=np.uint16)
    for i in range(40, n):  # noisy copies, copies of copies too
        kept = rng.random(J.HASHES) < rng.choice([0.6, 0.75, 0.95])
        signs[i, kept] = signs[rng.integers(0, i), kept]
    sizes = rng.choice([100, 105, 130], n)
    for sides in (np.zeros(n, int), rng.integers(0, 2, n)):
        pairs = [(i, j) for i in range(n) for j in range(i) if sides[i] != sides[j] or not sides.any()]
        alive = lambda i, j: min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) - 1e-6 and all((signs[i, : J.STEP * (k + 1)] == signs[j, : J.STEP * (k + 1)]).sum() > m for k, m in enumerate(limits))

        def dict_of(edges):
            root = list(range(n))
            for a, b in edges:
                p, q = top(root, a), top(root, b)
                root[p] = q
            return root

        def top(root, x):
            while root[x] != x:
                x = root[x]
            return x

        root_a, root_b = dict_of([p for p in pairs if alive(*p)]), dict_of(J._forest(sides, sizes, signs, 0.8, limits))
        assert {frozenset(x for x in range(n) if top(root_a, x) == r) for r in range(n)} == {frozenset(x for x in range(n) if top(root_b, x) == r) for r in range(n)}


def test_a_very_long_text_has_a_near_copy(spark):
    rng = random.Random(20)
    long = words(rng, 60_000).split()
    rows = [(1, " ".join(long)), (2, " ".join(long[:100] + ["x"] + long[101:])), (3, words(rng, 30))]
    got = {r.doc_id: (r.group_id, r.n_links) for r in J.jaccard_join(plain(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_prune_limits_keep_pairs_at_the_threshold():
    limits = J.prune_limits(0.8, 1e-6)
    assert limits == sorted(limits) and limits[0] >= 0
    for i, most in enumerate(limits):
        n = (i + 1) * J.STEP
        assert sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(most + 1)) < 1e-5


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    assert all(got.get(x, x) == top(x) for x in root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# leaks


def best_place(item, text):
    """Brute force: (distance, start, end) of the best match of an item in a text from the full edit table, the first end of equals and its nearest start."""
    rows = [[(0, -j) for j in range(len(text) + 1)]]  # distance, then the latest start
    for i, c in enumerate(item, 1):
        row = [(i, 0)]
        for j, d in enumerate(text, 1):
            row.append(min((rows[-1][j - 1][0] + (c != d), rows[-1][j - 1][1]), (rows[-1][j][0] + 1, rows[-1][j][1]), (row[-1][0] + 1, row[-1][1])))
        rows.append(row)
    end = min(range(len(text) + 1), key=lambda j: rows[-1][j][0])
    return rows[-1][end][0], -rows[-1][end][1], end


def all_places(item, text, most, at=0):
    """Every match with at most so many edits: the best, and then those before and after it."""
    distance, start, end = best_place(item, text)
    if distance > most or end == start:
        return []
    return all_places(item, text[:start], most, at) + [(at + start, at + end, distance)] + all_places(item, text[end:], most, at + end)


def test_leaks_match_the_full_edit_table(spark):
    rng = random.Random(7)
    items = [(k, words(rng, rng.randint(4, 12))) for k in range(12)] + [(50, None), (51, "  "), (52, "tiny")]
    rows = []
    for i in range(80):
        t = words(rng, rng.randint(0, 30))
        if i % 2:
            hit = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(hit))
                hit[at] = rng.choice(["", "z", hit[at] + "q", hit[at]])
            t = t + rng.choice([" ", "\n", ""]) + "".join(hit).upper().replace(" ", "  ") + " " + words(rng, 5)
        rows.append((i, t))
    rows += [(900, None), (901, ""), (902, "x" * 20000 + " Tiny " + items[0][1] + " " + items[0][1]), (None, items[1][1]), (902, items[2][1])]
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, leaks string")
    got = D.leaks(plain(spark, rows), bench).collect()
    found = Counter((r.doc_id, r.item_id) for r in got)
    for i, t in rows:
        norm = " ".join((t or "").lower().split())
        if len(norm) > 10000:
            continue
        for k, item in items:
            it = " ".join((item or "").lower().split())
            if len(it) >= D.MIN_CHARS and i != 902:
                mine = sorted((len(" ".join(t[: r.start].lower().split())), r.distance) for r in got if (r.doc_id, r.item_id) == (i, k))
                expect = [(a, d) for a, _, d in all_places(it, norm, int(D.ERROR_RATE * len(it)))]
                assert [d for _, d in mine] == [d for _, d in expect] and all(abs(a - b) <= 1 for (a, _), (b, _) in zip(mine, expect, strict=True)), (i, k)
    assert found[(902, 0)] == 2 and found[(902, 52)] == 1 and found[(None, 1)] == 1
    text = dict(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 900 and r.distance == 0:
            assert " ".join(text[r.doc_id][r.start : r.end].lower().split()) == " ".join(dict(items)[r.item_id].lower().split())
    clean = D.decontaminate(plain(spark, rows), bench)
    assert clean.columns == plain(spark, []).columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in found}
    assert D.leaks(plain(spark, []), bench).count() == 0 and D.leaks(plain(spark, rows), bench.limit(0)).count() == 0


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, words(rng, 8)) for k in range(9)]
    rows = [(k, words(rng, 5) + " " + t) for k, t in items] + [(100, words(rng, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(D.leaks(plain(spark, rows), bench).collect())
    monkeypatch.setattr(D, "BLOCK_CHARS", 60)
    assert sorted(D.leaks(plain(spark, rows), bench).collect()) == whole and len(whole) == 9


def test_a_worse_match_before_the_best_is_found():
    rng = random.Random(5)
    item = words(rng, 24)
    matcher = D.Matcher([(1, item)])
    near = item[:50] + "#" + item[51:]
    for text in (near + " " + item, item + " " + near, near + " " + item + " " + near, near + item + near):
        assert [x[1:] for x in matcher.find(text)] == all_places(item, text, int(D.ERROR_RATE * len(item))), text


def test_overlapping_windows_match_the_full_edit_table():
    rng = random.Random(13)
    for _ in range(40):
        item = words(rng, rng.randint(5, 8))
        bits = []
        for _ in range(rng.randint(1, 4)):
            hit = list(item)
            for _ in range(rng.randint(0, 4)):
                hit[rng.randrange(len(hit))] = rng.choice(["", "z", "qq"])
            bits.append("".join(hit)[rng.choice([0, 0, 1, 2]) :])
        text = " ".join(rng.choice(["", " "]).join(bits).split())
        got = [x[1:] for x in D.Matcher([(1, item)]).find(text)]
        assert got == all_places(item, text, int(D.ERROR_RATE * len(item))), (item, text)


def test_repeats_of_rows_with_clashing_columns(spark):
    line = words(random.Random(3), 40) + "."
    rows = [(1, line, 7, "a", "b", "c", 1), (2, line, 7, "d", "e", "f", 2), (1, line, 7, "a", "b", "c", 1), (3, "short", 8, "g", "h", "i", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_uid long, spans string, removed string, level string, start int")
    plainly = sorted(map(tuple, R.repeats(docs.select("doc_id", "text")).drop("row_uid").collect()))
    assert sorted(map(tuple, R.repeats(docs).drop("row_uid").collect())) == plainly and plainly
    clean = R.remove_repeats(docs)
    assert clean.columns == ["doc_id", "text", "row_uid", "spans", "level", "start", "removed"]
    got = sorted((r.doc_id, r.text, r.row_uid, r.spans, len(r.removed)) for r in clean.collect())
    assert got == [(1, "", 7, "a", 1), (1, line, 7, "a", 0), (2, "", 7, "d", 1), (3, "short", 8, "g", 0)]


def test_short_items_match_as_whole_words():
    found = D.Matcher([(1, "tiny"), (2, " x y z "), (3, ""), (4, "Tiny"), (5, "??")]).find("Tiny, x  y z! tinyx xtiny (TINY) ??")
    assert found == [(1, 0, 4, 0), (4, 0, 4, 0), (2, 6, 12, 0), (1, 27, 31, 0), (4, 27, 31, 0), (5, 33, 35, 0)]


def test_items_of_one_stem_cost_little_and_are_all_found():
    """2,000 items share their first 50 characters, and 300 share one text."""
    rng = random.Random(31)
    stem = words(rng, 12)[:50]
    items = [(i, stem + " " + words(rng, 25)) for i in range(2000)] + [(5000 + i, words(random.Random(1), 30)) for i in range(300)]
    matcher = D.Matcher(items)
    text = " ".join(stem + " " + words(rng, 40) for _ in range(20))
    began = time.process_time()
    assert matcher.find(text) == []
    assert time.process_time() - began < 0.5
    for i in (0, 77, 1999):
        broken = items[i][1].replace("a", "", 3)
        assert [x[0] for x in matcher.find("before " + broken + " after")] == [i]
    assert [x[0] for x in matcher.find("see " + items[2000][1])] == list(range(5000, 5300))


def test_pieces_are_disjoint_and_avoid_common_stretches():
    rng = random.Random(2)
    for _ in range(200):
        m = rng.randint(20, 300)
        common = np.zeros(m, bool)
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(m)
            common[a : a + rng.randint(1, 60)] = True
        k = int(D.ERROR_RATE * m)
        pieces = sorted(D.pieces_of(m, k, common))
        assert len(pieces) == k + 1 and all(0 <= a < b <= m for a, b in pieces) and all(b <= c for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))
    texts = ["the same long opening " + w for w in ("alpha beta gamma", "delta epsilon zeta")] * 5
    marks = D.common_places([f"{t} {i}" for i, t in enumerate(texts)])
    assert all(m[:14].all() for m in marks) and not D.common_places(["abcdefghijk"] * 3)[0].any()
