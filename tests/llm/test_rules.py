"""Repetition rules, collocations and hard negatives against brute force, on odd rows too."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import collocations as C
from tallyspark.llm import kd_search, repetition
from tallyspark.llm import rns_negatives as R
from tests.llm.data import docs, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Repetition rules


def brute_rules(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    total = sum(map(len, words))

    def inside(n: int) -> set[int]:
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {k for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}

    out = {"n_words": len(words), "word_chars": total, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside(5))}
    several = Counter(lines)
    out["line_chars"] = sum(len("".join(WORD.findall(x))) for x in lines if several[x] > 1)
    out |= {f"chars_{n}": sum(len(words[k]) for k in inside(n)) for n in repetition.LIMITS}
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    limits = {"line_chars": 30, **{f"chars_{n}": limit for n, limit in repetition.LIMITS.items()}}
    return out | {"kept": not out["base_failed"] and all(100 * out[c] <= limit * total for c, limit in limits.items())}


LONG = " ".join(f"averylongwordnumber{i}" for i in range(10))
REPEATS = [
    "a b c d e f g h i j a b c d e", "same line\nsame line\n\n \nsame line", "x\r\nx\ny\n", "é à ü # $ é à ü # $ é à", "\n".join([prose(1, 9), prose(2, 40), prose(1, 9)]), prose(3, 60) + " " + prose(3, 12),
    prose(4, 90) + " " + prose(4, 16), "a" * 9000 + " b", "\n\n\n", "no end", "end\n", "one\ntwo\none", prose(5, 300) + "\n" + prose(5, 20) + "\n" + prose(6, 200), "<a> | <b> & *%*\n<a> | <b> & *%*", prose(7, 100) + " tail of 11 " + " ".join(prose(7, 40).split()[3:15]),
    " ".join([LONG, prose(8, 130), LONG]), " ".join([LONG[:60], prose(9, 130)]) + f"\n{LONG[60:100]}\n{LONG[60:100]}\n" + prose(10, 30),
]


def test_rules_equal_brute_force(spark):
    own = [(100 + i, t, None, None, None) for i, t in enumerate(REPEATS)]
    table = docs(spark, [*rows(), *own])
    clashing = table.selectExpr("*", "'c' AS N_WORDS", "'c' AS `a b`", "'c' AS `a.b``,c:d`")
    got = [r.asDict() for r in repetition.measured(clashing).collect()]
    assert all(r["a b"] == r["a.b`,c:d"] == "c" for r in got)
    columns = ["doc_id", *repetition.COUNTS, "base_failed", "kept"]
    want = [{"doc_id": r[0], **brute_rules(r[1])} for r in [*rows(), *own]]
    order = lambda x: sorted((str([r[c] for c in columns]) for r in x))
    assert order(got) == order(want)
    assert any(r["kept"] for r in want) and any(not r["kept"] and not r["base_failed"] for r in want)
    none = repetition.measured(table.where("false"))
    assert none.collect() == [] and none.columns[:7] == columns[:7]


def test_rules_by_slices_of_a_column():
    """What stands before a text in its slice changes nothing."""
    texts = [t for _, t, *_ in rows()] + REPEATS
    found = [{c: int(x[c][i]) for c in repetition.COUNTS} for _, _, w in repetition.slices(pa.array(texts), most=5000) for x in [repetition.coverage(w)] for i in range(len(w.counts))]
    assert found == [{c: brute_rules(t)[c] for c in repetition.COUNTS} for t in texts]


# Collocations


def brute_collocations(rows: list[tuple], least: int, top: int) -> set[tuple]:
    grams: dict[str, Counter] = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        f = grams.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                f.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, f in grams.items():
        often = {g for g, n in f.items() if len(g) > 1 and n >= least}
        dropped = {g[i : i + 2] for g in often if len(g) == 3 for i in (0, 1) if 100 * f[g] >= 50 * f[g[i : i + 2]]}
        found = []
        for g in often - dropped:
            score, _, k = min((10**6 * f[g] ** 2 // (f[g[:k]] * f[g[k:]]), k, k) for k in range(1, len(g)))
            found.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(x for g, x in f.items() if len(g) == 1)
        out |= {(lang, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)}
    return out


def talk(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["New", "york", "times", "the", "of", "é", "größe", "x", "Ünder", "#1", "a-b", *(f"rare{i}" for i in range(300))]
    mark = [" ", " ", " ", " ", ", ", ".", "\n", "\t", "  ", "!? ", "\x0b", "\r\n"]
    text = lambda: "".join(r.choice(words[: 11 if r.random() < 0.9 else None]) + r.choice(mark) for _ in range(r.randrange(0, 60)))
    return [(text(), r.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(n)] + [(None, "en"), ("", "fr"), ("New York Times " * 400, "en"), ("of the " * 3000, None), ("z " * 5000, "zz")]


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations_equal_brute_force(spark, top):
    some = talk(1, 400)
    some += some[:50]
    table = spark.createDataFrame(some, "text string, lang string").selectExpr("*", "'c' AS n", "'c' AS score", "'c' AS `a.b`").repartition(5)
    got = {tuple(r) for r in C.collocations(table, top=top).collect()}
    assert got == brute_collocations(some, 10, top) and len(got) > 20


def test_collocations_with_many_shared_ids_shards_and_flushes(spark, monkeypatch):
    """Ids of few bits, so that words share them; many shards; filters sent after few n-grams; a saturated bitmap."""
    some = talk(2, 300)
    known = {}
    for text, lang in some:
        known.update({(w, lang or "und"): 1 for w in re.findall(r"[^\s.,;:!?]+", (text or "").lower())})
    table = spark.createDataFrame(some, "text string, lang string").repartition(3)
    rows_ = table.selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    vocabulary = C.written(rows_.mapInArrow(C._word_counts, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(C.F.sum("n").alias("n")))
    monkeypatch.setattr(C, "FEWEST_BITS", 11)
    monkeypatch.setattr(C, "EXCEPTIONS", 1 << 30)
    often, book = C.frequent_words(vocabulary, 10)
    assert book.bits == 11 and len(book.own) > 10
    ids = often.select("id").toPandas()["id"]
    assert ids.is_unique
    monkeypatch.setattr(C, "FEWEST_BITS", 22)
    monkeypatch.setattr(C, "SHARD", 200)
    assert {tuple(r) for r in C.collocations(table).collect()} == brute_collocations(some, 10, 2000)


def test_collocations_without_any(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    few = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert C.collocations(empty).collect() == [] and C.collocations(few).collect() == []


@pytest.mark.parametrize("bits", [22, 23, 31, 42])
def test_filters_lose_nothing(bits):
    r, p, n = np.random.default_rng(bits), C.Packing(bits), 3000
    ids = [r.integers(0, 1 << bits, n, dtype=np.uint64) for _ in range(3)]
    for x in ids:
        x[0], x[1] = (1 << bits) - 1, 0
    ids[2][: n // 2] = 0
    key, tail = p.packed(*ids)
    assert all((a == b).all() for a, b in zip(p.unpacked(key, tail), ids, strict=True))
    assert len(set(zip(key.tolist(), tail.tolist(), strict=True))) == len(set(zip(*(x.tolist() for x in ids), strict=True)))
    again = r.integers(0, n, 5000)
    number = r.integers(1, 10**12, 5000)
    counts = C.merged((key, tail, np.ones(n, np.int64)), (key[again], tail[again], number))
    want = Counter(zip(key.tolist(), tail.tolist(), strict=True))
    for i, m in zip(again.tolist(), number.tolist(), strict=True):
        want[int(key[i]), int(tail[i])] += m
    assert dict(zip(zip(counts[0].tolist(), counts[1].tolist(), strict=True), counts[2].tolist(), strict=True)) == want
    for shard in range(8):
        part = tuple(x[counts[0] >> np.uint64(61) == shard] for x in counts)
        back = C.decoded(C.encoded(part, 3, p.tail), shard, 3, p.tail)
        assert all((a == b).all() for a, b in zip(part, back, strict=True))


def test_equal_keys_with_different_tails_stay_apart():
    key, tail, n = np.array([5, 5, 5, 9], np.uint64), np.array([2, 1, 2, 0], np.uint64), np.array([1, 10, 100, 1000])
    assert [x.tolist() for x in C.merged((key, tail, n))] == [[5, 5, 9], [1, 2, 0], [10, 101, 1000]]


# Hard negatives


def brute_negatives(points: list[tuple], low: int = 80) -> set[tuple]:
    out, points = set(), list(dict.fromkeys((i, label, tuple(v)) for i, label, v in points))
    for i, label, v in points:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in points if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            negatives = sorted((t, k) for t, k, other in scored if other != label and low * -s <= 100 * -t <= 100 * -s)[:5]
            out |= {(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(negatives, 1)}
    return out


def vectors(n: int, dim: int, top: int, seed: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    return [(i, int(r.integers(0, 4)), r.integers(-top, top + 1, dim).tolist()) for i in range(n)]


def mined(spark, points: list[tuple], parts: int = 3) -> list[tuple]:
    table = spark.createDataFrame(points, "vec_id long, label long, vector array<long>").repartition(parts)
    return [tuple(r) for r in R.mine(table, R.F.col("vec_id") % 100 == 0).collect()]


@pytest.mark.parametrize(("dim", "top"), [(8, 100), (3, 2), (130, 256), (70, 100_000), (64, 10**8)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, top):
    """Several blocks and packs; small components make many ties, large ones many primes."""
    monkeypatch.setattr(R, "LEAST_BLOCK", 90)
    monkeypatch.setattr(R, "PACK", 2)
    points = vectors(420, dim, top, dim)
    points += [(1000, 1, points[5][2]), *((2000 + i, i % 2, [top] * dim) for i in range(40))]
    got = mined(spark, points)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(points) and got


def test_negatives_on_odd_rows(spark):
    base = vectors(150, 6, 9, 3)
    lengths = [(300, 0, [1, 2]), (301, 0, [3, 4]), (302, 1, [3, 3]), (400, 0, [5]), (500, 0, []), (501, 1, [])]
    assert set(mined(spark, [*base, *base[:9], *lengths])) == brute_negatives([*base, *lengths])
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1]), (2, 1, [1])]) == [] and mined(spark, [(100, 0, [1]), (200, 0, [1])]) == []
    with pytest.raises(OverflowError):
        mined(spark, [(0, 0, [1 << 40]), (1, 0, [1 << 40])])


def test_quantised_rows_of_negatives(spark):
    nan, inf = float("nan"), float("inf")
    some = [(1, [0.5, -0.5], 3), (2, [nan, 0.1], 1), (3, [inf, 0.1], 1), (4, None, 1), (5, [None, 0.1], 1), (None, [0.1, 0.1], 1), (6, [0.1, 0.2], None)]
    table = spark.createDataFrame(some, "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in kd_search.quantised(table.where("label IS NOT NULL"), 256, ("label",)).collect()] == [(1, [128, -128], 3)]


def test_residue_products_are_exact():
    r = np.random.default_rng(0)
    for top, dim in ((1, 1), (510, 64), (256, 200), (10**6, 65), (3 * 10**8, 64)):
        a, b = r.integers(-top, top + 1, (7, dim)), r.integers(-top, top + 1, (9, dim))
        a[0], b[0], b[1] = top, top, -top
        moduli = R.primes(dim * top * top)
        got = R.Residues(a, moduli).products(R.Residues(b, moduli))
        assert (got == (a.astype(object) @ b.astype(object).T)).all()
    assert R.primes(0) == [1021] and R.primes(600) == [1021, 1019] and int(np.prod([float(x) for x in R.primes(1 << 62)]) > 2.0**63)
