import hashlib
import random
import re
from collections import Counter

import pytest

from tallyspark.llm import jaccard_join, substring_dedup
from tallyspark.llm.graph import components
from tallyspark.llm.shared import join_hot
from tests.llm.data import DOCS, docs, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_cut(data, window=50):
    words = [(i, WORD.findall(t or "")) for i, t, *_ in data]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup_equals_brute_force(spark):
    found = substring_dedup.digests(substring_dedup.remove_repeats(docs(spark))).collect()
    assert Counter(tuple(r) for r in found) == brute_cut(rows())


def test_substring_dedup_small_window_and_edits(spark):
    base = prose(20, 300, 9)
    data = [(i, " ".join(prose(30 + i, 5, 9).split() + base.split()[i * 7 : i * 7 + 90]), None, None, None) for i in range(30)]
    found = substring_dedup.digests(substring_dedup.remove_repeats(spark.createDataFrame(data, DOCS), 12)).collect()
    assert Counter(tuple(r) for r in found) == brute_cut(data, 12)


def test_substring_dedup_keeps_white_space_as_is(spark):
    passage = prose(2, 60, 5000)
    data = [(1, passage, None, None, 0), (2, f" head\n\t{passage}  tail\n", None, None, 0), (3, " a\n b ", None, None, 0)]
    out = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(spark.createDataFrame(data, DOCS), as_is=True).collect()}
    assert out == {1: passage, 2: " head\n\ttail\n", 3: " a\n b "}


def test_substring_dedup_of_nothing(spark):
    out = substring_dedup.remove_repeats(spark.createDataFrame([], DOCS))
    assert out.collect() == [] and "lang" in out.columns


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(data):
    sets = [(i, shingles(t)) for i, t, *_ in data]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is None or j is None:
                continue
            if s and t and (i == j or 100 * len(s & t) >= 75 * len(s | t)):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return Counter((i, len(s), least[root(a)] if i is not None else None) for a, (i, s) in enumerate(sets))


def test_jaccard_join_equals_brute_force(spark):
    found = jaccard_join.classes(docs(spark)).collect()
    assert Counter(tuple(r) for r in found) == brute_classes(rows())


@pytest.mark.parametrize("sample,part", [(8, 2048), (1, 2048), (2, 8)])
def test_jaccard_join_near_the_threshold(spark, monkeypatch, sample, part):
    whole = jaccard_join.common_shingles
    monkeypatch.setattr(jaccard_join, "common_shingles", lambda docs, size: whole(docs, size, sample))
    monkeypatch.setattr(jaccard_join, "PART", part)
    data = []
    for g in range(4):
        base = prose(100 + g, 120, 4000).split()
        for k in range(12):
            w = list(base)
            for e in range(k % 6):
                w[(13 * e + 7 * k) % len(w)] = f"edit{g}-{k}-{e}"
            data.append((g * 100 + k, " ".join(w[: len(w) - k % 4 * 5]), None, None, None))
    common = prose(7, 40, 3000)
    data += [(1000 + i, f"{common} {prose(500 + i, 14, 3000)}", None, None, None) for i in range(40)]
    found = jaccard_join.classes(spark.createDataFrame(data, DOCS)).collect()
    assert Counter(tuple(r) for r in found) == brute_classes(data)


def test_a_large_family_is_sent_once(spark, monkeypatch):
    """Sets that are joined to the centre of their cell don't meet by pairs of parts."""
    sent, split = [], jaccard_join._split

    def watched(*args):
        star, more = split(*args)
        sent.append((star.count(), more.count()))
        return star, more

    monkeypatch.setattr(jaccard_join, "_split", watched)
    monkeypatch.setattr(jaccard_join, "PART", 10)
    base = prose(5, 200, 5000).split()
    data = [(i, " ".join([*base[:190], *prose(600 + i, 10, 5000).split()]), None, None, None) for i in range(300)]
    near = " ".join([*base[:150], *prose(9, 50, 5000).split()])  # like the family by 0.6: not joined to its centre
    data += [(1000 + i, near + f" {i}", None, None, None) for i in range(5)]
    found = jaccard_join.classes(spark.createDataFrame(data, DOCS)).collect()
    assert Counter(tuple(r) for r in found) == brute_classes(data)
    assert sent and sent[0][0] >= 299 and sent[0][1] < 2 * 305 + 5 * 40


def test_components_of_stars_and_pairs(spark):
    r = random.Random(1)
    for links in ([(500, i) for i in range(100)] + [(700, i) for i in range(200, 300)] + [(5, 700)], [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1, 50)], [(2, 1), (1, 2), (3, 3)], [(r.randrange(400), r.randrange(400)) for _ in range(250)], [(-(1 << 62), 1 << 62), (1 << 62, (1 << 62) + 1)]):
        label = {x: x for e in links if e[0] != e[1] for x in e}
        while any(label[a] != label[b] for a, b in links if a != b):
            for a, b in links:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = [tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect()]
        assert dict(got) == label and len(got) == len(label)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark):
    out = jaccard_join.one_of_each(docs(spark)).collect()
    ids = Counter(r.doc_id for r in out)
    want = {i for (i, _, c), _ in brute_classes(rows()).items() if i is not None and i == c}
    assert set(ids) - {None} == want and all(n == 1 for i, n in ids.items() if i is not None)
    assert ids[None] == 2


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.classes(spark.createDataFrame([], DOCS)).collect() == []


def test_shared_runs_across_batches():
    import numpy as np
    import pyarrow as pa

    h = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5, 6, 6]
    node = [7, 8, 9, 1, 1, 2, 3, 4, 5, 5, 1, 2]
    late = [0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1]
    want = {(1, 7), (1, 8), (3, 1), (3, 2), (3, 3)}
    for step in range(1, len(h) + 1):
        parts = [pa.RecordBatch.from_arrays([pa.array(np.array(h[i : i + step], np.int64) << 8 | np.array(late[i : i + step], np.int64) << 7), pa.array(node[i : i + step], pa.int64())], ["h", "node"]) for i in range(0, len(h), step)]
        got = [x for b in jaccard_join._shared_runs(iter(parts)) for x in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
        assert sorted(got) == sorted(want), step


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_join_hot_equals_a_join(spark):
    data = [(1, i) for i in range(500)] + [(k, k) for k in range(2, 40)] + [(None, 7), (99, 3)]
    rows = spark.createDataFrame(data, "k long, at long")
    few = spark.createDataFrame([(k, 10 * k, sum(1 for x, _ in data if x == k)) for k in range(1, 41)], "k long, lo long, c long")
    got = join_hot(rows, few, ["k"])
    assert got.columns == ["k", "at", "lo"]
    assert Counter(map(tuple, got.collect())) == Counter((k, a, 10 * k) for k, a in data if k is not None and k <= 40)
    assert join_hot(rows, few.where("k < 0"), ["k"]).collect() == []


def test_substring_dedup_of_many_copies(spark):
    passage = prose(60, 70, 5000)
    data = [(i, f"{prose(700 + i, 6, 5000)} {passage} {prose(900 + i % 9, 8, 5000)}", None, None, None) for i in range(150)]
    found = substring_dedup.digests(substring_dedup.remove_repeats(spark.createDataFrame(data, DOCS))).collect()
    assert Counter(tuple(r) for r in found) == brute_cut(data)
