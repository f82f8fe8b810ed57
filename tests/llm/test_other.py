import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from html import unescape
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import gif, html_text, kd_search, media, mixing, quality, toxicity
from tallyspark.llm.labels import training
from tests.llm.data import DOCS, docs, prose, rows

# GIF


def written_file(payload):
    """A file of the same kind, written code by code."""
    palette = bytes(v for r in range(8) for g in range(8) for b in range(4) for v in (r * 255 // 7, g * 255 // 7, b * 85))
    out = b"GIF89a" + bytes([24, 0, 24, 0, 0xF7, 0, 0]) + palette
    for i in range(0, len(payload), 576):
        codes = compress(payload[i : i + 576], 8)
        out += bytes([0x21, 0xF9, 4, 0, 4, 0, 0, 0, 0x2C, 0, 0, 0, 0, 24, 0, 24, 0, 0, 8])
        out += b"".join(bytes([len(codes[k : k + 255])]) + codes[k : k + 255] for k in range(0, len(codes), 255)) + b"\0"
    return out + b"\x3b", palette


def test_text_media_gives_the_payload_back(spark):
    got = Counter(tuple(r) for r in media.media_digests(media.text_media(docs(spark))).collect())
    want = []
    for i, t, *_ in rows():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored, palette = written_file(payload)
        boxes = [0] * 64
        for v in payload:
            r, g, b = palette[3 * v : 3 * v + 3]
            boxes[r // 64 * 16 + g // 64 * 4 + b // 64] += 1
        n = len(payload) // 576
        said = f"frames={n};size=24x24;ms={40 * n};colours={','.join(map(str, boxes))}"
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), said))
    assert got == Counter(want)
    assert media.media_digests(media.text_media(spark.createDataFrame([], DOCS))).collect() == []


def test_every_text_goes_through_lzw_and_palettes(monkeypatch):
    seen, streams = Counter(), 0
    lzw, colours = gif.lzw, gif._colours

    def counted(raws, bits):
        nonlocal streams
        streams += len(raws)
        return lzw(raws, bits)

    monkeypatch.setattr(gif, "lzw", counted)
    monkeypatch.setattr(gif, "_colours", lambda p: (seen.update(["_colours"]), colours(p))[1])
    texts = [t for _, t, *_ in rows()]
    stored = list(media._stored(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])])))
    assert sum(b.num_rows for b in media._digests(iter(stored))) == len(texts)
    assert seen["_colours"] == len(texts) and streams == sum(max(1, -(-len((t or "").encode()) // 576)) for t in texts)


def test_streams_with_clear_codes_inside():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 256, int(n)).astype(np.uint8).tolist() for n in r.integers(1, 900, 9)]
    streams = [compress(p, 8, parts[i + 1 : i + 1 + i % 3]) for i, p in enumerate(parts)]
    want = [bytes(sum([p, *parts[i + 1 : i + 1 + i % 3]], [])) for i, p in enumerate(parts)]
    assert gif.lzw([*streams, b"", b"\0"], 8) == [*want, b"", b""]


def test_broken_files(spark):
    r = np.random.default_rng(2)
    (good,) = gif.encode([gif.pad(b"some text " * 200)])
    files = [bytes(np.where(r.random(len(good)) < share, r.integers(0, 256, len(good)), np.frombuffer(good, np.uint8)).astype(np.uint8)) for share in (0.001, 0.01, 0.1) for _ in range(20)]
    files += [good[:i] for i in range(0, len(good), 97)] + [b"GIF89a" + b"\xff" * 40, good.replace(b"\0\0\x08", b"\0\0\x0c", 1), b"", None]
    frames = [f for f in media._frames(iter([pa.RecordBatch.from_arrays([pa.array(range(len(files))), pa.array(files, pa.binary())], ["id", "media"])]))]
    assert sum(f.num_rows for f in frames) > 20


def pack(codes):
    """(code, width) pairs, lowest bits first."""
    acc = have = 0
    out = bytearray()
    for c, w in codes:
        acc |= c << have
        have += w
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8
    return bytes(out + bytes([acc] if have else []))


def compress(pixels, bits, more=()):
    """Plain LZW, as most writers do it; a clear code before each further part."""
    clear, table, width, out, word = 1 << bits, {bytes([i]): i for i in range(1 << bits)}, bits + 1, [(1 << bits, bits + 1)], b""
    following = clear + 2
    for p in pixels:
        if word + bytes([p]) in table:
            word += bytes([p])
            continue
        out.append((table[word], width))
        if following < 4096:
            table[word + bytes([p])] = following
            following += 1
            if following - 1 == 1 << width and width < 12:
                width += 1
        word = bytes([p])
    out.append((table[word], width))
    for part in more:
        following += 1
        if following - 1 == 1 << width and width < 12:
            width += 1
        out.append((clear, width))
        table, width, word, following = {bytes([i]): i for i in range(clear)}, bits + 1, b"", clear + 2
        for p in part:
            if word + bytes([p]) in table:
                word += bytes([p])
                continue
            out.append((table[word], width))
            table[word + bytes([p])] = following
            following += 1
            if following - 1 == 1 << width:
                width += 1
            word = bytes([p])
        out.append((table[word], width))
    following += 1
    if following - 1 == 1 << width and width < 12:
        width += 1
    return pack([*out, (clear + 1, width)])


@pytest.mark.parametrize("bits,n", [(2, 500), (4, 9000), (8, 30000)])
def test_lzw_decodes_growing_codes(bits, n):
    r = np.random.default_rng(bits)
    pixels = np.repeat(r.integers(0, 1 << bits, n), r.integers(1, 5, n))[:n].astype(np.uint8)
    assert gif.lzw([compress(pixels.tolist(), bits)] * 2, bits) == [pixels.tobytes()] * 2


def frame(pixels, w, h, left=0, top=0, disposal=0, clear=None, delay=5):
    codes = compress(pixels, 2)
    blocks = b"".join(bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)) + b"\0"
    control = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
    return control + b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0, 2]) + blocks


def test_disposal_and_transparency(spark):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + b"\2\0\2\0" + bytes([0x81, 0, 0]) + palette
    data = head + frame([1, 1, 1, 1], 2, 2) + frame([2, 3], 2, 1, top=1, disposal=2, clear=3) + frame([3], 1, 1, disposal=3, delay=7) + frame([2], 1, 1, left=1) + b"\x3b"
    got = media.gif_frames(spark.createDataFrame([(1, data), (2, b"no gif"), (3, None), (4, data[:60])], "doc_id long, media binary")).orderBy("id", "frame").collect()
    red, green, blue, black = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    shown = [[tuple(bytes(r.rgb)[i : i + 3]) for i in range(0, 12, 3)] for r in got if r.id == 1]
    assert shown == [[red] * 4, [red, red, green, red], [blue, red, black, black], [red, green, black, black]]
    assert [(r.start_ms, r.delay_ms) for r in got if r.id == 1] == [(0, 50), (50, 50), (100, 70), (170, 50)]
    assert got[0].histogram[3 * 16] == 4 and {r.id for r in got} <= {1, 4}


# Mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        unit = rest / (sum(weight[s] for s in sizes if s not in capped) or 1)
        new = {s for s in sizes if s not in capped and weight[s] * unit > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in capped else weight[s] * unit for s in sizes}
        capped |= new


def test_mix_meets_its_targets(spark):
    data = [(i, prose(i, 5 + i * 37 % 90), None, None if i % 11 == 0 else f"s{(i * i) % 7}", 0) for i in range(900)]
    df = spark.createDataFrame(data, DOCS)
    out = mixing.mixed_documents(df).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    assert len(out) == 900 and all(abs(taken[s] - want[s]) <= max(0.01 * want[s], 20) for s in want)
    again = mixing.mixed_documents(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in out)


def test_mix_of_odd_rows(spark):
    out = mixing.mixed_documents(docs(spark)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in rows())
    assert mixing.mixed_documents(spark.createDataFrame([], DOCS)).collect() == []
    mixed = mixing.repeated_documents(docs(spark, clash=False)).collect()
    assert {tuple(r) for r in mixed} <= set(rows()) and sum(len((r.text or "").split()) for r in mixed) == pytest.approx(sum(r.size * r.copies for r in out), rel=0.02)


@pytest.mark.parametrize("sizes", [[100, 60, 37, 23, 11], [1 + k % 4 for k in range(12)], [5000, 3, 2, 2, 1, 1], [7]])
@pytest.mark.parametrize("last", [False, True])
def test_rounding_keeps_expectations(sizes, last):
    n, total, chance = 1500, 0, 0.3
    for seed in range(n):
        group = pa.table({"row": pa.array(range(len(sizes)), pa.int64()), "size": pa.array(sizes, pa.int64()), "p": pa.array([chance] * len(sizes))})
        out = mixing._round_group(1, last, seed)(group)
        p = np.zeros(len(sizes))
        p[out["row"].to_numpy()] = out["p"].to_numpy()
        open_ = (p > 0) & (p < 1)
        assert open_.sum() <= (0 if last else 1)
        if not last:
            assert abs((p * sizes).sum() - chance * sum(sizes)) < 1e-6
        total = total + p
    assert np.abs(total / n - chance).max() < 0.06


def test_many_rows_alike(spark):
    df = spark.createDataFrame([(None, "a b c", "en", "s", 5)] * 700 + [(1, "a b", "en", "t", 3)] * 300, DOCS)
    out = mixing.mixed_documents(df).collect()
    taken = Counter()
    for r in out:
        taken[r.source] += r.copies * r.size
        assert abs(sum(1 for _ in out) - 1000) == 0 and 0 <= r.copies <= 3
    want = {r.source: r.target for r in out}
    assert all(abs(taken[s] - want[s]) < 3 for s in want), (taken, want)


# Exact search


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(700)] + [(i, [0.5] * 6) for i in range(700, 760)]
    vectors += [(1000, None), (1001, [1.0, None] * 3), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1004, [1.0, 2.0]), (1100, [2.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    points = kd_search.quantised(df)
    got = sorted(map(tuple, kd_search.top_k(points.where("vec_id % 100 = 0"), points, 10, shard=64, block=3).collect()))
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_a_traversal_prunes_where_few_components_count():
    """A tree of points that differ in two of their components scores few of them; one of points that spread over 64 scores all."""
    r = np.random.default_rng(2)
    for dim, part in ((2, 0.1), (64, 1.01)):
        points = np.zeros((4096, 64), np.int64)
        points[:, :dim] = r.normal(size=(4096, dim)) * 300
        tree = kd_search.Tree.grown(points, np.arange(4096))
        queries = points[:32]
        best = list(tree.search(queries.astype(np.float64), np.arange(32), 10, np.full(32, -np.inf)))
        want = [sorted(((int(s), i) for i, s in enumerate(points @ q) if i != k), key=lambda x: (-x[0], x[1]))[:10] for k, q in enumerate(queries)]
        assert best == want and tree.scored < part * 32 * 4096
        # the k-th score that another shard has found prunes further
        tree.scored = 0
        list(tree.search(queries.astype(np.float64), np.arange(32), 10, np.array([w[0][0] * 2.0 + 1 for w in want])))
        assert dim == 64 or tree.scored == 0


def test_top_k_of_few_and_none(spark):
    points = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5, 6])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in kd_search.top_k(points.where("vec_id = 0"), points).orderBy("rank").collect()] == [(0, 1, 2, 17), (0, 2, 1, 11)]
    assert kd_search.top_k(points.where("vec_id > 9"), points.where("vec_id > 9")).collect() == []


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>x()</script><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p>First  part
goes <b>on</b>.<p>Second&nbsp;one.</p><aside>Side</aside><form>Mail<input></form></article><section id="comments"><p>Nice!</p></section></main><div class="ad">Buy</div><footer>&copy; me</footer>"""


def test_blocks_of_a_page():
    assert html_text.main_text(PAGE) == "Head & line First part goes on. Second one."


def test_differencing_without_articles(spark):
    def page(body):
        return f"<body><div>Top line of the site</div><div>{body}</div><div>All rights are ours</div></body>"

    texts = {k: prose(k, 30) for k in range(6)}
    data = [(k, f"http://h.example/a/{k}", page(texts[k])) for k in range(6)] + [(10, "http://other.example/x", page("alone")), (11, None, "<p>no address"), (12, "http://h.example/z", None), (13, "", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(6):
        assert got[k] == (texts[k], len(texts[k]))
    assert got[10][0] == "Top line of the site alone All rights are ours" and got[11][0] == "no address" and got[12] == ("", 0) and got[13] == ("", 0)


def test_differencing_within_articles(spark):
    def page(k):
        return f"<main><article><p>{texts[k]}</p><div>Read also our letters</div><p>End {k} <span class='ad box'>Buy now</span></p></article></main>"

    texts = {k: prose(k, 30) for k in range(7)}
    copy = f"<article><p>{texts[6]}</p><p>{prose(50, 30)}</p><p>{prose(51, 30)}</p><p>"
    data = [(k, f"http://h.example/a/{k}", page(k)) for k in range(6)] + [(6, "http://c.example/1", copy + "old"), (7, "http://c.example/2", copy + "new")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[k] for k in range(6)] == [f"{texts[k]} End {k}" for k in range(6)]
    assert [got[k] for k in (6, 7)] == [f"{texts[6]} {prose(50, 30)} {prose(51, 30)} {x}" for x in ("old", "new")]


def test_a_copy_is_paired_with_the_other_neighbour(spark):
    pages = [f"<article><p>{prose(k, 30)}</p><p>Read also our letters</p></article>" for k in (0, 1, 1)]
    data = [(k, f"http://h.example/{u}", h) for k, (u, h) in enumerate(zip(("a", "b/1", "b/2"), pages, strict=True))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(1)).collect()}
    assert got[0] == prose(0, 30) and got[1] == prose(1, 30)


def test_copies_are_not_furniture(spark):
    html = "<body><p>" + "</p><p>".join(prose(k, 12) for k in range(4))
    data = [(k, f"https://h.example/{k}", html) for k in range(3)] * 2
    got = html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and {r.text for r in got} == {" ".join(prose(k, 12) for k in range(4))}


def test_short_texts_in_a_heavy_frame(spark):
    def page(k, nav):
        return f"<body>{nav}<div>{prose(90, 40)}</div><p>{prose(k, 6)}</p><div>{prose(91, 40)}</div>"

    data = [(10 * h + k, f"http://h{h}.example/{k}", page(k, f"<nav>{prose(92, 300)}</nav>" if h % 2 else "")) for h in range(4) for k in range(2 + h)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {i: prose(i % 10, 6) for i, *_ in data}


def test_common_subsequence():
    def longest(a, b):
        if not a or not b:
            return 0
        return 1 + longest(a[1:], b[1:]) if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    r = np.random.default_rng(0)
    for _ in range(40):
        a, b = r.integers(0, 4, 7).tolist(), r.integers(0, 4, 6).tolist()
        found = sorted(html_text.common(a, b))
        it = iter(b)
        assert all(a[i] in it for i in found) and len(found) == longest(a, b)


def test_common_subsequence_of_long_pages(monkeypatch):
    r = np.random.default_rng(1)
    pairs = [(r.integers(0, k, n).tolist(), r.integers(0, k, m).tolist()) for k, n, m in ((3, 40, 60), (2, 90, 7), (9, 64, 65), (1, 5, 30))]
    whole = [len(html_text.common(a, b)) for a, b in pairs]
    monkeypatch.setattr(html_text, "TABLE_BITS", 8)
    for (a, b), n in zip(pairs, whole, strict=True):
        found = sorted(html_text.common(a, b))
        it = iter(b)
        assert all(a[i] in it for i in found) and len(found) == n
    monkeypatch.undo()
    lines = list(range(30000))
    tracemalloc.start()
    assert html_text.common([-1, *lines, -2], [*lines, -3]) == set(range(1, 30001))
    assert len(html_text.common([*lines[15000:], *lines[:15000]], lines)) == 15000
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


FRAMES = [
    '<div class="has-sidebar">{}</div>', '<div class="right-sidebar"><div class="comment-form-off">{}</div></div>', '<form id="aspnet">{}</form>', '<div id="page" class="widget social">{}</div>', "<main>{}</main>",
]


@pytest.mark.parametrize("frame", FRAMES)
def test_wrappers_do_not_take_the_article(frame):
    body = '<article id="comment-policy"><h1>Title</h1><div class="entry-content share-enabled"><p class="notice-board">One two three.</p><section>Four <b>five</b>.</section></div>{}</article>'
    for furniture in ("", '<div class="share-buttons">Share</div>', '<section id="comments"><article class="comment"><p>A remark that is much longer than the article itself is, of many words</p></article></section>', '<div class="siteHeader">x</div>', "<aside>Side</aside>"):
        page = f"<body><nav>Menu</nav><div class='related'><article>Teaser</article></div>{frame.format(body.format(furniture))}<div class='ad-slot-1'>Buy</div></body>"
        assert html_text.main_text(page) == "Title One two three. Four five."


def test_marks_are_whole_names():
    marks = {x: html_text.mark_of(x) for x in "sidebar site-header sidebar-left cookieBanner ad_slot_2 has-sidebar notice-board comment-policy share-enabled headerless roads menu-item-7 no-ads".split()}
    assert [k for k, v in marks.items() if v] == ["sidebar", "site-header", "sidebar-left", "cookieBanner", "ad_slot_2", "menu-item-7"]


def plain_lines(html: str) -> tuple[list[str], set[int], bool]:
    """(lines, places of those that may go, whether there is an article) of a well-formed page, by the XML parser; for pages whose furniture has tags of its own or no marks at all."""
    lines, may_go = [], set()
    tree = ElementTree.fromstring(html)
    main = next(tree.iter("article"), None)

    def walk(e, inside, gone):
        gone = gone or e.tag in ("nav", "footer", "aside")
        inside = inside or e is main
        if e.tag in ("p", "div", "h1", "li") and not any(c.tag in ("p", "div", "li", "ul") for c in e):
            if text := " ".join("".join(e.itertext()).split()):
                if not gone and (inside or main is None) and e.tag != "h1":
                    may_go.add(len(lines))
                lines.append(("gone" if gone or not (inside or main is None) else "text", text))
            return
        for c in e:
            walk(c, inside, gone)

    walk(tree, False, False)
    return lines, may_go, main is not None


def plain_lcs(a, b) -> set[int]:
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            n[i][j] = 1 + n[i + 1][j + 1] if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_text(k: int, pages: list[tuple[str, str]]) -> str:
    """Main text of page k of a host's pages (path, html) in order."""
    found = [plain_lines(h) for _, h in pages]
    lines, may_go, article = found[k]
    sides = [[j for j in (k + s, k + 2 * s) if 0 <= j < len(pages)] for s in (-1, 1)]
    near = sides[0] + sides[1]
    text = [t for _, t in lines]
    gone = set(may_go)
    for j in near:
        gone &= plain_lcs(text, [t for _, t in found[j][0]])
    if len(near) == 1 and article:
        a, b = [i for i in sorted(may_go)], [found[near[0]][0][i][1] for i in sorted(found[near[0]][1])]
        head = next((i for i in range(min(len(a), len(b))) if text[a[i]] != b[i]), min(len(a), len(b)))
        tail = next((i for i in range(min(len(a), len(b))) if text[a[-1 - i]] != b[-1 - i]), min(len(a), len(b)))
        gone = set(a[:head]) | set(a[len(a) - tail :])
    if not near or (2 * len(gone) > len(may_go) if article else len(gone) == len(may_go)):
        gone = set()
    return " ".join(t for i, (kind, t) in enumerate(lines) if kind == "text" and i not in gone)


def test_extract_equals_brute_force(spark):
    """Planted furniture without marks, prose that neighbours share, copies, hosts of one to many pages, with and without articles; an XML parser and plain tables for what is expected."""
    r = random.Random(8)
    data, want, hosts, deleted, quoted = [], {}, {}, 0, 0
    for host in range(24):
        frame = [f"Read also our letters {host}", f"Subscribe to {host}"]
        article, n = host % 3 > 0, r.choice([1, 2, 3, 5, 8, 11])
        quote = prose(900 + host, 12)
        pages = []
        for k in range(n):
            body = [prose(1000 * host + 10 * k + j, 9) for j in range(r.randrange(4, 9))]
            if k % 4 < 2:
                body.insert(2, quote)  # two neighbours quote the same
            if r.random() < 0.15 and pages:
                body = list(pages[-1])
            pages.append(body)
        out = []
        for k, body in enumerate(pages):
            inner = [f"<p>{frame[0]}</p>", *(f"<p>{x}</p>" for x in body[:3]), f"<div>{frame[1]}</div>", *(f"<p>{x}</p>" for x in body[3:])]
            main = f"<h1>Title of all</h1>{''.join(inner)}"
            out.append((f"/a/{k:03d}", f"<html><body><nav><ul><li>Home</li></ul></nav><div>Top {host}</div>{f'<article>{main}</article>' if article else f'<div>{main}</div>'}<footer><p>Bottom</p></footer></body></html>"))
        for k, (path, html) in enumerate(out):
            i = len(data)
            data.append((i, f"https://h{host}.example{path}", html))
            want[i] = plain_text(k, out)
            deleted += n > 2 and frame[1] not in want[i]
            quoted += quote in want[i]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    for parts in (1, 7):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", 17 if parts == 7 else int(old))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r.page_id: r.text for r in html_text.extract(pages.repartition(parts)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == want
    assert deleted > 40 and quoted > 15 and html_text.extract(pages.where("false")).collect() == []


def test_given_articles_stay_whole(spark):
    """On the given pages the text is the article, as the XML-free reading of its paragraphs finds it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    strip = lambda h: " ".join(unescape(re.sub(r"<[^>]*>", " \x00 ", re.sub(r"</?(b|i|a|em)\b[^>]*>", "", re.search(r"<article>(.*?)</article>", h, re.S)[1]))).replace("\x00", " ").split())
    want = {r.page_id: strip(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert sum(got[i] != want[i] for i in want) == 0


def test_a_very_long_page(spark):
    body = "".join(f"<p>line {i} of many</p>" for i in range(30_000))
    data = [(k, f"http://h.example/{k}", f"<article><h1>T{k}</h1><p>frame</p>{body}<p>own {k}</p></article>") for k in range(2)] + [(2, "http://h.example/2", "<article><p>x</p><p>y</p></article>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[0].startswith("T0 frame line 0 of many") and got[0].endswith("line 29999 of many own 0") and len(got[1]) == len(got[0]) and got[2] == "x y"


def test_partners_do_not_depend_on_partitions(spark):
    data = [(i, f"http://h{i % 3}.example/{i % 7}/{i}", f"<body><p>page {i}</p><p>host {i % 3}</p>") for i in range(60)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    one = sorted(map(tuple, html_text.extract(df.repartition(1)).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        two = sorted(map(tuple, html_text.extract(df.repartition(9)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == two and {t for *_, t, _ in one} == {f"page {i}" for i in range(60)}


# Classifiers


def labelled(spark, mark):
    texts = []
    for i in range(600):
        t = prose(i, 40).split()
        bad = i % 3 == 0
        if bad:
            t[i % 40] = mark(i)
        texts.append((i, " ".join(t), None, None, 0, int(bad)))
    d = spark.createDataFrame([t[:5] for t in texts], DOCS)
    return d, spark.createDataFrame([(t[0], 1 - t[5], t[5]) for t in texts], "doc_id long, quality int, toxic int"), {t[0]: t[5] for t in texts}


def near(a, b):
    """Edits between two words, and the fewest between a beginning of a and b."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1], d[:, -1].min()


def brute_evidence(text, words, stems, clean):
    tokens = [(m.start(), m.group()) for m in re.finditer(r"[^\W_]+(?:[@$*!][^\W_]+)*", text.lower())]
    spans, marks = [], {'"': '"', "“": "”", "«": "»", "„": "“"}
    for line in re.finditer(r"[^\n]+", text):
        i = line.start()
        while i < line.end():
            j = text.find(marks[text[i]], i + 1, line.end()) if text[i] in marks else -1
            spans += [(i, j)] if j >= 0 else []
            i = j + 1 if j >= 0 else i + 1
    found = []
    for k, (at, w) in enumerate(tokens):
        if w in words or any(w.startswith(s) for s in stems):
            weight = 1.0
        elif len(w) >= 4 and w not in clean and (any(len(t) >= 5 and abs(len(t) - len(w)) < 2 and near(w, t)[0] <= 1 for t in words) or any(len(w) >= len(t) >= 5 and near(w, t)[1] <= 1 for t in stems)):
            weight = 0.7
        else:
            continue
        around = [x for _, x in tokens[max(0, k - 8) : k + 9]]
        if any(a <= at <= b for a, b in spans) or any(x in toxicity.REPORTING for _, x in tokens[max(0, k - 3) : k]):
            weight *= 0.25
        elif any(x in toxicity.AIMED for x in around):
            weight *= 1.25
        found.append((k, weight))
    return max((sum(w for j, w in found if k - 16 <= j <= k) for k, _ in found), default=0.0), sum(w for _, w in found)


def test_toxicity_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs_, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    parts, w = toxicity.train(docs_, labels)
    words, stems, clean = map(set, parts)
    stems = sorted(stems)[:12]
    model = (tuple(sorted(words)[:25]), tuple(stems), tuple(clean)), w
    got = {r.doc_id: (r.heaviest, r.total) for r in toxicity.score(docs_, model).collect()}
    texts = {r.doc_id: r.text for r in docs_.collect()}
    some = sorted(texts, key=lambda i: (-got[i][1], len(texts[i])))
    for i in some[:25] + [x for x in some if len(texts[x]) < 700][-25:]:
        assert got[i] == pytest.approx(brute_evidence(texts[i], set(model[0][0]), stems, clean)), i


def test_automaton_equals_edit_distance():
    r = np.random.default_rng(5)
    terms = ["idiot", "moron", "stupid", "pathetic", "scum"]
    lexicon = toxicity.Lexicon(terms, ["lowei"])
    for _ in range(3000):
        w = list(terms[r.integers(5)])
        for _ in range(r.integers(0, 3)):
            k = r.integers(4)
            i = r.integers(len(w))
            if k == 0:
                w[i] = "abcdeiost"[r.integers(9)]
            elif k == 1:
                w.insert(i, "abcdeiost"[r.integers(9)])
            elif k == 2 and len(w) > 3:
                w.pop(i)
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        w = "".join(w)
        want = w in terms or any(len(t) >= 5 and near(w, t)[0] <= 1 for t in terms)
        assert bool(lexicon.look(w)) == want, w
    assert lexicon.look("loweischaft") == ("lowei", 0) and lexicon.look("lowe") is None


def test_misspellings_of_stems():
    lexicon = toxicity.Lexicon(["zurbelix", "zurbelon"], ["zurbel"], {"zurblings"})
    for w in ("zubrelix", "zubreling", "zurelanto", "urbelanto", "xzurbelanto", "zurbxelanto", "zurbalanto", "zurbe1anto", "zurbleanto", "zurbelxi"):
        assert lexicon.look(w), w
    assert lexicon.look("zurbe") is None and lexicon.look("zurblings") is None and lexicon.look("zarbalanto") is None and lexicon.look("arbelanto") is None


def test_stems_keep_words_and_given_insults(spark):
    endings = ("ix", "on", "ast", "und", "ori", "ume")
    d, labels, _ = labelled(spark, lambda i: "zurbel" + endings[i // 3 % 6])
    parts, _ = toxicity.train(d, labels)
    lexicon = toxicity.Lexicon(*parts)
    assert any("zurbelix".startswith(s) for s in parts[1]) and lexicon.look("zubrelix") and lexicon.look("zubrelund")
    d, labels, _ = labelled(spark, lambda i: "idio" + ("ten", "tic", "tum", "ma", "pat", "lex")[i // 3 % 6])
    assert toxicity.Lexicon(*toxicity.train(d, labels)[0]).look("idoit")


def test_context_tells_quotation_from_abuse():
    lexicon = toxicity.Lexicon(["idiot"], [])
    abuse = toxicity.evidence("you are an idiot and a fool", lexicon)
    quote = toxicity.evidence('they wrote "idiot" on the wall', lexicon)
    assert abuse[1] > 1 > 0.5 > quote[1] > 0 and toxicity.evidence("such an iidot", lexicon)[1] > 0.5


def test_quotations_of_any_length_and_letters():
    lexicon = toxicity.Lexicon(["idiot"], [])
    for text in ('a "' + "word " * 200 + 'idiot" end', 'İ a "plain idiot" end', 'an «open “plain idiot” end', '"" and "plain idiot" end'):
        assert toxicity.evidence(text, lexicon)[1] == 0.25, text
    for text in ('one "thing" idiot "more" end', 'a "open idiot\n" end', "a “ idiot end", 'İ a "plain" idiot end'):
        assert toxicity.evidence(text, lexicon)[1] == 1, text
    assert toxicity.quoted("“" * 200000) == [] and toxicity.evidence("İdiot", lexicon)[1] == 1


def test_many_terms_are_not_cut(spark):
    bad = np.array([f"bad{k}zz{k % 10}" for k in range(2500)])
    texts = [(i, " ".join(np.random.default_rng(i).permutation(bad)) if i % 2 else f"{prose(i, 20)} loser", None, None, 0) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    words = toxicity.train(spark.createDataFrame(texts, DOCS), labels)[0][0]
    assert "loser" not in words and "idiot" in words and len(words) >= 2500


def test_toxicity_learns_and_rejects(spark):
    d, labels, truth = labelled(spark, lambda i: ("idiot", "zurbelix", "zurbelon", "st00pid", "moron!!")[i % 5] if i % 5 != 3 else "stupod")
    model = toxicity.train(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.reject(d, model).collect()}
    assert kept == {i for i in truth if not got[i].predicted}


def test_toxicity_of_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark), empty)
    out = toxicity.score(docs(spark), model).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in rows()) and all(0 <= r.score < 0.5 for r in out)
    assert toxicity.score(spark.createDataFrame([], DOCS), model).collect() == []
    assert toxicity.reject(docs(spark), model).count() == len(rows())


def test_quality_learns(spark):
    d, labels, truth = labelled(spark, lambda i: "### $$$ ###")
    got = {r.doc_id: r for r in quality.score(d, quality.train(d, labels)).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (1 - truth[i]) for i in held) >= 0.97 * len(held)


def test_quality_equals_a_plain_model():
    """FTRL place by place with Python numbers, and scores as sums over words and their neighbours."""
    texts = [prose(i, 5 + i % 9, 30) + (" Ab9 !! ab AB" if i % 3 else "") for i in range(40)] + ["", "x"]
    ys = [i % 3 > 0 for i in range(len(texts))]
    column = pa.array(texts)
    found = [f for _, _, words in quality.slices(column) for f in quality.features(words)]
    rows_ = pa.table({"text": column, "y": pa.array([int(y) for y in ys]), "order": pa.array(range(len(texts)))})
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for epoch in range(quality.EPOCHS):
        for k in range(len(texts)) if epoch % 2 == 0 else reversed(range(len(texts))):
            pairs = list(zip(found[k][0].tolist(), found[k][1].tolist(), strict=True))
            old = {i: (weight(i), n[i]) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(old[i][0] * x for i, x in pairs)))
            for i, x in pairs:
                g = (p - ys[k]) * x
                z[i] += g - (math.sqrt(old[i][1] + g * g) - math.sqrt(old[i][1])) / quality.ALPHA * old[i][0]
                n[i] += g * g
    out = quality._train(None, rows_)
    got = dict(zip(out["place"].to_pylist(), out["weight"].to_pylist(), strict=True))
    assert {i for i in z if weight(i)} == set(got) and all(got[i] == pytest.approx(weight(i) * len(texts)) for i in got)
    (at, x), words = found[3], texts[3].split()
    norm = lambda c: sorted(math.sqrt(v) / math.sqrt(sum(c.values())) for v in c.values())
    singles, doubles = norm(Counter(words)), norm(Counter(zip(words, words[1:])))
    assert sorted(x[1 : 1 + len(singles)]) == pytest.approx(singles) and sorted(x[1 + len(singles) : 1 + len(singles) + len(doubles)]) == pytest.approx(doubles)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    w = quality.train(docs(spark), labels)
    out = quality.score(docs(spark), w).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in rows()) and all(0 <= r.score <= 1 for r in out)
    none = quality.train(docs(spark), labels.where("doc_id < 0"))
    assert not none.any() and quality.score(spark.createDataFrame([], DOCS), none).collect() == []


def test_training_rows_are_never_held_out(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(i, "x", None, None, 0) for i in range(200)], DOCS)
    ids = {r.doc_id for r in training(d, labels, "quality").collect()}
    assert ids == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 and i != 1}
    assert 20 < training(d, labels, "quality", most=60).count() < 110
