from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from tallyspark.llm import bpe, collocations, html_text, jaccard_join, media, mixing, quality, queries, repetition, substring_dedup, token_counts, toxicity
from tallyspark.llm.shared import table
from tests.llm.data import docs
from tests.llm.test_dedup import brute_classes, brute_cut

DIR = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, DIR, "documents")  # noqa: F811
    rows = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "byte_bpe"]
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, DIR)
    assert clean.columns == docs.columns
    found = clean.collect()
    assert 0.8 * len(rows) < len(found) < len(rows) and {tuple(r) for r in found} <= {tuple(r) for r in rows}
    single = steps["near_duplicates"](spark, clean, DIR)
    kept = single.collect()
    assert {r.doc_id for r in kept} == {c for _, _, c in brute_classes([tuple(r) for r in found])} and len(kept) == len({r.doc_id for r in kept})
    cut = steps["substring_dedup"](spark, single, DIR)
    out = {r.doc_id: r for r in cut.collect()}
    want = {i: (n - gone) for i, n, gone, _ in brute_cut([tuple(r) for r in kept])}
    assert cut.columns == docs.columns and {i: len(r.text.split()) for i, r in out.items()} == want
    assert all(r.n_chars == len(r.text) for r in out.values())
    mixed = steps["mixing"](spark, cut, DIR)
    taken = mixed.collect()
    assert mixed.columns == docs.columns and all(tuple(r) == tuple(out[r.doc_id]) for r in taken)
    ids = steps["byte_bpe"](spark, mixed, DIR)
    assert ids.count() == len(taken)
    texts = {(r.doc_id, bytes(r.bytes).decode()) for r in bpe.decode(ids, P.path(queries.RANKS), P.PATTERN).collect()}
    assert texts == {(r.doc_id, r.text) for r in taken}


CLASHES = ("toxic_total", "_n", "_copies", "rows", "row", "copies", "copy", "id", "key", "t", "m", "groups", "kept", "n_words", "n_removed", "found", "score", "component_id", "_e")


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    """Nulls, empty and long texts, repeated rows and ids, and columns of clashing names; then no rows at all."""
    name, step = corpus_pipeline.STAGES[stage]
    odd = docs(spark, clash=False)
    clashing = odd.selectExpr("*", *(f"'{c}' AS `{c}`" for c in CLASHES))
    plain, out = step(spark, odd, DIR), step(spark, clashing, DIR)
    if name == "byte_bpe":
        assert out.count() == odd.count()
    else:
        assert out.columns == clashing.columns and all(r[c] == c for r in out.collect() for c in CLASHES)
        assert Counter(map(tuple, out.select(*odd.columns).collect())) == Counter(map(tuple, plain.collect()))
    none = step(spark, odd.where("false"), DIR)
    assert none.collect() == [] and none.columns == plain.columns


NAMES = ("a b", "a,b:c", "a.b", "tick`s", "text.x", "`", "doc_id.y", "ümlaut", "x<y>")


def with_names(df):
    return df.selectExpr("*", *(f"concat('c', doc_id) AS `{c.replace('`', '``')}`" for c in NAMES))


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_column_names(spark, stage):
    name, step = corpus_pipeline.STAGES[stage]
    plain, named_ = docs(spark, clash=False), with_names(docs(spark, clash=False))
    one, two = step(spark, plain, DIR), step(spark, named_, DIR)
    if name != "byte_bpe":
        assert two.columns == named_.columns
        assert all(r[c] == (None if r.doc_id is None else f"c{r.doc_id}") for r in two.collect() for c in NAMES)
    assert Counter(map(str, two.select(*plain.columns if name != "byte_bpe" else one.columns).collect())) == Counter(map(str, one.collect()))


@pytest.mark.parametrize(
    "operator", ["section_tokens", "score_toxicity", "remove_repeats", "classes", "extract", "encode", "mix", "score_quality", "text_media", "measured", "collocations"],
)
def test_operators_on_odd_column_names(spark, operator):
    where = P.path(queries.RANKS), P.PATTERN
    labels = table(spark, DIR, "labels")
    run = {
        "section_tokens": lambda d: token_counts.section_tokens(d, *where, "first"), "score_toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)), "remove_repeats": substring_dedup.remove_repeats,
        "classes": jaccard_join.classes, "extract": lambda d: html_text.extract(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})), "encode": lambda d: bpe.encode(d, *where),
        "mix": lambda d: mixing.mix(d, "n_chars"), "score_quality": lambda d: quality.score(d, quality.train(d, labels, "quality")), "text_media": media.text_media, "measured": repetition.measured, "collocations": collocations.collocations,
    }[operator]
    plain = docs(spark, clash=False)
    one, two = run(plain), run(with_names(plain))
    assert set(one.columns) <= set(two.columns) and two.select(*one.columns).collect()


def test_run_is_repeatable(spark):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, DIR).select("doc_id", "ids_sha256").collect())) for _ in range(2))
    assert one == two and one


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    out = queries.QUERIES[name](spark, DIR)
    if name in ("op5_kd_search", "op12_collocations", "op13_hard_negatives"):
        assert out.count() > 0
    else:
        key = out.columns[0]
        assert out.select(key).distinct().count() == table(spark, DIR, "pages" if key == "page_id" else "documents").where("text <> ''" if name.startswith("op1_") else "true").count()
