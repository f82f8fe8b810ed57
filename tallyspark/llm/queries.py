"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, collocations, html_text, jaccard_join, kd_search, media, mixing, quality, repetition, rns_negatives, substring_dedup, token_counts, toxicity
from tallyspark.llm.shared import table


RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token that crosses a line's end goes to the line of its first character."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, "first")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when passages of 50 words that an earlier one has are cut."""
    return substring_dedup.digests(substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under links of similar sets of five-word shingles."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op5_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for each whose id is divisible by 100."""
    points = kd_search.quantised(table(spark, sf_dir, "embeddings"))
    return kd_search.top_k(points.where("vec_id % 100 = 0"), points)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes they decode to."""
    where = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), *where), *where).drop("ids")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    out = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), "quality"))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document stored as a GIF file, decoded again, with its frames' colour histograms."""
    return media.media_digests(media.text_media(table(spark, sf_dir, "documents")))


def op11_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures of each document, and whether the quality rules keep it."""
    return repetition.measured(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as the best of the own label, for anchors whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    rows = kd_search.quantised(table(spark, sf_dir, "embeddings").where("label IS NOT NULL"), 256, (label,))
    return rns_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_kd_search": op5_kd_search,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_text": op7_html_text,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality": op9_quality,
    "op10_gif_media": op10_gif_media,
    "op11_repetition_rules": op11_repetition_rules,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
        lows AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
        hit AS (SELECT doc_id, i FROM win JOIN lows USING (s) WHERE lo < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w WHERE len(ws) > 0),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t
                 FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS xs FROM w),
        n AS (SELECT doc_id, len(xs) AS n FROM s),
        x AS (SELECT doc_id, md5(unnest(xs)) AS h FROM s),
        shared AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
        y AS (SELECT * FROM x SEMI JOIN shared USING (h)),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM y a JOIN y b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
        linked AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
        both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
        reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id
        FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
    """,
    "op5_kd_search": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}

_COVERED = "\n".join(f"""        win{n} AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n})),
        in{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win{n}) WHERE c > 1),
        cov{n} AS (SELECT doc_id, count(*) AS words, sum(length(x)) AS chars FROM word JOIN in{n} USING (doc_id, k) GROUP BY doc_id),""" for n in repetition.LIMITS)
_WITHIN = " AND ".join(f"100 * chars_{n} <= {limit} * word_chars" for n, limit in repetition.LIMITS.items())

ORACLE_SQL["op11_repetition_rules"] = rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w WHERE len(ws) > 0),
{_COVERED}
        line AS (SELECT doc_id, x, sum(length(c)) AS chars, count(*) - 1 AS later FROM (
            SELECT doc_id, x, array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), '') AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w)) WHERE c <> '' GROUP BY doc_id, x),
        lines AS (SELECT doc_id, sum(later) AS dup, coalesce(sum(chars) FILTER (WHERE later > 0), 0) AS chars FROM line GROUP BY doc_id),
        total AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
            CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
        f AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov5.words, 0) AS BIGINT) AS n_repeat_words,
            CAST(coalesce(lines.chars, 0) AS BIGINT) AS line_chars, {", ".join(f"CAST(coalesce(cov{n}.chars, 0) AS BIGINT) AS chars_{n}" for n in repetition.LIMITS)}
            FROM total LEFT JOIN lines USING (doc_id) {" ".join(f"LEFT JOIN cov{n} USING (doc_id)" for n in repetition.LIMITS)})
        SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.BASE_LIMIT} * n_words AS base_failed,
            NOT (n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.BASE_LIMIT} * n_words) AND 100 * line_chars <= {repetition.LINE_LIMIT} * word_chars AND {_WITHIN} AS kept FROM f
    """
ORACLE_SQL["op12_collocations"] = r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
        w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
        one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY lang, x),
        two AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)) GROUP BY lang, x, y),
        three AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)) GROUP BY lang, x, y, z HAVING count(*) >= 10),
        inside AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY lang, x, y),
        parts AS (
            SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, l.f AS l1, r.f AS r1, NULL AS l2, NULL AS r2
            FROM two c JOIN one l ON l.lang = c.lang AND l.x = c.x JOIN one r ON r.lang = c.lang AND r.x = c.y LEFT JOIN inside i ON i.lang = c.lang AND i.x = c.x AND i.y = c.y
            WHERE c.f >= 10 AND NOT coalesce(100 * i.f >= 50 * c.f, FALSE)
            UNION ALL
            SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, l.f, yz.f, xy.f, r.f
            FROM three c JOIN one l ON l.lang = c.lang AND l.x = c.x JOIN two yz ON yz.lang = c.lang AND yz.x = c.y AND yz.y = c.z
            JOIN two xy ON xy.lang = c.lang AND xy.x = c.x AND xy.y = c.y JOIN one r ON r.lang = c.lang AND r.x = c.z),
        cuts AS (SELECT *, CAST(1000000 AS HUGEINT) * a * a // (CAST(l1 AS HUGEINT) * r1) AS s1, CAST(1000000 AS HUGEINT) * a * a // (CAST(l2 AS HUGEINT) * r2) AS s2 FROM parts),
        scored AS (SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r, CAST(CASE WHEN s2 < s1 THEN s2 ELSE s1 END AS BIGINT) AS score FROM cuts),
        total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM scored)
        SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """
ORACLE_SQL["op13_hard_negatives"] = """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
              FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
        n AS (SELECT p.anchor, p.other AS positive, p.score AS ps, s.other AS negative, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS k
              FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT anchor AS anchor_id, positive AS positive_id, CAST(k AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5
    """
