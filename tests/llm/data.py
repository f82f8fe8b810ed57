"""Small tables with nulls, empty and long texts, repeated rows and columns of clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows() -> list[tuple]:
    base, passage = prose(1, 200, 5000), prose(2, 60, 5000)
    texts = [
        base, base, base + " tail", "extra " + base, prose(3, 120, 5000), prose(4, 40) + " " + passage + " " + prose(5, 40), passage, prose(6, 30) + "\n" + passage.upper(),
        prose(7, 30) + "\n" + passage + "\t\n" + prose(8, 10), None, "", "   \n ", "one", "one two three four", "ONE two three four", "é" * 3000, prose(9, 4000), "a b " * 300, prose(10, 49), prose(10, 50),
        base.upper(), prose(1, 200, 5000) + " " + prose(11, 30), "x" * 5000, "naïve çedilla — “quotes” 中文 字 \x0b\x0c end",
    ]
    out = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (5, prose(12, 80), None, "s1", 1), (None, base, None, None, None), (None, None, None, "s2", None), (7, None, None, None, None)]


def docs(spark, some=None, clash: bool = True):
    df = spark.createDataFrame(rows() if some is None else some, DOCS)
    if clash:
        for c in ("score", "n", "size", "t", "h", "node", "groups", "kept", "copies", "predicted"):
            df = df.selectExpr("*", f"'c' AS `{c}`")
    return df
