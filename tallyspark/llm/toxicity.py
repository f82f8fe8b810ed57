"""Toxicity: a lexicon trie intersected with Levenshtein automata, scored over context windows.

1. Lexicon. Terms are whole words or stems (a stem matches every word that begins with it). Common insults are given;
   more are learned from the bounded sample of labels.training(): words and beginnings of words that
   occur in many toxic documents and in next to no clean one (of near copies in the sample, few count).
2. Matching. A word within one edit (insertion, deletion, substitution, neighbours swapped) of a whole-word
   term of EDIT_FROM letters or more is a misspelling, and so is a word at least as long as such a stem whose beginning is
   within one edit of it. The word's Levenshtein automaton and the trie are walked together, state by state and node by node, so that
   a branch is left as soon as no term below can be near. A process remembers the words it has looked up. Near words that the sample's clean documents use are words of their own and don't count.
3. Windows. Each hit weighs by its exactness and by its context of a few words: a hit inside quotation marks or
   after a word of reporting is quotation and weighs little; a hit that is aimed at someone (you, your, ...) or stands near
   another weighs full. A document's evidence is its heaviest window and its total.
4. Score. A logistic curve over that evidence, fitted on the sample.
"""

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.labels import TRAIN_ROWS, held_out, training
from tallyspark.llm.shared import discard, trimmed, written
from tallyspark.llm.words import runs, slices

# Insults known without any labels, words of reporting, words that aim at someone.
INSULTS = """
idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile dumbass jerk bastard asshole bitch
retard scumbag crap cretin dimwit
""".split()
REPORTING = set("""
said says say called calls quote quoted quotes wrote writes word words term insult slur reported alleged
sagte sagt nannte nennt zitat zitiert zitierte schrieb schreibt wort wörter begriff beleidigung angeblich
dit disait appelé appelle citation cite cité écrit écrivait mot mots terme insulte aurait
dijo dice decía llamó llama cita citó escribió escribe palabra palabras término insulto presunto
""".split())
AIMED = set("""
you your youre yourself he she they them him her u ur
du dich dir dein deine deinen ihr euch euer
tu toi ton vous votre vos
tú ti usted ustedes vosotros
""".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}

MARK = re.compile(f"[{''.join({*QUOTES, *QUOTES.values()})}\\n]")
TOKEN = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
EDIT_FROM, WINDOW = 5, 8
LEAST_DOCS, LEAST_PART, LEAST_ODDS, MOST_CLEAN = 6, 0.02, 3.2, 0.1
STEMS = range(4, 9)
#: Words that a process remembers at most, and the letters of those: 20 MB or so.
MEMO, MEMO_LETTERS = 150_000, 40


class Trie:
    """Terms by letters. A node: (children, term that ends here or None, stem that ends here or None)."""

    def __init__(self, words: list[str], stems: list[str]):
        self.root: list = [{}, None, None]
        for kind, terms in ((1, words), (2, stems)):
            for term in terms:
                node = self.root
                for c in term:
                    node = node[0].setdefault(c, [{}, None, None])
                node[kind] = term

    def exact(self, word: str) -> str | None:
        """The whole word as a term, or the shortest stem it begins with."""
        node = self.root
        for c in word:
            node = node[0].get(c)
            if node is None:
                return None
            if node[2]:
                return node[2]
        return node[1]


class Lexicon:
    """Words, stems, and near words that don't count. Only one edit is looked for."""

    def __init__(self, words: Iterable[str], stems: Iterable[str], clean: Iterable[str] = ()):
        self.words, self.stems, self.clean = list(words), list(stems), set(clean)
        self.trie = Trie(self.words, self.stems)
        self.loose = Trie(*([w for w in terms if len(w) >= EDIT_FROM] for terms in (self.words, self.stems)))
        self.known: set[str] = set()  # words that are no hits
        self.found: dict[str, tuple[str, int]] = {}

    def near(self, word: str) -> str | None:
        """A loose term within one edit of a word, or a stem within one of its beginning.

        The states of the automaton are (letters of the word read, edits made). Those without an edit follow one path of
        the trie, the word's own; from each of its nodes the four edits lead to states with one edit, which follow
        their path to its end.
        """
        n, node = len(word), self.loose.root
        for i in range(n + 1):
            children = node[0]
            here = word[i] if i < n else ""
            after = word[i + 1] if i + 1 < n else ""
            if here and (not after or after in children) and (term := self._rest(node, word, i + 1)):  # one letter too many
                return term
            for c, child in children.items():
                below = child[0]
                if (not here or here in below or child[2]) and (term := self._rest(child, word, i)):  # one too few
                    return term
                if here and c != here and (not after or after in below or child[2]) and (term := self._rest(child, word, i + 1)):  # another
                    return term
            if after and after in children and here in children[after][0] and (term := self._rest(children[after][0][here], word, i + 2)):  # swapped
                return term
            if not here or here not in children:
                return None
            node = children[here]
        return None

    @staticmethod
    def _rest(node: list, word: str, i: int) -> str | None:
        """The term that ends on the path of word[i:] from a node: a word at the path's end, or a stem on it."""
        n = len(word)
        while True:
            if node[2] and n >= len(node[2]):
                return node[2]
            if i == n:
                return node[1]
            node = node[0].get(word[i])
            if node is None:
                return None
            i += 1

    def look(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of a lower-case word, or None."""
        term = self.trie.exact(word)
        if term:
            return term, 0
        if len(word) >= EDIT_FROM - 1 and word not in self.clean:
            term = self.near(word)
            return (term, 1) if term else None
        return None

    def hits(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """Those of some words that are terms or near them."""
        out = {}
        if len(self.known) + len(self.found) > MEMO:
            self.known.clear()
            self.found.clear()
        for w in words - self.known:
            found = self.found.get(w) or self.look(w)
            if found:
                out[w] = found
                if len(w) <= MEMO_LETTERS:
                    self.found[w] = found
            elif len(w) <= MEMO_LETTERS:
                self.known.add(w)
        return out


@lru_cache(maxsize=2)
def lexicon(words: tuple[str, ...], stems: tuple[str, ...], clean: tuple[str, ...]) -> Lexicon:
    """One lexicon a process, with what it remembers of words."""
    return Lexicon(words, stems, clean)


def quoted(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks within a line, the marks included. A mark goes with the next one in its line that closes it."""
    spans: list[tuple[int, int]] = []
    marks: list[tuple[int, str]] = []
    for m in MARK.finditer(text + "\n"):
        if m.group() != "\n":
            marks.append((m.start(), m.group()))
            continue
        closer: dict[str, int] = {}
        closes = [-1] * len(marks)  # the next mark that closes each
        for i in range(len(marks) - 1, -1, -1):
            closes[i] = closer.get(QUOTES.get(marks[i][1], ""), -1)
            closer[marks[i][1]] = i
        start = 0
        while start < len(marks):
            if closes[start] < 0:
                start += 1
                continue
            spans.append((marks[start][0], marks[closes[start]][0] + 1))
            start = closes[start] + 1
        marks.clear()
    return spans


def lowered(text: str) -> str:
    """Lower-case text of the same length; letters whose lower case is longer give its first character."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower()[:1] for c in text)


def evidence(text: str, lexicon: Lexicon) -> tuple[float, float, list[str]]:
    """(heaviest window, total weight, misspelt words with their terms) of a text."""
    lower = lowered(text)
    words = TOKEN.findall(lower)
    hits = lexicon.hits(set(words))
    if not hits:
        return 0.0, 0.0, []
    spans = quoted(text) if any(a in text for a in QUOTES) else []
    starts = [a for a, _ in spans]
    found = []  # (position among words, weight)
    for at, m in enumerate(TOKEN.finditer(lower)):
        f = hits.get(m.group())
        if not f:
            continue
        near = words[max(0, at - WINDOW) : at + WINDOW + 1]
        weight = 1.0 if f[1] == 0 else 0.7
        if (k := bisect_right(starts, m.start())) and m.start() < spans[k - 1][1] or any(w in REPORTING for w in words[max(0, at - 3) : at]):
            weight *= 0.25
        elif any(w in AIMED for w in near):
            weight *= 1.25
        found.append((at, weight))
    total, heaviest, first = 0.0, 0.0, 0
    window = 0.0
    for at, weight in found:
        window += weight
        while found[first][0] < at - 2 * WINDOW:
            window -= found[first][1]
            first += 1
        heaviest, total = max(heaviest, window), total + weight
    return heaviest, total, [f"{w} {f[0]}" for w, f in hits.items() if f[1]]


def inputs(heaviest: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What the logistic curve sees."""
    return np.stack([np.ones_like(total), np.minimum(total, 1.0), np.log1p(total), np.log1p(heaviest)], 1)


#: The curve without labels: one full hit is enough.
PRIOR = np.array([-4.0, 5.0, 1.0, 1.0])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the prior."""
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) + 0.3 * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, toxic, clean): documents of a batch with each word, and (with *) with each beginning."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for w in TOKEN.findall(lowered(text)) if len(w) > 3 and not w.isdigit()}
            found = words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}
            (toxic if y else clean).update(found)
        if len(toxic) + len(clean) > 300_000:
            yield _counts(toxic, clean)
    yield _counts(toxic, clean)


def _counts(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    terms = list(toxic.keys() | clean.keys())
    out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])
    toxic.clear()
    clean.clear()
    return out


def pick_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """(words, stems) of counted terms. Of a stem and its longer forms the longest that keeps nearly all of its documents stays."""
    odds = lambda a, b: np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    strong = {t: a for t, a, b in counts if a >= max(LEAST_DOCS, LEAST_PART * n_toxic) and odds(a, b) >= LEAST_ODDS and b <= MOST_CLEAN * a}
    longer_by_one = defaultdict(list)
    for t in strong:
        longer_by_one[t.rstrip("*")[:-1]].append(t)
    words, stems = set(), set()
    for term in sorted(strong, key=len):
        if not term.endswith("*"):
            continue
        stem = term[:-1]
        if any(stem[:k] in stems for k in range(1, len(stem) + 1)) or any(stem[:k] + "*" in strong for k in range(STEMS[0], len(stem))):
            continue
        longer = stem
        while True:
            nexts = [t for t in longer_by_one.get(longer, ()) if strong[t] >= 0.9 * strong[term]]
            if not nexts:
                break
            best = max(nexts, key=lambda t: (strong[t], t))
            longer = best.rstrip("*")
            if not best.endswith("*") or longer in strong:
                break
        if longer in strong and strong[longer] >= 0.9 * strong[term]:
            words.add(longer)
        else:
            stems.add(longer)
    words |= {t for t in strong if not t.endswith("*")}  # those under a stem for their misspellings
    return sorted(words), sorted(stems)


def _evidence_of(parts: Broadcast) -> Callable[[Column], Column]:
    """A column function: struct(heaviest, total) of a text. Rows stay in the JVM; only texts go to Python."""

    @F.arrow_udf("heaviest double, total double")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scored(batches)

    @trimmed
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = lexicon(*parts.value)
        for texts in batches:
            rows = [evidence(t, known)[:2] if t else (0.0, 0.0) for i in range(0, len(texts), 256) for t in texts.slice(i, 256).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in (0, 1)], names=["heaviest", "total"])

    return found


def _labelled(parts: Broadcast):
    """Rows (y, heaviest, total, misspelt) of rows (text, y)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon(*parts.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                a, b, c = zip(*(evidence(t, known) for t in part.column(0).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(c, pa.list_(pa.string()))], ["y", "heaviest", "total", "misspelt"])

    return go


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's smallest hash of five words, which near copies mostly share; shorter texts' hash of all words."""
    for batch in batches:
        for a, b, words in slices(batch.column(1)):
            h = words.hashes()
            every = runs(h, 5)
            least = []
            for i, j in zip(words.first[:-1], words.first[1:], strict=True):
                own = every[i : j - 4] if j - i >= 5 else runs(h[i:j], int(j - i))
                least.append(int(own.min()) if j > i else 0)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(np.array(least, np.uint64).view(np.int64))], ["doc_id", "text", "y", "sign"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> tuple[tuple, np.ndarray]:
    """(lexicon's parts, weights of the curve). Without labelled rows: the given insults and the prior curve.

    What comes to the driver is bounded: terms of LEAST_PART of the sample's toxic documents each, and numbers and misspellings of the sample's documents.
    """
    sample = written(training(docs, labels, label, most).select("doc_id", "text", "y").mapInArrow(_signed, "doc_id long, text string, y int, sign long").groupBy("sign", "y").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.text", "y"))  # of near copies the smallest id
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = sample.select("text", "y").mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    given = F.col("term").isin(INSULTS) & (F.col("b") > 0)
    strong = (F.col("a") >= max(LEAST_DOCS, LEAST_PART * n_toxic)) & (F.col("b") <= MOST_CLEAN * F.col("a"))
    found = [(r["term"], r["a"], r["b"]) for r in counts.where(strong | given).orderBy(F.desc("a"), "term").collect()]
    words, stems = pick_terms(found, n_toxic, n_clean)
    used = {t for t, a, b in found if b > max(a, 1)}
    parts = (tuple(sorted({*words, *(w for w in INSULTS if w not in used)})), tuple(stems), ())
    spark = docs.sparkSession

    def hits(parts: tuple) -> list:
        return sample.select("text", "y").mapInArrow(_labelled(spark.sparkContext.broadcast(parts)), "y int, heaviest double, total double, misspelt array<string>").where("total > 0").collect()

    seen = {1: Counter(), 0: Counter()}
    for r in hits(parts):
        seen[r["y"]].update(r["misspelt"])
    own = {x for x, n in seen[0].items() if n / max(n_clean, 1) > 0.1 * seen[1][x] / max(n_toxic, 1)}
    parts = (*parts[:2], tuple(sorted({x.split(" ")[0] for x in own})))
    again = hits(parts)
    y = np.array([r["y"] for r in again] + [1] * (n_toxic - sum(r["y"] for r in again)) + [0] * (n_clean - sum(1 - r["y"] for r in again)), float)
    h, t = (np.array([r[c] for r in again] + [0.0] * (len(y) - len(again))) for c in ("heaviest", "total"))
    discard(sample)
    return parts, _fit(inputs(h, t), y)


def _probability(w: np.ndarray, found: Column) -> Column:
    total, heaviest = found["total"], found["heaviest"]
    dot = F.lit(float(w[0])) + F.lit(float(w[1])) * F.least(total, F.lit(1.0)) + F.lit(float(w[2])) * F.log1p(total) + F.lit(float(w[3])) * F.log1p(heaviest)
    return 1 / (1 + F.exp(-dot))


def score(docs: DataFrame, model: tuple[tuple, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted, heaviest, total) of every row, from its whole text alone.

    Null and empty texts have no hits and get the curve's lowest score. Repeated rows score alike; ids aren't used.
    """
    parts, w = model
    found = _evidence_of(docs.sparkSession.sparkContext.broadcast(parts))
    out = docs.select("doc_id", held_out().alias("held_out"), found(F.col("text").cast("string")).alias("found")).withColumn("score", _probability(w, F.col("found")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "found.heaviest", "found.total")


def reject(docs: DataFrame, model: tuple[tuple, np.ndarray], cut: float = 0.5) -> DataFrame:
    """The rows whose score is below `cut`, with all their columns, whatever those are called. Null and empty texts stay."""
    parts, w = model
    found = _evidence_of(docs.sparkSession.sparkContext.broadcast(parts))
    return docs.where(_probability(w, found(F.col("text").cast("string"))) < cut)
