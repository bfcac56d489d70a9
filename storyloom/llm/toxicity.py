"""Toxicity scores from a learned lexicon, matched with Levenshtein automata.

1. On half of a bounded sample of labelled rows Spark counts in how many toxic and clean
   texts each word and each word beginning (``stem*``) occurs; those that mark toxic texts
   become the lexicon.  Near copies in the sample count once.
2. The lexicon, with the words observed below its stems, is a trie.  A word that is no entry
   is run through the intersection of the trie with the word's Levenshtein automaton: the
   automaton's state is the row of edit distances, and a branch dies when all of it exceeds
   the limit, so misspelled terms are found without trying every entry.
3. Each match is judged in a window of words: inside quotation marks it counts as quoted,
   next to other matches as clustered.  A logistic regression over these counts, fitted on
   the other half of the sample, turns them into a score.

The bound of the sample (``rows``) is a parameter, and bounds the lexicon: every term that
passes the test is kept.  Words of fewer than five letters are found as written only: one edit
makes too many other words of them.  Scoring covers every whole text, and language, source and id are
not inputs.

Defined cases: null and empty texts score like a text without matches; labels that are null,
neither 0 nor 1, or repeated with both values are left out; without toxic labels all score 0; repeated rows
are scored each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm import blocks as B

SAMPLE_ROWS = 20_000
STEMS = range(4, 8)
WINDOW = 6
LEAST = 3  # toxic texts that a term is in
LIKELIHOOD = 15.0  # a likelihood ratio that chance gives one term in ten thousand
EDGE = ".,;:!?\"'()[]{}<>*#$%&|…“”„«»‘’-"
OPEN, CLOSE = "\"“„«‘'", "\"”“»’'"


def bare(token: str) -> str:
    return token.strip(EDGE)


def signature(words: list[str]) -> str:
    """Alike for near copies: the two smallest hashes of three words in a row."""
    grams = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    least = sorted(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams)[:2]
    return b"".join(least).hex()


def sampled(docs: DataFrame, labels: DataFrame, train: Column, rows: int) -> DataFrame:
    """About ``rows`` labelled training rows at most: text, toxic, half (0 or 1), chosen by a hash of the id."""
    sure = labels.filter("doc_id is not null and toxic in (0, 1)").filter(train).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    n = sure.count()
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(2**31))
    chosen = sure.filter(mark < int(2**31 * min(1.0, rows / max(n, 1)))) if n > rows else sure
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``rows``


def lexicon_counts(sample: DataFrame) -> DataFrame:
    """term -> texts it is in, toxic and clean; near copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, found, toxic = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [bare(t) for t in (text or "").lower().split()]
                sigs.append(signature(words))
                found.append(sorted({*words} - {""}))
                toxic.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.string()), pa.array(toxic, pa.int32()), pa.array(found, pa.list_(pa.string()))], names=["sig", "toxic", "words"])

    once = sample.select(F.col("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "sig string, toxic int, words array<string>")
    once = once.groupBy("sig").agg(F.min(F.struct("words", "toxic")).alias("one")).select("one.toxic", "one.words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = set(words)
                terms.update(w[:k] + "*" for w in words for k in STEMS if len(w) >= k)
                terms.add("")
                sums[label].update(terms)
        terms = list(sums[0] | sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([sums[1][t] for t in terms], pa.int64()), pa.array([sums[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    return once.select("toxic", "words").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """term -> log-odds; a stem only where it says more than the words below it, a word only where no stem covers it."""
    rated = []
    for term, t, c in counts:
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        share = toxic / (toxic + clean)
        ratio = 2 * sum(n * math.log(n / ((t + c) * p)) for n, p in ((t, share), (c, 1 - share)) if n)
        if odds >= 2 and ratio >= LIKELIHOOD:
            rated.append((t - 10 * c, not term.endswith("*"), len(term), term, odds, t))
    found: dict[str, float] = {}
    below: dict[str, int] = {}  # of each beginning, the count of the best word or chosen stem that has it

    def note(term: str, t: int) -> None:
        stem = term.rstrip("*")
        for k in STEMS:
            if k <= len(stem):
                below[stem[:k]] = max(t, below.get(stem[:k], 0))

    for *_, term, _, t in rated:
        if not term.endswith("*"):
            note(term, t)
    for _, _, _, term, odds, t in sorted(rated, reverse=True):
        stem = term.rstrip("*")
        if any(stem[:k] + "*" in found for k in STEMS if k <= len(stem)):
            continue
        if term.endswith("*") and t <= 1.1 * below.get(stem, 0):
            continue
        found[term] = odds
        note(term, t)
    return found


class Matcher:
    """Exact, stem and misspelled matches of single words; remembers what it has seen up to ``memory`` words.

    ``spelled`` are words below the stems, whose misspellings count too.
    """

    def __init__(self, lexicon: dict[str, float], edits: int = 1, shortest: int = 5, memory: int = 300_000, spelled: Iterable[str] = ()):
        self.words = {t for t in lexicon if not t.endswith("*")}
        self.stems = {t[:-1] for t in lexicon if t.endswith("*")}
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.edits, self.memory, self.seen = edits, memory, {}
        self.trie: dict = {}
        self.heads: dict[str, set[int]] = {}
        self.tails: dict[str, set[int]] = {}
        for w in sorted(self.words.union(spelled)):
            if len(w) < shortest:
                continue
            node = self.trie
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w
            near = range(len(w) - edits, len(w) + edits + 1)
            part = len(w) // (edits + 1)
            self.heads.setdefault(w[:part], set()).update(near)
            self.tails.setdefault(w[part:] if edits == 1 else w[-part:], set()).update(near)
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.tail_sizes = sorted({len(h) for h in self.tails})

    def near(self, word: str) -> bool:
        """One edit leaves the beginning or the end of a term whole; with more, every word is searched."""
        n = len(word)
        if self.edits > 1:
            return True
        return any(n in self.heads.get(word[:k], ()) for k in self.head_sizes) or any(n in self.tails.get(word[-k:], ()) for k in self.tail_sizes)

    def misspelled(self, word: str) -> bool:
        limit = self.edits
        stack = [(self.trie, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            if "" in node and row[-1] <= limit:
                return True
            for ch, child in node.items():
                if ch == "":
                    continue
                new = [row[0] + 1]
                for j, other in enumerate(word):
                    new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (other != ch)))
                if min(new) <= limit:
                    stack.append((child, new))
        return False

    def __call__(self, token: str) -> int:
        """0 no match, 1 a word, 2 a stem, 3 a misspelled word."""
        kind = self.seen.get(token)
        if kind is None:
            word = bare(token)
            if word in self.words:
                kind = 1
            elif any(word[:k] in self.stems for k in self.stem_sizes):
                kind = 2
            else:
                kind = 3 if self.trie and self.near(word) and self.misspelled(word) else 0
            if len(self.seen) >= self.memory:
                self.seen.clear()
            self.seen[token] = kind
        return kind


def features(text: str, match: Matcher) -> list[float]:
    tokens = text.lower().split()
    hits = {t for t in set(tokens) if match(t)}
    sums = [0.0] * 5  # words, stems, misspelled, quoted, clustered
    if hits:
        at = [i for i, t in enumerate(tokens) if t in hits]
        for k, i in enumerate(at):
            kind = match(tokens[i])
            a, b = max(0, i - WINDOW), i + WINDOW + 1
            opened = any(t[0] in OPEN for t in tokens[a : i + 1])
            closed = any(t.rstrip(".,;:!?")[-1:] in CLOSE and t.rstrip(".,;:!?")[-1:] for t in tokens[i:b])
            if opened and closed:
                sums[3] += 1
            else:
                sums[kind - 1] += 1
            sums[4] += (k > 0 and at[k - 1] >= a) or (k + 1 < len(at) and at[k + 1] < b)
    share = sum(sums[:3]) / max(len(tokens), 1)
    return [1.0, *(math.log1p(x) for x in sums), float(sums[0] + sums[1] > 0), math.sqrt(share)]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], list[str], np.ndarray | None]:
    """The lexicon, the words observed below its stems and the weights, from labelled rows where ``train`` holds."""
    sample = B.stored(sampled(docs, labels, train, rows), "toxicity-sample")
    counts = B.stored(lexicon_counts(sample.filter("half = 0")), "toxicity-terms")
    total = counts.filter("term = ''").first()
    if not total or not total["toxic"]:
        return {}, [], None
    marks = counts.filter((F.col("term") != "") & (F.col("toxic") > 0) & (F.col("toxic") * (total["clean"] + 1) >= 5 * F.col("clean") * (total["toxic"] + 1)))
    likely = marks.filter(F.col("toxic") >= LEAST)
    top = likely.collect()  # bounded by the words of ``rows`` texts
    lexicon = choose([(r["term"], r["toxic"], r["clean"]) for r in top], total["toxic"], total["clean"])
    stems = [t[:-1] for t in lexicon if t.endswith("*")]
    spelled: list[str] = []
    if stems:
        under = [F.substring("term", 1, k).isin(part) for k in STEMS if (part := [s for s in stems if len(s) == k])]
        words = marks.filter(~F.col("term").endswith("*")).filter(reduce(or_, under))
        spelled = sorted(r["term"] for r in words.collect())  # bounded likewise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(lexicon, spelled=spelled)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([features(t or "", match) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=["toxic", "x"])

    held = sample.filter("half = 1").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, x array<double>").collect()  # bounded by ``rows``
    if not any(r["toxic"] for r in held) or all(r["toxic"] for r in held):
        return lexicon, spelled, None
    return lexicon, spelled, fit(np.array([r["x"] for r in held]), np.array([float(r["toxic"]) for r in held]))


def score(docs: DataFrame, labels: DataFrame, train: Column, cutoff: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text), labels (doc_id, toxic) -> doc_id, score, predicted, and the counts of words, stems, misspelled, quoted and clustered matches."""
    lexicon, spelled, weights = learn(docs, labels, train, rows)
    model = docs.sparkSession.sparkContext.broadcast((lexicon, spelled, weights))  # bounded by the words of ``rows`` texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, spelled, w = model.value
        match = Matcher(lexicon, spelled=spelled)
        for batch in batches:
            for part, texts in B.slices(pa.Table.from_batches([batch])):
                x = np.array([features(t.as_py().decode(), match) for t in texts]).reshape(len(texts), -1)
                value = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) if w is not None else np.zeros(len(texts))
                counts = np.rint(np.expm1(x[:, 1:6])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(value), pa.array((value >= cutoff).astype(np.int32)), *(pa.array(counts[:, i]) for i in range(5))], names=["doc_id", "score", "predicted", "n_words_found", "n_stems", "n_misspelled", "n_quoted", "n_clustered"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_words_found long, n_stems long, n_misspelled long, n_quoted long, n_clustered long")
