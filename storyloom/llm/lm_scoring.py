"""Language-model scores from a weighted backoff automaton over n-grams.

The states are the root and one for every history of up to ``order`` - 1 words seen in
training.  From the state of a history h an arc leads to each word w that was seen behind it
and weighs

    p(w|h) = (c(hw) + mu * p(w|h')) / (c(h) + mu)

where h' is h without its first word and mu belongs to the length of h.  For all other words
the state's failure arc, of weight ``mu / (c(h) + mu)``, leads to the state of h'.  The root
has an arc for every word with p(w) = (c - d) / N and one for all unknown words that takes the
discounted mass d * V / N; d = n1 / (n1 + 2 * n2).  So a state's probabilities sum to one.  A
text is traversed left to right from the state of the end mark: the state before a word is
the longest history that is a state, and failure arcs are followed until an arc fits.

The automaton is never gathered in one place.  Each block of documents asks the owners of
the hash ranges for the counts of its own n-grams, once per distinct one, and so holds just
the slice of the automaton that its texts can visit: memory is bounded by the block, while
the model grows with the corpus without pruning.  Words and pairs are asked first.  A longer
n-gram can be in another block only if both shorter ones in it are, so only those are
asked; the block's own counts are whole for the rest.

Defined cases: a null text is empty (the end mark alone); a null training flag is held out;
with no training rows every probability is that of the one unknown word; repeated rows count
each time; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from storyloom.llm import blocks as B

TOTALS = 0  # kinds above are lengths of n-grams
END = np.uint64(0x0E0D0E0D0E0D0E0D)
MU = (30.0, 5.0)  # of histories of one word, of two ...


class Grams:
    """The distinct n-grams of a block's texts by length, in order of name; lists are indexed by length."""

    def __init__(self, table: pa.Table, order: int):
        tokens, train, sizes, self.batches = [], [], [], []
        for batch, texts in B.unpacked(table):
            w = B.Words(texts, lower=True)
            rows = len(w.first) - 1
            size = np.diff(w.first) + 1
            first = w.first + np.arange(rows + 1)
            part = np.full(first[-1], END, np.uint64)
            part[np.arange(len(w.hash)) + np.repeat(np.arange(rows), size - 1)] = w.hash
            flags = np.asarray(batch.column(2).fill_null(False).cast(pa.int8())).astype(bool)
            tokens.append(part)
            train.append(np.repeat(flags, size))
            sizes.append(size)
            self.batches.append(batch.select(["doc_id", "train"]))
        tokens, train, sizes = np.concatenate(tokens), np.concatenate(train), np.concatenate(sizes)
        self.edges = np.append(0, np.cumsum(sizes))
        place = (np.arange(len(tokens)) - np.repeat(self.edges[:-1], sizes)).astype(np.int32)
        none = np.zeros(0, np.int32)
        self.names, self.own, self.of, self.prefix, self.suffix = [none], [none], [none], [none], [none]
        name = tokens
        for k in range(1, order + 1):
            if k > 1:
                # The last token of a block is an end mark, and so is that before a text's first.
                name = B.pair_name(np.roll(name, 1), tokens, 6 + k)
            at = np.flatnonzero(place >= k - 2).astype(np.int32)
            ranked = at[np.argsort(name[at])]
            names = name[ranked]
            new = np.ones(len(names), bool)
            new[1:] = names[1:] != names[:-1]
            of = np.full(len(tokens), -1, np.int32)
            of[ranked] = np.cumsum(new, dtype=np.int32) - np.int32(1)
            first = np.flatnonzero(new)
            self.names.append(names[first])
            self.own.append(np.add.reduceat(train[ranked], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64))
            self.of.append(of)
            self.prefix.append(self.of[k - 1][ranked[first] - 1] if k > 1 else none)
            self.suffix.append(self.of[k - 1][ranked[first]] if k > 1 else none)


def to_ask(grams: Grams, k: int, shared: list[np.ndarray]) -> np.ndarray:
    """Which n-grams of length k another block can hold: those whose two shorter ones another block holds."""
    if k <= 2:
        return np.ones(len(grams.names[k]), bool)
    return shared[k - 1][grams.prefix[k]] & shared[k - 1][grams.suffix[k]]


def told(answers: pa.Table, kind: int) -> np.ndarray:
    """Answers in the order of the names that were asked: a bucket owns a range of names and answers it by rising parts."""
    found = [(tuple(np.frombuffer(n.as_py(), np.int64)), v.as_py()) for k, n, v in zip(answers.column("kind"), answers.column("names"), answers.column("vals")) if k.as_py() == kind]
    return np.concatenate([B.unplanes(v, np.int64) for _, v in sorted(found)]) if found else np.zeros(0, np.int64)


def totals_of(grams: Grams, answers: pa.Table, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the block's n-grams of up to ``most`` words the counts in the whole training corpus, and whether another block holds them."""
    none = np.zeros(0, np.int64)
    total, shared = [none], [none.astype(bool)]
    for k in range(1, most + 1):
        ask = to_ask(grams, k, shared)
        found = told(answers, k)
        counts, more = grams.own[k].copy(), np.zeros(len(ask), bool)
        counts[ask], more[ask] = found >> 1, found & 1
        total.append(counts)
        shared.append(more)
    return total, shared


def ask_short(table: pa.Table, buckets: int, order: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    most = min(order, 2)
    grams = Grams(table, most)
    rows = [r for k in range(1, most + 1) for r in B.asked(block, k, grams.names[k], grams.own[k][:, None], buckets)]
    return B.table_of([*rows, (0, block, TOTALS, b"", b"")], B.ASK_ARROW)  # the first bucket lists the blocks


def ask_long(table: pa.Table, answers: pa.Table, buckets: int, k: int) -> pa.Table:
    if not table.num_rows:
        return B.ASK_ARROW.empty_table()
    grams = Grams(table, k)
    ask = to_ask(grams, k, totals_of(grams, answers, k - 1)[1])
    return B.table_of(B.asked(table.column("block")[0].as_py(), k, grams.names[k][ask], grams.own[k][ask][:, None], buckets), B.ASK_ARROW)


def answer_counts(table: pa.Table, order: int) -> pa.Table:
    """Of the n-grams that each block asked for, in its order: twice the corpus count, and one more where several blocks hold it."""
    bucket = table.column("bucket")[0].as_py()
    rows = []
    for kind in range(1, order + 1):
        for part, (names, n, of) in enumerate(B.parts_of(table, kind)):
            order_, group, at = B.grouped(names)
            total = np.empty(len(names), np.int64)
            several = np.diff(np.append(at, len(names))) > 1
            total[order_] = (2 * np.add.reduceat(n[order_, 0], at) + several)[group]
            key = np.array([bucket, part], np.int64).tobytes()
            cut = np.flatnonzero(np.diff(of)) + 1
            edges = [0, *cut.tolist(), len(of)]
            rows += [(int(of[i]), kind, key, B.planes(total[i:j])) for i, j in zip(edges, edges[1:])]
    return B.table_of(rows, B.TELL_ARROW)


SUMS = pa.schema([*((c, pa.int64()) for c in ("n", "v", "once", "twice")), ("blocks", pa.binary())])


def bucket_sums(table: pa.Table) -> pa.Table:
    """A bucket's training tokens, its distinct words, those seen once and twice; and the blocks that it lists."""
    sums = np.zeros(4, np.int64)
    for names, n, _ in B.parts_of(table, 1):
        order, _, at = B.grouped(names)
        c = np.add.reduceat(n[order, 0], at)
        sums += [c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()]
    blocks = np.array([b for b, k in zip(table.column("block").to_pylist(), table.column("kind").to_pylist()) if k == TOTALS], np.int64)
    return pa.table({f.name: [x] for f, x in zip(SUMS, [*map(int, sums), blocks.tobytes()])}, schema=SUMS)


def spread_sums(table: pa.Table) -> pa.Table:
    """The corpus totals, a row for each block."""
    sums = B.planes(np.array([sum(table.column(c).to_pylist()) for c in SUMS.names[:4]], np.int64))
    key = np.zeros(2, np.int64).tobytes()
    blocks = np.frombuffer(b"".join(table.column("blocks").to_pylist()), np.int64).tolist()
    return B.table_of([(b, TOTALS, key, sums) for b in blocks], B.TELL_ARROW)


class Automaton:
    """The slice of the automaton that a block's texts visit; lists are indexed by the length of histories or n-grams."""

    def __init__(self, grams: Grams, total: list[np.ndarray], sums: np.ndarray, mu: tuple[float, ...]):
        n, v, once, twice = (float(x) for x in sums)
        c = total[1].astype(float)
        d = once / (once + 2 * twice) if once else 0.5
        p = np.where(c > 0, (c - d) / max(n, 1.0), d * v / n if n else 1.0)
        self.grams, self.base = grams, np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        self.arc = [None, np.log10(p)]  # weights; an n-gram of two or more words has one only where it was seen
        self.seen = [None, np.ones(len(c), bool)]
        self.state, self.failure = [None], [None]  # whether a history is a state, and the weight of its failure arc
        for k in range(2, len(total)):
            held = total[k - 1]
            self.state.append(held > 0)
            self.failure.append(np.log10(mu[k - 2] / (held + mu[k - 2])))
            p = (total[k] + mu[k - 2] * p[grams.suffix[k]]) / (held[grams.prefix[k]] + mu[k - 2])
            self.arc.append(np.log10(p))
            self.seen.append(total[k] > 0)

    def traverse(self) -> np.ndarray:
        """The log-probability of every token in its text."""
        grams = self.grams
        weight = np.zeros(len(grams.of[1]))
        at = np.arange(len(weight))  # tokens whose arc is still looked for, at the state of k - 1 words or fewer
        for k in range(len(self.arc) - 1, 0, -1):
            if not len(grams.names[k]):
                continue
            gram = grams.of[k][at]
            here = gram >= 0
            if k > 1:
                here &= self.state[k - 1][grams.prefix[k][gram]]
            fits = here & self.seen[k][gram]
            weight[at[fits]] += self.arc[k][gram[fits]]
            if k > 1:
                fails = here & ~fits
                weight[at[fails]] += self.failure[k - 1][grams.prefix[k][gram[fails]]]
            at = at[~fits]
        return weight


RESULT = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])


def score_block(table: pa.Table, answers: pa.Table, mu: tuple[float, ...]) -> pa.Table:
    if not table.num_rows:
        return RESULT.empty_table()
    grams = Grams(table, len(mu) + 1)
    total, _ = totals_of(grams, answers, len(mu) + 1)
    sums = told(answers, TOTALS)
    automaton = Automaton(grams, total, sums, mu)
    weight, base = automaton.traverse().tolist(), automaton.base[grams.of[1]].tolist()
    known = np.append(0, np.cumsum((total[1] > 0)[grams.of[1]]))
    edges = grams.edges
    pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return pa.Table.from_arrays([
        pa.chunked_array([b.column(0).cast(pa.int64()) for b in grams.batches]), pa.chunked_array([b.column(1) for b in grams.batches]),
        pa.array(np.diff(edges)), pa.array(known[edges[1:]] - known[edges[:-1]]), pa.array(np.full(len(pairs), int(sums[0]))),
        pa.array([math.fsum(base[a:b]) for a, b in pairs], pa.float64()), pa.array([math.fsum(weight[a:b]) for a, b in pairs], pa.float64()),
    ], schema=RESULT)


def score(docs: DataFrame, train: Column, mu: tuple[float, ...] = MU) -> DataFrame:
    """(doc_id, text), a training flag -> doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10).

    The automaton's order is one more than the number of values in ``mu``.
    """
    size = B.text_bytes(docs)
    m, order = B.bucket_count(size), len(mu) + 1
    by = B.blocked(docs, B.block_bytes(size), train.alias("train")).groupBy("block")
    asks = by.applyInArrow(lambda t: ask_short(t, m, order), B.ASK).groupBy("bucket")
    sums = asks.applyInArrow(bucket_sums, "n long, v long, once long, twice long, blocks binary")

    def asking(k: int):
        return lambda t, a: ask_long(t, a, m, k)

    # Each part of the answers is exchanged by itself: a union of parts that are dealt alike needs no exchange of its own.
    answers = asks.applyInArrow(lambda t: answer_counts(t, order), B.TELL).repartition("block")
    for k in range(3, order + 1):
        longer = by.cogroup(answers.groupBy("block")).applyInArrow(asking(k), B.ASK)
        answers = answers.unionByName(longer.groupBy("bucket").applyInArrow(lambda t: answer_counts(t, order), B.TELL).repartition("block"))
    answers = answers.unionByName(sums.groupBy().applyInArrow(spread_sums, B.TELL).repartition("block"))  # ``sums`` has one row a bucket
    result = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by.cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: score_block(t, a, mu), result)
