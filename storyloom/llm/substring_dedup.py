"""Removal of long repeated passages by recompression.

Texts become sequences of word symbols.  A *round* splits the alphabet in two by a bit of
each symbol's hash and names every adjacent (left, right) pair; upper rounds also name runs
of equal symbols.  A name is a hash of what it stands for, so every task gives equal
substrings equal interior names without a shared dictionary, and the Spark exchange of a
round only has to say which names are shared:

* *low* names (few rounds, pairs only) carry the range of words that determined them.  A
  window of ``width`` words that covers the whole range of a name found in one document only
  can't repeat, so it needs no further look;
* *high* names stand for passages of tens of words.  One that also occurs in a document
  with a smaller id reveals a long repeat; it is verified by a second hash of the passage's
  words, made without the rounds, and then removed whole, without a row for any of its
  windows.  A name that fails the check is left to the windows.

What is left, windows across the edges of high names and first occurrences, is settled
exactly: the hash of the window's words with the smallest id that holds it.  Words and names
are 64-bit hashes, a word's from random numbers for each byte at its place: the odds that a
window is judged wrongly are (windows in the corpus) / 2**64.

Defined cases: null text has no words; a null id counts as larger than any id; rows with
one id never remove each other's words; texts shorter than ``width`` lose nothing; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storyloom.llm import blocks as B

LOW, HIGH, WINDOW, COVERED = 0, 1, 2, 3
LOW_ROUNDS, HIGH_ROUNDS = 4, 14
_FAR = np.int64(2**60)


def _side(sym: np.ndarray, salt: int) -> np.ndarray:
    return (B.mix(sym + np.uint64(salt * 0x5851F42D4C957F2D % 2**64)) & np.uint64(1)).astype(bool)


def low_names(words: np.ndarray, text: np.ndarray, rounds: int = LOW_ROUNDS):
    """Pair rounds. Returns symbols and the word range [lo, hi) that determined each."""
    sym, lo = words, np.arange(len(words), dtype=np.int64)
    hi = lo + 1
    for r in range(rounds):
        if len(sym) < 2:
            break
        left = _side(sym, r)
        near = text[1:] == text[:-1]
        pair = np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & ~left[1:] & near
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        after_lo, after_hi = np.append(lo[1:], 0), np.append(hi[1:], 0)
        alone_next = np.append(~near, True)
        alone_prev = np.insert(~near, 0, True)
        new = sym.copy()
        new[:-1][pair[:-1]] = B.pair_name(sym[:-1][pair[:-1]], sym[1:][pair[:-1]], r)
        new_lo, new_hi = lo.copy(), hi.copy()
        by_next = pair | left
        new_lo[by_next] = np.minimum(lo, after_lo)[by_next]
        new_hi[by_next] = np.maximum(hi, after_hi)[by_next]
        edge = left & alone_next
        new_lo[edge], new_hi[edge] = -_FAR, _FAR
        right = ~left & ~second
        prev_lo, prev_hi = np.insert(lo[:-1], 0, 0), np.insert(hi[:-1], 0, 0)
        new_lo[right] = np.minimum(lo, prev_lo)[right]
        new_hi[right] = np.maximum(hi, prev_hi)[right]
        edge = right & alone_prev
        new_lo[edge], new_hi[edge] = -_FAR, _FAR
        keep = ~second
        sym, lo, hi, text = new[keep], new_lo[keep], new_hi[keep], text[keep]
    return sym, lo, hi, text


def high_names(words: np.ndarray, text: np.ndarray, rounds: int = HIGH_ROUNDS):
    """Run and pair rounds. Returns symbols with their words [start, end)."""
    sym, start = words, np.arange(len(words), dtype=np.int64)
    end = start + 1
    for r in range(rounds):
        if len(sym) < 2:
            break
        new_run = np.ones(len(sym), bool)
        new_run[1:] = (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new_run)
        size = np.diff(np.append(at, len(sym)))
        if len(at) < len(sym):
            end = end[at + size - 1]
            sym, start, text = sym[at], start[at], text[at]
            sym = np.where(size > 1, B.pair_name(sym, size.astype(np.uint64), 1000 + r), sym)
        if len(sym) < 2:
            break
        left = _side(sym, 100 + r)
        pair = np.flatnonzero(left[:-1] & ~left[1:] & (text[1:] == text[:-1]))
        new = sym.copy()
        new[pair] = B.pair_name(sym[pair], sym[pair + 1], 100 + r)
        end = end.copy()
        end[pair] = end[pair + 1]
        keep = np.ones(len(sym), bool)
        keep[pair + 1] = False
        sym, start, end, text = new[keep], start[keep], end[keep], text[keep]
    return sym, start, end, text


def passage_checks(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A second hash of each passage, from its words and their places; the passages follow one another."""
    place = np.arange(len(words)) - np.repeat(start, np.diff(np.append(start, len(words))))
    value = B.mix(words ^ B.mix(place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25)))
    return np.add.reduceat(value, start).view(np.int64) if len(start) else np.zeros(0, np.int64)


def window_names(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    name = np.zeros(len(at), np.uint64)
    for j in range(width):
        name = name * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
    return B.mix(name)


def _least(names: np.ndarray, docs: np.ndarray):
    """Distinct names, the smallest id of each, and whether there is a larger one."""
    if not len(names):
        return names, docs, np.zeros(0, bool)
    order = np.lexsort((docs, names))
    names, docs = names[order], docs[order]
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(names)) - 1
    return names[at], docs[at], docs[last] > docs[at]


def _least_checked(names: np.ndarray, checks: np.ndarray, docs: np.ndarray):
    """Distinct (name, check) in order, and the smallest id of each."""
    if not len(names):
        return names, checks, docs
    order = np.lexsort((docs, checks, names))
    names, checks, docs = names[order], checks[order], docs[order]
    first = np.ones(len(names), bool)
    first[1:] = (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])
    return names[first], checks[first], docs[first]


def _parts(table: pa.Table):
    """Of each slice: rows, words, each word's row, ids, and the end word of each word's row."""
    for batch, texts in B.unpacked(table):
        w = B.Words(texts)
        sizes = np.diff(w.first)
        yield batch, w, np.repeat(np.arange(len(sizes)), sizes), B.ids(batch), np.repeat(w.first[1:], sizes)


def _own(parts: list, index: int) -> np.ndarray:
    return np.concatenate([p[index] for p in parts]) if parts else np.zeros(0, np.uint64 if index == 0 else np.int64)


def _high(w, text: np.ndarray, doc: np.ndarray, width: int):
    """High names of a slice that are long enough: name, check, id, words [start, end)."""
    sym, start, end, of = high_names(w.hash, text)
    check = passage_checks(w.hash, start)
    fits = (end - start) >= width
    return sym[fits], check[fits], doc[of[fits]], start[fits], end[fits]


def ask_names(table: pa.Table, buckets: int, width: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    low, high = [], []
    for _, w, text, doc, _ in _parts(table):
        sym, lo, hi, of = low_names(w.hash, text)
        fits = (hi - lo) <= width
        low.append((sym[fits], doc[of[fits]]))
        high.append(_high(w, text, doc, width)[:3])
    names, _, more = _least(_own(low, 0), _own(low, 1))
    rows = B.asked(block, LOW, names, more.astype(np.int8)[:, None], buckets)
    names, checks, least = _least_checked(*(_own(high, i) for i in range(3)))
    rows += B.asked(block, HIGH, names, np.stack([least, checks], axis=1), buckets)
    return B.table_of(rows, B.ASK_ARROW)


def answer_names(table: pa.Table) -> pa.Table:
    """To each block its low names that another document has, and the smallest ids of high names of earlier ones."""
    rows = []
    for names, more, of in B.parts_of(table, LOW, np.int8):
        order, group, at = B.grouped(names)
        shared = np.empty(len(names), bool)
        shared[order] = (np.add.reduceat(1 + more[order, 0].astype(np.int64), at) > 1)[group]
        rows += B.told(LOW, names[shared], np.zeros((int(shared.sum()), 0), np.int8), of[shared])
    for names, vals, of in B.parts_of(table, HIGH):
        key, checks, least = _least_checked(names, vals[:, 1], vals[:, 0])
        # A name with several checks is told with the first one's; the others fail the comparison.
        at = np.searchsorted(key, names)
        tell = least[at] < vals[:, 0]
        rows += B.told(HIGH, names[tell], np.stack([least[at], checks[at]], axis=1)[tell], of[tell])
    return B.table_of(rows, B.TELL_ARROW)


def answer_windows(table: pa.Table) -> pa.Table:
    """To each block the smallest id of a window that another block has with a smaller id."""
    rows = []
    for names, doc, of in B.parts_of(table, WINDOW):
        order, group, at = B.grouped(names)
        least = np.empty(len(names), np.int64)
        least[order] = np.minimum.reduceat(doc[order, 0], at)[group]
        tell = least < doc[:, 0]
        rows += B.told(WINDOW, names[tell], least[tell][:, None], of[tell])
    return B.table_of(rows, B.TELL_ARROW)


def _smallest(names: np.ndarray, docs: np.ndarray, told_names: np.ndarray, told_docs: np.ndarray) -> np.ndarray:
    """For each occurrence the smallest id in the corpus: of its block or told."""
    own, least, _ = _least(names, docs)
    at = B.look_up(told_names, own)
    if len(told_names):
        least = np.where(at >= 0, np.minimum(least, told_docs[at]), least)
    return least[np.searchsorted(own, names)]


def _cover(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:size] > 0


def _high_hits(table: pa.Table, answers: pa.Table, width: int) -> list:
    """Of each slice the words [start, end) of high names that a smaller id has too, verified."""
    parts = [_high(w, text, doc, width) for _, w, text, doc, _ in _parts(table)]
    names, told = B.learned(answers, HIGH)
    key, checks, least = _least_checked(*(_own(parts, i) for i in range(3)))
    out = []
    for sym, check, doc, start, end in parts:
        hit = np.zeros(len(sym), bool)
        for known, values in ((key, np.stack([least, checks], axis=1)), (names, told)):
            at = B.look_up(known, sym)
            if len(known):
                hit |= (at >= 0) & (values[at, 0] < doc) & (values[at, 1] == check)
        out.append((start[hit], end[hit]))
    return out


def _candidates(w, text, end_of_text, shared, hits, width: int) -> np.ndarray:
    """Windows that may repeat and that no high name has settled."""
    n = len(w.hash)
    if n < width:
        return np.zeros(0, np.int64)
    sym, lo, hi, _ = low_names(w.hash, text)
    alone = ((hi - lo) <= width) & (B.look_up(shared, sym) < 0)
    closed = np.zeros(n + 1, np.int64)
    np.add.at(closed, np.maximum(hi[alone] - width, 0), 1)
    np.add.at(closed, lo[alone] + 1, -1)
    start, end = hits
    np.add.at(closed, start, 1)
    np.add.at(closed, end - width + 1, -1)
    at = np.arange(n)
    return np.flatnonzero((np.cumsum(closed)[:n] == 0) & (at + width <= end_of_text))


def ask_windows(table: pa.Table, answers: pa.Table, buckets: int, width: int) -> pa.Table:
    if not table.num_rows:
        return B.ASK_ARROW.empty_table()
    block = table.column("block")[0].as_py()
    shared, _ = B.learned(answers, LOW, np.int8)
    hits = _high_hits(table, answers, width)
    found = []
    for (_, w, text, doc, end), hit in zip(_parts(table), hits):
        at = _candidates(w, text, end, shared, hit, width)
        found.append((window_names(w.hash, at, width), doc[text[at]]))
    names, least, _ = _least(_own(found, 0), _own(found, 1))
    return B.table_of(B.asked(block, WINDOW, names, least[:, None], buckets), B.ASK_ARROW)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def settle(table: pa.Table, answers: pa.Table, width: int, texts: bool) -> pa.Table:
    if not table.num_rows:
        return RESULT.empty_table()
    shared, _ = B.learned(answers, LOW, np.int8)
    hits = _high_hits(table, answers, width)
    found = []
    for (_, w, text, doc, end), hit in zip(_parts(table), hits):
        at = _candidates(w, text, end, shared, hit, width)
        found.append((window_names(w.hash, at, width), doc[text[at]], at))
    names, least = B.learned(answers, WINDOW)
    smallest = _smallest(_own(found, 0), _own(found, 1), names, least[:, 0])
    out, done = [], 0
    for (batch, w, _, _, _), hit, (_, doc, at) in zip(_parts(table), hits, found):
        repeat = at[smallest[done : done + len(at)] < doc]
        done += len(at)
        gone = _cover(len(w.hash), np.append(repeat, hit[0]), np.append(repeat + width, hit[1]))
        before = np.append(0, np.cumsum(gone))
        raw = w.raw.tobytes()
        start, end = w.start.tolist(), w.end.tolist()
        kept_texts, sha = [], []
        for i in range(len(w.first) - 1):
            a, b = int(w.first[i]), int(w.first[i + 1])
            keep = range(a, b) if before[b] == before[a] else (a + np.flatnonzero(~gone[a:b])).tolist()
            kept = b" ".join([raw[start[k] : end[k]] for k in keep])
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode() if texts else None)
        out.append(pa.Table.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(w.first)), pa.array(before[w.first[1:]] - before[w.first[:-1]]), pa.array(kept_texts, pa.string()), pa.array(sha)], schema=RESULT))
    return pa.concat_tables(out)


def remove_repeats(docs: DataFrame, width: int = 13, texts: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_text (null unless ``texts``), kept_sha256.

    A word goes if a window of ``width`` words around it also starts in a document with a smaller id.
    """
    size = B.text_bytes(docs)
    m = B.bucket_count(size)
    by = B.blocked(docs, B.block_bytes(size)).groupBy("block")
    first = by.applyInArrow(lambda t: ask_names(t, m, width), B.ASK).groupBy("bucket").applyInArrow(answer_names, B.TELL)
    second = by.cogroup(first.groupBy("block")).applyInArrow(lambda t, a: ask_windows(t, a, m, width), B.ASK).groupBy("bucket").applyInArrow(answer_windows, B.TELL)
    answers = first.unionByName(second)
    result = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return by.cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: settle(t, a, width, texts), result)
