"""BPE encoding and decoding by dynamic programming over prefixes.

A merge list in which every token comes of one merge, and no merge uses a token that a later
one makes, encodes a prefix of a word with exactly one *last token*.  A token is the last one
of a prefix if it ends there, and the last token of the prefix before it tolerates it: while
the merges of both are replayed, no merge ever joins two tokens across their border
(``PrefixEncoder.stands``).  So one pass over a word stores the last token of every prefix:
an automaton over all tokens gives those that are suffixes of the prefix, the test finds the
one that stands, and the back-pointers, followed from the end, are the ids.  The time is linear
in the length of a word, so that a text without any space is encoded as fast as another.

Words are taken from a slice of texts at once: bytes are classed by a table, borders are
compared, and equal words of a slice are encoded once.  Texts outside the characters in which
all versions of Unicode agree (``PLAIN``), and texts with the strings of special tokens, are
normalised and split by the tokenizer's own parts; their words are encoded as all others.

Defined cases: a null text is empty and has no ids; empty tables stay empty; every row is
encoded on its own, repeated or not; all columns but the text are kept unless one is named as a
result, which then replaces it; texts may be of any length.  Decoding skips ids that name no
token; null ids decode to an empty text.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from storyloom.llm import blocks as B

NEVER = 2**62
ENDING = "</w>"
END_MARK = 0x8000  # added to a word's last symbol
LENGTH_BITS, LENGTH = 10, 1023
CACHED_WORDS, CACHED_SYMBOLS, CACHED_PAIRS = 100_000, 40, 200_000
DECODED_AT_ONCE = 500_000  # tokens
#: Characters that every Unicode version since 9 classes, lower-cases and composes alike; without capital sigma and dotted capital I.
PLAIN = "\\x{0}-\\x{12F}\\x{131}-\\x{241}\\x{386}\\x{388}-\\x{38A}\\x{38C}\\x{38E}-\\x{3A1}\\x{3A4}-\\x{3CE}\\x{400}-\\x{482}\\x{48A}-\\x{527}\\x{2010}-\\x{2027}\\x{2030}-\\x{205E}\\x{20A0}-\\x{20BE}\\x{3001}-\\x{3029}\\x{3041}-\\x{3096}\\x{309D}-\\x{30FF}\\x{4E00}-\\x{9FD5}"
SPACE, LETTER, NUMBER, OTHER, INSIDE = range(5)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class TokenNames:
    """The names of a tokenizer file's ids, all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = {**{k: name for name, k in spec["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in spec["added_tokens"]}}
        self.names: list[str | None] = [named.get(k) for k in range(max(named) + 1)]
        self.array = pa.array([n or "" for n in self.names], pa.string())
        self.named = np.array([n is not None for n in self.names])


class PrefixEncoder:
    """Encoder of one tokenizer file of kind BPE with word ends."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.made = [-1] * n  # the merge that makes a token
        self.left, self.right = [-1] * n, [-1] * n
        self.merge: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if self.made[c] >= 0 or c == a or c == b:
                raise ValueError("a token comes of two merges: prefixes have no unique last token")
            self.made[c], self.left[c], self.right[c] = rank, a, b
            self.merge[a * n + b] = rank
        if any(max(self.made[self.left[c]], self.made[self.right[c]]) >= r for c, r in enumerate(self.made) if r >= 0):
            raise ValueError("a merge uses a token that a later one makes")
        self.n = n
        self.automaton = ahocorasick.Automaton()
        for name, k in vocab.items():
            symbols = name[: -len(ENDING)] if name.endswith(ENDING) and len(name) > len(ENDING) else name
            if symbols is not name:
                symbols = symbols[:-1] + chr(ord(symbols[-1]) + END_MARK)
            if len(symbols) > LENGTH:
                raise ValueError(f"a token is longer than {LENGTH} symbols")
            self.automaton.add_word(symbols, k << LENGTH_BITS | len(symbols))
        self.automaton.make_automaton()
        self.symbols = {b: ord(s) for b, s in enumerate(byte_symbols())}
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.stood: dict[int, bool] = {}
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        kinds = [(SPACE, regex.compile(r"\s")), (LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}"))]
        self.kind = np.array([next((k for k, r in kinds if r.match(chr(c))), OTHER) for c in range(0xA000)], np.uint8)

    def stands(self, a: int, b: int) -> bool:
        """Whether tokens a and b may be neighbours: undo their merges, the latest first, and look for one across the border.

        A merge across the border wins if it comes before the one that takes its left token away, and not after the one that
        takes its right token away: of equal pairs the leftmost is merged first.
        """
        key = a * self.n + b
        made, merge, n = self.made, self.merge, self.n
        a_ends = b_ends = NEVER
        while True:
            rank = merge.get(a * n + b)
            if rank is not None and rank < a_ends and rank <= b_ends:
                found = False
                break
            if made[a] < 0 and made[b] < 0:
                found = True
                break
            if made[a] > made[b]:
                a_ends, a = made[a], self.right[a]
            else:
                b_ends, b = made[b], self.left[b]
        if len(self.stood) >= CACHED_PAIRS:
            self.stood.clear()
        self.stood[key] = found
        return found

    def last_tokens(self, word: str) -> tuple[int, ...]:
        """Ids of a word, given as symbols of which the last bears the end mark."""
        stands, stood, n = self.stands, self.stood, self.n
        last: list[int | None] = [None] * (len(word) + 1)
        last[-1] = -1  # the empty prefix, found one before the first symbol
        size = [0] * len(word)
        for end, packed in self.automaton.iter(word):
            if last[end] is None:
                length = packed & LENGTH
                before = last[end - length]
                if before is not None:
                    token = packed >> LENGTH_BITS
                    fits = before < 0 or stood.get(before * n + token)
                    if fits is None:
                        fits = stands(before, token)
                    if fits:
                        last[end], size[end] = token, length
        ids = []
        at = len(word) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        return tuple(reversed(ids))

    def word(self, word: bytes) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            symbols = word.decode("latin-1").translate(self.symbols)
            ids = self.last_tokens(symbols[:-1] + chr(ord(symbols[-1]) + END_MARK))
            if len(word) <= CACHED_SYMBOLS:
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def odd_text(self, text: str) -> list[int]:
        """Ids of a text with special tokens or with characters outside ``PLAIN``."""
        ids: list[int] = []
        for part in self.splitter.split(text) if self.splitter else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    ids.extend(self.last_tokens(word[:-1] + chr(ord(word[-1]) + END_MARK)))
        return ids

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of lower-case plain texts, and the number of each text's first word (one more for the end)."""
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        base, size = int(bounds[0]), int(bounds[-1] - bounds[0])
        bounds = bounds - base
        if not size:
            return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8, size, base)
        kind = self.kind[raw]
        high = np.flatnonzero(raw >= 0x80)
        if len(high):
            b = np.append(raw, np.zeros(2, np.uint8)).astype(np.int32)
            kind[high] = INSIDE
            two, three = high[(raw[high] >= 0xC0) & (raw[high] < 0xE0)], high[raw[high] >= 0xE0]
            kind[two] = self.kind[(b[two] & 31) << 6 | b[two + 1] & 63]
            kind[three] = self.kind[(b[three] & 15) << 12 | (b[three + 1] & 63) << 6 | b[three + 2] & 63]
            # What lies inside a character is of its kind.
            whole = kind != INSIDE
            kind = kind[whole][np.cumsum(whole) - 1]
        else:
            whole = None
        begins = np.ones(size, bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begins[bounds[:-1][bounds[:-1] < size]] = True
        if whole is not None:
            begins &= whole
        # An apostrophe that begins its run takes one of these endings along.
        quote = np.flatnonzero((raw == 0x27) & begins)
        if len(quote):
            end = bounds[np.searchsorted(bounds, quote, "right")]
            ahead = np.append(raw, np.zeros(2, np.uint8))
            one, two = np.where(quote + 1 < end, ahead[quote + 1], 0), np.where(quote + 2 < end, ahead[quote + 2], 0)
            taken = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
            for pair in (b"re", b"ve", b"ll"):
                taken[(one == pair[0]) & (two == pair[1])] = 2
            quote, taken = quote[taken > 0], taken[taken > 0]
            begins[quote + 1] = False
            after = quote + 1 + taken
            begins[after[after < size]] = True
            kind = kind.copy()
            kind[quote] = LETTER
        start = np.flatnonzero(begins)
        keep = kind[start] != SPACE
        length = np.diff(np.append(start, size))
        inside = np.repeat(keep, length)
        start, length = start[keep], length[keep]
        offsets = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(raw[inside]).tobytes())])
        return words, np.searchsorted(start, bounds)

    def texts(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and the ends of each text in them, in runs of texts."""
        odd = pc.match_substring_regex(texts, f"[^{PLAIN}]")
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        odd = np.asarray(odd)
        plain = pc.utf8_lower(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts).cast(pa.large_binary())
        words, first = self.words(plain)
        coded = words.dictionary_encode()
        found = [self.word(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found))
        begin = np.cumsum(size) - size
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
        which = np.asarray(coded.indices)
        sizes = size[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(begin[which], sizes) + np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)]
        ends = ends[first]
        if not odd.any():
            return [(ids, ends)]
        own: list[np.ndarray] = []
        for i, is_odd in enumerate(odd.tolist()):
            own.append(np.array(self.odd_text(texts[i].as_py()), np.int32) if is_odd else ids[ends[i] : ends[i + 1]])
        return [(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]))]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


@functools.lru_cache(maxsize=4)
def token_names(path: str) -> TokenNames:
    return TokenNames(path)


def _columns(rows: DataFrame, *without: str) -> list[str]:
    return [c for c in rows.columns if c not in without]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows without their text, and ``ids``: the ids of the whole text without special tokens added."""
    kept = _columns(docs, text, ids)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0)]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part, texts in B.slices(pa.Table.from_batches([batch])):
                at = 0
                for flat, ends in coder.texts(texts.cast(pa.large_string())):
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(lists)), lists], names=["row", "ids"])
                    at += len(lists)

    schema = StructType([*source.select("row").schema, StructField("ids", ArrayType(IntegerType()))])
    found = source.mapInArrow(run, schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("ids").alias(ids))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with ``decoded``: the names of their tokens, word ends included, joined by one space."""
    kept = _columns(rows, text)
    source = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_names(path)
        for batch in batches:
            lists = batch.column(1)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            at = 0
            while at < len(lists):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + DECODED_AT_ONCE, "right")) - 1)
                flat = np.asarray(lists.values.slice(bounds[at], bounds[to] - bounds[at]).fill_null(-1))
                good = (flat >= 0) & (flat < len(coder.names))
                good[good] = coder.named[flat[good]]
                ends = (bounds[at : to + 1] - bounds[at]) if good.all() else np.concatenate([[0], np.cumsum(good)])[bounds[at : to + 1] - bounds[at]]
                names = coder.array.take(pa.array(flat[good]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names), " ")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), joined], names=["row", "decoded"])
                at = to

    found = source.mapInArrow(run, StructType([*source.select("row").schema, StructField("decoded", StringType())]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("decoded").alias(text))
