"""BPE, hard negatives and lexical search against the library, brute force and SQL, and their defined cases."""

import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import blocks, bpe, hard_negatives, lexical_search, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def bpe_texts():
    rng = random.Random(3)
    odd = [
        None, "", " ", "it's 'sam's' don't we'll'll they've I'M ''s !'s 12'd 3're", "x<|endoftext|>Y <|startoftext|>z", "<|endoftext|>", "ΣΑΣ İ ı Å Å é", "日本語 テスト が",
        "\x1c\x85 \xa0x y", "a" * 30_000, "ababab" * 5_000, "\U0001f600 ok", "'", "s'", "'l l", "é" * 999, "\u2028x", "naïve CAFÉ Straße", "\x00\x01",
    ]
    odd += ["".join(rng.choice("abeitshnro'’ .,12É é\n\tlvmd") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    odd += ["".join(rng.choice("abeithnro") for _ in range(rng.randint(0, 200))) for _ in range(100)]
    return odd + ["same text", "same text"]


def test_ids_and_text_are_the_librarys(spark, path, library):
    texts = bpe_texts()
    docs = spark.createDataFrame([(i, t, "row", 5) for i, t in enumerate(texts)], "doc_id long, text string, row string, ids int").repartition(3)
    found = bpe.decode(bpe.encode(docs, path), path)
    assert found.columns == ["doc_id", "row", "ids", "decoded"]
    got = {r.doc_id: (r.ids, r.decoded, r.row) for r in found.collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (want, library.decode(want, skip_special_tokens=False), "row"), t
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, path), path).collect() == []
    assert [tuple(r) for r in bpe.encode(spark.createDataFrame([("a b",)], "text string"), path).collect()] == [(library.encode("a b").ids,)]


def test_decoding_skips_what_names_no_token(spark, path, library):
    rows = spark.createDataFrame([(1, [320, -1, 99_999_999, 49407, 49406]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(rows, path).collect()}
    assert got == {1: library.decode([320, 49407, 49406], skip_special_tokens=False), 2: "", 3: ""}


def test_every_token_encodes_to_itself_and_pairs_match_the_library(path, library):
    e, names = bpe.encoder(path), bpe.token_names(path).names
    rng = random.Random(5)
    words = [n for n in names if n and n.endswith("</w>") and n not in e.special]
    for name in words:
        k = name[:-4]
        assert e.last_tokens(k[:-1] + chr(ord(k[-1]) + bpe.END_MARK)) == (names.index(name),) if rng.random() < 0.02 else True
    letters = [n for n in words if n[:-4].isascii() and n[:-4].isalpha() and n.islower()]
    some = [rng.choice(letters)[:-4] + rng.choice(letters)[:-4] for _ in range(5000)]
    for w, want in zip(some, library.encode_batch(some, add_special_tokens=False)):
        assert list(e.word(w.encode())) == want.ids


def test_plain_characters_are_the_librarys(path, library):
    e = bpe.encoder(path)
    ranges = re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}|\\x\{(\w+)\}", bpe.PLAIN)
    plain = [c for a, b, single in ranges for c in (range(int(a, 16), int(b, 16) + 1) if a else [int(single, 16)])]
    plain = [c for c in plain if c < 0x600 or c % 7 == 0]
    texts = [f"a{chr(c)}! {chr(c)}{chr(c)}b 1{chr(c)}'s" for c in plain]
    got = []
    for ids, ends in e.texts(pa.array(texts, pa.large_string())):
        got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_merge_lists_without_unique_last_tokens_are_refused(tmp_path, path):
    import json

    spec = json.load(open(path, encoding="utf-8"))
    spec["model"]["merges"].append(["t", "he</w>"])  # "the</w>" would come of two merges
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="two merges"):
        bpe.PrefixEncoder(str(bad))


def brute_negatives(rows, positives, negatives, low, high):
    rows = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    for i, l, v in rows:
        if i % 10:
            continue
        ranked = sorted((-dot(v, w), j, m) for j, m, w in rows)
        same = [(-s, j) for s, j, m in ranked if m == l and j != i][:positives]
        for p, j in same:
            good = [(-s, k) for s, k, m in ranked if m != l and low * p <= -100 * s <= high * p][:negatives]
            out += [(i, j, n + 1, k, p, s) for n, (s, k) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        c = rng.choice([0, 8, -8])
        v = [float(rng.randint(-6, 6) + c * (k % 2)) for k in range(8)]
        rows.append((i, rng.randint(0, 3), v if i % 9 else [8.0] * 8))  # many equal rows
    rows += [(300, 1, None), (301, None, [1.0] * 8), (302, 1, [float("nan")] + [1.0] * 7), (303, 2, [None] + [1.0] * 7), (304, 2, [float("inf")] * 8), (None, 1, [1.0] * 8)]
    rows += [(310, 1, []), (311, 2, [3.0, 3.0]), (312, 2, [5.0] * 11), (320, 9, [1.0] * 8), (330, 2, [0.0] * 8), (5, 1, [8.0] * 8), (5, 1, [8.0] * 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label int, vector array<double>, is_anchor string, rank int").repartition(4)
    anchor = F.col("id") % 10 == 0
    want = brute_negatives([(i, l, (v + [0.0] * 12)[:12] if v is not None else None) for i, l, v in rows], 3, 4, 50, 100)
    assert want
    for part in (hard_negatives.PART_BYTES, 500):
        got = sorted(tuple(r) for r in hard_negatives.mine(df, anchor, positives=3, negatives=4, low=50, high=100, part_bytes=part).collect())
        assert got == want
    assert hard_negatives.mine(df.limit(0), anchor).collect() == []
    assert hard_negatives.mine(df, F.lit(False)).collect() == []


def test_lists_end_early_and_lose_nothing():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 60
    x = np.floor(centres[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 16)) * 6)
    ids, labels = np.arange(6000), rng.integers(0, 3, 6000)
    a = hard_negatives.Anchors(ids[::60], labels[::60], x[::60])
    found = hard_negatives.Positives(a, 5)
    seen = sum(found.shard(ids[i : i + 2000], labels[i : i + 2000], x[i : i + 2000]) for i in range(0, 6000, 2000))
    assert seen < 0.5 * len(a.ids) * len(x)
    for k, (i, label, u) in enumerate(zip(a.ids, a.labels, a.x)):
        s = (x @ u).astype(int)
        order = [j for j in np.lexsort((ids, -s)) if labels[j] == label and ids[j] != i][:5]
        assert found.best.ids[k].tolist() == ids[order].tolist()


def test_vectors_too_long_for_64_bits_are_refused():
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.lengths(np.array([[1e10, 1.0]]))


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top):
    own = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    n = sum(1 for _, w in own if w)
    total = sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOW))) & set(df)
        scored = []
        for i, w in own:
            if w:
                m = 100 - 50 + (50 * len(w) * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in asked if t in w)
                if score > 0:
                    scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    rng = random.Random(11)
    common, rare = ["the", "of", "and", "Ünder"], [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(0, 60)))) for i in range(900)]
    docs += [(900 + i, docs[3][1]) for i in range(300)]  # a large group of copies: equal scores
    docs += [(5, None), (6, ""), (7, "w1 " * 4000), (7, "w1 W1 w2"), (None, "w5 w6 the"), (-4, "w5, w6; the--w5"), (8, "--- !!")]
    items = [("a", "the w1 w2 w3 of"), ("b", "w5 w6 W7 w5"), ("c", None), ("d", "--"), ("e", "nowhere"), ("f", docs[3][1]), ("g", "the of and ünder"), ("h", " ".join(rare)), ("h2", "w9 Ünder ünder")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, shard string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id string, text string, rank int")
    want = brute_search(docs, items, 20)
    for part in (lexical_search.PART_BYTES, 300):
        shards = blocks.stored(lexical_search.index(d), "postings")
        got = sorted((tuple(r) for r in lexical_search.search(shards, q, 20, part).collect()), key=str)
        assert got == want
    assert lexical_search.search(shards, q.limit(0)).collect() == []
    nothing = blocks.stored(lexical_search.index(d.limit(0)), "postings")
    assert lexical_search.search(nothing, q).collect() == []


def test_many_shards_and_floors(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{min(int(rng.expovariate(0.05)), 400)}" for _ in range(40))) for i in range(2000)]
    items = [(k, " ".join(f"w{rng.randint(0, 120)}" for _ in range(12))) for k in range(15)]
    shards = blocks.stored(lexical_search.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(24)), "postings")
    assert shards.count() == 24
    got = sorted((tuple(r) for r in lexical_search.search(shards, spark.createDataFrame(items, "item_id int, text string"), 10).collect()), key=str)
    assert got == brute_search(docs, items, 10)


def test_blocks_are_skipped_by_their_bounds():
    """Topics make blocks alike: most blocks of the long lists fail their bound, and none that matters is lost."""
    rng = random.Random(4)
    topics = [rng.sample([f"w{i}" for i in range(60)], 6) for _ in range(40)]
    docs = []
    for _ in range(6000):
        own = topics[rng.randrange(40)] * 2 + [f"n{rng.randrange(500)}" for _ in range(rng.randint(3, 9))]
        docs.append(" ".join(own))
    held = lexical_search.postings(np.arange(len(docs)), pa.array([t.encode() for t in docs], pa.large_binary()))
    row = lexical_search.packed(0, [held]).to_pylist()[0]
    texts = [" ".join(t) for t in topics]
    items = lexical_search.Items(list(range(40)), [t.encode() for t in texts])
    df = np.array([int((held[2] == t).sum()) for t in items.terms])
    items.weigh(len(docs), int(held[1].sum()), df)
    best, shard = hard_negatives.Best(40, 10), lexical_search.Shard(row, items)
    for k in range(40):
        shard.search(k, best, 0)
    assert shard.skipped > 0 and shard.scored < 0.25 * 40 * len(docs)
    want = brute_search(list(enumerate(docs)), list(enumerate(texts)), 10)
    assert sorted([(int(w), int(i), int(s)) for w, s, i in zip(*best.rows())]) == sorted((w, i, s) for w, _, i, s in want)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_lexical_search"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    found = queries.QUERIES[name](spark, DATA)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted(cur.fetchall())
    assert want and sorted(tuple(r) for r in found.select(*names).collect()) == want


def test_bpe_query_equals_the_library(spark, library):
    import hashlib

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_bpe(spark, DATA).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
