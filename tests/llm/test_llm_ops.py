"""The corpus operators against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import chat_format, decontamination, line_dedup, lm_scoring, packing, pii, quality_rules, simhash, substring_dedup, toxicity

rng = random.Random(7)
VOCAB = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    passage = prose(40)
    texts = [prose(rng.randint(0, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " " + passage, prose(20) + "\t" + passage + "\n" + prose(15), passage, "a " * 60, "x " + "a " * 70, None, "", "one", "  \n\n ", "é ü " * 30, "x" * 5000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, "block", "x", 1) for i, t in rows], "doc_id long, text string, block string, rest string, names long").repartition(5)


@pytest.fixture(scope="module")
def texts():
    rng.seed(7)
    return dict(corpus())


@pytest.fixture(scope="module", autouse=True)
def seeded():
    rng.seed(7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def collected(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_substring_dedup(docs, empty):
    source = collected(docs)
    first = {}
    for d in sorted(source):
        w = words(source[d])
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), d)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got.keys() == source.keys()
    for d, t in source.items():
        w = words(t)
        gone = {i for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < d for i in range(p, p + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert any(r.n_removed for r in got.values())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_low_names_agree_inside_equal_windows():
    r = np.random.default_rng(1)
    a = r.integers(0, 5, 300).astype(np.uint64)
    b = np.concatenate([r.integers(0, 5, 50).astype(np.uint64), a[100:140], r.integers(0, 5, 50).astype(np.uint64)])
    names = []
    for x, off in ((a, 100), (b, 50)):
        sym, lo, hi, _ = substring_dedup.low_names(x, np.zeros(len(x), int))
        inside = (lo >= off) & (hi <= off + 40)
        names.append({(int(s), int(i) - off, int(j) - off) for s, i, j in zip(sym[inside], lo[inside], hi[inside])})
    assert names[0] == names[1] and names[0]


def test_lm_scoring(docs, empty):
    source = collected(docs)
    low = lambda t: [x.translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})) for x in words(t)] + ["\0"]
    seen = {}
    for d, t in source.items():
        if d % 4:
            w = low(t)
            for i in range(len(w)):
                for k in range(4):
                    if i >= k - 1:
                        gram = tuple((["\0", *w])[i + 1 - k : i + 2])
                        seen[gram] = seen.get(gram, 0) + 1
    uni = {g[0]: c for g, c in seen.items() if len(g) == 1}
    n, v = sum(uni.values()), len(uni)
    n1, n2 = (sum(c == k for c in uni.values()) for k in (1, 2))
    disc = n1 / (n1 + 2 * n2)

    def prob(gram, mu):
        if len(gram) == 1:
            return (seen.get(gram, 0) - disc) / n if gram in seen else disc * v / n
        m = mu[len(gram) - 2]
        return (seen.get(gram, 0) + m * prob(gram[1:], mu)) / (seen.get(gram[:-1], 0) + m)

    for mu in (lm_scoring.MU, (5.0,), (30.0, 3.0, 1.0)):
        got = {r.doc_id: r for r in lm_scoring.score(docs, F.col("doc_id") % 4 != 0, mu).collect()}
        for d, t in source.items():
            w = ["\0", *low(t)]
            base = sum(np.log10((uni.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w[1:])
            score = sum(np.log10(prob(tuple(w[max(0, i - len(mu)) : i + 1]), mu)) for i in range(1, len(w)))
            assert got[d].train_tokens == n and got[d].n_tokens == len(w) - 1 and got[d].n_known == sum(x in uni for x in w[1:])
            assert got[d].base_score == pytest.approx(base, abs=1e-8) and got[d].score == pytest.approx(score, abs=1e-8)
    assert lm_scoring.score(empty, F.lit(True)).count() == 0


def test_lm_automaton_has_states_and_failure_arcs(docs):
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    table = pa.table({"doc_id": [1, 2], "text": ["a b c a b d", "a b c"], "train": [True, False]})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    grams = lm_scoring.Grams(pa.table({"packed": [sink.getvalue().to_pybytes()]}), 3)
    auto = lm_scoring.Automaton(grams, grams.own, np.array([7, 5, 3, 2]), lm_scoring.MU)
    assert [int(s.sum()) for s in auto.state[1:]] == [5, 6] and len(auto.failure) == 3
    assert (auto.traverse() < 0).all() and not auto.seen[3].all()


def test_asked_rows_grow_with_the_blocks_alone(docs, monkeypatch):
    """A quarter and a sixteenth of the block bytes: rows in proportion to the blocks, not to their square."""
    from storyloom.llm import blocks

    size, counts = blocks.text_bytes(docs), {}
    for n in (1, 4, 16):
        dealt = blocks.blocked(docs, size // (4 * n), F.lit(True).alias("train"))
        held = dealt.select("block").distinct().count()
        counts[n] = dealt.groupBy("block").applyInArrow(lambda t: lm_scoring.ask_short(t, 8, 2), blocks.ASK).count()
        assert counts[n] <= (2 * 8 + 1) * held and held <= 8 * n + 10
    assert blocks.bucket_count(10**9) == blocks.MIN_BUCKETS and blocks.block_bytes(10**9) == blocks.BLOCK_BYTES


def test_words_of_a_pattern_differ():
    import pyarrow as pa

    from storyloom.llm import blocks

    turn = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(11):
        word += word.translate(turn)
    found = blocks.Words(pa.array([f"{word} {word.translate(turn)} {word}"]))
    assert found.hash[0] != found.hash[1] and found.hash[0] == found.hash[2]


def test_parts_of_a_bucket(monkeypatch):
    from storyloom.llm import blocks

    r = np.random.default_rng(3)
    rows, want = [], {}
    for block in range(5):
        names = np.unique(r.integers(0, 2**64, 300, dtype=np.uint64))
        vals = r.integers(-9, 9, (len(names), 2))
        rows += blocks.asked(block, 7, names, vals, 1)
        want |= {(int(n), block): v.tolist() for n, v in zip(names, vals)}
    got = {}
    for most in (100, 10**6):
        for names, vals, of in blocks.parts_of(blocks.table_of(rows, blocks.ASK_ARROW), 7, most=most):
            got |= {(int(n), int(b)): v.tolist() for n, v, b in zip(names, vals, of)}
        assert got == want


def test_lm_probabilities_sum_to_one():
    c, mu = np.array([5.0, 3, 1, 1]), 10.0
    n, v, d = c.sum(), 4, 0.5
    p = np.append((c - d) / n, d * v / n)
    assert p.sum() == pytest.approx(1)
    seen = np.array([2.0, 0, 1, 0, 0])
    assert ((seen + mu * p) / (seen.sum() + mu)).sum() == pytest.approx(1)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    long = docs.select("doc_id", F.when(F.col("doc_id") == 1, F.repeat(F.lit("word salad 漢字 "), 600)).when(F.col("doc_id") == 2, F.lit("a<|endoftext|>b")).otherwise(F.col("text")).alias("text"))
    source, t = collected(long), Tokenizer.from_file(path)
    rows = packing.pack(packing.pieces(long, path, ranks, 256), 256).collect()
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == source.keys()
    for d, text in source.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by[d], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 256 for r in parts[1:]) and (len(parts) == 1 or len(ids) > 256)
        for r in parts:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in rows) // 256) + 2
    assert packing.pack(packing.pieces(empty, path, ranks)).count() == 0


def test_packing_capacities():
    counts = {60: 7, 30: 11, 10: 40, 1: 5}
    for rule in ("norm", "dot"):
        for caps in ((100, 3, 10**9), (100, 100, 4500)):
            held = {}
            for length, a, b, per, first, at in packing.plan(counts, caps, rule=rule):
                for r in range(b - a):
                    held.setdefault(first + r // per, []).append(length)
            assert sorted(x for h in held.values() for x in h) == sorted(x for k, n in counts.items() for x in [k] * n)
            assert all(sum(h) <= caps[0] and len(h) <= caps[1] and sum(x * x for x in h) <= caps[2] for h in held.values())
    with pytest.raises(ValueError):
        packing.plan({101: 1}, (100, 100, 10**9))


def test_pii_base_patterns(spark):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    alphabet = ["@", ".", "a", "b1", "9", "12", "4111111111111111", "5500-0000 0000 0004", "+1 (555) 123-4567", " ", "\n", "-", "+", "é", "1.2.3.4", "300.1.1.1", "x@y.z", "@@", ".."]
    local = random.Random(3)
    for _ in range(1500):
        t = "".join(local.choice(alphabet) for _ in range(local.randint(0, 14)))
        want = [(m.start(), "email", m.end()) for m in email.finditer(t)]
        want += [(m.start(), "ip", m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), "card", m.end()) for m in card.finditer(t) if 14 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
        want += [(m.start(), "phone", m.end()) for m in phone.finditer(t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], pii.ORDER[s[1]])), t


def test_pii_very_long_numbers():
    text = "1.2.3." + "9" * 5000 + " and 0001.2.3.255 and 1.2.3." + "0" * 6000 + "7"
    kinds = [k for _, k, _ in pii.base_spans(text)]
    assert kinds == ["ip", "ip"]


def test_pii_rejected_candidates_block_nothing():
    text = "see aaaaaaaaaaaa123-45-6789 or ssn 123-45-6789"
    found = pii.candidates("x abcdefghij1234-AB12CDEFGHIJ34567 y", [])
    assert found == sorted(found, key=lambda c: (c[0], -c[1]))
    both = pii.candidates("key=AB12CDEFGHIJ34567890", [])
    assert {c[2] for c in both} == {"secret", "account"} and len(both) == 2
    assert pii.candidates(text, [(0, "email", len(text))]) == []


def test_pii_expectation_maximisation_is_that_of_single_spans():
    """Over spans one by one, in plain loops, with the same start and pseudo-counts."""
    r = random.Random(2)
    patterns = [("".join(r.choice("-0+") for _ in range(3)), r.randint(1, 6)) for _ in range(8)]
    patterns = sorted(dict(patterns).items())
    spans = [p for p, n in patterns for _ in range(n)]
    one = 1e4 / len(spans)
    belief = {p: 1 / (1 + math.exp(-1.5 * (p.count("+") - 1.5 * p.count("-") - 1))) for p in set(spans)}
    for _ in range(60):
        score = {p: [0.0, 0.0] for p in belief}
        for side in (0, 1):
            weight = [one * (belief[p] if side else 1 - belief[p]) for p in spans]
            for p in score:
                score[p][side] += math.log(sum(weight) + 1)
            for j in range(3):
                share = dict(zip("-0+", (0.5, 1.0, 2.0) if side else (2.0, 1.0, 0.5)))
                for p, w in zip(spans, weight):
                    share[p[j]] += w
                for p in score:
                    score[p][side] += math.log(share[p[j]] / sum(share.values()))
        belief = {p: 1 / (1 + math.exp(max(-30.0, min(30.0, a - b)))) for p, (a, b) in score.items()}
    got = pii.reliabilities(patterns)
    assert got.keys() == belief.keys() and all(got[p] == pytest.approx(belief[p], abs=1e-9) for p in belief)


def test_pii_finds_secrets(spark, empty):
    rows = [(i, f"plain words {i} here AKIA{'ABCDEFGH23456789'[i % 5:]}{'QRSTU'[:i % 5]} and password={hashlib.md5(str(i).encode()).hexdigest()[:18]} mail a{i}@b.example.org end thisisaverylongplainword2") for i in range(30)]
    rows += [(100, None), (101, "")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == got[101].spans == ""
    for i in range(30):
        kinds = [s.split(":")[0] for s in got[i].spans.split(",")]
        assert kinds.count("secret") == 2 and kinds.count("email") == got[i].n_email == 1
    assert pii.find(empty).count() == 0


def test_pii_judges_a_mix_alike_at_every_size():
    mix = [("+0++++0", "secret|2|1|0", 40), ("0000+-0", "secret|2|0|0", 900), ("+0+00++", "secret|2|2|0", 3), ("0-000-0", "account|1|2|1", 57)]

    def judged(times):
        belief = pii.reliabilities([(v, n * times) for v, _, n in mix])
        return pii.span_classifier([(v, s, n * times) for v, s, n in mix], belief)

    small, large = judged(1), judged(100_000)
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-6 for k in small)


def test_pii_written_emails_in_any_case():
    for t in ("name (AT) host (DOT) com", "name [At] host [dot] com", "name(aT)host(Dot)com", "name [at] host [dot] com"):
        assert [k for _, _, k, _, _ in pii.candidates(t, [])] == ["written_email"], t


def test_fingerprints(docs):
    import xxhash

    for r in simhash.fingerprints(docs).join(docs, "doc_id").collect():
        w = words((r.text or "").lower())
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert r.bits & (2**64 - 1) == want


@pytest.mark.parametrize("cell", [8, 1024])
def test_simhash_links(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = np.random.default_rng(5)
    seeds = r.integers(0, 2**64, 12, dtype=np.uint64)
    rows = [int(s) for s in r.integers(0, 2**64, 60, dtype=np.uint64)]
    for s in seeds:
        x = int(s)
        for _ in range(15):
            rows.append(x)
            for b in r.choice(64, r.integers(1, 6), replace=False):
                x ^= 1 << int(b)
    fps = np.unique(np.array(rows, np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    a, b = np.nonzero(near)
    want = simhash.components_of(len(fps), a, b)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "bits long")
    got = {x.node: x.component for x in simhash.components(simhash.similar(df)).collect()}
    signed = fps.view(np.int64)
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(int(w), set()).add(int(signed[i]))
    found = {}
    for s in signed.tolist():
        found.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_near_duplicates_cases(spark, empty):
    t = prose(200)
    rows = [(5, t), (3, t), (9, t), (7, None), (4, ""), (6, prose(200)), (6, prose(150))]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (6, 6), (6, 6), (7, 4), (9, 3)]
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [3, 4, 6, 6]
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_by_radius(spark):
    """Against all pairs of fingerprints, at the pipeline's settings; and a hot component over salts."""
    r = random.Random(5)
    base = [[f"v{r.randrange(5000)}" for _ in range(200)] for _ in range(12)]
    rows = []
    for i in range(240):
        w = list(base[i % 12] if i % 3 else base[0])
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(200)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, most=6).collect()}
    prints = [simhash.fingerprint(t.encode(), 5) for _, t in rows]
    label = list(range(240))
    for _ in range(240):
        new = [min(label[j] for j in range(240) if (prints[i] ^ prints[j]).bit_count() <= 6) for i in range(240)]
        if new == label:
            break
        label = new
    assert got == dict(enumerate(label))
    assert simhash.spare_chunks(10**6, 4) == 2 and simhash.spare_chunks(10**10, 4) == 3
    for spare in (2, 3):
        shapes = simhash.views(4, spare)
        assert all(sum(b - a for a, b in order) == 64 for order, _ in shapes) and len(shapes) == {2: 15, 3: 35}[spare]


def test_components_of_long_chains(spark):
    """A chain of edits whose ids come in any order: neighbour minima alone need some hundred rounds."""
    order = np.random.default_rng(1).permutation(400) * 7 - 900
    chain = [(int(min(x)), int(max(x))) for x in zip(order, order[1:])]
    pairs = [(10_000, 10_001), (10_001, 10_002)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(chain + pairs, "a long, b long")).collect()}
    assert got == {int(x): -900 for x in order} | {10_000: 10_000, 10_001: 10_000, 10_002: 10_000}


def test_line_dedup(spark, empty):
    shared = "This line is shared by several documents."
    rows = [(1, f"{shared}\nown one\n{shared}"), (2, f"x\n  {shared.upper()}\t\nshort"), (3, f"{shared}\n{shared}\nend"), (4, None), (5, ""), (6, "short\nshort"), (7, "Only two documents hold this line"), (8, "Only two documents hold this line"), (2, "again " + shared)]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.shared_lines(df).collect())
    assert got == sorted([(1, 3, 2, "own one"), (2, 3, 1, "x\nshort"), (3, 3, 0, rows[2][1]), (4, 1, 0, ""), (5, 1, 0, ""), (6, 2, 0, "short\nshort"), (7, 1, 0, rows[6][1]), (8, 1, 0, rows[7][1]), (2, 1, 0, rows[8][1])])
    for r in line_dedup.shared_lines(df).filter("doc_id = 1").collect():
        assert np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), count=3).tolist() == [0, 1, 0]
    out = line_dedup.without_shared_lines(df)
    assert out.columns == df.columns and all(r.n_chars == len(r.text) for r in out.collect())
    assert line_dedup.shared_lines(empty).count() == 0


def test_line_dedup_over_many_ranges(spark):
    """A very common line, repeated ids and texts, over ranges that cut it, against brute force."""
    rng.seed(11)
    lines = [f"a line of some length, number {i}" for i in range(40)]
    rows = []
    for i in range(300):
        own = ["the line that a third of all rows is made of"] * rng.randint(0, 3) + rng.sample(lines, rng.randint(0, 3)) + [f"only here is line number {i}"] * rng.randint(0, 2)
        rng.shuffle(own)
        rows.append((i if i % 9 else 500, "\n".join(own)))
    rows += [(None, "the line that a third of all rows is made of"), rows[5], rows[5]]
    holders = {}
    for d, t in rows:
        for x in t.split("\n"):
            if len(x) >= 20:
                holders.setdefault(x, set()).add(2**63 if d is None else d)
    want = sorted((2**63 if d is None else d, "\n".join(x for x in t.split("\n") if len(holders.get(x, ())) < 3 or (2**63 if d is None else d) == max(holders[x]))) for d, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for n in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((2**63 if r.doc_id is None else r.doc_id, r.kept_text) for r in line_dedup.shared_lines(df).collect())
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_decontamination(spark, docs, empty):
    source = collected(docs)
    items = [(1, " ".join(words(source[4])[10:40])), (2, "only four short words"), (3, None), (4, "..."), (5, prose(30)), (None, "x"), (10, " ".join(words(source[4])[20:50]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(900, "He said: ONLY four, short words!", "b", "r", 1)], docs.schema)
    both = docs.unionByName(extra)
    source[900] = "He said: ONLY four, short words!"
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for parts in (10**9, 60):
        for r in decontamination.contamination(both, bench, part_bytes=parts).collect():
            w, hit, found = low(source[r.row.doc_id]), set(), set()
            for i, t in items:
                x = low(t)
                if i is None or not x:
                    continue
                m = min(13, len(x))
                grams = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)}
                for p in range(len(w) - m + 1):
                    if tuple(w[p : p + m]) in grams:
                        hit.update(range(p, p + m))
                        found.add(str(i))
            assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(found))
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            if r.row.doc_id == 4:
                assert r.longest_match >= 30
    kept = decontamination.decontaminated(both, bench)
    assert kept.columns == both.columns and 900 not in {r.doc_id for r in kept.collect()}
    assert decontamination.contamination(empty, bench).count() == 0


def test_toxicity(spark, empty):
    rng.seed(11)
    bad = ["snorgle", "blatherskite", "fopdoodle"]
    rows, labels = [], []
    for i in range(400):
        w = prose(60).split()
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic)))
    rows += [(1000, "you snorgel of the and blatherskit w1 w2"), (1001, None), (1002, "")]
    df = spark.createDataFrame([(r[0], r[1], 0.5) for r in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, lab, F.col("doc_id") % 4 != 2).collect()}
    held = [i for i in range(400) if i % 4 == 2]
    assert sum((got[i].predicted == 1) == (i % 5 == 0) for i in held) / len(held) > 0.95
    assert got[1000].n_misspelled == 1 and got[1001].score == got[1002].score < 0.3
    assert toxicity.score(empty, lab, F.lit(True)).count() == 0
    assert all(r.score == 0 for r in toxicity.score(df.limit(5), lab.filter("toxic = 0"), F.lit(True)).collect())


def test_toxicity_misspelled_inflected_terms(spark):
    one = [("idiot", 104, 0), ("idiots", 6, 0), *((f"{'idiots'[:k]}*", 110, 0) for k in (4, 5))]
    match = toxicity.Matcher(toxicity.choose(one, 500, 2000))
    assert [match(w) for w in ("idiot", "ideot", "1diot", "iidiot", "radio")] == [1, 3, 3, 3, 0]
    # A stem that says more than each of its words: these are searched misspelled as well.
    forms, rows = ["snorgle", "snorgling", "snorgled", "snorgler"], []
    for i in range(400):
        w = [f"w{(i * 7 + j * j) % 61}" for j in range(40)]
        if i % 5 == 0:
            w[i % 40] = forms[i // 5 % 4]
        rows.append((i, " ".join(w)))
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    df = spark.createDataFrame([*rows, (1000, "w1 sn0rgle w2 xnorgling w3")], "doc_id long, text string")
    assert "snorgle" in toxicity.learn(df, lab, F.lit(True))[1]
    assert toxicity.score(df, lab, F.lit(True)).filter("doc_id = 1000").first().n_misspelled == 2


def test_toxicity_scores_by_brute_force(spark):
    """The whole score from the learned lexicon and weights, with edit distances and windows worked out word by word."""
    rng.seed(21)
    rows, labels = [], []
    for i in range(400):
        t = prose(25).split()
        if i % 5 == 0:
            t[rng.randrange(25)] = rng.choice(["scumbag", "vermin!", "scumbags", "Loser"])
        if i % 7 == 0:
            t[3:6] = ['"they', rng.choice(["scumbag", "vermim"]), 'said"']
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(900, None), (901, ""), (902, "vermn " * 3000), rows[5], (None, "scumbag")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(7, 3), (8, None)], "doc_id long, toxic int")
    train = F.col("doc_id") % 3 != 0
    lexicon, spelled, w = toxicity.learn(df, lab, train)
    assert lexicon and w is not None

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    terms = {t for t in lexicon if not t.endswith("*")}
    near, seen = {t for t in terms.union(spelled) if len(t) >= 5}, {}

    def kind(token):
        if token not in seen:
            word = token.strip(toxicity.EDGE)
            stem = any(t.endswith("*") and word.startswith(t[:-1]) for t in lexicon)
            seen[token] = 1 if word in terms else 2 if stem else 3 if any(distance(word, t) <= 1 for t in near) else 0
        return seen[token]

    def score(text):
        tokens = (text or "").lower().split()
        kinds = [kind(t) for t in tokens]
        sums = [0] * 5
        for i, k in enumerate(kinds):
            if k:
                a, b = max(0, i - toxicity.WINDOW), i + toxicity.WINDOW + 1
                ends = [t.rstrip(".,;:!?")[-1:] for t in tokens[i:b]]
                quoted = any(t[0] in toxicity.OPEN for t in tokens[a : i + 1]) and any(e and e in toxicity.CLOSE for e in ends)
                sums[3 if quoted else k - 1] += 1
                sums[4] += any(kinds[j] for j in range(a, min(b, len(tokens))) if j != i)
        x = [1.0, *(math.log1p(v) for v in sums), float(sums[0] + sums[1] > 0), math.sqrt(sum(sums[:3]) / max(len(tokens), 1))]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(p * q for p, q in zip(x, w))))))

    got = sorted(((r.doc_id is None, r.doc_id or 0), r.score, r.predicted) for r in toxicity.score(df, lab, train).collect())
    want = sorted(((d is None, d or 0), score(t)) for d, t in rows)
    assert len(got) == len(want)
    for (d, s, p), (e, v) in zip(got, want):
        assert d == e and s == pytest.approx(v, abs=1e-9) and p == int(s >= 0.3)


def test_levenshtein_trie_is_exact():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    lexicon = {w: 1.0 for w in ("stupid", "moron", "idiot", "worthless")}
    match, local = toxicity.Matcher(lexicon), random.Random(2)
    for _ in range(3000):
        w = list(local.choice(list(lexicon)))
        for _ in range(local.randint(0, 3)):
            k = local.randrange(len(w) + 1)
            local.choice((lambda: w.insert(k, local.choice("abst")), lambda: w.pop(min(k, len(w) - 1)) if w else None, lambda: w.__setitem__(min(k, len(w) - 1), "q") if w else None))()
        word = "".join(w)
        want = 1 if word in lexicon else 3 if word and min(distance(word, t) for t in lexicon) <= 1 else 0
        assert match(word) == want, word


def test_quality_rules(spark, empty):
    rng.seed(5)
    rows, labels = [], []
    for i in range(2400):
        junk = i % 8 == 0
        t = " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(400)) + ("$$$" if junk else "") for _ in range(25))
        rows.append((i, t, "en" if i % 2 else None))
        labels.append((i, int(not junk), 0))
    rows += [(9000, None, "xx"), (9001, "one two three four five " * 6, "xx"), (9002, "é " * 3, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.verdicts(df, lab).collect()}
    assert all(got[i].kept == (i % 8 != 0) for i in range(2400))
    assert got[9000].base_failed and got[9000].n_words == 0 and got[9001].base_failed and got[9001].n_repeat_words == 30
    out = quality_rules.accepted(df, lab)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.verdicts(empty.withColumn("lang", F.lit("en")), lab).count() == 0


def test_quality_promise_holds(spark):
    """Strata whose mildest level rejects more good documents than allowed: hardly ever is one chosen."""
    r = np.random.default_rng(4)
    rows, labels, trials, n = [], [], 60, 220
    for s in range(trials):
        bad = r.random(n) < quality_rules.RISK * 1.02
        rows += [(s * n + i, f"s{s}", False, int(x)) for i, x in enumerate(np.where(bad, 1, 11))]
        rows += [(10**6 + s * 400 + i, f"s{s}", False, 1) for i in range(400)]
        labels += [(s * n + i, 1) for i in range(n)] + [(10**6 + s * 400 + i, 0) for i in range(400)]
    found = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, level int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality_rules.proven(found, lab).count() == 0
    alone = [quality_rules.proven(found.filter(F.col("stratum") == f"s{s}"), lab).count() for s in range(12)]
    assert sum(alone) <= 3


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 500), (3, 500), (20, 1000), (7, 7), (0, 1)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    for r in df.collect():
        want = min(1.0, sum(comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.k + 1)))
        assert r.p == pytest.approx(want, rel=1e-9)


def test_repeat_words(docs):
    for r in quality_rules.measured(docs, "doc_id", "text").collect():
        w = words(r.text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))


def turns(spark):
    rng.seed(9)
    rows = []
    for c in range(40):
        n = 700 if c == 0 else rng.randint(2, 8)
        for t in range(n):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, prose(5) + "?" if role == "user" else prose(60) + ".\n" + prose(20)))
    rows += [(77, 0, "user", None), (77, None, None, "User: hello"), (None, 0, None, "AI> hi")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_format(spark):
    df = turns(spark)
    train = F.col("conv_id") % 3 != 0
    got = chat_format.recover(df, train, segment=64).collect()
    assert len(got) == df.count()
    held = [r for r in got if r.conv_id is not None and r.conv_id < 40 and r.conv_id % 3 == 0]
    assert sum(r.role == r.found_role for r in held) / len(held) > 0.97
    whole = {(r.conv_id, r.turn, r.body): r.found_role for r in chat_format.recover(df, train, segment=10**6).collect()}
    assert whole == {(r.conv_id, r.turn, r.body): r.found_role for r in got}
    assert next(r for r in got if r.conv_id == 77 and r.turn is None).body == "hello"


def test_chat_markers(spark):
    """Only the marker of the role that was found goes, and only once."""
    rows = [("Context: the answer is 42", "assistant", "Context: the answer is 42"), ("Assistant: AI: hello", "assistant", "AI: hello"), ("User: hi", "user", "hi"), ("User: hi", "assistant", "User: hi"), ("", "user", "")]
    df = spark.createDataFrame(rows, "text string, role string, want string")
    assert all(r.got == r.want for r in df.select("want", chat_format.body(F.col("text"), F.col("role")).alias("got")).collect())


def test_viterbi_is_exact():
    from itertools import product

    r = np.random.default_rng(3)
    start, step, score = r.normal(size=3), r.normal(size=(3, 3)), r.normal(size=(6, 3))
    best = max(product(range(3), repeat=6), key=lambda p: start[p[0]] + score[0, p[0]] + sum(step[a, b] + score[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:]))))
    assert chat_format.viterbi(start, score, step) == list(best)


def test_transcript_blocks(spark):
    df = spark.createDataFrame([(1, "Human: hi there\nhow are you?\nAI: fine\n\nthanks"), (2, None)], "conv_id long, text string")
    rows = [(r.turn, r.text) for r in chat_format.blocks_of(df).orderBy("turn").collect()]
    assert [t for _, t in rows] == ["Human: hi there\nhow are you?", "AI: fine", "thanks"]
