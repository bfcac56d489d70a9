"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13
),
named AS (SELECT doc_id, p, hash(list_slice(w, p, p + 12)) AS h1, md5(array_to_string(list_slice(w, p, p + 12), ' ')) AS h2 FROM win),
rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h1, h2) AS first_doc FROM named) WHERE first_doc < doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM rep),
gl AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.i) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(gl.g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gl USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
crc AS (SELECT doc_id, w, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS c FROM d),
flag AS (SELECT doc_id, w, xor(c, 4294967295::UBIGINT) % 10 = 0 AS held_out FROM crc),
tok AS (
  SELECT doc_id, held_out, unnest(list_append(w, ' ')) AS t, unnest(list_prepend(' ', w)) AS v,
         unnest(list_slice(list_concat([NULL, ' '], w), 1, len(w) + 1)) AS u FROM flag
),
uni AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t),
pair AS (SELECT v, t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY v, t),
tri AS (SELECT u, v, t, count(*) AS c FROM tok WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, t),
tot AS (SELECT CAST(sum(c) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS vv, CAST(count(*) FILTER (c = 1) AS DOUBLE) AS n1,
        CAST(count(*) FILTER (c = 2) AS DOUBLE) AS n2 FROM uni),
par AS (SELECT n, vv, n1 / (n1 + 2 * n2) AS dd FROM tot),
scored AS (
  SELECT tok.doc_id, tok.held_out, coalesce(u.c, 0) AS c, coalesce(h.c, 0) AS cv, coalesce(pair.c, 0) AS c2, coalesce(uv.c, 0) AS cuv, coalesce(tri.c, 0) AS c3,
         CASE WHEN u.c IS NULL THEN dd * vv / n ELSE (u.c - dd) / n END AS p, n, vv
  FROM tok CROSS JOIN par LEFT JOIN uni u ON u.t = tok.t LEFT JOIN uni h ON h.t = tok.v
  LEFT JOIN pair ON pair.v = tok.v AND pair.t = tok.t LEFT JOIN pair uv ON uv.v = tok.u AND uv.t = tok.v
  LEFT JOIN tri ON tri.u = tok.u AND tri.v = tok.v AND tri.t = tok.t
),
backed AS (
  SELECT *, (c2 + 30.0 * p) / (cv + 30.0) AS p2,
         CASE WHEN c2 > 0 THEN log10((c2 + 30.0 * p) / (cv + 30.0)) ELSE log10(30.0 / (cv + 30.0)) + log10(p) END AS l2 FROM scored
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       round(fsum(log10((c + 0.1) / (n + 0.1 * (vv + 1)))), 6) AS base_score,
       round(fsum(CASE WHEN c3 > 0 THEN log10((c3 + 5.0 * p2) / (cuv + 5.0)) ELSE log10(5.0 / (cuv + 5.0)) + l2 END), 6) AS score
FROM backed GROUP BY doc_id, held_out
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT keyed.*, hot.k IS NOT NULL AND hot.keeper <> doc_id AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT item_id, least(len(w), 13) AS m, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM it WHERE len(w) > 0
),
iwin AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS win FROM iw),
ms AS (SELECT DISTINCT m FROM iwin),
dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d CROSS JOIN ms WHERE len(w) >= m),
dwin AS (SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS win FROM dw),
hit AS (SELECT dwin.doc_id, dwin.p, dwin.m, iwin.item_id FROM dwin JOIN iwin ON dwin.m = iwin.m AND dwin.win = iwin.win),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LADDER = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03, 0.02, 0.01),
    "repeats": (0.2, 0.19, 0.18, 0.17, 0.16, 0.15, 0.12, 0.1, 0.08, 0.05),
    "duplicate_lines": (0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "capitals": (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08),
    "marks": (0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.03),
}

OP10 = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM w WHERE len(w) >= 5),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, p, p + 4), ' ')) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS i FROM win WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang AS stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(b) AS BIGINT) AS word_chars,
         CAST(length(b) - length(regexp_replace(b, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
         length(b) - length(regexp_replace(b, '\p{{Lu}}', '', 'g')) AS n_capitals,
         length(b) - length(regexp_replace(b, '[!?]', '', 'g')) AS n_marks
  FROM (SELECT *, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS b,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w) w
  LEFT JOIN rep USING (doc_id)
),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         coalesce(CAST(n_symbols AS DOUBLE) / nullif(word_chars, 0), 0) AS symbols, coalesce(CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0), 0) AS repeats,
         coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 0) AS duplicate_lines,
         coalesce(CAST(n_capitals AS DOUBLE) / nullif(word_chars, 0), 0) AS capitals, coalesce(CAST(n_marks AS DOUBLE) / nullif(word_chars, 0), 0) AS marks
  FROM m
),
sure AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
held AS (SELECT f.*, quality FROM f JOIN sure USING (doc_id) WHERE NOT base_failed),
tests AS (
  SELECT stratum, s, sum(quality) AS good, count(*) FILTER (hit AND quality = 1) AS g, count(*) FILTER (hit AND quality = 0) AS b
  FROM (SELECT held.stratum, held.quality, unnest([{", ".join(str(s + 1) for s in range(10))}]) AS s,
               unnest([{", ".join("(" + " OR ".join(f"{r} >= CAST({c[s]} AS DOUBLE)" for r, c in _LADDER.items()) + ")" for s in range(10))}]) AS hit FROM held)
  GROUP BY stratum, s
),
tail AS (
  SELECT t.*, (SELECT sum(exp(lgamma(t.good + 1) - lgamma(j + 1) - lgamma(t.good - j + 1) + j * ln(0.03::DOUBLE) + (t.good - j) * ln(0.97::DOUBLE)))
               FROM range(0, t.g + 1) r(j)) AS p FROM tests t WHERE t.good > 0
),
valid AS (SELECT * FROM tail WHERE p <= 0.05 / (SELECT count(DISTINCT coalesce(stratum, '?')) FROM held) AND b > 10 * g),
cut AS (SELECT stratum, arg_max(s, (b - 10 * g) * 100 - s) AS s FROM valid GROUP BY stratum),
level AS (SELECT *, CASE {" ".join("WHEN " + " OR ".join(f"{r} >= CAST({c[s]} AS DOUBLE)" for r, c in _LADDER.items()) + f" THEN {s + 1}" for s in range(10))} ELSE 11 END AS level FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(level <= s, false) AS kept
FROM level LEFT JOIN cut ON level.stratum IS NOT DISTINCT FROM cut.stratum
"""

OP12 = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT pos.anchor_id, positive_id, row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark),
tot AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
wt AS (SELECT t, CAST(floor(1000 * ln((CAST(2 AS DOUBLE) * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, tot GROUP BY t, nn),
m AS (SELECT doc_id, 50 + (50 * len(w) * nn) // ll AS m FROM d, tot WHERE len(w) > 0),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN wt USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""
