"""Personal data and secrets: fixed patterns, and more spans by weak supervision.

The base patterns (email, ip, card, phone) are exact and always stay.  Further *candidates*
(long tokens with digits, values behind key words, national numbers, account numbers,
written-out emails, local phone numbers, hardware addresses) are judged without labels:
each of seven labelers (formats, checksums, a gazetteer of key words, context, entropy, word
shape, isolation) votes for, against, or abstains.  Spark counts the vote patterns over the
whole corpus; expectation-maximisation on that table estimates how reliable each labeler is
and how likely each pattern is personal; a logistic span classifier over votes and shape
buckets is trained on those soft labels and decides.  There are at most 3^7 patterns times
the shape buckets, so the table's size does not depend on the corpus.  The text is read once:
candidates wait in a written table.

Defined cases: a null text is empty; a candidate that overlaps a base span is left out, and
so is an accepted one that overlaps an earlier accepted one (a rejected one blocks nothing); without candidates only base spans are returned; repeated rows are
searched each; other columns are ignored.

Written e-mails (name [at] host [dot] com) are searched up to 64 characters before the at and 63 in a label,
the limits of such addresses.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import blocks as B

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "national_id", "account", "written_email", "local_phone", "hardware")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A first digit behind another digit can't begin a match that its run's first digit could not; looking back keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            found.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def byte_value(digits: str) -> bool:
    """At most 255, whatever the number of digits."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind."""
    found = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(byte_value(p) for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(ch.isdigit() for ch in m[0]) <= 15:
            found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], ORDER[s[1]]))


# Candidate patterns; the value is the group.
TOKEN = re.compile(r"(?<![A-Za-z0-9_/+-])([A-Za-z0-9_/+-]{12,}+)")
KEYED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\x20?[:=]\x20?[\"']?([^\s\"']{6,})")
NATIONAL = re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])")
WRITTEN = re.compile(r"(?i)(?<![\w.+-])([a-z0-9._+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{1,63})+)")
AT = tuple(a + t + end for a in "aA" for t in "tT" for end in "])")  # each written email holds one
LOCAL_PHONE = re.compile(r"(?<![0-9+)(.-])(\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![0-9-])")
HARDWARE = re.compile(r"(?<![0-9A-Fa-f:])((?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2})(?![0-9A-Fa-f:])")
# Key words of the gazetteer in English, German, Spanish and French, by what they announce.
GAZETTEER = {
    "secret": ("password", "passwd", "pwd", "passphrase", "secret", "token", "api key", "apikey", "api_key", "access key", "access_key", "private key", "credential", "bearer", "auth", "pin",
               "passwort", "kennwort", "geheim", "schlüssel", "zugang", "contraseña", "clave", "secreto", "mot de passe", "clé", "jeton", "identifiant"),
    "national_id": ("ssn", "social security", "national id", "passport", "tax id", "taxpayer", "sozialversicherung", "steuernummer", "ausweis", "reisepass", "seguridad social", "dni", "nif", "pasaporte", "sécurité sociale", "passeport", "numéro fiscal"),
    "account": ("iban", "account", "bank", "acct", "routing", "swift", "bic", "konto", "bankverbindung", "überweisung", "cuenta", "banco", "compte", "banque", "virement"),
    "written_email": ("email", "e-mail", "mail", "contact", "write", "reach", "kontakt", "schreib", "correo", "contacto", "courriel", "écrire", "contacter"),
    "local_phone": ("phone", "tel", "call", "mobile", "cell", "fax", "dial", "ring", "telefon", "handy", "anruf", "ruf", "teléfono", "móvil", "llamar", "llame", "téléphone", "portable", "appel"),
    "hardware": ("mac", "device", "hardware", "adapter", "interface", "ethernet", "wifi", "bluetooth", "gerät", "netzwerk", "dispositivo", "équipement", "appareil"),
}
FORMATS = [re.compile(p) for p in (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"sk-[A-Za-z0-9_-]{20,}", r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}", r"[0-9a-f]{16,}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}")]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def account_number(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def votes(text: str, kind: str, a: int, b: int) -> str:
    """One letter a labeler: + for, - against, 0 abstains."""
    value = text[a:b]
    left, right = text[max(0, a - 24) : a].lower(), text[b : b + 1]
    digits, letters = any(ch.isdigit() for ch in value), any(ch.isalpha() for ch in value)
    h = entropy(value)
    vowels = sum(ch in "aeiouáéíóúäöüàèêAEIOU" for ch in value) / len(value)
    return "".join((
        "+" if any(f.fullmatch(value) for f in FORMATS) or kind in ("written_email", "local_phone") else "0",
        ("+" if account_number(value) else "-") if kind == "account" else "0",
        "+" if any(w in left for w in GAZETTEER[kind]) else "0",
        "+" if re.search(r"[:=]\x20?[\"']?$", left) else "0",
        "+" if h >= 2.8 and digits and letters else ("-" if h < 2.2 else "0"),
        "-" if letters and (not digits or vowels > 0.3) else ("+" if digits and vowels < 0.15 else "0"),
        "+" if (not right or right in " \t\n\"',.;)") and (not left or left[-1] in " \t\n\"'=:(") else "-",
    ))


def shape(kind: str, value: str) -> str:
    n = len(value)
    digits = sum(ch.isdigit() for ch in value)
    return f"{kind}|{min(n // 8, 6)}|{4 * digits // n}|{4 * sum(ch.isupper() for ch in value) // n}"


def candidates(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, votes, shape) by start, the longest first; none overlaps a base span."""
    found = []
    for m in TOKEN.finditer(text):
        if any(ch in "0123456789" for ch in m[1]) and not m[1].isdigit():
            found.append((m.start(1), "secret", m.end(1)))
    low = text if "=" in text or ":" in text else ""
    for pattern, kind, on in ((KEYED, "secret", low), (NATIONAL, "national_id", text if "-" in text else ""), (ACCOUNT, "account", text), (WRITTEN, "written_email", text if any(x in text for x in AT) else ""), (LOCAL_PHONE, "local_phone", text), (HARDWARE, "hardware", low)):
        if on:
            found += [(m.start(1), kind, m.end(1)) for m in pattern.finditer(on)]
    out, at = [], 0
    bounds = sorted((a, b) for a, _, b in taken)
    for a, kind, b in sorted(set(found), key=lambda s: (s[0], -s[2], -ORDER[s[1]])):
        while at < len(bounds) and bounds[at][1] <= a:
            at += 1
        if not any(x < b for x, _ in bounds[at : at + 1]):
            out.append((a, b, kind, votes(text, kind, a, b), shape(kind, text[a:b])))
    return out


def weights(counts: list[int], total: float = 1e4) -> np.ndarray:
    """Shares of all spans times a fixed total, so that the same mix is judged alike at every size."""
    n = np.array(counts, float)
    return n * (total / n.sum())


def reliabilities(patterns: list[tuple[str, int]], steps: int = 60) -> dict[str, float]:
    """Expectation-maximisation over vote patterns: the probability that a span with this pattern is personal."""
    if not patterns:
        return {}
    codes = np.array([["-0+".index(ch) for ch in p] for p, _ in patterns])
    n = weights([c for _, c in patterns])
    belief = 1 / (1 + np.exp(-1.5 * ((codes == 2).sum(axis=1) - 1.5 * (codes == 0).sum(axis=1) - 1)))
    for _ in range(steps):
        score = np.zeros((len(n), 2))
        for side, weight in enumerate((n * (1 - belief), n * belief)):
            score[:, side] = np.log(weight.sum() + 1)
            for j in range(codes.shape[1]):
                # Labelers are taken to be better than chance: a pseudo-count backs a vote on its own side.
                prior = np.array([2.0, 1.0, 0.5]) if side == 0 else np.array([0.5, 1.0, 2.0])
                share = np.bincount(codes[:, j], weight, 3) + prior
                score[:, side] += np.log(share / share.sum())[codes[:, j]]
        belief = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -30, 30)))
    return {p: float(b) for (p, _), b in zip(patterns, belief)}


def span_classifier(table: list[tuple[str, str, int]], belief: dict[str, float], penalty: float = 1.0) -> dict[tuple[str, str], float]:
    """Logistic regression on votes and shape buckets, trained on soft labels; the probability of every pattern and shape."""
    if not table:
        return {}
    names: dict[str, int] = {}
    rows = []
    for votes_, shape_, _ in table:
        facts = [f"{i}{v}" for i, v in enumerate(votes_) if v != "0"] + [f"s{i}{v}" for i, v in enumerate(shape_.split("|"))]
        rows.append([names.setdefault(f, len(names)) for f in facts])
    y = np.array([belief[v] for v, _, _ in table])
    n = weights([c for _, _, c in table])
    width = len(names) + 1

    def parts(size: int = 50_000):
        """The 0/1 matrix of facts, some rows at a time."""
        for at in range(0, len(rows), size):
            x = np.zeros((min(size, len(rows) - at), width))
            x[:, -1] = 1
            for i, r in enumerate(rows[at : at + size]):
                x[i, r] = 1
            yield slice(at, at + len(x)), x

    w = np.zeros(width)
    for _ in range(40):
        curve, slope = penalty * np.eye(width), -penalty * w
        for at, x in parts():
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve += (x * (n[at] * p * (1 - p))[:, None]).T @ x
            slope += x.T @ (n[at] * (y[at] - p))
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    p = np.concatenate([1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for _, x in parts()])
    return {(v, s): float(q) for (v, s, _), q in zip(table, p)}


def find(docs: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, n_added, base_spans and spans ("kind:start:end" by start, code points, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in B.slices(pa.Table.from_batches([batch])):
                base, more = [], []
                for t in texts:
                    text = t.as_py().decode()
                    spans = base_spans(text)
                    base.append([{"kind": k, "start": a, "end": b} for a, k, b in spans])
                    more.append([{"kind": k, "start": a, "end": b, "votes": v, "shape": s} for a, b, k, v, s in candidates(text, spans)])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(base, SPANS), pa.array(more, CANDIDATES)], names=["doc_id", "base", "more"])

    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    SPANS = pa.list_(pa.struct(span))
    CANDIDATES = pa.list_(pa.struct([*span, ("votes", pa.string()), ("shape", pa.string())]))
    kind = "kind:string,start:bigint,end:bigint"
    found = B.stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base array<struct<{kind}>>, more array<struct<{kind},votes:string,shape:string>>"), "pii-candidates")
    each = found.select(F.inline("more"))
    table = [(r["votes"], r["shape"], r["count"]) for r in each.groupBy("votes", "shape").count().collect()]  # one row for each pattern and shape bucket
    patterns = Counter()
    for v, _, n in table:
        patterns[v] += n
    chance = span_classifier(table, reliabilities(sorted(patterns.items())))
    sure = found.sparkSession.sparkContext.broadcast({k for k, p in chance.items() if p >= cutoff})  # at most 3^7 patterns times the shape buckets

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = batch.column(1).to_pylist(), []
            for row in batch.column(2).to_pylist():
                kept, end = [], 0
                for x in row:
                    if x["start"] >= end and (x["votes"], x["shape"]) in sure.value:
                        kept.append(x)
                        end = x["end"]
                spans.append(kept)
            both = [sorted(b + s, key=lambda x: (x["start"], ORDER[x["kind"]])) for b, s in zip(base, spans)]
            text = lambda rows: pa.array([",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r) for r in rows], pa.string())
            counts = [pa.array([sum(x["kind"] == k for x in r) for r in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([len(s) for s in spans], pa.int64()), text(base), text(both)], names=["doc_id", *(f"n_{k}" for k in BASE), "n_added", "base_spans", "spans"])

    return found.select("doc_id", "base", "more").mapInArrow(accept, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_spans string, spans string")
