"""Personal data by weak supervision.

Patterns propose spans; labelers of three sorts vote on each, for, against or not at all:
patterns and checksums, gazetteers (published number ranges and codes), and the context. Expectation
maximisation over the counts of all vote patterns in the corpus estimates how reliable each
labeler is, and its posteriors train a logistic span classifier on votes and shapes. Spans of
the base kinds that pass their checks are always reported; spans of the added kinds (local
phone numbers, social security numbers, bank accounts) if the classifier is sure of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_table, per_text, plain

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "ssn", "iban")
LABELERS = ("shape", "checksum", "gazetteer", "context", "edges")
#: probability from which a span of an added kind is reported
SURE = 0.9
#: code points before a span that are its context
CONTEXT = 40

# --- proposals ----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: a number that starts inside a run of digits goes on as the whole run does, so runs are
#: tried at their first digit alone
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ADDED = {
    "local_phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @, and a domain with a dot: each @ is tried with all
    that can stand before it, back to the last match."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of every match of every kind; valid: the base checks hold."""
    out = [("email", a, b, True) for a, b in emails(text)]
    for m in _IP.finditer(text):
        out.append(("ip", *m.span(), all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 7:  # shorter ones are ordinary numbers, and never valid
            d = digits_of(m[0])
            out.append(("card", *m.span(), 13 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text):
        out.append(("phone", *m.span(), 9 <= len(digits_of(m[0])) <= 15))
    for kind, pattern in _ADDED.items():
        out += [(kind, *m.span(), True) for m in pattern.finditer(text)]
    return out


# --- labelers -----------------------------------------------------------------------------

# fixed values: top-level domains, country calling codes, card prefixes, account lengths
_TLDS = frozenset("com org net edu gov io co uk de fr es it nl eu ch at be us ca au jp cn in br ru pl se no fi dk info biz me".split())
_CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
_CARD_PREFIXES = ("34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "6", "2")
_IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_CUES = {
    "email": ("mail", "contact", "correo", "courriel", "write"),
    "ip": ("ip", "host", "addr", "server", "login"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobil", "fax", "cell"),
    "local_phone": ("phone", "tel", "call", "mobil", "fax", "cell"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
}
_AGAINST = ("version", "isbn", "issn", "build", "order", "invoice", "serial", "part", "doi", "page")
_LETTERS = re.compile(r"[a-z]+")


def votes(text: str, kind: str, start: int, end: int, valid: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1, 0 (none) or -1."""
    s = text[start:end]
    d = digits_of(s)
    seps = sum(c in " -.()" for c in s)
    shape = {
        "email": len(s) <= 254 and ".." not in s and s[0] not in ".%+-",
        "ip": all(g == "0" or g[:1] != "0" for g in s.split(".")),
        "card": seps in (0, 3, 4),
        "phone": 9 <= len(d) <= 15 and seps <= 6,
        "local_phone": len(d) == 10,
        "ssn": True,
        "iban": 15 <= len(s.replace(" ", "")) <= 34,
    }[kind]
    checksum = 0
    if kind in ("ip", "card", "phone"):
        checksum = 1 if valid else -1
    elif kind == "iban":
        checksum = 1 if mod97(s) else -1
    gazetteer = {
        "email": s.rpartition(".")[2].lower() in _TLDS,
        "ip": not s.startswith(("0.", "127.", "255.")),
        "card": d.startswith(_CARD_PREFIXES),
        "phone": d.startswith(_CALLING),
        "local_phone": d[:1] not in ("0", "1") and d[3:4] not in ("0", "1"),
        "ssn": d[:3] not in ("000", "666") and d[:1] != "9" and d[3:5] != "00" and d[5:] != "0000",
        "iban": _IBAN_LENGTHS.get(s[:2]) == len(s.replace(" ", "")),
    }[kind]
    words = _LETTERS.findall(text[max(0, start - CONTEXT) : start].lower())[-4:]
    cue = any(w.startswith(c) for w in words for c in _CUES[kind])
    against = any(w.startswith(c) for w in words for c in _AGAINST)
    edge = (start and (text[start - 1].isalnum() or text[start - 1] in "._-/=")) or (end < len(text) and (text[end].isalnum() or text[end] in "_-/="))
    return 1 if shape else -1, checksum, 1 if gazetteer else -1, 1 if cue else -1 if against else 0, -1 if edge else 1


def pattern_of(text: str, kind: str, start: int, end: int, valid: bool) -> str:
    """All that the models see of a span: kind, votes, binned length and digits, separators."""
    s = text[start:end]
    v = "".join("n0p"[x + 1] for x in votes(text, kind, start, end, valid))
    seps = any(c in " -.()" for c in s)
    return f"{kind}|{v}|{min(5, len(s) // 6)}|{min(5, len(digits_of(s)) // 3)}|{int(seps)}"


# --- models -------------------------------------------------------------------------------


def estimate(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of every pattern, and the labelers' vote probabilities [labeler, vote, class],
    by expectation maximisation over the counted vote patterns."""
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], np.float64)
    kind = np.array([KINDS.index(p.split("|")[0]) for p in names], np.int64)
    v = np.array([["n0p".index(c) for c in p.split("|")[1]] for p in names], np.int64).reshape(-1, len(LABELERS))
    share = (v == 2).sum(1) / np.maximum(1, (v != 1).sum(1))
    post = np.clip(share, 0.05, 0.95)
    rates = np.ones((len(LABELERS), 3, 2)) / 3
    for _ in range(rounds if names else 0):
        weight = np.stack([n * (1 - post), n * post], 1)
        prior = np.ones((len(KINDS), 2))
        np.add.at(prior, kind, weight)
        prior /= prior.sum(1, keepdims=True)
        for j in range(len(LABELERS)):
            rates[j] = 0.5  # a few imagined votes, so that no rate is 0
            np.add.at(rates[j], v[:, j], weight)
            rates[j] /= rates[j].sum(0)
        log = np.log(prior[kind]) + sum(np.log(rates[j][v[:, j]]) for j in range(len(LABELERS)))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return dict(zip(names, post.tolist(), strict=True)), rates


def features(pattern: str) -> np.ndarray:
    kind, v, length, digits, seps = pattern.split("|")
    x = np.zeros(1 + len(KINDS) + 3 * len(LABELERS) + 13)
    x[0] = 1
    x[1 + KINDS.index(kind)] = 1
    at = 1 + len(KINDS)
    for j, c in enumerate(v):
        x[at + 3 * j + "n0p".index(c)] = 1
    at += 3 * len(LABELERS)
    x[at + int(length)] = 1
    x[at + 6 + int(digits)] = 1
    x[at + 12] = int(seps)
    return x


def train(patterns: dict[str, int], posterior: dict[str, float], l2: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Logistic regression of the posteriors on the features, by Newton's method over patterns;
    counts weigh by their logarithm, so frequent shapes do not drown the others."""
    names = sorted(patterns)
    if not names:
        return np.zeros(len(features("email|00000|0|0|0")))
    x = np.array([features(p) for p in names])
    y = np.array([posterior[p] for p in names])
    n = 1 + np.log(np.array([patterns[p] for p in names], np.float64))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + l2 * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


# --- the operator -------------------------------------------------------------------------

SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("valid", T.BooleanType()), T.StructField("pattern", T.StringType())]
)


def _make():
    def each(column):
        rows = []
        for t in plain(column):
            spans = proposals(t)
            rows.append(([{"kind": k, "start": a, "end": b, "valid": ok, "pattern": pattern_of(t, k, a, b, ok)} for k, a, b, ok in spans],))
        return rows

    return each


def listed(spans: list[tuple[int, int, int]]) -> str:
    """(kind number, start, end) sorted and joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """Per row of ``docs``: counts and digest of the base spans, all spans (code points, by kind,
    then start), and the number of added ones with their probabilities. Null and empty texts
    have no spans; an added span that overlaps a base span, or an added one before it, is not
    reported. Only counts of patterns, of which there is a fixed number, reach the driver."""
    spark = docs.sparkSession
    found = as_table(per_text(docs, text_col, T.StructType([T.StructField("spans", T.ArrayType(SPAN))]), _make, "_p_", [id_col]), "pii-spans")
    spans = found.select(F.col(f"`{id_col}`").alias("id"), F.col("_p_.spans").alias("spans"))
    counts = spans.select(F.explode("spans").alias("s")).groupBy("s.pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = {r.pattern: r.n for r in counts}
    posterior, _ = estimate(patterns)
    weights = train(patterns, posterior)
    chance = {p: float(1 / (1 + np.exp(-np.clip(features(p) @ weights, -30, 30)))) for p in patterns}
    shared = spark.sparkContext.broadcast(chance)
    schema = T.StructType(
        [T.StructField(id_col, spans.schema["id"].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("added_chances", T.ArrayType(T.DoubleType()))]
    )
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = shared.value
        for b in batches:
            rows = []
            for spans in b.column(1).to_pylist():
                base = [(KINDS.index(s["kind"]), s["start"], s["end"]) for s in spans if s["kind"] in BASE and s["valid"]]
                taken = [(a, e) for _, a, e in base]
                added, chances = [], []
                for s in sorted((s for s in spans if s["kind"] not in BASE), key=lambda s: (s["start"], -s["end"])):
                    p = chance[s["pattern"]]
                    if p >= sure and all(s["end"] <= a or s["start"] >= e for a, e in taken):
                        taken.append((s["start"], s["end"]))
                        added.append((KINDS.index(s["kind"]), s["start"], s["end"]))
                        chances.append(p)
                n = [sum(k == i for k, _, _ in base) for i in range(len(BASE))]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added), chances))
            columns = zip(*rows, strict=True) if rows else [[] for _ in out][1:]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True)]], schema=out)

    return spans.mapInArrow(run, schema)
