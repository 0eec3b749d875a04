"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _decontaminate() -> str:
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({_LOW.format('text')}, {words}) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram, least(len(w), 10) AS size
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, {words}) AS w FROM documents),
grams AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, p, grams.size AS size, item_id FROM grams JOIN win USING (gram)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS at FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _warc() -> str:
    digits = "['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']"
    bits = f"array_to_string(list_transform(range(1, 41), lambda i: {digits}[strpos('0123456789abcdef', substr(x, i, 1))]), '')"
    five = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
    return f"""
WITH s AS (SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, {bits} AS bits, min(page_id) OVER (PARTITION BY x) AS first FROM s)
SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {five}, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""


def _jaccard() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format('text')}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
edges AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS doc, doc_id AS node FROM documents UNION SELECT doc, v FROM reach JOIN edges ON node = u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT doc AS doc_id, min(node) AS component_id FROM reach GROUP BY doc) USING (doc_id)"""


def _secrets() -> str:
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
        ("hex", r"[0-9a-f]{24,}", 0, 24),
        ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 10),
    )
    parts = []
    for no, (kind, pattern, group, least) in enumerate(kinds):
        parts.append(
            f"SELECT doc_id, owner, repository, {no} AS no, '{kind}' AS kind, {least} AS least, i, m[i] AS m, v[i] AS v, "
            "coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) + list_sum(list_transform(g[1:i], lambda x: len(x))) AS start_ FROM ("
            f"SELECT doc_id, owner, repository, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, owner, repository, regexp_extract_all(t, '{pattern}') AS m, "
            f"regexp_extract_all(t, '{pattern}', {group}) AS v, regexp_split_to_array(t, '{pattern}') AS g FROM d) WHERE len(m) > 0)"
        )
    union = "\nUNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
s AS (SELECT doc_id, owner, repository, no, kind, v, CAST(start_ AS BIGINT) AS a, CAST(start_ + len(m) AS BIGINT) AS e FROM ({union}) WHERE len(v) >= least),
st AS (SELECT v, count(DISTINCT owner) <= 2 AND count(DISTINCT owner || chr(0) || repository) <= 4 AS live FROM s GROUP BY v),
j AS (SELECT s.*, live, concat(kind, ':', a, ':', e) AS span FROM s JOIN st USING (v) WHERE no < 3 OR live),
g AS (
  SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
         string_agg(span, ',' ORDER BY a, no, e) FILTER (no < 3) AS base, string_agg(span, ',' ORDER BY a, no, e) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (doc_id)"""


def _resample(buckets: int = 10_000, percent: int = 25, least: int = 20, seed: int = 7) -> str:
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    # checksum by half bytes, low half first, through a table of 16 entries made by its rule
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    entries = f"[{', '.join(f'{x}::BIGINT' for x in table)}]"
    halves = "list_transform(range(0, len(x)), lambda i: CAST(strpos('0123456789ABCDEF', substr(x, CAST(i // 2 * 2 + 2 - i % 2 AS INTEGER), 1)) - 1 AS BIGINT))"
    # ``CROSS JOIN`` on one-row totals only
    return rf"""
WITH raw AS (
  SELECT doc_id, 0 AS kind, regexp_extract_all({_LOW.format('text')}, {words}) AS w FROM documents
  UNION ALL SELECT NULL, 1, regexp_extract_all({_LOW.format('text')}, {words}) FROM benchmark),
f AS (SELECT doc_id, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM raw),
d AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
c AS (
  SELECT f, xor(list_reduce({halves}, lambda a, b: xor(list_extract({entries}, CAST(xor(a, b) & 15 AS INTEGER) + 1), a >> 4), 4294967295::BIGINT), 4294967295::BIGINT) % {buckets} AS bucket
  FROM d),
n AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN c USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (ss + {buckets})) / (CAST(s + 1 AS DOUBLE) * (tt + {buckets})))) AS gain
  FROM n CROSS JOIN (SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(sum(t) AS DOUBLE) AS tt FROM n)),
w AS (SELECT doc_id, floor(sum(gain) / count(*)) AS weight FROM f JOIN c USING (f) JOIN g USING (bucket) WHERE kind = 0 GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n_words, CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) AS h FROM raw WHERE kind = 0),
r AS (
  SELECT doc_id, n_words, CAST(CASE WHEN n_words = 0 THEN 0 ELSE 2 * n_words - 1 END AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM h LEFT JOIN w USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= {least}) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least} AND place <= {percent} * n // 100 THEN place END AS rank FROM o"""


def _chat_format() -> str:
    from .chat import CONTROLS, END, SEP, TURN

    quoted = lambda s: "".join("\\" + c if c in "[]|" else c for c in s)
    text = lambda c: f"coalesce({c}, '')"

    def escaped(column: str) -> str:
        out = text(column)
        for c in CONTROLS:
            out = rf"regexp_replace({out}, '({quoted(c[0])})(\\*{quoted(c[1:])})', '\1\\\2', 'g')"
        return out

    return f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg({text('role')} || chr(10) || {text('text')} || chr(10), '' ORDER BY turn) AS turns,
         coalesce(string_agg({text('text')}, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(length({escaped('role')}) + length({escaped('text')}) + {len(TURN + SEP + END)}) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain squared distances, in doubles that hold whole numbers."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM (SELECT *, unnest(range({parts})) AS part FROM v))""",
        f"""b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))""",
    ]
    distance = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, part, CAST(dd % 1000 AS BIGINT) AS entry, CAST(dd // 1000 AS BIGINT) AS dist
  FROM (SELECT vec_id, part, min(CAST({distance} AS BIGINT) * 1000 + entry) AS dd FROM p JOIN b{r} b USING (part) GROUP BY vec_id, part))"""
        )
        if r < rounds:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY k) AS x FROM (
      SELECT part, entry, k, floor(sum(x[k]) / count(*)) AS m FROM (SELECT part, entry, p.x AS x, unnest(range(1, len(p.x) + 1)) AS k FROM p JOIN a{r} USING (vec_id, part)) GROUP BY part, entry, k)
    GROUP BY part, entry) n USING (part, entry))"""
            )
    return f"""
WITH {','.join(steps)},
e AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS k FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (vec_id) CROSS JOIN s"""


ORACLE = {
    "op2_secrets": _secrets(),
    "op4_decontaminate": _decontaminate(),
    "op6_warc": _warc(),
    "op8_jaccard": _jaccard(),
    "op11_resample": _resample(),
    "op12_chat_format": _chat_format(),
    "op13_vector_codes": _vector_codes(),
}
