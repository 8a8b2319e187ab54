"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

# --- personal data and secrets -------------------------------------------------

_LUHN = """list_sum(list_transform(range(1, length(x) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(x[length(x) - i + 1] AS INT)
             WHEN CAST(x[length(x) - i + 1] AS INT) > 4 THEN CAST(x[length(x) - i + 1] AS INT) * 2 - 9
             ELSE CAST(x[length(x) - i + 1] AS INT) * 2 END)) % 10 = 0"""


def placed(kind: str, rank: int, pattern: str, flags: str = "") -> str:
    """Rows (doc_id, kind, rank, s, e, hit) of all leftmost matches of one pattern."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS rank, hit,
           sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id ORDER BY n) - length(hit) AS s,
           sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id ORDER BY n) AS e
    FROM (SELECT doc_id, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS piece, generate_subscripts(hits, 1) AS n
          FROM (SELECT doc_id, regexp_extract_all(text, $re${pattern}$re$) AS hits,
                       string_split_regex(text, $re${pattern}$re$) AS pieces
                FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) WHERE len(hits) > 0)"""


PII = f"""
WITH raw AS ({" UNION ALL ".join([
    placed("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    placed("ip", 2, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    placed("card", 3, r"[0-9](?:[\x20-]?[0-9])+"),
    placed("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]"),
    placed("iban", 5, r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
])}),
digits AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS x FROM raw),
good AS (
    SELECT * FROM digits WHERE CASE kind
        WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS INT), 999) > 255)) = 0
        WHEN 'card' THEN length(x) BETWEEN 12 AND 19 AND {_LUHN}
        WHEN 'phone' THEN length(x) BETWEEN 9 AND 15
        WHEN 'iban' THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(hit[5:] || hit[1:4], ''),
              lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END)),
              lambda a, d: CASE WHEN d < 10 THEN (a * 10 + d) % 97 ELSE (a * 100 + d) % 97 END) = 1
        ELSE true END),
told AS (SELECT *, substr(text, CAST(greatest(1, s + 1 - 40) AS BIGINT), CAST(least(40, s) AS BIGINT)) AS before FROM good JOIN documents USING (doc_id)),
line AS (SELECT *, kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS part,
    CASE kind WHEN 'email' THEN 90 + 10 * CAST(regexp_matches(before, '(?i)mail|contact|write to') AS INT)
        WHEN 'ip' THEN 60 + 10 * CAST(regexp_matches(before, '(?i)\bip\b|address|host|server') AS INT)
        WHEN 'card' THEN 70 + 10 * CAST(regexp_matches(before, '(?i)card|visa|credit|carte|karte|tarjeta') AS INT)
        WHEN 'phone' THEN 60 + 10 * CAST(regexp_matches(before, '(?i)phone|call|tel|mobile') AS INT)
        ELSE 90 + 10 * CAST(regexp_matches(before, '(?i)iban|account|bank|konto|compte|cuenta') AS INT) END AS score FROM told),
by_doc AS (
    SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
           count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
           string_agg(part, ',' ORDER BY s, rank) FILTER (kind <> 'iban') AS base,
           string_agg(part, ',' ORDER BY s, rank) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank) AS scores
    FROM line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""

# --- benchmark decontamination -------------------------------------------------

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (
    SELECT s.doc_id, s.i, z.k, array_to_string(s.w[s.i:s.i + z.k - 1], ' ') AS g
    FROM spot s, sizes z WHERE s.i + z.k - 1 <= len(s.w)),
hit AS (SELECT o.doc_id, o.i, o.k, n.item_id FROM occ o JOIN win n USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# --- secrets -------------------------------------------------------------------

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = f"""
WITH raw AS ({" UNION ALL ".join([
    placed("assign", 1, _ASSIGN),
    placed("access", 2, "AKIA[A-Z0-9]+"),
    placed("hex", 3, "[0-9a-f]+"),
    placed("opaque", 4, "[A-Za-z0-9_-]+"),
])}),
valued AS (SELECT *, CASE WHEN kind = 'assign' THEN regexp_extract(hit, $re${_ASSIGN}$re$, 1) ELSE hit END AS v FROM raw),
good AS (
    SELECT * FROM valued WHERE CASE kind WHEN 'assign' THEN length(v) >= 6 WHEN 'access' THEN length(v) >= 20 WHEN 'hex' THEN length(v) >= 24
        ELSE length(v) >= 32 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') END),
live AS (SELECT v FROM good JOIN documents USING (doc_id) GROUP BY v HAVING count(DISTINCT source) <= 2 AND count(DISTINCT doc_id) <= 20),
every AS (
    SELECT doc_id, kind, rank, s, e FROM good WHERE rank <= 3 OR v IN (SELECT v FROM live)
    UNION ALL SELECT DISTINCT doc_id, 'live', 5, e - length(v), e FROM good WHERE v IN (SELECT v FROM live)),
line AS (SELECT *, kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS part FROM every),
by_doc AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex, string_agg(part, ',' ORDER BY s, rank) FILTER (rank <= 3) AS base,
           string_agg(part, ',' ORDER BY s, rank, e) AS spans
    FROM line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""

# --- embeddings ----------------------------------------------------------------

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
edges AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, g.w FROM reach r JOIN edges g ON r.w = g.u),
label AS (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY u),
links AS (SELECT u AS vec_id, count(*) AS n FROM edges GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN label USING (vec_id) LEFT JOIN links USING (vec_id)
"""

# --- repeated passages ---------------------------------------------------------

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS line FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
