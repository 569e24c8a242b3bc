"""DuckDB SQL for the operators' queries, written from their contracts."""

from rankloom.llm.secrets import ALLOWED, CLASSES, SCALE, most_units

SPACES = r"""' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"""

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
      HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.line, k.pos, f.first IS NOT NULL AND f.first <> k.doc_id AS gone
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

WINDOW = 20
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"


def _spans(kind: int, pattern: str, value: str) -> str:
    return f"""SELECT doc_id, {kind} AS kind, list_sum(list_transform(found[1:i - 1], lambda x: length(x)))
               AS hits, list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS gap, found[i] AS hit, {value} AS value
               FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found,
                            string_split_regex(text, '{pattern}') AS gaps,
                            unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i, text FROM d)"""


_whole = [p for p in ALLOWED if p.startswith("^")]
_cut = "|".join(f"({p})" for p in ALLOWED if not p.startswith("^"))


def _allowed(value: str) -> str:
    return " OR ".join(f"regexp_matches({value}, '{p}')" for p in _whole)


_class = " ".join(
    f"WHEN regexp_full_match(piece, '[{c.characters}]+') THEN {most_units(c.bits, WINDOW)}" for c in CLASSES
)

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_spans(0, _ASSIGN, f"regexp_extract_all(text, '{_ASSIGN}', 2)[i]")}
  UNION ALL {_spans(1, "AKIA[A-Z0-9]+", "found[i]")}
  UNION ALL {_spans(2, "[0-9a-f]{16,}", "found[i]")}
  UNION ALL {_spans(3, _CANDIDATE, "found[i]")}),
placed AS (SELECT row_number() OVER () AS span, doc_id, kind, value, coalesce(hits, 0) + gap AS first,
                  coalesce(hits, 0) + gap + length(hit) AS last FROM raw
           WHERE length(value) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 WHEN 2 THEN 16 ELSE {WINDOW} END),
pieces AS (SELECT span, unnest(string_split_regex(value, '{_cut}')) AS piece FROM placed
           WHERE kind = 3 AND NOT ({_allowed("value")})),
unsure AS (SELECT row_number() OVER () AS place, span, piece AS value, CASE {_class} ELSE -1 END AS most FROM pieces
           WHERE length(piece) >= {WINDOW} AND NOT ({_allowed("piece")})),
windows AS (SELECT place, span, most, value, unnest(range(1, length(value) - {WINDOW - 2})) AS i FROM unsure),
chars AS (SELECT place, span, most, i, substring(value, i + j, 1) AS c FROM windows, range({WINDOW}) AS t(j)),
counts AS (SELECT place, span, most, i, c, count(*) AS n FROM chars GROUP BY ALL),
sums AS (SELECT place, span, most, i, sum(CAST(round(n * log2(n) * {SCALE}) AS BIGINT)) AS units FROM counts GROUP BY ALL),
found AS (SELECT DISTINCT span FROM sums WHERE units <= most),
final AS (SELECT doc_id, kind, first, last,
                 ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || first || ':' || last AS said
          FROM placed WHERE kind < 3 OR span IN (FROM found)),
said AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
                count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
                string_agg(said, ',' ORDER BY first, kind) FILTER (kind < 3) AS base,
                string_agg(said, ',' ORDER BY first, kind) AS spans FROM final GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said ON d.doc_id = said.doc_id
"""
