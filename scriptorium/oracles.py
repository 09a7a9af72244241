"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

_TOKENS = r"""
docs_tokens AS (
  SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]+|[\x{4e00}-\x{9fff}]') AS base FROM documents),
single AS (SELECT *, list_filter(base, lambda t: regexp_full_match(t, '[\x{4e00}-\x{9fff}]')) AS han FROM docs_tokens),
toks AS (
  SELECT doc_id, coalesce(lang, 'xx') AS scope,
    CASE WHEN len(han) < 2 THEN base ELSE list_concat(base, list_transform(range(1, len(han)), lambda i: han[i] || han[i + 1])) END AS t FROM single),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]+|[\x{4e00}-\x{9fff}]')) AS token FROM benchmark),
tf AS (SELECT doc_id, scope, token, count(*) AS tf FROM (SELECT doc_id, scope, unnest(t) AS token FROM toks) GROUP BY ALL)
"""

_BM25 = _TOKENS + r""",
scored AS (
  SELECT a.item_id, f.doc_id, round(sum(ln(1.0 + (s.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.5 / (f.tf + 1.5 * (0.25 + 0.75 * l.dl / s.av))), 6) AS score
  FROM asked a JOIN tf f USING (token) JOIN (SELECT token, count(*) AS df FROM tf GROUP BY token) d USING (token)
    JOIN (SELECT doc_id, len(t) AS dl FROM toks) l USING (doc_id), (SELECT count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1) AS av FROM toks) s
  GROUP BY a.item_id, f.doc_id)
"""

_HASH = r"""
(SELECT id, dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 7) AS weight FROM (
  SELECT id, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 384 AS INTEGER) AS dim,
    CAST(sum(n * CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN -1 ELSE 1 END) AS DOUBLE) AS w
  FROM (SELECT id, sha256(token) AS h, count(*) AS n FROM (
    SELECT {id} AS id, unnest(CASE WHEN len(t) = 0 THEN [lower(coalesce(text, ''))] ELSE t END) AS token
    FROM (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]+') AS t FROM {table})) GROUP BY id, token)
  GROUP BY id, dim) WHERE w <> 0)
"""

_NOTES = r"""
notes AS (
  SELECT doc_id, 'Sources/' || coalesce(lang, 'xx') || '/' || coalesce(source, 'none') || '/doc_' || doc_id || '.md' AS path, 'Doc ' || doc_id AS title,
    CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 5 THEN 'NOTE-' || doc_id
      WHEN doc_id % 50 = 1 THEN 'note_' || md5(CAST(-CAST(floor(doc_id / 100) AS BIGINT) - 1 AS VARCHAR)) ELSE 'note_' || md5(CAST(doc_id AS VARCHAR)) END AS id,
    'd' || doc_id % 397 AS alias,
    ['doc_' || doc_id + 1, 'Doc ' || doc_id * 7, 'd' || doc_id % 397, 'doc_' || (doc_id - 1) || '.md', '../x/doc_' || doc_id] AS outlinks,
    sha256(coalesce(text, '')) AS sha256, 'doc_' || doc_id AS stem, regexp_replace(path, '\.md$', '') AS bare, regexp_replace(path, '/[^/]*$', '') AS folder FROM documents),
names AS (SELECT DISTINCT lower(unnest([path, bare, stem, id, title, alias])) AS key, path FROM notes),
lookup AS (SELECT * FROM names WHERE key <> ''),
out_links AS (SELECT path, folder, ord - 1 AS ord, outlinks[ord] AS target FROM (SELECT path, folder, outlinks, unnest(range(1, 6)) AS ord FROM notes)),
ends AS (
  SELECT path, ord, target, lower(regexp_replace(target, '\.md$', '')) AS key FROM out_links UNION
  SELECT path, ord, target, lower(folder || '/' || regexp_replace(target, '\.md$', '')) FROM out_links WHERE contains(target, '/')),
resolved AS (
  SELECT e.path, e.ord, e.target, CASE count(DISTINCT l.path) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, coalesce(min(l.path), '') AS resolved
  FROM ends e LEFT JOIN lookup l USING (key) GROUP BY e.path, e.ord, e.target),
state AS (
  SELECT *, CASE WHEN id = '' THEN 'legacy' WHEN regexp_full_match(id, 'note_[0-9a-f]{32}') THEN 'stable' ELSE 'malformed' END AS state FROM notes),
members AS (
  SELECT path, collection, depth, ord FROM (
    SELECT path, 'sources' AS collection, 1 AS depth, 0 AS ord FROM notes WHERE starts_with(lower(path), 'sources/') UNION ALL
    SELECT path, 'english', 2, 1 FROM notes WHERE starts_with(lower(path), 'sources/en/') UNION ALL
    SELECT path, 'romance', 2, 2 FROM notes WHERE regexp_matches(lower(path), '^sources/(fr|es|it)/') UNION ALL
    SELECT path, 'first', 3, 3 FROM notes WHERE regexp_matches(lower(path), '^sources/(en|de)/src1/') UNION ALL
    SELECT path, 'archive', 1, 4 FROM notes WHERE starts_with(lower(path), 'archive/'))),
placed AS (SELECT path, collection, row_number() OVER (PARTITION BY path ORDER BY depth DESC, ord) - 1 AS position FROM members),
later AS (
  SELECT CASE WHEN doc_id % 17 = 0 THEN 'Moved/doc_' || doc_id || '.md' ELSE path END AS path,
    CASE WHEN doc_id % 7 = 0 THEN sha256(sha256 || '!') ELSE sha256 END AS sha256 FROM notes WHERE doc_id % 11 <> 0)
"""

_TIERS = r"""
asked AS (SELECT unnest(['doc_12', 'Doc 7', 'd42', 'sources/en/src1', 'SRC3/doc_1', 'doc 99']) AS query),
tried AS (
  SELECT query, path, CASE WHEN id <> '' AND lower(id) = lower(query) THEN 110 WHEN lower(query) IN (lower(path), lower(bare)) THEN 100
    WHEN lower(query) = lower(title) THEN 98 WHEN lower(query) = alias THEN 97 WHEN lower(query) = stem THEN 96
    WHEN starts_with(lower(path), lower(query)) OR starts_with(lower(title), lower(query)) OR starts_with(alias, lower(query)) OR starts_with(stem, lower(query)) THEN 80
    WHEN contains(lower(path), lower(query)) OR contains(lower(title), lower(query)) OR contains(alias, lower(query)) OR contains(stem, lower(query)) THEN 60 END AS score
  FROM asked, notes)
"""

_PIECES = r"""
cut(doc_id, text, start, stop, level) AS (
  SELECT doc_id, text, 0, CASE WHEN length(text) <= 1200 THEN length(text) ELSE 1200 END, 0 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
  UNION ALL
  SELECT doc_id, text, edge - 150, least(length(text), edge - 150 + 1200), level + 1 FROM (
    SELECT *, CASE WHEN brk > start + 600 THEN brk + 1 ELSE stop END AS edge FROM (
      SELECT *, CASE WHEN rev = 0 THEN -1 ELSE stop - rev END AS brk FROM (
        SELECT *, CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END AS rev FROM (
          SELECT *, strpos(reverse(text[start + 1:stop]), chr(10)) AS a, strpos(reverse(text[start + 1:stop]), '。') AS b FROM cut WHERE stop < length(text)))))),
ended AS (
  SELECT doc_id, level, text, start, CASE WHEN stop = length(text) THEN stop WHEN brk > start + 600 THEN brk + 1 ELSE stop END AS edge FROM (
    SELECT *, CASE WHEN rev = 0 THEN -1 ELSE stop - rev END AS brk FROM (
      SELECT *, CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END AS rev FROM (
        SELECT *, strpos(reverse(text[start + 1:stop]), chr(10)) AS a, strpos(reverse(text[start + 1:stop]), '。') AS b FROM cut)))),
stripped AS (
  SELECT doc_id, level, CASE WHEN length(text) <= 1200 THEN text ELSE trim(text[start + 1:edge], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS content, length(text) AS n FROM ended),
pieces AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY level) - 1 AS INTEGER) AS piece, content FROM stripped WHERE content <> '' OR n <= 1200)
"""

_ISSUES = _NOTES + r""",
dup AS (SELECT id, count(*) AS files, min(path) AS first_path FROM state WHERE state = 'stable' GROUP BY id HAVING count(*) > 1),
amb AS (SELECT key, count(*) AS paths FROM lookup GROUP BY key HAVING count(*) > 1),
there AS (
  SELECT path FROM notes UNION SELECT folder FROM notes UNION SELECT regexp_replace(folder, '/[^/]*$', '') FROM notes UNION SELECT 'Sources' FROM notes UNION SELECT '' FROM notes),
found AS (
  SELECT 'error' AS severity, 'malformed_note_id' AS code, path, id AS target FROM state WHERE state = 'malformed' UNION ALL
  SELECT 'error', 'duplicate_note_id', first_path, id FROM dup UNION ALL
  SELECT 'warning', 'missing_stable_id', path, '' FROM state WHERE state = 'legacy' AND starts_with(lower(path), 'sources/en/') UNION ALL
  SELECT 'warning', 'ambiguous_name', key, '' FROM amb UNION ALL
  SELECT 'warning', status || '_wikilink', path, target FROM resolved WHERE status <> 'unique' UNION ALL
  SELECT 'error', 'collection_path_missing', p, '' FROM (SELECT unnest(['Sources', 'sources/EN', 'Sources/fr', 'Sources/es', 'Sources/it', 'Sources/en/src1', 'Sources/de/src1', 'Archive']) AS p)
    WHERE p NOT IN (SELECT path FROM there) UNION ALL
  SELECT 'error', 'collection_entrypoint_missing', p, '' FROM (SELECT 'Sources/en/README.md' AS p) WHERE p NOT IN (SELECT path FROM notes) UNION ALL
  SELECT 'warning', 'unclassified_files', min(path), '' FROM notes WHERE path NOT IN (SELECT path FROM members) HAVING count(*) > 0)
"""

_LEDGER = _NOTES + r""",
identity AS (SELECT id, min(path) AS now FROM state WHERE state = 'stable' GROUP BY id HAVING count(*) = 1),
units AS (
  SELECT 'u' || doc_id AS unit_id, doc_id % 9 AS s, ['captured', 'integrated', 'verified', 'blocked'][doc_id % 4 + 1] AS status,
    ['not-ready', 'ready-for-cleanup', 'raw-and-draft-cleaned'][doc_id % 3 + 1] AS clean,
    CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN sha256('other') ELSE sha256 END AS want,
    CASE doc_id % 7 WHEN 0 THEN 'removed' WHEN 1 THEN 'unknown' ELSE 'present' END AS presence,
    CASE WHEN doc_id % 6 = 0 THEN 'Gone/' || doc_id ELSE path END AS p, doc_id % 2 = 0 AS raw, doc_id % 8 <> 0 AS made,
    CASE WHEN doc_id % 3 = 0 THEN id ELSE '' END AS note_id, doc_id % 6 <> 0 AS there, sha256 AS have, id AS own_id FROM notes),
joined AS (SELECT u.*, i.now FROM units u LEFT JOIN identity i ON u.note_id = i.id),
found AS (
  SELECT 'error' AS severity, 'ledger_source_unknown' AS code, unit_id, '' AS target FROM units WHERE s >= 7 UNION ALL
  SELECT 'error', 'ledger_integrated_without_output', unit_id, '' FROM units WHERE status IN ('integrated', 'verified') AND NOT made UNION ALL
  SELECT 'error', 'ledger_cleanup_without_raw_hash', unit_id, '' FROM units WHERE clean <> 'not-ready' AND (NOT raw OR presence = 'unknown' OR want = '') UNION ALL
  SELECT 'error', 'ledger_cleanup_before_integration', unit_id, '' FROM units WHERE clean <> 'not-ready' AND status NOT IN ('integrated', 'verified') UNION ALL
  SELECT 'error', 'ledger_cleanup_without_output', unit_id, '' FROM units WHERE clean <> 'not-ready' AND NOT made UNION ALL
  SELECT 'error', 'ledger_cleaned_input_still_present', unit_id, '' FROM units WHERE clean = 'raw-and-draft-cleaned' AND raw AND presence <> 'removed' UNION ALL
  SELECT 'error', 'ledger_path_missing', unit_id, '' FROM units WHERE presence = 'present' AND NOT there UNION ALL
  SELECT 'error', 'ledger_hash_mismatch', unit_id, '' FROM units WHERE presence = 'present' AND there AND want <> '' AND want <> have UNION ALL
  SELECT 'warning', 'ledger_removed_path_exists', unit_id, '' FROM units WHERE presence = 'removed' AND there UNION ALL
  SELECT 'error', 'ledger_note_id_missing', unit_id, note_id FROM joined WHERE made AND note_id <> '' AND now IS NULL UNION ALL
  SELECT 'warning', 'ledger_output_path_stale', unit_id, now FROM joined WHERE made AND note_id <> '' AND now <> p AND NOT there UNION ALL
  SELECT 'error', 'ledger_output_identity_mismatch', unit_id, now FROM joined WHERE made AND note_id <> '' AND now <> p AND there AND own_id <> note_id UNION ALL
  SELECT 'error', 'ledger_output_missing', unit_id, '' FROM joined WHERE made AND note_id = '' AND NOT there)
"""

_SUBMISSIONS = r"""
d AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS case_id FROM documents),
cases AS (SELECT case_id, n % 4 = 0 AS unsure, list_distinct(['p' || (2 * n) % 11, 'p' || (2 * n + 3) % 11, 'p' || (2 * n + 6) % 11]) AS must,
    list_distinct(['p' || (5 * n) % 11, 'p' || (5 * n + 1) % 11]) AS never, CASE WHEN n % 2 = 0 THEN ['reason', 'links'] ELSE [] END AS proofs FROM d),
given AS (SELECT agent, case_id, CASE WHEN n % (8 * k) = 0 THEN 'complete' ELSE 'target_required' END AS status, ['p' || (2 * n) % 11, 'p' || (2 * n + 3) % 11] AS found,
    ['p' || (2 * n * k) % 11, 'p' || (2 * n) % 11] AS opened, ['p' || (2 * n + 6) % 11] AS returned, list_distinct(['p' || (5 * n) % 11, 'p' || (n * k) % 11]) AS adopted,
    CASE WHEN n % 6 = 0 THEN ['reason'] ELSE [] END AS evidence
    FROM d, (VALUES ('a', 1), ('b', 2)) AS t(agent, k) WHERE k = 1 OR n % 5 <> 0),
met AS (SELECT * FROM given JOIN cases USING (case_id)),
musts AS (SELECT *, unnest(must) AS item FROM met), nevers AS (SELECT *, unnest(never) AS item FROM met), asked AS (SELECT *, unnest(proofs) AS item FROM met)"""

_HYBRID = r"""
dots AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.weight * d.weight) AS s FROM qv q JOIN dv d USING (dim) GROUP BY ALL),
near AS (
  SELECT b.item_id, d.doc_id, round(coalesce(s, 0), 6) + 0.0 AS score FROM (SELECT item_id FROM benchmark) b CROSS JOIN (SELECT doc_id FROM chunked) d
  LEFT JOIN dots x ON x.item_id = b.item_id AND x.doc_id = d.doc_id),
dr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM near) WHERE r <= 40),
sr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0) WHERE r <= 40),
fused AS (
  SELECT coalesce(dr.item_id, sr.item_id) AS item_id, coalesce(dr.doc_id, sr.doc_id) AS doc_id, dr.r AS a, sr.r AS b,
    round(coalesce(1.0 / (60 + dr.r), 0) + coalesce(1.0 / (60 + sr.r), 0), 9) AS score FROM dr FULL JOIN sr ON dr.item_id = sr.item_id AND dr.doc_id = sr.doc_id)
"""

_WHOLE = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TRIMMED = f"SELECT doc_id, trim(coalesce(text, ''), {_BLANKS}) AS text FROM documents"
_NUMBER = "CASE WHEN piece < 10000 THEN lpad(CAST(piece AS VARCHAR), 4, '0') ELSE CAST(piece AS VARCHAR) END"


def _chunk_search(scope: str) -> str:
    """The index's search by whole scans: pieces of notes under their headers, both rankings, their fusion."""
    return f"""WITH RECURSIVE {_PIECES.replace(_WHOLE, f"({_TRIMMED})")}, {_NOTES},
        tagged AS (SELECT *, concat_ws(', ', nullif(source, ''), nullif(lang, '')) AS tags FROM documents),
        chunked AS (
          SELECT substr(sha1(lower(path)), 1, 16) || '::' || {_NUMBER} AS doc_id, path, piece, '' AS lang,
            '[Source: ' || title || ']' || CASE WHEN tags <> '' THEN ' (' || tags || ')' ELSE '' END || chr(10) || content AS text
          FROM pieces JOIN notes USING (doc_id) JOIN tagged USING (doc_id) WHERE content <> '' AND ({scope})),
        {_BM25.replace("FROM documents)", "FROM chunked)")}, dv AS ({_HASH.format(id="doc_id", table="chunked")}), qv AS ({_HASH.format(id="item_id", table="benchmark")}), {_HYBRID}
        SELECT r.item_id, r.doc_id AS chunk_id, c.path, c.piece, CAST(r.rank AS INTEGER) AS rank, r.score FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, a NULLS LAST, b NULLS LAST) AS rank FROM fused) r JOIN chunked c USING (doc_id) WHERE rank <= 6"""


_EDITED = f"SELECT 1000000000000 + doc_id, trim(coalesce(text, '') || ' more', {_BLANKS}) FROM documents WHERE doc_id % 7 = 0"
_INDEXED = f"""{_PIECES.replace(_WHOLE, f"({_TRIMMED} UNION ALL {_EDITED})")},
    sizes AS (SELECT doc_id, count(*) AS n FROM pieces WHERE content <> '' GROUP BY doc_id),
    states AS (SELECT d.doc_id AS k, coalesce(s.n, 0) AS before, CASE WHEN k % 7 = 0 THEN coalesce(e.n, 0) ELSE coalesce(s.n, 0) END AS after
      FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN sizes e ON e.doc_id = 1000000000000 + d.doc_id)"""

_LEDGERS = """
d AS (SELECT doc_id AS n, doc_id // 20 AS ledger, (doc_id // 20) % 9 AS form FROM documents WHERE doc_id IS NOT NULL),
m AS (SELECT *, 's' || n AS s, 'u' || n AS u FROM d WHERE form < 4), l AS (SELECT * FROM d WHERE form IN (4, 5)),
l1 AS (SELECT *, CASE WHEN n % 13 = 0 THEN 'again' ELSE 'u' || n END AS u, row_number() OVER (PARTITION BY ledger, CASE WHEN n % 13 = 0 THEN 'again' ELSE 'u' || n END ORDER BY n) AS turn FROM l),
src AS (
  SELECT ledger, s AS source_id, 'book' AS kind, 'T' || n AS title, 'k' AS canonical_key, CASE WHEN n % 6 = 0 THEN ['Inbox/' || n, 'a/b'] ELSE [] END AS roots,
    CAST(NULL AS VARCHAR) AS official_root, CAST(NULL AS VARCHAR) AS entry_path FROM m WHERE n % 6 = 0 UNION ALL
  SELECT DISTINCT ledger, 's' || n, 'legacy', 's' || n, 's' || n, [], NULL, NULL FROM l WHERE n % 3 <> 0),
units AS (
  SELECT ledger, u AS unit_id, n, CASE WHEN n % 3 = 0 THEN '' ELSE s END AS source_id, CASE WHEN n % 8 = 0 THEN '' ELSE 'chapter' END AS kind, CASE WHEN n % 9 = 0 THEN '{}' ELSE '{"label":"x"}' END AS scope,
    ['', '', 'captured', 'verified', 'blocked'][n % 5 + 1] AS processing_status, ['', 'not-ready', 'unknown', 'ready-for-cleanup'][n % 4 + 1] AS cleanup_status,
    ['', '', 'b|c', '', 'b', ''][n % 6 + 1] AS basis, ['', 'exact', '', '', 'reviewed', 'exact'][n % 6 + 1] AS confidence, CASE WHEN n % 11 = 0 THEN '' ELSE 'i' END AS issues,
    CASE n % 7 WHEN 0 THEN [{'r': 'raw', 'p': 'Inbox/' || n || '.pdf', 'h': repeat('ab', 32), 'e': 'removed'}] WHEN 6 THEN [{'r': 'draft', 'p': 'e/' || n, 'h': '', 'e': 'unknown'}] ELSE [] END AS ins,
    CASE n % 5 WHEN 0 THEN [{'r': 'official', 'p': 'Notes/' || n || '.md', 'i': ''}] WHEN 1 THEN [] WHEN 2 THEN [{'r': 'official', 'p': 'N/' || n, 'i': ''}] WHEN 3 THEN [{'r': 'x', 'p': 'N/' || n, 'i': ''}]
      ELSE [{'r': 'official', 'p': 'N/' || n, 'i': 'note_' || repeat('0f', 16)}] END AS outs FROM m UNION ALL
  SELECT ledger, u, n, CASE WHEN n % 3 = 0 THEN '' ELSE 's' || n || ' ' END, 'legacy', '{}', ['', '', 'captured', 'verified', ''][n % 5 + 1], ['', 'not-ready', 'unknown', 'ready-for-cleanup'][n % 4 + 1],
    'legacy-ledger', 'unresolved', '', [{'r': 'raw', 'p': 'R/' || n, 'h': '', 'e': 'present'}, {'r': 'raw', 'p': 'S/' || n, 'h': '', 'e': 'removed'}], [{'r': 'official', 'p': 'O/' || n, 'i': ''}] FROM l1 WHERE turn = 1)
"""


def _broken(code: str, test: str, rows: str = "m", unit: str = "u", path: str = "''", severity: str = "error") -> str:
    return f"SELECT ledger, '{severity}' AS severity, '{code}' AS code, {unit} AS unit_id, {path} AS path FROM {rows} WHERE {test}"


_BROKEN = " UNION ALL ".join([
    "SELECT DISTINCT ledger, 'error' AS severity, CASE form WHEN 6 THEN 'ledger_missing' WHEN 7 THEN 'ledger_invalid_root' WHEN 8 THEN 'ledger_invalid_json' ELSE 'ledger_version_invalid' END AS code, '' AS unit_id, '' AS path FROM d WHERE form IN (3, 6, 7, 8)",
    "SELECT DISTINCT ledger, 'warning', 'ledger_legacy_format', '', '' FROM l",
    _broken("ledger_source_field_missing", "n % 6 = 1", "m, range(2)", "s"), _broken("ledger_source_roots_invalid", "n % 6 = 2", unit="s"),
    _broken("ledger_path_unsafe", "n % 6 = 3", "m, range(2)", "s"), _broken("ledger_path_unsafe", "n % 6 = 4", unit="s"), _broken("ledger_source_invalid", "n % 6 = 5", unit="''"),
    _broken("ledger_status_unknown", "n % 5 < 2"), _broken("ledger_cleanup_status_unknown", "n % 4 = 0"), _broken("ledger_source_id_missing", "n % 3 = 0"), _broken("ledger_kind_missing", "n % 8 = 0"),
    _broken("ledger_scope_invalid", "n % 9 = 0"), _broken("ledger_provenance_invalid", "n % 6 = 0"), _broken("ledger_provenance_basis_invalid", "n % 6 = 1"),
    _broken("ledger_provenance_confidence_invalid", "n % 6 IN (0, 2, 3)"), _broken("ledger_issues_invalid", "n % 11 = 0"), _broken("ledger_paths_not_array", "n % 7 = 1"), _broken("ledger_outputs_not_array", "n % 5 = 1"),
    _broken("ledger_path_invalid", "n % 7 = 2"), _broken("ledger_role_missing", "n % 7 = 2"), _broken("ledger_role_missing", "n % 7 = 3"), _broken("ledger_path_missing", "n % 7 = 3"), _broken("ledger_path_unsafe", "n % 7 = 3"),
    _broken("ledger_presence_invalid", "n % 7 = 4", path="'b/' || n"), _broken("ledger_hash_invalid", "n % 7 = 6", path="'c/' || n"), _broken("ledger_hash_invalid", "n % 7 = 6", path="'d/' || n"),
    _broken("ledger_output_invalid", "n % 5 = 2"), _broken("ledger_output_extensions_invalid", "n % 5 = 2", path="'N/' || n"), _broken("ledger_note_id_invalid", "n % 5 = 3", path="'N/' || n"), _broken("ledger_path_unsafe", "n % 5 = 4"),
    _broken("ledger_unit_id_invalid", "turn > 1", "l1", "''"), _broken("ledger_source_id_missing", "turn = 1 AND n % 3 = 0", "l1"), _broken("ledger_status_unknown", "turn = 1 AND n % 5 IN (0, 1, 4)", "l1"),
    _broken("ledger_cleanup_status_unknown", "turn = 1 AND n % 4 = 0", "l1"), _broken("ledger_paths_not_array", "turn = 1 AND n % 4 = 1", "l1"), _broken("ledger_output_invalid", "turn = 1", "l1"),
])

def _tree(name: str, rows: str) -> str:
    """A digest tree over rows' texts ``t``, of the one level that 32 to 8,191 rows have."""
    return f"""SELECT '{name}' AS name, sha256(string_agg(value, '' ORDER BY p)) AS digest FROM (
          SELECT substr(h, 1, 2) AS p, sha256(string_agg(sha256(h || ':' || n), '' ORDER BY h)) AS value FROM (SELECT sha256(t) AS h, count(*) AS n FROM ({rows}) GROUP BY 1) GROUP BY 1)"""


_KEY = "CASE WHEN state = 'stable' THEN id ELSE 'legacy-path:' || path END"

_CONTEXT = f"""{_NOTES}, {_LEDGERS},
foci AS (SELECT 'note' || doc_id AS focus, 'path' AS kind, bare AS value FROM notes WHERE doc_id % 50 = 0 UNION ALL
  SELECT unnest(['d1', 'd2', 'd3', 'd4', 'd5', 'q1', 'q2', 'c1']), unnest(['path', 'path', 'path', 'path', 'path', 'query', 'query', 'collection']), unnest(['Sources/en', 'Sources/fr/src1', 'Nowhere', 'Notes', 'd42', 'doc_12', 's7', 'english'])),
named AS (SELECT f.focus, count(DISTINCT l.path) AS n, min(l.path) AS path FROM foci f JOIN lookup l ON l.key = lower(f.value) WHERE f.kind = 'path' GROUP BY f.focus),
aims AS (SELECT f.focus, f.value, coalesce(x.path, CASE WHEN m.n = 1 THEN m.path END) AS path, CASE WHEN x.path IS NULL AND m.n > 1 THEN m.n ELSE 0 END AS several
  FROM foci f LEFT JOIN notes x ON x.path IN (f.value, f.value || '.md') LEFT JOIN named m ON m.focus = f.focus WHERE f.kind = 'path'),
aimed AS (SELECT focus, path FROM aims WHERE path IS NOT NULL), loose AS (SELECT focus, value AS folder, several FROM aims WHERE path IS NULL),
below AS (SELECT l.focus, split_part(substr(n.path, length(l.folder) + 2), '/', 1) AS name FROM loose l JOIN notes n ON starts_with(n.path, l.folder || '/')),
hits AS (SELECT f.focus, n.path, row_number() OVER (PARTITION BY f.focus ORDER BY CASE WHEN stem = lower(value) THEN 96 WHEN starts_with(lower(title), lower(value)) OR starts_with(alias, lower(value)) OR starts_with(stem, lower(value)) OR starts_with(lower(path), lower(value)) THEN 80 ELSE 60 END DESC, lower(path), path) AS turn
  FROM foci f JOIN notes n ON contains(lower(n.path), lower(value)) OR contains(lower(n.title), lower(value)) OR contains(alias, lower(value)) OR contains(stem, lower(value)) WHERE f.kind = 'query'),
unit_paths AS (SELECT ledger, unit_id, unnest(list_transform(ins, lambda e: e.p)) AS path FROM units UNION ALL
  SELECT ledger, unit_id, unnest(list_transform(list_filter(outs, lambda e: e.i = ''), lambda e: e.p)) FROM units UNION ALL
  SELECT u.ledger, u.unit_id, unnest(s.roots) FROM units u JOIN src s ON u.ledger = s.ledger AND u.source_id = s.source_id),
touched AS (SELECT DISTINCT a.focus, p.ledger, p.unit_id FROM (SELECT focus, coalesce(path, value) AS spot FROM aims) a JOIN unit_paths p ON lower(p.path) = lower(a.spot) OR (NOT contains(a.spot, '.') AND starts_with(lower(p.path), lower(a.spot) || '/')) UNION
  SELECT f.focus, u.ledger, u.unit_id FROM foci f JOIN units u ON contains(lower(u.unit_id), lower(f.value)) OR contains(lower(u.source_id), lower(f.value)) WHERE f.kind = 'query'),
sourced AS (SELECT DISTINCT t.focus, s.ledger, s.source_id FROM touched t JOIN units u USING (ledger, unit_id) JOIN src s ON s.ledger = u.ledger AND s.source_id = u.source_id),
places AS (SELECT focus, path, 0 AS t FROM aimed UNION ALL SELECT focus, folder || '/x', 0 FROM loose UNION ALL SELECT focus, path, turn FROM hits WHERE turn <= 12),
collected AS (SELECT focus, 'sources' AS name, t, 1 AS depth, 0 AS ord FROM places WHERE starts_with(lower(path), 'sources/') UNION ALL
  SELECT focus, 'english', t, 2, 1 FROM places WHERE starts_with(lower(path), 'sources/en/') UNION ALL SELECT focus, 'romance', t, 2, 2 FROM places WHERE regexp_matches(lower(path), '^sources/(fr|es|it)/') UNION ALL
  SELECT focus, 'first', t, 3, 3 FROM places WHERE regexp_matches(lower(path), '^sources/(en|de)/src1/') UNION ALL SELECT 'c1', 'english', 0, 0, 0),
matched AS (SELECT focus, name, min((t, -depth, ord)) AS spot FROM collected GROUP BY focus, name),
hints(name, related, i) AS (VALUES ('sources', 'english', 0), ('sources', 'archive', 1), ('english', 'romance', 0), ('romance', 'english', 0), ('romance', 'sources', 1)),
reached AS (SELECT m.focus, h.related AS name, min((m.spot, h.i)) AS spot FROM matched m JOIN hints h USING (name) WHERE (m.focus, h.related) NOT IN (SELECT (focus, name) FROM matched) GROUP BY 1, 2),
items AS (
  SELECT focus, 'outlinks' AS section, target AS item, row_number() OVER (PARTITION BY focus ORDER BY ord) AS position FROM aimed JOIN out_links USING (path) UNION ALL
  SELECT focus, 'backlinks', item, row_number() OVER (PARTITION BY focus ORDER BY lower(item), item) FROM (SELECT DISTINCT a.focus, e.path AS item FROM aimed a JOIN lookup l ON l.path = a.path JOIN ends e ON e.key = l.key) UNION ALL
  SELECT focus, 'siblings', item, row_number() OVER (PARTITION BY focus ORDER BY lower(item), item) FROM (SELECT a.focus, o.path AS item FROM aimed a JOIN notes n ON n.path = a.path JOIN notes o ON o.folder = n.folder AND o.path <> n.path) UNION ALL
  SELECT focus, 'children', name || ':' || n, row_number() OVER (PARTITION BY focus ORDER BY lower(name), name) FROM (SELECT focus, name, count(*) AS n FROM below GROUP BY ALL) UNION ALL
  SELECT focus, 'focus_issues', code, row_number() OVER (PARTITION BY focus ORDER BY code) FROM (SELECT focus, 'focus_ambiguous' AS code FROM loose WHERE several > 1 UNION ALL SELECT focus, 'focus_not_found' FROM loose WHERE focus NOT IN (SELECT focus FROM below)) UNION ALL
  SELECT focus, 'matches', path, turn FROM hits UNION ALL
  SELECT focus, 'reading_units', item, row_number() OVER (PARTITION BY focus ORDER BY lower(item), item) FROM (SELECT focus, ledger || '/' || unit_id AS item FROM touched) UNION ALL
  SELECT focus, 'reading_sources', item, row_number() OVER (PARTITION BY focus ORDER BY lower(item), item) FROM (SELECT focus, ledger || '/' || source_id AS item FROM sourced) UNION ALL
  SELECT focus, 'matched_collections', name, row_number() OVER (PARTITION BY focus ORDER BY spot, name) FROM matched UNION ALL
  SELECT focus, 'related_collections', name, row_number() OVER (PARTITION BY focus ORDER BY spot, name) FROM reached),
around AS (SELECT *, count(*) OVER (PARTITION BY focus, section) AS total, CASE WHEN section LIKE '%collections' THEN 64 ELSE 12 END AS most FROM items),
shown AS (SELECT focus, section, position, item, total, total > most AS truncated FROM around WHERE position <= most)"""
_ROUTE = "['reading_units', 'matched_collections', 'related_collections', 'reading_sources', 'matches', 'focus_issues', 'children', 'outlinks', 'backlinks', 'embeds', 'siblings']"

_BAG = f"""{_ISSUES}, {_LEDGERS}, broken AS ({_BROKEN}),
bag AS (
  SELECT severity, code, path, target FROM found WHERE code <> 'missing_stable_id' UNION ALL
  (SELECT severity, code, path, target FROM found WHERE code = 'missing_stable_id' ORDER BY lower(path), path LIMIT 1) UNION ALL
  SELECT severity, code, path, unit_id FROM broken)"""

_RESULTS = f"""{_NOTES},
r AS (SELECT n.doc_id AS n, CAST(n.doc_id AS VARCHAR) AS case_id, n.path, t.agent, t.k, (t.k = 1 OR n.doc_id % 5 <> 0) AND n.doc_id % 9 <> 4 AS given FROM notes n, (VALUES ('a', 1), ('b', 2)) AS t(agent, k)),
g AS (SELECT *, CASE WHEN n % (k * 8) = 0 THEN 'completed' ELSE 'target_required' END AS status, n % 6 > 1 AS asked FROM r WHERE given)"""

_PAGES = """asked7 AS (SELECT query FROM asked UNION ALL SELECT 'no such note'), hits AS ({}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, lower(path), path) AS position, count(*) OVER (PARTITION BY query) AS n FROM hits)
        SELECT query, CASE WHEN n IS NULL THEN 'not_found' {} END AS status, coalesce(n, 0) AS total, coalesce(n, 0) > 20 AS truncated, CAST(position AS INTEGER) AS position, path, CAST(score AS INTEGER) AS score
        FROM asked7 LEFT JOIN (SELECT * FROM ranked WHERE position <= 20) USING (query)"""

SQL = {
    "embed_issues": f"""WITH {_NOTES} SELECT 'warning' AS severity, status || '_wikilink' AS code, path, target, m AS non_markdown FROM resolved, (VALUES (FALSE), (TRUE)) AS t(m) WHERE ord = 0 AND status <> 'unique' UNION ALL
        SELECT 'warning', 'unresolved_wikilink', path, 'none_' || doc_id || '.md', m FROM notes, (VALUES (FALSE), (TRUE)) AS t(m) UNION ALL
        SELECT 'warning', 'unresolved_wikilink', path, 'pic.PNG', TRUE FROM notes""",
    "public_records": f"""WITH {_NOTES}, shown AS (SELECT path, string_agg(collection, '|' ORDER BY position) AS collections, min(collection) FILTER (position = 0) AS first FROM placed GROUP BY path),
        t AS (SELECT s.*, title || repeat('x', CAST(doc_id % 700 AS BIGINT)) AS long FROM state s)
        SELECT t.path, id, state AS identity_state, CASE WHEN state = 'stable' THEN id ELSE 'legacy-path:' || t.path END AS identity_key, md5(CASE WHEN length(long) > 512 THEN long[1:509] || '...' ELSE long END) AS title_md5,
          coalesce(first, '') AS primary_collection, CAST(doc_id % 20 AS INTEGER) AS aliases_total, CAST(doc_id % 30 AS INTEGER) AS metadata_total, doc_id % 20 > 12 OR doc_id % 30 > 24 AS truncated,
          array_to_string(list_transform(range(1, 1 + least(12, doc_id % 20)), lambda i: 'a' || i), '|') AS aliases, coalesce(collections, '') AS collections,
          array_to_string(list_transform(range(1, 1 + least(24, doc_id % 30)), lambda i: 'v' || doc_id * i), '|') AS metadata FROM t LEFT JOIN shown USING (path)""",
    "trace_events": """SELECT CAST(event_id AS VARCHAR) AS trace_id, CASE WHEN event_id % 3 = 0 THEN 'parent' ELSE 'root' || user_id END AS parent_span_id, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'unknown' END AS agent,
        substr(sha256('x:process:' || user_id), 1, 16) AS session_key, event_type AS operation, CAST(32 AS INTEGER) AS id_chars, CAST(16 AS INTEGER) AS span_chars, round(round(value, 3), 2) AS duration FROM events""",
    "find_pages": f"WITH {_NOTES}, {_TIERS}, " + _PAGES.format("SELECT * FROM tried WHERE score IS NOT NULL", "ELSE 'matches'"),
    "find_pages_exact": f"WITH {_NOTES}, {_TIERS}, "
    + _PAGES.format("SELECT query, path, score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM tried WHERE score > 80) WHERE score = best", "WHEN n = 1 THEN 'unique' ELSE 'ambiguous'"),
    "resolve_targets": f"""WITH {_NOTES},
        a AS (SELECT *, CASE WHEN doc_id % 12 = 5 THEN 'note_' || md5(CAST(doc_id + 1 AS VARCHAR)) ELSE nullif(id, '') END AS other FROM notes),
        q AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN other END AS qid, doc_id % 3 <> 1 OR other IS NULL AS by_path, path FROM a),
        m AS (SELECT q.doc_id, q.qid, q.by_path, q.path AS place, count(n.path) AS ids, min(n.path) AS id_path FROM q LEFT JOIN notes n ON n.id <> '' AND lower(n.id) = lower(q.qid) GROUP BY ALL),
        s AS (SELECT *, CASE WHEN qid IS NULL THEN 'unique' WHEN ids > 1 THEN 'ambiguous' WHEN NOT by_path AND ids = 1 THEN 'unique' WHEN ids = 0 THEN 'not_found' WHEN id_path <> place THEN 'id_path_conflict' ELSE 'unique' END AS status FROM m)
        SELECT CAST(doc_id AS VARCHAR) AS asked, status, CASE WHEN status = 'unique' THEN CASE WHEN qid IS NULL THEN 'path' WHEN by_path THEN 'stable_id_and_path' ELSE 'stable_id' END END AS match_type,
          CASE WHEN status = 'id_path_conflict' THEN id_path WHEN status = 'unique' THEN CASE WHEN qid IS NULL THEN place ELSE id_path END END AS path, CASE WHEN status = 'id_path_conflict' THEN place END AS other,
          CAST(CASE WHEN status = 'not_found' THEN 0 WHEN qid IS NULL THEN 1 ELSE greatest(ids, CASE WHEN by_path THEN 1 ELSE 0 END) END AS BIGINT) AS matches FROM s""",
    "eval_evidence": f"""WITH {_RESULTS}
        SELECT agent, case_id, 'submission_case_missing' AS code, '' AS item FROM r WHERE NOT given UNION ALL
        SELECT agent, case_id, 'submission_status_mismatch', '' FROM g WHERE status <> CASE WHEN n % 4 = 0 THEN 'target_required' ELSE 'completed' END UNION ALL
        SELECT agent, case_id, 'query_evidence_invalid', '' FROM g WHERE n % 6 = 0 UNION ALL SELECT agent, case_id, 'query_evidence_invalid', '' FROM g, range(2) WHERE n % 6 = 1 UNION ALL
        SELECT agent, case_id, 'decision_evidence_invalid', '' FROM g WHERE n % 7 = 0 UNION ALL
        SELECT agent, case_id, 'evidence_path_missing', 'gone/' || n FROM g WHERE n % 3 = 0 UNION ALL
        SELECT agent, case_id, 'ambiguous_target_guessed', '' FROM g WHERE n % 4 = 0 AND status <> 'target_required' UNION ALL
        SELECT agent, case_id, 'must_find_not_opened', path FROM g WHERE n % 2 = 1 UNION ALL
        SELECT agent, case_id, 'must_find_without_query_evidence', path FROM g WHERE NOT asked UNION ALL
        SELECT agent, case_id, 'forbidden_relation_adopted', path FROM g WHERE n % 10 = 0 AND n % 7 <> 0 UNION ALL
        SELECT agent, case_id, 'evidence_missing', 'notes' FROM g WHERE n % 2 = 0 UNION ALL
        SELECT agent, case_id, 'evidence_missing', 'queries' FROM g WHERE n % 2 = 0 AND n % 6 = 0""",
    "match_tiers_folded": f"""WITH {_NOTES}, asked AS (SELECT unnest(['doc_12', 'ＤＯＣ  7', 'Ｄ42', 'STRASSE 3', 'straße', 'ﬁ']) AS query, unnest(['doc_12', 'doc 7', 'd42', 'strasse 3', 'strasse', 'fi']) AS q),
        n AS (SELECT *, [lower(path), lower(bare), stem, lower(title), alias, 'strasse ' || doc_id % 7] AS keys FROM notes)
        SELECT query, path, CAST(score AS INTEGER) AS score FROM (SELECT query, path, CASE WHEN q IN (lower(path), lower(bare)) THEN 100 WHEN q = lower(title) THEN 98 WHEN q IN (alias, 'strasse ' || doc_id % 7) THEN 97 WHEN q = stem THEN 96
          WHEN len(list_filter(keys, lambda k: starts_with(k, q))) > 0 THEN 80 WHEN len(list_filter(keys, lambda k: contains(k, q))) > 0 THEN 60 END AS score FROM asked, n) WHERE score IS NOT NULL""",
    "resolve_links_folded": f"""WITH {_NOTES} SELECT r.path, CAST(r.ord AS INTEGER) AS ord, CASE WHEN n.doc_id % 4 = 2 THEN translate(r.target, 'Do', 'Ｄｏ') ELSE r.target END AS target, r.status, r.resolved
        FROM resolved r JOIN notes n USING (path)""",
    "context_sections": f"WITH {_CONTEXT} SELECT focus, section, CAST(position AS INTEGER) AS position, item, total, truncated FROM shown",
    "route_capsules": f"""WITH RECURSIVE {_CONTEXT},
        rungs AS (SELECT unnest({_ROUTE}) AS section, unnest(range(11)) AS s),
        queue AS (SELECT focus, s, section, length(to_json(item)) AS chars, to_json(item) AS json, total, row_number() OVER (PARTITION BY focus ORDER BY s, position) AS n FROM shown JOIN rungs USING (section)),
        totals AS (SELECT f.focus, n.section, n.s, coalesce(max(q.total), 0) AS total FROM (SELECT DISTINCT focus FROM queue) f CROSS JOIN rungs n LEFT JOIN queue q ON q.focus = f.focus AND q.s = n.s GROUP BY ALL),
        blank AS (SELECT focus, 2 + 11 + sum(length(section) + 5) + 12 + sum(length(section) + 3 + length(CAST(total AS VARCHAR))) + 10 AS base FROM totals GROUP BY focus),
        walk(focus, n, used, s, taken, stopped, fits) AS (
          SELECT focus, 0, CAST(base AS BIGINT), -1, 0, FALSE, FALSE FROM blank UNION ALL
          SELECT focus, n, CASE WHEN ok THEN after ELSE used END, s, before + CASE WHEN ok THEN 1 ELSE 0 END, NOT ok, ok FROM (
            SELECT *, NOT halted AND after + 16 <= 700 AS ok FROM (
              SELECT w.focus, q.n, w.used, q.s, CASE WHEN w.s = q.s THEN w.taken ELSE 0 END AS before, w.s = q.s AND w.stopped AS halted,
                w.used + q.chars + CASE WHEN w.s = q.s AND w.taken > 0 THEN 1 ELSE 0 END + length(CAST(q.total - CASE WHEN w.s = q.s THEN w.taken ELSE 0 END - 1 AS VARCHAR)) - length(CAST(q.total - CASE WHEN w.s = q.s THEN w.taken ELSE 0 END AS VARCHAR)) AS after
              FROM walk w JOIN queue q ON q.focus = w.focus AND q.n = w.n + 1))),
        kept AS (SELECT q.* FROM walk w JOIN queue q ON q.focus = w.focus AND q.n = w.n WHERE w.fits),
        parts AS (SELECT t.focus, t.section, t.total - count(k.n) AS missing, '"' || t.section || '":[' || coalesce(string_agg(k.json, ',' ORDER BY k.n), '') || ']' AS shown FROM totals t LEFT JOIN kept k ON k.focus = t.focus AND k.s = t.s GROUP BY t.focus, t.section, t.total),
        fields AS (SELECT focus, section AS name, shown AS text FROM parts UNION ALL SELECT focus, 'omitted', '"omitted":{{' || string_agg('"' || section || '":' || missing, ',' ORDER BY section) || '}}' FROM parts GROUP BY focus),
        capsules AS (SELECT focus, '{{' || string_agg(text, ',' ORDER BY name) || '}}' AS capsule FROM fields GROUP BY focus)
        SELECT c.focus, CAST(length(c.capsule) AS BIGINT) AS used_chars, (SELECT bool_or(missing > 0) FROM parts p WHERE p.focus = c.focus) AS truncated, c.capsule FROM capsules c""",
    "catalog_sync": """WITH s AS (SELECT doc_id AS n, doc_id % 11 = 0 AS gone, doc_id % 11 <> 0 AND doc_id % 17 = 0 AS moved, doc_id % 7 = 0 OR doc_id % 5 = 0 AS touched FROM documents WHERE doc_id IS NOT NULL),
        f AS (SELECT *, NOT gone AND (moved OR touched) AS opened FROM s)
        SELECT 0 AS sync, count(*) AS scanned, count(*) AS files, count(*) AS changed, 0 AS unchanged, 0 AS deleted, 0 AS errors, count(*) AS opened, 0 AS possible_legacy_moves FROM f UNION ALL
        SELECT 1, count(*) FILTER (NOT gone), count(*) FILTER (NOT gone AND NOT moved) + count(*) FILTER (moved AND n % 13 <> 0), count(*) FILTER (opened AND n % 13 <> 0), count(*) FILTER (NOT gone AND NOT opened),
          count(*) FILTER (gone OR moved), count(*) FILTER (opened AND n % 13 = 0), count(*) FILTER (opened), count(*) FILTER (moved AND n % 10 = 0 AND n % 13 <> 0 AND n % 7 <> 0) FROM f""",
    "watermarks": f"""WITH {_NOTES}, known AS (SELECT s.*, coalesce(p.collection, '') AS first FROM state s LEFT JOIN placed p ON p.path = s.path AND p.position = 0)
        {_tree("content", f"SELECT {_KEY} || chr(31) || sha256 AS t FROM known")} UNION ALL
        {_tree("structure", "SELECT concat_ws(chr(31), path, id, state, title, first) AS t FROM known")} UNION ALL
        {_tree("index_input", "SELECT path || chr(31) || sha256 AS t FROM known")} UNION ALL
        {_tree("members", "SELECT path || chr(31) || collection AS t FROM placed")}""",
    "ledger_documents": f"WITH {_LEDGERS} SELECT DISTINCT ledger, CASE WHEN form = 6 THEN 'missing' WHEN form > 6 THEN 'invalid:hash' ELSE 'sha256:hash' END AS state FROM d",
    "ledger_sources": f"WITH {_LEDGERS} SELECT ledger, source_id, kind, title, canonical_key, array_to_string(roots, '|') AS inbox_roots, official_root, entry_path FROM src",
    "ledger_units": f"""WITH {_LEDGERS} SELECT ledger, unit_id, source_id, kind, scope, processing_status, cleanup_status, basis, confidence, issues,
        array_to_string(list_transform(ins, lambda e: e.r || ':' || e.p || ':' || e.h || ':' || e.e), '|') AS inputs, array_to_string(list_transform(outs, lambda e: e.r || ':' || e.p || ':' || e.i), '|') AS outputs FROM units""",
    "ledger_issues": f"WITH {_LEDGERS} {_BROKEN}",
    "ledger_focus": f"""WITH {_LEDGERS}, asked AS (SELECT unnest(['inbox/1', 'Notes', 'N', 'notes/4.MD', 'a/b', 'R', 'C/6', 'Now']) AS focus),
        paths AS (SELECT ledger, unit_id, unnest(list_transform(ins, lambda e: e.p)) AS path FROM units UNION ALL
          SELECT ledger, unit_id, unnest(list_transform(outs, lambda e: CASE WHEN e.i = '' THEN e.p ELSE 'Now/here.md' END)) FROM units UNION ALL
          SELECT u.ledger, u.unit_id, unnest(s.roots) FROM units u JOIN src s ON u.ledger = s.ledger AND u.source_id = s.source_id)
        SELECT DISTINCT focus, ledger, unit_id FROM paths, asked WHERE lower(path) = lower(focus) OR (NOT contains(focus, '.') AND starts_with(lower(path), lower(focus) || '/'))""",
    "chunk_search": _chunk_search("TRUE"),
    "chunk_search_scoped": _chunk_search("starts_with(path, 'Sources/en/') OR starts_with(path, 'Sources/fr/src1/')"),
    "index_sync": f"""WITH RECURSIVE {_INDEXED}
        SELECT 0 AS sync, count(*) AS scanned, count(*) AS changed, 0 AS deleted, CAST(sum(before) AS BIGINT) AS chunks_upserted, 0 AS chunks_deleted FROM states UNION ALL
        SELECT 1, count(*) FILTER (k % 11 <> 0), count(*) FILTER (k % 11 <> 0 AND (k % 17 = 0 OR k % 7 = 0)), count(*) FILTER (k % 11 = 0 OR k % 17 = 0),
          CAST(coalesce(sum(after) FILTER (k % 11 <> 0 AND (k % 17 = 0 OR k % 7 = 0)), 0) AS BIGINT), CAST(coalesce(sum(before) FILTER (k % 11 = 0 OR k % 17 = 0 OR k % 7 = 0), 0) AS BIGINT) FROM states UNION ALL
        SELECT 2, count(*) FILTER (k % 11 <> 0), 0, 0, 0, 0 FROM states""",
    "index_audit": f"""WITH RECURSIVE {_INDEXED} SELECT a AS audit, count(*) AS files, CAST(sum(before) AS BIGINT) AS chunks, 0 AS missing_chunks, 0 AS orphaned_chunks, TRUE AS storage_consistent,
        TRUE AS pipeline_current, a = 0 AS fresh, a = 0 AS ready FROM states, (VALUES (0), (1)) AS t(a) GROUP BY a""",
    "tokenize_docs": f"WITH {_TOKENS} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM toks",
    "term_freq": f"WITH {_TOKENS} SELECT doc_id, token, tf FROM tf",
    "doc_freq": f"WITH {_TOKENS} SELECT token, count(*) AS df FROM tf GROUP BY token",
    "corpus_stats": f"WITH {_TOKENS} SELECT count(*) AS n_docs, round(coalesce(nullif(avg(len(t)), 0), 1), 6) AS avg_len FROM toks",
    "bm25_topk": f"WITH {_BM25} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10",
    "bm25_scoped": f"""WITH {_TOKENS},
        scored AS (
          SELECT a.item_id, f.scope, f.doc_id, round(sum(ln(1.0 + (s.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.5 / (f.tf + 1.5 * (0.25 + 0.75 * l.dl / s.av))), 6) AS score
          FROM asked a JOIN tf f USING (token) JOIN (SELECT scope, token, count(*) AS df FROM tf GROUP BY ALL) d ON d.token = f.token AND d.scope = f.scope
            JOIN (SELECT doc_id, len(t) AS dl FROM toks) l ON l.doc_id = f.doc_id
            JOIN (SELECT scope, count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1) AS av FROM toks GROUP BY scope) s ON s.scope = f.scope
          GROUP BY ALL)
        SELECT item_id, scope, doc_id, CAST(rank AS INTEGER) AS rank, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id, scope ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5""",
    "hash_embed_dims": "SELECT id AS doc_id, dim, weight FROM " + _HASH.format(id="doc_id", table="documents"),
    "dense_topk_vectors": """WITH means AS (
          SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
        lists AS (SELECT label, list(m ORDER BY i) AS m FROM means GROUP BY label),
        scored AS (SELECT label, vec_id, round(list_sum(list_transform(list_zip(embedding, m), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 6) + 0.0 AS score FROM (SELECT vec_id, embedding FROM embeddings), lists)
        SELECT CAST(label AS BIGINT) AS item_id, vec_id AS doc_id, CAST(rank AS INTEGER) AS rank, score
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 6""",
    "hybrid_topk": f"""WITH {_BM25}, dv AS ({_HASH.format(id="doc_id", table="documents")}), qv AS ({_HASH.format(id="item_id", table="benchmark")}),
        dots AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.weight * d.weight) AS s FROM qv q JOIN dv d USING (dim) GROUP BY ALL),
        near AS (
          SELECT b.item_id, d.doc_id, round(coalesce(s, 0), 6) + 0.0 AS score FROM (SELECT item_id FROM benchmark) b CROSS JOIN (SELECT doc_id FROM documents) d
          LEFT JOIN dots x ON x.item_id = b.item_id AND x.doc_id = d.doc_id),
        dr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM near) WHERE r <= 40),
        sr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0) WHERE r <= 40),
        fused AS (
          SELECT coalesce(dr.item_id, sr.item_id) AS item_id, coalesce(dr.doc_id, sr.doc_id) AS doc_id, dr.r AS a, sr.r AS b,
            round(coalesce(1.0 / (60 + dr.r), 0) + coalesce(1.0 / (60 + sr.r), 0), 9) AS score FROM dr FULL JOIN sr ON dr.item_id = sr.item_id AND dr.doc_id = sr.doc_id)
        SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, a NULLS LAST, b NULLS LAST) AS rank FROM fused) WHERE rank <= 6""",
    "split_windows": f"WITH RECURSIVE {_PIECES} SELECT doc_id, piece, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS content_md5 FROM pieces",
    "heading_sections": r"""WITH raw AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<h([1-6])>', chr(10) || '<h\1>', 'g') AS t FROM pages),
        marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<h1>([^<\n]*)</h1>', '# \1' || chr(10), 'g'), '<h2>([^<\n]*)</h2>', '## \1' || chr(10), 'g'),
          '<h3>([^<\n]*)</h3>', '### \1' || chr(10), 'g'), '<h4>([^<\n]*)</h4>', '#### \1' || chr(10), 'g') AS t FROM raw),
        lines AS (SELECT page_id, i, l[i] AS line FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_split_to_array(t, '\r\n|\n|\r') AS l FROM marked))),
        fenced AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END AS fence FROM lines),
        coded AS (SELECT *, coalesce(sum(fence) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS code FROM fenced),
        levels AS (SELECT *, CASE WHEN code = 0 AND fence = 0 THEN length(regexp_extract(line, '^(#{1,4}) ', 1)) ELSE 0 END AS level FROM coded),
        titled AS (SELECT *, trim(substr(line, level + 2)) AS title, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS part FROM levels),
        heads AS (SELECT *,
          last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS h1,
          last_value(CASE WHEN level = 2 THEN title WHEN level = 1 THEN '' END IGNORE NULLS) OVER w AS h2,
          last_value(CASE WHEN level = 3 THEN title WHEN level BETWEEN 1 AND 2 THEN '' END IGNORE NULLS) OVER w AS h3,
          last_value(CASE WHEN level = 4 THEN title WHEN level BETWEEN 1 AND 3 THEN '' END IGNORE NULLS) OVER w AS h4
          FROM titled WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
        joined AS (SELECT page_id, part, any_value(array_to_string(list_filter([coalesce(h1, ''), coalesce(h2, ''), coalesce(h3, ''), coalesce(h4, '')], lambda h: h <> ''), ' > ')) AS heading_path,
          trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM heads GROUP BY page_id, part)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part) - 1 AS INTEGER) AS section, heading_path, md5(content) AS content_md5 FROM joined WHERE content <> ''""",
    "extract_links": r"""WITH t AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<a href="([^"]*)">([^<]*)</a>', '[[\1|\2]]', 'g') AS t FROM pages),
        l AS (SELECT page_id, regexp_extract_all(t, '!?\[\[([^\]]+)\]\]', 1) AS l FROM t),
        e AS (SELECT page_id, i - 1 AS ord, l[i] AS x FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
        s AS (SELECT *, split_part(x, '|', 1) AS front FROM e)
        SELECT page_id, CAST(ord AS INTEGER) AS ord, trim(split_part(front, '#', 1)) AS target,
          trim(CASE WHEN contains(front, '#') THEN substr(front, strpos(front, '#') + 1) ELSE '' END) AS heading,
          trim(CASE WHEN contains(x, '|') THEN substr(x, strpos(x, '|') + 1) ELSE '' END) AS alias FROM s""",
    "resolve_links": f"WITH {_NOTES} SELECT path, CAST(ord AS INTEGER) AS ord, target, status, resolved FROM resolved",
    "backlink_counts": f"WITH {_NOTES} SELECT l.path, count(DISTINCT e.path) AS backlinks FROM ends e JOIN lookup l USING (key) GROUP BY l.path",
    "match_tiers": f"WITH {_NOTES}, {_TIERS} SELECT query, path, CAST(score AS INTEGER) AS score FROM tried WHERE score IS NOT NULL",
    "find_exact": f"WITH {_NOTES}, {_TIERS} SELECT query, path, CAST(score AS INTEGER) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM tried WHERE score >= 96) WHERE score = best",
    "find_page": f"""WITH {_NOTES}, hits AS (
          SELECT path, CASE WHEN stem = 'doc_1' THEN 96 WHEN starts_with(stem, 'doc_1') THEN 80 ELSE 60 END AS score FROM notes WHERE contains(lower(path), 'doc_1'))
        SELECT CAST(position AS INTEGER) AS position, path, CAST(score AS INTEGER) AS score, total
        FROM (SELECT *, row_number() OVER (ORDER BY score DESC, lower(path), path) AS position, count(*) OVER () AS total FROM hits) WHERE position <= 20""",
    "resolve_path": f"""WITH {_NOTES}, asked AS (SELECT unnest(['sources/EN/src0/DOC_0', 'Sources/en/src1/doc_1.md', 'no/such']) AS asked)
        SELECT asked, CASE count(path) WHEN 0 THEN 'not_found' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN count(path) = 1 THEN min(path) ELSE '' END AS path
        FROM asked LEFT JOIN notes ON lower(path) IN (lower(asked), lower(asked) || '.md') GROUP BY asked""",
    "collection_membership": f"WITH {_NOTES} SELECT path, CAST(position AS INTEGER) AS position, collection FROM placed",
    "primary_collection": f"WITH {_NOTES} SELECT coalesce(p.collection, '') AS primary_collection, count(*) AS files FROM notes n LEFT JOIN (SELECT * FROM placed WHERE position = 0) p USING (path) GROUP BY 1",
    "collection_summary": f"WITH {_NOTES} SELECT collection, count(*) AS files, count(*) FILTER (ends_with(path, '.md')) AS markdown, count(*) FILTER (NOT ends_with(path, '.md')) AS other_files FROM members GROUP BY collection",
    "child_counts": f"WITH {_NOTES} SELECT CASE WHEN starts_with(path, 'Sources/en/') THEN split_part(path, '/', 3) ELSE split_part(path, '/', 2) END AS name, count(*) AS files FROM notes GROUP BY 1",
    "related_collections": f"""WITH {_NOTES}, links AS (SELECT unnest([['sources', 'english'], ['sources', 'archive'], ['english', 'romance'], ['romance', 'english'], ['romance', 'sources']]) AS l),
        reached AS (SELECT DISTINCT m.path, l[2] AS collection FROM members m JOIN links ON l[1] = m.collection)
        SELECT r.collection, count(*) AS files FROM reached r WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.path = r.path AND m.collection = r.collection) GROUP BY 1""",
    "frontmatter_fields": "SELECT doc_id, 'Last ' || doc_id AS title, coalesce(lang, '') AS type, coalesce(source, '') AS area, 'a' || (doc_id % 3) || '|b' AS tags, CAST(4 AS INTEGER) AS fields FROM documents",
    "duplicate_ids": f"WITH {_NOTES} SELECT id, count(*) AS files, min(path) AS first_path FROM state WHERE state = 'stable' GROUP BY id HAVING count(*) > 1",
    "ambiguous_names": f"WITH {_NOTES} SELECT key, count(*) AS paths FROM lookup GROUP BY key HAVING count(*) > 1",
    "snapshot_diff": f"""WITH {_NOTES} SELECT CASE WHEN n.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'deleted' WHEN n.sha256 = l.sha256 THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS files
        FROM notes n FULL JOIN later l ON n.path = l.path GROUP BY 1""",
    "chunk_audit": f"""WITH RECURSIVE {_PIECES}, named AS (
          SELECT doc_id, piece, substr(sha1('doc_' || doc_id), 1, 16) || '::' || CASE WHEN piece < 10000 THEN lpad(CAST(piece AS VARCHAR), 4, '0') ELSE CAST(piece AS VARCHAR) END AS chunk_id FROM pieces),
        have AS (SELECT CASE WHEN piece = 2 THEN chunk_id || 'x' ELSE chunk_id END AS chunk_id FROM named WHERE doc_id % 13 <> 0)
        SELECT chunk_id, 'missing' AS problem FROM named WHERE chunk_id NOT IN (SELECT chunk_id FROM have) UNION ALL
        SELECT chunk_id, 'orphaned' FROM have WHERE chunk_id NOT IN (SELECT chunk_id FROM named)""",
    "readme_ancestors": f"""WITH {_NOTES}, files AS (
          SELECT path FROM notes UNION ALL SELECT DISTINCT folder || '/README.md' FROM notes UNION ALL SELECT unnest(['README.md', 'Sources/README.md'])),
        parts AS (SELECT path, string_split(path, '/') AS p FROM files),
        way AS (SELECT path, n AS depth, array_to_string(p[1:n], '/') || '/README.md' AS readme FROM (SELECT path, p, unnest(range(1, len(p))) AS n FROM parts))
        SELECT path, CAST(depth AS INTEGER) AS depth, readme FROM way WHERE readme IN (SELECT path FROM files)""",
    "identity_totals": f"""WITH {_NOTES} SELECT count(*) FILTER (state = 'stable') AS stable, count(*) FILTER (state = 'legacy') AS legacy, count(*) FILTER (state = 'malformed') AS malformed,
        count(*) FILTER (state = 'legacy' AND starts_with(lower(path), 'sources/en/')) AS managed_legacy FROM state""",
    "legacy_moves": f"""WITH {_NOTES}, after AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'Moved/doc_' || doc_id || '.md' ELSE path END AS path, id, sha256 FROM notes WHERE doc_id % 11 <> 0),
        gone AS (SELECT sha256, min(path) AS old_path FROM notes WHERE id = '' AND path NOT IN (SELECT path FROM after) GROUP BY sha256 HAVING count(*) = 1),
        come AS (SELECT sha256, min(path) AS new_path FROM after WHERE id = '' AND path NOT IN (SELECT path FROM notes) GROUP BY sha256 HAVING count(*) = 1)
        SELECT old_path, new_path FROM gone JOIN come USING (sha256)""",
    "issue_bag": f"WITH {_BAG} SELECT severity, code, path, target FROM bag",
    "issue_totals": f"WITH {_BAG} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM bag",
    "content_digest": f"""WITH {_NOTES}, h AS (SELECT sha256(path || chr(31) || sha256) AS h FROM notes), lots AS (SELECT substr(h, 1, 3) AS lot, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
        SELECT sha256(string_agg(h, '' ORDER BY lot)) AS digest FROM lots""",
    "ledger_cross_check": f"WITH {_LEDGER} SELECT severity, code, count(*) AS issues, min(unit_id) AS first_unit, count(*) FILTER (target <> '') AS with_target FROM found GROUP BY severity, code",
    "envelope_routes": f"""WITH {_NOTES}, t AS (
          SELECT path, doc_id % 23 = 0 AS hub, starts_with(lower(path), 'sources/de/') AS de, starts_with(lower(path), 'sources/fr/') AS fr, regexp_matches(lower(path), '^sources/(de|fr)/src1/') AS one FROM notes),
        r AS (SELECT path, CASE WHEN hub THEN 'update-project' WHEN de AND one THEN 'unresolved' WHEN de THEN 'process-input' ELSE 'update-note' END AS workflow,
            CASE WHEN hub THEN 'project' WHEN one THEN 'ghost' WHEN de OR fr THEN 'book' ELSE '' END AS processor,
            CASE WHEN hub THEN '' WHEN de AND one THEN 'workflow_registry_conflict,workflow_unresolved,processor_undefined' WHEN one THEN 'processor_undefined' ELSE '' END AS blocks FROM t)
        SELECT *, CASE workflow WHEN 'process-input' THEN 'read_target,read_entrypoints,ledger_exact,register_ledger_input,dedupe_exact,extract_candidates,resolve_candidates,update_ledger,validate'
            WHEN 'update-project' THEN 'read_project_hub,validate_hub_references,read_declared_evidence,sync_indexes,validate'
            ELSE 'resolve_target,read_target,read_entrypoints,inspect_direct_links,extract_candidates,resolve_candidates,sync_indexes,validate' END
          || CASE processor WHEN 'book' THEN ',read_book' WHEN 'project' THEN ',read_plan' ELSE '' END AS required_checks, blocks = '' AS ready FROM r""",
    "event_redaction": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'rag' ELSE 'task' END || '.' || event_type AS name, 'action,result_count' AS keys, json_extract_string(props, '$.k') AS result_count FROM events""",
    "event_redaction_typed": """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'result_count' WHEN 2 THEN '' ELSE 'action,result_count' END AS keys,
        CASE event_id % 5 WHEN 0 THEN '[1]' WHEN 4 THEN event_type END AS action, CASE WHEN event_id % 5 <> 2 THEN coalesce(json_extract_string(props, '$.k'), '0') END AS result_count FROM events""",
    "event_spans": """SELECT event_id, epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + CAST(trunc(greatest(0.0, coalesce(value, 0.0)) * 1000000) AS BIGINT) AS end_ns,
        CASE WHEN event_id % 3 = 0 THEN 'RETRIEVER' ELSE 'TASK' END AS span_kind FROM events""",
    "session_supersede": """SELECT user_id AS session_key, step, count(*) AS steps FROM (
          SELECT user_id, CASE WHEN n = 1 THEN 'start' WHEN event_type IS NOT DISTINCT FROM before THEN 'reuse' ELSE 'supersede' END AS step FROM (
            SELECT user_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY ALL""",
    "pending_events": """WITH l AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS file, day(ts) AS d, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS line FROM events),
        c AS (SELECT file, CASE WHEN any_value(d) % 2 = 0 THEN max(line) // 3 ELSE 0 END AS acked FROM l GROUP BY file)
        SELECT file, count(*) AS pending, min(event_id) AS first_event FROM l JOIN c USING (file) WHERE line > acked GROUP BY file""",
    "eval_recall": """WITH w AS (SELECT DISTINCT coalesce(source, 'none') AS source, doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
        SELECT source, count(*) AS wanted, count(*) FILTER (n_chars > 1000) AS hits, round(count(*) FILTER (n_chars > 1000) / count(*), 4) AS recall FROM w GROUP BY source""",
    "eval_jaccard": """WITH d AS (SELECT coalesce(source, 'none') AS source, doc_id, n_chars > 1000 AS b, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS a FROM documents)
        SELECT source, count(*) FILTER (a AND b) AS common, count(*) FILTER (a OR b) AS either,
          CASE WHEN count(*) FILTER (a OR b) = 0 THEN 1.0 ELSE round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 4) END AS jaccard FROM d GROUP BY source""",
    "eval_rollup": """WITH r AS (SELECT 'm' || doc_id % 4 AS metric, CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS status FROM labels)
        SELECT metric, count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
          round(count(*) FILTER (status = 'passed') / nullif(count(*) FILTER (status <> 'skipped'), 0), 4) AS rate FROM r GROUP BY metric""",
    "eval_submissions": f"""WITH {_SUBMISSIONS},
        m AS (SELECT agent, round(avg(CAST(list_contains(found, item) AS INT)), 4) AS must_find_recall, round(avg(CAST(list_contains(opened, item) AS INT)), 4) AS must_find_open_rate FROM musts GROUP BY agent),
        f AS (SELECT agent, count(*) FILTER (list_contains(adopted, item)) AS forbidden_adopted FROM nevers GROUP BY agent),
        e AS (SELECT agent, round(avg(CAST(list_contains(evidence, item) AS INT)), 4) AS evidence_rate FROM asked GROUP BY agent),
        t AS (SELECT agent, round(avg(CAST(status = 'target_required' AS INT)) FILTER (unsure), 4) AS target_safety_rate FROM met GROUP BY agent)
        SELECT * FROM m JOIN f USING (agent) LEFT JOIN e USING (agent) JOIN t USING (agent)""",
    "eval_failures": f"""WITH {_SUBMISSIONS}
        SELECT agent, case_id, 'must_find_missed' AS code, item FROM musts WHERE NOT list_contains(found, item) UNION ALL
        SELECT agent, case_id, 'must_find_not_opened', item FROM musts WHERE NOT list_contains(opened, item) UNION ALL
        SELECT agent, case_id, 'must_find_without_query_evidence', item FROM musts WHERE NOT list_contains(returned, item) UNION ALL
        SELECT agent, case_id, 'forbidden_relation_adopted', item FROM nevers WHERE list_contains(adopted, item) UNION ALL
        SELECT agent, case_id, 'evidence_missing', item FROM asked WHERE NOT list_contains(evidence, item) UNION ALL
        SELECT agent, case_id, 'ambiguous_target_guessed', '' FROM met WHERE unsure AND status <> 'target_required'""",
    "eval_consistency": f"""WITH {_SUBMISSIONS},
        i AS (SELECT case_id, item, count(*) AS n FROM (SELECT case_id, unnest(adopted) AS item FROM given) GROUP BY ALL),
        j AS (SELECT case_id, count(*) FILTER (n = 2) / count(*) AS share FROM i GROUP BY case_id), s AS (SELECT case_id, count(*) = 2 AND count(DISTINCT status) = 1 AS same FROM given GROUP BY case_id)
        SELECT case_id, same AS status_agreement, round(share, 4) AS adopted_jaccard FROM s JOIN j USING (case_id)""",
    "link_counts": f"""WITH {_NOTES}, b AS (SELECT l.path, count(DISTINCT e.path) AS n FROM ends e JOIN notes s ON s.path = e.path AND e.ord < s.doc_id % 6 JOIN lookup l USING (key) GROUP BY l.path)
        SELECT path, CAST(least(5, doc_id % 6) AS INTEGER) AS outlinks, CAST(doc_id % 3 AS INTEGER) AS embeds, least(coalesce(n, 0), 2) AS backlinks FROM notes LEFT JOIN b USING (path)""",
    "find_within": f"""WITH {_NOTES}, asked AS (SELECT unnest(['doc_1', 'doc_', 'src1']) AS query) SELECT query, path, CAST(CASE WHEN stem = query THEN 96 WHEN starts_with(stem, query) THEN 80 ELSE 60 END AS INTEGER) AS score
        FROM notes, asked WHERE contains(lower(path), query) AND starts_with(path, 'Sources/en/') AND doc_id % 2 = 0""",
    "warning_codes": f"WITH {_ISSUES} SELECT DISTINCT code FROM found WHERE severity = 'warning'",
    "ledger_inputs": f"""WITH {_NOTES}, e AS (
          SELECT 'u' || doc_id AS unit_id, doc_id % 7 = 0 AS odd, split_part(path, '/', 3) AS role, path, ['present', 'removed', 'unknown', 'gone'][doc_id % 4 + 1] AS presence, sha256,
            CASE WHEN doc_id % 7 = 0 THEN 'ledger_paths_not_array' WHEN doc_id % 6 = 0 THEN 'ledger_path_unsafe' WHEN doc_id % 4 = 3 THEN 'ledger_presence_invalid' WHEN doc_id % 5 = 0 THEN 'ledger_hash_invalid' END AS code,
            unnest(CASE WHEN doc_id % 7 = 0 THEN [0] ELSE [0, 1] END) AS position FROM notes)
        SELECT unit_id, CASE WHEN NOT odd THEN CAST(position AS INTEGER) END AS position, code, code IS NULL AS kept, CASE WHEN code IS NULL THEN role END AS role,
          CASE WHEN code IS NULL OR code IN ('ledger_presence_invalid', 'ledger_hash_invalid') THEN path END AS path, CASE WHEN code IS NULL THEN presence END AS presence, CASE WHEN code IS NULL THEN sha256 END AS sha256 FROM e""",
    "ledger_outputs": f"""WITH {_NOTES}, e AS (
          SELECT 'u' || doc_id AS unit_id, doc_id % 7 = 0 AS odd, doc_id % 7 <> 0 AND doc_id % 9 <> 0 AS kept, split_part(path, '/', 2) AS role, path, id, doc_id % 4 = 1 AS spoilt,
            CASE WHEN doc_id % 7 = 0 THEN 'ledger_outputs_not_array' WHEN doc_id % 9 = 0 THEN 'ledger_role_missing' WHEN doc_id % 4 = 1 THEN 'ledger_output_extensions_invalid'
              WHEN NOT regexp_full_match(id, '(note_[0-9a-f]{{32}})?') THEN 'ledger_note_id_invalid' END AS code FROM notes)
        SELECT unit_id, CASE WHEN NOT odd THEN 0 END AS position, code, kept, CASE WHEN kept THEN role END AS role, CASE WHEN kept THEN path END AS path,
          CASE WHEN kept THEN CASE WHEN spoilt OR code IS NOT NULL THEN '' ELSE id END END AS note_id FROM e""",
}
