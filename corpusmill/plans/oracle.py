"""The registered queries in SQL, over the same tables.

Other algorithms than the operators': line by line unnesting, windows, the whole
table of common lengths and recursive folds instead of array expressions, bit rows and bounded
candidates.  Rules and patterns are stated here anew; what is shared are fixed
values (language tables, layers, placeholders, hash constants, message texts) and the parameters of the adapters.
"""

from __future__ import annotations

from corpusmill.functions import languages as lang
from corpusmill.functions.minhash import CONSTANTS
from corpusmill.operators.redaction import PLACEHOLDERS
from corpusmill.operators.transcripts import _CLOSING, _CONVERSATION, _INTRO
from corpusmill.plans import adapters as a
from corpusmill.schemas import LAYERS, LOGIC_LAYERS, LOW_VALUE_LAYERS

LF = "chr(10)"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in values.items()) + "}"


def _pick(values, index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def _with(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


# --- derived tables --------------------------------------------------------------

DOCS = f"""docs AS (
  SELECT doc_id, text, source,
    'https://git.example.com/group' || (CAST(substr(source, 4) AS INTEGER) % 5) || '/' || source
      || CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN '.git' ELSE '' END AS repo_url,
    {_pick(a.DIRECTORIES, 'doc_id')} || 'f' || doc_id || {_pick(a.SUFFIXES, 'doc_id // 3')} AS path
  FROM documents)"""

FILES = f"""files AS (
  SELECT doc_id, source, repo_url, path, text, array_to_string(list_transform(string_split(text, {LF}),
    lambda x, i: CASE WHEN (i - 1) % 5 = 4 THEN '  # ' || x WHEN (i - 1) % 5 = 3 THEN '// ' || x
      WHEN (i - 1) % 7 = 6 THEN '' ELSE x END), {LF}) AS content
  FROM docs)"""

EDITED = f"""edited AS (
  SELECT source AS folder, path, text AS before, coalesce((SELECT string_agg(
      CASE WHEN k % 9 = 5 THEN x || {LF} || 'inserted after ' || k ELSE x END, {LF} ORDER BY k)
    FROM (SELECT unnest(string_split(content, {LF})) AS x, unnest(range(0, len(string_split(content, {LF})))) AS k)
    WHERE k % 9 = 5 OR k % 13 <> 12), '') AS after
  FROM files)"""
_EDITED_PAIRS = "SELECT folder, path, before, after FROM edited"

_NAME = "lower(regexp_extract({path}, '[^/]*$'))"


def _language(path: str) -> str:
    name = _NAME.format(path=path)
    endings = " ".join(
        f"WHEN ends_with({name}, {_text(e)}) THEN {_text(n)}" for e, n in lang.NAME_ENDINGS.items()
    )
    return (
        f"CASE {endings} ELSE coalesce({_map(lang.EXACT_NAMES)}[{name}], "
        f"{_map(lang.LANGUAGE_BY_SUFFIX)}[regexp_extract({name}, '^.+(\\.[^.]+)$', 1)], '') END"
    )


TAGGED = f"""tagged AS (
  SELECT *, {_language('path')} AS language, strlen(content) AS size FROM files)"""

FILE_LINES = f"""file_lines AS (
  SELECT repo_url, path, language,
    CAST(length(content) - length(replace(content, {LF}, ''))
      + CASE WHEN ends_with(content, {LF}) THEN 0 ELSE 1 END AS BIGINT) AS lines
  FROM tagged
  WHERE size > 0 AND size <= 20971520 AND language <> ''
    AND NOT list_has_any(string_split(path, '/')[:-2],
      ['node_modules', 'vendor', 'dist', 'build', 'bower_components', '.git']))"""

COUNTS = """counts AS (
  SELECT repo_url, language, CAST(sum(lines) AS BIGINT) AS n FROM file_lines GROUP BY ALL
  HAVING sum(lines) > 0),
totals AS (SELECT repo_url, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY ALL),
ranked AS (
  SELECT repo_url, language, n, total,
    row_number() OVER (PARTITION BY repo_url ORDER BY n DESC, language) AS rn
  FROM counts JOIN totals USING (repo_url))"""

PROFILE = f"""focus AS (
  SELECT repo_url, arg_min(language, rn) AS code_primary FROM ranked
  WHERE language NOT IN {_in(lang.NON_CODE_LANGUAGES)} AND n / total >= 0.05 GROUP BY repo_url)"""

_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _starts(prefixes) -> str:
    return "(" + " OR ".join(f"starts_with(body, {_text(p)})" for p in prefixes) + ")"


LINES = f"""raw_lines AS (
  SELECT repo_url, path, language, content,
    unnest(regexp_split_to_array(content, '{_BREAKS}')) AS line,
    generate_subscripts(regexp_split_to_array(content, '{_BREAKS}'), 1) AS i,
    len(regexp_split_to_array(content, '{_BREAKS}')) AS parts
  FROM tagged),
bodies AS (
  SELECT *, regexp_replace(line, '^{_SPACE}', '') AS body FROM raw_lines
  WHERE NOT (i = parts AND line = '')),
marked AS (
  SELECT repo_url, path, language, i, body <> '' AND NOT (CASE
    WHEN lower(language) IN ('python', 'ruby', 'shell', 'bash', 'yaml') THEN {_starts(("#",))}
    WHEN lower(language) IN ('typescript', 'typescript typings', 'javascript', 'jsx', 'go', 'java', 'kotlin', 'c',
      'c header', 'c++', 'c++ header', 'c#', 'cpp', 'swift', 'objective c', 'objective c++', 'dart', 'scala')
      THEN {_starts(("//", "*", "/*", "*/"))}
    WHEN lower(language) = 'rust' THEN {_starts(lang.PREFIXES_BY_LANGUAGE["rust"])}
    WHEN lower(language) = 'php' THEN {_starts(lang.PREFIXES_BY_LANGUAGE["php"])}
    ELSE {_starts(lang.OTHER_PREFIXES)} END) AS is_code
  FROM bodies),
loc AS (
  SELECT t.repo_url, t.path, t.language, CAST(count(m.i) AS BIGINT) AS total_lines,
    CAST(count(*) FILTER (WHERE m.is_code) AS BIGINT) AS loc
  FROM tagged t LEFT JOIN marked m ON t.repo_url = m.repo_url AND t.path = m.path
  GROUP BY ALL)"""

REQUESTS = f"""req AS (
  SELECT repo_url, {_pick(LAYERS, 'doc_id')} AS layer, doc_id * 4 AS seq, path,
    CASE WHEN doc_id % 11 = 0 THEN 2 WHEN doc_id % 13 = 0 THEN 9 END AS s,
    CASE WHEN doc_id % 11 = 0 THEN 6 WHEN doc_id % 13 = 0 THEN 3 END AS e FROM docs
  UNION ALL SELECT repo_url, {_pick(LAYERS, 'doc_id')}, doc_id * 4 + 1, './' || path, NULL, NULL
    FROM docs WHERE doc_id % 17 = 0
  UNION ALL SELECT repo_url, {_pick(LAYERS, 'doc_id')}, doc_id * 4 + 2, 'missing/' || path, NULL, NULL
    FROM docs WHERE doc_id % 19 = 0
  UNION ALL SELECT repo_url, {_pick(LAYERS, 'doc_id')}, doc_id * 4 + 3, path, 1, 3
    FROM docs WHERE doc_id % 7 = 0),
asked AS (
  SELECT r.*, regexp_replace(r.path, '^\\./', '') AS norm_path, l.total_lines,
    {_language('r.path')} AS language,
    CASE WHEN s IS NULL THEN 0 ELSE greatest(1, s) - 1 END AS first_line,
    CASE WHEN s IS NULL THEN l.total_lines ELSE least(e, l.total_lines) END AS last_line
  FROM req r LEFT JOIN loc l
    ON l.repo_url = r.repo_url AND l.path = regexp_replace(r.path, '^\\./', '')),
chunks AS (
  SELECT k.repo_url, k.seq, k.path, k.norm_path, k.layer, k.language, k.first_line, k.last_line,
    k.s, k.total_lines,
    CAST(count(m.i) FILTER (WHERE m.is_code) AS BIGINT) AS loc
  FROM asked k LEFT JOIN marked m ON m.repo_url = k.repo_url AND m.path = k.norm_path
    AND m.i > k.first_line AND m.i <= k.last_line
  GROUP BY ALL),
checked AS (
  SELECT *, CASE WHEN total_lines IS NULL THEN 'not_found' END AS missing,
    CASE WHEN s IS NOT NULL AND first_line >= last_line THEN 'bad_range'
      WHEN loc = 0 THEN 'zero_loc' END AS flaw,
    coalesce(s IS NOT NULL AND (first_line > 0 OR last_line < total_lines), FALSE) AS is_partial,
    row_number() OVER (PARTITION BY repo_url ORDER BY seq) AS rn
  FROM chunks)"""

_T, _C = a.BUDGET.target_loc, a.BUDGET.cap_loc
FOLD = f"""fold AS (
  SELECT repo_url, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS total, CAST([] AS VARCHAR[]) AS taken,
    CAST(NULL AS VARCHAR) AS reason, FALSE AS saved
  FROM (SELECT DISTINCT repo_url FROM checked)
  UNION ALL
  SELECT repo_url, rn, CASE WHEN reason IS NULL THEN total + loc ELSE total END,
    CASE WHEN reason IS NULL THEN list_append(taken, norm_path) ELSE taken END,
    reason, reason IS NULL
  FROM (
    SELECT c.repo_url, c.rn, f.total, f.taken, c.loc, c.norm_path,
      CASE WHEN c.missing IS NOT NULL THEN c.missing
        WHEN list_contains(f.taken, c.norm_path) THEN 'duplicate'
        WHEN c.flaw IS NOT NULL THEN c.flaw
        WHEN f.total + c.loc > {_C} AND f.total >= {_T} THEN 'budget_exhausted'
        WHEN f.total + c.loc > {_C} THEN 'too_large' END AS reason
    FROM fold f JOIN checked c ON c.repo_url = f.repo_url AND c.rn = f.rn + 1)),
outcome AS (
  SELECT c.*, f.saved, f.reason, f.total,
    CASE WHEN f.saved THEN len(f.taken) END AS rank
  FROM checked c JOIN fold f ON f.repo_url = c.repo_url AND f.rn = c.rn)"""

SAVED = """saved AS (
  SELECT o.*, focus.code_primary AS primary_language
  FROM outcome o LEFT JOIN focus USING (repo_url) WHERE o.saved)"""


def _r4(value: str) -> str:
    return f"CAST(printf('%.4f', {value}) AS DOUBLE)"


ROLLUP = f"""by_lang AS (
  SELECT repo_url, language, CAST(sum(loc) AS BIGINT) AS n FROM saved GROUP BY ALL),
lang_text AS (
  SELECT repo_url, string_agg(entry, ';' ORDER BY entry) AS sample_lang_loc
  FROM (SELECT repo_url, CASE WHEN language = '' THEN 'Unknown' ELSE language END || '=' || n AS entry
        FROM by_lang) GROUP BY repo_url),
main_lang AS (
  SELECT repo_url, language AS main_language FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY n DESC, language DESC) AS k
    FROM by_lang WHERE language <> '' AND language NOT IN {_in(lang.NON_CODE_LANGUAGES)}) WHERE k = 1),
rollup_rows AS (
  SELECT repo_url, CAST(sum(loc) AS BIGINT) AS total_loc, count(*) AS file_count,
    coalesce(sum(loc) FILTER (WHERE layer = 'test'), 0) AS test_loc,
    coalesce(sum(loc) FILTER (WHERE layer IN {_in(LOGIC_LAYERS)}), 0) AS logic_loc,
    coalesce(sum(loc) FILTER (WHERE layer IN {_in(LOW_VALUE_LAYERS)}), 0) AS low_loc,
    coalesce(sum(loc) FILTER (WHERE language = primary_language), 0) AS primary_loc,
    any_value(primary_language) AS primary_language,
    string_agg(rank || ':' || path || ':' || layer || ':' || loc, ';' ORDER BY rank) AS files,
    string_agg('- `' || path || '` (' || layer || ', ' || loc || ' lines)', {LF} ORDER BY rank) AS listing,
    arg_min(path, rank) AS first_path
  FROM saved GROUP BY repo_url),
layers AS (
  SELECT s.repo_url, s.layer, sum(s.loc) AS n, any_value(r.total_loc) AS total
  FROM saved s JOIN rollup_rows r USING (repo_url) GROUP BY s.repo_url, s.layer),
breakdowns AS (
  SELECT repo_url, string_agg(layer || ': ' || CAST(round_even(n / total * 100, 0) AS BIGINT) || '%',
    ', ' ORDER BY n DESC, layer) AS breakdown
  FROM layers GROUP BY repo_url)"""

FILE_CTES = (DOCS, FILES, TAGGED)
PROFILE_CTES = (*FILE_CTES, FILE_LINES, COUNTS, PROFILE)
FOLD_CTES = (*PROFILE_CTES, LINES, REQUESTS, FOLD, SAVED)
ROLLUP_CTES = (*FOLD_CTES, ROLLUP)


def _rollup(select: str) -> str:
    return _with(*ROLLUP_CTES, select=select, recursive=True)


_ORDER_REPO = (
    "'https://git.example.com/org' || (o_custkey % 200 % 7) || '/team/repo' || (o_custkey % 200) || '.git'"
)
COMMITS = f"""commit_rows AS (
  SELECT {_ORDER_REPO} AS repo_url, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS sha,
    (20000 - date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) * 1000000000 + o_orderkey AS pos,
    o_orderkey % 7 <> 0 AS on_head, o_orderkey % 997 = 0 AS imported
  FROM orders),
commits AS (
  SELECT *, imported OR pos = max(pos) OVER (PARTITION BY repo_url) AS is_root FROM commit_rows)"""

IDENTITY = """identity AS (
  SELECT repo_url,
    coalesce(string_agg(sha, ',' ORDER BY pos) FILTER (WHERE on_head AND is_root), '') AS first_commit_hash,
    coalesce(string_agg(sha, ',' ORDER BY pos DESC) FILTER (WHERE on_head AND age <= 10), '')
      AS early_commit_hashes,
    coalesce(arg_min(sha, pos) FILTER (WHERE on_head), '') AS head_commit_sha
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, on_head ORDER BY pos DESC) AS age FROM commits)
  GROUP BY repo_url)"""

_HOST = "regexp_extract(url, '^https?://([^/]+)/', 1)"
_REST = "regexp_extract(url, '^https?://[^/]+/(.*)$', 1)"
REPO_LIST = f"""list_lines AS (
  SELECT CASE WHEN page_id % 16 = 7 THEN ' # ' || url
      WHEN page_id % 4 = 1 THEN 'git@' || {_HOST} || ':' || {_REST} || '.git'
      WHEN page_id % 4 = 2 THEN chr(9) || ' ' || url || '/ '
      WHEN page_id % 4 = 3 THEN '# ' || url ELSE url END AS value,
    page_id + copy * 100000000 AS line_no
  FROM pages, (VALUES (0), (1)) AS v(copy) WHERE copy = 0 OR page_id % 5 = 0),
repo_list AS (
  SELECT trim(value, ' ' || chr(9)) AS repo_url, min(line_no) AS line_no FROM list_lines
  WHERE trim(value, ' ' || chr(9)) <> '' AND NOT starts_with(value, '#') GROUP BY 1)"""

VERSIONS = """versions AS (
  SELECT 'https://git.example.com/u/repo' || user_id AS repo_url, epoch_us(ts) AS version, event_id,
    CAST(floor(value) AS BIGINT) AS total_loc, event_id % 40 AS file_count, event_type AS language,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS sampled_at
  FROM events)"""


def _latest(name: str, where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY version DESC, event_id DESC) AS k
    FROM versions WHERE {where}) WHERE k = 1)"""


TEXTS = DOCS


_LABELS = r"[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)+"
_OCTET = "([0-9]|[1-9][0-9]|[01][0-9][0-9]|0[0-9]|2[0-4][0-9]|25[0-5])"
# Look-arounds are written as groups, so neighbours need a second round; chr(1) holds the place of a host in user@host:path.
_REDACT_STEPS = (
    (r"((?i:api_?key|access_?key|token|secret|passwd|password)[\"'']?[\t ]*[=:][\t ]*[\"'']?)[\w/+-]+", r"'\1REDACTED'", 1),
    (r"AKIA[A-Z0-9]{16}", "'REDACTED'", 1),
    (r"\b((?i:bearer)[\t ]+)[\w.~+/=-]+", r"'\1REDACTED'", 1),
    (r"\b(gh[oprsu]_[0-9A-Za-z]{20,}|glpat-[\w-]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[\w-]{20,})", "'REDACTED'", 1),
    (rf"@{_LABELS}(:[\w~])", r"'@' || chr(1) || '\2'", 1),
    (r"[\w.%+-]+@[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*\.[A-Za-z][A-Za-z]+", "'user@example.com'", 1),
    (r"\x01", "'example.com'", 1),
    (r"(://[^/ \t\n:@]+:)[^/ \t\n@]+@", r"'\1REDACTED@'", 1),
    (r"((https?|ftp|ssh|git)://([\w.~%+-]+(:[^@/ \t\n]*)?@)?)[0-9A-Za-z.-]+", r"'\1example.com'", 1),
    (rf"www\.{_LABELS}", "'example.com'", 1),
    (r"(^|[^\w@/.-])(?i:([0-9a-z][0-9a-z-]*\.)+(com|org|net|de|ru|fr|uk|eu|info|biz))($|\.$|\.[^0-9A-Za-z]|[^\w(.-])",
     r"'\1example.com\4'", 2),
    (r"\+[0-9]{1,3}[-. ]?\(?[0-9]{2,4}\)?[-. ]?[0-9]{3}([-. ]?[0-9]{4}|[-. ][0-9]{2}[-. ][0-9]{2})", "'+1-555-0100'", 1),
    (r"(^|[^\w+.-])8[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -][0-9]{2}[ -][0-9]{2}($|[^0-9])", r"'\1+1-555-0100\2'", 2),
    (rf"(^|[^\w.])({_OCTET}\.){{3}}{_OCTET}($|\.$|\.[^0-9]|[^\w.])", r"'\1192.0.2.1\5'", 2),
)


def _redact_chain() -> str:
    expr = "text"
    for pattern, put, rounds in _REDACT_STEPS:
        for _ in range(rounds):
            expr = f"regexp_replace({expr}, '{pattern}', {put}, 'g')"
    return expr


def _units(text: str) -> str:
    """Words of a text cut at their capitals, as a list of lists of pieces: chr(2) stands at each cut."""
    cut = rf"regexp_replace(regexp_replace({text}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1' || chr(2) || '\2', 'g'), " \
          rf"'(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1' || chr(2) || '\2', 'g')"
    return rf"regexp_extract_all({cut}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+')"


_KINDS = ("company", "product", "person")
_IS_WORD = r"regexp_matches(piece, '^[\p{L}\p{N}]')"
REDACTED = rf"""bench_words AS (
  SELECT item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM benchmark),
named AS (
  SELECT array_to_string(w[s + 1 : s + n], ' ') AS name, {_pick(_KINDS, 'item_id + s')} AS kind
  FROM (SELECT item_id, w, unnest(range(0, len(w))) AS s FROM bench_words), (SELECT unnest([3, 4]) AS n)
  WHERE s + n <= len(w) AND (n = 3 OR s % 5 = 0)),
gaz AS (
  SELECT min(name) AS name, {_map(PLACEHOLDERS)}[{_list(_KINDS)}[min(list_position({_list(_KINDS)}, kind))]] AS put
  FROM named GROUP BY lower(name)),
wanted_names AS (
  SELECT name, put, list_transform(list_filter({_units("name")}, lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]')),
    lambda x: lower(x)) AS u FROM gaz),
cleaned AS (SELECT source AS folder, path, text, {_redact_chain()} AS masked FROM docs),
pieces AS (
  SELECT path, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT path, {_units("masked")} AS p FROM cleaned)),
spots AS (
  SELECT *, {_IS_WORD} AS is_word, length(replace(piece, chr(2), '')) AS size,
    CAST(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY path ORDER BY k) AS BIGINT) AS stop FROM pieces),
unit_rows AS (
  SELECT path, lower(piece) AS u, stop - size AS start, stop, row_number() OVER w AS n,
    lead(lower(piece), 1) OVER w AS u2, lead(lower(piece), 2) OVER w AS u3
  FROM spots WHERE is_word WINDOW w AS (PARTITION BY path ORDER BY k)),
lists AS (
  SELECT path, list(u ORDER BY n) AS us, list(start ORDER BY n) AS starts, list(stop ORDER BY n) AS stops
  FROM unit_rows GROUP BY path),
met AS (
  SELECT r.path, r.n, g.name, g.put, len(g.u) AS many, r.start, l.stops[r.n + len(g.u) - 1] AS stop
  FROM unit_rows r JOIN wanted_names g ON g.u[1] = r.u AND g.u[2] = r.u2 AND g.u[3] = r.u3
  JOIN lists l ON l.path = r.path JOIN cleaned c ON c.path = r.path
  WHERE l.us[r.n : r.n + len(g.u) - 1] = g.u AND len(list_filter(range(r.n, r.n + len(g.u) - 1), lambda q:
    substr(c.masked, l.stops[q] + 1, l.starts[q + 1] - l.stops[q]) NOT IN ('', ' ', chr(9), '_', '-'))) = 0),
best AS (
  SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY path, n ORDER BY many DESC, length(name) DESC, name, put) = 1),
taken AS (
  SELECT DISTINCT path, 0::BIGINT AS n, 1::BIGINT AS beyond FROM best
  UNION ALL
  SELECT b.path, b.n, b.n + b.many
  FROM (SELECT t.path, min(b.n) AS n FROM taken t JOIN best b ON b.path = t.path AND b.n >= t.beyond GROUP BY t.path) f
  JOIN best b USING (path, n)),
put_in AS (
  SELECT path, b.start, b.stop, coalesce(lag(b.stop) OVER w, 0) AS done, lead(b.start) OVER w IS NULL AS is_last,
    CASE WHEN regexp_matches(substr(masked, b.start, CASE WHEN b.start = 0 THEN 0 ELSE 1 END) || ' '
        || substr(masked, b.stop + 1, 1), '[\p{{L}}\p{{N}}_]') OR contains(substr(masked, b.start + 1, b.stop - b.start), '_')
      THEN replace(put, ' ', '') ELSE put END AS put, masked
  FROM taken t JOIN best b USING (path, n) JOIN cleaned USING (path) WINDOW w AS (PARTITION BY path ORDER BY b.start)),
rebuilt AS (
  SELECT path, string_agg(substr(masked, done + 1, start - done) || put
    || CASE WHEN is_last THEN substr(masked, stop + 1) ELSE '' END, '' ORDER BY start) AS redacted
  FROM put_in GROUP BY path),
redacted AS (
  SELECT folder, path, text, coalesce(r.redacted, masked) AS redacted FROM cleaned LEFT JOIN rebuilt r USING (path))"""


def _numbered(name: str, column: str, line: str) -> str:
    lines = f"string_split(regexp_replace({column}, '\\n$', ''), {LF})"
    return f"""{name} AS (
  SELECT folder, path, unnest({lines}) AS line, generate_subscripts({lines}, 1) AS {line}, len({lines}) AS n
  FROM changing WHERE {column} <> '')"""


def _between(name: str, lines: str, line: str, other: str, number: str) -> str:
    """Lines between head and tail that the other version has there too, numbered anew."""
    return f"""{name} AS (
  SELECT x.folder, x.path, x.{line}, x.line, row_number() OVER (PARTITION BY x.folder, x.path ORDER BY x.{line}) AS {number}
  FROM {lines} x JOIN edge e USING (folder, path)
  WHERE x.{line} > head AND x.{line} <= x.n - tail AND EXISTS (SELECT 1 FROM {other} y
    WHERE y.folder = x.folder AND y.path = x.path AND y.line = x.line AND y.{'j' if line == 'i' else 'i'} > head
      AND y.{'j' if line == 'i' else 'i'} <= y.n - tail))"""


def _change_ctes(pairs: str) -> str:
    """Changed lines and hunks of ``pairs(folder, path, before, after)``: the table of common lengths row by row."""
    return f"""pairs AS ({pairs}),
changing AS (SELECT * FROM pairs WHERE before <> after),
{_numbered("old_lines", "before", "i")},
{_numbered("new_lines", "after", "j")},
sizes AS (
  SELECT c.folder, c.path, coalesce(max(o.n), 0) AS n, coalesce(max(w.n), 0) AS m FROM changing c
  LEFT JOIN old_lines o USING (folder, path) LEFT JOIN new_lines w USING (folder, path) GROUP BY ALL),
heads AS (
  SELECT s.folder, s.path, s.n, s.m, coalesce(min(o.i) FILTER (o.line IS DISTINCT FROM w.line), least(s.n, s.m) + 1) - 1 AS head
  FROM sizes s LEFT JOIN old_lines o USING (folder, path)
  LEFT JOIN new_lines w ON w.folder = o.folder AND w.path = o.path AND w.j = o.i GROUP BY s.folder, s.path, s.n, s.m),
edge AS (
  SELECT h.folder, h.path, h.n, h.m, head, least(least(h.n, h.m) - head,
    coalesce(min(h.n - o.i + 1) FILTER (o.line IS DISTINCT FROM w.line), least(h.n, h.m) + 1) - 1) AS tail
  FROM heads h LEFT JOIN old_lines o USING (folder, path)
  LEFT JOIN new_lines w ON w.folder = o.folder AND w.path = o.path AND w.n - w.j = o.n - o.i GROUP BY h.folder, h.path, h.n, h.m, head),
{_between("old_in", "old_lines", "i", "new_lines", "r")},
{_between("new_in", "new_lines", "j", "old_lines", "c")},
grid AS (
  SELECT folder, path, rows_in, cols_in FROM (SELECT folder, path, max(r) AS rows_in FROM old_in GROUP BY ALL)
  JOIN (SELECT folder, path, max(c) AS cols_in FROM new_in GROUP BY ALL) USING (folder, path)),
common AS (
  SELECT folder, path, rows_in + 1 AS r, unnest(range(1, cols_in + 2)) AS c, 0 AS l FROM grid
  UNION ALL
  SELECT folder, path, r, c, max(step) OVER (PARTITION BY folder, path ORDER BY c DESC) FROM (
    SELECT k.folder, k.path, k.r - 1 AS r, k.c, greatest(k.l, CASE WHEN o.line = w.line THEN k.beyond + 1 ELSE 0 END) AS step
    FROM (SELECT *, lead(l) OVER (PARTITION BY folder, path ORDER BY c) AS beyond FROM common) k
    JOIN old_in o ON o.folder = k.folder AND o.path = k.path AND o.r = k.r - 1
    LEFT JOIN new_in w ON w.folder = k.folder AND w.path = k.path AND w.c = k.c)),
moves AS (
  SELECT k.folder, k.path, k.r, k.c, o.i, w.j, o.line = w.line AS same, n.l = k.l AS skip
  FROM common k JOIN old_in o USING (folder, path, r) JOIN new_in w USING (folder, path, c)
  JOIN common n ON n.folder = k.folder AND n.path = k.path AND n.r = k.r AND n.c = k.c + 1),
walk AS (
  SELECT folder, path, 1::BIGINT AS r, 1::BIGINT AS c, NULL::BIGINT AS i, NULL::BIGINT AS j FROM grid
  UNION ALL
  SELECT v.folder, v.path, v.r + CASE WHEN same OR NOT skip THEN 1 ELSE 0 END, v.c + CASE WHEN same OR skip THEN 1 ELSE 0 END,
    CASE WHEN same THEN v.i END, CASE WHEN same THEN v.j END
  FROM walk k JOIN moves v ON v.folder = k.folder AND v.path = k.path AND v.r = k.r AND v.c = k.c),
stays AS (
  SELECT folder, path, i, j FROM walk WHERE i IS NOT NULL
  UNION ALL SELECT folder, path, k, k FROM (SELECT folder, path, unnest(range(1, head + 1)) AS k FROM edge)
  UNION ALL SELECT folder, path, n - k, m - k FROM (SELECT folder, path, n, m, unnest(range(0, tail)) AS k FROM edge)
  UNION ALL SELECT folder, path, n + 1, m + 1 FROM edge),
runs AS (
  SELECT * FROM (
    SELECT folder, path, coalesce(lag(i) OVER w, 0) + 1 AS old_first, i - 1 AS old_last,
      coalesce(lag(j) OVER w, 0) + 1 AS new_first, j - 1 AS new_last
    FROM stays WINDOW w AS (PARTITION BY folder, path ORDER BY i, j))
  WHERE old_last >= old_first OR new_last >= new_first),
changed AS (
  SELECT r.folder, r.path, o.i AS line_no, w.j AS new_line_no, o.line AS before, w.line AS after
  FROM (SELECT *, unnest(range(0, greatest(old_last - old_first, new_last - new_first) + 1)) AS k FROM runs) r
  LEFT JOIN old_lines o ON o.folder = r.folder AND o.path = r.path AND o.i = old_first + k AND o.i <= old_last
  LEFT JOIN new_lines w ON w.folder = r.folder AND w.path = r.path AND w.j = new_first + k AND w.j <= new_last),
changes AS (
  SELECT folder, path, count(*) FILTER (apart) AS hunks, CAST(sum(new_last - new_first + 1) AS BIGINT) AS additions,
    CAST(sum(old_last - old_first + 1) AS BIGINT) AS deletions, FALSE AS hidden
  FROM (SELECT *, coalesce(old_first - lag(old_last) OVER (PARTITION BY folder, path ORDER BY old_first, new_first) - 1 > 6, TRUE)
          AS apart FROM runs)
  GROUP BY folder, path)"""


_REDACTED_PAIRS = "SELECT folder, path, text AS before, redacted AS after FROM redacted"

MESSAGES = """messages AS (
  SELECT conv_id AS run_id, turn AS pos, CASE WHEN role = 'user' THEN 'tool' ELSE role END AS role,
    text AS content FROM conversations)"""

_GOOD = '{"name":"bash","arguments_json":"{\\"command\\":\\"ls\\"}"}'
_WORDS = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


def _calls(calls: str) -> str:
    return f"'{{\"content\":\"' || {_WORDS} || '\",\"tool_calls\":{calls}}}'"


TURNS = f"""turns AS (
  SELECT conv_id * 1000 + turn AS turn_id, conv_id % 10 AS form, {_WORDS} AS words,
    CASE conv_id % 10 WHEN 0 THEN {_calls(f'[{_GOOD},{_GOOD}]')} WHEN 1 THEN {_calls('[]')}
      WHEN 2 THEN '{{"content":"' || {_WORDS} || '"}}' WHEN 3 THEN {_calls('"none"')}
      WHEN 4 THEN {_calls(f'[{_GOOD},7]')} WHEN 5 THEN {_calls('[{"name":"","arguments_json":"{}"}]')}
      WHEN 6 THEN {_calls('[{"name":"bash","arguments_json":"not json"}]')}
      WHEN 7 THEN {_calls(f'[{_GOOD},' + '{"name":"bash","arguments_json":"[1]"}]')}
      WHEN 8 THEN '[1]' ELSE '{{"content":"' || {_WORDS} || '"' END AS payload
  FROM conversations),
turn_calls AS (
  SELECT turn_id, CASE WHEN json_valid(payload) THEN json_type(payload) END AS kind,
    CASE WHEN json_valid(payload) THEN payload -> '$.tool_calls' END AS calls,
    CASE WHEN json_valid(payload) THEN payload ->> '$.content' END AS content
  FROM turns),
call_rows AS (
  SELECT turn_id, i, call, CASE WHEN json_type(call) <> 'OBJECT' THEN 'call_not_object'
      WHEN coalesce(call ->> '$.name', '') = '' THEN 'call_without_name'
      WHEN NOT coalesce(json_valid(call ->> '$.arguments_json'), FALSE) THEN 'invalid_arguments'
      WHEN json_type(call ->> '$.arguments_json') <> 'OBJECT' THEN 'arguments_not_object' END AS flaw
  FROM (SELECT turn_id, unnest(CAST(calls AS JSON[])) AS call,
          generate_subscripts(CAST(calls AS JSON[]), 1) - 1 AS i
        FROM turn_calls WHERE json_type(calls) = 'ARRAY')),
judged AS (
  SELECT t.turn_id, CASE WHEN t.kind IS NULL OR t.kind <> 'OBJECT' OR t.calls IS NULL
      OR json_type(t.calls) <> 'ARRAY' THEN 'missing_tool_calls'
      ELSE (SELECT arg_min(flaw, i) FROM call_rows c WHERE c.turn_id = t.turn_id AND flaw IS NOT NULL) END
      AS reason, coalesce(t.content, '') AS content,
    coalesce((SELECT string_agg('call_' || i || '|' || (call ->> '$.name') || '|'
      || (call ->> '$.arguments_json'), ';' ORDER BY i) FROM call_rows c WHERE c.turn_id = t.turn_id), '')
      AS tool_calls
  FROM turn_calls t)"""

_CLASS = (
    "CASE WHEN regexp_matches(error, '(?i)not logged in|unauthorized|\\b401\\b|\\b403\\b|credit balance|"
    "usage limit|model_not_found|issue with the selected model|unrecognized_model|hit your limit') THEN 'auth' "
    "WHEN regexp_matches(error, '(?i)timed? ?out|timeout|not JSON|\\b(429|500|502|503)\\b') THEN 'retryable' "
    "ELSE 'other' END"
)
ERRORS = f"""errors AS (
  SELECT 'https://git.example.com/u/repo' || user_id AS repo_url,
    {_pick(a.ERROR_STAGES, 'event_id')} AS stage, {_pick(a.ERROR_TEXTS, 'event_id')} AS error, ts, event_id
  FROM events WHERE event_type = 'error')"""

_SUMMARY = (
    "'# Sample of a repository' || chr(10) || chr(10) || 'Nobody described this repository; the figures below come from the "
    "sample itself.' || chr(10) || chr(10) || 'Sampled: ' || file_count || ' files with ' || total_loc || ' code lines.' "
    "|| chr(10) || 'By layer: ' || breakdown || chr(10) || chr(10) || listing || chr(10)"
)


def _share(part: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN {part} / {total} ELSE 0.0 END"


_SIGNATURE = " || ',' || ".join(
    f"lower(lpad(to_hex(min(CAST((CAST(v AS UHUGEINT) * {m}::UHUGEINT + {b}::UHUGEINT)"
    f" % 18446744073709551616::UHUGEINT AS UBIGINT))), 16, '0'))"
    for m, b in CONSTANTS
)

SQL: dict[str, str] = {
    "repo_list": _with(REPO_LIST, select="SELECT repo_url, line_no FROM repo_list"),
    "repo_urls": _with(
        REPO_LIST,
        """bare AS (SELECT repo_url, regexp_replace(rtrim(repo_url, '/'), '\\.git$', '') AS v FROM repo_list),
spread AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(v, '^[a-zA-Z]+://', ''),
    '^([^:]*):', '\\1/'), '^[^@/]+@', '') AS path FROM bare),
segs AS (SELECT *, list_filter(string_split(path, '/')[2:], lambda x: x <> '') AS s FROM spread)""",
        select="""SELECT repo_url,
  replace(CASE WHEN starts_with(v, 'git@') THEN regexp_replace(substr(v, 5), '^([^:]*):', '\\1/')
    ELSE regexp_replace(v, '^(https|http|git|ssh)://', '') END, '/', '__') AS folder_name,
  CASE WHEN len(s) > 1 THEN array_to_string(s[:-2], '/') ELSE '' END AS repo_org,
  regexp_extract(regexp_extract(v, '[^/]*$'), '[^:]*$') AS repo_name,
  regexp_extract(rtrim(repo_url, '/'), '[^/]*$') AS display_name,
  regexp_replace(repo_url, '^https?://([^/]+)/(.+?)(\\.git)?/?$', 'ssh://git@\\1:10022/\\2.git') AS ssh_url,
  regexp_replace(repo_url, '^(?:ssh://)?git@([^:/]+)[:/](.+?)(\\.git)?/?$', 'https://\\1/\\2.git') AS https_url
FROM segs""",
    ),
    "latest_branch": f"""SELECT repo_url, refname, tip_sha, strftime(committer_ts, '%Y-%m-%d') AS committer_ts
FROM (SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY committer_ts DESC, refname) AS k FROM (
  SELECT {_ORDER_REPO} AS repo_url, CASE WHEN o_orderkey % 10 = 0 THEN 'refs/remotes/origin/HEAD'
      ELSE 'refs/remotes/origin/b' || o_orderkey END AS refname,
    date_trunc('month', o_orderdate) AS committer_ts,
    substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS tip_sha FROM orders)
  WHERE refname NOT LIKE '%/HEAD') WHERE k = 1""",
    "resume_repos": _with(
        VERSIONS, _latest("latest"),
        select="""SELECT 'https://git.example.com/u/repo' || c_custkey AS repo_url FROM customer
WHERE 'https://git.example.com/u/repo' || c_custkey NOT IN (SELECT repo_url FROM latest WHERE total_loc > 0)""",
    ),
    "snapshot_diag": _with(
        *FILE_CTES,
        """exts AS (SELECT repo_url, path, size, CASE WHEN regexp_extract(path, '(\\.[^./]*)$', 1) = ''
    THEN '<noext>' ELSE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) END AS ext FROM tagged),
ext_counts AS (SELECT repo_url, ext, count(*) AS n FROM exts GROUP BY ALL),
top_ext AS (SELECT repo_url, string_agg(ext || ':' || n, ', ' ORDER BY k) AS extensions FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY n DESC, ext) AS k FROM ext_counts)
  WHERE k <= 8 GROUP BY repo_url),
top_paths AS (SELECT repo_url, string_agg(path, ',' ORDER BY path) AS sample_paths FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY path) AS k FROM exts)
  WHERE k <= 15 GROUP BY repo_url)""",
        select="""SELECT repo_url, count(*) AS file_count, CAST(sum(size) // 1024 AS BIGINT) AS total_kb,
  any_value(extensions) AS extensions, any_value(sample_paths) AS sample_paths, FALSE AS is_empty
FROM exts JOIN top_ext USING (repo_url) JOIN top_paths USING (repo_url) GROUP BY repo_url""",
    ),
    "tree_files": _with(DOCS, select="SELECT repo_url, count(*) AS file_count FROM docs GROUP BY repo_url"),
    "lang_profile": _with(
        *PROFILE_CTES,
        select="""SELECT repo_url, string_agg(language || '=' || n, ';' ORDER BY language || '=' || n) AS counts,
  any_value(total) AS total, arg_min(language, rn) AS "primary", any_value(code_primary) AS code_primary,
  'walk' AS source
FROM ranked LEFT JOIN focus USING (repo_url) GROUP BY repo_url""",
    ),
    "lang_distribution": _with(
        *PROFILE_CTES,
        select=f"""SELECT repo_url, string_agg('- ' || language || ': ' || printf('%.1f%%', n / total * 100),
  {LF} ORDER BY rn) AS distribution FROM ranked WHERE rn <= 8 OR n / total >= 0.01 GROUP BY repo_url""",
    ),
    "lang_shares": _with(
        *PROFILE_CTES,
        select=f"SELECT repo_url, language, {_r4('n / total')} AS share FROM ranked",
    ),
    "file_lines": _with(*FILE_CTES, FILE_LINES, select="SELECT * FROM file_lines"),
    "file_loc": _with(*FILE_CTES, LINES, select="SELECT * FROM loc"),
    "commit_minhash": f"""SELECT repo_url, {_SIGNATURE} AS commit_minhash FROM (
  SELECT {_ORDER_REPO} AS repo_url,
    CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS UBIGINT) AS v FROM orders)
GROUP BY repo_url""",
    "repo_identity": _with(
        COMMITS, IDENTITY,
        select="""SELECT *, regexp_extract(repo_url, '^https://[^/]+/(.*)/[^/]*$', 1) AS repo_org,
  regexp_extract(repo_url, '([^/]*)\\.git$', 1) AS repo_name FROM identity""",
    ),
    "line_ranges": _with(
        *FILE_CTES, LINES, REQUESTS,
        select="""SELECT repo_url, seq, norm_path, CAST(first_line AS BIGINT) AS first_line,
  CAST(last_line AS BIGINT) AS last_line, is_partial, loc, coalesce(missing, flaw) AS flaw FROM checked""",
    ),
    "budget_select": _with(
        *FOLD_CTES, recursive=True,
        select="""SELECT repo_url, seq, path, saved, reason, CASE WHEN saved THEN loc END AS loc,
  CASE WHEN saved THEN is_partial END AS is_partial, CAST(rank AS BIGINT) AS rank,
  CASE WHEN saved THEN total END AS running_total FROM outcome""",
    ),
    "running_share": _with(
        *FOLD_CTES, recursive=True,
        select=f"""SELECT repo_url, CAST(rank AS BIGINT) AS rank, path, loc, total AS running_total,
  CAST(greatest(0, {_T} - total) AS BIGINT) AS remaining,
  floor(sum(CASE WHEN layer IN {_in(LOGIC_LAYERS)} THEN loc ELSE 0 END) OVER w / total * 100) / 100
    AS logic_share,
  CASE WHEN primary_language IS NOT NULL THEN
    floor(sum(CASE WHEN language = primary_language THEN loc ELSE 0 END) OVER w / total * 100) / 100 END
    AS primary_share
FROM saved WINDOW w AS (PARTITION BY repo_url ORDER BY rank)""",
    ),
    "sample_texts": _with(
        *FOLD_CTES, recursive=True,
        select=f"""SELECT s.repo_url, CAST(s.rank AS BIGINT) AS rank, s.path, CASE WHEN s.is_partial THEN
  array_to_string(string_split(f.content, {LF})[s.first_line + 1 : s.last_line], {LF})
    || CASE WHEN s.last_line < s.total_lines OR ends_with(f.content, {LF}) THEN {LF} ELSE '' END
  ELSE f.content END AS text
FROM saved s JOIN files f ON f.repo_url = s.repo_url AND f.path = s.norm_path""",
    ),
    "sample_manifest": _rollup(
        f"""SELECT repo_url, total_loc, file_count, {_r4('test_loc / total_loc')} AS test_share,
  {_r4('logic_loc / total_loc')} AS logic_share, {_r4('low_loc / total_loc')} AS low_value_share,
  {_r4('primary_loc / total_loc')} AS primary_share, sample_lang_loc, files
FROM rollup_rows JOIN lang_text USING (repo_url)"""
    ),
    "main_language": _rollup(
        """SELECT repo_url, coalesce(main_language, '') AS main_language, primary_language AS "primary"
FROM rollup_rows LEFT JOIN main_lang USING (repo_url)"""
    ),
    "layer_breakdown": _rollup("SELECT repo_url, breakdown FROM breakdowns"),
    "repo_summary": _rollup(
        f"""SELECT repo_url, CASE WHEN main_language IS NULL THEN '' ELSE '**Main language:** ' || main_language
  || chr(10) || chr(10) END || {_SUMMARY} AS repo_summary
FROM rollup_rows JOIN breakdowns USING (repo_url) LEFT JOIN main_lang USING (repo_url)"""
    ),
    "manifest_flat": _rollup(
        f"""SELECT repo_url, regexp_extract(repo_url, '[^/]*$') AS repo_name,
  coalesce(primary_language, '') AS language, total_loc, file_count,
  {_r4('test_loc / total_loc')} AS test_share, first_path, 'walk' AS stats_source, 'unknown' AS commit_sha
FROM rollup_rows"""
    ),
    "manifest_latest": _with(VERSIONS, _latest("latest"), select="SELECT * FROM latest"),
    "manifest_upsert": _with(
        VERSIONS, _latest("cur", "event_id % 2 = 0"), _latest("fresh", "event_id % 2 = 1"),
        select="""SELECT * FROM cur WHERE repo_url NOT IN (SELECT repo_url FROM fresh)
UNION ALL SELECT * FROM fresh""",
    ),
    "manifest_remove": _with(
        VERSIONS, _latest("latest"), select="SELECT repo_url, total_loc FROM latest WHERE total_loc <> 0"
    ),
    "result_validation": f"""SELECT repo_url,
  CASE WHEN total_loc = 0 THEN 'agent_empty' WHEN low THEN 'agent_no_primary_lang' END AS stage,
  CASE WHEN total_loc = 0 THEN 'agent saved 0 LOC' WHEN low THEN 'primary language ''' || lang || ''': '
    || part || ' LOC (' || CAST(floor(part / total_loc * 100) AS BIGINT) || '%) below the 20% minimum' END
    AS error
FROM (SELECT *, forced AND lang IS NOT NULL AND total_loc > 0 AND part / total_loc < 0.2 AS low FROM (
  SELECT 'https://git.example.com/u/repo' || c_custkey AS repo_url,
    CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey % 6000 + 1 END AS total_loc,
    CASE WHEN c_custkey % 5 <> 0 THEN {_pick(('PHP', 'Go', 'JavaScript'), 'c_custkey')} END AS lang,
    CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE
      CAST(floor((c_custkey % 6000 + 1) * (c_custkey % 10) / 10) AS BIGINT) END AS part,
    c_custkey % 2 = 0 AS forced FROM customer))""",
    "redacted_documents": _with(
        TEXTS, REDACTED, select="SELECT folder, path, redacted FROM redacted", recursive=True,
    ),
    "audit_files": _with(
        TEXTS, REDACTED, _change_ctes(_REDACTED_PAIRS), select="SELECT * FROM changes", recursive=True,
    ),
    "audit_report": _with(
        TEXTS, REDACTED, _change_ctes(_REDACTED_PAIRS), recursive=True,
        select="""SELECT f.folder, count(c.path) AS files_changed,
  CAST(coalesce(sum(hunks), 0) AS BIGINT) AS total_hunks,
  CAST(coalesce(sum(additions), 0) AS BIGINT) AS total_additions,
  CAST(coalesce(sum(deletions), 0) AS BIGINT) AS total_deletions
FROM (SELECT DISTINCT folder FROM redacted) f LEFT JOIN changes c USING (folder) GROUP BY f.folder""",
    ),
    "audit_lines": _with(DOCS, FILES, EDITED, _change_ctes(_EDITED_PAIRS), select="SELECT * FROM changed", recursive=True),
    "audit_hunks": _with(DOCS, FILES, EDITED, _change_ctes(_EDITED_PAIRS), select="SELECT * FROM changes", recursive=True),
    "sample_index": _with(
        VERSIONS, _latest("latest"), COMMITS, IDENTITY,
        select="""SELECT l.folder, coalesce(i.repo_name, '') AS repo_name, coalesce(i.repo_org, '') AS repo_org,
  coalesce(i.repo_url, '') AS repo_url, coalesce(first_commit_hash, '') AS first_commit_hash,
  coalesce(early_commit_hashes, '') AS early_commit_hashes, CAST(total_loc AS VARCHAR) AS sample_loc,
  CAST(file_count AS VARCHAR) AS sample_files,
  sampled_at,
  coalesce(head_commit_sha, '') AS head_commit_sha, '0.1.0' AS sampler_version
FROM (SELECT *, replace(replace(repo_url, 'https://', ''), '/', '__') AS folder FROM latest) l
LEFT JOIN (SELECT *, 'git.example.com__u__' || regexp_extract(repo_url, '(repo[0-9]+)', 1) AS folder,
    regexp_extract(repo_url, '^https://[^/]+/(.*)/[^/]*$', 1) AS repo_org,
    regexp_extract(repo_url, '([^/]*)\\.git$', 1) AS repo_name FROM identity) i ON i.folder = l.folder""",
    ),
    "index_problems": _with(
        VERSIONS,
        """folders AS (SELECT language || '-' || total_loc AS folder, count(*) AS n FROM versions GROUP BY 1),
have AS (SELECT DISTINCT event_type || '-' || (event_id % 60) AS folder FROM events)""",
        select="""SELECT folder, 'duplicate_folder' AS problem FROM folders WHERE n > 1
UNION ALL SELECT folder, 'no_samples' FROM folders WHERE folder NOT IN (SELECT folder FROM have)
UNION ALL SELECT folder, 'no_summary' FROM folders WHERE folder NOT IN (SELECT folder FROM have)""",
    ),
    "bundle_listing": _with(
        DOCS,
        select="""SELECT source AS folder, CASE WHEN path LIKE 'tests/%' THEN 0 ELSE 1 END AS section,
  'samples/' || source || '/' || CASE WHEN path LIKE 'src/%' THEN 'samples/' || path ELSE 'repo_summary.md' END
    AS entry_path, length(text) AS size
FROM docs WHERE path LIKE 'src/%' OR path LIKE 'tests/%'""",
    ),
    "transcript_compact": _with(
        MESSAGES,
        select="""SELECT run_id, pos, role, CASE
  WHEN role = 'tool' AND k > 2 AND length(content) > 300 THEN substr(content, 1, 150) || chr(10) || '[truncated]'
  WHEN role = 'assistant' AND k > 3 AND content <> '' THEN NULL ELSE content END AS content
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, role ORDER BY pos DESC) AS k FROM messages)""",
    ),
    "transcript_render": f"""SELECT conv_id AS run_id, CAST(0 AS BIGINT) AS part,
  {_text(_INTRO)} || chr(10) || '- bash: run a command' || chr(10) || '  parameters: {{}}' || chr(10)
  || {_text(_CONVERSATION)} || chr(10)
  || string_agg(CASE WHEN role = 'user' THEN '[tool result for call_' || turn || ']' || chr(10) || text
      ELSE '[' || role || ']' || chr(10) || text || CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN
        chr(10) || '[assistant tool call call_' || turn || '] save_sample({{"path": "f' || turn || '.py"}})'
        ELSE '' END END, chr(10) ORDER BY turn)
  || chr(10) || {_text(_CLOSING)} AS prompt
FROM conversations GROUP BY conv_id""",
    "turn_validate": _with(
        TURNS,
        select="""SELECT turn_id, reason, CASE WHEN reason IS NULL THEN content END AS content,
  CASE WHEN reason IS NULL THEN tool_calls END AS tool_calls,
  CASE WHEN reason IS NULL THEN CASE WHEN tool_calls <> '' THEN 'tool_calls' ELSE 'stop' END END AS finish_reason
FROM judged""",
    ),
    "error_classes": _with(
        ERRORS,
        select=f"""SELECT stage, {_CLASS} AS error_class, count(*) AS n, count(DISTINCT repo_url) AS repos
FROM errors GROUP BY ALL""",
    ),
}

# --- run logs ---------------------------------------------------------------------

_R = a.RUN_BUDGET
_LANGS = ("PHP", "Go", "JavaScript")
RUN_TURNS = f"""ev AS (
  SELECT l_orderkey % 500 AS run_id, (l_partkey + l_linenumber) % 50 AS turn, l_suppkey % 9 = 0 AS saved,
    CASE WHEN l_suppkey % 9 = 0 THEN l_partkey % 90 + 10 ELSE 0 END AS loc,
    {_pick(LAYERS, 'l_partkey')} AS layer, {_pick(_LANGS, 'l_suppkey + l_orderkey % 500')} AS language
  FROM lineitem),
goals AS (
  SELECT run_id, CASE WHEN run_id % 4 <> 0 THEN {_pick(_LANGS, 'run_id')} END AS prim, run_id % 3 = 0 AS hard,
    max(turn) AS last_turn FROM ev GROUP BY run_id),
turn_sums AS (
  SELECT g.run_id, t.turn, count(*) FILTER (WHERE saved) AS files,
    CAST(coalesce(sum(loc) FILTER (WHERE saved), 0) AS BIGINT) AS loc,
    CAST(coalesce(sum(loc) FILTER (WHERE saved AND layer IN {_in(LOGIC_LAYERS)}), 0) AS BIGINT) AS logic,
    CAST(coalesce(sum(loc) FILTER (WHERE saved AND language = prim), 0) AS BIGINT) AS ploc
  FROM goals g JOIN range(0, 50) t(turn) ON t.turn <= g.last_turn
  LEFT JOIN ev e ON e.run_id = g.run_id AND e.turn = t.turn GROUP BY ALL),
walk AS (
  SELECT run_id, CAST(-1 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS l,
    CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS p, CAST(-1 AS BIGINT) AS ls, CAST(-10 AS BIGINT) AS lp,
    CAST(-10 AS BIGINT) AS lg, CAST('' AS VARCHAR) AS flag FROM goals
  UNION ALL
  SELECT run_id, turn, n + files, l + loc, q + logic, p + ploc,
    CASE WHEN files > 0 THEN turn ELSE ls END,
    CASE flag WHEN 'LANGUAGE' THEN turn WHEN 'SILENCED' THEN 50 ELSE lp END,
    CASE flag WHEN 'LOGIC_LOW' THEN turn ELSE lg END, flag
  FROM (
    SELECT w.run_id, s.turn, w.n, w.l, w.q, w.p, w.ls, w.lp, w.lg, s.files, s.loc, s.logic, s.ploc,
      CASE
        WHEN w.n = 0 AND s.turn >= 3 THEN 'URGENT'
        WHEN prim IS NOT NULL AND w.l >= {_R.target_loc // 2}
          AND (hard OR w.l < {_R.target_loc + _R.tolerance_loc})
          AND w.p < CAST(0.2 AS DOUBLE) * w.l AND s.turn - w.lp >= 3 THEN
          CASE WHEN greatest(1, ceil((CAST(0.2 AS DOUBLE) * w.l - w.p) / CAST(0.8 AS DOUBLE)))
              > {_R.cap_loc} - w.l THEN CASE WHEN hard THEN 'ABORT' ELSE 'SILENCED' END
            ELSE 'LANGUAGE' END
        WHEN w.l >= {_R.target_loc + _R.tolerance_loc}
          AND NOT (hard AND prim IS NOT NULL AND w.p < CAST(0.2 AS DOUBLE) * w.l) THEN 'STOP'
        WHEN w.n > 0 AND s.turn - (w.ls + 1) >= 4 AND w.l < {_R.target_loc} THEN 'STALLED'
        WHEN s.turn >= 45 AND w.l < {_R.target_loc - _R.tolerance_loc} THEN 'LAST_ITERS'
        WHEN w.l >= {_R.target_loc // 2} AND w.l < {_R.target_loc + _R.tolerance_loc}
          AND w.q < CAST(0.6 AS DOUBLE) * w.l AND s.turn - w.lg >= 4 THEN 'LOGIC_LOW'
        ELSE '' END AS flag
    FROM walk w JOIN turn_sums s ON s.run_id = w.run_id AND s.turn = w.turn + 1
    JOIN goals g ON g.run_id = w.run_id WHERE w.flag <> 'ABORT'))"""

SQL["progress_flags"] = _with(
    RUN_TURNS, recursive=True,
    select="SELECT run_id, turn, flag FROM walk WHERE turn >= 0 AND flag NOT IN ('', 'SILENCED')",
)

SQL["run_statistics"] = """WITH ev AS (
  SELECT l_orderkey % 5000 AS run_id, l_partkey % 50 AS turn,
    ['bash', 'save_sample', 'write_summary'][l_linenumber % 3 + 1] AS tool,
    l_linenumber % 3 = 1 AND l_suppkey % 5 = 0 AS saved, l_partkey % 90 AS loc,
    CASE WHEN l_partkey % 4 = 0 THEN 'note ' || (l_partkey % 50) END AS prose
  FROM lineitem)
SELECT run_id, count(DISTINCT turn) AS turns, count(*) FILTER (WHERE tool = 'save_sample') AS save_attempts,
  count(*) FILTER (WHERE tool = 'bash') AS shell_calls, count(*) FILTER (WHERE saved) AS files_saved,
  CAST(coalesce(sum(loc) FILTER (WHERE saved), 0) AS BIGINT) AS total_loc,
  CASE WHEN coalesce(sum(loc) FILTER (WHERE saved), 0) = 0 THEN
    max_by(prose, turn) FILTER (WHERE prose IS NOT NULL) END AS last_prose
FROM ev GROUP BY run_id"""

SQL["run_totals"] = _with(
    ERRORS,
    """res AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey % 6000 + 1 END AS total_loc FROM customer),
shown AS (SELECT * FROM errors ORDER BY ts, repo_url LIMIT 3)""",
    select="""SELECT count(*) FILTER (WHERE total_loc > 0) AS processed, count(*) AS repositories,
  (SELECT count(*) FROM errors) AS errors, CAST(sum(total_loc) AS BIGINT) AS total_loc,
  (SELECT string_agg(substr(error, 1, 200), ' | ' ORDER BY ts, repo_url) FROM shown) AS first_errors
FROM res""",
)

_RUNS = """runs AS (
  SELECT 'folder' || o_orderkey AS folder, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN o_orderkey % 4 < 2 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS cost,
    CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey ELSE 0 END AS tokens_in FROM orders)"""
SQL["usage_costs"] = _with(_RUNS, select="SELECT folder, cost, tokens_in FROM runs")
SQL["redaction_totals"] = _with(
    _RUNS,
    select="""SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS errors,
  count(*) AS folders, coalesce(sum(cost) FILTER (WHERE status = 'ok'), 0.0) AS total_cost FROM runs""",
)

# --- files chosen by rule -----------------------------------------------------------

DENSE_FLOW = "0.15"
# Occurrences are counted by the pieces that a text falls into.
_FLOW = " + ".join(
    f"(len(string_split(content, {_text(mark)})) - 1)"
    for mark in ("while ", "while(", "for ", "for(", "if ", "if(", "except", "catch", "switch")
)
_UNDER = "regexp_matches(lower(t.path), '(^|/)({})/')"
_NAMED = "regexp_matches(lower(t.path), '{}$')"
_PLACES = (
    ("test", (_UNDER.format("test|tests|spec|__tests__"), _NAMED.format("(^|/)test_[^/]*"), _NAMED.format("[-._](spec|test)\\.[^/]*"))),
    ("autogen", (
        _UNDER.format("migrations|generated|gen"), _NAMED.format("\\.(min|pb)\\.[a-z]+"), _NAMED.format("_pb2\\.py"),
        _NAMED.format("[-.]lock(\\.[a-z]+)?"))),
    ("infra", (
        _UNDER.format("terraform|scripts|infra|docker|deploy|ci|\\.github"), _NAMED.format("(^|/)(makefile|dockerfile)"),
        _NAMED.format("\\.(sh|bash|bat|ps1|tf|hcl|cmake|gradle)"))),
    ("data", (_UNDER.format("etl|repositories|queries|dao"), _NAMED.format("\\.sql"))),
    ("api", (_UNDER.format("endpoint|endpoints|handler|handlers|controller|controllers|route|routes|api"),)),
    ("boilerplate", (
        _UNDER.format("constants|models|dto|config"), _NAMED.format("(^|/)(constants|settings|__init__)\\.[a-z]+"))),
    ("util", (_UNDER.format("shared|common|helper|helpers|util|utils"),)),
    ("algorithm", (_UNDER.format("parser|algorithm|algorithms|engine|core"),)),
)
_SECRETS = "(" + " OR ".join(f"regexp_matches(content, '{pattern}')" for pattern, _, _ in _REDACT_STEPS[:4]) + ")"
_GENERATED = "regexp_matches(lower(content), '@generated|auto-?generated|do not edit')"
_RULE_CASES = " ".join(f"WHEN {' OR '.join(tests)} THEN {_text(layer)}" for layer, tests in _PLACES)
FEATURES = f"""features AS (
  SELECT t.repo_url, t.path, t.language, l.loc, l.total_lines, CAST(round({_FLOW}) AS BIGINT) AS flow_marks,
    {_GENERATED} AS is_generated, {_SECRETS} AS has_secret,
    CASE WHEN {_GENERATED} THEN 'autogen' {_RULE_CASES}
      WHEN t.language IN {_in(lang.NON_CODE_LANGUAGES)} THEN 'boilerplate'
      WHEN round({_FLOW}) >= CAST({DENSE_FLOW} AS DOUBLE) * greatest(l.loc, 1) THEN 'business'
      ELSE 'util' END AS layer
  FROM tagged t JOIN loc l ON l.repo_url = t.repo_url AND l.path = t.path
  WHERE t.size > 0 AND t.size <= 20971520 AND t.language <> ''
    AND NOT list_has_any(string_split(t.path, '/')[:-2],
      ['node_modules', 'vendor', 'dist', 'build', 'bower_components', '.git']))"""
SQL["layer_tags"] = _with(
    *FILE_CTES, LINES, FEATURES,
    select="SELECT repo_url, path, loc, flow_marks, is_generated, has_secret, layer FROM features",
)

_P = a.CANDIDATES
CANDIDATES = f"""fit AS (
  SELECT f.repo_url, f.path, f.layer, f.language, f.layer = 'test' AS is_test,
    CASE WHEN contains(f.path, '/') THEN split_part(f.path, '/', 1) ELSE '' END AS module,
    f.loc > {_P.partial_above_loc} AS is_long,
    CASE WHEN f.loc > {_P.partial_above_loc} THEN (SELECT count(*) FROM marked m
      WHERE m.repo_url = f.repo_url AND m.path = f.path AND m.is_code AND m.i <= {_P.preferred_max_loc})
      ELSE f.loc END AS loc,
    coalesce(f.language <> focus.code_primary, FALSE) AS off_focus,
    f.layer NOT IN {_in(LOGIC_LAYERS)} AS off_logic
  FROM features f LEFT JOIN focus USING (repo_url)
  WHERE f.language NOT IN {_in(lang.NON_CODE_LANGUAGES)} AND NOT is_generated AND NOT has_secret
    AND f.layer <> 'autogen'),
sized AS (
  SELECT *, NOT (loc BETWEEN {_P.preferred_min_loc} AND {_P.preferred_max_loc}) AS off_size
  FROM fit WHERE loc >= {_P.min_loc} AND loc <= {_C}),
rounds AS (
  SELECT *, row_number() OVER (PARTITION BY repo_url, is_test, module
    ORDER BY off_focus, off_logic, off_size, path) AS round FROM sized),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY repo_url, is_test ORDER BY round, module, path) AS nth FROM rounds),
wanted AS (
  SELECT repo_url, CAST(CASE WHEN is_test THEN nth * 6 ELSE nth + (nth - 1) // 5 END AS BIGINT) AS seq, path,
    layer, CAST(CASE WHEN is_long THEN 1 END AS INTEGER) AS start_line,
    CAST(CASE WHEN is_long THEN {_P.preferred_max_loc} END AS INTEGER) AS end_line, loc, language
  FROM numbered)"""
SQL["candidate_order"] = _with(
    *PROFILE_CTES, LINES, FEATURES, CANDIDATES,
    select="SELECT repo_url, seq, path, layer, start_line, end_line FROM wanted",
)

_BUDGET = a.BUDGET
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _picked(n: str, goals: str, room: str) -> str:
    """CTEs ``n``_*: the files that the goals of each repository and kind choose.

    The level of the water is the highest of (goal less the shallower vessels) / (widths of the others).
    """
    return f"""{n}_left AS (
  SELECT w.*, goal, goal - coalesce(sum(lines) OVER (o {_BEFORE}), 0) AS remaining,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS width
  FROM weighed w JOIN {goals} USING (repo_url, kind)
  WINDOW o AS (PARTITION BY repo_url, kind ORDER BY lines / weight, language)),
{n}_level AS (
  SELECT repo_url, kind, arg_max({{'a': remaining, 'b': width}}, remaining / width) AS lev FROM {n}_left GROUP BY ALL),
{n}_base AS (
  SELECT *, least(lines, lev.a * weight // lev.b) AS base,
    CASE WHEN lines * lev.b <= lev.a * weight THEN -1 ELSE lev.a * weight % lev.b END AS part
  FROM {n}_left JOIN {n}_level USING (repo_url, kind)),
{n}_quota AS (
  SELECT repo_url, kind, language, base + CASE WHEN part >= 0 AND
    row_number() OVER (PARTITION BY repo_url, kind ORDER BY part DESC, language)
      <= goal - sum(base) OVER (PARTITION BY repo_url, kind) THEN 1 ELSE 0 END AS quota FROM {n}_base),
{n}_first AS (
  SELECT * EXCLUDE (quota, ahead) FROM (
    SELECT s.*, quota, coalesce(sum(loc) OVER (PARTITION BY repo_url, kind, language ORDER BY seq {_BEFORE}), 0) AS ahead
    FROM sorted s JOIN {n}_quota USING (repo_url, kind, language) WHERE loc <= quota)
  WHERE ahead + loc <= quota),
{n}_gap AS (
  SELECT g.repo_url, g.kind, any_value(goal) AS goal, coalesce(sum(loc), 0) AS taken
  FROM {goals} g LEFT JOIN {n}_first f ON f.repo_url = g.repo_url AND f.kind = g.kind GROUP BY ALL),
{n}_second AS (
  SELECT * EXCLUDE (wanting, room, ahead) FROM (
    SELECT s.*, goal - taken AS wanting, {room} - taken AS room,
      coalesce(sum(loc) OVER (PARTITION BY repo_url, kind ORDER BY seq {_BEFORE}), 0) AS ahead
    FROM sorted s ANTI JOIN {n}_first USING (repo_url, seq) JOIN {n}_gap USING (repo_url, kind)
    WHERE goal > taken AND loc <= {room} - taken)
  WHERE ahead < wanting AND ahead + loc <= room),
{n}_files AS (SELECT * FROM {n}_first UNION ALL SELECT * FROM {n}_second)"""


# Tests 10 to 20 % of the lines (15 % where code abounds), low value at most 20 %: a quarter of the ordinary code.
STEERED = f"""sorted AS (
  SELECT *, CASE WHEN layer = 'test' THEN 'test' WHEN layer IN ('boilerplate', 'infra', 'autogen') THEN 'low'
    ELSE 'main' END AS kind FROM wanted WHERE loc > 0),
strata AS (SELECT repo_url, kind, language, CAST(sum(loc) AS BIGINT) AS lines FROM sorted GROUP BY ALL),
weighed AS (SELECT *, sum(lines) OVER (PARTITION BY repo_url, language) AS weight FROM strata),
offers AS (
  SELECT repo_url, coalesce(sum(lines) FILTER (kind = 'main'), 0) AS main,
    coalesce(sum(lines) FILTER (kind = 'test'), 0) AS tests, coalesce(sum(lines) FILTER (kind = 'low'), 0) AS low
  FROM strata GROUP BY ALL),
main_goals AS (
  SELECT repo_url, 'main' AS kind, least(main, {_BUDGET.target_loc} - least(tests, {_BUDGET.target_loc * 15 // 100})) AS goal
  FROM offers),
{_picked('main', 'main_goals', str(_C))},
sums AS (
  SELECT o.*, coalesce((SELECT sum(loc) FROM main_files m WHERE m.repo_url = o.repo_url), 0) AS done FROM offers o),
test_lines AS (
  SELECT *, CASE WHEN done = 0 THEN least(tests, {_BUDGET.target_loc}) ELSE greatest(0, least(tests,
    greatest({_BUDGET.target_loc} - done, done * 3 // 17), done // 4, {_C} - done)) END AS t FROM sums),
side_goals AS (
  SELECT repo_url, 'test' AS kind, t AS goal FROM test_lines WHERE t > 0
  UNION ALL
  SELECT repo_url, 'low', g FROM (SELECT repo_url, CASE WHEN done = 0 THEN least(low, {_BUDGET.target_loc} - t)
    ELSE least(low, {_BUDGET.target_loc} - done - t, done // 4) END AS g FROM test_lines) WHERE g > 0),
{_picked('side', 'side_goals', 'goal')},
steered AS (SELECT * FROM main_files UNION ALL SELECT * FROM side_files)"""
SQL["steered_order"] = _with(
    *PROFILE_CTES, LINES, FEATURES, CANDIDATES, STEERED,
    select="SELECT repo_url, seq, path, layer, language, CAST(loc AS BIGINT) AS loc, start_line, end_line FROM steered",
)
SQL["steered_corpus"] = _with(
    *PROFILE_CTES, LINES, FEATURES, CANDIDATES, STEERED,
    select="""SELECT repo_url, coalesce(any_value(code_primary), '') AS language, CAST(sum(loc) AS BIGINT) AS total_loc,
  count(*) AS file_count, CAST(coalesce(sum(loc) FILTER (kind = 'test'), 0) AS BIGINT) AS test_loc,
  CAST(coalesce(sum(loc) FILTER (kind = 'low'), 0) AS BIGINT) AS low_value_loc,
  string_agg(path, ';' ORDER BY seq) AS paths
FROM steered LEFT JOIN focus USING (repo_url) GROUP BY repo_url""",
)

SAMPLED_CTES = (
    *PROFILE_CTES, LINES, FEATURES, CANDIDATES,
    f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY seq) AS rn FROM wanted),
fold AS (
  SELECT DISTINCT repo_url, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS files,
    CAST('' AS VARCHAR) AS paths FROM ordered
  UNION ALL
  SELECT o.repo_url, o.rn, CASE WHEN f.total + o.loc <= {_C} THEN f.total + o.loc ELSE f.total END,
    CASE WHEN f.total + o.loc <= {_C} THEN f.files + 1 ELSE f.files END,
    CASE WHEN f.total + o.loc <= {_C} THEN f.paths || CASE WHEN f.paths = '' THEN '' ELSE ';' END || o.path
      ELSE f.paths END
  FROM fold f JOIN ordered o ON o.repo_url = f.repo_url AND o.rn = f.rn + 1),
done AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY rn DESC) = 1)""",
)
_FOLDER = "replace(regexp_replace(replace(d.repo_url, 'https://', ''), '\\.git$', ''), '/', '__')"
SQL["sampled_corpus"] = _with(
    *SAMPLED_CTES,
    recursive=True,
    select=f"""SELECT repo_url, {_FOLDER} AS folder_name, coalesce(code_primary, '') AS language, total AS total_loc,
  files AS file_count, paths
FROM done d LEFT JOIN focus USING (repo_url) WHERE total > 0""",
)
_FIRST = f"string_split(content, {LF})[1:{_P.preferred_max_loc}]"
SQL["delivered_corpus"] = _with(
    *SAMPLED_CTES,
    f"""picked AS (
  SELECT {_FOLDER} AS source, 'samples/' || f.path AS path,
    CASE WHEN w.start_line IS NULL THEN content ELSE array_to_string({_FIRST}, {LF})
      || CASE WHEN len(string_split(content, {LF})) > {_P.preferred_max_loc} THEN {LF} ELSE '' END END AS text
  FROM done d JOIN wanted w ON w.repo_url = d.repo_url AND list_contains(string_split(d.paths, ';'), w.path)
    JOIN files f ON f.repo_url = w.repo_url AND f.path = w.path WHERE d.total > 0)""",
    REDACTED.replace("FROM docs", "FROM picked"),
    recursive=True,
    select="SELECT folder, path, redacted AS text FROM redacted",
)

# --- further checks -----------------------------------------------------------------

SQL["history_of_heads"] = """WITH RECURSIVE graph AS (
  SELECT 'https://git.example.com/g/repo' || (o_orderkey % 20) AS repo_url, o_orderkey AS k,
    list_filter([CASE WHEN o_orderkey % 501 <> 0 THEN o_orderkey - 20 ELSE o_orderkey - 40 END,
      CASE WHEN o_orderkey % 997 = 0 THEN o_orderkey - 60 END], lambda p: p >= 0) AS parents
  FROM orders),
reach AS (
  SELECT repo_url, max(k) AS k FROM graph WHERE k % 3 = 0 GROUP BY repo_url
  UNION SELECT g.repo_url, unnest(g.parents) FROM reach r JOIN graph g ON g.repo_url = r.repo_url AND g.k = r.k)
SELECT g.repo_url, CAST(g.k AS VARCHAR) AS sha, r.k IS NOT NULL AS on_head
FROM graph g LEFT JOIN reach r ON r.repo_url = g.repo_url AND r.k = g.k"""

SQL["redaction_resume"] = """SELECT 'd' || doc_id AS folder FROM documents
WHERE doc_id <> 7 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)"""

SQL["deliverable_split"] = _with(
    DOCS,
    select="""SELECT source AS folder, regexp_replace(path, '^src/', 'samples/') AS path,
  split_part(regexp_replace(path, '^src/', 'samples/'), '/', 1) IN ('samples', 'repo_summary.md') AS ships
FROM docs""",
)

SQL["sample_display"] = _with(
    *FOLD_CTES, recursive=True,
    select="""SELECT repo_url, CAST(rank AS BIGINT) AS rank, path, layer,
  CASE WHEN language = '' THEN '-' ELSE language END AS language, loc,
  CASE WHEN is_partial THEN 'yes' ELSE 'no' END AS partial FROM saved""",
)

SQL["identity_gaps"] = """SELECT DISTINCT 'repo' || c_custkey AS folder FROM customer
WHERE 'repo' || c_custkey NOT IN (SELECT 'repo' || (o_custkey % 200) FROM orders)"""

SQL["error_previews"] = f"""WITH raw AS (
  SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN
    regexp_replace(html, '<(p|li)>', chr(10) || 'ERROR: ', 'g') || chr(10) || 'end' ELSE html END AS stderr
  FROM pages),
lines AS (
  SELECT *, regexp_split_to_array(regexp_replace(stderr, '({_BREAKS})$', ''), '{_BREAKS}') AS all_lines FROM raw),
picked AS (
  SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '^\\s*ERROR:')) AS errs,
    regexp_replace(trim(regexp_replace(html, '{_SPACE}', ' ', 'g')), '^ ', '') AS flat FROM lines)
SELECT page_id, array_to_string(CASE WHEN len(errs) > 0 THEN errs ELSE all_lines[-5:] END, chr(10)) AS errors,
  CASE WHEN length(flat) <= 200 THEN flat ELSE substr(flat, 1, 200) || '...' END AS short
FROM picked"""

_TREES = """trees AS (
  SELECT source AS folder, encode(CASE WHEN doc_id % 7 = 1 THEN '' ELSE text END) AS content,
    CASE doc_id % 7 WHEN 0 THEN '.github/' || doc_id || '.yml' WHEN 1 THEN 'pkg' || doc_id || '/__init__.py'
      WHEN 2 THEN '.git/objects/' || doc_id ELSE path END AS path
  FROM docs)"""
SQL["working_tree_files"] = _with(
    DOCS, _TREES,
    select="SELECT folder, path, octet_length(content)::BIGINT AS size, sha256(content) AS sha256 FROM trees",
)
SQL["tree_listing"] = _with(
    DOCS, _TREES,
    """seen AS (
  SELECT *, octet_length(content)::BIGINT AS size, octet_length(content) BETWEEN 1 AND 20971520
    AND NOT list_has_any(string_split(path, '/')[:-2],
      ['node_modules', 'vendor', 'dist', 'build', 'bower_components', '.git']) AS wanted FROM trees)""",
    select="""SELECT folder AS repo_url, count(*) AS file_count, count(*) FILTER (starts_with(path, '.git/')) AS git_files,
  count(*) FILTER (wanted) AS scanned, max(size) FILTER (wanted) AS largest FROM seen GROUP BY folder""",
)

SQL["redaction_twice"] = _with(
    DOCS, select="SELECT source AS folder, count(*) AS files, 0::BIGINT AS changed_again FROM docs GROUP BY source"
)

SQL["manifest_feed"] = SQL["manifest_latest"]
SQL["manifest_heads"] = (
    "SELECT repo_url, CASE WHEN length(repo_url) % 2 = 0 THEN left(sha256(repo_url), 7) ELSE 'unknown' END AS commit_sha FROM ("
    + SQL["manifest_flat"] + ")"
)
SQL["manifest_lines"] = _with(
    VERSIONS,
    """lines AS (
  SELECT *, '{"repo_url":"' || repo_url || '","total_loc":' || total_loc AS cut FROM versions)""",
    select="""SELECT 'record' AS kind, repo_url, total_loc, NULL::VARCHAR AS line FROM lines WHERE event_id % 50 > 2
UNION ALL SELECT 'broken', NULL, NULL, CASE WHEN event_id % 50 = 0 THEN cut ELSE '[1]' END FROM lines WHERE event_id % 50 < 2
UNION ALL SELECT 'strict', NULL, count(*), NULL FROM lines WHERE event_id % 50 = 0""",
)
SQL["error_log"] = _with(
    ERRORS, select="SELECT repo_url, stage, error, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM errors"
)
SQL["index_file"] = f"SELECT nullif(COLUMNS(*), '') FROM ({SQL['sample_index']})"
SQL["own_layers"] = _with(
    *FILE_CTES, LINES, FEATURES,
    select="""SELECT repo_url, path, CASE WHEN starts_with(path, 'src/') THEN 'business' WHEN flow_marks > loc THEN 'algorithm'
  WHEN is_generated THEN 'autogen' WHEN language = 'Go' THEN 'api' ELSE 'data' END AS layer FROM features""",
)
_LIST_LINE = r"""CASE WHEN page_id % 16 = 7 THEN ' # ' || url
    WHEN page_id % 4 = 1 THEN 'git@' || regexp_replace(url, '^https?://([^/]+)/(.*)$', '\1:\2') || '.git'
    WHEN page_id % 4 = 2 THEN url || '/' WHEN page_id % 4 = 3 THEN '# ' || url ELSE url END"""
SQL["intake_stream"] = f"""SELECT DISTINCT trim(line) AS repo_url FROM (SELECT {_LIST_LINE} AS line FROM pages)
WHERE NOT starts_with(line, '#') AND trim(line) <> '' AND trim(line) NOT IN (
  SELECT url FROM pages WHERE page_id % 3 = 0 AND page_id % 2 > 0 AND url IS NOT NULL)"""
SQL["published_delivery"] = SQL["delivered_corpus"]
SQL["audit_record"] = _with(
    TEXTS, REDACTED, _change_ctes(_REDACTED_PAIRS), recursive=True,
    select="""SELECT f.folder, '1970-01-01T00:00:00Z' AS anonymized_at, 'rules' AS model, NULL::DOUBLE AS cost_usd,
  count(c.path) AS files_changed, CAST(coalesce(sum(additions), 0) AS BIGINT) AS total_additions,
  CAST(coalesce(sum(deletions), 0) AS BIGINT) AS total_deletions, 0 AS part,
  coalesce(string_agg(c.path || ':' || hunks || ':' || additions || ':' || deletions, ';' ORDER BY c.path), '') AS changes
FROM (SELECT DISTINCT folder FROM redacted) f LEFT JOIN changes c USING (folder) GROUP BY f.folder""",
)
SQL["live_budget_stream"] = f"SELECT repo_url, seq, reason, rank, running_total FROM ({SQL['budget_select']})"
_MARKS = ", ".join(
    f"({_text(mark)}, {_text(name)})"
    for table in (lang.LANGUAGE_BY_SUFFIX, lang.NAME_ENDINGS, lang.EXACT_NAMES) for mark, name in table.items()
)
SQL["language_marks"] = f"""SELECT p.repo_url, upper(p.code_primary) AS given,
  (SELECT x FROM (SELECT unnest({_list(lang.TRACKABLE_LANGUAGES)}) AS x) WHERE lower(x) = lower(p.code_primary)) AS language,
  coalesce((SELECT string_agg(mark, ' ' ORDER BY mark) FROM (VALUES {_MARKS}) AS m(mark, name)
    WHERE lower(name) = lower(p.code_primary)), '') AS marks
FROM ({SQL['lang_profile']}) p"""
