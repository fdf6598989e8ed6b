"""SQL counterparts of the catalog queries, written for DuckDB on the same tables.

They state the expected result in another way: recursion by depth, window functions over
whole groups and string aggregation, where the Spark side uses row-local folds, joins on
unique keys and distributed totals.
"""

from __future__ import annotations

import re

from quire import constants as C
from quire.plans import catalog, corpora

NL = "chr(10)"

# --- files -------------------------------------------------------------------
VF = f"""vf AS (SELECT source AS repo, {corpora.FILE_PATH} AS path, {corpora.FILE_TEXT} AS body
 FROM documents)"""
PLAIN = """pf AS (SELECT source AS repo, concat('doc/', doc_id, '.txt') AS path, text AS body
 FROM documents)"""

BASE = "regexp_extract(path, '[^/]*$')"
SENSITIVE_NAME = (
    "regexp_matches(lower({0}), '^(\\.env|credentials?|secrets?)(\\.|$)"
    "|^id_(rsa|dsa|ecdsa|ed25519)$|\\.(pem|key)$')"
)
CONTROL = "[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]"


def binary(body: str) -> str:
    return (
        f"(contains({body}, chr(0)) OR "
        f"length(regexp_replace({body}, '[^\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))"
        f" >= (strlen({body}) * 3 + 99) // 100)"
    )


SECRETS = {
    **{
        name: f"(?s)-----BEGIN {title}-----.*-----END {title}-----"
        for name, title in (
            ("private_key", "PRIVATE KEY"), ("rsa_private_key", "RSA PRIVATE KEY"),
            ("openssh_private_key", "OPENSSH PRIVATE KEY"), ("ec_private_key", "EC PRIVATE KEY"),
            ("dsa_private_key", "DSA PRIVATE KEY"), ("pgp_private_key", "PGP PRIVATE KEY BLOCK"),
        )
    },
    "aws_akia": "(^|[^A-Z0-9])AKIA[A-Z0-9]{16}([^A-Z0-9]|\\z)",
    "aws_asia": "(^|[^A-Z0-9])ASIA[A-Z0-9]{16}([^A-Z0-9]|\\z)",
    **{
        f"github_gh{kind}":
            f"(^|[^A-Za-z0-9_-])gh{kind}_[A-Za-z0-9_-]{{30,255}}([^A-Za-z0-9_-]|\\z)"
        for kind in "pousr"
    },
    "sk_token": "(^|[^A-Za-z0-9_-])sk-[A-Za-z0-9_-]{40,255}([^A-Za-z0-9_-]|\\z)",
}
FIRST_SECRET = "CASE " + " ".join(
    f"WHEN regexp_matches(body, '{rx}') THEN '{name}'" for name, rx in SECRETS.items()
) + " END"

DECIDED = f"""decided AS (SELECT *, strlen(body) AS size,
 CASE WHEN regexp_matches(path, '(^|/)node_modules/') THEN 'ignored'
  WHEN strlen(body) > 102400 THEN 'too_large'
  WHEN NOT regexp_matches(path, '^build/keep/[^/]*\\.txt$') AND (
    regexp_matches(path, '(^|/)(\\.git|build|dist|bin|\\.venv|__pycache__)/')
    OR regexp_matches({BASE}, '^(\\.env|\\.DS_Store|.*\\.(o|a|so|exe|dll|log))$')) THEN 'ignored'
  WHEN {SENSITIVE_NAME.format(BASE)} THEN 'sensitive_name'
  WHEN body = '' THEN 'empty'
  WHEN {binary('body')} THEN 'binary'
  WHEN {FIRST_SECRET} IS NOT NULL THEN 'sensitive_content' END AS skip_reason FROM vf)"""

LANG_ROWS = ", ".join(f"('{ext}', '{lang}')" for ext, lang in {
    **C.LANGUAGE_BY_EXTENSION, **C.LANGUAGE_BY_FILE_NAME}.items())
INTERPRETER_ROWS = ", ".join(f"('{word}', '{lang}')" for word, lang in C.LANGUAGE_BY_INTERPRETER.items())
HEADER_WORD = (
    "regexp_extract(regexp_extract({0}, '^#![^\\n\\r]*'), "
    "'^#![ \\t]*(?:(?:[^ \\t]*/)?env[ \\t]+)?(?:[^ \\t]*/)?([^ \\t/]+)', 1)"
)
LANGS = f"""langs(ext, lang) AS (VALUES {LANG_ROWS}),
interpreters(word, lang) AS (VALUES {INTERPRETER_ROWS})"""

LINES = f"(length({{0}}) - length(replace({{0}}, {NL}, '')) + " \
        f"CASE WHEN {{0}} = '' OR ends_with({{0}}, {NL}) THEN 0 ELSE 1 END)"
FENCE = (
    "CASE WHEN coalesce(list_max(list_transform(regexp_extract_all({0}, '`+'), "
    "lambda r: length(r))), 0) >= 3 THEN list_max(list_transform(regexp_extract_all({0}, '`+'), "
    "lambda r: length(r))) + 1 ELSE 3 END"
)
ACCEPTED = f"""acc AS (SELECT d.repo, d.path, d.body, d.size AS n_bytes,
 CASE WHEN lower({BASE}) IN ('makefile', 'gnumakefile') THEN 'makefile'
  WHEN lower({BASE}) = 'dockerfile' THEN 'dockerfile'
  WHEN regexp_matches({BASE}, '.\\.[^.]*$') THEN l.lang ELSE i.lang END AS lang,
 {LINES.format('d.body')} AS total_lines, {FENCE.format('d.body')} AS fence_len
 FROM decided d LEFT JOIN langs l ON l.ext = lower(regexp_extract({BASE}, '[^.]*$'))
 LEFT JOIN interpreters i ON i.word = {HEADER_WORD.format('d.body')}
 WHERE d.skip_reason IS NULL)"""
FILES = f"{VF}, {DECIDED}, {LANGS}, {ACCEPTED}"


def markdown(path: str) -> str:
    out = f"regexp_replace({path}, '([\\\\`*\\[\\]])', '\\\\\\1', 'g')"
    for plain, shown in (("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("chr(10)", "'\\n'"),
                         ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("chr(7)", "'\\x07'")):
        out = f"replace({out}, {plain}, {shown})"
    return out


def lines_of(body: str) -> str:
    cut = f"CASE WHEN ends_with({body}, {NL}) THEN left({body}, length({body}) - 1) ELSE {body} END"
    return f"string_split({cut}, {NL})"


CLOSED = f"concat({{0}}, CASE WHEN ends_with({{0}}, {NL}) THEN '' ELSE {NL} END)"
NUMBERED = (
    f"array_to_string(list_transform({lines_of('{0}')}, lambda l, i: concat("
    f"lpad(cast(i AS VARCHAR), CAST(length(cast({{1}} AS VARCHAR)) AS INT), ' '), ' | ', l, {NL})), '')"
)


def block(inner: str) -> str:
    return (
        f"concat('## ', {markdown('path')}, {NL}, {NL}, repeat('`', fence_len), "
        f"coalesce(lang, ''), {NL}, {inner}, repeat('`', fence_len), {NL}, {NL}, {NL})"
    )


FULL_BLOCK = block(CLOSED.format("body"))
NUMBERED_BLOCK = block(NUMBERED.format("body", "total_lines"))


def header(mode: str, flags: str, description: str) -> str:
    return (
        f"concat('# Codebase Export', {NL}, {NL}, 'Repository: ', {markdown('repo')}, {NL}, "
        f"'Mode: {mode}', {NL}, 'Generated: {catalog.STAMP}', {flags} {NL}, {NL}, "
        f"'{description}', {NL}, {NL})"
    )


SCAN_TEXT = "Below are the source files found in the folders of this repository."

# --- tree: expects "acc(repo, path)" -----------------------------------------
TREE = """parts AS (SELECT DISTINCT repo, string_split(path, '/') AS p FROM acc),
nodes AS (SELECT repo, names, bool_or(is_dir) AS is_dir FROM (
  SELECT repo, p[1:k] AS names, k < len(p) AS is_dir
  FROM (SELECT repo, p, unnest(range(1, len(p) + 1)) AS k FROM parts)) GROUP BY repo, names),
tree AS (SELECT repo, names, is_dir, len(names) AS depth, names[len(names)] AS name,
  array_to_string(names, '/') AS node, array_to_string(names[1:len(names) - 1], '/') AS parent
  FROM nodes),
marked AS (SELECT *, row_number() OVER (PARTITION BY repo, parent
  ORDER BY CASE WHEN is_dir THEN 1 ELSE 0 END, name DESC) = 1 AS is_last FROM tree),
drawn AS (SELECT m.repo, m.node, m.depth, m.is_dir, m.name, m.is_last,
  concat(coalesce(string_agg(CASE WHEN a.is_last THEN '    ' WHEN NOT a.is_last THEN '│   ' END,
    '' ORDER BY a.depth), ''), CASE WHEN m.is_last THEN '└── ' ELSE '├── ' END, m.name) AS line
  FROM marked m LEFT JOIN marked a ON a.repo = m.repo AND a.depth < m.depth
    AND m.names[1:a.depth] = a.names
  GROUP BY m.repo, m.node, m.depth, m.is_dir, m.name, m.is_last)"""


def tree_order() -> str:
    """Print order of a node: directories first at every level."""
    return (
        "list_transform(names, lambda n, i: concat(CASE WHEN i < len(names) OR dir THEN '0' "
        "ELSE '1' END, n, chr(1)))"
    )


def artifact(block_sql: str, flags: str = "") -> str:
    """Ordered pieces of all scan artifacts."""
    head = header("recursive", flags, SCAN_TEXT)
    ticks = "repeat('`', 3)"
    return f"""repos AS (SELECT DISTINCT repo FROM vf), {TREE},
ordered AS (SELECT d.repo, d.line, array_to_string({tree_order()}, '') AS k
  FROM drawn d JOIN (SELECT repo, node, names, is_dir AS dir FROM marked) m USING (repo, node)),
shown AS (SELECT DISTINCT repo FROM acc),
pieces AS (
 SELECT repo, 0 AS section, '' AS k, {head} AS body FROM repos
 UNION ALL SELECT repo, 2, '', concat('## Project Tree', {NL}, {NL}, {ticks}, 'text', {NL},
  CASE WHEN repo IN (SELECT repo FROM shown) THEN '' ELSE concat('(no exported files)', {NL}) END)
  FROM repos
 UNION ALL SELECT repo, 2, k, concat(line, {NL}) FROM ordered
 UNION ALL SELECT repo, 2, '2', concat({ticks}, {NL}, {NL}) FROM repos
 UNION ALL SELECT repo, 3, '', concat('<!-- FILES BEGIN -->', {NL}, {NL}) FROM shown
 UNION ALL SELECT repo, 4, path, {block_sql} FROM acc
 UNION ALL SELECT repo, 5, '', concat('<!-- FILES END -->', {NL}, {NL}) FROM shown)"""


def metrics_of(pieces: str, warn: int = 200_000, limit: int = 0) -> str:
    fail = f"WHEN sum(strlen(body)) * 2 // 7 > {limit} THEN 'fail'" if limit else ""
    return f"""SELECT repo, count(*) FILTER (section = 4) AS files_exported,
 CAST(sum(strlen(body)) AS BIGINT) AS bytes_written,
 CAST(sum(strlen(body)) * 2 // 7 AS BIGINT) AS estimated_tokens,
 CASE {fail} WHEN sum(strlen(body)) * 2 // 7 > {warn} THEN 'warn' ELSE 'ok' END AS verdict
 FROM {pieces} GROUP BY repo"""


# --- ignore rules ------------------------------------------------------------
_DEFAULT_NAMES = [
    ("\\.git", 1), ("node_modules", 1), ("build", 1), ("dist", 1), ("bin", 1), ("\\.env", 0),
    ("\\.venv", 1), ("__pycache__", 1), ("\\.DS_Store", 0), (".*\\.o", 0), (".*\\.a", 0),
    (".*\\.so", 0), (".*\\.exe", 0), (".*\\.dll", 0), (".*\\.log", 0),
]


def rules(own: list[tuple[int, int, int, str]], defaults: bool = True) -> str:
    """Rows (seq, negated, dir_only, whole_path, regex)."""
    rows = [(0, dir_only, 0, rx) for rx, dir_only in _DEFAULT_NAMES if defaults] + own
    values = ", ".join(
        f"({i}, {n} = 1, {d} = 1, {w} = 1, '^{rx}$')" for i, (n, d, w, rx) in enumerate(rows)
    )
    return f"rules(seq, neg, dir_only, whole, rx) AS (VALUES {values})"


DEEP = rules([
    (0, 1, 0, "vendor"), (1, 1, 1, "vendor/keep"), (0, 0, 0, ".*\\.tmp"), (1, 0, 0, "keep\\.tmp"),
    (0, 1, 1, "apps/(?:.*/)?gen"), (1, 0, 1, "build/(?:.*/)?dist/main\\.c"),
    (0, 0, 1, "docs(?:/.*)?"), (1, 1, 1, "docs/web"), (0, 0, 1, "cache/[^/]*"),
])
BRACKETS = rules([
    (0, 0, 0, "[nk].*\\.t[^a-l]p"), (1, 0, 0, "k[A-Za-z]ep\\.tmp"), (0, 1, 1, "[a-d][^/]*/[^w/][^/]*"),
    (1, 1, 1, "build/k[aeiou]ep"), (0, 0, 0, "re[\\]a]dme\\.md"), (0, 0, 0, "[^.]e[m-o]v"),
], defaults=False)
PRUNE = rules([
    (0, 1, 0, "vendor"), (1, 1, 1, "vendor/keep"), (0, 0, 0, ".*\\.tmp"),
    (0, 1, 1, "apps/(?:.*/)?gen"), (0, 0, 1, "docs(?:/.*)?"),
])


def walk(rule_rows: str) -> str:
    """State of every prefix of every path, one recursion step per level."""
    return f"""{rule_rows},
paths AS (SELECT doc_id, source AS repo, {corpora.DEEP_PATH} AS path FROM documents),
prefixes AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS prefix, p[k] AS base,
  k < len(p) AS is_dir, k AS depth
  FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k
    FROM (SELECT DISTINCT string_split(path, '/') AS p FROM paths))),
hits AS (SELECT prefix, is_dir, seq, neg, whole FROM prefixes, rules
  WHERE (is_dir OR NOT dir_only) AND regexp_matches(CASE WHEN whole THEN prefix ELSE base END, rx)),
walked(prefix, is_dir, depth, ignored) AS (
  SELECT p.prefix, p.is_dir, p.depth, coalesce((SELECT NOT arg_max(neg, seq) FROM hits h
    WHERE h.prefix = p.prefix AND h.is_dir = p.is_dir), false)
  FROM prefixes p WHERE p.depth = 1
  UNION ALL
  SELECT p.prefix, p.is_dir, p.depth, CASE WHEN w.ignored THEN coalesce(f.held, true)
    ELSE coalesce(f.free, false) END
  FROM walked w JOIN prefixes p ON p.depth = w.depth + 1
    AND regexp_replace(p.prefix, '/[^/]*$', '') = w.prefix AND w.is_dir
  LEFT JOIN (SELECT prefix, is_dir, NOT arg_max(neg, seq) AS free,
      NOT arg_max(neg, seq) FILTER (whole OR NOT neg) AS held FROM hits GROUP BY prefix, is_dir) f
    ON f.prefix = p.prefix AND f.is_dir = p.is_dir)"""


_OWN = {
    "1": [(0, 0, 0, ".*\\.tmp"), (1, 0, 0, "keep\\.tmp")],
    "2": [(0, 1, 0, "docs"), (1, 1, 1, "build/lib")],
    "x": [(0, 0, 1, "apps/web"), (0, 0, 1, "src(?:/.*)?"), (1, 0, 1, "src/keep/a/[^/]*\\.c")],
    "0": [],
}
_CACHE = [(0, 0, 1, "cache/[^/]*")]


def own_walk() -> str:
    """The walk of every kind of rule list, and the kind of every repository."""
    lists = {kind: walk(rules(_CACHE + own)) for kind, own in _OWN.items()}
    ctes = []
    for i, (kind, text) in enumerate(lists.items()):
        for name in ("rules", "paths", "prefixes", "hits", "walked"):
            text = re.sub(rf"\b{name}\b", f"{name}{i}", text)
        ctes.append(text)
    branches = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, prefix, ignored FROM walked{i} WHERE NOT is_dir"
        for i, kind in enumerate(lists)
    )
    return ", ".join(ctes) + f""", verdicts AS ({branches}),
kinds AS (SELECT *, CASE WHEN repo LIKE '%1' THEN '1' WHEN repo LIKE '%2' THEN '2'
  WHEN repo LIKE '%0' THEN '0' ELSE 'x' END AS kind FROM paths0)"""


# --- snapshots ---------------------------------------------------------------
SNAPSHOTS = f"""base AS (SELECT source AS repo, concat('doc/', doc_id, '.txt') AS path, text AS body
 FROM documents WHERE doc_id % 7 <> 0),
head AS (SELECT source AS repo, {corpora.HEAD_PATH} AS path, {corpora.head_text(chr(92) + '1')}
 AS body FROM documents WHERE doc_id % 11 <> 0),
delta AS (SELECT coalesce(h.repo, b.repo) AS repo, coalesce(h.path, b.path) AS path,
  CASE WHEN b.path IS NULL THEN 'A' WHEN h.path IS NULL THEN 'D' ELSE 'M' END AS change_type,
  sha256(b.body) AS base_sha, sha256(h.body) AS head_sha
  FROM base b FULL JOIN head h ON b.repo = h.repo AND b.path = h.path
  WHERE b.body IS DISTINCT FROM h.body)"""
RENAMES = """added AS (SELECT repo, path, head_sha AS sha,
  row_number() OVER (PARTITION BY repo, head_sha ORDER BY path) AS n
  FROM delta WHERE change_type = 'A'),
deleted AS (SELECT repo, path, base_sha AS sha,
  row_number() OVER (PARTITION BY repo, base_sha ORDER BY path) AS n
  FROM delta WHERE change_type = 'D'),
renamed AS (SELECT a.repo, a.path, 'R' AS change_type, d.path AS previous_path
  FROM added a JOIN deleted d ON a.repo = d.repo AND a.sha = d.sha AND a.n = d.n)"""


SIMILAR = f"""unpaired AS (SELECT 'D' AS kind, d.repo, d.path, body FROM delta d
   JOIN base b ON b.repo = d.repo AND b.path = d.path
   WHERE change_type = 'D' AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.repo = d.repo AND r.previous_path = d.path)
  UNION ALL SELECT 'A', d.repo, d.path, body FROM delta d JOIN head h ON h.repo = d.repo AND h.path = d.path
   WHERE change_type = 'A' AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.repo = d.repo AND r.path = d.path)),
line_sets AS (SELECT *, md5(array_to_string(ls, {NL})) AS k FROM (
  SELECT kind, repo, path, list_sort(list_distinct({lines_of('body')})) AS ls FROM unpaired WHERE body <> '')),
likened AS (SELECT d.repo, d.path AS previous_path, a.path, md5(concat(d.k, a.k)) AS tie,
  len(list_intersect(d.ls, a.ls)) AS common, len(list_distinct(list_concat(d.ls, a.ls))) AS either
  FROM line_sets d JOIN line_sets a ON d.kind = 'D' AND a.kind = 'A' AND a.repo = d.repo),
in_turn AS (SELECT *, CAST(common AS DOUBLE) / either AS score, row_number() OVER (PARTITION BY repo
   ORDER BY CAST(common AS DOUBLE) / either DESC, tie, previous_path, path) AS turn
  FROM likened WHERE 100 * common >= 50 * either),
taking AS (SELECT repo, CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS olds, CAST([] AS VARCHAR[]) AS news, false AS took
  FROM (SELECT DISTINCT repo FROM in_turn)
 UNION ALL SELECT t.repo, i.turn,
  CASE WHEN list_contains(olds, previous_path) OR list_contains(news, path) THEN olds ELSE list_append(olds, previous_path) END,
  CASE WHEN list_contains(olds, previous_path) OR list_contains(news, path) THEN news ELSE list_append(news, path) END,
  NOT list_contains(olds, previous_path) AND NOT list_contains(news, path)
  FROM taking t JOIN in_turn i ON i.repo = t.repo AND i.turn = t.turn + 1),
alike AS (SELECT i.repo, i.path, 'R' AS change_type, i.previous_path, i.score
  FROM taking t JOIN in_turn i ON i.repo = t.repo AND i.turn = t.turn WHERE took)"""


# Changed lines between "old" and "new", both (repo, path, body): the table of common lengths row by row,
# then the way back through it.
MARKED_LINES = (
    f"CASE WHEN {{0}} = '' THEN [] WHEN ends_with({{0}}, {NL}) THEN {lines_of('{0}')} "
    f"ELSE list_concat(list_slice(string_split({{0}}, {NL}), 1, -2), "
    f"[concat(string_split({{0}}, {NL})[-1], {NL})]) END"
)
HUNKS = f"""both_sides AS (SELECT o.repo, o.path, {MARKED_LINES.format('o.body')} AS a, {MARKED_LINES.format('n.body')} AS b
  FROM old o JOIN new n ON n.repo = o.repo AND n.path = o.path),
started AS (SELECT *, least(len(a), len(b)) - p AS rest FROM (SELECT *, coalesce(list_min(list_filter(
   range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS p FROM both_sides)),
trimmed AS (SELECT repo, path, p, s, len(a) AS na, len(b) AS nb, a[p + 1:len(a) - s] AS x, b[p + 1:len(b) - s] AS y
  FROM (SELECT *, coalesce(list_min(list_filter(range(1, rest + 1),
   lambda i: a[len(a) + 1 - i] <> b[len(b) + 1 - i])) - 1, rest) AS s FROM started)),
lengths AS (SELECT repo, path, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(y) + 1), lambda j: CAST(0 AS BIGINT)) AS l FROM trimmed
 UNION ALL SELECT repo, path, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
  SELECT t.repo, t.path, l.i, list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN 0
    ELSE greatest(l.l[j + 1], l.l[j] + CASE WHEN x[l.i + 1] = y[j] THEN 1 ELSE 0 END) END) AS c
  FROM lengths l JOIN trimmed t ON t.repo = l.repo AND t.path = l.path WHERE l.i < len(x))),
way AS (SELECT repo, path, CAST(len(x) AS BIGINT) AS i, CAST(len(y) AS BIGINT) AS j, false AS met FROM trimmed
 UNION ALL SELECT w.repo, w.path, CASE WHEN l.l[w.j] = l.l[w.j + 1] THEN w.i ELSE w.i - 1 END,
  CASE WHEN l.l[w.j] = l.l[w.j + 1] OR x[w.i] = y[w.j] THEN w.j - 1 ELSE w.j END,
  l.l[w.j] <> l.l[w.j + 1] AND x[w.i] = y[w.j]
  FROM way w JOIN trimmed t ON t.repo = w.repo AND t.path = w.path
  JOIN lengths l ON l.repo = w.repo AND l.path = w.path AND l.i = w.i WHERE w.i > 0 AND w.j > 0),
stays AS (SELECT repo, path, unnest(range(0, p + 1)) AS i, unnest(range(0, p + 1)) AS j FROM trimmed
 UNION ALL SELECT w.repo, w.path, p + i + 1, p + j + 1 FROM way w JOIN trimmed t ON t.repo = w.repo AND t.path = w.path WHERE met
 UNION ALL SELECT repo, path, unnest(range(na - s + 1, na + 2)), unnest(range(nb - s + 1, nb + 2)) FROM trimmed),
gaps AS (SELECT *, lag(i) OVER (PARTITION BY repo, path ORDER BY i) AS pi, lag(j) OVER (PARTITION BY repo, path ORDER BY i) AS pj FROM stays),
hunks AS (SELECT repo, path, CASE WHEN j - pj > 1 THEN pj + 1 ELSE pj END AS new_start, j - pj - 1 AS new_count
  FROM gaps WHERE j - pj > 1 OR i - pi > 1)"""


def ranges(context: int) -> str:
    """Ranges and merged ranges from "hunks" and "sizes(repo, path, total_lines)"."""
    return f"""clamped AS (SELECT h.repo, h.path, total_lines, new_count,
  least(greatest(new_start, 1), total_lines) AS cs, new_start + new_count - 1 AS e
  FROM hunks h JOIN sizes s ON s.repo = h.repo AND s.path = h.path WHERE total_lines > 0),
rr AS (SELECT repo, path, total_lines, greatest(cs - {context}, 1) AS range_start,
  max(least((CASE WHEN new_count > 0 THEN least(greatest(e, cs), total_lines) ELSE cs END)
    + {context}, total_lines)) AS range_end
  FROM clamped GROUP BY repo, path, total_lines, range_start),
covered AS (SELECT DISTINCT repo, path, total_lines,
  unnest(range(range_start, range_end + 1)) AS line_no FROM rr),
merged AS (SELECT repo, path, total_lines, min(line_no) AS start_line, max(line_no) AS end_line
  FROM (SELECT *, line_no - row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS g
    FROM covered) GROUP BY repo, path, total_lines, g)"""


PATCH_HUNKS = f"""patches AS (SELECT source AS repo, concat('doc/', doc_id, '.txt') AS path,
  doc_id, {corpora.PATCH} AS patch FROM documents),
parsed AS (SELECT repo, path, regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1) AS s,
  regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+\\d+,(\\d+) @@', 1) AS c
  FROM (SELECT repo, path, unnest(string_split(patch, {NL})) AS line FROM patches
    WHERE doc_id % 97 <> 0) WHERE starts_with(line, '@@')),
hunks AS (SELECT repo, path, CAST(s AS BIGINT) AS new_start,
  CASE WHEN c = '' THEN 1 ELSE CAST(c AS BIGINT) END AS new_count FROM parsed)"""
PLAIN_SIZES = f"""sizes AS (SELECT repo, path, {LINES.format('body')} AS total_lines FROM pf
  WHERE body <> '' AND NOT {binary('body')}
   AND {FIRST_SECRET} IS NULL)"""
FROM_PATCHES = f"{PLAIN}, {PATCH_HUNKS}, {PLAIN_SIZES}, {ranges(1)}"


def slices(entries: str, numbers: bool) -> str:
    """Blocks of sliced files from "merged" and entries(repo, path, body, total_lines,
    fence_len, lang)."""
    prefix = (
        "lpad(cast(start_line + i - 1 AS VARCHAR), "
        "CAST(length(cast(total_lines AS VARCHAR)) AS INT), ' '), ' | ', " if numbers else ""
    )
    omitted = f"concat('... ', {{0}}, ' unchanged lines omitted ...', {NL}, {NL})"
    return f"""spans AS (SELECT m.*, e.body, e.fence_len, e.lang,
  start_line - 1 - lag(end_line, 1, 0) OVER w AS gap, lead(start_line) OVER w IS NULL AS is_tail
  FROM merged m JOIN {entries} e ON e.repo = m.repo AND e.path = m.path
  WINDOW w AS (PARTITION BY m.repo, m.path ORDER BY start_line)),
sliced AS (SELECT repo, path, concat('## ', {markdown('path')}, {NL}, {NL}, string_agg(concat(
   CASE WHEN gap > 0 THEN {omitted.format('gap')} ELSE '' END,
   repeat('`', fence_len), coalesce(lang, ''), {NL},
   array_to_string(list_transform(({lines_of('body')})[start_line:end_line],
     lambda l, i: concat({prefix} l, {NL})), ''),
   repeat('`', fence_len), {NL}, {NL}, {NL},
   CASE WHEN is_tail AND end_line < total_lines THEN {omitted.format('total_lines - end_line')}
     ELSE '' END), '' ORDER BY start_line)) AS body
  FROM spans GROUP BY repo, path)"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


SCAN_PIECES = f"{FILES}, {artifact(FULL_BLOCK)}"
NUMBERED_PIECES = f"{FILES}, {artifact(NUMBERED_BLOCK, f'{NL}, ' + chr(39) + 'Line numbers: on' + chr(39) + ',')}"

HUNK_FLAGS = f"{NL}, 'Hunks: on (context: 2)',"
STAGED_TEXT = "Below are the files with staged changes."
CHANGE_LINE = (
    f"concat('- ', change_type, ' ', CASE WHEN change_type = 'R' THEN concat("
    f"{markdown('previous_path')}, ' -> ') ELSE '' END, {markdown('path')}, {NL})"
)
DELTA_PIECES = f"""{SNAPSHOTS}, {RENAMES}, {SIMILAR},
all_renamed AS (SELECT * FROM renamed UNION ALL SELECT repo, path, change_type, previous_path FROM alike),
changes AS (SELECT repo, path, change_type, CAST(NULL AS VARCHAR) AS previous_path FROM delta d
  WHERE change_type IN ('A', 'M') AND NOT EXISTS (SELECT 1 FROM all_renamed r
    WHERE r.repo = d.repo AND r.path = d.path)
  UNION ALL SELECT * FROM all_renamed),
ok AS (SELECT * FROM head WHERE body <> '' AND NOT {binary('body')}
  AND {FIRST_SECRET} IS NULL),
listed AS (SELECT c.* FROM changes c JOIN ok USING (repo, path)),
new AS (SELECT o.* FROM ok o JOIN listed c ON c.repo = o.repo AND c.path = o.path
  WHERE change_type <> 'A'),
old AS (SELECT c.repo, c.path, b.body FROM listed c JOIN base b
  ON b.repo = c.repo AND b.path = coalesce(c.previous_path, c.path) WHERE change_type <> 'A'),
{HUNKS},
entry AS (SELECT o.*, change_type, {LINES.format('o.body')} AS total_lines,
  {FENCE.format('o.body')} AS fence_len, CAST(NULL AS VARCHAR) AS lang
  FROM ok o JOIN listed c ON c.repo = o.repo AND c.path = o.path),
sizes AS (SELECT repo, path, total_lines FROM entry), {ranges(2)}, {slices('entry', False)},
acc AS (SELECT repo, path, {FULL_BLOCK} AS body FROM entry WHERE change_type = 'A'
  UNION ALL SELECT repo, path, body FROM sliced),
repos AS (SELECT DISTINCT repo FROM head), {TREE},
shown AS (SELECT DISTINCT repo FROM acc),
pieces AS (SELECT repo, 0 AS section, {header('staged', HUNK_FLAGS, STAGED_TEXT)} AS body FROM repos
 UNION ALL SELECT r.repo, 1, concat('## Change Context', {NL}, {NL}, 'Files changed: ', count(l.path),
  {NL}, {NL}, {NL}) FROM repos r LEFT JOIN listed l ON l.repo = r.repo GROUP BY r.repo
 UNION ALL SELECT repo, 1, {CHANGE_LINE} FROM listed
 UNION ALL SELECT repo, 2, concat('## Project Tree', {NL}, {NL}, '```text', {NL}, '```', {NL}, {NL},
  CASE WHEN repo IN (SELECT repo FROM shown) THEN '' ELSE concat('(no exported files)', {NL}) END)
  FROM repos
 UNION ALL SELECT repo, 2, concat(line, {NL}) FROM drawn
 UNION ALL SELECT repo, 3, concat('<!-- FILES BEGIN -->', {NL}, {NL}, '<!-- FILES END -->', {NL}, {NL})
  FROM shown
 UNION ALL SELECT repo, 4, body FROM acc)"""

PATH_PARTS = "'^https?://([^/]+)/?([^?#]*)'"
PAGES = f"""vf AS (SELECT regexp_extract(url, {PATH_PARTS}, 1) AS repo, concat('p', page_id, '/',
  regexp_extract(url, {PATH_PARTS}, 2), '_index.html') AS path, html AS body FROM pages),
acc AS (SELECT *, 'html' AS lang, {FENCE.format('body')} AS fence_len FROM vf
  WHERE body <> '' AND NOT {binary('body')} AND {FIRST_SECRET} IS NULL
   AND NOT regexp_matches(path, '(^|/)(\\.git|node_modules|build|dist|bin|\\.venv|__pycache__|\\.env)/')),
{artifact(FULL_BLOCK)}"""
TURNS = f"""vf AS (SELECT role AS repo, concat('conv/', conv_id, '/', turn, '.md') AS path,
  text AS body FROM conversations),
acc AS (SELECT *, 'markdown' AS lang, {FENCE.format('body')} AS fence_len,
  {LINES.format('body')} AS total_lines FROM vf
  WHERE body <> '' AND NOT {binary('body')} AND {FIRST_SECRET} IS NULL),
repos AS (SELECT DISTINCT repo FROM vf), shown AS (SELECT DISTINCT repo FROM acc),
pieces AS (SELECT repo, 0 AS section,
  {header('recursive', f"{NL}, 'Line numbers: on',", SCAN_TEXT)} AS body FROM repos
 UNION ALL SELECT repo, 3, concat('<!-- FILES BEGIN -->', {NL}, {NL}, '<!-- FILES END -->', {NL}, {NL})
  FROM shown
 UNION ALL SELECT repo, 4, {NUMBERED_BLOCK} FROM acc)"""

DIFF_TEXT = "Below are the files that differ between two states."
LOG_PIECES = f"""{PLAIN},
listed AS (SELECT p.repo, p.path, p.body,
  CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE 'M' END AS change_type,
  CASE WHEN doc_id % 4 = 1 THEN concat('old/', doc_id) END AS previous_path
  FROM pf p JOIN documents d ON p.path = concat('doc/', doc_id, '.txt') WHERE doc_id % 4 <> 3
   AND body <> '' AND NOT {binary('body')} AND {FIRST_SECRET} IS NULL),
acc AS (SELECT *, CAST(NULL AS VARCHAR) AS lang, {FENCE.format('body')} AS fence_len FROM listed),
repos AS (SELECT DISTINCT repo FROM pf), shown AS (SELECT DISTINCT repo FROM acc),
pieces AS (SELECT repo, 0 AS section, {header('diff', '', DIFF_TEXT)} AS body FROM repos
 UNION ALL SELECT r.repo, 1, concat('## Change Context', {NL}, {NL}, 'Files changed: ', count(l.path),
  {NL}, 'Diff range: v1..v2', {NL}, {NL}, {NL})
  FROM repos r LEFT JOIN listed l ON l.repo = r.repo GROUP BY r.repo
 UNION ALL SELECT repo, 1, {CHANGE_LINE} FROM listed
 UNION ALL SELECT repo, 3, concat('<!-- FILES BEGIN -->', {NL}, {NL}, '<!-- FILES END -->', {NL}, {NL})
  FROM shown
 UNION ALL SELECT repo, 4, {FULL_BLOCK} FROM acc)"""

ORACLES: dict[str, str] = {
    "file_kinds": _with(f"""{PLAIN}, k AS (SELECT *, length(path) + strlen(body) % 7 AS n FROM pf)""",
                        f"""SELECT repo, path, CASE n WHEN 10 THEN 'symlink' WHEN 11 THEN 'not_regular' WHEN 12 THEN 'unreadable'
 WHEN 13 THEN 'unreadable_dir' WHEN 14 THEN 'changed' ELSE CASE WHEN body = '' THEN 'empty' WHEN {binary('body')} THEN 'binary'
 WHEN {FIRST_SECRET} IS NOT NULL THEN 'sensitive_content' END END AS skip_reason FROM k"""),
    "invalid_bytes": f"""WITH t AS (SELECT doc_id, text AS body, concat(hex(text), CASE doc_id % 8 WHEN 0 THEN 'C328' WHEN 1 THEN 'EDA080'
  WHEN 2 THEN 'F4908080' WHEN 3 THEN 'C080' WHEN 4 THEN 'C3A9' WHEN 5 THEN 'E282' WHEN 6 THEN 'F09F9880' ELSE 'EE8080' END) AS h
  FROM documents)
SELECT doc_id, {binary('body')} OR NOT regexp_matches(h, '^([0-7].|(C[2-9A-F]|D.|E0[AB].|E[1-9A-CEF][89AB].|ED[89].|F0[9AB].[89AB].'
  '|F[1-3][89AB].[89AB].|F48.[89AB].)[89AB].)*$') AS binary FROM t""",
    "file_decisions": _with(f"{VF}, {DECIDED}", f"""SELECT repo, path, size, skip_reason,
 CASE WHEN skip_reason = 'sensitive_content' THEN {FIRST_SECRET} END AS matched_rule,
 CASE WHEN skip_reason = 'ignored' AND starts_with(path, 'node_modules/') THEN 'node_modules' END
  AS pruned_directory FROM decided"""),
    "skip_summary": _with(f"{VF}, {DECIDED}", """SELECT repo, coalesce(skip_reason, 'accepted') AS reason,
 count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM decided GROUP BY ALL"""),
    "skip_counters": _with(f"{VF}, {DECIDED}", """SELECT repo,
 count(*) FILTER (skip_reason IN ('empty', 'binary')) AS binary_or_empty,
 count(*) FILTER (skip_reason = 'too_large') AS too_large,
 count(*) FILTER (skip_reason = 'ignored' AND NOT starts_with(path, 'node_modules/'))
  + CASE WHEN bool_or(starts_with(path, 'node_modules/')) THEN 1 ELSE 0 END AS ignored,
 CAST(0 AS BIGINT) AS symlink,
 count(*) FILTER (starts_with(skip_reason, 'sensitive')) AS sensitive,
 CAST(0 AS BIGINT) AS unreadable_dirs FROM decided GROUP BY repo"""),
    "selected_decisions": _with(VF, f"""SELECT repo, reason, count(*) AS n_files,
 CAST(sum(strlen(body)) AS BIGINT) AS n_bytes FROM (SELECT *, CASE WHEN strlen(body) > 10240
  THEN 'too_large' WHEN body = '' THEN 'empty' WHEN {binary('body')} THEN 'binary'
  ELSE 'accepted' END AS reason FROM vf) GROUP BY ALL"""),
    "binary_text": f"""SELECT doc_id, {binary('t')} AS is_binary FROM (SELECT doc_id,
 concat(text, repeat(chr(7), greatest(0, strlen(text) * 3 // 97 + doc_id % 6 - 2)),
  CASE WHEN doc_id % 29 = 0 THEN chr(0) ELSE chr(9) END) AS t FROM documents)""",
    "sensitive_names": f"""SELECT doc_id, path, {SENSITIVE_NAME.format(BASE)} AS is_sensitive
 FROM (SELECT doc_id, {catalog.corpora_name_sql()} AS path FROM documents)""",
    "language_of_file": _with(FILES, "SELECT repo, path, lang FROM acc"),
    "shebang_language": _with(LANGS, f"""SELECT doc_id, i.lang FROM (SELECT doc_id,
 {catalog.shebang_sql()} AS t FROM documents) LEFT JOIN interpreters i
 ON i.word = {HEADER_WORD.format('t')}"""),
    "line_count": _with(FILES, "SELECT repo, path, total_lines FROM acc"),
    "line_split": f"""SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line
 FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM documents)""",
    "final_newline": f"""SELECT doc_id, {LINES.format('t')} AS total_lines, strlen(t) AS n_bytes
 FROM (SELECT doc_id, {CLOSED.format('text')} AS t FROM documents)""",
    "fence_length": f"""SELECT doc_id, {FENCE.format('t')} AS fence_len FROM (SELECT doc_id,
 concat(text, {NL}, repeat('`', doc_id % 9), ' ``') AS t FROM documents)""",
    "token_estimate": """SELECT doc_id, strlen(text) AS n_bytes,
 (strlen(text) // 7) * 2 + ((strlen(text) % 7) * 2) // 7 AS tokens FROM documents""",
    "heading_paths": f"""SELECT doc_id, {markdown('path')} AS heading,
 replace(replace(replace(replace(path, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(7),
  '\\x07') AS visible, true AS round_trip
 FROM (SELECT doc_id, {catalog._odd_path()} AS path FROM documents)""",
    "unsafe_paths": """SELECT doc_id, concat(CASE doc_id % 6 WHEN 0 THEN '/abs/' WHEN 1 THEN '../'
  WHEN 2 THEN 'a/../' WHEN 3 THEN 'a/../../' WHEN 4 THEN './x//' ELSE '' END, doc_id, '.txt') AS path,
 CASE doc_id % 6 WHEN 0 THEN concat('abs/', doc_id, '.txt') WHEN 1 THEN NULL WHEN 3 THEN NULL
  WHEN 4 THEN concat('x/', doc_id, '.txt') ELSE concat(doc_id, '.txt') END AS safe_path
 FROM documents""",
    "secret_findings": _with(f"{VF}, {DECIDED}", " UNION ALL ".join(
        f"""SELECT repo, path, '{name}' AS rule,
 '{'soft' if name.startswith(('github', 'sk')) else 'hard'}' AS severity,
 CAST(len(regexp_extract_all(body, '{rx}')) AS BIGINT) AS n_hits FROM decided
 WHERE (skip_reason IS NULL OR skip_reason = 'sensitive_content')
  AND regexp_matches(body, '{rx}')""" for name, rx in SECRETS.items())),
    "contextual_secrets": _with(PLAIN, f"""SELECT repo, path, 'hex_token' AS rule, 'soft' AS severity,
 CAST(n AS BIGINT) AS n_hits FROM (SELECT repo, path, len(regexp_extract_all(body,
  '(?:Bearer |[=:](?:[^\\n\\r]{{0,30}}[^\\n\\r0-9a-f])?)[0-9a-f]{{40}}(?:[^0-9a-f]|\\z)')) AS n FROM pf
  WHERE body <> '' AND NOT {binary('body')}) WHERE n > 0"""),
    "ignore_decisions": _with(walk(DEEP), """SELECT doc_id, path, ignored FROM paths
 JOIN walked w ON w.prefix = path AND NOT w.is_dir""", recursive=True),
    "bracket_rules": _with(walk(BRACKETS), """SELECT doc_id, path, ignored FROM paths
 JOIN walked w ON w.prefix = path AND NOT w.is_dir""", recursive=True),
    "ignore_pruned_dirs": _with(walk(PRUNE), """SELECT repo, directory, count(*) AS hidden_files FROM (
  SELECT p.repo, p.doc_id, arg_min(w.prefix, w.depth) AS directory FROM paths p
  JOIN walked w ON w.is_dir AND starts_with(p.path, w.prefix || '/') AND w.ignored
   AND w.prefix NOT IN ('vendor', 'vendor/keep') GROUP BY p.repo, p.doc_id) GROUP BY repo, directory""",
                                recursive=True),
    "own_ignore_files": _with(own_walk(), """SELECT k.repo, k.path, count(*) AS n_files,
 count(*) FILTER (v.ignored) AS n_ignored FROM kinds k JOIN verdicts v
 ON v.kind = k.kind AND v.prefix = k.path GROUP BY k.repo, k.path""", recursive=True),
    "tracked_union": f"""SELECT DISTINCT source AS repo, path FROM (SELECT doc_id, source,
  {corpora.FILE_PATH} AS path FROM documents) WHERE doc_id % 3 = 0 OR NOT (
  regexp_matches(path, '(^|/)(build|node_modules)/') AND NOT starts_with(path, 'build/keep/')
  OR ends_with(path, '.log'))""",
    "path_list": """SELECT DISTINCT source AS repo, path FROM (
 SELECT source, concat('doc/', doc_id, '.txt') AS path FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT source, concat('./doc/', doc_id - doc_id % 2, '.txt') FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT source, concat('missing/', doc_id, '.c') FROM documents)""",
    "selected_files": _with(PLAIN, f"""SELECT p.repo, p.path, strlen(body) AS n_bytes FROM pf p
 WHERE body <> '' AND NOT {binary('body')} AND {FIRST_SECRET} IS NULL
 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 3 = 0 AND d.source = p.repo
  AND p.path IN (concat('doc/', d.doc_id, '.txt'), concat('doc/', d.doc_id - d.doc_id % 2, '.txt')))"""),
    "subtree_scope": """SELECT DISTINCT source AS repo, concat(doc_id, '.c') AS path, 'R' AS change_type,
 concat('old/', doc_id, '.c') AS previous_path FROM documents WHERE doc_id % 19 <> 0""",
    "change_log": """SELECT source AS repo, concat('src/m_', doc_id, '.c') AS path, 'M' AS change_type,
 CAST(NULL AS VARCHAR) AS previous_path, false AS parse_error FROM documents WHERE doc_id % 19 <> 0
 UNION ALL SELECT source, concat('new/', doc_id, '.c'), 'R', concat('old/', doc_id, '.c'), false
 FROM documents WHERE doc_id % 19 <> 0
 UNION ALL SELECT source, 'A', 'A', NULL, false FROM documents WHERE doc_id % 19 <> 0 AND doc_id % 3 <> 0
 UNION ALL SELECT source, NULL, NULL, NULL, true FROM documents WHERE doc_id % 19 = 0""",
    "change_list_files": """SELECT source AS repo, concat('src/m_', doc_id, '.c') AS path, 'M' AS change_type,
 CAST(NULL AS VARCHAR) AS previous_path, false AS parse_error FROM documents WHERE doc_id % 19 <> 0
 UNION ALL SELECT source, concat('new/', doc_id, '.c'), 'R', concat('old/', doc_id, '.c'), false
 FROM documents WHERE doc_id % 19 <> 0
 UNION ALL SELECT source, 'A', 'A', NULL, false FROM documents WHERE doc_id % 19 <> 0 AND doc_id % 3 <> 0""",
    "change_order": """WITH c AS (SELECT DISTINCT source AS repo, unnest([
  {'p': concat('src/m_', doc_id, '.c'), 't': 'M', 'o': '', 'l': concat('- M src/m_', doc_id, '.c')},
  {'p': concat('new/', doc_id, '.c'), 't': 'R', 'o': concat('old/', doc_id, '.c'), 'l': concat('- R old/', doc_id, '.c -> new/', doc_id, '.c')},
  {'p': CASE WHEN doc_id % 3 <> 0 THEN 'A' END, 't': 'A', 'o': '', 'l': '- A A'}]) AS x FROM documents WHERE doc_id % 19 <> 0)
SELECT repo, x.l AS line, CAST(row_number() OVER (PARTITION BY repo ORDER BY x.p, x.t, x.o) AS INTEGER) AS place
 FROM c WHERE x.p IS NOT NULL""",
    "snapshot_delta": _with(SNAPSHOTS, "SELECT repo, path, change_type, base_sha, head_sha FROM delta"),
    "exact_renames": _with(f"{SNAPSHOTS}, {RENAMES}", "SELECT * FROM renamed"),
    "similar_renames": _with(f"{SNAPSHOTS}, {RENAMES}, {SIMILAR}", "SELECT * FROM alike", recursive=True),
    "change_context": _with(SNAPSHOTS, f"""SELECT d.repo, concat('- ', change_type, ' ', d.path) AS line
 FROM delta d JOIN head h ON h.repo = d.repo AND h.path = d.path WHERE change_type <> 'D'
 AND body <> '' AND NOT {binary('body')} AND {FIRST_SECRET} IS NULL"""),
    "hunks_from_patch": _with(PATCH_HUNKS, """SELECT *, false AS parse_error FROM hunks
 UNION ALL SELECT repo, path, NULL, NULL, true FROM patches WHERE doc_id % 97 = 0"""),
    "render_ranges": _with(FROM_PATCHES, "SELECT * FROM rr"),
    "merged_ranges": _with(FROM_PATCHES, "SELECT * FROM merged"),
    "omission_counts": _with(FROM_PATCHES, """, missing AS (SELECT s.repo, s.path, s.total_lines, line_no
  FROM (SELECT repo, path, total_lines, unnest(range(1, total_lines + 1)) AS line_no FROM sizes
    WHERE EXISTS (SELECT 1 FROM merged m WHERE m.repo = sizes.repo AND m.path = sizes.path)) s
  ANTI JOIN covered c ON c.repo = s.repo AND c.path = s.path AND c.line_no = s.line_no)
 SELECT repo, path, max(line_no) + 1 AS before_line, count(*) AS omitted_lines FROM (
  SELECT *, line_no - row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS g FROM missing)
 GROUP BY repo, path, g"""),
    "line_hunks": _with(f"""{SNAPSHOTS},
 changed AS (SELECT * FROM delta WHERE change_type = 'M'),
 old AS (SELECT b.* FROM base b JOIN changed c ON c.repo = b.repo AND c.path = b.path),
 new AS (SELECT h.* FROM head h JOIN changed c ON c.repo = h.repo AND c.path = h.path), {HUNKS}""",
                        "SELECT * FROM hunks", recursive=True),
    "moved_line_hunks": _with(f"""turned AS (SELECT source AS repo, concat('doc/', doc_id, '.txt') AS path, text,
  string_split(text, {NL}) AS l, len(string_split(text, {NL})) AS n FROM documents),
 old AS (SELECT repo, path, text AS body FROM turned),
 new AS (SELECT repo, path, array_to_string([v[1] FOR v IN list_zip(t, range(0, len(t))) IF v[2] % 7 <> 5], {NL}) AS body
  FROM (SELECT repo, path, list_concat(l[n // 2 + 1:], l[1:n // 2], l[2:2]) AS t FROM turned)), {HUNKS}""",
                        "SELECT * FROM hunks", recursive=True),
    "sliced_blocks": _with(f"""{FROM_PATCHES},
 entry AS (SELECT repo, path, body, {LINES.format('body')} AS total_lines,
  {FENCE.format('body')} AS fence_len, CAST(NULL AS VARCHAR) AS lang,
  CAST(regexp_extract(path, '\\d+') AS BIGINT) % 3 = 0 AS is_new
  FROM pf JOIN sizes USING (repo, path)), {slices('entry', True)}""",
                           f"""SELECT repo, path, {NUMBERED_BLOCK} AS body FROM entry WHERE is_new
 UNION ALL SELECT s.* FROM sliced s JOIN entry e USING (repo, path) WHERE NOT is_new"""),
    "delta_export": _with(DELTA_PIECES, metrics_of("pieces"), recursive=True),
    "change_log_export": _with(LOG_PIECES, metrics_of("pieces")),
    "tree_nodes": _with(f"{FILES}, {TREE}", "SELECT repo, node, parent, name, depth, is_dir FROM tree"),
    "project_tree": _with(f"{FILES}, {TREE}", "SELECT repo, depth, is_last, line FROM drawn"),
    "tree_depth_limited": _with(
        f"{FILES}, {TREE}", "SELECT repo, depth, is_last, line FROM drawn WHERE depth <= 2"),
    "file_blocks": _with(FILES, f"SELECT repo, path, {FULL_BLOCK} AS body FROM acc"),
    "numbered_blocks": _with(FILES, f"SELECT repo, path, {NUMBERED_BLOCK} AS body FROM acc"),
    "repo_metrics": _with(SCAN_PIECES, metrics_of("pieces")),
    "token_budget": _with(SCAN_PIECES, f"""SELECT repo, estimated_tokens, verdict FROM (
 {metrics_of('pieces', catalog.BUDGET.warn_tokens, catalog.BUDGET.max_tokens)})"""),
    "artifact_by_repo": _with(SCAN_PIECES, f"""SELECT repo, part,
 string_agg(body, '' ORDER BY section, k) AS body FROM (SELECT *,
  CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY repo ORDER BY section, k
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {catalog.SMALL_PART} AS part
  FROM pieces) GROUP BY repo, part"""),
    "unpack_roundtrip": _with(FILES, f"""SELECT repo, path, path AS safe_path,
 {CLOSED.format('body')} AS text, 'ok' AS status FROM acc"""),
    "stored_roundtrip": _with(FILES, f"""SELECT repo, path, path AS safe_path,
 {CLOSED.format('body')} AS text, 'ok' AS status FROM acc"""),
    "written_artifacts": _with(SCAN_PIECES, f"""SELECT repo,
 CAST(sum(strlen(body) - strlen(replace(body, {NL}, ''))) AS BIGINT) AS lines, CAST(sum(strlen(body)) AS BIGINT) AS bytes
 FROM pieces GROUP BY repo"""),
    "broken_artifacts": _with(f"""{PLAIN}, ok AS (SELECT repo, body FROM pf
  WHERE body <> '' AND NOT {binary('body')} AND {FIRST_SECRET} IS NULL)""",
                              """SELECT repo, CASE right(repo, 1) WHEN '0' THEN 'malformed' WHEN '1' THEN 'hunk_export'
 WHEN '2' THEN 'malformed' WHEN '3' THEN 'invalid_line_number' WHEN '4' THEN 'unsafe_path' ELSE 'ok' END AS status,
 CASE WHEN right(repo, 1) IN ('0', '1', '2') THEN 0 ELSE count(*) END AS files FROM ok GROUP BY repo"""),
    "page_metrics": _with(PAGES, metrics_of("pieces")),
    "turn_metrics": _with(TURNS, metrics_of("pieces")),
}
