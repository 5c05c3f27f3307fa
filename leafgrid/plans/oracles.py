"""For each registered query the same result as one DuckDB statement.

The shared pieces below restate the derived tables and the rules in SQL.
"""

from __future__ import annotations

FOLDER = "'application/vnd.google-apps.folder'"

FILES = f"""
files AS (
  SELECT 'ROOT' AS id, 'My Drive' AS name, {FOLDER} AS mime, NULL::VARCHAR AS size,
         NULL::VARCHAR AS link, NULL::VARCHAR AS modified, NULL::VARCHAR AS owner,
         NULL::VARCHAR AS sharer, ['ALL'] AS parents, false AS trashed,
         NULL::VARCHAR AS shared_time, NULL::VARCHAR AS drive_id
  UNION ALL SELECT 'PARTS', 'Parts', {FOLDER}, NULL, NULL, NULL, NULL, NULL,
         ['ROOT'], false, NULL, NULL
  UNION ALL SELECT 'D' || r_regionkey, r_name, {FOLDER}, NULL, NULL, NULL, NULL, NULL,
         ['ALL'], false, NULL, 'D' || r_regionkey FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, {FOLDER}, NULL, NULL, NULL, NULL, NULL,
         ['D' || n_regionkey], false, NULL, 'D' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, {FOLDER}, NULL, NULL, NULL,
         c_name || '@example.com', NULL, ['N' || c_nationkey], false, NULL, 'D'
         FROM customer
  UNION ALL SELECT 'O' || o_orderkey,
         CASE WHEN o_orderkey % 7 < 2 THEN o_orderpriority || '.pdf' ELSE o_orderpriority END,
         (['application/pdf', 'application/octet-stream',
           'application/vnd.google-apps.document', 'application/vnd.google-apps.spreadsheet',
           'application/vnd.google-apps.presentation', 'application/vnd.google-apps.form',
           'application/vnd.google-apps.shortcut'])[(o_orderkey % 7 + 1)::INT],
         CASE WHEN o_orderkey % 7 < 2
              THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END,
         CASE WHEN o_orderkey % 3 = 0 THEN 'https://docs.google.com/document/d/O'
              || o_orderkey || '/edit?usp=sharing' END,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z'),
         'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@example.com',
         CASE WHEN o_orderkey % 5 = 0 THEN
              'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@example.com' END,
         CASE WHEN o_orderkey % 13 = 0 THEN ['C' || o_custkey, 'N' || (o_orderkey % 25)]
              ELSE ['C' || o_custkey] END,
         o_orderkey % 11 = 0,
         CASE WHEN o_orderkey % 5 = 0 THEN '2026-01-01T00:00:00Z' END,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'D' END FROM orders
  UNION ALL SELECT 'P' || p_partkey, p_name || '.' || p_type, 'text/plain',
         CAST(p_size AS VARCHAR), NULL, NULL, NULL, NULL, ['PARTS'], false, NULL, NULL
         FROM part
  UNION ALL SELECT DISTINCT 'S_' || source, source, {FOLDER}, NULL, NULL, NULL, NULL, NULL,
         ['ROOT'], false, '2026-01-01T00:00:00Z', NULL FROM documents
  UNION ALL SELECT DISTINCT 'L_' || source || '_' || lang, lang, {FOLDER}, NULL, NULL,
         NULL, NULL, NULL, ['S_' || source], false, NULL, NULL FROM documents
  UNION ALL SELECT 'T' || doc_id, 'doc_' || doc_id || '.' || lang || '.TXT', 'text/plain',
         CAST(n_chars AS VARCHAR), 'https://drive.google.com/file/d/T' || doc_id || '/view?usp=x',
         NULL, NULL, NULL, ['L_' || source || '_' || lang], false, NULL, NULL FROM documents
),
edges AS (
  SELECT *, unnest(parents) AS parent FROM files WHERE NOT trashed
)"""

DRIVES = """
drives AS (
  SELECT 'ROOT' AS id, 'personal' AS type, 'My Drive' AS name,
         'https://drive.google.com/drive/my-drive' AS url, CAST(0 AS BIGINT) AS ord
  UNION ALL
  SELECT 'D' || r_regionkey, 'shared', r_name,
         'https://drive.google.com/drive/folders/D' || r_regionkey,
         CAST(r_regionkey + 1 AS BIGINT) FROM region
)"""


def walk(depth: int | None = None, root: str = "'ALL'") -> str:
    within = "true" if depth is None else f"lvl + 1 < {depth}"
    return f"""{FILES},
descended AS (
  SELECT {root} AS fid, CAST([] AS VARCHAR[]) AS ancestors, 0 AS lvl
  UNION ALL
  SELECT e.id, list_append(d.ancestors, e.name), d.lvl + 1
  FROM descended d JOIN edges e ON e.parent = d.fid
  WHERE e.mime = {FOLDER} AND {within}
),
walk AS (
  SELECT e.*, d.ancestors, d.lvl AS depth,
         (e.mime = {FOLDER} AND {within}) AS descended
  FROM descended d JOIN edges e ON e.parent = d.fid
)"""


SUFFIX = "regexp_extract({0}, '(?s)^.+\\.([^.]+)$', 1)"
TYPE = f"""CASE mime WHEN {FOLDER} THEN 'folder'
  WHEN 'application/vnd.google-apps.document' THEN 'gdoc'
  WHEN 'application/vnd.google-apps.spreadsheet' THEN 'gsheet'
  WHEN 'application/vnd.google-apps.presentation' THEN 'gslides'
  WHEN 'application/vnd.google-apps.form' THEN 'gform'
  WHEN 'application/vnd.google-apps.shortcut' THEN 'shortcut'
  ELSE coalesce(nullif({SUFFIX.format("name")}, ''), 'unknown') END"""
CANONICAL = """regexp_replace(regexp_replace(
  CASE WHEN contains({0}, 'drive.google.com') OR contains({0}, 'docs.google.com')
       THEN split_part({0}, '?', 1) ELSE {0} END, '/edit$', ''), '/view$', '')"""
URL = f"""CASE WHEN mime = {FOLDER} THEN 'https://drive.google.com/drive/folders/' || id
  ELSE {CANONICAL.format("coalesce(link, 'https://drive.google.com/file/d/' || id)")} END"""
ID_IN = """coalesce(
  nullif(regexp_extract({0}, '/(?:folders|d)/([a-zA-Z0-9_-]+)', 1), ''),
  nullif(regexp_extract({0}, '[?&]id=([a-zA-Z0-9_-]+)', 1), ''),
  CASE WHEN NOT (starts_with({0}, 'http://') OR starts_with({0}, 'https://')) THEN {0} END)"""
KIND = """CASE WHEN NOT starts_with(mime, 'application/vnd.google-apps.') THEN 'binary'
  WHEN mime IN ('application/vnd.google-apps.document',
    'application/vnd.google-apps.spreadsheet',
    'application/vnd.google-apps.presentation') THEN 'export' ELSE 'skip' END"""
EXTENSION = """CASE mime WHEN 'application/vnd.google-apps.document' THEN '.docx'
  WHEN 'application/vnd.google-apps.spreadsheet' THEN '.xlsx'
  WHEN 'application/vnd.google-apps.presentation' THEN '.pptx' ELSE '' END"""


def size_text(n: str) -> str:
    cases = ""
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        cases += (
            f" WHEN {n} < 1024.0::DOUBLE ** {power + 1}"
            f" THEN printf('%.1f {unit}', CAST({n} AS DOUBLE) / 1024.0::DOUBLE ** {power})"
        )
    return f"CASE{cases} ELSE printf('%.1f PB', CAST({n} AS DOUBLE) / 1024.0::DOUBLE ** 5) END"


def listing(root: str = "'ALL'") -> str:
    return f"""{walk(root=root)},
listing AS (
  SELECT {URL} AS url,
         array_to_string(list_transform(ancestors, lambda a: a || '/'), '') || name
           || CASE WHEN mime = {FOLDER} THEN '/' ELSE '' END AS path,
         name, {TYPE} AS file_type, coalesce(substr(modified, 1, 10), '') AS modified,
         coalesce(owner, '') AS owner, coalesce(sharer, '') AS shared_by, depth
  FROM walk
)"""


LISTING = listing()


def manifest(out_dir: str, depth: int | None = None) -> str:
    below = "array_to_string(ancestors, '/')"
    if out_dir == ".":
        place = f"CASE WHEN len(ancestors) = 0 THEN '.' ELSE {below} END"
    else:
        place = f"CASE WHEN len(ancestors) = 0 THEN '{out_dir}' ELSE '{out_dir}/' || {below} END"
    return f"""{walk(depth)},
manifest AS (
  SELECT id, CASE WHEN mime = {FOLDER} AND NOT descended THEN 'skip_depth'
           WHEN mime = {FOLDER} THEN 'mkdir'
           WHEN {KIND} = 'skip' THEN 'skip_native' ELSE {KIND} END AS action,
         {place} AS dir, name || {EXTENSION} AS base, lower(name) AS lname
  FROM walk
)"""


TARGETS = """
targets AS (
  SELECT id, action, dir,
    CASE WHEN action IN ('binary', 'export') THEN
      CASE WHEN dir = '.' THEN '' ELSE dir || '/' END ||
      CASE WHEN rn = 0 THEN base
           ELSE regexp_replace(base, '\\.[^.]+$', '') || ' (' || rn || ')'
                || CASE WHEN contains(base, '.') THEN regexp_extract(base, '\\.[^.]+$') ELSE '' END
      END END AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY dir, base,
           action IN ('binary', 'export') ORDER BY id) - 1 AS rn FROM manifest)
)"""

# Files of one directory and family take turns in walk order; each takes the first
# of its names that is not among the names taken so far.
TURNS = r"""
mixed AS (
  SELECT id, action, dir, lname, CASE WHEN id LIKE 'P%' AND copy > 0
    THEN regexp_replace(base, '(\.[A-Z])', ' (' || copy || ')\1', 'g') ELSE base END AS base
  FROM (SELECT *, TRY_CAST(substr(id, 2, 20) AS BIGINT) % 3 AS copy FROM manifest)
),
held AS (
  SELECT dir, base FROM mixed WHERE action = 'mkdir'
  UNION SELECT 'My Drive/Parts', p_name || '.' || p_type FROM part
  UNION SELECT r_name || '/' || n_name, c_name FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_custkey % 10 = 0
),
named AS (
  SELECT *, left(base, len(base) - len(ending)) AS stem,
    row_number() OVER (PARTITION BY dir, family ORDER BY lname, id) AS turn
  FROM (SELECT *, regexp_replace(base, ' \([0-9]+\)', '', 'g') AS family,
          regexp_extract(base, '^.+(\.[^.]+)$', 1) AS ending
        FROM mixed WHERE action IN ('binary', 'export'))
),
at_first AS (
  SELECT dir, family, coalesce(names, []) AS names
  FROM (SELECT DISTINCT dir, family FROM named) LEFT JOIN
    (SELECT dir, regexp_replace(base, ' \([0-9]+\)', '', 'g') AS family, list(base) AS names
     FROM held GROUP BY ALL) USING (dir, family)
),
placed AS (
  SELECT dir, family, 0::BIGINT AS turn, NULL::VARCHAR AS id, NULL::VARCHAR AS name, names
  FROM at_first
  UNION ALL
  SELECT dir, family, turn, id, name, list_append(names, name)
  FROM (SELECT f.dir, f.family, f.turn, f.id, p.names,
          list_filter(list_transform(range(0, len(p.names) + 1), lambda n:
              CASE WHEN n = 0 THEN f.base ELSE f.stem || ' (' || n || ')' || f.ending END),
            lambda c: NOT list_contains(p.names, c))[1] AS name
        FROM placed p JOIN named f
          ON f.dir = p.dir AND f.family = p.family AND f.turn = p.turn + 1)
)"""

REQUESTS = """
homes AS (
  SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS folder
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
requests AS (
  SELECT 'o' || o_orderkey AS request,
    CASE WHEN o_orderkey % 17 = 0 THEN folder || '/none/x'
         WHEN o_orderkey % 19 = 0 THEN 'Nowhere/' || folder
         WHEN o_orderkey % 2 = 0 THEN upper(folder || '/' || file)
         ELSE lower(folder || '/' || file) END AS path
  FROM (SELECT *, CASE WHEN o_orderkey % 7 < 2 THEN o_orderpriority || '.pdf'
                       ELSE o_orderpriority END AS file FROM orders)
  JOIN homes ON o_custkey = c_custkey
  UNION ALL SELECT 'c' || c_custkey, '/' || folder || '/' FROM homes
)"""

PREFIX = f"""{DRIVES},
parts AS (
  SELECT path, string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/') AS parts
  FROM (SELECT DISTINCT path FROM requests)
),
prefix AS (
  SELECT p.path, p.parts, max(i) AS taken, max_by(d.id, i) AS drive_id,
         max_by(d.name, i) AS drive_name
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM parts) p
  JOIN drives d ON lower(d.name) = lower(array_to_string(parts[1:i], '/'))
  GROUP BY ALL
),
matched AS (
  SELECT p.path, p.parts, drive_id, drive_name,
         CASE WHEN drive_id IS NOT NULL THEN p.parts[taken + 1:] END AS rest
  FROM parts p LEFT JOIN prefix x ON p.path = x.path
)"""


def descend(allow_files: bool, corpora_filter: str = "true") -> str:
    any_match = "true" if allow_files else "false"
    return f"""
idx AS (
  SELECT parent, lower(name) AS lname, count(*) FILTER (WHERE mime = {FOLDER}) AS folders,
         count(*) AS items, min(id) FILTER (WHERE mime = {FOLDER}) AS folder_child,
         min(id) AS item_child
  FROM edges WHERE {corpora_filter} GROUP BY ALL
),
steps AS (
  SELECT path, rest, 0 AS i, at_folder, status, segment, kind FROM seeds
  UNION ALL
  SELECT s.path, s.rest, s.i + 1,
    CASE WHEN s.hits = 1 THEN s.child ELSE s.at_folder END,
    CASE WHEN s.hits = 0 THEN 'not_found' WHEN s.hits > 1 THEN 'ambiguous' END,
    CASE WHEN s.hits <> 1 THEN s.rest[s.i + 1] END,
    CASE WHEN s.hits <> 1 THEN CASE WHEN s.last THEN 'file or folder' ELSE 'folder' END END
  FROM (
    SELECT t.*, coalesce(CASE WHEN t.last THEN x.items ELSE x.folders END, 0) AS hits,
           CASE WHEN t.last THEN x.item_child ELSE x.folder_child END AS child
    FROM (SELECT *, i + 1 = len(rest) AND {any_match} AS last FROM steps
          WHERE status IS NULL AND i < len(rest)) t
    LEFT JOIN idx x ON x.parent = t.at_folder AND x.lname = lower(t.rest[t.i + 1])
  ) s
),
results AS (
  SELECT path, CASE WHEN status IS NULL THEN at_folder END AS id,
         coalesce(status, 'ok') AS status, segment, kind,
         CASE WHEN status IS NOT NULL THEN at_folder END AS at_folder
  FROM steps WHERE status IS NOT NULL OR i >= len(rest)
)"""


PATH_SEEDS = """
seeds AS (
  SELECT path, rest, drive_id AS at_folder,
         CASE WHEN drive_id IS NULL THEN 'no_drive' END AS status,
         CASE WHEN drive_id IS NULL THEN parts[1] END AS segment,
         CASE WHEN drive_id IS NULL THEN 'drive' END AS kind
  FROM matched
)"""


def resolve(allow_files: bool) -> str:
    return f"""WITH RECURSIVE {FILES}, {REQUESTS}, {PREFIX}, {PATH_SEEDS},
{descend(allow_files)}
SELECT request, path, id, status, segment, kind, at_folder
FROM requests LEFT JOIN results USING (path)"""


SOURCES = """
sources AS (
  SELECT 's' || doc_id AS request, CASE doc_id % 4
    WHEN 0 THEN 'https://docs.google.com/document/d/T' || doc_id || '/edit'
    WHEN 1 THEN 'my drive/' || source || '/' || lang || '/doc_' || doc_id || '.' || lang || '.TXT'
    WHEN 2 THEN 'T' || doc_id
    ELSE 'https://drive.google.com/drive/my-drive' END AS source
  FROM documents
)"""
IS_URL = "(starts_with(source, 'http://') OR starts_with(source, 'https://'))"

# The grid in long form: one row per cell, positions from 0.
GRID = """
sheet AS (
  SELECT 'customers' AS tab, CAST(1 AS BIGINT) AS row_num,
         ['custkey', 'name', 'nation', 'segment', 'acctbal'] AS cells
  UNION ALL SELECT 'customers', c_custkey + 2, [CAST(c_custkey AS VARCHAR), c_name,
         CAST(c_nationkey AS VARCHAR), c_mktsegment, printf('%.2f', c_acctbal)] FROM customer
  UNION ALL SELECT 'suppliers', s_suppkey + 1, [CAST(s_suppkey AS VARCHAR), s_name]
         FROM supplier
)"""
SHEET_TEXT = "SELECT tab, row_num, array_to_string({0}, '|') AS cells FROM sheet {1}"

ORACLES: dict[str, str] = {
    "q_file_pages": f"""
SELECT 'O' || o_orderkey AS id, o_orderpriority AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN 'text/plain' END AS "mimeType",
  coalesce(nullif({SUFFIX.format("o_orderpriority")}, ''), 'unknown') AS file_type,
  CASE WHEN odd THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS modified, odd AS malformed,
  o_orderstatus || '@example.com' AS owner, '' AS shared_by,
  o_orderkey % 11 = 0 AS trashed
FROM (SELECT *, o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 AS odd FROM orders)""",
    "q_drives": f"WITH {DRIVES} SELECT id, type, name, url, ord FROM drives",
    "q_drive_catalog": """
SELECT 'ROOT' AS id, 'personal' AS type, 'My Drive' AS name,
  'https://drive.google.com/drive/my-drive' AS url, 0::BIGINT AS ord
UNION ALL SELECT 'C' || c_custkey, 'shared', c_name,
  'https://drive.google.com/drive/folders/C' || c_custkey, (c_custkey + 1)::BIGINT
FROM customer""",
    "q_snapshot": """
SELECT 'O' || o_orderkey AS id,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority || ' new' ELSE o_orderpriority END AS name,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN o_orderkey % 6 = 0 THEN 'Z' ELSE '' END AS "modifiedTime"
FROM orders
UNION ALL SELECT 'P' || p_partkey, p_name, NULL FROM part""",
    "q_rejects": """
WITH records AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CASE WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS bad_time,
    CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey || ' kB'
         WHEN o_orderkey % 19 = 0 THEN '1.5'
         WHEN o_orderkey % 23 = 0 THEN '90000000000000000000' END AS bad_size
  FROM orders
)
SELECT id, 'modifiedTime' AS field, bad_time AS value, 'no date' AS reason
FROM records WHERE bad_time IS NOT NULL
UNION ALL SELECT id, 'size', bad_size, 'no number of bytes' FROM records
WHERE bad_size IS NOT NULL
UNION ALL SELECT id, NULL, NULL, NULL FROM records
WHERE bad_time IS NULL AND bad_size IS NULL""",
    "q_save_listing": f"""WITH RECURSIVE {LISTING}
SELECT 'map' AS sink, repeat('  ', depth) || '- [' || name || '](' || url || ')' AS line
FROM listing
UNION ALL SELECT 'csv', concat_ws('|', regexp_replace(path, '/+$', ''), name, file_type,
  modified, owner, shared_by, url) FROM listing
UNION ALL SELECT 'csv', 'path|name|type|modified|owner|shared_by|url'""",
    "q_list_path": f"""WITH RECURSIVE {listing(
        "(SELECT 'N' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey "
        "WHERE r_name = 'ASIA' AND n_name = 'NATION_7')"
    )} SELECT * FROM listing""",
    "q_list_shared_path": f"""WITH RECURSIVE {listing("'S_src1'")} SELECT * FROM listing""",
    "q_children_edges": f"""WITH {FILES}
SELECT id, name, mime AS "mimeType" FROM edges WHERE parent = 'PARTS'""",
    "q_walk_edges": f"""WITH RECURSIVE {walk()}
SELECT id, name, array_to_string(ancestors, '/') AS ancestors, depth, descended FROM walk""",
    "q_manifest_depth2": f"""WITH RECURSIVE {manifest('out', 2)}
SELECT id, action, dir, base FROM manifest""",
    "q_safe_names": r"""
SELECT p_partkey, CASE p_partkey % 7
  WHEN 0 THEN '.._' || p_name || '_' || p_brand
  WHEN 1 THEN p_name || '_' || p_type
  WHEN 2 THEN '__' WHEN 3 THEN '_' WHEN 4 THEN 'file'
  WHEN 5 THEN '.' || p_name ELSE p_name END AS safe
FROM part""",
    "q_range_edits": f"""WITH {GRID}, writes AS (
  SELECT o_custkey + 1 AS row_num, 'c' AS col, o_orderpriority AS v, o_orderkey AS seq
  FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey + 2, 'c', lower(o_orderpriority), o_orderkey
  FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey + unnest([1, 2]), 'd', o_orderstatus, o_orderkey
  FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey + 2, 'ab', o_orderstatus, o_orderkey
  FROM orders WHERE o_orderkey % 2 = 1),
edits AS (
  SELECT row_num, max_by(v, seq) FILTER (WHERE col = 'c') AS c,
    max_by(v, seq) FILTER (WHERE col = 'd') AS d, max_by(v, seq) FILTER (WHERE col = 'ab') AS ab
  FROM writes GROUP BY ALL)
SELECT tab, s.row_num, CASE WHEN tab = 'suppliers' THEN array_to_string(cells, '|')
  ELSE array_to_string(cells[1:2], '|') || '|' || coalesce(c, cells[3]) || '|'
    || coalesce(d, cells[4]) || '|' || cells[5]
    || CASE WHEN ab IS NOT NULL THEN repeat('|', 23) || ab ELSE '' END END AS cells
FROM sheet s LEFT JOIN edits e ON e.row_num = s.row_num""",
    "q_grid_read": """
SELECT 'Sheet1' AS tab, p_partkey + 1 AS row_num,
  CASE WHEN p_partkey % 9 = 0 THEN ''
       WHEN p_partkey % 4 = 0 THEN p_brand || '|' || p_name || ', "x"|'
       ELSE p_partkey || '|' || p_type END AS cells
FROM part""",
    "q_grid_quoted": """
SELECT 'Sheet1' AS tab, row_number() OVER (ORDER BY p_partkey) AS row_num,
  CASE WHEN p_partkey % 9 = 0 THEN ''
       WHEN p_partkey % 4 = 0 THEN p_partkey || '|' || p_name || chr(10) || chr(10) || '"x", y'
       WHEN p_partkey % 4 = 1 THEN 'a' || chr(13) || chr(10) || p_brand || '",' || chr(10) || '|b"c|d'
       ELSE p_partkey || '|' || p_type || '|' END AS cells
FROM part""",
    "q_grid_write": """
SELECT p_partkey + 1 AS row_num,
  CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN '""'
       ELSE p_brand || ',"' || p_name || ', ""x""' || '",' END AS line
FROM part""",
    "q_listing_csv": f"""WITH RECURSIVE {LISTING}
SELECT rtrim(path, '/') AS path, name, file_type AS type, modified, owner, shared_by, url
FROM listing""",
    "q_folder_map": f"""WITH RECURSIVE {LISTING}
SELECT repeat('  ', depth) || '- [' || name || '](' || url || ')' AS line FROM listing""",
    "q_children": f"""WITH {FILES}
SELECT id, name, mime AS "mimeType" FROM edges WHERE parent = 'PARTS'""",
    "q_children_user": f"""WITH {FILES}
SELECT parent, id, name FROM edges WHERE drive_id IS NULL""",
    "q_shared": f"""WITH {FILES}
SELECT id, name, coalesce(sharer, '') AS shared_by FROM files
WHERE NOT trashed AND shared_time IS NOT NULL AND drive_id IS NULL""",
    "q_shared_named": f"""WITH {FILES}
SELECT id, name FROM files WHERE NOT trashed AND shared_time IS NOT NULL
AND drive_id IS NULL AND lower(name) = '1-urgent'""",
    "q_metadata": f"""WITH {FILES}
SELECT id, name, mime AS "mimeType" FROM files
WHERE id IN (SELECT 'O' || (l_orderkey * 2) FROM lineitem)""",
    "q_walk": f"""WITH RECURSIVE {walk()}
SELECT id, name, array_to_string(ancestors, '/') AS ancestors, depth, descended FROM walk""",
    "q_walk_depth2": f"""WITH RECURSIVE {walk(2)}
SELECT id, name, array_to_string(ancestors, '/') AS ancestors, depth, descended FROM walk""",
    "q_listing": f"WITH RECURSIVE {LISTING} SELECT * FROM listing",
    "q_shared_listing": f"""WITH {FILES}
SELECT {URL} AS url, name || CASE WHEN mime = {FOLDER} THEN '/' ELSE '' END AS path, name,
  {TYPE} AS file_type, coalesce(substr(modified, 1, 10), '') AS modified,
  coalesce(owner, '') AS owner, coalesce(sharer, '') AS shared_by, 0 AS depth
FROM files WHERE NOT trashed AND shared_time IS NOT NULL AND drive_id IS NULL""",
    "q_find_drive": f"""WITH {DRIVES}, names AS (
  SELECT c_custkey, (['asia', 'MY DRIVE', 'Europe', 'none', 'africa'])[c_custkey % 5 + 1] AS name
  FROM customer)
SELECT c_custkey, n.name, d.id AS drive_id, d.type AS drive_type, d.name AS drive_name,
  d.url AS drive_url
FROM names n LEFT JOIN drives d ON lower(d.name) = lower(n.name)""",
    "q_drive_prefix": f"""WITH {REQUESTS}, {PREFIX}
SELECT path, drive_id, drive_name, array_to_string(rest, '/') AS rest FROM matched""",
    "q_resolve": resolve(True),
    "q_resolve_folders": resolve(False),
    "q_resolve_shared": f"""WITH RECURSIVE {FILES},
requests AS (
  SELECT 'd' || doc_id AS request,
    CASE WHEN doc_id % 7 = 0 THEN source
         WHEN doc_id % 5 = 0 THEN upper(source) || '/' || lang
         WHEN doc_id % 3 = 0 THEN source || '/nope/' || lang
         ELSE source || '/' || lang || '/DOC_' || doc_id || '.' || lang || '.txt' END AS path
  FROM documents
  UNION ALL SELECT 'o' || o_orderkey, o_orderpriority || '/x' FROM orders
),
shared AS (
  SELECT lower(name) AS lname, count(*) AS items, min(id) AS item,
         bool_and(mime = {FOLDER}) AS folder
  FROM files WHERE NOT trashed AND shared_time IS NOT NULL AND drive_id IS NULL GROUP BY ALL
),
judged AS (
  SELECT path, parts, item, CASE WHEN items IS NULL THEN 'not_found'
         WHEN items > 1 THEN 'ambiguous'
         WHEN NOT (folder OR len(parts) = 1) THEN 'not_a_folder' END AS status
  FROM (SELECT path, string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/') AS parts
        FROM (SELECT DISTINCT path FROM requests))
  LEFT JOIN shared ON lower(parts[1]) = lname
),
seeds AS (
  SELECT path, parts[2:] AS rest, CASE WHEN status IS NULL THEN item END AS at_folder, status,
         CASE WHEN status IS NOT NULL THEN parts[1] END AS segment,
         CASE WHEN status IS NOT NULL THEN 'shared item' END AS kind
  FROM judged
),
{descend(True, "drive_id IS NULL")}
SELECT request, path, id, status, segment, kind FROM requests LEFT JOIN results USING (path)""",
    "q_ambiguous": f"""WITH {FILES}
SELECT * FROM (
  SELECT parent AS location, lower(name) AS lname, name, id,
    CASE WHEN mime = {FOLDER} THEN 'folder' ELSE 'file' END AS kind,
    coalesce(owner, 'unknown') AS owner,
    count(*) OVER (PARTITION BY parent, lower(name)) AS matches
  FROM edges) WHERE matches > 1""",
    "q_route": f"""WITH {SOURCES}
SELECT 'export' AS policy, request, source,
  CASE WHEN {IS_URL} THEN 'url' ELSE 'id' END AS route, {ID_IN.format("source")} AS id
FROM sources
UNION ALL SELECT 'download', request, source,
  CASE WHEN {IS_URL} THEN 'url' ELSE 'path' END,
  CASE WHEN {IS_URL} THEN {ID_IN.format("source")} END FROM sources
UNION ALL SELECT 'sheets', request, source,
  CASE WHEN {IS_URL} THEN 'url' WHEN contains(source, '/') THEN 'path' ELSE 'id' END,
  CASE WHEN {IS_URL} THEN {ID_IN.format("source")}
       WHEN NOT contains(source, '/') THEN source END FROM sources""",
    "q_sources": f"""WITH RECURSIVE {FILES}, {SOURCES},
requests AS (SELECT source AS path FROM sources WHERE contains(source, '/') AND NOT {IS_URL}),
{PREFIX}, {PATH_SEEDS}, {descend(True)}
SELECT request, source,
  CASE WHEN {IS_URL} THEN 'url' WHEN contains(source, '/') THEN 'path' ELSE 'id' END AS route,
  CASE WHEN {IS_URL} THEN {ID_IN.format("source")}
       WHEN contains(source, '/') THEN r.id ELSE source END AS id,
  CASE WHEN NOT {IS_URL} AND contains(source, '/') THEN r.status
       WHEN {ID_IN.format("source")} IS NULL THEN 'no_id_in_url' ELSE 'ok' END AS status
FROM sources LEFT JOIN results r ON r.path = source""",
    "q_links": f"""WITH links AS (
  SELECT unnest(['https://drive.google.com/file/d/T' || doc_id || '/view?usp=x',
    'https://drive.google.com/open?id=T' || doc_id,
    'https://drive.google.com/drive/folders/S_' || source]) AS link FROM documents
  UNION ALL SELECT url FROM pages),
read AS (SELECT {ID_IN.format("link")} AS id, {CANONICAL.format("link")} AS url FROM links)
SELECT id, min(url) AS url, count(*) AS n_links,
  CASE WHEN id IS NULL THEN 'no_id' ELSE 'ok' END AS status
FROM read GROUP BY id, CASE WHEN id IS NULL THEN url END""",
    "q_classify": f"""WITH {FILES}
SELECT id, {TYPE} AS file_type, {KIND} AS disposition FROM files WHERE mime <> {FOLDER}""",
    "q_summary": f"""WITH RECURSIVE {walk()},
kinds AS (SELECT *, CASE WHEN mime = {FOLDER} THEN 'folder' ELSE {KIND} END AS kind FROM walk),
totals AS (
  SELECT count(*) FILTER (WHERE kind = 'binary') AS binary_files,
    CAST(coalesce(sum(CASE WHEN kind = 'binary' AND regexp_full_match(size, '[0-9]+')
      THEN CAST(size AS BIGINT) END), 0) AS BIGINT) AS binary_bytes,
    count(*) FILTER (WHERE kind = 'export') AS auto_export,
    count(*) FILTER (WHERE kind = 'skip') AS skipped_natives,
    count(*) FILTER (WHERE kind = 'folder' AND descended) AS subfolders,
    count(*) FILTER (WHERE kind = 'folder' AND NOT descended) AS skipped_subfolders
  FROM kinds)
SELECT *, {size_text("binary_bytes")} AS size_text FROM totals""",
    "q_sizes": f"""
SELECT o_orderkey, {size_text("b")} AS size_text
FROM (SELECT o_orderkey, o_orderkey * CAST(2.0::DOUBLE ** (o_orderkey % 44) AS BIGINT) AS b
      FROM orders)""",
    "q_manifest": f"WITH RECURSIVE {manifest('out')} SELECT id, action, dir, base FROM manifest",
    "q_targets": f"""WITH RECURSIVE {manifest('.')}, {TARGETS}
SELECT id, action, dir, target FROM targets""",
    "q_targets_mixed": f"""WITH RECURSIVE {manifest('.')}, {TURNS}
SELECT id, CASE WHEN dir = '.' THEN '' ELSE dir || '/' END || name AS target
FROM placed WHERE turn > 0
UNION ALL SELECT id, NULL FROM mixed WHERE action NOT IN ('binary', 'export')""",
    "q_conflicts": f"""
SELECT r_name || '/' || n_name || '/' || c_name AS path,
  'a file with that name exists' AS error
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey % 10 = 0""",
    "q_export_plan": f"""WITH {SOURCES}, asked AS (
  SELECT s.*, 'out.d/' || lang ||
    (['.csv', '.DOCX', '.pptx', '.Xlsx', '.pdf', ''])[doc_id % 6 + 1] AS output
  FROM sources s JOIN documents ON request = 's' || doc_id),
planned AS (
  SELECT request, source, output, {ID_IN.format("source")} AS id,
    CASE lower(regexp_extract(output, '\\.[a-zA-Z]+$'))
      WHEN '.csv' THEN 'text/csv'
      WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
      WHEN '.pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation'
      WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
    END AS mime FROM asked)
SELECT *, CASE WHEN id IS NULL THEN 'no id in url'
  WHEN mime IS NULL THEN 'unsupported extension, use .csv, .docx, .pptx, .xlsx'
  ELSE 'ok' END AS status FROM planned""",
    "q_plan": f"""WITH RECURSIVE {manifest('out')}, {TARGETS}
SELECT action, count(*) AS entries, count(target) AS files, count(DISTINCT target) AS paths
FROM targets GROUP BY action""",
    "q_tabs": f"""WITH {GRID}
SELECT DISTINCT tab, CASE tab WHEN 'customers' THEN 0 ELSE 1 END AS tab_ord FROM sheet""",
    "q_range": f"""WITH {GRID}
{SHEET_TEXT.format("cells[2:4]", "WHERE tab = 'customers'")}""",
    "q_update_range": f"""WITH {GRID}
SELECT tab, row_num, CASE WHEN tab = 'customers' AND s_suppkey IS NOT NULL
    THEN array_to_string(cells[1:4], '|') || '|' || s_name || '|' || s_nationkey
    ELSE array_to_string(cells, '|') END AS cells
FROM sheet LEFT JOIN supplier ON s_suppkey + 3 = row_num""",
    "q_append": f"""WITH {GRID}
{SHEET_TEXT.format("cells", "")}
UNION ALL SELECT 'customers', (SELECT max(row_num) FROM sheet WHERE tab = 'customers')
  + s_suppkey + 1, s_name || '|' || s_nationkey FROM supplier""",
    "q_clear": f"""WITH {GRID}
{SHEET_TEXT.format("CASE WHEN tab = 'customers' AND row_num >= 2 THEN cells[1:3] ELSE cells END", "")}""",
    "q_apply_edits": f"""WITH {GRID}, edits AS (
  SELECT o_custkey + 2 AS row_num,
    max_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS even,
    max_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) AS odd
  FROM orders GROUP BY ALL)
SELECT tab, s.row_num, CASE WHEN tab = 'suppliers' THEN array_to_string(cells, '|')
  ELSE array_to_string(cells[1:3], '|') || '|' || coalesce(even, cells[4]) || '|' || cells[5]
    || CASE WHEN odd IS NOT NULL THEN '||' || odd ELSE '' END END AS cells
FROM sheet s LEFT JOIN edits e ON e.row_num = s.row_num""",
    "q_parse_cells": f"""WITH {GRID}, long AS (
  SELECT tab, row_num, CAST(unnest(range(len(cells))) AS INT) AS col_idx, unnest(cells) AS text
  FROM sheet)
SELECT tab, row_num, col_idx, text,
  CASE WHEN regexp_full_match(text, '-?[0-9]+') THEN TRY_CAST(text AS BIGINT) END AS as_long,
  CASE WHEN regexp_full_match(text, '-?[0-9.]+') THEN TRY_CAST(text AS DOUBLE) END AS as_double,
  CAST(NULL AS VARCHAR) AS as_date, starts_with(text, '-') AS formula_risk
FROM long WHERE text <> ''""",
    "q_find_rows": """
SELECT c_custkey + 2 AS row_num FROM customer
WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 7""",
    "q_table": """
SELECT c_custkey + 2 AS row_num, CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name,
  CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment,
  printf('%.2f', c_acctbal) AS acctbal FROM customer""",
    "q_set": f"""WITH {GRID}
{SHEET_TEXT.format("CASE WHEN tab = 'customers' AND cells[4] = 'MACHINERY' "
    "THEN list_concat(cells[1:3], ['TOOLS', '0.00']) ELSE cells END", "")}""",
    "q_set_edits": """
SELECT 'customers' AS tab, c_custkey + 2 AS row_num, col_idx,
  '''customers''!' || chr(65 + col_idx) || (c_custkey + 2) AS a1,
  CASE col_idx WHEN 4 THEN '0.00' ELSE 'TOOLS' END AS value,
  (c_custkey + 2) * 2 + (4 - col_idx) AS seq
FROM customer, (SELECT unnest([3, 4]) AS col_idx)
WHERE c_mktsegment = 'MACHINERY'""",
    "q_set_batch": """
SELECT o_orderkey AS seq, CASE WHEN n = 1 THEN 'ok' ELSE 'no_match' END AS status,
  coalesce(n, 0) AS n_rows
FROM orders LEFT JOIN (SELECT c_custkey, count(*) AS n FROM customer GROUP BY ALL)
  ON o_custkey = c_custkey
UNION ALL
SELECT -n_nationkey - 1, CASE WHEN coalesce(n, 0) = 0 THEN 'no_match'
  WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END, coalesce(n, 0)
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL)
  ON c_nationkey = n_nationkey
UNION ALL SELECT -s_suppkey - 1000, 'no_match', 0 FROM supplier""",
    "q_set_batch_grid": f"""WITH {GRID}, lone AS (
  SELECT c_nationkey FROM customer GROUP BY ALL HAVING count(*) = 1),
latest AS (
  SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY ALL)
SELECT tab, row_num, CASE WHEN tab = 'suppliers' OR row_num = 1 THEN array_to_string(cells, '|')
  ELSE array_to_string(cells[1:3], '|') || '|' || coalesce(value, cells[4]) || '|'
    || CASE WHEN c_nationkey IS NOT NULL THEN '0' ELSE cells[5] END END AS cells
FROM sheet LEFT JOIN latest ON tab = 'customers' AND o_custkey + 2 = row_num
LEFT JOIN lone ON tab = 'customers' AND row_num > 1 AND CAST(c_nationkey AS VARCHAR) = cells[3]""",
    "q_set_batch_edits": """
SELECT 'customers' AS tab, o_custkey + 2 AS row_num, 3 AS col_idx,
  '''customers''!D' || (o_custkey + 2) AS a1,
  max_by(o_orderpriority, o_orderkey) AS value, max(o_orderkey) AS seq
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey
UNION ALL
SELECT 'customers', c_custkey + 2, 4, '''customers''!E' || (c_custkey + 2), '0',
  -c_nationkey - 1
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY ALL HAVING count(*) = 1)""",
    "q_set_kinds": """
WITH alike AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT o_orderkey AS seq, CASE o_orderkey % 9
    WHEN 3 THEN CASE WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END
    WHEN 4 THEN 'unknown_match' WHEN 5 THEN 'unknown_target' WHEN 6 THEN 'no_updates'
    WHEN 8 THEN 'no_match' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 9 = 3 THEN n WHEN o_orderkey % 9 IN (0, 1, 2, 7) THEN 1 ELSE 0 END AS n_rows
FROM orders JOIN customer ON o_custkey = c_custkey JOIN alike USING (c_nationkey, c_mktsegment)""",
    "q_set_kinds_grid": f"""WITH {GRID},
alike AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
asked AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN alike USING (c_nationkey, c_mktsegment)),
written AS (
  SELECT c, k, 4 AS col, CASE WHEN k % 9 = 0 THEN p ELSE CAST(k AS VARCHAR) END AS v
  FROM asked WHERE k % 9 IN (0, 2)
  UNION ALL SELECT c, k, 5, CAST(k AS VARCHAR) FROM asked WHERE k % 9 IN (1, 7)
  UNION ALL SELECT c, k, 5, '0' FROM asked WHERE k % 9 = 3 AND n = 1
  UNION ALL SELECT c, k, 3, 'x' FROM asked WHERE k % 9 = 7),
latest AS (
  SELECT c, max_by(v, k) FILTER (col = 3) AS v3, max_by(v, k) FILTER (col = 4) AS v4,
    max_by(v, k) FILTER (col = 5) AS v5
  FROM written GROUP BY c)
SELECT tab, row_num, CASE WHEN tab = 'suppliers' OR row_num = 1 THEN array_to_string(cells, '|')
  ELSE array_to_string(cells[1:2], '|') || '|' || coalesce(v3, cells[3]) || '|'
    || coalesce(v4, cells[4]) || '|' || coalesce(v5, cells[5]) END AS cells
FROM sheet LEFT JOIN latest ON tab = 'customers' AND c + 2 = row_num""",
    "q_pairs": """
SELECT c_custkey,
  CASE WHEN c_custkey % 10 NOT IN (3, 7) THEN c_name END AS name,
  CASE WHEN c_custkey % 10 NOT IN (3, 7) THEN c_custkey || '=y ' END AS key,
  CASE WHEN c_custkey % 10 NOT IN (3, 7) THEN 2 END AS n,
  CASE c_custkey % 10 WHEN 3 THEN 'must be COLUMN=VALUE'
    WHEN 7 THEN 'empty column name' END AS error
FROM customer""",
}
