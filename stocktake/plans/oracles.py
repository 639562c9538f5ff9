"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-12-01'"

# The tables below are written out here, not imported, so that a wrong one in the library fails.
# fixed values: extensions of each category
CATEGORIES = {
    "Archives": "zip zipx rar 7z tar tgz gz bz bz2 tbz tbz2 xz txz zst tzst lz4",
    "Audio": "aif aiff flac m4a mp3 wav",
    "Databases": "db realm sqlite sqlite3",
    "Developer": "app bundle framework h json m mm pbxproj plist sh swift xcarchive xcodeproj xcworkspace yml yaml",
    "Documents": "csv doc docx key md numbers pages pdf ppt pptx rtf txt xls xlsx",
    "Fonts": "otf ttc ttf woff woff2",
    "Images": "gif heic jpeg jpg png psd raw tif tiff webp",
    "Installers": "dmg ipsw iso mpkg pkg sparsebundle sparseimage toast xip",
    "Video": "avi m4v mkv mov mp4 mpeg mpg wmv",
    "Virtual Machines": "qcow2 vbox vdi vhd vhdx vmdk vmwarevm pvm",
}
# fixed values: names and extensions of the cleanup rules, confidences and how they are shown
CACHE_NAMES = ("cache", "caches", ".cache")
BUILD_NAMES = ("deriveddata", "node_modules", ".build", "build", "dist", "target", ".gradle")
DISK_IMAGES = ("dmg", "iso", "toast", "sparsebundle", "sparseimage")
INSTALLERS = ("pkg", "mpkg", "xip", "ipsw")
ARCHIVES = ("zip", "zipx", "rar", "7z", "tar", "tgz", "gz", "bz", "bz2", "tbz", "tbz2", "xz", "txz", "zst", "tzst", "lz4")
TEMPORARY = ("tmp", "temp", "bak", "old")
CONFIDENCE_LABELS = {"high": "Verified", "medium": "Review", "review": "Manual"}
#: kind: (confidence, why it is listed)
TRUST = {
    "verifiedDuplicate": ("high", "Its bytes equal those of a kept file."),
    "oldLargeFile": ("review", "It is large and has long been unchanged."),
    "archive": ("review", "It is a compressed archive."),
    "installer": ("medium", "It is an installer package."),
    "diskImage": ("medium", "It is a disk image."),
    "cacheFolder": ("medium", "Its name is that of a cache."),
    "buildArtifact": ("medium", "Its name is that of build output."),
    "temporary": ("review", "Its name is that of a temporary or backup file."),
    "general": ("review", "It was picked by hand."),
}
#: Directories and endings of the inventory made of lineitem.
BUCKETS = ("Caches", "node_modules", "DerivedData", "Documents", "Media", ".hidden", "src", "Downloads")
ENDINGS = (".mov", ".mp4", ".zip", ".dmg", ".pkg", ".tmp", ".pdf", ".swift", ".JPG", ".sqlite", ".bin", "")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def anc(p: str) -> str:
    return f"CASE WHEN {p} = '/' THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, len(string_split({p}, '/'))), lambda i: CASE WHEN i = 1 THEN '/' ELSE array_to_string(list_slice(string_split({p}, '/'), 1, i), '/') END) END"


def self_anc(p: str) -> str:
    return f"list_append({anc(p)}, {p})"


def parent(p: str) -> str:
    return f"CASE WHEN {p} = '/' THEN NULL WHEN regexp_replace({p}, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace({p}, '/[^/]*$', '') END"


def base(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def ext(n: str) -> str:
    return f"nullif(lower(trim(regexp_extract({n}, '^.+\\.([^./]+)$', 1))), '')"


def nat(n: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({n}), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, CAST(greatest(20, length(p)) AS INT), '0') ELSE p END), '')"


def order(n: str) -> str:
    """The natural key in Unicode's order."""
    return f"icu_sort_key({nat(n)}, 'und')"


def category(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {e} IN {_in(words.split())} THEN '{c}'" for c, words in CATEGORIES.items()) + " ELSE 'Other' END"


def trust(kind: str, field: int) -> str:
    quote = lambda s: s.replace("'", "''")
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{quote(v[field])}'" for k, v in TRUST.items()) + " END"


def shown(confidence: str) -> str:
    return f"CASE {confidence} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONFIDENCE_LABELS.items()) + " END"


RANK = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"

CTES = {
    "where_": ((), "SELECT s_suppkey, '/' || r_name || '/' || n_name || '/' || s_name AS dir FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "inv0": (("where_",), f"SELECT dir || '/' || ({_list(BUCKETS)})[CAST(l_suppkey % 8 AS INT) + 1] || '/li-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || ({_list(ENDINGS)})[CAST(l_partkey % 12 AS INT) + 1] AS path, CAST(floor(l_quantity * 1000) AS BIGINT) AS byte_size, l_shipdate AS modified_at, l_partkey AS k FROM lineitem JOIN where_ ON l_suppkey = s_suppkey"),
    "inv": (("inv0",), f"SELECT path, {base('path')} AS name, {parent('path')} AS parent_path, 'file' AS kind, byte_size, ((byte_size + 4095) // 4096) * 4096 AS allocated_size, greatest(byte_size, ((byte_size + 4095) // 4096) * 4096) AS size, modified_at, k, {ext(base('path'))} AS ext FROM inv0"),
    "dirs": (("inv",), f"SELECT DISTINCT unnest({self_anc('parent_path')}) AS path FROM (SELECT DISTINCT parent_path FROM inv)"),
    "up": (("inv",), f"SELECT unnest({anc('path')}) AS path, byte_size, allocated_size FROM inv"),
    "rollup": (("up", "dirs"), f"SELECT u.path, u.logical, u.allocated, greatest(u.logical, u.allocated) AS size, coalesce(c.n, 0) AS children, u.files + coalesce(b.n, 0) AS descendants FROM (SELECT path, CAST(sum(byte_size) AS BIGINT) AS logical, CAST(sum(allocated_size) AS BIGINT) AS allocated, count(*) AS files FROM up GROUP BY path) u LEFT JOIN (SELECT path, count(*) AS n FROM (SELECT unnest({anc('path')}) AS path FROM dirs) GROUP BY path) b ON b.path = u.path LEFT JOIN (SELECT p AS path, count(*) AS n FROM (SELECT {parent('path')} AS p FROM dirs UNION ALL SELECT parent_path FROM inv) WHERE p IS NOT NULL GROUP BY p) c ON c.path = u.path"),
    "folders": (("rollup",), f"SELECT path, CASE WHEN path = '/' THEN '/' ELSE {base('path')} END AS name, size, {parent('path')} AS parent_path FROM rollup"),
    "nodes": (("folders", "inv"), "SELECT path, name, 'folder' AS kind, size, CAST(NULL AS TIMESTAMP) AS modified_at, parent_path FROM folders UNION ALL SELECT path, name, kind, size, modified_at, parent_path FROM inv"),
    "tree": (("nodes",), "SELECT path, any_value(name) AS name, CAST(sum(size) AS BIGINT) AS size FROM nodes GROUP BY path"),
    "numbered": (("nodes",), "SELECT path, row_number() OVER (ORDER BY path) AS n FROM (SELECT path FROM nodes UNION SELECT parent_path FROM nodes WHERE parent_path IS NOT NULL)"),
    "types": (("inv",), f"SELECT coalesce('.' || ext, 'No Extension') AS label, {category('ext')} AS category, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM inv GROUP BY 1, 2"),
    "doc": ((), "SELECT '/corpus/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc-' || doc_id || (['.txt', '.md', '.csv', ''])[CAST(doc_id % 4 AS INT) + 1] AS path, 'doc-' || doc_id || (['.txt', '.md', '.csv', ''])[CAST(doc_id % 4 AS INT) + 1] AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS byte_size, CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 1 END AS nlink, TIMESTAMP '2000-01-01' + to_days(CAST(doc_id % 900 AS INT)) AS modified_at, doc_id, coalesce(text, '') AS text FROM documents"),
    "cand": (("doc",), "SELECT * FROM doc WHERE nlink <= 1"),
    "sgroups": (("cand",), "SELECT byte_size, count(*) AS file_count, byte_size * count(*) AS total_bytes, byte_size * (count(*) - 1) AS reclaimable_bytes FROM cand GROUP BY byte_size HAVING count(*) > 1"),
    "members": (("cand",), "SELECT path, byte_size, sha256(text) AS checksum FROM cand QUALIFY count(*) OVER (PARTITION BY byte_size, sha256(text)) > 1"),
    "vgroups": (("members",), "SELECT byte_size || '-' || checksum AS group_id, byte_size, checksum, count(*) AS file_count, byte_size * (count(*) - 1) AS reclaimable_bytes, min(path) AS first_path FROM members GROUP BY byte_size, checksum"),
    "copies": (("members",), "SELECT path FROM members WHERE path NOT IN (SELECT min(path) FROM members GROUP BY checksum)"),
    "entries": (("nodes", "doc"), "SELECT path, name, kind, size, modified_at FROM nodes WHERE path <> '/' UNION ALL SELECT path, name, 'file', byte_size, modified_at FROM doc"),
    "ruled": (("entries",), f"SELECT *, CASE WHEN kind = 'folder' AND lower(name) IN {_in(CACHE_NAMES)} THEN 'cacheFolder' WHEN kind = 'folder' AND (lower(name) IN {_in(BUILD_NAMES)} OR contains(lower(path), '/deriveddata/')) THEN 'buildArtifact' WHEN kind <> 'file' THEN NULL WHEN {ext('name')} IN {_in(DISK_IMAGES)} THEN 'diskImage' WHEN {ext('name')} IN {_in(INSTALLERS)} THEN 'installer' WHEN {ext('name')} IN {_in(ARCHIVES)} THEN 'archive' WHEN {ext('name')} IN {_in(TEMPORARY)} OR name LIKE '%~' THEN 'temporary' WHEN size >= 49000 AND modified_at <= {AS_OF} - INTERVAL 180 DAY THEN 'oldLargeFile' END AS candidate_kind FROM entries"),
    "cands0": (("ruled", "copies"), "SELECT * FROM ruled WHERE candidate_kind IS NOT NULL AND path NOT IN (SELECT path FROM copies) UNION ALL SELECT * EXCLUDE (candidate_kind), 'verifiedDuplicate' FROM ruled WHERE path IN (SELECT path FROM copies)"),
    "cands": (("cands0",), f"SELECT candidate_kind || '-' || path AS candidate_id, candidate_kind, path, name, size, {trust('candidate_kind', 1)} AS reason, {trust('candidate_kind', 0)} AS confidence, size AS reclaimable_bytes FROM cands0"),
    "candtop": (("cands",), f"SELECT * FROM cands c WHERE NOT EXISTS (SELECT 1 FROM (SELECT path, unnest({anc('path')}) AS above FROM cands) u JOIN cands x ON x.path = u.above WHERE u.path = c.path)"),
    "sel": (("cands", "copies"), "SELECT path FROM cands UNION ALL SELECT path FROM copies"),
    "selup": (("sel",), f"SELECT path, unnest({anc('path')}) AS above FROM (SELECT DISTINCT path FROM sel)"),
    "nested": (("selup",), "SELECT path, max_by(above, length(above)) AS ancestor FROM selup WHERE above IN (SELECT path FROM sel) GROUP BY path"),
    "ident": (("doc",), "SELECT *, CASE WHEN nlink = 1 THEN 'disk0:' || doc_id || ':' || strftime(modified_at, '%Y-%m-%d %H:%M:%S') || ':2000-01-01 00:00:00' END AS identity FROM doc"),
    "cache": (("ident",), "SELECT path, doc_id, CASE WHEN doc_id % 5 = 0 THEN byte_size + 1 ELSE byte_size END AS byte_size, modified_at, identity, sha256(text) AS checksum FROM ident WHERE doc_id % 4 <> 0"),
    "now": (("snap_b", "doc", "dirs"), "SELECT path FROM snap_b UNION SELECT path FROM doc UNION SELECT path FROM dirs"),
    "live": (("cands", "now"), "SELECT * FROM cands WHERE path IN (SELECT path FROM now)"),
    "chg": (("where_",), "SELECT event_id, ts, dir AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'delete' WHEN 'error' THEN 'dropped' WHEN 'view' THEN 'noop' END AS change_type FROM events JOIN where_ ON user_id % (SELECT count(*) FROM supplier) = s_suppkey"),
    "snap_a": (("inv",), "SELECT path, byte_size, allocated_size, modified_at FROM inv WHERE k % 10 <> 0"),
    "snap_b": (("inv",), "SELECT path, CASE WHEN k % 10 = 2 THEN byte_size + 1 ELSE byte_size END AS byte_size, allocated_size, modified_at FROM inv WHERE k % 10 <> 1"),
    "diff": (("snap_a", "snap_b"), "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM snap_a a FULL JOIN snap_b b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.byte_size <> b.byte_size OR a.modified_at IS DISTINCT FROM b.modified_at OR a.allocated_size <> b.allocated_size"),
    "dirty0": (("chg", "dirs"), f"SELECT DISTINCT CASE WHEN path IN (SELECT path FROM dirs) THEN path ELSE {parent('path')} END AS path FROM chg WHERE change_type = 'delete'"),
    "dirty": (("dirty0",), f"SELECT path FROM dirty0 d WHERE NOT EXISTS (SELECT 1 FROM (SELECT path, unnest({anc('path')}) AS above FROM dirty0) u JOIN dirty0 x ON x.path = u.above WHERE u.path = d.path)"),
    "page": ((), "SELECT CASE WHEN p = '' THEN '/' ELSE p END AS path, arg_min(n, page_id) AS byte_size FROM (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, regexp_replace(regexp_replace('/' || regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS p FROM pages) GROUP BY 1"),
}


def sql(body: str, *names: str) -> str:
    """A query with the CTEs that it needs, in order."""
    order: list[str] = []

    def need(name):
        for below in CTES[name][0]:
            need(below)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + " " + body


TOTAL = "count(*) AS item_count, CAST(coalesce(sum(reclaimable_bytes), 0) AS BIGINT) AS reclaimable_bytes"


def _lane(order: int, name: str, cond: str) -> str:
    return f"SELECT {order} AS section_order, '{name}' AS section, {TOTAL} FROM (SELECT * FROM cands WHERE {cond}) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT path, unnest({anc('path')}) AS above FROM cands WHERE {cond}) u JOIN (SELECT path FROM cands WHERE {cond}) x ON x.path = u.above WHERE u.path = c.path)"


ORACLE_SQL = {
    "read_inventory": sql("SELECT path, name, parent_path, CAST(5 AS INT) AS depth, kind, byte_size, allocated_size, modified_at, name LIKE '.%' AS is_hidden FROM inv", "inv"),
    "read_inventory_pages": sql(f"SELECT path, {base('path')} AS name, {parent('path')} AS parent_path, byte_size FROM page", "page"),
    "read_contents": sql("SELECT path, byte_size AS content_bytes FROM doc WHERE byte_size IN (SELECT byte_size FROM doc GROUP BY 1 HAVING count(*) > 1)", "doc"),
    "read_changes": sql("SELECT * FROM chg WHERE event_id > 5000", "chg"),
    "scan_report": sql("SELECT (SELECT count(*) FROM inv) + (SELECT count(*) FROM dirs) AS scanned_items, CAST(0 AS BIGINT) AS inaccessible_count, (SELECT CAST(greatest(sum(byte_size), sum(allocated_size)) AS BIGINT) FROM inv) AS total_bytes, (SELECT CAST(sum(size) AS BIGINT) FROM inv) AS leaf_bytes, (SELECT count(*) FROM inv) AS file_count, (SELECT count(*) FROM dirs) AS folder_count, (SELECT count(*) FROM sgroups) AS size_groups, (SELECT CAST(sum(file_count) AS BIGINT) FROM sgroups) AS size_group_files, (SELECT count(*) FROM vgroups) AS verified_groups, (SELECT CAST(sum(reclaimable_bytes) AS BIGINT) FROM vgroups) AS verified_reclaimable, (SELECT count(*) FROM cands) AS candidates, (SELECT CAST(sum(reclaimable_bytes) AS BIGINT) FROM cands) AS candidate_bytes", "cands", "vgroups", "sgroups"),
    "display_size": sql("SELECT path, size FROM inv", "inv"),
    "path_parts": sql(f"SELECT path, {base('path')} AS base, {parent('path')} AS above, CAST(CASE WHEN path = '/' THEN 0 ELSE len(string_split(path, '/')) - 1 END AS INT) AS levels FROM page", "page"),
    "path_ancestors": sql(f"SELECT path, array_to_string({anc('path')}, '|') AS ancestors FROM page", "page"),
    "file_extension": sql("SELECT path, ext FROM inv", "inv"),
    "entry_kind": sql("SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'alias' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'package' WHEN doc_id % 3 = 0 THEN 'folder' WHEN doc_id % 5 <> 0 THEN 'file' ELSE 'other' END AS entry FROM doc", "doc"),
    "is_container": sql("SELECT kind, count(*) AS n FROM nodes WHERE kind IN ('folder', 'package') GROUP BY kind", "nodes"),
    "type_label": sql("SELECT path, coalesce('.' || ext, 'No Extension') AS label FROM inv", "inv"),
    "type_category": sql(f"SELECT path, {category('ext')} AS category FROM inv", "inv"),
    "relative_path": sql("SELECT path, CASE WHEN path = '/ASIA' THEN 'ASIA' WHEN starts_with(path, '/ASIA/') THEN path[7:] ELSE path END AS relative FROM inv", "inv"),
    "candidate_id": sql("SELECT 'general-' || path AS candidate_id FROM inv", "inv"),
    "group_id": sql("SELECT group_id FROM vgroups", "vgroups"),
    "confidence_rank": sql(f"SELECT candidate_id, {RANK} AS rank FROM cands", "cands"),
    "trust_details": sql(f"SELECT candidate_id, {shown('confidence')} AS confidence_label, {trust('candidate_kind', 1)} AS flagged_reason FROM cands", "cands"),
    "natural_key": sql(f"SELECT path, {nat('name')} AS natural FROM inv", "inv"),
    "content_sha256": sql("SELECT path, sha256(text) AS checksum FROM doc", "doc"),
    "prefix_sha256": sql("SELECT path, sha256(encode(text)[1:1024]) AS checksum FROM doc", "doc"),
    "file_identity": sql("SELECT path, identity FROM ident", "ident"),
    "redact_names": sql("SELECT path, 'File ' || row_number() OVER (ORDER BY path) || coalesce('.' || ext, '') AS redacted FROM inv", "inv"),
    "redact_tree": sql(
        """SELECT path, label AS redacted, coalesce('…/Folder ' || m || '/', '') || label AS redacted_path FROM (
        SELECT t.path, o.n, a.n AS m, CASE WHEN t.kind = 'folder' THEN 'Folder ' || o.n ELSE 'File ' || o.n || coalesce('.' || nullif(regexp_extract(t.name, '^.+\\.([^./]+)$', 1), ''), '') END AS label
        FROM nodes t JOIN numbered o ON o.path = t.path LEFT JOIN numbered a ON a.path = t.parent_path)""", "nodes", "numbered"),
    "redact_names_whole": sql("SELECT path, 'File ' || row_number() OVER (ORDER BY path) || coalesce('.' || ext, '') AS redacted FROM inv", "inv"),
    "redact_tokens": sql("SELECT path, 'File ' || substr(sha256('stocktake' || path), 1, 12) AS redacted FROM inv", "inv"),
    "size_share": sql("SELECT path, CAST(floor(least(greatest(size / greatest(max(size) OVER (), 1), 0.0), 1.0) * 1000000) AS BIGINT) AS share_ppm FROM (SELECT path, size FROM rollup WHERE path <> '/' ORDER BY size DESC, path LIMIT 100)", "rollup"),
    "size_share_root": sql("SELECT path, CAST(floor(least(greatest(size / greatest((SELECT size FROM folders WHERE path = '/'), 1), 0), 1) * 1000000) AS BIGINT) AS share_ppm FROM folders", "folders"),
    "filter_hidden": sql("SELECT path FROM inv WHERE NOT contains(path, '/.')", "inv"),
    "filter_excluded": sql("SELECT path FROM inv WHERE NOT contains(path, '/node_modules/') AND NOT starts_with(path, '/ASIA/CHINA/') AND NOT starts_with(path, '/EUROPE/x/')", "inv"),
    "filter_empty_other": sql("SELECT path FROM doc WHERE NOT (doc_id % 2 = 0 AND (doc_id % 4 = 0 OR byte_size = 0))", "doc"),
    "filter_size": sql("SELECT path FROM inv WHERE size >= 40000", "inv"),
    "search_items": sql("SELECT path FROM inv WHERE contains(lower(path), 'asia') AND contains(lower(path), 'zip')", "inv"),
    "filter_file_type": sql("SELECT path FROM inv WHERE ext = 'jpg'", "inv"),
    "filter_lane": sql("SELECT candidate_id FROM cands WHERE candidate_kind = 'verifiedDuplicate'", "cands"),
    "filter_candidates": sql("SELECT candidate_id FROM cands WHERE candidate_kind <> 'verifiedDuplicate' AND (reclaimable_bytes >= 100000 OR size >= 100000) AND (contains(lower(path), 'cache') OR contains(lower(reason), 'cache') OR contains(lower(candidate_kind), 'cache')) AND path NOT LIKE '%0/Caches'", "cands"),
    "filter_types": sql("SELECT label, category FROM types WHERE contains(lower(label), 'vid') OR contains(lower(category), 'vid')", "types"),
    "hardlink_filter": sql("SELECT path FROM cand", "cand"),
    "exclude_root": sql("SELECT path FROM dirs WHERE path <> '/'", "dirs"),
    "top_level": sql("SELECT DISTINCT path FROM sel WHERE path NOT IN (SELECT path FROM nested)", "nested"),
    "nested_pairs": sql("SELECT path, ancestor FROM nested", "nested"),
    "missing_targets": sql("SELECT DISTINCT path FROM sel WHERE path NOT IN (SELECT path FROM inv)", "sel"),
    "batch_preflight": sql("SELECT *, CASE WHEN duplicates > 0 THEN 'duplicates' WHEN missing > 0 THEN 'missing' WHEN nested > 0 THEN 'nested' ELSE 'ok' END AS verdict FROM (SELECT (SELECT count(path) - count(DISTINCT path) FROM sel) AS duplicates, (SELECT count(DISTINCT path) FROM sel WHERE path NOT IN (SELECT path FROM inv)) AS missing, (SELECT count(*) FROM nested) AS nested)", "nested"),
    "unverified_groups": sql("SELECT byte_size, count(*) AS file_count, byte_size * count(*) AS total_bytes, byte_size * (count(*) - 1) AS reclaimable_bytes FROM cand WHERE path NOT IN (SELECT path FROM members) GROUP BY byte_size HAVING count(*) > 1", "members"),
    "merge_verified": sql("SELECT checksum, file_count + CASE WHEN byte_size % 2 = 0 THEN 1 ELSE 0 END AS file_count, CASE WHEN byte_size % 2 = 0 THEN 'on_demand' ELSE 'scan' END AS origin FROM vgroups", "vgroups"),
    "visible_groups": sql("SELECT byte_size || '-' || checksum AS group_id, count(*) AS file_count FROM members WHERE byte_size >= 500 AND contains(lower(path), 'en') GROUP BY byte_size, checksum", "members"),
    "pick_keeper": sql("SELECT checksum, CASE WHEN checksum < '8' THEN max(path) ELSE min(path) END AS keeper FROM members GROUP BY checksum", "members"),
    "protect_keepers": sql(f"SELECT path FROM (SELECT path FROM members UNION ALL SELECT DISTINCT unnest({anc('path')}) AS path FROM doc) WHERE path NOT IN (SELECT unnest({self_anc('first_path')}) FROM vgroups)", "vgroups"),
    "cached_checksums": sql("SELECT i.path, CASE WHEN c.identity IS NOT DISTINCT FROM i.identity AND c.byte_size = i.byte_size THEN c.checksum END AS checksum, coalesce(c.identity IS NOT DISTINCT FROM i.identity AND c.byte_size = i.byte_size, false) AS hit FROM ident i LEFT JOIN cache c ON c.path = i.path", "cache"),
    "changed_targets": sql("SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'vanished' ELSE 'changed' END AS change FROM doc WHERE doc_id % 11 = 0 OR doc_id % 13 = 0", "doc"),
    "validate_copies": sql("SELECT m.path, (m.path NOT LIKE '%.md') AND m.checksum >= '4' AS valid FROM members m JOIN vgroups g ON g.checksum = m.checksum WHERE m.checksum < '4' OR m.path <> g.first_path", "vgroups"),
    "snapshot_diff": sql("SELECT path, change FROM diff", "diff"),
    "splice_subtrees": sql(f"SELECT path, byte_size FROM snap_a WHERE NOT list_has_any({self_anc('path')}, (SELECT list(path) FROM dirty)) UNION ALL SELECT path, byte_size FROM snap_b WHERE list_has_any({self_anc('path')}, (SELECT list(path) FROM dirty))", "snap_a", "snap_b", "dirty"),
    "dir_rollup": sql("SELECT * FROM rollup", "rollup"),
    "scan_summary": sql("SELECT count(*) + (SELECT count(*) FROM dirs) AS scanned_items, CAST(0 AS BIGINT) AS inaccessible_count, CAST(greatest(sum(byte_size), sum(allocated_size)) AS BIGINT) AS total_bytes, CAST(sum(size) AS BIGINT) AS leaf_bytes, count(*) AS file_count, (SELECT count(*) FROM dirs) AS folder_count FROM inv", "dirs"),
    "type_breakdown": sql("SELECT * FROM types", "types"),
    "category_breakdown": sql("SELECT category, CAST(sum(file_count) AS BIGINT) AS file_count, count(*) AS extension_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM types GROUP BY category", "types"),
    "filtered_categories": sql("SELECT category, CAST(sum(file_count) AS BIGINT) AS file_count, count(*) AS extension_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM types WHERE contains(lower(label), 'i') OR contains(lower(category), 'i') GROUP BY category", "types"),
    "type_rollup": sql("SELECT category, label, CAST(grouping(category, label) AS INT) AS level, CAST(sum(file_count) AS BIGINT) AS file_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM types GROUP BY ROLLUP (category, label)", "types"),
    "size_groups": sql("SELECT * FROM sgroups", "sgroups"),
    "size_group_pages": sql("SELECT byte_size, page, count(*) AS file_count, string_agg(path, '|' ORDER BY path) AS members FROM (SELECT byte_size, path, (row_number() OVER (PARTITION BY byte_size ORDER BY path) - 1) // 1000 AS page FROM cand WHERE byte_size IN (SELECT byte_size FROM sgroups)) GROUP BY byte_size, page", "sgroups"),
    "size_group_ids": sql("SELECT byte_size, byte_size || '-' || CASE WHEN count(*) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, chr(10) ORDER BY page)) END AS group_id FROM (SELECT byte_size, page, sha256(string_agg(path, chr(10) ORDER BY path)) AS digest FROM (SELECT byte_size, path, (row_number() OVER (PARTITION BY byte_size ORDER BY path) - 1) // 1000 AS page FROM cand WHERE byte_size IN (SELECT byte_size FROM sgroups)) GROUP BY byte_size, page) GROUP BY byte_size", "sgroups"),
    "verify_size": sql("SELECT path, byte_size, checksum FROM members WHERE byte_size = (SELECT byte_size FROM sgroups ORDER BY reclaimable_bytes DESC, byte_size DESC LIMIT 1)", "members", "sgroups"),
    "still_the_same": sql("SELECT m.path, m.byte_size, m.checksum FROM members m JOIN ident d ON d.path = m.path WHERE d.doc_id % 11 <> 0 AND d.doc_id % 13 <> 0 AND d.identity IS NOT NULL QUALIFY count(*) OVER (PARTITION BY m.byte_size, m.checksum) > 1", "members", "ident"),
    "verified_groups": sql("SELECT * FROM vgroups", "vgroups"),
    "already_verified": sql("SELECT c.byte_size, count(m.checksum) = count(*) AND coalesce(min(m.checksum) = max(m.checksum), false) AS verified FROM cand c LEFT JOIN members m ON m.path = c.path GROUP BY c.byte_size HAVING count(*) > 1", "members"),
    "verification_cost": sql("SELECT CAST(sum(least(byte_size, 1024) + CASE WHEN n > 1 AND byte_size > 1024 THEN byte_size ELSE 0 END) AS BIGINT) AS tiered_bytes, CAST(sum(byte_size) AS BIGINT) AS naive_bytes, count(*) AS files, count_if(n > 1 AND byte_size > 1024) AS full_reads FROM (SELECT byte_size, count(*) OVER (PARTITION BY byte_size, encode(text)[1:1024]) AS n, count(*) OVER (PARTITION BY byte_size) AS g FROM cand) WHERE g > 1", "cand"),
    "retention_stats": sql("SELECT count(*) AS considered, least(count(*), 5000) AS retained, greatest(count(*) - 5000, 0) AS dropped, count(*) > 5000 AS limit_reached FROM inv WHERE byte_size >= 20000", "inv"),
    "reclaim_total": sql(f"SELECT {TOTAL} FROM candtop", "candtop"),
    "verified_reclaim_total": sql("SELECT CAST(sum(reclaimable_bytes) AS BIGINT) AS reclaimable_bytes FROM vgroups WHERE byte_size >= 500", "vgroups"),
    "reclaim_plan": sql(f"SELECT * FROM ({_lane(1, 'verified', 'candidate_kind = ' + chr(39) + 'verifiedDuplicate' + chr(39))} UNION ALL {_lane(2, 'review', 'candidate_kind <> ' + chr(39) + 'verifiedDuplicate' + chr(39))} UNION ALL SELECT 3, 'access_gaps', count_if(byte_size % 1000 = 0), CAST(0 AS BIGINT) FROM inv) WHERE item_count > 0", "cands", "inv"),
    "reclaim_plan_present": sql(
        f"""SELECT *, CASE section WHEN 'verified' THEN 'review_verified_copies' WHEN 'review' THEN 'review_suggestions' ELSE 'inspect_unreadable' END AS action,
        section_order = min(section_order) OVER () AS is_primary, (SELECT count(*) FROM cands WHERE path NOT IN (SELECT path FROM now)) AS missing_count
        FROM (SELECT CASE WHEN candidate_kind = 'verifiedDuplicate' THEN 1 ELSE 2 END AS section_order, CASE WHEN candidate_kind = 'verifiedDuplicate' THEN 'verified' ELSE 'review' END AS section, {TOTAL}
              FROM live l WHERE NOT EXISTS (SELECT 1 FROM (SELECT path, unnest({anc('path')}) AS above FROM live) u JOIN live x ON x.path = u.above WHERE u.path = l.path) GROUP BY 1, 2
              UNION ALL SELECT 3, 'access_gaps', count_if(byte_size % 1000 = 0), CAST(0 AS BIGINT) FROM inv) WHERE item_count > 0""", "live", "inv"),
    "review_summary": sql(f"SELECT {TOTAL}, count_if(candidate_kind = 'verifiedDuplicate') AS verified_count, count_if(candidate_kind <> 'verifiedDuplicate') AS review_count, coalesce(bool_or(confidence = 'review'), false) AS has_review_risk FROM candtop", "candtop"),
    "largest_files": sql("SELECT path, size, CAST(row_number() OVER (ORDER BY size DESC, path) AS INT) AS rank FROM inv ORDER BY size DESC, path LIMIT 500", "inv"),
    "largest_folders": sql("SELECT path, size, CAST(row_number() OVER (ORDER BY size DESC, path) AS INT) AS rank FROM rollup WHERE path <> '/' ORDER BY size DESC, path LIMIT 500", "rollup"),
    "old_large_files": sql(f"SELECT path, size, modified_at, CAST(row_number() OVER (ORDER BY size DESC, path) AS INT) AS rank FROM inv WHERE size >= 40000 AND modified_at <= {AS_OF} - INTERVAL 180 DAY ORDER BY size DESC, path LIMIT 500", "inv"),
    "sort_items": sql("SELECT path, row_number() OVER (ORDER BY modified_at DESC NULLS LAST, path) AS rank FROM inv", "inv"),
    "sort_items_whole": sql("SELECT path, row_number() OVER (ORDER BY modified_at DESC NULLS LAST, path) AS rank FROM inv", "inv"),
    "cap_candidates": sql("SELECT path, byte_size FROM inv WHERE byte_size >= 20000 ORDER BY byte_size DESC, path LIMIT 5000", "inv"),
    "order_size_groups": sql("SELECT byte_size, row_number() OVER (ORDER BY total_bytes DESC, byte_size DESC) AS rank FROM sgroups", "sgroups"),
    "order_size_groups_whole": sql("SELECT byte_size, row_number() OVER (ORDER BY total_bytes DESC, byte_size DESC) AS rank FROM sgroups", "sgroups"),
    "order_verified_groups": sql("SELECT group_id, row_number() OVER (ORDER BY reclaimable_bytes DESC, byte_size DESC, checksum) AS rank FROM vgroups", "vgroups"),
    "order_verified_groups_whole": sql("SELECT group_id, row_number() OVER (ORDER BY reclaimable_bytes DESC, byte_size DESC, checksum) AS rank FROM vgroups", "vgroups"),
    "budget_groups": "WITH RECURSIVE " + sql("", "sgroups")[5:] + ", fit AS (SELECT *, row_number() OVER (ORDER BY reclaimable_bytes DESC, byte_size DESC) AS r FROM sgroups WHERE total_bytes <= 100000 AND file_count <= 60), walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS HUGEINT) AS b, CAST(0 AS HUGEINT) AS f, false AS kept UNION ALL SELECT fit.r, CASE WHEN b + total_bytes <= 100000 AND f + file_count <= 60 THEN b + total_bytes ELSE b END, CASE WHEN b + total_bytes <= 100000 AND f + file_count <= 60 THEN f + file_count ELSE f END, b + total_bytes <= 100000 AND f + file_count <= 60 FROM walk JOIN fit ON fit.r = walk.r + 1) SELECT byte_size, file_count FROM fit JOIN walk ON walk.r = fit.r WHERE kept",
    "cleanup_candidates": sql(f"SELECT candidate_id, confidence, reclaimable_bytes, CAST(row_number() OVER (ORDER BY {RANK}, reclaimable_bytes DESC, {order('name')}, path) AS INT) AS rank FROM cands ORDER BY rank LIMIT 500", "cands"),
    "top_children": sql("SELECT path, CAST(row_number() OVER (PARTITION BY parent_path ORDER BY size DESC, name, path) AS INT) AS rank FROM nodes WHERE path <> '/' QUALIFY rank <= 20", "nodes"),
    "overview_children": sql("SELECT path, size, CAST(row_number() OVER (ORDER BY size DESC, name) AS INT) AS rank FROM folders WHERE parent_path = '/' ORDER BY rank LIMIT 12", "folders"),
    "item_query_folders": sql(f"SELECT path, CAST(row_number() OVER (ORDER BY {order('name')}, path) AS INT) AS rank FROM (SELECT * FROM folders WHERE path <> '/' ORDER BY size DESC, path LIMIT 500) WHERE size >= 100000 AND contains(lower(path), 'asia')", "folders"),
    "item_query_old_files": sql(f"SELECT path, CAST(row_number() OVER (ORDER BY modified_at, path) AS INT) AS rank FROM (SELECT * FROM inv WHERE size >= 40000 AND modified_at <= {AS_OF} - INTERVAL 180 DAY ORDER BY size DESC, path LIMIT 500) WHERE size >= 45000 AND contains(lower(path), 'li-') AND ext = 'zip'", "inv"),
    "item_query_candidates": sql(f"SELECT path, row_number() OVER (ORDER BY size DESC, {order('name')}, path) AS rank FROM cands WHERE candidate_kind <> 'verifiedDuplicate' AND size >= 20000 AND contains(lower(path), 'europe')", "cands"),
    "item_query_duplicates": sql("SELECT path, row_number() OVER (ORDER BY modified_at DESC NULLS LAST, path) AS rank FROM doc WHERE path IN (SELECT path FROM members) AND byte_size >= 100 AND contains(path, 'corpus') AND name LIKE '%.txt'", "doc", "members"),
    "item_query": sql(f"SELECT path, CAST(row_number() OVER (ORDER BY size DESC, {order('name')}, path) AS INT) AS rank FROM inv WHERE size >= 10000 AND contains(lower(path), 'europe') AND contains(lower(path), 'documents') AND ext = 'pdf' ORDER BY rank LIMIT 500", "inv"),
    "preorder": sql(f"SELECT path, row_number() OVER (ORDER BY key) AS rank FROM (SELECT u.path, list({{'s': -f.size, 'n': f.name}} ORDER BY length(u.above)) AS key FROM (SELECT path, unnest({self_anc('path')}) AS above FROM folders) u JOIN folders f ON f.path = u.above GROUP BY u.path)", "folders"),
    "preorder_whole": sql(f"SELECT path, row_number() OVER (ORDER BY key) AS rank FROM (SELECT u.path, list({{'s': -f.size, 'n': f.name}} ORDER BY length(u.above)) AS key FROM (SELECT path, unnest({self_anc('path')}) AS above FROM tree) u JOIN tree f ON f.path = u.above GROUP BY u.path)", "tree"),
    "tree_search": sql(f"SELECT path, bool_or(direct) AS direct FROM (SELECT path, true AS direct FROM folders WHERE lower(name) LIKE '%caches%' UNION ALL SELECT unnest({anc('path')}), false FROM folders WHERE lower(name) LIKE '%caches%') GROUP BY path", "folders"),
    "latest_snapshots": "SELECT root, scanned_at, total_bytes, CAST(row_number() OVER (ORDER BY scanned_at DESC, root) AS INT) AS rank FROM (SELECT '/root-' || o_custkey % 40 AS root, o_orderdate AS scanned_at, CAST(floor(o_totalprice) AS BIGINT) AS total_bytes FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, floor(o_totalprice) DESC) = 1) ORDER BY rank LIMIT 8",
    "purge_cache": sql("SELECT path FROM cache WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0", "cache"),
    "dirty_subtrees": sql("SELECT path FROM dirty", "dirty"),
    "ignored_candidates": sql("SELECT candidate_id FROM cands WHERE candidate_kind = 'archive'", "cands"),
    "fallback_reason": "SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'missing' WHEN user_id % 11 = 0 THEN 'corrupt' WHEN user_id % 17 = 0 THEN 'schema' WHEN user_id % 19 = 0 THEN 'root' WHEN user_id % 7 = 0 THEN 'volume' WHEN user_id % 5 = 0 THEN 'options' WHEN event_type = 'error' OR user_id % 23 = 0 THEN 'history' WHEN user_id % 29 = 0 THEN 'inconsistent' WHEN user_id % 300 > 128 THEN 'too_many_dirty' END AS reason FROM events",
    "tree_consistency": sql("SELECT *, orphans = 0 AND repeated = 0 AS sound FROM (SELECT (SELECT count(*) FROM kept WHERE path <> '/' AND parent_path NOT IN (SELECT path FROM kept WHERE kind = 'folder')) AS orphans, (SELECT count(*) FROM (SELECT path FROM kept GROUP BY path HAVING count(*) > 1)) AS repeated)", "nodes").replace(" SELECT *, orphans", ", kept AS (SELECT * FROM nodes WHERE path NOT LIKE '%3/src') SELECT *, orphans", 1),
    "trust_verify": sql("SELECT count(*) AS differences, count(*) = 0 AS trusted FROM diff", "diff"),
    "dedupe_changes": sql("SELECT path, arg_max(change_type, (ts, event_id)) AS change_type, count(*) AS reports FROM chg GROUP BY path", "chg"),
    "changes_per_window": sql("SELECT date_trunc('hour', ts) AS window_start, change_type, count(*) AS changes FROM chg GROUP BY 1, 2", "chg"),
}
