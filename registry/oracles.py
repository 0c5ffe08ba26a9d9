"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

NOW, PAGES, CHATS = 1800000000, 100, 101
OLD = 1700000000

FILES = """
docs as (
  select doc_id as file_id, cast(substr(source, 4) as bigint) as volume_id, source || '/' as volume,
    lang || '/' || case when doc_id % 17 = 0 then '$Recycle.Bin/' else '' end || 'doc' || cast(doc_id as varchar)
      || case doc_id % 5 when 0 then '.txt' when 1 then '.TXT' when 2 then '.log' when 3 then '.tar.gz' else '' end as path_rel,
    'doc' || cast(doc_id as varchar)
      || case doc_id % 5 when 0 then '.txt' when 1 then '.TXT' when 2 then '.log' when 3 then '.tar.gz' else '' end as filename,
    case doc_id % 5 when 0 then 'txt' when 1 then 'txt' when 2 then 'log' when 3 then 'gz' end as extension,
    cast(octet_length(encode(text)) as bigint) as size,
    1704067200 + doc_id * 60 as modified,
    cast((case when doc_id % 7 = 0 then 2 else 0 end) + (case when doc_id % 11 = 0 then 4 else 0 end) as bigint) as attributes,
    case when doc_id % 13 = 0 then 1 else 0 end as is_deleted,
    cast(doc_id % 3 as integer) as hash_status, text as content
  from documents
)"""

HASHED = FILES + """,
hashed as (
  select file_id, volume_id, volume, path_rel, filename, extension, size, modified, attributes, is_deleted,
    case when size > 0 then sha256(encode(content)[1:4096]) end as partial_hash,
    case when size > 0 then sha256(encode(content)) end as full_hash,
    case when size > 0 then 2 else 0 end as hash_status
  from docs
)"""

PAGE_FILES = """,
page_files as (
  select 1000000000000 + page_id as file_id, cast(100 as bigint) as volume_id, 'pages/' as volume,
    'page' || cast(page_id as varchar) || '.html' as path_rel,
    'page' || cast(page_id as varchar) || '.html' as filename, 'html' as extension,
    cast(octet_length(encode(html)) as bigint) as size, 1704067200 + page_id as modified,
    cast(null as bigint) as attributes, 0 as is_deleted,
    case when octet_length(encode(html)) > 0 then sha256(encode(html)[1:4096]) end as partial_hash,
    case when octet_length(encode(html)) > 0 then sha256(encode(html)) end as full_hash,
    case when octet_length(encode(html)) > 0 then 2 else 0 end as hash_status
  from pages
)"""

PRIOR = HASHED + PAGE_FILES + """,
prior as (
  select *, cast(1700000000 as bigint) as indexed_at, cast(1700000000 as bigint) as last_verified
  from (select * from hashed union all by name select * from page_files)
)"""

VOLUMES = """
vols as (
  select distinct cast(substr(source, 4) as bigint) as id, source || '/' as path, 1 as volume_type from documents
  union all select cast(100 as bigint), 'pages/', 0
  union all select cast(101 as bigint), 'conversations/', 0
)"""

GROUPS = """,
dup as (
  select 2 as hash_type, full_hash as hash_value, size, count(*) as file_count,
    cast(size * count(*) as bigint) as total_size
  from hashed where is_deleted = 0 and full_hash is not null
  group by full_hash, size having count(*) > 1
),
top_dup as (select * from dup order by total_size desc, hash_value, size limit 50),
cand as (
  select 1 as hash_type, partial_hash as hash_value, size, count(*) as file_count,
    cast(size * count(*) as bigint) as total_size
  from hashed where is_deleted = 0 and partial_hash is not null
  group by partial_hash, size having count(*) > 1
),
top_cand as (select * from cand order by file_count desc, size desc, hash_value limit 50)"""

UPSERT = PRIOR + """,
scan as (
  select volume_id, path_rel, filename, extension, size,
    case when file_id % 20 = 10 then cast(null as bigint)
         when file_id % 2 = 0 then modified + 3600 else modified end as modified, attributes
  from docs
  union all
  select cast(101 as bigint), 'conv' || cast(conv_id as varchar) || '/turn' || cast(turn as varchar) || '.' || role,
    'turn' || cast(turn as varchar) || '.' || role, role, cast(octet_length(encode(text)) as bigint),
    1704067200 + conv_id, cast(null as bigint)
  from conversations
),
upserted as (
  select o.file_id, coalesce(o.volume_id, n.volume_id) as volume_id, coalesce(o.path_rel, n.path_rel) as path_rel,
    coalesce(o.filename, n.filename) as filename,
    case when o.file_id is null then n.extension else o.extension end as extension,
    case when n.path_rel is null then 'unchanged' when o.path_rel is null then 'inserted'
         when o.modified is not null and o.modified = coalesce(n.modified, 0) then 'verified' else 'reset' end as action,
    o.size as o_size, n.size as n_size, o.attributes as o_attributes, n.attributes as n_attributes,
    o.modified as o_modified, n.modified as n_modified, o.partial_hash as o_partial, o.full_hash as o_full,
    o.hash_status as o_status, o.indexed_at as o_indexed, o.last_verified as o_verified, o.is_deleted as o_deleted
  from prior o full outer join scan n on o.volume_id = n.volume_id and o.path_rel = n.path_rel
),
upserted_rows as (
  select file_id, volume_id, path_rel, filename, extension,
    case action when 'unchanged' then o_size else n_size end as size,
    cast(null as bigint) as created,
    case when action in ('verified', 'unchanged') then o_modified else n_modified end as modified,
    cast(null as bigint) as accessed,
    case action when 'unchanged' then o_attributes else n_attributes end as attributes,
    case when action in ('verified', 'unchanged') then o_partial end as partial_hash,
    case when action in ('verified', 'unchanged') then o_full end as full_hash,
    case when action in ('verified', 'unchanged') then o_status else 0 end as hash_status,
    case action when 'inserted' then cast(1800000000 as bigint) else o_indexed end as indexed_at,
    case action when 'unchanged' then o_verified else cast(1800000000 as bigint) end as last_verified,
    cast(null as bigint) as usn,
    case action when 'unchanged' then o_deleted else 0 end as is_deleted, action
  from upserted
)"""

IGNORED = """,
ignored as (
  select volume_id, '' as path, 'bad_key' as reason, cast(1800000000 as bigint) as indexed_at
  from docs where attributes = 6 and is_deleted = 0
)"""

FEED = """,
feed as (
  select event_id as pos, user_id % 20 as volume_id, 'home/user' || cast(user_id as varchar) || '.dat' as path_rel,
    cast(floor(value) as bigint) as size,
    case when user_id % 3 = 0 then cast(1704067200 as bigint)
         when user_id % 3 = 1 and event_type = 'signup' then cast(null as bigint)
         else cast(epoch(date_trunc('day', ts)) as bigint) end as modified,
    cast(case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2
         when 'purchase' then 4 else 6 end as bigint) as attributes
  from events
),
half_way as (
  select v.id, v.path, f.last_usn from vols v left join (
    select volume_id, cast(floor(max(pos) / 2.0) as bigint) as last_usn from feed group by volume_id
  ) f on f.volume_id = v.id
)"""

FEED_STATE = """,
ranked as (
  select *, row_number() over (partition by path_rel order by pos) as first_no,
    row_number() over (partition by path_rel order by pos desc) as last_no
  from feed
),
firsts as (select * from ranked where first_no = 1),
lasts as (select * from ranked where last_no = 1),
spans as (
  select path_rel, min(coalesce(modified, 0)) as low, max(coalesce(modified, 0)) as high from feed group by path_rel
),
users as (
  select f.*, l.pos as l_pos, l.size as l_size, l.modified as l_modified, l.attributes as l_attributes,
    case when l.pos = f.pos then 'unchanged'
         when f.modified is not null and s.low = f.modified and s.high = f.modified then 'verified'
         else 'reset' end as action
  from firsts f join lasts l using (path_rel) join spans s using (path_rel)
),
feed_rows as (
  select 2000000000000 + pos as file_id, volume_id, path_rel,
    split_part(path_rel, '/', 2) as filename, 'dat' as extension,
    l_size as size, cast(null as bigint) as created,
    case action when 'reset' then l_modified else modified end as modified,
    cast(null as bigint) as accessed, l_attributes as attributes,
    case when action <> 'reset' then sha256(path_rel) end as partial_hash,
    case when action <> 'reset' then sha256(path_rel) end as full_hash,
    case when action <> 'reset' then 2 else 0 end as hash_status,
    cast(1700000000 as bigint) as indexed_at,
    case action when 'unchanged' then cast(1700000000 as bigint) else cast(1800000000 as bigint) end as last_verified,
    l_pos as usn, 0 as is_deleted, action
  from users
  union all
  select file_id, volume_id, path_rel, filename, extension, size, cast(null as bigint), modified, cast(null as bigint),
    attributes, partial_hash, full_hash, hash_status, cast(1700000000 as bigint), cast(1700000000 as bigint),
    cast(null as bigint), is_deleted, 'unchanged'
  from hashed
)"""

CHECKS = HASHED + "," + VOLUMES + IGNORED + FEED + """,
facts as (
  select (select count(*) from vols where path = 'src3/') as n_volumes,
    (select coalesce(max(pos), 0) from feed where volume_id = 3) as usn,
    (select count(*) from hashed where volume_id = 3 and is_deleted = 0) as alive_files,
    (select count(*) from hashed where volume_id = 3 and is_deleted = 0 and hash_status >= 2) as hashed_files,
    (select count(*) from (select 1 from hashed where is_deleted = 0 and full_hash is not null group by full_hash, size having count(*) > 1)) as n_groups,
    (select coalesce(max(n), 0) from (select count(*) as n from hashed where is_deleted = 0 and full_hash is not null group by full_hash, size having count(*) > 1)) as n_members,
    (select count(*) from ignored where volume_id = 3) as n_ignored
),
check_rows as (
  select 0 as ordinal, 'db_integrity' as name, 10 as code, true as passed, 'violations: 0' as detail
  union all select 1, 'volume_exists', 11, n_volumes > 0, 'volumes found: ' || n_volumes from facts
  union all select 2, 'files_count', 12, alive_files >= 1 and alive_files <= 2, 'alive files: ' || alive_files from facts
  union all select 3, 'hashes', 13, case when alive_files > 0 then hashed_files * 100 // alive_files else 0 end >= 100,
    'hashed: ' || hashed_files || '/' || alive_files || ' (' ||
    case when alive_files > 0 then hashed_files * 100 // alive_files else 0 end || '%)' from facts
  union all select 4, 'dup_groups', 14, n_groups = 99, 'groups: ' || n_groups from facts
  union all select 5, 'dup_members', 15, n_members >= 2, 'largest group: ' || n_members from facts
  union all select 6, 'usn_stored', 16, usn > 0, 'last position: ' || usn from facts
  union all select 7, 'ignored', 17, n_ignored <= 0, 'ignored: ' || n_ignored from facts
)"""


def _stage(ordinal: int, name: str, keys: str, condition: str) -> str:
    return (
        f"select {ordinal} as ordinal, '{name}' as stage, count(*) as group_count, "
        "cast(coalesce(sum(n), 0) as bigint) as file_count, "
        "cast(coalesce(sum(n * size), 0) as bigint) as total_size from "
        f"(select size, count(*) as n from hashed where is_deleted = 0 and {condition} group by {keys}) "
    )


_FUNNEL = " union all ".join([
    _stage(0, "all", "size", "true"),
    _stage(1, "size", "size", "true") + "where n > 1",
    _stage(2, "prefix", "size, partial_hash", "partial_hash is not null") + "where n > 1",
    _stage(3, "full", "size, partial_hash, full_hash", "full_hash is not null") + "where n > 1",
])

_MEMBERS = """
select g.hash_type, g.hash_value, g.size, g.file_count, g.total_size, f.file_id, f.size as member_size,
  f.path_rel, f.volume || f.path_rel as path
from {groups} g join hashed f on f.{column} = g.hash_value {same_size} where f.is_deleted = 0"""

_UPSERT_COLUMNS = "select * from upserted_rows"

ORACLES: dict[str, str] = {
    "dup_groups": f"with {HASHED}{GROUPS} select * from top_dup",
    "dup_groups_all": f"""with {PRIOR} select 2 as hash_type, full_hash as hash_value, size, count(*) as file_count,
        cast(size * count(*) as bigint) as total_size from prior
        where is_deleted = 0 and full_hash is not null group by full_hash, size having count(*) > 1""",
    "dup_candidates": f"with {HASHED}{GROUPS} select * from top_cand",
    "dup_members": f"with {HASHED}{GROUPS}" + _MEMBERS.format(
        groups="top_dup", column="full_hash", same_size="and f.size = g.size"),
    "dup_members_all": f"with {HASHED}{GROUPS}" + _MEMBERS.format(
        groups="dup", column="full_hash", same_size="and f.size = g.size"),
    "dup_nested": f"""with {HASHED}{GROUPS} select g.hash_value, g.file_count,
        cast(row_number() over (partition by g.hash_value, g.size order by f.path_rel, f.file_id) - 1 as integer) as position,
        f.file_id, f.volume || f.path_rel as path
        from dup g join hashed f on f.full_hash = g.hash_value and f.size = g.size where f.is_deleted = 0""",
    "candidate_members": f"with {HASHED}{GROUPS}" + _MEMBERS.format(
        groups="top_cand", column="partial_hash", same_size="and f.size = g.size"),
    "candidate_members_by_hash": f"with {HASHED}{GROUPS}" + _MEMBERS.format(
        groups="top_cand", column="partial_hash", same_size=""),
    "dup_group_count": f"with {HASHED}{GROUPS} select count(*) as dup_groups from dup",
    "dup_max_members": f"with {HASHED}{GROUPS} select coalesce(max(file_count), 0) as max_members from dup",
    "same_size_groups": f"""with {FILES} select size, count(*) as file_count, cast(size * count(*) as bigint) as total_size
        from docs where is_deleted = 0 group by size having count(*) > 1""",
    "funnel_report": f"with {HASHED} {_FUNNEL}",
    "funnel_survivors": f"""with {HASHED} select file_id, size, partial_hash from (
        select *, count(*) over (partition by size, partial_hash) as n from hashed where is_deleted = 0 and size > 0
        ) where n > 1""",
    "dup_materialised": f"""with {HASHED}{GROUPS} select g.*, cast({NOW} as bigint) as created_at, f.file_id
        from dup g join hashed f on f.full_hash = g.hash_value and f.size = g.size where f.is_deleted = 0""",
    "index_stats": f"""with {HASHED}, {VOLUMES}{IGNORED}
        select 'files' as metric, count(*) as value from hashed where is_deleted = 0
        union all select 'hashed_partial', count(partial_hash) from hashed where is_deleted = 0
        union all select 'hashed_full', count(full_hash) from hashed where is_deleted = 0
        union all select 'volumes', count(*) from vols
        union all select 'ignored', count(*) from ignored""",
    "alive_by_volume": f"with {FILES} select volume_id, count(*) as file_count from docs where is_deleted = 0 group by volume_id",
    "hashed_count": f"with {FILES} select count(*) as hashed_files from docs where is_deleted = 0 and hash_status >= 1",
    "hashed_pct": f"""with {FILES} select count(*) as alive_files, count(*) filter (where hash_status >= 2) as hashed_files,
        case when count(*) > 0 then count(*) filter (where hash_status >= 2) * 100 // count(*) else 0 end as hashed_pct
        from docs where is_deleted = 0""",
    "ignored_counts": f"""with {FILES}{IGNORED} select volume_id, reason, count(*) as ignored_count
        from ignored group by volume_id, reason""",
    "hash_backlog": f"""with {FILES} select file_id, volume || path_rel as path, size from docs
        where is_deleted = 0 and hash_status < 2 order by size desc, file_id limit 100000""",
    "largest_files": f"""with {FILES} select file_id, volume_id, path_rel, size from docs
        where is_deleted = 0 order by size desc, file_id limit 50""",
    "export_rows": f"""with {PRIOR} select file_id as id, volume, path_rel as path, filename, extension, size, modified,
        partial_hash, full_hash, hash_status, is_deleted from prior""",
    "export_csv_roundtrip": f"""with {HASHED} select file_id as id, volume, path_rel as path, filename, extension, size,
        modified, partial_hash, full_hash, hash_status, is_deleted from hashed""",
    "include_exclude": f"""with {FILES} select file_id, filename from docs
        where (filename glob '*.txt' or filename glob 'doc?[0-4]*')
        and not (filename glob '*[!0-9].gz' or filename glob '*7.txt')""",
    "extension_filter": f"""with {FILES} select file_id, filename from docs
        where extension is null or ((extension glob 't?t' or extension glob 'g*') and extension <> 'gz')""",
    "attribute_filter": f"with {FILES} select file_id, attributes from docs where attributes & 6 = 0",
    "skip_dirs": f"""with {FILES} select file_id, path_rel from docs
        where not list_has_any(string_split(lower(path_rel), '/'),
          ['$recycle.bin', 'system volume information', '$windows.~bt', '$windows.~ws'])""",
    "inventory_scan": f"""with {FILES} select volume_id, path_rel, filename, extension, size, cast(null as bigint) as created,
        modified, cast(null as bigint) as accessed, attributes from docs
        where is_deleted = 0 and filename glob '*.txt' and attributes & 6 = 0
        and not list_contains(string_split(lower(path_rel), '/'), '$recycle.bin')""",
    "extensions": """with named as (
        select page_id, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) as name from pages)
        select page_id, case when regexp_matches(name, '^.+\\.([^.]*)$')
          then lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) end as extension from named""",
    "root_normalise": """with roots as (select doc_id, trim(case doc_id % 4 when 0 then substr(lang, 1, 1)
          when 1 then substr(lang, 1, 1) || ':' when 2 then '  ' || source || ' ' else lang end) as root from documents)
        select doc_id, case when regexp_full_match(root, '[A-Za-z]') then upper(root) || ':\\'
          when octet_length(encode(root)) = 2 and root like '%:' then upper(root) || '\\' else root end as root from roots""",
    "rel_path": """select page_id, ltrim(substr(replace(url, '\\', '/'), 7), '/') as path_rel
        from pages where replace(url, '\\', '/') like 'https:/%'""",
    "absolute_paths": f"with {FILES} select file_id, volume || path_rel as path from docs",
    "times": "select event_id, greatest(cast(floor(epoch(ts)) as bigint), 0) as seconds from events",
    "hex_values": "select event_id, lower(hex(encode(props))) as props_hex from events",
    "fingerprints": f"with {HASHED} select file_id, size, partial_hash, full_hash, hash_status from hashed",
    "upsert_index": f"with {UPSERT} {_UPSERT_COLUMNS}",
    "upsert_counted": f"with {UPSERT} {_UPSERT_COLUMNS}",
    "upsert_actions": f"with {UPSERT} select action, count(*) as row_count from upserted_rows group by action",
    "upsert_sweep": f"""with {UPSERT} select a as action, d as is_deleted, count(*) as row_count from (
        select case when action = 'unchanged' and o_deleted = 0 then 'missing'
                    when action = 'verified' and o_size <> n_size then 'reset' else action end as a,
               case when action = 'unchanged' then 1 else 0 end as d
        from upserted) group by a, d""",
    "revive": f"""with {UPSERT} select u.file_id, u.path_rel, u.action from upserted_rows u join prior p using (file_id)
        where u.is_deleted = 0 and p.is_deleted = 1""",
    "volume_upsert": f"""with {VOLUMES},
        seen as (
          select source || '/' as path, 2 as volume_type,
            case when source || '/' < 'src2' then min(lang) end as label from documents group by source
          union all select distinct lang || '/', 3, null from documents)
        select coalesce(v.path, s.path) as path, coalesce(v.volume_type, s.volume_type) as volume_type,
          coalesce(s.label, 'disk ' || v.path) as label,
          case when v.path is null then cast({NOW} as bigint) else cast({OLD} as bigint) end as indexed_at,
          case when s.path is null then cast({OLD} as bigint) else cast({NOW} as bigint) end as last_scan,
          cast(null as bigint) as last_usn
        from vols v full outer join seen s on v.path = s.path""",
    "soft_delete": f"""with {FILES} select file_id, volume_id,
        case when volume_id = 3 then 1 else is_deleted end as is_deleted from docs""",
    "hash_writeback": f"""with {HASHED} select d.file_id,
        case when d.hash_status < 2 and d.is_deleted = 0 then h.partial_hash end as partial_hash,
        case when d.hash_status < 2 and d.is_deleted = 0 then h.full_hash end as full_hash,
        case when d.hash_status < 2 and d.is_deleted = 0 and h.full_hash is not null then 2 else d.hash_status end as hash_status,
        d.is_deleted from docs d join hashed h using (file_id)""",
    "run_log_latest": """select user_id as run_id, user_id % 20 as volume_id, event_id as seq,
        cast(floor(value) as bigint) as files_scanned,
        case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'running' end as status,
        case when event_type = 'error' then props end as error_message
        from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1""",
    "tags_upsert": f"""with {FILES} select d.file_id, d.path_rel, t.name from docs d join (
        select doc_id as file_id, lang as name from documents
        union select doc_id, 'quality' from labels where quality = 1
        union select doc_id, 'toxic' from labels where toxic = 1) t using (file_id)""",
    "check_results": f"with {CHECKS} select * from check_rows",
    "check_code": f"""with {CHECKS} select count(*) filter (where passed) as passed, count(*) as total,
        coalesce(arg_min(code, ordinal) filter (where not passed), 0) as code from check_rows""",
    "integrity_checks": f"""with {PRIOR}, {VOLUMES}, marked as (
          select * replace (case when volume_id < 100 then cast(file_id % 4 as integer) else hash_status end as hash_status)
          from prior)
        select 'status_domain' as invariant, count(*) as violations from marked where hash_status is null or hash_status not in (0, 1, 2)
        union all select 'deleted_domain', count(*) from marked where is_deleted is null or is_deleted not in (0, 1)
        union all select 'status_agrees', count(*) from marked where hash_status is distinct from
          (case when partial_hash is not null and full_hash is not null then 2 when partial_hash is not null then 1 else 0 end)
        union all select 'empty_not_hashed', count(*) from marked where size = 0 and (partial_hash is not null or full_hash is not null)
        union all select 'path_unique', count(*) from (select 1 from marked group by volume_id, path_rel having count(*) > 1)
        union all select 'id_unique', count(*) from (select 1 from marked group by file_id having count(*) > 1)
        union all select 'volume_path_unique', count(*) from (select 1 from vols where path <> 'pages/' group by path having count(*) > 1)
        union all select 'volume_known', count(*) from marked where volume_id not in (select id from vols where path <> 'pages/')
        union all select 'hash_one_size', count(*) from (
          select 1 from marked where full_hash is not null group by full_hash having min(size) <> max(size))""",
    "feed_apply": f"with {HASHED}, {VOLUMES}{FEED}{FEED_STATE} select * from feed_rows",
    "feed_since": f"""with {VOLUMES}{FEED} select f.pos, f.volume_id, f.path_rel, f.size, f.modified
        from feed f join half_way h on h.id = f.volume_id where f.pos > h.last_usn""",
    "feed_status": f"""with {VOLUMES}{FEED}, tops as (select volume_id, max(pos) as current_usn from feed group by volume_id)
        select h.id as volume_id, h.path, h.last_usn, t.current_usn, t.current_usn - h.last_usn as lag,
          t.current_usn is not null as active, t.current_usn is not null and h.last_usn is not null as incremental
        from half_way h left join tops t on t.volume_id = h.id""",
    "stream_apply": f"with {HASHED}, {VOLUMES}{FEED}{FEED_STATE} select * exclude (action) from feed_rows",
    "walk_scan": f"""with {FILES} select volume_id, path_rel, filename, extension, size, cast(null as varchar) as error
        from docs where filename not like '%.log'
        and not list_contains(string_split(lower(path_rel), '/'), '$recycle.bin')""",
    "scan_and_hash": f"""with {HASHED} select filename, size, partial_hash, full_hash, hash_status from hashed
        where not list_contains(string_split(lower(path_rel), '/'), '$recycle.bin')""",
    "funnel_hash": f"""with {HASHED} select filename, size, partial_hash,
        case when size <= 4096 or n > 1 then full_hash end as full_hash from (
          select *, count(*) over (partition by size, partial_hash) as n from (
            select *, count(*) over (partition by size) as same from hashed
            where size > 0 and not list_contains(string_split(lower(path_rel), '/'), '$recycle.bin'))
          where same > 1)""",
}
