"""Table schemas of the index and the fixed values every operator shares."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# These must not change: stored indexes, reports and result codes depend on them.

PREFIX_BYTES = 4096            # length of the prefix fingerprint
DEFAULT_GROUP_LIMIT = 50       # groups shown by a duplicate report

SKIPPED_DIRECTORIES = (
    "$recycle.bin",
    "system volume information",
    "$windows.~bt",
    "$windows.~ws",
)

ATTRIBUTE_HIDDEN = 0x02
ATTRIBUTE_SYSTEM = 0x04

STATUS_NONE, STATUS_PREFIX, STATUS_FULL = 0, 1, 2

HASH_TYPE_PREFIX, HASH_TYPE_FULL = 1, 2

RUN_RUNNING, RUN_DONE, RUN_FAILED = "running", "done", "failed"

IGNORE_REASONS = ("permission", "ioerror", "symlink_broken", "system", "hidden")
REASON_BAD_KEY = "bad_key"     # added here: a row without a usable path

CHECK_CODES = {
    "ok": 0,
    "db_integrity": 10,
    "volume_exists": 11,
    "files_count": 12,
    "hashes": 13,
    "dup_groups": 14,
    "dup_members": 15,
    "usn_stored": 16,
    "ignored": 17,
}
# ----------------------------------------------------------------------------


def struct(spec: str) -> T.StructType:
    """``"name type, name! type"``; ``!`` marks a column that is never NULL."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    out = T.StructType()
    for item in spec.split(","):
        name, kind = item.split()
        out = out.add(name.rstrip("!"), kinds[kind], not name.endswith("!"))
    return out


VOLUMES = struct(
    "id! long, path! string, volume_type int, label string, "
    "indexed_at long, last_scan long, last_usn long"
)

FILES = struct(
    "file_id! long, volume_id! long, path_rel! string, filename string, extension string, "
    "size long, created long, modified long, accessed long, attributes long, "
    "partial_hash string, full_hash string, hash_status int, "
    "indexed_at long, last_verified long, usn long, is_deleted int"
)

# What a scanner or an inventory yields; volume_id and path_rel form the key.
SCAN_ENTRIES = struct(
    "volume_id! long, path_rel string, filename string, extension string, size long, "
    "created long, modified long, accessed long, attributes long"
)

# A change feed row: a scan entry with its position in the feed.
CHANGES = struct(
    "pos! long, volume_id! long, path_rel string, size long, "
    "created long, modified long, accessed long, attributes long"
)

TAGS = struct("tag_id! long, name! string")
FILE_TAGS = struct("file_id! long, tag_id! long")
IGNORED = struct("volume_id long, path string, reason string, indexed_at long")

SCAN_LOG = struct(
    "run_id! long, volume_id! long, seq! int, run_key string, "
    "started_at long, finished_at long, files_scanned long, files_added long, "
    "files_updated long, files_deleted long, file_count long, "
    "top_file_id long, last_checkpoint_usn long, "
    "status string, error_message string"
)

FILE_COLUMNS = FILES.fieldNames()


@dataclass(frozen=True)
class ScanOptions:
    """Which entries a scan keeps."""

    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    skip_hidden: bool = True
    skip_system: bool = True
    match_on: str = "filename"       # or "extension"
    separator: str = "/"
    skipped_directories: tuple[str, ...] = field(default=SKIPPED_DIRECTORIES)
