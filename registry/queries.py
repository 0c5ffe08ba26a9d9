"""Registered queries, by name; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import frames as X
from twinsieve.functions.hashing import with_fingerprints
from twinsieve.functions.paths import (
    absolute_path,
    epoch_seconds,
    extension,
    hex_lower,
    normalise_root,
    relative_path,
)
from twinsieve.operators import checks as expectations
from twinsieve.operators import filters, groups, maintenance, runlog, stats
from twinsieve.operators.fingerprint import fingerprint
from twinsieve.plans import export
from twinsieve.plans.index import Index
from twinsieve.schema import (
    FILE_COLUMNS,
    HASH_TYPE_FULL,
    HASH_TYPE_PREFIX,
    ScanOptions,
)
from twinsieve.session import new_path, written
from twinsieve.sources.inventory import inventory_entries
from twinsieve.sources.walker import walk_files
from twinsieve.streaming import feed as feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- duplicate queries ------------------------------------------------------

@query
def dup_groups(spark, sf):
    """D1, T1 straight from content: one pass, no content in the shuffle."""
    return groups.duplicate_groups(X.hashed_documents(spark, sf))


@query
def dup_groups_all(spark, sf):
    """D1 without a limit, over documents and pages."""
    return groups.duplicate_groups(X.prior_index(spark, sf), None)


@query
def dup_candidates(spark, sf):
    """D2, T2."""
    return groups.candidate_groups(X.hashed_documents(spark, sf))


def _stored_documents(spark, sf):
    """Fingerprints written once, for queries that pass over them twice."""
    return written(X.hashed_documents(spark, sf), "index")


@query
def dup_members(spark, sf):
    """Members of the top groups."""
    return groups.group_members(_stored_documents(spark, sf), X.volumes(spark, sf))


@query
def dup_members_all(spark, sf):
    """D3 over every group, with hot groups split."""
    return groups.group_members(
        _stored_documents(spark, sf), X.volumes(spark, sf), HASH_TYPE_FULL, None
    )


@query
def dup_nested(spark, sf):
    """D3 nested, unfolded again so that both engines can compare it."""
    members = groups.group_members(
        _stored_documents(spark, sf), X.volumes(spark, sf), HASH_TYPE_FULL, None
    )
    return unfolded(groups.nested_groups(members), 10_000)


def unfolded(nested: DataFrame, page_rows: int) -> DataFrame:
    """A row per member of nested groups, with its place in the whole group."""
    rows = nested.select("hash_value", "file_count", "page", F.posexplode("members").alias("at", "member"))
    position = (F.col("page") * page_rows + F.col("at")).cast("int").alias("position")
    return rows.select("hash_value", "file_count", position, "member.file_id", "member.path")


@query
def candidate_members(spark, sf):
    """D3 for candidate groups."""
    return groups.group_members(
        _stored_documents(spark, sf), X.volumes(spark, sf), HASH_TYPE_PREFIX
    )


@query
def candidate_members_by_hash(spark, sf):
    """D3 for candidate groups, members by prefix hash whatever their size."""
    return groups.group_members(
        _stored_documents(spark, sf), X.volumes(spark, sf), HASH_TYPE_PREFIX,
        members_scope="hash",
    )


@query
def dup_group_count(spark, sf):
    """D4."""
    return groups.duplicate_summary(X.hashed_documents(spark, sf)).select("dup_groups")


@query
def dup_max_members(spark, sf):
    """D5."""
    return groups.duplicate_summary(X.hashed_documents(spark, sf)).select("max_members")


@query
def same_size_groups(spark, sf):
    """Reads the text for its length only."""
    return groups.same_size_groups(X.documents_as_files(spark, sf))


@query
def funnel_report(spark, sf):
    """D7."""
    return groups.funnel_report(X.hashed_documents(spark, sf))


@query
def funnel_survivors(spark, sf):
    """J4, J5."""
    stored = written(
        X.hashed_documents(spark, sf).select("file_id", "size", "partial_hash", "is_deleted"),
        "prefixes",
    )
    same_size = written(groups.size_survivors(stored), "same-size")
    return groups.prefix_survivors(same_size).select("file_id", "size", "partial_hash")


@query
def dup_materialised(spark, sf):
    """K5: both tables stored, read back and joined."""
    found, members = groups.materialise_groups(_stored_documents(spark, sf), X.NOW)
    out = new_path(spark, "groups")
    found.write.parquet(f"{out}/duplicate_groups")
    members.write.parquet(f"{out}/duplicate_members")
    stored = spark.read.parquet(f"{out}/duplicate_groups")
    return spark.read.parquet(f"{out}/duplicate_members").join(stored, ["size", "hash_value"])


# --- counts and reports -----------------------------------------------------

@query
def index_stats(spark, sf):
    """A1."""
    return stats.index_stats(
        X.hashed_documents(spark, sf), X.volumes(spark, sf), _ignored(spark, sf)
    )


@query
def alive_by_volume(spark, sf):
    """A2, F8, F9."""
    return stats.alive_by_volume(X.documents_as_files(spark, sf))


@query
def hashed_count(spark, sf):
    """A3, F10."""
    return stats.hashed_counts(X.documents_as_files(spark, sf), min_status=1).select("hashed_files")


@query
def hashed_pct(spark, sf):
    """A5."""
    return stats.hashed_counts(X.documents_as_files(spark, sf))


def _listed(spark, sf):
    """documents as a listing in which hidden files have lost their path."""
    return inventory_entries(
        X.documents_as_files(spark, sf),
        {
            "volume_id": "volume_id",
            "path_rel": "case when attributes = 6 then cast(null as string) else path_rel end",
            "filename": "filename",
            "size": "size",
            "modified": "modified",
            "attributes": "attributes",
            "allocated": "is_deleted = 0",
            "is_dir": "false",
        },
        ScanOptions(skip_hidden=False, skip_system=False),
    )


def _ignored(spark, sf):
    return filters.split_ignored(_listed(spark, sf), X.NOW)[1]


@query
def ignored_counts(spark, sf):
    """A4, F11, U10."""
    return stats.ignored_counts(_ignored(spark, sf))


@query
def hash_backlog(spark, sf):
    """T3 over all volumes."""
    return stats.hash_backlog(X.documents_as_files(spark, sf), X.volumes(spark, sf))


@query
def largest_files(spark, sf):
    """T6."""
    return stats.largest_files(X.documents_as_files(spark, sf))


@query
def export_rows(spark, sf):
    """The export as rows."""
    return export.export_rows(X.prior_index(spark, sf), X.volumes(spark, sf))


@query
def export_csv_roundtrip(spark, sf):
    """K1: the export written as CSV and read back."""
    out = new_path(spark, "export")
    export.export_csv(_stored_documents(spark, sf), X.volumes(spark, sf), out)
    schema = (
        "id long, volume string, path string, filename string, extension string, size long, "
        "modified long, partial_hash string, full_hash string, hash_status int, is_deleted int"
    )
    return spark.read.schema(schema).options(header=True, quote='"', escape='"').csv(out)


# --- filters and expressions ------------------------------------------------

@query
def include_exclude(spark, sf):
    """F1, F2."""
    options = ScanOptions(includes=("*.txt", "doc?[0-4]*"), excludes=("*[!0-9].gz", "*7.txt"))
    files = X.documents_as_files(spark, sf)
    return files.where(filters.name_filter(options, F.col("filename"))).select("file_id", "filename")


@query
def extension_filter(spark, sf):
    """F4."""
    options = ScanOptions(includes=("t?t", "g*"), excludes=("gz",), match_on="extension")
    files = X.documents_as_files(spark, sf)
    return files.where(filters.name_filter(options, F.col("filename"))).select("file_id", "filename")


@query
def attribute_filter(spark, sf):
    """F5."""
    files = X.documents_as_files(spark, sf)
    kept = filters.attribute_filter(ScanOptions(), F.col("attributes"))
    return files.where(kept).select("file_id", "attributes")


@query
def skip_dirs(spark, sf):
    """F6."""
    files = X.documents_as_files(spark, sf)
    return files.where(filters.skipped_directory_filter(F.col("path_rel"))).select(
        "file_id", "path_rel"
    )


@query
def inventory_scan(spark, sf):
    """S2, F7 with all scan filters."""
    return inventory_entries(
        X.documents_as_files(spark, sf),
        {
            "volume_id": "volume_id",
            "path_rel": "path_rel",
            "size": "size",
            "modified": "modified",
            "attributes": "attributes",
            "allocated": "is_deleted = 0",
            "is_dir": "false",
        },
        ScanOptions(includes=("*.txt",)),
    )


@query
def extensions(spark, sf):
    """P3 over page addresses."""
    name = F.substring_index(F.regexp_replace("url", "[?#].*$", ""), "/", -1)
    return X.table(spark, sf, "pages").select("page_id", extension(name).alias("extension"))


@query
def root_normalise(spark, sf):
    """P1."""
    root = F.expr(
        "case doc_id % 4 when 0 then substr(lang, 1, 1) when 1 then substr(lang, 1, 1) || ':' "
        "when 2 then '  ' || source || ' ' else lang end"
    )
    return X.table(spark, sf, "documents").select("doc_id", normalise_root(root).alias("root"))


@query
def rel_path(spark, sf):
    """Page addresses below a root; others are dropped."""
    rel = relative_path(F.col("url"), F.lit("https:"))
    return (
        X.table(spark, sf, "pages").select("page_id", rel.alias("path_rel"))
        .where(F.col("path_rel").isNotNull())
    )


@query
def absolute_paths(spark, sf):
    """P5, J1."""
    return X.documents_as_files(spark, sf).select(
        "file_id", absolute_path(F.col("volume"), F.col("path_rel")).alias("path")
    )


@query
def times(spark, sf):
    """P4."""
    return X.table(spark, sf, "events").select(
        "event_id", epoch_seconds(F.col("ts")).alias("seconds")
    )


@query
def hex_values(spark, sf):
    """P6."""
    return X.table(spark, sf, "events").select(
        "event_id", hex_lower(F.col("props").cast("binary")).alias("props_hex")
    )


@query
def fingerprints(spark, sf):
    """P7-P10."""
    return with_fingerprints(X.documents_as_files(spark, sf)).select(
        "file_id", "size", "partial_hash", "full_hash", "hash_status"
    )


# --- index maintenance ------------------------------------------------------

def _upserted(spark, sf, few_changes=False):
    return maintenance.upsert_files(
        X.prior_index(spark, sf), X.current_scan(spark, sf), X.NOW, few_changes=few_changes
    )


def _old_ids(df):
    """Ids of new rows are assigned on insert and not comparable; they are blanked."""
    inserted = F.col("action") == maintenance.INSERTED
    return df.withColumn("file_id", F.when(~inserted, F.col("file_id")))


@query
def upsert_index(spark, sf):
    """Both sides shuffled by key."""
    return _old_ids(_upserted(spark, sf))


@query
def upsert_counted(spark, sf):
    """U1 with the join chosen by a count: a small scan is broadcast."""
    return _old_ids(_upserted(spark, sf, few_changes=None))


@query
def upsert_actions(spark, sf):
    """A7."""
    return stats.action_counts(_upserted(spark, sf))


@query
def upsert_sweep(spark, sf):
    """U1 with rows missing from the scan marked deleted and size changes resetting hashes."""
    out = maintenance.upsert_files(
        X.prior_index(spark, sf), X.current_scan(spark, sf), X.NOW,
        sweep_missing=True, reset_on_size_change=True,
    )
    return out.groupBy("action", "is_deleted").agg(F.count(F.lit(1)).alias("row_count"))


@query
def revive(spark, sf):
    """U4: rows that were deleted and that the scan brought back."""
    dead = X.prior_index(spark, sf).where("is_deleted = 1").select("file_id")
    back = _upserted(spark, sf).where("is_deleted = 0").select("file_id", "path_rel", "action")
    return back.join(dead, "file_id", "left_semi")


@query
def volume_upsert(spark, sf):
    """The sources of documents are known, all of them and the languages are seen."""
    known = X.volumes(spark, sf).withColumn("label", F.concat(F.lit("disk "), "path"))
    documents = X.table(spark, sf, "documents")
    seen = documents.select(F.concat("source", F.lit("/")).alias("path"), "lang").groupBy("path").agg(
        F.min("lang").alias("lowest")
    ).selectExpr("path", "2 as volume_type", "case when path < 'src2' then lowest end as label")
    tongues = documents.select(F.concat("lang", F.lit("/")).alias("path")).distinct().selectExpr(
        "path", "3 as volume_type", "cast(null as string) as label"
    )
    return maintenance.upsert_volumes(known, seen.unionByName(tongues), X.NOW).drop("id")


@query
def soft_delete(spark, sf):
    """U3."""
    return maintenance.soft_delete(X.documents_as_files(spark, sf), 3).select(
        "file_id", "volume_id", "is_deleted"
    )


@query
def hash_writeback(spark, sf):
    """Fingerprints of the backlog put into an index without any."""
    rows = X.documents_as_files(spark, sf)
    nothing = F.lit(None).cast("string")
    index = rows.drop("content").withColumns({"partial_hash": nothing, "full_hash": nothing})
    hashes = with_fingerprints(rows.where("hash_status < 2 and is_deleted = 0"))
    return maintenance.write_hashes(
        index, hashes.select("file_id", "partial_hash", "full_hash")
    ).select("file_id", "partial_hash", "full_hash", "hash_status", "is_deleted")


@query
def run_log_latest(spark, sf):
    """Events as run events, one run per user, status by type."""
    events = X.table(spark, sf, "events").selectExpr(
        "user_id as run_id", "user_id % 20 as volume_id", "event_id as seq",
        "cast(floor(value) as bigint) as files_scanned",
        "case event_type when 'purchase' then 'done' when 'error' then 'failed' "
        "else 'running' end as status",
        "case when event_type = 'error' then props end as error_message",
    )
    return runlog.latest_runs(events)


@query
def tags_upsert(spark, sf):
    """Files are tagged by language; labels add their tags and repeat the languages."""
    files = X.documents_as_files(spark, sf)
    documents = X.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    empty_tags = documents.where(F.lit(False)).selectExpr("file_id as tag_id", "lang as name")
    no_pairs = documents.where(F.lit(False)).selectExpr("file_id", "file_id as tag_id")
    by_language = documents.withColumnRenamed("lang", "name")
    tags = written(maintenance.add_tags(empty_tags, by_language), "tags")
    pairs = written(maintenance.tag_files(tags, no_pairs, by_language), "pairs")
    labels = X.table(spark, sf, "labels").selectExpr(
        "doc_id as file_id",
        "explode(filter(array(case when quality = 1 then 'quality' end, "
        "case when toxic = 1 then 'toxic' end), x -> x is not null)) as name",
    )
    new = labels.unionByName(by_language)
    tags = written(maintenance.add_tags(tags, new), "tags")
    return maintenance.tagged_files(files, tags, maintenance.tag_files(tags, pairs, new))


# --- checks -----------------------------------------------------------------

def _checked(spark, sf):
    feed = X.change_feed(spark, sf).groupBy("volume_id").agg(F.max("pos").alias("top"))
    volumes = X.volumes(spark, sf).join(feed, F.col("id") == F.col("volume_id"), "left")
    volumes = volumes.withColumn("last_usn", F.col("top")).drop("top", "volume_id")
    expect = expectations.Expectations(
        integrity=True, volume=" src3/ ", files_min=1, files_max=2, hashed_pct=100,
        dup_groups=99, dup_members_min=2, usn_stored=True, ignored_max=0,
    )
    return expectations.check_results(
        _stored_documents(spark, sf), volumes, _ignored(spark, sf), expect
    )


@query
def check_results(spark, sf):
    """V1-V9."""
    return _checked(spark, sf)


@query
def check_code(spark, sf):
    """V8: the summary and the code of the first failure."""
    return expectations.check_summary(_checked(spark, sf))


@query
def integrity_checks(spark, sf):
    """V1 on rows whose status was not set by the fingerprint job."""
    marked = X.prior_index(spark, sf).withColumn(
        "hash_status",
        F.when(F.col("volume_id") < X.PAGES_VOLUME, (F.col("file_id") % 4).cast("int"))
        .otherwise(F.col("hash_status")),
    )
    known = X.volumes(spark, sf).where(F.col("path") != "pages/")
    return expectations.index_invariants(written(marked, "index"), known)


# --- change feed ------------------------------------------------------------

@query
def feed_apply(spark, sf):
    """R1 as one batch: end state."""
    return feeds.apply_changes(X.prior_feed_state(spark, sf), X.change_feed(spark, sf), X.NOW)


@query
def feed_since(spark, sf):
    """Changes after the stored position of each volume, which is half way through."""
    return feeds.changes_since(X.change_feed(spark, sf), _half_way(spark, sf)).select(
        "pos", "volume_id", "path_rel", "size", "modified"
    )


def _half_way(spark, sf):
    middle = X.change_feed(spark, sf).groupBy("volume_id").agg(
        F.floor(F.max("pos") / 2).alias("middle")
    )
    volumes = X.volumes(spark, sf).join(
        middle.withColumnRenamed("volume_id", "id"), "id", "left"
    )
    return volumes.withColumn("last_usn", F.col("middle")).drop("middle")


@query
def feed_status(spark, sf):
    """R2."""
    return feeds.feed_status(_half_way(spark, sf), X.change_feed(spark, sf))


@query
def stream_apply(spark, sf):
    """R1 as a stream into a stored index, read back: the end state of the users' files."""
    index = Index(spark, new_path(spark, "index"), clock=lambda: X.NOW)
    volumes = X.volumes(spark, sf)
    ids = [r.id for r in volumes.select("id").collect()]
    start = X.prior_feed_state(spark, sf)
    index.commit(index.begin_run(ids), ids, start, volumes)
    feed = feeds.start_feed(X.as_changes(X.streamed(spark, sf, "events")), index, new_path(spark, "checkpoint"))
    feed.awaitTermination()
    return index.files().select(*FILE_COLUMNS)


# --- files ------------------------------------------------------------------

def _write_files(spark, sf) -> str:
    """Every document as a file below a folder of its own in the shared folder."""
    base = new_path(spark, "tree")

    def write(batches):
        import posixpath

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['volume']}{row['path_rel']}"
                store.create_dir(posixpath.dirname(path), recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(row["content"].encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files = X.documents_as_files(spark, sf).select("volume", "path_rel", "content")
    slots = spark.sparkContext.defaultParallelism
    files.repartition(4 * slots).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return base


def _volume_roots(spark, sf, base: str) -> dict[int, str]:
    sources = X.documents_as_files(spark, sf).select("volume_id", "volume").distinct()
    return {r.volume_id: f"{base}/{r.volume}" for r in sources.collect()}


@query
def walk_scan(spark, sf):
    """Documents written as files and scanned, one volume per source."""
    base = _write_files(spark, sf)
    options = ScanOptions(excludes=("*.log",))
    return walk_files(spark, _volume_roots(spark, sf, base), options).select(
        "volume_id", "path_rel", "filename", "extension", "size", "error"
    )


def _scanned_index(spark, sf) -> Index:
    base = _write_files(spark, sf)
    index = Index(spark, new_path(spark, "index"), clock=lambda: X.NOW)
    index.scan(list(_volume_roots(spark, sf, base).values()))
    return index


@query
def scan_and_hash(spark, sf):
    """S1, U1, U6, U5, K4, S5 on files: the whole index after an eager hash run."""
    index = _scanned_index(spark, sf)
    index.hash("eager")
    return index.files().select("filename", "size", "partial_hash", "full_hash", "hash_status")


@query
def funnel_hash(spark, sf):
    """U6, J4, J5 on files: which rows the funnel hashes, and how far."""
    index = _scanned_index(spark, sf)
    files, volumes = index.tables()
    found = fingerprint(files, volumes, "funnel")
    return files.select("file_id", "filename", "size").join(found, "file_id").select(
        "filename", "size", "partial_hash", "full_hash"
    )
