"""The given tables seen as files, volumes, scans and change feeds.

``documents`` is a file per row on the volume of its source, ``pages`` and
``conversations`` are files on two more volumes, and ``events`` is a change
feed: one file per user, position = event id. Every frame covers its whole
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.paths import extension
from twinsieve.plans.index import content_index
from twinsieve.schema import FILES

PAGES_VOLUME, CHATS_VOLUME = 100, 101
NOW = 1_800_000_000      # the clock of every registered query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: file columns, synthetic flags, and the text as content."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as file_id",
        "cast(substr(source, 4) as bigint) as volume_id",
        "source || '/' as volume",
        "lang || '/' || case when doc_id % 17 = 0 then '$Recycle.Bin/' else '' end || 'doc' || doc_id "
        "|| case doc_id % 5 when 0 then '.txt' when 1 then '.TXT' when 2 then '.log' "
        "when 3 then '.tar.gz' else '' end as path_rel",
        "'doc' || doc_id || case doc_id % 5 when 0 then '.txt' when 1 then '.TXT' when 2 then '.log' "
        "when 3 then '.tar.gz' else '' end as filename",
        "cast(octet_length(text) as bigint) as size",
        "1704067200 + doc_id * 60 as modified",
        "cast((case when doc_id % 7 = 0 then 2 else 0 end) + "
        "(case when doc_id % 11 = 0 then 4 else 0 end) as bigint) as attributes",
        "case when doc_id % 13 = 0 then 1 else 0 end as is_deleted",
        "cast(doc_id % 3 as int) as hash_status",
        "text as content",
    )


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files: a folder of part files, or the one file. A missing table fails."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volumes of documents, pages and conversations."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    found = sources.selectExpr(
        "cast(substr(source, 4) as bigint) as id", "source || '/' as path", "1 as volume_type"
    )
    for name, volume_id in (("pages", PAGES_VOLUME), ("conversations", CHATS_VOLUME)):
        one_row = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(
            one_row.select(
                F.lit(volume_id).cast("long").alias("id"),
                F.lit(f"{name}/").alias("path"),
                F.lit(0).alias("volume_type"),
            )
        )
    nothing = F.lit(None)
    return found.select(
        "*",
        nothing.cast("string").alias("label"),
        F.lit(1_700_000_000).cast("long").alias("indexed_at"),
        F.lit(1_700_000_000).cast("long").alias("last_scan"),
        nothing.cast("long").alias("last_usn"),
    )


def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as index rows with real fingerprints."""
    return content_index(
        documents_as_files(spark, sf_dir).drop("hash_status", "filename", "volume")
    )


def hashed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as index rows on their own volume; ids follow those of documents."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "1000000000000 + page_id as file_id",
        f"cast({PAGES_VOLUME} as bigint) as volume_id",
        "'page' || page_id || '.html' as path_rel",
        "1704067200 + page_id as modified",
        "html as content",
    )
    return content_index(pages)


def prior_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index before the scan: documents and pages, hashed."""
    rows = hashed_documents(spark, sf_dir).unionByName(hashed_pages(spark, sf_dir))
    return rows.withColumns(
        {"indexed_at": F.lit(1_700_000_000).cast("long"),
         "last_verified": F.lit(1_700_000_000).cast("long")}
    ).select(*FILES.fieldNames())


def current_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan: every document, some modified since, and every chat turn, all new."""
    documents = documents_as_files(spark, sf_dir).selectExpr(
        "volume_id", "path_rel", "filename", "size",
        "case when file_id % 20 = 10 then cast(null as bigint) "
        "when file_id % 2 = 0 then modified + 3600 else modified end as modified",
        "attributes",
    )
    chats = table(spark, sf_dir, "conversations").selectExpr(
        f"cast({CHATS_VOLUME} as bigint) as volume_id",
        "'conv' || conv_id || '/turn' || turn || '.' || role as path_rel",
        "'turn' || turn || '.' || role as filename",
        "cast(octet_length(text) as bigint) as size",
        "1704067200 + conv_id as modified",
        "cast(null as bigint) as attributes",
    )
    return documents.unionByName(chats).withColumn("extension", extension(F.col("filename")))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes of one file per user."""
    return as_changes(table(spark, sf_dir, "events"))


def as_changes(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as pos",
        "user_id % 20 as volume_id",
        "'home/user' || user_id || '.dat' as path_rel",
        "cast(floor(value) as bigint) as size",
        "cast(null as bigint) as created",
        # some files never get a new time, some changes come without one
        "case when user_id % 3 = 0 then cast(1704067200 as bigint) "
        "when user_id % 3 = 1 and event_type = 'signup' then cast(null as bigint) "
        "else unix_date(cast(ts as date)) * cast(86400 as bigint) end as modified",
        "cast(null as bigint) as accessed",
        "cast(case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 "
        "when 'purchase' then 4 else 6 end as bigint) as attributes",
    )


def prior_feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index before the feed: documents, and each user's file as first seen, hashed then."""
    changes = change_feed(spark, sf_dir)
    first = changes.groupBy("volume_id", "path_rel").agg(
        F.min("pos").alias("pos"),
        *[F.min_by(c, "pos").alias(c) for c in ("size", "modified", "attributes")],
    )
    users = first.select(
        (F.lit(2_000_000_000_000) + F.col("pos")).alias("file_id"),
        "volume_id", "path_rel",
        F.substring_index("path_rel", "/", -1).alias("filename"),
        F.lit("dat").alias("extension"),
        "size",
        F.lit(None).cast("long").alias("created"),
        "modified",
        F.lit(None).cast("long").alias("accessed"),
        "attributes",
        F.sha2("path_rel", 256).alias("partial_hash"),
        F.sha2("path_rel", 256).alias("full_hash"),
        F.lit(2).alias("hash_status"),
        F.lit(1_700_000_000).cast("long").alias("indexed_at"),
        F.lit(1_700_000_000).cast("long").alias("last_verified"),
        F.col("pos").alias("usn"),
        F.lit(0).alias("is_deleted"),
    )
    documents = hashed_documents(spark, sf_dir).withColumns(
        {"indexed_at": F.lit(1_700_000_000).cast("long"),
         "last_verified": F.lit(1_700_000_000).cast("long")}
    )
    return users.select(*FILES.fieldNames()).unionByName(documents.select(*FILES.fieldNames()))
