"""The persistent index: a folder of Parquet tables, and the runs that build it.

The rows of a volume are laid out in parts by a hash of the path:
``files/run_id=R/volume_id=V/part=P`` holds part P of volume V as run R left it.
A run that rewrites a whole volume chooses its number of parts from the rows the
volume had, a power of two near one part per ``PART_ROWS`` rows and at most
``MAX_PARTS``; later runs keep that layout until the next whole rewrite. A run
writes only the parts it touched, into folders of its own, and lists them, empty
ones too, with the layout, in its manifest ``parts/run_id=R``; a part is current
in the newest finished run that lists it, since the volume's last whole rewrite. A run is finished once its ``done``
row is in ``scan_log``, which is written last. Nothing that is read is ever
overwritten, and a run that dies leaves the previous state in force.

Scans, hash runs and erasures rewrite whole volumes; a feed batch rewrites only
the parts that its keys hash to. Reads join the files to the current parts on
the partition columns, which lets Spark prune the other folders at run time.
(S3, S5, K4, K5, R1, R3, U3, U6-U8, U10)
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.functions.hashing import with_fingerprints
from twinsieve.operators.checks import Expectations, run_checks
from twinsieve.operators.filters import name_and_extension, split_ignored
from twinsieve.operators.fingerprint import fingerprint, hash_failures
from twinsieve.operators.groups import group_members, materialise_groups, ordered_members
from twinsieve.operators.maintenance import (
    one_per_key,
    soft_delete,
    upsert_files,
    upsert_volumes,
    write_hashes,
)
from twinsieve.operators.runlog import event_tuples, latest_runs
from twinsieve.operators.stats import index_stats
from twinsieve.plans.export import export_csv
from twinsieve.schema import (
    DEFAULT_GROUP_LIMIT,
    FILES,
    HASH_TYPE_FULL,
    HASH_TYPE_PREFIX,
    IGNORED,
    RUN_DONE,
    RUN_FAILED,
    RUN_RUNNING,
    SCAN_LOG,
    VOLUMES,
    ScanOptions,
    struct,
)
from twinsieve.session import broadcast_if_small, small_frame, written
from twinsieve.sources.walker import walk_files

# Parts of a volume, by a hash of the path: about one per PART_ROWS rows, a power of two, at most MAX_PARTS.
PART_ROWS = 1_000_000
MAX_PARTS = 64
MANIFEST = struct("volume_id long, part int, rows long, parts int")


def part_of(path_rel, parts) -> F.Column:
    """The part that a path's row lies in, of ``parts`` (a column or a number)."""
    path = F.col(path_rel) if isinstance(path_rel, str) else path_rel
    count = F.col(parts) if isinstance(parts, str) else parts if isinstance(parts, F.Column) else F.lit(parts)
    return F.pmod(F.xxhash64(path), count).cast("int")


def parts_for(rows: F.Column) -> F.Column:
    """The number of parts for a volume of so many rows."""
    wanted = F.greatest(F.ceil(F.coalesce(rows, F.lit(0)) / F.lit(PART_ROWS)), F.lit(1))
    return F.least(F.pow(F.lit(2), F.ceil(F.log2(wanted))), F.lit(MAX_PARTS)).cast("int")


def as_root(root: str) -> str:
    """A root as the volumes table names it: P1, and always ending in a separator."""
    root = root.strip()
    if len(root) <= 2 and root[:1].isascii() and root[:1].isalpha() and root[1:] in ("", ":"):
        return root[0].upper() + ":\\"
    return root if root.endswith(("/", "\\")) else root + "/"


# Stands for no volume in the log of a run that touched none.
NO_VOLUME = -1


class Index:
    """An index in a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.clock = clock or (lambda: int(time.time()))

    # --- state ------------------------------------------------------------

    def _read(self, paths: list[str], schema: T.StructType, base: str) -> DataFrame:
        if not paths:
            return small_frame(self.spark, [], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{base}")
        return reader.parquet(*paths).select(*schema.fieldNames())

    def scan_log(self) -> DataFrame:
        """Every event so far."""
        try:
            return self.spark.read.schema(SCAN_LOG).parquet(f"{self.path}/scan_log")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            return small_frame(self.spark, [], SCAN_LOG)

    def runs(self) -> DataFrame:
        """The latest state of every run."""
        return latest_runs(self.scan_log())

    def _stored(self, name: str, schema: T.StructType) -> DataFrame:
        """All runs' rows of a partitioned table, with its partition columns; none if there is none yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            return small_frame(self.spark, [], schema)

    def current_parts(self, also: int | None = None) -> DataFrame:
        """K4: volume_id, part, run_id and rows of every current part; ``also`` counts a run as finished."""
        done = self.scan_log().where(F.col("status") == RUN_DONE).select("run_id")
        if also is not None:
            done = done.unionByName(small_frame(self.spark, [(also,)], struct("run_id long")))
        listed = self._stored("parts", T.StructType([*MANIFEST, T.StructField("run_id", T.LongType())]))
        listed = listed.join(F.broadcast(done.distinct()), "run_id", "left_semi")  # one row per run
        whole = (listed.groupBy("run_id", "volume_id").agg(F.count("*").alias("n"), F.max("parts").alias("parts"))
                 .where(F.col("n") == F.col("parts")).groupBy("volume_id").agg(F.max("run_id").alias("since")))
        listed = listed.join(whole, "volume_id").where(F.col("run_id") >= F.col("since"))
        newest = listed.groupBy("volume_id", "part").agg(F.max_by(F.struct("run_id", "rows", "parts"), "run_id").alias("last"))
        return newest.select("volume_id", "part", "last.run_id", "last.rows", "last.parts")

    def layout(self) -> DataFrame:
        """volume_id, parts (the current number) and rows of every stored volume."""
        return self.current_parts().groupBy("volume_id").agg(F.max("parts").alias("parts"), F.sum("rows").alias("rows"))

    def tables(self, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The current rows of all volumes, or of some (volume_id, part), and the volumes.

        The files of all runs are joined to the current parts on the partition
        columns; the parts are broadcast where they are counted to be few, and
        the join prunes the folders of other runs and parts.
        """
        current = self.current_parts().where(F.col("rows") > 0).select("run_id", "volume_id", "part")
        if parts is not None:
            current = current.join(parts.select("volume_id", "part").distinct(), ["volume_id", "part"], "left_semi")
        schema = T.StructType([*FILES, T.StructField("run_id", T.LongType()), T.StructField("part", T.IntegerType())])
        files = self._stored("files", schema).join(broadcast_if_small(current), ["run_id", "volume_id", "part"], "left_semi")
        newest = self.scan_log().where(F.col("status") == RUN_DONE).agg(F.max("run_id")).first()[0]
        volumes = [] if newest is None else [f"{self.path}/volumes/run_id={newest}"]
        return files.select(*FILES.fieldNames()), self._read(volumes, VOLUMES, "volumes")

    def files(self) -> DataFrame:
        return self.tables()[0]

    def volumes(self) -> DataFrame:
        return self.tables()[1]

    def ignored(self) -> DataFrame:
        """A row per entry set aside by a finished run."""
        done = self.scan_log().where(F.col("status") == RUN_DONE).select("run_id").distinct()
        try:
            rows = self.spark.read.schema(
                T.StructType([*IGNORED, T.StructField("run_id", T.LongType())])
            ).parquet(f"{self.path}/ignored")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            return small_frame(self.spark, [], IGNORED)
        return rows.join(done, "run_id", "left_semi").select(*IGNORED.fieldNames())

    def volume_id(self, root: str) -> int | None:
        found = self.volumes().where(F.col("path") == as_root(root)).take(1)
        return found[0].id if found else None

    def next_file_id(self) -> int:
        """One above every id ever given out, from the log."""
        top = self.scan_log().agg(F.max("top_file_id")).first()[0]
        return 0 if top is None else top + 1

    def has_run(self, run_key: str) -> bool:
        done = (F.col("status") == RUN_DONE) & (F.col("run_key") == run_key)
        return bool(self.scan_log().where(done).take(1))

    # --- runs -------------------------------------------------------------

    def _log(self, rows: list[dict]) -> None:
        """Append events as one file of a name of its own, created only if it does not exist.

        Writers that log at once never share a folder of temporary files, as appends through
        Spark's committer would.
        """
        import io
        import uuid

        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        names = SCAN_LOG.fieldNames()
        schema = to_arrow_schema(SCAN_LOG)
        columns = list(zip(*event_tuples(rows), strict=True)) or [[] for _ in names]
        table = pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        buffer = io.BytesIO()
        pq.write_table(table, buffer)
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scan_log/events-{uuid.uuid4().hex}.parquet")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, False)
        try:
            out.write(bytearray(buffer.getvalue()))
        finally:
            out.close()

    def _claim(self, run_id: int) -> bool:
        """Create ``claims/<run_id>`` if no writer has; True for the one that did."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{run_id}")
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        try:
            system.create(path, False).close()  # fails if the file exists
        except Exception as error:  # py4j wraps the Java exception
            if "FileAlreadyExists" in str(error) or system.exists(path):
                return False
            raise
        return True

    def begin_run(self, volume_ids: list[int], run_key: str | None = None) -> int:
        """Open a run over some volumes. Ids of dead runs are not used again.

        The id is claimed by creating a file of that name that must not exist yet, so two
        writers never share one: the loser tries the next id.
        """
        last = self.scan_log().agg(F.max("run_id")).first()[0]
        run_id = (last or 0) + 1
        while not self._claim(run_id):
            run_id += 1
        self._log([
            dict(run_id=run_id, volume_id=v, seq=0, run_key=run_key,
                 started_at=self.clock(), status=RUN_RUNNING)
            for v in volume_ids
        ])
        return run_id

    def fail_run(self, run_id: int, volume_ids: list[int], message: str) -> None:
        now = self.clock()
        self._log([
            dict(run_id=run_id, volume_id=v, seq=2, started_at=now, finished_at=now,
                 status=RUN_FAILED, error_message=message)
            for v in volume_ids
        ])

    def commit(
        self,
        run_id: int,
        volume_ids: list[int],
        files: DataFrame | None,
        volumes: DataFrame,
        ignored: DataFrame | None = None,
        run_key: str | None = None,
        even_out: bool = True,
        parts: DataFrame | None = None,
    ) -> None:
        """K4, U8: write a run's tables and make them current.

        ``files`` holds the whole new state of the touched volumes, or, if
        ``parts`` (volume_id, part) is given, of those parts only; it is None if
        no volume is touched. An ``action`` column is stored along and counted
        for the log. ``even_out`` lets adaptive execution cut a large part into
        even files and merge small ones; without it the layout of the input
        stays, and the rows are not shuffled.
        """
        by_volume: dict[int, dict] = {}
        if files is not None:
            files_dir = f"{self.path}/files/run_id={run_id}"
            if "action" not in files.columns:
                files = files.withColumn("action", F.lit("unchanged"))
            if parts is None:  # whole volumes: a layout by the rows they had
                ids = small_frame(self.spark, [(v,) for v in volume_ids], struct("volume_id long"))
                chosen = ids.join(self.layout(), "volume_id", "left").select("volume_id", parts_for(F.col("rows")).alias("parts"))
            else:
                chosen = parts.select("volume_id", "parts").distinct()
            chosen = written(chosen, "layout")
            files = files.join(broadcast_if_small(chosen), "volume_id").withColumn("part", part_of("path_rel", "parts")).drop("parts")
            laid_out = files.hint("rebalance", "volume_id", "part") if even_out else files
            laid_out.write.partitionBy("volume_id", "part").parquet(files_dir)
            by_volume = self._written_counts(files_dir, run_id, chosen, parts)
        volumes.write.parquet(f"{self.path}/volumes/run_id={run_id}")
        if ignored is not None:
            ignored.write.parquet(f"{self.path}/ignored/run_id={run_id}")

        positions = {r.id: r.last_usn for r in volumes.select("id", "last_usn").collect()}
        now = self.clock()
        self._log([
            dict(
                by_volume.get(v, {}), run_id=run_id, volume_id=v, seq=2, run_key=run_key,
                started_at=now, finished_at=now, status=RUN_DONE,
                last_checkpoint_usn=positions.get(v),
            )
            for v in volume_ids
        ])

    def _written_counts(self, files_dir: str, run_id: int, chosen: DataFrame,
                        parts: DataFrame | None) -> dict[int, dict]:
        """What a run did, per volume, from three columns of what it wrote.

        Writes the run's manifest: every part it rewrote with its rows, all
        parts of the volumes in the ``chosen`` layout (volume_id, parts) unless ``parts``
        (volume_id, part, parts) names some. ``file_count`` is the
        volume's rows once the run is current.
        """

        def n(*actions: str):
            return F.count_if(F.col("action").isin(*actions))

        rows = self.spark.read.schema("action string, file_id long, volume_id long, part int").parquet(files_dir)
        by_part = written(rows.groupBy("volume_id", "part").agg(
            n("inserted", "verified", "reset").alias("files_scanned"),
            n("inserted").alias("files_added"),
            n("verified", "reset").alias("files_updated"),
            n("missing").alias("files_deleted"),
            F.count(F.lit(1)).alias("rows"),
            F.max("file_id").alias("top_file_id"),
        ), "part-counts")
        if parts is None:
            parts = chosen.select("volume_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
        listed = parts.select("volume_id", "part", "parts").distinct().join(
            by_part.select("volume_id", "part", "rows"), ["volume_id", "part"], "left")
        listed.select("volume_id", "part", F.coalesce("rows", F.lit(0)).alias("rows"), "parts").write.parquet(
            f"{self.path}/parts/run_id={run_id}")
        totals = self.current_parts(also=run_id).groupBy("volume_id").agg(F.sum("rows").alias("file_count"))
        counts = by_part.groupBy("volume_id").agg(
            *(F.sum(c).alias(c) for c in ("files_scanned", "files_added", "files_updated", "files_deleted")),
            F.max("top_file_id").alias("top_file_id")).join(totals, "volume_id", "left")
        return {r.volume_id: r.asDict() for r in counts.collect()}

    # --- commands ---------------------------------------------------------

    def register_volumes(self, roots: list[str], volume_type: int = 0) -> DataFrame:
        """The volumes table with these roots added or refreshed."""
        names = [(r,) for r in dict.fromkeys(map(as_root, roots))]
        seen = small_frame(self.spark, names, struct("path string")).select(
            "path",
            F.lit(volume_type).alias("volume_type"),
            F.lit(None).cast("string").alias("label"),
        )
        return written(upsert_volumes(self.volumes(), seen, self.clock()), "volumes")

    def scan(
        self,
        roots: list[str],
        options: ScanOptions | None = None,
        hash_mode: str | None = None,
        **upsert_options,
    ) -> dict[str, str]:
        """Index every file below the roots; returns root -> run status.

        A root that cannot be listed fails alone.
        """
        options = options or ScanOptions()
        volumes = self.register_volumes(roots)
        now = volumes.where(F.col("path").isin([as_root(r) for r in roots]))
        ids = {r.path: r.id for r in now.select("path", "id").collect()}
        run_id = self.begin_run(list(ids.values()))
        entries = written(walk_files(self.spark, {v: p for p, v in ids.items()}, options), "entries")
        lost = {
            r.volume_id: r.error
            for r in entries.where((F.col("path_rel") == "") & F.col("error").isNotNull()).collect()
        }
        for v, reason in lost.items():
            self.fail_run(run_id, [v], reason)
        good = [v for v in ids.values() if v not in lost]
        if good:
            self.apply_scan(run_id, good, entries.where(F.col("volume_id").isin(good)),
                            volumes, **upsert_options)
        if hash_mode and good:
            self.hash(hash_mode, good if hash_mode == "eager" else None)
        return {p: RUN_FAILED if v in lost else RUN_DONE for p, v in ids.items()}

    def apply_scan(
        self, run_id: int, volume_ids: list[int], entries: DataFrame, volumes: DataFrame,
        **upsert_options,
    ) -> None:
        """Put scan or inventory entries of some volumes into the index."""
        now = self.clock()
        usable, ignored = split_ignored(entries, now)
        usable = one_per_key(usable)
        old = self.files().where(F.col("volume_id").isin(volume_ids))
        new = upsert_files(
            old, usable, now, few_changes=False, next_id=self.next_file_id(), **upsert_options
        )
        self.commit(run_id, volume_ids, new, volumes, ignored)

    def add_inventory(
        self, entries: DataFrame, roots: dict[int, str], **upsert_options
    ) -> None:
        """Index entries that an inventory lists; ``roots`` by volume id."""
        seen = small_frame(
            self.spark,
            [(v, p, 0, None) for v, p in roots.items()],
            struct("id long, path string, volume_type int, label string"),
        )
        volumes = written(upsert_volumes(self.volumes(), seen, self.clock()), "volumes")
        run_id = self.begin_run(list(roots))
        self.apply_scan(run_id, list(roots), entries, volumes, **upsert_options)

    def _rewrite(self, volume_ids: list[int], change: Callable[[DataFrame], DataFrame],
                 ignored: DataFrame | None = None, even_out: bool = False) -> None:
        """A run that maps the rows of some volumes."""
        run_id = self.begin_run(volume_ids)
        files, volumes = self.tables()
        rows = change(files.where(F.col("volume_id").isin(volume_ids)))
        self.commit(run_id, volume_ids, rows, volumes, ignored, even_out=even_out)

    def set_positions(self, positions: dict[int, int]) -> None:
        """U8: store the feed position of some volumes; a stored one never goes back."""
        run_id = self.begin_run([NO_VOLUME])
        top = small_frame(self.spark, list(positions.items()), struct("id long, top long"))
        volumes = self.volumes().join(F.broadcast(top), "id", "left")
        volumes = volumes.withColumn("last_usn", F.greatest("last_usn", "top")).drop("top")
        self.commit(run_id, [NO_VOLUME], None, volumes)

    def hash(self, mode: str = "eager", volume_ids: list[int] | None = None) -> None:
        """Hash the backlog of some volumes or all and store the result.

        Only volumes with a result are rewritten.
        """
        files, volumes = self.tables()
        hashes = fingerprint(files, volumes, mode, volume_ids)
        touched = [r.volume_id for r in hashes.select("volume_id").distinct().collect()]
        if touched:
            failed = hash_failures(files, hashes, self.clock())
            self._rewrite(touched, lambda rows: write_hashes(rows, hashes), failed, even_out=True)

    def erase(self, root: str) -> bool:
        """Mark a volume's files deleted; False if the volume is unknown."""
        v = self.volume_id(root)
        if v is None:
            return False
        self._rewrite([v], lambda rows: soft_delete(rows, v))
        return True

    def duplicates(self, limit: int | None = DEFAULT_GROUP_LIMIT) -> DataFrame:
        """Members of the largest duplicate groups, in report order."""
        return ordered_members(group_members(*self.tables(), HASH_TYPE_FULL, limit))

    def candidates(self, limit: int | None = DEFAULT_GROUP_LIMIT, scope: str = "size_hash") -> DataFrame:
        """Members of the candidate groups with most copies, in report order."""
        found = group_members(*self.tables(), HASH_TYPE_PREFIX, limit, scope)
        return found.orderBy(F.desc("file_count"), F.desc("size"), "hash_value", "path_rel", "file_id")

    def materialise(self, out: str) -> None:
        """K5: store all duplicate groups and their members."""
        groups, members = materialise_groups(self.files(), self.clock())
        groups.write.parquet(f"{out}/duplicate_groups")
        members.write.parquet(f"{out}/duplicate_members")

    def stats(self) -> DataFrame:
        """A1."""
        return index_stats(*self.tables(), self.ignored())

    def export(self, out: str) -> int:
        """K1."""
        return export_csv(*self.tables(), out)

    def verify(self, expect: Expectations) -> tuple[list, int]:
        """V1-V9."""
        if expect.volume is not None:
            expect = replace(expect, volume=as_root(expect.volume))
        return run_checks(*self.tables(), self.ignored(), expect)


def content_index(rows: DataFrame, content: str = "content") -> DataFrame:
    """Index rows with fingerprints from rows that carry their content.

    Fills the columns a content table does not have. ``rows``: file_id,
    volume_id, path_rel and the content column, optionally any other file column.
    """
    have = set(rows.columns)
    hashed = name_and_extension(with_fingerprints(rows, content))
    for column in FILES:
        if column.name not in have and column.name not in hashed.columns:
            value = 0 if column.name == "is_deleted" else None
            hashed = hashed.withColumn(column.name, F.lit(value).cast(column.dataType))
    return hashed.select(*FILES.fieldNames())
