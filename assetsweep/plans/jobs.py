"""End-to-end jobs a user calls, composed from the operators."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from assetsweep.functions.hashing import content_hash
from assetsweep.operators import archive as arc
from assetsweep.operators import catalog as cat
from assetsweep.operators import duplicates as dup
from assetsweep.operators import inventory as inv
from assetsweep.operators import plan as pln
from assetsweep.operators.capacity import capacity_fit, with_shard_weights  # noqa: F401  (re-exported)
from assetsweep.operators.commits import CommitLog
from assetsweep.operators.skew import filter_by_ids
from assetsweep.plans import report as rep
from assetsweep.session import any_path, literal_table, materialize, path_exists
from assetsweep.sources import files as FS
from assetsweep.sources import headers as hdr
from assetsweep.sources.kept import VERSION, KeptRows


@dataclass
class Inventory:
    assets: DataFrame
    stores: DataFrame
    totals: DataFrame

    def top(self, n: int = 500) -> DataFrame:
        """O3: the largest assets with their rank, ties by path."""
        return rep.top_rows(self.assets, [F.desc("size"), F.asc("path")], n)

    def report(self, dups: dup.Duplicates | None = None) -> DataFrame:
        """One row of JSON per store and file, one or more per duplicate group, with its members in bounded
        chunks, and one of totals; nulls are left out."""
        parts = [self.stores.select(F.lit("store").alias("section"), "*"),
                 self.assets.select(F.lit("file").alias("section"), *[c for c in self.assets.columns if c != "payload"])]
        totals = self.totals.select(F.lit("totals").alias("section"), "*")
        if dups is not None:
            parts.append(rep.group_chunks(dups).select(F.lit("group").alias("section"), "*"))
            both = totals.unionByName(dups.totals().withColumn("section", F.lit("totals")), allowMissingColumns=True)
            totals = both.groupBy("section").agg(*[F.max(c).alias(c) for c in both.columns if c != "section"])
        return reduce(lambda a, b: a.unionByName(b), [rep.to_json_rows(p) for p in [*parts, totals]])


def inventory(assets: DataFrame, stores: DataFrame, tags: DataFrame | None = None,
              boundary: bool = True, manifests: DataFrame | None = None,
              catalog: DataFrame | None = None) -> Inventory:
    """Name parts, optional tags and headers, display names, store summaries and totals of an asset table.

    Tags come from ``tags`` (``blob, tag``) or are derived from ``manifests``
    (``rel_path, json``, see ``sources.manifests``).  ``catalog`` (from ``catalog_headers``)
    adds the header columns; without it no header is read (P10)."""
    if tags is None and manifests is not None:
        from assetsweep.sources.manifests import manifest_tags
        tags = manifest_tags(manifests)
    a = inv.with_name_parts(assets)
    if tags is not None:
        a = inv.attach_tags(a, tags)
    if catalog is not None:
        head = catalog.withColumnRenamed("name", "header_name")
        a = a.join(head.select("path", *[c for c in head.columns if c not in a.columns]), "path", "left")
    blank = F.lit(None).cast("string")
    a = a.withColumns({c: blank for c in ("tag", "header_name") if c not in a.columns})
    a = a.withColumn("display_name", rep.display_name("tag", "header_name", "path"))
    return Inventory(a, inv.store_summaries(a, stores, boundary), inv.totals(a))


def file_inventory(spark: SparkSession, stores: list[tuple[str, str, str | None]], no_parse: bool = False,
                   manifests: DataFrame | None = None, kept: str | None = None) -> Inventory:
    """The models below store roots ``[(kind, root, glob), ...]``, with their headers unless ``no_parse`` (P10).

    ``kept`` names a folder in which decoded headers stay between runs, see ``catalog_headers_kept``."""
    files = materialize(FS.with_asset_ids(FS.select_models(FS.scan_stores(spark, stores))))
    if no_parse:
        catalog = None
    elif kept:
        catalog = materialize(catalog_headers_kept(spark, files, kept))
    else:
        catalog = materialize(catalog_headers(files.select("path"), from_paths=True))
    roots = literal_table(spark, [(k, f"file:{os.path.abspath(r)}" if "://" not in r and not r.startswith("file:") else r,
                                   not path_exists(spark, r)) for k, r, _ in stores], "kind string, root string, missing boolean")
    return inventory(files, roots, manifests=manifests, catalog=catalog)


def find_duplicates(assets: DataFrame, min_size: int = dup.DEFAULT_MIN_SIZE, managed=None,
                    algo: str = "sha256", exclude_same_split: bool = False,
                    prefilter: bool | str = "auto") -> dup.Duplicates:
    """Duplicate groups of assets whose payload is a column.

    ``prefilter=True`` keeps only sizes that occur twice before hashing (J3): the
    size list is count-checked and broadcast, so payload rows are filtered where
    they are read.  ``"auto"`` skips it for in-table payloads, where hashing in
    the scan costs less than the extra pass (files use the prefilter always).
    """
    if prefilter is True:
        sizes = dup.size_candidates(assets.select("asset_id", "size"), min_size).select("size")
        assets = filter_by_ids(assets, sizes, "size", keep=True)
    if exclude_same_split and "split_group" not in assets.columns:
        assets = inv.with_name_parts(assets)
    keep = ("split_group",) if exclude_same_split else ()
    fp = dup.fingerprint_payloads(assets, algo, keep)
    return dup.find_duplicates(fp, min_size, managed, exclude_same_split=exclude_same_split)


def find_file_duplicates(spark: SparkSession, stores: list[tuple[str, str, str | None]],
                         min_size: int = dup.DEFAULT_MIN_SIZE, managed=None,
                         algo: str = "sha256") -> dup.Duplicates:
    """Duplicate groups of files below store roots ``[(kind, root, glob), ...]``.

    Listing (no content read) -> one row per path (U1) -> hash only files whose
    size occurs twice (J3), in tasks that stream each file -> group (A4 A5).  Names of
    one physical file (hard links, links) count once (D17).
    """
    files = FS.with_asset_ids(FS.scan_stores(spark, stores))
    fp = materialize(FS.prefiltered_fingerprints(files, min_size, algo))
    fp = fp.join(FS.physical_ids(fp.where("ok")), "path", "left")
    return dup.find_duplicates(fp, min_size, managed)


def find_file_duplicates_cached(spark: SparkSession, stores: list[tuple[str, str, str | None]],
                                cache_path: str, min_size: int = dup.DEFAULT_MIN_SIZE, managed=None,
                                algo: str = "sha256") -> dup.Duplicates:
    """``find_file_duplicates`` with a fingerprint table kept between runs.

    Only files whose size occurs twice are hashed (J3).  Files that the table holds
    with the same (path, size, modification time), read without error by the same
    algorithm, are not read again; others are hashed and appended.  Grouping uses the
    newest good row per listed path.
    """
    from assetsweep.streaming import incremental as inc
    listing = FS.with_asset_ids(FS.scan_stores(spark, stores))
    listing = listing.where(F.col("size") >= min_size)
    twice = listing.groupBy("size").count().where(F.col("count") > 1).select("size")  # J3
    listing = materialize(listing.join(twice, "size", "left_semi"))
    cache = spark.read.parquet(cache_path) if path_exists(spark, cache_path) else None
    fresh = inc.refresh_fingerprints(listing, cache, algo)
    fresh.write.mode("append").parquet(cache_path)
    table = spark.read.parquet(cache_path)
    current = inc.latest_fingerprints(table, algo).join(listing.select("path", "size", "modificationTime"),
                                                  ["path", "size", "modificationTime"], "left_semi")
    # Links may have changed while the content did not, so identities are not kept in the table.
    current = current.join(FS.physical_ids(current), "path", "left")
    return dup.find_duplicates(current, min_size, managed)


reclaim_plan = pln.reclaim_plan
verify_plan = pln.verify_plan


def _norm_path(p: str) -> str:
    """One name per place: ``file:///a``, ``file:/a``, ``/a`` and links to it; s3, s3a and s3n."""
    if p.startswith("file:"):
        p = p[5:]
        while p.startswith("//"):
            p = p[1:]
    scheme, sep, rest = p.partition("://")
    if not sep:
        return os.path.realpath(unquote(p))
    return f"s3://{unquote(rest)}" if scheme in ("s3a", "s3n") else f"{scheme}://{unquote(rest)}"


def archive(spark: SparkSession, removal: DataFrame, assets: DataFrame, archive_dir: str,
            kept_out: str, existing_names: DataFrame | None = None, now: int | None = None,
            algo: str = "sha256", dry_run: bool = False) -> DataFrame:
    """Move planned rows to the archive, verified, with an undo manifest.

    ``removal`` rows need ``asset_id, path, size, hash`` (as ``reclaim_plan`` gives them).
    Steps: destination checks (J6 W4) -> write archive rows with payload (S9) ->
    read back and re-hash (S9) -> commit the manifest (S7, before anything is
    removed) -> write the kept table to ``kept_out`` (U3).  Verification is per
    row: ``result`` is ``archived``, ``changed`` (content differs from the plan),
    ``copy_missing``, ``archived_before`` (another run recorded the same path and
    hash, and it was not undone), ``name_taken`` (a run that committed meanwhile has the name) or
    ``skipped`` (destination check failed).  Runs may overlap: each checks at its commit what others
    committed since it began, so a name is recorded once.  Rows that are
    archived now or were before are left out of the kept table, so a run that died
    after its manifest was written is finished by running it again.  Returns per-row
    ``status`` and ``result``; with ``dry_run`` only the destination checks run and
    nothing is written.
    """
    now = int(time.time()) if now is None else int(now)
    kept_norm = _norm_path(kept_out).rstrip("/") + "/"
    if any(_norm_path(f).startswith(kept_norm) for f in assets.inputFiles()):
        raise ValueError("kept_out must be a new location, not the table being read")
    log = _log(spark, archive_dir)
    seen = log.latest()
    recorded = materialize(_active_entries(spark, archive_dir, seen).select("from", "to", "hash"))
    if existing_names is None:
        # Names that verified runs archived and that were not undone since.
        existing_names = recorded.select(F.element_at(F.split("to", "/"), -1).alias("name"))
    base = F.element_at(F.split("path", "/"), -1)
    dest_root = archive_dir.rstrip("/") + "/"
    status = materialize(arc.destination_status(removal, existing_names, base))
    if dry_run:
        # Only the checks: what would move, what would be skipped, and why.
        return status
    movable = status.where(F.col("status") == "movable").withColumn(
        "to", F.concat(F.lit(dest_root), F.col("dest_name")))
    # Payload rows are picked map-side by broadcast ids (count-checked); the
    # narrow columns of the archive row come from the same asset row, so the
    # payload side never goes through a shuffle.
    rows = filter_by_ids(assets, movable, "asset_id", keep=True).select(
        "asset_id", F.col("path").alias("from"), F.concat(F.lit(dest_root), base).alias("to"),
        "name", "store", "size", "payload")
    written = arc.write_archive(rows.withColumn("algo", F.lit(algo)), archive_dir + "/data")
    # Per-row verification: re-read the written copies, re-hash, compare with
    # the plan.  Only rows that verify are recorded and removed; a row whose
    # content changed since planning (or whose copy is missing) stays.
    back = spark.read.parquet(written).select(
        "asset_id", content_hash(F.col("payload"), algo).alias("copy_hash"))
    checked = materialize(movable.select("asset_id", "hash").join(back, "asset_id", "left").select(
        "asset_id",
        F.when(F.col("copy_hash").isNull(), "copy_missing")
         .when(F.col("copy_hash") != F.col("hash"), "changed")
         .otherwise("archived").alias("result")))
    verified = checked.where(F.col("result") == "archived").select("asset_id")
    entries = movable.join(verified, "asset_id", "left_semi").select(
        F.col("path").alias("from"), "to", "size", "hash", F.lit(algo).alias("algo"))
    # The manifest names the verified run folder, so undo never reads a folder
    # left behind by a failed run.  It is committed before the kept table is
    # published (nothing is removed without its undo record).
    entries = materialize(entries)
    taken = literal_table(spark, [], "path string, result string")
    if verified.limit(1).count():
        taken = _commit_archive(spark, archive_dir, log, seen, entries, written, now)
    # Overwrite is safe: kept_out is checked above not to be the input, and a
    # re-run after a failure replaces a partial result.
    before = (status.where("status = 'destination_exists'").join(
        recorded.select(F.col("from").alias("path"), "hash").distinct(), ["path", "hash"], "left_semi")
        .select("asset_id", F.lit("archived_before").alias("result")))
    lost = movable.join(taken, "path").select("asset_id", F.col("result").alias("other"))
    checked = checked.join(lost, "asset_id", "left").select("asset_id", F.coalesce("other", "result").alias("result"))
    checked = materialize(checked.unionByName(before))
    gone = checked.where(F.col("result").isin("archived", "archived_before")).select("asset_id")
    pln.kept_assets(assets, gone).write.mode("overwrite").parquet(kept_out)
    return status.join(checked, "asset_id", "left").withColumn(
        "result", F.coalesce(F.col("result"), F.lit("skipped")))


_ENTRY = "created_unix bigint, destination string, `from` string, `to` string, size bigint, hash string, algo string"


_ARCHIVED = ("asset_id bigint, `from` string, `to` string, name string, store string, size bigint, payload binary, algo string, "
             "run string")


def _log(spark: SparkSession, archive_dir: str) -> CommitLog:
    """The commit log; lines that an older version appended without one are taken over by its first commit."""
    root = archive_dir.rstrip("/")
    log = CommitLog(spark, f"{root}/log")
    if not log.exists() and any_path(spark, f"{root}/manifest/*.json"):  # lines of logged runs stand in run=... folders
        log.put(0, {"kind": "snapshot", "run": _write_snapshot(_unlogged_entries(spark, root), root), "covers": -1})
    return log


def _commit_archive(spark: SparkSession, archive_dir: str, log: CommitLog, seen: int, entries: DataFrame, written: str,
                    now: int) -> DataFrame:
    """Commits the entries of one run but those whose name another run took meanwhile; returns these with their result."""
    root = archive_dir.rstrip("/")
    state = {"entries": entries, "taken": literal_table(spark, [], "path string, result string")}

    def stage() -> dict:
        if not state["entries"].limit(1).count():
            return {"kind": "nothing", "run": None}
        return {"kind": "archive", "run": arc.write_lines(arc.manifest_lines(state["entries"], written, now), f"{root}/manifest")}

    def check(first: int, last: int) -> dict:
        since = _active_entries(spark, archive_dir, last).select("to", F.col("from").alias("o_from"), F.col("hash").alias("o_hash"))
        hit = state["entries"].join(since, "to")
        same = (F.col("from") == F.col("o_from")) & (F.col("hash") == F.col("o_hash"))
        hit = materialize(hit.groupBy(F.col("from").alias("path")).agg(F.max(same).alias("same")).select(
            "path", F.when(F.col("same"), "archived_before").otherwise("name_taken").alias("result")))
        if not hit.limit(1).count():
            return {}
        state["taken"] = state["taken"].unionByName(hit)
        state["entries"] = materialize(state["entries"].join(hit.select(F.col("path").alias("from")), "from", "left_anti"))
        return stage()

    log.commit(seen, stage(), check)
    return state["taken"]


def _unlogged_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries with ``undone`` of manifest lines appended without a log."""
    entries, _ = arc.manifest_entries(arc.read_manifest(spark, f"{root}/manifest/*.json"))
    if not any_path(spark, f"{root}/undone/*.json"):
        return entries.withColumn("undone", F.lit(False))
    back, _ = arc.manifest_entries(arc.read_manifest(spark, f"{root}/undone/*.json"))
    return _with_undone(entries.withColumn("undone", F.lit(False)), back)


def _with_undone(entries: DataFrame, back: DataFrame) -> DataFrame:
    back = back.select("destination", "to").distinct().withColumn("_back", F.lit(True))
    return entries.join(back, ["destination", "to"], "left").withColumn(
        "undone", F.col("undone") | F.coalesce("_back", F.lit(False))).select(*entries.columns)


def _write_snapshot(entries: DataFrame, root: str) -> str:
    run = f"s{uuid.uuid4().hex}"
    entries.write.parquet(f"{root}/snapshots/run={run}")
    return run


def _entries(spark: SparkSession, archive_dir: str, upto: int | None = None) -> DataFrame:
    """Entries of all committed runs (up to commit ``upto``), each with ``undone``: a later undo moved the row back.

    The newest snapshot, and the lines of the runs committed after it: three partitioned reads, however many runs there are.
    """
    root = archive_dir.rstrip("/")
    log = _log(spark, archive_dir)
    none = literal_table(spark, [], _ENTRY).withColumn("undone", F.lit(False))
    if not log.exists():
        return none
    commits = log.records()
    if upto is not None:
        commits = commits.where(F.col("version") <= upto)
    newest = commits.where(F.col("kind") == "snapshot").orderBy(F.desc("version")).select("run", "covers").first()
    entries, covers = none, -1
    if newest is not None:
        entries, covers = spark.read.parquet(f"{root}/snapshots/run={newest.run}").select(*none.columns), newest.covers
    later = commits.where(F.col("version") > covers)
    if path_exists(spark, f"{root}/manifest") and later.where(F.col("kind") == "archive").limit(1).count():
        fresh, _ = arc.manifest_entries(arc.committed_lines(spark, f"{root}/manifest", later.where(F.col("kind") == "archive")))
        entries = entries.unionByName(fresh.withColumn("undone", F.lit(False)))
    if path_exists(spark, f"{root}/undone") and later.where(F.col("kind") == "undo").limit(1).count():
        back, _ = arc.manifest_entries(arc.committed_lines(spark, f"{root}/undone", later.where(F.col("kind") == "undo")))
        entries = _with_undone(entries, back)
    return entries


def compact_manifest(spark: SparkSession, archive_dir: str) -> int:
    """Writes the entries of all commits so far, with their undone state, as one snapshot; returns its commit.

    Later reads start from it.  What others commit meanwhile has a higher number than it covers and is read as before.
    """
    log = _log(spark, archive_dir)
    seen = log.latest()
    run = _write_snapshot(_entries(spark, archive_dir, seen), archive_dir.rstrip("/"))
    return log.commit(seen, {"kind": "snapshot", "run": run, "covers": seen}, lambda first, last: None)


def _active_entries(spark: SparkSession, archive_dir: str, upto: int | None = None) -> DataFrame:
    return _entries(spark, archive_dir, upto).where(~F.col("undone"))


def _run_of(destination: str = "destination") -> F.Column:
    return F.regexp_extract(F.col(destination), "/run=([^/]+)/*$", 1)


def _runs(spark: SparkSession, archive_dir: str, entries: DataFrame) -> DataFrame | None:
    """The archived rows of the runs that the entries name, with their ``destination``.

    One partitioned read of all run folders, of which only the named ones are opened (dynamic partition pruning); a
    folder that is gone has no rows.
    """
    data = f"{archive_dir.rstrip('/')}/data"
    if not path_exists(spark, data):
        return None
    named = entries.where(F.col("destination").contains("/run=")).select("destination", _run_of().alias("run")).distinct()
    return spark.read.schema(_ARCHIVED).parquet(data).join(F.broadcast(named), "run").drop("run")


def undo(spark: SparkSession, archive_dir: str, live: DataFrame, algo: str = "sha256") -> DataFrame:
    """Undo status per manifest entry (J8); archived copies are re-hashed from the
    run folders the manifest names.  A run folder that is gone gives ``archive_missing``.  Entries that were undone show only while
    their path is occupied."""
    return _undo(spark, archive_dir, live, algo).drop("destination")


def _undo(spark: SparkSession, archive_dir: str, live: DataFrame, algo: str) -> DataFrame:
    entries = materialize(_entries(spark, archive_dir))
    rows = _runs(spark, archive_dir, entries)
    if rows is None:
        archived = literal_table(spark, [], "destination string, path string, hash string")
    else:
        archived = rows.select("destination", F.col("to").alias("path"), content_hash(F.col("payload"), algo).alias("hash"))
    status = arc.undo_status(entries, live, archived, extra=("destination", "undone"))
    return status.where(~F.col("undone") | (F.col("status") == "occupied")).drop("undone")


def apply_undo(spark: SparkSession, archive_dir: str, live: DataFrame, out: str,
               algo: str = "sha256", now: int | None = None) -> DataFrame:
    """Restore archived rows whose undo status is ``restore`` into a new live table.

    ``live`` is the current asset table (``asset_id, path, name, store, size,
    payload``); ``out`` receives live + restored rows (a new location, checked
    not to be an input).  Restored rows are picked from the verified run folders
    by their run and archive path.  After ``out`` is written the restored entries are
    recorded as undone, so their names are free and their rows can be archived again.
    Returns the per-entry status; running it again on the restored table reports
    ``occupied`` for everything (idempotent).
    """
    out_norm = _norm_path(out).rstrip("/") + "/"
    if any(_norm_path(f).startswith(out_norm) for f in live.inputFiles()):
        raise ValueError("out must be a new location, not the table being read")
    seen = _log(spark, archive_dir).latest()
    status = materialize(_undo(spark, archive_dir, live.select("path"), algo))
    todo = status.where(F.col("status") == "restore")
    rows = _runs(spark, archive_dir, todo)
    if rows is None:
        live.write.mode("overwrite").parquet(out)
        return status.drop("destination")
    key = F.concat_ws("\u0001", "destination", "to")
    picked = filter_by_ids(rows.withColumn("_key", key), todo.select(key.alias("_key")), "_key", keep=True)
    restored = picked.select("asset_id", F.col("from").alias("path"), "name", "store", "size", "payload")
    live.unionByName(restored).write.mode("overwrite").parquet(out)
    _commit_undo(spark, archive_dir, seen, todo, int(time.time()) if now is None else now)
    return status.drop("destination")


def _commit_undo(spark: SparkSession, archive_dir: str, seen: int, todo: DataFrame, now: int) -> None:
    """Records entries as undone, each once even if another undo recorded some of them meanwhile."""
    root, log = archive_dir.rstrip("/"), _log(spark, archive_dir)
    state = {"todo": todo}

    def stage() -> dict:
        known = _active_entries(spark, archive_dir).select("destination", "to", "hash", "algo")
        back = materialize(state["todo"].join(known, ["destination", "to"]))
        if not back.limit(1).count():
            return {"kind": "nothing", "run": None}
        # Lines carry the destination of their entries: one line per destination and bucket.
        return {"kind": "undo", "run": arc.write_lines(arc.undo_lines(back, now), f"{root}/undone")}

    log.commit(seen, stage(), lambda first, last: stage())


def catalog_headers(files: DataFrame, from_paths: bool = False) -> DataFrame:
    """S3 -> P11: decode headers (payload column, or open ``path`` in tasks), then
    summarize the decoded long table in one aggregation (it is read once)."""
    decoded = hdr.decode_paths(files) if from_paths else hdr.decode_payloads(files)
    return cat.summarize_decoded(decoded)


KEPT_HEADERS = StructType([*hdr.DECODED.fields, StructField("size", LongType()), StructField("modificationTime", TimestampType()),
                           StructField("limits", StringType())])


def _kept_headers(spark: SparkSession, folder: str) -> KeptRows:
    return KeptRows(spark, folder, KEPT_HEADERS)


def catalog_headers_kept(spark: SparkSession, files: DataFrame, folder: str, limits: hdr.Limits = hdr.DEFAULT_LIMITS) -> DataFrame:
    """``catalog_headers`` of listed files (path, size, modificationTime), opening only files that changed.

    Decoded rows are kept in ``folder`` by path, size, modification time and limits.  Files that could not be read are tried
    again, those whose header is damaged are not.  ``compact_headers`` drops rows of files that are gone or have changed.
    """
    table = _kept_headers(spark, folder)
    listing = files.select(*VERSION)
    known = table.rows().where(F.col("limits") == repr(limits))
    readable = ~F.coalesce(F.col("error").startswith("io:"), F.lit(False))
    done = known.where((F.col("section") == "header") & readable).select(*VERSION)
    todo = materialize(listing.join(done, VERSION, "left_anti"))
    if todo.limit(1).count():
        fresh = hdr.decode_paths(todo.select("path"), limits=limits).join(todo, "path").withColumn("limits", F.lit(repr(limits)))
        table.add(fresh)
    rows = table.rows().where(F.col("limits") == repr(limits)).join(listing, VERSION, "left_semi")
    # A file that failed before may stand twice; its newest rows are those without the failure.
    good = rows.where((F.col("section") != "header") | readable)
    failed = rows.where((F.col("section") == "header") & ~readable).dropDuplicates(["path"])
    failed = failed.join(good.where("section = 'header'").select("path"), "path", "left_anti").select(*rows.columns)
    both = good.unionByName(failed).dropDuplicates(["path", "section", "pos"])
    return cat.summarize_decoded(both.select(*hdr.DECODED.fieldNames()))


def compact_headers(spark: SparkSession, files: DataFrame, folder: str) -> int:
    """Keeps the header rows of the listed file versions only; returns the commit."""
    return _kept_headers(spark, folder).compact(files)
