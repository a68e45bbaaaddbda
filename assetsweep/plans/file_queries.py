"""Named queries over trees of files that tasks write from ``documents`` and other tables, read back by the file jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from assetsweep.functions.hashing import TREE
from assetsweep.operators import archive as arc_ops
from assetsweep.plans import jobs, sample_files, sample_headers
from assetsweep.plans import report as rep
from assetsweep.plans.registry import MANAGED, MIN_SIZE, ARCHIVED_SQL, _archive_run, _scratch, doc_members_sql, document_duplicates, register
from assetsweep.session import spread
from assetsweep.sources import devices, tables
from assetsweep.sources import files as FS
from assetsweep.sources import headers as hdr

# Where a document's file stands: folders and names with a leading dot or underscore among others.
FILE_SQL = """
  SELECT doc_id, source, source || '/' || CASE doc_id % 3 WHEN 0 THEN '.cache' WHEN 1 THEN '_tmp' ELSE lang END AS folder,
         CASE doc_id % 4 WHEN 0 THEN '.h' || doc_id || '.gguf' WHEN 1 THEN '_u' || doc_id || '.gguf'
              WHEN 2 THEN 'sha256-' || doc_id ELSE 'note ' || doc_id || '.txt' END AS name,
         coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size
  FROM documents
"""


def _document_files(spark, sf_dir, magic: bool = False) -> str:
    """Writes every document as a file; with ``magic`` those with doc_id % 8 = 2 begin like a model header."""
    i = F.col("doc_id")
    folder = F.when(i % 3 == 0, F.lit(".cache")).when(i % 3 == 1, F.lit("_tmp")).otherwise(F.col("lang"))
    name = (F.when(i % 4 == 0, F.concat(F.lit(".h"), i, F.lit(".gguf"))).when(i % 4 == 1, F.concat(F.lit("_u"), i, F.lit(".gguf")))
            .when(i % 4 == 2, F.concat(F.lit("sha256-"), i)).otherwise(F.concat(F.lit("note "), i, F.lit(".txt"))))
    text = F.coalesce("text", F.lit(""))
    text = F.when(i % 8 == 2, F.concat(F.lit("GGUF"), text)).otherwise(text) if magic else text
    docs = spread(tables.read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    root = _scratch(spark, "files")
    sample_files.write_files(docs.select(F.concat_ws("/", "source", folder, name).alias("path"), F.encode(text, "UTF-8").alias("content")), root)
    return root


def _below(root: str):
    """The part of a listed path below the scratch folder."""
    return F.substring_index(F.col("path"), root.rsplit("/", 1)[-1] + "/", -1)


@register("file_listing", f"""
SELECT folder || '/' || name AS path, name, 'lake' AS store, size FROM ({FILE_SQL}) f WHERE doc_id % 4 < 2 AND size > 0
""")
def q_file_listing(spark, sf_dir):
    """Every non-empty ``*.gguf`` file of the tree, hidden names included."""
    root = _document_files(spark, sf_dir)
    return FS.list_files(spark, root, "*.gguf", "lake").select(_below(root).alias("path"), "name", "store", "size")


@register("store_scan", f"""
SELECT folder || '/' || name AS path, CASE WHEN source = 'src0' AND doc_id % 4 < 2 THEN 'first' ELSE 'whole' END AS store, size
FROM ({FILE_SQL}) f WHERE size > 0
""")
def q_store_scan(spark, sf_dir):
    """Two overlapping roots; a file below both counts once."""
    root = _document_files(spark, sf_dir)
    scan = FS.scan_stores(spark, [("whole", root, None), ("first", f"{root}/src0", "*.gguf")])
    return scan.select(_below(root).alias("path"), "store", "size")


@register("blob_models", f"""
SELECT folder || '/' || name AS path, 'ollama' AS store FROM ({FILE_SQL}) f WHERE doc_id % 8 = 2
""")
def q_blob_models(spark, sf_dir):
    """Of a blob store the blobs that begin with the header magic."""
    root = _document_files(spark, sf_dir, magic=True)
    return FS.select_models(FS.scan_stores(spark, [("ollama", root, None)])).select(_below(root).alias("path"), "store")


@register("file_dup_groups", f"""
SELECT size AS size_each, hash, CAST(COUNT(*) AS BIGINT) AS n_members, CAST(size * (COUNT(*) - 1) AS BIGINT) AS reclaimable FROM (
  SELECT size, sha256(unhex('02') || unhex(printf('%016x', size)) || unhex(sha256(unhex('00') || encode(text)))) AS hash
  FROM ({FILE_SQL}) f WHERE size > 0) x
GROUP BY size, hash HAVING COUNT(*) > 1
""")
def q_file_dup_groups(spark, sf_dir):
    """Duplicate files by the tree hash; every text is one range."""
    root = _document_files(spark, sf_dir)
    groups = jobs.find_file_duplicates(spark, [("lake", root, None)], 1, MANAGED, TREE).groups
    return groups.select("size_each", "hash", "n_members", "reclaimable")


@register("inventory_no_parse", f"""
SELECT folder || '/' || name AS path, name AS display_name, size, CAST(NULL AS VARCHAR) AS header_name
FROM ({FILE_SQL}) f WHERE doc_id % 4 < 2 AND size > 0
""")
def q_inventory_no_parse(spark, sf_dir):
    """P10: the inventory of files without reading a header."""
    root = _document_files(spark, sf_dir)
    found = jobs.file_inventory(spark, [("lake", root, "*.gguf")], no_parse=True).assets
    return found.select(_below(root).alias("path"), "display_name", "size", "header_name")


WINDOW_SQL = f"""
  SELECT size, sha256(encode(text)[1:4096]) AS head, sha256(encode(text)[greatest(1, octet_length(encode(text)) - 4095):]) AS tail
  FROM ({FILE_SQL}) f WHERE size >= {MIN_SIZE}
"""


@register("hash_cascade", f"""
WITH w AS ({WINDOW_SQL}),
s AS (SELECT size FROM w GROUP BY size HAVING COUNT(*) > 1),
t AS (SELECT size, head, tail, COUNT(*) AS n FROM w GROUP BY size, head, tail HAVING COUNT(*) > 1)
SELECT 'listed' AS step, CAST(COUNT(*) AS BIGINT) AS files, CAST(COALESCE(SUM(size), 0) AS BIGINT) AS bytes FROM w
UNION ALL SELECT 'size', CAST(COUNT(*) AS BIGINT), CAST(COALESCE(SUM(size), 0) AS BIGINT) FROM w WHERE size IN (SELECT size FROM s)
UNION ALL SELECT 'windows', CAST(COALESCE(SUM(n), 0) AS BIGINT), CAST(COALESCE(SUM(size * n), 0) AS BIGINT) FROM t
""")
def q_hash_cascade(spark, sf_dir):
    """Files and bytes left to hash after the sizes, and after both windows."""
    root = _document_files(spark, sf_dir)
    return FS.cascade_workload(FS.with_asset_ids(FS.list_files(spark, root, None)), MIN_SIZE).select("step", "files", "bytes")


@register("vram_devices", """
SELECT 'gpu' || s_suppkey AS device, CAST(s_suppkey % 4 AS BIGINT) AS n_gpus,
       CAST((s_suppkey % 4) * (10 * s_suppkey + 7) * 1048576 AS BIGINT) AS vram
FROM supplier
""")
def q_vram_devices(spark, sf_dir):
    """One export per supplier with 0 to 3 figures; an empty export keeps its device."""
    k = F.col("s_suppkey")
    lines = F.array_join(F.array_repeat((k * 10 + 7).cast("string"), (k % 4).cast("int")), "\n")
    rows = spread(tables.read_table(spark, sf_dir, "supplier").select("s_suppkey"))
    root = _scratch(spark, "vram")
    sample_files.write_files(rows.select(F.concat(F.lit("gpu"), k, F.lit(".csv")).alias("path"), F.encode(lines, "UTF-8").alias("content")), root)
    found = devices.read_vram_exports(spark, root)
    total = F.aggregate("vram", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("device", F.size("vram").cast("long").alias("n_gpus"), total.alias("vram"))


def _damaged_headers(batches):
    for batch in batches:
        paths, blobs = [], []
        for key, name, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = name.split()
            data = sample_headers.encode_header(3, [
                ("general.name", "str", name + " ~~"), ("tokens", "arr", ("str", words * 3)), ("scores", "arr", ("u32", list(range(size))))], [])
            paths.append(str(key))
            blobs.append(data.replace(b"~~", b"\xff\xfe"))  # no UTF-8 any more
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(blobs, pa.binary())], names=["path", "payload"])


def _decoded_parts(spark, sf_dir, limits):
    rows = spread(tables.read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    return hdr.decode_payloads(rows.mapInArrow(_damaged_headers, "path string, payload binary"), limits=limits).where("section = 'kv'")


@register("header_array_limits", """
SELECT p_partkey, k.key, CAST(CASE k.key WHEN 'tokens' THEN least(4, 3 * len(string_split(p_name, ' '))) ELSE least(2, p_size) END AS BIGINT) AS kept,
       CASE k.key WHEN 'tokens' THEN string_split(p_name, ' ')[1] ELSE '0' END AS first_item
FROM part, (VALUES ('tokens'), ('scores')) k(key)
""")
def q_header_array_limits(spark, sf_dir):
    """How many items of text and number arrays are kept."""
    kv = _decoded_parts(spark, sf_dir, hdr.Limits(keep_items=4, keep_fixed_items=2)).where("type = 'arr'")
    return kv.select(F.col("path").cast("long").alias("p_partkey"), "key", F.size("v_arr").cast("long").alias("kept"), F.get("v_arr", F.lit(0)).alias("first_item"))


@register("header_lossy_text", """
SELECT p_partkey, p_name || ' ' || chr(65533) || chr(65533) AS name FROM part
""")
def q_header_lossy_text(spark, sf_dir):
    """bytes that are no UTF-8 are shown as replacement characters."""
    kv = _decoded_parts(spark, sf_dir, hdr.DEFAULT_LIMITS).where("key = 'general.name'")
    return kv.select(F.col("path").cast("long").alias("p_partkey"), F.col("v_str").alias("name"))


@register("archive_created", f"""
SELECT path AS "from", size, CAST(1700000000 AS BIGINT) AS created_unix FROM ({ARCHIVED_SQL}) a WHERE result = 'archived'
""")
def q_archive_created(spark, sf_dir):
    """The committed entries carry the time the run was given."""
    _, root = _archive_run(spark, sf_dir)
    return jobs._entries(spark, root + "/archive").select("from", "size", "created_unix")


PER_ROW = 3


@register("group_chunks", f"""
SELECT group_id, CAST((n - 1) // {PER_ROW} AS BIGINT) AS chunk, CAST((total + {PER_ROW - 1}) // {PER_ROW} AS BIGINT) AS n_chunks,
       string_agg(CAST(asset_id AS VARCHAR) || ':' || path || ':' || store || ':' || CAST(is_keeper AS VARCHAR), ',' ORDER BY asset_id) AS members
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY asset_id) AS n, COUNT(*) OVER (PARTITION BY group_id) AS total
      FROM ({doc_members_sql(MIN_SIZE)}) m) x
GROUP BY group_id, total, (n - 1) // {PER_ROW}
""")
def q_group_chunks(spark, sf_dir):
    """The groups of the report with their members, at most three in a row."""
    chunks = rep.group_chunks(document_duplicates(spark, sf_dir), PER_ROW)
    one = lambda m: F.concat_ws(":", m["asset_id"].cast("string"), m["path"], m["store"], m["is_keeper"].cast("string"))
    return chunks.select("group_id", "chunk", "n_chunks", F.array_join(F.transform("members", one), ",").alias("members"))
