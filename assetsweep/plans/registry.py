"""Named queries over the driver tables, each with an equivalent DuckDB SQL.

Every query reads whole tables (or data Spark derives from them); parameters
such as the preferred-store list or the policy cap are fixed values below.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetsweep.functions import scalars as S
from assetsweep.operators import archive as arc_ops
from assetsweep.operators import capacity as cap_ops
from assetsweep.operators import catalog as cat_ops
from assetsweep.operators import duplicates as dup
from assetsweep.operators import inventory as inv
from assetsweep.operators import plan as plan_ops
from assetsweep.operators.skew import filter_by_ids
from assetsweep.plans import jobs, sample_headers
from assetsweep.session import checkpoint_dir, literal_table, materialize, spread
from assetsweep.sources import headers as hdr
from assetsweep.sources import manifests as man
from assetsweep.sources import tables

# Parameters of the registered queries (fixed values, used by both sides).
MANAGED = ["src0", "src1", "src2"]
MIN_SIZE = 1
MIN_SIZE_4K = 4096
POLICY_CAP = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _in_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def document_duplicates(spark: SparkSession, sf_dir: str, min_size: int = MIN_SIZE) -> dup.Duplicates:
    assets = tables.documents_assets(spark, sf_dir)
    return dup.find_duplicates(dup.fingerprint_payloads(assets), min_size=min_size, managed=MANAGED)


# SQL building blocks ---------------------------------------------------------
DOC_ASSETS_SQL = """
  SELECT doc_id AS asset_id, source AS store,
         source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path,
         CAST(octet_length(encode(text)) AS BIGINT) AS size,
         sha256(text) AS hash
  FROM documents WHERE text IS NOT NULL
"""


def doc_groups_sql(min_size: int = MIN_SIZE) -> str:
    return f"""
  SELECT size, hash, COUNT(*) AS n_members, MIN(asset_id) AS group_id,
         COALESCE(MIN(asset_id) FILTER (WHERE store IN ({_in_list(MANAGED)})), MIN(asset_id)) AS keeper_id,
         MIN(store) <> MAX(store) AS spans_stores
  FROM ({DOC_ASSETS_SQL}) a
  WHERE size >= {min_size} AND size > 0
  GROUP BY size, hash HAVING COUNT(*) > 1
"""


def doc_members_sql(min_size: int = MIN_SIZE) -> str:
    return f"""
  SELECT g.group_id, a.asset_id, a.path, a.store, a.size, g.keeper_id,
         a.asset_id = g.keeper_id AS is_keeper, a.asset_id = g.group_id AS is_first
  FROM ({DOC_ASSETS_SQL}) a JOIN ({doc_groups_sql(min_size)}) g
    ON a.size = g.size AND a.hash = g.hash
"""


GROUP_COLS = ["group_id", "size_each", "n_members", "reclaimable", "keeper_id", "hash", "spans_stores"]


def _group_select(g: DataFrame) -> DataFrame:
    return g.select(*GROUP_COLS)


def _group_sql(min_size: int) -> str:
    return f"""
SELECT group_id, size AS size_each, n_members, CAST(size * (n_members - 1) AS BIGINT) AS reclaimable,
       keeper_id, hash, spans_stores
FROM ({doc_groups_sql(min_size)}) g
"""


# Duplicate detection --------------------------------------------------------
@register("dup_groups", _group_sql(MIN_SIZE))
def q_dup_groups(spark, sf_dir):
    return _group_select(document_duplicates(spark, sf_dir).groups)


@register("dup_groups_min4k", _group_sql(MIN_SIZE_4K))
def q_dup_groups_min4k(spark, sf_dir):
    return _group_select(document_duplicates(spark, sf_dir, MIN_SIZE_4K).groups)


@register("dup_members", doc_members_sql(MIN_SIZE))
def q_dup_members(spark, sf_dir):
    return document_duplicates(spark, sf_dir).members().drop("hash")


@register("dup_totals", f"""
SELECT COUNT(*) AS n_groups, CAST(COALESCE(SUM(n_members), 0) AS BIGINT) AS n_members,
       CAST(COALESCE(SUM(size * (n_members - 1)), 0) AS BIGINT) AS reclaimable
FROM ({doc_groups_sql(MIN_SIZE)}) g
""")
def q_dup_totals(spark, sf_dir):
    return document_duplicates(spark, sf_dir).totals()


SIZE_CAND_SQL = f"""
SELECT size, COUNT(*) AS n, MIN(asset_id) AS min_id
FROM ({DOC_ASSETS_SQL}) a WHERE size >= {MIN_SIZE} AND size > 0
GROUP BY size HAVING COUNT(*) > 1
"""


@register("size_candidates", SIZE_CAND_SQL)
def q_size_candidates(spark, sf_dir):
    return dup.size_candidates(tables.documents_assets(spark, sf_dir), MIN_SIZE)


@register("hash_workload", f"""
SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS files, CAST(COALESCE(SUM(size * n), 0) AS BIGINT) AS bytes
FROM ({SIZE_CAND_SQL}) c
""")
def q_hash_workload(spark, sf_dir):
    return dup.hash_workload(dup.size_candidates(tables.documents_assets(spark, sf_dir), MIN_SIZE))


@register("bucket_guard", f"""
SELECT size, hash, COUNT(*) AS n, TRUE AS edges_agree
FROM ({DOC_ASSETS_SQL}) a WHERE size >= {MIN_SIZE} AND size > 0
GROUP BY size, hash HAVING COUNT(*) > 1
""")
def q_bucket_guard(spark, sf_dir):
    fp = dup.fingerprint_payloads(tables.documents_assets(spark, sf_dir))
    return dup.bucket_guard(fp, MIN_SIZE)


@register("dup_groups_pages", """
SELECT MIN(page_id) AS group_id, COUNT(*) AS n_members
FROM pages WHERE html IS NOT NULL AND octet_length(encode(html)) > 0
GROUP BY octet_length(encode(html)), sha256(html) HAVING COUNT(*) > 1
""")
def q_dup_groups_pages(spark, sf_dir):
    fp = dup.fingerprint_payloads(tables.pages_assets(spark, sf_dir))
    return dup.find_duplicates(fp, min_size=MIN_SIZE).groups.select("group_id", "n_members")


@register("dup_groups_conversations", """
SELECT MIN(conv_id * 16777216 + turn) AS group_id, COUNT(*) AS n_members
FROM conversations WHERE text IS NOT NULL AND octet_length(encode(text)) > 0
GROUP BY octet_length(encode(text)), sha256(text) HAVING COUNT(*) > 1
""")
def q_dup_groups_conversations(spark, sf_dir):
    fp = dup.fingerprint_payloads(tables.conversations_assets(spark, sf_dir))
    return dup.find_duplicates(fp, min_size=MIN_SIZE).groups.select("group_id", "n_members")


# Keeper, plan and policy ----------------------------------------------------


@register("keeper_preferred", f"""
SELECT g.group_id, g.keeper_id, a.store AS keeper_store, a.store IN ({_in_list(MANAGED)}) AS keeper_managed
FROM ({doc_groups_sql(MIN_SIZE)}) g JOIN ({DOC_ASSETS_SQL}) a ON a.asset_id = g.keeper_id
""")
def q_keeper_preferred(spark, sf_dir):
    d = document_duplicates(spark, sf_dir)
    m = d.members().where("is_keeper")
    return m.select("group_id", "keeper_id", F.col("store").alias("keeper_store"),
                    F.col("store").isin(MANAGED).alias("keeper_managed"))


REMOVAL_COLS = "group_id, asset_id, path, store, size, keeper_id"


def removal_sql(keep: str, cap: int | None = None) -> str:
    keep_col = "keeper_id" if keep == "preferred" else "group_id"
    gate = "" if cap is None else f"AND m.size <= {cap}"
    return f"""
SELECT m.group_id, m.asset_id, m.path, m.store, m.size, m.{keep_col} AS keeper_id
FROM ({doc_members_sql(MIN_SIZE)}) m
WHERE m.asset_id <> m.{keep_col} {gate}
"""


@register("keeper_first", removal_sql("first"))
def q_keeper_first(spark, sf_dir):
    return plan_ops.reclaim_plan(document_duplicates(spark, sf_dir), keep="first").removal.drop("hash")


@register("removal_plan", removal_sql("preferred"))
def q_removal_plan(spark, sf_dir):
    return plan_ops.reclaim_plan(document_duplicates(spark, sf_dir), keep="preferred").removal.drop("hash")


@register("kept_documents", f"""
SELECT d.doc_id, d.source, CAST(octet_length(encode(d.text)) AS BIGINT) AS size
FROM documents d WHERE d.doc_id NOT IN (SELECT asset_id FROM ({removal_sql('preferred')}) r)
""")
def q_kept_documents(spark, sf_dir):
    docs = tables.read_table(spark, sf_dir, "documents")
    removal = plan_ops.reclaim_plan(document_duplicates(spark, sf_dir), keep="preferred").removal
    kept = plan_ops.kept_assets(docs.withColumnRenamed("doc_id", "asset_id"), removal)
    return kept.select(F.col("asset_id").alias("doc_id"), "source",
                       F.octet_length("text").cast("long").alias("size"))


@register("policy_allowed", f"""
SELECT group_id, size_each, n_members FROM ({_group_sql(MIN_SIZE)}) g WHERE size_each <= {POLICY_CAP}
""")
def q_policy_allowed(spark, sf_dir):
    p = plan_ops.reclaim_plan(document_duplicates(spark, sf_dir), cap=POLICY_CAP)
    return p.allowed.select("group_id", "size_each", "n_members")


@register("policy_blocked", f"""
SELECT group_id, size_each, n_members FROM ({_group_sql(MIN_SIZE)}) g WHERE size_each > {POLICY_CAP}
""")
def q_policy_blocked(spark, sf_dir):
    p = plan_ops.reclaim_plan(document_duplicates(spark, sf_dir), cap=POLICY_CAP)
    return p.blocked.select("group_id", "size_each", "n_members")


@register("policy_blocked_rollup", f"""
SELECT COUNT(*) AS blocked_groups, CAST(COALESCE(SUM(reclaimable), 0) AS BIGINT) AS blocked_bytes
FROM ({_group_sql(MIN_SIZE)}) g WHERE size_each > {POLICY_CAP}
""")
def q_policy_blocked_rollup(spark, sf_dir):
    return plan_ops.reclaim_plan(document_duplicates(spark, sf_dir), cap=POLICY_CAP).blocked_rollup()


@register("policy_removal", removal_sql("preferred", POLICY_CAP))
def q_policy_removal(spark, sf_dir):
    return plan_ops.reclaim_plan(document_duplicates(spark, sf_dir), cap=POLICY_CAP).removal.drop("hash")


@register("policy_rows_over_cap", f"""
SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS size
FROM documents WHERE octet_length(encode(text)) > {POLICY_CAP}
""")
def q_policy_rows_over_cap(spark, sf_dir):
    a = tables.documents_assets(spark, sf_dir)
    _, over = plan_ops.row_gate(a, POLICY_CAP)
    return over.select(F.col("asset_id").alias("doc_id"), F.col("store").alias("source"), "size")


# Re-verification against a changed present state ----------------------------
# The present state: German documents were edited (each differently), and the
# whole of source src3 has disappeared.
EDITED_LANG = "de"
GONE_SOURCE = "src3"

CURRENT_SQL = f"""
  SELECT doc_id AS asset_id,
         CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS hash
  FROM (SELECT doc_id, CASE WHEN lang = '{EDITED_LANG}' THEN text || ' #' || CAST(doc_id AS VARCHAR)
                            ELSE text END AS t
        FROM documents WHERE source <> '{GONE_SOURCE}') c
"""


def current_documents(spark, sf_dir):
    docs = tables.read_table(spark, sf_dir, "documents").where(F.col("source") != GONE_SOURCE)
    edited = F.when(F.col("lang") == EDITED_LANG,
                    F.concat(F.col("text"), F.lit(" #"), F.col("doc_id").cast("string"))
                    ).otherwise(F.col("text"))
    docs = docs.withColumn("text", edited)
    return dup.fingerprint_payloads(tables.text_assets(docs, "doc_id", "text", "source"))


VERIFY_SQL = f"""
SELECT r.group_id, r.asset_id, r.keeper_id, r.size,
       CASE WHEN t.hash IS NULL THEN 'missing'
            WHEN k.hash IS NULL THEN 'keeper_missing'
            WHEN t.hash <> k.hash OR t.size <> k.size THEN 'changed'
            ELSE 'ok' END AS status
FROM ({removal_sql('preferred')}) r
LEFT JOIN ({CURRENT_SQL}) t ON t.asset_id = r.asset_id
LEFT JOIN ({CURRENT_SQL}) k ON k.asset_id = r.keeper_id
"""


def _verify(spark, sf_dir):
    removal = plan_ops.reclaim_plan(document_duplicates(spark, sf_dir)).removal
    return plan_ops.verify_plan(removal, current_documents(spark, sf_dir))


@register("verify_plan", VERIFY_SQL)
def q_verify_plan(spark, sf_dir):
    return _verify(spark, sf_dir)


@register("verify_summary", f"""
SELECT status, COUNT(*) AS n, CAST(COALESCE(SUM(size), 0) AS BIGINT) AS bytes
FROM ({VERIFY_SQL}) v GROUP BY status
""")
def q_verify_summary(spark, sf_dir):
    return plan_ops.status_rollup(_verify(spark, sf_dir))


# Inventory ------------------------------------------------------------------

# Store roots over page URLs: plain string-prefix semantics (reference
# behaviour); ``http`` is a prefix of every other root and ``ftp://`` matches
# nothing and is flagged missing.
URL_STORES = [("secure", "https://", False), ("plain", "http://", False), ("blog", "http://blog.", False),
              ("mobile", "https://m.", False), ("ftp", "ftp://", True), ("any_http", "http", False)]
# Store roots over document paths (source/lang/doc_id) with a path boundary:
# ``src1`` must not count ``src10/...``.
PATH_STORES = [("s1", "src1", False), ("s1_en", "src1/en", False), ("s2", "src2/", False),
               ("none", "nosuch", True)]


def _stores_df(spark, rows):
    return literal_table(spark, rows, "kind string, root string, missing boolean")


def _stores_sql(rows):
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, '{r}' AS root, {str(m).upper()} AS missing"
                              for k, r, m in rows)


@register("store_summary_prefix", f"""
SELECT s.kind, s.root, CAST(COUNT(p.page_id) AS BIGINT) AS files,
       CAST(COALESCE(SUM(octet_length(encode(p.html))), 0) AS BIGINT) AS bytes, s.missing
FROM ({_stores_sql(URL_STORES)}) s LEFT JOIN pages p ON starts_with(p.url, s.root)
GROUP BY s.kind, s.root, s.missing
""")
def q_store_summary_prefix(spark, sf_dir):
    return inv.store_summaries(tables.pages_assets(spark, sf_dir), _stores_df(spark, URL_STORES),
                               boundary=False)


@register("store_summary_boundary", f"""
SELECT s.kind, s.root, CAST(COUNT(a.asset_id) AS BIGINT) AS files,
       CAST(COALESCE(SUM(a.size), 0) AS BIGINT) AS bytes, s.missing
FROM ({_stores_sql(PATH_STORES)}) s LEFT JOIN ({DOC_ASSETS_SQL}) a
  ON starts_with(a.path, CASE WHEN s.root LIKE '%/' THEN s.root ELSE s.root || '/' END) OR a.path = s.root
GROUP BY s.kind, s.root, s.missing
""")
def q_store_summary_boundary(spark, sf_dir):
    return inv.store_summaries(tables.documents_assets(spark, sf_dir), _stores_df(spark, PATH_STORES),
                               boundary=True)


@register("store_totals", """
SELECT source AS store, COUNT(*) AS files, CAST(SUM(octet_length(encode(text))) AS BIGINT) AS bytes
FROM documents GROUP BY source
""")
def q_store_totals(spark, sf_dir):
    return inv.per_store(tables.documents_assets(spark, sf_dir))


@register("inventory_totals", """
SELECT COUNT(*) AS total_files, CAST(COALESCE(SUM(octet_length(encode(text))), 0) AS BIGINT) AS total_bytes
FROM documents
""")
def q_inventory_totals(spark, sf_dir):
    return inv.totals(tables.documents_assets(spark, sf_dir))


# File names built from documents: split-style stems (five digits or not, empty
# base for Spanish documents) with a .gguf / .bin / no extension.
def _doc_names(spark, sf_dir, *more):
    d = tables.read_table(spark, sf_dir, "documents")
    base = F.when(F.col("lang") == "es", F.lit("")).otherwise(F.concat_ws("-", "lang", "source"))
    stem = F.concat(base, F.lit("-"), F.col("n_chars").cast("string"), F.lit("-of-"),
                    F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))
    ext = F.when(F.col("lang") == "en", ".gguf").when(F.col("lang") == "fr", ".bin").otherwise("")
    name = F.concat(stem, ext)
    return d.select(F.col("doc_id").alias("asset_id"), name.alias("name"),
                    F.concat_ws("/", F.col("source"), name).alias("path"),
                    F.octet_length("text").cast("long").alias("size"), *more)


DOC_NAMES_SQL = """
  SELECT doc_id AS asset_id, name, source || '/' || name AS path,
         CAST(octet_length(encode(text)) AS BIGINT) AS size
  FROM (SELECT *, (CASE WHEN lang = 'es' THEN '' ELSE lang || '-' || source END) || '-' ||
                  CAST(n_chars AS VARCHAR) || '-of-' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') ||
                  (CASE WHEN lang = 'en' THEN '.gguf' WHEN lang = 'fr' THEN '.bin' ELSE '' END) AS name
        FROM documents) d
"""
SPLIT_RE = r"^(.*)-([0-9]{5})-of-([0-9]{5})\z"
NAME_PARTS_SQL = f"""
  SELECT asset_id, name, path, size, stem,
         CASE WHEN regexp_matches(name, '.\\.[^.]*$') THEN regexp_extract(name, '.\\.([^.]*)$', 1) END AS ext,
         CASE WHEN regexp_matches(stem, '{SPLIT_RE}') THEN regexp_extract(stem, '{SPLIT_RE}', 1) END AS split_group
  FROM (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem FROM ({DOC_NAMES_SQL}) n) s
"""


@register("shard_key", f"""
SELECT asset_id, name, stem, ext, split_group,
       COALESCE(ext = 'gguf', FALSE) OR split_group IS NOT NULL AS looks_like_model
FROM ({NAME_PARTS_SQL}) p
""")
def q_shard_key(spark, sf_dir):
    a = inv.with_name_parts(_doc_names(spark, sf_dir))
    looks = F.coalesce(F.col("ext") == "gguf", F.lit(False)) | F.col("split_group").isNotNull()
    return a.select("asset_id", "name", "stem", "ext", "split_group", looks.alias("looks_like_model"))


@register("shard_rollup", f"""
SELECT COALESCE(split_group, path) AS model_key, COUNT(*) AS shards, CAST(SUM(size) AS BIGINT) AS weights_bytes
FROM ({NAME_PARTS_SQL}) p GROUP BY COALESCE(split_group, path)
""")
def q_shard_rollup(spark, sf_dir):
    return inv.shard_rollup(inv.with_name_parts(_doc_names(spark, sf_dir)))


# Manifests: one manifest per lineitem row at registry.example/library/m<order>/v<line>,
# with a model layer (part) and a params layer (supplier).  Returned lines ('R')
# carry ``layers`` as an object instead of a list, and accepted seventh lines
# ('A', line 7) are unterminated JSON; both must yield no layers.


def _manifest_rows(spark, sf_dir):
    li = spread(tables.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"))
    s = lambda c: F.col(c).cast("long").cast("string")
    model = F.concat(F.lit('{"digest":"sha256:p'), s("l_partkey"),
                     F.lit('","mediaType":"application/vnd.model","size":'), s("l_quantity"), F.lit("}"))
    params = F.concat(F.lit('{"digest":"sha256:s'), s("l_suppkey"),
                      F.lit('","mediaType":"application/vnd.params","size":'), s("l_linenumber"), F.lit("}"))
    head = F.concat(F.lit('{"schemaVersion":2,"config":{"digest":"sha256:o'), s("l_orderkey"), F.lit('"},'))
    doc = (F.when(F.col("l_returnflag") == "R", F.concat(head, F.lit('"layers":'), model, F.lit("}")))
           .when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7),
                 F.concat(head, F.lit('"layers":['), model))
           .otherwise(F.concat(head, F.lit('"layers":['), model, F.lit(","), params, F.lit("]}"))))
    rel = F.concat(F.lit("registry.example/library/m"), s("l_orderkey"), F.lit("/v"), s("l_linenumber"))
    return li.select(rel.alias("rel_path"), doc.alias("json"))


MANIFEST_OK = "l_returnflag <> 'R' AND NOT (l_returnflag = 'A' AND l_linenumber = 7)"
MANIFEST_TAGS_SQL = f"""
SELECT blob, MIN(tag) AS tag, COUNT(*) AS n_refs FROM (
  SELECT 'sha256-p' || CAST(l_partkey AS VARCHAR) AS blob,
         'm' || CAST(l_orderkey AS VARCHAR) || ':v' || CAST(l_linenumber AS VARCHAR) AS tag
  FROM lineitem WHERE {MANIFEST_OK}
  UNION ALL
  SELECT 'sha256-s' || CAST(l_suppkey AS VARCHAR),
         'm' || CAST(l_orderkey AS VARCHAR) || ':v' || CAST(l_linenumber AS VARCHAR)
  FROM lineitem WHERE {MANIFEST_OK}) t
GROUP BY blob
"""


@register("manifest_tags", MANIFEST_TAGS_SQL)
def q_manifest_tags(spark, sf_dir):
    return man.manifest_tags(_manifest_rows(spark, sf_dir))


@register("blob_tag_join", f"""
SELECT p.p_partkey, 'sha256-p' || CAST(p.p_partkey AS VARCHAR) AS name, t.tag
FROM part p LEFT JOIN ({MANIFEST_TAGS_SQL}) t ON t.blob = 'sha256-p' || CAST(p.p_partkey AS VARCHAR)
""")
def q_blob_tag_join(spark, sf_dir):
    blobs = tables.read_table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("sha256-p"), F.col("p_partkey").cast("string")).alias("name"))
    return inv.attach_tags(blobs, man.manifest_tags(_manifest_rows(spark, sf_dir))).select(
        "p_partkey", "name", "tag")


# Capacity ---------------------------------------------------------------------

GIB = 1024 ** 3
# Machine profiles (fixed values): RAM 16 GiB with a 6 GiB GPU, 16 GiB with a
# 12 GiB GPU, 4 GiB without GPU, and a machine whose memory is unknown.
DEVICES = [("ram16_gpu6", 16 * GIB, [6 * GIB]), ("ram16_gpu12", 16 * GIB, [12 * GIB]),
           ("ram4", 4 * GIB, []), ("unknown", 0, [])]
CONTEXTS = [4096, 32768]


def _part_catalog(spark, sf_dir):
    p = tables.read_table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        (F.round(F.col("p_retailprice") * 100).cast("long") * F.lit(50000)).alias("weights_bytes"),
        F.when(F.col("p_type") == "SMALL", F.lit(None)).otherwise(F.col("p_size")).cast("long").alias("n_layers"),
        (F.col("p_size") * 256).cast("long").alias("n_embd"),
        F.when(F.col("p_size") % 4 == 0, F.lit(None)).otherwise(F.lit(32)).cast("long").alias("n_head"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.lit(8)).cast("long").alias("n_head_kv"))


PART_CATALOG_SQL = """
  SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) * 50000 AS weights_bytes,
         CAST(CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_size END AS BIGINT) AS n_layers,
         CAST(p_size * 256 AS BIGINT) AS n_embd,
         CAST(CASE WHEN p_size % 4 = 0 THEN NULL ELSE 32 END AS BIGINT) AS n_head,
         CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE 8 END AS BIGINT) AS n_head_kv
  FROM part
"""


def _capacity_sql():
    devs = " UNION ALL ".join(
        f"SELECT '{d}' AS device, CAST({r} AS BIGINT) AS ram_total, "
        f"{'CAST(' + str(max(v)) + ' AS BIGINT)' if v else 'NULL'} AS largest_gpu"
        for d, r, v in DEVICES)
    ctxs = " UNION ALL ".join(f"SELECT CAST({c} AS BIGINT) AS context_tokens" for c in CONTEXTS)
    kv = """CASE WHEN n_layers IS NOT NULL AND n_embd IS NOT NULL THEN
                  2 * n_layers * greatest((n_embd // greatest(coalesce(n_head, 1), 1))
                                          * greatest(coalesce(n_head_kv, greatest(coalesce(n_head, 1), 1)), 1),
                                          n_embd // 4) * context_tokens * 2
             ELSE weights_bytes // 8 END"""
    return f"""
SELECT p_partkey, weights_bytes, n_layers, n_embd, n_head, n_head_kv, device, context_tokens,
       CAST(kv AS DECIMAL(20,0)) AS kv_cache_bytes, CAST({S.RUN_OVERHEAD_BYTES} AS BIGINT) AS overhead_bytes,
       CAST(total AS DECIMAL(20,0)) AS total_estimate_bytes, largest_gpu,
       fits_largest_gpu, fits_all_ram,
       CASE WHEN fits_largest_gpu THEN '{S.VERDICT_NOTES[0]}'
            WHEN fits_largest_gpu = FALSE AND fits_all_ram THEN '{S.VERDICT_NOTES[1]}'
            WHEN fits_largest_gpu = FALSE AND fits_all_ram = FALSE THEN '{S.VERDICT_NOTES[2]}'
            WHEN fits_largest_gpu IS NULL AND fits_all_ram THEN '{S.VERDICT_NOTES[3]}'
            WHEN fits_largest_gpu IS NULL AND fits_all_ram = FALSE THEN '{S.VERDICT_NOTES[4]}'
            ELSE '{S.VERDICT_NOTES[5]}' END AS note
FROM (
  SELECT *, largest_gpu >= total AS fits_largest_gpu,
         CASE WHEN ram_total > 0 THEN ram_total >= total END AS fits_all_ram
  FROM (SELECT *, weights_bytes + kv + {S.RUN_OVERHEAD_BYTES} AS total
        FROM (SELECT c.*, x.context_tokens, d.device, d.ram_total, d.largest_gpu, {kv} AS kv
              FROM ({PART_CATALOG_SQL}) c, ({ctxs}) x, ({devs}) d) k) t) v
"""


@register("capacity_fit", _capacity_sql())
def q_capacity_fit(spark, sf_dir):
    return cap_ops.capacity_fit(_part_catalog(spark, sf_dir), DEVICES, CONTEXTS)


@register("quant_labels", f"""
SELECT p_partkey, p_size - 1 AS file_type,
       CASE p_size - 1 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in S.QUANT_LABELS.items())} ELSE 'unknown' END AS quant
FROM part
""")
def q_quant_labels(spark, sf_dir):
    p = tables.read_table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_size") - 1).alias("file_type"),
                    S.quant_label(F.col("p_size") - 1).alias("quant"))


# Tensor rollup: every lineitem row is a tensor of order o<orderkey>; a zero part
# key gives a zero product and the linenumber factor drives products past u64.


def _lineitem_tensors(spark, sf_dir):
    li = spread(tables.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    dims = F.array(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long"),
                   F.col("l_linenumber").cast("long") * F.lit(1000000000000)).cast("array<decimal(20,0)>")
    return li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"),
                     F.col("l_linenumber").alias("pos"), dims.alias("dims"),
                     (F.col("l_linenumber") - 1).cast("long").alias("type_id"))


@register("tensor_rollup", f"""
SELECT path, CAST(LEAST(SUM(e), {S.U64_MAX}) AS DECIMAL(20,0)) AS tensor_elem_count,
       CAST(LEAST(SUM(b), {S.U64_MAX}) AS DECIMAL(20,0)) AS tensor_bytes_estimate
FROM (SELECT path, e, LEAST(e * (CASE type_id {' '.join(f'WHEN {k} THEN {v}' for k, v in S.TENSOR_TYPE_BYTES.items())} ELSE 1 END),
                            {S.U64_MAX}) AS b
      FROM (SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS path, l_linenumber - 1 AS type_id,
                   LEAST(CAST(l_partkey AS DECIMAL(38,0)) * l_suppkey * CAST(l_quantity AS BIGINT)
                         * (l_linenumber * 1000000000000), {S.U64_MAX}) AS e
            FROM lineitem) t) u
GROUP BY path
""")
def q_tensor_rollup(spark, sf_dir):
    return cat_ops.tensor_rollup(_lineitem_tensors(spark, sf_dir))


# Header round trip: every part row is written as a model header (version,
# typed keys, a duplicate key, a string array, a skipped float array, two
# tensors), decoded in Spark tasks and summarized back.


def _encode_part_headers(it, bad_magic_above=None):
    import pyarrow as pa
    for batch in it:
        d = batch.to_pydict()
        paths, blobs = [], []
        for key, name, brand, ptype, size, price in zip(d["p_partkey"], d["p_name"], d["p_brand"],
                                                        d["p_type"], d["p_size"], d["p_retailprice"]):
            arch = ptype.lower()
            kvs = [("general.architecture", "str", arch), ("general.name", "str", name),
                   ("general.file_type", "u32", size - 1)]
            if size % 2 == 0:
                kvs.append(("general.parameter_count", "u64", round(price * 1000000)))
            kvs += [(f"{arch}.context_length", "u32", size * 1024),
                    (f"{arch}.block_count", "u32", size),
                    (f"{arch}.embedding_length", "u64", size * 128),
                    (f"{arch}.attention.head_count", "u16", 8),
                    (f"{arch}.attention.head_count_kv", "i32", size % 4 - 1),
                    ("tokenizer.tokens", "arr", ("str", name.split() * 5)),
                    ("tokenizer.scores", "arr", ("f32", [0.5] * size))]
            if size > 40:
                kvs.append(("general.name", "str", brand))
            tensors = [("token_embd.weight", [size * 128, 32000], 1), ("output.weight", [size * 128, size], 0)]
            paths.append(f"part/{key}.gguf")
            data = sample_headers.encode_header(1 + size % 3, kvs, tensors)
            if bad_magic_above is not None and size > bad_magic_above:
                data = b"X" + data[1:]  # damaged first byte
            blobs.append(data)
        yield pa.RecordBatch.from_pydict({"path": paths, "payload": blobs},
                                         schema=pa.schema([("path", pa.string()), ("payload", pa.binary())]))


def _part_header_payloads(spark, sf_dir, bad_magic_above=None):
    p = spread(tables.read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
    return p.mapInArrow(lambda it: _encode_part_headers(it, bad_magic_above), "path string, payload binary")


@register("header_roundtrip", f"""
SELECT p_partkey,
       CASE WHEN p_size > 40 THEN p_brand ELSE p_name END AS name,
       lower(p_type) AS architecture,
       CASE p_size - 1 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in S.QUANT_LABELS.items())} ELSE 'unknown' END AS quant,
       CAST(CASE WHEN p_size % 2 = 0 THEN CAST(round(p_retailprice * 1000000) AS BIGINT)
                 ELSE p_size * 128 * 32000 + p_size * 128 * p_size END AS DECIMAL(20,0)) AS parameter_count,
       CAST(p_size * 1024 AS DECIMAL(20,0)) AS context_length,
       CAST(p_size AS DECIMAL(20,0)) AS n_layers,
       CAST(p_size * 128 AS DECIMAL(20,0)) AS n_embd,
       CAST(8 AS DECIMAL(20,0)) AS n_head,
       CAST(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 - 1 END AS DECIMAL(20,0)) AS n_head_kv,
       CAST(2 AS BIGINT) AS tensor_count, 1 + p_size % 3 AS version,
       CAST(p_size * 128 * 32000 + p_size * 128 * p_size AS DECIMAL(20,0)) AS tensor_elem_count,
       CAST(p_size * 128 * 32000 * 2 + p_size * 128 * p_size * 4 AS DECIMAL(20,0)) AS tensor_bytes_estimate
FROM part
""")
def q_header_roundtrip(spark, sf_dir):
    cat = jobs.catalog_headers(_part_header_payloads(spark, sf_dir))
    key = F.regexp_extract(F.col("path"), r"^part/([0-9]+)\.gguf$", 1).cast("long")
    return cat.select(key.alias("p_partkey"), *[c for c in cat.columns if c != "path"])


@register("header_kv_counts", """
SELECT CAST(CASE WHEN p_size % 2 = 0 THEN 11 ELSE 10 END + CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS BIGINT) AS n_kv,
       COUNT(*) AS files
FROM part GROUP BY 1
""")
def q_header_kv_counts(spark, sf_dir):
    kv = hdr.header_kv(hdr.decode_payloads(_part_header_payloads(spark, sf_dir)))
    return kv.groupBy("path").agg(F.count(F.lit(1)).alias("n_kv")).groupBy("n_kv").agg(
        F.count(F.lit(1)).alias("files"))


# Display ----------------------------------------------------------------------
@register("human_bytes_parts", """
SELECT doc_id, b AS bytes,
       CASE WHEN b >= 1125899906842624 THEN 'PB' WHEN b >= 1099511627776 THEN 'TB'
            WHEN b >= 1073741824 THEN 'GB' WHEN b >= 1048576 THEN 'MB'
            WHEN b >= 1024 THEN 'KB' ELSE 'B' END AS unit,
       CAST(b AS DOUBLE) / CASE WHEN b >= 1125899906842624 THEN 1125899906842624 WHEN b >= 1099511627776 THEN 1099511627776
            WHEN b >= 1073741824 THEN 1073741824 WHEN b >= 1048576 THEN 1048576
            WHEN b >= 1024 THEN 1024 ELSE 1 END AS scaled
FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) << CAST((n_chars % 5) * 10 + (n_chars % 3) AS INTEGER) AS b
      FROM documents) d
""")
def q_human_bytes_parts(spark, sf_dir):
    d = tables.read_table(spark, sf_dir, "documents")
    b = F.expr("shiftleft(CAST(octet_length(text) AS BIGINT), CAST((n_chars % 5) * 10 + (n_chars % 3) AS INT))")
    d = d.select("doc_id", b.alias("bytes"))
    scaled, unit = S.human_bytes_parts(F.col("bytes"))
    return d.select("doc_id", "bytes", unit.alias("unit"), scaled.alias("scaled"))


SHORT_MAX = 24


@register("display_name", f"""
SELECT page_id, display_name,
       CASE WHEN length(display_name) <= {SHORT_MAX} THEN display_name
            ELSE left(display_name, {SHORT_MAX // 2}) || '…' || right(display_name, {SHORT_MAX // 2}) END AS short_name
FROM (SELECT p.page_id,
             COALESCE(t.tag, h.header_name,
                      regexp_extract(regexp_replace(p.url, '/+$', ''), '([^/]*)$', 1)) AS display_name
      FROM pages p
      LEFT JOIN (SELECT doc_id, 'flagged:' || CAST(doc_id AS VARCHAR) AS tag FROM labels WHERE toxic = 1) t
        ON t.doc_id = p.page_id
      LEFT JOIN (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS header_name
                 FROM documents WHERE lang = 'de') h ON h.doc_id = p.page_id) x
""")
def q_display_name(spark, sf_dir):
    from assetsweep.plans import report
    pages = tables.read_table(spark, sf_dir, "pages")
    tags = tables.read_table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("flagged:"), F.col("doc_id").cast("string")).alias("tag"))
    names = tables.read_table(spark, sf_dir, "documents").where(F.col("lang") == "de").select(
        F.col("doc_id").alias("page_id"),
        F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("header_name"))
    a = pages.select("page_id", F.col("url").alias("path")).join(tags, "page_id", "left").join(names, "page_id", "left")
    a = a.withColumn("display_name", report.display_name("tag", "header_name", "path"))
    return a.select("page_id", "display_name", S.shorten(F.col("display_name"), SHORT_MAX).alias("short_name"))


TOP_N = 500


@register("top_assets", f"""
SELECT row_number() OVER (ORDER BY size DESC, asset_id) AS rank, asset_id, size,
       GREATEST((SELECT COUNT(*) FROM documents) - {TOP_N}, 0) AS n_more
FROM ({DOC_ASSETS_SQL}) a
ORDER BY size DESC, asset_id LIMIT {TOP_N}
""")
def q_top_assets(spark, sf_dir):
    from assetsweep.plans import report
    return report.top_rows(tables.documents_assets(spark, sf_dir).select("asset_id", "size"),
                           [F.desc("size"), F.asc("asset_id")], TOP_N)


# Archive and undo ---------------------------------------------------------------


ARCHIVE_HOLDER = "src0"      # names already present in the archive come from this source
RECREATED_LANG = "fr"        # removed French documents reappear in the live table
LOST_SOURCE = "src5"         # archived copies from this source are gone
CHANGED_LANG = "es"          # archived Spanish copies were altered


def _scratch(spark, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/assetsweep-work/{what}-{uuid.uuid4().hex}"


def _dest_name():
    return F.concat(F.element_at(F.split(F.col("path"), "/"), 2), F.lit("-"), F.col("size").cast("string"))


@register("archive_conflicts", f"""
WITH n AS (SELECT *, split_part(path, '/', 2) || '-' || CAST(size AS VARCHAR) AS dest_name
           FROM ({removal_sql('preferred')}) r),
     f AS (SELECT dest_name, MIN(asset_id) AS first_id FROM n GROUP BY dest_name),
     e AS (SELECT DISTINCT lang || '-' || CAST(octet_length(encode(text)) AS VARCHAR) AS name
           FROM documents WHERE source = '{ARCHIVE_HOLDER}')
SELECT n.group_id, n.asset_id, n.path, n.store, n.size, n.keeper_id, n.dest_name,
       CASE WHEN n.dest_name IN (SELECT name FROM e) THEN 'destination_exists'
            WHEN n.asset_id <> f.first_id THEN 'name_collision' ELSE 'movable' END AS status
FROM n JOIN f ON n.dest_name = f.dest_name
""")
def q_archive_conflicts(spark, sf_dir):
    removal = plan_ops.reclaim_plan(document_duplicates(spark, sf_dir)).removal.drop("hash")
    docs = tables.read_table(spark, sf_dir, "documents")
    existing = docs.where(F.col("source") == ARCHIVE_HOLDER).select(
        F.concat(F.col("lang"), F.lit("-"), F.octet_length("text").cast("string")).alias("name"))
    return arc_ops.destination_status(removal, existing, _dest_name())


def _archive_entries(spark, sf_dir):
    """Planned removals with the hash of each document and of its archived copy
    (altered for CHANGED_LANG).  Hashes are computed where the text is read, so
    only narrow rows meet the plan in the join."""
    removal = materialize(plan_ops.reclaim_plan(document_duplicates(spark, sf_dir)).removal)
    docs = tables.read_table(spark, sf_dir, "documents")
    changed = F.when(F.col("lang") == CHANGED_LANG, F.concat("text", F.lit(" *"))).otherwise(F.col("text"))
    # Only planned documents are hashed again; the plan itself holds their present hash.
    planned = filter_by_ids(docs.withColumnRenamed("doc_id", "asset_id"), removal, "asset_id", keep=True)
    narrow = planned.select("asset_id", "lang", "source", F.sha2(F.encode(changed, "UTF-8"), 256).alias("archived_hash"))
    return removal.join(narrow, "asset_id").select(
        "asset_id", F.col("path").alias("from"),
        F.concat(F.lit("archive/"), F.col("asset_id").cast("string")).alias("to"),
        "size", "hash", "archived_hash", "lang", "source")


ENTRIES_SQL = f"""
  SELECT r.path AS "from", 'archive/' || CAST(r.asset_id AS VARCHAR) AS "to", r.size, sha256(d.text) AS hash,
         d.text, d.lang, d.source, r.asset_id
  FROM ({removal_sql('preferred')}) r JOIN documents d ON d.doc_id = r.asset_id
"""


@register("undo_status", f"""
WITH e AS ({ENTRIES_SQL}),
     live AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents
              WHERE doc_id NOT IN (SELECT asset_id FROM e)
              UNION ALL SELECT "from" FROM e WHERE lang = '{RECREATED_LANG}'),
     arch AS (SELECT "to" AS path, sha256(CASE WHEN lang = '{CHANGED_LANG}' THEN text || ' *' ELSE text END) AS hash
              FROM e WHERE source <> '{LOST_SOURCE}')
SELECT e."from", e."to", e.size,
       CASE WHEN e."from" IN (SELECT path FROM live) THEN 'occupied'
            WHEN a.hash IS NULL THEN 'archive_missing'
            WHEN a.hash <> e.hash THEN 'hash_mismatch' ELSE 'restore' END AS status
FROM e LEFT JOIN arch a ON a.path = e."to"
""")
def q_undo_status(spark, sf_dir):
    e = materialize(_archive_entries(spark, sf_dir))
    docs = tables.documents_assets(spark, sf_dir).select("asset_id", "path")
    live = plan_ops.kept_assets(docs, e.select("asset_id")).select("path").unionByName(
        e.where(F.col("lang") == RECREATED_LANG).select(F.col("from").alias("path")))
    archived = e.where(F.col("source") != LOST_SOURCE).select(
        F.col("to").alias("path"), F.col("archived_hash").alias("hash"))
    return arc_ops.undo_status(e.select("from", "to", "size", "hash"), live, archived)


@register("manifest_roundtrip", f"""
SELECT "from", "to", size, hash, 'sha256' AS algo FROM ({ENTRIES_SQL}) e
""")
def q_manifest_roundtrip(spark, sf_dir):
    e = _archive_entries(spark, sf_dir).select("from", "to", "size", "hash", F.lit("sha256").alias("algo"))
    d = _scratch(spark, "manifest")
    arc_ops.append_manifest(arc_ops.manifest_lines(e, "archive", 1700000000, per_line=16), d)
    # A damaged line and a blank line in the same folder must not stop the read.
    literal_table(spark, [("{\"created_unix\": 1, \"entries\": [",), ("",)], "value string") \
        .coalesce(1).write.mode("append").text(d)
    entries, _bad = arc_ops.manifest_entries(arc_ops.read_manifest(spark, d))
    return entries.select("from", "to", "size", "hash", "algo")


# Spanish documents are altered between planning and archiving: their copies do not
# match the plan, so they are reported as changed and stay in the kept table.
ARCHIVED_SQL = f"""
  SELECT r.*, CASE WHEN d.lang = '{CHANGED_LANG}' THEN 'changed' ELSE 'archived' END AS result
  FROM ({removal_sql('preferred')}) r JOIN documents d ON d.doc_id = r.asset_id
"""


def _archive_run(spark, sf_dir):
    removal = plan_ops.reclaim_plan(document_duplicates(spark, sf_dir)).removal
    docs = tables.read_table(spark, sf_dir, "documents")
    altered = F.when(F.col("lang") == CHANGED_LANG, F.concat("text", F.lit(" *"))).otherwise(F.col("text"))
    assets = tables.text_assets(docs.withColumn("text", altered), "doc_id", "text", "source",
                                F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")))
    root = _scratch(spark, "archive")
    status = jobs.archive(spark, removal, assets, root + "/archive", root + "/kept", now=1700000000)
    return status, root


@register("archive_verified", f"""
SELECT group_id, asset_id, path, store, size, keeper_id, CAST(asset_id AS VARCHAR) AS dest_name,
       'movable' AS status, result
FROM ({ARCHIVED_SQL}) r
""")
def q_archive_verified(spark, sf_dir):
    status, _ = _archive_run(spark, sf_dir)
    return status.select("group_id", "asset_id", "path", "store", "size", "keeper_id", "dest_name", "status", "result")


# Every document is in the kept table or in the archive, and in one of them only.
@register("archive_places", f"""
SELECT doc_id AS asset_id, doc_id IN (SELECT asset_id FROM ({ARCHIVED_SQL}) a WHERE result = 'archived') AS archived,
       CAST(1 AS BIGINT) AS places
FROM documents
""")
def q_archive_places(spark, sf_dir):
    _, root = _archive_run(spark, sf_dir)
    entries, _bad = arc_ops.manifest_entries(arc_ops.read_manifest(spark, root + "/archive/manifest"))
    gone = entries.select(F.element_at(F.split("to", "/"), -1).cast("long").alias("asset_id"), F.lit(True).alias("archived"))
    kept = spark.read.parquet(root + "/kept").select("asset_id", F.lit(False).alias("archived"))
    return kept.unionByName(gone).groupBy("asset_id").agg(
        F.max("archived").alias("archived"), F.count("*").alias("places"))


# Part rows above this size are written with a damaged first byte: the magic
# predicate (P3) flags them and decoding reports them as error rows.
BAD_MAGIC_ABOVE = 45


@register("header_magic", f"""
SELECT p_partkey, p_size <= {BAD_MAGIC_ABOVE} AS has_magic,
       CASE WHEN p_size > {BAD_MAGIC_ABOVE} THEN 'bad magic: not a model header' END AS error,
       CASE WHEN p_size > {BAD_MAGIC_ABOVE} THEN NULL ELSE 1 + p_size % 3 END AS version
FROM part
""")
def q_header_magic(spark, sf_dir):
    payloads = _part_header_payloads(spark, sf_dir, BAD_MAGIC_ABOVE)
    heads = hdr.headers(hdr.decode_payloads(payloads)).select("path", "error", "version")
    flags = payloads.select("path", S.has_header_magic(F.col("payload")).alias("has_magic"))
    key = F.regexp_extract(F.col("path"), r"^part/([0-9]+)\.gguf$", 1).cast("long")
    return flags.join(heads, "path").select(key.alias("p_partkey"), "has_magic", "error", "version")


# Last value per duplicate key (P11 semantics) over a real table: each user is a
# header, each event an entry keyed by its type, positions ordered by event id.
@register("kv_last_value", """
SELECT 'user' || CAST(user_id AS VARCHAR) AS path, event_type AS key,
       arg_max(CAST(props->>'$.k' AS BIGINT), event_id) AS value, COUNT(*) AS n_entries
FROM events GROUP BY user_id, event_type
""")
def q_kv_last_value(spark, sf_dir):
    ev = tables.read_table(spark, sf_dir, "events")
    kv = ev.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("path"),
                   F.col("event_type").alias("key"), F.col("event_id").alias("pos"),
                   F.get_json_object("props", "$.k").cast("long").alias("value"))
    return cat_ops.last_values(kv)


@register("dup_groups_top", f"""
SELECT row_number() OVER (ORDER BY reclaimable DESC, size_each DESC, group_id) AS rank,
       group_id, size_each, n_members, reclaimable
FROM ({_group_sql(MIN_SIZE)}) g
""")
def q_dup_groups_top(spark, sf_dir):
    """O2: all groups in order, with their rank."""
    return document_duplicates(spark, sf_dir).ordered().select("rank", "group_id", "size_each", "n_members", "reclaimable")


@register("size_candidates_ranked", f"""
SELECT row_number() OVER (ORDER BY size DESC, min_id) AS rank, size, n, min_id FROM ({SIZE_CAND_SQL}) c
""")
def q_size_candidates_ranked(spark, sf_dir):
    return dup.ordered_candidates(dup.size_candidates(tables.documents_assets(spark, sf_dir), MIN_SIZE))


@register("dup_groups_prefiltered", _group_sql(MIN_SIZE))
def q_dup_groups_prefiltered(spark, sf_dir):
    """Only documents whose size occurs twice are hashed; the groups are the same."""
    d = jobs.find_duplicates(tables.documents_assets(spark, sf_dir), MIN_SIZE, MANAGED, prefilter=True)
    return _group_select(d.groups)


@register("policy_rows_within_cap", f"""
SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS size
FROM documents WHERE octet_length(encode(text)) <= {POLICY_CAP}
""")
def q_policy_rows_within_cap(spark, sf_dir):
    within, _ = plan_ops.row_gate(tables.documents_assets(spark, sf_dir), POLICY_CAP)
    return within.select(F.col("asset_id").alias("doc_id"), F.col("store").alias("source"), "size")


@register("selected_removal", f"""
SELECT {REMOVAL_COLS} FROM ({removal_sql('preferred')}) r
WHERE group_id IN (SELECT group_id FROM ({_group_sql(MIN_SIZE)}) g WHERE n_members > 2)
""")
def q_selected_removal(spark, sf_dir):
    """The plan for selected groups only."""
    d = document_duplicates(spark, sf_dir)
    return plan_ops.reclaim_plan(d, groups=d.groups.where("n_members > 2")).removal.drop("hash")


@register("union_of_scans", f"""
SELECT path, MIN(store) AS store, MIN(size) AS size FROM (
  SELECT path, store, size FROM ({DOC_ASSETS_SQL}) a
  UNION ALL SELECT path, 'loose' AS store, size FROM ({DOC_ASSETS_SQL}) b WHERE store = 'src2') u GROUP BY path
""")
def q_union_of_scans(spark, sf_dir):
    """A second scan reaches the files of one store again, under another store name."""
    a = tables.documents_assets(spark, sf_dir).select("path", "store", "size")
    again = a.where(F.col("store") == "src2").withColumn("store", F.lit("loose"))
    return inv.union_scans(a, again).select("path", "store", "size")


# The head window of every document of one source is read differently, as when a file
# changes while it is read; buckets that mix such a row with others disagree.
@register("bucket_guard_disagrees", f"""
SELECT size, hash, COUNT(*) AS n, MIN(store = 'src0') = MAX(store = 'src0') AS edges_agree
FROM ({DOC_ASSETS_SQL}) a WHERE size >= {MIN_SIZE} AND size > 0
GROUP BY size, hash HAVING COUNT(*) > 1
""")
def q_bucket_guard_disagrees(spark, sf_dir):
    fp = dup.fingerprint_payloads(tables.documents_assets(spark, sf_dir))
    other = F.when(F.col("store") == "src0", F.lit("0")).otherwise(F.col("head_hash"))
    return dup.bucket_guard(fp.withColumn("head_hash", other), MIN_SIZE)


# French documents cannot be read.
@register("unreadable_rows", """
SELECT doc_id AS asset_id, 'unreadable: no payload' AS error FROM documents WHERE lang = 'fr'
""")
def q_unreadable_rows(spark, sf_dir):
    docs = tables.read_table(spark, sf_dir, "documents").withColumn("n", F.octet_length("text"))
    docs = docs.withColumn("text", F.when(F.col("lang") != "fr", F.col("text")))
    return dup.quarantine(dup.fingerprint_payloads(tables.text_assets(docs, "doc_id", "text", "source"))).select("asset_id", "error")


# Extension, magic bytes (documents with an even length are given them) or split name.
@register("looks_like_model", f"""
SELECT p.asset_id, COALESCE(ext = 'gguf', FALSE) OR d.n_chars % 2 = 0 OR split_group IS NOT NULL AS looks
FROM ({NAME_PARTS_SQL}) p JOIN documents d ON d.doc_id = p.asset_id
""")
def q_looks_like_model(spark, sf_dir):
    magic = F.concat(F.when(F.col("n_chars") % 2 == 0, F.unhex(F.lit(S.HEADER_MAGIC_HEX))).otherwise(F.lit(b"")),
                     F.encode("text", "UTF-8"))
    rows = _doc_names(spark, sf_dir, magic.alias("payload"))
    return rows.select("asset_id", inv.looks_like_model().alias("looks"))


# labels of stores and of parameter counts.
@register("labels", f"""
SELECT p_partkey, CASE p_size % 6 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(S.STORE_LABELS.values()))} END AS store_label,
       printf('%.2fB', round(p_retailprice * 100) * 10000000 / 1e9) AS params
FROM part
""")
def q_labels(spark, sf_dir):
    p = tables.read_table(spark, sf_dir, "part")
    kind = F.get(F.array(*[F.lit(k) for k in S.STORE_LABELS]), (F.col("p_size") % 6).cast("int"))
    n = F.round(F.col("p_retailprice") * 100).cast("long") * 10000000
    return p.select("p_partkey", S.store_label(kind).alias("store_label"), S.billions_label(n).alias("params"))


# With each source treated as one split, copies inside one source count once,
# so only content copied across sources forms a group.
@register("dup_groups_cross_source", f"""
WITH a AS ({DOC_ASSETS_SQL}),
     firsts AS (SELECT size, hash, store, MIN(asset_id) AS asset_id FROM a
                WHERE size >= {MIN_SIZE} AND size > 0 GROUP BY size, hash, store)
SELECT MIN(asset_id) AS group_id, size AS size_each, COUNT(*) AS n_members,
       CAST(size * (COUNT(*) - 1) AS BIGINT) AS reclaimable
FROM firsts GROUP BY size, hash HAVING COUNT(*) > 1
""")
def q_dup_groups_cross_source(spark, sf_dir):
    assets = tables.documents_assets(spark, sf_dir).withColumn("split_group", F.col("store"))
    fp = dup.fingerprint_payloads(assets, keep=("split_group",))
    d = dup.find_duplicates(fp, min_size=MIN_SIZE, managed=MANAGED, exclude_same_split=True)
    return d.groups.select("group_id", "size_each", "n_members", "reclaimable")


# The report's JSON rows, parsed again.
@register("inventory_report", f"""
SELECT 'store' AS section, root AS name, n AS files, b AS bytes FROM (
  SELECT s.root, CAST(COUNT(a.asset_id) AS BIGINT) AS n, CAST(COALESCE(SUM(a.size), 0) AS BIGINT) AS b
  FROM ({_stores_sql(PATH_STORES)}) s LEFT JOIN ({DOC_ASSETS_SQL}) a
    ON starts_with(a.path, CASE WHEN s.root LIKE '%/' THEN s.root ELSE s.root || '/' END) OR a.path = s.root GROUP BY s.root) x
UNION ALL SELECT 'file', split_part(path, '/', 3), CAST(NULL AS BIGINT), size FROM ({DOC_ASSETS_SQL}) a
UNION ALL SELECT 'group', CAST(group_id AS VARCHAR), n_members, reclaimable FROM ({_group_sql(MIN_SIZE)}) g
UNION ALL SELECT 'totals', CAST((SELECT COUNT(*) FROM ({_group_sql(MIN_SIZE)}) g) AS VARCHAR), COUNT(*), CAST(SUM(size) AS BIGINT)
  FROM ({DOC_ASSETS_SQL}) a
""")
def q_inventory_report(spark, sf_dir):
    assets = tables.documents_assets(spark, sf_dir)
    found = jobs.inventory(assets, _stores_df(spark, PATH_STORES))
    rows = found.report(document_duplicates(spark, sf_dir))
    f = lambda *keys: F.coalesce(*[F.get_json_object("json", f"$.{k}") for k in keys])
    return rows.select(
        f("section").alias("section"), f("root", "display_name", "group_id", "n_groups").alias("name"),
        f("files", "total_files", "n_members").cast("long").alias("files"),
        f("total_bytes", "bytes", "reclaimable", "size").cast("long").alias("bytes"))


# the context length comes from the header; every fifth part has none, some exceed a signed long.
@register("capacity_header_context", f"""
SELECT p_partkey, CAST(ctx AS DECIMAL(20,0)) AS context_tokens,
       CAST(LEAST(CAST(4 * p_size AS HUGEINT) * (p_size * 256 // 4) * ctx, {S.U64_MAX}) AS DECIMAL(20,0)) AS kv_cache_bytes
FROM (SELECT p_partkey, p_size, CAST(CASE WHEN p_partkey % 5 = 0 THEN {S.DEFAULT_CONTEXT}
             WHEN p_partkey % 7 = 0 THEN 10000000000000000000 ELSE p_size * 1024 END AS HUGEINT) AS ctx FROM part) x
""")
def q_capacity_header_context(spark, sf_dir):
    p = tables.read_table(spark, sf_dir, "part")
    given = (F.when(F.col("p_partkey") % 5 == 0, F.lit(None))
             .when(F.col("p_partkey") % 7 == 0, F.lit("10000000000000000000")).otherwise((F.col("p_size") * 1024).cast("string")))
    cat = p.select("p_partkey", F.lit(1).cast("long").alias("weights_bytes"), F.col("p_size").cast("long").alias("n_layers"),
                   (F.col("p_size") * 256).cast("long").alias("n_embd"), F.lit(8).cast("long").alias("n_head"),
                   F.lit(1).cast("long").alias("n_head_kv"), given.cast("decimal(20,0)").alias("context_length"))
    return cap_ops.capacity_fit(cat, DEVICES[:1]).select("p_partkey", "context_tokens", "kv_cache_bytes")


# Queries over files register themselves in the tables above.
from assetsweep.plans import file_queries  # noqa: E402, F401
