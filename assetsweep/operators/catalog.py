"""Header catalogue: typed summary per file (P11 F6-F10) and tensor rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetsweep.functions import scalars as S
from assetsweep.sources.headers import INT_TYPES

# Architecture-dependent keys are ``<architecture><suffix>``.
ARCH_SUFFIXES = {
    "context_length": ".context_length",
    "n_layers": ".block_count",
    "n_embd": ".embedding_length",
    "n_head": ".attention.head_count",
    "n_head_kv": ".attention.head_count_kv",
}
GENERAL_KEYS = ["general.architecture", "general.name", "general.file_type", "general.parameter_count"]


def last_values(kv: DataFrame, value_col: str = "value") -> DataFrame:
    """Last value (highest ``pos``) per (path, key) and how many entries the key had.

    ``max_by`` keeps a fixed-width buffer, so the hash aggregate combines map-side
    and a file (or key) with a huge number of entries is pre-aggregated.
    """
    return kv.groupBy("path", "key").agg(F.max_by(F.col(value_col), F.col("pos")).alias(value_col),
                                         F.count(F.lit(1)).alias("n_entries"))


def tensor_rollup(tensors: DataFrame) -> DataFrame:
    """Per file, saturating sums of element counts and of estimated bytes."""
    elems = S.sat_product(F.col("dims"))
    nbytes = S.sat_mul(elems, S.tensor_type_bytes(F.col("type_id")))
    per = tensors.select("path", elems.alias("e"), nbytes.alias("b"))
    return (per.groupBy("path")
            .agg(F.least(F.sum("e"), S.u64_lit()).cast("decimal(20,0)").alias("tensor_elem_count"),
                 F.least(F.sum("b"), S.u64_lit()).cast("decimal(20,0)").alias("tensor_bytes_estimate")))


def summarize_decoded(decoded: DataFrame) -> DataFrame:
    """One typed row per successfully decoded file, in a single aggregation.

    ``decoded`` is the long table of ``sources.headers`` (header, kv and tensor
    rows).  One ``groupBy(path)`` computes the header fields, the saturating
    tensor sums (A9), the last value of each general key (highest ``pos`` wins
    for duplicate keys) and a position-sorted list of the few keys ending in an
    architecture suffix; the architecture-dependent fields are then read from
    that list with ``<architecture><suffix>``.  One shuffle, no joins.
    """
    sec = F.col("section")
    is_kv, is_t, is_h = sec == "kv", sec == "tensor", sec == "header"
    suffix_re = "(" + "|".join(x.replace(".", r"\.") for x in ARCH_SUFFIXES.values()) + ")$"
    is_arch_kv = is_kv & F.col("key").rlike(suffix_re)
    # Keys that no field reads (tokenizer lists, ...) are dropped before the
    # shuffle; every per-row expression is computed in this codegen'd projection
    # so the aggregate itself only combines plain columns.
    wanted = decoded.where(~is_kv | F.col("key").isin(GENERAL_KEYS) | F.col("key").rlike(suffix_re))
    elems = S.sat_product(F.col("dims"))
    cols = [
        "path",
        F.when(is_h, F.lit(1)).alias("_h"),
        F.when(is_h, F.col("error")).alias("_err"),
        F.when(is_h, F.col("version")).alias("_ver"),
        F.when(is_h, F.col("tensor_count")).alias("_tc"),
        F.when(is_t, elems).alias("_e"),
        F.when(is_t, S.sat_mul(elems, S.tensor_type_bytes(F.col("type_id")))).alias("_b"),
        F.when(is_arch_kv, F.struct("pos", "key", "type", "v_int")).alias("_ak"),
        F.struct("type", "v_int", "v_str").alias("_v"),
    ]
    shorts = [k.split(".")[1] for k in GENERAL_KEYS]
    cols += [F.when(is_kv & (F.col("key") == k), F.col("pos")).alias(f"_p_{sh}") for k, sh in zip(GENERAL_KEYS, shorts)]
    pre = wanted.select(*cols)
    aggs = [F.max("_h").alias("_has_header"), F.max("_err").alias("error"), F.max("_ver").alias("version"),
            F.max("_tc").alias("tensor_count"), F.sum("_e").alias("_elems"), F.sum("_b").alias("_bytes"),
            F.array_sort(F.collect_list("_ak")).alias("_arch_kv")]
    aggs += [F.max_by("_v", f"_p_{sh}").alias(f"_{sh}") for sh in shorts]
    per = pre.groupBy("path").agg(*aggs).where(F.col("_has_header").isNotNull() & F.col("error").isNull())
    for sh in shorts:
        per = (per.withColumn(f"_{sh}_t", F.col(f"_{sh}.type")).withColumn(f"_{sh}_i", F.col(f"_{sh}.v_int"))
               .withColumn(f"_{sh}_s", F.col(f"_{sh}.v_str")))

    def u64_of(t, v):
        return F.when(t.isin(*INT_TYPES) & (v >= 0), v)

    arch = F.when(F.col("_architecture_t") == "str", F.col("_architecture_s"))
    per = per.withColumn("architecture", arch)
    arch_fields = []
    for f, sfx in ARCH_SUFFIXES.items():
        hit = F.try_element_at(F.filter(F.col("_arch_kv"),
                                        lambda x: x["key"] == F.concat(F.col("architecture"), F.lit(sfx))),
                               F.lit(-1))
        arch_fields.append(u64_of(hit["type"], hit["v_int"]).cast("decimal(20,0)").alias(f))
    elem_total = F.least(F.coalesce(F.col("_elems"), F.lit(0).cast("decimal(38,0)")), S.u64_lit())
    byte_total = F.least(F.coalesce(F.col("_bytes"), F.lit(0).cast("decimal(38,0)")), S.u64_lit())
    explicit = u64_of(F.col("_parameter_count_t"), F.col("_parameter_count_i"))
    return per.select(
        "path",
        F.when(F.col("_name_t") == "str", F.col("_name_s")).alias("name"),
        "architecture",
        S.quant_label(u64_of(F.col("_file_type_t"), F.col("_file_type_i"))).alias("quant"),
        F.coalesce(explicit, F.when(elem_total > 0, elem_total)).cast("decimal(20,0)").alias("parameter_count"),
        *arch_fields,
        "tensor_count", "version",
        elem_total.cast("decimal(20,0)").alias("tensor_elem_count"),
        byte_total.cast("decimal(20,0)").alias("tensor_bytes_estimate"))


def summarize(headers: DataFrame, kv: DataFrame, tensors: DataFrame) -> DataFrame:
    """P11 from the three split tables (re-stacked into the long form)."""
    long = (headers.withColumn("section", F.lit("header"))
            .unionByName(kv.withColumn("section", F.lit("kv")), allowMissingColumns=True)
            .unionByName(tensors.withColumn("section", F.lit("tensor")), allowMissingColumns=True))
    return summarize_decoded(long)
