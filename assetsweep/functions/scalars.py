"""Scalar column functions.  All are built-in Spark expressions (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetsweep.schemas import U64_MAX

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# ---------------------------------------------------------------------------
# Byte units, stepping by 1024; the last unit is open-ended.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

# Quantization label by header file_type code (codes not listed: "unknown").
QUANT_LABELS = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1",
    7: "Q8_0", 8: "Q5_0", 9: "Q5_1", 10: "Q2_K", 11: "Q3_K_S", 12: "Q3_K_M",
    13: "Q3_K_L", 14: "Q4_K_S", 15: "Q4_K_M", 16: "Q5_K_S", 17: "Q5_K_M",
    18: "Q6_K", 19: "IQ2_XXS", 20: "IQ2_XS", 21: "Q2_K_S", 22: "IQ3_XS",
    23: "IQ3_XXS", 24: "IQ1_S", 25: "IQ4_NL", 26: "IQ3_S", 27: "IQ3_M",
    28: "IQ2_S", 29: "IQ2_M", 30: "IQ4_XS", 31: "IQ1_M", 32: "BF16",
    36: "TQ1_0", 37: "TQ2_0", 38: "MXFP4",
}

# Bytes per tensor element by tensor type id; any other type id counts 1.
TENSOR_TYPE_BYTES = {0: 4, 1: 2, 2: 1, 3: 1, 4: 8, 5: 8, 6: 4}

# Store kinds that a management tool owns; their copies are preferred keepers.
MANAGED_STORES = ["ollama", "lm_studio", "hugging_face"]

# Display label per store kind.
STORE_LABELS = {
    "ollama": "Ollama", "lm_studio": "LM Studio", "hugging_face": "HuggingFace",
    "custom": "Custom", "loose": "Loose",
}

# Flat allowance for activations and runtime state: 1.5 GiB.
RUN_OVERHEAD_BYTES = 1536 * 1024 * 1024
# Context length used when neither the caller nor the header gives one.
DEFAULT_CONTEXT = 8192
# Split-file naming: <base>-NNNNN-of-MMMMM, exactly five digits each.
SPLIT_NAME_PATTERN = r"(?s)^(.*)-([0-9]{5})-of-([0-9]{5})\z"
# Header magic bytes ("GGUF") and the policy size cap (1 GiB, inclusive).
HEADER_MAGIC_HEX = "47475546"
POLICY_SIZE_CAP = 1024 * 1024 * 1024
# Identity window at each end of a payload.
EDGE_BYTES = 4096
# Undo-manifest bad lines are reported by their first characters, with this detail.
BAD_LINE_PREVIEW = 60
BAD_LINE_DETAIL = "unparseable manifest line (skipped)"
# Fit verdict notes, in the order the cases are tested.
VERDICT_NOTES = [
    "fits on the largest GPU",
    "GPU-bound: likely CPU offload needed",
    "does not fit in RAM as-is",
    "fits in system RAM (no GPU detected)",
    "does not fit in RAM (no GPU detected)",
    "memory unknown: cannot judge",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 -------------------------------------------------------------------------
def byte_unit_index(size) -> Column:
    """Number of 1024 steps taken for display, capped at the last unit."""
    v = _col(size).cast("double")
    expr = F.lit(0)
    for k in range(1, len(BYTE_UNITS)):
        expr = F.when(v >= F.lit(float(1024 ** k)), F.lit(k)).otherwise(expr)
    return expr


def human_bytes_parts(size) -> tuple[Column, Column]:
    """(scaled value as double, unit) of ``human_bytes``."""
    k = byte_unit_index(size)
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), k + 1)
    scaled = _col(size).cast("double") / F.pow(F.lit(1024.0), k)
    return scaled, unit


def human_bytes(size) -> Column:
    scaled, unit = human_bytes_parts(size)
    return F.when(byte_unit_index(size) == 0,
                  F.concat(_col(size).cast("string"), F.lit(" B"))) \
        .otherwise(F.format_string("%.2f %s", scaled, unit))


# F2 / F3 --------------------------------------------------------------------
def file_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def file_stem(name) -> Column:
    return F.regexp_replace(_col(name), r"(.)\.[^.]*$", "$1")


def file_ext(name) -> Column:
    n = _col(name)
    return F.when(n.rlike(r"(?s).\.[^.]*$"), F.regexp_extract(n, r"(?s).\.([^.]*)$", 1))


def split_group_key(stem) -> Column:
    s = _col(stem)
    return F.when(s.rlike(SPLIT_NAME_PATTERN), F.regexp_extract(s, SPLIT_NAME_PATTERN, 1))


# F4 / F5 --------------------------------------------------------------------
def digest_to_blob(digest) -> Column:
    return F.replace(_col(digest), F.lit(":"), F.lit("-"))


def manifest_tag(rel_path) -> Column:
    """``model:tag`` from the last two parts of a manifest path; null if fewer."""
    parts = F.split(_col(rel_path), "/")
    return F.when(F.size(parts) >= 2,
                  F.concat(F.try_element_at(parts, F.lit(-2)), F.lit(":"),
                           F.try_element_at(parts, F.lit(-1))))


# F6 -------------------------------------------------------------------------
def quant_label(code) -> Column:
    """Label for a file_type code; null when the code is missing."""
    m = F.create_map(*[x for k, v in QUANT_LABELS.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    c = _col(code)
    # Codes beyond the long range cannot be in the table.
    as_long = F.when(c <= F.lit(2 ** 63 - 1), c.cast("long"))
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(m, as_long), F.lit("unknown")))


# F11 ------------------------------------------------------------------------
def tensor_type_bytes(type_id) -> Column:
    m = F.create_map(*[x for k, v in TENSOR_TYPE_BYTES.items() for x in (F.lit(k).cast("long"), F.lit(v).cast("long"))])
    return F.coalesce(F.try_element_at(m, _col(type_id).cast("long")), F.lit(1).cast("long"))


# Saturating u64 arithmetic in DECIMAL(38,0) ----------------------------------
def u64_lit() -> Column:
    return F.lit(str(U64_MAX)).cast("decimal(38,0)")


def sat_mul(a, b) -> Column:
    """min(a*b, u64 max) for non-negative decimals; a zero factor gives zero."""
    a, b = _col(a).cast("decimal(38,0)"), _col(b).cast("decimal(38,0)")
    prod = F.coalesce(F.try_multiply(a, b), u64_lit())
    return F.least(prod, u64_lit()).cast("decimal(38,0)")


def sat_add(a, b) -> Column:
    a, b = _col(a).cast("decimal(38,0)"), _col(b).cast("decimal(38,0)")
    return F.least(F.coalesce(F.try_add(a, b), u64_lit()), u64_lit()).cast("decimal(38,0)")


def sat_product(arr) -> Column:
    """Saturating product of an array of non-negative integers (1 for empty)."""
    return F.aggregate(_col(arr), F.lit(1).cast("decimal(38,0)"), lambda acc, d: sat_mul(acc, d))


def to_u64(c) -> Column:
    return _col(c).cast("decimal(20,0)")


def _int_div(a: Column, b: Column) -> Column:
    """Whole part of a / b for non-negative decimals, from the exact remainder (a decimal quotient is rounded)."""
    return ((a - a % b) / b).cast("decimal(38,0)")


# F14 / F16 ------------------------------------------------------------------
def kv_cache_bytes(weights, n_layers, n_embd, n_head, n_head_kv, context) -> Column:
    """KV-cache estimate in bytes (DECIMAL(38,0)), saturating like the reference.

    ``2 * layers * max((embd div head) * kv_heads, embd div 4) * ctx * 2`` with head
    defaulting to 1 and kv_heads to head (both at least 1); when layers or embd is
    missing the estimate falls back to ``weights div 8``.
    """
    d = "decimal(38,0)"
    head = F.greatest(F.coalesce(_col(n_head).cast(d), F.lit(1).cast(d)), F.lit(1).cast(d))
    kv = F.greatest(F.coalesce(_col(n_head_kv).cast(d), head), F.lit(1).cast(d))
    embd = _col(n_embd).cast(d)
    head_dim = _int_div(embd, head)
    # head_dim * kv_heads is clamped like every other product so that the
    # arithmetic stays inside DECIMAL(38,0) for any u64 inputs.
    n_embd_kv = sat_mul(head_dim, kv)
    width = F.greatest(n_embd_kv, _int_div(embd, F.lit(4).cast(d)))
    est = sat_mul(sat_mul(sat_mul(sat_mul(F.lit(2), _col(n_layers)), width), _col(context)), F.lit(2))
    fallback = _int_div(_col(weights).cast(d), F.lit(8).cast(d))
    return F.when(_col(n_layers).isNotNull() & _col(n_embd).isNotNull(), est).otherwise(fallback)


def total_estimate(weights, kv) -> Column:
    return sat_add(sat_add(weights, kv), F.lit(RUN_OVERHEAD_BYTES))


# F17 ------------------------------------------------------------------------
def fit_verdict(total, ram_total, vram) -> tuple[Column, Column, Column]:
    """(fits_largest_gpu, fits_all_ram, note); GPU fit wins, unknown RAM last."""
    d = "decimal(38,0)"
    gpu = F.when(F.size(_col(vram)) > 0,
                 F.coalesce(F.array_max(_col(vram)), F.lit(0)).cast(d) >= _col(total).cast(d))
    ram = F.when(_col(ram_total) > 0, _col(ram_total).cast(d) >= _col(total).cast(d))
    gpu_fit, offload, no_fit, ram_fit, ram_no_fit, unknown = VERDICT_NOTES
    note = (F.when(gpu.eqNullSafe(True), gpu_fit)
            .when(gpu.eqNullSafe(False) & ram.eqNullSafe(True), offload)
            .when(gpu.eqNullSafe(False) & ram.eqNullSafe(False), no_fit)
            .when(gpu.isNull() & ram.eqNullSafe(True), ram_fit)
            .when(gpu.isNull() & ram.eqNullSafe(False), ram_no_fit)
            .otherwise(unknown))
    return gpu, ram, note


# F15 / F19 / F20 ------------------------------------------------------------
def shorten(s, max_chars: int) -> Column:
    """Middle ellipsis by characters: keep max/2 characters at each end."""
    keep = max_chars // 2
    c = _col(s)
    return F.when(F.char_length(c) <= max_chars, c).otherwise(
        F.concat(F.left(c, F.lit(keep)), F.lit("…"), F.right(c, F.lit(keep))))


def store_label(store) -> Column:
    m = F.create_map(*[x for k, v in STORE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, _col(store))


def billions_label(params) -> Column:
    p = _col(params)
    return F.when(p.isNotNull(), F.format_string("%.2fB", p.cast("double") / F.lit(1e9)))


# P3 -------------------------------------------------------------------------
def has_header_magic(payload) -> Column:
    p = _col(payload)
    return F.coalesce(F.hex(F.substring(p, 1, 4)) == F.lit(HEADER_MAGIC_HEX), F.lit(False))
