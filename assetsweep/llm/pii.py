"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Base spans (email, ip, card, phone) come from patterns.  Each base value is a protected entity.  Terms
(words) of a text that holds an entity, however far from it, may reveal it even when it is masked.  How
strongly is estimated from the corpus: with N different texts, df(e) of them that hold the entity, df(t)
that hold the term and c(e,t) that hold both (copies of a text count once in all four),

    PMI(e,t) = log2(c(e,t) * N / (df(e) * df(t)))      IC(e) = log2(N / df(e))

and a term discloses the entity if PMI / IC, discounted by c / (c + 1) because few common texts prove little, is at least
``threshold`` (1 means that the term never occurs without the entity) and so many common texts are no chance: for
independent e and t, a bound on the chance of c(e,t) or more common texts is at most ``alpha`` / V.  V is the number of different
terms of the corpus, as each of them is tried against an entity (Bonferroni): some of a corpus' many rare words stand in any given
text, so one common text never tells; two that hold a rare term and a rare entity do in a corpus of some size.  In such
texts the term is generalised to the class of the word (NAME, NUMBER) or, if it has none, removed.

Plan: DataFrame functions only.  Spans are computed in the scan and kept as a narrow table in the shared
folder.  Class, pair and term counts are hash aggregates with map-side combine; the term count runs over
all words of all texts.  Only texts with base spans and texts that stand more than once are shuffled.

Offsets: Spark has no function for match positions, so a pattern's matches and the gaps between them are
taken apart (``regexp_extract_all`` and ``split`` find the same matches) and their lengths in code points
are added up.  The patterns are written so that they run in linear time on long runs of word characters
or digits: possessive loops, and starts only where a run starts.

Defined cases: null text is empty; no span gives an empty ``spans`` and the hash of the empty string;
equal rows get equal results; a null doc_id is kept; an empty table gives an empty result; only doc_id
and text are read, other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetsweep.llm.common import stored
from assetsweep.operators.skew import filter_by_ids

KINDS = ("email", "ip", "card", "phone")
BLOCK = 256
ALPHA = 0.01
THRESHOLD = 0.6

# The contract's patterns, with possessive loops and run starts only, which find the same matches.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold before its pattern is tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[\p{L}\p{N}]+"
SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"


def _walk(gaps: str, hits: str, kind: str) -> Column:
    """Spans (code points, end exclusive) of ``hits`` standing between ``gaps``.

    Offsets are added up inside blocks of ``BLOCK`` hits, after the lengths of whole blocks, so that a text of
    very many hits does not copy a growing array at each of them.
    """
    part = lambda a: f"slice({a}, k * {BLOCK} + 1, {BLOCK})"
    return F.expr(f"""flatten(zip_with(
        sequence(0, (size({hits}) - 1) div {BLOCK}),
        aggregate(transform(sequence(0, (size({hits}) - 1) div {BLOCK}), k ->
                length(array_join({part(gaps)}, '')) + length(array_join({part(hits)}, ''))),
            cast(array(0) as array<int>), (a, x) -> concat(a, array(element_at(a, -1) + x))),
        (k, from) -> if(k is null, cast(array() as {SPAN}), aggregate(
            zip_with(slice({gaps}, k * {BLOCK} + 1, size({part(hits)})), {part(hits)}, (g, h) -> named_struct('g', g, 'h', h)),
            named_struct('at', from, 'out', cast(array() as {SPAN})),
            (a, x) -> named_struct(
                'at', a.at + length(x.g) + length(x.h),
                'out', concat(a.out, array(named_struct('kind', '{kind}', 's', a.at + length(x.g),
                                                        'e', a.at + length(x.g) + length(x.h), 'v', x.h)))),
            a -> a.out))))""")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    rev = F.reverse(_digits(v))
    digit = lambda i: F.substr(rev, i, F.lit(1)).cast("int")
    doubled = lambda i: digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0),
                        lambda a, i: a + F.when(i % 2 == 0, doubled(i)).otherwise(digit(i)))
    return F.length(rev).between(13, 19) & (total % 10 == 0)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: VALID[kind](x["v"]))


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` plus ``__spans``: the base spans by kind, then start."""
    d = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    none = F.lit(None).cast("array<string>")
    d = d.withColumns({f"__x_{k}": F.col("__t").rlike(HINT[k]) if k != "email" else F.contains("__t", F.lit("@"))
                       for k in KINDS})
    cut = {f"__g_{k}": F.when(F.col(f"__x_{k}"), F.split("__t", PATTERN[k], -1)).otherwise(none) for k in KINDS}
    cut |= {f"__h_{k}": F.when(F.col(f"__x_{k}"), F.regexp_extract_all("__t", F.lit(PATTERN[k]), F.lit(0)))
            .otherwise(none) for k in KINDS}
    d = d.withColumns(cut)
    d = d.withColumns({f"__s_{k}": F.when(F.size(f"__h_{k}") > 0, _kept(_walk(f"__g_{k}", f"__h_{k}", k), k))
                       for k in KINDS})
    some = [F.coalesce(F.col(f"__s_{k}"), F.expr(f"cast(array() as {SPAN})")) for k in KINDS]
    return d.withColumn("__spans", F.concat(*some)).drop(*cut, *(f"__s_{k}" for k in KINDS), *(f"__x_{k}" for k in KINDS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _entity(x: Column) -> Column:
    """Key of a protected value: emails in lower case, others by their digits (dots kept in an ip)."""
    v = F.when(x["kind"] == "email", F.lower(x["v"])).when(x["kind"] == "ip", x["v"]).otherwise(_digits(x["v"]))
    return F.xxhash64(x["kind"], v)


def _row_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def texts_with_entities(found: DataFrame) -> DataFrame:
    """One row per different text with base spans: ``__h``, its ``entities`` and its ``words`` outside base spans."""
    d = found.where(F.size("__spans") > 0).select("__h", "__t", "__spans")
    # A stated number of partitions is not merged: the words are taken apart in as many tasks.
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__h").dropDuplicates(["__h"])
    d = d.withColumns({"g": F.split("__t", WORD, -1), "h": F.regexp_extract_all("__t", F.lit(WORD), F.lit(0))})
    words = F.when(F.size("h") > 0, _walk("g", "h", "term"))
    words = F.transform(words, lambda w: F.struct(F.lower(w["v"]).alias("term"), w["s"].alias("s"), w["e"].alias("e")))
    words = F.filter(words, lambda w: ~F.exists("__spans", lambda b: (w["s"] < b["e"]) & (w["e"] > b["s"])))
    return d.select("__h", F.array_distinct(F.transform("__spans", _entity)).alias("entities"), words.alias("words"))


def entity_classes(near: DataFrame) -> DataFrame:
    """(class, __h): entities that stand in the same texts have the same counts with every term, so they are one class.

    The class is a fingerprint of 128 bits of the set of texts; a text with thousands of entities of its own
    makes one class instead of a pair of each of them with each word.
    """
    held = near.select("__h", F.explode("entities").alias("entity"))
    sets = held.groupBy("entity").agg(F.bit_xor(F.xxhash64(F.lit(1), "__h")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "__h")).alias("b"))
    return held.join(sets, "entity").select(F.struct("a", "b").alias("class"), "__h").distinct()


def one_of_each(docs: DataFrame, key: str = "__h") -> DataFrame:
    """One row of each ``key``; only rows whose key stands more than once are shuffled."""
    copied = stored(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "pii-copied")
    return (filter_by_ids(docs, copied, key, keep=False)
            .unionByName(filter_by_ids(docs, copied, key, keep=True).dropDuplicates([key])))


def term_documents(docs: DataFrame, text: str) -> DataFrame:
    """df(t) over all words of all different texts (``__h``)."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))
    return one_of_each(docs).select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))


def _chance(both: Column, a: Column, b: Column, n: Column) -> Column:
    """log of a bound on the chance that of ``b`` texts out of ``n`` at least ``both`` are among ``a`` given ones.

    Chvatal's bound of the hypergeometric tail, exp(-b KL(both/b || a/n)); it is not a bound below the mean.
    """
    q, p = both / b, a / n
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / F.greatest(1 - p, F.lit(1e-300)))).otherwise(0.0)
    return F.when(q > p, -b * (q * F.log(q / p) + rest)).otherwise(0.0)


def significant(both: Column, a: Column, b: Column, n: Column, alpha: float, tests: int) -> Column:
    """Whether the smaller of the two bounds (the tail is symmetric in ``a`` and ``b``) is at most ``alpha`` / ``tests``."""
    return F.least(_chance(both, a, b, n), _chance(both, b, a, n)) <= math.log(alpha / max(1, tests))


def disclosing_pairs(holders: DataFrame, held: DataFrame, docs: DataFrame, text: str, alpha: float = ALPHA,
                     threshold: float = THRESHOLD) -> DataFrame:
    """(class, term) pairs above the threshold, with ``disclosure`` = PMI / IC, discounted; all counts are of different texts."""
    n_texts = docs.select("__h").distinct().count()
    pairs = held.groupBy("class", "term").agg(F.count("*").alias("both"))
    pairs = pairs.join(holders.groupBy("class").agg(F.count("*").alias("df_entity")), "class")
    terms = stored(term_documents(docs, text), "pii-term-counts")
    pairs = stored(pairs, "pii-pairs").join(terms, "term")
    n = F.lit(float(max(n_texts, 1)))
    content = F.log2(n / F.col("df_entity"))
    pmi = F.log2(F.col("both") * n / (F.col("df_entity") * F.col("df_term")))
    sure = F.col("both") / (F.col("both") + 1)
    return (pairs.withColumn("disclosure", F.when(content > 0, pmi / content * sure))
            .where((F.col("disclosure") >= threshold)
                   & significant(F.col("both"), F.col("df_entity"), F.col("df_term"), n, alpha, terms.count()))
            .select("class", "term", "disclosure"))


def disclosing_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     alpha: float = ALPHA, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(narrow table with base spans per document, term spans per different text)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d = d.withColumn("__h", _row_hash("text"))
    found = with_base_spans(d, "text")
    narrow = F.transform("__spans", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    base = stored(found.select("doc_id", "__h", narrow.alias("spans")), "pii-spans")
    near = stored(texts_with_entities(found), "pii-words")
    holders = stored(entity_classes(near), "pii-classes")
    terms = near.select("__h", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    held = terms.join(holders, "__h")
    pairs = stored(disclosing_pairs(holders, held, d, "text", alpha, threshold), "pii-disclosing")
    told = held.join(pairs, ["class", "term"], "left_semi").select("__h", "term").distinct()
    # Every occurrence in the text, however far from the entity.
    marks = (near.select("__h", F.explode("words").alias("w"))
             .select("__h", F.col("w.term").alias("term"), F.col("w.s").alias("s"), F.col("w.e").alias("e"))
             .join(told, ["__h", "term"], "left_semi")
             .groupBy("__h").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "s", "e"))).alias("terms")))
    return base, stored(marks, "pii-terms")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA,
             threshold: float = THRESHOLD) -> DataFrame:
    """One narrow row per document: counts of base spans, their hash, and all spans."""
    base, marks = disclosing_spans(docs, doc_id, text, alpha, threshold)
    on = F.col("b.__h") == F.col("m.__h")
    d = base.alias("b").join(marks.alias("m"), on, "left").select("b.*", "m.terms")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    everything = F.concat(F.col("spans"), F.coalesce("terms", F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")))
    return d.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                    F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(everything).alias("spans"),
                    F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def _class(v: Column) -> Column:
    """What a term is generalised to; an ordinary word is removed."""
    return F.when(v.rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).when(v.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit(""))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA,
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all columns; in the text base spans are masked, disclosing terms generalised or removed.

    A null text stays null.  Overlapping spans are masked by the one that starts first (the longer of two
    that start together); what reaches beyond it is cut off with it.
    """
    _, marks = disclosing_spans(docs, doc_id, text, alpha, threshold)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.col(text).alias("text"), _row_hash(text).alias("__h"))
    row = with_base_spans(row, "text").withColumn(
        "base", F.transform("__spans", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    on = F.col("d.__h") == F.col("m.__h")
    d = row.alias("d").join(marks.alias("m"), on, "left").select("d.row", "d.__t", "d.base", "m.terms")
    everything = F.concat("base", F.coalesce("terms", F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")))
    d = d.withColumn("all", F.array_sort(F.transform(everything, lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("minus_e"), x["kind"].alias("kind")))))
    put = lambda x: F.when(x["kind"] == "term", _class(F.substr("__t", x["s"] + 1, -x["minus_e"] - x["s"]))).otherwise(
        F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    merged = F.aggregate(
        "all", start,
        lambda a, x: F.struct(
            F.greatest(a["at"], -x["minus_e"]).alias("at"),
            F.when(x["s"] >= a["at"], F.concat(a["out"], F.substr("__t", a["at"] + 1, x["s"] - a["at"]), put(x)))
            .otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substr("__t", a["at"] + 1, F.length("__t"))))
    clean = F.when(F.size("all") > 0, merged).otherwise(F.col("row")[text])
    return d.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
