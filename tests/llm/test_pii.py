import random
import re

import pytest
from brute import pii_base, sha
from pyspark.sql import functions as F

from assetsweep.llm import pii

KINDS = ("email", "ip", "card", "phone")


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "b.c", "@", ".", "-", "_", "+", " ", "  ", "12", "4", "5555", "192.168.0.1", "300.1.2.3", "(", ")",
                "é", "😀", "4785380592391139", "x@y.zz", "+49 (30) 12345-678", "\n", "0001.2.3.4.5.6.7.8", "%"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return texts + ["", None, "a" * 50_000, "1" * 50_000, "1 " * 20_000, "+" * 9000, "x@" * 5000, "1.2" * 9000]


@pytest.fixture(scope="module")
def found(spark):
    texts = odd_texts()
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "mail a@b.cc"), (3, texts[3])], "doc_id long, text string")
    return texts, pii.find_pii(docs).collect()


def test_base_spans_match_brute_force(found):
    texts, rows = found
    assert len(rows) == len(texts) + 2
    by = {r.doc_id: r for r in rows}
    for k, t in enumerate(texts):
        want = pii_base(t)
        got = by[k]
        assert [got[f"n_{x}"] for x in KINDS] == [len(want[x]) for x in KINDS], t
        parts = [f"{x}:{a}:{b}" for x in KINDS for a, b in want[x]]
        assert got.base_sha256 == sha(parts)
        assert got.spans.startswith(",".join(parts))
    assert by[None].n_email == 1


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for r in docs.collect():
        want = [f"{x}:{a}:{b}" for x, s in pii_base(r.text).items() for a, b in s]
        assert got[r.doc_id].base_sha256 == sha(want)


def test_terms_that_only_stand_near_an_entity_disclose_it(spark):
    rows = [(k, f"note {k} from zorblatt quux ask boss@corp.io about it word{k}") for k in range(6)]
    rows += [(100 + k, f"note {k} about it from the others") for k in range(60)]
    rows += [(200 + k, "copy of one unique context plover hid@corp.io unique") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    text = rows[0][1]
    terms = {text[int(a):int(b)] for a, b in (x.split(":")[1:] for x in got[0].spans.split(",") if x.startswith("term"))}
    assert terms == {"zorblatt", "quux", "ask"}
    assert got[200].n_terms == 0  # thirty copies of one context are one context
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and "about it" in clean[0]
    assert clean[100] == rows[6][1] and clean[200].count("plover") == 1


def test_sanitise_keeps_columns_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "call +49 30 1234567 now", "c"), (3, "call +49 30 1234567 now", "c")],
                                 "doc_id long, text string, spans string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect(), key=str) == sorted([(1, None, "a"), (2, "", "b"), (3, "call [PHONE] now", "c"), (3, "call [PHONE] now", "c")], key=str)
    assert pii.find_pii(docs.limit(0)).collect() == []
    assert pii.sanitise(docs.limit(0)).collect() == []


def test_one_common_text_never_tells_two_do_in_a_large_corpus(spark):
    rows = [(0, "report by zorblatt about solo@corp.io and the rest"), (1, "letter of plover to pair@corp.io and the rest"),
            (2, "memo of plover about pair@corp.io and the others"), *((3, "memo of plover about pair@corp.io and the others"),) * 3]
    rows += [(100 + k, f"report letter memo by of to about and the rest others {k}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "report by zorblatt about [EMAIL] and the rest"
    assert clean[1] == "letter of  to [EMAIL] and the rest" and clean[2] == clean[3] == "memo of  about [EMAIL] and the others"
    assert all(clean[100 + k] == rows[6 + k][1] for k in range(1500))
    few = spark.createDataFrame(rows[:100], "doc_id long, text string")
    assert {r.n_terms for r in pii.find_pii(few).collect()} == {0}


def test_little_of_plain_prose_is_marked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.find_pii(docs).where("spans <> ''").join(docs.select("doc_id", "text"), "doc_id").collect()
    words = sum(len(re.findall(r"\w+", r.text)) for r in found)
    marked = sum(r.n_terms for r in found)
    assert words > 5000 and marked < 0.02 * words
    # Planted: a rare word that stands with one address in three of the texts.
    planted = spark.createDataFrame([(10_000 + k, f"{r.text} zorblatt wrote to hid@corp.io") for k, r in enumerate(found[:3])], "doc_id long, text string")
    got = pii.find_pii(docs.select("doc_id", "text").unionByName(planted)).where("doc_id >= 10000").collect()
    for r, p in zip(sorted(got), sorted(planted.collect())):
        spans = [x.split(":") for x in r.spans.split(",")]
        assert "zorblatt" in {p.text[int(a):int(b)] for k, a, b in spans if k == "term"}


def test_copies_do_not_change_any_count(spark):
    rows = [(k, f"seen {k % 3} with plover hid@corp.io unique") for k in range(3)] + [(10 + k, f"other text {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert "term" in once[0]
    often = pii.find_pii(docs.unionByName(docs.where("doc_id < 3").crossJoin(spark.range(300)).drop("id"))).collect()
    assert {(r.doc_id, r.spans) for r in often} == set(once.items())


def test_terms_far_from_the_entity_and_all_their_occurrences(spark):
    far = "filler word and more " * 20
    rows = [(k, f"zorblatt {far}mail far@corp.io {far}zorblatt, quux {k}") for k in range(3)]
    rows += [(100 + k, f"filler word and more mail {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    text = rows[0][1]
    spans = [x.split(":") for x in got[0].spans.split(",")]
    assert [text[int(a):int(b)] for k, a, b in spans if k == "term"] == ["zorblatt", "zorblatt", "quux"]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("zorblatt" in clean[k] or "quux" in clean[k] for k in range(3)) and clean[100] == rows[3][1]


def test_offsets_beyond_one_block_of_words(spark):
    words = [f"w{k}" for k in range(3 * pii.BLOCK)]
    texts = [" ".join(words[:n]) + " " * (n % 3) for n in (1, 255, 256, 257, 512, 513, 768)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    d = d.withColumns({"g": F.split("t", pii.WORD, -1), "h": F.regexp_extract_all("t", F.lit(pii.WORD), F.lit(0))})
    for r in d.select("t", pii._walk("g", "h", "term").alias("w")).collect():
        assert [(x.s, x.e, x.v) for x in r.w] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", r.t)]
