import re
from collections import Counter

import corpus_pipeline as P
import pytest
from brute import pii_base
from test_ngram_join import brute

from assetsweep.llm import quality_rules as R
from assetsweep.llm import sampled_pieces
from assetsweep.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        path = f"file://{folder}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, after := spark.read.parquet(path)))
        docs = after
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == len(r.text) for r in after.collect())


def test_quality_stage_keeps_what_the_rules_keep(stages):
    before, after = stages[0]
    verdict = {r.doc_id: r for r in R.quality_verdicts(before).collect()}
    kept = {r.doc_id: r.text for r in after.collect()}
    assert set(kept) == {k for k, v in verdict.items() if v.kept}
    for r in before.collect():
        w = words(r.text)
        grams = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        times = Counter(grams)
        n = len({x for k, g in enumerate(grams) if times[g] > 1 for x in range(k, k + 8)})
        assert verdict[r.doc_id].n_repeat_words == n
        assert verdict[r.doc_id].base_failed == (len(w) < 20 or 100 * n > 30 * len(w))
        if r.doc_id in kept and not verdict[r.doc_id].n_removed_words:
            assert kept[r.doc_id] == r.text


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in brute(rows)}
    assert {(r.doc_id, r.text) for r in after.collect()} <= set(rows)


def test_no_benchmark_window_is_left(stages, spark):
    before, after = stages[2]
    clean = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = clean(r.text)
        n = min(10, len(w))
        grams |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    sizes = {len(g) for g in grams}

    def hit(t):
        w = clean(t)
        return any(tuple(w[k:k + n]) in grams for n in sizes for k in range(len(w)))
    old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, after))
    assert old.keys() == new.keys()
    for k, t in old.items():
        assert (new[k] != t) == hit(t)


def test_no_personal_data_is_left(stages):
    before, after = stages[3]
    old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, after))
    assert old.keys() == new.keys()
    for k, t in new.items():
        assert not any(pii_base(t).values())
        if not any(pii_base(old[k]).values()):
            assert t == old[k]


def test_pieces_decode_to_the_texts(stages, spark):
    before, after = stages[4]
    back = sampled_pieces.decode_pieces(after, tokenizer_path("piece_bpe_32k.model"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in before.collect()}


def test_odd_rows_and_an_empty_table_pass(spark, tmp_path):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "alpha beta " * 30, "en", None, 5, "x"),
            (3, " ".join(f"w{k}" for k in range(30_000)), "en", "s", 1, None), (3, " ".join(f"w{k}" for k in range(30_000)), "en", "s", 1, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for name, data in (("odd", rows), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        got = P.run(spark, folder).collect()
        assert [r.doc_id for r in got] == ([3] if data else [])
