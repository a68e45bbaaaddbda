from assetsweep.llm import chat_format as C


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")


def test_prefix_is_rendered_once_and_masks_hold_assistant_text(spark):
    t = turns(spark, [
        (1, 0, "system", "be kind", "x"), (1, 1, "user", "hi", "x"), (1, 2, "assistant", "hello é", "x"), (1, 3, "user", "bye", "x"), (1, 4, "assistant", "ok", "x"),
        (2, 0, "system", "be kind", "x"), (2, 1, "user", "hi", "x"), (2, 2, "assistant", "go <|im_end|> away", "x")])
    g = C.gather_turns(t)
    pair = (g.where("conv_id = 1").selectExpr("7L as conv_id", "turns as chosen")
            .join(g.where("conv_id = 2").selectExpr("7L as conv_id", "turns as rejected"), "conv_id"))
    r = C.format_pairs(pair).collect()[0]
    assert r.n_prompt_turns == 2
    assert r.prompt == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in r.chosen_mask.split(",")]
    assert [r.chosen[a:b] for a, b in spans] == ["hello é<|im_end|>", "ok<|im_end|>"]
    (a, b), = [tuple(map(int, s.split(":"))) for s in r.rejected_mask.split(",")]
    assert r.rejected[a:b] == "go < |im_end|> away<|im_end|>" and r.usable


def test_equal_empty_and_missing(spark):
    t = turns(spark, [(1, 0, "user", "a b", None), (1, 1, "assistant", "x y z w", None), (1, 1, "assistant", "x y z w", None),
                      (2, 0, "user", None, None), (3, None, None, "q", None), (3, 0, "assistant", None, None),
                      (None, 0, "assistant", "lost", None), (4, 0, "assistant", "one " * 50_000, None)])
    rows = {r.conv_id: r for r in C.format_pairs(C.cut_reply(C.gather_turns(t))).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert not rows[2].usable and rows[2].n_prompt_turns == 1 and rows[2].chosen == rows[2].rejected == ""
    assert rows[1].chosen == "<|im_start|>assistant\nx y z w<|im_end|>\n" and rows[1].rejected == "<|im_start|>assistant\nx y<|im_end|>\n"
    assert rows[3].n_prompt_turns == 2 and not rows[3].usable and rows[3].chosen == "" and rows[3].prompt.startswith("<|im_start|>\nq")
    assert rows[4].usable and rows[4].n_prompt_turns == 0
    empty = C.gather_turns(t.limit(0))
    assert C.format_pairs(C.cut_reply(empty)).collect() == []


def test_sides_part_at_different_replies(spark):
    t = turns(spark, [(c, k, "assistant" if k % 2 else "user", f"turn {k} of talk", None) for c in range(60) for k in range(6)])
    rows = C.format_pairs(C.cut_reply(C.gather_turns(t))).collect()
    assert len(rows) == 60 and all(r.usable for r in rows)
    assert {r.n_prompt_turns for r in rows} == {1, 3, 5}
    for r in rows:
        assert r.prompt.count("<|im_start|>") == r.n_prompt_turns
        assert r.chosen.count("<|im_start|>") == 6 - r.n_prompt_turns and r.rejected == f"<|im_start|>assistant\nturn {r.n_prompt_turns}<|im_end|>\n"
