from vecloom.llm import chat


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def rows(*turns):
    return [(1, i, r, t) for i, (r, t) in enumerate(turns)]


SCHEMA = "conv_id long, turn long, role string, text string"


def pairs(spark, a, b):
    return {r.conv_id: r for r in chat.preferences(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()}


def test_prefix_and_masks(spark):
    a = rows(("system", "S"), ("user", "hé"), ("assistant", "good \U0001F600"), ("user", "q"), ("assistant", "end"))
    b = rows(("system", "S"), ("user", "hé"), ("assistant", "bad"))
    r = pairs(spark, a[::-1], b)[1]
    assert r.prompt_turns == 2 and r.prompt == turn("system", "S") + turn("user", "hé") and r.differs
    assert r.chosen == turn("assistant", "good \U0001F600") + turn("user", "q") + turn("assistant", "end") and r.rejected == turn("assistant", "bad")
    cut = lambda s, m: [s[int(x.split(":")[0]):int(x.split(":")[1])] for x in m.split(",")]
    assert cut(r.chosen, r.chosen_mask) == ["good \U0001F600<|im_end|>\n", "end<|im_end|>\n"] and cut(r.rejected, r.rejected_mask) == ["bad<|im_end|>\n"]


def test_edges_of_the_input(spark):
    same = rows(("user", "a"), ("assistant", "b"))
    r = pairs(spark, same, same)[1]
    assert r.prompt_turns == 2 and (r.chosen, r.rejected, r.chosen_mask, r.differs) == ("", "", "", False)
    other = pairs(spark, same, [(1, 0, "user", "x"), (2, 0, None, None), (None, 0, "user", "lost")])
    assert other[1].prompt == "" and other[2].chosen == "" and other[2].rejected == turn("", "") and set(other) == {1, 2}
    role = pairs(spark, rows(("user", "a")), rows(("assistant", "a")))[1]
    assert role.prompt_turns == 0 and role.rejected_mask == "22:34" and role.rejected[22:34] == "a<|im_end|>\n"
    twice = pairs(spark, same + same, same)[1]
    assert twice.prompt_turns == 1 and twice.chosen.startswith(turn("user", "a"))
    assert pairs(spark, [], []) == {}
    long = pairs(spark, rows(*[("user", "w " * 50000)] * 3), rows(("user", "w " * 50000)))[1]
    assert long.prompt_turns == 1 and len(long.chosen) == 2 * len(turn("user", "w " * 50000))
    clash = spark.createDataFrame([(1, 0, "user", "a", "p")], SCHEMA + ", prompt string")
    assert chat.preferences(clash, clash).count() == 1


def test_swapped_replies(spark):
    convs = [(0, 0, "user", "a"), (0, 1, "assistant", "own"), (1, 0, "user", "b"), (1, 1, "assistant", "x"), (1, 2, "assistant", "other"), (4, 0, "user", "alone"), (4, 1, "assistant", "z"), (6, 0, "user", "none")]
    out = {r.conv_id: [t["text"] for t in r.rejected_turns] for r in chat.swapped_replies(chat.conversations(spark.createDataFrame(convs, SCHEMA))).collect()}
    assert out == {0: ["a", "other"], 1: ["b", "x", "own"], 4: ["alone", ""], 6: ["none"]}
