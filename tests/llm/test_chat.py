import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from epsgroup.llm import chat


def model():
    turns = {(0, 1): 5, (1, 2): 30, (2, 1): 25}
    symbols = {(1, 3 + 1): 20, (1, 3 + 4): 10, (2, 3 + 5): 30, (2, 3 + 4): 20, (0, 3 + 4): 5}
    return chat.fitted(turns, {0: (5, 5), 1: (30, 40), 2: (30, 120)}, symbols, {0: 5, 1: 10})


def cost(m, symbols, states):
    total = m.first[states[0]] + m.symbol[states[0], symbols[0]]
    for a, b, s in zip(states, states[1:], symbols[1:], strict=False):
        total += m.next[a, b] + m.symbol[b, s]
    return total


def test_viterbi_is_the_best_of_all_paths():
    r, m = random.Random(0), model()
    for _ in range(10):
        symbols = np.array([r.randrange(chat.SYMBOLS) for _ in range(5)])
        best = max(itertools.product(range(6), repeat=5), key=lambda p: cost(m, symbols, p))
        assert np.isclose(cost(m, symbols, chat.path_of(m, symbols, None, None)), cost(m, symbols, best))


def test_markers():
    for line, role, rest in (("User: hi", 1, "hi"), ("### Assistant: x", 2, "x"), ("<|system|> a", 0, "a"), ("<|im_start|>user", 1, ""),
                             ("**Human:** q", 1, "q"), ("[Bot]: y", 2, "y"), ("A: z", 2, "z")):
        assert chat.seen(line) == (role, rest)
    for line in ("the user: hi", "A cat", "", "Username: x", "## Answering machines"):
        assert chat.seen(line)[0] >= 3 and chat.seen(line)[1] == line


CHATS = [
    (1, ["User: what is it?", "Assistant: a long answer", "over lines", "what else?", "Assistant: no"]),
    (2, ["just one line"]), (3, [None, None]), (4, ["System: be kind", "User: hello there?"]),
    (5, ["User: again and again"] + [f"Assistant: step {i}" if i % 3 == 0 else f"more of {i}" for i in range(300)]),
]


def test_a_spread_transcript_equals_one_part(frame, ws, spark):
    rows = [(conv, i, line) for conv, lines in CHATS for i, line in enumerate(lines)] + [(None, 1, "x"), (6, None, "y")]
    lines = frame(rows, "conv_id long, line_no long, text string")
    out = []
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = chat.parse(lines, "conv_id", "line_no", "text", model(), ws).collect()
        out.append(sorted(map(tuple, got)))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out[0] == out[1]
    turns = {(r[0], r[1]): r for r in out[0]}
    assert [turns[1, i][2] for i in range(4)] == ["user", "assistant", "user", "assistant"]
    assert turns[1, 1][3:] == (2, "a long answer\nover lines") and turns[1, 2][4] == "what else?"
    assert sum(r[3] for r in out[0]) == sum(len(x) for _, x in CHATS)
    assert turns[4, 0][2:] == ("system", 1, "be kind")
    assert {r[0] for r in out[0]} == {1, 2, 3, 4, 5}


def test_recovered_roles(frame, ws):
    r = random.Random(5)
    rows = []
    for conv in range(120):
        roles = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randint(1, 4)
        for turn, role in enumerate(roles):
            if role == "assistant":
                text = "\n".join("word " * r.randint(20, 40) for _ in range(r.randint(2, 6)))
            else:
                text = "what " * r.randint(2, 6) + "?"
            rows.append((conv, turn, role, text))
    table = frame(rows, "conv_id long, turn long, role string, text string")
    silent = F.crc32(F.concat_ws(":", "conv_id", "turn")) % 8 == 0
    lines = chat.transcript(table, "conv_id", "turn", "role", "text", silent)
    held = chat.learn(table.where("conv_id < 60"), "conv_id", "turn", "role", "text")
    got = {(x["conv_id"], x["turn"]): x["role"] for x in chat.parse(lines.where("conv_id >= 60"), "conv_id", "line", "text", held, ws).collect()}
    want = {(c, t): role for c, t, role, _ in rows if c >= 60}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)


def test_rendering_and_empty(frame, ws):
    lines = frame([(1, 1, "User: hi")], "conv_id long, line_no long, text string")
    turns = chat.render(chat.parse(lines, "conv_id", "line_no", "text", model(), ws))
    assert turns.first()["rendered"] == "<|user|>\nhi\n<|end|>"
    assert chat.parse(lines.limit(0), "conv_id", "line_no", "text", model(), ws).count() == 0
    assert chat.learn(frame([], "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
