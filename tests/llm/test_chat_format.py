"""Chat formatting: exact round trips."""

import hashlib
import random

import pytest

from codequarry.llm import chat_format as C

PARTS = ["### ", "</turn>", "\\", ":", " ", "\n", "User", "Assistant", "user", "assistant", "ok", "é", " </turn>\n",
         "### User: ", ": ", "#", "/turn>", "\x00", "𝄞"]
ROWS = "conv_id long, turn long, role string, text string, formatted int, n_turns string"


@pytest.mark.parametrize("seed", range(4))
def test_every_turn_reads_back(seed):
    rng = random.Random(seed)
    for i in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "User", ""]) if i % 2 else
                  "".join(rng.choices(PARTS, k=rng.randrange(5))), "".join(rng.choices(PARTS, k=rng.randrange(8))))
                 for _ in range(3)]
        shown = "".join(C.render(r, t) for r, t in turns)
        read = C.parse(shown)
        assert [x[:2] for x in read] == turns
        assert all(C.unescape(shown[a:b]) == t for (_, _, a, b), (_, t) in zip(read, turns))


def test_plain_text_is_left_alone():
    assert C.render("user", r"a \ b # c") == "### User: a \\ b # c </turn>\n"
    assert C.render("assistant", r"\### Assistant: </turn> ok") == \
        "### Assistant: \\\\### Assistant: \\</turn> ok </turn>\n"


@pytest.mark.parametrize("bad", ["x", "### User: a", "### User a </turn>\n", "### User: a </turn>", "### U: a### b </turn>\n"])
def test_what_breaks_the_grammar(bad):
    with pytest.raises(C.NotATurn):
        C.parse(bad)


def digests(rows):
    out = {}
    for key in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, C.render(r[2] or "", r[3] or ""), r[2] or "", r[3] or "")
                        for r in rows if r[0] == key), key=lambda x: x[:3])
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[key] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(x[2]) for x in turns))
    return out


def test_digests_of_conversations(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None, "tool"]), rng.choice([None, "", "".join(rng.choices(PARTS, k=5))]))
            for c in range(20) for t in range(rng.randrange(1, 6))]
    rows += [(50, i, "assistant", f"turn {i}") for i in range(3000)]  # one long conversation
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (60, 1, "user", "same"), (60, 1, "user", "same"),
             (61, 0, "assistant", "x" * 300_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], ROWS)
    got = {r.conv_id: tuple(r)[1:] for r in C.read_back(C.format_turns(df)).collect()}
    assert got == digests(rows)


def test_empty_table(spark):
    assert C.read_back(C.format_turns(spark.createDataFrame([], ROWS))).collect() == []
