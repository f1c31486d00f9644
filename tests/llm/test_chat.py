"""Chat formatting: the grammar, escapes, and digests against plain strings."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridcast.llm import chat

ODD = st.lists(st.sampled_from(["###", "# ", "\\", "</turn>", "\n", "user", "### user\n", "x", "</tu", "rn>", "é", "\\n"]), max_size=8).map("".join)


def read(text, cuts=()):
    parser, out = chat.Parser(), []
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        out += parser.feed(text[a:b])
    parser.close()
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), min_size=1, max_size=4), st.randoms())
def test_turns_read_back_however_the_stream_is_cut(turns, rng):
    text = "".join(chat.rendered(r, t) for r, t in turns)
    cuts = sorted(rng.randint(0, len(text)) for _ in range(6))
    found = read(text, cuts)
    assert [x[:2] for x in found] == turns
    assert [chat.unescaped(text[a:b]) for _, _, a, b in found] == [t for _, t in turns]


def test_plain_texts_are_not_escaped():
    assert chat.rendered("user", "a \\ b # c </ turn>") == "### user\na \\ b # c </ turn>\n</turn>\n"
    assert chat.rendered("user", "\\### Assistant: </turn> ok") == "### user\n\\\\### Assistant: \\</turn> ok\n</turn>\n"


@pytest.mark.parametrize("text", ["x", "### user\nhi", "### user\n</turn>\n", "### user\na ### b\n</turn>\n", "### user\na\n</turn>x"])
def test_other_texts_are_refused(text):
    with pytest.raises(chat.Conflict):
        read(text)


def plain(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = []
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        every = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        size = sum(len(chat.rendered(r, x)) for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=str)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, None, "x"), (None, 3, "assistant", "###"), (None, None, "user", "")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"{i} </turn>\n### user\n" * 3) for i in range(2000)] + [(4, 0, "assistant", "é漢 " * 200_000), (5, 0, "a\nb\\", "\\</turn>")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, rendered string, n_turns int").repartition(5)
    got = sorted(map(tuple, chat.read_back(chat.formatted(df)).collect()), key=str)
    assert got == plain(rows)
    assert chat.read_back(chat.formatted(df.where(F.lit(False)))).count() == 0
