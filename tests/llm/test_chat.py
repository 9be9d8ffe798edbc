"""Perspective rotation against a plain version."""

import pytest

from opslens.llm.chat import perspectives


def brute(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or "", turn))
    out = []
    for conv, turns in conversations.items():
        for speaker in {t[2] for t in turns} - {"system"}:
            at = 0
            for n, (_, _, role, text, turn) in enumerate(sorted(turns, key=lambda t: t[:4])):
                as_role = "assistant" if role == speaker else "system" if role == "system" else "user"
                name = role if as_role == "user" else None
                head = f"<|im_start|>{as_role}" + (f" name={name}" if name is not None else "") + "\n"
                segment = head + text + "<|im_end|>\n"
                out.append((conv, speaker, n, turn, as_role, name, segment, at, at + len(head), at + len(head) + len(text), role == speaker))
                at += len(segment)
    return sorted(out, key=str)


ROWS = [
    *((1, t, role, f"{role} says {t} é") for t, role in enumerate(["system", "ann", "bob", "cy", "ann", "bob"])),
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (2, None, "user", "no number"),
    (3, 0, "system", "alone"), (4, 0, None, "nobody"), (None, 0, "user", "lost"), (None, 5, "assistant", "found"),
    *((5, t, "user" if t % 2 else "assistant", "long " * (t % 3)) for t in range(300)), (6, 1, "user", "x" * 100_000),
]


@pytest.mark.parametrize("slice_turns", [1024, 7])
def test_against_plain_version(spark, slice_turns):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as speaker", "2 as start")
    got = [tuple(r) for r in perspectives(turns, slice_turns=slice_turns).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_empty_table(spark):
    assert perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
