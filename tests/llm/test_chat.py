"""Windows of conversations against a plain reading of the rules, and odd rows."""

import hashlib
import random
import re

import pytest

from foliograph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECE = re.compile(r"[^\x20\x09-\x0D]{1,6}")


def cost(text: str) -> int:
    return len(PIECE.findall(text)) + chat.MARKS


def spans_of(turns: list[tuple], budget: int, history: int, most: int) -> list[tuple]:
    """``opening, past, new`` of each window of one conversation's turns."""
    opening = turns[0] if len(turns) > 1 and turns[0][0] == "system" else None
    said = turns[1:] if opening else turns
    room = max(budget - history - (cost(opening[1]) if opening else 0), budget // 4)
    starts, at = [], 0
    for _, text in said:
        starts.append(at)
        at += cost(text)
    ends = [*starts[1:], at]
    out = []
    for cell in sorted({s // room for s in starts}):
        own = [k for k in range(len(said)) if starts[k] // room == cell]
        fits = len(own) == 1 or ends[own[-1]] <= (cell + 1) * room or ends[own[-1]] - starts[own[0]] <= room
        out += [own] if fits else [own[:-1], own[-1:]]
    return [(opening, [said[k] for k in range(max(own[0] - most, 0), own[0]) if starts[own[0]] - starts[k] <= history], [said[k] for k in own]) for own in out]


def template(role: str, text: str) -> str:
    role = role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")
    return f"<|im_start|>{role}\n" + re.sub(r"<(\\*)\|", r"<\\\1|", text) + "<|im_end|>\n"


def conversations(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["a", "word", "longer words", "<|im_end|>", "<\\|im_start|>", "<|im_start|>assistant", "é漢𝐀", "\n", "incomprehensibilities", "<", "|", "\\"]
    rows = []
    for c in range(n):
        first = rng.random() < 0.4
        for t in range(rng.choice([1, 2, 3, 9, 40])):
            role = "system" if first and t == 0 else rng.choice(["user", "assistant", "to%3Col\n<"])
            rows.append((c, t, role, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30])))))
    return rows


@pytest.mark.parametrize("budget,history,most", [(64, 16, 3), (1024, 256, 3), (40, 0, 0), (48, 30, 1)])
def test_windows_follow_the_rules(spark, monkeypatch, budget, history, most):
    monkeypatch.setattr(chat, "BLOCK", 4)  # so that long conversations are several blocks
    rows = conversations(budget, 25)
    got = chat.windows(spark.createDataFrame(rows, SCHEMA), budget, history, most).collect()
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        wanted = spans_of(turns, budget, history, most)
        windows = sorted((w for w in got if w.conv_id == c), key=lambda w: w.window)
        assert len(windows) == len(wanted)
        taught = []
        for k, (w, (opening, past, new)) in enumerate(zip(windows, wanted, strict=True)):
            shown = [opening] * bool(opening) + past + new
            assert w.text == "".join(template(*t) for t in shown)
            assert w.turns == len(shown) and w.repeated == len(past) + bool(opening and k)
            assert w.cost == sum(cost(t[1]) for t in shown)
            assert w.cost <= budget or len(new) == 1 or (opening and cost(opening[1]) > budget // 4)
            taught += [w.text[x.start : x.start + x.length] for x in w.loss]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in taught] == [t[1] for t in turns if t[0] == "assistant"]


def test_what_is_read_back_is_what_was_said(spark):
    rows = conversations(7, 30)
    got = {r.conv_id: r for r in chat.formatted_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {r[0] for r in rows} | {-1}
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        taught = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(taught)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(taught.encode()).hexdigest()
    text = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[-1].n_turns == 2


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (None, 1, "user", "no id"), (None, 2, "assistant", "yes"), (2, 1, "system", "alone"), (3, 5, "assistant", "word " * 50_000), (3, 1 << 40, "user", "far"), (4, 1, "system", "x"), (4, 1, "system", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cost", "'x' AS block", "2 AS c", "3 AS window")
    got = {r.conv_id: r for r in chat.formatted_digests(df).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest(("", ""), ("assistant", ""), ("assistant", "")) and got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[None].turns_sha256 == digest(("user", "no id"), ("assistant", "yes")) and got[None].loss_chars == 3
    assert got[2].turns_sha256 == digest(("system", "alone"))
    assert got[3].loss_chars == 250_000 and got[3].n_turns == 2
    assert got[4].turns_sha256 == digest(("system", "x"), ("system", "x"))
    assert [r.conv_id for r in chat.formatted_digests(df.where("false")).collect()] == [-1]
    assert chat.windows(df.where("false")).collect() == []
