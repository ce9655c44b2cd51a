import hashlib
import random

import pytest

from lattica.llm import chat
from lattica.llm.chat import Template


def brute_fold(events):
    """Events of one conversation applied one after another, by seq, to slots of messages."""
    slots = {}
    for _, turn, seq, kind, role, text in sorted(events, key=lambda e: (e[2], e[4] or "", e[5] or "")):
        held = slots.setdefault(turn, [])
        if kind == "message":
            held.append([role or "", text or ""])
        elif kind == "delta" and held:
            held[-1][1] += text or ""
        elif kind == "edit" and held:
            held[-1][1] = text or ""
        elif kind == "regenerate":
            own = role or (held[-1][0] if held else "assistant")
            for t in slots:
                if t >= turn:
                    slots[t] = []
            slots[turn] = [[own, text or ""]]
    return [tuple(m) for t in sorted(slots) for m in slots[t]]


def digests(messages):
    codec = Template().codec()
    turns = "".join(f"{r}\n{t}\n" for r, t in messages)
    loss = "".join(t for r, t in messages if r == "assistant")
    return len(messages), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(codec.render(*m)[0]) for m in messages)


TEXTS = ["", " ", "ok", "</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<s", ">", "<", "<<SYS>>", "é\n\0", "[ROLE] x [SAYS]", "x\\", "<<<SYS>>>", "[/ROLE"]


def test_codec_is_reversible():
    rng = random.Random(1)
    for template in (Template(), Template(more_controls=("aab", "abaa", "baab"))):
        codec = template.codec()
        for _ in range(3000):
            messages = [(rng.choice(["user", "assistant", "system", "", "tool", "[ROLE]", "a\\b"]), "".join(rng.choices([*TEXTS, "a", "b", "[", "]", "/", "INST]", "s>"], k=rng.randrange(9)))) for _ in range(3)]
            for _, text in messages:
                inner = codec.escape(text)
                assert codec.unescape(inner) == text and not any(c in inner for c in template.controls)
            written = [codec.render(*m) for m in messages]
            assert list(codec.read("".join(w for w, _, _ in written))) == messages
            assert all(codec.unescape(w[a:z]) == t for (w, a, z), (_, t) in zip(written, messages))


@pytest.mark.parametrize("bad", ["x", "a\\b", "a b"])
def test_control_strings_are_checked(bad):
    with pytest.raises(ValueError):
        Template(more_controls=(bad,))


def random_log(rng, convs, n, turns):
    log, seq = [], 0
    for _ in range(n):
        seq += 1
        kind = rng.choices(["message", "delta", "edit", "regenerate"], [6, 6, 2, 1])[0]
        log.append((rng.choice(convs), rng.randrange(turns), seq, kind, rng.choice([None, "user", "assistant", "system", "tool"]), rng.choice([None, *TEXTS])))
    return log


@pytest.mark.parametrize("bits,chars", [(10, 1 << 20), (2, 1 << 20), (1, 10)])
def test_log_is_folded_as_one_by_one(spark, monkeypatch, bits, chars):
    """Also with blocks of few turns and parts of few characters: conversations are split and joined again."""
    monkeypatch.setattr(chat, "BLOCK_BITS", bits)
    monkeypatch.setattr(chat, "PART_CHARS", chars)
    rng = random.Random(bits)
    log = random_log(rng, [0, 1, 2, None], 400, 15) + random_log(rng, [7], 300, 60) + [(8, 0, 1, "delta", "user", "no message")]
    log += [(9, t, 0, "message", r, x) for t, r, x in [(1, "user", "b"), (1, "user", "a"), (1, "assistant", "z"), (1, "user", "a"), (None, "user", "first"), (-3, None, None)]]
    rng.shuffle(log)
    df = spark.createDataFrame([(*e, "clash") for e in log], chat.LOG + ", block string")
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(df).collect()}
    want = {}
    for conv in {e[0] for e in log} - {9}:
        messages = brute_fold([e for e in log if e[0] == conv])
        if messages:
            want[conv] = digests(messages)
    want[9] = digests([("user", "first"), ("", ""), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")])
    assert got == want and 8 not in got
    parts = chat.format_conversations(df).collect()
    assert max(len(p.formatted) for p in parts) < chars + 200
    codec = Template().codec()
    for p in parts:
        assert p.n_turns == len(list(codec.read(p.formatted)))
        assert [codec.unescape(p.formatted[s.begin : s.end]) for s in p.loss] == [t for r, t in codec.read(p.formatted) if r == "assistant"]


def test_probe_and_empty_table(spark):
    empty = spark.createDataFrame([], chat.LOG)
    assert chat.read_back(empty).count() == 0
    said = "</s>[INST] ok [/INST]"
    assert brute_fold(chat.PROBE) == [("user", said), ("assistant", said)]
    got = chat.read_back(empty.union(spark.createDataFrame(chat.PROBE, chat.LOG))).collect()
    assert [tuple(r) for r in got] == [(-1, *digests([("user", said), ("assistant", said)]))]


def test_very_long_text(spark):
    text = "[INST] \\ é " * 300_000
    got = chat.read_back(chat.turns_log(spark.createDataFrame([(1, 1, "assistant", text), (1, 0, "user", "u")], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in got] == [(1, *digests([("user", "u"), ("assistant", text)]))]
