import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillon.llm.chat import CONTROL, Costs, escape, format_and_read_back, format_conversations, format_turn, parse_turn, unescape
from quillon.llm.spool import Spool

NASTY = st.lists(st.one_of(st.sampled_from([*CONTROL, "\\", "<", "[", "|>", "\n", "é"]), st.text(max_size=5)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    out = escape(text)
    assert unescape(out) == text
    assert not any(c in out for c in CONTROL)


@settings(max_examples=100, deadline=None)
@given(NASTY, NASTY)
def test_turn_round_trip(role, text):
    segment, low, high, _ = format_turn(role, [{"type": "text", "text": text}])
    assert parse_turn(segment) == (role, text) and (low == high) == (role != "assistant" or not text)


def test_parts_become_ordered_placeholders():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, None, {"type": "audio", "ref": "b.wav", "seconds": 1.0}, {"type": "text", "text": "<|image|>"}, {"type": "document", "ref": "c.pdf", "pages": 2}]
    segment, low, high, attached = format_turn("assistant", parts)
    assert segment[low:high] == "see <|image|><|audio|><\\|image|><|document|>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in attached] == [("image", "a.png", 4), ("audio", "b.wav", 13), ("document", "c.pdf", 1024)]
    assert all(segment[a["at"] :].startswith(f"<|{a['type']}|>") for a in attached)
    assert parse_turn(segment) == ("assistant", "see <|image|>")
    with pytest.raises(ValueError):
        format_turn("user", [{"type": "video"}])
    assert Costs().image({}) == 1


@pytest.mark.parametrize("texts", [("a <|im", "age|> b"), ("x<|e", "nd|>y"), ("\\", "<", "|end|>"), ("<", "/s", ">", None, "[INS", "T]"), ("", "")])
def test_control_strings_across_parts(texts):
    for between in ([], [{"type": "image", "ref": "r"}]):
        parts = [{"type": "text", "text": t} for t in texts[:1]] + between + [{"type": "text", "text": t} for t in texts[1:]]
        segment, low, high, attached = format_turn("assistant", parts)
        assert parse_turn(segment) == ("assistant", "".join(t or "" for t in texts))
        body = segment[low:high]
        for a in attached:
            assert body[a["at"] - low :].startswith("<|image|>")
        if not between:
            assert not any(c in body for c in CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(NASTY, st.just(None)), max_size=6))
def test_parts_round_trip(texts):
    parts = [{"type": "audio", "ref": "r"} if t is None else {"type": "text", "text": t} for t in texts]
    segment, _, _, attached = format_turn("user", parts)
    assert parse_turn(segment) == ("user", "".join(t or "" for t in texts)) and len(attached) == sum(t is None for t in texts)


def test_very_long_turn_and_clashing_columns(spark):
    text = "<|end|>é" * 100_000
    rows = [(1, 0, "assistant", text, "x", 1), (1, 1, "user", None, "y", 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss_start long")
    r = format_and_read_back(df, Spool(spark, "test")).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    want = [format_turn("assistant", [{"type": "text", "text": text}])[0], format_turn("user", [])[0]]
    assert r.formatted_chars == sum(map(len, want))


def brute(rows):
    out = {}
    for c, n, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learnt = {c: "".join(x for r, x in t if r == "assistant") for c, t in out.items()}
    return sorted((c, len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(learnt[c]), sha(learnt[c])) for c, t in out.items())


def test_read_back(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, None, None), (-8, 1, "assistant", None), (None, 0, "user", "x"), (-9, 0, "user", "a"), (-9, 0, "user", "a"), (-10, 5, "assistant", "\\[INST]" * 3000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, parts string").repartition(3)
    got = format_and_read_back(df, Spool(spark, "test"))
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute(rows)
    chars = {}
    for c, _, role, text in rows:
        if c is not None:
            chars[c] = chars.get(c, 0) + len(format_turn(role or "", [{"type": "text", "text": text}])[0])
    assert {r.conv_id: r.formatted_chars for r in got.collect()} == chars


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_and_read_back(df, Spool(spark, "test")).count() == 0


def test_attachments_survive_spark(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "r", 28, 28, None, None), ("text", "t", None, None, None, None, None)])], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")
    r = format_conversations(df).first()
    assert r.attachments[0].ref == "r" and r.expanded_tokens == 1
