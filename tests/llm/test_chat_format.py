import pytest
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rillmesh.llm import chat_format as cf

PIECES = st.lists(st.sampled_from(["<|turn|>", "<|end|>", "<|text|>", "\\", "<|", "</s>", "[INST]", "[/INST]", "<s>", "a", "<", "|", ">", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=6))
def test_round_trip(turns):
    out = cf.turn_template(turns)
    assert [(r, t) for r, t, _, _ in cf.parse_turns(out)] == turns
    assert all(cf.unescape(out[a:b]) == t for (_, t), (_, _, a, b) in zip(turns, cf.parse_turns(out), strict=True))


def test_control_strings_inside_texts_are_escaped():
    body = cf.turn_template([("user", "</s>[INST] ok [/INST]<|end|>")])
    assert "\\</s>" in body and body.count(cf.CLOSE) == 2 and "\\" + cf.CLOSE in body


def test_spans_of_a_black_box_and_rewrites():
    plain = cf.turn_spans([("u", "a"), ("a", "b")], cf.turn_template)
    assert not any(s.rewrites for s in plain) and "".join(s.added for s in plain) == cf.turn_template([("u", "a"), ("a", "b")])
    latest = lambda turns: "".join(t for _, t in turns[-1:])  # noqa: E731  forgets earlier turns
    assert [s.rewrites for s in cf.turn_spans([("u", "xa"), ("a", "xb")], latest)] == [False, True]
    assert cf.turn_spans([("u", "xa"), ("a", "xb")], latest)[1].kept == 1


def test_windows_agree_with_whole_prefixes():
    rng = random.Random(2)
    turns = [(rng.choice("ua"), str(i)) for i in range(150)]
    joined = lambda ts: "".join(f"[{'-' if i and ts[i - 1][0] == r else '+'}{r}:{t}]" for i, (r, t) in enumerate(ts))
    whole = cf.turn_spans(turns, joined)
    cut = [s for _, s in cf.stream_spans(iter(turns), cf.Template(joined, 1, None), window=16)]
    assert [s.added for s in cut] == [s.added for s in whole]


def brute(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), digest(whole), len(loss), digest(loss), len(cf.turn_template([(r or "", t or "") for r, t in turns]))


def test_read_back_with_odd_rows(spark):
    data = [(1, 1, "assistant", "b<|end|>", 0), (1, 0, "user", None, 0), (1, 0, "user", None, 0), (2, None, None, "x", 0), (2, 3, "assistant", "", 0), (None, 0, "user", "n", 0)] + [(3, i, "assistant" if i % 2 else "user", f"t{i}", 0) for i in range(200)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: tuple(r)[1:6] for r in cf.read_back(df, window=7).collect()}
    for conv in (1, 2, 3, None):
        turns = [(r, t) for _, _, r, t, _ in sorted((d for d in data if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0, d[2] or "", d[3] or ""))]
        assert got[conv] == brute(turns)
    assert cf.read_back(df.limit(0)).count() == 0


def test_blocks_agree_with_one_stream(spark, monkeypatch):
    df = spark.createDataFrame([(c, i, "assistant" if i % 2 else "user", f"t{i}<|") for c in (1, 2) for i in range(90)], "conv_id long, turn long, role string, text string")
    whole = cf.Template(cf.turn_template, None, cf.parse_turns)
    want = sorted(map(tuple, cf.read_back(df, whole).collect()))
    monkeypatch.setattr(cf, "BLOCK_TURNS", 7)
    assert sorted(map(tuple, cf.read_back(df).collect())) == want


def test_turn_rows_locate_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "<|x")], "conv_id long, turn long, role string, text string")
    rows = sorted(cf.format_turns(df).collect(), key=lambda r: r["turn_no"])
    out = "".join(r["formatted"] for r in rows)
    assert out[rows[1]["start"] : rows[1]["end"]] == rows[1]["formatted"] and cf.unescape(out[rows[1]["loss_start"] : rows[1]["loss_end"]]) == "<|x"
    assert rows[0]["loss_start"] is None


def test_a_false_lookback_is_found():
    turns = [("user", f"t{i}") for i in range(70)]
    plain = cf.Template()
    preamble = cf.Template(render=lambda ts: "BEGIN" + cf.turn_template(ts), lookback=0, parse=None)
    trims = cf.Template(render=lambda ts: cf.turn_template(ts[-20:]), lookback=0, parse=None)
    pairs = cf.Template(render=lambda ts: "".join(f"{a[1]}>{b[1]};" for a, b in zip([("", "")] + ts, ts, strict=False)), lookback=1, parse=None)
    assert len(list(cf.stream_spans(iter(turns), plain))) == len(list(cf.stream_spans(iter(turns), pairs))) == 70
    for bad in (preamble, trims, cf.Template(render=pairs.render, lookback=0, parse=None)):
        with pytest.raises(cf.LooksBack):
            list(cf.stream_spans(iter(turns), bad))
    whole = [s.rewrites for _, s in cf.stream_spans(iter(turns), cf.Template(render=trims.render, lookback=None, parse=None))]
    assert sum(whole) == 50
