import itertools

from pyspark.sql import functions as F

from stowage.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>\n", "[\\INST]", "<|im_start|>user<|im_sep|>x", "<<SYS>>[[INST]]",
         "", None, "a\nb", "<|im_turn|><|im_turn|>", "$1 \\1", "x" * 100_000, "<<s>", "é👩‍👩‍👧", "<", "|im_end|>", "<|im_end|"]


def _read(df):
    out = df.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"),
                    chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    return {r["conv_id"]: r for r in out}


def test_every_text_comes_back(frame):
    roles = ["user", "assistant", "assistant", "system", None, "<|im_sep|>"]
    rows = [(c, t, roles[(c + t) % 6], NASTY[(c * 5 + t) % len(NASTY)], "x", [1])
            for c in range(20) for t in range(9)]
    rows += [(None, None, "assistant", "b", "x", None), (None, 1, "user", "a", "x", None),
             (50, 1, "user", "dup", "", None), (50, 1, "user", "dup", "", None), (50, 1, "user", "b", "", None)]
    out = _read(chat.format_conversations(
        frame(rows, "conv_id bigint, turn bigint, role string, text string, loss string, at array<int>")))
    assert len(out) == 22
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in own]
        assert [tuple(t) for t in out[conv]["turns"]] == want
        assert out[conv]["loss"] == [t for role, t in want if role == "assistant"]
        # One block for each run of turns of one role.
        assert out[conv]["formatted"].count(chat.START) == len(list(itertools.groupby(want, lambda t: t[0])))


def test_format(frame):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "a</s>"), (1, 2, "assistant", "more")]
    out = _read(chat.format_conversations(frame(rows, "conv_id bigint, turn bigint, role string, text string")))[1]
    assert out["formatted"] == ("<|im_start|>user<|im_sep|>a<\\/s><|im_end|>\n"
                                "<|im_start|>assistant<|im_sep|>yes<|im_turn|>more<|im_end|>\n")
    assert [out["formatted"][s["start"]:s["start"] + s["length"]] for s in out["loss_spans"]] == ["yes", "more"]


def test_empty_table(frame):
    ddl = "conv_id bigint, turn bigint, role string, text string"
    assert chat.format_conversations(frame([], ddl)).collect() == []


def test_long_conversations(spark, frame):
    import time

    n = 6000
    rows = [(c, i, ("user", "assistant")[i % 2 if c else i % 1000 // 700], f"text {i} é" * (i % 3)) for c in (0, 1) for i in range(n)]
    ddl = "conv_id bigint, turn bigint, role string, text string"
    made = chat.format_conversations(frame(rows, ddl).repartition(3))
    start = time.perf_counter()
    out = _read(made)
    assert time.perf_counter() - start < 60
    for c in (0, 1):
        own = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [tuple(t) for t in out[c]["turns"]] == own
        assert out[c]["loss"] == [t for role, t in own if role == "assistant"]
        assert out[c]["formatted"].count(chat.START) == len(list(itertools.groupby(own, lambda t: t[0])))


def test_turns_are_folded_in_arrays(spark, frame):
    ddl = "conv_id bigint, turn bigint, role string, text string"
    plan = chat.format_conversations(frame([(1, 1, "user", "a")], ddl))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "aggregate(" in plan
