"""Formatting conversations for training, and reading the format back.

A conversation becomes one text. Adjacent turns of one role share a block:

    <|im_start|>role<|im_sep|>text<|im_turn|>text of the next turn<|im_end|>LF

Control strings inside roles and texts get a backslash after their first
character, and backslashes are doubled, so texts can be restored exactly. The
loss mask is a list of spans, in characters of the formatted text, one for
each assistant text. All of it are Spark expressions: sorted turn structs are
folded into blocks, and these are concatenated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
#: Control strings of this and of other common templates (fixed values).
CONTROLS = [START, SEP, TURN, END, "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<s>", "</s>"]
ASSISTANT = "assistant"
#: Turns folded together before their blocks are joined, and characters of a piece when spans are read.
PART, CUT = 128, 4096


def _pattern() -> str:
    """The first character of a control string that the rest follows."""
    return "|".join(f"\\Q{c[0]}\\E(?=\\Q{c[1:]}\\E)" for c in CONTROLS)


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_pattern()})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


_BLOCKS = "array<struct<role:string,texts:array<string>>>"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joined(left: Column, right: Column) -> Column:
    """Two lists of blocks one after the other; where they meet in one role, these two are one."""
    last, first = F.get(left, F.size(left) - 1), F.get(right, F.lit(0))
    meet = F.struct(last["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts"))
    one = F.concat(F.slice(left, F.lit(1), F.size(left) - 1), F.array(meet),
                   F.slice(right, F.lit(2), F.greatest(F.size(right) - 1, F.lit(0))))
    return F.when((F.size(left) > 0) & (F.size(right) > 0) & (last["role"] == first["role"]), one).otherwise(
        F.concat(left, right))


def _parts_of(array: Column) -> Column:
    """An array in parts of ``PART`` items, so that folds copy short lists only."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(PART))
    return F.transform(starts, lambda i: F.slice(array, i, F.lit(PART)))


def merged_blocks(turns: Column) -> Column:
    """Blocks (role, texts) of sorted turns: adjacent turns of one role are folded into one."""
    none = F.array().cast(_BLOCKS)
    block = lambda t: F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    folded = F.transform(_parts_of(turns), lambda part: F.aggregate(
        part, none, lambda blocks, t: _joined(blocks, block(t))))
    return F.aggregate(folded, none, _joined)


def _ends(lengths: Column) -> Column:
    """Running sums of an array of numbers."""
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def run(numbers: Column, start: Column) -> Column:
        step = lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["all"], F.array(s["sum"] + n)).alias("all"))
        return F.aggregate(numbers, F.struct(start.alias("sum"), none.alias("all")), step)

    total = lambda part: F.aggregate(part, zero, lambda a, n: a + n)

    def chain(state: Column, part: Column) -> Column:
        return F.struct((state["sum"] + total(part)).alias("sum"),
                        F.concat(state["all"], run(part, state["sum"])["all"]).alias("all"))

    return F.aggregate(_parts_of(lengths), F.struct(zero.alias("sum"), none.alias("all")), chain)["all"]


def _formatted(blocks: Column) -> Column:
    """Pieces of a conversation: per text what stands before it, itself, and what ends its block."""
    def of_block(b: Column) -> Column:
        head = F.concat(F.lit(START), escape(b["role"]), F.lit(SEP))
        return F.transform(b["texts"], lambda text, i: F.struct(
            F.when(i == 0, head).otherwise(F.lit(TURN)).alias("head"), escape(text).alias("body"),
            F.when(i == F.size(b["texts"]) - 1, F.lit(END + "\n")).otherwise(F.lit("")).alias("tail"),
            b["role"].alias("role")))

    return F.flatten(F.transform(blocks, of_block))


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = ASSISTANT,
) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` (start from 0, length), a row per conversation.

    One shuffle brings a conversation's turns together as an array of structs,
    which is sorted and folded into blocks of one role each. Places of texts
    are running sums over the array. A conversation must fit in a task, since
    the result is one text.

    Defined cases: a NULL role or text counts as an empty one; turns without a
    number come first; turns of one number follow each other by role, then
    text, and repeated rows are repeated turns; rows with a NULL ``conv_id`` are
    one conversation; an empty table gives an empty one; other columns don't
    matter.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.struct(
            F.col(turn_col).cast("bigint").alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = found.select("conv_id", _formatted(merged_blocks(F.col("turns"))).alias("pieces"))
    size = lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("bigint")
    placed = pieces.select("conv_id", "pieces", _ends(F.transform("pieces", size)).alias("ends"))

    def span(p: Column, end: Column) -> Column:
        length = F.length(p["body"]).cast("bigint")
        return F.when(p["role"] == loss_role, F.struct(
            (end - F.length(p["tail"]) - length).alias("start"), length.alias("length")))

    whole = F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"]))
    spans = F.filter(F.zip_with("pieces", "ends", span), lambda s: s.isNotNull())
    return placed.select("conv_id", F.array_join(whole, "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = lambda text, mark: F.split(text, f"\\Q{mark}\\E", -1)
    blocks = F.slice(pieces(formatted, END + "\n"), 1, F.size(pieces(formatted, END + "\n")) - 1)

    def turns_of(block: Column) -> Column:
        sides = pieces(F.substring(block, F.lit(len(START) + 1), F.length(block)), SEP)
        return F.transform(pieces(sides[1], TURN), lambda t: F.struct(
            unescape(sides[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order.

    The text is cut once into pieces of ``CUT`` characters, so that a span is
    looked for in its own pieces only.
    """
    def within(pieces: Column, s: Column) -> Column:
        start = (s["start"] % CUT).cast("int")
        first = (F.floor(s["start"] / CUT) + 1).cast("int")
        held = F.slice(pieces, first, F.floor((start + s["length"]) / CUT).cast("int") + 1)
        return unescape(F.substring(F.array_join(held, ""), start + 1, s["length"].cast("int")))

    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return _once(pieces, lambda cut: F.transform(spans, lambda s: within(cut, s)))
