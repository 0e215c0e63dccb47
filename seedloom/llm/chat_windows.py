"""Chat formatting in windows of a token budget, with a loss mask, and the way back from windows to turns.

Every turn is written between the marks of its role. Control strings inside texts are escaped: a backslash is doubled,
and a control string gets a backslash after its first character, so none is left and the text can be had back.

Prefix sums of turn tokens choose the spans. A conversation's room is the budget without its system turn, the history
and the opening mark; turns that start in the same half of a room make a span, so a span fits unless a single turn
is longer than that half, which is a span of its own and marked if its window passes the budget. Spans end at multiples
of BLOCK turn numbers, so that sums run over blocks first and then within each: a long conversation is many small keys.
A window holds its span, before it the system turn, and the turns of the span before if they have at most ``history`` tokens
together from there to its end. Only assistant texts that are new to a window are under its loss mask; repeated ones aren't.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.storage import written
from .token_counts import BATCH_BYTES, counter
from .util import chunks

#: Turn numbers in a block: no span crosses one.
BLOCK = 64
#: The template: what stands at the start of a window, and around the text of each role. Marks begin and end with blanks
#: where a text meets them, so that text and mark never join to a control string.
BEGIN = "<s>"
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER, OTHER_END = "[ROLE:", " [/ROLE]"
#: Strings that are escaped in texts and roles: marks of this template and of the usual ones.
CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE:", "[/ROLE]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<pad>", "<unk>"]
_FOLLOW = "|".join(re.escape(c[1:]) for c in CONTROL)
_TURN = re.compile(
    r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE:(?P<role>(?:[^\\\]]|\\.)*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.S
)


def _key(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key")


def escaped(text: Column) -> Column:
    """The text without control strings; see opening() for a role's."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={_FOLLOW})", r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def opening(role: Column) -> Column:
    """The mark before a turn's text. Roles without marks of their own, and none, are named, "]" as "\\]"."""
    named = F.concat(F.lit(OTHER), F.when(role.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.replace(escaped(role), F.lit("]"), F.lit("\\]")))), F.lit("] "))
    for name, (before, _) in MARKS.items():
        named = F.when(role == name, before).otherwise(named)
    return named


def closing(role: Column) -> Column:
    end = F.lit(OTHER_END)
    for name, (_, after) in MARKS.items():
        end = F.when(role == name, after).otherwise(end)
    return end


def written_turns(df: DataFrame, path: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, conv, turn, role, piece, body_at, body_len, tokens): each row as it stands in a window, counted once."""
    body, who = escaped(F.coalesce(F.col(text), F.lit(""))), F.col(role)
    rows = df.select(_key(conv), F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"),
        opening(who).alias("before"), body.alias("body"), closing(who).alias("after"))
    rows = rows.select("key", "conv", "turn", "role", F.concat("before", "body", "after").alias("piece"), F.length("before").alias("body_at"), F.length("body").alias("body_len"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in chunks(batches, "piece", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(count(part.column("piece").to_pylist()))], names=[*part.schema.names, "tokens"])

    return rows.mapInArrow(run, f"{kinds}, tokens long")


def chat_windows(df: DataFrame, path: str, budget: int = 1024, history: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, window, formatted, loss, n_turns, n_repeated, tokens, over_budget) of every window of every conversation.

    ``df``: a row for each turn. window: tokens of the conversation before it, 0 for the first. loss: array of struct(start,
    end) in code points of ``formatted``, the escaped new assistant texts. The first ``n_repeated`` of its ``n_turns``
    were in an earlier window: the system turn (the first turn, if of role "system") and the history. tokens: sum of the
    turns' tokens by the vocabulary at ``path`` and one for the opening mark.

    Rows come in order of turn, null first, equals by role and then as written. A null text counts as empty. Rows without
    a conversation are one of their own, with a null id. Any role is kept, null too. An empty table gives no windows.
    Other columns are not looked at. Rows repeated with one turn number stay in one block, however many.
    """
    block = F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(1 << 62))).alias("block")
    rows = written(written_turns(df, path, conv, turn, role, text).select("*", block))
    lead = F.struct("turn", "role", F.when(F.col("role") == "system", F.struct("piece", "tokens")).alias("system"))
    blocks = rows.groupBy("key", "block").agg(F.sum("tokens").alias("all"), F.min(lead).alias("lead"))
    past = Window.partitionBy("key").orderBy("block")
    blocks = blocks.select("key", "block", F.first("lead.system").over(past).alias("system"), F.coalesce(F.sum("all").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("past"))
    blocks = blocks.withColumn("opens", F.col("past") == 0).withColumn("sys_n", F.coalesce("system.tokens", F.lit(0)))
    placed = rows.join(blocks, ["key", "block"])

    order = Window.partitionBy("key", "block").orderBy("turn", "role", "piece")
    first = F.col("opens") & F.col("system").isNotNull() & (F.row_number().over(order) == 1)
    placed = placed.withColumn("leads", first).withColumn("n", F.when(F.col("leads"), 0).otherwise(F.col("tokens")))
    until = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("end", F.when(F.col("opens"), 0).otherwise(F.col("past") - F.col("sys_n")) + until).withColumn("start", F.col("end") - F.col("n"))
    half = F.greatest(F.expr(f"({budget} - 1 - {history} - sys_n) div 2"), F.lit(1))
    placed = placed.withColumn("long", F.col("n") > half).withColumn("bin", F.expr("start").cast("long") - F.pmod("start", half))
    placed = placed.withColumn("longs", F.count_if("long").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy("key", "block", "bin", "longs", "long")  # within a block: no shuffle
    placed = placed.withColumn("begin", F.min("start").over(span)).withColumn("fin", F.max("end").over(span))

    bears = (F.col("start") == F.col("begin")) & ~F.col("leads") & (F.col("begin") > 0)
    new = F.struct(F.col("begin").alias("window"), F.lit(False).alias("repeated"), F.when(bears, F.col("system")).alias("system"))
    again = F.struct(F.col("fin").alias("window"), F.lit(True).alias("repeated"), F.lit(None).cast("struct<piece:string,tokens:bigint>").alias("system"))
    both = F.when(~F.col("leads") & (F.col("fin") - F.col("start") <= history), F.array(new, again)).otherwise(F.array(new))
    shown = placed.select("key", "conv", "start", "end", "piece", "role", "body_at", "body_len", "tokens", F.explode(both).alias("w")).select("*", "w.*").drop("w")
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    part = F.struct("start", "end", "repeated", "piece", "tokens", F.when(target, F.col("body_at")).alias("at"), F.when(target, F.col("body_len")).alias("len"))
    found = shown.groupBy("key", "window").agg(
        F.first("conv", True).alias(conv), F.max("system").alias("system"), F.sort_array(F.collect_list(part)).alias("parts"), F.count_if(~F.col("repeated")).alias("news")
    ).filter("news > 0")
    before = F.concat(F.lit(BEGIN), F.coalesce("system.piece", F.lit("")))
    spans = """aggregate(parts, struct(int(length(before)) as at, cast(array() as array<struct<start:int,end:int>>) as spans), (a, x) -> struct(a.at + length(x.piece) as at,
        if(x.at is null, a.spans, array_append(a.spans, struct(a.at + x.at as start, a.at + x.at + x.len as end))) as spans)).spans"""
    tokens = F.expr("1 + coalesce(system.tokens, 0) + aggregate(parts, 0L, (a, x) -> a + x.tokens)")
    extra = F.expr("int(system is not null)")
    return found.withColumn("before", before).select(
        conv, "window", F.concat("before", F.array_join("parts.piece", "")).alias("formatted"), F.expr(spans).alias("loss"), (F.size("parts") + extra).alias("n_turns"),
        (F.size("parts") - F.col("news").cast("int") + extra).alias("n_repeated"), tokens.alias("tokens"), (tokens > budget).alias("over_budget")
    )


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """(role, text) of the turns of a window, unescaped. What is no window is an error."""
    at, turns = len(BEGIN), []
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn begins at {at}")
        kind = next(k for k in ("other", *MARKS) if m[k] is not None)
        if kind == "other":
            turns.append((unescaped(m["role"][1:]) if m["role"] else None, unescaped(m["other"])))
        else:
            turns.append((kind, unescaped(m[kind])))
        at = m.end()
    return turns


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from the windows' text and masks.

    turns: role, line feed, text, line feed of every turn that no earlier window showed; a null role as empty. loss: all
    text under the masks, unescaped. Windows stream in order, so a conversation takes no more memory than a window.
    """
    kind = windows.schema[conv].dataType.simpleString()
    rows = windows.select(_key(conv), F.col(conv).alias("c"), "window", "formatted", "loss", "n_repeated")
    rows = rows.repartition("key").sortWithinPartitions("key", "window")
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [to_arrow_type(windows.schema[conv].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

        def ended():
            c, n, turns, chars, loss, size = state
            done.append((c, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for part in chunks(iter([batch]), "formatted", BATCH_BYTES):
                for row in part.to_pylist():
                    if row["key"] != key:
                        if state:
                            ended()
                        key, state = row["key"], [row["c"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for who, said in parse(row["formatted"])[row["n_repeated"] :]:
                        state[1] += 1
                        state[2].update(f"{who or ''}\n{said}\n".encode())
                    for at in row["loss"]:
                        text = unescaped(row["formatted"][at["start"] : at["end"]])
                        state[3] += len(text)
                        state[4].update(text.encode())
                    state[5] += len(row["formatted"])
            if done:
                yield flush(done)
                done = []
        if state:
            ended()
            yield flush(done)

    return rows.mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
