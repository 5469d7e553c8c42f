"""Chat formatting in budgeted windows.

Turns are marked by control strings; backslashes and the beginnings of control strings inside texts are escaped, so that
formatting can be undone. The tokens before each turn (a prefix sum) choose its window: what the budget leaves beside the
system turn and the history is cut in halves, turns that begin in the same half share a window, and a turn longer than
a half has one of its own, so whole turns never overrun the budget unless one alone does. A window begins with the
conversation's system turn and up to the history's tokens of turns before it; only assistant turns that are new in a
window are under its loss mask, so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1_024, 256
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column, name: bool = False) -> Column:
    """Backslash before backslashes and before the bar of `<|`; in names also `\\n` for a line feed."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if name else out


def unescape(text: str, name: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if name and m[1] == "n" else m[1], text)


def tokens(text: Column) -> Column:
    """Words and single signs, and four for the marks around a turn."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")) + 4


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count=tokens) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, window, formatted, mask (start and length in characters), repeated.

    `repeated` is the number of leading turns that stand for context only. Null roles and texts are empty. Turns of equal
    number keep the order of role and text; a null number comes last. Rows with a null conv_id form one conversation.
    A window's tokens keep to the budget but where a single turn, or the system turn and the history, leave no room: a turn
    beyond it stays whole in a window of its own. Repeated rows are turns of their own. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), count(text).cast("long").alias("n"))
    inside = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(inside)).withColumn("before", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    said = F.coalesce(F.max(F.when(system, F.col("n"))).over(Window.partitionBy("conv_id")), F.lit(0))
    half = F.greatest(F.lit(1), F.floor((budget - history - said) / 2))
    rows = rows.withColumn("long", F.col("n") > half).withColumn("part", F.floor(F.col("before") / half))
    follows = (F.col("part") == F.lag("part").over(inside)) & ~F.col("long") & ~F.lag("long").over(inside)
    rows = rows.withColumn("begins", F.when(follows | (F.col("pos") == 1), 0).otherwise(1))
    rows = rows.withColumn("window", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("long", "part", "begins")
    later = Window.partitionBy("conv_id").orderBy(F.col("window").desc()).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.max_by(F.struct("window", "before"), -F.col("before")).over(later))
    piece = F.concat(F.lit(START), escaped(F.col("role"), name=True), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n"))
    # Where the text stands in its piece: after the mark, the role and a line feed.
    rows = rows.withColumn("piece", piece).withColumn("head", F.length(escaped(F.col("role"), name=True)) + len(START) + 1)
    rows = rows.withColumn("body", F.length("piece") - F.col("head") - len(END) - 1)
    target = F.col("role") == "assistant"
    parts = ["conv_id", "window", "pos", "new", "piece", "head", "body", "target"]
    new = rows.withColumns({"new": F.lit(True), "target": target}).select(parts)
    old = rows.where(F.col("next").isNotNull() & (F.col("next.before") - F.col("before") <= history) & ~system)
    old = old.withColumns({"window": F.col("next.window"), "new": F.lit(False), "target": F.lit(False)}).select(parts)
    later_windows = rows.where("window > 0").select(F.struct("conv_id").alias("of"), "window").distinct()
    kept = rows.where(system).withColumns({"of": F.struct("conv_id"), "new": F.lit(False), "target": F.lit(False)}).drop("window", "next")
    kept = kept.join(later_windows, kept.of.eqNullSafe(later_windows.of)).select(parts)
    whole = new.unionByName(old).unionByName(kept).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "piece", "head", "body", "target"))).alias("parts"))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return whole.select("conv_id", "window", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("mask"), F.size(F.filter("parts", lambda p: ~p["new"])).alias("repeated"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted window; an error if anything else stands there."""
    turns, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            break
        turns.append((unescape(m[1], name=True), unescape(m[2])))
        end = m.end()
    if end != len(formatted):
        raise ValueError("not a formatted window")
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """windows() -> for each conversation n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read from the windows.

    A conversation's windows come to one task in their order and pass through running digests, so none is held as a whole.
    One row for each conversation, also for one whose conv_id is null; no windows, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        none = object()
        current, state, done = none, None, []

        def close():
            if current is not none:
                n, turns, chars, loss, total = state
                done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if current is none or row["conv_id"] != current:
                    close()
                    current, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in parse(text)[row["repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in row["mask"]:
                    said = unescape(text[span["start"] : span["start"] + span["length"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    dealt = formatted.select(F.col("conv_id").cast("long"), "window", "formatted", "mask", "repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
