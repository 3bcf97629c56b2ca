"""Running state over a long ordered sequence, computed in blocks.

A window over a whole book would put the book, which may hold a third of all rows, into one task. Here a window runs within each
block; the blocks' totals, one row each, are carried over the book and joined back. The only sequence that one task sees
whole is that of the blocks' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import cut


def _within(key: list[str], block: str, seq: str):
    return Window.partitionBy(*key, block).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)


def _earlier(key: list[str], block: str):
    return Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, key: list[str], block: str, seq: str, sums: dict[str, Column] | None = None, lasts: dict[str, tuple[Column, object]] | None = None) -> DataFrame:
    """Several running states in one pass, in the order of (block, seq): for `sums` the sum of a value up to and including each row, for
    `lasts` its last non-null value, or the initial one before the first."""
    sums, lasts = sums or {}, lasts or {}
    rows = df.select("*", *(v.alias(f"_v_{n}") for n, v in sums.items()), *(v.alias(f"_v_{n}") for n, (v, _) in lasts.items()))
    total = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    total += [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(seq))).alias(f"_t_{n}") for n in lasts]
    earlier, within = _earlier(key, block), _within(key, block, seq)
    before = [F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums]
    before += [F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in lasts]
    carried = rows.groupBy(*key, block).agg(*total).select(*key, block, *before)
    own = [F.sum(f"_v_{n}").over(within).alias(f"_o_{n}") for n in sums]
    own += [F.last(f"_v_{n}", ignorenulls=True).over(within).alias(f"_o_{n}") for n in lasts]
    joined = rows.select(*df.columns, *own).join(carried, [*key, block])
    out = [(F.col(f"_o_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums]
    out += [F.coalesce(f"_o_{n}", f"_b_{n}", F.lit(initial)).alias(n) for n, (_, initial) in lasts.items()]
    return joined.select(*df.columns, *out)


def running_sum(df: DataFrame, key: list[str], block: str, seq: str, value: Column, out: str) -> DataFrame:
    """`out`: the sum of `value` up to and including each row."""
    return running(df, key, block, seq, sums={out: value})


def running_last(df: DataFrame, key: list[str], block: str, seq: str, value: Column, out: str, initial) -> DataFrame:
    """`out`: the last non-null `value` up to and including each row, `initial` before the first."""
    return running(df, key, block, seq, lasts={out: (value, initial)})


#: Blocks whose effects are combined in one row.
FAN = 256
_STATE = "struct<keep:int,tail:array<string>>"


def _moved(stack: Column, effects: Column) -> Column:
    """A stack after a block: what the effects for its depth keep of it, and what they append."""
    return F.transform(F.array(F.get(effects, F.size(stack))), lambda e: F.concat(F.slice(stack, 1, e["keep"]), e["tail"]))[0]


def _combined(first: Column, effects: Column) -> Column:
    """An effect (keep, tail) followed by a block."""
    e = F.get(effects, first["keep"] + F.size(first["tail"]))
    keep = F.least(first["keep"], e["keep"])
    return F.struct(keep.alias("keep"), F.concat(F.slice(first["tail"], 1, e["keep"] - keep), e["tail"]).alias("tail")).cast(_STATE)


def _start(depth: int) -> Column:
    return F.struct(F.lit(depth).cast("int").alias("keep"), F.array().cast("array<string>").alias("tail")).cast(_STATE)


def _incoming(effects: DataFrame, key: str, block: str, fan: int) -> DataFrame:
    """(key, block, _stack): the stack before each block. Effects of `fan` blocks at a time are combined to one, level by level, and the stacks are carried down again: no row holds more than
    `fan` blocks, whatever the length of a book."""
    kind, over = dict(effects.dtypes)[block], f"{block}_over"
    parent = effects.withColumn(over, F.floor(F.col(block) / fan))
    groups = parent.groupBy(key, over).agg(F.sort_array(F.collect_list(F.struct(F.col(block).alias("block"), F.col("_effects").alias("effects")))).alias("_b"))
    top = effects.agg(F.max(block)).first()[0]
    if top is None or top < fan:
        above = groups.select(key, over, F.array().cast("array<string>").alias("_stack"))
    else:
        groups = cut(groups)
        combined = groups.select(key, over, F.array(*(F.aggregate("_b", _start(d), lambda acc, b: _combined(acc, b["effects"])) for d in range(4))).alias("_effects"))
        above = _incoming(combined, key, over, fan)
    carried = F.aggregate(
        "_b",
        F.struct(F.col("_stack").alias("stack"), F.array().cast(f"array<struct<block:{kind},stack:array<string>>>").alias("out")),
        lambda acc, b: F.struct(_moved(acc["stack"], b["effects"]).alias("stack"), F.array_append(acc["out"], F.struct(b["block"].alias("block"), acc["stack"].alias("stack"))).alias("out")),
    )["out"]
    return groups.join(above, [key, over]).select(key, F.inline(carried).alias(block, "_stack"))


def breadcrumbs(headers: DataFrame, key: str, block: str, seq: str, level: str, title: str, out: str, fan: int = FAN) -> DataFrame:
    """`out`: the path of each header: the stack is cut to level - 1 entries and the title pushed, so that after a
    skipped level siblings nest.

    What a block does to the stack depends on the incoming depth only: it keeps some entries and appends others. These
    effects are computed for each depth in each block, combined in a tree over the blocks of a book, and applied within the blocks.
    Levels are at most 3, so there are four depths."""

    def step(acc: Column, h: Column) -> Column:
        size = F.least(acc["keep"] + F.size(acc["tail"]), h["level"] - 1)
        keep = F.least(acc["keep"], size)
        return F.struct(keep.cast("int").alias("keep"), F.concat(F.slice(acc["tail"], 1, size - keep), F.array(h["title"])).alias("tail")).cast(_STATE)

    blocks = headers.groupBy(key, block).agg(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(level).cast("int").alias("level"), F.col(title).alias("title")))).alias("_h"))
    effects = blocks.select(key, block, F.array(*(F.aggregate("_h", _start(d), step) for d in range(4))).alias("_effects"))
    incoming = _incoming(effects, key, block, fan)
    paths = F.aggregate(
        "_h",
        F.struct(F.col("_stack").alias("stack"), F.array().cast(f"array<struct<seq:{dict(headers.dtypes)[seq]},path:array<string>>>").alias("out")),
        lambda acc, h: F.transform(
            F.array(F.concat(F.slice(acc["stack"], 1, h["level"] - 1), F.array(h["title"]))), lambda s: F.struct(s.alias("stack"), F.array_append(acc["out"], F.struct(h["seq"].alias("seq"), s.alias("path"))).alias("out"))
        )[0],
    )["out"]
    return blocks.join(incoming, [key, block]).select(key, block, F.inline(paths).alias(seq, out))
