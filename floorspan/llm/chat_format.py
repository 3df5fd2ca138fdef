"""Chat formatting: minimum-cost role repair by dynamic programming, then rendering.

A legal conversation is an optional system message, then user and assistant messages in turn, the user first.
Each turn is kept, relabelled, or merged into the message before it, and an empty message may be inserted before
it; dynamic programming over the automaton's states (the role of the last message) finds the repairs of the
least total cost.  Of repairs of equal cost, the one with the lowest last state is taken and, from the last turn
backwards, the first in the order of ``options`` that keeps the cost least.

Distinct turns are ordered by number (null last), role (null first) and a hash of the text.  Their places are counted
over ranges of the whole table (``places``), so that a conversation that holds a third of all rows is spread over many
tasks, and ``block`` places in a row are a block.  A block is summed up as a min-plus matrix of costs from the state
before it to the state after it; a scan of the matrices gives the true costs of each state before each block.  With those,
a block maps the state that it ends in to the state that it begins in, as the rule above says, and a scan of these
maps from the end gives the state at each border.  Both products are associative, so the scans go by trees of fixed
fan-in (``scan``).  Each block then makes its choices alone, the same as without blocks.

All this works on narrow rows without texts.  Texts are shuffled once, to meet their turn's choice, and rendered by column
functions: the result has a row for each turn whose ``fragment`` is the turn's part of the rendered conversation.  The fragments
in the order of ``place`` are the rendering, so no conversation has to fit into one row or task.

Defined cases: repeated rows (same conversation, turn, role and text) count once, whatever their number; different texts
of equal turn and role go by their hash; a null or unknown role is relabelled at a lower cost than a known one; a null
text is empty; a null conversation id is a conversation; the template's control strings inside texts are broken by a
space; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorspan.llm._common import cut, table
from floorspan.session import ship

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles that may follow a state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COST_MERGE, COST_INSERT, COST_RELABEL, COST_NAME = 1, 2, 3, 1
BLOCK = 1024
#: Blocks that are combined at a time.
FAN_IN = 256
INFINITE = 1 << 40
HEADER, FOOTER, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
#: Costs before the first turn.
BEGIN = [0, INFINITE, INFINITE, INFINITE]


def _options() -> dict[int, dict[int, list[tuple[int, int, str, int]]]]:
    """role of the turn (0: unknown) -> state after -> (cost, state before, action, role inserted) in order of preference."""
    out: dict[int, dict[int, list[tuple[int, int, str, int]]]] = {}
    for role in range(4):
        for label in (SYSTEM, USER, ASSISTANT):
            base = 0 if role == label else COST_RELABEL if role else COST_NAME
            found = [(base, s, "keep", 0) for s in range(4) if label in LEGAL[s]]
            found += [(base + COST_MERGE, label, "merge", 0)]
            found += [(base + COST_INSERT, s, "insert", via) for s in range(4) for via in LEGAL[s] if label in LEGAL[via] and label not in LEGAL[s]]
            out.setdefault(role, {})[label] = found
    return out


OPTIONS = _options()


def role_code(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else 0


def forward(roles: list[int], before: list[int]) -> list[list[int]]:
    """Least costs of each state after each turn, from the costs of the states before the first."""
    out = [before]
    for role in roles:
        last, now = out[-1], [INFINITE] * 4
        for label, found in OPTIONS[role].items():
            now[label] = min(INFINITE, min(last[s] + c for c, s, _, _ in found))
        out.append(now)
    return out


def closing(end_with_assistant: bool) -> list[int]:
    """Costs of ending in each state; ending with a system message or nothing is legal."""
    return [0, 0, COST_INSERT if end_with_assistant else 0, 0]


def repair(roles: list[int], before: list[int], state: int | None = None, end_with_assistant: bool = False) -> list[tuple[int, str, int, int]]:
    """(role, action, role inserted before, cost) of each turn; ``state`` is the state to end in, else the cheapest."""
    costs = forward(roles, before)
    if state is None:
        ends = [a + b for a, b in zip(costs[-1], closing(end_with_assistant), strict=True)]
        state = ends.index(min(ends))
    out = []
    for i in range(len(roles) - 1, -1, -1):
        for c, s, action, via in OPTIONS[roles[i]][state]:
            if costs[i][s] + c == costs[i + 1][state]:
                out.append((state, action, via, c))
                state = s
                break
    return out[::-1]


def matrix(roles: list[int]) -> list[int]:
    """The least costs of a block from each state before it to each state after it, row by row."""
    return [x for s in range(4) for x in forward(roles, [0 if t == s else INFINITE for t in range(4)])[-1]]


def after(costs: list[int], m: list[int]) -> list[int]:
    """The least costs after a block, from those before it."""
    return [min(INFINITE, min(costs[s] + m[4 * s + t] for s in range(4))) for t in range(4)]


def both(m: list[int], k: list[int]) -> list[int]:
    """The matrix of two blocks in a row."""
    return [x for s in range(4) for x in after(m[4 * s : 4 * s + 4], k)]


def begins(roles: list[int], before: list[int]) -> list[int]:
    """The state before a block for each state after it, by the costs before it; -1 where that can't be reached."""
    costs, out = forward(roles, before), []
    for state in range(4):
        if costs[-1][state] >= INFINITE:
            out.append(-1)
            continue
        for i in range(len(roles) - 1, -1, -1):
            state = next(s for c, s, _, _ in OPTIONS[roles[i]][state] if costs[i][s] + c == costs[i + 1][state])
        out.append(state)
    return out


def through(state: list[int], m: list[int]) -> list[int]:
    return [-1 if x < 0 else m[x] for x in state]


def _groups(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns; a run may go on over batches."""
    key, own = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own and row[:n_key] != key:
                yield key, own
                own = []
            key = row[:n_key]
            own.append(row)
    if own:
        yield key, own


def scan(rows: DataFrame, start: Callable[[str], DataFrame], apply: Callable, combine: Callable, most: int, fan_in: int = FAN_IN) -> DataFrame:
    """(conv, b, x): what comes before each of the elements (conv, b, m), b from 0 to ``most``.

    ``start`` gives (conv, x), the x of each conversation's element 0; ``apply(x, m)`` is the next x, and ``combine``
    joins two elements.  Elements meet ``fan_in`` at a time, level by level.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    up = F.floor(F.col("b") / fan_in).cast("long")

    def product(t: pa.Table) -> pa.Table:
        t = t.sort_by("b")
        m = t["m"].to_pylist()
        total = m[0]
        for k in m[1:]:
            total = combine(total, k)
        return pa.table({"conv": t["conv"][:1], "b": t["up"][:1], "m": pa.array([total], pa.list_(pa.int64()))})

    def spread(t: pa.Table) -> pa.Table:
        t = t.sort_by("b")
        x, out = t["x"][0].as_py(), []
        for m in t["m"].to_pylist():
            out.append(x)
            x = apply(x, m)
        return pa.table({"conv": t["conv"], "b": t["b"], "x": pa.array(out, pa.list_(pa.int64()))})

    if most < fan_in:
        held = rows.join(start(kind).withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
        return held.groupBy("conv").applyInArrow(spread, f"conv {kind}, b long, x array<long>")
    upper = cut(rows.withColumn("up", up).groupBy("conv", "up").applyInArrow(product, f"conv {kind}, b long, m array<long>"))
    begin = scan(upper, start, apply, combine, most // fan_in, fan_in).select(F.col("conv").alias("c"), F.col("b").alias("up_"), "x")
    held = rows.withColumn("up", up).join(begin, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("up_")))
    return held.groupBy("conv", "up").applyInArrow(spread, f"conv {kind}, b long, x array<long>")


def places(turns: DataFrame, order: list[str]) -> DataFrame:
    """Distinct ``turns`` with their ``place`` in the conversation, from 0, and ``last``, whether they end it.

    Turns are dealt by ranges of conversation and order, and counted by range; a place is that within the range after the
    counts of the conversation's ranges before.  Only those that span ranges, two for each range at most, need them.
    """
    keys = [F.col("conv").asc_nulls_first(), *[F.col(c).asc_nulls_last() if c == "turn" else F.col(c).asc_nulls_first() for c in order]]
    ranges = cut(turns.repartitionByRange(*keys).withColumn("p", F.spark_partition_id()))
    # a range's rows of a conversation; partial sums leave a row for each task and conversation
    sums = ranges.groupBy("conv", "p").agg(F.count("*").alias("size"))
    w = Window.partitionBy("conv").orderBy("p")  # a row for each range of a conversation
    sums = sums.select(F.col("conv").alias("c"), F.col("p").alias("q"), (F.sum("size").over(w) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy("conv")).alias("all"))
    within = F.row_number().over(Window.partitionBy("p", "conv").orderBy(*keys[1:]))
    found = ranges.withColumn("r", within).join(sums, F.col("conv").eqNullSafe(F.col("c")) & (F.col("p") == F.col("q")))
    place = F.col("before") + F.col("r") - 1
    return found.select("conv", *order, place.alias("place"), (place + 1 == F.col("all")).alias("last"))


def choices(turns: DataFrame, block: int, end_with_assistant: bool) -> DataFrame:
    """(conv, turn, role, h, place, last, label, action, via, cost) of distinct narrow turns (conv, turn, role, h)."""
    conv_kind, turn_kind = (turns.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    rows = cut(places(turns, ["turn", "role", "h"]).withColumn("b", F.floor(F.col("place") / block).cast("long")))
    most = rows.agg(F.max("b")).first()[0] or 0
    of_block = lambda df: df.repartition("conv", "b").sortWithinPartitions("conv", "b", "place")

    def each_block(df: DataFrame, made: Callable[[list[int], tuple], list[int]]) -> DataFrame:
        """(conv, b, m) of blocks, from their roles and first row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types: list[pa.DataType] = []

            def typed():
                for batch in batches:
                    types[:] = batch.schema.types
                    yield batch

            for (conv, b), own in _groups(typed(), 2):
                m = made([role_code(r[3]) for r in own], own[0])
                yield pa.RecordBatch.from_arrays([pa.array([conv], types[0]), pa.array([b], types[1]), pa.array([m], pa.list_(pa.int64()))], ["conv", "b", "m"])

        return cut(of_block(df).mapInArrow(run, f"conv {conv_kind}, b long, m array<long>"))

    none = F.lit(None).cast("array<long>")
    if most == 0:
        marked = rows.withColumn("x", none).withColumn("e", none)
    else:
        many = rows.filter("last and b > 0").select(F.col("conv").alias("c"), F.col("b").alias("last_b"))
        long_ones = rows.select("conv", "b", "place", "role").join(many, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
        convs = cut(many)
        # forwards: the costs of each state before each block
        matrices = each_block(long_ones.select("conv", "b", "place", "role"), lambda roles, _: matrix(roles))
        at_start = lambda kind: convs.select(F.col("c").alias("conv"), F.array(*map(F.lit, BEGIN)).cast("array<long>").alias("x"))
        costs = cut(scan(matrices, at_start, after, both, most))
        # backwards: blocks are counted from the end, so that the scan begins there
        named = costs.select(F.col("conv").alias("c_"), F.col("b").alias("b_"), "x")
        with_costs = long_ones.join(named, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("b") == F.col("b_")))
        maps = each_block(with_costs.select("conv", "b", "place", "role", "x", "last_b"), lambda roles, first: [*begins(roles, first[4]), first[5] - first[1]])
        back = maps.select("conv", F.element_at("m", -1).alias("b"), F.slice("m", 1, 4).alias("m"))
        ends = cut(matrices.join(convs, F.col("conv").eqNullSafe(F.col("c")) & (F.col("b") == F.col("last_b"))).drop("c", "last_b").join(named, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("b") == F.col("b_"))))
        close = F.array(*map(F.lit, closing(end_with_assistant))).cast("array<long>")
        total = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.get(close, t) + F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.get(F.col("x"), s) + F.get(F.col("m"), s * 4 + t))))
        at_end = lambda kind: ends.select("conv", F.array((F.array_position(total, F.array_min(total)) - 1).cast("long")).alias("x"))
        states = scan(back, at_end, through, lambda m, k: through(m, k), most)
        states = states.join(convs, F.col("conv").eqNullSafe(F.col("c"))).select("conv", (F.col("last_b") - F.col("b")).alias("b"), F.col("x").alias("e"))
        border = cut(states.select(F.col("conv").alias("c"), F.col("b").alias("q"), "e").join(named, F.col("c").eqNullSafe(F.col("c_")) & (F.col("q") == F.col("b_"))).select("c", "q", "x", "e"))
        marked = rows.join(border, F.col("conv").eqNullSafe(F.col("c")) & (F.col("b") == F.col("q")), "left").drop("c", "q")

    names = ["conv", "turn", "role", "h", "place", "last", "label", "action", "via", "cost"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        out: list[tuple] = []

        def typed():
            for batch in batches:
                types[:] = batch.schema.types
                yield batch

        def flush() -> pa.RecordBatch:
            kinds = [types[0], types[3], types[4], pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for (conv, _), own in _groups(typed(), 2):
            before, end = own[0][7] or BEGIN, own[0][8]
            done = repair([role_code(r[4]) for r in own], before, end[0] if end else None, end_with_assistant)
            out += [(conv, r[3], r[4], r[5], r[2], r[6], *d) for r, d in zip(own, done, strict=True)]
            if len(out) > 10_000:
                yield flush()
                out = []
        if out:
            yield flush()

    dealt = of_block(marked.select("conv", "b", "place", "turn", "role", "h", "last", "x", "e"))
    return dealt.mapInArrow(work, f"conv {conv_kind}, turn {turn_kind}, role string, h long, place long, last boolean, label int, action string, via int, cost long")


def fragment(text: Column, add_assistant: bool) -> Column:
    """A turn's part of the rendering: what closes the message before it, inserted messages, its own text."""
    body = F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    header = lambda role: F.concat(F.lit(HEADER.split("{}")[0]), F.get(F.array(*map(F.lit, ROLES)), role - 1), F.lit(HEADER.split("{}")[1]))
    opened = F.concat(
        F.when(F.col("place") == 0, "").otherwise(FOOTER),
        F.when(F.col("via") > 0, F.concat(header(F.col("via")), F.lit(FOOTER))).otherwise(""),
        header(F.col("label")),
        body,
    )
    closed = F.lit(FOOTER)
    if add_assistant:
        closed = F.concat(closed, F.when(F.col("label") == USER, HEADER.format("assistant") + FOOTER).otherwise(""))
    return F.concat(F.when(F.col("action") == "merge", F.concat(F.lit(JOINT), body)).otherwise(opened), F.when(F.col("last"), closed).otherwise(""))


def format_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", end_with_assistant: bool = False, block: int = BLOCK
) -> DataFrame:
    """(conv, turn, place, role, new_role, action, inserted, cost, fragment) of every distinct turn."""
    ship(conversations.sparkSession)
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    key = ["conv", "turn", "role", "h"]
    made = choices(rows.select(*key).distinct(), block, end_with_assistant)
    texts = rows.groupBy(*[F.col(c).alias(f"{c}_") for c in key]).agg(F.max("text").alias("text"))  # a row that is repeated often leaves each task once
    met = F.lit(True)
    for c in key:
        met = met & F.col(c).eqNullSafe(F.col(f"{c}_"))
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    name = lambda c: F.get(F.array(*map(F.lit, ROLES)), F.col(c) - 1)
    what = F.when((F.col("action") == "keep") & (role != name("label")), "relabel").otherwise(F.col("action"))
    return made.join(texts, met).select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "place", "role", name("label").alias("new_role"), what.alias("action"), F.when(F.col("via") > 0, name("via")).alias("inserted"), "cost",
        fragment(F.col("text"), end_with_assistant).alias("fragment"),
    )


def render(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, rendered): whole renderings, for conversations that fit into a row; use the fragments for others."""
    part = F.struct("place", "fragment")
    return formatted.groupBy(conv_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["fragment"]), "").alias("rendered"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = format_turns(table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "turn", "place", "role", "new_role", "action", "inserted", "cost", F.length("fragment").cast("long").alias("n_chars"), F.sha2("fragment", 256).alias("fragment_sha256"))
