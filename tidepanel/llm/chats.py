"""Cheapest repair of a conversation's turns, decided by one big integer a state.

A repaired conversation has roles whose initials match ``(s?(ua)+)?``. Rows are kept (K, free), given the role that is due (R, 2), deleted (D, 3; blank
and duplicate rows must go) or inserted empty (I, 2); a truncated row that stays costs 1 more. Of the cheapest edits the ASCII-least audit wins.

The weight of a state before a row is a scalar: ``cost * 8**digits`` plus an octal fraction of fixed width that spells the letters still to come, first
letter first, ended with zeros. Putting a letter in front moves the fraction one place down and sets its first digit, so smaller integers mean
cheaper edits, and among these ASCII-lesser ones (a shorter audit before its continuations). One backward minimum over
the graph of rows and states then decides everything.

A conversation may hold a third of all rows, so it is cut into blocks of ``BLOCK`` rows:

1. Rows are sorted over all machines by range; equal rows are counted before, then numbered apart. A row's fault and initial become one character.
2. Each block gives its least cost from each state to each state; a backward scan over these small tables says what the rest costs after each block.
3. The big-integer minimum runs block by block with that as its start. Insertions before a row belong to the row's block, so that no block's letters
   are the beginning of another choice's, and the letters of a block need not be compared any further.
4. The blocks' letters, one choice for each state at their start, are followed in order next to the rows, which pass by one at a time.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import BLANKS
from tidepanel.session import staged

#: Rows of a block, as a power of two: positions of one sorted part are numbered from a multiple of it.
BLOCK_BITS = 9
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an insertion or a change of role.
DUE = (USER, USER, ASSISTANT, USER)
#: ``KEEPS[initial][state]``: the state after a kept row with initial s, u, a or another; None where it may not stand.
KEEPS = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Octal digits of the letters in ASCII order; 0 ends an audit.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {v: k for k, v in DIGITS.items()}
FAULTS = (None, "truncated", "blank", "duplicate")
FAR = 1 << 60
#: What an ended conversation costs from each state: an empty one and one that ends with the assistant are right.
END = (0, 4, 2, 0)


def edges(code: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can become of a row; ``code`` is four times its initial plus its fault."""
    initial, fault = divmod(code, 4)
    out = [("D", 3, state)]
    if fault < 2:
        if KEEPS[initial][state] is not None:
            out.append(("K", fault, KEEPS[initial][state]))
        out.append(("R", 2 + fault, DUE[state]))
    return out


@lru_cache(1 << 16)
def cost_table(codes: str) -> tuple[int, ...]:
    """Least cost through a block from each state (rows) to each state (columns)."""
    after = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for c in reversed(codes):
        here = [[min(cost + after[to][b] for _, cost, to in edges(int(c, 16), a)) for b in range(4)] for a in range(4)]
        for _ in range(2):  # up to two rows put in before this one
            here = [[min(here[a][b], 2 + here[DUE[a]][b]) for b in range(4)] for a in range(4)]
        after = here
    return tuple(min(x, FAR) for row in after for x in row)


def before(table: tuple[int, ...], rest: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each state at the start of a block, ``rest`` being those at its end."""
    return tuple(min(table[4 * a + b] + rest[b] for b in range(4)) for a in range(4))


@lru_cache(1 << 16)
def letters(codes: str, rest: tuple[int, ...] | None) -> tuple[str, ...]:
    """The letters of a block from each state. ``rest`` holds the costs after the block; None ends the conversation there."""
    digits = 3 * len(codes) + 2
    top = 3 * (digits - 1)
    mask = (1 << 3 * digits) - 1

    def front(letter: str, cost: int, weight: int) -> int:
        spelt = weight & mask
        return weight - spelt + (cost << 3 * digits) + (DIGITS[letter] << top) + (spelt >> 3)

    def with_inserts(direct: list[int]) -> list[int]:
        out = direct
        for _ in range(2):
            out = [min(direct[q], front("I", 2, out[DUE[q]])) for q in range(4)]
        return out

    if rest is None:
        never = FAR << 3 * digits
        weights = with_inserts([0, never, never, 0])
    else:
        weights = [cost << 3 * digits for cost in rest]
    for c in reversed(codes):
        weights = with_inserts([min(front(letter, cost, weights[to]) for letter, cost, to in edges(int(c, 16), q)) for q in range(4)])
    out = []
    for weight in weights:
        spelt = []
        for i in range(digits):
            digit = weight >> (top - 3 * i) & 7
            if not digit:
                break
            spelt.append(LETTERS[digit])
        out.append("".join(spelt))
    return tuple(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` after the trial damage that a checksum of ``conv_id:turn`` deals out; a null counts as one space."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in order (``pos`` rises through a conversation, a ``block`` holds at most ``2**BLOCK_BITS`` rows), and a conversation's ``codes`` of each block."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    same = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    every = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    order = ["conv_id", "turn", "role", "text", "copy"]
    every = every.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ended == "", 2).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0))
    initial = F.when(initial == 0, 3).otherwise(initial - 1)
    columns = {"block": F.shiftright("pos", BLOCK_BITS), "fault": fault, "initial": initial.cast("int"), "digest": F.md5(F.encode("text", "UTF-8"))}
    every = staged(every.withColumns(columns).drop("copy"), "turns")
    # a row is a duplicate unless it is the first of its conversation, role and text; positions are unique, so no key of this join is frequent
    first = every.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    slim = every.select("pos", "conv_id", "block", "fault", "initial").join(first, "pos", "left")
    fault = F.when((F.col("fault") != 2) & F.col("first").isNull(), 3).otherwise(F.col("fault"))
    coded = slim.select("pos", "conv_id", "block", F.lower(F.hex((F.col("initial") * 4 + fault).cast("long"))).alias("code"))
    runs = coded.groupBy("conv_id", "block").agg(F.min("pos").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"))
    return every.select("conv_id", "turn", "block", "pos", "role", "text"), staged(runs, "blocks")


def _per_row(work, *columns: str):
    """A ``mapInArrow`` function from a generator of rows (as tuples) to rows."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in columns))

        yield from _batched(work(rows()))

    return run


def _batched(rows, size: int = 2048, limit: int = 1 << 24):
    """Rows, which are dicts of (type, value), as batches; long texts end a batch early."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for _, v in row.values() if isinstance(v, str))
        if len(held) >= size or weight >= limit:
            yield _batch(held)
            held, weight = [], 0
    if held:
        yield _batch(held)


def _batch(held) -> pa.RecordBatch:
    names = list(held[0])
    return pa.RecordBatch.from_arrays([pa.array([row[c][1] for row in held], held[0][c][0]) for c in names], names)


def _rests(blocks: DataFrame) -> DataFrame:
    """``at`` and the costs ``rest`` after each block; null after the last of a conversation."""
    numbers = pa.list_(pa.int64())
    arrow = _arrow(blocks, "conv_id")

    def tables(rows):
        for conv, at, codes in rows:
            yield {"conv_id": (arrow, conv), "at": (pa.int64(), at), "table": (numbers, list(cost_table(codes)))}

    def scan(rows):
        now, rest = (), None
        for conv, at, table in rows:
            if (conv,) != now:
                now, rest = (conv,), None
            yield {"at": (pa.int64(), at), "rest": (numbers, None if rest is None else list(rest))}
            rest = before(tuple(table), END if rest is None else rest)

    head = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}"
    found = blocks.select("conv_id", "at", "codes").mapInArrow(_per_row(tables, "conv_id", "at", "codes"), f"{head}, at long, table array<long>")
    back = found.repartition("conv_id").sortWithinPartitions("conv_id", F.col("at").desc())
    return back.mapInArrow(_per_row(scan, "conv_id", "at", "table"), "at long, rest array<long>")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation, in order: ``conv_id``, ``place`` (from 0), ``edit`` (K, R, D or I), ``role``, ``text``, and of a row that was there its ``initial`` and ``fault``.

    What is left after the repair are the rows whose edit is not D; deleted rows keep the role and text they had. Rows are taken by ``turn``, nulls first, and those of one turn by role and text.
    A null role or text counts as one space, so a null text is blank. Repeated rows are duplicates of the first one. A null ``conv_id`` is a conversation like others.
    Other columns are left out; an empty table gives an empty result. Each partition of the result holds whole conversations in order.
    """
    turns, blocks = _placed(rows)
    rests = _rests(blocks)
    arrow = _arrow(blocks, "conv_id")
    texts = pa.list_(pa.string())

    def choose(items):
        for conv, block, codes, rest in items:
            yield {"conv_id": (arrow, conv), "block": (pa.int64(), block), "codes": (pa.string(), codes), "ways": (texts, list(letters(codes, None if rest is None else tuple(rest))))}

    kind = blocks.schema["conv_id"].dataType.simpleString()
    joined = blocks.join(rests, "at").select("conv_id", "block", "codes", "rest")
    ways = joined.mapInArrow(_per_row(choose, "conv_id", "block", "codes", "rest"), f"conv_id {kind}, block long, codes string, ways array<string>")
    both = ways.withColumn("pos", F.lit(-1).cast("long")).unionByName(turns.drop("turn"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")

    def follow(items):
        now, place, state, way, codes, at, row = (), 0, START, "", "", 0, 0

        def edit(conv, letter, role, text, initial, fault):
            nonlocal place
            place += 1
            return {"conv_id": (arrow, conv), "place": (pa.int64(), place - 1), "edit": (pa.string(), letter), "role": (pa.string(), role), "text": (pa.string(), text), "initial": (pa.string(), initial), "fault": (pa.string(), fault)}

        for conv, pos, its_codes, ways, role, text in items:
            if (conv,) != now:
                now, place, state = (conv,), 0, START
            if pos < 0:
                way, codes, at, row = ways[state], its_codes, 0, 0
                continue
            while way[at] == "I":
                state, at = DUE[state], at + 1
                yield edit(conv, "I", ROLES[state], "", None, None)
            letter, code = way[at], int(codes[row], 16)
            at, row = at + 1, row + 1
            if letter == "K":
                state = KEEPS[code // 4][state]
            elif letter == "R":
                state = DUE[state]
            yield edit(conv, letter, ROLES[state] if letter == "R" else role, text, "sua?"[code // 4], FAULTS[code % 4])
            if row == len(codes):
                for _ in way[at:]:
                    state = DUE[state]
                    yield edit(conv, "I", ROLES[state], "", None, None)

    schema = f"conv_id {kind}, place long, edit string, role string, text string, initial string, fault string"
    return both.mapInArrow(_per_row(follow, "conv_id", "pos", "codes", "ways", "role", "text"), schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation that has rows: counts of faults, ``illegal`` neighbours, ``cost``, ``audit`` and ``repaired_sha256`` of its edits.

    ``repaired_sha256`` is of the lines ``role:text``. A conversation's lines pass through one digest, one at a time; only its audit, a letter an edit, is held.
    """
    edits = repair(rows)
    arrow = _arrow(edits, "conv_id")
    kind = edits.schema["conv_id"].dataType.simpleString()
    price = {"D": 3, "K": 0, "R": 2, "I": 2}

    def fold(items):
        now = ()

        def ended():
            n = {c: (pa.int64(), v) for c, v in counts.items()}
            return {"conv_id": (arrow, now[0]), **n, "audit": (pa.string(), "".join(audit)), "repaired_sha256": (pa.string(), digest.hexdigest())}

        for conv, letter, role, text, initial, fault in items:
            if (conv,) != now:
                if now:
                    yield ended()
                now, audit, digest, last, lines = (conv,), [], hashlib.sha256(), None, 0
                counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            audit.append(letter)
            counts["cost"] += price[letter] + (fault == "truncated" and letter != "D")
            if fault:
                counts[fault] += 1
            if letter != "I":
                counts["illegal"] += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
            if letter != "D":
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        if now:
            yield ended()

    schema = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return edits.mapInArrow(_per_row(fold, "conv_id", "edit", "role", "text", "initial", "fault"), schema)


def damage_report(conversations: DataFrame) -> DataFrame:
    """Every ``conv_id`` once: ``repair_report`` of its rows after ``damaged``, and ``gaps``, the turns missing between its first and last.

    Conversations without rows after the damage have zeros, an empty audit and the digest of nothing; null turns leave no gap.
    """
    rows = staged(damaged(conversations), "damaged")
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    found = repair_report(rows).withColumnRenamed("conv_id", "r_conv")
    turns = turns.withColumnRenamed("conv_id", "t_conv")
    out = conversations.select("conv_id").distinct()
    out = out.join(turns, F.col("conv_id").eqNullSafe(F.col("t_conv")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("r_conv")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
