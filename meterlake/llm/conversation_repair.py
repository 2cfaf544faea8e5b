"""Faults of conversations and the cheapest edits that mend them, for conversations of any length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import turn_edits
from .scratch import Scratch

BLANKS = " \t\n\x0b\f\r"
#: Turns of one conversation whose place in the order has the same leading bits make a block: 65,536 at most.
BLOCK_BITS = 16


def placed_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns (conv_id, turn, role, text; nulls of the last two: one space) with ``at``, their place in the order of all.

    Rows of a conversation go by turn, nulls first; equal ones by role and text. Rows are dealt out in
    ranges of these, so a long conversation is spread over tasks; roles and texts take part by their
    first characters, which order them as the whole ones do once they are sorted by both.
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ranges = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(16)).asc(), F.left("text", F.lit(32)).asc()]
    ordered = own.repartitionByRange(*ranges).sortWithinPartitions(*ranges, "role", "text")
    return scratch.table(ordered.withColumn("at", F.monotonically_increasing_id()))


def turn_kinds(placed: DataFrame) -> DataFrame:
    """conv_id, at, fault (blank, duplicate, truncated or null; the first that holds) and kind of each turn.

    A duplicate has the role and text of an earlier turn: it isn't the least place of its (conversation,
    role, digest of the text), which a partial aggregate finds; places are unique, so no text is a hot key.
    """
    stripped = F.btrim("text", F.lit(BLANKS))
    digest = F.unhex(F.sha2("text", 256))
    firsts = placed.groupBy("conv_id", "role", digest.alias("_digest")).agg(F.min("at").alias("_first")).select("_first")
    told = placed.select("conv_id", "at", F.left("role", F.lit(1)).alias("_i"), (stripped == "").alias("_blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    met = told.join(firsts, F.col("at") == F.col("_first"), "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated")
    initial = F.when(F.col("_i").isin("s", "u", "a"), F.col("_i")).otherwise("x")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), F.translate("initial", "suax", "1234")).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return met.select("conv_id", "at", fault.alias("fault"), initial.alias("initial")).select("conv_id", "at", "fault", kind.alias("kind"))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equal in all columns, nulls being equal."""
    found = F.lit(True)
    for n in names:
        found = found & a[n].eqNullSafe(b[n])
    return found


@dataclass
class Repairs:
    """Tables of a repair: ``placed`` turns; ``kinds``, their faults and kinds by ``at``; ``plans``, the edits of
    each block (conv_id, block, entry: the state before it, letters); ``costs`` (conv_id, cost, illegal)."""

    placed: DataFrame
    kinds: DataFrame
    plans: DataFrame
    costs: DataFrame


def plan_repairs(turns: DataFrame, scratch: Scratch | None = None) -> Repairs:
    """The cheapest edits of each conversation of ``turns`` (conv_id, turn, role, text).

    Edits: keep (K, 0), rerole to user or assistant (R, 2), delete (D, 3, the only one for a blank turn or a
    duplicate), insert an empty turn of user or assistant (I, 2); a truncated turn that stays costs 1 more.
    Of the cheapest edits whose roles read ``(s?(ua)+)?`` by their initials the ASCII-least letters are taken.

    A conversation is cut into blocks of at most 65,536 turns, each a matrix of least costs between
    states. Matrices are folded forward and backward; with the costs before and after it each block finds its
    tight arcs and letters for every state it may be entered in, and a last fold picks the states. Only
    matrices of 16 numbers meet in one task, one for each block.
    A null id is a conversation of its own; repeated rows are duplicates; no turns, no rows.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    placed = placed_turns(turns, scratch)
    kinds = scratch.table(turn_kinds(placed))

    @F.arrow_udf("struct<m:array<array<bigint>>,illegal:bigint>")
    def measured(kinds: pa.Array) -> pa.Array:
        told = [{"m": turn_edits.through(k), "illegal": turn_edits.illegal_pairs(k)} for k in kinds.to_pylist()]
        return pa.array(told, pa.struct([("m", pa.list_(pa.list_(pa.int64()))), ("illegal", pa.int64())]))

    block = F.shiftright("at", BLOCK_BITS).alias("block")
    listed = kinds.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("_turns"))
    joined = listed.select("conv_id", "block", F.array_join(F.col("_turns.kind"), "").alias("kinds"))
    blocks = scratch.table(joined.withColumn("_told", measured("kinds")))

    place = "struct<block:bigint,before:array<bigint>,after:array<bigint>,last:boolean>"

    @F.arrow_udf(f"struct<cost:bigint,illegal:bigint,blocks:array<{place}>>")
    def folded(conversations: pa.Array) -> pa.Array:
        told = []
        for own in conversations.to_pylist():
            cost, befores, afters = turn_edits.chained([b["m"] for b in own])
            between = sum(turn_edits.illegal_pairs(x["tail"] + y["head"]) for x, y in zip(own, own[1:]))
            at = [{"block": b["block"], "before": f, "after": a, "last": b is own[-1]} for b, f, a in zip(own, befores, afters)]
            told.append({"cost": cost, "illegal": between + sum(b["illegal"] for b in own), "blocks": at})
        longs = pa.list_(pa.int64())
        of_block = pa.struct([("block", pa.int64()), ("before", longs), ("after", longs), ("last", pa.bool_())])
        return pa.array(told, pa.struct([("cost", pa.int64()), ("illegal", pa.int64()), ("blocks", pa.list_(of_block))]))

    of_block = F.struct("block", F.col("_told.m").alias("m"), F.col("_told.illegal").alias("illegal"), F.left("kinds", F.lit(1)).alias("head"), F.right("kinds", F.lit(1)).alias("tail"))
    chains = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(of_block)).alias("_own")).withColumn("_fold", folded("_own"))
    chains = scratch.table(chains.select("conv_id", F.col("_fold.cost").alias("cost"), F.col("_fold.illegal").alias("illegal"), F.col("_fold.blocks").alias("blocks")))

    @F.arrow_udf("array<struct<entry:int,exit:int,letters:string>>")
    def solved(kinds: pa.Array, before: pa.Array, after: pa.Array, cost: pa.Array, last: pa.Array) -> pa.Array:
        rows = zip(kinds.to_pylist(), before.to_pylist(), after.to_pylist(), cost.to_pylist(), last.to_pylist(), strict=True)
        told = [[dict(zip(("entry", "exit", "letters"), e, strict=True)) for e in turn_edits.edits(*r)] for r in rows]
        return pa.array(told, pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("letters", pa.string())])))

    wanted = chains.select("conv_id", "cost", F.explode("blocks").alias("_b")).select("conv_id", "cost", "_b.*")
    met = wanted.join(blocks, _same(wanted, blocks, "conv_id", "block")).drop(blocks["conv_id"], blocks["block"])
    ways = scratch.table(met.select("conv_id", "block", solved("kinds", "before", "after", "cost", "last").alias("ways")))

    @F.arrow_udf("array<struct<block:bigint,entry:int>>")
    def entered(conversations: pa.Array) -> pa.Array:
        told = []
        for own in conversations.to_pylist():
            state, path = turn_edits.START, []
            for b in own:
                path.append({"block": b["block"], "entry": state})
                state = next(w["exit"] for w in b["ways"] if w["entry"] == state)
            told.append(path)
        return pa.array(told, pa.list_(pa.struct([("block", pa.int64()), ("entry", pa.int32())])))

    steps = F.transform("ways", lambda w: F.struct(w["entry"].alias("entry"), w["exit"].alias("exit")))
    paths = ways.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", steps.alias("ways")))).alias("_own"))
    paths = scratch.table(paths.select("conv_id", F.explode(entered("_own")).alias("_b")).select("conv_id", "_b.*"))
    taken = paths.join(ways, _same(paths, ways, "conv_id", "block")).drop(ways["conv_id"], ways["block"])
    letters = F.get(F.filter("ways", lambda w: w["entry"] == F.col("entry")), F.lit(0))["letters"]
    plans = scratch.table(taken.select("conv_id", "block", "entry", letters.alias("letters")))
    return Repairs(placed, kinds, plans, chains.select("conv_id", "cost", "illegal"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, int, str, str, str]]:
    """conv_id, block, number in it, letter, role and text of each edit; for each block its plan comes first, then its turns."""
    state, letters, n, end = 0, "", 0, 0
    for batch in batches:
        for conv, block, plan, entry, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "letters", "entry", "role", "text")), strict=True):
            if plan is not None:
                state, letters, n, end = entry, plan, 0, len(plan.rstrip("I"))
                continue
            while n < len(letters):  # what is inserted before the turn, the turn, and what follows the last turn
                letter = letters[n]
                state = turn_edits.step(state, letter, role[:1])
                chosen = turn_edits.ROLES[state] if letter in "IR" else role
                yield conv, block, n, letter, chosen, "" if letter == "I" else text
                n += 1
                if letter != "I" and n < end:
                    break


def _plans_and_turns(repairs: Repairs) -> DataFrame:
    """Plans (at -1) and turns of all blocks, for ``_edited``."""
    plans = repairs.plans.select("conv_id", "block", F.lit(-1).cast("long").alias("at"), "letters", "entry", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    turns = repairs.placed.select("conv_id", block, "at", F.lit(None).cast("string").alias("letters"), F.lit(None).cast("int").alias("entry"), "role", "text")
    return plans.unionByName(turns)


def repaired_turns(repairs: Repairs) -> DataFrame:
    """conv_id, block, number, edit, role and text of each edit, deleted turns (D) with what they were; the order
    of a conversation is that of (block, number). Blocks are dealt out one by one."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(_edited(batches), schema)

    kind = repairs.placed.schema["conv_id"].dataType.simpleString()
    rows = _plans_and_turns(repairs).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    spec = f"conv_id {kind}, block long, number long, edit string, role string, text string"
    schema = ["conv_id", "block", "number", "edit", "role", "text"]
    return rows.mapInArrow(told, spec)


def _in_batches(rows: Iterator[tuple], names: list[str], most: int = 1000, most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1] or "")
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held])
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held])


def repaired_digests(repairs: Repairs) -> DataFrame:
    """conv_id and repaired_sha256 of the mended ``role:text``, joined by newlines.

    A digest takes its text in order, so the turns of a conversation pass one task, as a stream: it holds a batch
    and the digest's state at a time, however long the conversation is."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple[object, str]]:
            current, digest, begun = (), None, False
            for conv, _, _, letter, role, text in _edited(batches):
                if current != (conv,):
                    if digest:
                        yield *current, digest.hexdigest()
                    current, digest, begun = (conv,), hashlib.sha256(), False
                if letter != "D":
                    digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
                    begun = True
            if digest:
                yield *current, digest.hexdigest()

        yield from _in_batches(digests(), ["conv_id", "repaired_sha256"])

    kind = repairs.placed.schema["conv_id"].dataType.simpleString()
    rows = _plans_and_turns(repairs).repartition("conv_id").sortWithinPartitions("conv_id", "block", "at")
    return rows.mapInArrow(told, f"conv_id {kind}, repaired_sha256 string")


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Conversations with faults dealt by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the turn, 1 empties its text,
    2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Null roles and texts are one
    space, null ids and turns too where they are hashed."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 3, F.array(F.lit(0), F.lit(1))).when(fault != 0, F.array(F.lit(0))).alias("_copies"),
    )
    return hurt.select("conv_id", "turn", "role", "text", F.explode("_copies")).drop("col")


def audited_repairs(conversations: DataFrame, turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each id in ``conversations``: gaps, faults, illegal, cost, audit and repaired_sha256 of its ``turns``.

    gaps counts the turn numbers missing between least and largest. Ids without turns have zeros, an empty
    audit and the digest of nothing. A null id is an id; extra columns of both tables aren't read; empty tables give no rows.
    """
    repairs = plan_repairs(turns, scratch)
    faults = repairs.kinds.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    spans = repairs.placed.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "letters")))
    audits = repairs.plans.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda b: b["letters"]), "").alias("audit"))
    found = conversations.select("conv_id").distinct()
    for part in (spans, faults, repairs.costs, audits, repaired_digests(repairs)):
        found = found.join(part, _same(found, part, "conv_id"), "left").drop(part["conv_id"])
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
