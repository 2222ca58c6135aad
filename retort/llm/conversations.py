"""Repair of the structure of conversations by a checkpointed dynamic program.

Each turn is reduced to one character: the initial of its role (small, or large for a truncated text), ``d`` where it has to go
(blank, or a repeat of an earlier turn of the conversation). The repaired roles must read ``(s?(ua)+)?``. That takes four states:
nothing yet, after a system turn, after a user turn, after an assistant turn. Edits go through the states at their costs.

The codes of a conversation, in order, are cut into blocks that grow by ``BLOCK`` turns each, so that n turns make about the square root
of n blocks, and the longest block has about as many turns. Only at the end of each block is the vector of the costs from there to the
end of the conversation kept (one cost a state); within a block the vectors are computed again when the edits are walked forward. Of
the tight edits the ASCII-least is taken. A conversation of any length is thus worked on by many tasks: blocks give their
cost matrices side by side, a narrow job for each conversation folds these backwards to the vectors at the checkpoints, blocks give where
each entry state leads, a second one folds that forward, and blocks emit their edits. Texts take no part in it; they are
shuffled once, to meet their edits in order.

Defined cases: a null role or text reads as one space; null conversation ids are one conversation; turns come by number, nulls
first, and those of one number by role and then by the MD5 of their text; an empty role can't be kept; a conversation without turns has
no edits; repeated rows are duplicates; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import checkpointed, written
from retort.llm.shared_files import partition

#: Turns by which each block of a conversation is longer than the one before it.
BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State after a kept turn by its initial and the state before; states are nothing yet, after system, after user, after assistant.
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: State after the only user or assistant turn that may come after a state, and that turn's role.
_GIVEN, _ROLE = (2, 2, 3, 2), "uuau"
_ENDS = (0, 3)
_ROLES = {"u": "user", "a": "assistant"}


def _with_inserts(costs: list[float]) -> list[float]:
    """Costs to the end by state where turns may be inserted before what ``costs`` starts with."""
    out = list(costs)
    for s in (2, 3, 2, 0, 1):
        out[s] = min(out[s], INSERT + out[_GIVEN[s]])
    return out


#: Costs at the end of a conversation, inserts included.
FINAL = _with_inserts([0.0 if s in _ENDS else float("inf") for s in range(4)])


def _before(code: str, after: list[float]) -> list[float]:
    """Costs before a turn from those after it."""
    costs = [DELETE + after[s] for s in range(4)]
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        kept = _KEPT.get(code.lower(), {})
        for s in range(4):
            if s in kept:
                costs[s] = min(costs[s], KEEP + more + after[kept[s]])
            costs[s] = min(costs[s], REROLE + more + after[_GIVEN[s]])
    return _with_inserts(costs)


def matrix(codes: str) -> list[float]:
    """Least costs through a block from each state to each, row by row."""
    columns = []
    for t in range(4):
        costs = [0.0 if s == t else float("inf") for s in range(4)]
        for code in reversed(codes):
            costs = _before(code, costs)
        columns.append(costs)
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(codes: str, state: int, end: tuple[float, ...], last: bool) -> tuple[str, int]:
    """Edits of a block from ``state`` on, given the costs at its end, and the state after it.

    Edits are ``D`` and ``K``; ``u`` and ``a`` for a new role; ``U`` and ``A`` for an inserted turn. ``last`` adds the inserts at the end.
    """
    costs = [list(end)]
    for code in reversed(codes):
        costs.append(_before(code, costs[-1]))
    costs.reverse()
    edits = []
    for i, code in enumerate(codes):
        here, after = costs[i], costs[i + 1]
        more = TRUNCATED if code.isupper() else 0
        while True:
            given = _GIVEN[state]
            if here[state] == DELETE + after[state]:
                edits.append("D")
            elif here[state] == INSERT + here[given]:
                edits.append(_ROLE[state].upper())
                state = given
                continue
            elif code != "d" and state in (kept := _KEPT.get(code.lower(), {})) and here[state] == KEEP + more + after[kept[state]]:
                edits.append("K")
                state = kept[state]
            else:
                edits.append(_ROLE[state])
                state = given
            break
    while last and FINAL[state] > 0:
        edits.append(_ROLE[state].upper())
        state = _GIVEN[state]
    return "".join(edits), state


@lru_cache(maxsize=50_000)
def whole_edits(codes: str) -> str:
    """Edits of a conversation of one block."""
    return walk(codes, 0, tuple(FINAL), True)[0]


_ORDER = ["turn", "role", "digest", "tie"]
_BLOCKS = "conv_id {conv}, turn {turn}, role string, digest string, tie long, part int, no long, codes string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted turns of a partition, each with the place of its first turn."""
    part, held, count, no, number = partition(), [], 0, -1, 0
    key = first = None

    def out() -> dict:
        return {**first, "part": part, "no": number, "codes": "".join(held)}

    for batch in batches:
        names = ["conv_id", *_ORDER]
        schema = pa.schema([*(batch.schema.field(c) for c in names), ("part", pa.int32()), ("no", pa.int64()), ("codes", pa.string())])
        rows = []
        columns = [batch.column(c).to_pylist() for c in names]
        for *values, code in zip(*columns, batch.column("code").to_pylist(), strict=True):
            if first is None or values[0] != key or count == (no + 1) * BLOCK:
                if first is not None:
                    rows.append(out())
                    number += 1
                no = no + 1 if first is not None and values[0] == key else 0
                key, first, held, count = values[0], dict(zip(names, values, strict=True)), [], 0
            held.append(code)
            count += 1
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if first is not None:
        yield pa.RecordBatch.from_pylist([out()], schema)


def _per_row(column: str, made: str, kind: pa.DataType, do):
    """A task function that adds column ``made``, from what ``do`` gives for each value of ``column`` or row of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [do(x) for x in batch.column(column).to_pylist()] if column else [do(x) for x in batch.to_pylist()]
            yield batch.append_column(made, pa.array(values, kind))

    return run


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {more}"


def _ends(blocks: pa.Table) -> pa.Table:
    """Costs at the end of each block of a conversation, from the blocks' matrices."""
    rows = sorted(blocks.to_pylist(), key=lambda r: (r["part"], r["no"]))
    costs, out = list(FINAL), []
    for i, r in enumerate(reversed(rows)):
        out.append({"part": r["part"], "no": r["no"], "end": costs, "last": i == 0})
        m = r["matrix"]
        costs = [min(m[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("no", pa.int64()), ("end", pa.list_(pa.float64())), ("last", pa.bool_())]))


def _entries(blocks: pa.Table) -> pa.Table:
    """The state in which the walk enters each block, from where the blocks lead."""
    state, out = 0, []
    for r in sorted(blocks.to_pylist(), key=lambda r: (r["part"], r["no"])):
        out.append({"part": r["part"], "no": r["no"], "entry": state})
        state = r["leads"][state]
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("no", pa.int64()), ("entry", pa.int32())]))


def block_edits(blocks: DataFrame) -> DataFrame:
    """``blocks`` with a column ``edits``: those of one block at once, those of longer conversations by way of their checkpoints."""
    counted = blocks.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_long"))
    long = checkpointed(blocks.join(counted, F.col("conv_id").eqNullSafe(F.col("_long")), "left_semi"))
    short = blocks.join(counted, F.col("conv_id").eqNullSafe(F.col("_long")), "left_anti")
    short = short.mapInArrow(_per_row("codes", "edits", pa.string(), whole_edits), _schema(short, "edits string"))
    matrices = long.select("conv_id", "part", "no", "codes").mapInArrow(
        _per_row("codes", "matrix", pa.list_(pa.float64()), matrix), _schema(long.select("conv_id", "part", "no", "codes"), "matrix array<double>")
    )
    ends = matrices.select("conv_id", "part", "no", "matrix").groupBy("conv_id").applyInArrow(_ends, "part int, no long, end array<double>, last boolean")
    ended = checkpointed(long.join(ends, ["part", "no"]))
    leads = lambda r: [walk(r["codes"], s, tuple(r["end"]), r["last"])[1] for s in range(4)]
    led = ended.mapInArrow(_per_row("", "leads", pa.list_(pa.int32()), leads), _schema(ended, "leads array<int>"))
    entries = led.select("conv_id", "part", "no", "leads").groupBy("conv_id").applyInArrow(_entries, "part int, no long, entry int")
    entered = ended.join(entries, ["part", "no"])
    edits = lambda r: walk(r["codes"], r["entry"], tuple(r["end"]), r["last"])[0]
    walked = entered.mapInArrow(_per_row("", "edits", pa.string(), edits), _schema(entered, "edits string"))
    return short.unionByName(walked.select(*short.columns))


def with_faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of ``turns`` with ``digest``, ``tie``, ``dropped`` (if a column of ``turns``), ``fault`` and ``code``; written once.

    ``fault`` is the first of ``blank``, ``duplicate`` and ``truncated`` that holds, else null.
    """
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    given = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), dropped.alias("dropped"))
    rows = written(given.withColumns({"digest": F.md5("text"), "tie": F.monotonically_increasing_id()}), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "tie")
    # the first of each role and text that comes more than once; counts are added up before the shuffle
    firsts = rows.filter("not dropped").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "digest")]
    joined = rows.alias("r").join(firsts.alias("f"), same, "left").select("r.*", "_first")
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(end == "", "blank").when(F.coalesce(place > F.col("_first"), F.lit(False)), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    return joined.withColumn("fault", fault).withColumn("code", code).drop("_first")


def repaired(turns: DataFrame) -> DataFrame:
    """The edits of all conversations, in order within each partition, a conversation's in one: ``conv_id, turn, role, text, fault, was, edit,
    new_role``, a row an edit (and one without for each dropped turn). ``was`` is the role before; inserted turns have an empty text and no ``was``."""
    rows = written(with_faults(turns), "faults")
    narrow = rows.filter("not dropped").select("conv_id", *_ORDER, "code")
    ordered = checkpointed(narrow.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER))
    kinds = dict(ordered.dtypes)
    blocks = checkpointed(ordered.mapInArrow(_blocks, _BLOCKS.format(conv=kinds["conv_id"], turn=kinds["turn"])))
    edits = block_edits(blocks).select("conv_id", *_ORDER, F.col("edits"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"), F.lit(False).alias("dropped"), F.lit(0).alias("kind"))
    texts = rows.select("conv_id", *_ORDER, F.lit(None).cast("string").alias("edits"), "text", "fault", "dropped", F.lit(1).alias("kind"))
    met = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("dropped").desc(), *[F.col(c) for c in _ORDER], "kind")
    return met.mapInArrow(_met, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, text string, fault string, was string, edit string, new_role string")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns with their edits: the edits of a block come just before its first turn, and all of them are used up by its last."""
    todo, at, last = "", 0, 0
    for batch in batches:
        conv, turn = batch.schema.field("conv_id"), batch.schema.field("turn")
        schema = pa.schema([conv, turn, *[(c, pa.string()) for c in ("text", "fault", "was", "edit", "new_role")]])
        out = []
        for r in batch.to_pylist():
            base = {"conv_id": r["conv_id"]}
            if r["dropped"]:
                out.append(base)
            elif r["kind"] == 0:
                todo, at, last = r["edits"], 0, len(r["edits"].rstrip("UA"))
            else:
                before = at
                while todo[at] in "UA":
                    at += 1
                out += [{**base, "edit": "I", "text": "", "new_role": _ROLES[e.lower()]} for e in todo[before:at]]
                e = todo[at]
                new = {"D": None, "K": r["role"]}.get(e) if e in "DK" else _ROLES[e]
                out.append({**base, "turn": r["turn"], "text": r["text"], "fault": r["fault"], "was": r["role"], "edit": "R" if e in "ua" else e, "new_role": new})
                at += 1
                if at == last:  # what is left comes after the block's last turn
                    out += [{**base, "edit": "I", "text": "", "new_role": _ROLES[e.lower()]} for e in todo[at:]]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def digests(edits: DataFrame) -> DataFrame:
    """A row a conversation from what ``repaired`` gives: counts, costs, the edits and the SHA-256 of the repaired turns, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done() -> dict:
            known = now["turns"]
            gaps = now["high"] - now["low"] + 1 - known if known else 0
            return {"conv_id": now["conv_id"], "gaps": gaps, **{c: now[c] for c in _COUNTS[1:]}, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    out += [done()] if now is not None else []
                    now = {"conv_id": r["conv_id"], "turns": 0, "low": None, "high": None, "was": None, "audit": [], "sha": hashlib.sha256(), "lines": 0, **dict.fromkeys(_COUNTS, 0)}
                if r["edit"] is None:
                    continue
                now["audit"].append(r["edit"])
                now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[r["edit"]] + (TRUNCATED if r["fault"] == "truncated" and r["edit"] != "D" else 0)
                if r["new_role"] is not None:
                    now["sha"].update((("\n" if now["lines"] else "") + r["new_role"] + ":" + r["text"]).encode())
                    now["lines"] += 1
                if r["edit"] == "I":
                    continue
                if r["fault"]:
                    now[r["fault"]] += 1
                if now["was"] is not None and now["was"][:1] + r["was"][:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["was"] = r["was"]
                if r["turn"] is not None:
                    if now["low"] is None:
                        now["low"] = r["turn"]
                    if now["high"] != r["turn"]:
                        now["turns"] += 1
                    now["high"] = r["turn"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    kind = dict(edits.dtypes)["conv_id"]
    return edits.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by the checksum of conversation and turn; dropped ones stay as marks."""
    blank: Column = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")], (F.crc32(name.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    each = rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return each.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("dropped"))
