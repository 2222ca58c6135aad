"""Sequences and batches: SMILES tokens, route tokens, padding, batch forming."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.functions.numbering import numbered

#: Token types. Fixed values.
END, START, REACTION, REACTANT = 0, 1, 2, 3

#: Characters a token of the head that is searched first.
HEAD_CHARS = 3


def token_pattern(tokens: Sequence[str]) -> str:
    """Alternation of the tokens, longer ones before their beginnings."""
    return "(" + "|".join(re.sub(r"([^\w])", r"\\\1", t) for t in sorted(tokens, reverse=True)) + ")"


def tokenize_smiles(smiles: Column, tokens: Sequence[str], most: int | None = None) -> Column:
    """Token ids from 1 of a SMILES; characters outside the vocabulary are passed over; cut to ``most`` if given.

    With a cut, the head of the text comes first; the whole text is searched where the head does not hold enough tokens (and some more, so
    that the head's end cuts none of those that count).
    """
    pattern, names = F.lit(token_pattern(tokens)), F.array(*[F.lit(t) for t in tokens])
    every = lambda text: F.regexp_extract_all(text, pattern, F.lit(1))
    ids = lambda found: F.transform(found, lambda t: F.array_position(names, t).cast("int"))
    if most is None:
        return ids(every(smiles))
    enough = most + max(map(len, tokens), default=0)
    found = F.transform(F.array(every(F.substring(smiles, 1, HEAD_CHARS * most))), lambda head: F.slice(F.when(F.size(head) > enough, head).otherwise(every(smiles)), 1, most))
    return ids(F.get(found, F.lit(0)))


def route_arrays(steps: DataFrame) -> DataFrame:
    """``route_id, steps`` with the steps ``(pos, n_reactants, ref_idx, smiles)`` of each route in order."""
    return steps.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n_reactants", "ref_idx", "smiles"))).alias("steps"))


def _of(steps: str | Column, molecule, reaction) -> Column:
    return F.transform(steps, lambda s: F.when(s["n_reactants"] > 0, reaction(s)).otherwise(molecule(s)))


def molecule_indices(steps: str = "steps") -> Column:
    """Index of each step's building block, null for reactions."""
    return _of(steps, lambda s: s["ref_idx"], lambda s: F.lit(None))


def reaction_indices(steps: str = "steps") -> Column:
    """Index of each step's reaction, null for building blocks."""
    return _of(steps, lambda s: F.lit(None), lambda s: s["ref_idx"])


def action_string(steps: str = "steps", delim: str = ";") -> Column:
    """SMILES of building blocks and ``R<index>`` of reactions, joined."""
    return F.array_join(_of(steps, lambda s: s["smiles"], lambda s: F.concat(F.lit("R"), s["ref_idx"])), delim)


def state_repr(stack: str = "stack") -> Column:
    """Each level of a stack sorted and joined by commas, levels by semicolons."""
    return F.array_join(F.transform(stack, lambda level: F.array_join(F.sort_array(level), ",")), ";")


def count_reactions(steps: str = "steps") -> Column:
    return F.size(F.filter(steps, lambda s: s["n_reactants"] > 0))


def route_sequences(routes: DataFrame, end_token: bool = True) -> DataFrame:
    """Token types (START first), reaction indices, reactant indices and padding mask of each route; 0 and null where a token has none."""
    types = F.concat(F.array(F.lit(START)), _of("steps", lambda s: F.lit(REACTANT), lambda s: F.lit(REACTION)), F.array(*([F.lit(END)] if end_token else [])).cast("array<int>"))
    edge = lambda x, c: F.concat(F.array(F.lit(x).cast(c)), F.col("_v"), F.array(*([F.lit(x).cast(c)] if end_token else [])).cast(f"array<{c}>"))
    out = routes.withColumn("token_types", types)
    out = out.withColumn("_v", F.transform(reaction_indices(), lambda x: F.coalesce(x.cast("int"), F.lit(0)))).withColumn("rxn_indices", edge(0, "int"))
    out = out.withColumn("_v", F.transform(molecule_indices(), lambda x: x.cast("int"))).withColumn("reactant_indices", edge(None, "int"))
    return out.withColumn("padding_mask", F.transform("token_types", lambda x: F.lit(False))).drop("_v")


def reactant_fingerprints(sequences: DataFrame, fps: DataFrame, dim: int) -> DataFrame:
    """``route_id, reactant_fps``: the fingerprint of each reactant token from ``fps (idx, fp)``, zeros for other tokens."""
    each = sequences.select("route_id", F.posexplode("reactant_indices").alias("pos", "idx"))
    found = each.join(fps.select("idx", "fp"), "idx", "left").withColumn("fp", F.coalesce("fp", F.array_repeat(F.lit(0.0), dim)))
    return found.groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "fp"))), lambda x: x["fp"]).alias("reactant_fps"))


def padded(values: Column, width: int, fill: Column) -> Column:
    """An array cut or padded to ``width``."""
    return F.concat(F.slice(values, 1, width), F.array_repeat(fill, F.greatest(F.lit(width) - F.size(values), F.lit(0)).cast("int")))


def padded_matrix(rows: Column, height: int, width: int, fill: Column) -> Column:
    """A matrix cut or padded on both sides."""
    return padded(F.transform(rows, lambda r: padded(r, width, fill)), height, F.array_repeat(fill, width))


def batches(df: DataFrame, n: int, order: str, drop_last: bool = False) -> DataFrame:
    """``batch_id, rows``: consecutive rows in batches of ``n``, the rows as structs, null ``order`` first; numbers come from ranges of ``order``, each sorted by itself."""
    placed = numbered(df, [], [order], "_number").withColumn("batch_id", F.floor(F.col("_number") / n))
    rows = F.sort_array(F.collect_list(F.struct(order, F.col("_number"), *[c for c in df.columns if c != order])))
    out = placed.groupBy("batch_id").agg(F.transform(rows, lambda r: r.dropFields("_number")).alias("rows"))
    return out.filter(F.size("rows") == n) if drop_last else out


def padded_graphs(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Molecule graphs padded to the largest of their batch: ``atoms``, ``positions``, ``mask`` and the square ``square_mask`` by atoms, ``edges`` and, if there, ``edge_features`` by edges."""
    largest = df.groupBy(batch).agg(F.max(F.size("atoms")).alias("_a"), F.max(F.coalesce(F.size("edges"), F.lit(0))).alias("_e"))
    sized = df.join(largest, batch)
    pad = lambda c, n, fill: F.concat(c, F.array_repeat(fill, (F.col(n) - F.size(c)).cast("int")))
    zeros = lambda c: F.transform(F.get(F.col(c), F.lit(0)), lambda x: F.lit(0.0))
    row = pad(F.col("mask"), "_a", F.lit(False))
    square = F.transform(row, lambda m: F.transform(row, lambda other: m & other))
    edges = F.coalesce("edges", F.array().cast(df.schema["edges"].dataType))
    out = {"atoms": pad(F.col("atoms"), "_a", zeros("atoms")), "positions": pad(F.col("positions"), "_a", F.array(*[F.lit(0.0)] * 3)), "mask": row, "square_mask": square, "edges": pad(edges, "_e", F.array(F.lit(0), F.lit(0)))}
    if "edge_features" in df.columns:
        given = F.coalesce("edge_features", F.array().cast(df.schema["edge_features"].dataType))
        width = F.coalesce(F.size(F.get(given, F.lit(0))), F.lit(0))
        most = F.max(width).over(Window.partitionBy(batch))
        sized = sized.withColumn("_w", most)
        out["edge_features"] = pad(given, "_e", F.array_repeat(F.lit(0.0), F.col("_w")))
    return sized.withColumns(out).drop("_a", "_e", "_w")


def training_samples(routes: DataFrame, fps: DataFrame, dim: int, tokens: Sequence[str], most_tokens: int = 192, seed: int = 0) -> DataFrame:
    """The training table: a row for each emitted route ``route_id, steps, stack`` with a drawn ``product`` of its top level, its SMILES token ids, the route's token
    types, reaction and reactant indices and mask, and the fingerprint of each reactant token from ``fps (idx, fp)``."""
    order = F.transform(F.element_at("stack", -1), lambda p: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("route_id"), p)).alias("key"), p.alias("p")))
    chosen = routes.withColumn("product", F.array_min(order)["p"]).drop("stack")
    told = route_sequences(chosen.withColumn("smiles_tokens", tokenize_smiles(F.col("product"), tokens, most_tokens)))
    return told.join(reactant_fingerprints(told, fps, dim), "route_id").drop("steps")


def time_shift(values: Column) -> tuple[Column, Column]:
    """All but the last and all but the first."""
    less = F.greatest(F.size(values) - 1, F.lit(0))
    return F.slice(values, 1, less), F.slice(values, 2, less)
