"""Readers and writers of molecule files. Rows of files have no order in Spark, so readers keep a sequence where order matters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.sources import ranges


def read_csv_molecules(spark: SparkSession, path: str, smiles_col: str | None = None) -> DataFrame:
    """Molecules from CSV: the given column, else ``smiles``, else ``SMILES``; other columns stay."""
    df = spark.read.csv(path, header=True)
    name = next((c for c in ([smiles_col] if smiles_col else ["smiles", "SMILES"]) if c in df.columns), None)
    if name is None:
        raise ValueError(f"no SMILES column in {df.columns}")
    out = df if name == "smiles" else df.withColumnRenamed(name, "smiles")
    return out.withColumn("mol_id", F.monotonically_increasing_id())


#: Place of a row in its file: by start of the file's split, then by number within. The rows of a file sort by it in file order.
_PLACE = "row_place"


def _placed(lines: DataFrame) -> DataFrame:
    """Text rows with ``mol_id``, unique over all files, ``file`` and their place in it; files are split as Spark likes."""
    number = F.monotonically_increasing_id()
    return lines.select("value", number.alias("mol_id"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), number.alias("n")).alias(_PLACE))


def read_smi_molecules(spark: SparkSession, path: str, title_line: bool = True) -> DataFrame:
    """Molecules from ``.smi`` files: ``mol_id, file, seq, smiles, name``, SMILES and name by white space; ``seq`` sorts the rows of a file in its order.

    The first line of each file is a title unless told otherwise. Files are split by lines.
    """
    lines = _placed(spark.read.text(path))
    if title_line:
        first = lines.filter(F.col(f"{_PLACE}.start") == 0).groupBy("file").agg(F.min(_PLACE).alias("title"))
        lines = lines.join(first, "file", "left").filter(~F.col(_PLACE).eqNullSafe(F.col("title")))
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    kept = lines.filter(F.col("value").rlike(r"\S"))
    return kept.select("mol_id", "file", F.col(_PLACE).alias("seq"), F.get(parts, F.lit(0)).alias("smiles"), F.get(parts, F.lit(1)).alias("name"))


def read_molecules(spark: SparkSession, path: str, smiles_col: str | None = None, title_line: bool = True) -> DataFrame:
    """Molecules from a CSV, SMI or SDF path, by its ending."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return read_csv_molecules(spark, path, smiles_col)
    if ending == "smi":
        return read_smi_molecules(spark, path, title_line)
    if ending == "sdf":
        return read_sdf(spark, path)[0]
    raise ValueError(f"unknown molecule file {path}")


_SDF = "mol_id long, file string, seq struct<start:long,n:long>, name string, elements array<string>, x array<double>, y array<double>, z array<double>, charges array<int>, a array<int>, b array<int>, orders array<int>, properties map<string,string>"
#: Charge codes of the atom lines. Fixed values.
_CHARGES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}


def _parsed_record(record: str) -> tuple | None:
    """Name, atoms, bonds and properties of a record, None if it cannot be read. Records but the first of a file begin with the end of the line before them."""
    lines = record.splitlines()
    for at in (4, 3) if not lines[0].strip() else (3,):  # the counts line; the name line, three before it, may be blank
        found = _parsed_lines(lines, at)
        if found:
            return found
    return None


def _parsed_lines(lines: list[str], at: int) -> tuple | None:
    """A record whose counts are in line ``at``."""
    try:
        n, m = int(lines[at][0:3]), int(lines[at][3:6])
        atoms, rest = lines[at + 1 : at + 1 + n], lines[at + 1 + n + m :]
        if len(atoms) < n:
            return None
        xyz = [[float(line[i : i + 10]) for line in atoms] for i in (0, 10, 20)]
        elements = [line[31:34].strip() for line in atoms]
        charges = [_CHARGES.get(int(line[36:39] or 0), 0) if len(line) >= 39 else 0 for line in atoms]
        bonds = [(int(line[0:3]) - 1, int(line[3:6]) - 1, int(line[6:9])) for line in lines[at + 1 + n : at + 1 + n + m]]
    except (ValueError, IndexError):
        return None
    properties = {}
    for i, line in enumerate(rest):
        if line.startswith(">") and "<" in line:
            properties[line[line.index("<") + 1 : line.rindex(">")]] = rest[i + 1].strip() if i + 1 < len(rest) else ""
    return (lines[at - 3].strip(), elements, *xyz, charges, *([b[k] for b in bonds] for k in range(3)), properties)


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        read = [_parsed_record(v) if v.strip() else None for v in rows["value"]]
        kept = [x is not None for x in read]
        names = ["name", "elements", "x", "y", "z", "charges", "a", "b", "orders", "properties"]
        out = pd.DataFrame([x for x in read if x is not None], columns=names)
        for c, of in (("mol_id", "mol_id"), ("file", "file"), ("seq", _PLACE)):
            out[c] = rows.loc[kept, of].to_list()
        yield out[["mol_id", "file", "seq", *names]]


_RECORDS = "mol_id long, file string, start long, reason string, record string, name string, elements array<string>, x array<double>, y array<double>, z array<double>, charges array<int>, a array<int>, b array<int>, orders array<int>, properties map<string,string>"


def _read_or_rejected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["name", "elements", "x", "y", "z", "charges", "a", "b", "orders", "properties"]
    for rows in batches:
        read = [_parsed_record(v) if v.strip() else None for v in rows["record"]]
        out = pd.DataFrame([x or (None,) * len(names) for x in read], columns=names)
        out["reason"] = [None if x else _why(v) for x, v in zip(read, rows["record"], strict=True)]
        out["record"] = [None if x else v for x, v in zip(read, rows["record"], strict=True)]
        for c in ("mol_id", "file", "start"):
            out[c] = rows[c].to_list()
        yield out[["mol_id", "file", "start", "reason", "record", *names]]


def _why(record: str) -> str:
    """Why a record cannot be read."""
    lines = record.splitlines()
    if len(lines) < 4:
        return "no counts line"
    if not lines[3][0:3].strip().isdigit() or not lines[3][3:6].strip().isdigit():
        return "unreadable counts line"
    return "unreadable or missing atom or bond lines"


def read_sdf_ranges(spark: SparkSession, path: str, range_bytes: int = ranges.RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Molecules (``mol_id, file, start, name, properties``), atoms, bonds, and rejects (``file, start, reason, record``) of SDF files, read by byte ranges.

    ``start`` is the place of a record in its file. Only a whole line ``$$$$`` ends a record.
    """
    given = ranges.read_records(spark, path, "sdf", range_bytes).withColumn("mol_id", F.monotonically_increasing_id())
    every = given.mapInPandas(_read_or_rejected, _RECORDS)
    records = every.filter("reason is null")
    atoms, bonds = _atoms_and_bonds(records)
    return records.select("mol_id", "file", "start", "name", "properties"), atoms, bonds, every.filter("reason is not null").select("file", "start", "reason", "record")


def _atoms_and_bonds(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    zipped = F.arrays_zip("elements", "x", "y", "z", "charges")
    atoms = records.select("mol_id", F.posexplode(zipped).alias("atom_idx", "t")).select("mol_id", "atom_idx", F.col("t.elements").alias("element"), "t.x", "t.y", "t.z", F.col("t.charges").alias("charge"))
    bonds = records.select("mol_id", F.explode(F.arrays_zip("a", "b", "orders")).alias("t")).select("mol_id", "t.a", "t.b", F.col("t.orders").alias("order"))
    return atoms, bonds


def read_sdf(spark: SparkSession, path: str, without_hydrogens: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Molecules (``mol_id, file, seq, name, properties``), atoms and bonds of V2000 records, which end in ``$$$$``; unreadable ones are left out.

    ``mol_id`` is a record's own, also of equal records, and ``seq`` sorts the records of a file in its order. Lines may end in CRLF.
    """
    records = _placed(spark.read.text(path, lineSep="$$$$")).mapInPandas(_records, _SDF)
    atoms, bonds = _atoms_and_bonds(records)
    if without_hydrogens:
        heavy = atoms.filter("element != 'H'")
        ends = heavy.select("mol_id", F.col("atom_idx").alias("i"))
        bonds = bonds.join(ends.withColumnRenamed("i", "a"), ["mol_id", "a"], "left_semi").join(ends.withColumnRenamed("i", "b"), ["mol_id", "b"], "left_semi")
        atoms = heavy
    return records.select("mol_id", "file", "seq", "name", "properties"), atoms, bonds


def read_reactions(spark: SparkSession, path: str) -> DataFrame:
    """Reaction templates, a line each, numbered by line order without blank lines: parts around ``>``, split at dots."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "").alias("l"))
    rows = lines.select(F.posexplode("l").alias("rxn_id", "smarts")).withColumn("p", F.split("smarts", ">"))
    part = lambda i: F.filter(F.split(F.get("p", F.lit(i)), r"\."), lambda x: x != "")
    out = rows.select("rxn_id", "smarts", part(0).alias("reactants"), part(1).alias("agents"), part(2).alias("products"))
    return out.withColumns({f"n_{c}": F.size(c) for c in ("reactants", "agents", "products")})


def write_smi(df: DataFrame, path: str, smiles: str = "smiles") -> None:
    """One SMILES a line."""
    df.select(F.col(smiles).alias("value")).filter("value is not null").write.text(path)


def write_results(df: DataFrame, path: str, decimals: int = 3, mode: str = "errorifexists") -> None:
    """CSV with a header and fixed decimals; missing values stay empty."""
    fixed = [F.when(F.col(n).isNotNull(), F.format_string(f"%.{decimals}f", F.col(n).cast("double"))).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    df.select(*fixed).write.mode(mode).csv(path, header=True)


def read_receptors(spark: SparkSession, path: str, size: float = 20.0, exhaustiveness: int = 16) -> DataFrame:
    """Docking boxes from receptor descriptions: ``receptor, pdbcode, target_name, center, size, exhaustiveness``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for rows in batches:
            read = [yaml.safe_load(v) for v in rows["value"]]
            yield pd.DataFrame({
                "receptor": [f.rstrip("/").split("/")[-2] for f in rows["file"]],
                "pdbcode": [d.get("pdbcode") for d in read],
                "target_name": [d.get("target_name") for d in read],
                "center": [[float(x) for x in d["center_of_mass"]] for d in read],
            })

    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    out = files.mapInPandas(parse, "receptor string, pdbcode string, target_name string, center array<double>")
    return out.withColumns({"size": F.array(*[F.lit(size)] * 3), "exhaustiveness": F.lit(exhaustiveness)})


def read_docked_poses(spark: SparkSession, path: str) -> DataFrame:
    """Affinities of docked poses: ``file, mode_id, affinity``; a line that starts with `` VINA RESULT:`` each, numbered from 1."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    kept = lines.filter(F.startswith("value", F.lit(" VINA RESULT:")))
    affinity = F.get(F.split(F.trim("value"), r"\s+"), F.lit(2)).try_cast("double")
    return kept.select("file", F.row_number().over(Window.partitionBy("file").orderBy("line")).alias("mode_id"), affinity.alias("affinity"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Pharmacophore points: a header ``dim:name``, then ``TYPE x y z`` lines."""
    files = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("l"))
    named = files.select(F.get(F.split(F.get("l", F.lit(0)), ":"), F.lit(1)).alias("name"), F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("point_no", "value"))
    parts = F.split(F.trim("value"), r"\s+")
    return named.filter(F.trim("value") != "").select("name", "point_no", F.get(parts, F.lit(0)).alias("feat"), *[F.get(parts, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")])


def write_points(points: DataFrame, path: str, dim: int = 3) -> None:
    """One text a molecule, in a folder by ``mol_id``: a header and a line a point."""
    line = F.format_string("%s %.4f %.4f %.4f", "feat", "x", "y", "z")
    texts = points.groupBy("mol_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("point_no", line.alias("s")))), lambda p: p["s"]), "\n").alias("body"))
    texts.select("mol_id", F.concat(F.lit(f"{dim}:"), F.col("mol_id").cast("string"), F.lit("\n"), F.col("body")).alias("value")).write.partitionBy("mol_id").text(path)


def read_pockets(spark: SparkSession, path: str) -> DataFrame:
    """Pocket listings ``Pocket <id> <volume>``: ``file, line_no, pocket_id, volume``; other lines are passed over."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.get(parts, F.lit(0)) == "Pocket").select("file", "line_no", F.get(parts, F.lit(1)).try_cast("int").alias("pocket_id"), F.get(parts, F.lit(2)).try_cast("double").alias("volume"))
    return rows.filter("pocket_id is not null and volume is not null")


def pdb_line(index: Column, element: Column, x: Column, y: Column, z: Column) -> Column:
    """An ATOM record of fixed columns."""
    return F.format_string("ATOM  %5d  %-3s MOL A   1    %8.3f%8.3f%8.3f  1.00  0.00          %2s", index, element, x, y, z, element)


def write_pdb(atoms: DataFrame, path: str) -> None:
    """One PDB text a molecule, in a folder by ``mol_id``, ended by TER and END."""
    line = pdb_line(F.col("atom_idx") + 1, F.col("element"), F.col("x"), F.col("y"), F.col("z"))
    texts = atoms.groupBy("mol_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("atom_idx", line.alias("s")))), lambda a: a["s"]).alias("l"))
    texts.select("mol_id", F.array_join(F.concat("l", F.array(F.lit("TER"), F.lit("END"))), "\n").alias("value")).write.partitionBy("mol_id").text(path)


def saved_or_built(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``, built and saved first where there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # no such path
        if "PATH_NOT_FOUND" not in str(error):
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, id``: a token a line, ids from 1 in line order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "token"))
    return lines.filter("token != ''").select("token", (F.col("n") + 1).alias("id"))
