"""Structure files read by Spark: atoms of PDB and PSF files, and the frames of PDB trajectories.

Both are lines of text, so a large file is read by as many tasks as it has splits. What depends on the lines before, the
number of a line, frame or atom, is counted within each split and carried over by the sums of the splits before it.
Columns follow the public descriptions of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First column (from 1) and width of the fields of ATOM and HETATM records.
PDB_FIELDS = {"name": (13, 4), "resname": (18, 4), "chain": (22, 1), "resid": (23, 4), "icode": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8), "segment": (73, 4)}
#: Atoms of a stretch within which a residue's first atom is looked for; its border to the next is joined.
STRETCH = 100_000


def _counted(lines: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Adds to lines (file, block, line) how many of a file's lines up to each have a flag, for each flag."""
    rows = lines.withColumns({f"_is_{n}": c.cast("long") for n, c in flags.items()})
    within = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(F.col("file").alias("_file"), F.col("block").alias("_block")).agg(*(F.sum(f"_is_{n}").alias(f"_all_{n}") for n in flags))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    sums = sums.select("_file", "_block", *(F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in flags))
    rows = rows.withColumns({n: F.sum(f"_is_{n}").over(within) for n in flags})
    rows = rows.join(sums, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return rows.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in flags}).select(*lines.columns, *flags)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, value: the lines of files; by block and line they are in the file's order.

    A block is a split of a file, which one task reads from its start to its end, so ids that rise within a task order it.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("line", F.monotonically_increasing_id())


def _field(name: str) -> Column:
    start, width = PDB_FIELDS[name]
    return F.trim(F.substring("value", start, width))


def pdb_frames(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, atom_index, name, resname, resid, icode, segid, x, y, z of the ATOM and HETATM records of PDB files.

    MODEL records begin frames, numbered from 1 in the file's order whatever numbers they bear; a file without them is one
    frame. Atoms are numbered from 1 in their frame. segid is the segment or else the chain. Fields that are no numbers are null.
    """
    record = F.rtrim(F.substring("value", 1, 6))
    lines = read_lines(spark, path).filter(record.isin("ATOM", "HETATM", "MODEL"))
    rows = _counted(lines, {"frame": record == "MODEL", "place": record != "MODEL"}).filter(record != "MODEL")
    number = lambda n, kind: _field(n).try_cast(kind).alias(n)
    rows = rows.select(
        "file", F.greatest("frame", F.lit(1)).alias("frame"), "place", _field("name").alias("name"), _field("resname").alias("resname"), number("resid", "int"), _field("icode").alias("icode"),
        F.coalesce(F.nullif(_field("segment"), F.lit("")), _field("chain")).alias("segid"), number("x", "double"), number("y", "double"), number("z", "double"),
    )
    first = rows.groupBy(F.col("file").alias("_file"), F.col("frame").alias("_frame")).agg(F.min("place").alias("_first"))
    rows = rows.join(first, (F.col("file") == F.col("_file")) & (F.col("frame") == F.col("_frame")))
    return rows.select("file", "frame", (F.col("place") - F.col("_first") + 1).alias("atom_index"), "name", "resname", "resid", "icode", "segid", "x", "y", "z")


def pdb_atoms(frames: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The atoms of the first frame with resindex, as the atom tables of `residues` have them, for each file."""
    rows = frames.filter("frame = 1").select("file", "atom_index", "name", "resname", "resid", "segid", F.struct("resid", "icode", "resname", "segid").alias("_residue"))
    return _with_residues(rows, stretch)


def psf_atoms(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """The atoms of PSF files: as many lines after the one that says !NATOM as it says; numbered and with resindex as above."""
    lines = read_lines(spark, path)
    counted = _counted(lines, {"number": F.lit(True)})
    heads = counted.filter(F.col("value").rlike(r"^\s*[0-9]+\s+!NATOM"))
    heads = heads.groupBy(F.col("file").alias("_file")).agg(F.min(F.struct("number", F.split(F.trim("value"), r"\s+")[0].try_cast("long").alias("n"))).alias("_head"))
    own = counted.join(heads, F.col("file") == F.col("_file")).filter((F.col("number") > F.col("_head.number")) & (F.col("number") <= F.col("_head.number") + F.col("_head.n")))
    f = F.split(F.trim("value"), r"\s+")
    digits = F.regexp_extract(F.get(f, F.lit(2)), r"^(-?[0-9]+)", 1)
    rows = own.select("file", (F.col("number") - F.col("_head.number")).alias("atom_index"), F.get(f, F.lit(4)).alias("name"), F.get(f, F.lit(3)).alias("resname"), digits.try_cast("int").alias("resid"), F.get(f, F.lit(1)).alias("segid"), F.struct(F.get(f, F.lit(2)), F.get(f, F.lit(3)), F.get(f, F.lit(1))).alias("_residue"))
    return _with_residues(rows, stretch)


def _with_residues(atoms: DataFrame, stretch: int) -> DataFrame:
    """resindex, from 0: a residue ends where the next atom's number, name or segment differs."""
    rows = atoms.withColumn("_stretch", F.floor((F.col("atom_index") - 1) / stretch))
    within = Window.partitionBy("file", "_stretch").orderBy("atom_index")
    ends = rows.filter(F.col("atom_index") % stretch == 0).select(F.col("file").alias("_of"), (F.col("_stretch") + 1).alias("_next"), F.col("_residue").alias("_carried"))
    rows = rows.withColumn("_last", F.lag("_residue").over(within)).join(ends, (F.col("file") == F.col("_of")) & (F.col("_stretch") == F.col("_next")), "left")
    before = F.coalesce("_last", "_carried")
    rows = rows.withColumn("_new", (before.isNotNull() & ~F.col("_residue").eqNullSafe(before)).cast("long"))
    rows = rows.withColumn("_own", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy(F.col("file").alias("_file"), F.col("_stretch").alias("_part")).agg(F.sum("_new").alias("n"))
    earlier = Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch of a file
    sums = sums.select("_file", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.join(sums, (F.col("file") == F.col("_file")) & (F.col("_stretch") == F.col("_part")))
    return rows.select("file", "atom_index", "name", "resname", "resid", "segid", (F.col("_own") + F.col("_before")).alias("resindex"))
