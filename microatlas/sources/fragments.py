"""Editions shipped as keyless column fragments, assembled by row position.

An edition is a folder of delimited text fragments. Each fragment carries a few
columns; row i of every fragment belongs to the same student, and no fragment
has a student key. Spark has no row order, so a position is rebuilt from what a
scan does know: the file, the byte where the split starts, and the row's number
inside its task. A first scan, which parses nothing, counts the rows of every split, so

    position = row number in split + rows in all earlier splits

is known to the second scan, which writes every fragment's values, one array a row, into
a layer bucketed by ranges of positions (``sources.zipping``). Rows of one range lie in one
bucket whatever fragment they come from, so the fragments meet without a shuffle. Files
are split alike in both scans, whatever the size of the cluster, and the written layer is
held against the counts.

Rows whose number of fields is not the header's keep their place and the fields they have;
they are counted per fragment and kept with their text as rejects.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING, NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas import config
from microatlas.runtime import SettledParts, settle, settle_parts
from microatlas.sources.positions import file_order
from microatlas.sources.zipping import RANGE, range_width, write_bucketed

if TYPE_CHECKING:
    import pyarrow as pa

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id: row number within the task
POSITION = "pos"
PEEKS = 8
REJECT = "_linha"
_HUGE = str(1 << 46)  # no file is split, and no two files share a task


@dataclass(frozen=True)
class Fragment:
    """One topic: a text file, or a folder of part files read in name order."""

    name: str
    files: tuple[str, ...]
    columns: tuple[str, ...]


@dataclass
class Choice:
    """Which columns are taken from which fragment of an edition."""

    year: int
    fragments: list[Fragment]
    taken: dict[str, list[str]] = field(default_factory=dict)
    identification: str | None = None


@dataclass(frozen=True)
class Part:
    """One fragment of one edition with the columns taken from it."""

    number: int
    year: int
    fragment: Fragment
    columns: tuple[str, ...]
    identifies: bool


@dataclass
class Layer:
    """The values of all fragments by position: one row per fragment and position.

    ``rows`` is bucketed by ``RANGE``, a number for each edition and range of positions.
    """

    parts: list[Part]
    rows: DataFrame
    offsets: DataFrame


class Load(NamedTuple):
    """Assembled rows; one line per edition and per fragment; the rejected lines."""

    rows: DataFrame
    report: DataFrame
    fragments: DataFrame
    rejects: DataFrame


@contextmanager
def set_conf(spark: SparkSession, **own: str) -> Iterator[None]:
    """SQL settings under ``spark.sql.files`` for the jobs of a block."""
    before = {k: spark.conf.get(f"spark.sql.files.{k}", None) for k in own}
    for k, v in own.items():
        spark.conf.set(f"spark.sql.files.{k}", v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(f"spark.sql.files.{k}")
            else:
                spark.conf.set(f"spark.sql.files.{k}", v)


def read_text(
    spark: SparkSession, files: Sequence[str] | str, columns: Sequence[str] | None = None, rejects: str | None = None
) -> DataFrame:
    """Delimited latin-1 text with a header, every column a string.

    With ``columns`` the header is known and not read for it. ``rejects`` names a further
    column with the line where it has not as many fields as the header has, else null; a file
    with another header than ``columns`` then fails.
    """
    files = [files] if isinstance(files, str) else list(files)
    reader = (
        spark.read.option("sep", ";")
        .option("encoding", "ISO-8859-1")
        .option("header", True)
        .option("escape", '"')
    )
    if columns is not None:
        names = [*columns, *([rejects] if rejects else [])]
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).option("enforceSchema", False)
        if rejects:
            # A pruned column would not be counted.
            reader = reader.option("columnNameOfCorruptRecord", rejects).option("columnPruning", False)
    return reader.csv(files)


def discover(spark: SparkSession, folder: str, pattern: str = "*.txt") -> list[str]:
    """All text files under a folder, in path order. Lists only; reads nothing."""
    listed = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(folder)
        .inputFiles()
    )
    return sorted(unquote(f) for f in listed)


def headers(spark: SparkSession, files: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The column names in the first line of every file, in one job.

    Each file is one task, which stops after its first rows. A file without lines has
    no columns.
    """
    if not files:
        return {}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = spark.read.schema("line string").option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").csv(list(files))
    with set_conf(spark, maxPartitionBytes=_HUGE, openCostInBytes=_HUGE):
        found = lines.select(F.col("_metadata.file_path").alias("file"), "line").mapInArrow(first, "file string, line string").collect()
    names = {_bare(unquote(r.file)): _column_names(r.line) for r in found}
    return {f: names.get(_bare(f), ()) for f in files}


def _bare(file: str) -> str:
    """A path as Spark's listing and its metadata both give it."""
    return file.replace(":///", ":/")


def _column_names(line: str) -> tuple[str, ...]:
    """Names as Spark gives them: repeated ones get their place, empty ones are _c and the place."""
    names = next(csv.reader([line], delimiter=";"))
    lower = [n.lower() for n in names]
    return tuple(f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names))


def fragments_of(
    spark: SparkSession, files: Sequence[str], on_error: str = "fail", failed: list[str] | None = None
) -> list[Fragment]:
    """Group part files by folder and take each fragment's header, all in one job.

    With ``on_error="skip"`` a fragment that cannot be opened is left out and its name
    is added to ``failed``; only when the one job fails are headers read one by one.
    """
    groups: dict[str, list[str]] = {}
    for f in files:
        is_part = os.path.basename(f).startswith("part-")
        groups.setdefault(os.path.dirname(f) if is_part else f, []).append(f)
    firsts = {name: parts[0] for name, parts in sorted(groups.items())}
    try:
        names = headers(spark, list(firsts.values()))
    except Exception:
        if on_error != "skip":
            raise

        def peek(file: str) -> tuple[str, ...] | None:
            try:
                return headers(spark, [file])[file]
            except Exception:
                return None

        names = {f: peek(f) for f in firsts.values()}
    if failed is not None:
        failed += [name for name, f in firsts.items() if names[f] is None]
    return [Fragment(name, tuple(groups[name]), names[f]) for name, f in firsts.items() if names[f] is not None]


def choose_columns(
    year: int,
    fragments: Sequence[Fragment],
    wanted: Sequence[str] = config.RAW_COLUMNS,
    group: str = config.GROUP_COLUMN,
    course: str = config.COURSE_COLUMN,
) -> Choice:
    """First fragment (by path) to offer a wanted column supplies it.

    The fragment with the group code always supplies group and course; of several
    such fragments the last one does. Fragments with nothing wanted are not read.
    """
    choice = Choice(year, list(fragments))
    owner: dict[str, str] = {}
    for fragment in fragments:
        for c in fragment.columns:
            if c in wanted:
                owner.setdefault(c, fragment.name)
        if group in fragment.columns:
            choice.identification = fragment.name
            owner[group] = fragment.name
            if course in fragment.columns:
                owner[course] = fragment.name
    for c, name in owner.items():
        choice.taken.setdefault(name, []).append(c)
    return choice


def values_of(part: Part, year_column: str = config.YEAR_COLUMN) -> list[str]:
    return [c for c in part.columns if c != year_column]


def _row() -> Column:
    """The row's number in its task."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row")


def split_offsets(spark: SparkSession, parts: Sequence[Part]) -> SettledParts:
    """Rows before each split, per fragment: one row per split of the input.

    Counts lines and parses none. The running sum is over splits, not rows. Each
    fragment's offsets are settled in a folder of their own, so the join that uses them
    broadcasts only while they are small.
    """
    scans = [
        read_text(spark, part.fragment.files, part.fragment.columns).select(
            F.lit(part.number).alias("_part"), F.lit(part.year).alias("_year"),
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), _row(),
        )
        for part in parts
    ]
    counted = reduce(DataFrame.unionByName, scans).groupBy("_part", "_year", "_file", "_start").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = W.partitionBy("_part").orderBy(*file_order(), "_start").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return settle_parts(placed.withColumn("_file", F.xxhash64("_file")), "_part", "split-offsets")


def lay_out(spark: SparkSession, parts: Sequence[Part], year_column: str = config.YEAR_COLUMN) -> Layer:
    """Write the taken values of every fragment by position.

    ``_values`` is an array in the order of the part's columns, without the edition.
    Splits depend on the files alone while this runs, so both scans see the same ones.
    """
    parts = list(parts)
    with set_conf(spark, minPartitionNum="1"):
        offsets = split_offsets(spark, parts)
        counted = offsets.table()
        n, editions = counted.agg(F.max(F.col("_before") + F.col("_rows")), F.count_distinct("_year")).first()
        width = range_width(spark, (n or 0) * max(1, editions))
        ranges = (n or 0) // width + 1
        years = {y: i for i, y in enumerate(sorted({part.year for part in parts}))}
        scans = []
        for part in parts:
            taken = values_of(part, year_column)
            text = read_text(spark, part.fragment.files, part.fragment.columns, REJECT)
            scan = text.select(
                F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), _row(),
                F.array(*[F.col(c) for c in taken]).cast("array<string>").alias("_values"), F.col(REJECT),
            )
            own = offsets.part(part.number).select("_file", "_start", "_first", "_before")
            # A row without an offset keeps a null position, which the check below finds.
            placed = scan.join(own, ["_file", "_start"], "left").withColumn(POSITION, F.col("_row") - F.col("_first") + F.col("_before"))
            scans.append(
                placed.select(
                    F.lit(part.number).alias("_part"), F.lit(part.year).alias("_year"), POSITION,
                    (F.lit(years[part.year] * ranges) + F.floor(F.col(POSITION) / width)).cast("bigint").alias(RANGE),
                    "_file", "_start", "_values", REJECT,
                )
            )
        rows = write_bucketed(reduce(DataFrame.unionByName, scans), ranges * len(years), "fragment-layer", POSITION)
    layer = Layer(parts, rows, counted)
    check_positions(layer)
    return layer


def check_positions(layer: Layer) -> None:
    """Fail unless every counted split is in the layer, whole and in its place.

    A split's rows follow each other without a gap, and so do the splits of a fragment: each
    position from 0 to the count is there once. One narrow pass over the written rows; only
    splits are compared.
    """
    keys = ["_part", "_file", "_start"]
    found = layer.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(POSITION).alias("low"), F.max(POSITION).alias("high"))
    counted = layer.offsets.select(*keys, "_rows", "_before")
    follow = F.lag(F.col("_before") + F.col("_rows"), 1, 0).over(W.partitionBy("_part").orderBy("_before", "_rows"))
    whole = (
        (F.col("n") == F.col("_rows")) & (F.col("low") == F.col("_before"))
        & (F.col("high") == F.col("_before") + F.col("_rows") - 1) & (F.col("_before") == follow)
    )
    wrong = found.join(counted, keys, "full").withColumn("whole", whole).filter(~F.coalesce("whole", F.lit(False))).limit(5).collect()
    if wrong:
        raise RuntimeError(f"fragments whose rows are not all placed: {[r.asDict() for r in wrong]}")


def assemble(
    spark: SparkSession,
    choices: Sequence[Choice],
    keep: Column | None = None,
    wanted: Sequence[str] = config.RAW_COLUMNS,
    optional: Sequence[str] = config.OPTIONAL_COLUMNS,
    year_column: str = config.YEAR_COLUMN,
    layer: Layer | None = None,
    with_id: bool = False,
) -> DataFrame:
    """All editions as one table keyed by (edition, position).

    ``keep`` is a predicate on the identification columns. ``with_id`` numbers the kept rows
    in (edition, position) order from 0. ``layer`` is what ``lay_out`` gave. Fragments meet
    bucket by bucket, and ids follow from counts per range: no value is shuffled.
    """
    if layer is None:
        layer = lay_out(spark, parts_of(choices), year_column)
    named: dict[str, list[tuple[int, int]]] = {}  # column -> (part, place in its values)
    for part in layer.parts:
        for i, c in enumerate(values_of(part, year_column)):
            named.setdefault(c, []).append((part.number, i))
    identifying = [part.number for part in layer.parts if part.identifies]

    def column(c: str, values: Callable[[int], Column]) -> Column:
        return F.coalesce(*[values(n)[i] for n, i in named[c]], F.lit(None).cast("string")).alias(c)

    # A position holds at most one array per fragment.
    gathered = layer.rows.groupBy(RANGE, "_year", POSITION).agg(
        F.map_from_entries(F.collect_list(F.struct("_part", "_values"))).alias("_parts")
    )
    columns = [column(c, lambda n: F.element_at("_parts", F.lit(n))) for c in named]
    is_known = F.arrays_overlap(F.map_keys("_parts"), F.array(*[F.lit(n) for n in identifying])) if identifying else F.lit(False)
    rows = gathered.select(
        RANGE, "_year", POSITION, is_known.alias("_known"), F.col("_year").cast("string").alias(year_column),
        *[c for c, name in zip(columns, named) if name != year_column],
    )
    if keep is not None:
        rows = rows.filter(F.col("_known") & keep)
    if with_id:
        rows = _with_id(rows, _kept_before(layer, identifying, named, keep, column))
    for c in optional:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    first = [POSITION, "id"] if with_id else [POSITION]
    return rows.select(*first, *[c for c in wanted if c in rows.columns])


def _kept_before(layer: Layer, identifying: list[int], named: Mapping, keep: Column | None, column: Callable) -> DataFrame:
    """For each range of positions, how many kept rows all earlier ranges hold."""
    own = layer.rows.filter(F.col("_part").isin(identifying))
    if keep is not None:
        of_part = lambda n: F.when(F.col("_part") == n, F.col("_values"))
        known = [c for c, places in named.items() if any(n in identifying for n, _ in places)]
        own = own.select(RANGE, *[column(c, of_part) for c in known]).filter(keep)
    counts = settle(own.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n")), "kept-ranges")
    # One row per range enters this window.
    earlier = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(RANGE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))


def _with_id(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Consecutive ids of the identified rows; a window holds one range of positions."""
    upto = F.count(F.when(F.col("_known"), 1)).over(W.partitionBy(RANGE).orderBy(POSITION))
    placed = rows.withColumn("_upto", upto).join(settle(starts, "range-starts"), RANGE, "left")
    return placed.withColumn("id", F.when(F.col("_known"), F.col("_earlier") + F.col("_upto") - 1))


def parts_of(choices: Sequence[Choice]) -> list[Part]:
    """The fragments that are read, numbered over all editions."""
    read = [
        (choice, fragment)
        for choice in choices
        for fragment in choice.fragments
        if choice.taken.get(fragment.name)
    ]
    return [
        Part(
            i, choice.year, fragment, tuple(choice.taken[fragment.name]),
            fragment.name == choice.identification,
        )
        for i, (choice, fragment) in enumerate(read)
    ]


def unreadable(spark: SparkSession, parts: Sequence[Part]) -> list[Part]:
    """The parts whose texts cannot be read to the end, each tried by itself."""

    def fails(part: Part) -> bool:
        try:
            whole = read_text(spark, part.fragment.files, part.fragment.columns, REJECT)
            whole.write.format("noop").mode("overwrite").save()
            read_text(spark, part.fragment.files, part.fragment.columns).agg(F.count(F.lit(1))).collect()
            return False
        except Exception:
            return True

    with ThreadPoolExecutor(PEEKS) as pool:
        return [part for part, bad in zip(parts, pool.map(fails, parts)) if bad]


def load(
    spark: SparkSession,
    folders: Mapping[int, str],
    codes: Sequence[int] | None = tuple(config.COURSE_NAMES),
    wanted: Sequence[str] = config.RAW_COLUMNS,
    optional: Sequence[str] = config.OPTIONAL_COLUMNS,
    on_error: str = "fail",
    with_id: bool = False,
) -> Load:
    """Assemble several editions.

    ``on_error="skip"`` leaves out fragments that cannot be opened or read to the end, and
    editions that are missing or have no identification fragment, and says so in the
    report; a column of a dropped fragment comes from the next one that offers it. Nothing
    at all is an error.
    """
    found: dict[int, list[Fragment]] = {}
    broken: dict[int, list[str]] = {}
    errors: dict[int, str] = {}
    for year, folder in sorted(folders.items()):
        broken[year] = []
        try:
            found[year] = fragments_of(spark, discover(spark, folder), on_error, broken[year])
        except Exception as error:
            if on_error != "skip":
                raise
            errors[year] = type(error).__name__
    while True:
        choices: list[Choice] = []
        for year, fragments in found.items():
            choice = choose_columns(year, fragments, wanted)
            if choice.identification is not None:
                choices.append(choice)
            elif on_error == "skip":
                errors[year] = "ValueError"
            else:
                raise ValueError(f"no fragment of {year} has {config.GROUP_COLUMN}")
        if not choices:
            raise RuntimeError("no edition could be read")
        parts = parts_of(choices)
        try:
            layer = lay_out(spark, parts)
            break
        except Exception:
            bad = unreadable(spark, parts) if on_error == "skip" else []
            if not bad:
                raise
            for part in bad:
                found[part.year] = [f for f in found[part.year] if f.name != part.fragment.name]
                broken[part.year].append(part.fragment.name)
    keep = None if codes is None else F.trim(config.GROUP_COLUMN).isin([str(c) for c in codes])
    rows = assemble(spark, choices, keep, wanted, optional, layer=layer, with_id=with_id)
    chosen = {choice.year: choice for choice in choices}
    lines = [
        (y, errors[y], 0, 0, len(broken[y])) if y not in chosen
        else (y, "ok", len(chosen[y].fragments), len(chosen[y].taken), len(broken[y]))
        for y in sorted(folders)
    ]
    status = spark.createDataFrame(
        lines, "ano int, situacao string, fragmentos int, fragmentos_lidos int, fragmentos_com_erro int"
    )
    names = [(part.year, part.number, part.fragment.name, "ok") for part in parts]
    names += [(y, None, name, "erro") for y, lost in broken.items() for name in lost]
    per_fragment = _per_fragment(spark.createDataFrame(names, "ano int, _part int, fragmento string, situacao string"), layer)
    parted = spark.createDataFrame([n[:3] for n in names if n[1] is not None], "ano int, _part int, fragmento string")
    rejects = layer.rows.filter(F.col(REJECT).isNotNull()).join(parted, "_part").select("ano", "fragmento", POSITION, F.col(REJECT).alias("linha"))
    return Load(rows, _with_lengths(status, per_fragment), per_fragment, rejects)


def load_editions(spark: SparkSession, folders: Mapping[int, str], *args, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Assembled rows and the report per edition of ``load``."""
    done = load(spark, folders, *args, **kwargs)
    return done.rows, done.report


def _per_fragment(names: DataFrame, layer: Layer) -> DataFrame:
    """Rows and malformed rows of each fragment that is read."""
    counts = layer.offsets.groupBy("_part").agg(F.sum("_rows").alias("linhas"))
    bad = layer.rows.filter(F.col(REJECT).isNotNull()).groupBy("_part").agg(F.count(F.lit(1)).alias("malformadas"))
    both = names.join(counts, "_part", "left").join(bad, "_part", "left")
    read = F.col("situacao") == "ok"
    # A fragment without rows has no split to count.
    return settle(
        both.select(
            "ano", "fragmento", "situacao", F.when(read, F.coalesce("linhas", F.lit(0))).alias("linhas"),
            F.when(read, F.coalesce("malformadas", F.lit(0))).alias("linhas_malformadas"),
        ),
        "fragment-report",
    )


def _with_lengths(status: DataFrame, per_fragment: DataFrame) -> DataFrame:
    """Add shortest and longest fragment per edition: unequal lengths are a warning, as
    malformed rows are."""
    per_year = per_fragment.filter("situacao = 'ok'").groupBy("ano").agg(
        F.min("linhas").alias("menor_fragmento"), F.max("linhas").alias("maior_fragmento"),
        F.sum("linhas_malformadas").alias("linhas_malformadas"),
    )
    return status.join(per_year, "ano", "left").withColumn(
        "alinhado", F.col("menor_fragmento") == F.col("maior_fragmento")
    )
