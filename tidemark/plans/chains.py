"""Monthly tables built on monthly tables, each dependency read at its own lag.

A ``Table`` is a stored source (a monthly root, read by month), an external
source (a root read whole, whatever the month) or a build function over its
dependencies. ``frame(spark, table, period)`` composes the lazy
DataFrames of the whole chain for one run month: each dependency is resolved
at the run month minus its offset, lags add up along a path, and a table
reached by two paths is read at two months. Each (table, month) is built once
however many paths lead to it, so the number of build calls grows with the
tables and months, not with the paths. Catalyst sees one plan, with each
source scan pruned to its month.

Spark would compute such a table for each of its readers. With ``cut_shared``
a derived table that several others read is written to the shared folder
once (``cut_lineage``) and read back by all of them: per month, or, in a backfill
by range, once for all months that any of them reads. Tables with one reader
stay part of the plan.

Dependencies by availability (``latest``, ``trailing``, ``most_recent``) have one plan
for any number of months too: one listing gives the available months, an as-of map
names for each run month those it reads, and the rows of these months are
joined to the map.

``run`` writes one month of a table, ``backfill_table`` many months in one
job, ``run_chain`` every stored table of a chain in order, each (table, month)
computed and written once; ``needed_periods`` lists the (table, month) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.periods import Period, PeriodLike, as_periods, period_index
from tidemark.operators.lineage import cut_lineage
from tidemark.operators.schema import PERIOD_COLUMNS, check_id, conform, declare_schema
from tidemark.sources.tables import (
    available_periods,
    read_external,
    read_latest_available,
    read_most_recent,
    read_period,
    read_periods,
    read_table,
    read_trailing,
)
from tidemark.sources.writes import backfill, backfill_range, replace_period

MODES = ("offset", "latest", "trailing", "most_recent")
#: The month of a trailing dependency's rows in a range, where year and month are the run month's.
OWN_PERIOD = ("own_year", "own_month")


@dataclass(frozen=True, eq=False)
class Dependency:
    table: "Table"
    offset: int = 0
    mode: str = "offset"
    k: int = 0

    def __post_init__(self):
        if self.offset < 0:
            raise ValueError("offsets count months back and cannot be negative")
        if self.mode not in MODES:
            raise ValueError(f"unknown dependency mode {self.mode!r}; use one of {MODES}")


@dataclass(frozen=True, eq=False)
class Table:
    name: str
    build: "Callable[..., DataFrame] | None" = None
    deps: tuple = field(default_factory=tuple)
    root: "str | None" = None
    schema: "T.StructType | None" = None
    id_col: "str | None" = None
    external: bool = False
    build_range: "Callable[..., DataFrame] | None" = None

    def at(self, offset: int = 0) -> Dependency:
        return Dependency(self, offset)

    def latest(self, offset: int = 0) -> Dependency:
        """The last available month not after the run month minus ``offset``."""
        return Dependency(self, offset, "latest")

    def trailing(self, k: int, offset: int = 0) -> Dependency:
        """The last ``k + 1`` available months not after the run month minus ``offset``."""
        return Dependency(self, offset, "trailing", k)

    def most_recent(self) -> Dependency:
        """The table's last available month, whatever the run month (it may lie after it)."""
        return Dependency(self, 0, "most_recent")


def source(name: str, root: str, schema: "T.StructType | None" = None) -> Table:
    """A stored monthly table, read one month at a time; with ``schema`` no file is opened to find its columns."""
    return Table(name=name, root=root, schema=schema)


def external(name: str, path: str, schema: "T.StructType | None" = None) -> Table:
    """A table outside the project, read whole for any month."""
    return Table(name=name, root=path, schema=schema, external=True)


def table(name: str, build: "Callable[..., DataFrame] | None", deps: Iterable = (), root: "str | None" = None,
          schema: "T.StructType | None" = None, id_col: "str | None" = None,
          build_range: "Callable[..., DataFrame] | None" = None) -> Table:
    """A derived table: ``build(period, *inputs)`` with inputs in the order of ``deps``.

    A dependency given as a bare ``Table`` is read at offset 0. With
    ``schema`` the result is conformed to it; with ``id_col`` (a wide table
    with no fixed schema) the id column is checked instead.

    ``build_range(*inputs)`` does the same for many months at once: its inputs
    and result carry the run month in ``year`` and ``month`` (typically it
    groups by them). Backfills then need one plan for any number of months. The
    rows of a trailing dependency also carry their own month, in ``own_year`` and ``own_month``.
    """
    if schema is not None and id_col is not None:
        raise ValueError("a table has either a schema or an id column, not both")
    if schema is not None and not any(f.name in PERIOD_COLUMNS and not f.nullable for f in schema.fields):
        schema = declare_schema(schema)
    resolved = tuple(d if isinstance(d, Dependency) else Dependency(d) for d in deps)
    return Table(name=name, build=build, deps=resolved, root=root, schema=schema, id_col=id_col, build_range=build_range)


class _Chain:
    """The frames of one request, each (table, month) made once, and each undeclared root's columns looked up once.

    ``cut_shared``: tables with several readers are stored when they are first read.
    """

    def __init__(self, spark: SparkSession, top: Table, use_stored: Iterable[str], cut_shared: bool = False):
        self.spark = spark
        self.stored = frozenset(use_stored)
        self.cut_shared = cut_shared
        self.frames: dict[tuple, DataFrame] = {}
        self.schemas: dict[str, T.StructType] = {}
        self.readers: dict[tuple, int] = {}
        self.ranges: dict[int, set[Period]] = {}
        _check_names(top)

    def count_readers(self, t: Table, wanted: list[Period]) -> None:
        """How many dependencies read each derived (table, month), and in ``ranges`` the months that are read of each table."""
        seen: set[tuple] = set()

        def visit(node: Table, p: Period) -> None:
            self.ranges.setdefault(id(node), set()).add(p)
            if (id(node), p) in seen or self.is_read(node):
                return
            seen.add((id(node), p))
            for d in node.deps:
                if d.mode == "offset" and not d.table.external:
                    key = (id(d.table), p.minus(d.offset))
                    self.readers[key] = self.readers.get(key, 0) + 1
                    visit(d.table, p.minus(d.offset))

        for p in wanted:
            visit(t, p)

    def shared(self, t: Table, out: DataFrame, readers: int) -> DataFrame:
        return cut_lineage(out, name=f"shared-{t.name}") if self.cut_shared and readers > 1 else out

    def is_read(self, t: Table) -> bool:
        return t.build is None and t.build_range is None or t.name in self.stored

    def schema(self, t: Table) -> T.StructType:
        if t.schema is not None:
            return t.schema
        if t.root not in self.schemas:
            self.schemas[t.root] = read_table(self.spark, t.root).schema
        return self.schemas[t.root]

    def root(self, t: Table) -> str:
        if t.root is None:
            raise ValueError(f"table {t.name} has no root to read from")
        return t.root

    def external(self, t: Table) -> DataFrame:
        key = (id(t), "external")
        if key not in self.frames:
            self.frames[key] = read_external(self.spark, t.root, schema=t.schema)
        return self.frames[key]

    def checked(self, t: Table, out: "DataFrame | None", what: str, keep: tuple = ()) -> DataFrame:
        if out is None:
            raise ValueError(f"table {t.name} returned nothing for {what}")
        if t.schema is not None:
            return conform(out, t.schema, keep)
        return check_id(out, t.id_col) if t.id_col is not None else out

    def month(self, t: Table, p: Period) -> DataFrame:
        if t.external:
            return self.external(t)
        key = (id(t), p)
        if key not in self.frames:
            if self.is_read(t):
                self.frames[key] = read_period(self.spark, self.root(t), p, schema=self.schema(t))
            else:
                if t.build is None:
                    raise ValueError(f"table {t.name} is only defined for ranges of months")
                out = self.checked(t, t.build(p, *[self.dep(d, p) for d in t.deps]), str(p))
                self.frames[key] = self.shared(t, out, self.readers.get(key, 0))
        return self.frames[key]

    def dep(self, d: Dependency, p: Period) -> DataFrame:
        at, t = p.minus(d.offset), d.table
        if d.mode == "offset":
            return self.month(t, at)
        if t.external:
            return self.external(t)
        if t.root is None or not self.is_read(t):
            raise ValueError(f"table {t.name} has to be stored to be read by availability")
        key = (id(t), at, d.mode, d.k)
        if key not in self.frames:
            schema = self.schema(t)
            if d.mode == "latest":
                found = read_latest_available(self.spark, t.root, at, schema=schema).drop(*PERIOD_COLUMNS)
            elif d.mode == "most_recent":
                found = read_most_recent(self.spark, t.root, schema=schema).drop(*PERIOD_COLUMNS)
            else:
                found = read_trailing(self.spark, t.root, at, d.k, schema=schema)
            self.frames[key] = found
        return self.frames[key]

    def months(self, t: Table, wanted: list[Period]) -> DataFrame:
        """The table's rows of all the months, with their year and month."""
        key = (id(t), tuple(wanted))
        if key not in self.frames:
            if self.is_read(t):
                self.frames[key] = read_periods(self.spark, self.root(t), wanted, schema=self.schema(t))
                return self.frames[key]
            whole = sorted(self.ranges.get(id(t), ()))
            if self.cut_shared and self.range_readers.get(id(t), 0) > 1 and whole != wanted:
                # One frame of all months that are read of it, stored once; each reader takes its own.
                rows = self.months(t, whole)
                self.frames[key] = rows.where(period_index().isin([p.index for p in wanted]))
                return self.frames[key]
            inputs = [self.external(d.table) if d.table.external else self.lagged(d, wanted) for d in t.deps]
            out = self.checked(t, t.build_range(*inputs), f"{wanted[0]} to {wanted[-1]}", PERIOD_COLUMNS)
            self.frames[key] = self.shared(t, out, self.range_readers.get(id(t), 0))
        return self.frames[key]

    def count_range_readers(self, t: Table, wanted: list[Period]) -> None:
        """As ``count_readers``, for whole ranges: the dependencies on each table are its readers."""
        self.count_readers(t, wanted)
        self.range_readers: dict[int, int] = {}
        for node in _in_order(t):
            for d in node.deps if not self.is_read(node) else ():
                self.range_readers[id(d.table)] = self.range_readers.get(id(d.table), 0) + 1

    def lagged(self, d: Dependency, wanted: list[Period]) -> DataFrame:
        """A dependency's rows under the run months that read them."""
        if d.mode != "offset":
            return self.as_of(d, wanted)
        if d.offset == 0:
            return self.months(d.table, wanted)
        rows = self.months(d.table, [p.minus(d.offset) for p in wanted])
        run = period_index() + d.offset
        return rows.withColumns({"year": F.floor(run / 12).cast("int"), "month": (run % 12 + 1).cast("int")})

    def as_of(self, d: Dependency, wanted: list[Period]) -> DataFrame:
        """The rows that each run month reads by availability.

        The map has k + 1 rows a run month, so its size is that of the request. A month
        that several run months read goes to each of them.
        """
        t = d.table
        if t.root is None or not self.is_read(t):
            raise ValueError(f"table {t.name} has to be stored to be read by availability")
        there = available_periods(self.spark, t.root)
        reads: dict[Period, list[Period]] = {}
        for p in wanted:
            upto = there if d.mode == "most_recent" else [a for a in there if a <= p.minus(d.offset)]
            reads[p] = upto[-(d.k + 1) :]
            if not reads[p] and d.mode != "trailing":
                raise FileNotFoundError(f"table {t.root} has no month up to {p.minus(d.offset)}")
        pairs = [(a.year, a.month, p.year, p.month) for p, read in reads.items() for a in read]
        as_of = self.spark.createDataFrame(pairs, "own_year int, own_month int, year int, month int")
        needed = sorted({a for read in reads.values() for a in read})
        rows = read_periods(self.spark, t.root, needed, schema=self.schema(t)).withColumnsRenamed(dict(zip(PERIOD_COLUMNS, OWN_PERIOD)))
        joined = rows.join(F.broadcast(as_of), list(OWN_PERIOD))
        own = [F.col(f"`{c}`") for c in rows.columns if c not in OWN_PERIOD]
        return joined.select(*own, *(OWN_PERIOD if d.mode == "trailing" else ()), *PERIOD_COLUMNS)


def _by_range(t: Table, stored: frozenset) -> bool:
    """Whether the table and all it is built from can be made for many months at once."""
    if t.external or t.build is None and t.build_range is None or t.name in stored:
        return True
    return t.build_range is not None and all(_by_range(d.table, stored) for d in t.deps)


def _check_names(t: Table) -> None:
    """Tables are told apart by name where months are stored, so two of one name would mix."""
    names: dict[str, Table] = {}
    for node in _in_order(t):
        if names.setdefault(node.name, node) is not node:
            raise ValueError(f"two tables of the chain are named {node.name!r}")


def frame(spark: SparkSession, t: Table, period: PeriodLike, *, use_stored: Iterable[str] = (), cut_shared: bool = False) -> DataFrame:
    """The table's frame for one month, as one lazy plan over its sources.

    Tables named in ``use_stored`` are read from their root instead of being
    built again. ``cut_shared`` runs a job for each derived table that several
    others read, which is then computed once and not once per reader.
    """
    chain, p = _Chain(spark, t, use_stored, cut_shared), Period.of(period)
    chain.count_readers(t, [p])
    return chain.month(t, p)


def run(spark: SparkSession, t: Table, period: PeriodLike, *, use_stored: Iterable[str] = (),
        rebalance: bool = True, cut_shared: bool = True) -> Period:
    """Compute one month of a table and replace that month in its root, tables with several readers computed once.

    ``rebalance=False`` when the table's frame ends in an aggregate (see
    ``replace_periods``).
    """
    if t.root is None:
        raise ValueError(f"table {t.name} has no root to write to")
    return replace_period(frame(spark, t, period, use_stored=use_stored, cut_shared=cut_shared), t.root, period, rebalance=rebalance)


def backfill_table(spark: SparkSession, t: Table, periods: Iterable[PeriodLike], *,
                   use_stored: Iterable[str] = (), cut_shared: bool = True) -> list[Period]:
    """Compute many months of a table and write them in one Spark job (and one for each shared table).

    Where the table and its inputs have ``build_range`` (or are read), the
    plan is the same for any number of months; otherwise it holds one frame per month.
    """
    if t.root is None:
        raise ValueError(f"table {t.name} has no root to write to")
    chain, wanted = _Chain(spark, t, use_stored, cut_shared), as_periods(periods)
    if t.build_range is not None and _by_range(t, chain.stored - {t.name}):
        chain.count_range_readers(t, wanted)
        return backfill_range(spark, t.root, lambda months: chain.months(t, months), wanted)
    chain.count_readers(t, wanted)
    return backfill(spark, t.root, lambda p: chain.month(t, p), wanted)


def run_chain(spark: SparkSession, t: Table, period: PeriodLike) -> dict[str, list[Period]]:
    """Run a chain for one month: every table with a root is written for the months that are needed of it.

    Tables are written after those they read, each (table, month) once, and read
    back from then on. Returns the months written by table.
    """
    _check_names(t)
    needed = needed_periods(t, period)
    done: dict[str, list[Period]] = {}
    for node in _in_order(t):
        if (node.build is not None or node.build_range is not None) and node.root is not None:
            done[node.name] = backfill_table(spark, node, needed[node.name], use_stored=list(done))
    return done


def _in_order(t: Table) -> list[Table]:
    """All tables of a chain, each after those it reads."""
    out: list[Table] = []
    seen: set[int] = set()

    def visit(node: Table) -> None:
        if id(node) in seen:
            return
        seen.add(id(node))
        for d in node.deps:
            visit(d.table)
        out.append(node)

    visit(t)
    return out


def needed_periods(t: Table, period: PeriodLike) -> dict[str, set[Period]]:
    """Every (table name -> months) that a run of ``t`` for ``period`` reads or builds.

    Which months are available is known to the store alone. Without it a
    trailing dependency is taken to need its ``k + 1`` calendar months, and a latest or most
    recent one the run month minus its offset.
    """
    out: dict[str, set[Period]] = {}
    seen: set[tuple] = set()

    def visit(node: Table, p: Period) -> None:
        if (id(node), p) in seen:
            return
        seen.add((id(node), p))
        out.setdefault(node.name, set()).add(p)
        for d in node.deps:
            at = p.minus(d.offset)
            for back in range(d.k + 1 if d.mode == "trailing" else 1):
                visit(d.table, at.minus(back))

    visit(t, Period.of(period))
    return out
