"""A chained description of a run: source, cuts, reasons to drop, formats.

Nothing is read until a result is asked for.  Every method returns the run itself, and
results are DataFrames, so a chain can be left and taken up anywhere.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.operators import evidence as E
from baseloom.operators.measures import Check, DeclarationError, Measure, Relation
from baseloom.sinks import sites as sinks


class Run:
    def __init__(self, hits: DataFrame | str | None = None, *, read: tuple[str, ...] = E.READ, block=None, block_sep: str = ".", names: dict[str, str] | None = None, coordinate_base: int = 0, spark: SparkSession | None = None):
        self._spark = spark or SparkSession.getActiveSession()
        self._where: list[tuple] = []
        self._measures: dict[str, Measure] = {}
        self._relations: dict[str, Relation] = {}
        self._drop: dict[str, list[Check]] = {"read": [], "block": [], "site": []}
        self._merge: Measure | None = None
        self._span = 1
        self._sites_used = False
        self._base = coordinate_base
        self.formats = dict(sinks.FORMATS)
        self.source(hits, read=read, block=block, block_sep=block_sep, names=names)

    def source(self, hits, *, read=E.READ, block=None, block_sep=".", names=None) -> Run:
        """The hits (a DataFrame, or paths of Parquet files), what is one read, and what blocks reads."""
        self._source = (hits, (read,) if isinstance(read, str) else tuple(read), block, block_sep, names)
        return self

    def where(self, *alternatives: str | Column) -> Run:
        """Hits that meet one of these conditions; several calls must all be met."""
        self._where.append(alternatives)
        return self

    def measures(self, *items: Measure | Relation) -> Run:
        for item in items:
            self._declare(item)
        return self

    def _declare(self, item: Measure | Relation) -> Relation | None:
        table, new = (self._relations, item) if isinstance(item, Relation) else (self._measures, item)
        if isinstance(item, Relation):
            self._declare(item.measure)
        if table.setdefault(new.name, new) != new:
            raise DeclarationError(f"two different things are declared as {new.name!r}")
        if isinstance(item, Measure) and len(item.categories) == 2:
            self._relations.setdefault(item.name, item.relate())
        return new if isinstance(new, Relation) else self._relations.get(new.name)

    def _dropping(self, level: str, checks) -> Run:
        for check in checks:
            check.at(level)
            for item in check.declared():
                self._declare(item)
            self._drop[level].append(check)
        return self

    def drop_reads(self, *checks: Check) -> Run:
        """Reads that meet any of the checks go."""
        return self._dropping("read", checks)

    def drop_blocks(self, *checks: Check) -> Run:
        return self._dropping("block", checks)

    def drop_sites(self, *checks: Check) -> Run:
        if self._sites_used:
            raise DeclarationError("sites have been read already: drop_sites() goes before formats")
        return self._dropping("site", checks)

    def merge_strands(self, measure: Measure, span: int = 1) -> Run:
        """Folds a measure's minus-strand sites onto the plus strand, span bases before."""
        self._declare(measure)
        self._merge, self._span = measure, span
        return self

    def register(self, name: str, function) -> Run:
        """Adds or replaces a format: function(site_relation, ..., base=) returning rows."""
        self.formats[name] = function
        return self

    # SQL and Python in between

    def views(self) -> Run:
        """Makes src, resolved, site_relation and block_summary views of the session, for SQL."""
        for name, make in (("src", self.src), ("resolved", self.resolved), ("site_relation", self.sites), ("block_summary", self.summary)):
            make().createOrReplaceTempView(name)
        return self

    def sql(self, statement: str, **values) -> DataFrame:
        """Rows of a statement over the run's views; values are its named parameters."""
        self.views()
        return self._spark.sql(statement, args=values or None)

    def read(self, path: str, include: tuple[str, ...] = (), **values) -> Run:
        """Runs a script over the run's views; values are session variables."""
        from baseloom.plans.script import run_script

        self.views()
        run_script(self._spark, path, include, **values)
        return self

    def python(self, path: str, **values) -> Run:
        """Runs a Python file with ``spark``, ``run`` and ``var``."""
        from baseloom.plans.script import run_python, set_variables

        set_variables(self._spark, values)
        run_python(self._spark, path, run=self)
        return self

    # results

    def src(self) -> DataFrame:
        hits, read, block, sep, names = self._source
        if hits is None:
            raise DeclarationError("the run has no source")
        if not isinstance(hits, DataFrame):
            hits = self._spark.read.parquet(*([hits] if isinstance(hits, str) else hits))
        for alternatives in self._where:
            hits = E.where(hits, *alternatives)
        return E.source(hits, read, block, sep, names)

    def evidence(self) -> E.Evidence:
        args = (list(self._measures.values()), list(self._relations.values()))
        src = self.src()
        resolved = E.Evidence(src, *args).resolve(self._drop["read"], self._drop["block"])
        return E.Evidence(src, *args, resolved=resolved, merge=self._merge, span=self._span, coordinate_base=self._base)

    def resolved(self) -> DataFrame:
        return self.evidence().resolved

    def sites(self) -> DataFrame:
        """(block, contig, refr_pos, strand, relation, num, den) of the sites that are kept."""
        self._sites_used = True
        return self.evidence().site_relation(self._drop["site"])

    def summary(self) -> DataFrame:
        return E.block_summary(self.sites())

    def report(self) -> DataFrame:
        """(ord, what, n): distinct reads seen and kept, then the rows that each check rejects.

        Checks of a level that a row of its counts decides share one pass over them.
        """
        ev = self.evidence()
        reads = lambda hits: hits.agg(F.count_distinct("read").alias("n"))
        parts = [(0, "reads seen", reads(ev.hits)), (1, "reads kept", reads(ev.resolved))]
        together: dict[str, list[tuple[int, str, Column]]] = {}
        for level, checks in self._drop.items():
            for check, found in zip(checks, ev.counted(checks, level), strict=True):
                at = len(parts) + sum(map(len, together.values()))
                if isinstance(found, Column):
                    together.setdefault(level, []).append((at, f"{level} {check.label}", found))
                else:
                    parts.append((at, f"{level} {check.label}", found))
        rows = [df.select(F.lit(i).alias("ord"), F.lit(what).alias("what"), "n") for i, what, df in parts]
        for level, tests in together.items():
            counts = ev._table(level).agg(*(F.count_if(test).alias(f"n{i}") for i, _, test in tests))
            entries = (F.struct(F.lit(i).alias("ord"), F.lit(what).alias("what"), F.col(f"n{i}").alias("n")) for i, what, _ in tests)
            rows.append(counts.select(F.inline(F.array(*entries))))
        return reduce(DataFrame.unionByName, rows)

    def rows(self, form: str, *args, **values) -> DataFrame:
        """A format's rows.  Measures and relations among the arguments are declared and named."""
        if form not in self.formats:
            raise AttributeError(f"no format {form!r}; there are {', '.join(sorted(self.formats))}")

        def named(x):
            return self._declare(x).name if isinstance(x, (Measure, Relation)) else x

        args, values = [named(a) for a in args], {k: named(v) for k, v in values.items()}
        if form == "cgmap":
            args = [list(self._relations)]
        if form not in ("cellinfo", "sites_parquet"):
            values.setdefault("base", self._base)
        return self.formats[form](self.sites(), *args, **values)

    def write(self, form: str, *args, out: str, single: bool = False, **values) -> Run:
        """Writes a format; text in parts whose names are in order, or as a single part."""
        if Path(out).suffix == ".parquet" or form == "sites_parquet":
            sinks.write_parquet(self.rows(form, *args, **values), out)
        else:
            sinks.write_rows(self.rows(form, *args, **values), out, single)
        return self

    def __getattr__(self, name: str):
        """``run.bismark_cov(mCG, out=path)`` writes a format; without out it returns the rows."""
        if name.startswith("_") or name not in self.__dict__.get("formats", {}):
            raise AttributeError(name)
        return lambda *args, out=None, **values: self.rows(name, *args, **values) if out is None else self.write(name, *args, out=out, **values)
