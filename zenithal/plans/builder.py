"""From a SELECT's tree to a DataFrame.

Every table's columns get names of their own (r0__ra), so that references are never
ambiguous to Spark; filters that belong to one table are put on it before the joins,
and the rest is left to Catalyst. The engine itself only adds what Catalyst cannot know:
region filters and chunk lists, the cell join of near neighbours, and the match tables'
guard against doubled pairs.
"""

from __future__ import annotations

from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import CHILD, CHUNK, MATCH, SUB_CHUNK, Catalog, Table
from ..errors import AnalysisError, UnsupportedQueryError
from ..functions.registry import FunctionRegistry, domain_name
from ..operators.near_neighbour import LARGEST, near_join, near_listed, near_lists
from . import ast as A
from . import regions
from .parser import AGGREGATES
from .relations import check_local, key_edge

_SHOWN = 64


@dataclass
class Ref:
    """A table of FROM: its columns by lower-case name, and their names in the plan."""

    index: int
    alias: str
    table: Table
    df: DataFrame
    columns: dict[str, str] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    def col(self, name: str) -> Column:
        return F.col(self.columns[name.lower()])


class Builder:
    def __init__(self, catalog: Catalog, functions: FunctionRegistry, db: str | None, strict: bool = False, ignore_case: bool = False):
        self.catalog, self.functions, self.db = catalog, functions, db
        self.strict, self.ignore_case = strict, ignore_case
        self.refs: list[Ref] = []
        self.merged: dict[str, str] = {}  # columns that USING or NATURAL made one
        self.pruned: dict[int, set[int]] = {}  # chunks by reference, for explain and scheduling

    # ---- the whole statement

    def build(self, s: A.Select) -> DataFrame:
        self._check_names(s)
        for r in s.restrictors:
            regions.check(r.kind, r.args)
        if s.first is None:
            if s.where is not None or s.group_by or any(isinstance(i.expr, A.Star) for i in s.items):
                raise UnsupportedQueryError("a SELECT without FROM takes expressions only")
            return self.catalog.spark.range(1).select(*[self.value(i.expr).alias(n) for i, n in zip(s.items, self._names(s.items), strict=True)])
        for t in [s.first, *(j.table for j in s.joins)]:
            self._add(t)
        where = A.conjuncts(s.where)
        where = self._restrict(s, where)
        df = self._neighbours(s, where)
        if df is None:
            df = self._joined(s, where)
        else:
            where = [t for t in where if self._edge(t) is None]
        if where:
            df = df.where(_all([self.condition(c) for c in where]))
        items = self._expand(s.items)
        names = self._names(items)
        if s.group_by or s.having is not None or any(self._aggregates(i.expr) for i in items):
            df = self._aggregated(df, s, items)
        else:
            df = df.select(*[self.value(i.expr).alias(f"c{k}") for k, i in enumerate(items)])
        if s.distinct:
            df = df.distinct()
        if s.order_by:
            keys = [F.col(f"c{self._ordered(o, items, names)}") for o in s.order_by]
            df = df.orderBy(*[k.desc() if o.descending else k.asc() for k, o in zip(keys, s.order_by, strict=True)])
        if s.limit is not None:
            df = df.limit(s.limit)
        return df.toDF(*names)

    # ---- names

    def _check_names(self, s: A.Select) -> None:
        """Names that the select list has twice, by position; stars are skipped."""
        seen: dict[str, list[int]] = {}
        for k, i in enumerate([i for i in s.items if not isinstance(i.expr, A.Star)]):
            seen.setdefault((i.alias or "".join(i.text.split())).lower(), []).append(k + 1)
        twice = [f"'{n}' at positions: {' '.join(map(str, p))}" for n, p in sorted(seen.items()) if len(p) > 1]
        if twice:
            raise AnalysisError("Duplicate names detected in select expression, rewrite SQL query using alias: " + ", ".join(twice))

    def _names(self, items) -> list[str]:
        out = []
        for k, i in enumerate(items):
            if i.alias:
                out.append(i.alias)
            elif isinstance(i.expr, A.ColumnRef):
                out.append(i.expr.name)
            else:
                out.append(i.text if len(i.text) <= _SHOWN else f"valueExprAlias_{k + 1}")
        return out

    def _add(self, t: A.TableRef) -> None:
        table = self.catalog.table(t.name, t.db or self.db)
        if not self.catalog.database(table.db).published:
            raise AnalysisError(f"database {table.db} is not published")
        k, df = len(self.refs), table.df
        alias = t.alias or t.name
        if any(r.alias.lower() == alias.lower() for r in self.refs):
            raise AnalysisError(f"Not unique table/alias: '{alias}'")
        spec, have = table.spec, {c.lower() for c in df.columns}
        if spec.partitioned and CHUNK.lower() not in have and spec.lon and spec.lat:
            chunk, sub = self.catalog.database(table.db).chunker.columns(F.col(spec.lon), F.col(spec.lat))
            df = df.withColumns({CHUNK: chunk, SUB_CHUNK: sub})
        own = df.columns
        df = df.select(*[F.col(f"`{c}`").alias(f"r{k}__{c}") for c in own])
        self.refs.append(Ref(k, alias, table, df, {c.lower(): f"r{k}__{c}" for c in own}, own))

    def _owner(self, c: A.ColumnRef) -> tuple[Ref, str]:
        low = c.name.lower()
        if c.table is None:
            if low in self.merged:
                ref = next(r for r in self.refs if self.merged[low] == r.columns.get(low))
                return ref, ref.columns[low]
            owners = [r for r in self.refs if low in r.columns]
            if len(owners) > 1:
                raise AnalysisError(f"Column '{c.name}' is ambiguous")
        else:
            owners = [r for r in self.refs if r.alias.lower() == c.table.lower() and (c.db is None or r.table.db == c.db)]
            owners = owners or [r for r in self.refs if r.table.spec.name.lower() == c.table.lower() and (c.db is None or r.table.db == c.db)]
            if not owners:
                raise AnalysisError(f"Unknown table '{c.table}'")
            owners = [r for r in owners if low in r.columns]
        if not owners:
            raise AnalysisError(f"Unknown column '{c.name}'")
        return owners[0], owners[0].columns[low]

    def _expand(self, items) -> list[A.SelectItem]:
        out = []
        for i in items:
            if not isinstance(i.expr, A.Star):
                out.append(i)
                continue
            refs = [r for r in self.refs if i.expr.table is None or r.alias.lower() == i.expr.table.lower()]
            if not refs:
                raise AnalysisError(f"Unknown table '{i.expr.table}'")
            done = set()
            for r in refs:
                for c in r.order:
                    if c.lower() in self.merged and i.expr.table is None:
                        if c.lower() in done:
                            continue
                        done.add(c.lower())
                    out.append(A.SelectItem(A.ColumnRef(c, r.alias), None, c))
        return out

    def _ordered(self, o: A.OrderItem, items, names) -> int:
        """Position of the select item that ORDER BY names."""
        c = o.expr
        if c.table is None:
            for k, i in enumerate(items):
                if i.alias and i.alias.lower() == c.name.lower():
                    return k
        for k, i in enumerate(items):
            if isinstance(i.expr, A.ColumnRef) and i.expr.name.lower() == c.name.lower():
                if c.table is None and i.expr.table is None:
                    return k
                try:
                    if self._owner(i.expr)[1] == self._owner(c)[1]:
                        return k
                except AnalysisError:
                    if c.table is None:
                        return k
        raise AnalysisError(f"ORDER BY column '{c.name}' must match a column of the select list")

    # ---- restrictors and pruning

    def _restrict(self, s: A.Select, where: list) -> list:
        spatial = [r for r in self.refs if r.table.spec.partitioned]
        for r in s.restrictors:
            if not spatial:
                raise AnalysisError("Spatial restrictor without partitioned table.")
            for ref in spatial:
                spec = ref.table.spec
                if spec.lon and spec.lat:
                    ref.df = ref.df.where(regions.test(r.kind, r.args, ref.col(spec.lon), ref.col(spec.lat)))
                self._prune(ref, self._chunks(ref, r.kind, r.args))
        if not s.restrictors:
            lone = [x for x in map(self._region_test, where) if x]
            if len(lone) == 1:
                ref, kind, args = lone[0]
                self._prune(ref, self._chunks(ref, kind, args))
        for c in where:
            self._by_index(c)
        if len(self.refs) == 1 and (spec := self.refs[0].table.spec).role == MATCH:
            ref = self.refs[0]
            ref.df = ref.df.where(ref.col(spec.key).isNull() | (ref.col(spec.flag) != 2))
        return where

    def _region_test(self, term):
        """(reference, kind, constants) of a region test on a partitioned table's own position."""
        call = term
        if isinstance(term, A.Compare) and term.op == "=":
            sides = [x for x in (term.left, term.right) if isinstance(x, A.Call)]
            if len(sides) != 1 or A.Literal(1) not in (term.left, term.right):
                return None
            call = sides[0]
        if not isinstance(call, A.Call):
            return None
        known = domain_name(call.name) or ""
        kinds = {"s2ptinbox": "box", "s2ptincircle": "circle", "s2ptinellipse": "ellipse", "s2ptincpoly": "poly"}
        if known not in kinds or len(call.args) < 3 or not all(isinstance(a, A.ColumnRef) for a in call.args[:2]):
            return None
        if not all(isinstance(a, A.Literal) and isinstance(a.value, (int, float)) for a in call.args[2:]):
            return None
        ref = self._position(call.args[0], call.args[1])
        args = tuple(float(a.value) for a in call.args[2:])
        try:
            regions.check(kinds[known], args)
        except AnalysisError as e:
            if "Wrong number" in str(e):
                raise AnalysisError(f"Wrong number of arguments for {call.name}") from None
            return None
        return (ref, kinds[known], args) if ref is not None else None

    def _position(self, lon: A.ColumnRef, lat: A.ColumnRef) -> Ref | None:
        """The partitioned reference whose longitude and latitude these columns are."""
        (a, x), (b, y) = self._owner(lon), self._owner(lat)
        spec = a.table.spec
        if a is b and spec.partitioned and spec.lon and spec.lat and a.columns.get(spec.lon.lower()) == x and a.columns.get(spec.lat.lower()) == y:
            return a
        return None

    def _chunks(self, ref: Ref, kind: str, args: tuple) -> list[int]:
        """Chunks with rows of a region; children lie in their directors' chunks, so the region grows by how far they are from these."""
        far = self.catalog.placed(ref.table.path).reach if ref.table.spec.role == CHILD else 0.0
        return regions.chunks(kind, args, self.catalog.database(ref.table.db).chunker, far)

    def _prune(self, ref: Ref, chunks: list[int]) -> None:
        """Keep the chunks of a list: a partition filter where the table is stored by chunk."""
        now = self.pruned.get(ref.index)
        self.pruned[ref.index] = set(chunks) if now is None else now & set(chunks)
        if ref.table.path is not None and CHUNK.lower() in ref.columns:
            ref.df = ref.df.where(ref.col(CHUNK).isin(sorted(chunks)) if chunks else F.lit(False))

    def _by_index(self, term) -> None:
        """Chunks of keys that equal constants, from a director index."""
        if isinstance(term, A.Compare) and term.op == "=":
            sides = (term.left, term.right) if isinstance(term.left, A.ColumnRef) else (term.right, term.left)
            c, values = sides[0], [sides[1]]
        elif isinstance(term, A.In) and not term.negated:
            c, values = term.value, list(term.items)
        else:
            return
        if not isinstance(c, A.ColumnRef) or not all(isinstance(v, A.Literal) and v.value is not None for v in values):
            return
        ref, _ = self._owner(c)
        spec = ref.table.spec
        if not spec.partitioned or spec.key is None or spec.key.lower() != c.name.lower() or spec.role == MATCH:
            return
        if ref.table.path is None or CHUNK.lower() not in ref.columns or (spec.role == CHILD and self.catalog.placed(ref.table.path).orphans):
            return  # nothing to prune, or children without a director, which no index has
        index = self.catalog.index(ref.table.db, spec.director or spec.name)
        if index is not None:
            rows = index.where(F.col("key").isin([v.value for v in values])).select(CHUNK).distinct().collect()
            self._prune(ref, [r[0] for r in rows])

    # ---- joins

    def _near(self, term, here: list[Ref], new: Ref):
        """(left reference, radius, inclusive) if a term bounds the separation of the new table from one that is joined."""
        if not isinstance(term, A.Compare) or term.op not in ("<", "<=", ">", ">="):
            return None
        call, bound = (term.left, term.right) if term.op in ("<", "<=") else (term.right, term.left)
        if not isinstance(call, A.Call) or domain_name(call.name) != "angsep" or len(call.args) != 4 or not isinstance(bound, A.Literal):
            return None
        if not all(isinstance(a, A.ColumnRef) for a in call.args) or not isinstance(bound.value, (int, float)) or bound.value < 0:
            return None
        a, b = self._position(*call.args[:2]), self._position(*call.args[2:])
        if a is None or b is None or a is b:
            return None
        if b in here and a is new:
            a, b = b, a
        return (a, float(bound.value), term.op in ("<=", ">=")) if a in here and b is new else None

    def _edge(self, term) -> tuple[int, int, float, bool] | None:
        """(references, radius, inclusive) of a term that bounds the separation of two tables."""
        for b in self.refs:
            if x := self._near(term, [r for r in self.refs if r is not b], b):
                return x[0].index, b.index, x[1], x[2]
        return None

    def _neighbours(self, s: A.Select, where: list) -> DataFrame | None:
        """Two tables near a third: the pairs of one edge as lists beside the third's rows, which then meet the other table.

        None for other statements, and where a filter on one table or a key may leave few pairs to which the last table is added.
        """
        if len(self.refs) != 3 or any(j.kind not in ("comma", "cross") or j.on is not None for j in s.joins):
            return None
        edges = [e for e in map(self._edge, where) if e]
        rest = [t for t in where if self._edge(t) is None]
        if len(edges) != 2 or any(e[2] > LARGEST for e in edges):
            return None
        shared = set(edges[0][:2]) & set(edges[1][:2])
        if len(shared) != 1 or any(len(self._used(t)) < 2 or (isinstance(t, A.Compare) and t.op in ("=", "<=>")) for t in rest):
            return None
        if self.strict:
            self._check_local(s, where, [])
        middle = self.refs[shared.pop()]
        needed = self._needed(s, rest)
        place = lambda r: (r.col(r.table.spec.lon), r.col(r.table.spec.lat))
        slim = lambda r: r.df.select(*[c for c in r.df.columns if c in needed or c in (r.columns[r.table.spec.lon.lower()], r.columns[r.table.spec.lat.lower()])])
        base = slim(middle)
        if any(kind.startswith(("array", "map", "struct", "variant")) for _, kind in base.dtypes):
            return None  # rows with such values are not grouped
        (last, *at_last), (listed, *at_listed) = sorted(((self.refs[e[0] if e[1] == middle.index else e[1]], *e[2:]) for e in edges), key=lambda e: e[0].index)
        kept = [c for c in listed.df.columns if c in needed]
        df = near_lists(base, slim(listed), kept, place(middle), place(listed), *at_listed)
        df = near_listed(df, slim(last), place(middle), place(last), *at_last, dense=base)
        return df.withColumn("_near", F.explode("_near")).select(*[c for c in df.columns if c != "_near"], *[F.col("_near" if len(kept) == 1 else f"_near.{c}").alias(c) for c in kept])

    def _used(self, e) -> set[int]:
        return {self._owner(n)[0].index for n in A.walk(e) if isinstance(n, A.ColumnRef)}

    def _needed(self, s: A.Select, where: list) -> set[str]:
        """Names in the plan of the columns that a statement reads, besides those of other conditions."""
        out = set()
        for e in [*(i.expr for i in self._expand(s.items)), *where, *s.group_by, *([] if s.having is None else [s.having]), *(o.expr for o in s.order_by)]:
            for n in A.walk(e):
                if isinstance(n, A.ColumnRef):
                    with suppress(AnalysisError):  # an alias, or a name that is refused where it is read
                        out.add(self._owner(n)[1])
        return out

    def _equal(self, term, here: list[Ref], new: Ref) -> bool:
        if not (isinstance(term, A.Compare) and term.op in ("=", "<=>")):
            return False
        sides = [{self._owner(n)[0].index for n in A.walk(x) if isinstance(n, A.ColumnRef)} for x in (term.left, term.right)]
        return any(x and y == {new.index} and x <= {r.index for r in here} for x, y in (sides, sides[::-1]))

    def _joined(self, s: A.Select, where: list) -> DataFrame:
        df, here, edges = self.refs[0].df, [self.refs[0]], []
        for join, new in zip(s.joins, self.refs[1:], strict=True):
            if join.kind in ("left", "right") and not join.natural and self.strict:
                raise UnsupportedQueryError("outer joins with a condition are not supported in strict mode")
            if self.strict and ((join.kind == "left" and new.table.spec.partitioned and not any(r.table.spec.partitioned for r in here)) or (join.kind == "right" and not new.table.spec.partitioned and any(r.table.spec.partitioned for r in here))):
                raise AnalysisError("an outer join may not keep the rows of an unpartitioned table against a partitioned one")
            how = join.kind if join.kind in ("left", "right") else "inner"
            shared = [join.using] if join.using else [c for c in new.order if c.lower() in {x for r in here for x in r.columns} and c not in (CHUNK, SUB_CHUNK)] if join.natural else []
            on = []
            for c in shared:
                low = c.lower()
                left = next((r for r in here if low in r.columns), None)
                if left is None or low not in new.columns:
                    raise AnalysisError(f"Unknown column '{c}' in join")
                on.append(left.col(c) == new.col(c))
                edges.append((left, left.columns[low].split("__", 1)[1], new, c))
                self.merged.setdefault(low, new.columns[low] if how == "right" else left.columns[low])
            terms = A.conjuncts(join.on)
            free = terms + (where if how == "inner" else [])
            near = next((x for x in (self._near(t, here, new) for t in free) if x), None)
            keyed = bool(on) or any(self._equal(t, here, new) for t in free if how == "inner" or t in terms)
            if near and not keyed and how == "inner":
                left, radius, inclusive = near
                df = near_join(df, new.df, (left.col(left.table.spec.lon), left.col(left.table.spec.lat)), (new.col(new.table.spec.lon), new.col(new.table.spec.lat)), radius, inclusive)
                here.append(new)
                if terms:
                    df = df.where(_all([self.condition(t) for t in terms]))
                continue
            here.append(new)
            on += [self.condition(t) for t in terms]
            if how == "inner":  # what ties the tables may stand in WHERE as well
                on += [self.condition(t) for t in where if self._equal(t, here[:-1], new)]
            df = df.join(new.df, _all(on), how) if on else df.crossJoin(new.df)
        if self.strict:
            self._check_local(s, where, edges)
        return df

    def _check_local(self, s: A.Select, where: list, shared: list) -> None:
        edges = []
        for a, ca, b, cb in shared:
            if (w := key_edge(a, ca, b, cb)) is not None:
                edges.append((a.index, b.index, w))
        for t in where + [t for j in s.joins for t in A.conjuncts(j.on)]:
            if isinstance(t, A.Compare) and t.op == "=" and isinstance(t.left, A.ColumnRef) and isinstance(t.right, A.ColumnRef):
                (a, _), (b, _) = self._owner(t.left), self._owner(t.right)
                if a is not b and (w := key_edge(a, t.left.name, b, t.right.name)) is not None:
                    edges.append((a.index, b.index, w))
            for b in self.refs:
                if x := self._near(t, [r for r in self.refs if r is not b], b):
                    edges.append((x[0].index, b.index, x[1]))
        dbs = {r.table.db for r in self.refs if r.table.spec.partitioned}
        if len({tuple(sorted(self.catalog.family(d))) for d in dbs}) > 1:
            raise AnalysisError("the databases of the query have different partitionings")
        check_local(self.refs, edges, min((self.catalog.database(d).striping.overlap for d in dbs), default=0.0))

    # ---- aggregation

    def _aggregates(self, e) -> bool:
        return any(isinstance(n, A.Call) and n.name.lower() in AGGREGATES for n in A.walk(e))

    def _aggregated(self, df: DataFrame, s: A.Select, items: list[A.SelectItem]) -> DataFrame:
        by_alias = {i.alias.lower(): i.expr for i in items if i.alias}
        keys = []
        for g in s.group_by:
            if isinstance(g, A.ColumnRef) and g.table is None and g.name.lower() in by_alias and not any(g.name.lower() in r.columns for r in self.refs):
                g = by_alias[g.name.lower()]
            keys.append(self._plain(g))
        named = {k: f"g{n}" for n, k in enumerate(dict.fromkeys(keys))}
        df = df.withColumns({n: self.value(k) for k, n in named.items()}) if named else df
        made = [self.value(self._plain(i.expr), named).alias(f"c{k}") for k, i in enumerate(items)]
        if s.having is not None:
            made.append(self.condition(self._plain(self._unalias(s.having, by_alias)), named).alias("_having"))
        df = df.groupBy(*named.values()).agg(*made)
        if s.having is not None:
            df = df.where("_having")
        return df.select(*[f"c{k}" for k in range(len(items))])

    def _plain(self, e):
        """The tree with every column as table and name, so that equal expressions are equal."""

        def of(n):
            if isinstance(n, A.ColumnRef):
                ref, name = self._owner(n)
                return A.ColumnRef(name.split("__", 1)[1], ref.alias)
            return n

        return _map(e, of)

    def _unalias(self, e, by_alias: dict):
        return _map(e, lambda n: by_alias[n.name.lower()] if isinstance(n, A.ColumnRef) and n.table is None and n.name.lower() in by_alias else n)

    # ---- expressions

    def value(self, e, groups: dict | None = None, inside: bool = False) -> Column:
        """Column of a value. With groups: grouped expressions by name; columns outside of them take any value of the group."""
        if groups is not None and not inside and e in groups:
            return F.col(groups[e])
        if isinstance(e, A.Literal):
            return F.lit(e.value)
        if isinstance(e, A.ColumnRef):
            c = F.col(self._owner(e)[1])
            return c if groups is None or inside else F.any_value(c)
        if isinstance(e, A.Binary):
            return _binary(e.op, self.value(e.left, groups, inside), self.value(e.right, groups, inside))
        if isinstance(e, A.Call):
            if e.name.lower() in AGGREGATES:
                if groups is None or inside:
                    raise AnalysisError(f"Invalid use of the aggregate {e.name}")
                arg = F.lit(1) if isinstance(e.args[0], A.Star) else self.value(e.args[0], groups, inside=True)
                return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[e.name.lower()](arg)
            constants = [a.value if isinstance(a, A.Literal) else None for a in e.args]
            return self.functions.call(e.name, [self.value(a, groups, inside) for a in e.args], constants)
        raise UnsupportedQueryError("a condition stands where a value is needed")

    def condition(self, e, groups: dict | None = None) -> Column:
        v = lambda x: self.value(x, groups)
        if isinstance(e, A.And):
            return _all([self.condition(t, groups) for t in e.terms])
        if isinstance(e, A.Or):
            out = self.condition(e.terms[0], groups)
            for t in e.terms[1:]:
                out = out | self.condition(t, groups)
            return out
        if isinstance(e, A.Not):
            return ~self.condition(e.term, groups)
        if isinstance(e, A.Compare):
            a, b = v(e.left), v(e.right)
            if self.ignore_case and any(isinstance(x, A.Literal) and isinstance(x.value, str) for x in (e.left, e.right)):
                a, b = F.lower(a), F.lower(b)
            return {"=": a == b, "<=>": a.eqNullSafe(b), "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]
        if isinstance(e, A.In):
            if all(isinstance(i, A.Literal) and i.value is not None for i in e.items):
                found = v(e.value).isin([i.value for i in e.items])
            else:
                found = v(e.value) == v(e.items[0])
                for i in e.items[1:]:
                    found = found | (v(e.value) == v(i))
            return ~found if e.negated else found
        if isinstance(e, A.Between):
            found = v(e.value).between(v(e.low), v(e.high))
            return ~found if e.negated else found
        if isinstance(e, A.Like):
            found = (F.ilike if self.ignore_case else F.like)(v(e.value), v(e.pattern))
            return ~found if e.negated else found
        if isinstance(e, A.IsNull):
            return v(e.value).isNotNull() if e.negated else v(e.value).isNull()
        return v(e).cast("double") != 0  # a bare value holds when it is not 0


def _all(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def _binary(op: str, a: Column, b: Column) -> Column:
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if op == "/":
        return F.try_divide(a.cast("double"), b.cast("double"))
    if op in ("%", "mod"):
        return F.try_mod(a, b)
    if op == "div":
        q = F.try_divide(a.cast("double"), b.cast("double"))
        return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))
    if op in ("<<", ">>"):
        return F.call_function("shiftleft" if op == "<<" else "shiftright", a.cast("long"), b.cast("int"))
    a, b = a.cast("long"), b.cast("long")
    return {"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[op](b)


def _map(e, of):
    """A tree with every node replaced, leaves first."""
    if isinstance(e, (A.And, A.Or)):
        return type(e)(tuple(_map(t, of) for t in e.terms))
    if isinstance(e, A.Call):
        return of(A.Call(e.name, tuple(_map(a, of) for a in e.args), e.text))
    if isinstance(e, A.Binary):
        return of(A.Binary(e.op, _map(e.left, of), _map(e.right, of)))
    if isinstance(e, A.Compare):
        return A.Compare(e.op, _map(e.left, of), _map(e.right, of))
    if isinstance(e, A.In):
        return A.In(_map(e.value, of), tuple(_map(i, of) for i in e.items), e.negated)
    if isinstance(e, A.Between):
        return A.Between(_map(e.value, of), _map(e.low, of), _map(e.high, of), e.negated)
    if isinstance(e, A.Like):
        return A.Like(_map(e.value, of), _map(e.pattern, of), e.negated)
    if isinstance(e, A.IsNull):
        return A.IsNull(_map(e.value, of), e.negated)
    if isinstance(e, A.Not):
        return A.Not(_map(e.term, of))
    return of(e)
