"""Differences between two copies of a table, row by row and field by field.

Copies may hold a key more than once. Identical rows cancel by multiplicity; what is left of a key is
paired so that the number of differing fields, summed over all pairs, is least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.session import materialise

#: Left classes times right classes of one key beyond which costs are looked up by shared values, not in a matrix.
PAIR_WORK = 20_000 * 20_000
#: Memberships of classes in groups of equal values that a task keeps, and those that it looks at together.
_MEMBERS, _PIECE = 1 << 24, 1 << 20
#: Bytes of the cost matrix that a task keeps; larger ones are computed row by row.
_KEPT = 64 << 20
_FAR = np.iinfo(np.int64).max


class _Matrix:
    """Costs by comparing each row with all columns; time goes with rows times columns times fields."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b, (self.n, self.fields), self.m = a, b, a.shape, b.shape[1]
        self.step = step = max(1, (1 << 22) // self.m)
        self.kept = None
        if self.n * self.m <= _KEPT and self.fields < 128:
            self.kept = np.concatenate([self._block(np.arange(i, min(i + step, self.n))).astype(np.int8) for i in range(0, self.n, step)])

    def _block(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), self.m), np.int16)
        for f in range(self.fields):
            out += self.a[which, f][:, None] != self.b[f][None, :]
        return out

    def _costs(self, which: np.ndarray) -> np.ndarray:
        return self.kept[which] if self.kept is not None else self._block(which)

    def least(self) -> np.ndarray:
        return np.concatenate([self._costs(np.arange(i, min(i + self.step, self.n))).min(1) for i in range(0, self.n, self.step)]).astype(np.int64)

    def start_raise(self) -> None:
        pass

    def relax(self, front: np.ndarray, u: np.ndarray, v: np.ndarray, level: int, key: np.ndarray) -> None:
        """Lower `key` of each column to its reduced cost from the rows in front, plus the level."""
        for i in range(0, len(front), self.step):
            part = front[i : i + self.step]
            np.minimum(key, (self._costs(part) - u[part][:, None]).min(0) - v + level, out=key)

    def start_fill(self, u: np.ndarray, v: np.ndarray, free: np.ndarray, entered: np.ndarray) -> None:
        self.u, self.v, self.free, self.entered, self.row = u, v, free, entered, -1

    def _first(self, row: int, also: np.ndarray) -> int:
        if row != self.row:
            self.row, self.good = row, (self._costs(np.array([row]))[0] - self.u[row] - self.v) == 0
        j = int((at := self.good & also).argmax())
        return j if at[j] else -1

    def first_free(self, row: int) -> int:
        """The first column at no reduced cost that has room, or -1."""
        return self._first(row, self.free > 0)

    def first_open(self, row: int) -> int:
        """The first column at no reduced cost that is not entered, or -1."""
        return self._first(row, ~self.entered)


def _pieces(starts: np.ndarray, which: np.ndarray) -> Iterator[np.ndarray]:
    """`which` in parts that hold about _PIECE memberships each."""
    held = np.cumsum(starts[which + 1] - starts[which])
    cuts = np.searchsorted(held, np.arange(_PIECE, held[-1] if len(held) else 0, _PIECE))
    return (part for part in np.split(which, np.unique(cuts)) if len(part))


def _ranges(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions from starts[w] up to starts[w + 1] for each w, and how many each w has."""
    counts = starts[which + 1] - starts[which]
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts[which] - ends + counts, counts), counts


def _starts(of: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


class _Shared:
    """The same costs by groups: for each set of fields the rows and columns that agree in all of them. A row and a
    column cost as many fields as there are, less those of the largest set in which they share a group. A group without
    a row or without a column is left out. Time and memory go with the memberships, not with rows times columns."""

    def __init__(self, a: np.ndarray, b: np.ndarray, members: int) -> None:
        (self.n, fields), self.m = a.shape, b.shape[1]
        ids = lambda k: np.arange(k, dtype=np.int32)
        todo, parts, base, offset = [(0, 0, ids(self.n), np.zeros(self.n, np.int32), ids(self.m), np.zeros(self.m, np.int32), 1)], [], [], 0
        while todo:
            f, size, rows, rg, cols, cg, count = todo.pop()
            members -= len(rows) + len(cols)
            if members < 0:
                raise OverflowError
            parts.append((rows, rg + offset, cols, cg + offset))
            base.append(np.full(count, fields - size, np.int64))  # what a row and a column cost that share this group and no larger one
            offset += count
            for g in range(f, fields):
                values = np.concatenate([rg, cg]).astype(np.int64) << 32 | np.concatenate([a[rows, g], b[g, cols]])
                seen, group = np.unique(values, return_inverse=True)
                r, c = group[: len(rows)], group[len(rows) :]
                both = (np.bincount(r, minlength=len(seen)) > 0) & (np.bincount(c, minlength=len(seen)) > 0)
                if both.any():
                    name, kr, kc = (np.cumsum(both) - 1).astype(np.int32), both[r], both[c]
                    todo.append((g + 1, size + 1, rows[kr], name[r[kr]], cols[kc], name[c[kc]], int(both.sum())))
        self.base = np.concatenate(base)
        rows, rg, cols, cg = (np.concatenate(p) for p in zip(*parts))
        del parts
        self.row_groups, self.row_starts = rg[np.argsort(rows, kind="stable")], _starts(rows, self.n)
        order = np.argsort(cg, kind="stable")
        self.columns, self.group_of, self.col_starts = cols[order], cg[order], _starts(cg, offset)

    def least(self) -> np.ndarray:
        return np.minimum.reduceat(self.base[self.row_groups], self.row_starts[:-1])  # each row is in the group of all

    def start_raise(self) -> None:
        self.best = np.full(len(self.base), _FAR)

    def relax(self, front: np.ndarray, u: np.ndarray, v: np.ndarray, level: int, key: np.ndarray) -> None:
        lowered = [np.zeros(0, np.int32)]
        for part in _pieces(self.row_starts, front):
            at, counts = _ranges(self.row_starts, part)
            groups = self.row_groups[at]
            values = self.base[groups] - np.repeat(u[part], counts) + level
            lower = values < self.best[groups]
            np.minimum.at(self.best, groups[lower], values[lower])
            lowered.append(np.unique(groups[lower]))
        for part in _pieces(self.col_starts, np.unique(np.concatenate(lowered))):
            at, counts = _ranges(self.col_starts, part)
            cols = self.columns[at]
            np.minimum.at(key, cols, np.repeat(self.best[part], counts) - v[cols])

    def start_fill(self, u: np.ndarray, v: np.ndarray, free: np.ndarray, entered: np.ndarray) -> None:
        """Columns of a group in lists, one for each potential; of a row the lists whose columns cost it nothing more."""
        low, wide = int(v.min()), int(v.max() - v.min()) + 1
        names = self.group_of.astype(np.int64) * wide + (v[self.columns] - low)
        order = np.lexsort((self.columns, names))
        self.sorted = memoryview(self.columns[order])
        lists, starts = np.unique(names[order], return_index=True)
        self.ends = memoryview(np.append(starts[1:], len(names)))
        self.at_free, self.at_open = memoryview(starts.copy()), memoryview(starts.copy())
        own, counts = [], np.zeros(self.n, np.int64)
        for part in _pieces(self.row_starts, np.arange(self.n)):
            at, each = _ranges(self.row_starts, part)
            row, groups = np.repeat(part, each), self.row_groups[at]
            want = self.base[groups] - u[row] - low
            name = groups.astype(np.int64) * wide + want
            place = np.minimum(np.searchsorted(lists, name), len(lists) - 1)
            there = (want >= 0) & (want < wide) & (lists[place] == name)
            own.append(place[there])
            counts += np.bincount(row[there], minlength=self.n)
        self.own, self.own_starts = np.concatenate(own), np.concatenate([[0], np.cumsum(counts)])
        self.free, self.entered = memoryview(free), memoryview(entered)

    def _first(self, row: int, heads: memoryview, passed: Callable[[int], bool]) -> int:
        found = -1
        for k in self.own[self.own_starts[row] : self.own_starts[row + 1]].tolist():
            at, end = heads[k], self.ends[k]
            while at < end and passed(self.sorted[at]):
                at += 1
            heads[k] = at
            if at < end and (found < 0 or self.sorted[at] < found):
                found = self.sorted[at]
        return found

    def first_free(self, row: int) -> int:
        return self._first(row, self.at_free, lambda j: self.free[j] == 0)

    def first_open(self, row: int) -> int:
        return self._first(row, self.at_open, self.entered.__getitem__)


def _costs(a: np.ndarray, b: np.ndarray, matrix: int) -> _Matrix | _Shared:
    if len(a) * b.shape[1] > matrix:
        try:
            return _Shared(a, b, _MEMBERS)
        except OverflowError:  # so many fields agree in so many ways that a matrix, row by row, takes less
            pass
    return _Matrix(a, b)


def min_cost_pairs(left: list[tuple], right: list[tuple], matrix: int = PAIR_WORK) -> list[tuple[int, int, int]]:
    """Pair two bags of field vectors at the least total number of differing fields.

    `left` and `right` hold (count, values). Returns (left index, right index, pairs); as many rows are
    paired as the smaller bag has.

    A minimum-cost assignment with multiplicities, primal-dual: shortest distances from all rows that are still
    alone raise the potentials until some place is free at no reduced cost; then alternating paths are
    filled until none is left at that level. Costs are whole numbers up to the number of fields, so there are few
    levels. Where left times right classes are more than `matrix`, costs come from groups of equal values instead of a
    matrix, if memory allows. Either way the same columns are met in the same order, so the pairs are the same.
    """
    if not left or not right:
        return []
    swap = sum(c for c, _ in left) > sum(c for c, _ in right)
    rows, cols = (right, left) if swap else (left, right)
    fields, n, m = len(rows[0][1]), len(rows), len(cols)
    a, b = np.zeros((n, fields), np.int32), np.zeros((fields, m), np.int32)
    for f in range(fields):
        code: dict = {}
        a[:, f] = [code.setdefault(v[f], len(code)) for _, v in rows]
        b[f] = [code.setdefault(v[f], len(code)) for _, v in cols]

    costs = _costs(a, b, matrix)
    alone, free = np.array([c for c, _ in rows]), np.array([c for c, _ in cols])
    u = costs.least()
    v = np.zeros(m, np.int64)
    flow: list[dict[int, int]] = [{} for _ in range(m)]  # of each column: rows with their amounts

    def raise_potentials() -> None:
        row_at, col_at, key = np.full(n, -1, np.int64), np.full(m, -1, np.int64), np.full(m, _FAR)
        level, front = 0, np.flatnonzero(alone)
        costs.start_raise()
        while True:
            row_at[front] = level
            costs.relax(front, u, v, level, key)
            open_ = np.where(col_at < 0, key, _FAR)
            level = int(open_.min())
            new = np.flatnonzero(open_ == level)
            col_at[new] = level
            if free[new].any():
                break
            front = np.unique(np.fromiter((i for j in new for i in flow[j] if row_at[i] < 0), np.int64))
        seen, got = row_at >= 0, col_at >= 0
        u[seen] += level - row_at[seen]
        v[got] -= level - col_at[got]

    def fill() -> None:
        """Alternating paths at no reduced cost, depth first; no row is used twice in a round without success."""
        entered, used = np.zeros(m, bool), np.zeros(n, bool)
        costs.start_fill(u, v, free, entered)
        for root in np.flatnonzero(alone):
            while alone[root]:
                path: list[tuple[int, int]] = []  # (row, the column by which it is left)
                row = int(root)
                while True:
                    used[row] = True
                    if (end := costs.first_free(row)) >= 0:
                        path.append((row, end))
                        break
                    onward = None
                    while onward is None and (j := costs.first_open(row)) >= 0:
                        onward = next(((i, j) for i in flow[j] if not used[i]), None)
                        if onward is None:
                            entered[j] = True
                    if onward is not None:
                        path.append((row, onward[1]))
                        row = onward[0]
                    elif path:
                        row = path.pop()[0]
                    else:
                        path = []
                        break
                if not path:
                    break
                amount = min(int(alone[root]), int(free[path[-1][1]]), *(flow[j][path[k + 1][0]] for k, (_, j) in enumerate(path[:-1])))
                for k, (i, j) in enumerate(path):
                    flow[j][i] = flow[j].get(i, 0) + amount
                    if k + 1 < len(path):
                        after = path[k + 1][0]
                        flow[j][after] -= amount
                        if not flow[j][after]:
                            del flow[j][after]
                alone[root] -= amount
                free[path[-1][1]] -= amount
                used[[i for i, _ in path]] = False

    while alone.any():
        raise_potentials()
        fill()
    return [(j, i, w) if swap else (i, j, w) for j, own in enumerate(flow) for i, w in sorted(own.items())]


def _differs(fields: Sequence[str], left: str, right: str) -> Column:
    return F.array_compact(F.array(*(F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields)))


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    return reduce(Column.__and__, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


_NAN = float("nan")


def _paired(groups: DataFrame, keys: Sequence[str], fields: Sequence[str], shape: str, matrix: int) -> DataFrame:
    """`keys`, `_l`, `_r`, `n`: the classes (`_row`, `_net`) of each key paired at the least cost, and what is left."""
    types = dict(groups.dtypes)
    schema = f"{', '.join(f'`{k}` {types[k]}' for k in keys)}, _l {shape}, _r {shape}, n long"

    def once(column: pa.Array) -> list:
        """The values of a column, equal ones as one object."""
        same: dict = {}
        return [_NAN if v != v else same.setdefault(v, v) for v in column.to_pylist()]

    def pair(table: pa.Table) -> pa.Table:
        row = pa.concat_arrays(table["_row"].chunks)
        row = row.cast(pa.struct([(f.name, f.type) for f in row.type]))
        values = list(zip(*(once(row.field(f)) for f in range(len(fields)))))
        net = table["_net"].to_pylist()
        order = sorted(range(len(net)), key=lambda i: repr(values[i]))
        ls, rs = [i for i in order if net[i] > 0], [i for i in order if net[i] < 0]
        lleft, rleft = [net[i] for i in ls], [-net[i] for i in rs]
        found = []
        for i, j, n in min_cost_pairs([(net[i], values[i]) for i in ls], [(-net[i], values[i]) for i in rs], matrix):
            found.append((ls[i], rs[j], n))
            lleft[i] -= n
            rleft[j] -= n
        found += [(ls[i], None, n) for i, n in enumerate(lleft) if n] + [(None, rs[j], n) for j, n in enumerate(rleft) if n]
        left, right, n = (pa.array(x, pa.int64()) for x in zip(*found))
        first = pa.array(np.zeros(len(found), np.int64))
        return pa.table({k: table[k].take(first) for k in keys} | {"_l": row.take(left), "_r": row.take(right), "n": n})

    return groups.select(*keys, "_row", "_net").groupBy(*keys).applyInArrow(pair, schema)


def cost_bounds(diff: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """`keys`, `n_pairs`, `cost` and `least` of the pairs in a result of diff_copies: the number of differing fields of
    all pairs, and a bound below which no pairing of the same rows can get: pairs that agree in a field are at
    most as many as both sides have rows of each value. Where both are equal the pairing is known to be optimal."""
    both = diff.where("left is not null and right is not null")
    total = both.groupBy(*keys).agg(F.sum("n").alias("n_pairs"), F.sum(F.col("n") * F.size("differing")).alias("cost"))
    sides = diff.where("left is not null").select(*keys, F.col("left").alias("_row"), F.col("n").alias("_a"), F.lit(0).alias("_b")).unionByName(diff.where("right is not null").select(*keys, F.col("right").alias("_row"), F.lit(0).alias("_a"), F.col("n").alias("_b")))
    values = sides.select(*keys, "_a", "_b", F.posexplode(F.array(*(F.to_json(F.struct(F.col(f"_row.{f}").alias("v"))) for f in fields))).alias("_f", "_v"))
    shared = values.groupBy(*keys, "_f", "_v").agg(F.least(F.sum("_a"), F.sum("_b")).alias("_s")).groupBy(*keys, "_f").agg(F.sum("_s").alias("_s"))
    bound = total.alias("t").join(shared.alias("s"), _same(keys, "t", "s")).select("t.*", F.greatest(F.col("t.n_pairs") - F.col("s._s"), F.lit(0)).alias("_m"))
    return bound.groupBy(*keys, "n_pairs", "cost").agg(F.sum("_m").alias("least"))


def diff_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], pair_work: int = PAIR_WORK) -> DataFrame:
    """Every difference between two copies: columns `keys`, `left`, `right` (structs of `fields`, null where
    the copy has no such row), `n` (how many rows are so paired) and `differing` (names of fields that
    differ; empty for a row that one copy lacks).

    Nulls in keys or fields equal nulls. Identical rows cancel as often as both copies have them, inside
    the same aggregation that counts them, so a shuffle carries one row for each distinct row of a copy.
    Keys with one leftover class a side, nearly all, are paired without leaving the JVM. Of other keys a task
    pairs one at the least cost, however many classes it has; `pair_work` (left classes times right ones) only tells from where on
    costs are looked up in another way, see min_cost_pairs. Other columns of the inputs, also ones of the same name in both, are left out.
    Empty inputs are fine.
    """
    keys, fields = list(keys), list(fields)
    row = F.struct(*(F.col(f) for f in fields)).alias("_row")
    sided = left.select(*keys, row, F.lit(1).cast("long").alias("_net")).unionByName(right.select(*keys, row, F.lit(-1).cast("long").alias("_net")))
    classes = sided.groupBy(*keys, "_row").agg(F.sum("_net").alias("_net")).where("_net <> 0")
    classes = materialise(classes)  # the leftovers alone, read by each of the ways below
    is_left = F.col("_net") > 0
    sums = classes.groupBy(*keys).agg(
        F.count_if(is_left).alias("_cl"), F.count_if(~is_left).alias("_cr"),
        F.max(F.when(is_left, F.struct("_row", "_net"))).alias("_l"), F.max(F.when(~is_left, F.struct("_row", "_net"))).alias("_r"),
    )
    shape = "struct<" + ",".join(f"`{f}`:{dict(left.dtypes)[f]}" for f in fields) + ">"
    none = F.lit(None).cast(shape)

    one = sums.where("_cl <= 1 and _cr <= 1")
    nl, nr = F.coalesce(F.col("_l._net"), F.lit(0)), F.coalesce(-F.col("_r._net"), F.lit(0))
    some = F.array_compact(F.array(
        F.when(F.least(nl, nr) > 0, F.struct(F.col("_l._row").alias("l"), F.col("_r._row").alias("r"), F.least(nl, nr).alias("n"))),
        F.when(nl > nr, F.struct(F.col("_l._row").alias("l"), none.alias("r"), (nl - nr).alias("n"))),
        F.when(nr > nl, F.struct(none.alias("l"), F.col("_r._row").alias("r"), (nr - nl).alias("n"))),
    ))
    simple = one.select(*keys, F.explode(some).alias("_p")).select(*keys, F.col("_p.l").alias("_l"), F.col("_p.r").alias("_r"), F.col("_p.n").alias("n"))

    pairs, many = simple, sums.where("_cl > 1 or _cr > 1").select(*keys)
    if many.agg(F.count("*").alias("c")).first()["c"]:  # keys with several leftover classes on a side are few, often none
        crowded = classes.alias("c").join(many.alias("m"), _same(keys, "c", "m"), "left_semi")
        pairs = pairs.unionByName(_paired(crowded, keys, fields, shape, pair_work))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return pairs.select(*keys, F.col("_l").alias("left"), F.col("_r").alias("right"), "n", F.when(both, _differs(fields, "_l", "_r")).otherwise(F.array().cast("array<string>")).alias("differing"))
