"""Statistics of many redraws of Inside / Outside without a copy of any row.

A redraw puts, in every stratum, as many rows Inside as there were: those with the smallest keys. The
keys of a row are cheap remixes of one hash of its id, one for each redraw, so membership is a
comparison with one limit per stratum and redraw. The limits are found first: rows count the keys
clearly below and send only those near the place where the quota must end. After that any task that
holds some rows and the limits knows the sides of its rows in all redraws, as a matrix of rows and
redraws. Sums of the rows' numbers over such a matrix are one product; ranked statistics run in score
order within ranges of scores and are carried from range to range as one vector of totals per redraw.

Strata of groups that share their draws meet in one task, where a key is worked out once for all of
them; those with the same rows and quota share their limits as well.

Tasks hold a bounded number of rows of one stratum or one range, however large a group is, and the
number of results depends on groups, ranges and redraws, not on rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.digests import md5_heads, xxhash64_on
from ..functions.joining import join_on
from ..sources.shared import materialise

#: Modulus of the remixed keys; a key has two numbers below it, of which the second breaks ties.
PRIME = (1 << 31) - 1
#: Rows of a stratum or range in a task, and rows and redraws compared at once.
TASK_ROWS, ROW_CHUNK, REDRAW_CHUNK = 20_000, 2048, 250
#: Rows whose remixed keys are worked out at once, so that the matrices stay in the cache.
KEY_ROWS = 128
#: Strata that meet in a task because they share their draws, and the rows of all of them, in tasks of one stratum.
SHARED_CELLS, SHARED_TASKS = 32, 10
#: Half width of the band in which a quota ends: standard deviations, and rows on top.
BAND = (6.0, 10.0)
MAX_TRIES = 10
#: Rank error of the quantiles that part the ranges: one in so many rows, for each range.
ACCURACY = 50


# --- keys ----------------------------------------------------------------------------------------


def key_parts(parts: list[Column]) -> list[Column]:
    """Three numbers below ``PRIME`` from a hash of the given columns."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    number = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(3)]
    return [number[0] % (PRIME - 1) + 1, number[1] % PRIME, number[2] % PRIME]


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """Make numbers smaller without a change of their remainders by ``PRIME``."""
    np.right_shift(x, 31, out=spare)
    np.bitwise_and(x, PRIME, out=x)
    np.add(x, spare, out=x)


def _remainder(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Remainders by ``PRIME`` of any unsigned numbers."""
    _fold(x, spare)
    _fold(x, spare)
    # a number below PRIME becomes very large
    np.subtract(x, PRIME, out=spare)
    return np.minimum(x, spare, out=x).view(np.int64)


def first_key(a: np.ndarray, b: np.ndarray, c: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """First number of the keys of rows (column vectors) in redraws (a row vector)."""
    a, b, c, draw = (np.asarray(v).astype(np.uint64) for v in (a, b, c, draw))
    u = a * (2 * draw + 1)
    spare = np.empty_like(u)
    u += b
    _fold(u, spare)
    _fold(u, spare)
    # u is below 2^31 + 2 and x below 2^33, so no product passes 2^64
    x = u * u
    x += c
    _fold(x, spare)
    x *= u
    x += a
    return _remainder(x, spare)


def second_key(first: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = first.astype(np.uint64) ** 2 + np.asarray(b).astype(np.uint64)
    return _remainder(x, np.empty_like(x))


class Remixed:
    """Keys remixed from three numbers of a row; groups are told apart by the columns hashed."""

    names = ("_a", "_b", "_c")
    block = KEY_ROWS

    def __init__(self, seed: int):
        self.seed = seed

    def columns(self, parts: list[Column]) -> list[Column]:
        return [p.alias(name) for p, name in zip(key_parts([*parts, F.lit(self.seed)]), self.names)]

    def numbers(self, rows: pd.DataFrame) -> list[np.ndarray]:
        return [rows[x].to_numpy(dtype=np.int64)[:, None] for x in self.names]

    def keys(self, numbers: list[np.ndarray], part: slice, draws: np.ndarray):
        """First numbers of the keys of some rows in some redraws, and a function of places that gives the second ones."""
        a, b, c = (x[part] for x in numbers)
        first = first_key(a, b, c, draws[None, :])
        return first, lambda i, j: second_key(first[i, j], b[i, 0])


class Hashed:
    """Keys that are the first 62 bits of ``md5`` or ``xxhash64`` of (id, keys, redraw, seed, attempt), as in ``order_key``.

    The redraw ``p`` in attempt ``t`` has the number p + t n.
    """

    names = ("_start", "_c")
    block = ROW_CHUNK

    def __init__(self, method: str, n: int, seed: int):
        if method not in ("md5", "xxhash64"):
            raise ValueError(f"unknown hash method {method!r}")
        self.method, self.n, self.seed = method, n, seed

    def columns(self, parts: list[Column]) -> list[Column]:
        start = F.xxhash64(*parts) if self.method == "xxhash64" else F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(""))
        return [start.alias("_start"), F.pmod(F.xxhash64(*parts), F.lit(PRIME)).alias("_c")]

    def numbers(self, rows: pd.DataFrame) -> list:
        if self.method == "xxhash64":
            return [rows["_start"].to_numpy(dtype=np.int64).astype(np.uint64)[:, None]]
        return [[x.encode() for x in rows["_start"]]]

    def keys(self, numbers: list, part: slice, draws: np.ndarray):
        perm, attempt = draws % self.n, draws // self.n
        if self.method == "md5":
            whole = md5_heads(numbers[0][part], [b"%d|%d|%d" % (p, self.seed, t) for p, t in zip(perm, attempt)])
        else:
            seed = np.array([[self.seed]])
            whole = xxhash64_on(xxhash64_on(numbers[0][part], perm[None, :]), seed, not -(1 << 31) <= self.seed < 1 << 31)
            whole = xxhash64_on(whole, attempt[None, :])
        whole = (whole >> np.uint64(2)).astype(np.int64)
        return whole >> 31, lambda i, j: whole[i, j] & PRIME


def key_sql(a: str, b: str, c: str, draw: str) -> str:
    """The whole key as a SQL expression."""
    u = f"(({a}) * (2 * ({draw}) + 1) + ({b})) % {PRIME}"
    w = f"(((({u}) * ({u}) + ({c})) % {PRIME}) * ({u}) + ({a})) % {PRIME}"
    return f"({w}) * 2147483648 + (({w}) * ({w}) + ({b})) % {PRIME}"


# --- layout --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Rows with numbers for their group and stratum.

    ``rows`` has (_row, _group, _cell, _share, _salt, what ``order`` makes keys from, values...), ``cells``
    (_group, _cell, _q, _m, _share, _tasks, _like) for each group and stratum, ``groups`` the keys of each group.
    Cells of one ``_share`` share their draws and meet in ``_tasks`` tasks, the ``_salt`` of a row; those of one
    ``_like`` have the same rows and quota.
    """

    rows: DataFrame
    cells: DataFrame
    groups: DataFrame
    order: Remixed | Hashed


def layout(
    strata: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    seed: int,
    id_col: str = "id",
    drawn_by: list[str] | None = None,
    order: Remixed | Hashed | None = None,
    optional: tuple[str, ...] = (),
) -> Layout:
    """Number groups and strata of (keys, id, stratum, inside, ...) and keep what the redraws need of each row.

    Rows with one id have one key and go together. A missing value is 0, but for ``optional`` ones, which are
    for least and largest only. A row's key depends on its id and on the columns ``drawn_by``, by default all
    keys: groups that differ only in other keys share their draws. Ranked statistics need remixed keys.
    """
    order = order or Remixed(seed)
    number = F.monotonically_increasing_id()
    by = keys if drawn_by is None else drawn_by
    alike = {"_x": F.bit_xor(F.xxhash64(id_col)), "_s": F.sum(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(PRIME)))} if set(by) != set(keys) else {}
    counted = strata.groupBy(*keys, "stratum").agg(
        F.count_if("inside").alias("_q"), F.count(F.lit(1)).alias("_m"), *[v.alias(k) for k, v in alike.items()]
    )
    counted = materialise(counted, "strata")
    groups = materialise(counted.select(*keys).distinct().withColumn("_group", number), "groups")
    cells = materialise(_shares(join_on(counted, groups, keys).withColumn("_cell", number), by, list(alike)), "cells")
    parts = order.columns([F.col(id_col), *[F.col(k) for k in by]])
    numbers = [(v.cast("double") if name in optional else F.coalesce(v.cast("double"), F.lit(0.0))).alias(name) for name, v in values.items()]
    kept = strata.select(*keys, "stratum", *parts, *numbers)
    rows = join_on(kept, cells.select(*keys, "stratum", "_group", "_cell", "_share", "_tasks"), [*keys, "stratum"])
    salt = F.pmod(F.col("_c"), F.col("_tasks")).cast("int").alias("_salt")
    rows = materialise(rows.select(number.alias("_row"), "_group", "_cell", "_share", salt, *order.names, *values), "redraw-rows")
    return Layout(rows, cells.select("_group", "_cell", "_q", "_m", "_share", "_tasks", "_like"), groups, order)


def _shares(cells: DataFrame, by: list[str], alike: list[str]) -> DataFrame:
    """Cells with ``_share``, ``_tasks`` and ``_like``; without ``alike`` every cell is by itself."""
    if not alike:
        own = F.col("_cell")
        return cells.withColumns({"_share": own, "_like": own, "_tasks": F.ceil(F.col("_m") / TASK_ROWS).cast("int")})
    place = F.row_number().over(W.partitionBy(*by, "stratum").orderBy("_q", "_m", *alike, "_cell"))
    cells = cells.withColumn("_batch", F.floor((place - 1) / SHARED_CELLS))
    batch, same = W.partitionBy(*by, "stratum", "_batch"), W.partitionBy(*by, "stratum", "_q", "_m", *alike)
    tasks = F.greatest(F.ceil(F.max("_m").over(batch) / TASK_ROWS), F.ceil(F.sum("_m").over(batch) / (SHARED_TASKS * TASK_ROWS)))
    return cells.withColumns({"_share": F.min("_cell").over(batch), "_tasks": tasks.cast("int"), "_like": F.min("_cell").over(same)})


_TASK = ["_share", "_salt"]


def _in_shares(rows: DataFrame, tasks: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of the rows of every task of a share and one row of ``tasks`` for each of its cells.

    Dealt to a set number of partitions: few bytes stand for much work, and would be put together.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = {c.split()[0]: [] for c in schema.split(", ")}
    dealt = rows.repartition(partitions, *_TASK)
    return dealt.groupBy(*_TASK).cogroup(tasks.groupBy(*_TASK)).applyInPandas(
        lambda r, p: make(r, p) if len(r) and len(p) else pd.DataFrame(empty, dtype=object), schema
    )


def _for_tasks(cells: DataFrame, *columns: str) -> DataFrame:
    """One row of ``columns`` for every task of a cell."""
    return cells.select("_share", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_salt"), "_cell", *columns)


class Members:
    """Cells of a task that have the same redraws: distinct rows by key, and which of them are in which cell."""

    def __init__(self, rows: pd.DataFrame, plan: pd.DataFrame, order: Remixed | Hashed):
        self.plan, self.order = plan.reset_index(drop=True), order
        self.draws = np.asarray(plan["_draws"].iloc[0], dtype=np.int64)
        at = self.plan["_cell"].to_numpy()
        by_cell = np.argsort(at)
        place = np.minimum(np.searchsorted(at[by_cell], rows["_cell"].to_numpy()), len(at) - 1)
        cell = by_cell[place]
        held = at[cell] == rows["_cell"].to_numpy()
        rows, cell = rows[held], cell[held]
        if len(at) == 1:
            self.rows, self.cell, self.which = rows, cell, np.arange(len(rows))
            self.distinct = rows
        else:
            which = rows.groupby(list(order.names), sort=False, dropna=False).ngroup().to_numpy()
            by_key = np.argsort(which, kind="stable")
            self.rows, self.cell, self.which = rows.iloc[by_key], cell[by_key], which[by_key]
            self.distinct = self.rows.iloc[np.flatnonzero(np.r_[True, self.which[1:] != self.which[:-1]])] if len(rows) else rows
        self.numbers = order.numbers(self.distinct)

    def blocks(self):
        """(first distinct row, their number, members as a slice) of some distinct rows at a time."""
        for s in range(0, len(self.distinct), self.order.block):
            n = min(self.order.block, len(self.distinct) - s)
            yield s, n, slice(*np.searchsorted(self.which, [s, s + n]))

    def chunks(self, s: int, n: int):
        """(slice of redraws, first numbers of keys, function of places that gives the second ones) of a block."""
        for d in range(0, len(self.draws), REDRAW_CHUNK):
            part = slice(d, min(d + REDRAW_CHUNK, len(self.draws)))
            yield part, *self.order.keys(self.numbers, slice(s, s + n), self.draws[part])


def _by_redraws(rows: pd.DataFrame, plan: pd.DataFrame, order: Remixed | Hashed):
    """``Members`` for each list of redraws in a plan."""
    lists = [np.asarray(x, dtype=np.int64).tobytes() for x in plan["_draws"]]
    for _, own in plan.groupby(lists, sort=False):
        yield Members(rows, own, order)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true places of a matrix."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _column_counts(mask: np.ndarray) -> np.ndarray:
    return mask.view(np.uint8).sum(axis=0, dtype=np.uint8 if len(mask) < 256 else np.int64)


# --- limits --------------------------------------------------------------------------------------


def _near(rows: pd.DataFrame, plan: pd.DataFrame, order: Remixed | Hashed) -> pd.DataFrame:
    """Of some rows of some strata: how many keys lie below the band of each redraw, and the keys within."""
    out = []
    for m in _by_redraws(rows, plan, order):
        cells, n_draws = len(m.plan), len(m.draws)
        low = np.maximum(m.plan["_low"].to_numpy(dtype=np.int64), 0)
        wide = (np.minimum(m.plan["_high"].to_numpy(dtype=np.int64), PRIME) - low).astype(np.uint64)
        below = np.zeros((cells, n_draws), dtype=np.int64)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(cells)]
        for s, n, own in m.blocks():
            of_cell = [m.which[own][m.cell[own] == k] - s for k in range(cells)]
            whole = [len(x) == n and bool((x == np.arange(n)).all()) for x in of_cell]
            for part, first, second in m.chunks(s, n):
                for k, at in enumerate(of_cell):
                    if not len(at):
                        continue
                    own_first = first if whole[k] else first[at]
                    below[k, part] += _column_counts(own_first < low[k])
                    i, j = _places((own_first - low[k]).view(np.uint64) <= wide[k])
                    found[k].append((j + part.start, (own_first[i, j] << 31) + second(at[i], j)))
        for k, cell in enumerate(m.plan["_cell"].tolist()):
            if not found[k]:
                continue
            where, keys = map(np.concatenate, zip(*found[k]))
            by_draw = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[by_draw], np.arange(1, n_draws))
            out.append(pd.DataFrame({"_cell": cell, "_place": np.arange(n_draws), "_below": below[k], "_keys": np.split(keys[by_draw], cuts)}))
    return pd.concat(out) if out else pd.DataFrame({"_cell": [], "_place": [], "_below": [], "_keys": []}, dtype=object)


def limits(lay: Layout, plan: DataFrame, band: tuple[float, float] | None = None) -> DataFrame:
    """(_group, _cell, _m, _draws, _limits): the largest Inside key of every redraw of every stratum.

    ``plan`` has (_group, _draws): the numbers of the redraws. A band that missed the end of a quota is
    made wider for its stratum.
    """
    deviations, extra = band or BAND
    order = lay.order
    rows = lay.rows.select("_cell", *_TASK, *order.names)
    # cells with the same rows, quota and redraws have the same limits
    every = join_on(lay.cells, plan, ["_group"]).withColumn("_rep", F.min("_cell").over(W.partitionBy("_like", "_draws")))
    every = materialise(every, "wanted")
    todo, wide, found = every.where("_cell = _rep"), 1.0, []
    while True:
        share = F.col("_q") / F.col("_m")
        margin = (F.lit(deviations) * F.sqrt(F.col("_m") * share * (1 - share)) + extra) / F.col("_m") * wide
        near = todo.withColumns({"_low": F.floor((share - margin) * PRIME).cast("long"), "_high": F.ceil((share + margin) * PRIME).cast("long")})
        tasks = _for_tasks(near, "_draws", "_low", "_high")
        own = rows.join(todo.select("_cell"), "_cell", "left_semi")
        each = _in_shares(own, tasks, lambda r, p: _near(r, p, order), "_cell long, _place int, _below long, _keys array<long>")
        met = each.groupBy("_cell", "_place").agg(F.sum("_below").alias("_below"), F.sort_array(F.flatten(F.collect_list("_keys"))).alias("_keys"))
        left = (F.col("_q") - F.col("_below")).cast("int")
        # none Inside: before all keys
        limit = F.when(F.col("_q") == 0, F.lit(-1).cast("long")).when((left >= 1) & (left <= F.size("_keys")), F.get("_keys", left - 1))
        ends = met.join(todo.select("_cell", "_q"), "_cell").select("_cell", "_place", limit.alias("_limit"))
        entry = F.sort_array(F.collect_list(F.struct("_place", "_limit")))
        listed = ends.groupBy("_cell").agg(entry.alias("_e")).select("_cell", F.col("_e._limit").alias("_limits"))
        out = materialise(todo.join(listed, "_cell"), "limits")
        held = ~F.exists("_limits", lambda x: x.isNull())
        found.append(out.where(held).select(F.col("_cell").alias("_rep"), "_limits"))
        todo = materialise(out.where(~held).drop("_limits"), "missed")
        if todo.isEmpty():
            limit = reduce(lambda a, b: a.unionByName(b), found)
            return every.join(limit, "_rep").select("_group", "_cell", "_share", "_tasks", "_draws", "_limits")
        wide *= 5


class Sides:
    """Which of some rows are Inside, for all redraws a chunk at a time; rows may be of several strata."""

    def __init__(self, rows: pd.DataFrame, plan: pd.DataFrame, order: Remixed | Hashed | None = None):
        self.order = order or Remixed(0)  # the seed is in the rows' numbers
        self.rows = len(rows)
        at = plan["_cell"].to_numpy()
        by_cell = np.argsort(at)
        stratum = by_cell[np.searchsorted(at[by_cell], rows["_cell"].to_numpy())]
        # rows of a stratum follow each other, so that its limits are compared as one line
        self.place = np.argsort(stratum, kind="stable")
        self.numbers = self.order.numbers(rows.iloc[self.place])
        self.starts = np.searchsorted(stratum[self.place], np.arange(len(at) + 1))
        self.draws = np.array([np.asarray(x) for x in plan["_draws"]], dtype=np.int64)[0]
        self.limits = np.array([np.asarray(x) for x in plan["_limits"]], dtype=np.int64)

    def chunks(self):
        """(slice of redraws, matrix of rows and redraws that is true Inside)."""
        for d in range(0, len(self.draws), REDRAW_CHUNK):
            part = slice(d, d + REDRAW_CHUNK)
            inside = np.empty((self.rows, len(self.draws[part])), dtype=bool)
            for k, (a, b) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist())):
                for s in range(a, b, self.order.block):
                    r = slice(s, min(s + self.order.block, b))
                    first, second = self.order.keys(self.numbers, r, self.draws[part])
                    inside[self.place[r]] = _is_inside(first, second, self.limits[k, part])
            yield part, inside


def _is_inside(first: np.ndarray, second, limit: np.ndarray) -> np.ndarray:
    """Rows of one stratum and redraws: whether the key is at most the limit of the redraw."""
    top = limit >> 31
    inside = first < top
    i, j = _places(first == top)
    if len(i):
        inside[i, j] = second(i, j) <= (limit[j] & PRIME)
    return inside


# --- sums over the sides ---------------------------------------------------------------------------


def _side_ends(rows: pd.DataFrame, column: np.ndarray, draws: np.ndarray, limit: np.ndarray, order: Remixed | Hashed) -> dict[str, np.ndarray]:
    """Least and largest value on both sides of every redraw, of some rows of a stratum; missing values are left out.

    Rows are looked at from both ends of their order, a few at first, until both sides were met.
    """
    by_value = np.argsort(column, kind="stable")[: len(column) - np.isnan(column).sum()]
    out = {f"{side}_{end}": np.full(len(draws), np.inf if end == "low" else -np.inf) for side in ("in", "out") for end in ("low", "high")}
    constant = len(by_value) > 0 and column[by_value[0]] == column[by_value[-1]]
    for end, line in (("low", by_value), ("high", by_value[::-1])):
        if end == "high" and constant:
            for k, side in enumerate(("in", "out")):
                out[f"{side}_high"][met[k]] = column[by_value[0]]
            break
        todo, at, size = np.arange(len(draws)), 0, 16
        met = np.zeros((2, len(draws)), dtype=bool)
        while len(todo) and at < len(line):
            some = line[at : at + size]
            first, second = order.keys(order.numbers(rows.iloc[some]), slice(0, len(some)), draws[todo])
            inside = _is_inside(first, second, limit[todo])
            for k, (side, matrix) in enumerate((("in", inside), ("out", ~inside))):
                new = matrix.any(axis=0) & ~met[k, todo]
                out[f"{side}_{end}"][todo[new]] = column[some[matrix[:, new].argmax(axis=0)]]
                met[k, todo[new]] = True
            todo, at, size = todo[~met[:, todo].all(axis=0)], at + size, min(2 * size, ROW_CHUNK)
    return out


def _sums(rows: pd.DataFrame, plan: pd.DataFrame, values: list[str], varied: list[str], order: Remixed | Hashed) -> pd.DataFrame:
    """Sums Inside of the values, and least and largest of the varied ones on both sides, of some rows of some strata."""
    out = []
    for m in _by_redraws(rows, plan, order):
        cells, n_draws = len(m.plan), len(m.draws)
        limits = np.array([np.asarray(x) for x in m.plan["_limits"]], dtype=np.int64)
        x = m.rows[values].to_numpy(dtype=np.float64)
        some = np.flatnonzero((x != 0).any(axis=0))
        x = np.concatenate([np.ones((len(x), 1)), x[:, some]], axis=1)
        # strata with the same limits have one matrix of sides
        same: dict[bytes, list[int]] = {}
        for k in range(cells):
            same.setdefault(limits[k].tobytes(), []).append(k)
        twice = len(np.unique(m.which * cells + m.cell)) < len(m.which)
        total = np.zeros((n_draws, cells, x.shape[1]))
        for s, n, own in m.blocks():
            block = np.zeros((n, cells, x.shape[1]))
            if twice:
                np.add.at(block, (m.which[own] - s, m.cell[own]), x[own])
            else:
                block[m.which[own] - s, m.cell[own]] = x[own]
            parts = [(ks, np.ascontiguousarray(block[:, ks].reshape(n, -1))) for ks in same.values()]
            for part, first, second in m.chunks(s, n):
                for ks, columns in parts:
                    inside = _is_inside(first, second, limits[ks[0], part])
                    total[part, ks] += (inside.T.astype(np.float64) @ columns).reshape(-1, len(ks), x.shape[1])
        group = dict(zip(rows["_cell"].to_numpy(), rows["_group"].to_numpy()))
        for k, cell in enumerate(m.plan["_cell"].tolist()):
            own = m.rows[m.cell == k]
            if not len(own):
                continue
            frame = {"_place": np.arange(n_draws), "in_n": total[:, k, 0]} | {f"in_{v}": np.zeros(n_draws) for v in values}
            for c, v in enumerate(some.tolist()):
                frame[f"in_{values[v]}"] = total[:, k, 1 + c]
            for v in varied:
                ends = _side_ends(own, own[v].to_numpy(dtype=np.float64), m.draws, limits[k], order)
                frame |= {f"{name[: name.index('_')]}_{v}{name[name.index('_') :]}": found for name, found in ends.items()}
            out.append(pd.DataFrame(frame).assign(_group=group[cell]))
    return pd.concat(out)


def side_sums(lay: Layout, ends: DataFrame, values: list[str], varied: list[str]) -> DataFrame:
    """(_group, _place, in_..., out_...): number of rows and sums of the values on both sides of every redraw.

    For ``varied`` values also the least and the largest of each side.
    """
    columns = ["in_n", *[f"in_{v}" for v in values]]
    extremes = [f"{side}_{v}_{end}" for side in ("in", "out") for v in varied for end in ("low", "high")]
    schema = "_group long, _place int, " + ", ".join(f"{c} double" for c in [*columns, *extremes])
    tasks = _for_tasks(ends, "_draws", "_limits")
    order = lay.order
    needed = list(dict.fromkeys([*values, *varied]))
    rows = lay.rows.select("_group", "_cell", *_TASK, *order.names, *needed)
    rows = rows.join(ends.select("_cell"), "_cell", "left_semi")
    each = _in_shares(rows, tasks, lambda r, p: _sums(r, p, values, varied, order), schema)
    least_or_most = [(F.min if c.endswith("low") else F.max)(c).alias(c) for c in extremes]
    inside = each.groupBy("_group", "_place").agg(*[F.sum(c).alias(c) for c in columns], *least_or_most)
    whole = lay.rows.groupBy("_group").agg(F.count(F.lit(1)).cast("double").alias("all_n"), *[F.sum(v).alias(f"all_{v}") for v in values])
    joined = inside.join(whole, "_group")
    rest = {f"out_{v}": F.col(f"all_{v}") - F.col(f"in_{v}") for v in ["n", *values]}
    return joined.withColumns(rest).drop(*[f"all_{v}" for v in ["n", *values]])


@dataclass(frozen=True)
class Drawn:
    """Redraws of a layout: ``sums`` (keys, perm, in_..., out_...), ``ends`` the limits by stratum, ``groups`` the keys."""

    lay: Layout
    sums: DataFrame
    ends: DataFrame


def draw(
    lay: Layout, keys: list[str], n: int, values: list[str], varied: list[str], by_stratum: bool = False, band: tuple[float, float] | None = None
) -> Drawn:
    """Sums of ``n`` redraws of every group; one without variety on a side is drawn again, ten times at most.

    The redraw ``perm`` in attempt ``t`` has the number perm + t n. ``by_stratum``: one of ``varied`` is the same
    in all rows of a stratum and differs between strata; a group with a side of one stratum, which no draw
    can vary, is not drawn again. ``band``: half width of the band in which a quota ends, by default ``BAND``.
    """
    ok = F.lit(True)
    for side in ("in", "out"):
        for v in varied:
            ok = ok & (F.col(f"{side}_{v}_low") < F.col(f"{side}_{v}_high"))
    plan = lay.groups.select("_group", F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")).alias("_draws"))
    fixed = (F.count_if(F.col("_q") > 0) < 2) | (F.count_if(F.col("_q") < F.col("_m")) < 2)
    stuck = lay.cells.groupBy("_group").agg((fixed & F.lit(by_stratum)).alias("_stuck")).where("_stuck").select("_group")
    sums, ends = [], []
    for attempt in range(MAX_TRIES):
        limit = materialise(limits(lay, plan, band), "limits")
        numbered = side_sums(lay, limit, values, varied).join(plan, "_group")
        number = F.get("_draws", F.col("_place"))
        each = materialise(numbered.withColumns({"_number": number, "perm": (number % n).cast("int")}).drop("_draws", "_place"), "side-sums")
        last = attempt == MAX_TRIES - 1
        again = each.where(~ok).join(stuck, "_group", "left_anti")
        good = each if last else each.where(ok).unionByName(each.where(~ok).join(stuck, "_group", "left_semi"))
        sums.append(good)
        ends.append(limit)
        if last:
            break
        again = again.groupBy("_group").agg(F.sort_array(F.collect_list(F.col("_number") + n)).alias("_draws"))
        plan = materialise(again, "again")
        if plan.isEmpty():
            break
    every = reduce(lambda a, b: a.unionByName(b), sums)
    named = join_on(every, lay.groups, ["_group"])
    # one list of redraws and limits for each stratum: of a redraw drawn again only the last attempt counts
    final = named.select("_group", "perm", "_number")
    entry = reduce(lambda a, b: a.unionByName(b), [e.select("_group", "_cell", F.explode(F.arrays_zip("_draws", "_limits")).alias("e")) for e in ends])
    entry = entry.select("_group", "_cell", F.col("e._draws").alias("_number"), F.col("e._limits").alias("_limit")).join(final, ["_group", "_number"])
    listed = F.sort_array(F.collect_list(F.struct("perm", "_number", "_limit")))
    per_cell = entry.groupBy("_group", "_cell").agg(listed.alias("e"))
    per_cell = per_cell.select("_group", "_cell", F.col("e._number").alias("_draws"), F.col("e._limit").alias("_limits"))
    return Drawn(lay, named.select(*keys, "perm", *[c for c in every.columns if c[:3] in ("in_", "out")]), materialise(per_cell, "limits"))


# --- ranked statistics -------------------------------------------------------------------------------


def _with_ranges(rows: DataFrame, score: str, tie: str | None = None) -> DataFrame:
    """Rows with ``_range``, which follows the order of the score, and ``_task``.

    A range holds about ``TASK_ROWS`` rows. A score that fills ranges by itself is a range of its own,
    an odd one, whose rows go to several tasks; with ``tie``, a number from 0 to 1, in its order.
    """
    rows = rows.drop(*_TASK)
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    most = math.ceil((sizes.agg(F.max("_rows")).first()[0] or 1) / TASK_ROWS)
    if most > 1:
        shares = F.array(*[F.lit(i / most) for i in range(1, most)])
        borders = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(score, shares, ACCURACY * most).alias("_all"))
        # a smaller group takes every so many of the quantiles
        own = F.ceil(F.col("_rows") / TASK_ROWS)
        borders = borders.select("_group", F.filter("_all", lambda x, i: F.floor((i + 1) * own / most) > F.floor(i * own / most)).alias("_all"))
    else:
        borders = sizes.select("_group", F.array().cast("array<double>").alias("_all"))
    borders = materialise(borders.withColumn("_borders", F.array_distinct("_all")), "borders")
    placed = rows.join(borders, "_group")
    times = F.size(F.filter("_all", lambda x: x == F.col(score)))
    placed = placed.withColumns({"_times": times, "_range": 2 * F.size(F.filter("_borders", lambda x: x < F.col(score)))})
    hot = F.col("_times") > 1
    task = F.pmod(F.col("_c"), F.col("_times")).cast("int") if tie is None else F.least(F.floor(F.col(tie) * F.col("_times")), F.col("_times") - 1).cast("int")
    placed = placed.withColumns({"_range": F.col("_range") + hot.cast("int"), "_task": F.when(hot, task).otherwise(0)})
    return materialise(placed.drop("_all", "_borders", "_times"), "score-ranges")


_AT = ["_group", "_range", "_task"]


def _range_tasks(rows: DataFrame, drawn: Drawn) -> DataFrame:
    """Limits of every stratum of the group, for each task of ``rows``."""
    tasks = rows.select(*_AT).distinct().join(drawn.ends, "_group").select(*_AT, "_cell", "_draws", "_limits")
    return materialise(tasks, "range-tasks")


def _in_tasks(rows: DataFrame, tasks: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of the rows of every task and what its redraws need.

    Dealt to a set number of partitions, as in ``_in_shares``.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = {c.split()[0]: [] for c in schema.split(", ")}
    dealt = rows.repartition(partitions, *_AT)
    return dealt.groupBy(*_AT).cogroup(tasks.groupBy(*_AT)).applyInPandas(lambda r, p: make(r, p) if len(r) and len(p) else pd.DataFrame(empty, dtype=object), schema)


def _tie_blocks(values: np.ndarray) -> list[tuple[int, int, bool]]:
    """Stretches (start, end, of one value) of sorted values, cut between different ones, of about ``KEY_ROWS`` rows."""
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]).tolist()
    out, start = [], 0
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > KEY_ROWS:
            if a > start:
                out.append((start, a, False))
            out.append((a, b, True))
            start = b
        elif b - start >= KEY_ROWS:
            out.append((start, b, False))
            start = b
    return out if start == len(values) else [*out, (start, len(values), False)]


def _concordant(rows: pd.DataFrame, plan: pd.DataFrame, score: str, label: str) -> pd.DataFrame:
    """Rows of both classes on both sides of every redraw in a range, and pairs in order within it, ties by half.

    Pairs Outside are all pairs, less those with their positive or their negative Inside, and those with both once more.
    """
    rows = rows.sort_values(score)
    sides = Sides(rows, plan)
    values, positive = rows[score].to_numpy(), rows[label].to_numpy() == 1
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    tied = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(values)]))
    p, q = np.add.reduceat(positive, starts, dtype=np.int64), np.add.reduceat(~positive, starts, dtype=np.int64)
    # pairs in order that a row is in
    pairs = np.where(positive, (q.cumsum() - 0.5 * q)[tied], (p.sum() - p.cumsum() + 0.5 * p)[tied])
    columns = np.stack([positive, ~positive, pairs], axis=1).astype(np.float64)
    blocks = []
    for a, b, one in _tie_blocks(values):
        above, below = np.flatnonzero(positive[a:b]), np.flatnonzero(~positive[a:b])
        x, y = values[a:b][above][:, None], values[a:b][below][None, :]
        order = None if one else (y < x).astype(np.float32) + np.float32(0.5) * (x == y)
        blocks.append((a, b, above, below, order))
    out = {"_place": np.arange(len(sides.draws))} | {f"{s}_{x}": np.zeros(len(sides.draws)) for s in ("in", "out") for x in "pqu"}
    for part, inside in sides.chunks():
        sums, u = np.zeros((3, inside.shape[1])), np.zeros(inside.shape[1])
        for a, b, above, below, order in blocks:
            own = columns[a:b].T @ inside[a:b].astype(np.float64)
            u += own[0] * sums[1]
            if order is None:
                u += 0.5 * own[0] * own[1]
            elif order.size:
                matrix = inside[a:b].astype(np.float32)
                met = order @ matrix[below]
                met *= matrix[above]
                u += met.sum(axis=0)
            sums += own
        out["in_p"][part], out["in_q"][part], out["in_u"][part] = sums[0], sums[1], u
        out["out_p"][part], out["out_q"][part] = p.sum() - sums[0], q.sum() - sums[1]
        out["out_u"][part] = pairs[positive].sum() - sums[2] + u
    return pd.DataFrame(out).assign(_group=rows["_group"].iloc[0], _range=rows["_range"].iloc[0])


def auc_per_redraw(drawn: Drawn, keys: list[str], score: str = "prob", label: str = "y") -> DataFrame:
    """(keys, perm, subset, value): area under the ROC curve of both sides of every redraw.

    Within a range pairs are counted in score order; pairs across ranges are the positives of a range
    times the negatives of all ranges before.
    """
    rows = _with_ranges(drawn.lay.rows, score)
    columns = [f"{s}_{x}" for s in ("in", "out") for x in "pqu"]
    schema = "_group long, _range int, _place int, " + ", ".join(f"{c} double" for c in columns)
    each = _in_tasks(rows, _range_tasks(rows, drawn), lambda r, p: _concordant(r, p, score, label), schema)
    totals = materialise(each.groupBy("_group", "_range", "_place").agg(*[F.sum(c).alias(c) for c in columns]), "pairs")
    before = W.partitionBy("_group", "_place").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sides = []
    for side, subset in (("in", "Inside"), ("out", "Outside")):
        p, q, u = (F.col(f"{side}_{x}") for x in "pqu")
        # all rows of an odd range are tied, in however many tasks they were
        within = F.when(F.col("_range") % 2 == 1, p * q / 2).otherwise(u)
        carried = totals.withColumn("_u", within + p * F.coalesce(F.sum(q).over(before), F.lit(0.0)))
        summed = carried.groupBy("_group", "_place").agg(F.sum("_u").alias("_u"), F.sum(p).alias("_p"), F.sum(q).alias("_q"))
        sides.append(summed.select("_group", F.col("_place").alias("perm"), F.lit(subset).alias("subset"), F.try_divide(F.col("_u"), F.col("_p") * F.col("_q")).alias("value")))
    return join_on(sides[0].unionByName(sides[1]), drawn.lay.groups, ["_group"]).select(*keys, "perm", "subset", "value")


def _counted(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    sides = Sides(rows, plan)
    n = np.concatenate([inside.sum(axis=0) for _, inside in sides.chunks()])
    return pd.DataFrame({"_place": np.arange(len(n)), "_n": n, "_rows": len(rows)}).assign(**{c: rows[c].iloc[0] for c in _AT})


def _offsets(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """For each task, by redraw: rows Inside before its range, before itself, in its range and in its group; and all rows alike."""
    n = _in_tasks(rows, tasks, _counted, "_group long, _range int, _task int, _place int, _n long, _rows long")
    n = materialise(n, "range-counts")
    draw = ["_group", "_place"]
    earlier = W.partitionBy(*draw).orderBy("_range").rangeBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*draw).orderBy("_range", "_task").rowsBetween(W.unboundedPreceding, -1)
    own, whole = W.partitionBy(*draw, "_range"), W.partitionBy(*draw)
    sums = {f"{name}{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("_n", "_rows") for name, w in (("earlier", earlier), ("before", before), ("own", own), ("whole", whole))}
    wide = n.select(*_AT, "_place", *[v.alias(k) for k, v in sums.items()])
    lists = F.sort_array(F.collect_list(F.struct("_place", *[c for c in sums if c.endswith("_n")])))
    packed = wide.groupBy(*_AT).agg(lists.alias("_e"), *[F.max(c).alias(c) for c in sums if c.endswith("_rows")])
    return packed.select(*_AT, *[F.col(f"_e.{c}").alias(c) if c.endswith("_n") else F.col(c) for c in sums])


def _side_offsets(plan: pd.DataFrame, part: slice, side: str) -> dict[str, np.ndarray]:
    """Offsets of a chunk of redraws for one side."""
    first = plan.iloc[0]
    inside = {k: np.asarray(first[f"{k}_n"], dtype=np.int64)[part] for k in ("earlier", "before", "own", "whole")}
    return inside if side == "in" else {k: int(first[f"{k}_rows"]) - v for k, v in inside.items()}


def _own_ranks(rows: pd.DataFrame, plan: pd.DataFrame, score: str):
    """(slice of redraws, inside, ranks) in chunks: twice the tie-averaged rank of each row on its own side, centred.

    ``rows`` are sorted by the score.
    """
    values, tied = rows[score].to_numpy(), rows["_range"].iloc[0] % 2 == 1
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    sizes = np.diff(np.r_[starts, len(values)])
    member = np.repeat(np.arange(len(starts)), sizes) if len(starts) < len(values) else slice(None)
    # of all rows, twice the mean place of a value; those Outside have what is left of it
    places = (2 * sizes.cumsum() - sizes).astype(np.int32)[:, None]
    for part, inside in Sides(rows, plan).chunks():
        at, away = _side_offsets(plan, part, "in"), _side_offsets(plan, part, "out")
        if tied:
            yield part, inside, np.where(inside, 2 * at["earlier"] + at["own"] - at["whole"], 2 * away["earlier"] + away["own"] - away["whole"]).astype(np.int32)
            continue
        count = inside.astype(np.int32) if len(starts) == len(values) else np.add.reduceat(inside, starts, axis=0, dtype=np.int32)
        own = count.cumsum(axis=0, dtype=np.int32)
        own *= 2
        own -= count
        left = places - own
        own += (2 * at["earlier"] - at["whole"]).astype(np.int32)
        left += (2 * away["earlier"] - away["whole"]).astype(np.int32)
        yield part, inside, np.where(inside, own[member], left[member])


def _rank_lists(rows: pd.DataFrame, plan: pd.DataFrame, score: str, other: str) -> pd.DataFrame:
    """Rows for the task of their other score, with their ranks in all redraws as 4-byte numbers."""
    rows = rows.sort_values(score)
    ranks = np.empty((len(rows), len(plan["_draws"].iloc[0])), dtype=np.int32)
    for part, _, own in _own_ranks(rows, plan, score):
        ranks[:, part] = own
    there = rows[["_group", "_other_range", "_other_task", "_cell", *Remixed.names, other]].set_axis([*_AT, "_cell", *Remixed.names, other], axis=1)
    return there.assign(_other=[r.tobytes() for r in ranks])


def _products(rows: pd.DataFrame, plan: pd.DataFrame, score: str) -> pd.DataFrame:
    """Sums of squares and products of two ranks on both sides of every redraw."""
    rows = rows.sort_values(score)
    n = len(plan["_draws"].iloc[0])
    out = {"_place": np.arange(n)} | {f"{s}_{x}": np.zeros(n) for s in ("in", "out") for x in ("xx", "yy", "xy")}
    others = rows["_other"].to_list()
    for part, inside, ranks in _own_ranks(rows, plan, score):
        # some rows at a time, which stay in the cache
        for s in range(0, len(rows), KEY_ROWS):
            x = np.frombuffer(b"".join(others[s : s + KEY_ROWS]), np.int32).reshape(-1, n)[:, part].astype(np.float64)
            y = ranks[s : s + KEY_ROWS].astype(np.float64)
            for side, matrix in (("in", inside[s : s + KEY_ROWS]), ("out", ~inside[s : s + KEY_ROWS])):
                a, b = x * matrix, y * matrix
                for name, one, two in (("xx", a, a), ("yy", b, b), ("xy", a, b)):
                    out[f"{side}_{name}"][part] += np.einsum("ij,ij->j", one, two)
    return pd.DataFrame(out).assign(_group=rows["_group"].iloc[0])


def spearman_per_redraw(drawn: Drawn, keys: list[str], x: str, y: str, where: Column | None = None) -> DataFrame:
    """(keys, perm, subset, value): Spearman correlation of two values on both sides of every redraw.

    In the order of the first value each row gets its ranks in all redraws as one list, with which it goes
    to its task in the order of the second one: lists are shuffled once and never written. Only rows for which
    ``where`` holds count.
    """
    rows = drawn.lay.rows if where is None else drawn.lay.rows.where(where)
    first, second = _with_ranges(rows, x), _with_ranges(rows, y)
    there = second.select("_row", F.col("_range").alias("_other_range"), F.col("_task").alias("_other_task"))
    placed = first.select("_row", *_AT, "_cell", *Remixed.names, *dict.fromkeys([x, y])).join(there, "_row")
    tasks = _range_tasks(first, drawn)
    plan = materialise(tasks.join(_offsets(first, tasks), _AT), "rank-plan")
    listed = f"_group long, _range int, _task int, _cell long, {', '.join(f'{c} long' for c in Remixed.names)}, {y} double, _other binary"
    lists = _in_tasks(placed, plan, lambda r, p: _rank_lists(r, p, x, y), listed)
    tasks = _range_tasks(second, drawn)
    plan = materialise(tasks.join(_offsets(second, tasks), _AT), "rank-plan")
    columns = [f"{s}_{p}" for s in ("in", "out") for p in ("xx", "yy", "xy")]
    schema = "_group long, _place int, " + ", ".join(f"{c} double" for c in columns)
    each = _in_tasks(lists, plan, lambda r, p: _products(r, p, y), schema)
    # written once, as both sides are read from it
    sums = materialise(each.groupBy("_group", F.col("_place").alias("perm")).agg(*[F.sum(c).alias(c) for c in columns]), "rank-sums")
    return _by_side(drawn, keys, sums, lambda s: F.try_divide(F.col(f"{s}_xy"), F.sqrt(f"{s}_xx") * F.sqrt(f"{s}_yy")))


def _by_side(drawn: Drawn, keys: list[str], sums: DataFrame, value) -> DataFrame:
    named = join_on(sums, drawn.lay.groups, ["_group"])
    sides = [named.select(*keys, "perm", F.lit(subset).alias("subset"), value(s).alias("value")) for s, subset in (("in", "Inside"), ("out", "Outside"))]
    return sides[0].unionByName(sides[1])


def _binned(rows: pd.DataFrame, plan: pd.DataFrame, variance: str, error: str, tie: str, bin_rows: int) -> pd.DataFrame:
    """Rows, squared errors and variances by bin of both sides of every redraw; a bin that is whole in the task goes in as terms.

    (_place, side, bin, n, e, v, terms, sum, infinite): bin -1 holds the sums over all whole bins.
    """
    rows = rows.sort_values([variance, tie])
    e, v = rows[error].to_numpy() ** 2, rows[variance].to_numpy()
    found: list[list] = [[] for _ in range(9)]
    for part, inside in Sides(rows, plan).chunks():
        for side, matrix in (("in", inside), ("out", ~inside)):
            at = _side_offsets(plan, part, side)
            for j in range(matrix.shape[1]):
                own = np.flatnonzero(matrix[:, j])
                if not len(own):
                    continue
                bins = max(int(at["whole"][j]) // bin_rows, 1)
                size, extra = divmod(int(at["whole"][j]), bins)
                place = at["before"][j] + np.arange(len(own))
                # the first bins hold one row more
                number = np.where(place < extra * (size + 1), place // (size + 1), extra + (place - extra * (size + 1)) // size)
                starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                n, bin_no = np.diff(np.r_[starts, len(own)]), number[starts]
                errors, variances = np.add.reduceat(e[own], starts), np.add.reduceat(v[own], starts)
                whole = n == size + (bin_no < extra)
                terms, total, infinite = _terms(n[whole], errors[whole], variances[whole])
                rest = np.flatnonzero(~whole)
                for column, value in zip(found, (part.start + j, side, -1, 0, 0.0, 0.0, terms, total, infinite)):
                    column.append(value)
                for k in rest.tolist():
                    for column, value in zip(found, (part.start + j, side, int(bin_no[k]), int(n[k]), errors[k], variances[k], 0, 0.0, False)):
                        column.append(value)
    names = ["_place", "side", "bin", "n", "e", "v", "terms", "sum", "infinite"]
    return pd.DataFrame(dict(zip(names, found))).assign(_group=rows["_group"].iloc[0])


def _terms(n: np.ndarray, errors: np.ndarray, variances: np.ndarray) -> tuple[int, float, bool]:
    """Number and sum of the bins' relative gaps, and whether a variance is infinite; 0 / 0 does not count."""
    rmse, rmv = np.sqrt(errors / n), np.sqrt(variances / n)
    if np.isinf(rmv).any():
        return 0, 0.0, True
    counts = (rmv > 0) | (rmse > 0)
    with np.errstate(divide="ignore"):
        gaps = np.abs(rmse - rmv)[counts] / rmv[counts]
    return int(counts.sum()), float(gaps.sum()), False


def ence_per_redraw(drawn: Drawn, keys: list[str], variance: str, error: str, tie: str, bin_rows: int = 20, where: Column | None = None) -> DataFrame:
    """(keys, perm, subset, value): expected normalised calibration error of both sides of every redraw.

    A side's bins are runs of about ``bin_rows`` rows in the order of variance. A task adds up the bins that
    it holds whole; those that go on in the next range are sent and added up there. Missing without
    rows and with an infinite variance. ``tie``, a number from 0 to 1, orders equal variances. Only rows for
    which ``where`` holds count.
    """
    rows = _with_ranges(drawn.lay.rows if where is None else drawn.lay.rows.where(where), variance, tie)
    tasks = _range_tasks(rows, drawn)
    plan = materialise(tasks.join(_offsets(rows, tasks), _AT), "rank-plan")
    schema = "_group long, _place int, side string, bin long, n long, e double, v double, terms long, sum double, infinite boolean"
    each = _in_tasks(rows, plan, lambda r, p: _binned(r, p, variance, error, tie, bin_rows), schema)
    bins = each.groupBy("_group", "_place", "side", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "e", "v", "terms", "sum")], F.bool_or("infinite").alias("infinite"))
    rmse, rmv = F.sqrt(F.col("e") / F.col("n")), F.sqrt(F.col("v") / F.col("n"))
    gap = F.when(rmv > 0, F.abs(rmse - rmv) / rmv).when(rmse > 0, F.lit(float("inf")))
    joined = F.col("bin") >= 0
    ends = bins.groupBy("_group", F.col("_place").alias("perm"), "side").agg(
        (F.sum("terms") + F.count_if(joined & gap.isNotNull())).alias("terms"),
        F.sum(F.when(joined, F.coalesce(gap, F.lit(0.0))).otherwise(F.col("sum"))).alias("sum"),
        F.bool_or(F.col("infinite") | (joined & (rmv == float("inf")))).alias("infinite"),
    )
    value = F.when(~F.col("infinite"), F.try_divide(F.col("sum"), F.col("terms").cast("double")))
    named = join_on(ends, drawn.lay.groups, ["_group"])
    return named.select(*keys, "perm", F.when(F.col("side") == "in", "Inside").otherwise("Outside").alias("subset"), value.alias("value"))
