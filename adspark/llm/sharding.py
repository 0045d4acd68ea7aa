"""Resharding with the fewest bytes moved.

The bytes of the old shards are the supplies and the capacities of the new ones the demands of a
flow network in which bytes that stay cost nothing and bytes that move cost one each. Its cheapest
flow (a few dozen numbers, solved on the driver) says how many bytes go from each old shard to each
new one. Rows of an old shard are laid out in hash order, in small blocks of known size; a transfer
is a run of that order. Only the blocks in which a run ends are looked at row by row, to place the
cuts so that the new sizes come out near equal. Rows then go to their shard by comparing two
numbers, without a join, and one shuffle writes the files.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import new_folder, parts, shuffles_freed, written

#: Rows of a block, on average; 2 blocks at most for each transfer are read on the driver.
BLOCK_ROWS = 2000
FILE_BYTES = 32 << 20


def cheapest_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j that move the fewest bytes (i = j stays).

    Successive shortest paths; the sums of both sides must agree.
    """
    if sum(supply) != sum(capacity):
        raise ValueError("supplies and capacities differ")
    n, m = len(supply), len(capacity)
    cost = {(i, j): int(i != j) for i in range(n) for j in range(m)}
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = list(supply), list(capacity)
    while any(left):
        # distances from all old shards with bytes left; old nodes are (0, i), new nodes (1, j)
        dist = {(0, i): 0 for i in range(n) if left[i]}
        before: dict = {}
        changed = True
        while changed:
            changed = False
            for (i, j), c in cost.items():
                a, b = (0, i), (1, j)
                if a in dist and dist[a] + c < dist.get(b, 1 << 60):
                    dist[b], before[b], changed = dist[a] + c, a, True
                if flow[i, j] and b in dist and dist[b] - c < dist.get(a, 1 << 60):
                    dist[a], before[a], changed = dist[b] - c, b, True
        end = min((x for x in dist if x[0] == 1 and room[x[1]]), key=lambda x: (dist[x], x))
        path, node = [], end
        while node in before:
            path.append((before[node], node))
            node = before[node]
        amount = min([left[node[1]], room[end[1]]] + [flow[b[1], a[1]] for a, b in path if a[0] == 1])
        for a, b in path:
            if a[0] == 0:
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[node[1]] -= amount
        room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


@dataclass
class Plan:
    """Where rows go: for each old shard, the runs of its hash order as (last key, new shard)."""

    flow: dict[tuple[int, int], int]
    runs: dict[int, list[tuple[int | None, int]]]
    #: single rows of the cut blocks that go elsewhere: old shard -> key -> new shard
    single: dict[int, dict[int, int]] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)

    @property
    def moved(self) -> int:
        return sum(v for (i, j), v in self.flow.items() if i != j)

    @property
    def affected(self) -> list[int]:
        """New shards whose files change."""
        return sorted({x for i, j in self.flow if i != j for x in (i, j)})

    def route(self, old: Column, key: Column) -> Column:
        """New shard of a row."""
        shard = F.lit(None).cast("int")
        for i, runs in sorted(self.runs.items()):
            inner = F.lit(runs[-1][1])
            for last, j in reversed(runs[:-1]):
                inner = F.when(key <= last, j).otherwise(inner)
            elsewhere = defaultdict(list)
            for k, j in self.single.get(i, {}).items():
                elsewhere[j].append(k)
            for j, keys in sorted(elsewhere.items()):
                inner = F.when(key.isin(keys), j).otherwise(inner)
            shard = F.when(old == i, inner).otherwise(shard)
        return shard.cast("int")


def _even_out(plan: Plan, spots: dict[tuple[int, int], dict[int, int]], dests: dict[tuple[int, int], set[int]], target: list[int]) -> None:
    """Send single rows of the cut blocks to another run's shard until sizes meet their targets.

    ``spots`` holds key -> size for each cut block. Rows go from the fuller to the emptier of the
    shards that share a block, largest first, never past the middle; this ends as the spread falls.
    """
    over = [plan.sizes[j] - t for j, t in enumerate(target)]
    at = {spot: {k: plan_shard(plan.runs[spot[0]], k) for k in rows} for spot, rows in spots.items()}
    order = {spot: sorted(rows, key=lambda k, rows=rows: (-rows[k], k)) for spot, rows in spots.items()}
    for _ in range(30):
        before = list(over)
        for spot, rows in spots.items():
            for a, b in permutations(sorted(dests[spot]), 2):
                want = (over[a] - over[b]) // 2
                for key in order[spot]:
                    if at[spot][key] == a and 0 < rows[key] <= want:
                        at[spot][key] = b
                        over[a], over[b], want = over[a] - rows[key], over[b] + rows[key], want - rows[key]
                # or a row changes places with a smaller one, which brings the two closer than any single row
                small = sorted((rows[k], k) for k in rows if at[spot][k] == b)
                for key in order[spot] if small and want > 0 else ():
                    other = bisect_left(small, (rows[key] - want,))
                    if at[spot][key] == a and other < len(small) and 0 < (gain := rows[key] - small[other][0]) <= want:
                        at[spot][key], at[spot][small[other][1]] = b, a
                        over[a], over[b] = over[a] - gain, over[b] + gain
                        break
        if over == before:
            break
    for (i, _), keys in at.items():
        for key, j in keys.items():
            if j != plan_shard(plan.runs[i], key):
                plan.single.setdefault(i, {})[key] = j
    plan.sizes = {j: t + o for j, (t, o) in enumerate(zip(target, over))}


def plan_shard(runs: list[tuple[int | None, int]], key: int) -> int:
    return next(j for last, j in runs if last is None or key <= last)


def _cut(rows: dict[int, int], start: int, at: int) -> tuple[int, int]:
    """Last key before the cut nearest to byte ``at`` of a block that begins at byte ``start``, and that byte."""
    best, run = (min(rows) - 1, start), start
    for key in sorted(rows):
        run += rows[key]
        if abs(run - at) < abs(best[1] - at):
            best = (key, run)
    return best


def plan_reshard(keyed: DataFrame, old_shards: int, shards: int, capacities: list[int] | None = None) -> Plan:
    """Plan from a table of (old int, key long, size long).

    To the driver go one row per old shard and the rows of the blocks in which runs end: fewer than
    ``old_shards + shards`` blocks of about ``BLOCK_ROWS`` rows.
    """
    blocks = parts(keyed.count(), 1, BLOCK_ROWS)
    # blocks follow the order of the keys: equal slices of the range of the upper 32 bits
    slot = F.shiftright("key", 32) + F.lit(1 << 31)
    laid = keyed.withColumn("block", F.shiftright(slot * F.lit(blocks).cast("long"), 32))
    before = W.partitionBy("old").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = laid.groupBy("old", "block").agg(F.sum("size").alias("bytes"))
    table = written(sums.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "blocks")

    supply = [0] * old_shards
    for row in table.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect():
        supply[row["old"]] = row["bytes"]
    total = sum(supply)
    target = capacities or [total // shards + (j < total % shards) for j in range(shards)]
    plan = Plan(cheapest_flow(supply, target), {}, sizes=dict(enumerate(target)))

    ends: dict[int, list[tuple[int, int]]] = {}
    for i in range(old_shards):
        runs = sorted((j != i, j, v) for (a, j), v in plan.flow.items() if a == i)
        at, ends[i] = 0, []
        for _, j, v in runs:
            at += v
            ends[i].append((at, j))
    inner = [(i, at) for i, runs in ends.items() for at, _ in runs[:-1]]
    holds = F.lit(False)
    for i, at in inner:
        holds = holds | ((F.col("old") == i) & (F.col("start") < at) & (F.lit(at) <= F.col("start") + F.col("bytes")))
    cut_blocks = {(r["old"], r["block"]): (r["start"], r["bytes"]) for r in table.where(holds).collect()}
    spots: dict[tuple[int, int], dict[int, int]] = {spot: defaultdict(int) for spot in cut_blocks}
    if cut_blocks:
        inside = F.lit(False)
        for i, b in cut_blocks:
            inside = inside | ((F.col("old") == i) & (F.col("block") == b))
        for r in laid.where(inside).select("old", "block", "key", "size").collect():
            spots[r["old"], r["block"]][r["key"]] += r["size"]

    dests: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, runs in ends.items():
        if runs:
            plan.runs[i] = []
        for (at, j), (_, after) in zip(runs, runs[1:]):
            spot, start = next((s, x[0]) for s, x in cut_blocks.items() if s[0] == i and x[0] < at <= sum(x))
            key, real = _cut(spots[spot], start, at)
            plan.runs[i].append((key, j))
            plan.sizes[j] += real - at
            plan.sizes[after] -= real - at
            dests[spot] |= {j, after}
        if runs:
            plan.runs[i].append((None, runs[-1][1]))
    _even_out(plan, spots, dests, target)
    return plan


def rewrite(routed: DataFrame, folder: str, shards: list[int] | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write the rows of (shard, key, size, ...) as files ``shard=N/...``, in hash order within a file.

    ``shards`` limits the work to shards whose content changes (``Plan.affected``). A shard is cut
    into files by its hash order, so that a large shard is written by many tasks.
    """
    if shards is not None:
        routed = routed.where(F.col("shard").isin(shards))
    largest = routed.groupBy("shard").agg(F.sum("size").alias("b")).agg(F.max("b"), F.count("b")).first()
    files = parts(largest[0] or 0, 1, file_bytes)
    piece = F.shiftright((F.shiftright("key", 32) + F.lit(1 << 31)) * F.lit(files).cast("long"), 32)
    dealt = routed.repartition(max(1, files * largest[1]), "shard", piece).sortWithinPartitions("shard", "key")
    with shuffles_freed(routed.sparkSession):
        dealt.drop("key", "size").write.option("compression", "zstd").partitionBy("shard").parquet(folder)


def read_shards(spark, folder: str, schema: str) -> DataFrame:
    """Rows of a shard folder with ``slot``, the row's place in its shard: files by name, then rows."""
    stored = spark.read.schema(f"{schema}, shard int").parquet(folder)
    placed = stored.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    earlier = W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = placed.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return placed.join(files, "file").withColumn("slot", F.col("start") + F.col("row")).drop("file", "row", "start")


def reshard(
    docs: DataFrame,
    old_shard: Column,
    old_shards: int,
    shards: int,
    capacities: list[int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[Plan, DataFrame]:
    """Move documents from old shards to new ones; returns the plan and the rows read from the new files.

    ``old_shard`` must be an int from 0 up to ``old_shards`` for every row. The size of a row is its
    UTF-8 bytes plus 8. Columns of the result: doc_id, text, shard, slot; other input columns are
    left out. Repeated rows (same id and text) count one by one but go to one shard together; NULL
    texts weigh 8 bytes and stay NULL; an empty table gives no files and no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    keyed = docs.select(
        old_shard.cast("int").alias("old"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
        size.alias("size"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    plan = plan_reshard(written(keyed.select("old", "key", "size"), "shard-keys"), old_shards, shards, capacities)
    folder = new_folder(spark, "shards")
    rewrite(keyed.withColumn("shard", plan.route(F.col("old"), F.col("key"))).drop("old"), folder)
    kind = docs.schema[id_col].dataType.simpleString()
    return plan, read_shards(spark, folder, f"doc_id {kind}, text string")


SHARDS, OLD_SHARDS = 24, 20


def op2_reshard(spark, folder: str) -> DataFrame:
    """``documents``, kept in 20 shards by source, into 24 of near equal bytes."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    _, placed = reshard(docs, old, OLD_SHARDS, SHARDS)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
