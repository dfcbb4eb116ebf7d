"""Relational sketches: HyperLogLog registers, Count-Min cells and top-k, as tables that merge by max and by sum.

A stored state is a row for each tenant, day and kind, with its parameters and its used registers or cells, so it is
bounded by them whatever it counted. States of one key are deltas that merge: registers by maximum, cells and totals by
sum, and the names of top-k candidates, at most k of a state, by pooling; counts are read again from the merged cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.bounds import cms_size, hll_alpha, hll_precision
from tidewell.functions.scalar import cms_column, hll_index, hll_rank, json_string

KINDS = ("users", "events", "pages")
#: Parameters of stored states: precision, width and depth, and names that a top-k state holds.
P, (WIDTH, DEPTH), K = 14, cms_size(0.001, 0.01), 20
STATES = "tenant_id string, kind string, p int, width int, depth int, k int, total bigint, cells array<struct<pos: int, v: bigint>>, names array<string>, day date"


def sketch_items(ev: DataFrame) -> DataFrame:
    """(tenant, day, kind, item, n): what each day's sketches count. Pages are string paths of page views."""
    page = F.when(F.col("name") == "page_view", json_string(F.col("properties"), "path"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("item")) for k, c in zip(KINDS, (F.col("distinct_id"), F.col("name"), page))])
    rows = ev.select("tenant_id", "day", F.explode(kinds).alias("x")).select("tenant_id", "day", "x.kind", "x.item").where("item is not null")
    return rows.groupBy("tenant_id", "day", "kind", "item").agg(F.count("*").alias("n"))


def hll_registers(df: DataFrame, item: str, keys: list[str], p: int = 14) -> DataFrame:
    hll_precision(p)
    return df.groupBy(*keys, hll_index(F.col(item), p).alias("idx")).agg(F.max(hll_rank(F.col(item), p)).alias("rank"))


def hll_merge(registers: DataFrame, keys: list[str], p: int | None = None) -> DataFrame:
    """Registers of unions: the largest of each. Rows with a column p must be of one precision, that given or their own."""
    rank = F.max("rank")
    if "p" in registers.columns:
        rank = F.when((F.min("p") == F.max("p")) & (F.lit(True) if p is None else F.max("p") == p), rank).otherwise(F.raise_error(F.lit("registers of another precision")))
    return registers.groupBy(*keys, "idx").agg(rank.alias("rank"))


def hll_estimate(registers: DataFrame, keys: list[str], p: int = 14) -> DataFrame:
    """Keys and `estimate`: the raw estimate, or linear counting while it is small and registers are empty."""
    m = hll_precision(p)
    s = registers.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("__s"), F.count("*").alias("__n"))
    zeros = F.lit(m) - F.col("__n")
    raw = F.lit(hll_alpha(m) * m * m) / (zeros + F.col("__s"))
    return s.select(*keys, F.when((raw <= 2.5 * m) & (zeros > 0), m * F.ln(F.lit(float(m)) / zeros)).otherwise(raw).alias("estimate"))


def cms_cells(items: DataFrame, item: str, n: str, keys: list[str], width: int, depth: int) -> DataFrame:
    """Cells in use. A negative count is an error."""
    n = F.when(F.col(n) < 0, F.raise_error(F.lit("counts must not be negative"))).otherwise(F.col(n))
    rows = items.groupBy(*keys, item).agg(F.sum(n).alias("__n")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return rows.groupBy(*keys, "row", cms_column(F.col(item), F.col("row"), width).alias("col")).agg(F.sum("__n").alias("total"))


def cms_merge(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the joined streams. Rows with columns width and depth must agree in both."""
    if {"width", "depth"} <= set(cells.columns):
        same = (F.min("width") == F.max("width")) & (F.min("depth") == F.max("depth"))
        return cells.groupBy(*keys, "row", "col").agg(F.when(same, F.sum("total")).otherwise(F.raise_error(F.lit("cells of another width or depth"))).alias("total"))
    return cells.groupBy(*keys, "row", "col").agg(F.sum("total").alias("total"))


def cms_estimate(cells: DataFrame, items: DataFrame, item: str, keys: list[str], width: int, depth: int) -> DataFrame:
    """Keys, item and `estimate`, which is never below the true count."""
    asked = items.select(*keys, item).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("col", cms_column(F.col(item), F.col("row"), width))
    found = asked.join(cells, [*keys, "row", "col"], "left")
    return found.groupBy(*keys, item).agg(F.min(F.coalesce("total", F.lit(0))).alias("estimate"))


def top(counts: DataFrame, keys: list[str], item: str, n: str, k: int, order: tuple[Column, ...] | None = None) -> DataFrame:
    """The k largest counts of each key with their rank; equal counts by item unless another order is given."""
    w = Window.partitionBy(*keys).orderBy(*(order or (F.desc(n), F.asc(item))))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_merge(candidates: DataFrame, counts: DataFrame, keys: list[str], item: str, n: str, k: int) -> DataFrame:
    """Top k of pooled candidates by merged counts. At the cut, of equal counts the larger item stays; the result is ordered by count and item."""
    pool = candidates.select(*keys, item).distinct().join(counts, [*keys, item])
    kept = top(pool, keys, item, n, k, (F.desc(n), F.desc(item))).drop("rank")
    return top(kept, keys, item, n, k)


def states(items: DataFrame, *, p: int = P, width: int = WIDTH, depth: int = DEPTH, k: int = K) -> DataFrame:
    """Stored states of items (tenant, day, kind, item, n): registers of users, and Count-Min cells with the k best names of the rest.

    The items of a state are counted before they are added, so its candidates are the largest counts, of equal ones the
    smaller item. Total is the number of adds.
    """
    keys = ["tenant_id", "day", "kind"]
    users, rest = items.where("kind = 'users'"), items.where("kind <> 'users'")
    registers = hll_registers(users, "item", keys, p).select(*keys, F.col("idx").alias("pos"), F.col("rank").cast("bigint").alias("v"))
    cells = cms_cells(rest, "item", "n", keys, width, depth).select(*keys, (F.col("row") * width + F.col("col")).cast("int").alias("pos"), F.col("total").alias("v"))
    used = registers.unionByName(cells).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells"))  # at most 2^p or width * depth
    names = top(rest, keys, "item", "n", k).groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("names"))
    total = items.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = total.join(used, keys).join(names, keys, "left")
    size = [F.lit(x).cast("int").alias(c) for c, x in (("p", p), ("width", width), ("depth", depth), ("k", k))]
    return out.select("tenant_id", "kind", *size, "total", "cells", F.coalesce("names", F.array().cast("array<string>")).alias("names"), "day")


def _entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Merged cells (pos from 0), names (pos -1) and totals (pos -2) of states, whose parameters must agree."""
    none = F.lit(None).cast("string")
    cells = F.transform("cells", lambda c: F.struct(c["pos"].alias("pos"), c["v"].alias("v"), none.alias("name")))
    names = F.transform("names", lambda c: F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("bigint").alias("v"), c.alias("name")))
    total = F.array(F.struct(F.lit(-2).alias("pos"), F.col("total").alias("v"), none.alias("name")))
    sizes = ["p", "width", "depth", "k"]
    each = rows.select(*keys, *sizes, F.explode(F.concat(cells, names, total)).alias("x")).select(*keys, *sizes, "x.*")
    v = F.when(F.col("kind") == "users", F.when(F.col("pos") >= 0, F.max("v")).otherwise(F.sum("v"))).otherwise(F.sum("v"))
    return each.groupBy(*keys, "pos", "name").agg(v.alias("v"), *[f(c).alias(f"{c}{i}") for c in sizes for i, f in ((0, F.min), (1, F.max))])


def _checked(value: Column, **want: int) -> Column:
    """value, or an error where states of other parameters were merged."""
    same = F.lit(True)
    for c in ("p", "width", "depth", "k"):
        same &= F.min(f"{c}0") == F.max(f"{c}1")
        if c in want:
            same &= F.max(f"{c}1") == want[c]
    return F.when(same, value).otherwise(F.raise_error(F.lit("stored sketches have other parameters")))


def estimates(rows: DataFrame, keys: list[str], *, p: int = P, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """keys (with kind), total, `users` (the estimate of distinct items, of users alone) and `ranked` (item, n) of merged states.

    ranked has all pooled names with the counts that the merged cells give, the largest first, of equal ones the smaller item.
    """
    m = hll_precision(p)
    cell = F.col("pos") >= 0
    total = _checked(F.max(F.when(F.col("pos") == -2, F.col("v"))), p=p, width=width, depth=depth)
    out = _entries(rows, keys).groupBy(*keys).agg(
        total.alias("total"),
        F.count_if(cell).alias("__n"),
        F.sum(F.when(cell & (F.col("kind") == "users"), F.pow(F.lit(2.0), -F.col("v")))).alias("__s"),
        F.map_from_entries(F.collect_list(F.when(cell & (F.col("kind") != "users"), F.struct("pos", "v")))).alias("__cells"),
        F.collect_list(F.when(F.col("pos") == -1, F.col("name"))).alias("__names"),
    )
    zeros = F.lit(m) - F.col("__n")
    raw = F.lit(hll_alpha(m) * m * m) / (zeros + F.col("__s"))
    users = F.when((raw <= 2.5 * m) & (zeros > 0), m * F.ln(F.lit(float(m)) / zeros)).otherwise(raw)
    at = lambda x, r: (r * width + cms_column(x, r.cast("bigint"), width)).cast("int")
    count = lambda x: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.coalesce(F.try_element_at("__cells", at(x, r)), F.lit(0).cast("bigint"))))
    ranked = F.array_sort(F.transform("__names", lambda x: F.struct((-count(x)).alias("c"), x.alias("item"))))
    return out.select(*keys, "total", F.when(F.col("kind") == "users", users).alias("users"), F.transform(ranked, lambda x: F.struct(x["item"].alias("item"), (-x["c"]).alias("n"))).alias("ranked"))


def merged(rows: DataFrame, *, p: int = P, width: int = WIDTH, depth: int = DEPTH, k: int = K) -> DataFrame:
    """One state for each key of many, as they were stored. At the cut to k names, of equal counts the larger item stays."""
    keys = ["tenant_id", "day", "kind"]
    cells = _entries(rows, keys).where("pos >= 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells"))
    best = F.reverse(F.array_sort(F.transform("ranked", lambda x: F.struct(x["n"].alias("n"), x["item"].alias("item")))))
    names = F.array_sort(F.transform(F.slice(best, 1, k), lambda x: x["item"]))
    out = estimates(rows, keys, p=p, width=width, depth=depth).select(*keys, "total", names.alias("names")).join(cells, keys, "left")
    size = [F.lit(x).cast("int").alias(c) for c, x in (("p", p), ("width", width), ("depth", depth), ("k", k))]
    return out.select("tenant_id", "kind", *size, "total", "cells", "names", "day")
