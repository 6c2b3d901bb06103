"""Exact nearest neighbours inside groups by a metric index.

A bounded sample of each group gives it pivots and a rotation to principal
coordinates; any choice is right, a good one saves work. Rows go to the cell of
their nearest pivot and, in order of the distance to it, to blocks of bounded
size. Each row's nearest in its own block is a bound. A block's rows need another
block only if, by the triangle inequality, some row may be within its bound: not
if all their distances to the other's pivot lie beyond that block's ring widened
by the bound. Of two blocks that meet, a pair of rows is compared in full only if
its distance in the leading coordinates, with the difference of what is left, is
within the bound. No group is held by one task; what one task holds is two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.operators.ordering import number_rows
from lithic.saved import save

#: rows of a block, rows of a group that its model is made of, pivots of a group, share of the coordinates that lead
BLOCK, SAMPLE, PIVOTS, LEADING = 512, 1024, 32, 0.75
#: rows that are placed together
TOGETHER = 16384
#: rounding must not shut a winner or a tie out: of squared distances, and a share of the squared lengths
SLACK, ROUNDING = 4e-9, 1e-12


def _matrix(column) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed in the order of the components."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += (x[:, k] - y[:, k]) ** 2
    return total


def _all_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances between two sets, up to rounding."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)


def _model(table: pa.Table) -> pa.Table:
    """Pivots and rotation of a group from its sample."""
    v = _matrix(table.column("v"))
    middle = v.mean(axis=0)
    _, _, axes = np.linalg.svd(v - middle, full_matrices=True)
    pivots = v[: max(1, min(PIVOTS, len(v) // 8))]
    out = [table.column("group").slice(0, 1), table.column("n").slice(0, 1), *(pa.array([x.tobytes()]) for x in (pivots - middle, axes.T, middle))]
    return pa.table(out, names=["group", "n", "pivots", "axes", "middle"])


def _place(rows: pa.Table, model: pa.Table) -> pa.Table:
    """Rows with their cell, the distances to all pivots and the rotated vector in two parts."""
    v = _matrix(rows.column("v"))
    v = v - np.frombuffer(model.column("middle")[0].as_py()) if len(v) else v
    pivots = np.frombuffer(model.column("pivots")[0].as_py()).reshape(-1, v.shape[1])
    axes = np.frombuffer(model.column("axes")[0].as_py()).reshape(v.shape[1], -1)
    far = np.sqrt(_all_squares(v, pivots))
    cell = far.argmin(axis=1)
    turned = v @ axes
    leading = max(1, int(v.shape[1] * LEADING))
    rest = np.sqrt((turned[:, leading:] ** 2).sum(axis=1))
    out = [rows.column("group"), rows.column("id"), rows.column("v"), pa.array(cell.astype(np.int64)), pa.array(far[np.arange(len(v)), cell]), _lists(far), _lists(np.column_stack([turned[:, :leading], rest]))]
    return pa.table(out, names=["group", "id", "v", "cell", "r", "far", "lead"])


def _closest(ids: np.ndarray, d: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ids its least (d, other), d as it will be shown."""
    order = np.lexsort((other, np.round(d, 9), ids))
    ids, d, other = ids[order], d[order], other[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, dtype=bool)
    return ids[first], d[first], other[first]


def _compare(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Finds (id, d, other) of both sides of two blocks, and how many pairs were compared in full."""
    bound = _all_squares(a["lead"], b["lead"])
    if a is b:
        np.fill_diagonal(bound, np.inf)
    slack = SLACK + ROUNDING * ((a["lead"] ** 2).sum(axis=1).max(initial=0) + (b["lead"] ** 2).sum(axis=1).max(initial=0))
    reach = []
    for one, two, least in ((a, b, bound), (b, a, bound.T)):  # the pair that looks closest tightens the bound first
        likely = least.argmin(axis=1)
        reach.append(np.minimum(one["reach"], np.where(np.isfinite(least.min(axis=1)), _squares(one["v"], two["v"][likely]), np.inf)))
    wanted = np.argwhere((bound <= reach[0][:, None] * (1 + 1e-9) + slack) | (bound <= reach[1][None] * (1 + 1e-9) + slack))
    if a is b:
        wanted = wanted[wanted[:, 0] < wanted[:, 1]]
    i, j = wanted[:, 0], wanted[:, 1]
    d = _squares(a["v"][i], b["v"][j])
    ids, other = np.concatenate([a["id"][i], b["id"][j]]), np.concatenate([b["id"][j], a["id"][i]])
    return (*_closest(ids, np.concatenate([d, d]), other), len(i))


def _side(table: pa.Table, reach: np.ndarray) -> dict:
    return {"id": table.column("id").to_numpy(), "v": _matrix(table.column("v")), "lead": _matrix(table.column("lead")), "reach": reach}


def _inside(table: pa.Table) -> pa.Table:
    """The rows of a block with the square of the distance to their nearest there, and which it is; nulls if alone."""
    side = _side(table, np.full(len(table), np.inf))
    ids, d, other, _ = _compare(side, side)
    at = np.searchsorted(ids, side["id"]) if len(ids) else np.zeros(len(table), dtype=np.int64)
    alone = not len(ids)
    columns = {"d": pa.nulls(len(table), pa.float64()) if alone else pa.array(d[at]), "other": pa.nulls(len(table), pa.int64()) if alone else pa.array(other[at])}
    for name, column in columns.items():
        table = table.append_column(name, column)
    return table.select(["group", "block", "cell", "id", "v", "r", "far", "lead", "d", "other"])


def _meet(table: pa.Table) -> pa.Table:
    """Two blocks: finds of both, and a row with the number of pairs that were compared in full."""
    reach = table.column("d").fill_null(np.inf).to_numpy()
    first = table.column("first").to_numpy(zero_copy_only=False)
    a, b = (_side(table.filter(pa.array(mask)), reach[mask]) for mask in (first, ~first))
    ids, d, other, compared = _compare(a, b)
    none = lambda kind: pa.nulls(1, kind)
    out = [pa.chunked_array([pa.array(ids, pa.int64()), none(pa.int64())]), pa.chunked_array([pa.array(d, pa.float64()), none(pa.float64())]), pa.chunked_array([pa.array(other, pa.int64()), none(pa.int64())]), pa.chunked_array([pa.nulls(len(ids), pa.int64()), pa.array([compared], pa.int64())])]
    return pa.table(out, names=["id", "d", "other", "compared"])


def search(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, nearest, d) for rows(id, group, v), and all finds with the numbers of pairs compared."""
    own = save(rows.where("group is not null").select("group", F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")), "vectors")
    kind = own.schema["group"].dataType.simpleString()
    sizes = own.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    first = own.withColumn("_o", F.row_number().over(W.partitionBy("group").orderBy(F.xxhash64("id"), "id"))).where(F.col("_o") <= SAMPLE).drop("_o")
    models = save(first.join(sizes, "group").groupBy("group").applyInArrow(_model, f"group {kind}, n long, pivots binary, axes binary, middle binary"), "models")
    deals = F.ceil(F.col("n") / TOGETHER).cast("int")
    dealt = own.join(sizes, "group").withColumn("deal", F.pmod(F.xxhash64("id"), deals).cast("int"))
    copies = models.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    placed = dealt.groupBy("group", "deal").cogroup(copies.groupBy("group", "deal")).applyInArrow(_place, f"group {kind}, id long, v array<double>, cell long, r double, far array<double>, lead array<double>")
    numbered = number_rows(placed, [F.asc("r"), F.asc("id")], "k", ["group", "cell"])
    blocks = numbered.withColumn("block", F.col("cell") * (1 << 40) + F.floor((F.col("k") - 1) / BLOCK))
    seekers = save(blocks.groupBy("group", "block").applyInArrow(_inside, f"group {kind}, block long, cell long, id long, v array<double>, r double, far array<double>, lead array<double>, d double, other long"), "seekers")

    reach = F.sqrt(F.max(F.coalesce("d", F.lit(float("inf")))) + SLACK) * (1 + 1e-9) + F.max(F.array_max("far")) * 1e-6
    rings = seekers.groupBy("group", "block").agg(F.first("cell").alias("cell"), F.min("r").alias("inner"), F.max("r").alias("outer"), reach.alias("reach"))
    near = seekers.select("group", "block", F.posexplode("far").alias("cell", "f")).groupBy("group", "block", "cell").agg(F.min("f").alias("low"), F.max("f").alias("high"))
    # for each block the blocks that some of its rows need
    to = rings.select("group", F.col("block").alias("to"), "cell", "inner", "outer")
    needs = near.join(rings.select("group", "block", "reach"), ["group", "block"]).join(to, ["group", "cell"])
    needs = needs.where((F.col("block") != F.col("to")) & (F.col("low") <= F.col("outer") + F.col("reach")) & (F.col("high") >= F.col("inner") - F.col("reach")))
    pairs = save(needs.select("group", F.least("block", "to").alias("a"), F.greatest("block", "to").alias("b")).distinct(), "block-pairs")
    sides = pairs.select("group", "a", "b", F.explode(F.array(F.struct(F.col("a").alias("block"), F.lit(True).alias("first")), F.struct(F.col("b").alias("block"), F.lit(False).alias("first")))).alias("s"))
    sent = seekers.select("group", "block", "id", "v", "lead", "d").join(sides.select("group", "a", "b", "s.*"), ["group", "block"])
    met = sent.groupBy("group", "a", "b").applyInArrow(_meet, "id long, d double, other long, compared long")
    met = save(met.unionByName(seekers.select("id", "d", "other", F.lit(None).cast("long").alias("compared"))), "finds")
    best = met.where("d is not null").groupBy("id").agg(F.min(F.struct(F.round("d", 9).alias("d"), "other")).alias("m"))
    return best.select("id", F.col("m.other").alias("nearest"), F.col("m.d").alias("d")), met


def nearest_in_group(rows: DataFrame) -> DataFrame:
    """For each row(id, group, v) the nearest other row of its group, the least id on ties, and the squared distance.

    A row that is alone in its group gives none; vectors of a group have one length.
    """
    return search(rows)[0]
