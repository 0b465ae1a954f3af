"""Spatial joins as equi-joins on cells of a grid or a quadtree, refined by exact predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom import constants as K
from fieldloom.functions import geometry as G
from fieldloom.functions import polygons as P
from fieldloom.functions.mathx import col, degrees_of, haversine_m, mercator
from fieldloom.sources.shared import written


def shape_of(df: DataFrame, name: str = "ring") -> Column:
    """A column of rings or of shapes as shapes."""
    kind = df.schema[name].dataType
    return P.of_ring(F.col(name)) if isinstance(kind.elementType, StructType) else F.col(name)


def bounds_of(df: DataFrame, name: str = "ring") -> Column:
    return P.bounds(shape_of(df, name))


def cells(box: Column, size: float) -> Column:
    """Grid cells (as text keys) that a bounding box meets; a box wider than the grid costs more rows, not wrong ones."""
    at = lambda v: F.floor(v / size)
    return F.flatten(
        F.transform(F.sequence(at(box["x0"]), at(box["x1"])), lambda i: F.transform(F.sequence(at(box["y0"]), at(box["y1"])), lambda j: F.struct(i.alias("cx"), j.alias("cy"))))
    )


#: Side of the cells of level 0, in degrees; each level's cells are twice as wide. Levels there are.
FINEST, LEVELS = 0.0005, 24


def level_of(box: Column) -> Column:
    """The level at which a box meets four cells at most: the first whose cells are as wide as it is."""
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    return F.coalesce(F.least(F.greatest(F.ceil(F.log2(F.when(side > 0, side) / FINEST)).cast("int"), F.lit(0)), F.lit(LEVELS)), F.lit(0))


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), level) * FINEST


def _at_levels(df: DataFrame, box: str, levels: Column) -> DataFrame:
    """df with ``_cell`` (level, cx, cy): a row for each cell that its box meets at each of some levels."""
    at = lambda v: F.floor(F.col(f"{box}.{v}") / _side(F.col("_level")))
    rows = df.withColumn("_level", F.explode(levels)).withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    return rows.withColumn("_cell", F.struct(F.col("_level").alias("level"), F.col("_cx").alias("cx"), F.col("_cy").alias("cy"))).drop("_level", "_cx", "_cy")


#: Rows of cells that a task sorts, about.
ROWS_A_TASK = 500_000


def _sizes(df: DataFrame, box: str) -> dict[int, tuple[float, float, int]]:
    """Of each level that boxes lie in how wide and high the largest is, a little more for rounding, and how many there are."""
    b = F.col(box)
    most = F.max(F.greatest(*[F.abs(b[k]) for k in ("x0", "y0", "x1", "y1")])) * 1e-14
    found = df.groupBy(level_of(b).alias("l")).agg((F.max(b["x1"] - b["x0"]) + most).alias("w"), (F.max(b["y1"] - b["y0"]) + most).alias("h"), F.count(F.lit(1)).alias("n")).collect()  # a few numbers
    return {r["l"]: (r["w"], r["h"], r["n"]) for r in found if r["w"] is not None}


def _met(big: DataFrame, big_box: str, of_big: dict, small: DataFrame, small_box: str, of_small: dict, ties: bool, salts: int) -> DataFrame | None:
    """Pairs of a box and one of the other side of a finer level (or of the same, with ``ties``), once each; None if there are no such levels.

    The finer box is where its lower left corner is: in one cell of each coarser level. The coarser one lies in the cells of its level that such a
    corner can be in if the boxes meet, which goes by the size of the largest box of the finer level. Rows are shuffled by tile, a cell of the next coarser
    level, and take their cells only after that, so that these are never written.
    """
    steps = {k: [j for j in of_small if j < k or ties and j == k] for k in of_big}
    steps = {k: v for k, v in steps.items() if v}
    if not steps:
        return None
    # Cells are a half of their level's or, for points and boxes so small, a quarter, 4 or 8 of them to a side of a tile.
    per_tile = lambda k, j: 8 if max(of_small[j][:2]) <= FINEST * 2.0**k / 4 else 4
    numbers = lambda **of: F.struct(*[(F.lit(v).cast("double") if n in "wh" else F.lit(v).cast("int")).alias(n) for n, v in of.items()])
    all_steps = F.array(*[numbers(k=k, j=j, w=of_small[j][0], h=of_small[j][1], m=per_tile(k, j)) for k, v in steps.items() for j in v])
    reach = F.array(*[numbers(k=k, w=max(of_small[j][0] for j in v), h=max(of_small[j][1] for j in v)) for k, v in steps.items()])
    rows = salts * sum(of_big[k][2] * (per_tile(k, j) * 0.75 + 1) ** 2 for k, v in steps.items() for j in v)
    session = big.sparkSession
    n = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")), int(rows / ROWS_A_TASK))
    # Sides that lie by tile aren't shuffled again by tile and cell.
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    tile = ["_cell", *(["_salt"] if salts > 1 else [])]
    b, s, k, t = F.col(big_box), F.col(small_box), F.col("_cell.level") - 1, F.col("_cell")
    cell = lambda v, m: F.floor(v / (_side(k) * 2 / m))

    reached = lambda r: F.struct((b["x0"] - r["w"]).alias("x0"), (b["y0"] - r["h"]).alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))
    a = big.withColumn("_coarse", level_of(b)).withColumn("_reach", F.get(F.filter(reach, lambda r: r["k"] == F.col("_coarse")), 0)).where("_reach is not null").withColumn("_reach", reached(F.col("_reach")))
    a = _at_levels(a, "_reach", F.array(F.col("_coarse") + 1)).drop("_coarse", "_reach")
    a = (a.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else a).repartition(n, *tile)
    a = a.withColumn("_step", F.explode(F.filter(all_steps, lambda q: q["k"] == k)))
    m = F.col("_step.m")
    between = lambda low, high: F.explode(F.when(low <= high, F.sequence(low, high)))
    own = lambda low, high, at: between(F.greatest(cell(low, m), at * m), F.least(cell(high, m), at * m + m - 1))
    a = a.withColumn("_cx", own(b["x0"] - F.col("_step.w"), b["x1"], t["cx"])).withColumn("_cy", own(b["y0"] - F.col("_step.h"), b["y1"], t["cy"])).withColumn("_fine", F.col("_step.j")).drop("_step")

    corner = F.struct(s["x0"].alias("x0"), s["y0"].alias("y0"), s["x0"].alias("x1"), s["y0"].alias("y1"))
    c = small.withColumn("_fine", level_of(s)).withColumn("_reach", corner)
    c = _at_levels(c, "_reach", F.transform(F.filter(all_steps, lambda q: q["j"] == F.col("_fine")), lambda q: q["k"] + 1)).drop("_reach")
    c = (c.withColumn("_salt", F.pmod(F.xxhash64(small_box), F.lit(salts)).cast("int")) if salts > 1 else c).repartition(n, *tile)
    c = c.withColumn("_parts", F.get(F.filter(all_steps, lambda q: (q["k"] == k) & (q["j"] == F.col("_fine"))), 0)["m"])
    c = c.withColumn("_cx", cell(s["x0"], F.col("_parts"))).withColumn("_cy", cell(s["y0"], F.col("_parts"))).drop("_parts")

    # Sorted by a number first, which spares the comparison of all keys. A merge join is never turned into one that sends a side through the driver, and it holds no more than a cell's rows.
    keys = [*tile, "_fine", "_cx", "_cy"]
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("_cell", "_fine", "_cx", "_cy"))
    # Boxes as plain columns that are never null, which pairs are compared by the most quickly.
    sides = ("x0", "y0", "x1", "y1")
    flat = lambda df, box, name: hashed(df).select("*", *[F.coalesce(F.col(box)[v], F.lit(float("nan"))).alias(f"_{name}_{v}") for v in sides])
    both = flat(a, big_box, "big").join(flat(c, small_box, "small").hint("merge"), ["_hash", *keys])
    meet = (F.col("_big_x0") <= F.col("_small_x1")) & (F.col("_small_x0") <= F.col("_big_x1")) & (F.col("_big_y0") <= F.col("_small_y1")) & (F.col("_small_y0") <= F.col("_big_y1"))
    return both.where(meet).drop("_hash", *keys, *[f"_{name}_{v}" for name in ("big", "small") for v in sides])


def box_pairs(left: DataFrame, right: DataFrame, left_box: str, right_box: str, salts: int = 1) -> DataFrame:
    """Pairs of rows whose boxes (x0, y0, x1, y1) meet, once each. Both sides should be tables, as they are read several times; their columns' names differ.

    A quadtree instead of a grid: a box has the level whose cells are as wide as it is, and meets boxes of its own and of finer levels in cells of its
    level. So there is no cell size to choose, and small boxes never meet each other in a coarse cell. A pair is found in the one cell that
    holds the lower left corner of its finer box. Where few tiles hold most pairs, ``salts`` deals the finer boxes of a tile
    out over so many tasks, each of which gets the tile's coarser ones.
    """
    return _paired(left, right, left_box, right_box, _sizes(left, left_box), _sizes(right, right_box), salts)


def _paired(left: DataFrame, right: DataFrame, left_box: str, right_box: str, of_left: dict, of_right: dict, salts: int = 1) -> DataFrame:
    found = [p for p in (_met(left, left_box, of_left, right, right_box, of_right, True, salts), _met(right, right_box, of_right, left, left_box, of_left, False, salts)) if p is not None]
    names = [*left.columns, *right.columns]
    if not found:  # a side without boxes
        return left.where("false").crossJoin(right.where("false")).select(*names)
    both = found[0].select(*names)
    for more in found[1:]:
        both = both.unionByName(more.select(*names))
    return both


def overlapping(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of rows whose polygons' bounding boxes meet, once each: (left columns, right columns with r_ before them)."""
    a = written(left.withColumn("_box", bounds_of(left)))
    b = written(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], bounds_of(right).alias("_r_box")))
    return box_pairs(a, b, "_box", "_r_box").drop("_box", "_r_box")


#: Shapes of more trapezoids are dealt out over cells trapezoid by trapezoid.
FEW_PIECES = 16
#: Of so many pieces, where one with slanted sides counts for several, what a shape shares with a rectangle is one expression.
COLUMN_PIECES, SLANTED = 12, 4


def shared_areas(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keep_left: tuple[str, ...] = (), keep_right: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, r_right_id, shared) of the polygons (ring, or a shape of that name) that share an area, in square degrees, with the columns to keep (those of the right side after r_).

    Each polygon is cut into trapezoids once. Polygons of few meet by the cells of a quadtree, which report a pair once, so that its area is
    computed where it is found and no row of a pair is shuffled. A polygon of many is dealt out over many cells by its trapezoids, and sums by
    pair follow; so do the rows of an id that several rows have.
    """

    def pieces(df: DataFrame, side: str, id: str, keep: tuple[str, ...]) -> DataFrame:
        names, key = [f"{side}{c}" for c in (id, *keep)], f"{side}{id}"
        shape, plain = shape_of(df), P.upright(shape_of(df))
        # Rectangles are shuffled as boxes. By id over all cores, as a small file's rows make much work each.
        rows = df.select(*[F.col(c).alias(f"{side}{c}") for c in (id, *keep)], F.when(plain, P.bounds(shape)).alias("_b"), F.when(~plain, shape).alias("_s")).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)
        cut = rows.withColumn("_cut", P.trapezoids()(F.col("_s"))).where("_b is not null or size(_cut) > 0")
        least = lambda *f: F.array_min(F.flatten(F.transform("_cut", lambda t: F.array(*[t[k] for k in f]))))
        most = lambda *f: F.array_max(F.flatten(F.transform("_cut", lambda t: F.array(*[t[k] for k in f]))))
        box = F.struct(least("l0", "l1").alias("x0"), least("y0").alias("y0"), most("r0", "r1").alias("x1"), most("y1").alias("y1"))
        found = written(cut.select(*names, F.coalesce("_b", box).alias(f"_{side}box"), F.when(F.col("_b").isNull(), F.col("_cut")).alias(f"_{side}t")))
        large = F.coalesce(F.size(f"_{side}t") > FEW_PIECES, F.lit(False))
        # Only ids are shuffled to find those of several rows.
        several = found.groupBy(F.col(key).alias("_twice")).count().where("count > 1").select("_twice", F.lit(True).alias("_of_several"))
        if several.isEmpty():
            return found.withColumn("_many", large)
        both = found.join(several.hint("merge"), F.col(key).eqNullSafe(F.col("_twice")), "left")
        return written(both.select(*found.columns, (F.col("_of_several").isNotNull() | large).alias("_many")))

    def one_by_one(rows: DataFrame, side: str) -> DataFrame:
        b = F.col(f"_{side}box")
        whole = F.array(F.struct(*[b[f].alias(k) for k, f in (("y0", "y0"), ("y1", "y1"), ("l0", "x0"), ("l1", "x0"), ("r0", "x1"), ("r1", "x1"))]))
        single = rows.withColumn(f"_{side}t", F.explode(F.coalesce(F.col(f"_{side}t"), whole)))
        t = F.col(f"_{side}t")
        box = F.struct(F.least(t["l0"], t["l1"]).alias("x0"), t["y0"].alias("y0"), F.greatest(t["r0"], t["r1"]).alias("x1"), t["y1"].alias("y1"))
        return written(single.withColumn(f"_{side}box", box))

    a, b = pieces(left, "", left_id, keep_left), pieces(right, "r_", right_id, keep_right)
    def kind(df: DataFrame, t: str) -> dict:
        """Whether a side has other shapes than rectangles, and rows for the sums by pair; of the others the most pieces, and whether any has slanted sides."""
        slanted = F.exists(t, lambda q: (q["l0"] != q["l1"]) | (q["r0"] != q["r1"]))
        one = ~F.col("_many")
        yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
        return df.agg(yes(F.col(t).isNotNull()).alias("cut"), yes(F.col("_many")).alias("many"), F.coalesce(F.max(F.when(one, F.size(t))), F.lit(0)).alias("pieces"), yes(one & slanted).alias("slanted")).first().asDict()

    def spelled(df: DataFrame, side: str, n: int, fields: tuple[str, ...]) -> DataFrame:
        """df with a column for each number of its n pieces instead of their list; the first of a rectangle is itself, pieces that aren't there have no width."""
        box = dict(zip(("y0", "y1", "l0", "l1", "r0", "r1"), ("y0", "y1", "x0", "x0", "x1", "x1"), strict=True))
        other = lambda k, f: F.when(F.col(f"_{side}t").isNull(), F.col(f"_{side}box")[box[f]]) if k == 0 else F.lit(None)
        return df.select("*", *[F.coalesce(F.get(f"_{side}t", F.lit(k))[f], other(k, f), F.lit(0.0)).alias(f"_{side}{k}{f}") for k in range(n) for f in fields]).drop(f"_{side}t")

    kinds = [kind(a, "_t"), kind(b, "_r_t")]
    few = lambda df, kind: (df.where("not _many") if kind["many"] else df).drop("_many")
    many = lambda df: df.where("_many").drop("_many")
    kept = [*keep_left, *[f"r_{c}" for c in keep_right]]
    ones = [few(a, kinds[0]), few(b, kinds[1])]
    # Few pieces and rectangles share areas without Python.
    of = 0 if kinds[0]["cut"] else 1
    n, slanted, side, other = kinds[of]["pieces"], kinds[of]["slanted"], ("", "r_")[of], ("_r_box", "_box")[of]
    if kinds[0]["cut"] != kinds[1]["cut"] and n * (SLANTED if slanted else 1) <= COLUMN_PIECES:
        fields = ("y0", "y1", "l0", "r0", *(("l1", "r1") if slanted else ()))
        ones[of] = spelled(ones[of], side, n, fields)
        met = P.pieces_in_box(box_pairs(*ones, "_box", "_r_box"), [{f: f"_{side}{k}{f}" for f in fields} for k in range(n)], other, "_area")
        area = F.explode(F.array("_area"))  # a list of one, or else each filter on the area would compute it again
    else:
        met, area = box_pairs(*ones, "_box", "_r_box"), P.shared_by_cut("_box", "_t" if kinds[0]["cut"] else None, "_r_box", "_r_t" if kinds[1]["cut"] else None)
    out = met.select(left_id, f"r_{right_id}", area.alias("shared"), *kept)
    dealt = []
    if kinds[0]["many"]:
        dealt.append(box_pairs(one_by_one(many(a), ""), one_by_one(b.drop("_many"), "r_"), "_box", "_r_box"))
    if kinds[1]["many"]:
        dealt.append(box_pairs(one_by_one(few(a, kinds[0]), ""), one_by_one(many(b), "r_"), "_box", "_r_box"))
    for both in dealt:
        both = both.groupBy(left_id, f"r_{right_id}").agg(F.sum(P.trapezoids_share(F.col("_t"), F.col("_r_t"))).alias("shared"), *[F.any_value(c).alias(c) for c in kept])
        out = out.unionByName(both)
    return out.where("shared > 0")


def in_circle(df: DataFrame, lat: float, lng: float, radius_m: float, lat_col: str = "center_lat", lng_col: str = "center_lng") -> DataFrame:
    """Rows whose point is within a radius, with distance_m; a bounding box goes down to the scan first."""
    d_lng, d_lat = degrees_of(radius_m, lat)
    near = df.where(F.col(lat_col).between(lat - d_lat * 1.0001, lat + d_lat * 1.0001) & F.col(lng_col).between(lng - d_lng * 1.001, lng + d_lng * 1.001))
    return near.withColumn("distance_m", haversine_m(F.lit(lng), F.lit(lat), lng_col, lat_col)).where(F.col("distance_m") <= radius_m)


def circle_box(lat, lng, radius_m) -> Column:
    """A box around a circle."""
    y, x = col(lat), col(lng)
    d_lat = F.degrees(col(radius_m) / K.EARTH_RADIUS_M) * 1.0001
    d_lng = d_lat / F.greatest(F.cos(F.radians(y)), F.lit(1e-6)) * 1.001
    return F.struct((x - d_lng).alias("x0"), (y - d_lat).alias("y0"), (x + d_lng).alias("x1"), (y + d_lat).alias("y1"))


def in_circles(df: DataFrame, circles: DataFrame, size: float = 0.02, lat_col: str = "center_lat", lng_col: str = "center_lng") -> DataFrame:
    """The same for a table of circles (query_id, lat, lng, radius_m), joined by cell."""
    box = circle_box("lat", "lng", "radius_m")
    q = circles.withColumn("cell", F.explode(cells(box, size)))
    p = df.withColumn("cell", F.struct(F.floor(F.col(lng_col) / size).alias("cx"), F.floor(F.col(lat_col) / size).alias("cy")))
    return p.join(q, "cell").withColumn("distance_m", haversine_m("lng", "lat", lng_col, lat_col)).where(F.col("distance_m") <= F.col("radius_m")).drop("cell")


def assign_by_overlap(blocks: DataFrame, parcels: DataFrame, least: float = K.MIN_COVER_RATIO) -> DataFrame:
    """For each parcel the block that shares the most area with it, if it covers enough of it: (parcel_id, block_id, shared, cover_ratio).

    blocks: (block_id, block_rank, ring); parcels: (parcel_id, ring), where a ring may be a shape. Of equal shares the lower rank wins.
    """
    mine = parcels.select("parcel_id", "ring", P.area_deg2(shape_of(parcels)).alias("_area"))
    pairs = shared_areas(mine, blocks.select("block_id", "block_rank", "ring"), "parcel_id", "block_id", keep_left=("_area",), keep_right=("block_rank",))
    good = pairs.withColumn("cover_ratio", F.try_divide(F.col("shared"), F.col("_area"))).where(F.col("cover_ratio") >= least)
    best = good.groupBy("parcel_id").agg(F.max(F.struct(F.col("shared"), (-F.col("r_block_rank")).alias("order"), F.col("r_block_id").alias("block_id"), F.col("cover_ratio"))).alias("b"))
    return best.select("parcel_id", "b.block_id", "b.shared", "b.cover_ratio")


def uncovered(blocks: DataFrame, assigned: DataFrame, enough: float = K.BLOCK_COVERED) -> DataFrame:
    """Blocks of which assigned parcels cover less than a share; those that no parcel met stay."""
    covered = assigned.groupBy("block_id").agg(F.sum("shared").alias("covered"))
    return blocks.join(covered, "block_id", "left").where(F.coalesce("covered", F.lit(0.0)) / P.area_deg2(shape_of(blocks)) < enough)


def not_within(points: DataFrame, polygons: DataFrame, size: float | None = None) -> DataFrame:
    """Points (lat, lng) inside no polygon (ring); both sides meet by cell."""
    numbered = written(points.withColumn("_point", F.monotonically_increasing_id()))
    inside = containing(numbered.select("_point", "lat", "lng"), polygons.select("ring"), size, "lat", "lng")
    return numbered.join(inside.select("_point").distinct(), "_point", "left_anti").drop("_point")


def in_box(box: Column, lat: Column, lng: Column) -> Column:
    """Whether a point is in a bounding box: a few comparisons that spare most rings the walk along their edges."""
    return lng.between(box["x0"], box["x1"]) & lat.between(box["y0"], box["y1"])


def containing(points: DataFrame, polygons: DataFrame, size: float | None = None, lat: str = "center_lat", lng: str = "center_lng", also: Column | None = None) -> DataFrame:
    """Pairs of a point and a polygon (ring) that holds it; both sides meet by cell, and only points in a ring's box are held against the ring.

    Without a grid's ``size`` cells are those of a quadtree, whatever the sizes of polygons; shapes whose sides all run along the axes are cut into
    rectangles, one of which holds a point that they hold. ``also``: what a pair must fulfil besides.
    """
    shape, y, x = shape_of(polygons), F.col(lat), F.col(lng)
    # A rectangle along the axes holds its lower and left sides, as the walk along its edges has it.
    held = lambda b: (y >= b["y0"]) & (y < b["y1"]) & (x >= b["x0"]) & (x < b["x1"])
    also = F.lit(True) if also is None else also
    b = F.col("_box")
    if size is not None:
        boxed = polygons.withColumn("_box", P.bounds(shape)).withColumn("_plain", P.upright(shape)).withColumn("_cell", F.explode(cells(b, size)))
        cell = F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))
        near = points.withColumn("_cell", cell).join(boxed, "_cell").where(also)
        return near.where(in_box(b, y, x)).where(F.when(F.col("_plain"), held(b)).otherwise(P.contains(shape, lat, lng))).drop("_cell", "_box", "_plain")
    around = polygons.repartition(2 * polygons.sparkSession.sparkContext.defaultParallelism)  # a small file's rows, but much work each
    cut = around.withColumn("_plain", P.rectilinear(shape)).withColumn("_cut", P.trapezoids()(F.when(F.col("_plain"), shape)))
    piece = F.transform("_cut", lambda t: F.struct(t["l0"].alias("x0"), t["y0"].alias("y0"), t["r0"].alias("x1"), t["y1"].alias("y1")))
    boxed = written(cut.withColumn("_box", F.explode(F.when(F.col("_plain"), piece).otherwise(F.array(P.bounds(shape))))).drop("_cut"))
    spots = points.withColumn("_spot", F.struct(x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1")))
    out = None
    for plain in (True, False):
        some = boxed.where("_plain" if plain else "not _plain")
        sizes = _sizes(some, "_box")
        if not sizes and (plain or out is not None):
            continue
        # Points have no extent and the finest level, so polygons are the coarser ones.
        near = _paired(some, spots, "_box", "_spot", sizes, {0: (0.0, 0.0, 0)}).where(also)
        rule = F.when(F.col("_plain"), held(b))  # alone it needs no ring, which then isn't read
        near = near.where(rule if plain else rule.otherwise(P.contains(shape, lat, lng))).select(*points.columns, *polygons.columns)
        out = near if out is None else out.unionByName(near)
    return out


def pixels_within(pixels: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """Pixels (key, x, y in Mercator metres) whose centre is inside the polygon of their raster (key, ring)."""
    shape = polygons.select(key, F.transform("ring", lambda p: F.struct(mercator(p["lng"], p["lat"])[1].alias("lat"), mercator(p["lng"], p["lat"])[0].alias("lng"))).alias("_ring"))
    return pixels.join(shape, key).where(G.contains(F.col("_ring"), F.col("y"), F.col("x"))).drop("_ring")


def nearest(df: DataFrame, distance: str, tie: str, limit: int) -> DataFrame:
    """The nearest rows, a top-k without a full sort."""
    return df.orderBy(distance, tie).limit(limit)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; only the first of each task is shuffled."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def z_order(lat: Column, lng: Column, bits: int = 16) -> Column:
    """Morton key of a point, for clustering files so that scans skip row groups."""
    scale = float((1 << bits) - 1)
    x = F.least(F.greatest((col(lng) + 180) / 360 * scale, F.lit(0.0)), F.lit(scale)).cast("long")
    y = F.least(F.greatest((col(lat) + 90) / 180 * scale, F.lit(0.0)), F.lit(scale)).cast("long")
    key = F.lit(0).cast("long")
    for k in range(bits):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1).cast("long")), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1).cast("long")), 2 * k + 1))
    return key
