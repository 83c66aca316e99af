"""Points in the cells of a curvilinear grid: an index of bounding boxes by buckets, then the test of each candidate.

Cells are put into every bucket of ``degrees`` by ``degrees`` that their bounding box touches, points into the one they lie in; both meet by
bucket, an equi-join, so no point is compared with cells of other places. Cells may cross the date line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.conformity import inside


def _near(lon: Column, to: Column) -> Column:
    """A longitude as the one of its turns that is nearest to another."""
    return to + F.pmod(lon - to + 180, F.lit(360)) - 180


def located(points: DataFrame, cells: DataFrame, degrees: float = 5.0) -> DataFrame:
    """(point columns.., cell): every point (lat, lon, ...) with each cell (cell, lats, lons arrays of vertices) that holds it.

    A point on an edge is in the cell north-east of it (exactly so if all are decimals); points outside of all cells, or with a null coordinate, have no row, and neither have cells of
    fewer than three vertices or with a null one. Cells around a pole have to be cut at a meridian. The bucket should be about as
    large as a cell: many cells in a bucket cost comparisons, many buckets in a cell cost rows. A crowded bucket of points is
    split by Spark as a skewed join; cells in it are as many as the grid has there.
    """
    turns = round(360 / degrees)
    if abs(turns * degrees - 360) > 1e-9:
        raise ValueError("360 has to be a multiple of the bucket's degrees")
    c = cells.where("size(lats) = size(lons) and size(lats) > 2").select("cell", "lats", F.col("lons")[0].alias("_lon0"), "lons")
    c = c.where(~F.exists("lats", lambda x: x.isNull()) & ~F.exists("lons", lambda x: x.isNull()))
    c = c.withColumn("lons", F.transform("lons", lambda x: _near(x, F.col("_lon0"))))
    step = lambda x: F.floor(x / degrees)
    c = c.withColumn("_y", F.explode(F.sequence(step(F.array_min("lats")), step(F.array_max("lats")))))
    c = c.withColumn("_x", F.explode(F.sequence(step(F.array_min("lons")), step(F.array_max("lons"))))).withColumn("_x", F.pmod("_x", F.lit(turns))).dropDuplicates(["cell", "_x", "_y"])
    p = points.withColumn("_y", step(F.col("lat"))).withColumn("_x", F.pmod(step(F.col("lon")), F.lit(turns)))
    j = p.join(c, ["_x", "_y"]).where(inside(F.col("lat"), _near(F.col("lon"), F.col("_lon0")), F.col("lats"), F.col("lons")))
    return j.select(*points.columns, "cell")
