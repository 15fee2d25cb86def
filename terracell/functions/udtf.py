"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """``SELECT ... FROM lines, LATERAL split_line(line, width, height, transform)``: ``split, piece`` rows.

    For tables the column function is faster; this one is for a few rows in SQL.
    """
    import math

    @udtf(returnType="split int, piece array<struct<x:double,y:double>>")
    class SplitLine:
        def eval(self, line, width: int, height: int, transform):
            if line is None:
                return
            from terracell.functions.grid import Affine

            affine = Affine(*transform)
            inverse = affine.inverse()
            points = [(p["x"], p["y"]) for p in line]
            pieces, now = [], points[:1]
            for p, q in zip(points, points[1:]):
                (u0, v0), (u1, v1) = inverse(*p), inverse(*q)
                cuts = []
                for a, b in ((u0, u1), (v0, v1)):
                    if a != b:
                        cuts += [(k - a) / (b - a) for k in range(math.ceil(min(a, b)), math.floor(max(a, b)) + 1)]
                last = 0.0
                for t in sorted(t for t in cuts if 0 < t <= 1):
                    if t - last <= 1e-12:
                        continue
                    last = t
                    at = q if t >= 1 - 1e-12 else affine(u0 + t * (u1 - u0), v0 + t * (v1 - v0))
                    pieces.append([*now, at])
                    now = [at]
                if now[-1] != q:
                    now.append(q)
            if len(now) > 1:
                pieces.append(now)
            for k, piece in enumerate(pieces):
                yield k, [{"x": x, "y": y} for x, y in piece]

    spark.udtf.register("split_line", SplitLine)
