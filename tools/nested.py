"""Seconds of the cell joins and of the same joins without cells (equal project and exact test only)."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from planloom.operators import relations as R
from planloom.plans.registry import Tables
from planloom.session import local_session


def timed(df):
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 2)


def main():
    spark = local_session()
    t = Tables(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
    live = t.elements.where("not deleted").repartition(8)
    p, q = live.alias("p"), live.alias("q")
    d3 = "sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))"
    box = "p.min_x<=q.max_x and p.max_x>=q.min_x and p.min_y<=q.max_y and p.max_y>=q.min_y"
    seg, sym = t.segments.repartition(8), t.symbols
    ends = R.endpoints(seg.select("id", "project_id", "x1", "y1", "x2", "y2")).alias("e")
    cases = {
        "within_distance": (R.within_distance(live, 2.0), p.join(q, F.expr(f"p.project_id=q.project_id and p.id<>q.id and {d3}<=2"))),
        "intersecting_pairs": (R.intersecting_pairs(live), p.join(q, F.expr(f"p.project_id=q.project_id and p.id<q.id and {box}"))),
        "line_symbol_edges": (R.line_symbol_edges(seg, sym), ends.join(sym.alias("s"), F.expr(
            "e.project_id=s.project_id and sqrt((e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y))<15"))),
    }
    for name, (cells, nested) in cases.items():
        timed(cells)
        print(name, "cells", timed(cells), "per-project pairs", timed(nested), flush=True)


if __name__ == "__main__":
    main()
