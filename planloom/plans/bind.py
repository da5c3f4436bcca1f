"""Domain views over the driver tables, for Spark and (as the same formulas) for the SQL oracle.

Drawings are small and many: a project holds 400 elements, 300 segments, 40 symbols, 40 rooms and 30 texts,
so the number of projects grows with the tables and the density inside a project stays the same.
Coordinates are integer arithmetic with one final division, so both engines get identical doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (table, [(column, spark expression, sql expression or None when the same)])
VIEWS: dict[str, tuple[str, list[tuple[str, str, str | None]]]] = {
    "elements": ("part", [
        ("id", "p_partkey", None),
        ("project_id", "p_partkey div 400", "p_partkey // 400"),
        ("source_id", "concat('S', p_partkey)", None),
        ("entity_type", "p_type", None),
        ("layer", "p_brand", None),
        ("description", "p_name", None),
        ("category", "split_part(p_name, ' ', 2)", None),
        ("family", "split_part(p_name, ' ', 1)", None),
        ("level", "concat('L', p_size % 4)", None),
        ("deleted", "p_partkey % 50 = 0", None),
        ("embedded", "p_partkey % 3 <> 0", None),
        ("x", "(p_partkey * 7919 % 1000) / 10", "(p_partkey * 7919 % 1000) / 10e0"),
        ("y", "(p_partkey * 104729 % 1000) / 10", "(p_partkey * 104729 % 1000) / 10e0"),
        ("z", "p_size / 10", "p_size / 10e0"),
        ("min_x", "(p_partkey * 7919 % 1000 - p_size % 7 - 1) / 10", "(p_partkey * 7919 % 1000 - p_size % 7 - 1) / 10e0"),
        ("min_y", "(p_partkey * 104729 % 1000 - p_size % 5 - 1) / 10", "(p_partkey * 104729 % 1000 - p_size % 5 - 1) / 10e0"),
        ("max_x", "(p_partkey * 7919 % 1000 + p_size % 7 + 1) / 10", "(p_partkey * 7919 % 1000 + p_size % 7 + 1) / 10e0"),
        ("max_y", "(p_partkey * 104729 % 1000 + p_size % 5 + 1) / 10", "(p_partkey * 104729 % 1000 + p_size % 5 + 1) / 10e0"),
        ("size", "p_size", None),
        ("price", "p_retailprice", None),
    ]),
    "segments": ("orders", [
        ("id", "o_orderkey", None),
        ("project_id", "o_orderkey div 300", "o_orderkey // 300"),
        ("x1", "cast(o_custkey % 200 as double)", None),
        ("y1", "cast(o_orderkey % 20 * 10 as double)", None),
        ("x2", "cast(o_custkey % 200 + if(o_orderkey % 3 > 0, o_orderkey % 40 + 5, 0) as double)",
         "cast(o_custkey % 200 + case when o_orderkey % 3 > 0 then o_orderkey % 40 + 5 else 0 end as double)"),
        ("y2", "cast(o_orderkey % 20 * 10 + if(o_orderkey % 3 > 0, 0, o_orderkey % 40 + 5) as double)",
         "cast(o_orderkey % 20 * 10 + case when o_orderkey % 3 > 0 then 0 else o_orderkey % 40 + 5 end as double)"),
        ("confidence", "(o_orderkey % 10) / 10", "(o_orderkey % 10) / 10e0"),
        ("source", "if(o_orderstatus = 'F', 'direct', 'selective_opencv')",
         "case when o_orderstatus = 'F' then 'direct' else 'selective_opencv' end"),
        ("layer", "concat('LAY-', o_orderkey % 7)", None),
        ("linetype", "case o_orderkey % 8 when 0 then 'DASHED' when 1 then 'CENTER' when 2 then 'PHANTOM' else 'CONTINUOUS' end", None),
    ]),
    "symbols": ("part", [
        ("id", "p_partkey", None),
        ("project_id", "p_partkey div 40", "p_partkey // 40"),
        ("x", "cast(p_partkey * 37 % 200 as double)", None),
        ("y", "cast(p_partkey * 53 % 200 as double)", None),
        ("kind", "case p_partkey % 6 when 0 then 'diffuser' when 1 then 'valve' when 2 then 'outlet' when 3 then 'ahu' when 4 then 'panel' else 'door' end", None),
        ("category", "case p_partkey % 6 when 0 then 'mechanical' when 1 then 'plumbing' when 2 then 'electrical' when 3 then 'mechanical' when 4 then 'electrical' else 'architectural' end", None),
        ("confidence", "(p_size % 10) / 10", "(p_size % 10) / 10e0"),
    ]),
    "rooms": ("part", [
        ("id", "p_partkey", None),
        ("project_id", "p_partkey div 40", "p_partkey // 40"),
        ("name", "p_name", None),
        ("x0", "cast(p_partkey % 8 * 25 as double)", None),
        ("y0", "cast(p_partkey % 40 div 8 * 40 as double)", "cast(p_partkey % 40 // 8 * 40 as double)"),
        ("x1", "cast(p_partkey % 8 * 25 + 25 as double)", None),
        ("y1", "cast(p_partkey % 40 div 8 * 40 + 40 as double)", "cast(p_partkey % 40 // 8 * 40 + 40 as double)"),
    ]),
    "annotations": ("customer", [
        ("id", "c_custkey", None),
        ("project_id", "c_custkey div 30", "c_custkey // 30"),
        ("x", "cast(c_custkey * 17 % 200 as double)", None),
        ("y", "cast(c_custkey * 29 % 200 as double)", None),
        ("text", "case c_custkey % 6 when 0 then concat('AHU-', c_custkey) when 1 then concat(c_custkey, ' CFM') when 2 then concat('ROOM ', c_custkey) when 3 then '24x24' when 4 then concat(c_custkey, ' SF') else c_name end", None),
    ]),
    "edges": ("orders", [
        ("id", "o_orderkey", None),
        ("a", "o_orderkey", None),
        # order 0 and every 17th order have no parent: their edge leads to an end of its own
        ("b", "case when o_orderkey = 0 or o_orderkey % 17 = 5 then -1 - o_orderkey when o_orderkey % 11 = 0 then o_custkey else (o_orderkey - o_orderkey % 3) div 3 end",
         "case when o_orderkey = 0 or o_orderkey % 17 = 5 then -1 - o_orderkey when o_orderkey % 11 = 0 then o_custkey else (o_orderkey - o_orderkey % 3) // 3 end"),
        ("kind", "o_orderpriority", None),
        ("length", "cast(o_orderkey % 97 + 1 as double)", None),
    ]),
    "facts": ("events", [
        ("id", "event_id", None),
        ("project_id", "user_id % 10", None),
        ("fact_type", "concat('T', event_id % 4)", None),
        ("key", "event_type", None),
        ("confidence", "least(value / 500, 1)", "least(value / 500e0, 1e0)"),
        ("created_at", "ts", None),
        ("expires_at", "if(event_id % 5 = 0, null, ts + make_interval(0, 0, 0, 0, event_id % 96))",
         "case when event_id % 5 = 0 then null else ts + to_hours(event_id % 96) end"),
        ("value", "props", None),
    ]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, cols = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{expr} AS {col}" for col, expr, _ in cols])


def view_sql(name: str) -> str:
    source, cols = VIEWS[name]
    body = ", ".join(f"{sql or expr} AS {col}" for col, expr, sql in cols)
    return f"{name} AS (SELECT {body} FROM {source})"


def ctes(*names: str, recursive: bool = False) -> str:
    """``WITH ...`` prefix that defines the named views for the oracle."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(view_sql(n) for n in names)
