"""Drafting standards: four levels of precedence looked up for a whole element table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.functions import naming
from planloom.skew import salted_join


def standards_lookup(elements: DataFrame, project: DataFrame, company: DataFrame, file: DataFrame) -> DataFrame:
    """Adds layer, block and the ``source`` they come from: project, company, file, else the built-in names.

    ``elements``: (id, project_id, element_type, subtype). Each standards table: (discipline, element_type, subtype,
    layer, block) with subtype ``default`` for the kind itself; ``project`` is keyed by project_id as well. At each level
    the subtype row wins over the default row; rows without a subtype are not used. ``attributes`` are those of the built-in
    standards, with ``size`` filled in where the elements have that column. Standards are dimension tables: Spark broadcasts them when their size
    allows and otherwise shuffles, with hot kinds spread.
    """
    e = elements.withColumn("element_type", naming.name_key(F.col("element_type"))).withColumn("system", naming.infer_system(F.col("element_type")))
    e = e.withColumn("discipline", naming.infer_discipline(F.col("element_type"), F.col("system")))
    e = e.withColumn("subtype", naming.name_key(F.col("subtype")))
    for n, table in enumerate((project, company, file)):
        keys = ["discipline", "element_type"] + (["project_id"] if "project_id" in table.columns else [])
        # one row for each kind and subtype (the smallest, should a table repeat one), and of those the rows for any subtype
        names = F.struct("layer", "block").alias("own")
        rows = table.where(F.col("subtype").isNotNull()).groupBy(*keys, "subtype").agg(F.min(names).alias("own"))
        e = salted_join(e, rows.withColumnRenamed("own", f"_s{n}"), [*keys, "subtype"], how="left")
        e = salted_join(e, rows.where("subtype = 'default'").select(*keys, F.col("own").alias(f"_d{n}")), keys, how="left")
        e = e.withColumn(f"_h{n}", F.coalesce(f"_s{n}", f"_d{n}")).drop(f"_s{n}", f"_d{n}")
    best = F.coalesce("_h0", "_h1", "_h2")
    source = F.when(F.col("_h0").isNotNull(), "project").when(F.col("_h1").isNotNull(), "company").when(
        F.col("_h2").isNotNull(), "file").otherwise("default")
    layer = naming.default_layer(F.col("element_type"), F.col("system"), F.col("discipline"))
    block = naming.standard_block(F.col("element_type"), F.col("subtype"))
    size = F.col("size").cast("string") if "size" in e.columns else None
    return e.withColumns({"source": source, "layer": F.coalesce(best["layer"], layer),
                          "block": F.coalesce(best["block"], F.when(best.isNull(), block)), "attributes": naming.standard_attributes(F.col("element_type"), size),
                          "color": naming.color_for(F.col("system"))}).drop("_h0", "_h1", "_h2")


def coverage_stats(grounded: DataFrame) -> DataFrame:
    ok = F.col("layer") != "0"
    return grounded.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("applied"), F.count_if(~ok).alias("missing"),
                        *[F.count_if(ok & (F.col("source") == s)).alias(f"from_{s}") for s in ("project", "company", "file", "default")],
                        F.coalesce(F.try_divide(F.count_if(ok) * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("coverage_percent"))
