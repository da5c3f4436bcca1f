"""Operator 8, mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are added up over cells (source, language, topic). Weights of the cells are scaled to the target of one marginal after
the other until all marginals fit (raking); a document is kept with a probability in proportion to its cell's weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.staging import Stage

MARGINS = ("source", "lang", "topic")
#: Target share of a value: its share of all tokens to this power, scaled to 1. Below 1, small values gain.
POWERS = {"source": 0.7, "lang": 0.85, "topic": 0.95}
#: Rounds stop when no scaling factor is farther than this from 1.
TOLERANCE = 1e-6
#: Where no weights fit all targets (a value that occurs only with another), rounds stop here; the topic marginal is exact.
MAX_ROUNDS = 40


def n_tokens(text: str = "text") -> Column:
    """Runs of non-space characters."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("bigint")


def surface_topic(text: str = "text") -> Column:
    """A topic for documents without one, by what their text looks like: empty, symbols, numbers, lines or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    return (F.when(F.trim(t) == "", "empty").when(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:!?'-]")) * 20 > n, "symbols")
            .when(F.regexp_count(t, F.lit(r"\p{N}")) * 20 > n, "numbers").when(F.regexp_count(t, F.lit("\n")) * 200 > n, "lines").otherwise("prose"))


def cells_of(docs: DataFrame, topic: Column) -> DataFrame:
    """``docs`` with the cell columns _source, _lang, _topic; null is a value of its own, written as an empty text."""
    return docs.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
                             "_topic": F.coalesce(topic.cast("string"), F.lit(""))})


def default_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, share): shares of tokens, levelled by ``power``."""
    sums = cells.groupBy(f"_{margin}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("x"))
    total = sums.agg(F.sum("x")).first()[0] or 1.0
    return sums.select(F.col(f"_{margin}").alias("value"), (F.col("x") / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], stage: Stage, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``cells`` (staged: _source, _lang, _topic, tokens) with ``weight``. Values without a target, or without tokens, keep
    their weight in that marginal. Every round is written and read back."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out = cells.withColumn("weight", F.lit(1.0))
    for _ in range(max_rounds):
        off = []
        for margin, target in targets.items():
            key = f"_{margin}"
            factor = (out.groupBy(key).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now")).join(target.withColumnRenamed("value", key), key)
                      .select(key, F.coalesce(F.try_divide(F.col("share") * F.lit(float(total)), F.nullif("now", F.lit(0.0))), F.lit(1.0)).alias("factor")))
            out = out.join(factor, key, "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
            out = out.withColumns({"weight": F.col("weight") * F.col("factor"), f"_off{margin}": F.abs(F.col("factor") - 1)}).drop("factor")
            off.append(f"_off{margin}")
        out = stage.write(out)
        farthest = out.where("tokens > 0").agg(F.max(F.greatest(*off) if len(off) > 1 else F.col(off[0]))).first()[0]
        out = out.drop(*off)
        if farthest is None or farthest < tolerance:
            break
    return out


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that follows from the values of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") * (2.0**-53)


def calibrated(docs: DataFrame, topic: Column | None = None, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
               seed: int = 8) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, ...) with _topic, _tokens, _p (the probability) and _kept.

    The targets are given as (value, share) tables by marginal, or follow from ``powers``. Probabilities are the weights over
    the largest one, so expected tokens are in the target proportions exactly. Whether a document is kept follows from its
    doc_id and the seed: repeated rows share it. Empty and null texts have no tokens and do not weigh. An empty table gives an
    empty table; extra columns are kept, except for those of the names above.
    """
    stage = Stage(docs.sparkSession, "mixing")
    added = {"_source", "_lang", "_topic", "_tokens", "_p", "_kept"}
    marked = cells_of(docs.select(*[c for c in docs.columns if c not in added]), surface_topic() if topic is None else topic)
    keys = [f"_{m}" for m in MARGINS]
    cells = stage.write(marked.groupBy(*keys).agg(F.sum(n_tokens()).alias("tokens")))
    powers = POWERS if powers is None else powers
    targets = {m: (targets or {}).get(m) or stage.write(default_targets(cells, m, powers[m])) for m in MARGINS}
    weights = rake(cells, targets, stage)
    most = weights.agg(F.max("weight")).first()[0] or 1.0
    p = stage.write(weights.select(*keys, F.round(F.col("weight") / most, 9).alias("_p")))
    # cells are few next to documents; their table is written, so Spark knows its size when it picks the join
    out = marked.join(p, keys, "left")
    return out.withColumns({"_tokens": n_tokens(), "_kept": uniform(seed, "doc_id") < F.col("_p")})


def sample(docs: DataFrame, **how) -> DataFrame:
    """The kept documents, with the columns of ``docs``, whatever their names."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang")
    return calibrated(row, **how).where("_kept").select("row.*")
