"""Operator 3, document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A document is the bag of its words, weighted by their counts. For sample k every term has its own r and c from Gamma(2, 1) and
b from U(0, 1), all functions of hashes of the term. With t = floor(ln(weight) / r + b) the term scores
ln(a) = ln(c) - r * (t - b) - r, and the sample of the document is the pair (term, t) of the smallest score. Two documents
agree in a sample with a probability equal to the sum of minima over the sum of maxima of their weights.

A score and the hash of its pair are packed into one long (score in the upper bits), so that a sample is a plain minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import numbered
from planloom.staging import Stage

#: Samples of a fingerprint; its likeness has a standard error of 1 / (2 * sqrt(SAMPLES)) at most.
SAMPLES = 48
#: Terms are runs of non-space characters, longer ones in pieces of this length.
TERM = r"\S{1,24}"
#: Stands for a sample of a text without terms.
NONE = -1
LOW32 = 0xFFFFFFFF


def _uniform(bits: Column, n: int) -> Column:
    """The middle of one of 2**n equal parts of (0, 1)."""
    return (bits.cast("double") + 0.5) * (2.0**-n)


def sample_key(term: Column, weight: Column, k: int) -> Column:
    """Packed score of (term, weight) for sample ``k``; null for a weight of 0. ``term`` is a 64-bit hash."""
    x, y = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_uniform(x.bitwiseAND(LOW32), 32) * _uniform(F.shiftrightunsigned(x, 32), 32))
    c = -F.ln(_uniform(y.bitwiseAND((1 << 22) - 1), 22) * _uniform(F.shiftrightunsigned(y, 22).bitwiseAND((1 << 21) - 1), 21))
    b = _uniform(F.shiftrightunsigned(y, 43), 21)
    t = F.floor(F.ln(weight.cast("double")) / r + b)
    score = F.ln(c) - r * (t.cast("double") - b) - r
    pair = term.bitwiseXOR(F.shiftleft(t, 12)).bitwiseAND(LOW32)
    return F.shiftleft((score * float(1 << 20)).cast("bigint"), 32).bitwiseOR(pair)


def signatures(terms: DataFrame, key: str, weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """One array of ``samples`` 16-bit values for each weight column of (key, term, weights...), named like the column."""
    mins = terms.groupBy(key).agg(*[F.min(sample_key(F.col("term"), F.col(w), k)).alias(f"{w}{k}") for w in weights for k in range(samples)])
    low = lambda c: F.coalesce(F.col(c).bitwiseAND(0xFFFF).cast("int"), F.lit(NONE))
    return mins.select(key, *[F.array(*[low(f"{w}{k}") for k in range(samples)]).alias(w) for w in weights])


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples."""
    same = [F.when(F.col(a)[k] == F.col(b)[k], 1).otherwise(0) for k in range(samples)]
    return sum(same[1:], same[0]).cast("double") / samples


def as_text(signature: str, samples: int = SAMPLES) -> Column:
    """Four hexadecimal digits for each sample; empty for a text without terms."""
    digits = F.concat(*[F.lpad(F.hex(F.col(signature)[k].cast("bigint")), 4, "0") for k in range(samples)])
    return F.when(F.col(signature)[0] == NONE, F.lit("")).otherwise(digits)


def fingerprint(docs: DataFrame, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form: the second half replaced by the beginning of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as
    empty. A doc_id that repeats keeps its shortest text, of equally short ones the smallest; a null doc_id stands before
    all others. Texts without a non-space character have the fingerprint '', which is like itself (1) and unlike any other
    (0). With one document, the next document is the document itself. Other columns are not read.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, "fingerprints")
    first = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(first)).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # which document follows which: ids and lengths only
    order = stage.write(numbered(rows.groupBy("doc_id").agg(F.min(F.length("text")).alias("n")), ["doc_id"], stage))
    count = order.count()
    after = F.when(F.col("base") + 1 == count, F.lit(0)).otherwise(F.col("base") + 1)
    following = order.select(F.col("doc_id").alias("next_id"), F.col("base").alias("after"))
    link = stage.write(order.select("doc_id", "n", after.alias("after")).join(following, "after").drop("after"))

    whole = rows.groupBy("doc_id").agg(F.min(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    begin = whole.join(link.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for"), "n"), "doc_id").select(F.col("for").alias("doc_id"), F.left("text", half).alias("begin"))
    both = whole.join(begin, "doc_id").withColumn("n", F.length("text")).select("doc_id", "n", "text", F.concat(F.left("text", F.col("n") - half), "begin").alias("edited"))
    about = both.select("doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    forms = both.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("form"), "text"), F.struct(F.lit(1).alias("form"), F.col("edited").alias("text")))).alias("e"))
    words = forms.select("doc_id", F.col("e.form").alias("form"), F.explode(F.regexp_extract_all("e.text", F.lit(TERM), F.lit(0))).alias("word"))
    terms = (words.select("doc_id", F.xxhash64("word").alias("term"), (1 - F.col("form")).alias("a"), F.col("form").alias("b"))
             .groupBy("doc_id", "term").agg(F.sum("a").alias("own"), F.sum("b").alias("edited")))
    empty = F.array_repeat(F.lit(NONE), samples)
    signed = about.join(signatures(terms, "doc_id", ["own", "edited"], samples), "doc_id", "left")
    signed = stage.write(signed.withColumns({c: F.coalesce(c, empty) for c in ("own", "edited")}))
    beside = signed.select(F.col("doc_id").alias("next_id"), F.col("own").alias("next"))
    return (signed.join(link.select("doc_id", "next_id"), "doc_id").join(beside, "next_id")
            .select(F.nullif("doc_id", F.lit(first)).alias("doc_id"), "n_chars", "edited_sha256", as_text("own", samples).alias("fingerprint"),
                    as_text("edited", samples).alias("edited_fingerprint"), likeness("own", "edited", samples).alias("near_edited"),
                    likeness("own", "next", samples).alias("near_next")))
