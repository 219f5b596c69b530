"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, col, fresh, partitions, written

#: Hexadecimal digits of an md5 that make a uniform number: 52 bits, exact in a double.
DIGITS = 13
#: The mixture's size as a multiple of the input's.
EPOCHS = 1.0
#: Poisson probabilities under this end the table of cumulative ones; a uniform number has 52 bits.
TAIL = 1e-18


def poisson_cdf(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... until the tail beyond them is under TAIL."""
    if rate <= 0:
        return []
    out, total, k = [], 0.0, 0
    while True:
        p = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        total += p
        if k > rate and p < TAIL:
            return out
        out.append(total)
        k += 1


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"src": f["src"], "is_null": f["is_null"], "cdf": [poisson_cdf(r) for r in f["rate"]]})


def uniform(key: F.Column) -> F.Column:
    """A number in [0, 1) that the key's md5 decides."""
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = EPOCHS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str | None = None) -> DataFrame:
    """The rows of docs, each as often as its Poisson count says, in a globally random order.

    A source's rate is weight * total * epochs / its own, in characters of all its texts, so that the expected share of
    each source is its weight. weights are scaled to 1 over the sources that have characters; those that it leaves out
    get none; None stands for equal weights. The count inverts the Poisson distribution at a uniform number hashed from
    seed, id and text; copies go to partitions by a hash, and are sorted by one within them.

    A null source is a source of its own, under the key None in weights. Null texts have no characters and follow their
    source's rate; a source with no characters at all gets none. A null id hashes as an empty one. Equal rows draw equal
    counts. An empty table gives no rows. All columns are kept under their names; copy_col, if given, is added and numbers
    the copies from 0. A text of any length is one unit.
    """
    src, key, times, at, table = fresh(docs, "src", "key", "times", "copy", "cdf")
    # lengths of all texts; the table has a row for each source
    sizes = docs.groupBy(col(source_col).alias("src")).agg(F.coalesce(F.sum(F.length(col(text_col))), F.lit(0)).alias("size"))
    sizes = written(sizes, "mix-sizes")
    have = sizes.where("size > 0")
    if weights is None:
        share = have.withColumn("w", F.lit(1.0))
    else:
        pairs = sorted(((k, float(v)) for k, v in weights.items() if v > 0), key=lambda x: (x[0] is not None, x[0] or ""))
        wanted = docs.sparkSession.createDataFrame(pairs, "k string, w double")
        share = have.join(F.broadcast(wanted) if len(pairs) * 64 <= BROADCAST_BYTES else wanted, F.expr("cast(src AS string) <=> k"), "inner").select("src", "size", "w")
    total = have.agg(F.sum("size").alias("total"))
    scaled = share.crossJoin(F.broadcast(share.agg(F.sum("w").alias("all_w")))).crossJoin(F.broadcast(total))
    rates = scaled.select(F.coalesce(F.col("src").cast("string"), F.lit("")).alias("src"), F.col("src").isNull().alias("is_null"), (F.col("w") / F.col("all_w") * F.col("total") * F.lit(float(epochs)) / F.col("size")).alias("rate"))
    cdf = rates.mapInPandas(_tables, "src string, is_null boolean, cdf array<double>")
    cdf = written(cdf.select(F.struct("src", "is_null").alias(src), F.col("cdf").alias(table)), "mix-cdf")
    ident = F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(col(text_col), F.lit(""))))
    rows = docs.withColumn(src, F.struct(F.coalesce(col(source_col).cast("string"), F.lit("")).alias("src"), col(source_col).isNull().alias("is_null"))).withColumn(key, ident)
    room = cdf.agg(F.sum(F.size(table) * 8 + 64)).first()[0] or 0
    # the number is bound to a variable of its own, so that it is hashed once a row and not once for each probability
    drawn_at = F.transform(F.array(uniform(F.concat(col(key), F.lit(":n")))), lambda u: F.size(F.filter(col(table), lambda c: c <= u)))
    drawn = rows.join(F.broadcast(cdf) if room <= BROADCAST_BYTES else cdf, src).withColumn(times, drawn_at[0])
    copies = drawn.where(col(times) > 0).select(*map(col, docs.columns), col(key), F.explode(F.sequence(F.lit(0), col(times) - 1)).alias(at))
    order = F.md5(F.concat(col(key), F.lit(":"), col(at).cast("string")))
    mixed = copies.withColumn(key, order)
    mixed = mixed.repartition(partitions(docs), col(key)).sortWithinPartitions(col(key), col(at))
    return mixed.select(*map(col, docs.columns), *([col(at).alias(copy_col)] if copy_col else []))


MIX_SQL = f"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0)::BIGINT AS size FROM documents GROUP BY source),
have AS (SELECT * FROM sizes WHERE size > 0),
rates AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM have)::DOUBLE) * (SELECT sum(size) FROM have)::DOUBLE * {EPOCHS}::DOUBLE / size AS rate FROM have),
pmf AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
        FROM (SELECT source, rate, unnest(range(0, (rate + 20 * sqrt(rate) + 60)::BIGINT)) AS k FROM rates)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM pmf WHERE k <= rate OR p >= {TAIL}),
keyed AS (SELECT *, '17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key FROM documents),
drawn AS (SELECT *, ('0x' || substr(md5(key || ':n'), 1, {DIGITS}))::BIGINT::DOUBLE / {16**DIGITS}::DOUBLE AS u FROM keyed),
times AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.key, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM times WHERE n > 0
"""
