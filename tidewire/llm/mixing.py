"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sources get targets in words: shares of the whole by repeating weights, stopped at `most` times the
source's size, the excess reshared. Within a source a document's expected copies grow with the
bit length of its size (a mild preference for longer contexts; any small integer measure will do),
capped at `most` and scaled so that the expected words meet the target. The whole part of the
expectation is allocated for certain. Its fraction p is an inclusion probability: documents are ranked
by the Pareto variable, the odds of a uniform random number (a hash of doc_id) divided by the
odds of p, and the sample is the longest prefix of that order whose words fit the remaining target;
one closing document, the one nearest in size to what is still missing, may follow.

No group meets in one task: sizes are summed per source and measure, the rank order is cut by a
histogram of 4096 bins per source, and only the bin where the target falls is sorted.

Cases: null and word-less texts have size 0 and are taken 0 times; a null source is a source of
its own, the last; rows with equal doc_id, source and size are taken or left together, a null doc_id
being a value like any other; no documents give no rows; other columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm._shared import fresh, n_words, stored

WEIGHTS = (1, 2, 3)
MOST = 3
BINS = 4096
SEED = "mix-1"


def _uniform(doc_id: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on doc_id and seed only."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _measure(size: Column) -> Column:
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, words) -> source, source_size, target. One short row per source meets in one task."""
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(ordered) - 1
    s = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / F.sum("w").over(after).cast("double"))
    s = s.withColumn("full", (most * F.col("source_size")).cast("double") <= F.col("w") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * level).alias("target"))


def _expectations(cells: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """Per source and measure: copies for certain, inclusion probability of one more, words left for that."""
    key = _source_key(F.col("source")).alias("src")
    c = cells.select(key, "m", "words").join(goal.select(key, "source_size", "target"), "src")
    large_first = Window.partitionBy("src").orderBy(F.col("m").desc())
    above = F.coalesce(F.sum("words").over(large_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("m") * F.col("words")).over(large_first.rowsBetween(0, Window.unboundedFollowing))
    c = c.withColumn("scale", (F.col("target") - (most * above).cast("double")) / F.nullif(rest, F.lit(0)).cast("double"))
    open_ = F.max(F.when(F.col("scale") * F.col("m") < most, F.col("scale"))).over(Window.partitionBy("src"))
    expected = F.when(F.col("m") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce(open_ * F.col("m"), F.lit(float(most)))))
    c = c.withColumn("expected", F.greatest(expected, F.lit(0.0))).withColumn("certain", F.floor("expected").cast("long"))
    left = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("src")).cast("double")
    return c.select("src", "m", "source_size", "target", "certain", (F.col("expected") - F.col("certain")).alias("p"), left.alias("left"))


def _cuts(units: DataFrame) -> DataFrame:
    """Per source: the bin and the last key that the sample takes, and the key of the closing unit."""
    pool = units.where("p > 0")
    histogram = pool.groupBy("src", "left", "bin").agg(F.sum("unit").alias("unit"))
    upto = F.sum("unit").over(Window.partitionBy("src").orderBy("bin"))
    over = histogram.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
    cut = over.groupBy("src").agg(F.min("bin").alias("cut_bin"), F.min(F.struct("bin", (F.col("upto") - F.col("unit")).alias("before"))).alias("x"), F.first("left").alias("left")).select("src", "cut_bin", F.col("x.before").alias("before"), "left")
    key = F.struct("q", "doc_id", "size")
    inside = pool.drop("left").join(cut, "src").where("bin = cut_bin")
    fit = inside.withColumn("run", F.col("before") + F.sum("unit").over(Window.partitionBy("src").orderBy("q", "doc_id", "size"))).where(F.col("run") <= F.col("left"))
    last = fit.groupBy("src").agg(F.max(key).alias("cut_key"), F.max("run").alias("run"))
    cut = cut.join(last, "src", "left").select("src", "cut_bin", "cut_key", (F.col("left") - F.coalesce("run", "before")).alias("gap"))
    free = pool.join(cut, "src").where(~_taken(key))
    off = F.abs(F.col("unit") - F.col("gap"))
    closing = free.where(off < F.col("gap")).groupBy("src").agg(F.min(F.struct(off.alias("off"), "q", "doc_id", "size")).alias("c"))
    return cut.join(closing, "src", "left").select("src", "cut_bin", "cut_key", F.struct("c.q", "c.doc_id", "c.size").alias("closing"), F.col("c").isNotNull().alias("closes"))


def _taken(key: Column) -> Column:
    """Whether the sample's prefix has a unit; without a cut it has all."""
    return F.coalesce(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (key <= F.col("cut_key"))), F.lit(False))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def allocate(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, keep_columns: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    With `keep_columns` all columns of the documents come first and these (but doc_id) follow.
    """
    made = dict(zip(("size", "source_size", "target", "taken", "copies"), fresh(documents, "size", "source_size", "target", "taken", "copies")))
    base = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row") if keep_columns else F.lit(0).alias("row"), "doc_id", F.col("source").alias("source"), n_words(F.col("text")).alias("size"))
    base = base.select("row", "doc_id", _source_key(F.col("source")).alias("src"), "source", "size", _measure(F.col("size")).alias("m"), _uniform(F.col("doc_id"), seed).alias("u"))
    sized = stored(base.drop("row"))
    cells = sized.groupBy("source", "m").agg(F.sum("size").alias("words"))
    classes = _expectations(cells, targets(cells.select("source", "words"), weights, most), most)
    classes = stored(classes)
    units = sized.where("m > 0").groupBy("src", "doc_id", "size", "m", "u").agg((F.count("*") * F.first("size")).alias("unit"))
    cuts = stored(_cuts(stored(_ranked(units.join(classes.where("p > 0"), ["src", "m"])))))
    rows = _ranked((base if keep_columns else sized).join(classes, ["src", "m"])).join(cuts, "src", "left")
    key = F.struct("q", "doc_id", "size")
    extra = F.when((F.col("p") > 0) & (_taken(key) | (F.coalesce(F.col("closes"), F.lit(False)) & key.eqNullSafe(F.col("closing")))), 1).otherwise(0)
    rows = rows.withColumn("copies", F.col("certain") + extra)
    out = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("copies") * F.col("size"), "copies": F.col("copies")}
    return rows.select(*(["row.*"] if keep_columns else ["doc_id"]), *(v.alias(made[k] if keep_columns else k) for k, v in out.items()))


def _ranked(joined: DataFrame) -> DataFrame:
    """Adds the Pareto variable q and its bin."""
    q = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    return joined.withColumn("q", q).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS))


#: The same in SQL; the prefix is summed in one window per source instead of a histogram.
SQL = """
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
sized AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS m FROM base),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM src),
levels AS (
  SELECT *, CAST((sum(source_size) OVER ()) - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted),
capped AS (SELECT *, CAST(3 * source_size AS DOUBLE) <= w * level AS is_full FROM levels),
goal AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE w * max(CASE WHEN NOT is_full THEN level END) OVER () END AS target
  FROM capped),
cells AS (SELECT source, m, sum(size) AS words FROM sized GROUP BY source, m),
scaled AS (
  SELECT c.source, c.m, c.words, g.source_size, g.target,
         (g.target - CAST(3 * coalesce(sum(c.words) OVER (PARTITION BY c.source ORDER BY c.m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(nullif(sum(c.m * c.words) OVER (PARTITION BY c.source ORDER BY c.m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS scale
  FROM cells c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source),
expected AS (
  SELECT *, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(3.0::DOUBLE, coalesce(m * max(CASE WHEN scale * m < 3 THEN scale END) OVER (PARTITION BY source), 3.0::DOUBLE))) END AS expected
  FROM scaled),
classes AS (
  SELECT source, m, source_size, target, CAST(floor(expected) AS BIGINT) AS certain, expected - floor(expected) AS p,
         target - CAST(sum(floor(expected) * words) OVER (PARTITION BY source) AS DOUBLE) AS remaining
  FROM expected),
rows_ AS (
  SELECT s.doc_id, s.source, s.size, c.source_size, c.target, c.certain, c.p, c.remaining,
         CASE WHEN c.p > 0 THEN (s.u / (1 - s.u)) / (c.p / (1 - c.p)) END AS q
  FROM sized s JOIN classes c ON s.source IS NOT DISTINCT FROM c.source AND s.m = c.m),
run AS (
  SELECT source, doc_id, size, q, remaining, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM rows_ WHERE p > 0),
gaps AS (SELECT source, any_value(remaining) - coalesce(max(CASE WHEN run <= remaining THEN run END), 0) AS gap FROM run GROUP BY source HAVING max(run) > any_value(remaining)),
closing AS (
  SELECT source, arg_min(doc_id, (off, q, doc_id, size)) AS doc_id FROM (
    SELECT r.*, abs(r.size - g.gap) AS off, g.gap FROM run r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source WHERE r.run > r.remaining) t
  WHERE off < gap GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
FROM (
  SELECT r.*, r.certain + CASE WHEN n.run <= n.remaining OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END AS copies
  FROM rows_ r LEFT JOIN run n ON r.doc_id = n.doc_id LEFT JOIN closing c ON r.source IS NOT DISTINCT FROM c.source AND r.doc_id = c.doc_id) r
"""
