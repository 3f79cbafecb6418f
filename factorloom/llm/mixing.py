"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, scaled by its quality weight. A
source's target is met by whole epochs first; the rest is a weighted sample
without replacement: documents in key order until the words add up. The
document on which the budget ends gives only its first words.

The running sum over a source is split: documents fall into ranges of their
keys, ranges are summed, and only the range in which the budget ends is looked
at row by row. A source with a third of all rows thus never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import WORD, materialize, table

#: Weights by code-point order of the sources, repeating.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
KEY_RANGES = 1024
#: The plan has a row per source; up to so many it is sent to all tasks, beyond that joined.
MAX_BROADCAST_SOURCES = 20_000
_SYMBOLS = "#*$%&|<>"
_HEX_DIGITS = 12


def text_size(text: str = "text") -> Column:
    """Words of the whole text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: str = "text") -> Column:
    """Weight between 1/21 and 1, lower the more symbols a text holds."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    symbols = n - F.length(F.translate(F.coalesce(F.col(text), F.lit("")), _SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * symbols / F.greatest(n, F.lit(1)))


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u in (0, 1) drawn from the document's id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double")
    return -F.ln((draw + 1.0) / float(16**_HEX_DIGITS + 1)) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Sources share ``total_share`` of all sizes by their weights; none goes
    above ``max_epochs`` times its size, the excess goes to the others. In order
    of size per weight those at their limit come first, so one running sum finds
    the level at which the others stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumns({"__w": w, "__cap": (F.col("source_size") * max_epochs).cast("double")})
    by_fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, all_rows = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    taken = F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    left = F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(all_rows) * total_share - taken) / left
    rows = rows.withColumn("__level", level)
    rows = rows.withColumn("__free", F.col("__level") * F.col("__w") <= F.col("__cap"))
    stop = F.min(F.when(F.col("__free"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level")))).over(all_rows)["__level"]
    target = F.when(F.col("__free"), stop * F.col("__w")).otherwise(F.col("__cap"))
    return rows.withColumn("target", target).drop("__w", "__cap", "__level", "__free")


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    quality=text_quality,
    key_ranges: int = KEY_RANGES,
) -> DataFrame:
    """Add size, source_size, target and taken to ``docs`` (doc_id, text, source).

    ``taken`` counts the words of a document that the mix takes, with repeats:
    whole epochs times its size, and the words of the fractional sample. Null
    texts have size 0, a null source is a source of its own, null doc_ids share
    one draw. Rows that repeat a doc_id tie; if the budget ends on them, they
    share what is left evenly. The same rows always give the same mix.
    """
    size, key = text_size(), sampling_key(F.col("doc_id"), quality(), seed)
    light = materialize(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "mix")
    by_range = F.least(F.floor((1 - F.exp(-F.col("key"))) * key_ranges), F.lit(key_ranges - 1)).cast("int")
    light = light.withColumn("range", by_range)
    sums = materialize(light.groupBy("source", "range").agg(F.sum("size").alias("n")), "mix-sums")
    sources = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, total_share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    sources = sources.withColumn("epochs", whole.cast("long"))
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    sources = materialize(sources.withColumn("budget", budget), "mix-sources")

    # The range of keys in which each source's budget ends, then the document.
    in_order = Window.partitionBy("source").orderBy("range")
    upto = sums.withColumn("before", F.sum("n").over(in_order) - F.col("n"))
    ends = upto.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("n")))
    ends = ends.select("s", F.col("range").alias("r"), "before", "budget")
    near = light.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    ties = near.groupBy("s", "before", "budget", "key", "doc_id").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    by_key = Window.partitionBy("s").orderBy("key", F.col("doc_id").asc_nulls_first())
    ties = ties.withColumn("at", F.col("before") + F.sum("n").over(by_key) - F.col("n"))
    ties = ties.where((F.col("at") <= F.col("budget")) & (F.col("budget") < F.col("at") + F.col("n")))
    cut = ties.select(
        F.col("s").alias("c"), F.struct(F.col("key").alias("k"), F.col("doc_id").alias("d")).alias("cut"),
        F.floor((F.col("budget") - F.col("at")) / F.col("rows")).cast("long").alias("part"),
    )
    plan = sources.join(cut, F.col("source").eqNullSafe(F.col("c")), "left")
    plan = plan.select(F.col("source").alias("__s"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "epochs", "budget", "cut", "part")])
    plan = materialize(plan, "mix-plan")
    if plan.count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)

    out = docs.withColumns({"__size": size, "__key": F.struct(key.alias("k"), F.col("doc_id").alias("d"))})
    out = out.join(plan, F.col("source").eqNullSafe(F.col("__s")), "left")
    sample = (
        F.when(F.col("__budget") <= 0, 0)
        .when(F.col("__cut").isNull() | (F.col("__key") < F.col("__cut")), F.col("__size"))
        .when(F.col("__key") == F.col("__cut"), F.least(F.col("__part"), F.col("__size")))
        .otherwise(0)
    )
    named = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target")}
    out = out.withColumns(named | {"taken": (F.col("__epochs") * F.col("__size") + sample).cast("long")})
    return out.drop("__size", "__key", "__s", "__source_size", "__target", "__epochs", "__budget", "__cut", "__part")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document that is taken
    twice comes twice, and the one on which a budget ends is cut after its words.

    Documents of size 0 carry no words and are left out.
    """
    new = ("size", "source_size", "target", "taken")
    clash = [c for c in docs.columns if c in new]
    rows = mix_sources(docs.withColumnsRenamed({c: f"__in_{c}" for c in clash}), **options)
    copies = F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), i -> i * size <= taken)")
    rows = rows.where("taken > 0 and size > 0").withColumn("__whole", F.explode(copies))
    rows = rows.withColumn("__text", F.when(F.col("__whole"), F.col("text")).otherwise(first_words(F.col("text"), F.col("taken") % F.col("size"))))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__whole"), F.col("n_chars")).otherwise(F.length("__text")))
    rows = rows.drop(*new, "text").withColumnsRenamed({"__text": "text"} | {f"__in_{c}": c for c in clash})
    return rows.select(*docs.columns)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: doc_id, size, source_size, target, taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_sql() -> str:
    """The same by plain windows over whole sources."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, {_HEX_DIGITS}))::BIGINT::DOUBLE + 1.0) / {16**_HEX_DIGITS + 1}::DOUBLE)
      / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{_SYMBOLS}', '')))::DOUBLE
         / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {weight} AS w, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {TOTAL_SHARE}::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level * w <= cap
        THEN (SELECT x.level FROM l x WHERE x.level * x.w <= x.cap ORDER BY x.cap / x.w, x.level LIMIT 1) * w ELSE cap END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT *, round(target - epochs * source_size)::BIGINT AS budget FROM e),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM c"""
