"""Mixing sources to target weights by Sainte-Laguë apportionment.

The size of a document is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources, in code point order with
null last, weigh ``WEIGHTS`` in turn and share 100 % of all sizes; a target stops at ``MAX_REPEATS`` times
its source's size and the excess is shared by weight among the others (water-filling, in closed form).

1. Blocks of ``BLOCK`` words are given to sources by highest quotients target/(2k-1).
2. A source's documents are dealt to shards by a seeded hash; the source's blocks are given to its
   shards, again by highest quotients, so that each shard has an integer quota.
3. In a shard, documents stand in a second seeded order; the first blocks of that order are taken, and
   those of further rounds when the quota exceeds the shard. A document's words in taken blocks count.

A shard has about ``SHARD_ROWS`` documents whatever the size of its source, so that a source that holds
a third of all rows is many small sorts. Sorts over sources and over the shards of a source see one row
per source or shard. All is DataFrame functions; the order comes from MD5, so reruns agree.

Defined results: a null text has size 0 and a taken of 0; a null source is a source of its own;
repeated rows are documents of their own; an empty table gives no rows; other columns are ignored by
``mix_counts`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 16
SHARD_ROWS = 4096
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _apportioned(rows: DataFrame, group: list[str], key: list[Column], weight: str, seats: str, cap: str) -> DataFrame:
    """Add ``quota``: the ``seats`` of each group given to its rows by highest quotients weight/(2k-1).

    Dividing by the average weight of a seat and rounding is right but for a few seats; these are added
    by the highest quotients not yet used, or taken back by the lowest used. A row that can need n such
    steps offers n quotients, and all rows together about as many as there are rows.
    """
    by = Window.partitionBy(*group)
    quota = F.when(F.col("total") > 0, F.floor(F.col(weight) * F.col(seats) / F.col("total") + 0.5)).otherwise(0).cast("long")
    rows = rows.withColumn("total", F.sum(weight).over(by)).withColumn("members", F.count(F.lit(1)).over(by)).withColumn("q0", quota)
    rows = rows.withColumn("lack", F.col(seats) - F.sum("q0").over(by))
    steps = F.when(F.col("lack") != 0, F.floor(F.col(weight) / F.col("total") * (F.abs("lack") + F.col("members"))) + 2).otherwise(0)
    rows = rows.withColumn("steps", F.when(F.col("lack") < 0, F.least(steps, F.col("q0"))).when(F.col(weight) > 0, steps).otherwise(0).cast("int"))
    rows = rows.withColumn("turn", F.row_number().over(by.orderBy(*key)))
    offers = rows.withColumn("step", F.explode(F.expr("case when steps > 0 then sequence(1, steps) else array() end")))
    divisor = F.when(F.col("lack") > 0, 2 * (F.col("q0") + F.col("step")) - 1).otherwise(2 * (F.col("q0") - F.col("step") + 1) - 1)
    quotient = F.col(weight) / divisor * F.signum(F.col("lack").cast("double"))
    # Equal quotients go to the first row, so they are taken back from the last one.
    tie = F.col("turn") * F.signum(F.col("lack").cast("double"))
    ranked = offers.withColumn("place", F.row_number().over(by.orderBy(quotient.desc(), tie, "step"))).where(F.col("place") <= F.abs("lack"))
    names = [c for c in dict.fromkeys([*group, *[k for k in rows.columns if k in ("src", "shard")]])]
    extra = ranked.groupBy(*names).agg(F.sum(F.signum(F.col("lack").cast("double"))).cast("long").alias("more"))
    on = None
    extra = extra.select(*[F.col(n).alias(f"x_{n}") for n in names], "more")
    for n in names:
        on = F.col(n).eqNullSafe(F.col(f"x_{n}")) if on is None else on & F.col(n).eqNullSafe(F.col(f"x_{n}"))
    done = rows.join(extra, on, "left").withColumn("quota", F.least(F.col("q0") + F.coalesce("more", F.lit(0)), F.col(cap)))
    return done.drop(*[f"x_{n}" for n in names], "more", "total", "members", "q0", "lack", "steps", "turn")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From rows (src, source_size): src, source_size, target. Sources are ranked by one sort of one row each."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("src").isNull(), "src")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sizes.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", MAX_REPEATS * F.col("source_size")).withColumn("all_words", F.sum("source_size").over(everything))
    level = everything.orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), "src")
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level if all sources before this one are full and none after; it settles at the first that isn't full.
    lam = (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("lam", lam).withColumn("place", F.row_number().over(level))
    settled = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("lam"), F.struct("place", "lam"))).over(everything)["lam"]
    share = F.when(F.col("cap") <= F.col("weight") * settled, F.col("cap").cast("double")).otherwise(F.col("weight") * settled)
    return ranked.select("src", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), "none").otherwise(F.concat(F.lit("is "), source.cast("string")))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of each row with __size, __source_size, __target, __taken, __start, __shard_size, __words."""
    small = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("src"), word_count(F.col(f"`{text_col}`")).alias("size"))
    counts = small.agg(F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-counts["n"] // SHARD_ROWS))
    shard = lambda c: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}/shard/"), F.coalesce(c.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long"), F.lit(shards))
    by_shard = small.groupBy("src", shard(F.col("id")).alias("shard")).agg(F.sum("size").alias("shard_size"))
    targets = source_targets(by_shard.groupBy("src").agg(F.sum("shard_size").alias("source_size")))
    everything = Window.partitionBy(F.lit(0))
    blocks = targets.withColumn("one", F.lit(0)).withColumn("seats", F.floor(F.sum("source_size").over(everything) / BLOCK + 0.5))
    blocks = blocks.withColumn("most", F.floor(F.col("target") / BLOCK + 1).cast("long"))
    by_source = _apportioned(blocks, ["one"], [F.col("src").isNull(), F.col("src")], "target", "seats", "most").select("src", "source_size", "target", "quota")
    parts = by_shard.alias("a").join(by_source.select(F.col("src").alias("s_src"), "source_size", "target", F.col("quota").alias("seats")), F.col("src").eqNullSafe(F.col("s_src"))).drop("s_src")
    parts = parts.withColumn("most", F.ceil(MAX_REPEATS * F.col("shard_size") / BLOCK))
    quotas = _apportioned(parts, ["src"], [F.col("shard")], "shard_size", "seats", "most").select(
        _key(F.col("src")).alias("key"), "shard", "source_size", "target", "shard_size", F.least(F.col("quota") * BLOCK, MAX_REPEATS * F.col("shard_size")).alias("words")
    )
    quotas = written(quotas, "quotas")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)], F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("src"), word_count(F.col(f"`{text_col}`")).alias("size")
    ).select("*", shard(F.col("id")).alias("shard"), _key(F.col("src")).alias("key"))
    seeded = F.md5(F.concat(F.lit(f"{SEED}/order/"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    line = Window.partitionBy("key", "shard").orderBy(seeded, "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum("size").over(line) - F.col("size"))
    rows = rows.join(quotas, ["key", "shard"])  # dealt like the window, so that texts move once
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    rows = rows.withColumn("rounds", rounds).withColumn("rest", F.col("words") - F.col("rounds") * F.col("shard_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return rows.withColumn("part", part).select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("rounds").cast("long").alias("__rounds"), F.col("part").cast("long").alias("__part"),
    )


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    mixed = _mixed(docs, id_col, text_col, source_col, [id_col])
    return mixed.select(
        id_col, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__rounds") * F.col("__size") + F.col("__part")).alias("taken")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix itself: each document as often as it is taken, and its taken blocks as a shorter text."""
    mixed = _mixed(docs, id_col, text_col, source_col, docs.columns)
    whole = F.col("__part") == F.col("__size")
    times = F.col("__rounds") + F.when(F.col("__part") > 0, 1).otherwise(0)
    copies = mixed.withColumn("__times", times.cast("int")).where("__times > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    words = F.split(F.regexp_replace(F.col(f"`{text_col}`"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    head = F.array_join(F.slice(words, F.lit(1), F.col("__part").cast("int")), " ")
    copies = copies.withColumn("__short", F.when((F.col("__k") > F.col("__rounds")) & ~whole, head))
    kinds = dict(docs.dtypes)
    value = {text_col: F.coalesce("__short", F.col(f"`{text_col}`")), **({length_col: F.coalesce(F.length("__short").cast(kinds[length_col]), F.col(f"`{length_col}`"))} if length_col in kinds else {})}
    return copies.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in docs.columns])
