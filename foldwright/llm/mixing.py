"""Mixing sources to target weights, in DataFrame operations only.

1. Every document's size in words is summed per source; weights share the corpus, no source beyond
   ``max_repeat`` times its size (the excess is shared again by weight; solved in closed form by ordering
   sources by the level at which they hit their cap).
2. A source's documents are dealt into shards by a seeded hash. A shard orders its documents by another hash, which makes
   them one stream of words, and cuts it into blocks of ``BLOCK`` words; its last block may be short.
3. Seats are blocks. A source votes with its target in blocks of its own mean length, and Sainte-Lague gives out the
   blocks of the whole mix: seat k of a source has the quotient votes / (2k - 1), the highest quotients win. A
   source's blocks are then given to its shards in the same way, by the blocks they hold: every quota is a whole number.
4. A shard with a quota of q among n blocks takes all of them q div n times and q mod n of them once more, chosen
   systematically along the stream from a seeded start. Which words of a document lie in chosen blocks follows from its
   place in the stream, so no row is made per block.

A shard holds about ``SHARD_BLOCKS`` blocks, whatever its source: shards grow in number, and a hot source is many
shards. Seats are settled without listing them all: quotients above a bound are counted in closed form and about two
candidates per party are ranked. A source's words come within about a block of its target, and a block per shard where
last blocks are short.

Null text has size 0, a null source is a source (last in order), a null or repeated doc_id is an ordinary
row. Documents of no words are taken 0 times. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import empty_if_null, free_names
from foldwright.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
#: Words of a block, and blocks of a shard.
BLOCK, SHARD_BLOCKS = 128, 256
SEED = 17


def n_words(text: Column) -> Column:
    """Words are what white space separates; splitting is several times as fast as matching them."""
    inner = F.btrim(empty_if_null(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def _draw(*parts: Column | str) -> Column:
    """A reproducible whole number from 0 to 2^52, which does not depend on partitions."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(SEED)), *parts)), 1, 13), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weights by the order of the names, caps by size."""
    # one row per source: these windows see names and sums only
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    level = sources.withColumn("weight", weight).withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    share = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    # sources in the order in which they would hit their cap: the first that does not sets everyone's share
    level = level.withColumn("share", share).withColumn("free", F.col("cap") / F.col("weight") > F.col("share"))
    rest = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(Window.partitionBy())["share"]
    return level.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(rest * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: Column, group: list[str], name: list[str]) -> DataFrame:
    """``parties`` with ``won`` seats each: in every ``group`` the highest quotients votes / (2k - 1) win.

    With V votes for B seats of n parties, every quotient above V / (B - n/2) surely wins and none below
    V / (B + n/2) does, so at most about 2n candidates lie between. Equal quotients go by ``name``.
    """
    whole = Window.partitionBy(*group)
    p = parties.withColumn("_b", seats.cast("long")).withColumn("_v", F.sum(votes).over(whole).cast("double")).withColumn("_n", F.count(F.lit(1)).over(whole))
    # seat k is above the level x if votes / (2k - 1) > x / 2, i.e. k < votes / x + 1/2
    most = F.floor(F.col(votes) * (F.col("_b") + F.col("_n") / 2 + 1) / F.col("_v") + 0.5)
    least = F.floor(F.col(votes) * F.greatest(F.col("_b") - F.col("_n") / 2 - 1, F.lit(0)) / F.col("_v") + 0.5)
    p = p.withColumn("_sure", F.when(F.col("_v") > 0, F.greatest(least - 1, F.lit(0))).otherwise(0).cast("long"))
    p = p.withColumn("_most", F.when(F.col("_v") > 0, F.greatest(most, F.col("_sure"))).otherwise(0).cast("long"))
    p = p.withColumn("_open", F.col("_b") - F.sum("_sure").over(whole))
    seat = p.withColumn("_k", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most")))))
    quotient = F.when(F.col("_k").isNotNull(), F.col(votes) / (2 * F.col("_k") - 1))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in name]))
    seat = seat.withColumn("_won", (rank <= F.col("_open")) & F.col("_k").isNotNull())
    keep = [c for c in parties.columns]
    return seat.groupBy(*keep, "_sure").agg(F.count_if("_won").alias("_more")).withColumn("won", F.col("_sure") + F.col("_more")).drop("_sure", "_more")


def _chosen_before(j: Column, of: Callable[[str], Column]) -> Column:
    """Blocks chosen once more among the shard's first ``j``."""
    return F.floor((j * of("extra") + of("start")) / F.greatest(of("n_blocks"), F.lit(1)))


def _taken_before(x: Column, of: Callable[[str], Column] = F.col) -> Column:
    """Words of the shard's stream before word ``x`` that lie in blocks chosen once more."""
    j = F.floor(x / BLOCK)
    before = _chosen_before(j, of)
    return before * BLOCK + (_chosen_before(j + 1, of) - before) * (x - j * BLOCK)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per document: its size, its place in its shard's stream and the words taken of it."""
    text_key = F.xxhash64(empty_if_null(docs[text_col]))
    sizes = materialise(
        docs.select(docs[id_col].cast("long"), docs[source_col].cast("string"), n_words(docs[text_col]), text_key).toDF("doc_id", "source", "size", "text_key"),
        "mix-sizes",
    )
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    shards_of = F.greatest(F.round(F.col("source_size") / (BLOCK * SHARD_BLOCKS)), F.lit(1)).cast("long")
    targets = materialise(source_targets(sources, weights, max_repeat).withColumn("shards", shards_of), "mix-targets")

    # a row of ``targets`` per source is as small as the list of sources; joined by hash if that is large
    placed = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("shard", F.pmod(_draw(F.lit("shard"), F.col("doc_id").cast("string"), F.col("text_key").cast("string")), F.col("shards")))
    shards = placed.groupBy("source", "source_size", "target", "shard").agg(F.sum("size").alias("shard_size"))
    shards = materialise(shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / BLOCK).cast("long")), "mix-shards")

    held = shards.groupBy("source", "source_size", "target").agg(F.sum("n_blocks").alias("source_blocks"))
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(0.0)
    held = held.withColumn("votes", votes).withColumn("_all", F.round(F.sum("votes").over(Window.partitionBy())).cast("long"))
    won = sainte_lague(held, "votes", F.col("_all"), ["_all"], ["source"])
    won = materialise(won.select("source", F.col("won").alias("source_quota")), "mix-quotas")
    quota = shards.join(won.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quota = sainte_lague(quota, "n_blocks", F.col("source_quota"), ["source"], ["shard"])
    n = F.col("n_blocks")
    quota = quota.withColumn("quota", F.when(n > 0, F.least(F.col("won"), max_repeat * n)).otherwise(0))
    quota = quota.withColumn("extra", F.when(n > 0, F.pmod("quota", n)).otherwise(0)).withColumn("repeats", F.when(n > 0, F.floor(F.col("quota") / n)).otherwise(0))
    start = F.pmod(_draw(F.lit("start"), F.coalesce("source", F.lit("")), F.col("shard").cast("string")), F.greatest(n, F.lit(1)))
    quota = quota.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "n_blocks", "source_quota", "quota", "repeats", "extra", start.alias("start"))
    order = _draw(F.lit("order"), F.col("doc_id").cast("string"), F.col("text_key").cast("string"))
    stream = Window.partitionBy("source", "shard").orderBy(order, F.col("doc_id"), F.col("text_key"))
    placed = placed.withColumn("last", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.col("last") - F.col("size"))
    placed = placed.join(quota, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h")
    once_more = F.when(F.col("size") > 0, _taken_before(F.col("last")) - _taken_before(F.col("first"))).otherwise(0)
    return placed.withColumn("taken", (F.col("repeats") * F.col("size") + once_more).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shard's blocks and quota of blocks, one row per document."""
    return mix_plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "source", "source_quota", "shard", "n_blocks", "quota")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ``docs`` with one row per whole repeat, and one with the words of the blocks taken once more.

    The last has each word with the white space after it. Columns of ``docs`` are kept, with ``text_col``
    replaced.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **options).where("taken > 0")
    id_, key, nth, planned, copy = free_names(docs, "_id", "_key", "_nth", "_plan", "_copy")
    plan = plan.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.struct("size", "taken", "repeats", "first", "last", "extra", "start", "n_blocks").alias(planned))
    # rows that agree in identifier and text are interchangeable: each takes one of their plans
    plan = plan.withColumn(nth, F.row_number().over(Window.partitionBy(id_, key).orderBy(planned)))
    own = docs.withColumn(id_, docs[id_col].cast("long")).withColumn(key, F.xxhash64(empty_if_null(docs[text_col])))
    own = own.withColumn(nth, F.row_number().over(Window.partitionBy(id_, key).orderBy(F.lit(0))))
    on = own[id_].eqNullSafe(plan[id_]) & (own[key] == plan[key]) & (own[nth] == plan[nth])
    found = own.join(plan, on).select(*[own[c] for c in docs.columns], plan[planned])
    p = found[planned]
    rest = p["taken"] - p["repeats"] * p["size"]
    words = F.regexp_extract_all(found[text_col], F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))

    def block(j: Column) -> Column:
        begin = F.greatest(j * BLOCK, p["first"]) - p["first"]
        end = F.least((j + 1) * BLOCK, p["last"]) - p["first"]
        return F.slice(words, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    def is_chosen(j: Column) -> Column:
        return _chosen_before(j + 1, p.getField) > _chosen_before(j, p.getField)

    blocks = F.filter(F.sequence(F.floor(p["first"] / BLOCK), F.floor((p["last"] - 1) / BLOCK)), is_chosen)
    part = F.when(rest == p["size"], found[text_col]).when(rest > 0, F.array_join(F.flatten(F.transform(blocks, block)), ""))
    texts = F.concat(F.array_repeat(found[text_col], p["repeats"].cast("int")), F.array_compact(F.array(part)))
    out = found.withColumn(copy, F.explode(texts))
    return out.select(*[F.col(copy).alias(c) if c == text_col else F.col(c) for c in docs.columns])
