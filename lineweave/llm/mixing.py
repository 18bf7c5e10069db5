"""Mixing sources to target weights, in DataFrame functions only.

A source's documents form one stream of words, cut into blocks of ``BLOCK`` words.  A source's quota of slots is its target
in blocks.  Each slot draws its output shard by hash, so a source's counts per shard are multinomial with the quota as their sum:
every source comes to its target exactly, which counts without a fixed sum would miss by the root of their number.  Slot j of a
source takes block perm(j mod n), where perm is the source's own pseudorandom permutation of its n block indexes: a swap-or-not
shuffle of ``ROUNDS`` rounds, a bijection for any n, keyed by seed and source.  So the blocks that an unfinished last round through
the source takes are spread over it, and the draw decides which blocks, hence which documents, a shard holds.  Slots are gathered per
block (``MOST`` at most), then joined by block index with the documents that lie in it.

Targets: weights share the total size; a target stops at ``MOST`` times its source's size and the excess is shared by weight
among the others.  With sources in order of size per weight the capped ones come first, so running sums find the level at once.
As quotas are at most ``MOST`` times n, no block is taken more often than that, so neither is a document.

A document's place in its source's stream comes from three levels of running sums: within a chunk of some ``DOCS_PER_CHUNK``
documents, over the ``CHUNKS_PER_GROUP`` chunks of a group, and over groups.  Chunks are dealt by hash of the id and are far smaller
than a task's share, so a source with a third of all rows is spread evenly.

Edge cases: null or empty text has size 0 and is taken 0 times, by no shard (null); a null source is a source of its own, the last
one; ids may be of any type that casts to a string, null ids are kept; rows with equal ids are documents of their own; an empty table
gives no rows; columns of other names are passed by.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, key_of, n_words, written

BLOCK = 128
#: Repeats of a source at most (contract).
MOST = 3
#: Weights of the sources in turn (contract).
WEIGHTS = (1, 2, 3)
#: Slots of an output shard on average.
SHARD_SLOTS = 1024
DOCS_PER_CHUNK = 256
CHUNKS_PER_GROUP = 512
SEED = 42
#: Rounds of a permutation, and the prime of its round function.
ROUNDS = 16
PRIME = (1 << 31) - 1
#: Slots that a task makes, and those that one row stands for until then.
SLOTS_PER_TASK = 1 << 17
_SLOT_CHUNK = 1 << 12


def drawn(*parts: Column | str | int) -> Column:
    """A 60-bit number from the MD5 of the parts joined by bars, nulls left out; the same on any engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def round_constants(seed: int = SEED) -> list[tuple[int, int]]:
    """Multiplier and addend of each round's function."""
    number = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    return [(number(seed, "mult", i) % (PRIME - 1) + 1, number(seed, "add", i) % PRIME) for i in range(ROUNDS)]


def permuted(x: Column, n: Column, rounds: Column) -> Column:
    """The place of index ``x`` below ``n`` in the permutation of ``rounds``, an array of (pivot, mult, add).

    A round mirrors x at its pivot or leaves it; both mirror images ask the same bit, so each round is its own inverse.
    """

    def step(at, r):
        other = (r["pivot"] + n - at) % n
        bit = F.floor(((F.greatest(at, other) % PRIME) * r["mult"] + r["add"]) % PRIME / 4096) % 2
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(rounds, x, step)


def n_chunks(rows: int) -> int:
    return max(1, math.ceil(rows / DOCS_PER_CHUNK))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(key, source, rank, weight, source_size, target, n_blocks, quota, rounds): one row per source of ``sizes(key, source, size)``.

    Running sums here go over one row per source.
    """
    total = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = total.withColumn("rank", rank.cast("long")).withColumn("weight", weight)
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    cap = F.col("source_size") * most
    run = ranked.withColumn("cap", cap).withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    run = run.withColumn("left", F.col("all_size") - (F.sum("cap").over(up) - F.col("cap"))).withColumn("left_weight", F.col("all_weight") - (F.sum("weight").over(up) - F.col("weight")))
    run = run.withColumn("capped", F.col("cap") * F.col("left_weight") < F.col("weight") * F.col("left"))
    run = run.withColumn("free_size", F.col("all_size") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
    run = run.withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(every))
    share = F.col("weight") * F.col("free_size") / F.greatest("free_weight", F.lit(1))
    run = run.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share))
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    run = run.withColumn("n_blocks", blocks)
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1)) + 0.5)).otherwise(0)
    pivot = lambda i: drawn(seed, "pivot", F.col("rank"), i) % F.greatest("n_blocks", F.lit(1))
    rounds = F.array(*[F.struct(pivot(i).alias("pivot"), F.lit(a).cast("long").alias("mult"), F.lit(b).cast("long").alias("add")) for i, (a, b) in enumerate(round_constants(seed))])
    return run.select("key", "source", "rank", "weight", "source_size", "target", "n_blocks", quota.cast("long").alias("quota"), rounds.alias("rounds"))


def slots(targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, slot, epoch, block, shard): every slot of the mix, the block it takes and the shard it draws."""
    n_slots = F.sum("quota").over(Window.partitionBy())
    shards = F.greatest(F.ceil(F.col("n_slots") / SHARD_SLOTS), F.lit(1)).cast("long")
    kept = ["key", "rank", "n_blocks", "rounds", "shards"]
    # a few rows become many, so the number of tasks is said, or they would be made by one
    tasks = math.ceil((targets.agg(F.sum("quota")).first()[0] or 1) / SLOTS_PER_TASK)
    chunks = (
        targets.withColumn("n_slots", n_slots).withColumn("shards", shards).where("quota > 0")
        .select(*kept, "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(_SLOT_CHUNK).cast("long"))).alias("lo"))
        .repartition(tasks, "key", "lo")
    )
    each = chunks.select(*kept, F.explode(F.sequence("lo", F.least(F.col("lo") + _SLOT_CHUNK, F.col("quota")) - 1)).alias("slot"))
    block = permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.col("rounds"))
    return each.select("key", "slot", F.floor(F.col("slot") / F.col("n_blocks")).cast("long").alias("epoch"), block.alias("block"), (drawn(seed, "shard", F.col("rank"), F.col("slot")) % F.col("shards")).alias("shard"))


def shard_counts(targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, key, n): how many slots of each source each output shard has."""
    return slots(targets, seed).groupBy("shard", "key").agg(F.count("*").alias("n"))


def block_shards(targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, block, shards): the shards that take each block, one entry a slot, ``MOST`` at most."""
    return slots(targets, seed).groupBy("key", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))


def placed(rows: DataFrame, chunks: int, *order: str, seed: int = SEED) -> DataFrame:
    """Adds ``start``, the words before in the source's stream, to ``rows(key, size, ...)``; ``order`` begins with the id."""
    part = rows.withColumn("chunk", drawn(seed, "chunk", F.col(order[0])) % chunks).withColumn("group", F.floor(F.col("chunk") / CHUNKS_PER_GROUP))
    sums = part.groupBy("key", "group", "chunk").agg(F.sum("size").alias("words"))
    tops = sums.groupBy("key", "group").agg(F.sum("words").alias("words"))
    above = tops.select("key", "group", (F.sum("words").over(Window.partitionBy("key").orderBy("group")) - F.col("words")).alias("above"))
    inner = F.sum("words").over(Window.partitionBy("key", "group").orderBy("chunk")) - F.col("words")
    before = sums.withColumn("inner", inner).join(above.hint("merge"), ["key", "group"]).select("key", "chunk", (F.col("above") + F.col("inner")).alias("before"))
    own = Window.partitionBy("key", "chunk").orderBy(*order, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = part.withColumn("own", F.sum("size").over(own) - F.col("size")).join(before.hint("merge"), ["key", "chunk"])
    return summed.withColumn("start", F.col("before") + F.col("own")).drop("own", "before", "chunk", "group")


def pieces(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows(key, start, size, ...)`` once for each block that a document lies in and the mix takes: ``at``, ``words`` and ``shards``."""
    lo, hi = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(lo, hi)))
    at = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size"))
    # AQE would judge these columns by their compressed size and broadcast many rows
    return cut.join(blocks.hint("merge"), ["key", "block"]).withColumn("at", at).withColumn("words", end - at).drop("block")


def _measured(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, text_hash, key, source, size) of each row.  Texts are read once and not shuffled."""
    text = F.col("text")
    return written(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), key_of(F.col("source")).alias("key"), "source", n_words(text).alias("size")), "sizes")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, n_shards, first_shard): one row per row of ``docs(id, text, source)``.

    ``taken`` are the words the mix takes, repeats counted; ``n_shards`` output shards hold some of them, ``first_shard`` is the lowest.
    """
    sizes = _measured(docs, id_col)
    targets = written(source_targets(sizes, seed=seed), "targets")
    rows = placed(sizes.select("id", "key", "size"), n_chunks(sizes.count()), "id", seed=seed)
    held = F.array_distinct(F.flatten(F.collect_list("shards")))
    taken = pieces(rows.select("key", "start", "size"), block_shards(targets, seed)).groupBy("key", "start").agg(F.sum(F.col("words") * F.size("shards")).alias("taken"), held.alias("held"))
    told = taken.select("key", "start", "taken", F.size("held").cast("long").alias("n_shards"), F.array_min("held").alias("first_shard"))
    some = ["id", "key", "size", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"), "first_shard"]
    with_words = rows.where("size > 0").join(told.hint("merge"), ["key", "start"], "left").select(*some)
    none = F.lit(0).cast("long")
    all_rows = with_words.unionByName(sizes.where("size = 0").select("id", "key", "size", none.alias("taken"), none.alias("n_shards"), F.lit(None).cast("long").alias("first_shard")))
    return all_rows.join(targets.select("key", "source_size", "target"), "key").select("id", "size", "source_size", "target", "taken", "n_shards", "first_shard")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one row per document and epoch with the words taken in it.

    A document that an epoch takes whole keeps its text as it is; of others the words taken are joined by spaces.  ``n_chars``,
    if there, is counted anew.  What is taken is found from narrow rows; the texts are shuffled once, to meet it.  Rows of equal id,
    text and source are told apart by their other columns.
    """
    names = docs.columns
    sizes = _measured(docs, id_col)
    targets = written(source_targets(sizes, seed=seed), "targets")
    rows = placed(sizes.select("id", "text_hash", "key", "size").where("size > 0"), n_chunks(sizes.count()), "id", "text_hash", seed=seed)
    part = F.struct("at", "words", F.size("shards").alias("times"))
    of = ["id", "text_hash", "key", "start", "size"]
    parts = pieces(rows.select(*of), block_shards(targets, seed)).groupBy(*of).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    # rows of equal id, text and source share one array, so that the texts need one shuffle only
    same = ["row_id", "text_hash", "key"]
    listed = parts.groupBy(key_of(F.col("id")).alias("row_id"), "text_hash", "key").agg(F.sort_array(F.collect_list(F.struct("start", "size", "parts"))).alias("places"))
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key_of(F.col(f"`{id_col}`")).alias("row_id"), F.xxhash64("text").alias("text_hash"), key_of(F.col("source")).alias("key"))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("row")))
    met = wide.join(listed.hint("merge"), same).withColumn("place", F.get("places", nth - 1)).where("place is not null")
    epochs = F.sequence(F.lit(1), F.array_max(F.transform("place.parts", lambda p: p["times"])))
    now = met.select("row", "place", F.explode(epochs).alias("epoch")).select("row", F.col("place.size").alias("size"), F.filter("place.parts", lambda p: p["times"] >= F.col("epoch")).alias("now"))
    whole = F.aggregate("now", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("size")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})"), F.lit(1))
    text = F.when(F.col("words").isNull(), F.col("row.text")).otherwise(F.array_join(F.flatten(F.transform("now", lambda p: F.slice(F.col("words"), (p["at"] + 1).cast("int"), p["words"].cast("int")))), " "))
    out = now.withColumn("words", F.when(~whole, words)).withColumn("mixed", text)
    made = {"text": F.col("mixed")}
    if "n_chars" in names:
        made["n_chars"] = F.length("mixed").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
