"""Near-duplicates by SimHash, checked and completed: texts whose five-word shingles are 4/5 alike or more (Jaccard) are linked, no others.

SimHash comes first: fingerprints of the shingle sets are compared bit-sliced (:mod:`.simhash`), and links are checked against the
sets.  But 64 bits can't bound the similarity: at 4/5 two fingerprints differ in some ten bits, and a radius that wide would link
or compare nearly everything.  So an exact search finds the links that fingerprints miss: with the shingles of all texts in one order,
two sets of similarity 4/5 or more share one of the first n - ceil(4n/5) + 1 of either, and the first one that they share stands so
early in both that what follows it can still reach 4/5.  The order is by how often a shingle was seen in a tenth of the texts, rare ones
first, then by hash: it decides which shingles are looked at, never which texts are linked.

Texts that share such a shingle are a bucket.  First each is compared with the bucket's centre, in which the shingle stands earliest, so
the one with the fewest shingles of its own; along with what SimHash found, this links most of a group of near copies.  Then all pairs of
a bucket whose components differ, and whose sizes and places allow 4/5, are compared.  So a large group of near copies costs no square of
its size, and no bucket is dropped, capped or sampled: one of over ``BLOCK`` rows is cut into blocks, and each two of them meet in a task.

What is kept of a text is narrow: a hash of its set, its fingerprint, its prefix, and counts of its shingles in cells, one for some
``PER_CELL`` shingles, which bound what two sets can share.  Sets are made again from the texts, of those only that the cells leave to be compared.

Edge cases: a text of fewer words than a shingle is one shingle; texts without words are copies of each other; repeated rows and
texts of equal sets are one node; null ids are kept; an empty table gives no rows; columns of other names are passed by.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.network import star_components
from . import simhash
from .common import arrow_map, written
from .quality import FILTER_BITS

#: Rule for near-duplicate stages: words of a shingle, and 4/5 as the least similarity.
SIZE = 5
#: One in so many texts is counted for the order, and shingles that the order knows at most (a matter of speed, never of results).
SEEN, KNOWN = 10, 1 << 18
#: Rows of a bucket that one task compares with each other.
BLOCK = 1 << 15
_MET = 1 << 17
#: Shingles in a cell, at most on average, and cells at least and at most.
PER_CELL, FEWEST, MOST = 4, 128, 1 << 16
#: Rows of an Arrow batch that holds sets or texts.
_ROWS = 256


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Distinct shingle hashes, ascending, as signed longs."""
    found = list(simhash.shingle_hashes(text, size))
    return np.sort(np.unique(np.concatenate(found)).view(np.int64)) if found else np.zeros(0, dtype=np.int64)


def node_of(shingles: np.ndarray) -> int:
    """A hash of the set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def cells_of(shingles: np.ndarray) -> bytes:
    """How many shingles are in each cell, 255 for more; the cells are a power of two, so many can be folded into few."""
    width = min(max(FEWEST, 1 << (max(len(shingles) // PER_CELL, 1) - 1).bit_length()), MOST)
    return np.minimum(np.bincount(shingles & (width - 1), minlength=width), 255).astype(np.uint8).tobytes()


def _frequent(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen in several of one in ``SEEN`` texts, ascending, and how often; ``KNOWN`` at most, the most frequent ones."""

    def rows(batches):
        for b in batches:
            for t in b["text"]:
                yield (shingle_set(t, size),)

    text = F.col(f"`{text_col}`")
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SEEN)) == 0).distinct()
    seen = arrow_map(some, rows, T.StructType.fromDDL("s array<long>"), batch=_ROWS).select(F.explode("s").alias("s")).groupBy("s").count().where("count > 2")
    found = seen.orderBy(F.desc("count"), "s").limit(KNOWN).collect()
    pairs = np.array(sorted((r[0], r[1]) for r in found), dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def prefix_of(shingles: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 shingles in the order."""
    n = len(shingles)
    often = np.zeros(n, dtype=np.int64)
    if len(known) and n:
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        often = np.where(known[at] == shingles, times[at], 0)
    return shingles[np.lexsort((shingles, often))][: n - (4 * n + 4) // 5 + 1]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, text_hash, node, n, fp, cells, prefix): one row per row of ``docs``; node is a hash of the set, fp its fingerprint."""
    known, times = _frequent(docs, text_col, size)
    fields = "text_hash long, node long, n long, fp long, cells binary, prefix array<long>"
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(fields).fields])

    def rows(batches):
        for b in batches:
            for i, h, t in zip(b["id"], b["text_hash"], b["text"]):
                s = shingle_set(t, size)
                fp = simhash.majority([s.view(np.uint64)])
                yield i, h, node_of(s), len(s), fp - (1 << 64) if fp >> 63 else fp, cells_of(s), prefix_of(s, known, times)

    return arrow_map(_source(docs, id_col, text_col), rows, schema, batch=_ROWS)


def _prefixes(marked: DataFrame) -> DataFrame:
    """(s, n, p, node): a row for each shingle in a set's prefix and its place there.  A task that meets a set again mostly passes it by."""

    def run(batches):
        import pyarrow as pa

        met: set[int] = set()
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                new = [k not in met and (len(met) >= _MET or met.add(k) is None) for k in b.column(0).to_pylist()]
                b = b.filter(pa.array(new))
                if b.num_rows:
                    lists = b.column(2)
                    size = np.diff(lists.offsets.to_numpy())
                    node, n = (np.repeat(b.column(k).to_numpy(), size) for k in (0, 1))
                    p = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
                    yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(n), pa.array(p), pa.array(node)], names=["s", "n", "p", "node"])

    return marked.where("n > 0").select("node", "n", "prefix").mapInArrow(run, "s long, n long, p long, node long")


def _maybe_in(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``rows`` without most of those whose columns ``on`` are not in ``keys``, by a bitmap of hashed keys of 8 MiB at most."""
    bit = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    place = F.bitmap_bit_position(bit)
    bitmap = keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = rows.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "bucket")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("bucket", "bits")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` whose shingle is in the prefix of another set, too, each once."""
    two = prefixes.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("s")
    keys = written(two, "shared_shingles")
    return _maybe_in(prefixes, keys, "s").join(keys.hint("merge"), "s").dropDuplicates(["s", "node"])


def _centre_candidates(rows: DataFrame) -> DataFrame:
    """(a, b): each row of a bucket with the one in which the shingle stands earliest; as many pairs as rows at most."""
    centre = rows.groupBy("s").agg(F.min(F.struct("p", "n", "node")).alias("c"))
    fits = (F.least(F.col("n") - F.col("p"), F.col("c.n") - F.col("c.p")) * 9 >= 4 * (F.col("n") + F.col("c.n"))) & (F.col("node") != F.col("c.node"))
    met = rows.join(centre.hint("merge"), "s").where(fits)
    return met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def run_pairs(key: np.ndarray, n: np.ndarray, p: np.ndarray, root: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs in runs of equal ``key``, sorted by ``n``, of sizes and places that allow 4/5 and of different roots.

    In a run of two blocks, pairs within a block are left to that block's own run.
    """
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(key)]]))
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    one = np.repeat(np.minimum.reduceat(block, starts) == np.maximum.reduceat(block, starts), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(key))
    alive, shift, found, rest = np.flatnonzero(np.repeat(mixed, lengths)), 1, [], n - p
    while len(alive := alive[left[alive] > shift]):
        alive = alive[5 * n[alive] >= 4 * n[alive + shift]]  # sizes rise, so no later one fits either
        other = alive + shift
        ok = (root[alive] != root[other]) & (9 * np.minimum(rest[alive], rest[other]) >= 4 * (n[alive] + n[other])) & (one[alive] | (block[alive] != block[other]))
        found.append((alive[ok], shift))
        shift += 1
    at = np.concatenate([a for a, _ in found] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
    return at, at + np.repeat([d for _, d in found], [len(a) for a, _ in found]).astype(np.int64)


def _far_candidates(rooted: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """(a, b): all pairs to compare in the buckets of ``rooted(s, n, p, node, root)``."""

    def run(batches):
        import pyarrow as pa

        def flush(c):
            i, j = run_pairs(c[0], c[1], c[2], c[4], c[5])
            for lo in range(0, len(i), tile):
                x, y = c[3][i[lo : lo + tile]], c[3][j[lo : lo + tile]]
                two = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(two[:, k])) for k in (0, 1)], names=["a", "b"])

        held = [np.zeros(0, dtype=np.int64)] * 6
        for b in batches:
            held = [np.concatenate([h, b.column(k).to_numpy()]) for k, h in enumerate(held)]
            if len(held[0]) >= tile:
                others = np.flatnonzero(held[0] != held[0][-1])  # the last run may go on in the next batch
                if len(others):
                    cut = int(others[-1]) + 1
                    yield from flush([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield from flush(held)

    mixed = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many")).where("lo <> hi")
    met = rooted.join(mixed.select("s", F.ceil(F.col("many") / BLOCK).alias("blocks")).hint("merge"), "s")
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.xxhash64("s", F.least("block", k), F.greatest("block", k)))
    keyed = met.select(F.explode(F.when(F.col("blocks") > 1, cells).otherwise(F.array("s"))).alias("key"), "n", "p", "node", "root", "block")
    return keyed.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "a long, b long").distinct()


def _simhash_candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that fingerprints within two bits link; sets of one fingerprint are paired with its smallest node."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("low"))
    same = nodes.join(first, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    found = simhash.links(first.select("fp"))
    ends = found.join(first.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    return same.unionByName(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _sets_of(pairs: DataFrame, nodes: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the sets in ``pairs(a, b)``, made again from one text of each.

    A bitmap of hashed rows, 8 MiB at most, passes by most texts that aren't asked for; those left over are dropped by the join.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id", "text_hash"), "node")
    maybe = _maybe_in(source, asked, "id", "text_hash")

    def rows(batches):
        met: set[int] = set()
        for b in batches:
            for t in b["text"]:
                s = shingle_set(t, size)
                node = node_of(s)
                if node not in met:
                    if len(met) < _MET:
                        met.add(node)
                    yield node, s

    return arrow_map(maybe.select("text"), rows, T.StructType.fromDDL("node long, shingles array<long>"), batch=_ROWS).dropDuplicates(["node"])


def may_link(n_a: int, n_b: int, a: bytes, b: bytes) -> bool:
    """Whether the cells ``a`` and ``b`` leave room for 4/5; a full cell leaves any."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) != len(y):
        if (x == 255).any() or (y == 255).any():
            return True
        width = min(len(x), len(y))
        x, y = (c.reshape(-1, width).sum(axis=0, dtype=np.int64) for c in (x, y))
        return bool(9 * np.minimum(x, y).sum() >= 4 * (n_a + n_b))
    low = np.minimum(x, y)
    return bool(9 * low.sum(dtype=np.int64) >= 4 * (n_a + n_b) or (low == 255).any())


def _hopeful(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that their cells leave room for."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                ok = [may_link(*x) for x in zip(*(part.column(k).to_pylist() for k in (2, 4, 3, 5)))]
                yield part.select(["a", "b"]).filter(pa.array(ok, type=pa.bool_()))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("cells").alias(f"c_{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.select("a", "b", "n_a", "c_a", "n_b", "c_b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, nodes: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """The pairs whose similarity is 4/5 or more, exactly: 9 times the shared shingles reach 4 times both sizes."""
    pairs = written(_hopeful(pairs, nodes), "hopeful")
    sets = written(_sets_of(pairs, nodes, source, size), "compared")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.where(9 * F.size(F.array_intersect("s_a", "s_b")) >= 4 * (F.size("s_a") + F.size("s_b"))).select("a", "b")


def _roots(marked: DataFrame, nodes: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """(node, root) of every node that is linked to another; ``nodes`` has a row for each set with shingles."""
    rows = written(_shared(_prefixes(marked)), "shared")
    near = _centre_candidates(rows).unionByName(_simhash_candidates(nodes)).distinct()
    first = written(_linked(written(near, "near"), nodes, source, size), "first_links")
    roots = written(star_components(first), "first_roots")
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = _linked(written(_far_candidates(written(rooted, "rooted")), "far"), nodes, source, size)
    return star_components(first.unionByName(rest))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(root, best): a row for each set of shingles; sets of one group have one root, ``best`` is the set's row with the smallest id."""
    source = _source(docs, id_col, text_col)
    marked = written(marks(docs, id_col, text_col, size), "marks")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best")
    first = written(marked.groupBy("node").agg(best, *[F.first(c).alias(c) for c in ("n", "fp", "cells")]), "nodes")
    nodes = first.where("n > 0").select("node", "best.id", "best.text_hash", "n", "fp", "cells")
    return first.join(_roots(marked, nodes, source, size), "node", "left").select(F.coalesce("root", "node").alias("root"), "best")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row of each group, all columns of ``docs``: the row with the smallest id (ties: text hash); of equal rows one."""
    return simhash.chosen_rows(docs, groups(docs, id_col, text_col, size), id_col, text_col)
