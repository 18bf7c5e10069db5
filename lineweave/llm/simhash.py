"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison, connected groups.

Fingerprints that differ in at most ``radius`` bits agree on at least ``4 - radius`` of four 16-bit blocks, so every
linked pair meets in a bucket keyed by two equal blocks (32 bits).  A bucket holds *distinct* fingerprints only, and is
compared bit-sliced: plane b is one long integer with bit i = bit b of fingerprint i.  Shifting the planes by s lines up
fingerprint i with i+s for all i at once; the XOR of a plane with its shift is added to two carry-save counter planes, and
the block is abandoned as soon as every pair in it exceeds the radius.

A bucket larger than ``direct`` is keyed anew by two equal 8-bit quarters of its other 32 bits: what then remains are 16
bits, so such a bucket has at most 65,536 members whatever the input.  No bucket is dropped, capped or sampled.

A bucket emits a spanning forest (member, smallest linked member), not its pairs; alternating large-star and small-star
rounds join these into components.

Edge cases: null or empty text has fingerprint zero and is linked like any other; repeated rows and equal texts share a
fingerprint and hence a component; null ids are kept and never chosen as component id unless a component has no other;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.network import star_components
from .common import arrow_map, key_of, written

#: Buckets above this many distinct fingerprints are keyed anew (a matter of speed, never of results).
DIRECT = 4096

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_BASE = (np.arange(8, dtype=np.int64) * 256)[None, :]
_SLAB = 1 << 16


def shingle_hashes(text: str | None, size: int = 3) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each word shingle, repeats included, in slabs; nothing for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    h = xxhash.xxh64_intdigest
    if len(words) < size:
        yield np.array([h(b" ".join(words), 42)], dtype=np.uint64)
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    for at in range(0, len(first), _SLAB):
        yield np.array([h(joined[a:b], 42) for a, b in zip(first[at : at + _SLAB], last[at : at + _SLAB])], dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the shingle hashes."""
    return majority(shingle_hashes(text, size))


def majority(slabs: Iterable[np.ndarray]) -> int:
    """Bit b is 1 if it is set in over half of the hashes in all ``slabs`` (uint64)."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in slabs:
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8).astype(np.int64) + _BYTE_BASE).ravel(), minlength=2048)
        ones += np.einsum("jv,vb->jb", counts.reshape(8, 256), _BITS_OF_BYTE).ravel()
        n += len(h)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, text_hash, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def rows(batches):
        for b in batches:
            for i, h, t in zip(b["id"], b["text_hash"], b["text"]):
                f = fingerprint(t, size)
                yield i, h, f - (1 << 64) if f >> 63 else f

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    text = F.col(f"`{text_col}`")
    return arrow_map(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), rows, schema)


# --- bit-sliced comparison -------------------------------------------------------------------------------------------


def bit_planes(fps: np.ndarray) -> list[int]:
    """Plane b as an integer whose bit i is bit b of ``fps[i]`` (uint64)."""
    return [int.from_bytes(np.packbits(((fps >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(64)]


def within(planes: list[int], shift: int, pairs: int, radius: int = 2) -> int:
    """Mask of the positions i in ``pairs`` whose fingerprints i and i+shift differ in at most ``radius`` (1-3) bits."""
    ones = twos = over = 0
    alive = pairs
    for plane in planes:
        m = (plane ^ (plane >> shift)) & alive
        if not m:
            continue
        carry = ones & m
        ones ^= m
        over |= twos & carry
        twos ^= carry
        if radius == 1:
            over |= twos
        elif radius == 2:
            over |= ones & twos
        alive &= ~over
        if not alive:  # the whole block exceeds the radius
            return 0
    return alive


def _positions(mask: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), dtype=np.uint8), bitorder="little"))


def forest(fps: np.ndarray, run: np.ndarray, radius: int = 2) -> np.ndarray:
    """For each fingerprint, the position of the smallest one linked to it, directly or over others, in its run.

    ``fps`` (uint64) and ``run`` are sorted by run; positions of one run are contiguous.
    """
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label
    planes = bit_planes(fps)
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    lengths = np.diff(np.concatenate([starts, [n]]))
    left = np.repeat(starts + lengths, lengths) - np.arange(n)  # members from here to the end of the run
    for shift in range(1, int(lengths.max())):
        pairs = int.from_bytes(np.packbits(left > shift, bitorder="little").tobytes(), "little")
        if not (linked := within(planes, shift, pairs, radius)):
            continue
        at = _positions(linked, n)
        for i in at[label[at] != label[at + shift]].tolist():
            a, b = label[i], label[i + shift]
            if a != b:
                lo, hi = (a, b) if a < b else (b, a)
                s = np.searchsorted(starts, i, "right") - 1
                part = label[starts[s] : starts[s] + lengths[s]]
                part[part == hi] = lo
    return label


def _bucket_links(buckets: DataFrame, radius: int, tile: int = 1 << 15) -> DataFrame:
    """(a, b): spanning links inside buckets.  ``buckets``: (key, fp), each key's rows in one partition, sorted by key."""

    def run(batches):
        import pyarrow as pa

        def flush(keys, fps):
            label = forest(fps.view(np.uint64), keys, radius)
            hit = np.flatnonzero(label != np.arange(len(fps)))
            if len(hit):
                return pa.RecordBatch.from_arrays([pa.array(fps[hit]), pa.array(fps[label[hit]])], names=["a", "b"])

        keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False)])
            if len(keys) >= tile:
                others = np.flatnonzero(keys != keys[-1])  # the last run may go on in the next batch
                cut = int(others[-1]) + 1 if len(others) else 0
                if cut:
                    if (out := flush(keys[:cut], fps[:cut])) is not None:
                        yield out
                    keys, fps = keys[cut:], fps[cut:]
        if len(keys) and (out := flush(keys, fps)) is not None:
            yield out

    return buckets.mapInArrow(run, "a long, b long")


def _blocks() -> list:
    return [F.shiftright("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]


def _coarse(fps: DataFrame) -> DataFrame:
    """(n, key, fp): six rows per fingerprint, one for each pair of its blocks."""
    blocks = _blocks()
    keys = [F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), blocks[i], blocks[j]).alias("key")) for n, (i, j) in enumerate(combinations(range(4), 2))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.n", "k.key", "fp")


def _fine(rows: DataFrame) -> DataFrame:
    """(key, fp): the rows (n, fp) of large buckets, keyed by two equal quarters more."""
    blocks, per_n = _blocks(), []
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        quarters = [F.shiftright(blocks[k], 8 * h).bitwiseAND(F.lit(0xFF)) for k in range(4) if k not in (i, j) for h in (0, 1)]
        per_n.append(F.array(*[F.xxhash64(F.lit(n), F.lit(m), blocks[i], blocks[j], quarters[p], quarters[q]) for m, (p, q) in enumerate(combinations(range(4), 2))]))
    return rows.select("fp", F.explode(F.element_at(F.array(*per_n), F.col("n") + 1)).alias("key")).select("key", "fp")


def links(fps: DataFrame, radius: int = 2, direct: int = DIRECT) -> DataFrame:
    """(a, b): spanning links of distinct fingerprints ``fps(fp)`` within ``radius`` <= 2 bits.

    Keys are 64-bit hashes of (blocks, values); two buckets under one hash are only compared needlessly.
    """
    if not 1 <= radius <= 2:
        raise ValueError("two equal blocks of four prove a radius of 2 at most")
    coarse = _coarse(fps)
    sizes = coarse.groupBy("key").count().where("count > 1")
    met = coarse.join(sizes, "key")
    both = met.where(F.col("count") <= direct).select("key", "fp").unionByName(_fine(met.where(F.col("count") > direct)))
    spread = both.repartition("key").sortWithinPartitions("key", "fp")
    return _bucket_links(spread, radius).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, radius: int, direct: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprint of each row, and (fp, root, best) of each distinct fingerprint; best is its row with the smallest id.

    Fingerprints (24 bytes a document) are written once; the texts are read once and not shuffled.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "prints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best")
    first = written(prints.groupBy("fp").agg(best), "first")
    roots = star_components(links(first.select("fp"), radius, direct))
    return prints, first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, direct: int = DIRECT) -> DataFrame:
    """(id, fp, component): one row per row of ``docs``; component is the smallest id reachable over links."""
    prints, named = _grouped(docs, id_col, text_col, size, radius, direct)
    lowest = named.groupBy("root").agg(F.min("best").alias("low"))
    grouped = named.join(lowest, "root").select("fp", F.col("low.id").alias("component"))
    return prints.join(grouped, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, direct: int = DIRECT) -> DataFrame:
    """One row of each group, all columns of ``docs``: the row with the smallest id (ties: text hash); of equal rows one."""
    _, named = _grouped(docs, id_col, text_col, size, radius, direct)
    return chosen_rows(docs, named, id_col, text_col)


def chosen_rows(docs: DataFrame, named: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``named(root, best)`` chooses, one for each root."""
    low = named.groupBy("root").agg(F.min("best").alias("low"))
    kept = low.select(key_of(F.col("low.id")).alias("row_id"), F.col("low.text_hash").alias("row_hash"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), key_of(F.col(f"`{id_col}`")).alias("row_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("row_hash"))
    same = ["row_id", "row_hash"]  # of the join and of the window, so that whole rows are shuffled once
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("row")))
    found = keyed.join(kept.hint("merge"), same, "left_semi").withColumn("nth", nth).where("nth = 1")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
