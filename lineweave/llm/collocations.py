"""Phrase collocation mining: all phrases of 2 to 5 words that are frequent in a language, scored by their weakest cut.

The method: words that are frequent in their language get numbers; texts are cut into pieces at punctuation and line ends, and again
at all other words, as no frequent phrase contains one.  Every position of a piece is one key, the numbers of the five words from
there on, packed into a fixed number of bits (0 stands for no word).  A task sorts its keys by radix, merges equal ones into one with
a count, cuts them at fixed borders and ships blocks.  Spark brings the blocks of a range together; there they are sorted and merged
again.  In sorted keys all phrases with the same beginning stand together, so run lengths give the counts of all phrases of one to five
words in one go.  A run that touches an end of its range has only part of its count there, and parts are added up at the end.

Borders need no sample.  A word's share of its corpus maps keys to [0, 1) in their order, as arithmetic coding does, and ranges are equal
parts of that; so a hot first word, or a hot pair, is spread over ranges.  Equal keys leave a task as one, so a passage that is
repeated in all documents costs a task one key.

Words: at most ``KNOWN`` of the numbered words are held by tasks.  Pieces that may have others (a bitmap of fixed size tells) take the
long way: those words are joined with the table of numbers.

Cuts: a candidate of m words is cut after word k for all k; l and r are the counts of the parts, the score is floor(1000 * a * n / (l * r)) in
decimals of 38 digits.  A candidate goes if a longer one contains it and has ``100 * f(longer) >= share * a``; it is enough to look at those
longer by one word, as what lies between has a count between.

Edge cases: null text is empty, null language is ``und``; texts without words give nothing; repeated rows count each time; an empty
table gives no rows; other columns are passed by.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary
from .common import written

WORDS = 5
MIN_COUNT = 100
#: Numbered words that tasks hold.
KNOWN = 1 << 19
#: Keys that a task gathers before it sorts them, and positions of a range.
SLAB, RANGE = 1 << 20, 1 << 21
#: Bits of the bitmap of numbered words that tasks don't hold: 8 MiB.
FILTER_BITS = 1 << 26
#: Parts in which words that tasks don't hold are numbered.
NUMBERED = 1024
#: Copies of the count of a single word, which many phrases look up.
SALTS = 16
#: Parts in which the first rows of a language are looked for before one task sorts what is left.
PARTS = 64

#: Where pieces end, and the name of an unknown language.
BREAKS = re.compile(rb"[.,;:!?\x0a-\x0d]+")
UNKNOWN = "und"

BLOCKS = "range int, keys binary, counts binary"
GRAMS = "lang string, key binary, words int, f long"


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased, and ``.``, which no word is, where a piece ends."""
    return BREAKS.sub(b" . ", text.encode("utf-8", "surrogatepass")).lower().split() if text else []


def word_counts(texts: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, n): words found ``min_count`` times in a language; all others of a language are one row, its word null."""

    def found(b):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = tokens_of(text.as_py())
            yield lang, (w for w in words if w != b".")

    counts = vocabulary.partial_counts(texts, found, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counts.withColumn("word", F.when(F.col("n") >= min_count, F.col("word"))).groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Numbers:
    """Numbers of words from 1, ordered by language: first those that tasks hold, by falling count, then the rest."""

    def __init__(self, known: list[tuple[str, bytes, int]], rest: list[tuple[str, int]], rest_total: int, bits: bytes | None):
        self.words = known
        self.rest, self.bits = rest, bits
        self.n_known, self.n_rest = len(known), sum(n for _, n in rest)
        self.width = max(1, (self.n_known + self.n_rest).bit_length())
        if self.width > 32:
            raise ValueError("more than 2**32 frequent words")
        total = sum(n for _, _, n in known) + rest_total
        self.ranges = max(1, -(-total // RANGE))
        # 0, the end of a piece, has an eighth; the words that aren't held share what is left evenly
        weights = np.array([max(1, total // 7)] + [n for _, _, n in known] + [max(1, rest_total)], dtype=np.float64)
        edges = np.concatenate([[0.0], np.cumsum(weights)]) / weights.sum()
        edges[-1] = 1.0
        self.low, self.size, self.below = edges[:-1], np.diff(edges), np.nextafter(edges[1:], 0)

    def dictionaries(self) -> dict[str, dict[bytes, int]]:
        found: dict[str, dict[bytes, int]] = {}
        for i, (lang, word, _) in enumerate(self.words):
            found.setdefault(lang, {})[word] = i + 1
        return found

    def languages(self) -> tuple[np.ndarray, list[str]]:
        """First number of each run of words of one language, and the languages of the runs."""
        starts, names, at = [], [], 1
        for lang, n in [(lang, 1) for lang, _, _ in self.words] + self.rest:
            if not names or names[-1] != lang:
                starts.append(at)
                names.append(lang)
            at += n
        return np.array(starts, dtype=np.int64), names

    def range_of(self, words: list[np.ndarray]) -> np.ndarray:
        """Range of each key; never falls as keys rise."""
        x = np.zeros(len(words[0]))
        for w in reversed(words[:4]):
            k = np.minimum(w, self.n_known + 1)
            if self.n_rest:
                x = np.where(w > self.n_known, (w - (self.n_known + 1) + x) / self.n_rest, x)
                x = np.minimum(x, np.nextafter(1.0, 0))
            x = np.minimum(self.low[k] + self.size[k] * x, self.below[k])
        return np.minimum(((x - self.low[1]) / (1 - self.low[1]) * self.ranges).astype(np.int64), self.ranges - 1)


def pack(words: list[np.ndarray], width: int) -> np.ndarray:
    """Keys as rows of 16-bit digits, the highest digit first: ``WORDS`` numbers of ``width`` bits each."""
    n = -(-WORDS * width // 16)
    digits = np.zeros((n, len(words[0])), dtype=np.uint16)
    for j in range(n):
        for k, w in enumerate(words):
            shift = width * (WORDS - 1 - k) - 16 * (n - 1 - j)
            if -width < shift < 16:
                digits[j] |= ((w << shift if shift >= 0 else w >> -shift) & 0xFFFF).astype(np.uint16)
    return digits


def unpack(digits: np.ndarray, width: int) -> list[np.ndarray]:
    n = len(digits)
    out = []
    for k in range(WORDS):
        w = np.zeros(digits.shape[1], dtype=np.int64)
        for j in range(n):
            shift = width * (WORDS - 1 - k) - 16 * (n - 1 - j)
            if -width < shift < 16:
                d = digits[j].astype(np.int64)
                w |= d >> shift if shift >= 0 else d << -shift
        out.append(w & ((1 << width) - 1))
    return out


def merged(digits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts: radix passes from the lowest digit, then run lengths."""
    order = np.arange(digits.shape[1])
    for d in digits[::-1]:
        if len(d) and d.min() != d.max():
            order = order[np.argsort(d[order], kind="stable")]
    digits, counts = digits[:, order], counts[order]
    if not len(order):
        return digits, counts
    first = np.concatenate([[True], (digits[:, 1:] != digits[:, :-1]).any(axis=0)])
    starts = np.flatnonzero(first)
    return digits[:, starts], np.add.reduceat(counts, starts)


def windows(numbers: np.ndarray, stop: int) -> list[np.ndarray]:
    """The ``WORDS`` numbers from each word before ``stop`` on, 0 behind the end of its piece; ``numbers`` has a 0 between pieces."""
    padded = np.concatenate([numbers, np.zeros(WORDS, dtype=np.int64)])
    at = np.flatnonzero(numbers[:stop])
    out = [padded[at]]
    for k in range(1, WORDS):
        out.append(np.where(out[-1] > 0, padded[at + k], 0))
    return out


def _blocks(sequences, numbers: Numbers):
    """Blocks of sorted and merged keys of arrays of numbers, one for each range that a slab reaches."""
    schema = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def slab(x: np.ndarray, stop: int):
        words = windows(x, stop)
        digits, counts = merged(pack(words, numbers.width), np.ones(len(words[0]), dtype=np.int64))
        ranges = numbers.range_of(unpack(digits, numbers.width))
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        rows = [
            (int(ranges[a]), digits[:, a:b].tobytes(), b"" if (counts[a:b] == 1).all() else counts[a:b].astype(np.uint32).tobytes())
            for a, b in zip(cuts, cuts[1:])
            if b > a
        ]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at : at + 64]), schema)], schema=schema)

    held, size, gap = [], 0, np.zeros(1, dtype=np.int64)
    for x in sequences:
        for at in range(0, len(x) - SLAB, SLAB):  # of a longer text, a slab and the words that its last windows reach into
            yield from slab(x[at : at + SLAB + WORDS - 1], SLAB)
            rest = at + SLAB
        if len(x) > SLAB:
            x = x[rest:]
        held += [x, gap]
        size += len(x)
        if size >= SLAB:
            yield from slab(np.concatenate(held), size + len(held))
            held, size = [], 0
    if size:
        yield from slab(np.concatenate(held), size + len(held))


def _place(lang: str, word: bytes) -> int:
    return zlib.crc32(lang.encode() + b" " + word) % FILTER_BITS


def _numbered(batches, numbers: Numbers):
    """(language, tokens, numbers of tokens or 0, tokens that may have a number that isn't held) of each text."""
    dictionaries, none, bits = numbers.dictionaries(), {}, numbers.bits
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            tokens = tokens_of(text.as_py())
            found = np.fromiter(map(dictionaries.get(lang, none).get, tokens, repeat(0)), dtype=np.int64, count=len(tokens))
            maybe = []
            if bits is not None:
                for i in np.flatnonzero(found == 0).tolist():
                    if tokens[i] != b".":
                        place = _place(lang, tokens[i])
                        if bits[place >> 3] >> (place & 7) & 1:
                            maybe.append(i)
            yield lang, tokens, found, maybe


def _pieces(tokens: list[bytes], at: list[int]) -> list[tuple[int, int]]:
    """Pieces that the positions ``at`` lie in, as spans."""
    ends = [-1] + [i for i, w in enumerate(tokens) if w == b"."] + [len(tokens)]
    return [(ends[i - 1] + 1, ends[i]) for i in np.unique(np.searchsorted(ends, at)).tolist()]


def _held_blocks(texts: DataFrame, numbers: Numbers) -> DataFrame:
    def sequences(batches):
        for _, tokens, found, maybe in _numbered(batches, numbers):
            for a, z in _pieces(tokens, maybe) if maybe else ():
                found[a:z] = 0
            yield found

    return texts.mapInArrow(lambda batches: _blocks(sequences(batches), numbers), BLOCKS)


def _other_blocks(texts: DataFrame, numbers: Numbers, rest: DataFrame) -> DataFrame:
    """Blocks of the pieces that may have words of ``rest(lang, word, id)``, which are joined to them."""
    schema = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("at", pa.list_(pa.int32())), ("words", pa.list_(pa.binary()))])

    def apart(batches):
        rows = []
        for lang, tokens, found, maybe in _numbered(batches, numbers):
            for a, z in _pieces(tokens, maybe) if maybe else ():
                mine = [i for i in maybe if a <= i < z]
                rows.append((lang, found[a:z].tobytes(), [i - a for i in mine], [tokens[i] for i in mine]))
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    pieces = texts.mapInArrow(apart, "lang string, ids binary, at array<int>, words array<binary>")
    pieces = written(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    each = pieces.select("piece", "lang", F.inline(F.arrays_zip("at", "words"))).withColumnRenamed("words", "word")
    found = each.join(rest, ["lang", "word"]).groupBy("piece").agg(F.collect_list("at").alias("place"), F.collect_list("id").alias("id"))

    def filled(batches):
        for b in batches:
            for ids, place, id_ in zip(*(b.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(ids, dtype=np.int64).copy()
                x[np.array(place or [], dtype=np.int64)] = np.array(id_ or [], dtype=np.int64)
                yield x

    return pieces.join(found, "piece", "left").select("ids", "place", "id").mapInArrow(lambda batches: _blocks(filled(batches), numbers), BLOCKS)


def _phrases(blocks: DataFrame, numbers: Numbers, min_count: int) -> DataFrame:
    """(lang, key, words, f): counts of frequent phrases, those that go on in another range in parts."""
    width, (starts, names) = numbers.width, numbers.languages()
    n_digits = -(-WORDS * width // 16)
    schema = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("words", pa.int32()), ("f", pa.int64())])

    def phrases(digits, counts):
        words = unpack(digits, width)
        new = np.zeros(len(counts), dtype=bool)
        new[0] = True
        for k, w in enumerate(words):
            new[1:] |= w[1:] != w[:-1]
            at = np.flatnonzero(new)
            f = np.add.reduceat(counts, at)
            keep = f >= min_count
            keep[[0, -1]] = True  # these may go on in the ranges beside this one
            keep &= w[at] > 0
            if keep.any():
                at, f = at[keep], f[keep]
                keys = np.ascontiguousarray(np.stack([x[at] for x in words[: k + 1]], axis=1).astype(">u4"))
                lang = [names[i] for i in (np.searchsorted(starts, words[0][at], side="right") - 1).tolist()]
                raw = pa.Array.from_buffers(pa.binary(4 * (k + 1)), len(at), [None, pa.py_buffer(keys)])
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), raw.cast(pa.binary()), pa.array(np.full(len(at), k + 1, dtype=np.int32)), pa.array(f)], schema=schema)

    def ranges(batches):
        now, parts, size = None, [], 0
        for b in batches:
            for i, (r, keys, counts) in enumerate(zip(b.column(0).to_pylist(), b.column(1), b.column(2))):
                if r != now and parts:
                    yield from phrases(*_joined(parts))
                    parts, size = [], 0
                now = r
                d = np.frombuffer(keys.as_py(), dtype=np.uint16).reshape(n_digits, -1)
                c = counts.as_py()
                parts.append((d, np.frombuffer(c, dtype=np.uint32).astype(np.int64) if c else np.ones(d.shape[1], dtype=np.int64)))
                size += d.shape[1]
                if size >= 2 * RANGE:  # equal keys of many tasks become one before more are read
                    parts = [_joined(parts)]
                    size = parts[0][0].shape[1] // 2
        if parts:
            yield from phrases(*_joined(parts))

    return blocks.repartition("range").sortWithinPartitions("range").mapInArrow(ranges, GRAMS)


def _joined(parts):
    return merged(np.concatenate([d for d, _ in parts], axis=1), np.concatenate([c for _, c in parts]))


def _rest_numbers(words: DataFrame, bound: int, n_known: int) -> tuple[DataFrame, list[tuple[str, int]], int, bytes | None]:
    """Words that tasks don't hold, (lang, word, id), their number by language, their total and the bitmap of them."""
    rest = words.where(~vocabulary.reaches(F.col("n"), bound)).withColumn("part", F.pmod(F.crc32("word"), F.lit(NUMBERED)))
    sizes = rest.groupBy("lang", "part").agg(F.count("*").alias("k"))
    before = sizes.withColumn("before", F.sum("k").over(Window.orderBy("lang", "part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("word"))
    ids = rest.withColumn("place", place).join(before.drop("k"), ["lang", "part"])
    table = written(ids.select("lang", "word", "n", (F.lit(n_known) + F.coalesce("before", F.lit(0)) + F.col("place")).alias("id")), "numbers")
    by_lang = sorted((r[0], r[1]) for r in table.groupBy("lang").count().collect())
    if not by_lang:
        return table, [], 0, None
    total = table.agg(F.sum("n")).first()[0]
    bit = F.pmod(F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(b" "), F.col("word"))), F.lit(FILTER_BITS)) + 1  # places count from 1
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in table.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        at = (r["b"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return table, by_lang, total, bits.tobytes()


def phrase_counts(texts: DataFrame, counts: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, key, words, f) of all frequent phrases of 1 to 5 words of ``texts(lang, text)``, and the words' numbers, (id, word)."""
    spark = texts.sparkSession
    words = counts.where("word IS NOT NULL AND n >= 1")
    bound = vocabulary.frequent_bound(words, KNOWN)
    rows = words.where(vocabulary.reaches(F.col("n"), bound)).collect()  # KNOWN at most
    known = sorted(((r["lang"], bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (x[0], -x[2], x[1]))
    rest, by_lang, total, bits = _rest_numbers(words, bound, len(known))
    numbers = Numbers(known, by_lang, total, bits)
    blocks = _held_blocks(texts, numbers)
    if bits is not None:
        blocks = blocks.unionByName(_other_blocks(texts, numbers, rest))
    partial = _phrases(blocks, numbers, min_count)
    grams = partial.groupBy("lang", "key", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    held = pa.table({"id": pa.array(range(1, len(known) + 1), pa.int64()), "word": pa.array([w for _, w, _ in known], pa.binary())})
    return written(grams, "phrases"), spark.createDataFrame(held).unionByName(rest.select("id", "word"))


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, key, words, a, l, r, n, score) of all phrases of two words and more, by their weakest cut; ``totals(lang, n)``."""
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = grams.where("words >= 2").select("lang", "key", "words", F.col("f").alias("a"), cut)
    left, right = F.substring(F.col("key"), F.lit(1), 4 * F.col("k")), F.substring(F.col("key"), 4 * F.col("k") + 1, 4 * (F.col("words") - F.col("k")))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    salted = lambda part: F.when(F.octet_length(part) == 4, salt).otherwise(0)
    copies = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    looked = grams.where(f"words < {WORDS}").select("lang", F.col("key").alias("part"), "f", F.explode(copies).alias("salt"))

    def with_count(rows, part, name):
        keyed = rows.withColumn("part", part).withColumn("salt", salted(F.col("part")))
        return keyed.join(looked.withColumnRenamed("f", name), ["lang", "part", "salt"]).drop("part", "salt")

    both = with_count(with_count(cuts, left, "l"), right, "r").join(totals, "lang")
    value = F.expr("(1000bd * CAST(a AS decimal(17,0)) * CAST(n AS decimal(17,0))) div (CAST(l AS decimal(17,0)) * CAST(r AS decimal(17,0)))")
    least = F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("m")
    return both.groupBy("lang", "key", "words", "a", "n").agg(least).select("lang", "key", "words", "a", "m.l", "m.r", "n", "m.score")


def without_parts(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates that no longer one contains with ``share`` percent of their count."""
    longer = candidates.where("words >= 3")
    ends = F.array(F.substring(F.col("key"), F.lit(1), 4 * (F.col("words") - 1)), F.substring(F.col("key"), F.lit(5), 4 * (F.col("words") - 1)))
    most = longer.select("lang", F.explode(ends).alias("key"), "a").groupBy("lang", "key").agg(F.max("a").alias("most"))
    return candidates.join(most, ["lang", "key"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))).drop("most")


def spelled(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``phrase``, the words of ``key`` with spaces between them."""
    ids = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: F.conv(F.hex(F.substring(F.col("key"), 4 * i + 1, F.lit(4))), 16, 10).cast("long"))
    each = candidates.select("lang", "key", F.posexplode(ids).alias("at", "id")).join(words, "id")
    parts = F.sort_array(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word"))))
    phrases = each.groupBy("lang", "key").agg(F.array_join(F.transform(parts, lambda p: p["word"]), " ").alias("phrase"))
    return candidates.join(phrases, ["lang", "key"])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` by falling score, falling a, phrase."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    counts = written(word_counts(texts, min_count), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    grams, words = phrase_counts(texts, counts.where(F.col("word").isNotNull()), min_count)
    found = written(without_parts(scored(grams, totals), share), "candidates")
    order = [F.desc("score"), F.desc("a")]
    # what may be among the first goes on with all its ties: the phrases that decide between these are spelled out only then
    near = found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS))).withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    first = near.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return spelled(written(first, "first"), words).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
