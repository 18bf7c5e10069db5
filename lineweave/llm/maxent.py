"""LM scoring: a hashed maximum-entropy model with class-factored softmax, beside an exact unigram base.

The method: the probability of a word given what stands before it is that of its class times that of the word in its class.  Both are
softmaxes of sums of hashed features: for the class the word before, the two words before and, as a skip feature, the second word before; for
the word in its class the class with the word before and the class with the second word before.  The most frequent ``SHORT * WIDTH``
words have such classes, ``WIDTH`` words each.  All other words are in classes by rank, the last of them for words that tasks don't
hold and for unseen ones; in these classes a word has its smoothed share of the class, from exact counts of the whole training part, so
only its class depends on what stands before.  Before training the model is the unigram base; its features then learn what that misses.

Training is distributed: in each of ``ROUNDS`` rounds, over disjoint parts of the training documents that together are all of them, tasks
take the model, run AdaGrad steps over batches of ``BATCH`` tokens, and ship how far each row of weights has moved and how many tokens moved
it.  Moves are averaged by these numbers.  They are whole multiples of 2**-12 and are added up as integers, so their order has no effect.
The model has a fixed size (6 MB), whatever the corpus.  Nothing is sampled: every training token gives one gradient.

Counts cover all training words.  Tasks hold the ``KNOWN`` most frequent; the others of a document, each once with its number, are joined with the
table of counts.  Texts are read twice (counting, encoding) and never shuffled; training and scoring read the numbers.

Edge cases: null text is empty and has one token, its end; a null id counts as empty text, which is held out; without training documents all tokens
have probability 1 in base and model; repeated rows are scored, and learnt from, each; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .common import scratch_path, written

#: Words that tasks hold.
KNOWN = 1 << 18
#: Classes, how many of them have a softmax of their own, and the words of such a class.
CLASSES, SHORT, WIDTH = 32, 28, 64
#: First ranks of the other classes but the last, which has all words that aren't held.
BANDS = (SHORT * WIDTH, 8192, 32768)
#: Rows of hashed weights of either factor, behind them one row of weights that are always on, or one for each class.
ROWS = 1 << 14
#: Passes over parts of the training documents, tokens of a step, and the first length of a step.
ROUNDS, BATCH, RATE = 2, 1 << 14, 0.1
#: Tokens for which a training task is worth while, and tokens that it gets at most by intention.
LEAST, MOST = 1 << 20, 1 << 24
#: Rows of a block that is shipped, and parts of 1 in which moves are counted.
BLOCK, SCALE = 64, 1 << 12
#: A logarithm that stands for no probability.
NEVER = -30.0

ADDED = 0.1
HOLD_OUT = 10
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


class Vocabulary:
    """The words that tasks hold, numbered by falling count, and the shares that words and classes have of the training tokens."""

    def __init__(self, known: list[tuple[bytes, int]], tokens: int, distinct: int):
        self.words = [w for w, _ in known]
        self.n = len(known)
        c = np.array([n for _, n in known], dtype=np.float64)
        self.tokens, self.distinct = tokens, distinct
        self.whole = tokens + ADDED * (distinct + 1)
        #: Base logarithms of held words; a word that isn't held has its own, later.
        self.base = np.concatenate([np.log10((c + ADDED) / self.whole), [0.0]])
        self.rare_whole = (tokens - c.sum()) + ADDED * (distinct - self.n + 1)
        rank = np.arange(self.n)
        self.classes = np.concatenate([np.where(rank < SHORT * WIDTH, rank // WIDTH, SHORT - 1 + np.searchsorted(BANDS, rank, side="right")), [CLASSES - 1]]).astype(np.int64)
        mass = np.bincount(self.classes[:-1], weights=c + ADDED, minlength=CLASSES).astype(np.float64)
        mass[-1] = self.rare_whole
        #: Natural logarithm of a held word's share of its class, for classes without a softmax.
        self.share = np.concatenate([np.log((c + ADDED) / mass[self.classes[:-1]]), [0.0]])
        self.mass, self.held = mass, c


class Model:
    def __init__(self, v: Vocabulary):
        self.a = np.zeros((ROWS + BLOCK, CLASSES), dtype=np.float32)
        self.b = np.zeros((ROWS + BLOCK, WIDTH), dtype=np.float32)
        with np.errstate(divide="ignore"):
            self.a[ROWS] = np.maximum(np.log(v.mass / v.whole), NEVER)
        self.b[ROWS:] = NEVER
        short = min(v.n, SHORT * WIDTH)
        self.b[ROWS + v.classes[:short], np.arange(short) % WIDTH] = v.share[:short]


def _hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind, dtype=np.uint64)
    for p in parts:
        h = (h + p.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _contexts(texts: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the tokens of texts in turn, of the tokens before them, and of those before these."""
    start = np.full(2, begin, dtype=np.int32)
    flat = np.concatenate([x for t in texts for x in (start, t)])
    at = np.flatnonzero(flat != begin)
    return flat[at], flat[at - 1], flat[at - 2]


class Step:
    """Probabilities of tokens under a model, and what a step needs beside them."""

    def __init__(self, m: Model, v: Vocabulary, now: np.ndarray, w1: np.ndarray, w2: np.ndarray):
        self.cls = v.classes[now]
        self.fa = (_hashed(1, w1), _hashed(2, w1, w2), _hashed(3, w2))
        pa_ = np.take(m.a, self.fa[0], axis=0)
        for f in self.fa[1:]:
            pa_ += np.take(m.a, f, axis=0)
        pa_ += m.a[ROWS]
        self.pa = _softmax(pa_)
        self.short = np.flatnonzero(self.cls < SHORT)
        c = self.cls[self.short]
        self.fb = (_hashed(5, c, w1[self.short]), _hashed(6, c, w2[self.short]), ROWS + c)
        self.slot = now[self.short] % WIDTH
        pb = np.take(m.b, self.fb[0], axis=0)
        for f in self.fb[1:]:
            pb += np.take(m.b, f, axis=0)
        self.pb = _softmax(pb)
        tiny = np.float32(1e-30)
        self.logs = np.log(np.maximum(self.pa[np.arange(len(now)), self.cls], tiny)).astype(np.float64)
        self.logs[self.short] += np.log(np.maximum(self.pb[np.arange(len(c)), self.slot], tiny))
        other = self.cls >= SHORT
        self.logs[other] += v.share[now[other]]

    def gradients(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, gradients, tokens that reach them) of the weights of either factor; probabilities are used up."""
        self.pa[np.arange(len(self.cls)), self.cls] -= 1
        self.pb[np.arange(len(self.slot)), self.slot] -= 1
        rows, g, n = _scattered(self.pa, self.fa)
        always = (np.append(rows, ROWS), np.concatenate([g, self.pa.sum(axis=0, keepdims=True)]), np.append(n, len(self.cls)))
        return [always, _scattered(self.pb, self.fb)]


def _scattered(g: np.ndarray, features: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that features name, sums of ``g`` over the tokens that do so, number of these)."""
    f = np.concatenate(features).astype(np.uint16)
    if not len(f):
        return np.zeros(0, dtype=np.int64), np.zeros((0, g.shape[1]), dtype=g.dtype), np.zeros(0, dtype=np.int64)
    order = np.argsort(f, kind="stable")  # radix
    f = f[order]
    at = np.concatenate([[0], np.flatnonzero(f[1:] != f[:-1]) + 1])
    n = np.diff(at, append=len(f))
    return f[at].astype(np.int64), _sums(np.take(g, order % len(g), axis=0), at, n), n


def _sums(g: np.ndarray, at: np.ndarray, n: np.ndarray, short: int = 12) -> np.ndarray:
    """Sums of ``n`` rows from ``at`` on: short runs row by row for all of them at once, long ones run by run."""
    out = np.take(g, at, axis=0)
    for k in range(1, short):
        runs = np.flatnonzero((n > k) & (n <= short))
        out[runs] += np.take(g, at[runs] + k, axis=0)
    for i in np.flatnonzero(n > short).tolist():
        out[i] = g[at[i] : at[i] + n[i]].sum(axis=0)
    return out


def _learn(m: Model, v: Vocabulary, batches: Iterator[list[np.ndarray]], rate: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Moves of both factors' weights and the tokens behind each row, after AdaGrad steps over all batches."""
    begin = v.n + 1
    now = Model.__new__(Model)
    now.a, now.b = m.a.copy(), m.b.copy()
    squares = [np.full_like(now.a, 1e-6), np.full_like(now.b, 1e-6)]
    seen = [np.zeros(len(now.a), dtype=np.int64), np.zeros(len(now.b), dtype=np.int64)]
    for texts in batches:
        t, w1, w2 = _contexts(texts, begin)
        for at in range(0, len(t), BATCH):
            found = Step(now, v, t[at : at + BATCH], w1[at : at + BATCH], w2[at : at + BATCH]).gradients()
            for w, sq, total, (rows, g, n) in zip((now.a, now.b), squares, seen, found):
                total[rows] += n
                s = np.take(sq, rows, axis=0)
                s += g * g
                sq[rows] = s
                np.sqrt(s, out=s)
                g /= s
                g *= np.float32(rate)
                w[rows] -= g
    return [now.a - m.a, now.b - m.b], seen


def _batched(batches, column: str) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for b in batches:
        for raw in b.column(b.schema.get_field_index(column)):
            held.append(np.frombuffer(raw.as_py(), dtype=np.int32))
            size += len(held[-1])
            if size >= BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def train(codes: DataFrame, v: Vocabulary, rate: float = RATE) -> Model:
    """A model learnt from ``codes(ids, part)``, one round for each part.  What reaches the driver is one model's size a round."""
    m = Model(v)
    spark = codes.sparkSession
    tasks = max(-(-v.tokens // MOST), min(spark.sparkContext.defaultParallelism, -(-v.tokens // LEAST)), 1)
    for r in range(ROUNDS if v.tokens else 0):
        blocks = codes.where(F.col("part") == r).select("ids").coalesce(tasks).mapInArrow(_moves(m, v, rate / (r + 1)), "block int, tokens binary, moves binary")
        found = blocks.repartition("block").mapInArrow(_added, "block int, tokens binary, moves binary").collect()  # a model's size
        for row in found:
            k = row["block"]
            table, at = (m.a, k * BLOCK) if k < len(m.a) // BLOCK else (m.b, (k - len(m.a) // BLOCK) * BLOCK)
            n = np.maximum(np.frombuffer(bytes(row["tokens"]), dtype=np.int64), 1)
            moved = np.frombuffer(bytes(row["moves"]), dtype=np.int64).reshape(BLOCK, -1)
            table[at : at + BLOCK] += (moved / n[:, None] / SCALE).astype(np.float32)
    return m


def _moves(m: Model, v: Vocabulary, rate: float):
    schema = pa.schema([("block", pa.int32()), ("tokens", pa.binary()), ("moves", pa.binary())])

    def run(batches):
        moves, seen = _learn(m, v, _batched(batches, "ids"), rate)
        k, rows = 0, []
        for move, n in zip(moves, seen):
            whole = np.clip(np.rint(move * SCALE), -32767, 32767).astype(np.int16)
            for at in range(0, len(n), BLOCK):
                if n[at : at + BLOCK].any():
                    rows.append((k, n[at : at + BLOCK].tobytes(), whole[at : at + BLOCK].tobytes()))
                k += 1
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at : at + 256]), schema)], schema=schema)

    return run


def _added(batches):
    schema = pa.schema([("block", pa.int32()), ("tokens", pa.binary()), ("moves", pa.binary())])
    sums: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for k, tokens, moves in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            n = np.frombuffer(tokens.as_py(), dtype=np.int64)
            moved = np.frombuffer(moves.as_py(), dtype=np.int16).reshape(BLOCK, -1).astype(np.int64) * n[:, None]
            if k in sums:
                sums[k][0] += n
                sums[k][1] += moved
            else:
                sums[k] = [n.copy(), moved]
    if sums:
        rows = [(k, n.tobytes(), moved.tobytes()) for k, (n, moved) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all words and ends of ``texts(text)``."""

    def found(b):
        for text in b.column(0):
            yield 0, words_of(text.as_py())

    partial = vocabulary.partial_counts(texts, found, "part int, word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(rid, id, held_out, part, n_tokens, n_known, base, ids, rare) of each text of ``docs(id, held_out, part, text)``, in a table.

    ``ids`` are the numbers of its tokens, ``rare`` its words that tasks don't hold; ``n_known`` and ``base`` are of the others.
    """
    out = "id {}, held_out boolean, part int, n_tokens long, n_known long, base double, ids binary, rare array<struct<word: binary, n: int>>".format(docs.schema["id"].dataType.simpleString())
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def run(batches):
        numbers = {w: i for i, w in enumerate(v.words)}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = []
                for text in b.column(3):
                    words = words_of(text.as_py())
                    ids = np.fromiter(map(numbers.get, words, repeat(v.n)), dtype=np.int32, count=len(words))
                    rare = Counter(words[i] for i in np.flatnonzero(ids == v.n).tolist())
                    rows.append((len(words), len(words) - rare.total(), float(v.base[ids].sum()), ids.tobytes(), [{"word": w, "n": n} for w, n in rare.items()]))
                if rows:
                    n, known, base, ids, rare = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns[:3], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(ids, pa.binary()), pa.array(rare, rare_type)],
                        names=["id", "held_out", "part", "n_tokens", "n_known", "base", "ids", "rare"],
                    )

    codes = docs.select("id", "held_out", "part", "text").mapInArrow(run, out).withColumn("rid", F.monotonically_increasing_id())
    path = scratch_path(docs.sparkSession, "codes")
    codes.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(codes.schema).parquet(path)


def held_scores(codes: DataFrame, m: Model, v: Vocabulary) -> DataFrame:
    """(rid, id, held_out, n_tokens, n_known, base, score): log10 of each text under the model, but for the shares of its rare words."""
    kept = ["rid", "id", "held_out", "n_tokens", "n_known", "base"]
    fields = [codes.schema[c] for c in kept]

    def scores(batch):
        held, sizes, size = [], [], 0
        for raw in batch.column(batch.schema.get_field_index("ids")):
            held.append(np.frombuffer(raw.as_py(), dtype=np.int32))
            sizes.append(len(held[-1]))
            size += sizes[-1]
            if size >= BATCH:
                yield of(held, sizes)
                held, sizes, size = [], [], 0
        if held:
            yield of(held, sizes)

    def of(held, sizes):
        t, w1, w2 = _contexts(held, v.n + 1)
        logs = np.concatenate([Step(m, v, t[at : at + BATCH], w1[at : at + BATCH], w2[at : at + BATCH]).logs for at in range(0, len(t), BATCH)])
        return np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / np.log(10)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(np.concatenate(list(scores(b))))], names=[*kept, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return codes.select(*kept, "ids").mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``; scores are log10 of probabilities."""
    place = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    held_out = place % HOLD_OUT == 0
    part = F.when(~held_out, F.floor(place / HOLD_OUT) % ROUNDS).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), part.alias("part"), F.col(text_col).alias("text"))
    counts = written(word_counts(rows.where(~F.col("held_out")).select("text")), "words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bound = vocabulary.frequent_bound(counts, KNOWN)
    known = [(bytes(r["word"]), r["n"]) for r in counts.where(vocabulary.reaches(F.col("n"), bound)).collect()]  # KNOWN at most
    v = Vocabulary(sorted(known, key=lambda x: (-x[1], x[0])), tokens, distinct)
    codes = encoded(rows, v)
    v.words = []  # training and scoring know numbers only
    scored = held_scores(codes, train(codes, v), v)

    rest = counts.where(~vocabulary.reaches(F.col("n"), bound)).withColumnRenamed("n", "c")
    each = codes.select("rid", F.inline("rare")).join(rest, "word", "left")
    log = lambda whole: F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + ADDED) / whole)
    rare = each.groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum(log(v.whole)).alias("b"), F.sum(log(float(v.rare_whole))).alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(rare, "rid", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )
