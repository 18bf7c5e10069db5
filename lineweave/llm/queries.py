"""Thin queries over the test tables, one for each operator, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, licenses, maxent, media, mixing, packing, quality, secrets, simhash, token_counts, token_orc
from ..session import attach
from .common import table


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.withColumnRenamed("id", "doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.crc32_of_ids(token_orc.written_and_read(table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(token_counts.lengths(table(spark, sf_dir, "documents")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    return chat.digests(chat.read_back(chat.format_conversations(rows.unionByName(probe))))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(table(spark, sf_dir, "documents")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.peak_pairs(media.to_wav(table(spark, sf_dir, "documents"))))


def op11_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: n-gram buckets, weights in millionths of a nat and base counts, as the operator defines them.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
flat AS (SELECT d.rid, string_split(trim(regexp_replace(d.text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '') AS c FROM d),
grams AS (SELECT rid, (((unicode(c[i])::BIGINT * 521 + unicode(c[i + 1])) * 521 + unicode(c[i + 2])) * 521 + unicode(c[i + 3])) % 65521 AS b
          FROM (SELECT rid, c, unnest(range(1, greatest(len(c) - 2, 1))) AS i FROM flat)),
per AS (SELECT rid, b, count(*) AS n FROM grams GROUP BY rid, b),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (SELECT b, sum(n) AS r, coalesce(sum(n) FILTER (WHERE d.doc_id IN (SELECT doc_id FROM good)), 0) AS t FROM per JOIN d USING (rid) GROUP BY b),
totals AS (SELECT sum(r)::DOUBLE AS rs, sum(t)::DOUBLE AS ts FROM counts),
smooth AS (SELECT b, t::DOUBLE AS t, ts, (r + 1)::DOUBLE / (rs + 65521) AS q FROM counts, totals),
weights AS (SELECT b, round(1e6 * (ln((t + 65521 * q) / (ts + 65521)) - ln(q)))::BIGINT AS w FROM smooth),
scores AS (SELECT rid, sum(n * w)::BIGINT AS llr, sum(n)::BIGINT AS ng FROM per JOIN weights USING (b) GROUP BY rid),
wins AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n
         FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM wins, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (SELECT d.rid, d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
                coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(llr, 0)::BIGINT AS llr_micro, coalesce(ng, 0)::BIGINT AS n_grams
         FROM d JOIN words USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN scores USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND llr_micro >= -400000 * n_grams AS kept, llr_micro, n_grams
FROM base
"""

#: Sizes, targets by running sums, quotas in blocks, rounds of the permutation of blocks, shards drawn, and the overlap of blocks and documents.
_OP6_DRAW = "('0x' || substr(md5(concat_ws('|', {})), 1, 15))::BIGINT"
_OP6_ROUNDS = "".join(
    f""",
x{i + 1} AS (SELECT *, CASE WHEN (((greatest(x{i}, (k{i} + n_blocks - x{i}) % n_blocks) % {mixing.PRIME}) * {a} + {b}) % {mixing.PRIME}) // 4096 % 2 = 1 THEN (k{i} + n_blocks - x{i}) % n_blocks ELSE x{i} END AS x{i + 1} FROM x{i})"""
    for i, (a, b) in enumerate(mixing.round_constants())
)
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, rnk % 3 + 1 AS weight, 3 * source_size AS cap FROM k),
r AS (SELECT *, sum(source_size) OVER () AS all_size,
             sum(source_size) OVER () - (sum(cap) OVER o - cap) AS lft, sum(weight) OVER () - (sum(weight) OVER o - weight) AS left_weight
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, rnk ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap * left_weight < weight * lft AS capped FROM r),
f AS (SELECT *, all_size - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS free_size, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS free_weight FROM c),
t AS (SELECT source, rnk, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * free_size)::DOUBLE / greatest(free_weight, 1)::DOUBLE END AS target,
             ((source_size + 127) // 128)::BIGINT AS n_blocks FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * n_blocks / source_size + 0.5)::BIGINT ELSE 0 END AS quota FROM t),
v AS (SELECT *, greatest(1, ceil(sum(quota) OVER () / 1024.0))::BIGINT AS shards{"".join(f", {_OP6_DRAW.format(f"'42', 'pivot', rnk, '{i}'")} % greatest(n_blocks, 1) AS k{i}" for i in range(mixing.ROUNDS))} FROM q),
x0 AS (SELECT *, j % n_blocks AS x0 FROM (SELECT *, unnest(range(0, quota)) AS j FROM v WHERE quota > 0)){_OP6_ROUNDS},
slots AS (SELECT rnk, x{mixing.ROUNDS} AS block, {_OP6_DRAW.format("'42', 'shard', rnk, j")} % shards AS shard FROM x{mixing.ROUNDS}),
n AS (SELECT greatest(1, ceil(count(*) / 256.0))::BIGINT AS chunks FROM documents),
o AS (SELECT d.doc_id, d.size, q.rnk, q.source_size, q.target,
             sum(d.size) OVER (PARTITION BY q.rnk ORDER BY {_OP6_DRAW.format("'42', 'chunk', d.doc_id")} % n.chunks, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start,
             row_number() OVER () AS rid
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source CROSS JOIN n),
p AS (SELECT rid, rnk, start, size, unnest(range((start // 128)::BIGINT, ((start + size - 1) // 128 + 1)::BIGINT)) AS block FROM o WHERE size > 0),
g AS (SELECT rid, sum(least((block + 1) * 128 - start, size) - greatest(block * 128 - start, 0))::BIGINT AS taken, count(DISTINCT shard) AS n_shards, min(shard) AS first_shard
      FROM p JOIN slots USING (rnk, block) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n_shards, 0)::BIGINT AS n_shards, first_shard FROM o LEFT JOIN g USING (rid)
"""

OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) AS v(turn, role, text)),
e AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS begins,
             length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + CASE WHEN begins THEN length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 ELSE length('<|im_sep|>') END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Pieces, their words, phrases of one to five words with their counts, all cuts, candidates that no longer one holds.
OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) AS r(m))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS x, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(x[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(x[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(x[i:i + j - 1], ' ') AS phrase, max(a) AS most
      FROM (SELECT lang, m, string_split(phrase, ' ') AS x, a, j, unnest(range(1, m - j + 2)) AS i FROM f, range(2, 5) AS r(j) WHERE m > j) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a QUALIFY rank <= 2000
"""

QUERIES = {
    "op1_quality_llr": op1_quality_llr, "op2_simhash": op2_simhash, "op3_token_orc": op3_token_orc, "op4_token_counts": op4_token_counts,
    "op5_secrets": op5_secrets, "op6_mixing": op6_mixing, "op7_chat": op7_chat, "op8_packing": op8_packing, "op9_licenses": op9_licenses,
    "op10_media": op10_media, "op11_maxent_lm": op11_maxent_lm, "op12_collocations": op12_collocations,
}
SQL = {"op1_quality_llr": OP1_SQL, "op6_mixing": OP6_SQL, "op7_chat": OP7_SQL, "op12_collocations": OP12_SQL}


def _attached(f):
    return lambda spark, sf_dir: f(attach(spark), sf_dir)


QUERIES = {name: _attached(f) for name, f in QUERIES.items()}
