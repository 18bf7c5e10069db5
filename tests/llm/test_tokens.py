"""Encoder, ORC files, counts and packing against the tokenizers library and recounting."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.orc as orc
import pytest

from lineweave.llm import packing, token_counts, token_orc, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

SIGNS = [" ", "  ", "\n", "\t", "a", "B", "é", "7", ".", ",", "'s", " ", "́", "世", "🙂", "\r\n", "\x0b", "\x85", "\xa0", "Word", "été", "!", "\x1c", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "ÀÉ"]


def some_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [None, "", "x" * 5000 + " y", " \n" * 50, "word " * 3000]


def reference(name, special_as_text=False):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = special_as_text
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("capacity", [50, 100_000])
def test_encoder_equals_the_library(name, capacity):
    texts, want = some_texts(1500), reference(name)
    enc = tokens.Encoder(public_tokenizers.path(name), name.startswith("byte"), capacity)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        got = enc.encode([(t or "").encode() for t in part])
        assert [g.tolist() for g in got] == [want(t) for t in part]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens(name):
    texts = ["x <|endoftext|> y", "<|endoftext|><|startoftext|>", "a<|ENDOFTEXT|>  b", "no <| end |> of text", "<|endoftext|>\u0338 z"]
    raw = [t.encode() for t in texts]
    for as_text in (False, True):
        want = reference(name, as_text)
        enc = tokens.Encoder(public_tokenizers.path(name), name.startswith("byte"), special_as_text=as_text)
        assert [g.tolist() for g in enc.encode(raw)] == [want(t) for t in texts]
    assert reference(name)(texts[0]) != reference(name, True)(texts[0])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_beyond_a_slab_and_equal_hashes(name, monkeypatch):
    texts, want = some_texts(200, 4), reference(name)
    raw, ids = [(t or "").encode() for t in texts], [want(t) for t in texts]
    monkeypatch.setattr(tokens, "SLAB", 64)
    enc = tokens.Encoder(public_tokenizers.path(name), name.startswith("byte"))
    assert [g.tolist() for g in enc.encode(raw)] == ids
    monkeypatch.undo()
    # all pieces of one length under one hash: their bytes tell, and the library is asked
    monkeypatch.setattr(tokens, "piece_hashes", lambda b, s, e: (e - s).astype(np.uint64))
    enc = tokens.Encoder(public_tokenizers.path(name), name.startswith("byte"))
    assert [g.tolist() for g in enc.encode(raw)] == ids and [g.tolist() for g in enc.encode(raw)] == ids


def test_words_of_pieces_tell_them_apart():
    rng = random.Random(7)
    pieces = [bytes(rng.choice(b"ab\x00\xff") for _ in range(n)) for n in range(1, 41) for _ in range(30)]
    pieces += [p[:k] + bytes([p[k] ^ 1]) + p[k + 1 :] for p in pieces[::7] for k in range(len(p))]
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    e = np.cumsum([len(p) for p in pieces])
    outer, inner = tokens.piece_words(raw, e - [len(p) for p in pieces], e)
    found = defaultdict(set)
    for k, p in enumerate(pieces):
        found[len(p), *outer[:, k].tolist(), *inner[:, k].tolist()].add(p)
    assert all(len(v) == 1 for v in found.values()) and len(found) == len(set(pieces))


def documents(spark, texts):
    rows = [(i * 7 % 1009, t, 1) for i, t in enumerate(texts)] + [(5, "again one", 1), (5, "again one", 1), (None, "no id", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)


def test_orc_round_trip_and_metadata(spark, tmp_path, capsys):
    rows, docs = documents(spark, some_texts(300, 1))
    want = reference(token_orc.VOCABULARY)
    token_orc.write(docs, str(tmp_path / "ids"), ranges=3)
    got = token_orc.read(spark, str(tmp_path / "ids")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((i is not None, i or 0, want(t) + [1]) for i, t, _ in rows)
    in_order, at = sorted(got, key=lambda r: r.start), 0
    for r in in_order:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in in_order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    crc = {r.start: r.ids_crc32 for r in token_orc.crc32_of_ids(token_orc.read(spark, str(tmp_path / "ids"))).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in got)
    files = [orc.ORCFile(str(p)) for p in (tmp_path / "ids").glob("*.orc")]
    assert sum(f.nrows for f in files) == len(rows) and all(f.row_index_stride == token_orc.STRIDE for f in files)
    spans = sorted((min(x), max(x)) for f in files if (x := [v for v in f.read(["doc_id"]).column(0).to_pylist() if v is not None]))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # files hold disjoint ranges
    looked_up = token_orc.read(spark, str(tmp_path / "ids")).where("doc_id = 7")
    looked_up.explain("formatted")
    assert "EqualTo(doc_id,7)" in capsys.readouterr().out
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_orc.crc32_of_ids(token_orc.written_and_read(none)).count() == 0


def test_counts(spark):
    rows, docs = documents(spark, some_texts(200, 2) + ["same words here"] * 20)
    want = reference(token_counts.VOCABULARY)
    lens = [len(want(t)) + 1 for _, t, _ in rows]
    old, token_counts.SPAN = token_counts.SPAN, 16  # several spans
    try:
        hist = token_counts.histogram(token_counts.lengths(docs)).cache()
    finally:
        token_counts.SPAN = old
    got = {r.length: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lens)
    for k, r in got.items():
        assert r.docs_at_least == sum(x >= k for x in lens) and r.tokens_at_least == sum(x for x in lens if x >= k)
        assert r.docs_below == len(lens) - r.docs_at_least and r.tokens_below == sum(lens) - r.tokens_at_least
        assert r.truncated_total == sum(min(x, k) for x in lens)
    limits = [0, 1, 2, 5, 17, 100, 10**6]
    assert {r.limit: (r.docs_over, r.truncated_total) for r in token_counts.at_limits(hist, limits).collect()} == {k: (sum(x > k for x in lens), sum(min(x, k) for x in lens)) for k in limits}
    s = sorted(lens)
    assert {r.quantile: r.length for r in token_counts.quantiles(hist, [0.0, 0.5, 0.9, 1.0]).collect()} == {q: s[max(0, int(np.ceil(q * len(s))) - 1)] for q in (0.0, 0.5, 0.9, 1.0)}
    told = token_counts.report(token_counts.lengths(docs), limits, (0.5, 0.9, 1.0)).collect()
    assert {r.length: (r.docs_at_least - r.n_docs, r.truncated_total) for r in told if r.is_limit} == {k: (sum(x > k for x in lens), sum(min(x, k) for x in lens)) for k in limits}
    assert {r.length for r in told if r.n_docs} == set(lens) and {r.length for r in told} == set(lens) | set(limits)
    assert {q: r.length for r in told for q in r.quantiles.split(",") if q} == {str(q): s[max(0, int(np.ceil(q * len(s))) - 1)] for q in (0.5, 0.9, 1.0)}
    none = token_counts.histogram(token_counts.lengths(docs.limit(0)))
    assert {r.length for r in token_counts.quantiles(none, [0.5]).collect()} == {None}
    assert none.count() == 0 and token_counts.at_limits(none, [4]).first().truncated_total == 0


def test_packing(spark):
    rows, docs = documents(spark, some_texts(400, 3) + ["long " * 9000, "words and more " * 700])
    want = reference(packing.VOCABULARY)
    pieces = packing.pack_documents(docs).collect()
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        per_seq[p.sequence_id].append(p)
        per_doc[p.doc_id, p.doc_tokens].append(p)
    for seq in per_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.MAX_TOKENS
    expected = Counter(np.array([*want(t), 1], dtype="<u4").tobytes() for _, t, _ in rows)
    found = Counter()
    for (_, n), ps in per_doc.items():
        by_start = defaultdict(list)
        for p in ps:
            by_start[p.start].append(p)
        if sum(p.length for p in ps) == n:
            found[b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start))] += 1
        else:  # repeated ids: every piece is a whole document
            found.update(bytes(p.ids) for p in ps)
    assert found == expected
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packer_limits_and_fill():
    rng = random.Random(1)
    p = packing.Packer(100, 5, 60, pool=40)
    items = [(rng.randint(1, 250), rng.random()) for _ in range(500)]
    out = [x for k, (n, share) in enumerate(items) for x in p.add(k, n, int(n * share))] + list(p.finish())
    seq, seen = defaultdict(list), defaultdict(list)
    for s, offset, k, start, n in out:
        seq[s].append((offset, n, k, start))
        seen[k].append((start, n))
    for k, (n, _) in enumerate(items):
        at = 0
        for start, m in sorted(seen[k]):
            assert start == at
            at += m
        assert at == n
    for rows in seq.values():
        assert len(rows) <= 5 and sum(n for _, n, *_ in rows) <= 100
        # the last tokens of an example bear loss
        assert sum(max(0, min(n, start + n - (items[k][0] - int(items[k][0] * items[k][1])))) for _, n, k, start in rows) <= 60
    small = packing.Packer(2048, 64, 2048)
    sizes = [rng.randint(1, 900) for _ in range(6000)]
    used = Counter()
    for k, n in enumerate(sizes):
        for s, _, _, _, m in small.add(k, n, n - 1):
            used[s] += m
    for s, _, _, _, m in small.finish():
        used[s] += m
    assert sum(sizes) / (2048 * len(used)) > 0.995
    short = packing.Packer()
    sizes = [rng.randrange(5, 30) for _ in range(60_000)]
    used = Counter()
    for s, _, _, _, m in [x for k, n in enumerate(sizes) for x in short.add(k, n, n - 1)] + list(short.finish()):
        used[s] += m
    assert sum(used.values()) == sum(sizes) and sum(sizes) / (2048 * len(used)) > 0.995
    with pytest.raises(ValueError):
        list(packing.Packer(10, 5, 10, may_cut=False).add(0, 11, 3))


def slow_packing(items, limits, pool, smallest):
    """The heuristic by its definition over a plain list of waiting pieces: [(sequence, offset, key, start, n)]."""
    out, waiting, sequence = [], [], 0  # waiting: (tokens, loss, key, start)
    stamp, clock = {}, 0  # since when pieces of a size wait

    def wait(n, loss, k, start):
        nonlocal clock
        if not any(w[:2] == (n, loss) for w in waiting):
            stamp[n, loss] = clock = clock + 1
        waiting.append((n, loss, k, start))

    def close():
        nonlocal sequence
        left, offset = list(limits), 0
        while left[1]:
            fits = [i for i, w in enumerate(waiting) if w[0] <= left[0] and w[1] <= left[2]]
            if not fits:
                break
            score = lambda i: waiting[i][0] * (left[0] / limits[0] ** 2) + left[1] / limits[1] ** 2 + waiting[i][1] * (left[2] / limits[2] ** 2)
            best = max(fits, key=lambda i: (score(i), -stamp[waiting[i][:2]], i))
            n, loss, k, start = waiting.pop(best)
            out.append((sequence, offset, k, start, n))
            offset, left = offset + n, [left[0] - n, left[1] - 1, left[2] - loss]
        room = min(left[0], left[2])
        if waiting and left[1] and room >= smallest:
            size = max(w[:2] for w in waiting)
            if size[0] - room >= smallest:
                i = max(i for i, w in enumerate(waiting) if w[:2] == size)
                n, loss, k, start = waiting.pop(i)
                out.append((sequence, offset, k, start, room))
                wait(n - room, min(loss, n - room), k, start + room)
        sequence += 1

    for k, (n, loss) in enumerate(items):
        most, start = min(limits[0], limits[2]), 0
        while n - start > most:
            out.append((sequence, 0, k, start, most))
            sequence, start = sequence + 1, start + most
        wait(n - start, min(loss, n - start), k, start)
        if len(waiting) >= pool:
            close()
    while waiting:
        close()
    return out


@pytest.mark.parametrize("limits", [(100, 5, 60), (100, 50, 100), (64, 3, 20)])
def test_packer_follows_the_heuristic(limits):
    rng = random.Random(limits[2])
    items = [(n := rng.choice([1, 3, 7, 20, 45, 90, 250]), rng.randrange(n + 1)) for _ in range(300)]
    p = packing.Packer(*limits, pool=25)
    got = [x for k, (n, loss) in enumerate(items) for x in p.add(k, n, loss)] + list(p.finish())
    assert got == slow_packing(items, limits, 25, packing.SMALLEST_CUT)


def test_loss_bounds_instruction_data(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["red", "blue", "green"]) for _ in range(n))
    rows = [(i, words(rng.randrange(0, 60)), words(rng.randrange(0, 200)), 1) for i in range(300)] + [(301, None, None, 1), (302, "only asked", None, 1), (303, words(5000), words(3000), 1)]
    examples = spark.createDataFrame(rows, "doc_id long, prompt string, response string, text int").repartition(2)
    want = reference(packing.VOCABULARY)
    ids = {i: ([*want(p), *want(r), 1], len(want(p))) for i, p, r, _ in rows}
    loss, used, whole = Counter(), Counter(), defaultdict(dict)
    for p in packing.pack_examples(examples).collect():
        whole[p.doc_id][p.start] = np.frombuffer(bytes(p.ids), dtype="<u4").tolist()
        used[p.sequence_id] += p.length
        loss[p.sequence_id] += max(0, p.start + p.length - max(p.start, ids[p.doc_id][1]))
    assert {i: [x for s in sorted(v) for x in v[s]] for i, v in whole.items()} == {i: v[0] for i, v in ids.items()}
    assert max(loss.values()) <= packing.MAX_RESPONSE and max(used.values()) <= packing.MAX_TOKENS
    full = sorted(loss.values())
    assert full[len(full) // 2] > 0.95 * packing.MAX_RESPONSE  # it is this limit that closes them


def test_packer_keeps_only_what_waits(spark):
    docs = spark.createDataFrame([(i, "long words " * 20_000) for i in range(3)] + [(9, "x")], "doc_id long, text string").repartition(1)
    got = packing.pack_documents(docs).collect()
    per = Counter()
    for p in got:
        per[p.doc_id] += p.length
    assert {p.doc_id: p.doc_tokens for p in got} == dict(per)


def test_orc_stripes_bloom_filters_and_pruning(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(token_orc, "STRIPE_BYTES", 1 << 14)
    ids = rng.sample(range(0, 10**9, 2), 12_000)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["one", "two", "three", "four"]) + str(rng.randrange(10**6)) for _ in range(12))) for i in ids], "doc_id long, text string")
    token_orc.write(docs, str(tmp_path / "ids"), ranges=2)
    files = sorted((tmp_path / "ids").glob("*.orc"))
    made = [orc.ORCFile(str(p)) for p in files]
    assert any(f.nstripes > 1 for f in made)
    # streams and encodings are told in the stripe footers; columns are doc_id (1) and the ids (6)
    tell = spark._jvm.org.apache.orc.OrcFile
    conf = spark._jsc.hadoopConfiguration()
    for p in files:
        reader = tell.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(p)), tell.readerOptions(conf))
        rows = reader.rows()
        footer = rows.readStripeFooter(reader.getStripes().get(0))
        kinds = {str(footer.getStreams(k).getKind()) for k in range(footer.getStreamsCount()) if footer.getStreams(k).getColumn() == 1}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds and {str(footer.getColumns(k).getKind()) for k in (1, 6)} == {"DIRECT_V2"}  # run-length encoded integers
        rows.close()
    # a file's rows by stripe hold disjoint ids, and a lookup reads few row groups
    for f in made:
        spans = [(min(x), max(x)) for k in range(f.nstripes) if (x := f.read_stripe(k, ["doc_id"]).column(0).to_pylist())]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    one = sorted(ids)[4321]
    looked = spark.read.orc(str(tmp_path / "ids")).where(f"doc_id = {one}")
    looked.collect()
    scans = [n for n in _nodes(looked._jdf.queryExecution().executedPlan()) if "Scan orc" in n.nodeName()]
    read = sum(n.metrics().apply("numOutputRows").value() for n in scans)
    assert 1 <= read <= 3 * token_orc.STRIDE < len(ids) and spark.read.orc(str(tmp_path / "ids")).where(f"doc_id = {one + 1}").count() == 0


def _nodes(plan):
    out = [plan]
    kids = plan.children() if "Adaptive" not in plan.nodeName() else None
    if kids is None:
        return out + _nodes(plan.executedPlan())
    for k in range(kids.size()):
        out += _nodes(kids.apply(k))
    return out


def test_ranges_follow_the_input(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert token_orc.n_ranges(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    old, token_orc.RANGE_BYTES = token_orc.RANGE_BYTES, 16
    try:
        assert token_orc.n_ranges(docs.unionByName(docs)) >= 4
    finally:
        token_orc.RANGE_BYTES = old


def test_kept_pieces_are_found_again(monkeypatch):
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = [b"some words of a text, longer-than-sixteen-bytes-words too", b"and some others"]
    want = [g.tolist() for g in enc.encode(texts)]
    monkeypatch.setattr(enc, "_each", lambda *a: pytest.fail("the library was asked for known pieces"))
    monkeypatch.setattr(enc, "encode_pieces", lambda *a: pytest.fail("known pieces were encoded anew"))
    assert [g.tolist() for g in enc.encode(texts[::-1])] == want[::-1]
