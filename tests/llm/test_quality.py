"""Quality rules against brute force, and edge cases."""

import random
from collections import Counter
from math import log

from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import quality as Q

pieces = st.lists(st.sampled_from(["a", "b", "the", "é", " ", "  ", "\n", "\t", "#", "|", "\x0b", "\xa0", "日本", "\x1c"]), max_size=60).map("".join)


def slow_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if wins[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def slow_grams(text):
    import re

    t = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")
    return [(((ord(t[i]) * 521 + ord(t[i + 1])) * 521 + ord(t[i + 2])) * 521 + ord(t[i + 3])) % Q.BUCKETS for i in range(len(t) - 3)]


@given(pieces)
@settings(max_examples=300, deadline=None)
def test_counts_and_grams(text):
    assert Q.base_counts(text) == slow_base(text)
    assert [x for g in Q.grams(text) for x in g.tolist()] == slow_grams(text)


def test_repeated_words_of_many_kinds():
    words = [str(i).encode() for i in range(1500)] * 2
    assert Q.repeat_words(words) == 2998 + 2  # every window but the two over the seam, whose words others cover
    assert Q.repeat_words([b"a"] * 3) == 0 and Q.repeat_words([b"a"] * 4) == 4


def prose(rng, n):
    return " ".join(rng.choice(["the", "tion", "eron", "inand", "hathe", "of", "reed", "sting"]) + rng.choice(["", "er", "ing", "s"]) for _ in range(n))


def junk(rng, n):
    return " ".join("%03d$$|%d" % (rng.randrange(1000), rng.randrange(10)) for _ in range(n))


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, 120) for _ in range(40)] + [junk(rng, 90) for _ in range(10)] + [None, "", "abc", prose(rng, 30), "x y z " * 40]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, id string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(41, 0), (None, 1), (999, 1), (2, 1), (3, None)], "doc_id long, quality int")
    got = {r.id: r for r in Q.quality_rules(docs, labels).collect()}
    raw, tgt = Counter(), Counter()
    for i, t in enumerate(texts):
        g = slow_grams(t or "")
        raw.update(g)
        if i < 40 and i % 2 == 0:
            tgt.update(g)
    nr, nt = sum(raw.values()), sum(tgt.values())

    def weight(b):
        q = (raw[b] + 1) / (nr + Q.BUCKETS)
        w = 1e6 * (log((tgt[b] + Q.BUCKETS * q) / (nt + Q.BUCKETS)) - log(q))
        return int(abs(w) + 0.5) * (1 if w > 0 else -1)

    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = slow_grams(t or "")
        n, chars, sym, dup, rep = slow_base(t or "")
        total = sum(map(weight, g))
        failed = n < 50 or 100 * rep > 50 * n
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert (r.base_failed, r.llr_micro, r.n_grams, r.kept) == (failed, total, len(g), not failed and total >= Q.THRESHOLD_MICRO * len(g))
    rate = lambda i: got[i].llr_micro / max(got[i].n_grams, 1)
    clean = [i for i in range(40) if not got[i].base_failed]
    assert len(clean) > 30 and all(got[i].kept for i in clean) and not any(got[i].kept for i in range(50, 55))
    assert max(rate(i) for i in range(40, 50)) < min(rate(i) for i in clean) - 0.1e6
    kept = Q.good_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(55) if got[i].kept]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_rules(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a b c " * 5)], "doc_id long, text string")
    assert Q.quality_rules(one, labels).first().base_failed and Q.quality_rules(one, labels).first().llr_micro == 0
