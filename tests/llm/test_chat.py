"""Round trips through the chat template."""

import hashlib
import random

from lineweave.llm import chat as C

BITS = [*C.CONTROL, "\\", "<", "[", "<\\s>", "</\\s>", "[\\\\INST]", "</s", "\n", "é", "text ", "", "<<s>>", "[[INST]]", "s>", "/INST]", "\\n"]


def test_round_trip(spark):
    rng = random.Random(7)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.05 else "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))
            role = rng.choice(["user", "assistant", "system", None, "a\nb", "we\\ird\\n", "</s>", "<|im_sep|>"])
            rows.append((c, t, role, text, "x"))
    rows += [(None, 0, "user", "no id", "x"), (500, None, "assistant", "first", "x"), (500, 1, "assistant", "second", "x"), (501, 1, "user", "same", "x"), (501, 1, "user", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df)).collect()}
    digest = {r.conv_id: r for r in C.digests(C.read_back(C.format_conversations(df))).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        want = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [w[2:] for w in want]
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in want)
        said = "".join(x for _, _, r, x in want if r == "assistant")
        d = digest[c]
        assert d.n_turns == len(want) and d.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert d.loss_chars == len(said) and d.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert d.formatted_chars == len(got[c].formatted)
        blocks = 1 + sum(a[2] != b[2] for a, b in zip(want, want[1:]))
        f = got[c].formatted
        # control strings stand only where the template has put them
        assert f.count(C.START) == f.count(C.END) == blocks and f.count(C.SEP) == len(want) - blocks
        assert not any(s in f for s in ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"))
    assert C.format_conversations(df.limit(0)).count() == 0


def test_adjacent_turns_merge(spark):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(df).first().formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_one_long_conversation(spark):
    df = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 5 < 2 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id) AS text")
    r = C.digests(C.read_back(C.format_conversations(df))).first()
    assert r.n_turns == 20_000 and r.loss_chars == sum(len(f"t{i}") for i in range(20_000) if i % 5 >= 2)
