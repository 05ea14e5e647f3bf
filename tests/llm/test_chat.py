import hashlib
import random

from dijkstone.llm.chat import format_chats, read_back

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark):
    r = random.Random(11)
    bits = ["</turn>", "### ", "\\", "\\l", "\\b", "*", ": ", ":", "\n", "### Assistant: ", "a", "é😀", "<", "#", "</turn", ">", " ", "##"]
    rows = []
    for c in range(120):
        for t in range(r.randint(1, 9)):
            text = r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 12)))])
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", "a:b*\\\n", "*", ""]), text))
    rows += [(500, t, "assistant" if t % 2 else "user", "x" * 300_000 + "</turn>") for t in range(4)]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    chats = format_chats(df)
    want = {}
    for c, _, role, text in sorted(rows, key=lambda x: x[:2]):
        want.setdefault(c, []).append((role, text or ""))
    texts = {x.conv_id: x for x in chats.collect()}
    for x in read_back(chats).collect():
        w = want[x.conv_id]
        learnt = "".join(t for role, t in w if role == "assistant")
        assert (x.n_turns, x.turns_sha256) == (len(w), SHA("".join(f"{a}\n{b}\n" for a, b in w)))
        assert (x.loss_chars, x.loss_sha256) == (len(learnt), SHA(learnt))
        full = texts[x.conv_id]
        assert x.formatted_chars == len(full.formatted) and full.formatted.count("</turn>") == len(w) == full.formatted.count("### ")
        spans = [full.formatted[s.start : s.start + s.length] for s in full.loss]
        spans = [s if "\\" not in s or t == s else s.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") for s, t in zip(spans, [t for role, t in w if role == "assistant"])]
        assert "".join(spans) == learnt
    assert len(texts) == len(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, 1), (1, 0, "assistant", "b", 2), (1, 0, "assistant", "a", 3), (None, 0, "user", "x", 4), (None, 0, "user", "y", 5)], "conv_id long, turn long, role string, text string, formatted int")
    got = sorted((x.conv_id or 0, x.formatted) for x in format_chats(df).collect())
    assert got == [(0, "### user: x</turn>\n"), (0, "### user: y</turn>\n"), (1, "### : </turn>\n### assistant: a</turn>\n### assistant: b</turn>\n")]
    assert format_chats(df.limit(0)).collect() == []
