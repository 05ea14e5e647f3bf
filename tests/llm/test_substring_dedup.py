import hashlib
import random

from dijkstone.llm.substring_dedup import remove_repeats

WINDOW = 20


def brute(rows, window=WINDOW):
    seen, out = {}, {}
    split = {i: [] if t is None else t.encode().split() for i, t in rows}
    for i in sorted(split):
        w, gone = split[i], set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone.update(range(s, s + window))
            else:
                seen[k] = (i, s)
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def make(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé😀") for _ in range(r.choice([1, 1, 2, 3])))
    text = lambda k: r.choice([" ", "\n", " \t "]).join(word() for _ in range(k))
    passages = [text(r.choice([19, 20, 21, 25, 40, 80])) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1:
            t = r.choice([None, "", "  \n", "x", text(19)])
        elif kind < 0.3 and rows:
            t = r.choice(rows)[1]
        elif kind < 0.4 and rows and r.choice(rows)[1]:
            w = (r.choice(rows)[1] or "q").split()
            w[r.randrange(len(w)) if w else 0 :] = ["zz"]
            t = " ".join(w)
        else:
            t = " ".join(x for _ in range(r.randint(1, 4)) for x in (text(r.randint(0, 60)), r.choice(passages)))
        rows.append((i, t))
    rows.append((n, ("la " * 100) + text(30)))
    rows.append((n + 1, "la " * 30))
    rows.append((n + 2, text(30_000)))
    r.shuffle(rows)
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256((x.kept_text or "").encode()).hexdigest()) for x in remove_repeats(df).collect()}
    assert got == brute(rows)


def test_equals_brute_force(spark):
    for seed in (1, 2):
        check(spark, make(seed))


def test_nulls_repeated_rows_clashing_columns(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(1, t, "x"), (1, t, "x"), (None, t, None), (None, None, "y"), (2, None, "z"), (3, t + " tail", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = remove_repeats(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text", "repeats"]
    got = sorted((x.doc_id or -1, x.n_words, x.n_removed, x.kept_text) for x in out.collect() if x.doc_id)
    assert [x[:3] for x in got][2:] == [(2, 0, 0), (3, 51, 50)] and got[3][3] == "tail"
    assert got[0] == got[1] and got[0][1] == 50
    assert sum(1 for _ in out.collect()) == 6


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
