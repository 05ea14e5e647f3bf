import math
import random
import re
from collections import Counter

import numpy as np

from dijkstone.llm import language, toxicity


def test_block_max_is_exact():
    r = random.Random(8)
    draw = lambda n: {f: r.random() for f in r.sample(range(40), n)}
    unit = lambda v: {f: w / np.sqrt(sum(x * x for x in v.values())) for f, w in v.items()}
    flat = lambda vs: tuple(np.array(x) for x in zip(*((i, f, w) for i, v in enumerate(vs) for f, w in sorted(v.items()))))
    vectors = [unit(draw(r.randint(1, 6))) for _ in range(700)]
    vectors += vectors[:50]  # ties
    for dense in (0, 5, 40):
        index = toxicity.BlockMaxIndex.build(*flat(vectors), len(vectors), 40, block=16, dense=dense)
        queries = [unit(draw(r.randint(1, 8))) for _ in range(60)]
        for q, (near, numbers) in zip(queries, index.search(*flat(queries), len(queries), 10)):
            want = sorted(((sum(w * v.get(f, 0) for f, w in q.items()), i) for i, v in enumerate(vectors)), key=lambda x: (-x[0], x[1]))
            want = [x for x in want if x[0] > 0]
            assert np.allclose(near, [x for x, _ in want[:10]]) and len(near) == min(10, len(want))
            exact = {i: x for x, i in want}
            assert all(abs(exact[i] - x) < 1e-12 for x, i in zip(near, numbers.tolist()))
        none = np.zeros(0, np.int64)
        assert [len(x) for x, _ in index.search(none, none, np.zeros(0), 1, 5)] == [0]
    assert [len(x) for x, _ in toxicity.BlockMaxIndex.build(none, none, np.zeros(0), 0, 3).search(np.array([0]), np.array([1]), np.ones(1), 1, 5)] == [0]


def _words(text):
    return Counter(re.findall(r"[^\W_]+", (text or "").lower()))


def _terms(text):
    out = Counter()
    for w, n in _words(text).items():
        for t in (w, *((k, w[:k]) for k in (4, 5) if len(w) > k)):
            out[t] += n
    return out


def brute_scores(docs, labels, k):
    """Scores of all texts by plain loops: TF-IDF times association, cosine with every example, weighted votes."""
    examples = [(i, _terms(t), labels[i]) for i, t in sorted(x for x in docs if x[0] in labels)]
    n, p, df = Counter(), Counter(), Counter()
    for _, c, y in examples:
        n.update(c.keys())
        p.update({t: y for t in c})
    for _, t in docs:
        df.update(_terms(t).keys())
    rate, bar = sum(y for *_, y in examples) / len(examples), math.log(max(sum(x > 1 for x in n.values()), 3))
    weight = {}
    for t in n:
        ratio = 0.0
        if p[t] > n[t] * rate:
            ratio = p[t] * math.log(p[t] / (n[t] * rate)) + ((n[t] - p[t]) * math.log((n[t] - p[t]) / (n[t] * (1 - rate))) if n[t] > p[t] else 0)
        weight[t] = (math.log((1 + len(docs)) / (1 + df[t])) + 0.1) * (0.1 + ratio / bar)

    def vector(c):
        v = {t: (1 + math.log(x)) * weight[t] for t, x in c.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    made, out = [(i, vector(c), y) for i, c, y in examples], []
    for i, t in docs:
        q = vector(_terms(t))
        near = sorted(((-sum(x * v.get(f, 0) for f, x in q.items()), j, y) for j, v, y in made))[:k]
        near = [(-s, y) for s, _, y in near if s < 0]
        out.append((i, (sum(s * y for s, y in near) + 0.5 * rate) / (sum(s for s, _ in near) + 0.5) if near else min(rate, 0.15)))
    return out


def test_toxicity_equals_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice(["re", "än", "th", "és", "or", "ın", "国"]) for _ in range(r.randint(1, 4)))
    docs = []
    for i in range(260):
        t = [word() for _ in range(r.randint(1, 40))] + r.choices(["Scum", "VILE!", "so-so"], k=r.choice([0, 0, 0, 2]))
        docs.append((i, r.choice([" ", "\n", ", ", " — "]).join(t)))
    docs += [(300, None), (301, ""), (302, "— ×, ÷ 12"), (303, "Ünïcode £5 naïve Scum"), (304, docs[3][1])]
    labels = {i: int("Scum" in t or "VILE" in t) for i, t in docs[:150]}
    df, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(df, toxicity.fit(df, known, k=7)).collect()}
    for i, s in brute_scores(docs, labels, 7):
        assert abs(got[i].score - s) < 1e-9, i
    assert got[300].evidence == got[301].evidence == [] and got[3].score == got[304].score and all(x.evidence for i, x in got.items() if i < 260)


def test_toxicity(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["re", "an", "th", "es", "or", "in"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        t = [word() for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.15
        if bad:
            t += r.choices(["idiot", "scum", f"vile{word()}"], k=3)
        r.shuffle(t)
        rows.append((i, " ".join(t), "x"))
        if i % 2:
            labels.append((i, int(bad)))
    rows += [(9000, None, "y"), (9001, "", "y"), (None, "idiot scum vilean", "z"), (9002, "clean", None), (9002, "clean", None), (9003, "q " * 200_000 + "Idiot scum", "z")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    out = toxicity.score(docs, model).collect()
    by = {x.doc_id: x for x in out}
    assert len(out) == len(rows) and by[None].predicted == 1 and by[9003].predicted == 1 and by[9000].predicted == by[9001].predicted == by[9002].predicted == 0
    truth = {i: any(w.startswith("vile") or w in ("idiot", "scum") for w in t.split()) for i, t, _ in rows[:1500]}
    assert np.mean([truth[i] == (by[i].predicted == 1) for i in truth]) > 0.98
    assert all(0 <= x.score <= 1 for x in out) and by[None].evidence
    empty = toxicity.fit(docs, known.limit(0))
    assert {x.predicted for x in toxicity.score(docs, empty).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def brute_languages(learned, texts):
    """(language, score) of texts by plain loops."""
    letters = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    counts, totals = {}, Counter()
    for lang, t in learned:
        for w in letters(t):
            for kind, g in [(0, w)] + [(k, w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1)]:
                counts.setdefault((kind, g), Counter())[lang] += 1
                totals[kind, lang] += 1
    langs = sorted({lang for lang, _ in learned})
    logs = lambda key: np.array([math.log((counts[key][x] + 0.1) / (totals[key[0], x] + 1)) for x in langs])
    out = []
    for t in texts:
        total, n = np.zeros(len(langs)), 0
        for w in letters(t):
            if (0, w) in counts:
                total += logs((0, w))
            else:
                parts, i = [], 0
                while i < len(w):
                    k = next((k for k in range(4, 0, -1) if i + k <= len(w) and (k, w[i : i + k]) in counts), 0)
                    parts.append(logs((k, w[i : i + k])) if k else np.full(len(langs), math.log(1e-6)))
                    i += max(k, 1)
                total += np.mean(parts, axis=0)
            n += 1
        out.append((langs[int(total.argmax())], float(1 / np.exp((total - total.max()) / n).sum())) if n else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark):
    r = random.Random(13)
    kinds = {"en": ["th", "ing", "er", "wh"], "de": ["sch", "ung", "ei", "ä", "Über"], "el": ["α", "β", "γδ"], "zh": ["国", "語", "人"]}
    rows = []
    for i in range(120):
        k = r.choice(list(kinds))
        rows.append((i, r.choice([" ", ", ", " — ", "1"]).join("".join(r.choices(kinds[k], k=r.randint(1, 4))) for _ in range(r.randint(1, 12))), k))
    odd = [(500, "αβ国 zzz thing", None), (501, "½ — ×÷ 12_", None), (502, "ß", None), (503, rows[0][1], None), (504, "", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    got = {x.doc_id: x for x in language.predict(docs, language.fit(docs.where("doc_id % 3 > 0"))).collect()}
    texts = rows + odd
    for (i, *_), (lang, score) in zip(texts, brute_languages([(k, t) for i, t, k in rows if i % 3], [t for _, t, _ in texts])):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9, i


def test_language(spark):
    r = random.Random(10)
    kinds = {"en": ["th", "ing", "er", "wh", "ly"], "de": ["sch", "ung", "ei", "ä", "ver"], "fr": ["eau", "é", "qu", "tion", "è"]}
    make = lambda k, n: " ".join("".join(r.choices(kinds[k], k=r.randint(1, 4))) for _ in range(n))
    rows = []
    for i in range(600):
        k = r.choice(list(kinds))
        rows.append((i, make(k, r.randint(3, 50)), k))
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 ² _ .", "en"), (None, make("de", 20), "de"), (1003, make("fr", 30), None), (1004, "schung" * 100_000, "de")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 2 = 0 or doc_id is null"))
    by = {x.doc_id: x for x in language.predict(docs, model).collect()}
    assert len(by) == len(rows) + len(odd)
    assert np.mean([by[i].lang_pred == k for i, _, k in rows if i % 2]) > 0.95
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "de" and by[1003].lang_pred == "fr" and by[1004].lang_pred == "de"
    nothing = language.fit(docs.limit(0))
    assert {x.lang_pred for x in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).collect() == []
