import random

import corpus_pipeline
from dijkstone.llm import pieces
from dijkstone.llm.queries import VOCABULARY
from tests.llm.test_decontaminate import brute as contaminated_by
from tests.llm.test_simhash import brute as groups_of
from tests.llm.test_substring_dedup import WINDOW

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut(rows):
    """Kept texts by brute force; texts that lose nothing stay as they are."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = (t or "").split(), set()
        for s in range(len(w) - WINDOW + 1):
            k = tuple(w[s : s + WINDOW])
            if k in seen:
                gone.update(range(s, s + WINDOW))
            seen.add(k)
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    return out


def test_equals_brute_force(spark, tmp_path):
    r = random.Random(21)
    word = lambda: "".join(r.choice(["re", "an", "th", "es", "or", "in", "qu"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(6)]
    passage, docs, toxic = text(60), [], set()
    for i in range(700):
        t = text(r.randint(5, 90))
        kind = r.random()
        if kind < 0.2:
            t += " idiot scum vile " + text(5)
            toxic.add(i)
        elif kind < 0.3:
            t += "\n" + passage + "\n" + text(30)
        elif kind < 0.4:
            t += " " + r.choice(items)[1]
        elif kind < 0.5 and docs:
            j = r.randrange(len(docs))
            t = docs[j][1]
            if j in toxic:
                toxic.add(i)
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
    docs.append((700, None, None, None, None))
    docs.append((701, "", None, "s1", 0))
    labels = [(i, 1, int(i in toxic)) for i in range(700)]
    base = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")

    left = [(i, t) for i, t, *_ in docs if i not in toxic]
    group = {i: c for i, (_, c) in groups_of(left).items()}
    kept = cut([(i, t) for i, t in left if group[i] == i])
    bad = {i for i, x in contaminated_by(list(kept.items()), items).items() if x[4]}
    want = {i: t for i, t in kept.items() if i not in bad}
    assert toxic and bad and any(kept[i] != t for i, t in left if i in kept) and len(group) > len(set(group.values()))

    got = corpus_pipeline.run(spark, base)
    assert got.columns == [*COLUMNS, "ids", "n_ids", "exact"]
    rows = got.collect()
    assert {x.doc_id: x.text for x in rows} == want and len(rows) == len(want)
    v = pieces.Vocabulary.load(VOCABULARY)
    assert all(x.exact and (x.ids is None if x.text is None else pieces.decode(v, x.ids) == x.text) for x in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "benchmark decontamination", "sentencepiece"]


def test_stages_keep_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == COLUMNS and out.collect() == []


def test_extra_columns_pass(spark, tmp_path):
    """Columns named like the results of the operators come through all stages unchanged, also on odd rows."""
    extra = ["score", "predicted", "evidence", "n_words", "n_removed", "kept_text", "repeats", "n_hit", "contaminated", "component_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    texts = ["a b c", None, "", "idiot scum " * 5, "idiot scum " * 5, "x y z " * 30]
    rows = [(i, t, "en", None, None, *(f"{c}{i}" for c in extra)) for i, t in enumerate(texts)] + [(None, "p q", None, None, 3, *extra)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, int(bool(t and "scum" in t))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "u v w")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = {x.doc_id: x for x in out.collect()}
        assert out.columns[: len(docs.columns)] == docs.columns and None in got and 0 in got, name
        assert all(got[i][c] == (f"{c}{i}" if i is not None else c) for i in got for c in extra), name
