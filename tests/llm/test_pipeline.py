"""The whole pipeline and whole models on small tables, against plain Python."""

import math
from collections import Counter

import numpy as np
from test_tables import prose, table

import corpus_pipeline
from tidewrack.llm import langid, packing, toxicity


def sentences(seed, n=12, size=10**6):
    return "\n".join(prose(12, 1000 * seed + k, size) for k in range(n))


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    german = "\n".join("Über die größte Straße fährt früh der müde Bäcker mit süßen Brötchen nach Hause %s." % chr(97 + k) for k in range(12))
    shared = prose(80, 77_000, 10**6).replace("\n", " ")
    near = sentences(3).split(" ")
    near[20] = "edited"
    rows = [(1, sentences(1), "en"), (2, german, "de"), (3, sentences(3), "en"), (4, " ".join(near), "en"), (5, sentences(3), "en"), (6, "Home | News\nNo end\nclick here\n" * 10, "en"), (7, "12345 67890.\n" * 9, "en")]
    rows += [(8, sentences(8) + "\n" + shared + "\n" + sentences(18), "en"), (9, sentences(9) + "\n" + shared + "\n" + sentences(19), "en"), (None, sentences(20), "en"), (11, None, "en"), (12, "", "de")]
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    state, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = corpus_pipeline.cut(stage(spark, state, str(tmp_path)))
        assert state.columns == docs.columns
        kept[name] = sorted((r["doc_id"] or 0) for r in state.select("doc_id").collect())
    assert kept == {"quality_rules": [0, 1, 2, 3, 4, 5, 7, 8, 9], "language_id": [0, 1, 2, 3, 4, 5, 8, 9], "near_dedup": [0, 1, 2, 3, 8, 9], "passage_dedup": [0, 1, 2, 3, 8, 9]}
    texts = {r["doc_id"]: r["text"] for r in state.collect()}
    assert texts[8] == rows[7][1] and texts[9].split() == (sentences(9) + "\n" + sentences(19)).split() and texts[2] == german
    bins = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((i or 0, p) for b in bins for i, p in zip(b["doc_ids"], b["pieces"])) == [(i, 0) for i in (0, 1, 2, 3, 8, 9)]
    assert sum(b["used"] for b in bins) == sum(-(-len(t.encode()) // packing.TOKEN_BYTES) for t in texts.values()) and max(b["used"] for b in bins) <= packing.CAPACITY


def buckets(text):
    """The hashed n-grams of a text, one by one."""
    points = [32]
    for c in text or "":
        low = c.lower()[0]
        p = ord(low) if c.isalpha() and ord(c) < 0x500 else ord(c) if ord(c) >= 0x500 and not 0x2000 <= ord(c) < 0x2E80 else 32
        if p != 32 or points[-1] != 32:
            points.append(p)
    if points[-1] != 32:
        points.append(32)
    points = points[1:]
    out = []
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            part = points[i : i + n]
            if any(p != 32 for p in part):
                key = 0
                for p in part:
                    key = (key * 0x110000 + p) % 2**64
                out.append((key + (n << 61)) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - 16))
    return out


def test_naive_bayes_is_that_of_plain_python(spark):
    texts = ["The quick brown fox, 12 of them.", "le renard brun  saute", "der schnelle Fuchs läuft über die Straße", "the dog", "", None, "漢字 kana", "  spaces first", "der Hund"]
    labels = ["en", "fr", "de", "en", "en", "de", "en", "en", "de"]
    docs = table(spark, [(i, t, x) for i, (t, x) in enumerate(zip(texts, labels))]).repartition(3)
    counts = {x: Counter() for x in ("de", "en", "fr")}
    for t, x in zip(texts, labels):
        if t is not None:
            counts[x].update(buckets(t))
    rows = Counter(x for t, x in zip(texts, labels) if t is not None)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for i, t in enumerate(texts):
        mine = buckets(t)
        logs = {}
        for x, c in counts.items():
            total = sum(c.values()) + langid.SMOOTHING * langid.BUCKETS
            logs[x] = math.log(rows[x] / sum(rows.values())) + sum(math.log((c[b] + langid.SMOOTHING) / total) for b in mine)
        order = sorted(logs, key=lambda x: (-logs[x], x))
        lead = (logs[order[0]] - logs[order[1]]) / max(1, len(mine))
        assert (got[i]["lang"], got[i]["n_grams"]) == (order[0] if mine else "und", len(mine)), t
        assert not mine or (abs(got[i]["margin"] - lead) < 1e-4 and got[i]["accepted"] == (lead >= langid.MARGIN))


def test_toxic_log_odds_are_those_of_plain_python(spark):
    draw = np.random.default_rng(2)
    rows, known = [], []
    for i in range(80):
        words = ["w%d" % k for k in draw.integers(0, 40, 30)]
        if i % 4 == 0:
            for at in draw.choice(30, 4, replace=False):
                words[at] = ("vile", "rotten")[int(draw.integers(0, 2))]
        rows.append((i, " ".join(words), "en"))
        known.append((i, int(i % 4 == 0)))
    model = toxicity.train(table(spark, rows), spark.createDataFrame(known, "doc_id long, toxic int"))
    y, n = Counter(), Counter()
    for (_, t, _), (_, toxic) in zip(rows, known):
        (y if toxic else n).update(set(t.split()))
    y_all, n_all = (sum(v for k, v in c.items() if y[k] + n[k] > 1) for c in (y, n))
    want = []
    for k in y | n:
        if y[k] + n[k] > 1:
            a, whole = (y[k] + n[k]) * toxicity.PRIOR, (y_all + n_all) * toxicity.PRIOR
            odds = math.log((y[k] + a) / (y_all + whole - y[k] - a)) - math.log((n[k] + a) / (n_all + whole - n[k] - a))
            if odds >= toxicity.LEAST_ODDS and odds / math.sqrt(1 / (y[k] + a) + 1 / (n[k] + a)) >= toxicity.LEAST_Z:
                want.append(odds)
    assert len(want) >= 2 and np.allclose(sorted(model.scores), sorted(want))
    assert model.rate > 0
    found = {r["doc_id"] for r in toxicity.toxic_passages(table(spark, rows), None, model=model).collect()}
    assert found <= {i for i, x in known if x}

