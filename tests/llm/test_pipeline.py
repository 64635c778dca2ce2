"""The corpus pipeline on a small table, against brute force."""

import random
from collections import Counter

import corpus_pipeline
from wayloom.llm.common import materialize
from wayloom.llm.shingles import shingle_set


def rows_of():
    """Single-line texts: under ids of their own, one id and null; near copies, copies, and texts that the quality rules reject."""
    random.seed(11)
    words, rows = [f"word{i}" for i in range(500)], []
    for i in range(30):
        t = [random.choice(words) for _ in range(90)]
        rows.append(((i, 900, None)[i % 3], " ".join(t)))
        if i % 4 == 0:
            t[5] = "other"
            rows.append(((100 + i, None, 900)[i % 3], " ".join(t)))
    rows += [rows[0], rows[3], (None, rows[6][1]), (901, rows[2][1])]
    return rows + [(902, ""), (903, None), (None, None), (None, " \n "), (904, "few words"), (905, "! # $ " * 60)]


def test_stages(spark, tmp_path):
    rows = rows_of()
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    good = [i for i, (_, t) in enumerate(rows) if t and len(t.split()) >= 50 and "#" not in t]
    group = {i: i for i in good}
    for i in good:
        for j in good:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = {k: group[j] if g == group[i] else g for k, g in group.items()}
    least = lambda d: -(2**63) if d is None else d
    want = Counter(min((rows[k][0] for k in good if group[k] == g), key=least) for g in set(group.values()))
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, str(tmp_path)))
    kept = docs.collect()
    assert Counter(r.doc_id for r in kept) == want
    assert sorted(group[next(k for k in good if rows[k] == (r.doc_id, r.text))] for r in kept) == sorted(set(group.values()))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= set(want) and all(r.round_trip for r in out)
