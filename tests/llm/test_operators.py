"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and further columns."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wayloom.llm import chunk_fingerprint, context_mixing, jaccard_join, line_dedup, oracles, pii_tagger, quality_rules, queries, sentencepiece_codec, source_mix, suffix_dedup, url_rules
from wayloom.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def corpus():
    random.seed(7)
    words = [f"w{i}" for i in range(300)]
    line = lambda n: " ".join(random.choice(words) for _ in range(n))
    base, shared = [line(30) for _ in range(5)], line(60)
    texts = ["\n".join(base), "\n".join(base), "\n".join([*base[:4], line(30)]), shared, f"{line(10)}\n{shared}\n{line(9)}", None, "", "x", "x", line(3000), f"a@b.co {line(60)}", "é" * 500, " \n ", "\n".join(["a b c"] * 40)]
    texts += [line(80) for _ in range(12)]
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "null id", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(spark, df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


EVERY = {
    "op1": sentencepiece_codec.encode, "op2": context_mixing.score, "op3": pii_tagger.report, "op4": line_dedup.dedup_lines, "op6": suffix_dedup.remove_repeats,
    "op7": source_mix.mix, "op8": jaccard_join.join, "op9": chunk_fingerprint.fingerprint_edits, "op10": quality_rules.judge,
}


@pytest.mark.parametrize("name", EVERY)
def test_one_row_a_document_and_none_of_none(spark, docs, none, name):
    assert ids(spark, EVERY[name](docs)) == Counter(r[0] for r in corpus())
    assert EVERY[name](none).count() == 0


def test_repeats(docs):
    rows = corpus()
    count = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        count.update(raw[i : i + 200] for i in range(len(raw) - 199))
    for r in suffix_dedup.remove_repeats(docs).collect():
        raw = (next(x[1] for x in rows if x[0] == r.doc_id) or "").encode()
        gone = set()
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        rest = bytes(c for i, c in enumerate(raw) if i not in gone)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), len(gone), hashlib.sha256(rest).hexdigest())


def test_components_with_small_limits(spark, monkeypatch):
    for k, v in (("BIG", 30), ("CELL", 8), ("LEAF", 10)):
        monkeypatch.setattr(jaccard_join, k, v)
    random.seed(2)
    words = [f"w{i}" for i in range(200)]
    pool = [[random.choice(words) for _ in range(70)]]
    for _ in range(90):
        t = list(random.choice(pool))
        for _ in range(random.randint(0, 3)):
            t[random.randrange(len(t))] = random.choice(words)
        pool.append(t)
    texts = [" ".join(t) for t in pool] + ["", None, "a b", "a b"]
    sets = [set(shingle_set(t, 4).tolist()) for t in texts]
    least = list(range(len(texts)))
    for _ in range(20):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    least[i] = min(least[i], least[j])
    got = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), least[i]) for i, s in enumerate(sets)}


def test_large_family_of_unlinked_texts(spark, monkeypatch):
    """Texts that only share a passage are not copied to the cells of all pivots; links among them are found, with byte limits too."""
    random.seed(8)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*(f"w{i}x{j}" for j in range(30)), *passage]) for i in range(300)]
    for i in range(40):
        near = texts[i].split()
        near[0] = "other"
        texts.append(" ".join(near))
    for limits in ({"BIG": 30, "CELL": 8, "LEAF": 10}, {"BYTES": 4000, "LEAF": 10}):
        made = []

        def counted(df, *more, made=made, write=jaccard_join.materialize):
            out = write(df, *more)
            if {"f", "p"} <= set(df.columns):
                made.append(out.count())
            return out

        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(jaccard_join, k, v)
            m.setattr(jaccard_join, "materialize", counted)
            got = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: i - 300 if i >= 300 else i for i in range(340)}
        assert sum(made) <= 4 * len(texts)


def shared_ids():
    """Many texts under one id and under null, with near copies under other ids, copies, and empty texts."""
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        t = [random.choice(words) for _ in range(80)]
        rows.append(((7, None)[i % 2], " ".join(t)))
        if i % 3 == 0:
            t[random.randrange(80)] = "other"
            rows.append(((100 + i, 7, None)[i % 9 // 3], " ".join(t)))
    return [*rows, rows[0], (7, rows[0][1].upper()), (500, rows[1][1]), (7, ""), (7, ""), (None, None), (None, " "), (600, "a b"), (None, "a b"), (700, "c d"), (8, None)]


def linked(rows, n, pct):
    """For each row the numbers of the rows that links reach from it, itself included."""
    sets = [set(shingle_set(t, n).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= pct * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, [[k for k, h in enumerate(group) if h == g] for g in group]


def test_texts_under_one_id(spark):
    rows = shared_ids()
    sets, groups = linked(rows, 4, 85)
    doc = lambda i: jaccard_join.NO_ID if rows[i][0] is None else rows[i][0]
    real = lambda d: None if d == jaccard_join.NO_ID else d
    want = Counter((rows[i][0], len(s), real(min(map(doc, groups[i])))) for i, s in enumerate(sets))
    for parts in (1, 5):
        got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 4, 85).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_keep_one_of_each_group(spark):
    rows = shared_ids()
    sets, groups = linked(rows, 4, 85)
    doc = lambda i: jaccard_join.NO_ID if rows[i][0] is None else rows[i][0]
    # Of a group the least id stays; which of its texts under that id is open.
    clean = {tuple(g) for s, g in zip(sets, groups, strict=True) if s}
    for parts in (1, 5):
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row long, doc_id long, text string").repartition(parts)
        got = jaccard_join.keep_one(frame, 4, 85)
        assert got.columns == frame.columns
        kept = sorted(r.row for r in got.collect())
        assert [k for k in kept if not sets[k]] == [k for k, s in enumerate(sets) if not s]
        assert sorted(tuple(groups[k]) for k in kept if sets[k]) == sorted(clean)
        assert all(doc(k) == min(map(doc, groups[k])) for k in kept)


def test_mix(docs):
    rows = source_mix.mix(docs).collect()
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        t = by.setdefault(r.source, [r.target, 0, 0, r.source_size])
        t[1], t[2] = t[1] + r.taken, t[2] + r.size
    for target, taken, size, source_size in by.values():
        assert size == source_size and abs(target - taken) <= 3000


@pytest.mark.parametrize("ids", [(1, 2), (None, None)])
def test_mix_of_repeated_rows(spark, ids):
    rows = [(ids[k % 2], f"a b {'c' if k % 2 else 'd'}", f"s{k % 2}") for k in range(2000)]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(got) == 2000
    for s in ("s0", "s1"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 and {r.taken for r in own} <= {0, 3, 6, 9}


def test_lines_against_all_pairs(spark):
    random.seed(9)
    line = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    pool = [line(random.choice([3, 5, 20, 25, 30, 60]), k) for k in range(12)]
    w1, w2, y = line(25, 50), line(25, 51), line(20, 52)
    texts = ["\n".join([w1, w2]), "\n".join([w1, w2, y]), "\n".join(["x", w1, w2, y])]
    texts += ["\n".join(random.choice([*pool, ""]) for _ in range(random.randint(1, 14))) for _ in range(25)] + ["a b c\n" * 60, None, "", texts[1]]
    rows = [*enumerate(texts), (None, texts[1]), (4, texts[4])]
    docs = sorted({(-(2**63) if d is None else d, t) for d, t in rows if t is not None})
    cut = [[x for x in t.split("\n") if x.split()] for _, t in docs]
    gone = [set() for _ in docs]
    for i in range(len(docs)):
        for j in range(i + 1):
            for shift in range(-len(cut[j]) + 1, len(cut[i])):
                if i == j and shift <= 0:
                    continue
                run = []
                for p in range(max(0, shift), len(cut[i]) + 1):
                    if p < len(cut[i]) and 0 <= p - shift < len(cut[j]) and cut[i][p] == cut[j][p - shift]:
                        run.append(p)
                        continue
                    if sum(len(cut[i][q].split()) for q in run) >= 50:
                        gone[i].update(run)
                    run = []
    want = Counter()
    for d, t in rows:
        i = docs.index((-(2**63) if d is None else d, t)) if t is not None else None
        want[(d, 0, 0, None) if i is None else (d, len(cut[i]), len(gone[i]), tuple(x for p, x in enumerate(cut[i]) if p not in gone[i]))] += 1
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    shown = lambda t: None if t is None else tuple(x for x in t.split("\n") if x.split())
    assert Counter((r.doc_id, r.n_lines, r.n_removed, shown(r.text)) for r in got) == want
    assert next(r for r in got if r.doc_id == 2).n_removed == 3


def test_baseline_score(docs):
    import math
    import zlib

    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update([*(r[1] or "").encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    for r in context_mixing.score(docs).collect():
        t = [*(next(x[1] for x in rows if x[0] == r.doc_id) or "").encode().lower().split(), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(x in count for x in t), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) < 1e-6
        assert r.score < 0


def test_edits(docs):
    rows = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "") for r in corpus()), reverse=True)
    want = Counter()
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        e = t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]
        want[None if d == -(2**63) else d, hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in chunk_fingerprint.fingerprint_edits(docs, 4).collect()) == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = con.sql(queries.oracle_sql()[name]).df()
    mine = queries.queries()[name](spark, sf).toPandas()
    cols = sorted(sql.columns)
    assert sorted(map(str, mine[cols].values.tolist())) == sorted(map(str, sql[cols].values.tolist()))


def test_urls(spark):
    urls = [*[f"http://a{i}.example.org/buy/{i}" for i in range(4)], *[f"http://x{i}.net/es/buy/{i}" for i in range(40)], *[f"http://y{i}.com/news/{i}" for i in range(40)], "http://www.EXAMPLE.com/en/?q=1", "http://b.example.com/en/x", None, "no host", "http://z.example.org/news/"]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].verdict for i in (0, 4, 44, 84, 85, 86, 87, 88)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert (got[84].host, got[84].path, got[84].rule) == ("www.example.com", "/en/", "www.example.com/en/")
    # A mined rule fits by its tokens.
    assert got[0].mined and set(got[0].mined.split()) <= {"p:buy", "p:0", "h:a0", "h:example", "h:org"}


def test_rules_of_labels_that_say_nothing(spark):
    # Every label is as a host rule says; p:buy is the one token that blocked and allowed URLs do not share.
    urls = [f"http://{h}{i % 3}.example.{t}/{p}/{i}" for t, p in (("net", "fr"), ("com", "en"), ("com", "de")) for h in "ab" for i in range(20)]
    urls += [f"http://a{i % 3}.example.net/es/buy/{i}" for i in range(60)] + ["http://once.example.net/es/7"] * 2
    ask = {"http://a0.example.net/de/1": None, "http://b1.example.org/en/2": None, "http://c.example.org/fr/3": None, "http://once.example.org/4": None, "http://c.example.org/buy/5": "p:buy"}
    got = url_rules.judge(spark.createDataFrame(list(enumerate([*urls, *ask])), "page_id long, url string")).where(F.col("page_id") >= len(urls))
    assert {r.url: (r.mined, r.verdict) for r in got.collect()} == {u: (m, "block" if m else "allow") for u, m in ask.items()}
    few = spark.createDataFrame(list(enumerate(["http://a.net/es/buy", "http://b.org/buy"])), "page_id long, url string")
    assert [r.verdict for r in url_rules.judge(few).orderBy("page_id").collect()] == ["block", "allow"]


def test_urls_of_many_parts_and_odd_rows(spark, none):
    long = "http://a.net/es/" + "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(1, long, "x")] * 30 + [(i, f"{long}/{chr(97 + i)}", None) for i in range(2, 12)] + [(None, None, None), (20, "", "y"), (21, "://", "y"), (22, "http://", "y"), (23, "http://q.org/" + "a/" * 50_000, "z")]
    rows += [(100 + i, f"http://n{chr(97 + i % 20)}{chr(97 + i // 20)}.com/x", None) for i in range(60)] + [(24, "http://other.org/partba/partca", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_rules.judge(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    by = {r.page_id: r for r in got}
    assert by[1].verdict == "block" and by[1].rule == "net/es/" and by[1].host == "a.net"
    assert [(by[i].host, by[i].path, by[i].verdict) for i in (None, 20, 21, 22)] == [("", "", "allow")] * 4
    assert by[24].verdict == "block" and by[23].verdict == "allow"
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    # Every mined verdict against the rule's own tokens.
    for r in got:
        assert r.mined is None or set(r.mined.split()) <= {f"p:{x}" for x in r.path.split("/")} | {f"h:{x}" for x in r.host.split(".")}


def test_url_rules_of_many_tokens(spark, monkeypatch):
    """Rules of all tokens of long URLs, with the limit for listing passed or not; the decisive pair is seldom blocked alone."""
    rng, rows = random.Random(3), []
    for i in range(160):
        both = i % 4 == 0
        some = [f"a{j}" for j in range(14) if rng.random() < 0.25]
        rows.append((i, sorted({*some, *(["x", "y"] if both else [rng.choice("xy")])}), both))
    frame = spark.createDataFrame(rows, "id long, tokens array<string>, blocked boolean")
    monkeypatch.setattr(url_rules, "ITEMS", 30)
    want = {(r.rule, round(r.confidence, 9), round(r.support, 9)) for r in url_rules.mine(frame)[0].collect()}
    monkeypatch.setattr(url_rules, "ITEMS", 1)
    got = {(r.rule, round(r.confidence, 9), round(r.support, 9)) for r in url_rules.mine(frame)[0].collect()}
    assert got == want and ("x y", 1.0, 0.25) in got
