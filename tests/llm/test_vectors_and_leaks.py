"""Hard negatives, decontamination and whitening against plain versions, SQL, and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from factweave.llm import op11_negatives as op11
from factweave.llm import op12_decontaminate as op12
from factweave.llm import op13_whitening as op13

INF, NAN = float("inf"), float("nan")


def same_rows(df, sql, tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    rows = con.sql(sql)
    return sorted(map(repr, map(tuple, df.select(*rows.columns).collect()))) == sorted(map(repr, rows.fetchall()))


# op11
def plain_negatives(rows, every=100, positives=5, negatives=10):
    """rows: (id, label, x)."""
    out = []
    for a_id, a_label, a in rows:
        if a_id % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, x, strict=True)), i, label) for i, label, x in rows if i != a_id)
        for s, i, _ in [t for t in scored if t[2] == a_label][:positives]:
            inside = [t for t in scored if t[2] != a_label and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(a_id, i, n + 1, t[1], -s, -t[0]) for n, t in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("d", "anchors", "block"), [(5, 128, 4096), (70, 3, 16), (300, 4, 50)])
def test_negatives_like_plain(spark, monkeypatch, d, anchors, block):
    """Many blocks and chunks, hot label, ties, negative labels."""
    monkeypatch.setattr(op11, "ANCHORS", anchors)
    monkeypatch.setattr(op11, "ROWS", block)
    rng = random.Random(d)
    common = [rng.uniform(-1, 1) for _ in range(d)]
    rows = [(i, rng.choice([1, 1, 1, 2, -3]), common if rng.random() < 0.2 else [c + rng.uniform(-1, 1) for c in common]) for i in range(0, 600, 3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    x = [(r.vec_id, r.label, [math.floor(256 * c) for c in r.embedding]) for r in df.collect()]
    got = op11.hard_negatives(df, "vec_id % 25 = 0").collect()
    want = plain_negatives(x, 25)
    assert sorted(map(tuple, got)) == want and len(want) > 50


def test_negatives_of_odd_rows(spark, tmp_path):
    v = [1.0, 0.5, 0.25]
    rows = [
        (0, 1, v, 1), (1, 1, v, 2), (1, 1, v, 2), (2, 2, [0.5, 0.5, 0.5], 3), (3, None, v, 4), (None, 1, v, 5), (4, 2, None, 6), (5, 2, [1.0, None, 0.0], 7), (6, 2, [1.0, NAN, 0.0], 8), (8, 2, [1.0, INF, 0.0], 9), (9, 2, [1.0], 10), (10, 2, [], 11),
        (100, 3, [-1.0, -1.0, -1.0], 12), (101, 3, [1.0, 1.0, 1.0], 13), (102, 2, [0.25, 0.5, 0.25], 14), (7, 9, [0.5, 0.25, 0.0], 15), (200, 5, [-0.0, 0.0, 0.0], 16), (201, 5, [0.0, 0.0, 0.0], 17),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, rank int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11.op11_negatives(spark, str(tmp_path))
    tables = {"embeddings": f"{tmp_path}/embeddings.parquet/*.parquet"}
    assert {r.anchor_id for r in got.collect()} == {0, 200}
    # SQL numbers rows that repeat an id within one group; all but them are held against it.
    spark.read.parquet(f"{tmp_path}/embeddings.parquet").dropDuplicates(["vec_id"]).coalesce(1).write.parquet(f"{tmp_path}/one/embeddings.parquet")
    assert same_rows(op11.op11_negatives(spark, f"{tmp_path}/one"), op11.SQL["op11_negatives"], {"embeddings": f"{tmp_path}/one/embeddings.parquet/*.parquet"}), tables
    assert op11.hard_negatives(df.where("false")).count() == 0
    huge = spark.createDataFrame([(0, 1, [1e30, 1e30]), (1, 1, [1e30, 1e30]), (2, 2, [5e29, 0.0])], "vec_id long, label int, embedding array<double>")
    assert op11.hard_negatives(huge).count() == 1


def test_negatives_like_sql(spark, small):
    assert same_rows(op11.op11_negatives(spark, small), op11.SQL["op11_negatives"], {"embeddings": f"{small}/embeddings.parquet"})


# op12
def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(docs, items):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "One two, THREE four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, "a a a a a a a a a a a a"), (10, "One two, THREE four five six seven eight nine ten eleven twelve"), (None, "no id here"), (4, None), (5, ""), (6, "--"), (7, "é漢 ß1")]
DOCS = [
    (1, "x one two three four five six seven eight nine ten y"), (1, "x one two three four five six seven eight nine ten y"), (2, None), (3, ""), (4, " .,\n"), (5, "a " * 30), (None, "short ITEM, no-id; here"), (6, "short x item"), (7, "one two three four five six seven eight nine"),
    (8, "é漢-ß1 and é漢\nß1 é漢"), (9, "zwei " * 5000 + "short item " * 3 + "two three four five six seven eight nine ten eleven twelve"), (11, "a " * 9 + "b " + "a " * 10), (12, "\x00short\x00item\x7f"),
]


@pytest.mark.parametrize(("shard", "part"), [(1 << 20, 1 << 20), (40, 1 << 20), (1 << 20, 60)])
def test_leaks_like_plain(spark, tmp_path, monkeypatch, shard, part):
    """One shard, many shards, and a benchmark of several parts; repeated rows, nulls, long texts, clashing columns."""
    monkeypatch.setattr(op12, "SHARD", shard)
    monkeypatch.setattr(op12, "PART_BYTES", part)
    docs = spark.createDataFrame([(*d, 1, "k") for d in DOCS], "doc_id long, text string, n_words int, kept string")
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, spans string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bench.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op12.op12_decontaminate(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_leaks(DOCS, ITEMS)))
    assert same_rows(got, op12.SQL["op12_decontaminate"], {t: f"{tmp_path}/{t}.parquet/*.parquet" for t in ("documents", "benchmark")})
    clean = op12.without_passages(docs, bench)
    assert clean.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in clean.collect())
    assert texts[(1, "x  y")] == 2 and texts[(2, None)] == 1 and texts[(None, ", ")] + texts[(None, "")] == 1 and texts[(6, "short x item")] == 1
    assert op12.digest(op12.located(docs.where("false"), bench)).count() == 0
    assert op12.digest(op12.located(docs, bench.where("false"))).where("contaminated").count() == 0


def test_leaks_like_sql(spark, small):
    assert same_rows(op12.op12_decontaminate(spark, small), op12.SQL["op12_decontaminate"], {t: f"{small}/{t}.parquet" for t in ("documents", "benchmark")})


def test_words_do_not_depend_on_pieces(monkeypatch):
    data = "Ab é漢 c9-d  \n e".encode() * 50
    whole = [w for part in op12.words(data) for w in part]
    for piece in (1, 2, 7):
        monkeypatch.setattr(op12, "PIECE", piece)
        assert [w for part in op12.words(data) for w in part] == whole


@pytest.mark.parametrize(("symbols", "n"), [(1, 50), (2, 300), (5, 400), (3000, 500)])
def test_index_finds_every_occurrence(symbols, n):
    rng = np.random.default_rng(symbols)
    s = rng.integers(0, symbols + 1, n)
    s[n // 2 : n // 2 + n // 8] = s[: n // 8]  # a long repeat
    s = np.r_[s, 0].astype(np.int64)
    sa = op12.suffix_array(s)
    keys = [[(x, 0) if x else (-1, p) for p, x in enumerate(s[i:].tolist(), i)] for i in range(len(s))]
    ends = [next(k for k, x in enumerate(key) if x[0] < 0) + 1 for key in keys]
    want = sorted(range(len(s)), key=lambda i: keys[i][: ends[i]])
    assert sa.tolist() == want
    index = op12.Index(s, symbols)
    for length in (1, 2, 5):
        patterns = {tuple(s[i : i + length].tolist()) for i in range(len(s) - length)} | {tuple(rng.integers(1, symbols + 1, length).tolist())}
        for p in (p for p in patterns if 0 not in p):
            low, high = index.search(np.array([p[::-1]]), np.array([length]))
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [i for i in range(len(s) - length + 1) if tuple(s[i : i + length].tolist()) == p]


# op13
def plain_whitening(rows, k=4):
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows}
    fit = np.array(sorted(set(x.values())), dtype=float)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v.T[::-1]
    return {(i, c + 1): (n, int(sum((n * a - int(b)) ** 2 for a, b in zip(t, s, strict=True))), abs(float((np.array(t) - s / n) @ v[c] / math.sqrt(e[c]))), e[c] / e.sum()) for i, t in x.items() for c in range(min(k, len(s)))}


@pytest.mark.parametrize(("d", "tile"), [(3, 64), (6, 64), (10, 4)])
def test_whitening_like_plain(spark, monkeypatch, d, tile):
    monkeypatch.setattr(op13, "TILE", tile)
    rng = random.Random(d)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(d)]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # copies count once
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plain_whitening([(r.vec_id, list(r.embedding)) for r in df.collect()])
    got = op13.whitened(df).collect()
    assert len(got) == len(want)
    for r in got:
        n, deviation, w, share = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == (n, deviation) and math.isclose(abs(r.whitened), w, rel_tol=1e-7, abs_tol=1e-9) and math.isclose(r.explained, share, rel_tol=1e-9) and r.identity_error < 1e-9
    assert all(len({math.copysign(1, r.whitened) for r in got if r.vec_id in (0, 1000) and r.component == c}) == 1 for c in (1, 2, 3))


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, n string"
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [0.0, -0.0], "b"), (2, [1.0, None], "c"), (3, [NAN, 1.0], "d"), (4, [1.0, INF], "e"), (5, None, "f"), (6, [], "g"), (7, [1.0], "h"), (8, [1.0, 2.0, 3.0], "i"), (9, [3.0, 6.0], "j")]
    got = op13.whitened(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 2, 9: 2} and {r.n for r in got} == {3}
    assert all((r.whitened is None) == (r.component == 2) for r in got) and max(r.identity_error for r in got) < 1e-9  # all on one line
    one = op13.whitened(spark.createDataFrame(rows[:2], schema)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 and r.identity_error is None for r in one)
    huge = op13.whitened(spark.createDataFrame([(1, [1e200, 1.0], ""), (2, [1.0, 2.0], ""), (3, [-1e200, 7.0], "")], schema)).collect()
    assert len(huge) == 6 and any(r.deviation is None for r in huge)
    assert op13.whitened(spark.createDataFrame([], schema)).count() == 0 and op13.whitened(spark.createDataFrame([(5, None, "f"), (6, [], "g")], schema)).count() == 0
