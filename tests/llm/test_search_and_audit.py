"""Exact search, filter audit and ranked lexical search against brute force and DuckDB, with the cases that tables can hold."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tessera.llm import filter_audit, lexical, queries, vafile
from tessera.llm.topk import NAMED, UNNAMED, Best

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_filter_audit", "op13_lexical"])
def test_query_equals_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_rankings_keep_the_best_with_ties_by_id():
    rng = random.Random(3)
    best, pairs = Best(5, 4), []
    for _ in range(40):
        n = rng.randint(0, 30)
        q, s, i = ([rng.randrange(k) for _ in range(n)] for k in (5, 6, 1000))
        t = [rng.choice([NAMED, NAMED, UNNAMED]) for _ in range(n)]
        best.add(np.array(q, dtype=np.int64), np.array(s, dtype=np.int64), np.array(i, dtype=np.int64), np.array(t, dtype=np.int8))
        pairs += zip(q, s, t, i, strict=True)
    query, score, ids, named = best.held()
    for k in range(5):
        want = sorted((-s, t, i) for q, s, t, i in pairs if q == k)[:4]
        assert [(-s, 0 if m else 1, i) for q, s, i, m in zip(query, score, ids, named, strict=True) if q == k] == want


def plain_search(rows: list[tuple], k: int) -> list[tuple]:
    """rows of (id, integers or None), each a candidate and, if its id is divisible by 20, a query."""
    whole = [(i, v) for i, v in rows if v is not None]
    out = []
    for at, (i, v) in enumerate(whole):
        if i is None or i % 20:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for other, (j, w) in enumerate(whole) if other != at)
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def searched(spark, rows: list[tuple], k: int = 20) -> list[tuple]:
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, id long, v string")
    both = df.select(df.vec_id.alias("id"), vafile.as_integers().alias("v"))
    return sorted(map(tuple, vafile.search(both.where("id % 20 = 0"), both, k).collect()), key=repr)


def test_search_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vafile, "QUERY_TILE", 4)
    rng = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(300)]
    hot = [0.5, -0.25, 0.125, 0.0, 0.75, -0.5]
    vectors += [(1000 + i, hot) for i in range(70)]  # one vector of many rows, several of them queries
    vectors += [(40, vectors[40][1]), (40, hot), (None, hot), (None, None), (60, None), (80, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100, [float("nan")] * 6), (120, [float("inf")] * 6), (140, [0.3, 0.2]), (160, []), (-20, [0.0] * 6)]
    rows = [(i, v, None, 7, "clash") for i, v in vectors]
    integers = [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]) for i, v in vectors]
    for k in (3, 20):
        assert searched(spark, rows, k) == plain_search(integers, k)
    assert searched(spark, rows[:1]) == []
    assert searched(spark, []) == []


def test_search_takes_several_passes_and_reads_few_exact_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [[float(x) for x in v] for v in rng.normal(0, 0.125, (1200, 16))]
    rows = [(i, v, None, None, None) for i, v in enumerate(data)]
    whole = searched(spark, rows, 5)
    assert whole == plain_search([(i, [math.floor(64 * x) for x in v]) for i, v in enumerate(data)], 5)
    monkeypatch.setattr(vafile, "PASS_BYTES", 16 * 8 * 11)
    assert searched(spark, rows, 5) == whole
    exact = np.floor(64 * rng.normal(0, 0.125, (4096, 16))).astype(np.int64)
    marks, cells = vafile.cells_of(exact)
    low, high = vafile.bounds_of(marks, cells)
    assert (low <= exact).all() and (exact <= high).all()
    import pyarrow as pa

    row = vafile._packed([pa.array(range(4096), pa.int64())], [pa.array(exact.tolist(), pa.list_(pa.int64()))]).to_pylist()[0]
    best = Best(50, 6)
    read = vafile.Block(row).search(exact[:50], best)
    assert read < 0.25 * 50 * 4096
    assert (best.score == np.sort(exact[:50] @ exact.T, axis=1)[:, ::-1][:, :6]).all()


@pytest.mark.parametrize("size", [2**20, 2**29])
def test_search_of_large_components_is_exact(size):
    """Beyond 2^53 longs are multiplied."""
    import pyarrow as pa

    exact = np.random.default_rng(6).integers(-size, size, (200, 3))
    row = vafile._packed([pa.array(range(200), pa.int64())], [pa.array(exact.tolist(), pa.list_(pa.int64()))]).to_pylist()[0]
    best = Best(10, 5)
    vafile.Block(row).search(exact[:10], best)
    assert (best.score == np.sort(exact[:10] @ exact.T, axis=1)[:, ::-1][:, :5]).all()
    with pytest.raises(OverflowError):
        vafile.Block(row).search(np.full((1, 3), 2**40 * 2**20 // size * 2**10), best)


def plain_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    texts: dict[str, int] = {}
    for i, text, _ in docs:
        if i is not None:
            texts[text or ""] = min(i, texts.get(text or "", i))
    good, toxic = ({i for i, *values in labels if i is not None and values[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and texts[text] < i,
        }
        rows.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        table = {}
        for order in map("".join, permutations("ABCDE")):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for k, c in enumerate(order):
                lost, alive = [r for r in alive if r[1][c]], [r for r in alive if not r[1][c]]
                only = sum(r[1][c] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                table[order, k + 1] = [len(alive), len(lost), sum(r[1][c] for r in gone), only, sum(r[2] for r in lost), sum(r[3] for r in lost)]
                gone += lost
        for (order, k), counts in table.items():
            shapley = sum(table[o, o.index(order[k - 1]) + 1][1] for o in map("".join, permutations("ABCDE")))
            out.append((part, order, k, *counts, shapley))
    return sorted(out)


def test_audit_of_odd_rows(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([50, 220]))) + rng.choice(["", " ", "#", "|", " ABCDEF" * 30]) for _ in range(25)]
    texts += ["", None, " \t\n", "ÄÖ A", "x " * 5000, "one " * 199 + "two", "A" + "a" * 49, "A" + "a" * 48, "same", "same", "Same"]
    docs = [(rng.choice([None, *range(60)]), t, rng.choice(["p", "q", "", None])) for t in [*texts, *rng.choices(texts, k=50)]]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "1 AS n")
    given = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS part", "1 AS mask", "true AS good")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, filter_audit.audit(given, marks).select(names).collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), marks).count() == 0
    alone = filter_audit.audit(spark.createDataFrame([(1, "a", "p")], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(alone) == 600 and {r["shapley"] for r in alone if r["filter_order"][r["step"] - 1] == "A"} == {120}


def plain_ranking(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    def own(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low))

    counts = [(i, own(t)) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(own(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in terms.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_ranking_of_odd_rows(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [*"abcdefgh", "É", "é", "ñandú", "x1", "日本", "Zed", "zed", "a_b", "tab\tbed", " hard", "é"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(120)] + [None, "", "...", "a " * 50_000, "\x00a\x7f", "-a-"]
    docs = [(rng.choice([None, *range(90)]), t) for t in [*texts, *texts[:40]]]
    items = [(rng.choice([None, *range(12)]), " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for _ in range(25)] + [(99, None), (98, "?"), (97, "nowhere")]
    given = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS slots", "2 AS item")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS term", "3 AS n")
    want = plain_ranking(docs, items, 10)
    ranking = lambda: sorted(map(tuple, lexical.ranked(given, asked).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert ranking() == want
    # small tiles and many passes change nothing; tiles end where sums could reach a low bound
    monkeypatch.setattr(lexical, "TILE_TERMS", 3)
    monkeypatch.setattr(lexical, "TILE_ITEMS", 4)
    monkeypatch.setattr(lexical, "TILE_DOCS", 7)
    monkeypatch.setattr(lexical, "PASS_TERMS", 20)
    assert ranking() == want
    assert lexical.ranked(given, asked.limit(0)).count() == 0 == lexical.ranked(given.limit(0), asked).count()


def test_sums_of_a_tile_stay_below_the_bound(monkeypatch):
    monkeypatch.setattr(lexical, "EXACT", 10**10)
    postings = [(0, 0, 7), (0, 1, 25), (1, 1, 2), (1, 2, 1), (0, 3, 1)]
    weights = [1000, 900, 400, 0]
    tiles = list(lexical.item_tiles(postings, weights, 2))
    total = np.zeros((4, 2))
    for first, slots, matrix in tiles:
        assert first == 0 and (matrix.sum(axis=0) * lexical.IMPACT < 10**10).all()
        total[slots] += matrix[:, :2]
    assert total.tolist() == [[7000, 0], [22500, 1800], [0, 400], [0, 0]] and len(tiles) > 3
