"""Ranks, batches and masks against plain Python, with cells far smaller than a group."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import masking, packing, scores


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)


def fractional(values: list) -> dict:
    order = sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
    places = defaultdict(list)
    for place, v in enumerate(order, start=1):
        places[v].append(place)
    return {v: sum(p) / len(p) for v, p in places.items()}


@pytest.mark.parametrize("kind", ["double", "string", "long"])
def test_ranks_of_ties_over_many_cells(spark, small_cells, kind):
    rng = random.Random(kind)
    make = {"double": lambda: rng.choice([1.5, 1.5, rng.random()]), "string": lambda: rng.choice(["same", "", "é", "samf", f"same{rng.randint(0, 30)}"]), "long": lambda: rng.choice([3, -(2**40), rng.randint(-50, 50)])}[kind]
    rows = [(i, rng.choice("abb"), rng.choice([None, make(), make(), make()])) for i in range(300)]
    df = spark.createDataFrame(rows, f"id int, g string, v {kind}")
    whole = fractional([v for _, _, v in rows])
    assert {r["id"]: r["v_rank"] for r in scores.average_ranks(df, [], "v").collect()} == {i: whole[v] for i, _, v in rows}
    each = {g: fractional([v for _, h, v in rows if h == g]) for g in "ab"}
    assert {r["id"]: r["v_rank"] for r in scores.average_ranks(df, ["g"], "v").collect()} == {i: each[g][v] for i, g, v in rows}
    assert scores.average_ranks(df.limit(0), ["g"], "v").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_batches_hold_no_cluster_twice(spark, small_cells, seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 40, 200])
    clusters = [rng.choice([0, 0, 0, *range(12)]) if seed % 2 else rng.randrange(60) for _ in range(n)]
    size = rng.choice([1, 3, 5])
    df = spark.createDataFrame(list(enumerate(clusters)), "id int, c int")
    got = packing.distinct_cluster_batches(df, "c", "id", size).collect()
    batches = defaultdict(list)
    for r in got:
        batches[r["batch"]].append((r["slot"], r["c"], r["id"]))
    assert all(sorted(s for s, _, _ in b) == list(range(size)) and len({c for _, c, _ in b}) == size for b in batches.values())
    assert len({r["id"] for r in got}) == len(got)
    # as many as a greedy draw from the largest clusters can fill, which is the most there can be
    left, most = Counter(clusters), 0
    while sum(c > 0 for c in left.values()) >= size:
        for c, _ in left.most_common(size):
            left[c] -= 1
        most += 1
    assert len(batches) == most
    rest = packing.distinct_cluster_batches(df, "c", "id", size, full=False).collect()
    assert sorted(r["id"] for r in rest) == list(range(n))
    assert all(len(b) == len(set(b)) <= size for b in (lambda d: [d[k].append(c) or d[k] for k, c in ((r["batch"], r["c"]) for r in rest)])(defaultdict(list)))


def test_masks_keep_their_shares(spark):
    rng = random.Random(3)
    rows = [(w, [rng.randrange(100) for _ in range(200)]) for w in range(60)]
    own = masking.SpanMasker(vocabulary=100, mask_id=4, special=10, random_share=0.2, kept_share=0.3, max_span=3)
    df = spark.createDataFrame(rows, "w long, ids array<int>")
    draw = lambda seed, n: {r["w"]: r["m"] for r in df.repartition(n).select("w", own.masked(F.col("ids"), F.col("w"), 0.15, seed).alias("m")).collect()}
    first, again, other = draw("a", 1), draw("a", 5), draw("b", 2)
    assert first == again and first != other
    kinds: Counter = Counter()
    for w, ids in rows:
        m = first[w]
        hit = [i for i in range(200) if m["labels"][i] != masking.IGNORED]
        # 30 positions and what the last span has beyond
        assert 30 <= len(hit) <= 32
        for i in range(200):
            if i not in set(hit):
                assert m["inputs"][i] == ids[i]
                continue
            assert ids[i] >= 10 and m["labels"][i] == ids[i]
            kinds["mask" if m["inputs"][i] == 4 else "kept" if m["inputs"][i] == ids[i] else "random"] += 1
            assert m["inputs"][i] == 4 or m["inputs"][i] >= 10
    total = sum(kinds.values())
    assert abs(kinds["mask"] / total - 0.5) < 0.06 and abs(kinds["random"] / total - 0.2) < 0.05
    edge = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, None), (3, [50])], "w long, ids array<int>")
    got = {r["w"]: r["m"] for r in edge.select("w", own.masked(F.col("ids"), F.col("w"), 0.15).alias("m")).collect()}
    # all protected: nothing is masked; one position: it is
    assert list(got[0]["inputs"]) == [1, 2, 3] and set(got[0]["labels"]) == {masking.IGNORED}
    assert got[1] is None and got[2] is None and list(got[3]["labels"]) == [50]
    for wrong in ({"max_span": 0}, {"special": 100}, {"random_share": 0.8}):
        with pytest.raises(ValueError):
            masking.SpanMasker(**({"vocabulary": 100, "mask_id": 4, "special": 10, "random_share": 0.2, "kept_share": 0.3, "max_span": 3} | wrong))


def test_whole_windows_of_a_stream(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(10)], "at long, id long").repartition(3)
    assert sorted((r["window"], list(r["ids"])) for r in masking.windows(df, "at", "id", 4).collect()) == [(0, [0, 10, 20, 30]), (1, [40, 50, 60, 70])]


def greedy(rows):
    lefts, rights, kept = set(), set(), set()
    for seq, a, b in sorted(rows):
        if a not in lefts and b not in rights:
            kept.add((seq, a, b))
            lefts.add(a)
            rights.add(b)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_rows_that_stay_on_either_side(spark, seed):
    from tessera.operators import dedup

    rng = random.Random(seed)
    n = [0, 30, 120, 300][seed]
    rows = [(rng.randint(0, 60 * n), rng.choice([0, 0, rng.randint(0, 40)]), rng.randint(0, [5, 40, 40, 90][seed])) for _ in range(n)]
    df = spark.createDataFrame(rows, "seq long, a long, b long")
    assert {(r["seq"], r["a"], r["b"]) for r in dedup.either_side_first(df, "a", "b", "seq").collect()} == greedy(set(rows))


def test_a_long_chain_is_decided_in_one_round(spark):
    from tessera.operators import dedup

    rows = [(i, (i + 1) // 2, i // 2) for i in range(3_001)]
    rng = random.Random(5)
    other = [(10_000 - abs(k), 5_000 + (k + 1) // 2, 5_000 + k // 2) for k in range(-40, 40)]
    df = spark.createDataFrame(rng.sample(rows + other, len(rows) + len(other)), "seq long, a long, b long")
    got = {(r["seq"], r["a"], r["b"]) for r in dedup.either_side_first(df, "a", "b", "seq", max_rounds=3).collect()}
    assert got == greedy(rows + other) and len([r for r in got if r[0] <= 3_000]) == 1_501


def test_words_of_one_beginning_are_numbered_in_many_cells(spark, small_cells, monkeypatch):
    from tessera.plans import whole

    kept = {}
    monkeypatch.setattr(packing, "written", lambda df, name, own=packing.written: kept.setdefault(name, own(df, name)))
    words = sorted({f"zusammen{'abc'[i % 3]}{'é' * (i % 5)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)}, key=str.encode)
    rows = spark.createDataFrame([(" ".join(words),), (" ".join(words[::2]),)], "text string")
    assert {r["word"]: r["new_id"] for r in whole.vocabulary_ids(rows).collect()} == {w: i for i, w in enumerate(words)}
    assert max(r["count"] for r in kept["cells"].groupBy("_cell").count().collect()) <= len(words) // 5
