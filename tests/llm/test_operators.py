"""The operators on small tables against brute force: nulls, blanks, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import decontam, fingerprint, html_crf, langid, neardup, packing, pii, quality, sharding, token_count
from tessera.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def make_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, nulls, blanks and one long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        draw = rng.random()
        if rows and draw < 0.2:
            text = rng.choice(rows)[1]
        elif rows and draw < 0.5:
            own = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(max(1, len(own) // 40)):
                own[rng.randrange(len(own))] = "edited"
            text = " ".join(own)
        else:
            text = "\n".join(" ".join(words(rng, rng.randint(1, 30))) for _ in range(rng.randint(1, 8)))
        rows.append((i * 3, text, rng.choice(["aa", "bb", None]), f"s{i % 3}", len(text)))
    rows += [(500, None, None, None, None), (501, "", "aa", "s", 0), (502, " \n\t ", "aa", "s", 4), (503, "one", "bb", "s", 3), (504, "ONE", "bb", "s", 3)]
    rows.append((505, " ".join(words(rng, 30_000)), "aa", "s", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_rows(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


CLASHES = """node key group cell bucket score pos stretch gram row least digest comp hashes sketch keys members shares bundle
    pieces place slot shard size tokens pii lang_pred _sub _rank _n _before _row _id _k0 _text _stats _predicted _lang _score _fit
    _kept _flagged _pii item_id words grams df weight sure part of s n own edited next version terms quality label""".split()


def clashing(docs):
    """Columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({k: F.lit(1) for k in CLASHES})


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = dict(zip([i for i, _ in rows], neardup.brute_force(rows, size), strict=True))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(clashing(docs), words=size).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert all(r["n_shingles"] == len(neardup.shingles(dict(rows)[i], size)) for i, r in got.items())


@pytest.mark.parametrize("percent", [60, 90])
def test_near_duplicates_at_other_similarities(docs, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=percent).collect()}
    assert [got[i] for i, _ in rows] == neardup.brute_force(rows, percent=percent)


def test_near_duplicates_odd_rows(spark, empty):
    assert neardup.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(1, "a b c", "x", "s", 5), (1, "a b c", "x", "s", 5), (None, "a b c", "x", "s", 5), (2, "A B C", None, "s", 5)], DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, False)], key=str)


def test_one_doc_id_on_several_texts(spark):
    rng = random.Random(21)
    rows = []
    for k in range(12):
        base = words(rng, 60)
        near = [*base[:-1], "other"]
        # the least doc_id stands on the texts of all groups, some groups also share others
        rows += [(1, " ".join(base)), (2 + k, " ".join(near)), (2 + k // 2, " ".join([*near[:-1], "third"]))]
    rows += [(1, rows[0][1]), (40, ""), (40, "x"), (41, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted(zip([i for i, _ in rows], neardup.brute_force(rows), strict=True))


def test_a_large_group_of_near_copies_is_one_component(spark):
    """Members that differ more than the threshold from each other but hang together; no quadratic join."""
    rng = random.Random(4)
    base = words(rng, 120)
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(len(own))] = f"w{i}"
        rows.append((i, " ".join(own), None, None, None))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    want = neardup.brute_force([r[:2] for r in rows])
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(zip([r[0] for r in rows], want, strict=True))


def test_pages_of_one_template_stay_apart(spark):
    """Pages that share most words of a key but not enough; copies, edited ones and chains among them are still found."""
    rng = random.Random(21)
    templates = [[f"t{t}w{i}" for i in range(60)] for t in range(2)]
    texts = []
    for k in range(90):
        own = [f"own{k}x{rng.randrange(10**6)}" for _ in range(rng.choice([8, 14, 25]))]
        texts.append([*templates[k % 2], *own])
    for k in range(0, 60, 4):
        edited = list(texts[k])
        edited[rng.randrange(len(edited))] = f"new{k}"
        texts += [edited, list(texts[k])]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in rows], neardup.brute_force(rows), strict=True))


def test_components_of_a_chain(spark):
    from tessera.llm.common import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r["node"]: r["comp"] for r in neardup.components(links, Scratch(spark, "t"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_fingerprint(rows):
    order = sorted(rows, key=lambda r: -r[0])
    paragraphs = lambda t: {x for x in t.split("\n") if x.strip()}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {}
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + follow[:third]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), near(paragraphs(t), paragraphs(edited)), near(paragraphs(t), paragraphs(follow)))
    return out


def test_fingerprints(docs, empty, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_fingerprint(rows)
    monkeypatch.setattr(fingerprint, "STRETCH_ROWS", 4)
    monkeypatch.setattr(fingerprint, "WIDTH", 3)  # small sketches fail first and are retried larger
    got = fingerprint.fingerprints(clashing(docs)).collect()
    assert len(got) == len(rows)
    by_text: dict = {}
    for r in got:
        n, sha, edited, follow = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(edited) and r["near_next"] == pytest.approx(follow)
        by_text.setdefault(dict(rows)[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.fingerprints(empty).collect() == []


def test_fingerprint_of_a_single_row_follows_itself(spark):
    one = spark.createDataFrame([(7, "abc\ndef\nghi", None, None, None)], DOCS)
    (r,) = fingerprint.fingerprints(one).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abc\ndef\nabc").hexdigest()


def test_fingerprints_have_no_python(docs):
    for plan in (fingerprint.ring(docs), fingerprint.fingerprints(docs)):
        plan = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    """Null and repeated doc_ids each stand in the order: by doc_id, then by a hash of the text, null ones last."""
    monkeypatch.setattr(fingerprint, "STRETCH_ROWS", 3)
    rng = random.Random(22)
    text = lambda: "\n".join([" ".join(words(rng, 4)) for _ in range(rng.randint(1, 6))] + ["\t\r", " "])
    rows = [(None, text()) for _ in range(12)] + [(5, text()) for _ in range(5)] + [(i, text()) for i in range(10, 30)] + [(40, None), (41, "\n".join(words(rng, 3_000)))]
    wide = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = fingerprint.fingerprints(wide).collect()
    assert len(got) == len(rows)
    from pyspark.sql import functions as F

    hashed = {r["text"]: r["h"] for r in wide.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    third = lambda t: len(t) // 3
    want = sorted(((i, hashlib.sha256((t[: len(t) - third(t)] + order[(k + 1) % len(order)][1][: third(t)]).encode()).hexdigest()) for k, (i, t) in enumerate(order)), key=str)
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=str) == want


def test_packing(docs, empty):
    from pyspark.sql import functions as F

    counter = token_count.Counter(open(token_count.VOCABULARY, "rb").read())
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for tokens, size in ((None, lambda t: sum(counter.counts(counter.split(t)))), (F.regexp_count("text", F.lit(r"\S+")), lambda t: len(t.split()))):
        got = packing.pack(clashing(docs), buckets=4, batch_tokens=300, tokens=tokens).collect()
        count = {i: size(t or "") for i, t in rows.items()}
        assert {r["doc_id"]: r["n_tokens"] for r in got} == count
        assert all(r["pad_tokens"] == r["bucket_tokens"] - r["n_tokens"] >= 0 for r in got)
        batches: dict = {}
        for r in got:
            batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        for own in batches.values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
            assert len(own) == 1 or len(own) * own[0]["bucket_tokens"] <= 300
        for bucket in {b for b, _ in batches}:
            numbers = sorted(n for b, n in batches if b == bucket)
            room = max(1, 300 // max(1, batches[bucket, 0][0]["bucket_tokens"]))
            assert numbers == list(range(len(numbers))) and all(len(batches[bucket, n]) == room for n in numbers[:-1])
        lengths, counts = np.unique(list(count.values()), return_counts=True)
        assert sum(r["pad_tokens"] for r in got) == packing.best_boundaries(lengths, counts, 4)[1]
    assert packing.pack(empty).collect() == []


def test_packing_keeps_columns_and_odd_rows(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "SUB_ROWS", 3)
    rows = [(None, "a b", "x", "s", 1)] * 4 + [(5, "a b c", None, None, None)] * 4 + [(6, None, None, None, None), (7, "", None, None, None)]
    odd = spark.createDataFrame(rows, DOCS).selectExpr("*", "'k' AS bucket", "1 AS _row", "2 AS _id")
    got = packing.pack(odd, keep=odd.columns).collect()
    assert len(got) == 10 and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "_row", "_id", *packing.PACKED}
    assert sorted(r["slot"] for r in got if r["bucket"] == 0) == list(range(sum(r["bucket"] == 0 for r in got)))
    assert {(r["text"], r["n_tokens"]) for r in got} == {("a b", 2), ("a b c", 3), (None, 0), ("", 0)}


def held_by_shards(got, text):
    held: dict = {}
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + sharding.ROW_BYTES, zlib.crc32(raw))
        held.setdefault(r["shard"], []).append(r)
    for own in held.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return held


@pytest.mark.parametrize("copies", [12, 30, 400])
def test_sharding(docs, empty, spark, copies):
    """A group of equal texts below a shard's even part stays whole, a larger one gets the fewest pieces."""
    rows = docs.collect()
    hot = spark.createDataFrame([(1000 + i, "the same text " * 80, None, None, None) for i in range(copies)], DOCS)
    both = docs.where("doc_id <> 505").unionByName(hot)
    got = sharding.assign_shards(clashing(both), n_shards=5, bundles=64).collect()
    assert len(got) == len(rows) - 1 + copies
    held = held_by_shards(got, {r["doc_id"]: r["text"] or "" for r in both.collect()})
    even = sum(r["size"] for r in got) / 5
    group = sum(r["size"] for r in got if r["doc_id"] >= 1000)
    assert len({r["shard"] for r in got if r["doc_id"] >= 1000}) == max(1, -(-group // even))
    assert set(held) == set(range(5))
    sizes = [sum(r["size"] for r in own) for own in held.values()]
    assert max(sizes) - min(sizes) < 0.05 * max(sizes)
    assert sharding.assign_shards(empty).collect() == []


def test_sharding_odd_rows(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "SUB_ROWS", 7)
    rows = [(None, "one text for all " * 30, None, None, None)] * 60 + [(3, "another", "x", "y", 1)] * 5 + [(4, None, None, None, None)] + [(10 + i, f"row {i}", None, None, None) for i in range(100)]
    odd = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS shard", "2 AS row", "3 AS pieces", "4 AS _sub")
    got = sharding.assign_shards(odd, n_shards=4).collect()
    held = held_by_shards(got, {r[0]: r[1] or "" for r in rows})
    assert len(got) == len(rows) and set(held) == set(range(4))
    sizes = [sum(r["size"] for r in own) for own in held.values()]
    # the pieces of the group, dealt by row, differ by whole texts
    assert max(sizes) - min(sizes) <= 2 * 30 * 17
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1


def test_language_id(spark, empty):
    rng = random.Random(3)
    alphabets = {"aa": "abcde fg", "bb": "uvwxy zé"}
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, "".join(rng.choice(alphabets[lang]) for _ in range(200)), lang if i % 3 else None, "s", 1))
    truth = {r[0]: "aa" if "a" in r[1] else "bb" for r in rows}
    rows += [(900, None, "aa", "s", 1), (901, "", None, "s", 1), (902, "123 !!", "bb", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs.where(~langid.held_out(docs["doc_id"], 4, 2)))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, lang in truth.items())
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []


def test_held_out_parts(spark):
    from pyspark.sql import functions as F

    got = spark.range(50).select("id", langid.held_out(F.col("id"), 4, 2).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_quality(spark, sf_dir, empty):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (3, "x " * 50_000, None, None, None)], DOCS)
    got = quality.with_quality(odd, model).collect()
    assert got[0]["score"] == got[1]["score"] and all(0 <= r["score"] <= 1 for r in got)
    assert quality.with_quality(empty, model).collect() == []
    plan = quality.with_quality(odd, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    nothing = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in quality.with_quality(odd, nothing).collect()} == {0.5}


def test_compiled_rules_equal_the_model(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    stats = quality.statistics(F.col("text"))
    rows = quality.with_quality(docs, model).select("score", *[c.alias(f"x_{k}") for k, c in stats.items()]).toPandas()
    x = {k: rows[f"x_{k}"].to_numpy(dtype=float) for k in stats}
    total = model.bias + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.allclose(rows["score"], 1 / (1 + np.exp(-total)))


def test_decontamination(spark, empty):
    rng = random.Random(5)
    items = [" ".join(words(rng, n)) for n in (12, 30, 40)]
    edited = items[2].split()
    for k in range(0, 40, 6):
        edited[k] = "changed"
    noise = lambda n: " ".join(words(rng, n))
    rows = [
        (1, f"{noise(50)} {items[0]} {noise(20)}", None, None, None),
        (2, f"{noise(30)}, {items[1].upper()}! {noise(30)}", None, None, None),
        (3, f"{noise(10)} {' '.join(edited)}", None, None, None),
        (4, noise(400), None, None, None),
        (5, " ".join(items[1].split()[:6]) + noise(100), None, None, None),
        (6, None, None, None, None),
        (7, "", None, None, None),
    ]
    rows += [(100 + i, f"{items[0]} {noise(3)}", None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(0, items[0]), (1, items[1]), (2, items[2]), (3, None), (4, ""), (5, "it")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.copies(clashing(docs), bench).collect()}
    assert {k for k in got if k[1] != 5} == {(1, 0), (2, 1), (3, 2), *((100 + i, 0) for i in range(60))}
    assert got[1, 0]["score"] == 1.0 and (got[1, 0]["start_word"], got[1, 0]["end_word"]) == (50, 62)
    assert 0.4 < got[3, 2]["score"] < 1
    bench = bench.where("item_id <> 5")
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {4, 5, 6, 7}
    assert decontam.copies(empty, bench).collect() == []
    assert decontam.copies(docs, bench.limit(0)).collect() == []


@pytest.mark.parametrize("n", [16, 40])
def test_edited_copies_with_one_frequent_trigram(spark, n):
    rng = random.Random(11)
    item = words(rng, 15)
    edited = [f"other{k}" if k in (3, 6, 9, 12) else w for k, w in enumerate(item)]
    seed = " ".join(item[:3])
    rows = [(i, " ".join([*words(rng, 20), *edited, *words(rng, 20)]), None, None, None) for i in range(n)]
    rows += [(1000 + i, f"{' '.join(words(rng, 20))} {seed} {' '.join(words(rng, 20))}", None, None, None) for i in range(30)]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.copies(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert set(got) == set(range(n)) and min(got.values()) == pytest.approx(0.6)


def test_frequent_phrases_of_many_items(spark, monkeypatch):
    """A phrase of all items and most documents makes no pairs by itself; copies are found as by aligning all with all."""
    rng = random.Random(12)
    phrase = "which of the following"
    items = [f"{phrase} {' '.join(words(rng, 20))}" for _ in range(40)]
    rows = [(i, f"{' '.join(words(rng, 30))} {phrase} {' '.join(words(rng, 30))}", None, None, None) for i in range(80)]
    for i in range(30):
        own = items[i].split()
        for k in rng.sample(range(len(own)), i % 12):
            own[k] = "changed"
        rows.append((200 + i, " ".join([*words(rng, 10), *own, *words(rng, 10)]), None, None, None))
    # all n-grams of an item are frequent
    rows += [(300 + i, f"{items[39]} {' '.join(words(rng, 3))}", None, None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, keys = {r[0]: decontam.words_of(r[1]) for r in rows}, [decontam.words_of(x) for x in items]
    want = {}
    for i, own in texts.items():
        for k, item in enumerate(keys):
            score = decontam.align(item, own)[0] / (decontam.MATCH * len(item))
            if score >= decontam.THRESHOLD and np.isin(decontam.grams_of(own), decontam.grams_of(item)).any():
                want[i, k] = pytest.approx(score)
    for size in (decontam.SHARED_BYTES, 1_000):  # one block of items, and many
        monkeypatch.setattr(decontam, "SHARED_BYTES", size)
        assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.copies(docs, bench).collect()} == want
    assert len(want) > 40


def test_short_items_in_long_texts(spark):
    rng = random.Random(13)
    rows = [(1, f"{' '.join(words(rng, 2_000))} Quick-Fox {' '.join(words(rng, 2_000))}", None, None, None), (2, "quick brown fox", None, None, None), (3, "Zebra!", None, None, None), (4, " ".join(["lorem", *words(rng, 50), "zebra"]), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(0, "quick fox"), (1, "zebra"), (2, "a b c d")], "item_id long, text string")
    got = lambda **kw: {(r["doc_id"], r["item_id"]) for r in decontam.copies(docs, bench, **kw).collect()}
    assert got() == {(1, 0), (3, 1), (4, 1)}
    assert got(least_words=2) == {(1, 0)} and got(least_words=3) == set()


def test_decontamination_query_against_all_alignments(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    items = {r["item_id"]: decontam.words_of(r["text"]) for r in bench}
    want = set()
    for r in docs:
        own = decontam.words_of(r["text"])
        want |= {(r["doc_id"], i) for i, item in items.items() if decontam.most(item, own) >= decontam.THRESHOLD * decontam.MATCH * len(item) and decontam.align(item, own)[0] >= decontam.THRESHOLD * decontam.MATCH * len(item)}
    assert {(r["doc_id"], r["item_id"]) for r in q.op7_decontamination(spark, sf_dir).collect()} == want and want


def test_decontamination_without_a_shared_table(spark, monkeypatch):
    rng = random.Random(6)
    item = " ".join(words(rng, 20))
    docs = spark.createDataFrame([(1, f"x y {item}", None, None, None), (2, " ".join(words(rng, 60)), None, None, None)], DOCS)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    monkeypatch.setattr(decontam, "SHARED_GRAMS", 3)
    assert [(r["doc_id"], r["item_id"]) for r in decontam.copies(docs, bench).collect()] == [(1, 0)]


def test_pii_columns(spark, empty):
    texts = ["mail a@b.co or 1.2.3.4", None, "", "card 4111 1111 1111 1111, tel +1 (555) 123-4567"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["pii"] for r in pii.with_pii(docs).collect()}
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["spans"]) == (1, 1, "email:5:11,ip:15:22")
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:5:11,ip:15:22").hexdigest()
    assert got[1]["masked"] is None and got[1]["spans"] == "" and got[2]["masked"] == ""
    assert (got[3]["n_card"], got[3]["n_phone"]) == (1, 1) and got[3]["masked"] == "card [CARD], tel [PHONE]"
    assert pii.with_pii(empty).collect() == []


def test_token_counts(docs, empty):
    counter = token_count.Counter(open(token_count.VOCABULARY, "rb").read())
    got = {r["doc_id"]: r for r in token_count.with_token_counts(docs).collect()}
    for i, r in got.items():
        text = r["text"] or ""
        assert r["tokens"]["n_tokens"] == sum(counter.counts(counter.split(text))), i
        for start, end, new in token_count.standard_edits(text):
            text = text[:start] + new + text[max(start, min(end, len(text))) :]
        assert (r["tokens"]["edited_chars"], r["tokens"]["edited_tokens"]) == (len(text), sum(counter.counts(counter.split(text))))
    assert token_count.with_token_counts(empty).collect() == []


def test_every_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in q.QUERIES} == set(range(1, 11))


def article_of(page: str) -> str:
    """The article of the tables' pages by their markup, without a parser."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", x)))).strip() for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    return "\n".join(x for x in parts if x)


def test_html_query(spark, sf_dir):
    got = {r["page_id"]: r for r in q.op3_html(spark, sf_dir).collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: article_of(p) for i, p in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in got.values())


def test_html_odd_pages(spark):
    model = html_crf.train(html_crf.training_pages(60), steps=60)
    long = "<article>" + "<p>A paragraph with words, one of many.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p> </p>", "x"), (4, "u", long, "x"), (4, "u", long, "x"), (None, None, "<article><p>Some words, here. And more.</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_crf.with_main_text(pages, model).collect()
    assert [len(r["text"].split("\n")) if r["text"] else 0 for r in got] == [0, 0, 0, 20_000, 20_000, 1]
    assert html_crf.with_main_text(pages.limit(0), model).collect() == []


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [k for k, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = dict(zip(rows, neardup.brute_force(list(rows.items()), p.SHINGLE_WORDS, p.SIMILARITY), strict=True))
    kept = {i for i, c in groups.items() if i == c}
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {i for i in kept if any(decontam.align(w, decontam.words_of(rows[i]))[0] >= decontam.THRESHOLD * decontam.MATCH * len(w) for w in items)}
    want = {i: pii.mask(rows[i], pii.find(rows[i])[1]) or "" for i in kept - dirty}
    got = {r["doc_id"]: r for r in p.run(spark, sf_dir).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    counter = token_count.Counter(open(token_count.VOCABULARY, "rb").read())
    assert all(r["n_tokens"] == sum(counter.counts(counter.split(r["text"]))) and r["n_chars"] == len(r["text"]) for r in got.values())
    assert set(next(iter(got.values())).asDict()) == {*docs.columns, *packing.PACKED}
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    text = "The words of this document are plain words, and there are a few of them in it. "
    long = " ".join(f"word{i} of the text" for i in range(30_000))
    rows = [(1, None, "en", "s", 1), (None, text, "en", "s", 1), (None, text + "Two.", "en", None, 1), (2, "", "en", "s", 0), (3, text, None, "s", 1), (3, text, None, "s", 1)]
    rows += [(4, text, "en", "s", 1), (5, f"{text} {item}", "en", "s", 1), (6, f"{long} call +44 20 7946 0958", None, "s", 1), (7, "12 34", "en", "s", 1)]
    odd = spark.createDataFrame(rows, DOCS)
    wide = clashing(odd)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    for docs in (odd, wide):
        told = p.language_id(spark, docs, sf_dir)
        assert told.columns == docs.columns and ids(told) == [3, 3, 4, 5, 6, None, None]
        assert {r["lang"] for r in told.collect()} == {"en"}
        single = p.near_dedup(spark, docs, sf_dir)
        assert single.columns == docs.columns and ids(single) == [1, 2, 3, 5, 6, 7, None, None]
        clean = p.decontaminate(spark, docs, sf_dir)
        assert clean.columns == docs.columns and ids(clean) == [1, 2, 3, 3, 4, 6, 7, None, None]
        masked = p.mask_pii(spark, docs, sf_dir)
        assert masked.columns == docs.columns and len(rows) == masked.count()
        assert [r["text"] for r in masked.where("doc_id = 6").collect()] == [f"{long} call [PHONE]"]
        packed = p.packing(spark, docs, sf_dir)
        assert set(packed.columns) == {*docs.columns, *packing.PACKED} and packed.count() == len(rows)
        for _, stage in p.STAGES:
            assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_added_columns_leave_others_alone(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = clashing(spark.createDataFrame([(1, "some words here", "en", "s", 1), (2, None, None, None, None)], DOCS))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain = quality.train(table, labels)
    assert quality.train(clashing(table), labels.withColumns({c: F.lit(1) for c in CLASHES if c != "quality"})) == plain
    model = langid.train(clashing(table))
    added = {
        "score": quality.with_quality(docs, plain),
        "pii": pii.with_pii(docs),
        "tokens": token_count.with_token_counts(docs),
        "lang_pred": langid.identify(docs, model, score="lang_pred_score").drop("lang_pred_score"),
    }
    for name, got in added.items():
        assert set(got.columns) == set(docs.columns)
        assert all(r[c] == 1 for r in got.collect() for c in CLASHES if c != name)
        assert all(r[name] != 1 for r in got.collect())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(q.ORACLES[name])
    got = q.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_queries_keep_to_their_contracts(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    part = lambda i, n: zlib.crc32(str(i).encode()) % n
    told = q.op5_language_id(spark, sf_dir).collect()
    assert {r["doc_id"]: r["held_out"] for r in told} == {i: part(i, 4) == 2 for i in docs}
    scored = q.op6_quality(spark, sf_dir).collect()
    assert {r["doc_id"]: r["held_out"] for r in scored} == {i: part(i, 5) == 0 for i in docs}
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in scored)
    placed = q.op9_sharding(spark, sf_dir).collect()
    assert {r["law"] for r in placed} == {"bytes"} and {r["grown_shard"] for r in placed} == {None}
    assert set(held_by_shards(placed, docs)) == set(range(40)) and len(placed) == len(docs)
    found = {r["doc_id"]: r for r in q.op8_pii(spark, sf_dir).collect()}
    for i, text in docs.items():
        base, spans = pii.find(text)
        assert found[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and found[i]["spans"] == pii.joined(spans)
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    grouped = {r["doc_id"]: r["component_id"] for r in q.op10_minhash(spark, sf_dir).collect()}
    assert grouped == dict(zip(docs, neardup.brute_force(list(docs.items())), strict=True))
    packed = q.op1_packing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(docs)


def test_documents_that_no_language_fits_go(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign = {-1: "Все люди рождаются свободными и равными в своём достоинстве и правах. " * 5, -2: "人人生而自由在尊严和权利上一律平等" * 5}
    planted = docs.limit(1).select("*").collect()[0].asDict()
    rows = spark.createDataFrame([planted | {"doc_id": i, "text": t, "lang": None} for i, t in foreign.items()], docs.schema)
    left = {r["doc_id"] for r in p.language_id(spark, docs.unionByName(rows), sf_dir).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.select("doc_id").collect()}
