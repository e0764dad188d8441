"""The whole-table queries against plain Python on small fixtures: long texts, markup, other languages, later lines."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import corrupt, digests, script, segment, text
from tessera.plans import catalogue, shared, whole

DOCS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", sorted(whole.QUERIES))
def test_whole_queries_are_registered_and_run(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_edits_after_character_200_count(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\nÉ") for _ in range(n)) for n in (0, 30, 500)] + ["a" * 200 + " B" * 100]
    got = {r["lang"]: r["cer"] for r in whole.lowered_rate(spark.createDataFrame([*((i, t, None) for i, t in enumerate(texts)), (9, None, None), (10, "x" * 250 + "Y", "en")], DOCS)).collect()}
    assert got[None] == pytest.approx(sum(distance(t, t.lower()) for t in texts) / sum(map(len, texts)), abs=1e-6)
    assert got["en"] == pytest.approx(1 / 251, abs=1e-6)


def test_markup_and_long_texts_are_processed(spark, sf_dir):
    long = "tree é 𝄞e " * 400
    rows = [(1, long, "en"), (2, "{{box}} [[a|the link]] and [[b]]\n* item\n''bold'' <b>x</b>", None), (3, "", None), (4, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in docs.select("doc_id", script.skeleton(docs["text"]).alias("s"), text.strip_wikitext(docs["text"]).alias("plain")).collect()}
    for i, t, _ in rows[:3]:
        assert got[i]["s"]["kept"] == t.replace("e", "")
        assert got[i]["s"]["places"] == [len(t[:k].replace("e", "")) for k, c in enumerate(t) if c == "e"]
    assert got[2]["plain"].split() == "the link and b bold x".split()
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "conversations")}
    for name, of in (("m13_whole_skeletons", "documents"), ("x22_whole_wikitext", "documents"), ("x28_whole_corruption", "documents"), ("x16_whole_typography", "conversations")):
        assert whole.QUERIES[name](spark, sf_dir).count() == n[of]


def test_pieces_and_ids_take_all_languages(spark):
    texts = ["Extraordinarilylongwords and short", "extraordinarilylongwords, AND été", "été ein"]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ["en", None, "fr"], strict=True))], DOCS)
    words = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()))
    want: Counter = Counter()
    for w, n in words.items():
        marked = f"▁{w}"
        for i in range(len(marked) if n >= 2 else 0):
            for j in range(i + 1, min(i + 16, len(marked)) + 1):
                want[marked[i:j]] += n
    assert {r["piece"]: r["n"] for r in whole.substring_counts(docs).collect()} == want
    assert {r["word"]: r["new_id"] for r in whole.vocabulary_ids(docs).collect()} == {w: i for i, w in enumerate(sorted(words))}


def test_pools_take_every_sentence_of_every_language(spark):
    a, b, c = "One line of five words.", "Another line of five words.", "Una frase de cinco palabras."
    docs = spark.createDataFrame([(2, f"{a} {b}\nshort", "en"), (1, f"short\n{b}", "en"), (3, f"x\n{c}", None), (4, f"{c} {c}", "pt"), (5, None, "en")], DOCS)
    got = {(r["lang"], r["line"]): (r["doc_id"], r["place"]) for r in whole.pools(docs).collect()}
    assert got == {("en", a): (2, 0), ("en", b): (1, 1), (None, c): (3, 1), ("pt", c): (4, 0)}


def test_items_on_later_lines_are_blocked(spark):
    bench = spark.createDataFrame([(0, "An item of one line"), (1, "First half\nsecond half\n\nthird"), (2, "123"), (3, None)], "item_id long, text string")
    texts = {1: "intro\nan ITEM, of one line!\nend", 2: "x\nfirst half\nSecond half\nthird.\ny", 3: "First half second half third", 4: "one\nsecond half, too\nSecond half", 5: "456", 6: None, 7: "an item of one line more", 8: ""}
    docs = spark.createDataFrame([*((i, t, None) for i, t in texts.items()), (None, "kept", None)], DOCS)
    assert sorted((r["doc_id"] for r in whole.without_items(docs, bench).collect()), key=str) == [5, 6, 7, 8, None]
    assert whole.without_items(docs, bench.limit(0)).count() == 9


def test_windows_of_one_stream(spark):
    rng = random.Random(2)
    lengths = [rng.choice([0, 1, 5, 63, 64, 65, 300]) for _ in range(500)]
    docs = spark.createDataFrame([(i * 7 % 500, None if n == 0 else "w " * n, None) for i, n in enumerate(lengths)], DOCS)
    stream = [(d, k) for d, n in sorted((i * 7 % 500, n) for i, n in enumerate(lengths)) for k in range(n)]
    got = {r["window"]: (r["doc_id"], r["start"]) for r in whole.stream_windows(docs).collect()}
    assert got == {w: stream[w * 64] for w in range(len(stream) // 64)}
    assert whole.stream_windows(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_doc(rows, value):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["place"])):
        out.setdefault(r["doc_id"], []).append(value(r))
    return out


def test_units_of_the_documents(spark, sf_dir, texts):
    got = by_doc(catalogue.queries()["x19_units"](spark, sf_dir).collect(), lambda r: (r["text"], r["prefix"], r["suffix"]))
    assert got == {i: [(u.text, u.prefix, u.suffix) for u in segment.units(t)] for i, t in texts.items()}
    assert all("".join(p + x + s for x, p, s in own) == segment.unwrap(texts[i]) for i, own in got.items())


def test_seeded_changes_of_the_documents(spark, sf_dir, texts):
    got = by_doc(catalogue.queries()["x32_line_chunks"](spark, sf_dir).collect(), lambda r: r["line"])
    for i, lines in got.items():
        assert " ".join(lines).split() == texts[i].split()
        assert all(len(x) <= 80 or " " not in x for x in lines)
        # a line is only ended where the next word would not fit the widest line
        assert all(len(a) + 1 + len(b.split(" ")[0]) > 30 for a, b in zip(lines, lines[1:], strict=False))
    informal = {r["canonical"]: r["informal"] for r in catalogue.queries()["x29_informal_spelling"](spark, sf_dir).collect()}
    planted = str.maketrans(shared.STANDING_IN, shared.INFORMAL)
    assert informal.keys() == {t.translate(planted).replace(" dɛ ", " deg ").replace(" of ", " seg ").strip() for t in texts.values()} - {""}
    assert informal == {t: misspelled_plainly(t) for t in informal}
    # every spelling of the table, and each kind of change, occurs
    assert all(re.search(re.escape(to), "".join(informal.values())) for listed in corrupt.SPELLINGS.values() for to, _ in listed)


def test_letters_are_drawn_in_batches(spark, sf_dir):
    """One digest for each letter, but no step of a plan for each: texts longer than a block, letters beyond its edges, of several
    rows in one, and none at all."""
    long = "ČuḥxẒ-deg 😀ɛ seg c" * (corrupt.BLOCK // 16)
    texts_ = [None, "", "u", "𐊀ɣ deg\tuxxam", "plain", long, *(long[:n] for n in range(1, 40)), "ẓ" * 10, "Ğ" * (corrupt.BLOCK // 2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "i int, t string").coalesce(1)
    got = {r["i"]: r["x"] for r in df.select("i", corrupt.misspelled(F.col("t")).alias("x")).collect()}
    assert got == {i: t and misspelled_plainly(t) for i, t in enumerate(texts_)}
    plan = catalogue.queries()["x29_informal_spelling"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "md5" not in plan


def test_digests_are_those_of_the_library():
    shared = [hashlib.sha256(bytes([k])).hexdigest() for k in range(3)]
    numbers = np.array([x for k in range(10) for x in (10**k - 1, 10**k)] + [10**10 - 1])
    row = np.repeat(np.arange(3), len(numbers))
    high, low = digests.ended([s[row] for s in digests.begun(shared)], np.tile(numbers, 3))
    assert [f"{a:016x}{b:016x}" for a, b in zip(high.tolist(), low.tolist(), strict=True)] == [hashlib.md5(f"{own}:{n}".encode()).hexdigest() for own in shared for n in numbers]
    for refused in (-1, 10**10):
        with pytest.raises(ValueError, match="digits"):
            digests.ended([s[:1] for s in digests.begun(shared)], np.array([refused]))


def misspelled_plainly(text: str) -> str:
    """One text's informal spelling, letter by letter."""

    def drawn(name: object, k: int) -> float:
        own = hashlib.sha256(f"informal:{text}".encode()).hexdigest()
        kind = hashlib.sha256 if name == "row" else hashlib.md5
        return int(kind(f"{own}:{name}".encode()).hexdigest()[13 * k : 13 * k + 13], 16) / 16**13

    if drawn("row", 0) < 0.15:
        return text
    out = ""
    for i, c in enumerate(text, start=1):
        low, to = c.lower(), c
        if low == "u" and drawn(i, 0) < 0.45:
            to = "ou" if c == "u" else "Ou"
        elif low in corrupt.SPELLINGS and drawn(i, 0) < 0.9:
            left = drawn(i, 1)
            for option, weight in corrupt.SPELLINGS[low]:
                left = round(left - weight, 12)
                if left < 0:
                    break
            to = option if c == low else option.capitalize()
        out += to
    if "-" in out and drawn("row", 1) < 0.5:
        out = out.replace("-", " " if drawn("row", 2) < 0.5 else "")
    if drawn("row", 3) < 0.25:
        out = re.sub(r"(?<![\w])deg[ \t\n\r\f\v]+", "g ", out)
        out = re.sub(r"(?<![\w])seg[ \t\n\r\f\v]+", "s ", out)
    return out


def test_shouted_lines_of_the_documents(spark, sf_dir, texts):
    def soft(line):
        def fold(p):
            only = "".join(c for c in p if c.isalpha())
            if not only or re.fullmatch("[IVXLCDM]+", only) or re.fullmatch(r"(?:[^\W\d_]\.){2,}", p.strip("\"'()[]“”‘’«»")):
                return p
            at = next(k for k, c in enumerate(p) if c.isalpha())
            return p[:at] + p[at].upper() + p[at + 1 :].lower()

        return "".join(map(fold, re.findall(r"\S+|\s+", line)))

    lines = {(i, k): x for i, t in texts.items() for k, x in enumerate(t.split("\n"))}
    runs = {k: re.findall(r"[^\W\d_]{2,}", x) for k, x in lines.items()}
    want = {k: soft(lines[k]) for k, own in runs.items() if len(own) >= 2 and all(w == w.upper() and w.lower() != w for w in own)}
    assert {(r["doc_id"], r["line"]): r["soft"] for r in catalogue.queries()["x17_shouted_lines"](spark, sf_dir).collect()} == want
    rows = spark.createDataFrame([(0, "THE END OF PART XIV, BY A.B. (NOW)\nA line\nOK", "en"), (1, "DES ÉTÉS", "fr")], DOCS)
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(text.soften(F.split("text", "\n")[0])).collect()] == ["The End Of Part XIV, By A.B. (Now)", "Des Étés"]


def test_greedy_pass_over_orders(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()
    first: dict = {}
    for r in rows:
        key, seq = (r["l_partkey"], r["l_suppkey"]), r["l_orderkey"] * 10 + r["l_linenumber"]
        first[key] = min(seq, first.get(key, seq))
    left, right, kept = set(), set(), set()
    for (a, b), seq in sorted(first.items(), key=lambda x: (x[1], *x[0])):
        if a not in left and b not in right:
            kept.add((a, b, seq))
            left.add(a)
            right.add(b)
    assert {tuple(r) for r in catalogue.queries()["u08_either_side"](spark, sf_dir).collect()} == kept


def test_tokenizer_evaluation_of_the_documents(spark, sf_dir):
    """Against the public library, on texts whose white space is single blanks and that begin with one."""
    import base64

    import tiktoken

    from tessera.plans.subwords import VOCABULARIES

    tally: dict = {}
    for name, path in VOCABULARIES.items():
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb").read().splitlines() if x.strip())}
        enc = tiktoken.Encoding("t", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
            own = tally.setdefault((name, r["lang"]), [0, 0, 0])
            words = r["text"].split()
            whole = "".join(f" {w}" for w in words)
            own[0] += len(enc.encode_ordinary(whole))
            own[1] += len(words)
            own[2] += len(whole)
    got = {(r["vocabulary"], r["lang"]): (r["pieces_per_word"], r["pieces_per_char"], r["not_restored"]) for r in catalogue.queries()["a38_tokenizer_evaluation"](spark, sf_dir).collect()}
    assert got == {k: (pytest.approx(a / b, abs=1e-4), pytest.approx(a / c, abs=1e-4), 0) for k, (a, b, c) in tally.items()}
