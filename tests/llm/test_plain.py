"""The operators' plain parts against brute force: no Spark needed."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tessera.llm import decontam, html_crf, langid, neardup, packing, pii, quality, sharding, token_count


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 60, 9))
        counts = rng.integers(1, 9, len(lengths))
        edges, pad = packing.best_boundaries(lengths, counts, 3)
        best = None
        from itertools import combinations

        for k in range(3):
            for inner in combinations(lengths[:-1], k):
                cut = [*inner, lengths[-1]]
                cost = sum(c * (min(e for e in cut if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
                best = cost if best is None else min(best, cost)
        assert pad == best
        assert edges[-1] == lengths[-1]


def test_vectors_balance():
    rng = np.random.default_rng(1)
    loads = rng.integers(1, 100, (4000, 3)).astype(float)
    bins = sharding.pack_vectors(loads, 16)
    held = np.array([loads[bins == b].sum(axis=0) for b in range(16)])
    assert (held.max(axis=0) / held.mean(axis=0) < 1.02).all()
    assert held[:, 0].max() - held[:, 0].min() <= 100 and held[:, 2].max() - held[:, 2].min() <= 100
    assert sharding.pack_vectors(np.zeros((0, 3)), 4).tolist() == []


def test_boundaries_of_many_lengths_are_optimal():
    """Against the plain recursion over all splits, beyond what can be enumerated."""
    rng = np.random.default_rng(15)
    lengths = np.unique(rng.integers(0, 20_000, 900))
    counts = rng.integers(1, 1_000, len(lengths))
    rows = np.concatenate([[0], np.cumsum(counts)])
    cost = np.array([0.0] + [np.inf] * len(lengths))
    for _ in range(6):
        cost = np.array([0.0] + [min(cost[:j] + (rows[j] - rows[:j]) * lengths[j - 1]) for j in range(1, len(lengths) + 1)])
    edges, pad = packing.best_boundaries(lengths, counts, 6)
    assert pad == cost[-1] - (lengths * counts).sum() == sum(int(c) * (min(e for e in edges if e >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))


def test_a_vector_that_fits_a_bin_is_not_split_and_bins_stay_even():
    rng = np.random.default_rng(16)
    loads = np.concatenate([[[700.0, 400, 90], [650, 90, 20]], rng.integers(1, 9, (800, 3))])
    bins = sharding.pack_vectors(loads, 5)
    held = np.array([loads[bins == b].sum(axis=0) for b in range(5)])
    assert (np.abs(held / held.mean(axis=0) - 1).max(axis=0) < [0.01, 0.02, 0.02]).all()


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingles_are_those_of_the_words(size):
    rng = random.Random(2)
    for _ in range(50):
        words = [rng.choice(["a", "b", "Ä", "cc", "A"]) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", "\n", "\t\x0b", "  "]) for w in words)
        low = [w.replace("A", "a") for w in words]
        want = {tuple(low[i : i + size]) for i in range(max(1, len(low) - size + 1))} if low else set()
        assert len(neardup.shingles(text, size)) == len(want)
    assert len(neardup.shingles(None, 2)) == 0
    assert len(neardup.shingles(" ", 2)) == 1


def test_long_texts_hash_as_short_ones():
    words = [f"w{i % 7919}" for i in range(300_000)]
    text = " ".join(words)
    assert len(text) > neardup._POWERS
    assert (neardup.word_hashes(text.encode())[:50] == neardup.word_hashes(" ".join(words[:50]).encode())).all()
    assert len(neardup.word_hashes(("x" * (neardup._POWERS + 5) + " y").encode())) == 2


@pytest.mark.parametrize("percent", [50, 60, 80, 90, 99])
def test_pairs_within_the_distance_share_a_key(percent):
    rng = np.random.default_rng(3)
    layout = neardup.Layout.of(percent)
    n = layout.chunks * layout.width
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint64)
        b = a.copy()
        wrong = rng.choice(n, layout.guaranteed, replace=False)
        b[wrong] ^= np.uint64(1)
        assert set(neardup.keys(a, layout).tolist()) & set(neardup.keys(b, layout).tolist())


def test_layouts_follow_the_similarity():
    layout = neardup.Layout.of(80)
    assert (layout.chunks, layout.width, layout.guaranteed) == (10, 5, 19)
    assert [neardup.Layout.of(p).width for p in (50, 80, 90)] == sorted(neardup.Layout.of(p).width for p in (50, 80, 90))
    rng = np.random.default_rng(17)
    for percent in (60, 80):
        # sets at the similarity stay well within the sketch's limit
        for _ in range(20):
            both, own = 2_000 * percent // 100, 2_000 * (100 - percent) // 200
            pool = rng.integers(0, 1 << 63, both + 2 * own).astype(np.uint64)
            a, b = (neardup.sketch(np.sort(x)) for x in (np.concatenate([pool[:both], pool[both : both + own]]), np.concatenate([pool[:both], pool[both + own :]])))
            assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= neardup.Layout.of(percent).limit


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, text = (rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(item) + 1, len(text) + 1), dtype=int)
        for i in range(1, len(item) + 1):
            for j in range(1, len(text) + 1):
                step = decontam.MATCH if item[i - 1] == text[j - 1] else decontam.MISMATCH
                table[i, j] = max(0, table[i - 1, j - 1] + step, table[i - 1, j] + decontam.GAP, table[i, j - 1] + decontam.GAP)
        score, start, end = decontam.align(item, text)
        assert score == table.max()
        # the reported stretch alone reaches the score
        assert decontam.align(item, text[start:end])[0] == score
    assert decontam.align(np.zeros(0, np.uint64), np.zeros(3, np.uint64)) == (0, 0, 0)


def test_token_tree_equals_a_full_count():
    counter = token_count.Counter(open(token_count.VOCABULARY, "rb").read())
    rng = random.Random(5)
    letters = [*"ab c  \n\t'sé1,.!  ", "'ll", " the", "12"]
    text_of = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(80):
        tree = token_count.TokenTree(text_of(rng.choice([0, 1, 30, 2000])), counter)
        for _ in range(5):
            at = rng.randint(0, len(tree.text))
            tree.edit(at, at + rng.choice([0, 1, 40, 500]), text_of(rng.choice([0, 1, 20, 900])))
            full = counter.split(tree.text)
            assert [x for own, _ in tree.leaves for x in own] == list(map(len, full))
            assert tree.n_tokens == sum(counter.counts(full)) and tree.chars[1] == len(tree.text)
    long = token_count.TokenTree("word " * 20_000, counter)
    long.edit(50_000, 50_003, "xyz")
    assert long.reencoded < 20


def brute_pii(text: str) -> list[tuple[str, int, int]]:
    """The stated patterns, applied as they are written."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    parts = ["a", "@", ".", "-", "+", "12", "255", "4111111111111111", " ", "x.y", "1.2.3.4", "+1 555 123 4567", "é", "(", ")", "b@c.de", "0", "7"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_field_finds_repeats_and_keeps_base_spans():
    text = "call +44 123 456-7890 today. Later 456-7890 again, in 2021 for 12.50."
    base, spans = pii.find(text)
    assert base == [("phone", 5, 21)]
    assert spans == [("phone", 5, 21), ("phone", 35, 43)]
    assert pii.mask(text, spans) == "call [PHONE] today. Later [PHONE] again, in 2021 for 12.50."
    assert pii.find("Version 2.0 of 2004, page 17 of 230; licence CC BY 4.0")[1] == []
    assert pii.find(None) == ([], []) and pii.mask(None, []) is None
    for _, all_spans in (pii.find(t) for t, _ in pii.training_texts(50, seed=8)):
        assert all(k in pii.KINDS for k, _, _ in all_spans)


def test_field_accuracy_on_held_out_texts():
    hit = wanted = found = 0
    for text, spans in pii.training_texts(200, seed=99):
        got = set(pii.find(text)[1])
        hit += len(got & set(spans))
        wanted += len(set(spans))
        found += len(got)
    assert hit / wanted > 0.85 and hit / found > 0.9


def marginals_by_enumeration(unary, chain, skip, groups):
    from itertools import product

    n, k = unary.shape
    edges = [(g[0], j) for g in groups for j in g[1:]]
    total = np.zeros((n, k))
    for y in product(range(k), repeat=n):
        p = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(chain[y[i], y[i + 1]] for i in range(n - 1)) + sum(skip[y[i], y[j]] for i, j in edges))
        for i in range(n):
            total[i, y[i]] += p
    return total / total.sum(axis=1, keepdims=True)


def symmetric(rng, scale):
    x = rng.normal(size=(3, 3)) * scale
    return x + x.T


@pytest.mark.parametrize("seed", range(6))
def test_messages_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    unary, chain, skip, none = rng.normal(size=(6, 3)), symmetric(rng, 0.5), symmetric(rng, 0.5), np.zeros((3, 3))
    # without cycles messages are exact: a chain, and stars of skip edges
    assert np.allclose(pii.infer(unary, chain, skip, [], rounds=200), marginals_by_enumeration(unary, chain, skip, []), atol=1e-3)
    stars = [[0, 3, 5], [1, 4]]
    assert np.allclose(pii.infer(unary, none, skip, stars, rounds=200), marginals_by_enumeration(unary, none, skip, stars), atol=1e-3)
    # chain and skip edges make cycles: close, and nearer to the truth than either kind of edge alone
    truth = marginals_by_enumeration(unary, chain, skip, stars)
    gap = lambda c, s: np.abs(pii.infer(unary, c, s, stars, rounds=200) - truth).max()
    assert gap(chain, skip) < 0.12 and gap(chain, skip) < min(gap(chain, none), gap(none, skip))


def test_labels_of_repeats_come_through_the_skip_edges(monkeypatch):
    def recall(seed):
        hit = wanted = 0
        for text, spans in pii.training_texts(200, seed=seed):
            base, found = pii.find(text)
            extra = set(spans) - set(base)
            hit, wanted = hit + len(extra & set(found)), wanted + len(extra)
        return hit / wanted

    whole, weights, chain, skip = recall(99), *pii.model()
    monkeypatch.setitem(pii._LEARNED, "model", (weights, chain, np.zeros_like(skip)))
    assert whole > 0.95 and recall(99) < whole - 0.3


def test_repeats_planted_in_documents(sf_dir, monkeypatch):
    import pyarrow.parquet as pq

    rng = random.Random(14)
    forms = [("phone", "+44 20 7946 0958", "7946-0958"), ("ip", "81.2.199.61", "81-2-199-61"), ("email", "kim.lee@mail.example.org", "kim.lee")]
    whole = (weights, chain, skip) = pii.model()
    found, alone = {True: 0, False: 0}, 0
    texts = [r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()[:120]]
    for k, text in enumerate(texts):
        kind, full, bare = forms[k % 3]
        own = text.split(" ")
        for token in (f"is {full} here", f"was {bare} then"):
            own.insert(rng.randint(0, len(own)), token)
        planted = " ".join(own)
        at = planted.index(f"was {bare} then") + 4
        for skips in found:
            monkeypatch.setitem(pii._LEARNED, "model", whole if skips else (weights, chain, np.zeros_like(skip)))
            found[skips] += (kind, at, at + len(bare)) in pii.find(planted)[1]
        # without a partner the bare form is no personal data
        monkeypatch.setitem(pii._LEARNED, "model", whole)
        lone = planted.replace(f"is {full} here", "")
        at = lone.index(f"was {bare} then") + 4
        alone += (kind, at, at + len(bare)) in pii.find(lone)[1]
    assert found[True] > 0.95 * len(texts) and found[False] < 0.1 * len(texts) and alone == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call +44 123 456-7890 ... 4567890", ["+44 123 456-7890", "4567890"]),
        ("456-7890, later +44 123 456-7890", ["456-7890", "+44 123 456-7890"]),
        ("write to anna.kowal [at] mail [dot] org; Anna.Kowal said so, well-known", ["anna.kowal [at] mail [dot] org", "Anna.Kowal"]),
        ("anna.kowal@mail.org is anna.kowal, not Anna and not b.c-d", ["anna.kowal@mail.org", "anna.kowal"]),
        ("anna.kowal@mail.org is up-to-date and so is bea.novak", ["anna.kowal@mail.org"]),
        ("order 456-7890 and again order 456-7890", []),
        (f"{'a' * 300}(at){'b' * 300}.{'c.' * 50}org", [f"{'a' * 300}(at){'b' * 300}.{'c.' * 50}org"]),
    ],
)
def test_what_the_field_finds(text, want):
    assert [text[s:e] for _, s, e in pii.find(text)[1]] == want


def test_long_inputs_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("a.b" * 300_000, "x [at] " * 100_000, "+1 " * 200_000, "a@b " * 100_000 + "c.d " * 100_000, "1-" * 200_000, "ab@c.d 456-7890 " * 20_000):
        pii.find(text)
    assert time.perf_counter() - began < 60


@pytest.fixture(scope="module")
def extractor():
    return html_crf.Decoder(html_crf.train(html_crf.training_pages()))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(8)
    from itertools import product

    for _ in range(40):
        n = int(rng.integers(1, 8))
        unary, same, edges = rng.normal(size=n).tolist(), [False, *(rng.random(n - 1) < 0.5).tolist()], rng.normal(size=(2, 2, 2))
        score = lambda y: sum(u for u, on in zip(unary, y, strict=True) if on) + sum(edges[int(same[i])][int(y[i - 1])][int(y[i])] for i in range(1, n))  # noqa: B023, E731
        got = html_crf.viterbi(unary, same, edges.tolist())
        assert np.isclose(score(got), max(score(y) for y in product([False, True], repeat=n)))


def test_extractor_on_held_out_pages(extractor):
    wrong = total = 0
    for page in html_crf.training_pages(200, seed=77):
        blocks = html_crf.leaf_blocks(page)
        truth = [html_crf._MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(html_crf._MARK, "") or "x"
        got = html_crf.viterbi([extractor.potential(b) for b in blocks], html_crf.same_parent(blocks), extractor.edges)
        wrong += sum(a != b for a, b in zip(got, truth, strict=True))
        total += len(truth)
    assert wrong / total < 0.01


def test_blocks(extractor):
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<div><p>One &amp; <b>two\n three</b><br>four<p>five</div>") == ["One & two three four", "five"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>") == ["a", "b", "c", "d", "e"]
    assert texts("<script>if (a<b) { x('</p>') }</script><style>p{}</style><!-- <p>no</p> --><p>yes") == ["yes"]
    assert extractor.main_text(None) == extractor.main_text("") == extractor.main_text("<p> </p>") == ""
    page = "<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title here</h1><p>First long paragraph, with words. More words.</p><p>Short.</p></article><div class=comments><p>I liked it very much, thank you.</p></div><footer>&copy; us</footer>"
    assert extractor.main_text(page) == "Title here\nFirst long paragraph, with words. More words.\nShort."


ARTICLE = "<article><h1>Title here</h1><p>First long paragraph, with words. More words.</p><p>Second one, too. It ends.</p></article>"
NAV = "<nav><p>Home of all the things, here and there.</p></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<head><title>T</title><body>{ARTICLE}",
        f"<html><head><title>T</title>{ARTICLE}",
        ARTICLE.replace("<p>", "<p><video src=x>", 1),
        f"<div><video></div>{ARTICLE}<svg><object>",
        f"<canvas>{ARTICLE}",
        f"<select>{ARTICLE}",
        f"<title>T{ARTICLE}",
        f"<script>x = 1;{ARTICLE}",
        f"<!-- note {ARTICLE}",
        f"{'<div>' * 60}{NAV}{ARTICLE}",
        f"<nav>{'<div>' * 60}<p>Home of all the things, here and there.</p>{'</div>' * 60}</nav>{ARTICLE}",
        ARTICLE.replace("<p>", '<p title="x>', 1),
        ARTICLE.replace("<p>", '<p title="x>').replace("<h1>", '<h1 class="y">'),
        ARTICLE.replace("<p>", "<p title='it's a' data-x=\"<b>\">"),
        f"<template><p>no</p><template>a</template>b</template>{ARTICLE}",
        f"<video><p>Your browser shows no videos.</p></video>{ARTICLE}",
    ],
)
def test_pages_with_faults_keep_their_article(extractor, page):
    assert extractor.main_text(page) == "Title here\nFirst long paragraph, with words. More words.\nSecond one, too. It ends."


def test_whole_blocks_are_read(extractor):
    long = "word, " * 200_000 + "the end."
    assert extractor.main_text(ARTICLE.replace("Second one, too.", long)).split("\n")[2] == f"{long} It ends."
    assert len(extractor.main_text("<div>" * 50_000 + "<article>" + "<p>A paragraph of it, here.</p>" * 2_000).split("\n")) == 2_000
    # a block about rights is told by all of it, and one mention in a long text is none
    assert "rights" in html_crf.text_features("x " * 3 + "© us. All rights reserved", 0)
    assert "rights" not in html_crf.text_features("copyright " + "x " * 300, 0)


def test_paths_do_not_depend_on_what_was_met_before():
    one, two = html_crf.Paths(), html_crf.Paths()
    html_crf.leaf_blocks(NAV + ARTICLE, two)
    assert [b.path.features for b in html_crf.leaf_blocks(ARTICLE, one)] == [b.path.features for b in html_crf.leaf_blocks(ARTICLE, two)]


def test_rules_separate_and_are_sparse():
    rng = np.random.default_rng(9)
    x = {f"s{i}": rng.random(3000) for i in range(6)}
    y = ((x["s0"] > 0.5) & (x["s1"] <= 0.7)).astype(float)
    model = quality.fit(x, y)
    score = model.bias + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights, strict=True))
    assert ((score > 0) == y).mean() > 0.97
    assert len(model.rules) < len(quality.tree_rules(x, y))
    assert quality.fit({"s": np.zeros(0)}, np.zeros(0)).rules == ()


def test_grams_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = "Größe und Übermut " * 40
    whole = np.sort(np.concatenate(list(langid.text_buckets(text))))
    monkeypatch.setattr(langid, "PIECE", 50)
    assert (np.sort(np.concatenate(list(langid.text_buckets(text)))) == whole).all()


def test_no_alignment_exceeds_its_bound():
    rng = np.random.default_rng(12)
    for _ in range(300):
        item, text = rng.integers(0, 9, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 14, rng.integers(0, 60)).astype(np.uint64)
        assert decontam.align(item, text)[0] <= decontam.most(item, text)
        whole, spared = decontam.best_copy(item, text), decontam.best_copy(item, text, decontam.THRESHOLD)
        assert spared == whole or max(whole[0], spared[0]) < decontam.THRESHOLD


@pytest.mark.parametrize("tail", ["555 0123", "2125550123", "555.0123"])
def test_a_long_document_gets_the_spans_of_its_passages(tail):
    filler = " ".join(f"word {100 + i} of" for i in range(900))
    passages = f"Later {tail} again, {{}} call +1 212 555-0123 today. {{}} Then {tail} once more"
    short, long = passages.format(filler, filler), passages.format(" ".join([filler] * 6), " ".join([filler] * 6))
    assert [(k, long[s:e]) for k, s, e in pii.find(long)[1]] == [(k, short[s:e]) for k, s, e in pii.find(short)[1]]


def test_messages_do_not_depend_on_how_many_are_computed_together(monkeypatch):
    rng = np.random.default_rng(13)
    unary, chain, skip = rng.normal(size=(50, 5)), rng.normal(size=(5, 5)), np.eye(5)
    groups = [[0, 7, 30], [2, 49]]
    whole = pii.infer(unary, chain, skip, groups)
    monkeypatch.setattr(pii, "EDGES", 7)
    assert np.allclose(pii.infer(unary, chain, skip, groups), whole, rtol=0, atol=1e-12)


def test_batches_of_texts_against_plain_naive_bayes(monkeypatch):
    """Against the formula, one text and one n-gram at a time."""
    rng = random.Random(18)
    texts = ["".join(rng.choice("abcdéß ñ.") for _ in range(rng.choice([1, 2, 3, 50, 400]))) for _ in range(60)] + [None, "", "12 !", "a"]
    table = np.random.default_rng(19).random((langid.BUCKETS, 3))
    model = langid.Model(["x", "y", "z"], np.log(table / table.sum(axis=0)).astype(np.float32), np.log(np.array([0.2, 0.3, 0.5])).astype(np.float32))
    for group in (langid.GROUP_GRAMS, 40):
        monkeypatch.setattr(langid, "GROUP_GRAMS", group)
        for text, (lang, score, fit) in zip(texts, langid.judged(model, texts), strict=True):
            if not text or not any(map(str.isalpha, text)):
                assert (lang, score, fit) == ("und", 0.0, -np.inf)
                continue
            points = langid.code_points(text)
            ids = [int(langid.gram_buckets(points[i : i + n])[-1]) for n in langid.ORDERS for i in range(len(points) - n + 1)]
            sums = np.array([sum(float(model.log_prob[g, k]) for g in ids) for k in range(3)])
            total = sums + model.log_prior
            k = int(total.argmax())
            assert lang == model.languages[k]
            assert score == pytest.approx(1 / np.exp(total - total[k]).sum(), rel=1e-5)
            assert fit == pytest.approx(sums[k] / len(ids) - model.usual[k], rel=1e-5, abs=1e-6)


def test_training_counts_equal_plain_counts(spark):
    rows = [(i, "abc abd " * (i % 4), "x" if i % 2 else "y") for i in range(40)] + [(90, None, "x"), (91, "zz", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for k, lang in enumerate(["x", "y"]):
        counts = np.full(langid.BUCKETS, langid.SMOOTHING)
        for _, text, own in rows:
            if own == lang and text:
                for ids in langid.text_buckets(text):
                    np.add.at(counts, ids, 1)
        assert np.allclose(model.log_prob[:, k], np.log(counts / counts.sum()), rtol=1e-5)
