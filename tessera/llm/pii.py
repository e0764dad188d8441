"""Personal data: pattern spans plus those of a skip-chain conditional random field.

The chain runs over the candidate tokens of a text: numbers, spelled-out addresses, and words that repeat the name of an
address of the text. All other tokens are observed as O, since every potential of theirs for another label is minus
infinity. Beside the edge to the neighbouring candidate, equal or similar candidates share a skip potential
wherever they stand, and loopy sum-product message passing makes their labels agree: a bare number or name that says
nothing by itself is found where the text has it in full elsewhere. Base spans are observed variables.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone")
#: The labels of the field; O first.
LABELS = ("O", *KINDS)

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that starts inside a run of digits exists only if one starts with the run, so runs are tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each @ sign is tried once with the longest local part that the last match leaves free."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """The pattern spans by start, then in the order of KINDS."""
    found = emails(text) if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: Candidates of the field: spelled-out addresses, runs of digits with separators, and names (words with a mark or a digit inside).
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)\x20?[\[(]at[\])]\x20?([A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)+)")
SPELLED_DOT = re.compile(r"\x20?[\[(]dot[\])]\x20?")
NUMBER = re.compile(r"[(+]?[0-9](?:[\x20().-]{0,3}[0-9])*")
NAME = re.compile(r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z])[A-Za-z0-9]++(?:[._+-][A-Za-z0-9]++)*+(?![A-Za-z0-9_%+@-])")
CUES = {
    "email": re.compile(r"e-?mail|contact|write to|correo|courriel|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse", re.I),
    "card": re.compile(r"card|visa|iban|carte|karte|tarjeta|account", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|fax|mobile|téléphone|telefon|tel[ée]fono", re.I),
}
CUE_CHARS = 24
#: Last digits that similar numbers have in common, and the least length of shorter ones and of names.
SKIP_TAIL, SKIP_LEAST = 7, 4


def features(text: str, start: int, end: int) -> list[str]:
    """What a candidate's own potential sees: its shape and the words before it."""
    token = text[start:end]
    digits = [c for c in token if "0" <= c <= "9"]
    n = len(digits)
    found = ["bias", f"digits:{n if n < 8 else '8-9' if n < 10 else '10-13' if n < 14 else '14-19' if n < 20 else '20+'}"]
    found += [name for name, hit in (("at", re.search(r"[\[(]at[\])]", token)), ("plus", token[0] == "+"), ("paren", "(" in token), ("dash", "-" in token), ("blank", " " in token)) if hit]
    if "a" <= token[0].lower() <= "z" and not found[2:]:
        found.append("name")
    if token.count(".") == 3 and n >= 4:
        parts = token.split(".")
        found.append("quad" if all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else "dots3")
    if 14 <= n <= 19 and luhn("".join(digits)):
        found.append("luhn")
    before = text[max(0, start - CUE_CHARS) : start]
    found += [f"cue:{kind}" for kind, cue in CUES.items() if cue.search(before)]
    return found


def keys_of(text: str, start: int, end: int) -> list[str]:
    """What a candidate shares with those like it: the folded address and its name, or the digits: their last
    SKIP_TAIL (a number with or without its prefix), or all of fewer."""
    token = text[start:end]
    spelled = ADDRESS.fullmatch(token)
    name, _, domain = (f"{spelled[1]}@{SPELLED_DOT.sub('.', spelled[2])}" if spelled else token).lower().partition("@")
    if domain:
        return [f"@{name}@{domain}", f"@{name}"] if telling(name) else [f"@{name}@{domain}"]
    if "a" <= name[:1] <= "z":
        return [f"@{name}"]
    digits = "".join(c for c in token if "0" <= c <= "9")
    return [digits[-SKIP_TAIL:]] if len(digits) >= SKIP_TAIL else [f"={digits}"] if len(digits) >= SKIP_LEAST else []


def telling(name: str) -> bool:
    """Whether a name is more than a plain word: with a mark or a digit inside."""
    return not name.isalpha() and "a" <= name[:1] <= "z" and len(name) >= SKIP_LEAST


def skip_groups(keys: list[list[str]], seen: list[bool] | None = None) -> list[list[int]]:
    """Candidates that share potentials, by key. Each group is a star around its first observed member, or its first, so
    that edges grow with its size only; a group with the members of another is that one."""
    by: dict[str, list[int]] = defaultdict(list)
    for i, own in enumerate(keys):
        for key in own:
            by[key].append(i)
    groups = []
    for g in dict.fromkeys(tuple(g) for g in by.values() if len(g) > 1):
        hub = next((i for i in g if seen and seen[i]), g[0])
        groups.append([hub, *(i for i in g if i != hub)])
    return groups


#: Edges whose messages are computed together; a round takes all edges, so this bounds memory only.
EDGES = 1 << 14


def infer(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, groups: list[list[int]], rounds: int = 12) -> np.ndarray:
    """Marginals of the field by loopy sum-product in log space; unary[i, label], edge tables [label, label]."""
    n, k = unary.shape
    heads = np.repeat(np.array([g[0] for g in groups], dtype=np.int64), [len(g) - 1 for g in groups])
    tails = np.fromiter((j for g in groups for j in g[1:]), dtype=np.int64, count=len(heads))
    left, right = np.concatenate([np.arange(n - 1), heads]), np.concatenate([np.arange(1, n), tails])
    if not len(left):
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    both, which = np.stack([chain, skip]), (np.arange(len(left)) >= n - 1).astype(np.int64)
    forward, back = np.zeros((len(left), k)), np.zeros((len(left), k))
    to_right, to_left = np.empty_like(forward), np.empty_like(back)

    def reduce(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=1, keepdims=True)
        out = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
        return out - out.max(axis=1, keepdims=True)

    belief = unary.copy()
    for _ in range(rounds):
        for at in range(0, len(left), EDGES):
            own = slice(at, at + EDGES)
            tables = both[which[own]]
            to_right[own] = reduce((belief[left[own]] - back[own])[:, :, None] + tables)
            to_left[own] = reduce((belief[right[own]] - forward[own])[:, :, None] + tables.transpose(0, 2, 1))
        moved = max(np.abs(to_right - forward).max(), np.abs(to_left - back).max())
        # damping keeps cycles of skip edges from swinging
        forward, back = 0.5 * forward + 0.5 * to_right, 0.5 * back + 0.5 * to_left
        belief = unary.copy()
        np.add.at(belief, right, forward)
        np.add.at(belief, left, back)
        if moved < 1e-4:
            break
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def training_texts(n: int = 1_000, seed: int = 17) -> list[tuple[str, list[Span]]]:
    """Labelled texts made from templates: entities with and without cues; repeats in a shape that says nothing by
    itself, and the same shapes without a partner; numbers that are no personal data (years, prices, order numbers)."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 8)))

    def card() -> str:
        body = "4" + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    made = []
    for _ in range(n):
        text, spans = "", []

        def put(kind: str | None, token: str) -> None:
            nonlocal text
            text += " "
            if kind:
                spans.append((kind, len(text), len(text) + len(token)))
            text += token

        def fill(low: int, high: int) -> None:
            for _ in range(rng.integers(low, high)):
                put(None, word())

        def repeats(kind: str | None, *forms: str) -> None:
            for form in forms:
                fill(1, 6)
                put(kind, form)

        for _ in range(rng.integers(2, 6)):
            fill(2, 9)
            draw = rng.integers(0, 12)
            if draw == 0:
                area, tail = digits(3), f"{digits(3)}-{digits(4)}"
                put(None, "call")
                put("phone", f"+{rng.integers(1, 99)} {area} {tail}")
                repeats("phone", *[[tail, area + tail.replace("-", ""), tail.replace("-", " "), tail.replace("-", "")][rng.integers(0, 4)] for _ in range(rng.integers(0, 3))])
            elif draw == 1:
                put(None, "card")
                number = card()
                four = [number[i : i + 4] for i in range(0, 16, 4)]
                put("card", " ".join(four))
                repeats("card", ".".join(four))
            elif draw == 2:
                quad = [str(x) for x in rng.integers(1, 256, 4)]
                put("ip", ".".join(quad))
                repeats("ip", "-".join(quad))
            elif draw in (3, 4):
                name, host = (f"{word()}{'._-'[rng.integers(0, 3)]}{word()}" if rng.random() < 0.7 else word()), f"{word()}.{['com', 'org', 'net'][rng.integers(0, 3)]}"
                spelled = f"{name} [at] {host}" if rng.random() < 0.5 else f"{name}(at){host.replace('.', ' [dot] ')}"
                put("email", spelled if draw == 3 else f"{name}@{host}")
                for _ in range(rng.integers(0, 3)):
                    repeats(None, *[f"{word()}{'._-'[rng.integers(0, 3)]}{word()}"] * rng.integers(1, 3))
                if telling(name) and rng.random() < 0.6:
                    repeats("email", name)
            elif draw == 5:
                put(None, "phone")
                put("phone", f"({digits(3)}) {digits(3)}-{digits(4)}")
            elif draw in (6, 7, 8):
                # the same shapes as the repeats above, with no partner that tells: they are no personal data
                tail = f"{digits(3)}-{digits(4)}"
                shapes = [tail, digits(10), digits(7), tail.replace("-", " "), ".".join(digits(4) for _ in range(4)), "-".join(str(x) for x in rng.integers(1, 256, 4)), f"{word()}.{word()}"]
                token = shapes[rng.integers(0, len(shapes))]
                put(None, token)
                if rng.random() < 0.5:
                    repeats(None, token)
            else:
                put(None, [f"{rng.integers(1900, 2030)}", f"{digits(2)}.{digits(2)}", digits(5), digits(3), f"{digits(1)}.{digits(1)}.{digits(1)}", digits(9)][rng.integers(0, 6)])
        made.append((text, spans))
    return made


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, str | None]]:
    """Start, end and observed kind of the field's variables, by start. Base spans are observed variables;
    another candidate must not touch one. Names are variables of texts with an address: in others nothing tells them
    from words."""
    found: list[tuple[int, int, str | None]] = []
    drawn = [(s, e, kind) for kind, s, e in base]
    if "(at)" in text or "[at]" in text:
        drawn += [(*m.span(), None) for m in ADDRESS.finditer(text)]
    if any(kind in (None, "email") for _, _, kind in drawn):
        drawn += [(*m.span(), None) for m in NAME.finditer(text) if telling(m[0].lower())]
    drawn += [(*m.span(), None) for m in NUMBER.finditer(text)]
    end = 0
    starts = sorted(s for _, s, _ in base)
    i = 0
    for s, e, kind in sorted(drawn, key=lambda c: (c[0], c[2] is None)):
        while i < len(starts) and starts[i] < s:
            i += 1
        if kind or (s >= end and not (i < len(starts) and starts[i] < e)):
            found.append((s, e, kind))
            end = max(end, e)
    return found


Model = tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]
_LEARNED: dict[str, Model] = {}


def model() -> Model:
    """The field's weights, learned once in a process or set from the driver's."""
    if "model" not in _LEARNED:
        _LEARNED["model"] = learn()
    return _LEARNED["model"]


def learn() -> Model:
    """Feature weights and the two edge tables, by pseudo-likelihood: each label that is not observed is predicted from
    its features, its chain neighbours and its skip neighbours, all at their true labels."""
    names: dict[str, int] = {}
    rows, context, labels = [], [], []
    # each text counts twice: with its base spans observed, and without, as where a base pattern just fails
    for (text, spans), seen_base in product(training_texts(), (True, False)):
        true = {(s, e): k for k, s, e in spans}
        own = candidates(text, base_spans(text) if seen_base else [])
        y = [LABELS.index(kind or true.get((s, e), "O")) for s, e, kind in own]
        near: list[list[tuple[int, int]]] = [[] for _ in own]
        for i in range(len(own) - 1):
            near[i].append((0, y[i + 1]))
            near[i + 1].append((0, y[i]))
        for g in skip_groups([keys_of(text, s, e) for s, e, _ in own], [kind is not None for _, _, kind in own]):
            for j in g[1:]:
                near[g[0]].append((1, y[j]))
                near[j].append((1, y[g[0]]))
        for (s, e, kind), label, links in zip(own, y, near, strict=True):
            if kind:
                continue
            rows.append([names.setdefault(f, len(names)) for f in features(text, s, e)])
            context.append(links)
            labels.append(label)
    k = len(LABELS)
    x = np.zeros((len(rows), len(names)))
    for i, own_features in enumerate(rows):
        x[i, own_features] = 1
    seen = np.zeros((2, len(rows), k))
    for i, links in enumerate(context):
        for edge, label in links:
            seen[edge, i, label] += 1
    target = np.eye(k)[labels]
    w, t = np.zeros((len(names), k)), np.zeros((2, k, k))
    for step in range(800):
        score = x @ w + seen[0] @ t[0] + seen[1] @ t[1]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        gap = target - p / p.sum(axis=1, keepdims=True)
        rate = 3.0 / math.sqrt(1 + step / 50)
        w += rate * (x.T @ gap / len(rows) - 1e-4 * w)
        for edge in range(2):
            grad = seen[edge].T @ gap / len(rows)
            t[edge] += rate * ((grad + grad.T) / 2 - 1e-4 * t[edge])
    return {name: w[i] for name, i in names.items()}, t[0], t[1]


#: A candidate joins the result if its marginal for a kind reaches this.
ACCEPT = 0.7


def field_spans(text: str, base: list[Span]) -> list[Span]:
    """The spans that the field adds to the base ones."""
    if not (DIGIT.search(text) or "@" in text or "(at)" in text or "[at]" in text):
        return []
    weights, chain, skip = model()
    own = candidates(text, base)
    if all(c[2] for c in own):
        return []
    zero = np.zeros(len(LABELS))
    unary = np.empty((len(own), len(LABELS)))
    for i, (s, e, kind) in enumerate(own):
        if kind:
            unary[i] = -50.0
            unary[i, LABELS.index(kind)] = 0.0
        else:
            unary[i] = sum((weights.get(f, zero) for f in features(text, s, e)), zero)
    marginals = infer(unary, chain, skip, skip_groups([keys_of(text, s, e) for s, e, _ in own], [kind is not None for _, _, kind in own]))
    best = marginals.argmax(axis=1)
    return [(LABELS[k], s, e) for (s, e, kind), k, p in zip(own, best.tolist(), marginals.max(axis=1).tolist(), strict=True) if not kind and k and p >= ACCEPT]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start, then in the order of KINDS."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + field_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with each covered stretch replaced by its first span's kind in brackets."""
    if not spans:
        return text
    out, end = [], 0
    for kind, s, e in spans:
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"


def with_pii(docs: DataFrame, text: str = "text", target: str = "pii") -> DataFrame:
    """docs with a struct column `target`: counts and digest of the base spans, all spans, the masked text.

    Offsets are code points, ends exclusive. A null text has no spans and stays null when masked; whole
    texts of any length are read; repeated rows get equal results; an empty table stays empty; a column of that name that
    docs has is replaced, all others stay.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        _LEARNED["model"] = shared.value
        out = []
        for t in texts:
            base, spans = find(t)
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), mask(t, spans)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in FOUND.split(", ")])

    return docs.withColumn(target, scan(F.col(text)))
