"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fresh

#: Hash buckets of the n-grams, and the n-gram lengths in characters.
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: Labelled texts used for each language at most, chosen by a hash of doc_id: the fit's documented bound.
FIT_TEXTS = 3_000
#: Added to every count.
SMOOTHING = 0.1
#: Characters handled at a time; longer texts go through in pieces that overlap by the longest order.
PIECE = 1 << 18
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """log_prob[bucket, language] and log_prior[language]; the order of languages is alphabetical."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray

    @cached_property
    def columns(self) -> list[np.ndarray]:
        """log_prob by language, each in one stretch of memory."""
        return [np.ascontiguousarray(self.log_prob[:, k]) for k in range(len(self.languages))]

    @cached_property
    def usual(self) -> np.ndarray:
        """For each language, the mean log-probability of an n-gram of its training texts."""
        log_prob = self.log_prob.astype(np.float64)
        return (np.exp(log_prob) * log_prob).sum(axis=0)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces(text: str) -> Iterator[np.ndarray]:
    """The code points of the lower-cased text; each piece starts with the last characters of the one before."""
    points = code_points(text)
    lap = max(ORDERS) - 1
    if len(points) <= PIECE:
        yield points
        return
    for start in range(0, len(points), PIECE):
        yield points[max(0, start - lap) : start + PIECE]


def gram_buckets(points: np.ndarray, lap: int = 0) -> np.ndarray:
    """The bucket of each n-gram of all orders that ends after the first lap characters."""
    found = []
    x = points.astype(np.uint64)
    for order in ORDERS:
        if len(x) < order:
            continue
        h = np.full(len(x) - order + 1, order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for k in range(order):
            h = (h ^ x[k : len(x) - order + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
        found.append((h[max(0, lap - order + 1) :] & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def text_buckets(text: str) -> Iterator[np.ndarray]:
    for i, piece in enumerate(pieces(text)):
        yield gram_buckets(piece, 0 if i == 0 else max(ORDERS) - 1)


def train(labelled: DataFrame) -> Model:
    """Fits on (doc_id, text, lang). Texts per language are bounded by FIT_TEXTS through a hash of doc_id;
    each task sends one sparse count vector for each language it meets, so the driver gets bounded data."""
    bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, FIT_TEXTS / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = known.where(draw < share).select("lang", "text")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for ids in text_buckets(text):
                    own += np.bincount(ids, minlength=BUCKETS)
        for lang, own in total.items():
            ids = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": ids.astype(np.int32), "n": own[ids]})

    summed = sample.mapInPandas(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        own = summed[summed["lang"] == lang]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    prior = np.array([sizes[x] for x in languages], dtype=float)
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()).astype(np.float32))


#: N-grams that are scored together; a group of texts has a few more at most, one long text is scored in pieces.
GROUP_GRAMS = 1 << 18


def text_sums(model: Model, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the log-probabilities of each text's n-grams by language, and their numbers.

    Texts are gathered into sparse batches: the bucket ids of all, and where each piece of a text begins; one gather and
    one segmented sum then score a batch."""
    sums, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), dtype=np.int64)
    ids: list[np.ndarray] = []
    owner: list[int] = []
    held = 0

    def score() -> None:
        nonlocal held
        if ids:
            begins = np.cumsum([0, *map(len, ids[:-1])])
            flat = np.concatenate(ids)
            for k in range(len(model.languages)):
                np.add.at(sums[:, k], owner, np.add.reduceat(model.columns[k][flat], begins, dtype=np.float64))
            np.add.at(sizes, owner, [len(x) for x in ids])
            ids.clear()
            owner.clear()
            held = 0

    for i, text in enumerate(texts):
        for piece in text_buckets(text):
            if len(piece):
                ids.append(piece)
                owner.append(i)
                held += len(piece)
            if held >= GROUP_GRAMS:
                score()
    score()
    return sums, sizes


def judged(model: Model, texts: Sequence[str | None]) -> list[tuple[str, float, float]]:
    """For each text the likeliest language, its posterior, and how well it fits: the mean log-probability of the text's
    n-grams less that of the language's training texts. (und, 0, -inf) for texts that are null or without a letter."""
    out = [(UNDETERMINED, 0.0, -np.inf)] * len(texts)
    known = [i for i, t in enumerate(texts) if t is not None and model.languages and any(map(str.isalpha, t))]
    if known:
        sums, sizes = text_sums(model, [texts[i] for i in known])
        score = sums + model.log_prior.astype(np.float64)
        best = score.argmax(axis=1)
        rows = np.arange(len(known))
        post = 1.0 / np.exp(score - score[rows, best][:, None]).sum(axis=1)
        fit = sums[rows, best] / sizes - model.usual[best]
        for i, k, p, f in zip(known, best.tolist(), post.tolist(), fit.tolist(), strict=True):
            out[i] = (model.languages[k], p, f)
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score", fit: str | None = None) -> DataFrame:
    """docs with the columns label and score added, and on demand the fit. Whole texts are scored; repeated rows get equal
    results; a null text or one without letters is `und` with score 0; an empty table stays empty; columns of docs with
    the names of added ones are replaced, all others stay. The model is broadcast: BUCKETS x languages floats."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("label string, score double, fit double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judged(shared.value, list(texts)), columns=["label", "score", "fit"])

    own = fresh(docs, "_predicted")
    # marked so that a test of its result does not make it run twice
    found = docs.withColumn(own, predict.asNondeterministic()(F.col(text)))
    added = {label: F.col(f"{own}.label"), score: F.col(f"{own}.score")} | ({fit: F.col(f"{own}.fit")} if fit else {})
    return found.withColumns(added).drop(own)


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of doc_id as text falls into that part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
