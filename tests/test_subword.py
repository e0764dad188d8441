"""Byte-pair pieces against the plain rule and the public library of the same vocabulary."""

from __future__ import annotations

import base64
import random
import time
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import subword
from tessera.operators import scores
from tessera.plans import catalogue
from tessera.plans.subwords import VOCABULARIES


def plainly(unit: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [unit[i : i + 1] for i in range(len(unit))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def loaded(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(str.split, Path(path).read_text().splitlines())}


def test_merges_are_those_of_the_plain_rule():
    rng = random.Random(1)
    for _ in range(300):
        alphabet = "ab" if rng.random() < 0.5 else "abcé"
        ranks = {bytes([i]): i for i in range(256)}
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choices(list(ranks), k=2) if rng.random() < 0.3 else [rng.choice([k for k in ranks if all(c in alphabet.encode() for c in k)]) for _ in "ab"]
            ranks.setdefault(a + b, len(ranks))
        unit = "".join(rng.choices(alphabet, k=rng.randint(0, 14))).encode()
        assert subword.merged(unit, ranks) == plainly(unit, ranks), (unit, ranks)


def test_a_unit_of_any_length_is_merged_in_little_time():
    ranks = loaded(VOCABULARIES["english"])
    unit = " ".join(f"{i * 7919 % 10007}xyzzy" for i in range(40_000)).replace(" ", "").encode()
    began = time.perf_counter()
    found = subword.merged(unit, ranks)
    assert b"".join(found) == unit and time.perf_counter() - began < 20


@pytest.mark.parametrize("name", sorted(VOCABULARIES))
def test_pieces_are_those_of_the_public_vocabulary(name, spark, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = loaded(VOCABULARIES[name])
    public = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(spark.createDataFrame([("It's  we'll a\tb c's 'tis",), ("",), (" \n",), ("日本語 ñandú 12³ …!?",), (" x",)], "text string"))
    rows = given.select(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("t"), F.flatten(subword.pieces(subword.units(F.col("text")), subword.ranks(spark, VOCABULARIES[name]))).alias("p")).collect()
    for r in rows:
        want = public.encode_ordinary(" " + r["t"]) if r["t"] else []
        assert [bytes.fromhex(p) for p in r["p"]] == [public.decode_single_token_bytes(i) for i in want]


def test_units_are_encoded_once_and_counted_by_group(spark):
    ranks = spark.sparkContext.broadcast({b"ab": 256, b" ab": 257})
    rows = spark.createDataFrame([("x", "ab ab é"), ("y", " ab"), ("y", None), ("x", "")], "g string, text string")
    found = {(r["g"], r["unit"], r["n"], tuple(r["pieces"])) for r in subword.unit_counts(rows, "text", ranks, "g").collect()}
    assert found == {("x", " ab", 2, ("206162",)), ("y", " ab", 1, ("206162",)), ("x", " é", 1, ("20", "c3", "a9"))}


def test_pieces_are_counted_as_numbers():
    rng = random.Random(3)
    vocabulary = SimpleNamespace(value={b"ab": 0, b"abc": 1, b" a": 2, b" ab": 3})
    kind = pa.list_(pa.string())
    drawn = lambda: ["".join(rng.choices("abcé ", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 8))] if rng.random() < 0.8 else None
    plain = lambda rows: pa.array([None if r is None else [p.hex() for u in r for p in subword.merged(u.encode(), vocabulary.value)] for r in rows], kind)
    for n in (0, 1, 7, 40):
        ref, hyp = [drawn() for _ in range(n)], [drawn() for _ in range(n)]
        found = scores.counted(pa.array(ref, kind), pa.array(hyp, kind), 4, subword.numbering(vocabulary))
        assert found == scores.counted(plain(ref), plain(hyp), 4)


def test_pieces_of_a_full_batch_take_little_memory():
    vocabulary = SimpleNamespace(value=loaded(VOCABULARIES["many"]))
    words = pa.array([[f" γwɛw{(i * 7919 + k) % 3000}" for k in range(100)] for i in range(4_000)], pa.list_(pa.string()))
    tracemalloc.start()
    rows = sum(map(len, scores.counting(4, vocabulary)(iter([(words, words)]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4_000 and most < 100 << 20


def test_pieces_of_a_score_stay_in_their_task(spark, sf_dir):
    # arrays of pieces were flattened between Python and the counts
    plan = catalogue.queries()["a14_subword_bleu"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array" in plan and "flatten(" not in plan
