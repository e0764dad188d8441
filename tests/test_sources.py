"""Readers, sinks, the catalogue and the stream on files written by the tests."""

from __future__ import annotations

import datetime as dt
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue
from tessera.sources import readers, registry, sinks
from tessera.streaming import events


def put(folder, name: str, content: str) -> str:
    path = folder / name
    path.write_text(content, encoding="utf-8")
    return f"file://{path}"


def test_json_lines_and_documents(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"text": "x", "n": {"a": 1, "deep": {"b": true, "c": {"d": 2}}}, "list": [1]}\n\nnot json\n{"text": "y"}\n')
    flat = readers.flattened(readers.by_suffix(spark, path).where("text IS NOT NULL"))
    assert set(flat.columns) >= {"text", "n.a", "n.deep.b"} and "list" not in flat.columns and "n.deep.c.d" not in flat.columns
    assert {r["text"] for r in flat.collect()} == {"x", "y"}
    array = put(tmp_path, "b.json", '[{"t": 1}, {"t": 2}]')
    assert readers.by_suffix(spark, array).count() == 2
    with pytest.raises(readers.ReadError):
        readers.by_suffix(spark, "x.pdf")


def test_delimited(spark, tmp_path):
    titled = readers.by_suffix(spark, put(tmp_path, "a.tsv", '﻿kab\teng\n"azul\thello "you"\n'))
    assert titled.columns == ["kab", "eng"]
    assert titled.first() == ('"azul', 'hello "you"')
    bare = readers.by_suffix(spark, put(tmp_path, "b.tsv", "a whole sentence here\tanother one\n"))
    assert bare.columns == ["col0", "col1"] and bare.count() == 1
    assert [r["text"] for r in readers.by_suffix(spark, put(tmp_path, "c.txt", " one \n\n two\n")).collect()] == ["one", "two"]
    wide = readers.exact_width(spark, put(tmp_path, "d.txt", "a|b|c\nshort|x\na|b|c|d\n"), "|", ["x", "y", "z"])
    assert wide.collect() == [("a", "b", "c")]


def bundle(tmp_path, name: str, members: dict[str, str]) -> str:
    path = tmp_path / name
    with zipfile.ZipFile(path, "w") as z:
        for member, content in members.items():
            z.writestr(member, content)
    return f"file://{path}"


def test_zip_bundles(spark, tmp_path):
    good = bundle(tmp_path, "x.zip", {"T.en-kab.kab": "a\n\nc\n", "T.en-kab.en": "A\nB\nC\n", "T.xml": "<x/>"})
    assert [r["text"] for r in readers.by_suffix(spark, good).collect()] == ["a", "c"]
    assert [(r["line"], r["kab"], r["en"]) for r in readers.zip_pairs(spark, good, "kab", "en").collect()] == [(0, "a", "A"), (2, "c", "C")]
    bad = bundle(tmp_path, "y.zip", {"T.en-kab.kab": "a\n", "T.en-kab.en": "A\nB\n"})
    with pytest.raises(Exception, match="lines"):
        readers.zip_pairs(spark, bad, "kab", "en").collect()


def test_bundles_are_written_by_their_tasks(spark, tmp_path):
    """An archive from each task with rows, none from a failed one; sides stay aligned, also where one is missing."""
    pairs = [(f"T{i % 3}.en-kab", f"k {i} ɣ" if i % 5 else None, f"e {i}" if i % 7 else "") for i in range(1000)]
    df = spark.createDataFrame(pairs, "stem string, kab string, en string").repartition(4)
    path = f"file://{tmp_path}/bundles"
    sinks.zip_pairs(df, "stem", "kab", "en", path)
    names = [p.name for p in (tmp_path / "bundles").iterdir()]
    assert len(names) == 4 and all(n.endswith(".zip") and n[0] != "_" for n in names)
    got = [(r["member"], r["kab"], r["en"]) for r in readers.zip_pairs(spark, path, "kab", "en").collect()]
    assert sorted(got) == sorted((f"{stem}.kab", kab, en) for stem, kab, en in pairs if kab and en)
    sinks.zip_pairs(df.where("stem = 'none'"), "stem", "kab", "en", f"{path}-of-nothing")
    assert readers.zip_pairs(spark, f"{path}-of-nothing", "kab", "en").collect() == []
    for wrong, message in ((F.lit("a\nb"), "line break"), (F.lit("c"), "no path below")):
        broken = df.withColumn("kab", wrong).withColumn("stem", F.lit("../out") if "path" in message else F.col("stem"))
        with pytest.raises(Exception, match=message):
            sinks.zip_pairs(broken, "stem", "kab", "en", f"{path}-{message.split()[0]}")
        assert not list(tmp_path.glob(f"bundles-{message.split()[0]}/*"))


def test_turns_are_bundled_without_the_driver(spark, tmp_path, monkeypatch):
    """What the driver gets is the archives' paths, no text of a turn, and turns of every number or none are kept."""
    turns = [(c, 2 * k + i, role, None if (c, k) == (5, 1) else f"{role} {c}  {k}") for c in (-3, 0, 5, 6, 11, None) for k in range(3) for i, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    frame, seen = type(spark.range(0)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (seen.append(self.columns), collect(self))[1])
    found = catalogue.queries()["s09_turns_by_member"](spark, str(tmp_path))
    assert seen == [["path"]]
    monkeypatch.undo()
    number = lambda c: "NULL" if c is None else str(c % 4 if c > 0 else -(-c % 4))
    want = [(None if c is None else f"part{number(c)}.en-kab.kab", f"user {c} {k}", f"assistant {c} {k}", 1) for c in (-3, 0, 5, 6, 11, None) for k in range(3) if (c, k) != (5, 1)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


BLOCK = "# sent_id = s1\n1-2\tdu\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No\n1\tde\tde\tADP\t_\t_\t_\t_\t_\t_\n2\tle\tle\tDET\t_\tA=1\t_\t_\t_\t_\n2.1\tx\tx\tX\t_\t_\t_\t_\t_\t_\n3\tpain\tpain\tNOUN\t_\t_\t_\t_\t_\t_"


def test_treebank(spark, tmp_path):
    path = put(tmp_path, "t.conllu", BLOCK + "\n\n# sent_id = s2\n1\tOui\toui\tINTJ\t_\t_\t_\t_\t_\t_\n\n")
    rows = {r["sent_id"]: r for r in readers.by_suffix(spark, path).collect()}
    assert [w["form"] for w in rows["s1"]["words"]] == ["de", "le", "pain"]
    assert [(t["form"], t["first"], t["last"], t["space_after"]) for t in rows["s1"]["tokens"]] == [("du", 1, 2, False), ("pain", 3, 3, True)]
    assert readers.treebank_words(readers.treebank(spark, path)).count() == 4
    for broken in ("1\ta\tb", BLOCK.replace("1-2", "2-1"), BLOCK.replace("\n3\t", "\n4\t")):
        with pytest.raises(readers.ReadError):
            readers.parse_block(broken)


def test_dictionaries(spark, tmp_path):
    rows = readers.hunspell(spark, put(tmp_path, "d.dic", "2\nargaz/AB po:noun st:argaz\nddu\n")).collect()
    assert [(r["form"], r["flags"], r["upos"]) for r in rows] == [("argaz", "AB", "noun"), ("ddu", None, None)]
    posts = put(tmp_path, "p.csv", 'post_title,post_content\naxxam,"<p>house</p> plural: ixxamen\nannexed: uxxam"\nword,<b>gloss</b>\n')
    got = {(r["head"], r["form"], r["kind"]) for r in readers.dictionary_posts(spark, posts).collect()}
    assert got == {("axxam", "axxam", "head"), ("axxam", "ixxamen", "plural"), ("axxam", "uxxam", "annexed"), ("word", "word", "head")}
    pages = put(tmp_path, "w.xml", "<mediawiki><page><title>A</title><revision><text>Hello</text></revision></page></mediawiki>")
    assert readers.by_suffix(spark, pages).collect() == [("A", "Hello")]


def test_dump_pages_of_odd_texts_equal_their_sql(spark, tmp_path):
    odd = ["plain", "", None, " \n\t", "\ra", "a\r", " \r ", "a\r\nb", "\x0bx\x0c", " a\x01b ", "\x00", "a\ufffeb", "\ufdd0", "%41\x1f+ %", "a & b < c ]]>", "\u3000wide\u00a0", "null"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()["s15_dump_pages"]).fetchall()
    assert sorted(map(tuple, catalogue.queries()["s15_dump_pages"](spark, str(tmp_path)).collect())) == sorted(want)
    assert len(want) == len(odd) - 3


def test_directions_and_clusters(spark):
    rows = spark.createDataFrame([("a", "b", "kab-eng"), ("c", "d", "fra-kab"), (" ", "e", "kab-eng")], "source string, target string, direction string")
    assert {tuple(r) for r in readers.directed(rows, "kab").collect()} == {("a", "b", "eng"), ("d", "c", "fra")}
    with pytest.raises(Exception, match="malformed"):
        readers.directed(spark.createDataFrame([("a", "b", "kabeng")], rows.schema), "kab").collect()
    c = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "z")], "group int, sentence string")
    assert {(r["cluster"], tuple(r["texts"])) for r in readers.clusters(c, ["cluster", "group"], ["text", "sentence"]).collect()} == {("1", ("x", "y")), ("2", ("z",))}


def test_speech(spark, tmp_path):
    tsv = put(tmp_path, "s.tsv", "client_id\tpath\tsentence\nc1\ta.mp3\tazul\nc2\tb.mp3\textra\ttab\nc3\tc.mp3\tno length\n")
    times = put(tmp_path, "d.tsv", "clip\tduration[ms]\na.mp3\t400\n")
    got = {r["path"]: r["duration_ms"] for r in readers.speech_rows(spark, tsv, times, ["client_id", "path", "sentence"]).collect()}
    assert got == {"a.mp3": 400, "c.mp3": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a  b\nc", "train"), ("d", "dev")], "text string, split string")
    out = f"file://{tmp_path}/out"
    sinks.release(df, ["text"], out)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("a  b\nc", "train"), ("d", "dev")}
    with pytest.raises(sinks.SinkError):
        sinks.release(df, ["text", "missing"], out)
    with pytest.raises(sinks.SinkError):
        sinks.non_empty(df.limit(0), out)
    sinks.plain_text(df, "text", f"{out}-text")
    assert sorted(r[0] for r in spark.read.text(f"{out}-text").collect()) == ["a b c", "d"]
    sinks.filelist(spark.createDataFrame([("a.wav", "t", 1)], "audio string, text string, speaker int"), f"{out}-list")
    for bad in ((" ", "t", 1), ("a", "t|u", 1), ("a", "t", None)):
        with pytest.raises(sinks.SinkError):
            sinks.filelist(spark.createDataFrame([bad], "audio string, text string, speaker int"), out)
    assert sinks.checksums(spark, f"{out}-list").where("length(sha256) = 64").count() >= 1
    ids = sinks.token_stream(df, "text", lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x)), 0, 0.5).collect()
    assert all(r["ids"][-1] == 0 for r in ids)


def entry(i: str, **more) -> dict:
    return {"id": i, "name": i, "modality": "text", "tier": "core", "access": "open", "uri": "u", "licence": "CC0-1.0 ", "languages": ["kab_Latn"], "size": {"rows": 5}, "retrieved": dt.date(2024, 1, 1)} | more


def test_catalogue(spark):
    cat = registry.load(spark, [entry("a"), entry("b", licence="ODbL"), entry("c", licence="own terms"), entry("d", modality="speech"), entry("e", tier="excluded"), entry("f", tier="supplementary", languages=["fr"])])
    assert [r["id"] for r in registry.eligible(cat, ["zz"]).collect()] == ["a", "f", "b", "c"]
    assert {r["id"] for r in registry.find(cat, language="kab", modality="text", tier="core").collect()} == {"a", "b", "c"}
    assert registry.permissive(cat).count() == 4
    for broken in ([entry("a"), entry("a")], [entry("a", colour=1)], [entry("a", size={})]):
        with pytest.raises(registry.RegistryError):
            registry.load(spark, broken)
    places = spark.createDataFrame([("core", "text", "a.txt", 5), ("core", "speech", "a.tar.gz", 5), ("core", "speech", "a.tsv", 5), ("core", "text", "b.pdf", 5), ("core", "text", "c.bin", 3 << 30), ("excluded", "text", "a", 1)], "t string, m string, p string, s long")
    assert [r[0] for r in places.select(registry.placement(F.col("t"), F.col("m"), F.col("p"), F.col("s"))).collect()] == ["local", "remote", "local", "remote", "remote", "none"]
    shares = {r["redistribution"]: r["share"] for r in registry.compose(spark.createDataFrame([("a", 6), ("b", 3), ("?", 1)], "source_id string, kept long"), cat).collect()}
    assert shares == {"permissive": 0.6, "share-alike": 0.3, "unregistered": 0.1}


def test_manifest_state(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    man = spark.createDataFrame([("s", "p", "h1", "k", "t", 1, t(1)), ("s", "p", "h2", "k", "t", 1, t(5)), ("s", "q", "h3", "k", "t", 1, t(1))], registry.MANIFEST)
    rem = spark.createDataFrame([("s", "p", "h1", "r", t(3)), ("s", "q", "h3", "r", t(3))], registry.REMOVAL)
    assert [r["path"] for r in registry.standing_removals(man, rem).collect()] == ["q"]
    dfr = spark.createDataFrame([("s", "old", "", t(1)), ("x", "a", "", t(1)), ("x", "b", "", t(2))], registry.DEFERRAL)
    assert [(r["source_id"], r["reason"]) for r in registry.active_deferrals(man, dfr).collect()] == [("x", "b")]
    disk = spark.createDataFrame([("p", "h2"), ("q", "h3"), ("new", "h9")], "path string, sha256 string")
    assert {r["path"]: r["verdict"] for r in registry.verify(disk, man, rem).collect()} == {"p": "ok", "q": "resurrected", "new": "unrecorded"}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{tmp_path}/in"
    batch.repartitionByRange(3, "ts").write.parquet(folder)
    stream = events.windowed_counts(events.read(spark, folder, batch.schema, 1), "1 day", "60 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    run.processAllAvailable()
    run.stop()
    want = batch.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    got = spark.table("counted").select("start", "event_type", "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    once = events.first_arrivals(events.read(spark, folder, batch.schema), ["event_id"], "60 days").select("event_id")
    job = events.append(once, f"{tmp_path}/out", f"{tmp_path}/state").start()
    job.processAllAvailable()
    job.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.select("event_id").distinct().count()


def test_benchmark_splits(spark, tmp_path):
    for split, rows in (("dev", '{"id": 0, "text": "a", "topic": "t"}\n\n{"id": 1, "text": "b"}\n'), ("devtest", '{"id": 0, "text": "c"}\n'), ("bare", "\n")):
        (tmp_path / split).mkdir()
        put(tmp_path / split, "kab_Latn.jsonl", rows)
    got = readers.splits(spark, f"file://{tmp_path}", "kab_Latn", ["dev", "devtest"]).collect()
    assert sorted((r["split"], r["id"], r["text"], r["topic"]) for r in got) == [("dev", 0, "a", "t"), ("dev", 1, "b", ""), ("devtest", 0, "c", "")]
    with pytest.raises(readers.ReadError, match="not there"):
        readers.splits(spark, f"file://{tmp_path}", "kab_Latn", ["dev", "gone"])
    with pytest.raises(readers.ReadError, match="no sentence"):
        readers.splits(spark, f"file://{tmp_path}", "kab_Latn", ["bare"])


def test_pair_layouts(spark):
    both = spark.createDataFrame([("azul", "hello", None), ("a", None, "b"), (" ", "x", None), ("c", None, None)], "kab string, eng string, fra string")
    assert {tuple(r) for r in readers.pair_rows(both).collect()} == {("azul", "hello", "eng"), ("a", "b", "fra")}
    named = spark.createDataFrame([("x", "y", "eng", "kab"), ("k", "l", "kab", "fra")], "source string, target string, source_lang string, target_lang string")
    assert {tuple(r) for r in readers.pair_rows(named).collect()} == {("y", "x", "eng"), ("k", "l", "fra")}
    bare = spark.createDataFrame([("x", "y")], "src_text string, tgt_text string")
    assert readers.pair_rows(bare, named="kab-eng.jsonl").collect() == [("x", "y", "eng")]
    assert readers.pair_rows(bare, named="fr.jsonl").collect() == [("y", "x", "fra")]


def test_strict_readers(spark, tmp_path):
    good = put(tmp_path, "t.jsonl", '{"text": "a"}\n\n{"text": "b", "n": 1}\n')
    assert [r[0] for r in readers.texts(spark, good).collect()] == ["a", "b"]
    for k, broken in enumerate(('{"text": "a"}\n{"text": "b', '{"other": 1}\n')):
        with pytest.raises(Exception, match="no record with a text"):
            readers.texts(spark, put(tmp_path, f"bad{k}.jsonl", broken)).collect()
    with pytest.raises(Exception, match="lacks a field"):
        readers.filelist(spark, put(tmp_path, "f.txt", "a|b|1\n |b|1\n")).collect()
    lines = put(tmp_path, "o.txt", 'plain\n{"kab": " k "}\n{"text": "t", "kab": "k"}\n{broken\n\n{"other": 1}\n')
    assert [r[0] for r in readers.set_lines(spark, lines).collect()] == ["plain", "k", "t", '{"other": 1}']


def test_split_and_lexicon_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "dev"), (3, "train")], "k long, split string")
    assert sinks.splits(rows, f"file://{tmp_path}/s", ["train", "dev"], "k") == {"train": 2, "dev": 1}
    for bad, key in ((rows.where("split = 'train'"), None), (rows.unionByName(rows.selectExpr("k", "'dev' AS split")), "k")):
        with pytest.raises(sinks.SinkError):
            sinks.splits(bad, f"file://{tmp_path}/t", ["train", "dev"], key)
    none = spark.createDataFrame([], "form string, lemma string, upos string, feats map<string,string>, source string")
    with pytest.raises(sinks.SinkError):
        sinks.lexicon(none, {}, f"file://{tmp_path}/l")
    with pytest.raises(registry.RegistryError):
        registry.record(rows, f"file://{tmp_path}/m", registry.MANIFEST)


def test_positions_of_a_long_sentence_carry_no_words_with_them(spark, tmp_path):
    n = 20_000
    block = "# sent_id = s\n" + "\n".join(f"{i}\tw{i}\tw{i}\tNOUN\t_\t_\t_\t_\t_\t_" for i in range(1, n + 1))
    (tmp_path / "long.conllu").write_text(block.replace("\n1\t", "\n1-2\tw1w2\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No\n1\t", 1) + "\n\n")
    bank = readers.treebank(spark, str(tmp_path / "long.conllu"))
    found = bank.select(F.inline(readers.positions(False)))
    assert found.count() == n - 1
    assert [tuple(r) for r in found.where("place < 2").collect()] == [(0, "w1w2", None), (1, "w3", "NOUN")]
    spans = bank.select(F.get("tokens", 0)["space_after"], F.get("tokens", 1)["space_after"]).first()
    assert tuple(spans) == (False, True)
    assert [r["gold"] for r in readers.scoring_positions(bank, False).where("place < 2").select("gold").collect()] == [None, "NOUN"]
