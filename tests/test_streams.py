"""Lines, packing, windows, analytics, streaming and the entry point."""

import shutil
import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusloom.operators import analytics, encode, ordering, pack, sample, train
from corpusloom.plans import catalog
from corpusloom.sources import lines, streams
from corpusloom.streaming import tokens


def test_read_lines(spark, tmp_path):
    (tmp_path / "train.txt").write_bytes(b"aaa\r\nb\n\nc\rd\n")
    got = [bytes(r.line, "utf-8") if isinstance(r.line, str) else bytes(r.line) for r in lines.read_lines(spark, str(tmp_path), "train").collect()]
    assert got == [b"aaa", b"b", b"", b"c\rd"]
    with pytest.raises(Exception):
        lines.read_lines(spark, str(tmp_path), "valid").collect()


def test_text_lines(spark):
    cases = {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb": ["a", "b"], "\n": [""], "a\n\nb\n": ["a", "", "b"], "a\rb": ["a\rb"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.ls for r in df.select("t", lines.text_lines(F.col("t")).alias("ls")).collect()} == cases


def test_lines_with_ends(spark):
    text = "a\r\nb\rc\n\nd"
    got = spark.createDataFrame([(text,)], "t string").select(lines.lines_with_ends(F.col("t"))).first()[0]
    assert got == text.splitlines(keepends=True)


def test_no_lines(spark):
    with pytest.raises(ValueError):
        lines.require_lines(spark.createDataFrame([], "line string"))


def test_packed_bytes_pages_and_windows(spark, tmp_path):
    v = train.train(spark.createDataFrame([("hello world hello",)], "line string"), 270)
    texts = ["hello world", "", "abc hello", "x" * 50, "hello"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, line string")
    coded = pack.pack_lines(df, v)
    stream = [i for r in coded.orderBy("k").select(encode.ids(F.col("tok")).alias("i")).collect() for i in r.i]
    for r in coded.collect():
        assert bytes(r.packed) == struct.pack(f"<{len(r.tok)}H", *map(ord, r.tok))
    assert pack.pack_stats(coded).first().n_tokens == len(stream)
    pages = pack.paged(coded, ["k"], 7)
    flat = f"file://{tmp_path}/flat.bin"
    streams.write_flat(spark, pages, flat)
    assert (tmp_path / "flat.bin").read_bytes() == struct.pack(f"<{len(stream)}H", *stream)
    assert [ord(c) for c in streams.read_flat(spark, flat).first().tok] == stream
    streams.write_stream(pages, f"file://{tmp_path}/pages")
    assert "".join(r.tok for r in streams.read_stream(spark, f"file://{tmp_path}/pages").orderBy("page").collect()) == "".join(map(chr, stream))
    starts = spark.createDataFrame([(k, s) for k, s in enumerate((0, 3, 6, 7, len(stream) - 12))], "window long, start long")
    for w in sample.windows(pages, starts, 11, 7).collect():
        assert w.x == stream[w.start : w.start + 11] and w.y == stream[w.start + 1 : w.start + 12]
    assert sample.windows(pages, starts, 11, 7).count() == 5
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="16-bit"):
        streams.read_flat(spark, f"file://{tmp_path}/odd.bin").collect()


def test_random_starts(spark):
    rows = [r.start for r in sample.random_starts(spark, 100, 10, 500, 3).collect()]
    assert min(rows) >= 0 and max(rows) < 89 and len(set(rows)) > 50
    assert rows == [r.start for r in sample.random_starts(spark, 100, 10, 500, 3).collect()]
    with pytest.raises(ValueError):
        sample.random_starts(spark, 11, 10, 1, 3)
    paged = [r.start for r in sample.page_starts(spark, 1000, 10, 8, 4, 5, page_tokens=100, batches_per_page=2).collect()]
    assert len(paged) == 32 and all(0 <= s < 1000 - 11 for s in paged)
    assert all(max(paged[k : k + 8]) - min(paged[k : k + 8]) < 100 for k in range(0, 32, 8))


def test_running_sum(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(200)], "k long, v long")
    got = {r.k: r.s for r in ordering.running_sum(df, ["k"], "v", "s").collect()}
    assert got == {k: sum(j % 5 for j in range(k)) for k in range(200)}


def test_tier(spark):
    df = spark.createDataFrame([(0, "aa"), (1, ""), (2, "bbb")], "k long, line string")
    got = [(r.cycle, r.k) for r in analytics.tier(df, ["k"], "line", 8).orderBy("cycle", "k").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    with pytest.raises(ValueError):
        analytics.tier(df.filter("k = 1"), ["k"], "line", 8)


def test_trimmed(spark):
    df = spark.createDataFrame([("a", k, r) for k, r in enumerate((3.0, 1.0, 2.0, 9.0))] + [("b", 0, 1.0), ("b", 1, 2.0)], "v string, repeat int, rate double")
    assert sorted((r.v, r.rate) for r in analytics.trimmed(df, ["v"], "rate", "repeat").collect()) == [("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", 2.0)]


def test_log(spark):
    log = ["device=cpu", "step 20/2000 loss 6.5486 lr 3.00e-04 tok/s 184648 TFLOPS 5.159", "  [eval] step 100 val_loss 4.5", "  [eval] step 200 val_loss 4.1", "  [eval] step 300 val_loss 4.1"]
    df = analytics.parse_log(spark.createDataFrame([(x,) for x in log], "value string"))
    assert sorted(map(tuple, df.collect())) == [("train", 20, 6.5486), ("valid", 100, 4.5), ("valid", 200, 4.1), ("valid", 300, 4.1)]
    valid = df.filter("kind = 'valid'")
    assert tuple(analytics.best_checkpoint(valid).first()) == (200, 4.1)
    assert {r.step: r.saved for r in analytics.saved_checkpoints(valid).collect()} == {100: True, 200: True, 300: False}


def test_gate(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "c")], "x string, y string")
    assert analytics.round_trip_gate(df, F.col("x"), F.col("y")).first().passed is False
    assert analytics.round_trip_gate(df.limit(0), F.col("x"), F.col("y")).first().passed is True


def test_listing_and_leaderboard(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "k int, t string")
    rows = streams.chunk_listing(df, ["k"], "t").withColumn("line", streams.listing_line(*[F.col(c) for c in ("pos", "chars", "bytes", "text", "hex")]))
    assert [r.line for r in rows.orderBy("pos").collect()] == ['[0] chars=1 bytes=1 text="a" hex=[61]', '[1] chars=2 bytes=2 text=" b" hex=[20 62]']
    streams.write_leaderboard(rows.select("k"), f"file://{tmp_path}/board")
    assert spark.read.json(f"file://{tmp_path}/board").columns == ["k", "stamp"]


def test_stream_equals_batch(spark, small, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    shutil.copy(f"{small}/documents.parquet", folder / "a.parquet")
    docs = tokens.read_documents(spark, f"{folder}")
    coded = tokens.encode_stream(docs, catalog.merges()).select("doc_id", "n_tokens")
    q = coded.writeStream.format("memory").queryName("coded").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = tokens.encode_stream(spark.read.parquet(str(folder)), catalog.merges()).select("doc_id", "n_tokens")
    assert sorted(map(tuple, spark.table("coded").collect())) == sorted(map(tuple, batch.collect()))
    q = tokens.count_chunks(docs).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, tokens.count_chunks(spark.read.parquet(str(folder))).collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
