"""Tokenizer object, file tools, leaderboard and command line."""

import struct
import sys

import pytest

from corpusloom import __main__ as cli
from corpusloom.operators import encode, files, leaderboard, train
from corpusloom.sources import artefacts
from corpusloom.tokenizer import Tokenizer

TEXT = "hello world hello\r\nworld\n\nnaïve café\rlast"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("vocabulary")
    v = train.train(spark.createDataFrame([("hello world hello world",)], "line string"), 270)
    artefacts.save(spark, v, f"file://{folder}")
    return v, folder


def plain(v, text):
    """Ids by the single-chunk encoder over chunks of the regex module."""
    import regex

    from corpusloom.functions.rules import RULESETS

    ranks = {p: 256 + k for k, p in enumerate(v.merges)}
    return [i for c in regex.findall(RULESETS["cl100k_base"], text) for i in encode.encode_chunk(c.encode(), ranks)]


def test_tokenizer(spark, made):
    v, folder = made
    a = Tokenizer(spark, f"file://{folder}/vocab.bin")
    b = Tokenizer.from_json(spark, f"file://{folder}/vocab.json", f"file://{folder}/merges.txt")
    assert a.vocab_size == b.vocab_size == len(v) and a.ruleset == "cl100k_base" and Tokenizer.version.count(".") == 2
    for text in ("hello world", "", "naïve\n\n 12345"):
        assert a.encode(text) == b.encode(text) == plain(v, text) and a.decode(a.encode(text)) == text.encode()
    assert a.encode_batch(["x", "hello", "y"]) == [[120], plain(v, "hello"), [121]]
    for bad in ([-1], [65_536], [len(v)]):
        with pytest.raises(IndexError):
            a.decode(bad)
    with pytest.raises(ValueError):
        Tokenizer(spark, f"file://{folder}/vocab.bin", ruleset="nope")


def test_encode_file(spark, made, tmp_path):
    v, _ = made
    (tmp_path / "a.txt").write_bytes(b"hello\r\n\xff<|pad|>\nworld")
    (tmp_path / "empty.txt").write_bytes(b"")
    got = [[ord(c) for c in r.tok] for r in files.encode_file(spark, f"file://{tmp_path}/a.txt", v, allow_specials=True).collect()]
    assert got == [plain(v, "hello"), [*plain(v, "�"), len(v) + 3], plain(v, "world")]
    with pytest.raises(Exception, match="not allowed"):
        files.encode_file(spark, f"file://{tmp_path}/a.txt", v).collect()
    with pytest.raises(ValueError):
        files.encode_file(spark, f"file://{tmp_path}/empty.txt", v)


def test_pack_file(spark, made, tmp_path):
    v, _ = made
    (tmp_path / "a.txt").write_bytes(TEXT.encode())
    done = files.pack_file(spark, f"file://{tmp_path}/a.txt", f"file://{tmp_path}/a.bin", v, page_tokens=5)
    want = [i for line in TEXT.encode().splitlines(keepends=True) for i in plain(v, line.decode())]
    assert (tmp_path / "a.bin").read_bytes() == struct.pack(f"<{len(want)}H", *want)
    assert (done.lines, done.tokens) == (5, len(want)) and done.tokens_per_second > 0
    (tmp_path / "bad.txt").write_bytes(b"a\xff")
    with pytest.raises(Exception):
        files.pack_file(spark, f"file://{tmp_path}/bad.txt", f"file://{tmp_path}/bad.bin", v)


def test_leaderboard(spark, made):
    v, _ = made
    lines = spark.createDataFrame([(k, f"hello world {k}") for k in range(30)], "k long, line string")
    rows = leaderboard.run(spark, lines, ["k"], v, ("cl100k_base",), {"tiny": 100, "small": 1_000}, warm_ups=0, repeats=3).collect()
    assert {(r.variant, r.tier) for r in rows} == {(f"{p} (cl100k_base)", t) for p in ("arrow", "native") for t in ("tiny", "small")}
    assert all(r.tok_per_s > 0 and r.mib_per_s > 0 and r.decode_mib_per_s > 0 for r in rows)
    assert all((r.p50_us is not None) == r.variant.startswith("arrow") for r in rows)
    assert {r.tier: r.bytes >= (100 if r.tier == "tiny" else 1_000) for r in rows} == {"tiny": True, "small": True}


def test_command_line(spark, made, tmp_path, monkeypatch, capsys):
    _, folder = made
    (tmp_path / "a.txt").write_bytes(TEXT.encode())

    def call(*args):
        monkeypatch.setattr(sys, "argv", ["corpusloom", *args])
        return cli.main()

    assert call("tokenize", "a b") == 0
    assert capsys.readouterr().out.splitlines() == ["ruleset=cl100k_base storage_bytes=3 chunks=2", '[0] chars=1 bytes=1 text="a" hex=[61]', '[1] chars=2 bytes=2 text=" b" hex=[20 62]']
    assert call("train", "--input", f"file://{tmp_path}/a.txt", "--vocab-size", "260", "--output", f"file://{tmp_path}/v") == 0
    assert len(artefacts.load(spark, f"file://{tmp_path}/v")) == 260
    assert call("pack", "--vocabulary", f"file://{folder}", "--input", f"file://{tmp_path}/a.txt", "--output", f"file://{tmp_path}/a.bin") == 0
    assert call("encode", "--vocabulary", f"file://{folder}", "--input", f"file://{tmp_path}/a.txt", "--output", f"file://{tmp_path}/enc") == 0
    assert spark.read.parquet(f"file://{tmp_path}/enc").count() == 4
    assert call("pack", "--vocabulary", f"file://{tmp_path}/none", "--input", "x", "--output", "y") == 1
    for bad in (("pack",), ("tokenize", "--ruleset", "nope"), ()):
        with pytest.raises(SystemExit) as ended:
            call(*bad)
        assert ended.value.code == 2
    with pytest.raises(SystemExit) as ended:
        call("--version")
    assert ended.value.code == 0
