"""Command line: python -m corpusloom {tokenize,train,encode,pack,leaderboard} ...; bad usage ends with 2, errors with 1."""

from __future__ import annotations

import argparse
import re
import sys

from corpusloom import __version__
from corpusloom.functions.rules import DEFAULT_RULESET, NORMALIZATIONS, RULESETS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    tools = top.add_subparsers(dest="tool", required=True)
    tokenize = tools.add_parser("tokenize", help="list the chunks of a text, or of standard input")
    tokenize.add_argument("text", nargs="?")
    tokenize.add_argument("--normalize", choices=NORMALIZATIONS, default="Identity")
    train = tools.add_parser("train", help="train a vocabulary on the lines of a file")
    train.add_argument("--input", required=True)
    train.add_argument("--vocab-size", type=int, default=32_000)
    train.add_argument("--output", required=True, help="folder of the vocabulary's files")
    encode = tools.add_parser("encode", help="encode the lines of a file to Parquet")
    encode.add_argument("--allow-specials", action="store_true")
    pack = tools.add_parser("pack", help="pack a file into a stream of 16-bit ids")
    board = tools.add_parser("leaderboard", help="measure the encoder's plans on the lines of a file")
    board.add_argument("--repeats", type=int, default=5)
    board.add_argument("--warm-ups", type=int, default=2)
    for tool in (encode, pack, board):
        tool.add_argument("--vocabulary", required=True, help="folder of the vocabulary's files")
        tool.add_argument("--input", required=True)
        tool.add_argument("--output", required=True)
    for tool in (tokenize, train, encode, pack):
        tool.add_argument("--ruleset", choices=tuple(RULESETS), default=DEFAULT_RULESET)
    return top


def run(args: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from corpusloom.functions import split
    from corpusloom.operators import files, leaderboard, train
    from corpusloom.sources import artefacts, lines, streams

    if not re.fullmatch(r"\d+\.\d+\.\d+", __version__):
        raise ValueError(f"the version {__version__} is not of the form d.d.d")
    spark = SparkSession.builder.appName(f"corpusloom {args.tool}").getOrCreate()
    if args.tool == "tokenize":
        data = args.text.encode() if args.text is not None else sys.stdin.buffer.read()
        found = spark.createDataFrame([(bytearray(data),)], "data binary").select(split.pipeline(F.col("data"), args.normalize, args.ruleset).alias("chunks"))
        listed = found.select(F.posexplode("chunks").alias("pos", "chunk"))
        listed = listed.select("pos", F.length("chunk").alias("chars"), F.octet_length("chunk").alias("bytes"), streams.display_escape(F.col("chunk")).alias("text"), streams.hex_bytes(F.col("chunk")).alias("hex"))
        rows = listed.select("bytes", streams.listing_line(*[F.col(c) for c in listed.columns]).alias("line")).orderBy("pos").collect()
        print(f"ruleset={args.ruleset} storage_bytes={sum(r.bytes for r in rows)} chunks={len(rows)}")
        for r in rows:
            print(r.line)
    elif args.tool == "train":
        corpus = lines.read_lines(spark, args.input)
        made = train.train(corpus, args.vocab_size, "line", args.ruleset)
        artefacts.save(spark, made, args.output)
        print(f"vocabulary of {len(made)} ids")
    else:
        vocabulary = artefacts.load(spark, args.vocabulary)
        if args.tool == "encode":
            coded = files.encode_file(spark, args.input, vocabulary, args.allow_specials, args.ruleset)
            coded.select("file", F.length("tok").alias("n_tokens"), F.encode("tok", "UTF-16LE").alias("packed")).write.parquet(args.output)
        elif args.tool == "pack":
            done = files.pack_file(spark, args.input, args.output, vocabulary, args.ruleset)
            print(f"lines={done.lines} tokens={done.tokens} seconds={done.seconds:.3f} tok/s={done.tokens_per_second:.0f}")
        else:
            corpus = lines.require_lines(lines.read_lines(spark, args.input)).select("line", F.monotonically_increasing_id().alias("line_no"))
            results = leaderboard.run(spark, corpus, ["line_no"], vocabulary, warm_ups=args.warm_ups, repeats=args.repeats)
            streams.write_leaderboard(results, args.output)
            results.orderBy("tier", "variant").show(100, truncate=False)


def main() -> int:
    args = parser().parse_args()
    try:
        run(args)
    except Exception as error:  # the command line's contract: any failure is exit 1
        print(f"corpusloom: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
