"""Command line over the engine: ``python -m blockwright compress IN OUT``, and so on. Paths are Spark's, files are rows of a table.

IN of compress, explain and train is a file or folder of any bytes; stored blocks are a Parquet table.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import blockwright
from blockwright.engine import Config, Engine
from blockwright.sources import blocks
from blockwright.sources.dictionaries import DictionaryStore
from blockwright.sources.records import RecordSchema


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockwright", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, encoder: bool = False, decoder: bool = False, **more) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=more.get("help"))
        for place in places:
            c.add_argument(place)
        if encoder:
            c.add_argument("--block-size", type=int, default=blocks.BLOCK_SIZE)
            c.add_argument("--profile", default="balanced", choices=("fast", "balanced", "dense"))
            c.add_argument("--schema", help="record fields, such as ts:u64,price:f64,tag:b4")
            c.add_argument("--segment", type=int, default=0, help="least bytes of a segment; 0 leaves blocks whole")
        if encoder or decoder:
            c.add_argument("--dictionaries", help="folder of a dictionary store")
            c.add_argument("--dictionary", help="id of the dictionary to encode with")
        return c

    add("compress", "source", "target", encoder=True, help="files to stored blocks")
    add("decompress", "source", "target", decoder=True, help="stored blocks to a table of data")
    add("inspect", "source", help="blocks, bytes and ratio by file and label")
    add("verify", "source", decoder=True, help="decode everything and compare checksums")
    add("explain", "source", encoder=True, help="the plan of every block").add_argument("--exhaustive", action="store_true")
    c = add("read-range", "source", "file", "first", "last", decoder=True, help="the bytes [first, last) of a file")
    c = add("decode-block", "source", "file", "block", decoder=True, help="the bytes of one block")
    c = add("train", "source", "store", help="a dictionary from the lines of text files")
    c.add_argument("--size", type=int, default=4096)
    add("version", help="the version")
    return p


def _engine(spark: SparkSession, args: argparse.Namespace) -> Engine:
    known = {r["dict_id"]: bytes(r["bytes"]) for r in DictionaryStore(spark, args.dictionaries).all().collect()} if getattr(args, "dictionaries", None) else {}
    if args.dictionary and args.dictionary not in known:
        raise SystemExit(f"dictionary {args.dictionary} is not in the store")
    own = known.get(args.dictionary, b"")
    if not hasattr(args, "profile"):
        return Engine(Config(dictionary=own), list(known.values()))
    schema = RecordSchema(args.schema) if args.schema else None
    return Engine(Config(args.block_size, args.profile, schema, segment=args.segment, dictionary=own), list(known.values()))


def _files(spark: SparkSession, path: str):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_id"), F.col("content").alias("data"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(blockwright.__version__)
        return 0
    spark = spark or SparkSession.builder.appName("blockwright").getOrCreate()
    if args.command == "compress":
        blocks.write(_engine(spark, args).compress(_files(spark, args.source)), args.target)
        return main(["inspect", args.target], spark)
    if args.command == "train":
        lines = spark.read.text(args.source).withColumn("key", F.monotonically_increasing_id())
        print(DictionaryStore(spark, args.store).put(Engine.train(lines, "key", "value", args.size)))
        return 0
    if args.command == "explain":
        for r in _engine(spark, args).explain(_files(spark, args.source), args.exhaustive).orderBy("file_id", "block_id").toLocalIterator():
            print(json.dumps(r.asDict(recursive=True), default=str))
        return 0
    stored = blocks.read(spark, args.source)
    if args.command == "inspect":
        for r in blocks.inspect(stored).orderBy("file_id", "label").collect():
            print(json.dumps(r.asDict()))
        return 0
    engine = _engine(spark, args)
    if args.command == "decompress":
        engine.decompress(stored).write.mode("overwrite").parquet(args.target)
    elif args.command == "verify":
        found = engine.verify(stored).collect()
        for r in found:
            print(json.dumps(r.asDict()))
        return int(any(r["damaged"] or not r["complete"] for r in found))
    elif args.command == "decode-block":
        sys.stdout.buffer.write(engine.decode_block(stored, args.file, int(args.block)))
    else:
        part = engine.read_range(stored, args.file, int(args.first), int(args.last))
        for r in part.orderBy("block_id").toLocalIterator():
            if r["error"]:
                raise SystemExit(f"block {r['block_id']}: {r['error']}")
            sys.stdout.buffer.write(bytes(r["data"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
