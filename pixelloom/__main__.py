"""Command line: `python -m pixelloom info|decode|encode|transcode|list`, over a file or a folder of them, as a Spark job.

decode writes raw samples or portable pixmaps, encode and transcode write streams; each file's result has its name with
another ending. Files that fail are listed with the reason, and the exit status is 1.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import codec
from pixelloom.sources import sinks, streams

ENDINGS = {"jpeg": "jpg", "jpeg_lossless": "jpg", "jpegls": "jls", "j2k": "j2c", "jp2": "jp2"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pixelloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("info", "decode", "encode", "transcode"):
        one = sub.add_parser(name)
        one.add_argument("source")
        if name != "info":
            one.add_argument("target")
        if name == "decode":
            one.add_argument("--format", choices=("raw", "ppm"), default="raw")
        if name in ("encode", "transcode"):
            one.add_argument("--codec", choices=sorted(ENDINGS), default="jpeg")
            one.add_argument("--quality", type=int, default=85)
            one.add_argument("--near", type=int, default=0)
        if name == "encode":
            for flag in ("width", "height"):
                one.add_argument(f"--{flag}", type=int, required=True)
            one.add_argument("--components", type=int, default=1)
            one.add_argument("--bits", type=int, default=8)
    return p


def options_of(args: argparse.Namespace) -> dict:
    return {"quality": args.quality} if args.codec == "jpeg" else {"near": args.near} if args.codec == "jpegls" else {}


def named(df: DataFrame, ending: str) -> DataFrame:
    """df with `file`, the last part of its path with another ending."""
    return df.withColumn("file", F.concat(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), F.lit(f".{ending}")))


def portable(images: DataFrame) -> DataFrame:
    """8-bit images of one or three components with `content`, the portable gray- or pixmap."""
    kind = F.when(F.col("components") == 1, "P5").when(F.col("components") == 3, "P6")
    head = F.encode(F.format_string("%s\n%d %d\n255\n", kind, "width", "height"), "US-ASCII")
    fits = kind.isNotNull() & (F.col("bits") == 8)
    error = F.coalesce("error", F.when(~fits, F.lit("one or three components of 8 bits are needed")))
    return images.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), F.concat(head, "pixels")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pixelloom").getOrCreate()
    if args.command == "list":
        streams.codecs(spark).show(truncate=False)
        return 0
    source = streams.files(spark, args.source)
    if args.command == "info":
        found = streams.image_info(source).drop("content")
        found.show(found.count(), truncate=False)
        return int(found.where("error IS NOT NULL").limit(1).count() > 0)
    if args.command == "decode":
        done = codec.decode(source).drop("content")
        done = portable(done) if args.format == "ppm" else done.withColumn("content", F.col("pixels"))
        ending = args.format
    elif args.command == "encode":
        images = streams.raw_images(source, args.width, args.height, args.components, args.bits).drop("content")
        short, whole = images.where("error IS NOT NULL"), images.where("error IS NULL")
        done = codec.encode(whole, args.codec, **options_of(args)).select("path", "content", "error").unionByName(short.select("path", F.lit(None).cast("binary").alias("content"), "error"))
        ending = ENDINGS[args.codec]
    else:
        done, ending = codec.transcode(source, args.codec, **options_of(args)), ENDINGS[args.codec]
    done = named(done, ending).select("path", "file", "content", "error").persist()
    wrong = done.where("error IS NOT NULL").select("path", "error")
    sinks.write_files(done.where("error IS NULL"), args.target, "file", "content").agg(F.count("*")).collect()
    many = wrong.count()
    if many:
        wrong.show(many, truncate=False)
    done.unpersist()
    return int(many > 0)


if __name__ == "__main__":
    raise SystemExit(main())
