"""Command line: python -m cellwright.cli --rna-bam ... --vcf ... --out ..."""

from __future__ import annotations

import argparse
import logging

from .config import EngineConfig

#: Long name, short name, type (None: a switch).
FLAGS = (
    ("atac-bam", "a", str), ("rna-bam", "r", str), ("vcf", "v", str), ("gtf", "g", str), ("peaks", "p", str), ("exclude", "e", str), ("samples", "s", str), ("out", "o", str),
    ("counts-only", "C", None), ("no-counts-o", "n", None), ("out-min", "x", int), ("bc-wl", "w", str), ("rna-umi-tag", "u", str), ("rna-bc-tag", "b", str), ("atac-bc-tag", "c", str),
    ("rna-nh-tag", "N", str), ("atac-nh-tag", "A", str), ("max-nh", "m", int), ("min-phredq", "P", int), ("rna-mapq", "z", int), ("atac-mapq", "Z", int), ("region", "R", str),
    ("eps", "h", float), ("amb-eps", "j", float), ("max-iter", "q", int), ("amb-prior-w", "d", float), ("mdl-reads", "i", str), ("threads", "T", int), ("tx-basic", "t", None), ("verbose", "V", None),
)


def parse(args: list[str] | None = None) -> EngineConfig:
    parser = argparse.ArgumentParser(prog="cellwright", add_help=False)
    parser.add_argument("--help", action="help", help="show this text")
    for name, short, kind in FLAGS:
        if kind is None:
            parser.add_argument(f"--{name}", f"-{short}", action="store_true")
        else:
            parser.add_argument(f"--{name}", f"-{short}", type=kind)
    given = {k: v for k, v in vars(parser.parse_args(args)).items() if v is not None}
    return EngineConfig(**given)


def main(args: list[str] | None = None) -> None:
    config = parse(args)
    logging.basicConfig(level=logging.INFO if config.verbose else logging.WARNING)
    from pyspark.sql import SparkSession

    from .plans.engine import Engine

    builder = SparkSession.builder.appName("cellwright").config("spark.sql.session.timeZone", "UTC")
    if config.threads > 1:
        builder = builder.master(f"local[{config.threads}]")
    Engine(builder.getOrCreate(), config).run()


if __name__ == "__main__":
    main()
