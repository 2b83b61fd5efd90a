"""Command line: evaluate variants over stored tables."""

from __future__ import annotations

import argparse

from .config import VARIANTS, Config, load, variant


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow")
    p.add_argument("--config", help="YAML or JSON file")
    p.add_argument("--mode", default="baseline", choices=sorted(VARIANTS))
    p.add_argument("--variants", default="baseline,enhanced", help="names, or all")
    p.add_argument("--judge-variants", default="", help="names, or all")
    p.add_argument("--no-judge", action="store_true")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--no-image", action="store_true")
    p.add_argument("--caption-figures", action="store_true")
    p.add_argument("--tables", required=True, help="folder with text_index, image_index, kg and questions")
    p.add_argument("--out", required=True)
    return p


def names(value: str) -> list[str]:
    found = list(VARIANTS) if value == "all" else [v for v in value.split(",") if v]
    if unknown := [v for v in found if v not in VARIANTS]:
        raise SystemExit(f"unknown variants: {', '.join(unknown)}")
    return found


def resolve(args: argparse.Namespace) -> Config:
    return variant(load(args.config) if args.config else Config(), args.mode)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .models import stand_ins
    from .plans import stages
    from .plans.retrieval import Stores
    from .sources import graphml

    args = parser().parse_args(argv)
    config, spark = resolve(args), SparkSession.builder.appName("folioflow").getOrCreate()
    nodes, edges = graphml.load(spark, f"{args.tables}/kg")
    image = None if args.no_image else spark.read.parquet(f"{args.tables}/image_index")
    stores = Stores(spark.read.parquet(f"{args.tables}/text_index"), image, nodes, edges)
    questions = spark.read.parquet(f"{args.tables}/questions")
    questions = questions.filter(F.col("place") < args.limit) if args.limit else questions
    judged = () if args.no_judge else tuple(names(args.judge_variants))
    wanted = names(args.variants)
    done = set()
    for name in wanted:  # a variant whose results exist is not evaluated again
        target = f"{args.out}/variant={name}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            stages.evaluate(config, stores, questions, stand_ins(), [name], judged).drop("variant").write.mode("overwrite").parquet(target)
        done.add(name)
    values = spark.read.parquet(args.out).filter(F.col("variant").isin(*done))
    stages.comparison(values.select("variant", "qtype", "metric", "value"), wanted).coalesce(1).write.mode("overwrite").json(f"{args.out}-comparison")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
