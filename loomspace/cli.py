"""Command line: build, dry run and query.

    python -m loomspace.cli build SOURCE... [--output DIR] [--config FILE] [--http]
    python -m loomspace.cli dry-run SOURCE... [--config FILE]
    python -m loomspace.cli query QUESTION... [--output DIR] [--config FILE] [--http]

Sources are text files, each a corpus of its own. Without --http the offline stand-ins are used, so nothing leaves the machine.
"""

from __future__ import annotations

import argparse
import dataclasses
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings, settings_from
from .plans import pipeline
from .sources import files, models, store


def _settings(args: argparse.Namespace) -> Settings:
    found = settings_from(Path(args.config).read_text(encoding="utf-8")) if args.config else Settings()
    return dataclasses.replace(found, output_dir=args.output) if args.output else found


def _report(stage: str, seconds: float, rows: int | None) -> None:
    print(f"{stage}: {seconds:.1f} s" + ("" if rows is None else f", {rows} rows"), flush=True)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomspace", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["build", "dry-run", "query"])
    parser.add_argument("values", nargs="+")
    for name in ("--output", "--config"):
        parser.add_argument(name)
    parser.add_argument("--http", action="store_true")
    args = parser.parse_args(argv)
    s, spark = _settings(args), SparkSession.builder.appName("loomspace").getOrCreate()
    if args.command == "dry-run":
        pipeline.dry_run(files.read_texts(spark, args.values), s).orderBy("threshold").show(truncate=False)
    elif args.command == "build":
        docs = files.read_texts(spark, args.values)
        if args.http:
            embed = models.HttpEmbedder(s.embedding.base_url, s.embedding.model)
            summarize, name = (models.HttpGenerator(s.enrichment.base_url, m) for m in (s.enrichment.summarize_model, s.enrichment.name_model))
            registry = pipeline.build(docs, s, lambda terms: models.mapped(terms, "term", embed, "v", "array<double>"), None, summarize, name, _report)
        else:
            registry = pipeline.build(docs, s, report=_report)
        stored = store.read_shards(spark, f"{s.output_dir}/concepts").agg(F.count("*").alias("concepts"), F.count_distinct("shard_id").alias("shards")).first()
        print(f"{stored.concepts} concepts in {stored.shards} shards, {len(registry.numbers)} anchors")
    else:
        for question in args.values:
            if args.http:
                v = models.HttpEmbedder(s.embedding.base_url, s.embedding.model)(question)
            else:
                v = list(spark.range(1).select(models.hashed_embedding(F.lit(question)).alias("v")).first().v)
            found = pipeline.retrieve(spark, s.output_dir, pipeline.query_position(v, s.placement.projection_seed))
            pipeline.display(found).show(truncate=False)
            prompt = pipeline.answer_prompt(found, question).first().prompt
            print(models.HttpGenerator(s.enrichment.base_url, s.enrichment.summarize_model)(prompt) if args.http else prompt)


if __name__ == "__main__":
    main()
