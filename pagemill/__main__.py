"""python -m pagemill parse SOURCE | formats | config | routes"""

from __future__ import annotations

import argparse
from dataclasses import asdict, replace

from pagemill.config import Settings
from pagemill.functions.text import masked
from pagemill.operators import models_io, routing
from pagemill.plans import pipeline
from pagemill.session import cleared, local_session
from pagemill.sources import catalogue, files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagemill")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("parse", help="read one file or all of a folder and write Markdown")
    a.add_argument("source")
    a.add_argument("-o", "--output", default="")
    a.add_argument("-s", "--strategy", default="", help="fast, ocr, hybrid or vlm; others count as vlm")
    a.add_argument("-r", "--recursive", action="store_true")
    a.add_argument("-m", "--model", default="", help="the one model to ask")
    a.add_argument("-l", "--enrich-links", action="store_true")
    a.add_argument("-i", "--extract-images", action="store_true")
    a.add_argument("-p", "--page-tags", action="store_true")
    a.add_argument("-f", "--force", action="store_true")
    a.add_argument("-c", "--concurrency", type=int, default=0, help="calls at once in each task")
    a.add_argument("-v", "--verbose", action="store_true")
    for name in ("formats", "config", "routes"):
        sub.add_parser(name)
    args = p.parse_args(argv)
    settings = Settings.from_env()
    if args.command == "config":
        for k, v in asdict(settings).items():
            print(f"{k}: {v}")
        return 0
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "formats":
        routing.registry(spark).orderBy("ext").show(100, False)
    elif args.command == "routes":
        t = catalogue.tables(spark, catalogue.loaded(settings.vlm_routes_file))
        t["models"].show(100, False)
        t["providers"].withColumn("api_key_env", masked(t["providers"]["api_key_env"])).show(100, False)
    else:
        given = {"strategy": args.strategy, "vlm_model_override": args.model, "vlm_concurrency": args.concurrency, "output_dir": args.output}
        given |= {k: getattr(args, k) for k in ("enrich_links", "extract_images", "page_tags")}
        settings = replace(settings, **{k: v for k, v in given.items() if v})
        pipeline.logged(args.verbose)
        tools = pipeline.Tools.found(settings, catalogue.loaded(settings.vlm_routes_file))
        if args.verbose and tools.models:
            tools = replace(tools, models=replace(tools.models, client=models_io.measured(tools.models.client)))
        told = (lambda done, every: print(f"{done} of {every} pages", flush=True)) if args.verbose else None
        if files.exists(args.source) is None:
            print(f"File not found: {args.source}")
            return 1
        found = files.scanned(spark, args.source, args.recursive)
        if found.select("path").isEmpty():
            print("No supported files found.")
            return 1
        done, cost = pipeline.parse(spark, args.source, settings, args.recursive, args.force, tools, told)
        done = done.persist()
        if done.isEmpty():
            print("All files are there already; -f reads them again.")
            return 0
        done.orderBy("path").show(1000, False)
        pipeline.tally(done).show()
        cost.filter("requests > 0").show()
        cleared(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
