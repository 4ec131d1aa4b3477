"""Command line: python -m terralith <command> --data DIR --out DIR ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terralith.operators import dataset, relations
from terralith.plans import gateway
from terralith.session import exists, read_text
from terralith.sources import gazetteer, io


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terralith", description=__doc__)
    parser.add_argument("command", choices=["normalize-data", "convert-shapefiles", "build-inventory", "build-relations", "generate-samples", "full-pipeline", "validate", "export", "search", "evaluate"])
    parser.add_argument("--data", default="data", help="folder of the source tables")
    parser.add_argument("--out", default="out")
    parser.add_argument("--config", help="YAML file: countries, sample_targets, auto_scaling")
    parser.add_argument("--samples", help="JSON lines of samples (validate, export), or of expected and predicted texts (evaluate)")
    parser.add_argument("--query", help="question (search)")
    parser.add_argument("--task", help="sql or places (evaluate)")
    parser.add_argument("--split", help="train, val or test (evaluate)")
    parser.add_argument("--label", help="a label that results carry (evaluate)")
    parser.add_argument("--ids", help="ids of results, with commas between (evaluate)")
    parser.add_argument("--append", action="store_true")
    parser.add_argument("--fresh", action="store_true", help="build relations even if they are there")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("terralith").getOrCreate()
    config = io.read_config(a.config) if a.config else {}
    read = lambda source: gazetteer.read(spark, a.data, source)
    if a.command == "full-pipeline":
        steps = ["build-inventory", "build-relations", "generate-samples", "validate", "export"]
        common = ["--data", a.data, "--out", a.out, *(["--config", a.config] if a.config else []), *(["--fresh"] if a.fresh else []), *(["--append"] if a.append else [])]
        for step in steps:
            main([step, *common, "--samples", f"{a.out}/{'validated' if step == 'export' else 'raw'}.jsonl"])
    elif a.command == "generate-samples":
        from terralith.operators.drawing import Draw

        gazetteer.register_views(spark, a.data)
        divisions, natural = read("divisions_area"), read("natural_earth")
        items = dataset.work_items(config.get("sample_targets", {"direct_lookup": 4}), config.get("generation", {}).get("retry_multiplier", 2))
        made, outcome = dataset.generate(spark, divisions, natural, items, Draw(divisions, natural, relations.load(spark, a.out)))
        path = f"{a.out}/raw.jsonl"
        if a.append and exists(spark, path):
            start = io.next_sample_number(io.read_samples(spark, path))
            made = [m | {"id": f"sample_{start + i:06d}"} for i, m in enumerate(made)]
        io.write_jsonl(spark.createDataFrame(made, io.SAMPLE), path, a.append)
        io.save_stats(spark, outcome, f"{a.out}/generation.json")
    elif a.command == "normalize-data":
        gazetteer.normalize(spark, a.data, a.out)
    elif a.command == "convert-shapefiles":
        io.read_shapefiles(spark, a.data).write.mode("overwrite").parquet(f"{a.out}/natural_earth.parquet")
    elif a.command == "build-inventory":
        for source in ("divisions_area", "natural_earth"):
            gazetteer.inventory(read(source), source).write.mode("overwrite").parquet(f"{a.out}/{source}_inventory.parquet")
    elif a.command == "build-relations":
        countries, mark = config.get("countries"), f"{a.out}/countries.json"
        built = json.loads(read_text(spark, mark)) if exists(spark, mark) else None
        if a.fresh or relations.needs_rebuild(built, countries or ["all"]):
            scaling = config.get("auto_scaling", {})
            limits = relations.relation_limits(config.get("sample_targets", {}), config.get("generation", {}).get("retry_multiplier", 2), scaling.get("safety_factor", 1.5), scaling.get("manual_limits"))
            relations.build_all(read("divisions_area"), read("natural_earth"), a.out, countries, relations.capped(limits) if not countries or "all" in countries else limits)
            io.save_stats(spark, countries or ["all"], mark)
    elif a.command == "validate":
        checked = dataset.validate(io.read_samples(spark, a.samples))
        io.write_jsonl(checked.where("size(issues) = 0").drop("issues"), f"{a.out}/validated.jsonl", a.append)
        io.save_stats(spark, [r.asDict() for r in dataset.statistics(checked.where("size(issues) = 0")).collect()], f"{a.out}/stats.json")
    elif a.command == "export":
        split = dataset.stratified_split(io.read_samples(spark, a.samples).withColumn("stratum", F.coalesce("metadata.template_id", "metadata.task_family")), "stratum")
        for name in ("train", "val", "test"):
            part = split.where(F.col("split") == name)
            io.write_jsonl(dataset.sql_pairs(part).drop("id"), f"{a.out}/sql_{name}.jsonl")
            io.write_jsonl(dataset.place_pairs(part).drop("id"), f"{a.out}/places_{name}.jsonl")
    elif a.command == "evaluate":
        results = dataset.evaluated(spark.read.json(a.samples), a.task, a.split, a.label, a.ids.split(",") if a.ids else None)
        print(json.dumps(dataset.exact_match(results).first().asDict()))
    else:
        gazetteer.register_views(spark, a.data)
        print(json.dumps(gateway.search(spark, a.query or "", read("divisions_area"), read("natural_earth")), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
