"""Command line: python -m statewalk.cli {run,preflight,concat,fit,metrics,export,maps,stats,design,merge,parcels,select,qc} --config FILE --series GLOB --out DIR."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

from statewalk.plans.config import from_yaml
from statewalk.plans.run import Run
from statewalk.sources import matrix_files, readers

COMMANDS = {
    "run": lambda r: r.all(),
    "concat": lambda r: r.segments().count(),
    "fit": lambda r: r.model().loglik,
    "metrics": lambda r: (r.metrics_state().count(), r.metrics_global().count(), r.transitions().count()),
    "maps": lambda r: (r.group_maps().count(), r.write_maps()),
    "stats": lambda r: (r.omnibus().count(), r.effects_state().count(), r.effects_between().count()),
    "design": lambda r: r.write_design(),
    "merge": lambda r: (r.stacks().count(), r.columns_map().count()),
    "export": lambda r: r.write_texts(),
    "parcels": lambda r: r.parcel_tests(),
    "select": lambda r: r.selection(),
    "preflight": None,
    "qc": lambda r: {n: t.count() for n, t in r.quality().items()},
}


class JsonLines(logging.Formatter):
    """One JSON object a line."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="statewalk", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--config", required=True, help="YAML file with the sections hmm, stats, evaluation, paths")
    parser.add_argument("--series", help="text matrices, one for each sequence; else paths.series of the config")
    parser.add_argument("--covariates", help="delimited table with a header; else paths.covariates of the config")
    parser.add_argument("--out", required=True)
    parser.add_argument("--force", action="store_true", help="run stages again whose tables are there")
    args = parser.parse_args(argv)
    config = from_yaml(args.config)
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if config.logging.format == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logging.basicConfig(level=config.logging.level.upper(), handlers=[handler])
    spark = SparkSession.builder.appName("statewalk").getOrCreate()
    series = readers.series(spark, args.series or config.paths["series"])
    if args.command == "preflight":
        found = readers.preflight(matrix_files.shapes(spark, args.series or config.paths["series"]))
        found.write.mode("overwrite").parquet(f"{args.out}/preflight")
        for r in spark.read.parquet(f"{args.out}/preflight").groupBy("keep").agg({"*": "count"}).collect():
            print(f"{'kept' if r['keep'] else 'passed by'}: {r['count(1)']}")
        return 0
    path = args.covariates or config.paths.get("covariates")
    known = readers.covariates(spark, path) if path else spark.createDataFrame([], "sid string, uid string, sex string, age_group string, fd double")
    result = COMMANDS[args.command](Run(spark, config, args.out, series, known, args.force))
    if args.command == "run":
        spark.createDataFrame([(result,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/report")
    elif result is not None:
        print(result if not hasattr(result, "show") else result.toPandas().to_string())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
