"""Sinks: tables keyed by their parameters, text matrices, and reports."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a table that a report shows.
REPORT_ROWS = 200


def keyed_table(df: DataFrame, root: str, name: str, **params) -> str:
    """Write df under root/name/<key=value>..., overwriting; returns the path, which tells results of other parameters apart."""
    path = "/".join([root.rstrip("/"), name, *[f"{k}={params[k]}" for k in sorted(params)]])
    df.write.mode("overwrite").parquet(path)
    return path


def existing(spark: SparkSession, root: str, name: str, **params) -> DataFrame | None:
    """The table if it was written with exactly these parameters and to its end, else None."""
    path = "/".join([root.rstrip("/"), name, *[f"{k}={params[k]}" for k in sorted(params)]])
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.parquet(path)


def posterior_text(gamma: DataFrame, path: str) -> None:
    """One folder for each sequence with its steps in order, as text of six decimals."""
    line = F.concat_ws(" ", F.transform("g", lambda x: F.format_string("%.6f", x)))
    gamma.select("sid", "t", line.alias("value")).repartition("sid").sortWithinPartitions("sid", "t").select("sid", "value").write.mode("overwrite").partitionBy("sid").text(path)


def state_text(rows: DataFrame, path: str) -> None:
    """rows (sid, value) as one text for each sequence, in a folder for each."""
    rows.select("sid", "value").repartition("sid").write.mode("overwrite").partitionBy("sid").text(path)


def text_file(spark: SparkSession, text: str, path: str) -> None:
    """A short text, such as a contrast or a list of columns, as one file in a folder of its name."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def lines(rows: DataFrame, path: str, head: Sequence[str] = ()) -> None:
    """rows (row_key, value) in the order of row_key, after the head, as one file in a folder of its name: the form that asks for
    one file has as many rows as a design."""
    spark = rows.sparkSession
    top = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, row_key long, value string")
    both = top.union(rows.select(F.lit(1).alias("part"), F.col("row_key").cast("long").alias("row_key"), "value"))
    both.repartition(1).sortWithinPartitions("part", "row_key").select("value").write.mode("overwrite").text(path)


def matrix_file(rows: DataFrame, row_key: str, columns: Sequence[str], path: str) -> None:
    """The columns of a design as a matrix file, the greatest of each column's spread in its head."""
    spread = rows.agg(*[(F.max(f"`{c}`") - F.min(f"`{c}`")).alias(f"h{i}") for i, c in enumerate(columns)], F.count("*").alias("n")).first()
    head = [f"/NumWaves {len(columns)}", f"/NumPoints {spread['n']}", "/PPHeights " + " ".join(f"{spread[f'h{i}'] or 0:.6f}" for i in range(len(columns))), "/Matrix"]
    value = F.concat_ws(" ", *[F.format_string("%.6f", F.col(f"`{c}`")) for c in columns])
    lines(rows.select(F.col(row_key).alias("row_key"), value.alias("value")), path, head)


# The tokens /NumWaves, /NumPoints, /NumContrasts, /ContrastName, /PPHeights and /Matrix of the files below and above.


def matrix_text(rows: Sequence[Sequence[float]]) -> str:
    """A design matrix in the text form of permutation tools: counts, then one line for each row."""
    width = len(rows[0]) if rows else 0
    lines = [f"/NumWaves {width}", f"/NumPoints {len(rows)}", "/Matrix"]
    return "\n".join(lines + [" ".join(f"{v:.6f}" for v in r) for r in rows]) + "\n"


def contrast_text(names: Sequence[str], rows: Sequence[Sequence[float]]) -> str:
    lines = [f"/ContrastName{i} {n}" for i, n in enumerate(names, 1)]
    lines += [f"/NumWaves {len(rows[0]) if rows else 0}", f"/NumContrasts {len(rows)}", "/Matrix"]
    return "\n".join(lines + [" ".join(f"{v:g}" for v in r) for r in rows]) + "\n"


def groups_text(groups: Sequence[int]) -> str:
    return "\n".join(["/NumWaves 1", f"/NumPoints {len(groups)}", "/Matrix", *map(str, groups)]) + "\n"


def report(title: str, tables: dict[str, DataFrame]) -> str:
    """An HTML page with each table's first rows in the order of its columns."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        total = df.count()
        rows = df.orderBy(*df.columns).limit(REPORT_ROWS).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><p>{len(rows)} of {total} rows</p><table><tr>{head}</tr>{body}</table>")
    return "".join(parts) + "</body></html>"


def scorecard_json(df: DataFrame) -> str:
    """A scorecard's rows as JSON, missing figures as null."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str, sort_keys=True)
