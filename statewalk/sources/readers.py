"""Readers of the domain's text and table files, each to a fixed schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from statewalk.functions.expressions import leading_token
from statewalk.operators.numbering import places
from statewalk.operators.posterior import normalized
from statewalk.sources import matrix_files

#: The names under which a column is known, in order of preference.
ALIASES = {
    "sid": ("subject", "subject_id", "subjectid", "sid", "subid", "id", "participant_id"),
    "start": ("start", "begin"),
    "end": ("end", "stop"),
    "n_tr": ("ntr", "n_tr", "length", "len"),
    "sex": ("sex", "gender"),
    "age_group": ("agegroup", "age_group", "age group", "agebin"),
    "fd": ("mean_fd", "meanfd", "fd"),
}


def resolve(columns: Iterable[str], aliases: Iterable[str]) -> str | None:
    """The first alias that a column bears in any case, as the column is written."""
    found = {c.strip().lower(): c for c in columns}
    return next((found[a.lower()] for a in aliases if a.lower() in found), None)


def with_aliases(df: DataFrame, required: Iterable[str], optional: Iterable[str] = (), aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """df with canonical names first and its other columns after them; a missing optional column is null."""
    known = {name: resolve(df.columns, aliases[name]) for name in (*required, *optional)}
    missing = [n for n in required if known[n] is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    rest = [c for c in df.columns if c not in known.values()]
    return df.select(*[F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in known.items()], *[F.col(f"`{c}`") for c in rest])


def delimiter(spark: SparkSession, path: str) -> str:
    """Tab or comma, whichever is more frequent in the first line of the file; a tie is a tab."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0][0] if first else ""
    return "," if head.count(",") > head.count("\t") else "\t"


def table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with a header, every column as text, so that ids keep their leading zeros."""
    return spark.read.option("header", True).option("sep", sep or delimiter(spark, path)).csv(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """sid, seg, start, end, n_tr: lengths from their own column, else from end and start; several segments of a sid are numbered."""
    rows = with_aliases(table(spark, path), ("sid",), ("start", "end", "n_tr"))
    num = {c: F.expr(f"try_cast(`{c}` as bigint)") for c in ("start", "end", "n_tr")}
    out = rows.select("sid", num["start"].alias("start"), num["end"].alias("end"), F.coalesce(num["n_tr"], num["end"] - num["start"]).alias("n_tr"))
    return out.withColumn("seg", F.row_number().over(W.partitionBy("sid").orderBy("start", "end")) - 1)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches the path, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def covariates(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """sid, uid, sex, age_group, fd and the file's other columns; without `strict` a file that isn't there is an empty table."""
    from statewalk.functions.expressions import sex_text

    if not strict and not exists(spark, path):
        return spark.createDataFrame([], "sid string, uid string, sex string, age_group string, fd double")
    rows = with_aliases(table(spark, path), ("sid",), ("sex", "age_group", "fd"))
    rest = [c for c in rows.columns if c not in ("sid", "sex", "age_group", "fd")]
    sid = F.trim("sid")
    return rows.select(sid.alias("sid"), leading_token(sid).alias("uid"), sex_text(F.col("sex")).alias("sex"), "age_group", F.expr("try_cast(fd as double)").alias("fd"), *[F.col(f"`{c}`") for c in rest])


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A delimited file, or an empty table of the schema if it isn't there."""
    return table(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def numbers(line: Column, strict: bool = True) -> Column:
    """A line of numbers parted by blanks, tabs or commas, as an array; what is no number is an error, or null if not strict."""
    return F.transform(F.filter(F.split(F.trim(line), r"[\s,]+"), lambda x: x != ""), lambda x: x.cast("double") if strict else x.try_cast("double"))


def _steps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sid (before the first underscore of the file's name), t (line within the file), line."""
    rows = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    lines = rows.select(leading_token(F.col("name")).alias("sid"), F.posexplode(F.split(F.rtrim(F.regexp_replace("value", "\r", "")), "\n")).alias("t", "line"))
    return lines.where(F.trim("line") != "")


def posteriors(spark: SparkSession, paths: str | list[str], k: int | None = None, skip_bad: bool = False) -> DataFrame:
    """sid, t, g from one text file for each sequence, one line for each step; rows are normalised. A wrong width, or a value that
    is no number, is an error; with skip_bad the whole sequence is left out."""
    out = _steps(spark, paths).select("sid", "t", numbers(F.col("line"), strict=k is None).alias("g"))
    if k is None:
        return out.select("sid", "t", normalized(F.col("g")).alias("g"))
    good = (F.size("g") == k) & F.forall("g", lambda x: x.isNotNull() & ~F.isnan(x))
    if skip_bad:
        out = out.withColumn("_bad", F.max(~good).over(W.partitionBy("sid"))).where("not _bad").drop("_bad")
    else:
        out = out.withColumn("g", F.when(good, F.col("g")).otherwise(F.raise_error(F.concat(F.lit(f"expected {k} numbers a line in the posterior of "), "sid"))))
    return out.select("sid", "t", normalized(F.col("g"), k).alias("g"))


def ordered_subjects(spark: SparkSession, metrics: str, posterior_files: str) -> DataFrame:
    """pos, sid: the subjects of a metrics table in the order of their first rows; of the posterior files, by name, if there is none."""
    if exists(spark, metrics):
        rows = with_aliases(table(spark, metrics), ("sid",)).select(F.monotonically_increasing_id().alias("row"), F.trim("sid").alias("sid"))
        first = rows.where("sid <> ''").groupBy("sid").agg(F.min("row").alias("row"))
    else:
        named = spark.read.format("binaryFile").load(posterior_files).select(F.element_at(F.split("path", "/"), -1).alias("row"))
        first = named.select("row", leading_token(F.col("row")).alias("sid")).groupBy("sid").agg(F.min("row").alias("row"))
    return places(first, ["row", "sid"], name="pos").select("pos", "sid")


def map_files(found: DataFrame, names: list[str]) -> DataFrame:
    """sid, name: of files (name) each subject's first by the endings in `names`, in their order, else the first by name."""
    sid = leading_token(F.col("name"))
    place = F.lit(len(names))
    for i, ending in reversed(list(enumerate(names))):
        place = F.when(F.col("name") == F.concat(sid, F.lit(ending)), i).otherwise(place)
    return found.groupBy(sid.alias("sid")).agg(F.min_by("name", F.struct(place, "name")).alias("name"))


def states(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sid, t, s from one text file for each sequence."""
    return _steps(spark, paths).select("sid", "t", F.trim("line").cast("double").cast("int").alias("s"))


def series(spark: SparkSession, paths: str | list[str], orient: bool = True) -> DataFrame:
    """sid, t, y from one matrix file (text or .npy) for each sequence, a line or row for each step.

    With orient a matrix of fewer rows than columns has its steps in columns, and is turned. Files that aren't two-dimensional
    or have other features than the first usable one are passed by. Lines of different lengths in one file are an error. Text
    in a store that only Spark opens is read through Spark.
    """
    if matrix_files.reachable(paths):
        return matrix_files.series(spark, paths, orient).select("sid", "t", "y")
    return series_through_spark(spark, paths, orient)


def series_through_spark(spark: SparkSession, paths: str | list[str], orient: bool = True) -> DataFrame:
    """`series` of text files by Spark's own text reader; all files are kept."""
    rows = _steps(spark, paths).select("sid", "t", numbers(F.col("line")).alias("y"))
    own = W.partitionBy("sid")
    wide = rows.select("*", F.min(F.size("y")).over(own).alias("_least"), F.max(F.size("y")).over(own).alias("_most"), F.count("*").over(own).alias("_n"))
    wide = wide.withColumn("y", F.when(F.col("_least") == F.col("_most"), F.col("y")).otherwise(F.raise_error(F.concat(F.lit("lines of different lengths in the matrix of "), "sid"))))
    if not orient:
        return wide.select("sid", "t", "y")
    turned = wide.where("_n < _most").select("sid", "t", F.posexplode("y").alias("step", "x")).groupBy("sid", F.col("step").alias("t"))
    turned = turned.agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("y")).select("sid", "t", F.transform("y", lambda v: v["x"]).alias("y"))
    return wide.where("_n >= _most").select("sid", "t", "y").union(turned)


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """label, name for every label from 1 to the greatest: a file of alternating lines, a name and then 'index r g b a'.

    Labels that the file leaves out are named parcel_<label>. If no second line of a pair begins with a number, the first lines
    are the names of labels 1, 2, ... A label table is as small as its atlas.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    pair = lines.groupBy(F.floor(F.col("i") / 2).alias("pair")).agg(F.min_by("line", "i").alias("name"), F.max_by("line", "i").alias("codes"))
    code = F.expr(r"try_cast(split(trim(codes), '\\s+')[0] as int)")
    coded = pair.select("pair", code.alias("label"), F.trim("name").alias("name"))
    plain = coded.agg(F.max("label").alias("_most"))  # one row
    named = coded.crossJoin(F.broadcast(plain)).select(F.when(F.col("_most").isNull(), F.col("pair") + 1).otherwise(F.col("label")).cast("int").alias("label"), "name").where("label >= 1")
    grid = named.agg(F.max("label").alias("most")).where("most is not null").select(F.explode(F.sequence(F.lit(1), F.col("most"))).alias("label"))
    return grid.join(named, "label", "left").select("label", F.coalesce("name", F.concat(F.lit("parcel_"), "label")).alias("name"))


def columns_map(spark: SparkSession, path: str) -> DataFrame:
    """merged_file, col_index, sid, state: rows without an integer index or without an id are left out."""
    rows = with_aliases(table(spark, path), ("col_index", "sid", "state"), ("merged_file",), ALIASES | {"col_index": ("col_index", "col", "index"), "state": ("state", "map"), "merged_file": ("merged_file", "file")})
    out = rows.select("merged_file", F.expr("try_cast(col_index as int)").alias("col_index"), F.trim("sid").alias("sid"), F.trim("state").alias("state"))
    return out.where("col_index is not null and sid <> '' and state <> ''")


def preflight(files: DataFrame) -> DataFrame:
    """keep beside files (name, n_dim, rows, p): those of two dimensions with the first one's p are kept.

    The files are given as `matrix_files.shapes` finds them, by headers and line ends alone.
    """
    first = files.where("n_dim = 2 and rows > 0").agg(F.min_by("p", "name").alias("first_p"))
    return files.crossJoin(F.broadcast(first)).select(*files.columns, ((F.col("n_dim") == 2) & (F.col("rows") > 0) & F.coalesce(F.col("p") == F.col("first_p"), F.lit(False))).alias("keep"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, sid, length of the files under a folder; their contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("name"), leading_token(name).alias("sid"), "length")


def design_covariates(spark: SparkSession, path: str) -> DataFrame:
    """sid, age, sex (1 for M, 0 for F), fd: rows without an id or a known sex are left out; a bad or missing fd is 0."""
    from statewalk.functions.expressions import sex_text

    rows = with_aliases(table(spark, path), ("sid", "age", "sex"), ("fd",), ALIASES | {"age": ("age", "agegroup", "age_group")})
    sex = sex_text(F.col("sex"))
    out = rows.select(F.trim("sid").alias("sid"), F.trim("age").alias("age"), F.when(sex == "M", 1.0).when(sex == "F", 0.0).alias("sex"), F.coalesce(F.expr("try_cast(fd as double)"), F.lit(0.0)).alias("fd"))
    return out.where("sid <> '' and sex is not null")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, sid: one id a line, blanks left out, each id at its first place."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("pos", "sid"))
    kept = lines.select("pos", F.trim("sid").alias("sid")).where("sid <> ''")
    return kept.groupBy("sid").agg(F.min("pos").alias("pos")).select("pos", "sid")


def used_rows(spark: SparkSession, path: str) -> DataFrame:
    """pos, sid, sex of every row of a table of used subjects, in the file's order, repeated ones too."""
    from statewalk.functions.expressions import sex_text

    rows = with_aliases(table(spark, path), ("sid",), ("sex",)).withColumn("pos", F.monotonically_increasing_id())
    return rows.select("pos", F.trim("sid").alias("sid"), sex_text(F.col("sex")).alias("sex")).where("sid <> ''")


def used_ids(spark: SparkSession, path: str) -> DataFrame:
    """pos, sid, sex of a table of used subjects, once each, at the place of the first row."""
    return used_rows(spark, path).groupBy("sid").agg(F.min("pos").alias("pos"), F.min("sex").alias("sex")).select("pos", "sid", "sex")


def label_names(spark: SparkSession, path: str) -> DataFrame:
    """p (from 0), name: the first column of a delimited list with a header, blanks left out."""
    sep = delimiter(spark, path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    return lines.where("i > 0").select((F.col("i") - 1).alias("p"), F.trim(F.split_part("line", F.lit(sep), F.lit(1))).alias("name")).where("name <> ''")


def mean_patterns(spark: SparkSession, path: str) -> DataFrame:
    """s, p, mean from a wide table with a column `state`, its other columns being features in their order."""
    wide = table(spark, path)
    rest = [c for c in wide.columns if c.lower() != "state"]
    values = F.posexplode(F.array(*[F.expr(f"try_cast(`{c}` as double)") for c in rest]))
    return wide.select(F.col("state").cast("double").cast("int").alias("s"), values.alias("p", "mean"))
