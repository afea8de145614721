"""Result files: a line of ``key=value;``, a header line, then ``;``-separated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def metadata_line(info: dict[str, str]) -> str:
    """Keys without a value stand alone."""
    return "".join(f"{k}={v};" if v != "" else f"{k};" for k, v in info.items())


def parse_metadata(line: str) -> dict[str, str]:
    found = {}
    for part in line.split(";"):
        if part.strip():
            key, _, value = part.partition("=")
            found[key.strip()] = value.strip()
    return found


def file_name(prefix: str, info: dict[str, str]) -> str:
    return f"{prefix}({metadata_line(info)}).csv"


def scientific(c: Column) -> Column:
    """17 significant digits, so that doubles survive the round trip."""
    return F.format_string("%.16e", c.cast("double"))


def lines(df: DataFrame, info: dict[str, str], order: list[str]) -> DataFrame:
    """(n, value): the file's lines; results are small summaries, so they are put in one order."""
    columns = [scientific(F.col(c)) if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes]
    body = df.orderBy(*order).select(F.concat(F.concat_ws(";", *columns), F.lit(";")).alias("value"))
    spark = df.sparkSession
    head = spark.createDataFrame([(0, metadata_line(info)), (1, "".join(f"{c};" for c in df.columns))], "n bigint, value string")
    return head.unionByName(body.withColumn("n", F.monotonically_increasing_id() + 2))


def write(df: DataFrame, path: str, info: dict[str, str], order: list[str]) -> None:
    lines(df, info, order).orderBy("n").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_numbers(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("double").alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, info map, row, name, value) of all files a path or glob names: one row a cell.

    Cells and not columns, because each file names its own; ``wide`` gives columns.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    clean = F.filter(F.transform(F.split(F.element_at("lines", 1), ";"), lambda x: F.trim(x)), lambda x: x != "")
    info = F.map_from_entries(F.transform(clean, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.when(x.contains("="), F.trim(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("value"))))
    rows = text.select("file", info.alias("info"), F.transform(F.split(F.element_at("lines", 2), ";"), lambda x: F.trim(x)).alias("names"), F.posexplode(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))).alias("row", "line")).where(F.trim("line") != "")
    cells = rows.select("file", "info", "row", "names", F.posexplode(F.split("line", ";")).alias("at", "cell"))
    named = cells.withColumn("name", F.try_element_at("names", F.col("at") + 1)).where("name IS NOT NULL AND name <> ''")
    return named.select("file", "info", "row", "name", F.trim("cell").cast("double").alias("value"))


def of_config(cells: DataFrame, **wanted: str) -> DataFrame:
    """The cells of files whose metadata has all the values wanted."""
    for key, value in wanted.items():
        cells = cells.where(F.element_at("info", key) == value)
    return cells


def wide(cells: DataFrame, names: list[str]) -> DataFrame:
    """A column for each of ``names``."""
    picked = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    return cells.groupBy("file", F.to_json("info").alias("info"), "row").agg(*picked)


# ---- results by configuration -----------------------------------------------


def write_partitioned(df: DataFrame, path: str, info: dict[str, str], format: str = "csv") -> None:
    """Results of one configuration into a folder a parameter: path/name=.../m=.../part-*.

    Other configurations under the same path stay.  In csv, doubles have 17 digits.
    """
    taken = {c.lower() for c in df.columns}
    if clash := [k for k in info if k.lower() in taken]:
        raise ValueError(f"parameters and columns share the names {clash}")
    cells = df.select(*(scientific(F.col(c)).alias(c) if format == "csv" and t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    named = cells.select("*", *(F.lit(v).alias(k) for k, v in info.items()))
    options = {"sep": ";", "header": "true"} if format == "csv" else {}
    spark = df.sparkSession
    # only the folder of this configuration is replaced
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy(*info).format(format).save(path)
    spark.catalog.refreshByPath(path)


def read_partitioned(spark: SparkSession, path: str, schema: str, parameters: list[str], format: str = "csv") -> DataFrame:
    """Rows of ``schema`` with a text column a parameter; a filter on parameters reads the folders it names and no others."""
    options = {"sep": ";", "header": "true"} if format == "csv" else {}
    whole = ", ".join([schema, *(f"`{p}` string" for p in parameters)])
    return spark.read.schema(whole).options(**options).format(format).load(path)


#: The names of the twelve quantities in joint result files, by those of this library.
JOINT_NAMES = {
    "difference1": "Difference1", "difference2": "Difference2", "intersection": "Intersection", "cardinality1": "1", "cardinality2": "2", "union": "Union",
    "jaccard": "Jaccard", "cosine": "Cosine", "inclusion1": "InclusionCoefficient1", "inclusion2": "InclusionCoefficient2", "alpha": "Alpha", "beta": "Beta",
}


def joint_columns(labels: list[str], bounds: bool = True) -> list[str]:
    """Columns of a joint result file: 12 true values, 24 an estimator, and 4 of the bounds from equal registers."""
    true = [f"true{n}" for n in JOINT_NAMES.values()]
    own = [f"{label}{kind}{n}" for label in labels for kind in ("Mean", "MSE") for n in JOINT_NAMES.values()]
    return true + own + ([f"coll{side}Bound{kind}Jaccard" for kind in ("Mean", "MSE") for side in ("Lower", "Upper")] if bounds else [])


def joint_schema(found: DataFrame, truth: DataFrame, keys: list[str], labels: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """(keys..., the columns of ``joint_columns``), one row a pair: cells (keys..., column, value) pivoted by column.

    ``found`` is (keys..., estimator, q) with a row an example, ``truth`` is
    (keys..., q), ``bounds`` is (keys..., lower, upper) with a row an example.
    """

    def named(prefix: Column | str, kind: str, name: Column) -> Column:
        return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit(kind), name)

    def spread(q: Column) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(n).alias("name"), q[c].alias("value")) for c, n in JOINT_NAMES.items())))

    true = truth.select(*keys, spread(F.col("q")).alias("s")).select(*keys, "s.name", F.col("s.value").alias("true"))
    own = found.select(*keys, "estimator", spread(F.col("q")).alias("s")).select(*keys, F.col("estimator").alias("prefix"), "s.*", F.lit("").alias("bound"))
    if bounds is not None:
        sides = F.explode(F.array(*(F.struct(F.lit(f"{c.capitalize()}Bound").alias("bound"), F.col(c).alias("value")) for c in ("lower", "upper"))))
        ends = bounds.select(*keys, sides.alias("s")).select(*keys, F.lit("coll").alias("prefix"), F.lit("Jaccard").alias("name"), "s.value", "s.bound")
        own = own.unionByName(ends)
    off = F.col("value") - F.col("true")
    errors = own.join(true, [*keys, "name"]).groupBy(*keys, "prefix", "bound", "name").agg(F.avg("value").alias("Mean"), F.avg(off * off).alias("MSE"))
    kinds = F.explode(F.array(*(F.struct(named(F.concat("prefix", "bound"), k, F.col("name")).alias("column"), F.col(k).alias("value")) for k in ("Mean", "MSE"))))
    cells = errors.select(*keys, kinds.alias("s")).select(*keys, "s.*").unionByName(true.select(*keys, named("true", "", F.col("name")).alias("column"), F.col("true").alias("value")))
    return cells.groupBy(*keys).pivot("column", joint_columns(labels, bounds is not None)).agg(F.first("value"))
