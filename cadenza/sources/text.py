"""Text sources: delimited series files, scattered points, and positions with covariances."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.timefn import parse_time, timestamp_from_mjd
from cadenza.schema import CadenzaError, ConfigError, FileNotFound, ParseError

EXTENSIONS = "{*.csv,*.txt,*.log,[!.]*}"


def lines(spark: SparkSession, paths: str | Sequence[str], comment: str = "%") -> DataFrame:
    """(path, seq, line) without blank and comment lines; seq keeps the order inside a file."""
    t = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("seq"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"))
    return t.where((F.length(F.trim("line")) > 0) & ~F.ltrim("line").startswith(comment)).drop("_at")


def line_counts(spark: SparkSession, paths: str | Sequence[str], comment: str = "%") -> DataFrame:
    """Per file: its lines, the blank ones, the comments, and the lines of data."""
    t = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("path"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"))
    blank, note = F.length(F.trim("line")) == 0, F.ltrim("line").startswith(comment)
    return t.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(blank).alias("n_blank"), F.count_if(~blank & note).alias("n_comment"), F.count_if(~blank & ~note).alias("n_data"))


def header_names(spark: SparkSession, path: str, comment: str = "%") -> list[str]:
    """Names of a comment line '<comment> columns: a, b [m]' among the first lines, whatever its case."""
    pat = re.compile(rf"^\s*{re.escape(comment)}\s*columns\s*:\s*(.*)$", re.I)
    for r in spark.read.text(path).limit(200).collect():
        if m := pat.match(r[0]):
            return [x.strip() for x in m[1].split(",")]
    return []


def name_and_unit(name: str) -> tuple[str, str]:
    m = re.match(r"^(.*?)\s*\[(.*)\]\s*$", name)
    return (m[1].strip(), m[2].strip()) if m else (name, "-")


def _rows(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ";", comment: str = "%", time_format: str = "mjd", time_columns: Sequence[int] = (0,), columns: Sequence[int] = ()) -> tuple[DataFrame, list[int], dict[int, tuple[str, str]]]:
    """(path, seq, mjd, _v<column>...) of the lines that can be read; the columns chosen, their names and units."""
    if len(delimiter) != 1:
        raise ConfigError("the delimiter is one character")
    first = lines(spark, paths, comment)
    head = first.limit(1).collect()
    one = paths if isinstance(paths, str) else paths[0]
    names = header_names(spark, one, comment)
    width = len(head[0]["line"].rstrip(delimiter if delimiter.strip() else "").split(delimiter)) if head else 0
    chosen = [c for c in (columns or range(1, width + 1)) if 1 <= c <= width and c - 1 not in time_columns]
    f = first.withColumn("_f", F.split("line", re.escape(delimiter)))
    need = max([*(c for c in chosen), *(t + 1 for t in time_columns), 1])
    f = f.where(F.size("_f") >= need)
    vals = [F.trim(F.get("_f", F.lit(c - 1))).try_cast("double").alias(f"_v{c}") for c in chosen]
    f = f.select("path", "seq", parse_time(time_format, [F.trim(F.get("_f", F.lit(i))) for i in time_columns]).alias("mjd"), *vals)
    ok = F.col("mjd").isNotNull()
    for c in chosen:
        ok = ok & F.col(f"_v{c}").isNotNull()
    return f.where(ok), chosen, {c: name_and_unit(names[c - 1]) if c <= len(names) else (f"col_{c}", "-") for c in chosen}


def read_series(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ";", comment: str = "%", time_format: str = "mjd", time_columns: Sequence[int] = (0,), columns: Sequence[int] = (), station: str | None = None) -> DataFrame:
    """Series in long form (station_id, component, unit, seq, t, mjd, value, flag), one for each value column.

    columns: field numbers from 1; empty: all that are not time fields, counted on the first data row. A line with too few
    fields, a bad time or a bad number in any chosen column is dropped whole. The delimiter is one character and repeats
    are not collapsed; a trailing empty field does not count.
    """
    f, chosen, label = _rows(spark, paths, delimiter, comment, time_format, time_columns, columns)
    long = F.array(*[F.struct(F.lit(label[c][0]).alias("component"), F.lit(label[c][1]).alias("unit"), F.col(f"_v{c}").alias("value")) for c in chosen]) if chosen else F.array().cast("array<struct<component:string,unit:string,value:double>>")
    s = F.lit(station) if station else F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return f.withColumn("_e", F.explode(long)).select(s.alias("station_id"), "_e.component", "_e.unit", "seq", timestamp_from_mjd(F.col("mjd")).alias("t"), "mjd", "_e.value", F.lit(0).cast("smallint").alias("flag"))


def read_report(spark: SparkSession, paths: str | Sequence[str], comment: str = "%", **kw) -> DataFrame:
    """line_counts(), with the lines of data that read_series() takes (n_read) and those that it drops (n_skipped)."""
    rows = _rows(spark, paths, comment=comment, **kw)[0]
    n = line_counts(spark, paths, comment).join(rows.groupBy("path").agg(F.count("*").alias("n_read")), "path", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))
    return n.withColumn("n_skipped", F.col("n_data") - F.col("n_read"))


def read_each(spark: SparkSession, paths: Sequence[str], **kw) -> tuple[DataFrame | None, dict[str, str]]:
    """The series of all files that can be read, and an error for each that cannot: one bad file does not stop the rest.

    Each file has its own header, columns and units. Only its first lines come to the driver.
    """
    out, errors = None, {}
    for p in paths:
        try:
            one = read_series(spark, p, **kw)
            if not one.limit(1).count():
                raise ParseError("no line of data could be read")
        except (CadenzaError, PySparkException) as e:
            errors[p] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
            continue
        out = one if out is None else out.unionByName(one)
    return out, errors


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of one directory level, by name; hidden files and other endings are passed over."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for st in fs.listStatus(fs_path):
        n = st.getPath().getName()
        if st.isFile() and not n.startswith(".") and (n.rsplit(".", 1)[-1] in ("csv", "txt", "log") if "." in n else True):
            found.append(st.getPath().toString())
    if not found:
        raise FileNotFound(path)
    return sorted(found)


def scan_directory(spark: SparkSession, path: str, **kw) -> DataFrame:
    """All data files of one directory level in one scan, which must have the same layout; read_each() takes any."""
    return read_series(spark, data_files(spark, path), **kw)


def read_points(spark: SparkSession, path: str, x: int = 0, y: int = 1, values: Sequence[int] = (2,), delimiter: str = " ", comment: str = "#", mark: float | None = None, tolerance: float = 0.01) -> DataFrame:
    """Scattered points in long form (var, x, y, value); delimiter ' ' is any white space. No-data rows and cells drop out."""
    names = []
    for r in spark.read.text(path).limit(100).collect():
        s = r[0].strip()
        if not s.startswith(comment):
            break
        names.append(s[len(comment) :].strip())
    labels = names[2:] if len(names) > 2 and names[1].isdigit() else []
    f = lines(spark, path, comment).withColumn("_f", F.split(F.trim("line"), r"\s+" if delimiter == " " else re.escape(delimiter)))
    get = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    f = f.select(get(x).alias("x"), get(y).alias("y"), *[get(v).alias(labels[v] if v < len(labels) else f"col_{v}") for v in values])
    names_ = f.columns[2:]
    out = f.where("x is not null and y is not null").unpivot(["x", "y"], names_, "var", "value").where("value is not null").select("var", "x", "y", "value")
    if mark is not None:
        from cadenza.operators.spatial import no_data

        out = no_data(out, mark, tolerance)
    return out


def read_positions(spark: SparkSession, path: str, n: int = 3, delimiter: str = ";", comment: str = "#") -> DataFrame:
    """(pt, pos, cov): n state columns and, if the first row has them, the upper triangle of the covariance."""
    if n not in (3, 6):
        raise ConfigError("a state has 3 or 6 columns")
    f = lines(spark, path, comment).withColumn("_f", F.transform(F.split("line", re.escape(delimiter)), lambda v: F.trim(v).try_cast("double")))
    head = f.limit(1).collect()
    with_cov = bool(head) and len([v for v in head[0]["_f"] if v is not None]) >= n + n * (n + 1) // 2
    need = n + (n * (n + 1) // 2 if with_cov else 0)
    short = F.size(F.filter("_f", lambda v: v.isNotNull())) < need
    f = f.withColumn("_f", F.when(short, F.raise_error(F.lit("a row of positions is too short"))).otherwise(F.col("_f")))
    at = {}
    k = n
    for i in range(n):
        for j in range(i, n):
            at[i, j] = at[j, i] = k
            k += 1
    cov = F.array(*[F.array(*[F.get("_f", F.lit(at[i, j])) for j in range(n)]) for i in range(n)]) if with_cov else F.lit(None).cast("array<array<double>>")
    return f.select(F.col("seq").alias("pt"), F.slice("_f", 1, n).alias("pos"), cov.alias("cov"))


def require(df: DataFrame, what: str) -> DataFrame:
    if not df.limit(1).count():
        raise ParseError(f"no rows in {what}")
    return df
