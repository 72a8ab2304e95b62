"""File sources and sinks (A1-A10): CSV/JSON/text run artefacts as DataFrames.

Every reader takes an explicit schema where the layout is known (no
inference pass over the data), reads whole directories with globs so many
runs load in one distributed scan, and tags rows with the directory they
came from through the ``_metadata.file_path`` column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranges

DOC_SCHEMA = T.StructType([T.StructField("abstract", T.StringType()), T.StructField("label", T.StringType())])


def csv_reader(spark: SparkSession, schema: T.StructType | str | None, multi_line: bool = False):
    """CSV reader matching ``write_csv``: header, quoted fields, explicit schema.

    ``multi_line`` is for texts with line breaks: such a file is one split.  Numeric logs are read without it.
    """
    r = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
         .option("mode", "FAILFAST"))
    return r.schema(schema) if schema is not None else r.option("inferSchema", True)


def scan_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = DOC_SCHEMA,
                   text_col: str = "abstract", label_col: str = "label", record_col: str | None = None) -> DataFrame:
    """A1: labelled CSV with header and quoted multi-line text -> ``(doc_id, text, label, ...)``.

    A file is read by ranges, many tasks at once (``sources.ranges``).  Without a ``doc_id`` column, the id is a hash of
    the file's name and the row, so it is the same in each run, however the files are split; rows that repeat in a file
    share it.  ``record_col`` adds a number that tells these apart.
    """
    if schema is None:
        kind = csv_reader(spark, None, multi_line=True).csv(path).schema
    else:
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    df = ranges.scan_csv(spark, path, kind, record_col=record_col).withColumnsRenamed({text_col: "text", label_col: "label"})
    if "doc_id" in df.columns:
        return df.drop("_file")
    own = [c for c in df.columns if c not in ("_file", record_col)]
    return df.withColumn("doc_id", F.xxhash64("_file", *own)).drop("_file")


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV sink that round-trips through ``scan_*`` (header, RFC-4180 quoting, no trimming)."""
    w = folder_writer(df, partition_by) if partition_by else df.write
    (w.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)).csv(path)


def folder_writer(df: DataFrame, keys: list[str], deal: list[str] | None = None):
    """Writer of a folder per value of ``keys``, for tables of many small folders (one per run and epoch, say).

    Such tables cost by the file.  A folder's rows go to one task, so it gets one file, and all tasks share the work,
    however few bytes there are.  Tasks put their files in place themselves; a driver that renames them one by one would
    take longer than all tasks.  ``deal`` (default: ``keys``) names the first of the keys if few folders share its value:
    these move together then.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *(deal or keys)).write.partitionBy(*keys) \
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def parent_dir(col_path=None) -> F.Column:
    """Basename of a file's directory, URL-decoded, with any ``key=`` prefix removed."""
    p = F.url_decode(F.col("_metadata.file_path")) if col_path is None else col_path
    d = F.regexp_extract(p, r"([^/]+)/[^/]+$", 1)
    return F.regexp_replace(d, r"^[^=/]+=", "")


def scan_runs(spark: SparkSession, root: str, file_glob: str = "metrics.csv",
              schema: T.StructType | str | None = None, tag: str = "run") -> DataFrame:
    """A2: read ``root/*/<file_glob>`` of many run directories in one scan, tagged by directory.

    Directory names such as ``(100, 50)`` and CRLF line ends are fine; a run
    directory without the file simply contributes no rows, and if none has it, the scan is empty (see A10).
    """
    path = f"{root.rstrip('/')}/*/{file_glob}"
    if schema is not None and not _any_file(spark, path):
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], T.StructType([T.StructField(tag, T.StringType()), *kind.fields]))
    df = csv_reader(spark, schema).csv(path)
    return df.select(parent_dir().alias(tag), *df.columns)


def _any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern matches anything, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def scan_nested_runs(spark: SparkSession, root: str, file_name: str, schema, tags: tuple[str, str]) -> DataFrame:
    """A2 for two-level layouts ``root/<a>/<b>/<file>`` (e.g. vectorizer/layers/loss.csv)."""
    df = listed(csv_reader(spark, schema), file_name).csv(root).where(_below(spark, root, 3))
    p = F.url_decode(F.col("_metadata.file_path"))
    return df.select(
        F.regexp_replace(F.regexp_extract(p, r"([^/]+)/[^/]+/[^/]+$", 1), r"^[^=/]+=", "").alias(tags[0]),
        F.regexp_replace(F.regexp_extract(p, r"([^/]+)/[^/]+$", 1), r"^[^=/]+=", "").alias(tags[1]),
        *df.columns)


def listed(reader, file_name: str):
    """A reader of all files of a name below a folder: tasks list its folders, where the driver alone expands a pattern."""
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)


def _below(spark: SparkSession, root: str, levels: int) -> F.Column:
    """Whether a row's file stands so many levels below ``root``; decided for a file before it is read."""
    fs, to_path = _fs(spark, root)
    path = F.regexp_replace("_metadata.file_path", r"^\w+:(//[^/]*)?(?=/)", "")
    return F.size(F.split(path, "/")) - 1 == fs.makeQualified(to_path(root)).depth() + levels


def scan_json_arrays(spark: SparkSession, path: str, schema: T.StructType | str,
                     multiline: bool = True, tag: str | None = "run") -> DataFrame:
    """A3: JSON files holding an array of objects (or one object) -> one row per object.

    ``multiline`` files are cut at their top-level objects and read by ranges, many tasks per file (``sources.ranges``);
    others have one object per line.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if multiline:
        df = ranges.scan_json(spark, path, kind)
        return df.select(parent_dir(F.url_decode("_path")).alias(tag), *kind.names) if tag else df.select(*kind.names)
    df = spark.read.schema(kind).json(path)
    return df.select(parent_dir().alias(tag), *df.columns) if tag else df


def write_json_arrays(df: DataFrame, path: str, partition_by: str, rows_per_file: int = 10_000) -> None:
    """The layout that ``scan_json_arrays`` reads: files with one pretty-printed JSON array of objects each, below a
    folder per value of ``partition_by``; a file has ``rows_per_file`` objects at most, about."""
    cols = [c for c in df.columns if c != partition_by]
    sizes = df.groupBy(partition_by).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))  # one row per folder
    dealt = df.join(sizes, partition_by).withColumn("_file", F.pmod(F.xxhash64(*cols), F.col("_files")))
    arrays = dealt.groupBy(partition_by, "_file").agg(F.to_json(F.collect_list(F.struct(*cols)), {"pretty": "true"}).alias("value"))
    # a file is one JSON value, so one array
    arrays.select(partition_by, "value").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy(partition_by).text(path)


def write_traces(df: DataFrame, path: str, run: str = "run") -> None:
    """``path/<run>/epoch_N``: a folder with one trace each, as ``scan_attention_trace`` reads them."""
    named = df.withColumn("_f", F.concat(F.lit("epoch_"), F.col("epoch").cast("string")))
    folder_writer(named, [run, "_f"], [run]).mode("overwrite").json(path)


TRACE_SCHEMA = "epoch INT, tokens ARRAY<STRING>, attention_weights ARRAY<DOUBLE>"


def scan_attention_trace(spark: SparkSession, directory: str, schema: str = TRACE_SCHEMA,
                         pattern: str = "epoch_*.json", tag: str | None = None) -> DataFrame:
    """A4: ``epoch_N.json`` traces in numeric N order (epoch_10 after epoch_9).

    N is read from the file (or folder) name, so ``epoch_N`` folders written by
    Spark's partitioned JSON sink load the same way.
    """
    reader, *above, name = spark.read.schema(schema).option("multiLine", True), *pattern.split("/")
    if above and set(above) == {"*"}:
        df = listed(reader, name).json(directory).where(_below(spark, directory, len(above) + 1))
    else:
        df = reader.json(f"{directory.rstrip('/')}/{pattern}")
    n = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"epoch_(\d+)(?:\.json)?(?:/[^/]*)?$", 1)
    df = df.withColumn("file_epoch", n.cast("int"))
    if tag is None:
        return df.orderBy("file_epoch")
    # traces of several runs: the folder above the epochs names the run
    run = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/]+)/(?:[^/=]+=)?epoch_\d+(?:\.json)?(?:/[^/]*)?$", 1)
    return df.withColumn(tag, F.regexp_replace(run, r"^[^=/]+=", "")).orderBy(tag, "file_epoch")


def scan_vectors(spark: SparkSession, path: str, dim: int | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """A5: word vectors ``token v1 ... vd`` -> ``(token, vector ARRAY<FLOAT>)``.

    Lines may end in white space.  A header (two integers) is dropped where a file begins with it: such a line has one
    number behind its token, so it counts as header only if ``dim`` is not 1.  A line of another width than ``dim``
    (without ``dim``: an empty one) or with a value that is no number raises; ``rejected_vectors`` lists such lines.
    With ``tokens`` (a table with a column ``token``) only the lines of these tokens are parsed, and checked.
    """
    rows = _vector_lines(spark, path, dim, tokens)
    checked = F.when(F.col("ok"), F.col("vector")).otherwise(
        F.raise_error(F.concat(F.lit("not a word vector: "), F.substring("value", 1, 80))).cast("array<float>"))
    return rows.select("token", checked.alias("vector"))


def rejected_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``value``: the lines that ``scan_vectors`` would refuse."""
    return _vector_lines(spark, path, dim).where("not ok").select("value")


def _vector_lines(spark: SparkSession, path: str, dim: int | None, tokens: DataFrame | None = None) -> DataFrame:
    parts = F.split(F.rtrim("value"), r"\s+")
    numbers = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("float"))
    df = spark.read.text(path)
    if dim != 1:
        df = df.where(~F.col("value").rlike(r"^\d+ \d+\s*$"))
    if tokens is not None:
        first = df.withColumn("_token", F.regexp_substr("value", F.lit(r"^\S*")))
        df = first.join(tokens.select(F.col("token").alias("_token")), "_token", "left_semi").select("value")
    ok = F.forall("vector", lambda x: x.isNotNull()) & (F.size("vector") == dim if dim else F.size("vector") > 0)
    return df.select("value", parts.getItem(0).alias("token"), numbers.alias("vector")).withColumn("ok", ok)


def write_vectors(df: DataFrame, path: str) -> None:
    """Text sink in the same word-vector layout."""
    line = F.concat_ws(" ", F.col("token"), F.array_join(F.transform("vector", lambda x: x.cast("string")), " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def sink_history(history: DataFrame, path: str, keys: tuple[str, ...] = ("vectorizer", "hidden")) -> None:
    """loss/accuracy history, one directory per experiment key, overwritten as a whole."""
    write_csv(history, path, partition_by=list(keys))


def sink_sweep(history: DataFrame, accuracies: DataFrame, path: str, keys: tuple[str, ...] = ("vectorizer", "hidden")) -> str:
    """Loss histories and accuracies of a sweep, published together: a reader never sees one without the other."""
    return publish(history.sparkSession, path, {"loss": lambda folder: sink_history(history, folder, keys),
                                                "accuracies": lambda folder: sink_accuracies(accuracies, folder)})


def sink_accuracies(accuracies: DataFrame, path: str) -> None:
    """The table of all experiments' accuracies (one row per experiment key) beside their loss histories."""
    write_csv(accuracies, path)


def sink_metrics(metrics: DataFrame, path: str, formats: tuple[str, ...] = ("json", "csv")) -> None:
    """Metrics tables as JSON and/or CSV under ``path/<format>``."""
    for fmt in formats:
        if fmt == "csv":
            write_csv(metrics, f"{path}/csv")
        else:
            metrics.write.mode("overwrite").format(fmt).save(f"{path}/{fmt}")


#: Nested metrics of one run: figures, a map of classes and the matrix of counts (rows: true classes).
TEST_METRICS_SCHEMA = ("accuracy DOUBLE, macro_f1 DOUBLE, classes ARRAY<STRING>, confusion_matrix ARRAY<ARRAY<BIGINT>>, "
                       "per_class MAP<STRING, STRUCT<precision: DOUBLE, recall: DOUBLE, f1: DOUBLE, support: BIGINT>>")


def write_json_documents(df: DataFrame, path: str, partition_by: str) -> None:
    """One pretty-printed JSON object per row, each in a file of its own below its ``partition_by`` folder."""
    cols = [c for c in df.columns if c != partition_by]
    docs = df.select(partition_by, F.to_json(F.struct(*cols), {"pretty": "true"}).alias("value"))
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy(partition_by).text(path)


def sink_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """A split table partitioned by split name (readers prune to one split)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


MANIFEST = "_current"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, path: str, writers: dict[str, Callable[[str], None]]) -> str:
    """Writes a set of tables or files that readers see as a whole or not at all; returns the version's folder.

    Every writer gets a folder of its own below a version that nobody reads yet.  When all have succeeded, a manifest
    named by the version's number is put in place by one rename, which fails if another writer took that number.
    Readers take the highest manifest (``published``); a writer that dies half-way leaves the set before it in force.
    """
    fs, to_path = _fs(spark, path)
    version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
    for name, write in writers.items():
        write(f"{version}/{name}")
    draft = f"{version}/{MANIFEST}"
    out = fs.create(to_path(draft))
    out.write(bytearray(json.dumps({"version": version.rsplit("/", 1)[1], "names": list(writers)}).encode()))
    out.close()
    fs.mkdirs(to_path(f"{path.rstrip('/')}/{MANIFEST}"))
    number = _latest(spark, path)[0] + 1
    target = to_path(f"{path.rstrip('/')}/{MANIFEST}/{number:012d}.json")
    if fs.exists(target) or not fs.rename(to_path(draft), target):
        raise RuntimeError(f"{path}: another writer has published version {number}")
    return version


def _latest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    fs, to_path = _fs(spark, path)
    found = fs.globStatus(to_path(f"{path.rstrip('/')}/{MANIFEST}/*.json"))
    names = sorted(f.getPath().getName() for f in found or [])
    return (int(names[-1].split(".")[0]), f"{path.rstrip('/')}/{MANIFEST}/{names[-1]}") if names else (0, None)


def published(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete set below ``path``; raises where there is none."""
    _, manifest = _latest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"{path}: no complete set of tables")
    text = spark.read.text(manifest, wholetext=True).first()["value"]
    return f"{path.rstrip('/')}/{json.loads(text)['version']}"


def save_artifacts(tables: dict[str, DataFrame], path: str) -> None:
    """Vocabulary, label dictionary, prepared table -> parquet tables (no pickles), published together."""
    spark = next(iter(tables.values())).sparkSession
    publish(spark, path, {name: df.write.parquet for name, df in tables.items()})


def load_artifacts(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    folder = published(spark, path)
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def optional_inputs(requested: DataFrame, found: DataFrame, key: str = "run") -> DataFrame:
    """A10: requested runs with no file found -> warning rows; the others are analysed as usual."""
    return requested.select(key).distinct().join(found.select(key).distinct(), key, "left_anti") \
        .withColumn("status", F.lit("missing"))


def scan_mandatory(spark: SparkSession, root: str, file_glob: str, schema: T.StructType | str, tag: str = "run") -> DataFrame:
    """A10: the file that every run must have (``metrics.csv``): raises if a run directory lacks it, naming the runs."""
    fs, to_path = _fs(spark, root)
    runs = [f.getPath() for f in fs.globStatus(to_path(f"{root.rstrip('/')}/*")) or [] if f.isDirectory()]
    missing = [p.getName() for p in runs if not fs.globStatus(to_path(f"{p.toString()}/{file_glob}"))]
    if missing or not runs:
        raise FileNotFoundError(f"{file_glob} is missing in: {', '.join(sorted(missing)) or root}")
    return scan_runs(spark, root, file_glob, schema, tag)


# -- what an evaluation writes (A7) and an analysis reads (A3)
HIDDEN_STATES_SCHEMA = "row_id BIGINT, hidden_state ARRAY<DOUBLE>, label STRING"
MISCLASSIFIED_SCHEMA = "row_id BIGINT, true_label STRING, predicted_label STRING, confidence DOUBLE"
PREDICTIONS_SCHEMA = "row_id BIGINT, true_label STRING, predicted_label STRING, probabilities ARRAY<DOUBLE>"
ATTENTION_SCHEMA = "row_id BIGINT, tokens ARRAY<STRING>, attention_weights ARRAY<DOUBLE>"
EVALUATION_SCHEMAS = {"hidden_states": HIDDEN_STATES_SCHEMA, "misclassified": MISCLASSIFIED_SCHEMA,
                      "predictions": PREDICTIONS_SCHEMA, "attention_examples": ATTENTION_SCHEMA}


def sink_evaluation(tables: dict[str, DataFrame], path: str, rows_per_file: int = 10_000) -> str:
    """The documents of an evaluation as JSON arrays by run, published as one set.

    ``tables`` names any of EVALUATION_SCHEMAS; each has a column ``run`` beside its schema's.  ``test_metrics`` (one row
    per run) is written as one object per run.
    """
    spark = next(iter(tables.values())).sparkSession
    writers: dict[str, Callable[[str], None]] = {}
    for name, df in tables.items():
        if name == "test_metrics":
            writers[name] = lambda folder, df=df: write_json_documents(df, folder, "run")
        else:
            columns = T.StructType.fromDDL(EVALUATION_SCHEMAS[name]).names
            writers[name] = lambda folder, df=df.select("run", *columns): write_json_arrays(df, folder, "run", rows_per_file)
    return publish(spark, path, writers)


def scan_evaluation(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A3: one kind of document of the newest complete evaluation, tagged by run."""
    schema = TEST_METRICS_SCHEMA if name == "test_metrics" else EVALUATION_SCHEMAS[name]
    return scan_json_arrays(spark, f"{published(spark, path)}/{name}/*/*.txt", schema)
