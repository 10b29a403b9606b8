"""Readers: whole documents and lines to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.catalog import CONFIG_SPACE_LINE, Knob
from tunelake.constants import BENCHMARK_FOLDERS, METRIC_NAMES, THROUGHPUT_KEY
from tunelake.functions.text import extract_json_object, strip
from tunelake.operators.features import statements
from tunelake.operators.skew import BROADCAST_ROWS as CATALOG_LIMIT
from tunelake.operators.plan_trees import read_plan_rows

# Patterns of paths and log lines.
RUN_PATH = r"([^/]+)_smac_output/(run_[^/]*)/[^/]+$"
METRICS_PATH = r"([^/]+)_internal_metrics\.json$"
LOG_LINE = r"^\[([^\]]*?):([^:\]]+)#L(\d+):([A-Z]+)\]: (.*)$"
LOG_THROUGHPUT = r"throughput: ([-+0-9.eE]+)$"
BACKUP_MARK = ".OLD"


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, text), one row per file."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return found.select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def line_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, line), one row per line."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")
    )


def parse_knob_catalog(docs: DataFrame) -> DataFrame:
    """(knob, type, min, max, default) from catalog documents {name: {min, max, type, default}}.

    Limits may be numbers or texts of numbers, as in a dump of the server's settings.
    """
    limits = "map<string,struct<min:string,max:string,type:string,default:string>>"
    return docs.select(F.explode(F.from_json("text", limits)).alias("knob", "d")).select(
        "knob",
        F.col("d.type").alias("type"),
        *[F.col(f"d.{c}").try_cast("double").alias(c) for c in ("min", "max", "default")],
    )


def read_knob_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_knob_catalog(whole_files(spark, path))


def parse_config_space(lines: DataFrame) -> DataFrame:
    """(knob, type, min, max, default) from `name type [min, max] [default]` lines."""
    line = strip(F.col("line"))

    def part(i: int) -> Column:
        return F.regexp_extract(line, CONFIG_SPACE_LINE, i)

    numbers = [part(i).cast("double").alias(n) for i, n in ((3, "min"), (4, "max"), (5, "default"))]
    return lines.filter(line.rlike(CONFIG_SPACE_LINE)).select(
        part(1).alias("knob"), part(2).alias("type"), *numbers
    )


def read_config_space(spark: SparkSession, path: str) -> DataFrame:
    return parse_config_space(line_files(spark, path))


def catalog_records(table: DataFrame) -> list[Knob]:
    """A catalog table as plain records in name order; one of more than CATALOG_LIMIT knobs is refused."""
    rows = table.select("knob", "type", "min", "max", "default").limit(CATALOG_LIMIT + 1).collect()
    if len(rows) > CATALOG_LIMIT:
        raise ValueError(f"a catalog with more than {CATALOG_LIMIT} knobs")
    return sorted((Knob(*r) for r in rows), key=lambda k: k.knob)


def plain_path(path: Column) -> Column:
    """A local path spelled with or without an authority, in one form."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def run_folder(path: Column) -> list[Column]:
    """Workload and run folder of a history path."""
    return [
        F.regexp_extract(path, RUN_PATH, 1).alias("workload"),
        F.regexp_extract(path, RUN_PATH, 2).alias("run_folder"),
    ]


def first_run_folder(paths: DataFrame) -> DataFrame:
    """Paths of one run folder per workload: the first by name, backups left out."""
    named = paths.select("path", *run_folder(F.col("path"))).filter(
        (F.col("workload") != "") & ~F.contains(F.col("run_folder"), F.lit(BACKUP_MARK))
    )
    first = named.groupBy("workload").agg(F.min("run_folder").alias("run_folder"))
    return named.join(first, ["workload", "run_folder"], "left_semi")


def parse_runs(docs: DataFrame) -> DataFrame:
    """(workload, run_ord, config_id, cost) from history documents (workload, text).

    An entry of `data` is [[config id, ...], [cost, ...]].
    """
    data = F.try_variant_get(F.try_parse_json("text"), "$.data", "array<variant>")
    run = F.col("run")
    found = docs.select("workload", F.posexplode_outer(data).alias("run_ord", "run"))
    return found.filter(F.col("run_ord").isNotNull()).select(
        "workload",
        F.col("run_ord").cast("long").alias("run_ord"),
        F.try_variant_get(run, "$[0][0]", "string").alias("config_id"),
        F.try_variant_get(run, "$[1][0]", "double").alias("cost"),
    )


def parse_configs(docs: DataFrame) -> DataFrame:
    """(workload, config_id, knobs map) from history documents."""
    configs = F.try_variant_get(F.try_parse_json("text"), "$.configs", "map<string,map<string,double>>")
    found = docs.select("workload", F.explode_outer(configs).alias("config_id", "knobs"))
    return found.filter(F.col("config_id").isNotNull())


def read_run_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs and configurations of every `*_smac_output/run_*/runhistory.json` below a folder.

    The folders are chosen from the listing, which reads no contents.
    """
    names = {"pathGlobFilter": "runhistory.json", "recursiveFileLookup": True}
    listed = spark.read.format("binaryFile").options(**names).load(path).select(plain_path(F.col("path")).alias("path"))
    files = whole_files(spark, path, "runhistory.json").withColumn("path", plain_path(F.col("path")))
    docs = files.join(first_run_folder(listed), "path")
    return parse_runs(docs), parse_configs(docs)


def parse_metrics(docs: DataFrame) -> DataFrame:
    """(workload, inner_metrics array) from counter documents in object or list form.

    A list of a wrong length is kept as it is; the record builders reject it.
    """
    as_map = F.from_json("text", "map<string,double>")
    from_map = F.array(*[F.try_element_at("_map", F.lit(n)) for n in METRIC_NAMES])
    as_list = F.from_json("text", "array<double>")
    is_list = F.startswith(F.ltrim(F.col("text")), F.lit("["))
    return docs.withColumn("_map", F.when(~is_list, as_map)).select(
        "workload", F.when(is_list, as_list).otherwise(from_map).alias("inner_metrics")
    )


def read_internal_metrics(spark: SparkSession, path: str) -> DataFrame:
    docs = whole_files(spark, path, "*_internal_metrics.json")
    return parse_metrics(
        docs.withColumn("workload", F.regexp_extract("path", METRICS_PATH, 1))
    )


def with_both_files(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Workload names that have a run history and a counter file."""
    return runs.select("workload").distinct().join(metrics.select("workload").distinct(), "workload")


def read_families(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Run tables of the five benchmark families, by family name."""
    return {
        family: read_run_history(spark, f"{base}/{folder}")[0]
        for family, folder in BENCHMARK_FOLDERS.items()
    }


def wide_configs(configs: DataFrame, knobs: list[str], key: list[str]) -> DataFrame:
    """Knob maps as one column per knob; absent knobs are null."""
    return configs.select(
        *key, *[F.try_element_at("knobs", F.lit(k)).alias(k) for k in knobs]
    )


def read_statements(spark: SparkSession, path: str, rule: str = "replay") -> DataFrame:
    """Statements of every workload file, keyed by file name."""
    files = whole_files(spark, path, "*.wg")
    named = files.withColumn("workload", F.regexp_extract("path", r"([^/]+)\.wg$", 1))
    return statements(named, rule)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """One row per plan of every plan file; entries without a plan are skipped."""
    files = whole_files(spark, path, "*.json")
    return read_plan_rows(files.withColumn("workload", F.regexp_extract("path", r"([^/]+)\.json$", 1)))


BENCHMARK_XML = (
    "url string, scalefactor double, terminals int,"
    " works struct<work: array<struct<time: int, rate: string, weights: string>>>,"
    " transactiontypes struct<transactiontype: array<struct<name: string>>>"
)


def parse_benchmark_xml(docs: DataFrame) -> DataFrame:
    """Benchmark settings of (path, text), a row per `work` phase: weights as integers, transaction names in order."""
    parsed = docs.select("path", F.from_xml("text", BENCHMARK_XML, {"mode": "PERMISSIVE"}).alias("x"))
    work = F.col("work")
    phases = parsed.select("path", "x", F.posexplode_outer("x.works.work").alias("phase", "work"))
    return phases.select(
        F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("workload"),
        "x.url",
        "x.scalefactor",
        "x.terminals",
        "phase",
        work["time"].alias("time"),
        work["rate"].alias("rate"),
        F.transform(F.split(work["weights"], ","), lambda w: F.trim(w).cast("int")).alias("weights"),
        F.col("x.transactiontypes.transactiontype.name").alias("transactions"),
    )


def read_benchmark_xml(spark: SparkSession, path: str) -> DataFrame:
    return parse_benchmark_xml(whole_files(spark, path, "*.xml"))


def parse_benchmark_summary(docs: DataFrame) -> DataFrame:
    """(path, throughput) from summary documents; unreadable or missing values give 0.0."""
    value = F.try_variant_get(F.try_parse_json("text"), f"$['{THROUGHPUT_KEY}']", "double")
    return docs.select("path", F.coalesce(value, F.lit(0.0)).alias("throughput"))


def read_benchmark_summary(spark: SparkSession, path: str) -> DataFrame:
    return parse_benchmark_summary(whole_files(spark, path, "*.summary.json"))


def parse_result_lines(lines: DataFrame) -> DataFrame:
    """(path, name, qps) from `name: qps` lines; blank lines are skipped, others without a number have a null qps."""
    parts = F.split("line", ":")
    return lines.filter(strip(F.col("line")) != "").select(
        "path",
        strip(F.get(parts, F.lit(0))).alias("name"),
        strip(F.get(parts, F.lit(1))).try_cast("double").alias("qps"),
    )


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_result_lines(line_files(spark, path))


def parse_responses(docs: DataFrame) -> DataFrame:
    """(path, knob, label) from answer documents; a document that is not one JSON object is skipped."""
    whole = F.when(F.trim("text").rlike(r"(?s)^\{.*\}$") & F.try_parse_json("text").isNotNull(), F.col("text"))
    found = docs.select("path", F.explode_outer(extract_json_object(whole)).alias("knob", "label"))
    return found.filter(F.col("knob").isNotNull())


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return parse_responses(whole_files(spark, path, "*.json"))


OPTIMIZER_STATS = (
    "submitted_ta_runs long, finished_ta_runs long, n_configs long,"
    " wallclock_time_used double, ta_time_used double, inc_changed long"
)
STATS_PATH = r"([^/]+)/([^/]+)_smac_output/(run_[^/]*)/[^/]+$"


def parse_optimizer_stats(docs: DataFrame) -> DataFrame:
    """Optimizer statistics keyed by the benchmark, workload and run of the path."""
    folder = [
        F.regexp_extract("path", STATS_PATH, i).alias(n)
        for i, n in ((1, "benchmark"), (2, "workload"), (3, "run_folder"))
    ]
    return docs.select(*folder, F.from_json("text", OPTIMIZER_STATS).alias("s")).select(
        "benchmark", "workload", "run_folder", "s.*"
    )


def read_optimizer_stats(spark: SparkSession, path: str) -> DataFrame:
    return parse_optimizer_stats(whole_files(spark, path, "stats.json"))


def parse_run_log(lines: DataFrame) -> DataFrame:
    """(time, file, line_no, level, message, throughput) of log lines, each counted once.

    Handlers stack up and repeat every line; equal lines are one event.
    """

    def part(i: int) -> Column:
        return F.regexp_extract("line", LOG_LINE, i)

    # A line and its parts tell each other, so lines are compared whole and split only once each.
    once = lines.select("line").filter(F.startswith("line", F.lit("["))).distinct()
    return (
        once.filter(F.col("line").rlike(LOG_LINE))
        .select(
            part(1).alias("time"),
            part(2).alias("file"),
            part(3).cast("int").alias("line_no"),
            part(4).alias("level"),
            part(5).alias("message"),
        )
        .withColumn("throughput", F.regexp_extract("message", LOG_THROUGHPUT, 1).try_cast("double"))
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_log(line_files(spark, path))


def workload_files(names: DataFrame, kind: str, benchmark: str) -> DataFrame:
    """File names of a benchmark's workloads in name order.

    Transactional ones are `sample_<benchmark>_config<n>.xml` without the template;
    analytic ones start with the benchmark's name, so a name that is the start of
    another one also finds the other's files.
    """
    name = F.col("name")
    if kind == "oltp":
        stem = f"sample_{benchmark}_config"
        keep = F.startswith(name, F.lit(stem)) & F.endswith(name, F.lit(".xml")) & (name != f"{stem}.xml")
    else:
        keep = F.startswith(name, F.lit(benchmark))
    return names.filter(keep).orderBy("name")


def discover_workloads(spark: SparkSession, path: str, kind: str, benchmark: str) -> DataFrame:
    """Lists a folder without reading its files' contents."""
    listed = spark.read.format("binaryFile").load(path)
    return workload_files(
        listed.select(F.element_at(F.split("path", "/"), -1).alias("name")), kind, benchmark
    )


def sample_schema(knobs: list[str]) -> str:
    """Schema of sample files: knob columns, then y, counters, workload and configuration."""
    columns = [f"`{k}` double" for k in knobs]
    return ", ".join(
        columns
        + ["y array<double>", "inner_metrics array<double>", "workload string", "config_id string"]
    )


def read_samples(spark: SparkSession, path: str, knobs: list[str]) -> DataFrame:
    """Samples from JSON lines with an explicit schema; absent fields are null."""
    return spark.read.schema(sample_schema(knobs)).json(path)
