"""Experiment tables: suites expanded into steps, layered parameters, catalog checks.

J3–J5, J9, J11, J14, J15, P7, P13, P20–P22, U2, W2, W3, W13, A11. A *suite* is an ordered list of steps with optional
parameter sweeps on three levels: for the whole suite, for a step, and nested in the parameters of a step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.functions.text import COUNTED_PROCEDURES, step_label
from probeline.functions.units import corpus_to_count, count_to_corpus, range_bytes
from probeline.operators.timeline import Timeline, numbered
from probeline.session import parallelism

# The parameter layers from weakest to strongest, template variables in the order they are applied,
# internal and secret keys, the source files with their capacities, and the defaults of a run.
LAYERS = ("common", "engine", "procedure", "procedure_engine", "sweep", "runtime")
TEMPLATE_VARS = ("corpus_size", "corpus_name", "num_vectors", "source_file", "base_url", "query_k")
INTERNAL_KEYS = ("corpus_name", "corpus_size")
SECRET_KEYS = ("username", "password")
SOURCE_FILES = (
    (1_000, "documents-1k.hdf5.bz2"),
    (100_000, "documents-100k.hdf5.bz2"),
    (1_000_000, "documents-1m.hdf5.bz2"),
    (10_000_000, "documents-10m.hdf5.bz2"),
)
DEFAULT_TRUTH_K = 100
DEFAULT_NODE_SIZE = "small"
ENGINE_MARK = "__ENGINE__"

SWEEPS = "ARRAY<STRUCT<params: MAP<STRING, STRING>>>"
STEPS = "ARRAY<STRUCT<dataset: STRING, scenario: STRING, params: MAP<STRING, STRING>, profile: BOOLEAN, parameter_sweeps: " + SWEEPS + ">>"
SUITE = f"""
STRUCT<description: STRING, engine: STRING, params: MAP<STRING, STRING>, parameter_sweeps: {SWEEPS},
       versions: ARRAY<STRING>, node_sizes: ARRAY<STRING>, node_size: STRING, first_run_steps: {STEPS}, steps: {STEPS}>
"""


def merge_maps(weak: Column, strong: Column) -> Column:
    """Both maps' keys; where both have a key the second one wins."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(weak, empty), F.coalesce(strong, empty), lambda k, x, y: F.coalesce(y, x))


def _put_if_absent(m: Column, key: str, value: Column) -> Column:
    add = value.isNotNull() & ~F.map_contains_key(m, key)
    return F.when(add, F.map_concat(m, F.create_map(F.lit(key), value))).otherwise(m)


def parse_suites(texts: DataFrame, engine: str, document: str = "document") -> DataFrame:
    """Suite JSON text to typed columns, with the engine mark replaced. Nested parameter values stay JSON text."""
    named = F.replace(F.col(document), F.lit(ENGINE_MARK), F.lit(engine))
    return texts.withColumn("_s", F.from_json(named, SUITE)).select(
        *[c for c in texts.columns if c != document], "_s.*"
    )


def concat_steps(first: DataFrame, steps: DataFrame, first_run: bool = True, order: str = "step_ord") -> DataFrame:
    """First-run steps followed by the regular steps, with a two-part order that keeps both sequences."""
    regular = steps.withColumn("part", F.lit(1))
    if not first_run:
        return regular
    return first.withColumn("part", F.lit(0)).unionByName(regular)


def suite_steps(suites: DataFrame, first_run: bool = False) -> DataFrame:
    """One row per step of a parsed suite, in order, first-run steps in front when asked for."""
    lists = F.col("steps")
    if first_run:
        lists = F.concat(F.coalesce(F.col("first_run_steps"), F.from_json(F.lit("[]"), STEPS)), lists)
    keep = [c for c in suites.columns if c not in ("steps", "first_run_steps", "params", "parameter_sweeps")]
    nested = F.from_json(F.col("_st.params")["parameter_sweeps"], SWEEPS)
    params_of = lambda sweeps: F.transform(sweeps, lambda x: x["params"])
    return suites.select(*keep, "params", "parameter_sweeps", F.posexplode(lists).alias("step_ord", "_st")).select(
        *keep,
        "step_ord",
        F.col("_st.dataset").alias("dataset"),
        F.col("_st.scenario").alias("procedure"),
        F.col("params").alias("suite_params"),
        F.map_filter(
            F.coalesce(F.col("_st.params"), F.create_map().cast("map<string,string>")), lambda k, v: k != "parameter_sweeps"
        ).alias("params"),
        params_of(F.col("parameter_sweeps")).alias("suite_sweeps"),
        params_of(F.col("_st.parameter_sweeps")).alias("step_sweeps"),
        params_of(nested).alias("nested_sweeps"),
    )


def expand_sweeps(steps: DataFrame) -> DataFrame:
    """Suite sweeps × steps × step sweeps in run order, with merged parameters.

    Needs ``step_ord, params, suite_params, suite_sweeps, step_sweeps``. An absent suite list is one pass, an empty
    one no steps at all; an absent or empty step list is one pass. Strength: suite < suite sweep < step < step sweep.
    ``ord`` orders the result within a suite: the three positions as one number of twelve digits each.
    """
    empty = F.create_map().cast("map<string,string>")
    one_pass = F.array(empty)
    out = steps.select("*", F.posexplode(F.coalesce("suite_sweeps", one_pass)).alias("suite_sweep", "_sp"))
    per_step = F.when(F.size(F.coalesce("step_sweeps", one_pass)) > 0, F.coalesce("step_sweeps", one_pass)).otherwise(one_pass)
    weak = merge_maps(merge_maps(F.col("suite_params"), F.col("_sp")), F.col("params"))  # once per step, not per step sweep
    out = out.withColumn("_weak", weak).select("*", F.posexplode(per_step).alias("step_sweep", "_ssp"))
    merged = merge_maps(F.col("_weak"), F.col("_ssp"))
    wide = lambda c, shift: F.col(c).cast("decimal(12,0)").cast("decimal(38,0)") * F.lit("1" + "0" * shift).cast("decimal(38,0)")
    place = (wide("suite_sweep", 24) + wide("step_ord", 12) + wide("step_sweep", 0)).cast("decimal(38,0)")
    return out.withColumn("params", merged).withColumn("ord", place).drop(
        "_sp", "_ssp", "_weak", "suite_params", "suite_sweeps", "step_sweeps"
    )


def expand_nested(steps: DataFrame) -> DataFrame:
    """J14, third level: sweeps nested in a step's parameters become ``sweep-1 … sweep-n``; none is one plain pass."""
    empty = F.create_map().cast("map<string,string>")
    has = F.coalesce(F.size("nested_sweeps") > 0, F.lit(False))
    passes = F.when(has, F.col("nested_sweeps")).otherwise(F.array(empty))
    out = steps.withColumn("_has", has).select("*", F.posexplode(passes).alias("_i", "sweep_params"))
    return (
        out.withColumn("sweep_index", F.col("_i") + 1)
        .withColumn("sweep_name", F.when(F.col("_has"), F.concat(F.lit("sweep-"), (F.col("_i") + 1).cast("string"))))
        .withColumn("params", merge_maps(F.col("params"), F.col("sweep_params")))
        .drop("_has", "_i", "nested_sweeps")
    )


def derive_params(steps: DataFrame) -> DataFrame:
    """With a corpus size, add the target table name and, for ingest and search, the vector count, if absent.

    ``reject_reason`` names steps whose size is not of the strict form (P1b).
    """
    size = F.col("params")["corpus_size"]
    sized = F.coalesce(size, F.lit("")) != ""
    named = _put_if_absent(F.col("params"), "target_index_name", F.when(sized, F.concat("dataset", F.lit("-"), size)))
    counts = sized & F.col("procedure").isin(*COUNTED_PROCEDURES) & ~F.map_contains_key(F.col("params"), "num_vectors")
    strict = corpus_to_count(size, strict=True)
    out = steps.withColumn("reject_reason", F.when(counts & strict.isNull(), F.lit("unrecognised corpus size")))
    out = out.withColumn("_nv", F.when(counts, strict.cast("string"))).withColumn("params", named)
    return out.withColumn("params", _put_if_absent(F.col("params"), "num_vectors", F.col("_nv"))).drop("_nv")


def label_steps(steps: DataFrame) -> DataFrame:
    """P12 on expanded steps."""
    p = F.col("params")
    return steps.withColumn("label", step_label(F.col("dataset"), p["corpus_size"], F.col("procedure"), p["query_k"]))


def dedupe_labels(
    steps: DataFrame, keys: Sequence[str] = ("suite_id",), order: Sequence[str] = ("ord",), label: str = "label",
    slices: int | None = None,
) -> DataFrame:
    """The first use of a label keeps it, the n-th gets ``-n``. A label may cover any share of the steps."""
    rows = numbered(steps, [*keys, label], order, "_n", slices)
    again = F.concat(F.col(label), F.lit("-"), F.col("_n").cast("string"))
    return rows.withColumn(label, F.when(F.col("_n") > 1, again).otherwise(F.col(label))).drop("_n")


def label_versions(
    versions: DataFrame, keys: Sequence[str] = ("suite_id",), order: Sequence[str] = ("version_ord",),
    version: str = "version", slices: int | None = None,
) -> DataFrame:
    """``version_label`` is ``<version>_run<n>`` for versions that occur more than once, else the version."""
    rows = Timeline(versions, [*keys, version], order, slices).previous({}, number="_n", total="_uses").result()
    repeated = F.concat(F.col(version), F.lit("_run"), F.col("_n").cast("string"))
    return rows.withColumn("version_label", F.when(F.col("_uses") > 1, repeated).otherwise(F.col(version))).drop("_n", "_uses")


def run_matrix(suites: DataFrame, engines: Sequence[str], default_version: str, slices: int | None = None) -> DataFrame:
    """Engines × versions × node sizes of each suite, in order. Needs ``suite_id, versions, node_sizes``."""
    or_else = lambda c, d: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.array(F.lit(d)))
    rows = suites.select(
        "suite_id", or_else("node_sizes", DEFAULT_NODE_SIZE).alias("_sizes"),
        F.posexplode(or_else("versions", default_version)).alias("version_ord", "version"),
    )
    rows = label_versions(rows, slices=slices)
    rows = rows.select("*", F.posexplode("_sizes").alias("size_ord", "node_size")).drop("_sizes")
    return rows.select("*", F.posexplode(F.array(*[F.lit(e) for e in engines])).alias("engine_ord", "engine"))


def resolve_layers(params: DataFrame, run: str = "run_id", legacy: bool = False) -> DataFrame:
    """Per run and key the value of the strongest layer (``layer`` is 1 … 6, see ``LAYERS``).

    ``legacy`` keeps the older behaviour where procedure parameters were copied above the sweeps and so masked both
    sweeps and per-engine procedure parameters.
    """
    rank = F.col("layer").cast("double")
    if legacy:  # the copy outranks its original
        rank = F.when(F.col("layer") == 3, F.lit(5.5)).otherwise(rank)
    params = params.select(run, "key", "value", rank.alias("_rank"))
    # Values are text, so picking one sorts rows: as few as a key has layers go without being picked from first, in even parts.
    spread = params.repartition(parallelism(params.sparkSession), run, "key")
    return spread.groupBy(run, "key").agg(F.max_by("value", "_rank").alias("value"))


def resolve_templates(value: Column, variables: Mapping[str, Column]) -> Column:
    """Replace ``{{name}}`` marks. Nested values are JSON text, so marks inside them are replaced as well."""
    for name in TEMPLATE_VARS:
        if name in variables:
            text = F.coalesce(variables[name].cast("string"), F.lit(""))
            value = F.replace(value, F.lit("{{" + name + "}}"), text)
    return value


def drop_credentials(params: DataFrame) -> DataFrame:
    """Secrets leave the parameter table before it is stored."""
    return params.filter(~F.col("key").isin(*SECRET_KEYS))


def finalize_params(params: DataFrame, counts: DataFrame, run: str = "run_id") -> DataFrame:
    """Drop internal keys and add ``num_vectors`` for runs that lack it (``counts`` is run, num_vectors)."""
    kept = params.filter(~F.col("key").isin(*INTERNAL_KEYS))
    have = params.filter(F.col("key") == "num_vectors").select(run)
    added = counts.join(have, run, "left_anti").select(
        run, F.lit("num_vectors").alias("key"), F.col("num_vectors").cast("string").alias("value")
    )
    return kept.select(run, "key", "value").unionByName(added)


def _ceiling(sizes: Column, wanted: Column) -> Column:
    """First struct of an ascending array whose ``n`` is at least ``wanted``; null when there is none."""
    return F.get(F.filter(sizes, lambda s: s["n"] >= wanted), 0)


def pick_corpus_size(requests: DataFrame, supported: DataFrame, by: str = "dataset") -> DataFrame:
    """The smallest supported size that holds ``num_vectors``, the largest when none does.

    ``supported`` is (dataset, corpus_size). Its sizes become one short sorted array per dataset, so requests meet
    them by an equi join instead of a range join. A dataset without sizes gets the count as text (P2).
    """
    sized = supported.select(by, "corpus_size").distinct().select(
        by, F.struct(corpus_to_count("corpus_size").alias("n"), "corpus_size").alias("_s")
    )
    lists = sized.groupBy(by).agg(F.array_sort(F.collect_list("_s")).alias("_sizes"))
    joined = requests.join(lists, by, "left")
    pick = F.coalesce(_ceiling(F.col("_sizes"), F.col("num_vectors")), F.element_at("_sizes", -1))
    return joined.withColumn(
        "corpus_size", F.coalesce(pick["corpus_size"], count_to_corpus("num_vectors"))
    ).drop("_sizes")


def pick_truth_k(requests: DataFrame, supported: DataFrame, by: str = "dataset", k: str = "query_k") -> DataFrame:
    """The smallest ground-truth k that covers ``query_k``; without one the k stays as asked."""
    lists = supported.select(by, F.struct(F.col("k").cast("bigint").alias("n")).alias("_s")).distinct()
    lists = lists.groupBy(by).agg(F.array_sort(F.collect_list("_s")).alias("_ks"))
    asked = F.coalesce(F.col(k).cast("bigint"), F.lit(DEFAULT_TRUTH_K).cast("bigint"))
    default = F.array(F.struct(F.lit(DEFAULT_TRUTH_K).cast("bigint").alias("n")))
    joined = requests.join(lists, by, "left")
    pick = _ceiling(F.coalesce("_ks", default), asked)["n"]
    return joined.withColumn("truth_k", F.coalesce(pick, asked)).drop("_ks")


def pick_source_file(requests: DataFrame, count: str = "num_vectors") -> DataFrame:
    """The smallest source file that holds ``num_vectors``, the largest when none does."""
    files = F.array(*[F.struct(F.lit(n).cast("bigint").alias("n"), F.lit(f).alias("file")) for n, f in SOURCE_FILES])
    pick = F.coalesce(_ceiling(files, F.col(count)), F.element_at(files, -1))
    return requests.withColumn("source_file", pick["file"])


def split_valid(requests: DataFrame, catalog: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Requests whose ``on`` columns occur in the catalog, and those whose do not."""
    known = catalog.select(*on).distinct()
    return requests.join(known, list(on), "left_semi"), requests.join(known, list(on), "left_anti")


def validate(requests: DataFrame, procedures: DataFrame, engines: DataFrame) -> DataFrame:
    """P20: add ``reason``: null for a good request, else the first rule it breaks.

    ``requests`` has dataset, procedure, engine and ``params`` as JSON text (null when not given).
    """
    known_p = procedures.select("dataset", "procedure").distinct().withColumn("_p", F.lit(True))
    known_e = engines.select("dataset", "engine").distinct().withColumn("_e", F.lit(True))
    joined = requests.join(known_p, ["dataset", "procedure"], "left").join(known_e, ["dataset", "engine"], "left")
    an_object = F.try_parse_json("params").isNotNull() & F.col("params").rlike(r"^\s*\{")
    reason = (
        F.when(F.col("dataset").isNull() | F.col("procedure").isNull(), "dataset or procedure missing")
        .when(F.col("params").isNotNull() & ~an_object, "params is not an object")
        .when(F.col("_p").isNull(), "unknown procedure for dataset")
        .when(F.col("_e").isNull(), "engine not supported for dataset")
    )
    return joined.withColumn("reason", reason).drop("_p", "_e")


def discover(datasets: DataFrame, engines: DataFrame, procedures: DataFrame) -> DataFrame:
    """Per dataset and procedure the engines, ``has_sweeps`` and ``sweep_count``.

    ``engines`` is (dataset, engine, source); engines from the ``legacy`` source count only for datasets that have no
    current one. Engine names are first made distinct, so the list per dataset is as short as the engine catalog.
    """
    names = engines.select("dataset", "engine", "source").distinct()
    modern = F.array_sort(F.collect_set(F.when(F.col("source") != "legacy", F.col("engine"))))
    old = F.array_sort(F.collect_set(F.when(F.col("source") == "legacy", F.col("engine"))))
    lists = names.groupBy("dataset").agg(modern.alias("_m"), old.alias("_l")).select(
        "dataset", F.when(F.size("_m") > 0, F.col("_m")).otherwise(F.col("_l")).alias("engines")
    )
    known = datasets.join(lists, "dataset", "left").join(procedures, "dataset", "left")
    none = F.array().cast("array<string>")
    return (
        known.withColumn("engines", F.coalesce("engines", none))
        .withColumn("has_sweeps", F.col("sweep_count").isNotNull())
        .withColumn("sweep_count", F.coalesce("sweep_count", F.lit(0)))
    )


def file_completeness(expected: DataFrame, inventory: DataFrame, name: str = "name") -> DataFrame:
    """``present``, ``missing`` or ``mismatch`` per expected file; without a readable range any size will do.

    ``expected`` is (name, range), ``inventory`` (name, bytes).
    """
    joined = expected.withColumn("expected_bytes", range_bytes("range")).join(inventory.select(name, "bytes"), name, "left")
    state = (
        F.when(F.col("bytes").isNull(), "missing")
        .when(F.col("expected_bytes").isNull() | (F.col("expected_bytes") == F.col("bytes")), "present")
        .otherwise("mismatch")
    )
    return joined.withColumn("state", state).withColumn("fetch", F.col("state") != "present")
