import pytest
from pyspark.sql import functions as F

from probeline.functions import text, units
from probeline.functions.vectors import score


def value(spark, column, **inputs):
    names = list(inputs) or ["x"]
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(inputs.get(n))]}" for n in names)
    row = tuple(inputs.get(n) for n in names)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "size, count",
    [("1m", 1000000), ("1.5k", 1500), (" 2B ", 2000000000), ("7", 7), ("abc", 1000000), ("1.9999k", 1999), ("1e3", 1000000),
     ("-5", -5), ("m", 1000000), ("1.5", 1000000), ("1fk", 1000000), ("", 1000000)],
)
def test_corpus_to_count(spark, size, count):
    assert value(spark, units.corpus_to_count("x"), x=size) == count


@pytest.mark.parametrize("size, count", [("1m", 1000000), ("5k", 5000), ("1.5m", None), ("1M", None), ("7", None), ("2b", None)])
def test_strict_corpus_size(spark, size, count):
    assert value(spark, units.corpus_to_count("x", strict=True), x=size) == count


@pytest.mark.parametrize("count, size", [(2500000, "2m"), (3500000, "4m"), (999, "999"), (50000, "50k"), (2000000000, "2b")])
def test_count_to_corpus(spark, count, size):
    assert value(spark, units.count_to_corpus("x"), x=count) == size


@pytest.mark.parametrize("cpu, cores, milli", [("188m", 0.188, 188), ("2", 2.0, 2000), ("1999999n", 0.001999999, 1), ("", 0.0, None), ("0.5", 0.5, 500)])
def test_cpu(spark, cpu, cores, milli):
    assert value(spark, units.cpu_cores("x"), x=cpu) == pytest.approx(cores)
    assert value(spark, units.cpu_millicores("x"), x=cpu) == milli


@pytest.mark.parametrize(
    "memory, mib, kib",
    [("2449Mi", 2449.0, 2507776), ("16Gi", 16384.0, 16777216), ("1024Ki", 1.0, 1024), ("5", 5.0, 0), ("", 0.0, 0), ("1.5Gi", 1536.0, None)],
)
def test_memory(spark, memory, mib, kib):
    assert value(spark, units.mem_mib("x"), x=memory) == mib
    assert value(spark, units.mem_kib("x"), x=memory) == kib


def test_run_ts(spark):
    assert str(value(spark, units.run_ts("x"), x="20240131-235959-abc")) == "2024-01-31 23:59:59"
    assert value(spark, units.run_ts("x"), x="manual-1") is None


def test_ranges(spark):
    assert value(spark, units.byte_range(F.col("x"), 1024), x=1000000) == "0-4099999999"
    assert value(spark, units.range_bytes("x"), x="0-4099") == 4100
    assert value(spark, units.range_bytes("x"), x="all") is None


@pytest.mark.parametrize(
    "start, end, shown",
    [("2024-01-01 00:00:00", "2024-01-01 00:02:05.5", "2m 6s"), ("2024-01-01 00:00:00", "2024-01-01 00:00:00.4", "N/A"),
     ("2024-01-01 00:00:00", None, "N/A")],
)
def test_run_duration(spark, start, end, shown):
    assert value(spark, units.run_duration("a", "b"), a=start, b=end) == shown


@pytest.mark.parametrize("code, flag, status", [(0, False, "completed"), (1, False, "failed"), (-9, False, "cancelled"), (0, True, "cancelled"), (None, False, "failed")])
def test_sweep_status(spark, code, flag, status):
    df = spark.createDataFrame([(code, flag)], "code int, flag boolean")
    assert df.select(units.sweep_status("code", "flag")).first()[0] == status


def test_text(spark):
    console = "run 01234567-89ab-cdef-0123-456789abcdef and ffffffff-89ab-cdef-0123-456789abcdef"
    assert value(spark, text.extract_uuid("x"), x=console) == "01234567-89ab-cdef-0123-456789abcdef"
    assert value(spark, text.extract_uuid("x"), x="no id") is None
    assert value(spark, text.text_tail("x", 3), x="abcdef") == "def"
    assert value(spark, text.text_tail("x", 3), x=None) == ""
    assert value(spark, text.sweep_name("x"), x="job/e/step/sweep-3") == "sweep-3"
    assert value(spark, text.sweep_name("x"), x="job/e/sweep-3/logs") is None


def test_label_and_tags(spark):
    label = text.step_label(F.lit("cohere-wiki"), F.lit(None).cast("string"), F.lit("vector-search"), F.lit(10))
    assert value(spark, label, x="") == "wiki--vector-search-k10"
    tags = text.user_tags({"engine": F.lit("e"), "dataset": F.lit("d"), "query_k": F.lit(None).cast("int"), "dimension": F.lit(8)})
    assert value(spark, tags, x="") == "dataset:d,engine:e,dimension:8"


def test_ready(spark):
    assert [value(spark, units.is_ready("x"), x=s) for s in ("green", "yellow", "red", None)] == [True, True, False, False]


def test_scores(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(score(a, b, "innerproduct"), score(a, b, "l2"), score(a, b, "cosinesimil")).first()
    assert list(got) == pytest.approx([24.0, 2**0.5, 0.96])
    with pytest.raises(ValueError):
        score(a, b, "manhattan")
