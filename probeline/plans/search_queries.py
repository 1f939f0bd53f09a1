"""Vector tables, exact and approximate search, recall."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from probeline.functions.vectors import score
from probeline.operators import cells, search, tables
from probeline.plans.registry import query, table
from probeline.session import scratch_path
from probeline.sources import binary
from probeline.sources.binary import clustered
from probeline.sources.trees import file_inventory as file_list

K = 10
EVERY = 50
COARSE = 1.0  # one step per unit: a three-level quantiser, so that recall differs visibly between factors

_SCORES = {
    "innerproduct": "list_inner_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "l2": "list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "cosinesimil": "list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[])",
}


def _pairs(space_type: str) -> str:
    return f"""
        SELECT q.vec_id AS query_id, b.vec_id AS vec_id, {_SCORES[space_type]} AS score
        FROM embeddings q JOIN embeddings b ON b.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0"""


def _truth(space_type: str, k: int = K) -> str:
    way = "ASC" if space_type == "l2" else "DESC"
    return f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {way}, vec_id) AS rank
                       FROM ({_pairs(space_type)})) WHERE rank <= {k}"""


def _coarse(scale: float) -> str:
    q = f"list_transform(embedding::DOUBLE[], lambda x: round_even(x * {scale}, 0))"
    return f"""
        quantised AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, {q} AS c FROM embeddings),
        coarse AS (
            SELECT q.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(q.c, b.c) AS rank_score,
                   list_inner_product(q.e, b.e) AS score
            FROM quantised q JOIN quantised b ON b.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, vec_id) AS coarse_rank
                   FROM coarse)"""


def _sides(spark, sf):
    """The corpus and its query set: every row whose id is divisible by ``EVERY`` is searched for among all rows."""
    base = table(spark, sf, "embeddings")
    return base, base.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _neighbours(space_type: str):
    def run(spark, sf):
        base, asked = _sides(spark, sf)
        found = search.exact_knn(base, asked, K, space_type, exclude_self=True)
        return found.select(
            "query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score")
        )

    return run


for _name, _space in (("exact_knn", "innerproduct"), ("exact_knn_l2", "l2"), ("exact_knn_cosine", "cosinesimil")):
    query(_name, f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ({_truth(_space)})")(_neighbours(_space))


@query(
    "pair_scores",
    f"""SELECT q.vec_id AS vec_id, round({_SCORES['innerproduct']}, 6) AS inner_product,
               round({_SCORES['l2']}, 6) AS l2, round({_SCORES['cosinesimil']}, 6) AS cosine
        FROM embeddings q JOIN embeddings b ON b.vec_id = q.vec_id + 1""",
)
def pair_scores(spark, sf):
    """Every vector against the next one, under the three metrics."""
    base, _ = _sides(spark, sf)
    following = base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return base.join(following, "vec_id").select(
        "vec_id",
        F.round(score(a, b, "innerproduct"), 6).alias("inner_product"),
        F.round(score(a, b, "l2"), 6).alias("l2"),
        F.round(score(a, b, "cosinesimil"), 6).alias("cosine"),
    )


@query(
    "top_k",
    f"""WITH scored AS (SELECT q.label AS query_id, q.vec_id, {_SCORES['innerproduct']} AS score
                        FROM embeddings q JOIN embeddings b ON b.vec_id = q.vec_id + 1)
        SELECT query_id, rank, vec_id, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5""",
)
def top_k(spark, sf):
    base, _ = _sides(spark, sf)
    following = base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    scored = base.join(following, "vec_id").select(
        F.col("label").alias("query_id"), "vec_id", score(F.col("embedding"), F.col("other"), "innerproduct").alias("score")
    )
    best = search.top_k(scored, 5)
    return best.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


_FOUND_1 = f"""found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
                                       FROM ranked WHERE coarse_rank <= {K}) WHERE rank <= {K})"""


@query(
    "recall_at_k",
    f"""WITH {_coarse(COARSE)}, {_FOUND_1}, truth AS ({_truth('innerproduct', 64)})
        SELECT t.query_id, count(f.vec_id) / 10.0::DOUBLE AS recall
        FROM truth t LEFT JOIN found f ON t.query_id = f.query_id AND t.vec_id = f.vec_id AND f.query_id % 3 <> 0
        WHERE t.rank <= {K} GROUP BY t.query_id""",
)
def recall_at_k(spark, sf):
    """A truth of 64 neighbours sliced to the first ten, and a run that left a third of the queries unanswered."""
    base, asked = _sides(spark, sf)
    truth = search.exact_knn(base, asked, 64, exclude_self=True)
    found = search.overquery_search(base, asked, K, 1, scale=COARSE, exclude_self=True)
    return search.recall_at_k(found.filter("query_id % 3 <> 0"), truth, K)


@query(
    "mean_recall",
    f"""WITH {_coarse(COARSE)}, {_FOUND_1}, truth AS ({_truth('innerproduct', 64)}),
        per_query AS (SELECT t.query_id, count(f.vec_id) / 10.0::DOUBLE AS recall
                      FROM truth t LEFT JOIN found f ON t.query_id = f.query_id AND t.vec_id = f.vec_id AND f.query_id % 3 <> 0
                      WHERE t.rank <= {K} GROUP BY t.query_id)
        SELECT label, round(avg(recall), 10) AS recall, count(*) AS queries
        FROM per_query JOIN embeddings ON vec_id = query_id GROUP BY label""",
)
def mean_recall(spark, sf):
    """A14 per label of the query."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    means = search.mean_recall(recall_at_k(spark, sf).join(labels, "query_id"), ["label"])
    return means.withColumn("recall", F.round("recall", 10))


@query(
    "overquery_search",
    f"""WITH {_coarse(127.0)}
        SELECT query_id, rank, vec_id, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
              FROM ranked WHERE coarse_rank <= {2 * K}) WHERE rank <= {K}""",
)
def overquery_search(spark, sf):
    """X2 with int8 steps and factor 2."""
    base, asked = _sides(spark, sf)
    found = search.overquery_search(base, asked, K, 2, exclude_self=True)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query(
    "quality_curve",
    f"""WITH {_coarse(COARSE)}, truth AS ({_truth('innerproduct', 64)}),
        grid AS (SELECT k, factor FROM (VALUES (10), (64)) AS a(k), (VALUES (1), (2), (5)) AS b(factor)),
        cut AS (SELECT k, factor, query_id, vec_id,
                       row_number() OVER (PARTITION BY k, factor, query_id ORDER BY score DESC, vec_id) AS rank
                FROM ranked JOIN grid ON coarse_rank <= k * factor),
        per_query AS (
            SELECT c.k, c.factor, c.query_id, count(*) AS candidates,
                   count(*) FILTER (WHERE c.rank <= c.k AND t.rank <= c.k) / c.k::DOUBLE AS recall
            FROM cut c LEFT JOIN truth t ON t.query_id = c.query_id AND t.vec_id = c.vec_id
            GROUP BY c.k, c.factor, c.query_id)
        SELECT k, factor, round(avg(recall), 10) AS recall, CAST(sum(candidates) AS BIGINT) AS candidates
        FROM per_query GROUP BY k, factor""",
)
def quality_curve(spark, sf):
    """X3 on a corpus that was ingested, counted and read back."""
    base, asked = _sides(spark, sf)
    name = _ingested(spark, base)
    curve = search.quality_curve(spark.table(name), asked, [10, 64], [1, 2, 5], scale=COARSE, exclude_self=True)
    return curve.withColumn("recall", F.round("recall", 10))


@query("ann_search")
def ann_search(spark, sf):
    """Recall per number of probed cells."""
    base, asked = _sides(spark, sf)
    model = cells.train_cells(base, 16)
    path = scratch_path(spark, "cells")
    cells.write_cells(cells.assign_cells(base, model), path)
    index = spark.read.parquet(path)
    truth = search.exact_knn(base, asked, K, exclude_self=True)
    curve = cells.probe_curve(index, asked, truth, model, K, [1, 4, 16], exclude_self=True)
    return curve.withColumn("recall", F.round("recall", 10))


@query(
    "ann_search_given",
    f"""WITH parts AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
        centres AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY label),
        near AS (SELECT vec_id, embedding::DOUBLE[] AS e, label_c AS cell, row_number() OVER (PARTITION BY vec_id ORDER BY gap, label_c) AS place
                 FROM (SELECT vec_id, embedding, k.label AS label_c, list_distance(embedding::DOUBLE[], c) AS gap FROM embeddings, centres k)),
        scored AS (SELECT q.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(q.e, b.e) AS score
                   FROM near q JOIN near b ON q.cell = b.cell AND b.place = 1 AND b.vec_id <> q.vec_id
                   WHERE q.vec_id % {EVERY} = 0 AND q.place <= 3)
        SELECT query_id, rank, vec_id, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {K}""",
)
def ann_search_given(spark, sf):
    """X1 around the mean vector of each label, three cells probed."""
    base, asked = _sides(spark, sf)
    parts = base.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    means = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c")).orderBy("label").collect()
    model = cells.GivenCells([[x["m"] for x in r["c"]] for r in means])  # one vector per label
    index = cells.assign_cells(base.select("vec_id", "embedding"), model)
    found = cells.ann_search(index, asked, model, K, 3, exclude_self=True)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query(
    "rejected_vectors",
    """WITH cut AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN embedding[1:63] WHEN vec_id % 11 <> 0 THEN embedding END AS e FROM embeddings)
       SELECT vec_id, CASE WHEN e IS NULL THEN 'null' ELSE 'length' END AS reason FROM cut WHERE e IS NULL OR len(e) <> 64""",
)
def rejected_vectors(spark, sf):
    """What a search leaves out, of a corpus with shortened and missing vectors."""
    cut = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 != 0, F.col("embedding"))
    return search.rejected_vectors(table(spark, sf, "embeddings").withColumn("embedding", cut)).select("vec_id", "reason")


@query(
    "corpus_prefix",
    """SELECT vec_id, label FROM embeddings WHERE vec_id < (SELECT count(*) // 2 FROM embeddings)""",
)
def corpus_prefix(spark, sf):
    """S3: the first half of the corpus."""
    base = table(spark, sf, "embeddings")
    return tables.corpus_prefix(base, base.count() // 2).select("vec_id", "label")


_SUMS = "round(list_sum(embedding::DOUBLE[]), 6) AS total, CAST(len(embedding) AS INTEGER) AS dimension"


def _summed(df):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select("vec_id", F.round(total, 6).alias("total"), F.size("embedding").alias("dimension"))


@query("read_vectors", f"SELECT vec_id, {_SUMS} FROM embeddings")
def read_vectors(spark, sf):
    """S4."""
    return _summed(tables.read_vectors(spark, f"{sf}/embeddings.parquet"))


def _ingested(spark, base, shards: int = 3) -> str:
    name = f"vectors_{uuid.uuid4().hex}"
    tables.create_vector_table(spark, name, 64, "innerproduct", shards)
    tables.ingest(base, name)
    return name


@query("ingest_readback", f"SELECT vec_id, {_SUMS} FROM embeddings")
def ingest_readback(spark, sf):
    """What a sharded table holds after ingest."""
    name = _ingested(spark, table(spark, sf, "embeddings"))
    tables.refresh(spark, name)
    return _summed(spark.table(name))


@query(
    "verify_count",
    """SELECT count(*) AS actual_docs, count(*) + 7 AS expected_docs, CAST(7 AS BIGINT) AS shortfall, false AS complete
       FROM embeddings""",
)
def verify_count(spark, sf):
    """M5: a table that is seven vectors short."""
    base = table(spark, sf, "embeddings")
    name = _ingested(spark, base)
    return tables.verify_count(spark, name, base.count() + 7)


@query("retry_shards", "SELECT vec_id FROM embeddings WHERE vec_id % 10 = 3")
def retry_shards(spark, sf):
    """M5: a tenth of the vectors did not arrive; the failing shards' missing vectors are the retry set."""
    base = table(spark, sf, "embeddings")
    name = _ingested(spark, base.filter("vec_id % 10 <> 3"))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(3).cast("bigint")).cast("int")
    expected = base.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("expected_docs"))
    failing = tables.verify_count(spark, name, expected).filter("NOT complete")
    return tables.retry_shards(base, name, failing).select("vec_id")


@query("compact_readback", f"SELECT vec_id, {_SUMS}, CAST(3 AS BIGINT) AS files FROM embeddings")
def compact_readback(spark, sf):
    """M4: the same rows in one file per shard."""
    name = _ingested(spark, table(spark, sf, "embeddings"))
    tables.compact(spark, name)
    rows = spark.table(name)
    files = rows.select("_metadata.file_path").distinct().agg(F.count(F.lit(1))).scalar()
    return _summed(rows).withColumn("files", files)


@query("drop_table", "SELECT count(*) AS docs_before, CAST(0 AS BIGINT) AS docs_after FROM embeddings")
def drop_table(spark, sf):
    """M2: rows before the drop, and in the empty table created under the same name after it."""
    name = _ingested(spark, table(spark, sf, "embeddings"))
    before = spark.table(name).agg(F.count(F.lit(1)).alias("docs_before"))
    before = spark.createDataFrame(before.collect(), "docs_before bigint")  # one number
    tables.drop_vector_table(spark, name)
    tables.create_vector_table(spark, name, 64, "innerproduct", 3)
    return before.withColumn("docs_after", spark.table(name).agg(F.count(F.lit(1))).scalar())


@query(
    "table_snapshot",
    """SELECT 'graph' AS engine, count(*) AS docs, '64' AS dimension, 'innerproduct' AS space_type,
              'bigint' AS id_type FROM embeddings""",
)
def table_snapshot(spark, sf):
    """M11."""
    name = _ingested(spark, table(spark, sf, "embeddings"))
    shot = tables.snapshot_table(spark, name, "graph")
    return shot.select(
        "engine",
        F.get_json_object("stats", "$.docs").cast("bigint").alias("docs"),
        F.get_json_object("settings", "$.dimension").alias("dimension"),
        F.get_json_object("settings", "$.space_type").alias("space_type"),
        F.get_json_object("mapping", "$.vec_id").alias("id_type"),
    )


@query("synthetic_vectors")
def synthetic_vectors(spark, sf):
    """Clustered vectors for the ids of the corpus, as cell sizes and mean distances from the origin."""
    ids = table(spark, sf, "embeddings").select("vec_id")
    made = clustered(ids, 32, 8)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return made.groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg(norm), 4).alias("mean_norm"))


@query("file_inventory", "SELECT 'parquet' AS type, CAST(3 AS BIGINT) AS shards, count(*) AS docs, true AS sized FROM embeddings")
def file_inventory(spark, sf):
    """The files of an ingested table, shard by shard, with the vectors they hold."""
    name = _ingested(spark, table(spark, sf, "embeddings"))
    below = lambda c: F.regexp_extract(c, r"(shard=.*)$", 1).alias("file")
    listed = file_list(spark, tables.table_location(spark, name)).filter("type = 'parquet'").select(below("path"), "type", "bytes")
    held = spark.table(name).groupBy("shard", below("_metadata.file_path")).agg(F.count(F.lit(1)).alias("docs"))
    return listed.join(held, "file").groupBy("type").agg(
        F.countDistinct("shard").alias("shards"), F.sum("docs").alias("docs"), F.min(F.col("bytes") > 0).alias("sized")
    )


def _record_files(spark, sf):
    """The corpus as a folder of fvec files, in order of the id."""
    path = scratch_path(spark, "fvec")
    base = table(spark, sf, "embeddings").select("vec_id", "embedding")
    width = base.select(F.max(F.size("embedding"))).collect()[0][0] or 1
    binary.write_records(base.filter(F.size("embedding") == width), path, width)
    return path, width


_RECORDS = """SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS vec_id, len(embedding) AS dims,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total,
              CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[len(embedding)] AS DOUBLE) AS last_value
       FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings)"""


def _described(vectors):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return vectors.select(
        "vec_id", F.size("embedding").cast("bigint").alias("dims"), F.round(total, 4).alias("total"),
        F.element_at("embedding", 1).cast("double").alias("first_value"), F.element_at("embedding", -1).cast("double").alias("last_value"),
    )


@query("read_fvec", _RECORDS)
def read_fvec(spark, sf):
    """The corpus, written as records and read back."""
    path, width = _record_files(spark, sf)
    return _described(binary.read_fvec(spark, path, width))


@query("fvec_prefix", f"SELECT * FROM ({_RECORDS}) WHERE vec_id < 100")
def fvec_prefix(spark, sf):
    """S3 on records: the first hundred vectors, of which alone the bytes are read."""
    path, width = _record_files(spark, sf)
    return _described(tables.corpus_prefix(binary.read_fvec(spark, path, width), 100))


@query(
    "read_ivec",
    f"""SELECT CAST(dense_rank() OVER (ORDER BY query_id) - 1 AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, vec_id
        FROM ({_truth('innerproduct')})""",
)
def read_ivec(spark, sf):
    """Exact neighbours written as a ground-truth file, one record per query, and read back by rank."""
    base, asked = _sides(spark, sf)
    found = search.exact_knn(base, asked, K, "innerproduct", exclude_self=True)
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("near"))
    path = scratch_path(spark, "ivec")
    binary.write_records(lists.select("query_id", F.transform("near", lambda x: x["vec_id"].cast("int")).alias("neighbors")), path, K, "int")
    truth = binary.truth_rows(binary.read_ivec(spark, path, K))
    return truth.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id")
