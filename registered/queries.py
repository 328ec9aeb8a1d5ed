"""One query per operator, over whole tables. Every query takes (spark, folder) and returns a DataFrame of scalars."""

from pyspark.sql import functions as F

from epsgroup.functions import metrics
from epsgroup.functions import vectors as V
from epsgroup.operators import exact, partition, ranking, sampling
from epsgroup.operators.nearest import nearest_point
from epsgroup.operators.sums import total_cost, vector_mean, vector_sum
from epsgroup.plans import kmeans, report, similar
from epsgroup.sources import generator, sinks, text
from epsgroup.workspace import Workspace
from registered import tables

THRESHOLD = 50_000  # no partition is larger than what one task groups, whatever share of the rows is asked for
ORIGIN = [100.0, 0.5]


def coordinates(n, digits=None, column="features"):
    """x1..xn of a vector column."""
    values = [F.col(column)[i] for i in range(n)]
    return [(F.round(v, digits) if digits else v).alias(f"x{i + 1}") for i, v in enumerate(values)]


def group_by(choice, digits=6):
    def query(spark, folder):
        groups = exact.group_by_vector(tables.lineitem(spark, folder), choice, dimension=3)
        value = F.col("value") if choice == exact.COUNT else F.round("value", digits)
        return groups.select(*coordinates(3), value.alias("value"))

    return query


def group_number(spark, folder):
    return exact.group_number(exact.group_by_vector(tables.lineitem(spark, folder), exact.COUNT, dimension=3))


def summary_exact(spark, folder):
    groups = exact.group_by_vector(tables.lineitem(spark, folder), exact.SUM, dimension=3)
    return report.exact_summary(groups, exact.SUM).select(F.col("choice").cast("bigint").alias("choice"), "groups")


def vector_distance(spark, folder):
    origin = V.vector(*[F.lit(x) for x in ORIGIN])
    gap = V.distance(F.col("features"), origin)
    return tables.separated_customers(spark, folder).select("id", F.round(gap, 9).alias("distance"))


def vector_distance_sq(spark, folder):
    origin = V.vector(*[F.lit(x) for x in ORIGIN])
    gap = V.distance_sq(F.col("features"), origin)
    return tables.separated_customers(spark, folder).select("id", F.round(gap, 6).alias("distance"))


def vector_add(spark, folder):
    origin = V.vector(*[F.lit(x) for x in ORIGIN])
    total = V.add(F.col("features"), origin).alias("features")
    return tables.separated_customers(spark, folder).select("id", total).select("id", *coordinates(2, 9))


def vector_scale(spark, folder):
    scaled = V.scale_down(F.col("features"), F.lit(7)).alias("features")
    return tables.separated_customers(spark, folder).select("id", scaled).select("id", *coordinates(2, 9))


def vector_order(spark, folder):
    """Place of every row in the order of the vectors over the whole table, from 1. The price comes first, so that ties go on
    to the size, and then to the id."""
    rows = tables.separated_parts(spark, folder).select("id", F.reverse("features").alias("features"))
    placed = ranking.placed(rows, [F.col("features"), F.col("id")], Workspace(spark), "ordered")
    return placed.select("id", (F.col("place") + 1).alias("place"))


def vector_text(spark, folder):
    texts = tables.lineitem(spark, folder).select(V.to_text(F.col("features")).alias("vector"))
    return texts.groupBy("vector").agg(F.count("*").alias("n"))


def csv_scan(spark, folder):
    path = f"{Workspace(spark).path}/csv"
    text.write_vectors(tables.separated_customers(spark, folder), path)
    return text.read_vectors(spark, path, dimension=2).select("id", "agg", *coordinates(2))


def sample_pivots(spark, folder):
    distinct = sampling.distinct_vectors(tables.separated_parts(spark, folder), 7)
    pivots = sampling.sample_pivots(distinct.withColumn("path", F.lit("")), 20)
    return pivots.select(F.col("pid").cast("bigint").alias("pid"), *coordinates(2))


def sample_centers(spark, folder):
    return sampling.sample_rows(tables.separated_parts(spark, folder), 25, 3).select("id", *coordinates(2))


def sample_bernoulli(spark, folder):
    rows = tables.events(spark, folder)
    return sampling.sample_bernoulli(rows, 0.05, 100, 3).select("id", *coordinates(2))


def _split_parts(spark, folder, window=partition.EUCLIDEAN, table=tables.separated_parts, eps=2.0, pivots=6):
    """Rows of one round of partitioning, before copies are made."""
    distinct = sampling.distinct_vectors(table(spark, folder), 0).withColumn("path", F.lit(""))
    distinct = distinct.withColumn("base", F.array().cast("array<int>"))
    drawn = partition.collect_pivots(sampling.sample_pivots(distinct, pivots))
    return partition.split_shared(distinct, drawn, eps, window)


def _counts(spark, folder):
    counts = partition.partition_counts(_split_parts(spark, folder))
    return counts.select(F.col("child").cast("bigint").alias("child"), "rows", "vectors")


def sample_ratio(spark, folder):
    wanted = sampling.pivot_number(F.col("rows"), 0.01).alias("pivots")
    return _counts(spark, folder).select("child", "rows", wanted)


def partition_counts(spark, folder):
    return _counts(spark, folder)


def partition_ready(spark, folder):
    return partition.ready(_counts(spark, folder), 400)


def partition_oversized(spark, folder):
    return partition.oversized(_counts(spark, folder), 400)


def nearest_pivot(spark, folder):
    """64 dimensions: numpy blocks."""
    rows = tables.embeddings(spark, folder)
    points = [r[0] for r in sampling.sample_rows(rows, 16, 1).orderBy("draw", "id").select("features").collect()]
    near = nearest_point(rows, points, squared=False)
    gap = F.round("near_distance", 9).alias("distance")
    return near.select("id", F.col("near").cast("bigint").alias("near"), gap)


def _copies(split):
    copies = partition.copies_of(split)
    return copies.select("id", F.col("child").cast("bigint").alias("child"), F.col("base")[0].cast("bigint").alias("base"))


def window_euclidean(spark, folder):
    return _copies(_split_parts(spark, folder, table=tables.mixed_parts, eps=30.0, pivots=9))


def window_metric(spark, folder):
    return _copies(_split_parts(spark, folder, partition.METRIC, table=tables.mixed_parts, eps=30.0, pivots=9))


def window_wide(spark, folder):
    """The Euclidean window in 64 dimensions."""
    return _copies(_split_parts(spark, folder, table=tables.embeddings, eps=0.05, pivots=12))


def window_many(spark, folder):
    """The Euclidean window around 300 pivots, through their index."""
    return _copies(_split_parts(spark, folder, table=tables.embeddings, eps=0.05, pivots=300))


def window_joined(spark, folder):
    """The Euclidean window with the pivots sent tile by tile, here three at a time."""
    distinct = sampling.distinct_vectors(tables.mixed_parts(spark, folder), 0).withColumn("path", F.lit(""))
    distinct = distinct.withColumn("base", F.array().cast("array<int>"))
    pivots, ws = sampling.sample_pivots(distinct, 9), Workspace(spark)
    return _copies(partition.split_tiled(distinct, pivots, 30.0, partition.EUCLIDEAN, ws, "tiles", tile_bytes=48))


def vector_sums(spark, folder):
    rows = tables.given(spark, folder, "lineitem")
    rows = rows.select("l_returnflag", V.vector("l_quantity", "l_discount", "l_tax").alias("features"))
    return vector_sum(rows, ["l_returnflag"], 3).select("l_returnflag", *coordinates(3, 6, "sums"), "n")


def vector_means(spark, folder):
    rows = tables.given(spark, folder, "lineitem")
    rows = rows.select("l_linestatus", V.vector("l_quantity", "l_discount", "l_tax").alias("features"))
    return vector_mean(rows, ["l_linestatus"], 3).select("l_linestatus", *coordinates(3, 9, "center"), "n")


def _similar(table, eps, share=None, block_share=None, **options):
    """A similarity group-by. `share` sets the threshold to that part of the rows, `block_share` the size from which a
    partition is grouped block by block, so that both grow with the table."""

    def run(spark, folder):
        rows = table(spark, folder)
        total = rows.count() if share or block_share else 0
        threshold = min(THRESHOLD, max(1, int(total * share))) if share else THRESHOLD
        size = min(THRESHOLD, int(total * block_share)) if block_share else 0
        sizes = {"local_rows": size, "block_rows": size} if block_share else {}
        return similar.run(rows, similar.Options(eps, threshold=threshold, **sizes, **options))

    return run


one_partition = _similar(tables.mixed_parts, 200.0, num_pivots=1)
in_blocks = _similar(tables.mixed_parts, 200.0, num_pivots=1, block_share=0.25)
four_partitions = _similar(tables.mixed_parts, 200.0, num_pivots=4)
parts_one_round = _similar(tables.separated_parts, 2.0, num_pivots=5)
customers_one_round = _similar(tables.separated_customers, 2.0, num_pivots=8)
parts_rounds = _similar(tables.separated_parts, 2.0, num_pivots=6, share=0.15)
ratio_rounds = _similar(tables.separated_customers, 2.0, num_pivots=4, share=0.13, pivot_ratio=0.02)
metric_rounds = _similar(tables.separated_customers, 2.0, num_pivots=5, share=0.2, window=partition.METRIC)
mixed_rounds = _similar(tables.mixed_parts, 40.0, num_pivots=8, share=0.2)
mixed_metric = _similar(tables.mixed_parts, 12.0, num_pivots=8, share=0.2, window=partition.METRIC)
manhattan = _similar(tables.mixed_parts, 24.0, num_pivots=8, share=0.2, metric=metrics.MANHATTAN)
maximum = _similar(tables.mixed_parts, 22.0, num_pivots=8, share=0.2, metric=metrics.MAXIMUM)
mixed_ratio = _similar(tables.mixed_parts, 40.0, num_pivots=8, share=0.2, pivot_ratio=0.02)
equal_vectors = _similar(tables.cluster_parts, 0.0, num_pivots=4)
wide_vectors = _similar(tables.embeddings, 0.5, num_pivots=16, share=0.2)


def _members(groups):
    return groups.original_rows().select("group_id", "id", "agg", *coordinates(2))


def _centroids(groups):
    return groups.centroids().select("group_id", *coordinates(2, 6, "center"), "n")


def sim_local(spark, folder):
    return one_partition(spark, folder).original_rows().select("group_id", "id")


def sim_blocks(spark, folder):
    """As sim_local, with the partition treated as too large for one task."""
    return in_blocks(spark, folder).original_rows().select("group_id", "id")


def sim_tiles(spark, folder):
    """A plane much wider than eps, with five times the rows that one task is given: grouped tile by tile."""
    rows = tables.plane_customers(spark, folder)
    share = max(1, rows.count() // 5)
    options = similar.Options(20.0, num_pivots=1, threshold=THRESHOLD, local_rows=share, block_rows=share)
    return similar.run(rows, options, Workspace(spark)).original_rows().select("group_id", "id")


def sim_owner(spark, folder):
    """Four partitions of data that is not separated: the ownership rule leaves out rows whose groups cross a border, and
    `lost_and_doubled` counts them."""
    return four_partitions(spark, folder).original_rows().select("path", "group_id", "id")


def sim_members(spark, folder):
    return _members(parts_one_round(spark, folder))


def sim_centroids(spark, folder):
    return _centroids(parts_one_round(spark, folder))


def sim_count(spark, folder):
    return customers_one_round(spark, folder).number()


def sim_rounds(spark, folder):
    return _centroids(parts_rounds(spark, folder))


def sim_ratio(spark, folder):
    return _members(ratio_rounds(spark, folder))


def sim_metric(spark, folder):
    return _members(metric_rounds(spark, folder))


def sim_mixed(spark, folder):
    """Several rounds on data that is not separated: some rows are lost and some are in several groups (see `sim_owner`)."""
    return mixed_rounds(spark, folder).original_rows().select("path", "group_id", "id")


def sim_mixed_metric(spark, folder):
    """As sim_mixed, with the window of a general metric space."""
    return mixed_metric(spark, folder).original_rows().select("path", "group_id", "id")


def sim_l1(spark, folder):
    """Two rounds on data that is not separated, by the sum of the differences."""
    return manhattan(spark, folder).original_rows().select("path", "group_id", "id")


def sim_maximum(spark, folder):
    """The same by the largest difference."""
    return maximum(spark, folder).original_rows().select("path", "group_id", "id")


def sim_mixed_ratio(spark, folder):
    """As sim_mixed, with pivots of later rounds by a ratio."""
    return mixed_ratio(spark, folder).original_rows().select("path", "group_id", "id")


def sim_repeated_ids(spark, folder):
    """Four vectors share each id. A group is named by its lowest id here; several groups can have the same one."""
    rows = tables.mixed_parts(spark, folder).withColumn("id", F.expr("id div 4"))
    groups = similar.run(rows, similar.Options(200.0, num_pivots=1))
    named = groups.original_rows().groupBy("path", "group_id").agg(
        F.min("id").alias("low"), F.count("*").alias("n"), F.round(F.sum("agg"), 6).alias("agg")
    )
    return named.select("low", "n", "agg")


def sim_public(spark, folder):
    """The one-call form, with centroids."""
    centroids = similar.sim_group_by(tables.separated_parts(spark, folder), 2.0, num_pivots=5)
    return centroids.select("group_id", *coordinates(2, 6, "center"), "n")


def sim_zero_eps(spark, folder):
    groups = equal_vectors(spark, folder)
    return groups.centroids().select("group_id", *coordinates(2, 6, "center"), "n")


def sim_wide(spark, folder):
    """64 dimensions, where no split makes a partition smaller: every row its own group."""
    return wide_vectors(spark, folder).original_rows().select("group_id", "id")


def kmeans_assign(spark, folder):
    rows = tables.cluster_parts(spark, folder)
    near = nearest_point(rows, kmeans.initial_centers(rows, 4, 0))
    gap = F.round("near_distance", 6).alias("distance_sq")
    return near.select("id", F.col("near").cast("bigint").alias("cid"), gap)


def _centers(updated):
    cid = F.col("cid").cast("bigint").alias("cid")
    return updated.select(cid, *coordinates(2, 6, "center"), "n", F.round("cost", 4).alias("cost"))


def kmeans_step(spark, folder):
    rows = tables.cluster_parts(spark, folder)
    return _centers(kmeans.update(rows, kmeans.initial_centers(rows, 4, 0)))


def kmeans_step_wide(spark, folder):
    """64 dimensions: partial sums in numpy."""
    rows = tables.embeddings(spark, folder)
    updated = kmeans.update(rows, kmeans.initial_centers(rows, 8, 0))
    cid = F.col("cid").cast("bigint").alias("cid")
    return updated.select(cid, *coordinates(64, 6, "center"), "n", F.round("cost", 4).alias("cost"))


def kmeans_many(spark, folder):
    """100 centres in 64 dimensions, two iterations: an index keeps rows from centres too far away."""
    centers = kmeans.fit(tables.embeddings(spark, folder), 100, 2, 0.0).centers
    cid = F.col("cid").cast("bigint").alias("cid")
    return centers.select(cid, *coordinates(64, 6, "center"), "n", F.round("cost", 4).alias("cost"))


def kmeans_cost(spark, folder):
    rows = tables.cluster_parts(spark, folder)
    near = nearest_point(rows, kmeans.initial_centers(rows, 4, 0))
    return total_cost(near).select(F.round("cost", 4).alias("cost"))


def kmeans_fit(spark, folder):
    return _centers(kmeans.fit(tables.cluster_parts(spark, folder), 4, 3, 0.0).centers)


def kmeans_resumed(spark, folder):
    """Stopped after one iteration, and gone on with from what it wrote."""
    rows, ws = tables.cluster_parts(spark, folder), Workspace(spark)
    kmeans.fit(rows, 4, 1, 0.0, keep_history=True, workspace=ws)
    return _centers(kmeans.fit(rows, 4, 3, 0.0, workspace=ws, resume=True).centers)


def kmeans_converged(spark, folder):
    """Stopped by the change of the cost, before the iterations run out."""
    clusters = kmeans.fit(tables.cluster_parts(spark, folder), 4, 20, 0.02 * tables.given(spark, folder, "part").count())
    iterations = F.lit(clusters.iterations).cast("bigint").alias("iterations")
    return _centers(clusters.centers).select("*", iterations, F.lit(clusters.converged).alias("converged"))


def kmeans_bernoulli(spark, folder):
    return _centers(kmeans.fit(tables.cluster_parts(spark, folder), 4, 2, 0.0, frequency=0.3).centers)


def kmeans_history(spark, folder):
    history = kmeans.fit(tables.cluster_parts(spark, folder), 4, 3, 0.0, keep_history=True).history
    cid, iteration = (F.col(c).cast("bigint").alias(c) for c in ("cid", "iteration"))
    return history.select(iteration, cid, *coordinates(2, 6, "center"), F.round("cost", 4).alias("cost"))


def kmeans_drop_empty(spark, folder):
    """The second of three centres is far from every row."""
    return _centers(kmeans.update(tables.cluster_parts(spark, folder), [[10.0, 95.0], [1e6, 1e6], [40.0, 95.0]]))


def summary_kmeans(spark, folder):
    clusters = kmeans.fit(tables.cluster_parts(spark, folder), 4, 3, 0.0)
    summary = report.kmeans_summary(clusters, 4, 0.0, 0)
    return summary.select("centers", F.col("iterations").cast("bigint").alias("iterations"), F.round("cost", 4).alias("cost"))


def _generated(spark, folder):
    return generator.generate(tables.scale_factors(spark, folder), 3, 5, 40, 2.0, 11)


def generated_groups(spark, folder):
    return _generated(spark, folder).select("id", "agg", *coordinates(3, 9))


def generated_recovered(spark, folder):
    """Similarity group-by finds the generated groups again."""
    groups = _similar(_generated, 2.0, num_pivots=20, share=0.2)(spark, folder)
    return groups.original_rows().groupBy("group_id").agg(F.min("agg").alias("low"), F.max("agg").alias("high"))


def run_summary(spark, folder):
    summary = report.similar_summary(parts_one_round(spark, folder))
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("dimension", "groups", "lost_rows", "doubled_rows")]
    return summary.select("eps", *numbers)


def _written(spark, lines):
    path = f"{Workspace(spark).path}/lines"
    sinks.write_text(lines, path)
    return spark.read.text(path)


def sink_groups(spark, folder):
    groups = exact.group_by_vector(tables.lineitem(spark, folder), exact.MAXIMUM, dimension=3)
    return _written(spark, sinks.group_lines(groups)).select(F.col("value").alias("line"))


def _parsed(column, digits=6):
    numbers = F.split(column, ",")
    return [F.round(numbers[i].cast("double"), digits).alias(f"x{i + 1}") for i in range(2)]


def sink_summary(spark, folder):
    """Summaries of two runs in one table."""
    path = f"{Workspace(spark).path}/summaries"
    for choice in (exact.COUNT, exact.MAXIMUM):
        groups = exact.group_by_vector(tables.lineitem(spark, folder), choice, dimension=3)
        sinks.append_summary(report.exact_summary(groups, choice), path)
    return spark.read.parquet(path).select(F.col("choice").cast("bigint").alias("choice"), "groups")


def sink_table(spark, folder):
    path = f"{Workspace(spark).path}/table"
    sinks.write_table(exact.group_by_vector(tables.lineitem(spark, folder), exact.MINIMUM, dimension=3), path)
    return spark.read.parquet(path).select(*coordinates(3), F.round("value", 6).alias("value"))


def sink_centroids(spark, folder):
    lines = _written(spark, sinks.centroid_lines(customers_one_round(spark, folder).centroids()))
    return lines.select(*_parsed(F.col("value")))


def sink_members(spark, folder):
    lines = _written(spark, sinks.member_lines(customers_one_round(spark, folder).original_rows()))
    fields = F.split("value", "\t")
    row = F.split(fields[3], ",")
    return lines.select(
        fields[1].cast("bigint").alias("group_id"),
        fields[2].cast("bigint").alias("id"),
        *[row[i].cast("double").alias(name) for i, name in enumerate(("agg", "x1", "x2"))],
    )


def sink_centers(spark, folder):
    centers = kmeans.fit(tables.cluster_parts(spark, folder), 4, 2, 0.0).centers
    fields = F.split("value", "\t")
    lines = _written(spark, sinks.center_lines(centers))
    return lines.select(F.round(fields[0].cast("double"), 4).alias("cost"), *_parsed(fields[1]))


QUERIES = {
    "group_avg": group_by(exact.AVERAGE),
    "group_count": group_by(exact.COUNT),
    "group_max": group_by(exact.MAXIMUM),
    "group_min": group_by(exact.MINIMUM),
    "group_sum": group_by(exact.SUM, 4),
    "group_default": group_by(9),
    "group_number": group_number,
    "summary_exact": summary_exact,
    "vector_distance": vector_distance,
    "vector_distance_sq": vector_distance_sq,
    "vector_add": vector_add,
    "vector_scale": vector_scale,
    "vector_order": vector_order,
    "vector_text": vector_text,
    "csv_scan": csv_scan,
    "sample_pivots": sample_pivots,
    "sample_centers": sample_centers,
    "sample_bernoulli": sample_bernoulli,
    "sample_ratio": sample_ratio,
    "nearest_pivot": nearest_pivot,
    "window_euclidean": window_euclidean,
    "window_metric": window_metric,
    "window_wide": window_wide,
    "window_many": window_many,
    "window_joined": window_joined,
    "partition_counts": partition_counts,
    "partition_ready": partition_ready,
    "partition_oversized": partition_oversized,
    "vector_sum": vector_sums,
    "vector_mean": vector_means,
    "sim_local": sim_local,
    "sim_blocks": sim_blocks,
    "sim_tiles": sim_tiles,
    "sim_owner": sim_owner,
    "sim_members": sim_members,
    "sim_centroids": sim_centroids,
    "sim_count": sim_count,
    "sim_rounds": sim_rounds,
    "sim_ratio": sim_ratio,
    "sim_metric": sim_metric,
    "sim_mixed": sim_mixed,
    "sim_mixed_metric": sim_mixed_metric,
    "sim_mixed_ratio": sim_mixed_ratio,
    "sim_l1": sim_l1,
    "sim_maximum": sim_maximum,
    "sim_repeated_ids": sim_repeated_ids,
    "sim_public": sim_public,
    "sim_zero_eps": sim_zero_eps,
    "sim_wide": sim_wide,
    "kmeans_assign": kmeans_assign,
    "kmeans_step": kmeans_step,
    "kmeans_step_wide": kmeans_step_wide,
    "kmeans_many": kmeans_many,
    "kmeans_cost": kmeans_cost,
    "kmeans_fit": kmeans_fit,
    "kmeans_resumed": kmeans_resumed,
    "kmeans_bernoulli": kmeans_bernoulli,
    "kmeans_converged": kmeans_converged,
    "kmeans_history": kmeans_history,
    "kmeans_drop_empty": kmeans_drop_empty,
    "summary_kmeans": summary_kmeans,
    "generated_groups": generated_groups,
    "generated_recovered": generated_recovered,
    "run_summary": run_summary,
    "sink_groups": sink_groups,
    "sink_summary": sink_summary,
    "sink_table": sink_table,
    "sink_centroids": sink_centroids,
    "sink_members": sink_members,
    "sink_centers": sink_centers,
}
