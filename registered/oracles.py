"""The registered queries as SQL for DuckDB."""

import re

LINEITEM = "(SELECT [l_quantity, l_discount, l_tax] f, l_extendedprice agg FROM lineitem)"
CUSTOMERS = (
    "(SELECT c_custkey id, c_acctbal agg, [10.0::DOUBLE * c_nationkey, c_acctbal / 10000.0::DOUBLE] f FROM customer)"
)
PARTS = "(SELECT p_partkey id, p_retailprice agg, [10.0::DOUBLE * p_size, p_retailprice / 100.0::DOUBLE] f FROM part)"
MIXED = "(SELECT p_partkey id, p_retailprice agg, [p_retailprice, 20.0::DOUBLE * p_size] f FROM part)"
PLANE = "(SELECT c_custkey id, c_acctbal agg, [c_acctbal, 40.0::DOUBLE * c_nationkey] f FROM customer)"
CLUSTER = "(SELECT p_partkey id, p_retailprice agg, [p_size::DOUBLE, p_retailprice / 10.0::DOUBLE] f FROM part)"
EVENTS = "(SELECT event_id id, value agg, [value, user_id / 10.0::DOUBLE] f FROM events)"
EMBEDDINGS = "(SELECT vec_id id, label::DOUBLE agg, embedding::DOUBLE[] f FROM embeddings)"


def xs(n, column="f", digits=None):
    values = [f"{column}[{i + 1}]" for i in range(n)]
    return ", ".join(f"{f'round({v}, {digits})' if digits else v} AS x{i + 1}" for i, v in enumerate(values))


def group_by(value):
    return f"SELECT {xs(3)}, {value} AS value FROM {LINEITEM} GROUP BY f"


def draw(seed):
    return f"concat('0x', substr(md5(concat('{seed}:', id)), 1, 15))::BIGINT"


def vectors(table, seed=0):
    """Distinct vectors with lowest id, number of rows and lowest draw."""
    return f"(SELECT min(id) id, count(*) weight, min({draw(seed)}) draw, f FROM {table} GROUP BY f)"


def pivots(table, k, seed=0):
    return (
        f"(SELECT row_number() OVER (ORDER BY draw, id) - 1 pid, f p FROM {vectors(table, seed)} "
        f"ORDER BY draw, id LIMIT {k})"
    )


def centers(table, k, seed, where="true"):
    return (
        f"(SELECT row_number() OVER (ORDER BY {draw(seed)}, id) - 1 pid, f p FROM {table} WHERE {where} "
        f"ORDER BY {draw(seed)}, id LIMIT {k})"
    )


def fraction(seed):
    return f"{draw(seed)} / {1 << 60}::DOUBLE"


def near(points, squared=False):
    """One row per row of `v`: index of the nearest point and the distance to it."""
    gap = "list_sum(list_transform(range(1, len(f) + 1), lambda i: (f[i] - p[i]) * (f[i] - p[i])))"
    gap = gap if squared else "list_distance(f, p)"
    return (
        f"SELECT id, pid near, d FROM (SELECT id, pid, {gap} d FROM v, {points}) "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, pid) = 1"
    )


def placed(table, k, eps, window="euclidean", seed=0):
    """CTEs v (distinct vectors), p (pivots), n (nearest pivot), c (copies: id, child, base, weight, f)."""
    border = "(d * d - n.d * n.d) / (2 * list_distance(q.p, b.p))" if window == "euclidean" else "(d - n.d) / 2"
    border = border.replace("d * d", "list_distance(v.f, q.p) * list_distance(v.f, q.p)", 1)
    border = border.replace("(d - n.d)", "(list_distance(v.f, q.p) - n.d)", 1)
    return (
        f"v AS MATERIALIZED {vectors(table, seed)}, p AS MATERIALIZED {pivots(table, k, seed)}, "
        f"n AS MATERIALIZED ({near('p')}), "
        "c AS MATERIALIZED (SELECT v.id, v.weight, v.f, q.pid child, n.near base FROM v JOIN n USING (id) "
        f"JOIN p b ON b.pid = n.near JOIN p q ON q.pid = n.near OR {border} <= {eps}) "
    )


def counted(having=""):
    return (
        f"WITH {placed(PARTS, 6, 2.0)} SELECT child, sum(weight)::BIGINT AS rows, count(*) AS vectors FROM c "
        f"GROUP BY child {having}"
    )


def first_fit(copies, eps):
    """CTE g (part, id, founder): rows of `copies` (part, id, base, f) in ascending id join the first group all of
    whose members are at most eps away."""
    return (
        f"o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) nr FROM {copies}), "
        "s AS (SELECT part, 0::BIGINT nr, []::DOUBLE[][][] groups, 0::BIGINT pos FROM o GROUP BY part "
        "UNION ALL SELECT part, nr, CASE WHEN hit = 0 THEN list_append(groups, [f]) ELSE "
        "list_concat(list_append(groups[:hit - 1], list_append(groups[hit], f)), groups[hit + 1:]) END, "
        "CASE WHEN hit = 0 THEN len(groups) + 1 ELSE hit END FROM "
        "(SELECT s.part, o.nr, s.groups, o.f, coalesce(list_position(list_transform(s.groups, "
        f"lambda m: len(list_filter(m, lambda y: list_distance(y, o.f) > {eps})) = 0), true), 0)::BIGINT hit "
        "FROM s JOIN o ON o.part = s.part AND o.nr = s.nr + 1)), "
        "g AS MATERIALIZED (SELECT o.part, o.id, o.base, o.f, min(o.id) OVER (PARTITION BY o.part, s.pos) founder "
        "FROM o JOIN s ON s.part = o.part AND s.nr = o.nr) "
    )


def near_in_parts(rows, points):
    """One row per row of `rows` (part, id, f): index of the nearest of its part's points (part, pid, p)."""
    return (
        f"SELECT part, id, pid near, d FROM (SELECT part, id, pid, list_distance(f, p) d FROM {rows} JOIN {points} USING (part)) "
        "QUALIFY row_number() OVER (PARTITION BY part, id ORDER BY d, pid) = 1"
    )


def two_rounds(table, k, eps, share, window="euclidean", ratio=None):
    """Similarity group-by in at most two rounds, none of whose splits is given up: (path, group_id, id)."""
    wanted = f"greatest(1, floor(r * {ratio}))" if ratio else str(k)
    border = (
        "(list_distance(a2.f, q.p) ** 2 - n2.d ** 2) / (2 * list_distance(q.p, b.p))"
        if window == "euclidean"
        else "(list_distance(a2.f, q.p) - n2.d) / 2"
    )
    return (
        f"WITH RECURSIVE {placed(table, k, eps, window)}, "
        "cnt AS (SELECT child, sum(weight) r FROM c GROUP BY child), "
        f"few AS (SELECT least(50000, greatest(1, floor(count(*) * {share}))) few FROM {table}), "
        "a2 AS MATERIALIZED (SELECT child part, r, c.id, c.f, base, v.draw FROM c JOIN cnt USING (child) JOIN v USING (id), few WHERE r > few), "
        "p2 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY draw, id) - 1 pid, f p FROM a2 "
        f"QUALIFY row_number() OVER (PARTITION BY part ORDER BY draw, id) <= {wanted}), "
        f"n2 AS MATERIALIZED ({near_in_parts('a2', 'p2')}), "
        "c2 AS MATERIALIZED (SELECT concat(a2.part, '.', q.pid) part, a2.id, a2.f, [a2.base, n2.near] base FROM a2 JOIN n2 USING (part, id) "
        f"JOIN p2 b ON b.part = a2.part AND b.pid = n2.near JOIN p2 q ON q.part = a2.part AND (q.pid = n2.near OR {border} <= {eps})), "
        "both_ AS MATERIALIZED (SELECT child::VARCHAR part, c.id, c.f, [base] base FROM c JOIN cnt USING (child), few WHERE r <= few "
        "UNION ALL SELECT * FROM c2), "
        f"{first_fit('both_', eps)}, "
        "k AS (SELECT *, string_split(part, '.') s FROM g "
        "QUALIFY min(base[1]) OVER (PARTITION BY part, founder) = string_split(part, '.')[1]::BIGINT "
        "AND coalesce(min(base[2]) OVER (PARTITION BY part, founder) = string_split(part, '.')[2]::BIGINT, true)) "
        f"SELECT part AS path, founder AS group_id, r.id AS id FROM k JOIN {table} r USING (f)"
    )


def by_metric(sql, fold):
    """The query with another distance: a fold over the absolute differences of the coordinates."""
    return re.sub(r"list_distance\(([^(),]+), ([^(),]+)\)", rf"{fold}(list_transform(list_zip(\1, \2), lambda z: abs(z[1] - z[2])))", sql)


def labelled(table, key, columns):
    return f"SELECT min(id) OVER (PARTITION BY {key}) AS group_id, {columns} FROM {table}"


def centroids(table, key):
    return (
        f"SELECT min(id) AS group_id, round(avg(f[1]), 6) AS x1, round(avg(f[2]), 6) AS x2, count(*) AS n "
        f"FROM {table} GROUP BY {key}"
    )


def lloyd(table, k, iterations, seed=0, where="true", dimension=2):
    """CTEs c0, c1, ...: (pid, p, n, cost) after each iteration."""
    ctes = [
        f"v AS MATERIALIZED (SELECT * FROM {table})",
        f"c0 AS MATERIALIZED (SELECT pid, p, NULL::BIGINT n, NULL::DOUBLE cost FROM {centers(table, k, seed, where)})",
    ]
    means = ", ".join(f"avg(f[{i + 1}])" for i in range(dimension))
    for i in range(iterations):
        ctes.append(f"a{i} AS MATERIALIZED ({near(f'c{i}', squared=True)})")
        ctes.append(
            f"c{i + 1} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY near) - 1 pid, p, n, cost FROM "
            f"(SELECT near, [{means}] p, count(*) n, sum(d) cost FROM a{i} JOIN v USING (id) GROUP BY near))"
        )
    return "WITH " + ", ".join(ctes)


def center_rows(name, dimension=2):
    return f" SELECT pid AS cid, {xs(dimension, 'p', 6)}, n, round(cost, 4) AS cost FROM {name}"


HISTORY = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS iteration, pid AS cid, {xs(2, 'p', 6)}, round(cost, 4) AS cost FROM c{i}" for i in range(4)
)

_SF = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END"


def hashed(text, chunk=0):
    return f"concat('0x', substr(md5({text}), {1 + 8 * chunk}, 8))::BIGINT"


def generated(dimension=3, low=5, high=40, eps=2.0, seed=11):
    """The test table: (id, agg, x1..xn)."""
    side = eps / dimension**0.5
    size = hashed(f"concat('{seed}:size:', sf, ':', grp)")
    copies = hashed(f"concat('{seed}:copies:', sf, ':', grp, ':', point)")
    shift = [f" + grp * {2 * eps}::DOUBLE", f" + sf * {2 * eps}::DOUBLE"] + [""] * dimension
    inside = [
        hashed(f"concat('{seed}:x{d // 4}:', sf, ':', grp, ':', point)", d % 4)
        + f" / 4294967296.0::DOUBLE * {side!r}::DOUBLE{shift[d]}"
        for d in range(dimension)
    ]
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return (
        f"WITH spec AS (SELECT {_SF} sf, count(*) points FROM customer GROUP BY 1), "
        f"drawn AS (SELECT sf, points, grp, {low} + {size} % {high - low} size FROM "
        f"(SELECT sf, points, unnest(range(0, (points + {low} - 1) // {low})) grp FROM spec)), "
        f"cum AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sf ORDER BY grp {before}), 0) bef FROM drawn), "
        "sized AS (SELECT sf, grp, bef, least(size, points - bef)::BIGINT size FROM cum WHERE bef < points), "
        "starts AS (SELECT sf, coalesce(sum(pts) OVER w, 0) first_id, coalesce(sum(grps) OVER w, 0) first_grp FROM "
        f"(SELECT sf, sum(size) pts, count(*) grps FROM sized GROUP BY sf) WINDOW w AS (ORDER BY sf {before})), "
        f"pt AS (SELECT *, 1 + {copies} % 3 copies FROM (SELECT *, unnest(range(0, size)) point FROM sized)), "
        f"us AS (SELECT *, coalesce(sum(copies) OVER (PARTITION BY sf, grp ORDER BY point {before}), 0) used FROM pt), "
        "rw AS (SELECT *, unnest(range(1, least(copies, size - used)::BIGINT + 1)) cp FROM us WHERE used < size) "
        "SELECT (first_id + bef + used + cp)::BIGINT AS id, (first_grp + grp)::DOUBLE AS agg, "
        + ", ".join(f"round({x}, 9) AS x{d + 1}" for d, x in enumerate(inside))
        + " FROM rw JOIN starts USING (sf)"
    )


ORACLES = {
    "group_avg": group_by("round(avg(agg), 6)"),
    "group_count": group_by("count(*)"),
    "group_max": group_by("round(max(agg), 6)"),
    "group_min": group_by("round(min(agg), 6)"),
    "group_sum": group_by("round(sum(agg), 4)"),
    "group_default": group_by("round(avg(agg), 6)"),
    "group_number": f"SELECT count(*) AS groups FROM (SELECT DISTINCT f FROM {LINEITEM})",
    "summary_exact": f"SELECT 5::BIGINT AS choice, count(*) AS groups FROM (SELECT DISTINCT f FROM {LINEITEM})",
    "vector_distance": f"SELECT id, round(list_distance(f, [100.0, 0.5]::DOUBLE[]), 9) AS distance FROM {CUSTOMERS}",
    "vector_distance_sq": f"SELECT id, round((f[1] - 100.0) ** 2 + (f[2] - 0.5) ** 2, 6) AS distance FROM {CUSTOMERS}",
    "vector_add": f"SELECT id, round(f[1] + 100.0::DOUBLE, 9) AS x1, round(f[2] + 0.5::DOUBLE, 9) AS x2 FROM {CUSTOMERS}",
    "vector_scale": f"SELECT id, round(f[1] / 7.0::DOUBLE, 9) AS x1, round(f[2] / 7.0::DOUBLE, 9) AS x2 FROM {CUSTOMERS}",
    "vector_order": "SELECT id, row_number() OVER (ORDER BY f[2], f[1], id) AS place "
    f"FROM {PARTS}",
    "vector_text": "SELECT concat_ws(',', l_quantity::VARCHAR, l_discount::VARCHAR, l_tax::VARCHAR) AS vector, "
    "count(*) AS n FROM lineitem GROUP BY 1",
    "csv_scan": f"SELECT id, agg, {xs(2)} FROM {CUSTOMERS}",
    "sample_pivots": f"SELECT pid, {xs(2, 'p')} FROM {pivots(PARTS, 20, 7)}",
    "sample_centers": f"SELECT id, {xs(2)} FROM {PARTS} ORDER BY {draw(3)}, id LIMIT 25",
    "sample_bernoulli": f"SELECT id, {xs(2)} FROM {EVENTS} WHERE {fraction(3)} < 0.05 ORDER BY {draw(3)}, id LIMIT 100",
    "sample_ratio": f"SELECT child, rows, greatest(1, floor(rows * 0.01))::BIGINT AS pivots FROM ({counted()})",
    "nearest_pivot": f"WITH v AS MATERIALIZED (SELECT * FROM {EMBEDDINGS}), p AS MATERIALIZED "
    f"{centers(EMBEDDINGS, 16, 1)} SELECT id, near, round(d, 9) AS distance FROM ({near('p')})",
    "window_euclidean": f"WITH {placed(MIXED, 9, 30.0)} SELECT id, child, base FROM c",
    "window_metric": f"WITH {placed(MIXED, 9, 30.0, 'metric')} SELECT id, child, base FROM c",
    "window_wide": f"WITH {placed(EMBEDDINGS, 12, 0.05)} SELECT id, child, base FROM c",
    "window_many": f"WITH {placed(EMBEDDINGS, 300, 0.05)} SELECT id, child, base FROM c",
    "window_joined": f"WITH {placed(MIXED, 9, 30.0)} SELECT id, child, base FROM c",
    "partition_counts": counted(),
    "partition_ready": counted("HAVING sum(weight) <= 400"),
    "partition_oversized": counted("HAVING sum(weight) > 400"),
    "vector_sum": "SELECT l_returnflag, round(sum(l_quantity), 6) AS x1, round(sum(l_discount), 6) AS x2, "
    "round(sum(l_tax), 6) AS x3, count(*) AS n FROM lineitem GROUP BY 1",
    "vector_mean": "SELECT l_linestatus, round(avg(l_quantity), 9) AS x1, round(avg(l_discount), 9) AS x2, "
    "round(avg(l_tax), 9) AS x3, count(*) AS n FROM lineitem GROUP BY 1",
    "sim_local": f"WITH RECURSIVE {first_fit(f'(SELECT 0 part, 0 base, id, f FROM {MIXED})', 200.0)} "
    "SELECT founder AS group_id, id FROM g",
    "sim_tiles": f"WITH RECURSIVE {first_fit(f'(SELECT 0 part, 0 base, id, f FROM {PLANE})', 20.0)} "
    "SELECT founder AS group_id, id FROM g",
    "sim_owner": f"WITH RECURSIVE {placed(MIXED, 4, 200.0)}, "
    f"{first_fit('(SELECT child part, base, id, f FROM c)', 200.0)}, "
    "k AS (SELECT * FROM g QUALIFY min(base) OVER (PARTITION BY part, founder) = part) "
    f"SELECT part::VARCHAR AS path, founder AS group_id, r.id AS id FROM k JOIN {MIXED} r USING (f)",
    "sim_members": labelled(PARTS, "f[1]", f"id, agg, {xs(2)}"),
    "sim_centroids": centroids(PARTS, "f[1]"),
    "sim_count": "SELECT count(DISTINCT c_nationkey) AS groups FROM customer",
    "sim_rounds": centroids(PARTS, "f[1]"),
    "sim_ratio": labelled(CUSTOMERS, "f[1]", f"id, agg, {xs(2)}"),
    "sim_metric": labelled(CUSTOMERS, "f[1]", f"id, agg, {xs(2)}"),
    "sim_mixed": two_rounds(MIXED, 8, 40.0, 0.2),
    "sim_mixed_metric": two_rounds(MIXED, 8, 12.0, 0.2, window="metric"),
    "sim_mixed_ratio": two_rounds(MIXED, 8, 40.0, 0.2, ratio=0.02),
    "sim_l1": by_metric(two_rounds(MIXED, 8, 24.0, 0.2, window="metric"), "list_sum"),
    "sim_maximum": by_metric(two_rounds(MIXED, 8, 22.0, 0.2, window="metric"), "list_max"),
    "sim_public": centroids(PARTS, "f[1]"),
    "sim_zero_eps": centroids(CLUSTER, "f"),
    "sim_wide": "SELECT vec_id AS group_id, vec_id AS id FROM embeddings",
    "kmeans_assign": f"WITH v AS MATERIALIZED (SELECT * FROM {CLUSTER}), p AS MATERIALIZED {centers(CLUSTER, 4, 0)} "
    f"SELECT id, near AS cid, round(d, 6) AS distance_sq FROM ({near('p', squared=True)})",
    "kmeans_step": lloyd(CLUSTER, 4, 1) + center_rows("c1"),
    "kmeans_step_wide": lloyd(EMBEDDINGS, 8, 1, dimension=64) + center_rows("c1", 64),
    "kmeans_many": lloyd(EMBEDDINGS, 100, 2, dimension=64) + center_rows("c2", 64),
    "kmeans_cost": lloyd(CLUSTER, 4, 1) + " SELECT round(sum(cost), 4) AS cost FROM c1",
    "kmeans_fit": lloyd(CLUSTER, 4, 3) + center_rows("c3"),
    "kmeans_resumed": lloyd(CLUSTER, 4, 3) + center_rows("c3"),
    "kmeans_converged": lloyd(CLUSTER, 4, 20)
    + ", costs AS ("
    + " UNION ALL ".join(f"SELECT {i} i, sum(cost) cost FROM c{i}" for i in range(1, 21))
    + "), ended AS (SELECT coalesce(min(i), 20)::BIGINT e, count(*) > 0 converged FROM (SELECT i, abs(cost - lag(cost) OVER (ORDER BY i)) gap "
    "FROM costs) WHERE gap < 0.02 * (SELECT count(*) FROM part)), every_ AS ("
    + " UNION ALL ".join(f"SELECT {i} i, * FROM c{i}" for i in range(1, 21))
    + f") SELECT pid AS cid, {xs(2, 'p', 6)}, n, round(cost, 4) AS cost, e AS iterations, converged FROM every_ JOIN ended ON i = e",
    "kmeans_bernoulli": lloyd(CLUSTER, 4, 2, where=f"{fraction(0)} < 0.3") + center_rows("c2"),
    "kmeans_history": lloyd(CLUSTER, 4, 3) + " " + HISTORY,
    "kmeans_drop_empty": "WITH v AS (SELECT *, (f[1] - 10) ** 2 + (f[2] - 95) ** 2 a, (f[1] - 40) ** 2 + "
    f"(f[2] - 95) ** 2 b FROM {CLUSTER}) SELECT CASE WHEN a <= b THEN 0 ELSE 2 END::BIGINT AS cid, "
    "round(avg(f[1]), 6) AS x1, round(avg(f[2]), 6) AS x2, count(*) AS n, round(sum(least(a, b)), 4) AS cost "
    "FROM v GROUP BY 1",
    "summary_kmeans": lloyd(CLUSTER, 4, 3)
    + " SELECT count(*) AS centers, 3::BIGINT AS iterations, round(sum(cost), 4) AS cost FROM c3",
    "generated_groups": generated(),
    "generated_recovered": f"SELECT min(id) AS group_id, agg AS low, agg AS high FROM ({generated()}) GROUP BY agg",
    "run_summary": "SELECT 2.0::DOUBLE AS eps, 2::BIGINT AS dimension, count(DISTINCT p_size) AS groups, "
    "0::BIGINT AS lost_rows, 0::BIGINT AS doubled_rows FROM part",
    "sink_summary": f"SELECT unnest([2, 3])::BIGINT AS choice, count(*) AS groups FROM (SELECT DISTINCT f FROM {LINEITEM})",
    "sink_table": group_by("round(min(agg), 6)"),
    "sink_groups": "SELECT concat(l_quantity, ',', l_discount, ',', l_tax, chr(9), max(l_extendedprice)) AS line "
    "FROM lineitem GROUP BY l_quantity, l_discount, l_tax",
    "sink_centroids": f"SELECT round(avg(f[1]), 6) AS x1, round(avg(f[2]), 6) AS x2 FROM {CUSTOMERS} GROUP BY f[1]",
    "sink_members": labelled(CUSTOMERS, "f[1]", f"id, agg, {xs(2)}"),
    "sink_centers": lloyd(CLUSTER, 4, 2) + f" SELECT round(cost, 4) AS cost, {xs(2, 'p', 6)} FROM c2",
}
_FOURTHS = MIXED.replace("p_partkey id", "p_partkey // 4 id")
ORACLES["sim_repeated_ids"] = (
    "WITH RECURSIVE w AS MATERIALIZED (SELECT min(id) low, count(*) n, sum(agg) agg, f FROM "
    f"{_FOURTHS} GROUP BY f), "
    + first_fit("(SELECT 0 part, 0 base, row_number() OVER (ORDER BY low, f) id, f FROM w)", 200.0)
    + "SELECT min(low) AS low, sum(n)::BIGINT AS n, round(sum(agg), 6) AS agg FROM g JOIN w USING (f) GROUP BY founder"
)
ORACLES["sim_blocks"] = ORACLES["sim_local"]
