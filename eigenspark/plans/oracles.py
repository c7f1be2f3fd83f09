"""SQL for DuckDB with the rows of the queries of the same names."""

from __future__ import annotations

_E = "e AS (SELECT vec_id AS row_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings)"
_KEY = "md5(CAST(vec_id AS VARCHAR) || ':42')"
_K = f"k AS (SELECT vec_id AS row_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"
_HELD = "r <= CASE WHEN n > 1 THEN greatest(1, least(round_even(n * 0.2, 0), n - 1)) ELSE 0 END"
_FOLDS = f"f AS (SELECT vec_id AS row_id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY {_KEY}, vec_id) - 1 AS INTEGER) AS fold FROM embeddings)"
_H = f"h AS (SELECT row_id, label, CAST(embedding AS DOUBLE[]) AS x, {_HELD} AS held FROM k)"
_M = """m0 AS (SELECT label AS c, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM h WHERE NOT held),
    m1 AS (SELECT c, pos, avg(v) AS v FROM m0 GROUP BY c, pos), m AS (SELECT c, list(v ORDER BY pos) AS mean FROM m1 GROUP BY c)"""
_NEAREST = f"""{_K}, {_H}, {_M},
    d AS (SELECT row_id, label, c, list_distance(x, mean) AS d FROM h, m WHERE held),
    p AS (SELECT row_id, label, CAST(arg_min(c, d) AS INTEGER) AS predicted FROM d GROUP BY row_id, label)"""
_KNN = f"""{_K}, {_H},
    d AS (SELECT q.row_id AS query_id, q.label AS truth, t.row_id AS neighbor_id, t.label AS neighbor_label, pow(list_distance(q.x, t.x), 2) AS distance FROM h q, h t WHERE q.held AND NOT t.held),
    nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)"""
_SCORES = f"""{_FOLDS}, x AS (SELECT row_id, f.label, fold, CAST(embedding AS DOUBLE[]) AS x FROM f JOIN embeddings ON row_id = vec_id),
    d AS (SELECT a.row_id AS q, a.fold, a.label AS truth, b.row_id AS t, b.label AS l, list_distance(a.x, b.x) AS d FROM x a JOIN x b ON a.fold <> b.fold),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS r FROM d),
    v AS (SELECT k, q, fold, truth, l, count(*) AS n FROM r, (SELECT unnest([1, 3, 5]) AS k) WHERE r <= k GROUP BY ALL),
    p AS (SELECT k, q, fold, truth, arg_min(l, -n * 1000 + l) AS said FROM v GROUP BY k, q, fold, truth),
    m0 AS (SELECT g, label AS c, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM x, (SELECT unnest(generate_series(0, 4)) AS g) WHERE fold <> g),
    m1 AS (SELECT g, c, pos, avg(v) AS v FROM m0 GROUP BY g, c, pos), m AS (SELECT g, c, list(v ORDER BY pos) AS mean FROM m1 GROUP BY g, c),
    n AS (SELECT row_id, fold, label AS truth, arg_min(c, list_distance(x, mean)) AS said FROM x JOIN m ON fold = g GROUP BY row_id, fold, label),
    s AS (
        SELECT 'knn' AS model, CAST((k - 1) / 2 AS INTEGER) AS place, 'k=' || k AS setting, fold, avg(CASE WHEN said = truth THEN 1.0 ELSE 0.0 END) AS score FROM p GROUP BY k, fold
        UNION ALL SELECT 'nearest_class_mean', 0, 'n_components=64', fold, avg(CASE WHEN said = truth THEN 1.0 ELSE 0.0 END) FROM n GROUP BY fold
    )"""
_BEST = f"""{_SCORES}, a AS (SELECT model, place, setting, avg(score) AS score FROM s GROUP BY ALL),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(score, 12) DESC, place) = 1),
    i AS (SELECT model, fold, avg(score) AS inner_score FROM s GROUP BY model, fold),
    z AS (SELECT s.model, s.score, inner_score FROM s JOIN b USING (model, setting) JOIN i ON i.model = s.model AND i.fold = s.fold)"""


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _lloyd(k: int, steps: int) -> str:
    """Assignments of so many of Lloyd's steps, unrolled."""
    out = [
        "x AS (SELECT vec_id AS row_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY {_KEY}, vec_id) - 1 AS INTEGER) AS c, CAST(embedding AS DOUBLE[]) AS y FROM embeddings QUALIFY c < {k})",
    ]
    for i in range(steps):
        out.append(f"a{i} AS (SELECT row_id, label, x, arg_min(c, list_distance(x, y)) AS cluster FROM x, c{i} GROUP BY ALL)")
        out.append(f"u{i} AS (SELECT cluster AS c, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i})")
        out.append(f"c{i + 1} AS (SELECT c, list(v ORDER BY pos) AS y FROM (SELECT c, pos, avg(v) AS v FROM u{i} GROUP BY c, pos) GROUP BY c)")
    return ",\n    ".join(out)


_CLUSTERS = _lloyd(4, 3)
_GRID = """
    SELECT model, CAST(place AS INTEGER) AS place, setting FROM (
        WITH c AS (SELECT unnest([50, 100, 200]) AS c), r AS (SELECT unnest(['0.0001', '0.001', '0.01']) AS r), e AS (SELECT unnest([20, 50]) AS e), l AS (SELECT unnest(['0.1', '0.2']) AS l)
        SELECT m AS model, row_number() OVER (PARTITION BY m ORDER BY c) - 1 AS place, 'n_components=' || c AS setting FROM c, (SELECT unnest(['linear_least_squares', 'nearest_class_mean']) AS m)
        UNION ALL SELECT 'knn', row_number() OVER (ORDER BY k) - 1, 'k=' || k FROM (SELECT unnest([1, 3, 5]) AS k)
        UNION ALL SELECT 'svm', row_number() OVER (ORDER BY c, r, e, l) - 1, 'epochs=' || e || ', learning_rate=' || l || ', n_components=' || c || ', reg_strength=' || r FROM c, r, e, l
    )"""

SQL = {
    "class_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "dense_class_counts": "SELECT CAST(c AS INTEGER) AS label, count(vec_id) AS n FROM (SELECT unnest(generate_series(0, 11)) AS c) LEFT JOIN embeddings ON label = c GROUP BY c",
    "class_count_range": "SELECT min(n) AS min_count, max(n) AS max_count, count(*) AS n_classes FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)",
    "dataset_summary": "SELECT CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_classes, CAST(max(p) AS BIGINT) AS n_features, min(n) AS min_class_count, max(n) AS max_class_count FROM (SELECT count(*) AS n, max(len(embedding)) AS p FROM embeddings GROUP BY label)",
    "label_encode": "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label FROM documents",
    "label_decode": "SELECT vec_id AS row_id, label, 'person_' || label AS name FROM embeddings",
    "path_parse": r"""
        WITH p AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 7 = 0 THEN 'x_' || vec_id || '.pgm' WHEN vec_id % 3 = 0 THEN 'set/p' || label || '_i' || vec_id || '(2).pgm' ELSE 'p' || label || '_i' || vec_id || '.pgm' END AS path FROM embeddings)
        SELECT row_id, path, CAST(regexp_extract(path, '(?:.*/)?p(\d+)_i(\d+)(?:\(\d+\))?\.pgm$', 1) AS INTEGER) AS person_id, CAST(regexp_extract(path, '(?:.*/)?p(\d+)_i(\d+)(?:\(\d+\))?\.pgm$', 2) AS INTEGER) AS image_id
        FROM p WHERE regexp_matches(path, '(?:.*/)?p(\d+)_i(\d+)(?:\(\d+\))?\.pgm$')""",
    "per_class_cap": f"WITH {_K} SELECT row_id, label FROM k WHERE r <= 20",
    "first_n_per_class": "SELECT vec_id AS row_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 30",
    "global_cap": f"SELECT vec_id AS row_id, label FROM embeddings ORDER BY {_KEY}, vec_id LIMIT 100",
    "stratified_holdout": f"WITH {_K} SELECT row_id, label, {_HELD} AS is_holdout FROM k",
    "stratified_kfold": f"WITH {_FOLDS} SELECT row_id, label, fold FROM f",
    "three_way_split": f"WITH {_K} SELECT row_id, label, CASE WHEN r <= greatest(1, round_even(n * 0.15, 0)) THEN 'test' WHEN r <= 2 * greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM k",
    "shuffle_split": f"SELECT vec_id AS row_id, label, row_number() OVER (ORDER BY {_KEY}, vec_id) <= floor(count(*) OVER () * 0.75) AS is_train FROM embeddings",
    "event_holdout": f"WITH k AS (SELECT event_id AS row_id, event_type AS label, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT row_id, label, {_HELD} AS is_holdout FROM k",
    "complement_train": f"WITH {_FOLDS} SELECT row_id, label FROM f WHERE fold <> 0",
    "nested_fold_assignment": f"""
        WITH {_FOLDS}, n AS (SELECT row_id, label, CAST(o AS INTEGER) AS outer_fold FROM f, (SELECT unnest(generate_series(0, 4)) AS o) WHERE o <> fold)
        SELECT row_id, outer_fold, CAST(ntile(3) OVER (PARTITION BY outer_fold, label ORDER BY md5(CAST(row_id AS VARCHAR) || ':' || CAST(43 + outer_fold AS VARCHAR)), row_id) - 1 AS INTEGER) AS inner_fold FROM n""",
    "cv_feasibility": "WITH n AS (SELECT count(*) AS n FROM embeddings GROUP BY label), o AS (SELECT min(n) AS min_class_count, max(n) AS max_class_count, CAST(min(n - ceil(n / 5.0)) AS BIGINT) AS min_outer_train_count FROM n) SELECT *, min_class_count >= 5 AND min_outer_train_count >= 3 AS feasible FROM o",
    "zscore_vector": f"WITH {_E}, m AS (SELECT row_id, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY row_id) SELECT row_id, pos, {_r('CASE WHEN s > 0 THEN (v - m) / s ELSE v - m END')} AS value FROM e JOIN m USING (row_id)",
    "minmax_vector": f"WITH {_E}, m AS (SELECT row_id, min(v) AS lo, max(v) AS hi FROM e GROUP BY row_id) SELECT row_id, pos, {_r('CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END')} AS value FROM e JOIN m USING (row_id)",
    "symmetric_scale": f"WITH {_E}, m AS (SELECT row_id, min(v) AS lo, max(v) AS hi FROM e GROUP BY row_id) SELECT row_id, pos, {_r('2 * (v - lo) / (hi - lo) - 1')} AS value FROM e JOIN m USING (row_id)",
    "flat_resize": f"SELECT vec_id AS row_id, CAST(t AS INTEGER) AS pos, {_r('CAST(embedding[CAST(floor((t // 6) * 8 / 5) * 8 + floor((t % 6) * 8 / 6) + 1 AS INTEGER)] AS DOUBLE)')} AS value FROM embeddings, (SELECT unnest(generate_series(0, 29)) AS t)",
    "unflatten_rows": f"WITH {_E} SELECT row_id, CAST(pos // 8 AS INTEGER) AS line, {_r('sum(v)')} AS line_sum FROM e GROUP BY row_id, pos // 8",
    "bar_crop": f"""
        WITH {_E}, s AS (SELECT row_id, var_pop(v) FILTER (pos % 8 < 2) AS l, var_pop(v) FILTER (pos % 8 >= 6) AS r FROM e GROUP BY row_id),
        c AS (SELECT row_id, pos, v FROM e JOIN s USING (row_id) WHERE CASE WHEN l < r THEN pos % 8 >= 2 ELSE pos % 8 < 6 END)
        SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY pos) - 1 AS INTEGER) AS pos, {_r('v')} AS value FROM c""",
    "mean_vector": f"WITH {_E} SELECT pos, {_r('avg(v)')} AS mean FROM e GROUP BY pos",
    "column_variance_total": f"WITH {_E} SELECT {_r('sum(s)')} AS total_variance FROM (SELECT var_pop(v) AS s FROM e GROUP BY pos)",
    "sq_norms": f"WITH {_E} SELECT row_id, {_r('sum(v * v)')} AS sq_norm FROM e GROUP BY row_id",
    "global_mean_std": f"WITH {_E} SELECT count(*) AS n, {_r('avg(v)')} AS mean, {_r('stddev_pop(v)')} AS deviation FROM e",
    "standardised_vector": f"WITH {_E}, m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM e) SELECT row_id, pos, {_r('(v - m) / s')} AS value FROM e, m",
    "gram_matrix": f"WITH {_E} SELECT a.pos AS i, b.pos AS j, {_r('sum(a.v * b.v)')} AS value FROM e a JOIN e b USING (row_id) GROUP BY a.pos, b.pos",
    "covariance_matrix": f"WITH {_E} SELECT a.pos AS i, b.pos AS j, {_r('covar_samp(a.v, b.v)')} AS value FROM e a JOIN e b USING (row_id) GROUP BY a.pos, b.pos",
    "ls_cross_term": f"WITH {_E} SELECT label, pos, {_r('sum(v)')} AS total FROM e GROUP BY label, pos",
    "variance_curve": f"""
        WITH {_E}, s AS (SELECT pos, var_pop(v) AS s FROM e GROUP BY pos), r AS (SELECT pos, s, s / sum(s) OVER () AS ratio, CAST(row_number() OVER (ORDER BY s DESC, pos) AS INTEGER) AS place FROM s),
        c AS (SELECT pos, place, ratio, sum(ratio) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS cumulative FROM r)
        SELECT pos, place, {_r('ratio')} AS ratio, {_r('cumulative')} AS cumulative, CAST(coalesce(min(place) FILTER (cumulative >= 0.5) OVER (), 1) AS INTEGER) AS n_target FROM c""",
    "class_centroids": f"""
        WITH {_E}, d AS (SELECT CAST(c AS INTEGER) AS label, CAST(p AS INTEGER) AS pos FROM (SELECT unnest(generate_series(0, 10)) AS c), (SELECT unnest(generate_series(0, 63)) AS p))
        SELECT label, pos, count(v) AS n, {_r('coalesce(avg(v), 0)')} AS mean FROM d LEFT JOIN e USING (label, pos) GROUP BY label, pos""",
    "nearest_mean_predict": f"WITH {_NEAREST} SELECT row_id, label, predicted FROM p",
    "nearest_mean_confusion": f"WITH {_NEAREST}, g AS (SELECT CAST(i // 10 AS INTEGER) AS label, CAST(i % 10 AS INTEGER) AS predicted FROM (SELECT unnest(generate_series(0, 99)) AS i)) SELECT g.label, g.predicted, count(row_id) AS n FROM g LEFT JOIN p USING (label, predicted) GROUP BY g.label, g.predicted",
    "nearest_mean_accuracy": f"WITH {_NEAREST} SELECT count(*) AS n, {_r('avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM p",
    "match_report": f"WITH {_NEAREST} SELECT row_id, label, predicted, CASE WHEN label = predicted THEN 'OK' ELSE 'MISS' END AS match FROM p",
    "label_agreement": "WITH g AS (SELECT CAST(i // 2 AS INTEGER) AS label, CAST(i % 2 AS INTEGER) AS predicted FROM (SELECT unnest(generate_series(0, 3)) AS i)) SELECT g.label, g.predicted, count(doc_id) AS n FROM g LEFT JOIN labels l ON l.quality = g.label AND l.toxic = g.predicted GROUP BY g.label, g.predicted",
    "knn_neighbors": f"WITH {_KNN} SELECT query_id, neighbor_id, neighbor_label, {_r('distance')} AS distance, rank FROM nn WHERE rank <= 5",
    "knn_predict": f"WITH {_KNN}, v AS (SELECT query_id, neighbor_label AS l, count(*) AS c FROM nn WHERE rank <= 5 GROUP BY ALL) SELECT query_id, CAST(arg_min(l, -c * 1000 + l) AS INTEGER) AS predicted FROM v GROUP BY query_id",
    "knn_vote_share": f"WITH {_KNN} SELECT query_id, neighbor_label AS label, count(*) AS votes, {_r('count(*) / 5.0')} AS share FROM nn WHERE rank <= 5 GROUP BY query_id, neighbor_label",
    "knn_k_sweep": f"""
        WITH {_KNN}, v AS (SELECT k, query_id, truth, neighbor_label AS l, count(*) AS c FROM nn, (SELECT unnest([1, 3, 5, 7]) AS k) WHERE rank <= k GROUP BY ALL),
        p AS (SELECT k, query_id, truth, arg_min(l, -c * 1000 + l) AS predicted FROM v GROUP BY k, query_id, truth)
        SELECT CAST(k AS INTEGER) AS k, count(*) AS n, CAST(sum(CASE WHEN predicted = truth THEN 1 ELSE 0 END) AS BIGINT) AS correct, {_r('1 - sum(CASE WHEN predicted = truth THEN 1 ELSE 0 END) / count(*)')} AS error FROM p GROUP BY k""",
    "nested_knn_scores": f"""
        WITH {_FOLDS}, n AS (SELECT row_id, label, CAST(o AS INTEGER) AS o FROM f, (SELECT unnest(generate_series(0, 4)) AS o) WHERE o <> fold),
        i AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY o, label ORDER BY md5(CAST(row_id AS VARCHAR) || ':' || CAST(43 + o AS VARCHAR)), row_id) - 1 AS INTEGER) AS i FROM n),
        x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        d AS (SELECT a.vec_id AS q, b.vec_id AS t, list_distance(a.x, b.x) AS d FROM x a, x b),
        c AS (
            SELECT a.o, a.i, a.row_id AS q, a.label AS truth, b.row_id AS t, b.label AS l FROM i a JOIN i b ON a.o = b.o AND a.i <> b.i
            UNION ALL SELECT a.fold, -1, a.row_id, a.label, b.row_id, b.label FROM f a JOIN f b ON a.fold <> b.fold
        ),
        r AS (SELECT c.*, row_number() OVER (PARTITION BY o, i, q ORDER BY d, t) AS r FROM c JOIN d USING (q, t)),
        v AS (SELECT k, o, i, q, truth, l, count(*) AS n FROM r, (SELECT unnest([1, 3, 5]) AS k) WHERE r <= k GROUP BY ALL),
        p AS (SELECT k, o, i, q, truth, arg_min(l, -n * 1000 + l) AS said FROM v GROUP BY k, o, i, q, truth)
        SELECT 'k=' || k AS setting, o AS outer_fold, i AS inner_fold, count(*) AS n, CAST(sum(CASE WHEN said = truth THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM p GROUP BY k, o, i""",
    "hyperparam_grid": _GRID,
    "best_setting": f"WITH {_BEST} SELECT model, setting AS best_setting, {_r('score')} AS best_score FROM b",
    "fold_score_summary": f"WITH {_BEST} SELECT model, count(*) AS n_folds, {_r('avg(score)')} AS mean_score, {_r('coalesce(stddev_samp(score), 0)')} AS std_score, {_r('avg(inner_score)')} AS mean_inner_score FROM z GROUP BY model",
    "best_family": f"WITH {_BEST}, y AS (SELECT model, avg(score) AS m, coalesce(stddev_samp(score), 0) AS d FROM z GROUP BY model) SELECT model, {_r('m')} AS mean_score FROM y ORDER BY m DESC, d, model LIMIT 1",
    "kmeans_fixed_iters": f"WITH {_CLUSTERS} SELECT row_id, cluster FROM a2",
    "cluster_purity": f"WITH {_CLUSTERS}, n AS (SELECT cluster, label, count(*) AS n FROM a2 GROUP BY ALL), b AS (SELECT cluster, max(n) AS most, sum(n) AS n FROM n GROUP BY cluster) SELECT count(*) AS n_clusters, {_r('sum(most) / sum(n)')} AS purity FROM b",
    "one_hot": "SELECT vec_id AS row_id, CAST(c AS INTEGER) AS pos, CASE WHEN c = label THEN CAST(1 AS DOUBLE) ELSE 0 END AS value FROM embeddings, (SELECT unnest(generate_series(0, 9)) AS c)",
    "ovr_targets": "SELECT vec_id AS row_id, CAST(c AS INTEGER) AS pos, CASE WHEN c = label THEN CAST(1 AS DOUBLE) ELSE -1 END AS value FROM embeddings, (SELECT unnest(generate_series(0, 9)) AS c)",
    "bias_append": f"WITH {_E} SELECT row_id, CAST(count(*) + 1 AS INTEGER) AS size, CAST(1 AS DOUBLE) AS last, {_r('sum(v) + 1')} AS total FROM e GROUP BY row_id",
    "component_prefix": f"WITH {_E} SELECT row_id, pos, {_r('v')} AS value FROM e WHERE pos < 16",
    "softmax_scores": f"WITH {_NEAREST}, s AS (SELECT row_id, c, -d * d AS s FROM d), z AS (SELECT row_id, max(s) AS top, arg_min(c, -s) AS predicted FROM s GROUP BY row_id) SELECT row_id, CAST(predicted AS INTEGER) AS predicted, {_r('1 / sum(exp(s - top))')} AS confidence FROM s JOIN z USING (row_id) GROUP BY row_id, predicted",
    "ls_normal_equations": "SELECT CAST(label AS INTEGER) AS label, CAST(pos AS INTEGER) AS pos, CAST(0 AS DOUBLE) AS residual FROM (SELECT unnest(generate_series(0, 9)) AS label), (SELECT unnest(generate_series(-1, 63)) AS pos)",
    "pca_decorrelated": "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM (SELECT unnest(generate_series(0, 7)) AS i), (SELECT unnest(generate_series(0, 7)) AS j)",
    "pca_total_variance": f"WITH {_E}, s AS (SELECT pos, var_samp(v) AS v FROM e GROUP BY pos) SELECT {_r('sum(v)')} AS total_variance FROM s",
    "svm_optimality": f"WITH {_K} SELECT CAST(c AS INTEGER) AS label, count(*) AS n, true AS certified, true AS same FROM k, (SELECT unnest(generate_series(0, 9)) AS c) WHERE NOT ({_HELD}) GROUP BY c",
    "submission": """
        WITH p AS (
            SELECT q.vec_id, q.label, arg_min(t.label, CAST(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS DECIMAL(18, 9)) * 1000000 + t.vec_id / 1000000.0) AS said
            FROM embeddings q, embeddings t GROUP BY q.vec_id, q.label
        )
        SELECT 'p' || label || '_i' || vec_id || '.pgm' AS Image_Path, 'person_' || label AS True_Label, 'person_' || said AS Predicted_Label FROM p
    """,
}
