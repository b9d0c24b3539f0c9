"""Similarities, recommendations and scores."""

from pyspark.sql import functions as F

from prefspark import views as V
from prefspark.operators import clustering as K, itembased as I, preferences as P, scoring as R, similarity as S
from prefspark.operators.dispatch import recommend
from prefspark.operators.topics import recommend_topics
from prefspark.operators.topk import top_n
from prefspark.operators.tuning import absolute_error
from prefspark.plans.catalog import query, with_views
from prefspark.plans.session import materialize
from prefspark.sources.sinks import recommendations_json

DIGITS = 6

# -- SQL pieces ---------------------------------------------------------------------------


def pairs_sql(prefs: str, key: str = "") -> str:
    """CTEs n (users), c (raters per item), k (sums per pair) over the preferences `prefs`."""
    on = f"a.{key} = b.{key} AND " if key else ""
    k, ak = (f"{key}, ", f"a.{key}, ") if key else ("", "")
    group = "GROUP BY 1, 2, 3" if key else "GROUP BY 1, 2"
    nu = f"SELECT {k}count(DISTINCT user_id) AS n FROM {prefs}" + (" GROUP BY 1" if key else "")
    return f"""nu AS ({nu}),
c AS (SELECT {k}item_id, count(*) AS c, sum(CAST(preference AS DOUBLE) * CAST(preference AS DOUBLE)) AS norm
  FROM {prefs} GROUP BY {k}item_id),
k AS (SELECT {ak}a.item_id AS i, b.item_id AS j, count(*) AS k11,
  sum(CAST(a.preference AS DOUBLE) * CAST(b.preference AS DOUBLE)) AS sxy,
  sum(CAST(a.preference AS DOUBLE)) AS sx, sum(CAST(b.preference AS DOUBLE)) AS sy,
  sum(CAST(a.preference AS DOUBLE) * CAST(a.preference AS DOUBLE)) AS sxx,
  sum(CAST(b.preference AS DOUBLE) * CAST(b.preference AS DOUBLE)) AS syy
  FROM {prefs} a JOIN {prefs} b ON {on}a.user_id = b.user_id AND a.item_id < b.item_id {group})"""


def _term(k: str, row: str, col: str) -> str:
    return (
        f"CASE WHEN {k} > 0 THEN CAST({k} AS DOUBLE) * ln(CAST({k} AS DOUBLE) * n / "
        f"(CAST({row} AS DOUBLE) * CAST({col} AS DOUBLE))) ELSE 0.0 END"
    )


def loglikelihood_sql(key: str = "") -> str:
    """CTE sim over the CTEs of `pairs_sql`."""
    k = f"k.{key}, " if key else ""
    users = f"JOIN nu ON nu.{key} = k.{key}" if key else "CROSS JOIN nu"
    ci, cj = (
        f"JOIN c {a} ON {a}.item_id = k.{side}" + (f" AND {a}.{key} = k.{key}" if key else "")
        for a, side in (("ci", "i"), ("cj", "j"))
    )
    total = " + ".join(
        [
            _term("k11", "ri", "rj"),
            _term("(ri - k11)", "ri", "(n - rj)"),
            _term("(rj - k11)", "(n - ri)", "rj"),
            _term("(n - ri - rj + k11)", "(n - ri)", "(n - rj)"),
        ]
    )
    out = f"{key}, " if key else ""
    return f"""t AS (SELECT {k}k.i, k.j, k.k11, ci.c AS ri, cj.c AS rj, nu.n FROM k {ci} {cj} {users}),
sim AS (SELECT {out}i AS item_id, j AS similar_item_id,
  round(1.0 - 1.0 / (1.0 + greatest(2.0 * ({total}), 0.0)), 6) AS similarity FROM t)"""


def top_sql(key: str = "", k: int = 25) -> str:
    """CTE top: the k best neighbours of every item."""
    out = f"{key}, " if key else ""
    return f"""both_ways AS (SELECT {out}item_id, similar_item_id, similarity FROM sim
  UNION ALL SELECT {out}similar_item_id, item_id, similarity FROM sim),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {out}item_id
  ORDER BY similarity DESC, similar_item_id) AS INTEGER) AS rank FROM both_ways) t WHERE rank <= {k})"""


def best_sql(key: str, source: str, n: int = 10) -> str:
    return f"""SELECT {key}, rank, item_id, value FROM (SELECT {key}, item_id, value,
CAST(row_number() OVER (PARTITION BY {key} ORDER BY value DESC, item_id) AS INTEGER) AS rank FROM {source}) z
WHERE rank <= {n}"""


MODEL_E = pairs_sql("prefs_e") + ",\n" + loglikelihood_sql() + ",\n" + top_sql()
MODEL_O = pairs_sql("label_prefs", "label") + ",\n" + loglikelihood_sql("label") + ",\n" + top_sql("label")


def label_prefs(spark, d):
    """The training view of all labels, written once: training reads it several times."""
    return materialize(P.preferences_for_label(V.prefs_o(spark, d), V.cands_o(spark, d)), "training-view")


def model_e(spark, d):
    return S.similar_items_model(V.prefs_e(spark, d), 25, digits=DIGITS)


# -- similarities --------------------------------------------------------------------------


@query(
    "pair_cooccurrence",
    with_views(
        "label_prefs",
        f""", {pairs_sql("label_prefs", "label")}
SELECT label, i AS item_id, j AS other_item_id, k11 AS "both" FROM k""",
    ),
)
def pair_cooccurrence(spark, d):
    return S.pair_cooccurrence(label_prefs(spark, d))


@query(
    "pair_cooccurrence_heavy",
    with_views(
        "prefs_e",
        f""", {pairs_sql("prefs_e")}
SELECT i AS item_id, j AS other_item_id, k11 AS "both" FROM k""",
    ),
)
def pair_cooccurrence_heavy(spark, d):
    """Every basket of more than 40 items, most of them here, is cut into chunks."""
    return S.pair_cooccurrence(V.prefs_e(spark, d), chunk_items=40)


@query(
    "item_similarity",
    with_views(
        "label_prefs",
        f""", {pairs_sql("label_prefs", "label")}, {loglikelihood_sql("label")}
SELECT * FROM sim""",
    ),
)
def item_similarity(spark, d):
    return S.item_similarity(label_prefs(spark, d), digits=DIGITS)


_MEASURE_SQL = {
    "tanimoto": "CAST(k11 AS DOUBLE) / (ci.c + cj.c - k11)",
    "cityblock": "1.0 / (1.0 + CAST(ci.c + cj.c - 2 * k11 AS DOUBLE))",
    "cosine": "sxy / sqrt(ci.norm * cj.norm)",
    "euclidean": "1.0 / (1.0 + sqrt(greatest(sxx + syy - 2 * sxy, 0.0)))",
    "pearson": (
        "CASE WHEN k11 * sxx - sx * sx > 0 AND k11 * syy - sy * sy > 0 THEN (k11 * sxy - sx * sy) / "
        "sqrt((k11 * sxx - sx * sx) * (k11 * syy - sy * sy)) END"
    ),
}


def _register_measure(measure: str) -> None:
    # Order quantities are whole numbers, so every sum is exact in either engine.
    @query(
        f"item_similarity_{measure}",
        with_views(
            "label_prefs",
            f""", {pairs_sql("label_prefs", "label")}
SELECT * FROM (SELECT k.label, i AS item_id, j AS similar_item_id, round({_MEASURE_SQL[measure]}, 6) AS similarity
FROM k JOIN c ci ON ci.item_id = i AND ci.label = k.label JOIN c cj ON cj.item_id = j AND cj.label = k.label) s
WHERE similarity IS NOT NULL""",
        ),
    )
    def run(spark, d):
        return S.item_similarity(label_prefs(spark, d), measure, digits=DIGITS)


for _name in _MEASURE_SQL:
    _register_measure(_name)


@query(
    "similar_items_model",
    with_views(
        "label_prefs",
        f""", {MODEL_O}
SELECT label, item_id, similar_item_id, similarity, rank FROM top""",
    ),
)
def similar_items_model(spark, d):
    return S.similar_items_model(label_prefs(spark, d), 25, digits=DIGITS)


@query(
    "top_similar_items",
    with_views(
        "prefs_e",
        f""", {pairs_sql("prefs_e")}, {loglikelihood_sql()}, {top_sql(k=5)}
SELECT item_id, similar_item_id, similarity, rank FROM top""",
    ),
)
def top_similar_items(spark, d):
    sims = S.item_similarity(V.prefs_e(spark, d), digits=DIGITS)
    return S.top_similar_items(S.both_directions(sims), 5)


@query(
    "top_n",
    with_views(
        "prefs_e", ", s AS (SELECT user_id, item_id, preference AS value FROM prefs_e)\n" + best_sql("user_id", "s")
    ),
)
def best_rated(spark, d):
    return top_n(V.prefs_e(spark, d).withColumnRenamed("preference", "value"), "user_id", 10)


@query(
    "recommendations_json",
    with_views(
        "prefs_e",
        """, s AS (SELECT user_id, item_id, preference AS value, row_number() OVER (PARTITION BY user_id
ORDER BY preference DESC, item_id) AS r FROM prefs_e)
SELECT user_id AS request_id, '[' || string_agg('{"itemID":' || item_id || ',"value":' || value || '}', ',' ORDER BY r)
|| ']' AS recommendations FROM s WHERE r <= 10 GROUP BY 1""",
    ),
)
def as_json(spark, d):
    return recommendations_json(best_rated(spark, d).withColumnRenamed("user_id", "request_id"))


# -- item-based -------------------------------------------------------------------------------


@query(
    "similar_candidates",
    with_views(
        "label_prefs",
        f""", {MODEL_O}
SELECT DISTINCT p.label, p.user_id, t.similar_item_id AS item_id FROM label_prefs p JOIN top t
ON t.label = p.label AND t.item_id = p.item_id WHERE NOT EXISTS (SELECT 1 FROM label_prefs o WHERE o.label = p.label
AND o.user_id = p.user_id AND o.item_id = t.similar_item_id)""",
    ),
)
def similar_candidates(spark, d):
    # Written once: the model and the users' lists read it.
    prefs = materialize(label_prefs(spark, d), "label-prefs")
    return I.similar_candidates(None, prefs, S.similar_items_model(prefs, 25, digits=DIGITS))


@query(
    "recommend_itembased",
    with_views(
        "label_prefs",
        f""", {MODEL_O},
est AS (SELECT p.label, p.user_id, t.similar_item_id AS item_id,
  round(sum(t.similarity * CAST(p.preference AS DOUBLE)) / nullif(sum(t.similarity), 0.0), 6) AS value
  FROM label_prefs p JOIN top t ON t.label = p.label AND t.item_id = p.item_id GROUP BY 1, 2, 3),
unseen AS (SELECT e.* FROM est e LEFT JOIN label_prefs p ON p.label = e.label AND p.user_id = e.user_id
  AND p.item_id = e.item_id WHERE p.user_id IS NULL AND e.value IS NOT NULL)
{best_sql("label, user_id", "unseen")}""",
    ),
)
def recommend_itembased(spark, d):
    prefs = materialize(label_prefs(spark, d), "label-prefs")
    sims = S.similar_items_model(prefs, 25, digits=DIGITS)
    return I.recommend_itembased(None, prefs, sims, V.cands_o(spark, d), 10, digits=DIGITS)


@query(
    "label_restricted",
    with_views(
        "prefs_e",
        f""", {MODEL_E}
SELECT item_id, similar_item_id, similarity, rank FROM top WHERE similar_item_id IN
(SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""",
    ),
)
def label_restricted(spark, d):
    return I.label_restricted(model_e(spark, d), V.cands_o(spark, d), "ECONOMY", item="similar_item_id")


def baskets_by_type(spark, d):
    """What a user touched with one type of event, as an anonymous item list."""
    return (
        V.pref_events(spark, d)
        .select(F.concat_ws(":", "user_id", "label").alias("request_id"), "label", "item_id")
        .distinct()
    )


@query(
    "recommend_items_for_items",
    with_views(
        "prefs_e cands_e",
        f""", {MODEL_E},
given AS (SELECT DISTINCT user_id || ':' || label AS request_id, label, item_id FROM pref_events),
scored AS (SELECT g.request_id, g.label, t.similar_item_id AS item_id, round(avg(t.similarity), 10) AS value
  FROM given g JOIN top t USING (item_id)
  JOIN cands_e c ON c.label = g.label AND c.item_id = t.similar_item_id
  WHERE NOT EXISTS (SELECT 1 FROM given o WHERE o.request_id = g.request_id AND o.item_id = t.similar_item_id)
  GROUP BY 1, 2, 3)
{best_sql("request_id, label", "scored")}""",
    ),
)
def recommend_items_for_items(spark, d):
    return I.recommend_items_for_items(
        baskets_by_type(spark, d), model_e(spark, d), V.cands_e(spark, d), 10, digits=10
    )


# -- vectors ------------------------------------------------------------------------------------


@query(
    "unseen_items",
    with_views(
        "prefs_e cands_e",
        """SELECT c.label, u.user_id, c.item_id FROM (SELECT DISTINCT user_id, label FROM pref_events) u JOIN cands_e c ON c.label = u.label
WHERE c.item_id IN (SELECT item_id FROM prefs_e) AND NOT EXISTS
(SELECT 1 FROM prefs_e p WHERE p.user_id = u.user_id AND p.item_id = c.item_id)""",
    ),
)
def unseen_items(spark, d):
    users = V.pref_events(spark, d).select("user_id", "label")
    return R.unseen_items(users, V.prefs_e(spark, d), V.cands_e(spark, d))


_DOT = "list_dot_product(u.features, v.features)"


@query(
    "score_pairs",
    with_views(
        "prefs_o factors",
        f"""SELECT p.user_id, p.item_id, p.preference, round({_DOT}, 6) AS value FROM prefs_o p
JOIN factors u ON u.id = p.user_id JOIN factors v ON v.id = p.item_id""",
    ),
)
def score_pairs(spark, d):
    f = V.factors(spark, d)
    return R.score_pairs(V.prefs_o(spark, d), f, f).withColumn("value", F.round("value", DIGITS))


@query(
    "estimate_preference",
    with_views(
        "prefs_e factors",
        f"""SELECT p.user_id, p.item_id, round(CAST(CAST({_DOT} AS FLOAT) AS DOUBLE), 6) AS value FROM prefs_e p
JOIN factors u ON u.id = p.user_id JOIN factors v ON v.id = p.item_id""",
    ),
)
def estimate_preference(spark, d):
    f = V.factors(spark, d)
    pairs = V.prefs_e(spark, d)
    return R.estimate_preference(pairs, f, f).withColumn("value", F.round(F.col("value").cast("double"), DIGITS))


def _mf_sql(seen: str, value: str = _DOT) -> str:
    return with_views(
        "prefs_o cands_o factors pref_events",
        f""", asked AS (SELECT o_custkey AS user_id, label FROM (SELECT DISTINCT o_custkey FROM orders) o,
  (SELECT DISTINCT label FROM cands_o) l),
scored AS (SELECT a.label, a.user_id, c.item_id, round({value}, 6) AS value FROM asked a
  JOIN factors u ON u.id = a.user_id JOIN cands_o c ON c.label = a.label JOIN factors v ON v.id = c.item_id
  WHERE c.item_id IN (SELECT item_id FROM prefs_o) AND NOT EXISTS
  (SELECT 1 FROM {seen} s WHERE s.user_id = a.user_id AND s.item_id = c.item_id))
{best_sql("label, user_id", "scored")}""",
    )


def _mf(spark, d, seen=None, items=None, **options):
    f, cands = V.factors(spark, d), V.cands_o(spark, d)
    labels = cands.select("label").distinct()
    every = F.collect_set("label").alias("labels")
    # Each customer asks for every label.
    users = V.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    asked = users.withColumn("labels", labels.agg(every).scalar()).select(
        "user_id", F.explode("labels").alias("label")
    )
    return R.recommend_mf(
        asked, V.prefs_o(spark, d), f, f if items is None else items, cands, 10, seen=seen, digits=DIGITS, **options
    )


@query("recommend_mf", _mf_sql("prefs_o"))
def recommend_mf(spark, d):
    return _mf(spark, d)


@query("recommend_mf_given", _mf_sql("pref_events"))
def recommend_mf_given(spark, d):
    return _mf(spark, d, seen=V.pref_events(spark, d))


@query("recommend_mf_bounded", _mf_sql("prefs_o", f"{_DOT} / (1 + c.item_id % 8)"))
def recommend_mf_bounded(spark, d):
    """Item vectors of eight lengths; bands that cannot reach a request's list are not scored."""
    length = 1 + F.col("id") % 8
    items = V.factors(spark, d).withColumn("features", F.transform("features", lambda x: x / length))
    return _mf(spark, d, items=items, bounds=True, head_candidates=64)


@query("recommend_mf_rescored", _mf_sql("prefs_o", f"{_DOT} / (1 + c.item_id % 2)"))
def recommend_mf_rescored(spark, d):
    """Parts with odd numbers count half."""
    return _mf(spark, d, rescore=lambda item, value: value / (1 + item % 2))


_FOLD_SQL = """, given AS (SELECT DISTINCT user_id || ':' || label AS request_id, label, item_id FROM label_prefs),
parts AS (SELECT g.request_id, generate_subscripts(f.features, 1) AS dim, unnest(f.features) AS x
  FROM given g JOIN factors f ON f.id = g.item_id),
sums AS (SELECT request_id, dim, sum(x) AS s FROM parts GROUP BY 1, 2),
folded AS (SELECT request_id, dim, s / sum(abs(s)) OVER (PARTITION BY request_id) AS x FROM sums)"""


def label_baskets(spark, d):
    """A customer's parts of one type as an anonymous item list."""
    prefs = label_prefs(spark, d)
    return prefs.select(F.concat_ws(":", "user_id", "label").alias("request_id"), "label", "item_id").distinct()


@query(
    "fold_in_anonymous",
    with_views(
        "label_prefs factors",
        f"{_FOLD_SQL}\nSELECT request_id, dim, round(x, 6) AS x FROM folded",
    ),
)
def fold_in_anonymous(spark, d):
    folded = R.fold_in_anonymous(label_baskets(spark, d), V.factors(spark, d))
    return folded.select("request_id", F.posexplode("features").alias("dim", "x")).select(
        "request_id", (F.col("dim") + 1).cast("long").alias("dim"), F.round("x", DIGITS).alias("x")
    )


@query(
    "recommend_anonymous_mf",
    with_views(
        "label_prefs factors",
        f"""{_FOLD_SQL},
vectors AS (SELECT request_id, list(x ORDER BY dim) AS features FROM folded GROUP BY 1),
scored AS (SELECT r.label, r.request_id, c.item_id, round({_DOT}, 6) AS value
  FROM (SELECT DISTINCT request_id, label FROM given) r JOIN vectors u ON u.request_id = r.request_id
  JOIN cands_o c ON c.label = r.label JOIN factors v ON v.id = c.item_id
  WHERE c.item_id IN (SELECT item_id FROM prefs_o) AND NOT EXISTS
  (SELECT 1 FROM given g WHERE g.request_id = r.request_id AND g.item_id = c.item_id))
{best_sql("label, request_id", "scored")}""",
    ),
)
def recommend_anonymous_mf(spark, d):
    return R.recommend_anonymous_mf(
        label_baskets(spark, d), V.factors(spark, d), V.prefs_o(spark, d), V.cands_o(spark, d), 10, digits=DIGITS
    )


@query("fold_in_least_squares")
def fold_in_least_squares(spark, d):
    folded = R.fold_in_least_squares(label_baskets(spark, d), V.factors(spark, d))
    return folded.select("request_id", F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", DIGITS))


@query(
    "absolute_error",
    with_views(
        "prefs_o factors",
        f"""SELECT round(coalesce(sum(e), 0.0), 4) AS error, count(*) AS pairs, round(avg(e), 4) AS mean_error FROM
(SELECT abs({_DOT} - CAST(p.preference AS DOUBLE)) AS e FROM prefs_o p
JOIN factors u ON u.id = p.user_id JOIN factors v ON v.id = p.item_id) t""",
    ),
)
def error(spark, d):
    f = V.factors(spark, d)
    return absolute_error(V.prefs_o(spark, d), f, f, digits=4)


@query(
    "recommend_topics",
    with_views(
        "cands_o factors",
        f""", scored AS (SELECT s.label, s.item_id AS request_id, c.item_id,
  coalesce(round({_DOT}, 6), 0.0) AS value FROM cands_o s JOIN factors u ON u.id = s.item_id
  JOIN cands_o c ON c.label = s.label AND c.item_id <> s.item_id LEFT JOIN factors v ON v.id = c.item_id)
{best_sql("label, request_id", "scored")}""",
    ),
)
def topics(spark, d):
    cands = V.cands_o(spark, d)
    seeds = cands.select(F.col("item_id").alias("request_id"), "label", F.lit(0).alias("position"), "item_id")
    vectors = V.factors(spark, d).select(F.col("id").alias("item_id"), F.col("features").alias("topics"))
    return recommend_topics(seeds, vectors, cands, 10, digits=DIGITS)


# -- clusters ------------------------------------------------------------------------------------

# Centroids by hand: the mean vector of each part type's items.
_CLUSTER_SQL = """, heavy AS (SELECT user_id FROM prefs_o GROUP BY 1 HAVING count(*) > 40),
vec AS (SELECT DISTINCT item_id, user_id AS dim, 1.0::DOUBLE AS value FROM prefs_o WHERE user_id IN (SELECT * FROM heavy)),
ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS centroid_id FROM (SELECT DISTINCT label FROM cands_o) t),
member AS (SELECT v.item_id, i.centroid_id FROM (SELECT DISTINCT item_id FROM vec) v JOIN cands_o USING (item_id)
  JOIN ids i USING (label)),
cw AS (SELECT centroid_id, CAST(count(*) AS DOUBLE) AS weight FROM member GROUP BY 1),
cen AS (SELECT m.centroid_id, w.weight, v.dim, sum(v.value) / w.weight AS value FROM vec v JOIN member m USING (item_id)
  JOIN cw w USING (centroid_id) GROUP BY 1, 2, 3),
gain AS (SELECT v.item_id, c.centroid_id, sum(abs(v.value - c.value) - abs(c.value)) AS gain FROM vec v
  JOIN cen c USING (dim) GROUP BY 1, 2),
lone AS (SELECT v.item_id, a.centroid_id, sum(v.value) AS lone FROM vec v CROSS JOIN (SELECT centroid_id FROM cw) a
  WHERE NOT EXISTS (SELECT 1 FROM cen c WHERE c.centroid_id = a.centroid_id AND c.dim = v.dim) GROUP BY 1, 2),
dist AS (SELECT i.item_id, n.centroid_id, round(n.norm + coalesce(g.gain, 0.0) + coalesce(l.lone, 0.0), 9) AS distance
  FROM (SELECT DISTINCT item_id FROM vec) i CROSS JOIN (SELECT centroid_id, sum(abs(value)) AS norm FROM cen GROUP BY 1) n
  LEFT JOIN gain g ON g.item_id = i.item_id AND g.centroid_id = n.centroid_id
  LEFT JOIN lone l ON l.item_id = i.item_id AND l.centroid_id = n.centroid_id),
near AS (SELECT item_id, centroid_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY item_id
  ORDER BY distance, centroid_id) AS r FROM dist) t WHERE r = 1),
stats AS (SELECT centroid_id, max(weight) AS weight, sqrt(sum(value * value)) AS l2_norm,
  count(*) FILTER (WHERE value <> 0) AS non_zero FROM cen GROUP BY 1)"""


def type_centroids(spark, d):
    prefs, cands = V.prefs_o(spark, d), V.cands_o(spark, d)
    vectors = K.item_user_vectors(prefs, 40)
    names = cands.agg(F.array_sort(F.collect_set("label"))).scalar()
    members = (
        cands.join(vectors.select("item_id").distinct(), "item_id", "left_semi")
        .withColumn("names", names)
        .select("item_id", (F.array_position("names", F.col("label")) - 1).alias("centroid_id"))
    )
    return vectors, K.centroids_of(vectors, members)


@query(
    "item_user_vectors",
    with_views(
        "prefs_o",
        """SELECT DISTINCT item_id, user_id AS dim, 1.0::DOUBLE AS value FROM prefs_o WHERE user_id IN
(SELECT user_id FROM prefs_o GROUP BY 1 HAVING count(*) > 40)""",
    ),
)
def item_user_vectors(spark, d):
    return K.item_user_vectors(V.prefs_o(spark, d), 40)


@query(
    "new_item_vectors",
    with_views(
        "prefs_o cands_o",
        """SELECT DISTINCT item_id, user_id AS dim, 1.0::DOUBLE AS value FROM prefs_o WHERE user_id IN
(SELECT user_id FROM prefs_o GROUP BY 1 HAVING count(*) > 40)
AND item_id NOT IN (SELECT item_id FROM cands_o WHERE label <> 'PROMO')""",
    ),
)
def new_item_vectors(spark, d):
    prefs = V.prefs_o(spark, d)
    known = V.cands_o(spark, d).where("label <> 'PROMO'")
    return K.new_item_vectors(prefs, P.heavy_users(prefs, 40), known)


@query(
    "cluster_stats",
    with_views(
        "prefs_o cands_o",
        f"""{_CLUSTER_SQL}, v AS (SELECT *, max(weight) OVER () AS max_weight FROM stats)
SELECT centroid_id, weight, round(l2_norm, 6) AS l2_norm, non_zero, max_weight,
round(weight / max_weight, 6) AS norm_weight, round(weight / max_weight * non_zero, 6) AS volume,
round(avg(weight / max_weight * non_zero) OVER (), 6) AS mean_volume FROM v""",
    ),
)
def cluster_stats(spark, d):
    return K.cluster_stats(type_centroids(spark, d)[1], digits=DIGITS)


@query(
    "nearest_centroid",
    with_views("prefs_o cands_o", f"{_CLUSTER_SQL}\nSELECT item_id, centroid_id, round(distance, 6) AS distance FROM near"),
)
def nearest_centroid(spark, d):
    vectors, centroids = type_centroids(spark, d)
    return K.nearest_centroid(vectors, centroids).withColumn("distance", F.round("distance", DIGITS))


@query(
    "recommend_cluster_weight",
    with_views(
        "prefs_o cands_o",
        f"""{_CLUSTER_SQL}
SELECT p_partkey AS item_id, round(s.weight / (SELECT max(weight) FROM stats), 6) AS value
FROM part JOIN near ON near.item_id = p_partkey JOIN stats s ON s.centroid_id = near.centroid_id""",
    ),
)
def recommend_cluster_weight(spark, d):
    vectors, centroids = type_centroids(spark, d)
    items = V.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    return K.recommend_cluster_weight(items, vectors, centroids, digits=DIGITS)


# -- requests of mixed kinds -------------------------------------------------------------------------


@query(
    "recommend_dispatch",
    with_views(
        "prefs_o cands_o factors",
        f""", req AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS user_id,
  o_orderstatus, list(DISTINCT l_partkey) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
given AS (SELECT DISTINCT request_id, user_id, unnest(items) AS item_id FROM req WHERE o_orderstatus <> 'O'),
history AS (SELECT r.request_id, p.item_id FROM req r JOIN prefs_o p ON p.user_id = r.user_id WHERE o_orderstatus = 'O'
  UNION SELECT request_id, item_id FROM given),
parts AS (SELECT g.request_id, generate_subscripts(f.features, 1) AS dim, unnest(f.features) AS x
  FROM given g JOIN factors f ON f.id = g.item_id WHERE g.user_id IS NULL),
sums AS (SELECT request_id, dim, sum(x) AS s FROM parts GROUP BY 1, 2),
folded AS (SELECT request_id, dim, s / sum(abs(s)) OVER (PARTITION BY request_id) AS x FROM sums),
vectors AS (SELECT request_id, list(x ORDER BY dim) AS features FROM folded GROUP BY 1
  UNION ALL SELECT r.request_id, f.features FROM req r JOIN factors f ON f.id = r.user_id),
scored AS (SELECT u.request_id, c.item_id, round({_DOT}, 6) AS value FROM vectors u
  JOIN cands_o c ON c.label = 'PROMO' JOIN factors v ON v.id = c.item_id
  WHERE c.item_id IN (SELECT item_id FROM prefs_o) AND NOT EXISTS
  (SELECT 1 FROM history h WHERE h.request_id = u.request_id AND h.item_id = c.item_id))
{best_sql("request_id", "scored", 5)}""",
    ),
)
def recommend_dispatch(spark, d):
    """Every order is a request: open orders by customer, pending ones by customer and parts,
    fulfilled ones by their parts alone."""
    orders = V.table(spark, d, "orders")
    items = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set("l_partkey").alias("items")
    )
    requests = orders.join(items, "o_orderkey").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("user_id"),
        F.when(F.col("o_orderstatus") != "O", F.col("items")).alias("item_ids"),
        F.lit("PROMO").alias("label"),
        F.lit(5).alias("how_many"),
    )
    f = V.factors(spark, d)
    return recommend(
        "factorization",
        requests,
        V.cands_o(spark, d),
        prefs=V.prefs_o(spark, d),
        user_factors=f,
        item_factors=f,
        digits=DIGITS,
    ).drop("error")


@query(
    "recommend_dispatch_itembased",
    with_views(
        "prefs_e cands_e",
        f""", {MODEL_E},
est AS (SELECT p.user_id AS request_id, t.similar_item_id AS item_id,
  round(sum(t.similarity * CAST(p.preference AS DOUBLE)) / nullif(sum(t.similarity), 0.0), 10) AS value FROM prefs_e p
  JOIN top t ON t.item_id = p.item_id JOIN cands_e c ON c.label = 'purchase' AND c.item_id = t.similar_item_id
  WHERE p.user_id % 3 = 0 GROUP BY 1, 2),
by_user AS (SELECT * FROM est e WHERE value IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM prefs_e p WHERE p.user_id = e.request_id AND p.item_id = e.item_id)),
given AS (SELECT DISTINCT user_id AS request_id, item_id, CASE WHEN user_id % 3 = 1 THEN 'click' ELSE 'view' END AS label
  FROM pref_events WHERE user_id % 3 <> 0),
by_items AS (SELECT g.request_id, t.similar_item_id AS item_id, round(avg(t.similarity), 10) AS value FROM given g
  JOIN top t USING (item_id) JOIN cands_e c ON c.label = g.label AND c.item_id = t.similar_item_id
  WHERE NOT EXISTS (SELECT 1 FROM given o WHERE o.request_id = g.request_id AND o.item_id = t.similar_item_id) GROUP BY 1, 2),
scored AS (SELECT * FROM by_user UNION ALL SELECT * FROM by_items)
SELECT request_id, rank, item_id, CAST(value AS FLOAT) AS value FROM ({best_sql("request_id", "scored", 5)}) t""",
    ),
)
def recommend_dispatch_itembased(spark, d):
    """Some users ask by their history, all for purchases; others by their items, for labels no user asks."""
    asked = (
        V.pref_events(spark, d)
        .groupBy("user_id")
        .agg(F.collect_set("item_id").alias("items"))
        .select(
            F.col("user_id").alias("request_id"),
            F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("user_id"),
            F.when(F.col("user_id") % 3 != 0, F.col("items")).alias("item_ids"),
            F.when(F.col("user_id") % 3 == 0, "purchase").when(F.col("user_id") % 3 == 1, "click").otherwise("view").alias("label"),
            F.lit(5).alias("how_many"),
        )
    )
    return recommend(
        "itembased", asked, V.cands_e(spark, d), prefs=V.prefs_e(spark, d), sims=model_e(spark, d), digits=10
    ).select("request_id", "rank", "item_id", F.col("value").cast("float").alias("value"))


_ORDER_ITEMS = """, req AS (SELECT l_orderkey AS request_id, list_sort(list(DISTINCT l_partkey)) AS items,
  CASE WHEN l_orderkey % 2 = 0 THEN 'PROMO' ELSE 'ECONOMY' END AS label FROM lineitem GROUP BY 1),
given AS (SELECT request_id, label, unnest(items) AS item_id, generate_subscripts(items, 1) AS rank FROM req)"""


def order_requests(spark, d):
    """Every order's parts as an item request; even orders ask for one label, odd ones for another."""
    return (
        V.table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("request_id"))
        .agg(F.array_sort(F.collect_set("l_partkey")).alias("item_ids"))
        .select(
            "request_id",
            F.lit(None).cast("long").alias("user_id"),
            "item_ids",
            F.when(F.col("request_id") % 2 == 0, "PROMO").otherwise("ECONOMY").alias("label"),
            F.lit(5).alias("how_many"),
        )
    )


@query(
    "recommend_dispatch_topics",
    with_views(
        "cands_o factors",
        f"""{_ORDER_ITEMS},
scored AS (SELECT g.request_id, c.item_id, coalesce(round({_DOT}, 6), 0.0) AS value FROM given g
  JOIN factors u ON u.id = g.item_id JOIN cands_o c ON c.label = g.label LEFT JOIN factors v ON v.id = c.item_id
  WHERE g.rank = 1 AND NOT EXISTS (SELECT 1 FROM given o WHERE o.request_id = g.request_id AND o.item_id = c.item_id))
{best_sql("request_id", "scored", 5)}""",
    ),
)
def recommend_dispatch_topics(spark, d):
    """By the topics of an order's first part; most parts have none and score 0."""
    topics = V.factors(spark, d).select(F.col("id").alias("item_id"), F.col("features").alias("topics"))
    return recommend("lda", order_requests(spark, d), V.cands_o(spark, d), topics=topics, digits=DIGITS).drop("error")


@query(
    "recommend_dispatch_clusters",
    with_views(
        "prefs_o cands_o",
        f"""{_CLUSTER_SQL}{_ORDER_ITEMS},
answers AS (SELECT g.request_id, CAST(g.rank AS INTEGER) AS rank, g.item_id,
  round(s.weight / (SELECT max(weight) FROM stats), 6) AS value, CAST(NULL AS VARCHAR) AS error
  FROM given g JOIN near USING (item_id) JOIN stats s USING (centroid_id))
SELECT * FROM answers UNION ALL
SELECT request_id, NULL, NULL, NULL, 'no item is known' FROM req WHERE request_id NOT IN (SELECT request_id FROM answers)""",
    ),
)
def recommend_dispatch_clusters(spark, d):
    """An order none of whose parts was rated by a heavy user has an error row."""
    vectors, centroids = type_centroids(spark, d)
    got = recommend("clusters", order_requests(spark, d), V.cands_o(spark, d), vectors=vectors, centroids=centroids)
    return got.withColumns({"rank": F.col("rank").cast("int"), "value": F.round("value", DIGITS)})
