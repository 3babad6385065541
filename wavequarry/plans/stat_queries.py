"""Statistics, model selection by SQL, packets, profiles and narration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import packets as P
from ..operators import stats as ST
from ..sources.tables import ENGAGED, epoch_samples, samples, table
from .registry import query
from .signal_queries import C, E, _sides
from .window_queries import S

U = "u AS (SELECT user_id, avg(CASE WHEN event_type IN ('click', 'purchase') THEN value END) - avg(CASE WHEN event_type NOT IN ('click', 'purchase') THEN value END) AS d FROM events GROUP BY 1), v AS (SELECT user_id, round(d, 4) AS d, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM u WHERE d IS NOT NULL)"
#: Draw b at position i, and a row's scattered number.
DRAW = "CAST('0x' || substr(md5((b // 4) || '-' || i), 1 + 8 * (b % 4), 8) AS BIGINT)"
PICK = f"(({DRAW} * n) >> 32)"


def scattered_sql(number: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({number} AS VARCHAR)), 1, 8) AS BIGINT)"



def _differences(spark, sf_dir):
    """user_id, d: mean of engaged samples less mean of the others, rounded; one row per recording that has both."""
    engaged = F.col("event_type").isin(*ENGAGED)
    d = A.rounded_difference(F.when(engaged, F.col("value")), F.when(~engaged, F.col("value")), 4)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(d.alias("d")).where("d is not null")


@query(
    "bootstrap_mean_ci",
    f"""WITH {U}, b AS (SELECT unnest(range(0, 10000)) AS b), p AS (SELECT b, {PICK} AS pick FROM v, b), m AS (SELECT p.b, avg(v.d) AS m FROM p JOIN v ON v.i = p.pick GROUP BY 1)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""",
)
def bootstrap_mean_ci(spark, sf_dir):
    means = ST.bootstrap_means(ST.numbered(_differences(spark, sf_dir), ["user_id"]), "d", 10_000)
    p = lambda q: F.round(F.percentile("mean", F.lit(q)), 6)
    return means.agg(F.round(F.avg("mean"), 6).alias("mean"), p(0.025).alias("lo"), p(0.975).alias("hi"))


@query(
    "sign_flip_perm",
    f"""WITH {U}, b AS (SELECT unnest(range(0, 10000)) AS b), m AS (SELECT b, avg(d * CASE WHEN {DRAW} >= 2147483648 THEN 1.0 ELSE -1.0 END) AS m FROM v, b GROUP BY 1), o AS (SELECT avg(d) AS o FROM v)
SELECT round(any_value(o), 6) AS observed, round(avg(CASE WHEN abs(m) >= abs(o) THEN 1.0 ELSE 0.0 END), 6) AS p FROM m, o""",
)
def sign_flip_perm(spark, sf_dir):
    rows = ST.numbered(_differences(spark, sf_dir), ["user_id"])
    observed = rows.agg(A.ordered_mean(F.col("d")).alias("o"))
    means = ST.sign_flip_means(rows, "d", 10_000).crossJoin(F.broadcast(observed))
    return means.agg(F.round(F.first("o"), 6).alias("observed"), F.round(F.avg((F.abs("mean") >= F.abs("o")).cast("double")), 6).alias("p"))


@query(
    "wilcoxon_signed",
    f"""WITH {U}, z AS (SELECT d, abs(d) AS a FROM v WHERE d <> 0), r AS (SELECT d, avg(k) OVER (PARTITION BY a) AS r, count(*) OVER (PARTITION BY a) AS t FROM (SELECT d, a, row_number() OVER (ORDER BY a) AS k FROM z)),
x AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS m, sum(t * t - 1) AS tied FROM r)
SELECT n, least(p, m) AS w, round((least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48), 6) AS z FROM x""",
)
def wilcoxon_signed(spark, sf_dir):
    return ST.wilcoxon(_differences(spark, sf_dir), "d").withColumn("z", F.round("z", 6))


@query(
    "mann_whitney",
    """WITH v AS (SELECT value, event_type = 'purchase' AS a FROM events WHERE event_type IN ('purchase', 'signup')), r AS (SELECT a, avg(k) OVER (PARTITION BY value) AS r, count(*) OVER (PARTITION BY value) AS t FROM (SELECT value, a, row_number() OVER (ORDER BY value) AS k FROM v)),
x AS (SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(CASE WHEN a THEN r END) AS r, sum(t * t - 1) AS tied FROM r)
SELECT n_a, n_b, r - n_a * (n_a + 1) / 2 AS u, round((r - n_a * (n_a + 1) / 2 - n_a * n_b / 2) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - tied / ((n_a + n_b) * (n_a + n_b - 1)))), 5) AS z FROM x""",
)
def mann_whitney(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    return ST.mann_whitney(rows, "value", F.col("event_type") == "purchase").withColumn("z", F.round("z", 5))


@query(
    "binom_sign",
    f"""WITH {U}, c AS (SELECT count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(*) FILTER (d = 0) AS ties FROM v), x AS (SELECT *, unnest(range(up, up + down + 1)) AS x FROM c)
SELECT up, down, ties, round(sum(exp(lgamma(up + down + 1) - lgamma(x + 1) - lgamma(up + down - x + 1) - (up + down) * ln(2))), 6) AS p FROM x GROUP BY 1, 2, 3""",
)
def binom_sign(spark, sf_dir):
    """Signs of the differences and the one-sided probability of as many positive ones."""
    d = F.col("d")
    counts = _differences(spark, sf_dir).agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("ties")).withColumn("n", F.col("up") + F.col("down"))
    return counts.join(ST.binomial_tail(counts.select("up", "n"), "up", "n"), ["up", "n"]).select("up", "down", "ties", F.round("p", 6).alias("p"))


@query(
    "cohens_d",
    "SELECT user_id % 10 AS grp, round((avg(CASE WHEN event_type = 'purchase' THEN value END) - avg(CASE WHEN event_type = 'view' THEN value END)) / sqrt((var_pop(CASE WHEN event_type = 'purchase' THEN value END) + var_pop(CASE WHEN event_type = 'view' THEN value END)) / 2), 5) AS d FROM events GROUP BY 1",
)
def cohens_d(spark, sf_dir):
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("grp")).agg(F.round(A.cohens_d(of("purchase"), of("view")), 5).alias("d"))


@query(
    "generalisation_penalty",
    """WITH s AS (SELECT user_id, avg(CASE WHEN event_type <> 'purchase' THEN value END) AS rest, stddev_pop(CASE WHEN event_type <> 'purchase' THEN value END) AS sd, avg(CASE WHEN event_type = 'purchase' THEN value END) AS task FROM events GROUP BY 1),
o AS (SELECT * FROM s WHERE sd > 1e-6 AND task IS NOT NULL), r AS (SELECT rest AS r0, sd AS s0 FROM o ORDER BY user_id LIMIT 1)
SELECT user_id, round((task - rest) / sd, 5) AS z_own, round((task - r0) / s0, 5) AS z_reference, round(abs((task - rest) / sd - (task - r0) / s0), 5) AS penalty FROM o, r""",
)
def generalisation_penalty(spark, sf_dir):
    """Scores by a recording's own rest against those by the first recording's."""
    task, v = F.col("event_type") == "purchase", F.col("value")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(~task, v)).alias("rest"), F.stddev_pop(F.when(~task, v)).alias("sd"), F.avg(F.when(task, v)).alias("task"))
    s = s.where("sd > 1e-6 and task is not null")
    reference = s.agg(F.min_by(F.struct("rest", "sd"), "user_id").alias("r")).select(F.col("r.rest").alias("r0"), F.col("r.sd").alias("s0"))
    own, other = (F.col("task") - F.col("rest")) / F.col("sd"), (F.col("task") - F.col("r0")) / F.col("s0")
    return s.crossJoin(F.broadcast(reference)).select("user_id", F.round(own, 5).alias("z_own"), F.round(other, 5).alias("z_reference"), F.round(F.abs(own - other), 5).alias("penalty"))


@query(
    "swelling_sweep",
    f"""WITH {C}, p AS (SELECT vec_id, max(CASE WHEN i = 0 AND j = 0 THEN c END) * 16 / 15 + 1e-6 AS a, max(CASE WHEN i = 0 AND j = 2 THEN c END) * 16 / 15 AS b, max(CASE WHEN i = 2 AND j = 2 THEN c END) * 16 / 15 + 1e-6 AS d FROM c GROUP BY 1),
g AS (SELECT unnest([2, 4, 8]) AS parts), k AS (SELECT parts, seed FROM g, (SELECT unnest(range(0, 8)) AS seed) WHERE seed < parts),
r AS (SELECT parts, seed, (avg(a) * avg(d) - avg(b) * avg(b)) / exp(avg(ln(a * d - b * b))) AS ratio FROM k JOIN p ON p.vec_id % k.parts = k.seed GROUP BY 1, 2)
SELECT CAST(parts AS BIGINT) AS parts, round(avg(ratio), 5) AS mean_ratio, round(stddev_pop(ratio), 5) AS std_ratio, round(CASE WHEN avg(ratio) <> 0 THEN stddev_pop(ratio) / avg(ratio) ELSE 0 END, 5) AS cv, round(min(ratio), 5) AS min_ratio, round(max(ratio), 5) AS max_ratio, count(*) AS n_seeds FROM r GROUP BY 1""",
)
def swelling_sweep(spark, sf_dir):
    """Determinant of the arithmetic mean over that of the geometric mean, per part of the epochs, then per number of parts.

    For any matrices the geometric mean's determinant is the geometric mean of
    the determinants, so no mean matrix is needed.
    """
    rows, (a, b, d), _ = _sides(spark, sf_dir)
    rows = rows.select("vec_id", a.alias("a"), b.alias("b"), d.alias("d")).withColumn("parts", F.explode(F.array(*map(F.lit, (2, 4, 8))))).withColumn("seed", F.col("vec_id") % F.col("parts"))
    euclid = F.avg("a") * F.avg("d") - F.avg("b") * F.avg("b")
    r = rows.groupBy("parts", "seed").agg((euclid / F.exp(F.avg(F.log(F.col("a") * F.col("d") - F.col("b") * F.col("b"))))).alias("ratio"))
    x = F.col("ratio")
    out = {"mean_ratio": F.avg(x), "std_ratio": F.stddev_pop(x), "cv": A.variation(x), "min_ratio": F.min(x), "max_ratio": F.max(x)}
    return r.groupBy(F.col("parts").cast("long").alias("parts")).agg(*[F.round(c, 5).alias(k) for k, c in out.items()], F.count(F.lit(1)).alias("n_seeds"))


@query(
    "loso_nearest_centroid",
    f"""WITH {E}, 
c AS (SELECT g.fold, e.vec_id % 2 AS cls, e.t, e.ch, avg(e.x) AS m FROM e, (SELECT DISTINCT label AS fold FROM e) g WHERE e.label <> g.fold GROUP BY 1, 2, 3, 4),
d AS (SELECT e.vec_id, e.label AS fold, c.cls, round(sum((e.x - c.m) * (e.x - c.m)), 6) AS d FROM e JOIN c ON c.fold = e.label AND c.t = e.t AND c.ch = e.ch GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cls) AS k FROM d)
SELECT fold, count(*) AS n, round(avg(CASE WHEN cls = vec_id % 2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r WHERE k = 1 GROUP BY 1""",
)
def loso_nearest_centroid(spark, sf_dir):
    """Leave one label group out; classes are odd and even epochs.

    Class centroids without a group are the difference of all sums and the
    group's, so every row is read once and no fold copies the data.
    """
    rows = epoch_samples(spark, sf_dir).withColumn("cls", F.col("vec_id") % 2)
    own = rows.groupBy("label", "cls", "t", "ch").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    every = own.groupBy("cls", "t", "ch").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    folds = own.select(F.col("label").alias("fold")).distinct()
    held = own.select(F.col("label").alias("fold"), "cls", "t", "ch", "s", "n")
    cells = folds.crossJoin(F.broadcast(every)).join(held, ["fold", "cls", "t", "ch"], "left").fillna(0, ["s", "n"])
    centroids = cells.where("all_n > n").select(F.col("fold").alias("label"), F.col("cls").alias("named"), "t", "ch", ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("m"))
    far = F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))
    d = rows.join(F.broadcast(centroids), ["label", "t", "ch"]).groupBy("vec_id", "label", "named").agg(F.round(far, 6).alias("d"))
    best = d.groupBy("vec_id", "label").agg(F.min(F.struct("d", "named")).alias("b"))
    return best.groupBy(F.col("label").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("b.named") == F.col("vec_id") % 2).cast("double")), 6).alias("accuracy"))


@query(
    "gated_fallback",
    f"""WITH {S}, m AS (SELECT user_id, count(*) AS n, avg(CASE WHEN idx % 2 = 0 THEN value END) AS raw, avg(CASE WHEN idx % 2 = 1 THEN value END) AS tangent, stddev_pop(value) / avg(value) AS spread FROM s GROUP BY 1),
g AS (SELECT user_id, n, CASE WHEN spread > 1.0 OR raw >= tangent THEN 'raw' ELSE 'tangent' END AS model, CASE WHEN spread > 1.0 OR raw >= tangent THEN raw ELSE tangent END AS score FROM m)
SELECT model, count(*) AS n_all, round(avg(score), 6) AS mean_all, count(*) FILTER (n >= 60) AS n_clean, round(avg(score) FILTER (n >= 60), 6) AS mean_clean FROM g GROUP BY 1""",
)
def gated_fallback(spark, sf_dir):
    """A recording falls back to the raw model if unsteady or if that scores better; means over all and over long ones."""
    v, odd = F.col("value"), F.col("idx") % 2 == 1
    m = samples(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(~odd, v)).alias("raw"), F.avg(F.when(odd, v)).alias("tangent"), (F.stddev_pop(v) / F.avg(v)).alias("spread"))
    raw = F.coalesce((F.col("spread") > 1.0) | (F.col("raw") >= F.col("tangent")), F.lit(False))
    g = m.select("n", F.when(raw, "raw").otherwise("tangent").alias("model"), F.when(raw, F.col("raw")).otherwise(F.col("tangent")).alias("score"))
    clean = F.col("n") >= 60
    return g.groupBy("model").agg(F.count(F.lit(1)).alias("n_all"), F.round(F.avg("score"), 6).alias("mean_all"), F.count_if(clean).alias("n_clean"), F.round(F.avg(F.when(clean, F.col("score"))), 6).alias("mean_clean"))


SHUFFLE = scattered_sql("event_id")


@query("balanced_sample", f"WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {SHUFFLE}, event_id) AS k FROM events), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM r, m WHERE k <= m GROUP BY 1")
def balanced_sample(spark, sf_dir):
    """As many rows of each class as the smallest has, without replacement, by a seeded order."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id")
    rows = rows.withColumn("at", ST.scattered(F.col("event_id")))
    kept = ST.least_of_each(rows, "event_type", ["at", "event_id"], ST.BOUND)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "negative_control",
    f"""WITH o AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), h AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY {SHUFFLE}, event_id) AS i FROM events)
SELECT user_id, count(*) AS n, round(avg(CASE WHEN o.event_type = h.event_type THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM o JOIN h USING (user_id, i) GROUP BY 1""",
)
def negative_control(spark, sf_dir):
    """Labels shuffled within recordings agree with the true ones by chance only."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    i = lambda *by: F.row_number().over(Window.partitionBy("user_id").orderBy(*by))
    true = rows.select("user_id", "event_type", i("event_id").alias("i"))
    mixed = rows.select("user_id", F.col("event_type").alias("shuffled"), i(ST.scattered(F.col("event_id")), "event_id").alias("i"))
    agree = (F.col("event_type") == F.col("shuffled")).cast("double")
    return true.join(mixed, ["user_id", "i"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(agree), 6).alias("agreement"))


@query(
    "fold_log_parse",
    """WITH g AS (SELECT l_suppkey, l_returnflag, CAST(round(avg(l_quantity) * 10) AS BIGINT) AS a, CAST(round(avg(l_discount) * 1000) AS BIGINT) AS b FROM lineitem GROUP BY 1, 2)
SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::BIGINT AS block, l_suppkey AS subject, a::DOUBLE AS raw, b::DOUBLE AS tangent FROM g""",
)
def fold_log_parse(spark, sf_dir):
    """Log lines made of aggregates, with noise lines between, read back by pattern."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(A.rounded_mean(F.col("l_quantity"), 0, 10).cast("long").alias("a"), A.rounded_mean(F.col("l_discount"), 0, 1000).cast("long").alias("b"))
    block = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    line = F.format_string("[block %d] subject %03d: raw=%d.0 tangent=%d.0", block, "l_suppkey", "a", "b")
    lines = g.select(F.explode(F.array(line, F.lit("---- progress ----"))).alias("line"))
    return P.parse_fold_lines(lines, "line")


@query("json_packets", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS high FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1")
def json_packets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint")).where("p.k is not null")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("high"))


def _wrapped(x: str, bits: int) -> str:
    return f"((({x}) + {1 << bits - 1}) % {1 << bits} + {1 << bits}) % {1 << bits} - {1 << bits - 1}"


@query(
    "frame_decode",
    f"""WITH v AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS x FROM events WHERE event_id % 10 <> 9)
SELECT event_id, event_id % 256 AS packet_id, {_wrapped('x', 16)} AS ch1, {_wrapped('-x', 16)} AS ch2, {_wrapped('x * 2', 16)} AS ch3, {_wrapped('x - 30000', 16)} AS ch4, (event_id * 400009) % 4294967296 AS hw_time, event_id % 3 AS status FROM v""",
)
def frame_decode(spark, sf_dir):
    """Values packed in binary frames and read back; every tenth frame comes short and is dropped."""
    rows = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("x"))
    x, e = F.col("x"), F.col("event_id")
    rows = P.encode_frames(rows, e, [x, -x, x * 2, x - 30000], e * 400009, e % 3)
    rows = rows.withColumn("frame", F.when(e % 10 == 9, F.substring("frame", 1, 13)).otherwise(F.col("frame")))
    return P.decode_frames(rows, "frame").drop("x", "frame")


@query(
    "calibration_profile_json",
    """WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'purchase') AS nr, count(*) FILTER (event_type = 'purchase') AS nt, avg(CASE WHEN event_type <> 'purchase' THEN value END) AS mr, avg(CASE WHEN event_type = 'purchase' THEN value END) AS mt FROM events GROUP BY 1)
SELECT user_id, '{"calibration_version":2,"n_samples_rest":' || nr || ',"n_samples_task":' || nt || ',"gate_status":{"g1_separability_pass":' || CASE WHEN mt - mr >= 0.3 THEN 'true' ELSE 'false' END || ',"g2_quality_pass":' || CASE WHEN nr >= 30 THEN 'true' ELSE 'false' END || '}}' AS profile FROM s WHERE mt IS NOT NULL AND mr IS NOT NULL""",
)
def calibration_profile_json(spark, sf_dir):
    task, v = F.col("event_type") == "purchase", F.col("value")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(~task).alias("nr"), F.count_if(task).alias("nt"), F.avg(F.when(~task, v)).alias("mr"), F.avg(F.when(task, v)).alias("mt"))
    gates = F.struct((F.col("mt") - F.col("mr") >= 0.3).alias("g1_separability_pass"), (F.col("nr") >= 30).alias("g2_quality_pass"))
    profile = F.struct(F.lit(2).alias("calibration_version"), F.col("nr").alias("n_samples_rest"), F.col("nt").alias("n_samples_task"), gates.alias("gate_status"))
    return s.where("mt is not null and mr is not null").select("user_id", F.to_json(profile).alias("profile"))


GATES = {"rms": (50.0, 90.0), "mean": (30.0, 60.0), "loss": (0.0, 0.5)}


@query(
    "gate_report",
    """WITH m AS (SELECT event_type, sqrt(avg(value * value)) AS rms, avg(value) AS mean, avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) AS loss FROM events GROUP BY 1), x AS (UNPIVOT m ON rms, mean, loss INTO NAME gate VALUE v), g AS (SELECT * FROM (VALUES ('rms', 50.0, 90.0), ('mean', 30.0, 60.0), ('loss', 0.0, 0.5)) g(gate, lo, hi))
SELECT gate, count(*) AS n, count(*) FILTER (v BETWEEN lo AND hi) AS passed FROM x JOIN g USING (gate) GROUP BY 1""",
)
def gate_report(spark, sf_dir):
    """How many channels pass each range gate."""
    v = F.col("value")
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(A.rms(v).alias("rms"), F.avg(v).alias("mean"), F.avg((v < 5).cast("double")).alias("loss"))
    long = m.unpivot("event_type", list(GATES), "gate", "v")
    gates = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("gate"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in GATES.items()])))
    return long.join(F.broadcast(gates), "gate").groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("passed"))


@query(
    "narrate_rules",
    f"""WITH {S}, x AS (SELECT user_id, idx, CASE WHEN event_type IN ('click', 'purchase') THEN 'ENGAGED' ELSE 'RESTING' END AS st FROM s), a AS (SELECT user_id, arg_max(st, idx) AS state, arg_min(st, idx) AS first, avg(CASE WHEN st = 'ENGAGED' THEN 1.0 ELSE 0.0 END) AS share, max(idx) AS last FROM x GROUP BY 1),
b AS (SELECT a.*, x.st AS before FROM a LEFT JOIN x ON x.user_id = a.user_id AND x.idx = a.last - 1)
SELECT user_id, state, CASE WHEN state = 'ENGAGED' AND before = 'RESTING' THEN 'Attention has just picked up.' WHEN state = 'RESTING' AND before = 'ENGAGED' THEN 'Attention is fading.' WHEN state = 'ENGAGED' AND first = 'RESTING' THEN 'The session turned from rest to focus.' WHEN share >= 0.5 THEN 'Focus is holding.' ELSE 'A calm stretch.' END AS sentence FROM b""",
)
def narrate_rules(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("st", F.when(F.col("event_type").isin(*ENGAGED), "ENGAGED").otherwise("RESTING"))
    rows = rows.withColumn("prev", F.lag("st").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    a = rows.groupBy("user_id").agg(F.max_by("st", "idx").alias("state"), F.max_by("prev", "idx").alias("before"), F.min_by("st", "idx").alias("first"), F.avg((F.col("st") == "ENGAGED").cast("double")).alias("share"))
    return a.select("user_id", "state", P.narrate(F.col("state"), F.col("before"), F.col("first"), F.col("share")).alias("sentence"))


@query(
    "bootstrap_corr_ci",
    f"""WITH p0 AS (SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value END), 4) AS a, round(avg(CASE WHEN event_type = 'view' THEN value END), 4) AS c FROM events GROUP BY 1), v AS (SELECT a, c, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM p0 WHERE a IS NOT NULL AND c IS NOT NULL),
b AS (SELECT unnest(range(0, 2000)) AS b), p AS (SELECT b, {PICK} AS pick FROM v, b), m AS (SELECT p.b, corr(v.a, v.c) AS r FROM p JOIN v ON v.i = p.pick GROUP BY 1)
SELECT round(quantile_cont(r, 0.025), 5) AS r_lo, round(quantile_cont(r, 0.975), 5) AS r_hi, round(quantile_cont(r * r, 0.025), 5) AS r2_lo, round(quantile_cont(r * r, 0.975), 5) AS r2_hi, quantile_cont(r, 0.025) <= 0 AND quantile_cont(r, 0.975) >= 0 AS holds_zero FROM m""",
)
def bootstrap_corr_ci(spark, sf_dir):
    """Intervals of the correlation of two channels' means over recordings, and of its square."""
    mean = lambda kind: A.rounded_mean(F.when(F.col("event_type") == kind, F.col("value")), 4)
    pairs = table(spark, sf_dir, "events").groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("c")).where("a is not null and c is not null")
    rows = ST.numbered(pairs, ["user_id"])
    r = ST.bootstrap(rows, ["a", "c"], 2000, F.corr("a", "c"), ST.correlation).withColumnRenamed("statistic", "r")
    q = lambda c, p: F.percentile(c, F.lit(p))
    r2 = F.col("r") * F.col("r")
    out = r.agg(q("r", 0.025).alias("lo"), q("r", 0.975).alias("hi"), F.round(q(r2, 0.025), 5).alias("r2_lo"), F.round(q(r2, 0.975), 5).alias("r2_hi"))
    return out.select(F.round("lo", 5).alias("r_lo"), F.round("hi", 5).alias("r_hi"), "r2_lo", "r2_hi", ((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("holds_zero"))


@query("linear_decoder", f"WITH {E}, v AS (SELECT vec_id, ch, var_pop(x) AS v FROM e GROUP BY 1, 2), s AS (SELECT vec_id, sum(v * CASE ch WHEN 0 THEN 0.4 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0.1 END) AS score FROM v GROUP BY 1) SELECT vec_id, round(score, 6) AS score, CASE WHEN score > 0.015 THEN 'ENGAGED' ELSE 'RESTING' END AS decoded_state FROM s")
def linear_decoder(spark, sf_dir):
    """Weighted channel variances against a bound."""
    weight = F.element_at(F.array(*map(F.lit, (0.4, 0.3, 0.2, 0.1))), (F.col("ch") + 1).cast("int"))
    v = epoch_samples(spark, sf_dir).groupBy("vec_id", "ch").agg(F.var_pop("x").alias("v"))
    s = v.groupBy("vec_id").agg(F.sum(F.col("v") * weight).alias("score"))
    return s.select("vec_id", F.round("score", 6).alias("score"), F.when(F.col("score") > 0.015, "ENGAGED").otherwise("RESTING").alias("decoded_state"))


@query(
    "noise_sweep",
    f"""WITH {E}, g AS (SELECT unnest([0.0, 0.3, 0.6, 1.0, 1.5]) AS sigma), z AS (SELECT sigma, vec_id, t, ch, x, x + sigma * sqrt(0.015) * ({scattered_sql("vec_id * 64 + t * 4 + ch")} / 4294967296.0::DOUBLE - 0.5) * sqrt(12) AS y FROM e, g)
SELECT sigma, count(*) AS n, round(corr(x, y), 5) AS r, round(sqrt(avg(pow(y - x, 2))), 6) AS error FROM z GROUP BY 1""",
)
def noise_sweep(spark, sf_dir):
    """What rising noise leaves of the signal."""
    rows = epoch_samples(spark, sf_dir).withColumn("sigma", F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.6, 1.0, 1.5)))))
    u = ST.scattered(F.col("vec_id") * 64 + F.col("t") * 4 + F.col("ch")) / float(ST.BOUND) - 0.5
    rows = rows.withColumn("y", F.col("x") + F.col("sigma") * F.sqrt(F.lit(0.015)) * u * F.sqrt(F.lit(12.0)))
    e = F.col("y") - F.col("x")
    return rows.groupBy("sigma").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 5).alias("r"), F.round(F.sqrt(F.avg(e * e)), 6).alias("error"))
