"""Token-level batches, here the embeddings: advantages, losses, weights and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import arrays as A
from rillflow.functions import numeric as N
from rillflow.operators import importance as I
from rillflow.operators import losses as L
from rillflow.plans.registry import query, table


def batch(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, m`` (mask) and arrays: rewards ``r``, log probabilities ``old, new, ref``, values ``v``, advantages ``a``."""
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    df = table(spark, d, "embeddings").select("vec_id", "label", e.alias("r"))
    turned = lambda k: F.concat(F.slice("r", k + 1, F.size("r") - k), F.slice("r", 1, k)) if k else F.col("r")
    minus = lambda c: F.transform(c, lambda x: -F.abs(x))
    return df.select(
        "vec_id", "label", "r", F.transform("r", lambda _, i: (i < 16 + F.col("vec_id") % 48).cast("double")).alias("m"),
        minus(turned(0)).alias("old"), minus(turned(1)).alias("new"), minus(turned(2)).alias("ref"), turned(3).alias("v"), turned(5).alias("a"),
    )


_AT = lambda k: f"e[(i + {k}) % 64 + 1]::DOUBLE"
T = f"""t AS (SELECT vec_id, label, i, (i < 16 + vec_id % 48)::INT::DOUBLE AS m, {_AT(0)} AS r, -abs({_AT(0)}) AS old, -abs({_AT(1)}) AS new, -abs({_AT(2)}) AS ref, {_AT(3)} AS v, {_AT(5)} AS a
 FROM (SELECT vec_id, label, embedding AS e, unnest(range(64)) AS i FROM embeddings))"""


def _round(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _flat(df: DataFrame, *names: str) -> DataFrame:
    """One row per token of the named arrays."""
    return df.select("vec_id", F.posexplode(F.arrays_zip(*names)).alias("pos", "t")).select("vec_id", "pos", *[_round(F.col(f"t.{n}")).alias(n) for n in names])


# masked statistics


@query(f"""WITH {T}, s AS (SELECT vec_id, sum(m) AS n, sum(r * m) AS total, sum(r * m) / (sum(m) + 1e-8) AS mean FROM t GROUP BY vec_id)
 SELECT t.vec_id, round(any_value(total), 6) AS total, round(any_value(mean), 6) AS mean, round(sum(m * (r - mean) * (r - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1), 6) AS var,
 round(max(r) FILTER (m > 0), 6) AS top FROM t JOIN s USING (vec_id) GROUP BY t.vec_id""")
def masked_stats(spark: SparkSession, d: str) -> DataFrame:
    r, m = F.col("r"), F.col("m")
    return batch(spark, d).select("vec_id", _round(A.masked_sum(r, m)).alias("total"), _round(A.masked_mean(r, m)).alias("mean"), _round(A.masked_var(r, m)).alias("var"), _round(F.array_max(F.filter(F.zip_with(r, m, lambda x, k: F.when(k > 0, x)), lambda x: x.isNotNull()))).alias("top"))


def whitened(df: DataFrame, column: str, out: str, mask: str = "m", shift_mean: bool = True) -> DataFrame:
    """An array column less its masked batch mean, over the root of its variance plus 1e-8; the mask isn't applied again."""
    x, m = F.col(column), F.col(mask)
    first = df.agg(F.sum(A.mask_size(m)).alias("w_n"), (F.sum(A.masked_sum(x, m)) / (F.sum(A.mask_size(m)) + A.MASK_EPS)).alias("w_mean"))
    centred = df.join(F.broadcast(first))  # one row; squares about the mean, as those about 0 cancel where it is large
    second = centred.agg(F.sum(A.masked_sum(F.transform(x, lambda v: (v - F.col("w_mean")) * (v - F.col("w_mean"))), m)).alias("w_q"))
    var = F.col("w_q") / (F.col("w_n") + A.MASK_EPS) * F.col("w_n") / (F.col("w_n") - 1)
    joined = centred.join(F.broadcast(second)).withColumn("w_var", var).drop("w_n", "w_q")
    w = F.transform(x, lambda v: (v - F.col("w_mean")) / F.sqrt(F.col("w_var") + A.MASK_EPS) + (0.0 if shift_mean else F.col("w_mean")))
    return joined.withColumn(out, w).drop("w_mean", "w_var")


_WHITE = "w AS (SELECT mu, sum(m * (x - mu) * (x - mu)) / (sum(m) + 1e-8) * sum(m) / (sum(m) - 1) AS var FROM x, (SELECT sum(x * m) / (sum(m) + 1e-8) AS mu FROM x) GROUP BY mu)"


@query(f"WITH {T}, x AS (SELECT *, r AS x FROM t), {_WHITE} SELECT vec_id, i::INT AS pos, round((x - mu) / sqrt(var + 1e-8), 6) + 0.0 AS white FROM x, w")
def masked_whiten(spark: SparkSession, d: str) -> DataFrame:
    return _flat(whitened(batch(spark, d), "r", "white"), "white")


# recurrences

_GAMMA, _LAM = 0.99, 0.95
_GAE = f"""{T}, c AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k, coalesce(lead(v) OVER (PARTITION BY vec_id ORDER BY i), 0) AS nv FROM t WHERE m > 0),
 dl AS (SELECT *, r + {_GAMMA} * nv - v AS delta FROM c),
 g AS (SELECT p.vec_id, p.i, any_value(p.v) AS v, sum(pow({_GAMMA * _LAM}, q.k - p.k) * q.delta) AS x FROM dl p JOIN dl q ON q.vec_id = p.vec_id AND q.k >= p.k GROUP BY p.vec_id, p.i)"""


def _gae(spark: SparkSession, d: str) -> DataFrame:
    return batch(spark, d).withColumn("gae", A.gae(_GAMMA, _LAM)("r", "v", "m")).withColumn("returns", F.zip_with("gae", "v", lambda a, v: a + v))


def _counted(df: DataFrame, *names: str) -> DataFrame:
    return _flat(df, *names, "m").where("m > 0").drop("m")


@query(f"WITH {_GAE} SELECT vec_id, i::INT AS pos, round(x, 6) + 0.0 AS gae, round(x + v, 6) + 0.0 AS returns FROM g")
def adv_gae(spark: SparkSession, d: str) -> DataFrame:
    """Generalised advantages before whitening, at counted tokens."""
    return _counted(_gae(spark, d), "gae", "returns")


@query(f"""WITH {_GAE}, w AS (SELECT mu, sum((x - mu) * (x - mu)) / (count(*) + 1e-8) * count(*) / (count(*) - 1) AS var FROM g, (SELECT sum(x) / (count(*) + 1e-8) AS mu FROM g) GROUP BY mu)
 SELECT vec_id, i::INT AS pos, round((x - mu) / sqrt(var + 1e-8), 6) + 0.0 AS white FROM g, w""")
def adv_gae_whitened(spark: SparkSession, d: str) -> DataFrame:
    return _counted(whitened(_gae(spark, d), "gae", "white"), "white")


@query(f"WITH {T} SELECT vec_id, i::INT AS pos, round(sum(r * m) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS to_go, round(sum(r * m) OVER (PARTITION BY vec_id ORDER BY i), 6) + 0.0 AS so_far FROM t")
def reward_to_go(spark: SparkSession, d: str) -> DataFrame:
    return _flat(batch(spark, d).withColumns({"to_go": A.suffix_sum()("r", "m"), "so_far": A.prefix_sum("r", "m")}), "to_go", "so_far")


@query(f"""WITH {T}, k AS (SELECT p.vec_id, p.i, p.m, sum(pow(0.9, q.i - p.i) * q.r) AS x FROM t p JOIN t q ON q.vec_id = p.vec_id AND q.i >= p.i AND (q.m > 0 OR q.i = p.i) AND p.m > 0 GROUP BY p.vec_id, p.i, p.m),
 x AS (SELECT * FROM k), {_WHITE} SELECT vec_id, i::INT AS pos, round((x - mu) / sqrt(var + 1e-8), 6) + 0.0 AS advantage FROM x, w""")
def adv_reinforce_pp(spark: SparkSession, d: str) -> DataFrame:
    """Discounted reward to go (reset where the mask is 0), whitened; counted tokens."""
    return _counted(whitened(batch(spark, d).withColumn("g", A.suffix_sum(0.9)("r", "m")), "g", "advantage"), "advantage")


@query(f"WITH {T} SELECT vec_id, i::INT AS pos, round(sum(r * m) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.1 * label * m, 6) + 0.0 AS advantage FROM t")
def adv_remax(spark: SparkSession, d: str) -> DataFrame:
    """Reward to go less the greedy answer's score, here a tenth of the label."""
    df = batch(spark, d).withColumn("g", A.suffix_sum()("r", "m"))
    return _flat(df.withColumn("advantage", F.zip_with("g", "m", lambda g, m: g - 0.1 * F.col("label") * m)), "advantage")


def otb(df: DataFrame, key: str, ident: str, returns: str, energy: str, mask: str) -> DataFrame:
    """``ident, pos, advantage``: return less the group's energy-weighted mean return at the same position.

    The part of a group's single longest row beyond its second longest has baseline 0, and so has a group of one row.
    """
    tokens = df.select(key, ident, F.posexplode(F.arrays_zip(F.col(returns).alias("g"), F.col(energy).alias("w"), F.col(mask).alias("m"))).alias("pos", "t")).select(key, ident, "pos", "t.g", "t.w", "t.m")
    base = tokens.groupBy(key, "pos").agg((F.sum(F.col("g") * F.col("w") * F.col("m")) / (F.sum(F.col("w") * F.col("m")) + 1e-8)).alias("b"))
    lengths = df.select(key, ident, A.mask_size(F.col(mask)).alias("n"))
    longest = lengths.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n1"))
    tops = lengths.join(longest, key)
    second = tops.groupBy(key).agg(F.count_if(F.col("n") == F.col("n1")).alias("ties"), F.max(F.when(F.col("n") < F.col("n1"), F.col("n"))).alias("n2"))
    shape = tops.join(second, key).select(ident, "rows", F.when((F.col("n") == F.col("n1")) & (F.col("ties") == 1), F.col("n2")).alias("tail"))
    joined = tokens.join(base, [key, "pos"]).join(shape, ident)
    b = F.when((F.col("rows") == 1) | (F.col("pos") >= F.col("tail")), 0.0).otherwise(F.col("b"))
    return joined.select(ident, "pos", ((F.col("g") - b) * F.col("m")).alias("advantage"))


_OTB = """, s AS (SELECT vec_id, label, i, m, sum(r * m) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
 sum((1 - 2 * exp(old) + abs(v)) * m) OVER (PARTITION BY vec_id ORDER BY i) AS w FROM t),
 b AS (SELECT label, i, sum(g * w * m) / (sum(w * m) + 1e-8) AS b FROM s GROUP BY label, i),
 n AS (SELECT vec_id, label, sum(m) AS n FROM t GROUP BY vec_id, label),
 x AS (SELECT *, max(n) OVER (PARTITION BY label) AS n1, count(*) OVER (PARTITION BY label) AS rows FROM n),
 y AS (SELECT label, count(*) FILTER (n = n1) AS ties, max(n) FILTER (n < n1) AS n2 FROM x GROUP BY label),
 z AS (SELECT vec_id, rows, CASE WHEN n = n1 AND ties = 1 THEN n2 END AS tail FROM x JOIN y USING (label))
 SELECT s.vec_id, s.i::INT AS pos, round((g - CASE WHEN rows = 1 OR coalesce(s.i >= tail, false) THEN 0 ELSE b END) * m, 5) + 0.0 AS advantage FROM s JOIN b ON b.label = s.label AND b.i = s.i JOIN z ON z.vec_id = s.vec_id"""


@query(f"WITH {T}{_OTB}")
def adv_otb(spark: SparkSession, d: str) -> DataFrame:
    """Per-timestep optimal baseline; a token's energy is 1 - 2 p + the sum of squared probabilities."""
    energy = A.zip_map(lambda o, v: 1 - 2 * F.exp(o) + F.abs(v), F.col("old"), F.col("v"))
    df = batch(spark, d).withColumn("e", energy).withColumns({"g": A.suffix_sum()("r", "m"), "w": A.prefix_sum("e", "m")})
    return otb(df, "label", "vec_id", "g", "w", "m").withColumn("advantage", F.round("advantage", 5))


@query(f"""WITH {T.replace('(i < 16 + vec_id % 48)::INT::DOUBLE AS m', '((i < 16 + vec_id % 48) AND i % 3 <> 1)::INT::DOUBLE AS m')},
 k AS (SELECT vec_id, label, i AS at, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS i, 1.0::DOUBLE AS m, r, old, v FROM t WHERE m > 0){_OTB.replace('FROM t', 'FROM k', 1).replace('FROM t GROUP', 'FROM k GROUP')}""")
def adv_tir_otb(spark: SparkSession, d: str) -> DataFrame:
    """The same over the counted tokens only, pushed together: positions count tokens of the policy, not of tools."""
    df = batch(spark, d)
    keep = lambda c: F.filter(F.transform(c, lambda x, i: F.when((i < 16 + F.col("vec_id") % 48) & (i % 3 != 1), x)), lambda x: x.isNotNull())
    df = df.select("vec_id", "label", *[keep(F.col(c)).alias(c) for c in ("r", "old", "v")]).withColumn("m", F.transform("r", lambda _: F.lit(1.0)))
    energy = A.zip_map(lambda o, v: 1 - 2 * F.exp(o) + F.abs(v), F.col("old"), F.col("v"))
    df = df.withColumn("e", energy).withColumns({"g": A.suffix_sum()("r", "m"), "w": A.prefix_sum("e", "m")})
    return otb(df, "label", "vec_id", "g", "w", "m").withColumn("advantage", F.round("advantage", 5))


# divergences and penalised rewards

_KLD = "CASE kind WHEN 'k1' THEN new - ref WHEN 'abs' THEN abs(new - ref) WHEN 'k2' THEN 0.5 * (new - ref) * (new - ref) ELSE least(greatest(exp(ref - new) - (ref - new) - 1, -10), 10) END"


@query(f"WITH {T}, k AS (SELECT * FROM t, (SELECT unnest(['k1', 'abs', 'k2', 'k3']) AS kind)), s AS (SELECT kind, vec_id, sum(m * {_KLD}) AS s, sum(m) AS n FROM k GROUP BY kind, vec_id) SELECT kind, round(sum(s) / sum(n), 6) AS token_mean, round(avg(s / (n + 1e-8)), 6) AS row_mean FROM s GROUP BY kind")
def kl_estimators(spark: SparkSession, d: str) -> DataFrame:
    df = batch(spark, d)
    kinds = ("k1", "abs", "k2", "k3")
    k = df.select("m", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), A.zip_map(lambda a, b, n=n: L.kl_penalty(a, b, n), F.col("new"), F.col("ref")).alias("x")) for n in kinds])).alias("k")).select("m", "k.*")
    s = k.select("kind", A.masked_sum(F.col("x"), F.col("m")).alias("s"), A.mask_size(F.col("m")).alias("n"))
    return s.groupBy("kind").agg(_round(F.sum("s") / F.sum("n")).alias("token_mean"), _round(F.avg(F.col("s") / (F.col("n") + 1e-8))).alias("row_mean"))


@query(f"WITH {T} SELECT vec_id, i::INT AS pos, round(r - 0.05 * m * 0.5 * (new - ref) * (new - ref), 6) + 0.0 AS reward FROM t")
def kl_penalised_reward(spark: SparkSession, d: str) -> DataFrame:
    reward = A.zip_map(lambda r, n, f, m: r - 0.05 * m * L.kl_penalty(n, f, "k2"), F.col("r"), F.col("new"), F.col("ref"), F.col("m"))
    return _flat(batch(spark, d).withColumn("reward", reward), "reward")


# losses

_RATIO = "exp(least(greatest(new - old, -20), 20))"
_LOSS = {
    "vanilla": f"CASE WHEN a < 0 THEN least(-a * 3, greatest(-a * {_RATIO}, -a * least(greatest({_RATIO}, 0.8), 1.2))) ELSE greatest(-a * {_RATIO}, -a * least(greatest({_RATIO}, 0.8), 1.2)) END",
    "dppo_tv": f"-a * least({_RATIO}, 20) * new * CASE WHEN a > 0 THEN exp(new) - exp(old) <= 0.2 ELSE exp(new) - exp(old) >= -0.2 END::INT",
    "dppo_kl": f"-a * least({_RATIO}, 20) * new * CASE WHEN a > 0 THEN {{kl}} <= 0.2 OR exp(new) <= exp(old) ELSE {{kl}} <= 0.2 OR exp(new) >= exp(old) END::INT".replace("{kl}", "(exp(old) * (old - new) + (1 - exp(old)) * ln((1 - exp(old) + 1e-8) / (1 - exp(new) + 1e-8)))"),
    "sapo": f"-a * (4 / CASE WHEN a > 0 THEN 1.0 ELSE 1.05 END) / (1 + exp(-CASE WHEN a > 0 THEN 1.0 ELSE 1.05 END * ({_RATIO} - 1)))",
    "cispo": f"-least(greatest({_RATIO}, -9.0), 1.2) * a * new",
    "gpg": "-new * a",
    "reinforce": "-a * new",
}
_LOSSES = " UNION ALL ".join(f"SELECT '{k}' AS kind, vec_id, m, {x} AS x FROM t" for k, x in _LOSS.items())


@query(f"""WITH {T}, l AS ({_LOSSES}), s AS (SELECT kind, vec_id, sum(m * x) AS s, sum(m) AS n FROM l GROUP BY kind, vec_id)
 SELECT kind, round(sum(s) / sum(n), 6) AS token_mean, round(avg(s), 6) AS seq_sum, round(avg(s / (n + 1e-8)), 6) AS seq_mean, round(avg(s) / 64, 6) AS seq_norm FROM s GROUP BY kind""")
def policy_losses(spark: SparkSession, d: str) -> DataFrame:
    """Every token-level loss under every aggregation."""
    df = batch(spark, d)
    a, n, o = (F.col(c) for c in ("a", "new", "old"))
    each = df.select("m", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), L.token_losses(k, a, n, o).alias("x")) for k in _LOSS])).alias("l")).select("m", "l.*")
    modes = {"token_mean": "token-mean", "seq_sum": "seq-mean-token-sum", "seq_mean": "seq-mean-token-mean", "seq_norm": "seq-mean-token-sum-norm"}
    return each.groupBy("kind").agg(*[_round(L.aggregate_loss(each, F.col("x"), F.col("m"), mode, 64)).alias(c) for c, mode in modes.items()])


@query(f"WITH {T} SELECT round(sum(m * (-a * {_RATIO} < -a * least(greatest({_RATIO}, 0.8), 1.2))::INT) / sum(m), 6) AS clip_share, round(sum(m * (old - new)) / sum(m), 6) AS ppo_kl FROM t")
def clip_metrics(spark: SparkSession, d: str) -> DataFrame:
    df = batch(spark, d)
    def clipped(a: Column, n: Column, o: Column) -> Column:
        ratio = F.exp(L.log_ratio(n, o))
        return (-a * A.clamp(ratio, 0.8, 1.2) > -a * ratio).cast("double")
    m = F.col("m")
    return df.agg(_round(F.sum(A.masked_sum(A.zip_map(clipped, F.col("a"), F.col("new"), F.col("old")), m)) / F.sum(A.mask_size(m))).alias("clip_share"), _round(F.sum(A.masked_sum(A.zip_map(lambda n, o: o - n, F.col("new"), F.col("old")), m)) / F.sum(A.mask_size(m))).alias("ppo_kl"))


@query(f"""WITH {T}, s AS (SELECT vec_id, exp(least(sum(m * (new - old)) / greatest(sum(m), 1), 10)) AS ratio, sum(m) AS n FROM t GROUP BY vec_id),
 l AS (SELECT vec_id, sum(m * greatest(-a * ratio, -a * least(greatest(ratio, 0.997), 1.004))) / (any_value(n) + 1e-8) AS x FROM t JOIN s USING (vec_id) GROUP BY vec_id),
 g AS (SELECT vec_id, -sum(m * a) / (sum(m) + 1e-8) * exp(sum(m * least(sign(a) * (new - old), sign(a) * least(greatest(new - old, -0.4), 0.4)) * sign(a)) / (sum(m) + 1e-8)) AS x FROM t GROUP BY vec_id)
 SELECT (SELECT round(avg(x), 6) FROM l) AS gspo, (SELECT round(avg(x), 6) FROM g) AS gmpo""")
def sequence_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses with one ratio per sequence: of its mean log ratio, and of clipped token ratios' geometric mean."""
    df = batch(spark, d)
    a, n, o, m = (F.col(c) for c in ("a", "new", "old", "m"))
    return df.agg(_round(L.aggregate_loss(df, L.gspo(a, n, o, m, 0.003, 0.004), m, "seq-mean-token-mean")).alias("gspo"), _round(F.avg(L.gmpo(a, n, o, m, 0.4, 0.4))).alias("gmpo"))


@query(f"WITH {T} SELECT round(sum(m * 0.5 * greatest((v - r) * (v - r), pow(greatest(least(v, old + 0.2), old - 0.2) - r, 2))) / sum(m), 6) AS value_loss FROM t")
def value_losses(spark: SparkSession, d: str) -> DataFrame:
    df = batch(spark, d)
    x = A.zip_map(lambda v, r, o: L.value_loss(v, r, o, 0.2), F.col("v"), F.col("r"), F.col("old"))
    return df.agg(_round(L.aggregate_loss(df, x, F.col("m"), "token-mean")).alias("value_loss"))


@query(f"WITH {T}, x AS (SELECT vec_id, max(r) AS top FROM t GROUP BY vec_id), z AS (SELECT vec_id, any_value(top) AS top, sum(exp(r - top)) AS z, sum(exp(r - top) * r) AS s, sum(exp(2 * (r - top))) AS q FROM t JOIN x USING (vec_id) GROUP BY vec_id) SELECT vec_id, round(ln(z) + top - s / z, 6) AS entropy, round(q / (z * z), 6) AS pi_squared FROM z")
def logit_entropy(spark: SparkSession, d: str) -> DataFrame:
    return batch(spark, d).select("vec_id", _round(L.entropy(F.col("r"))).alias("entropy"), _round(L.sum_pi_squared(F.col("r"))).alias("pi_squared"))


@query(f"""WITH {T}, c AS (SELECT vec_id, i, (a - (SELECT avg(a) FROM t WHERE m > 0)) * (new - (SELECT avg(new) FROM t WHERE m > 0)) AS cov FROM t WHERE m > 0),
 k AS (SELECT *, row_number() OVER (ORDER BY round(cov, 9) DESC, vec_id, i) AS k, count(*) OVER () AS n FROM c) SELECT vec_id, i::INT AS pos, round(cov, 6) AS cov FROM k WHERE k <= greatest(1, floor(n * 0.002))""")
def kl_cov_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens with the largest covariance of advantage and log probability, which a covariance loss penalises."""
    tokens = L.covariance_tokens(batch(spark, d), "vec_id", "a", "new", "m").withColumn("key", F.round("cov", 9))
    return L.top_share(tokens, "key", 0.002, ["vec_id", "pos"]).select("vec_id", "pos", _round("cov").alias("cov"))


@query(f"WITH {T} SELECT vec_id, i::INT AS pos, (m > 0 AND NOT (i % 7 = 3))::INT AS loss_mask FROM t")
def explore_loss_mask(spark: SparkSession, d: str) -> DataFrame:
    """The mask of the loss: counted tokens that exploration didn't replace, given by their positions."""
    positions = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 7 == 3)
    df = batch(spark, d).withColumn("drop", A.positions_to_mask(positions, F.size("r"))).withColumn("loss_mask", F.zip_with("m", "drop", lambda m, k: ((m > 0) & (k == 0)).cast("int")))
    return df.select("vec_id", F.posexplode("loss_mask").alias("pos", "loss_mask"))


# importance weights and rejection

_OPTIONS = {"token_k1": "0.8_1.25", "token_k2": 0.02, "token_k3": 0.02, "seq_sum_k1": "0.5_2.0", "seq_sum_k2": 0.6, "seq_sum_k3": 0.6, "seq_mean_k1": "0.98_1.02", "seq_mean_k2": 0.02, "seq_mean_k3": 0.02, "seq_max_k2": 0.2, "seq_max_k3": 0.2}
_K = {"k1": "-(new - old)", "k2": "0.5 * (new - old) * (new - old)", "k3": "exp(new - old) - 1 - (new - old)"}


def _keep(name: str, spec: str | float) -> str:
    x, low, high = _K[name[-2:]], None, str(spec)
    if "_" in str(spec):
        low, high = (f"ln({p})" for p in str(spec).split("_"))
    if name.startswith("seq"):
        x = {"sum": "sum(m * ({x})) OVER w", "mean": "sum(m * ({x})) OVER w / (sum(m) OVER w + 1e-8)", "max": "max(CASE WHEN m > 0 THEN {x} END) OVER w"}[name.split("_")[1]].format(x=x)
    return f"SELECT '{name}' AS option, vec_id, m, coalesce({x} <= {high}{f' AND {x} >= {low}' if low else ''}, false)::INT AS keep FROM t WINDOW w AS (PARTITION BY vec_id)"


@query(f"""WITH {T}, k AS ({' UNION ALL '.join(_keep(n, s) for n, s in _OPTIONS.items())}), s AS (SELECT option, vec_id, sum(m * keep) AS kept, sum(m) AS n FROM k GROUP BY option, vec_id)
 SELECT option, round(1 - sum(kept) / sum(n), 6) AS masked, round(avg((kept < n)::INT), 6) AS seq_masked FROM s GROUP BY option""")
def rejection_options(spark: SparkSession, d: str) -> DataFrame:
    """Shares of tokens and of sequences that each rejection option masks."""
    df = batch(spark, d).withColumn("x", I.ratio_of(F.col("new"), F.col("old")))
    each = [F.struct(F.lit(n).alias("option"), I.keep_mask(F.col("x"), F.col("m"), I.parse_thresholds([n], s)).alias("keep")) for n, s in _OPTIONS.items()]
    k = df.select("m", F.explode(F.array(*each)).alias("k")).select("m", "k.*").select("option", A.masked_sum(F.col("keep"), F.col("m")).alias("kept"), A.mask_size(F.col("m")).alias("n"))
    return k.groupBy("option").agg(_round(1 - F.sum("kept") / F.sum("n")).alias("masked"), _round(F.avg((F.col("kept") < F.col("n")).cast("int"))).alias("seq_masked"))


@query(f"""WITH {T}, s AS (SELECT *, sum(m * (new - old)) OVER (PARTITION BY vec_id) AS whole FROM t),
 w AS (SELECT vec_id, m, least(exp(new - old) * m, 1.05) AS token, CASE WHEN exp(whole) * m BETWEEN 0.5 AND 2 THEN exp(whole) * m ELSE 0 END AS seq FROM s),
 f AS (SELECT sum(token * m) / (sum(m) + 1e-8) AS mt FROM w), q AS (SELECT vec_id, sum(seq * m) / (sum(m) + 1e-8) AS x FROM w GROUP BY vec_id), h AS (SELECT avg(x) AS ms FROM q)
 SELECT w.vec_id, round(sum(token / mt), 6) AS token_weight, round(sum(seq / ms), 6) AS seq_weight FROM w, f, h GROUP BY w.vec_id""")
def importance_weights(spark: SparkSession, d: str) -> DataFrame:
    """Token weights cut at a bound and sequence weights dropped outside two, each over its batch mean."""
    df = batch(spark, d).withColumn("x", I.ratio_of(F.col("new"), F.col("old")))
    x, m = F.col("x"), F.col("m")
    df = df.withColumns({"tw": I.clip_weights(I.raw_weights(x, m, "token"), 1.05), "sw": I.clip_weights(I.raw_weights(x, m, "sequence"), 2.0, 0.5)})
    df = I.normalised(I.normalised(df, "tw", "m", "token", "tn"), "sw", "m", "sequence", "sn")
    return df.select("vec_id", _round(A.array_sum(F.col("tn"))).alias("token_weight"), _round(A.array_sum(F.col("sn"))).alias("seq_weight"))


@query(f"""WITH {T}, w AS (SELECT least(exp(new - old), 1.05) AS w, exp(new - old) AS raw FROM t WHERE m > 0), u AS (SELECT avg(w) AS mu FROM w)
 SELECT round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, round(max(raw), 6) AS max, round(min(raw), 6) AS min, round(avg((raw > 1.05)::INT), 6) AS high_share, round(1 / avg((w / mu) * (w / mu)), 6) AS ess FROM w, u""")
def importance_metrics(spark: SparkSession, d: str) -> DataFrame:
    df = batch(spark, d).withColumn("x", I.ratio_of(F.col("new"), F.col("old")))
    t = df.select(F.explode(F.arrays_zip("x", "m")).alias("t")).where("t.m > 0").select(F.exp(A.clamp(F.col("t.x"), -20, 20)).alias("raw")).withColumn("w", F.least("raw", F.lit(1.05)))
    # mean of (w / mean)^2 is the mean square over the squared mean
    return t.agg(_round(F.avg("w")).alias("mean"), _round(F.stddev_pop("w")).alias("std"), _round(F.max("raw")).alias("max"), _round(F.min("raw")).alias("min"), _round(F.avg((F.col("raw") > 1.05).cast("int"))).alias("high_share"), _round(F.avg("w") * F.avg("w") / F.avg(F.col("w") * F.col("w"))).alias("ess"))


@query(f"""WITH {T}, s AS (SELECT vec_id, sum(m * old) / (sum(m) + 1e-8) AS tr, sum(m * ref) / (sum(m) + 1e-8) AS ro, sum(m * (old - ref)) AS lr FROM t GROUP BY vec_id)
 SELECT round(avg(exp(-tr)), 6) AS training_ppl, round(avg(-tr), 6) AS training_log_ppl, round(avg(exp(-ro)), 6) AS rollout_ppl, round(avg(ro - tr), 6) AS log_ppl_diff, round(avg(abs(ro - tr)), 6) AS log_ppl_abs_diff,
 round(max(ro - tr), 6) AS log_ppl_diff_max, round(min(ro - tr), 6) AS log_ppl_diff_min, round(avg(exp(ro - tr)), 6) AS ppl_ratio, round(avg(exp(2 * least(greatest(lr, -20), 20))) - 1, 5) AS chi2_seq,
 (SELECT round(sum(m * (ref - old)) / sum(m), 6) FROM t) AS kl, (SELECT round(sum(m * (exp(old - ref) - (old - ref) - 1)) / sum(m), 6) FROM t) AS k3_kl, (SELECT round(sum(m * exp(2 * (old - ref))) / sum(m) - 1, 6) FROM t) AS chi2_token FROM s""")
def off_policy_metrics(spark: SparkSession, d: str) -> DataFrame:
    df = batch(spark, d)
    m, old, ref = F.col("m"), F.col("old"), F.col("ref")
    x = I.ratio_of(old, ref)
    s = df.select(A.masked_mean(old, m).alias("tr"), A.masked_mean(ref, m).alias("ro"), A.masked_sum(x, m).alias("lr"), A.mask_size(m).alias("n"), A.masked_sum(F.transform(x, lambda v: F.exp(v) - v - 1), m).alias("k3"), A.masked_sum(F.transform(x, lambda v: F.exp(2 * A.clamp(v, -20, 20))), m).alias("sq"))
    diff = F.col("ro") - F.col("tr")
    return s.agg(
        _round(F.avg(F.exp(-F.col("tr")))).alias("training_ppl"), _round(F.avg(-F.col("tr"))).alias("training_log_ppl"), _round(F.avg(F.exp(-F.col("ro")))).alias("rollout_ppl"), _round(F.avg(diff)).alias("log_ppl_diff"),
        _round(F.avg(F.abs(diff))).alias("log_ppl_abs_diff"), _round(F.max(diff)).alias("log_ppl_diff_max"), _round(F.min(diff)).alias("log_ppl_diff_min"), _round(F.avg(F.exp(diff))).alias("ppl_ratio"),
        _round(F.avg(F.exp(2 * A.clamp(F.col("lr"), -20, 20))) - 1, 5).alias("chi2_seq"), _round(-F.sum("lr") / F.sum("n")).alias("kl"), _round(F.sum("k3") / F.sum("n")).alias("k3_kl"), _round(F.sum("sq") / F.sum("n") - 1).alias("chi2_token"),
    )


@query(f"""WITH {T}, s AS (SELECT vec_id, sum(m * a) / (sum(m) + 1e-8) AS a, sum(m * (1 - 2 * exp(old) + abs(v))) AS w FROM t GROUP BY vec_id), p AS (SELECT avg(a * a * greatest(w, 0)) AS p2, avg(a * a) AS ea2, avg(w) AS ew, count(*) AS n FROM s)
 SELECT round(p2, 6) AS total_power, round(greatest(0, (p2 - 0.01) / (n - 1)), 9) AS pure_noise, round(ea2, 6) AS expected_a_squared, round(ew, 6) AS expected_w FROM p""")
def variance_proxies(spark: SparkSession, d: str) -> DataFrame:
    """Power, noise and components of the gradient's variance; the squared gradient norm is given as 0.01."""
    m = F.col("m")
    energy = A.zip_map(lambda o, v: 1 - 2 * F.exp(o) + F.abs(v), F.col("old"), F.col("v"))
    s = batch(spark, d).select(A.masked_mean(F.col("a"), m).alias("a"), A.masked_sum(energy, m).alias("w"))
    p = s.agg(F.avg(F.col("a") * F.col("a") * F.greatest("w", F.lit(0.0))).alias("p2"), F.avg(F.col("a") * F.col("a")).alias("ea2"), F.avg("w").alias("ew"), F.count(F.lit(1)).alias("n"))
    return p.select(_round("p2").alias("total_power"), F.round(F.greatest(F.lit(0.0), (F.col("p2") - 0.01) / (F.col("n") - 1)), 9).alias("pure_noise"), _round("ea2").alias("expected_a_squared"), _round("ew").alias("expected_w"))


@query(f"""WITH {T}, x AS (SELECT r AS returns, v AS value, a FROM t WHERE m > 0), n AS (SELECT vec_id, sum(m) AS n, sum(r * m) AS score FROM t GROUP BY vec_id)
 SELECT (SELECT round(avg(score), 6) FROM n) AS score_mean, (SELECT round(max(score), 6) FROM n) AS score_max, (SELECT round(min(score), 6) FROM n) AS score_min, round(avg(a), 6) AS adv_mean, round(max(a), 6) AS adv_max, round(min(a), 6) AS adv_min,
 round(1 - var_samp(returns - value) / (var_samp(returns) + 1e-5), 6) AS explained_var, (SELECT round(avg(n), 6) FROM n) AS length_mean, (SELECT max(n) FROM n) AS length_max, (SELECT round(avg((n >= 63)::INT), 6) FROM n) AS clip_ratio FROM x""")
def data_metrics(spark: SparkSession, d: str) -> DataFrame:
    df = batch(spark, d)
    n = df.select(A.mask_size(F.col("m")).alias("n"), A.masked_sum(F.col("r"), F.col("m")).alias("score")).agg(
        _round(F.avg("score")).alias("score_mean"), _round(F.max("score")).alias("score_max"), _round(F.min("score")).alias("score_min"), _round(F.avg("n")).alias("length_mean"), F.max("n").alias("length_max"), _round(F.avg((F.col("n") >= 63).cast("int"))).alias("clip_ratio")
    )
    t = df.select(F.explode(F.arrays_zip("r", "v", "a", "m")).alias("t")).where("t.m > 0").select("t.*").agg(
        _round(F.avg("a")).alias("adv_mean"), _round(F.max("a")).alias("adv_max"), _round(F.min("a")).alias("adv_min"), _round(1 - F.var_samp(F.col("r") - F.col("v")) / (F.var_samp("r") + 1e-5)).alias("explained_var")
    )
    return n.join(F.broadcast(t))  # one row each


@query(f"WITH {T}, x AS (SELECT exp(old) AS p, exp(new) AS q FROM t WHERE m > 0) SELECT round(max(abs(p - q)), 6) AS max_diff, round(avg(abs(p - q)), 6) AS mean_diff, round(stddev_samp(abs(p - q)), 6) AS std_diff, round(corr(p, q), 6) AS pearson FROM x")
def logprob_differences(spark: SparkSession, d: str) -> DataFrame:
    t = batch(spark, d).select(F.explode(F.arrays_zip("old", "new", "m")).alias("t")).where("t.m > 0").select(F.exp("t.old").alias("p"), F.exp("t.new").alias("q"))
    x = F.abs(F.col("p") - F.col("q"))
    return t.agg(_round(F.max(x)).alias("max_diff"), _round(F.avg(x)).alias("mean_diff"), _round(F.stddev_samp(x)).alias("std_diff"), _round(F.corr("p", "q")).alias("pearson"))


# placement, padding and windows of arrays


@query(f"WITH {T}, l AS (SELECT vec_id, max(i) FILTER (m > 0) AS last FROM t GROUP BY vec_id) SELECT vec_id, i::INT AS pos, CASE WHEN i = last THEN label ELSE 0 END::DOUBLE AS placed FROM t JOIN l USING (vec_id)")
def score_placement(spark: SparkSession, d: str) -> DataFrame:
    return batch(spark, d).select("vec_id", F.posexplode(A.place_at_last(F.col("label").cast("double"), F.col("m"))).alias("pos", "placed"))


@query("SELECT vec_id, len(embedding) + vec_id % 5 AS left_size, round(embedding[20]::DOUBLE, 6) AS mid_first, round(embedding[1]::DOUBLE, 6) AS right_first, round(embedding[64]::DOUBLE, 6) AS left_last, round(embedding[64]::DOUBLE, 6) AS middle_last, round(embedding[5]::DOUBLE, 6) AS middle_fifth, round(embedding[60]::DOUBLE, 6) AS middle_sixth FROM embeddings")
def pad_and_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Padding at the left, and truncation at each side and in the middle."""
    r = F.col("r")
    df = batch(spark, d)
    middle = A.truncate(r, 10, "middle")
    padded = F.concat(F.array_repeat(F.lit(0.0), (F.col("vec_id") % 5).cast("int")), r)
    return df.select(
        "vec_id", F.size(padded).cast("long").alias("left_size"), _round(A.truncate(r, 45, "left")[0]).alias("mid_first"), _round(A.truncate(r, 10, "right")[0]).alias("right_first"),
        _round(F.element_at(A.truncate(r, 45, "left"), -1)).alias("left_last"), _round(F.element_at(middle, -1)).alias("middle_last"), _round(middle[4]).alias("middle_fifth"), _round(middle[5]).alias("middle_sixth"),
    )


@query(f"WITH {T}, e AS (SELECT vec_id, i, (r > 0.3)::INT AS stop FROM t), c AS (SELECT *, sum(stop) OVER (PARTITION BY vec_id ORDER BY i) - stop AS before FROM e) SELECT vec_id, sum((before = 0)::INT)::BIGINT AS kept FROM c GROUP BY vec_id")
def mask_to_first_stop(spark: SparkSession, d: str) -> DataFrame:
    stops = F.transform("r", lambda x: (x > 0.3).cast("int"))
    return batch(spark, d).select("vec_id", F.aggregate(A.mask_to_first(stops, F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("kept"))


@query("SELECT a.vec_id, list_count(list_filter(list_transform(range(1, 65), lambda k: list_count(list_filter(range(1, k + 1), lambda j: (a.embedding[j] > 0) <> (b.embedding[j] > 0)))), lambda x: x = 0))::INT AS lcp FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def common_prefixes(spark: SparkSession, d: str) -> DataFrame:
    signs = batch(spark, d).select("vec_id", F.transform("r", lambda x: x > 0).alias("s"))
    after = signs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("s2"))
    return signs.join(after, "vec_id").select("vec_id", A.common_prefix(F.col("s"), F.col("s2")).alias("lcp"))


_DIST = ("k1", "abs", "k2", "k3")


@query(f"""WITH {T}, k AS (SELECT kind, m, {_KLD} AS x FROM t, (SELECT unnest({list(_DIST)}) AS kind)) SELECT kind, round(min(x) FILTER (m > 0), 6) AS loss_min, round(max(x) FILTER (m > 0), 6) AS loss_max, round(avg(abs(x)) FILTER (m > 0), 6) AS abs_loss FROM k GROUP BY kind""")
def distillation_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Least, greatest and mean size of each distillation loss by name."""
    losses = [F.struct(F.lit(n).alias("kind"), A.zip_map(L.distillation(n), F.col("new"), F.col("ref")).alias("x")) for n in _DIST]
    each = batch(spark, d).select("m", F.explode(F.array(*losses)).alias("k")).select("m", "k.*")
    ranges = each.groupBy("kind").agg(*L.loss_range(F.col("x"), F.col("m")))
    return ranges.select("kind", *[_round(c).alias(c) for c in ("loss_min", "loss_max", "abs_loss")])


@query(f"""WITH {T}, x AS (SELECT vec_id, m, new, a, {_RATIO} AS ratio, m * (abs(new - old) <= ln(1.5))::INT AS kept FROM t),
 l AS (SELECT kept, CASE WHEN a < 0 THEN least(-a * 3, greatest(-a * ratio, -a * least(greatest(ratio, 0.8), 1.2))) ELSE greatest(-a * ratio, -a * least(greatest(ratio, 0.8), 1.2)) END AS clip, -a * new * least(ratio * m, 1.2) AS reinforce FROM x)
 SELECT round(sum(kept * clip) / sum(kept), 6) AS ppo_clip, round(sum(kept * reinforce) / sum(kept), 6) AS reinforce, sum(kept)::DOUBLE AS tokens FROM l""")
def bypassed_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses against the rollout's own probabilities, clipped or weighted, without rejected tokens."""
    df, limits = batch(spark, d), I.parse_thresholds(["token_k1"], 1.5)
    clip = I.bypassed(df, "a", "new", "old", "m", thresholds=limits)
    weighted = I.bypassed(df, "a", "new", "old", "m", "reinforce", "token", 1.2, thresholds=limits)
    loss = lambda out: _round(F.sum(A.masked_sum(F.col("loss"), F.col("kept"))) / F.sum(A.mask_size(F.col("kept"))))
    one = clip.agg(loss(clip).alias("ppo_clip"), F.sum(A.mask_size(F.col("kept"))).cast("double").alias("tokens"))
    return one.join(F.broadcast(weighted.agg(loss(weighted).alias("reinforce")))).select("ppo_clip", "reinforce", "tokens")  # one row each


@query(f"""WITH {T}, p AS (SELECT vec_id, exp(r) AS e FROM t), n AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p), k AS (SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) AS k FROM n),
 q AS (SELECT vec_id, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM k WHERE k > 1) SELECT vec_id, round(-sum(q * ln(q)), 6) AS left_over FROM q GROUP BY vec_id""")
def entropies_after_drop(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of what is left when the likeliest token is taken out, in closed form."""
    p = batch(spark, d).select("vec_id", F.transform("r", lambda x: F.exp(x)).alias("e")).withColumn("z", A.array_sum(F.col("e"))).withColumn("p", F.transform("e", lambda x: x / F.col("z")))
    top, h = F.array_max("p"), -A.array_sum(F.transform("p", lambda x: x * F.ln(x)))
    return p.select("vec_id", _round(N.entropy_after_drop(h, top * F.ln(top), top)).alias("left_over"))
