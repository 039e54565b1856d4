"""Policy, value and distillation losses as analytic columns: the value of each token's loss and its aggregation over a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.arrays import MASK_EPS, array_sum, clamp, let, mask_size, masked_mean, masked_sum, zip_map

#: Bound of log ratios before exp.
SAFE = 20.0
TokenLoss = Callable[..., Column]
POLICY: dict[str, TokenLoss] = {}


def register(name: str) -> Callable[[TokenLoss], TokenLoss]:
    def add(f: TokenLoss) -> TokenLoss:
        if name in POLICY and POLICY[name] is not f:
            raise ValueError(f"loss {name} is registered already")
        POLICY[name] = f
        return f

    return add


def log_ratio(new: Column, old: Column) -> Column:
    return clamp(new - old, -SAFE, SAFE)


@register("vanilla")
def vanilla(a: Column, new: Column, old: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> Column:
    """Dual-clip: the worse of the plain and the clipped term, bounded by ``-a c`` where the advantage is negative."""
    ratio = F.exp(log_ratio(new, old))
    worse = F.greatest(-a * ratio, -a * clamp(ratio, 1 - low, 1 + high))
    return F.when(a < 0, F.least(-a * c, worse)).otherwise(worse)


@register("dppo_tv")
def dppo_tv(a: Column, new: Column, old: Column, low: float = 0.2, high: float = 0.2, c: float = 20.0) -> Column:
    """Truncated ratio times log probability, kept where the probability moved at most the allowed distance."""
    moved = F.exp(new) - F.exp(old)
    valid = F.when(a > 0, moved <= high).otherwise(moved >= -low).cast("double")
    return -a * clamp(F.exp(log_ratio(new, old)), high=c) * new * valid


@register("dppo_kl")
def dppo_kl(a: Column, new: Column, old: Column, low: float = 0.2, high: float = 0.2, c: float = 20.0) -> Column:
    """As ``dppo_tv``, with the divergence of taking the token or not as the distance."""
    p, q = F.exp(new), F.exp(old)
    kl = q * (old - new) + (1 - q) * F.ln((1 - q + 1e-8) / (1 - p + 1e-8))
    valid = F.when(a > 0, (kl <= high) | (p <= q)).otherwise((kl <= low) | (p >= q)).cast("double")
    return -a * clamp(F.exp(log_ratio(new, old)), high=c) * new * valid


@register("sapo")
def sapo(a: Column, new: Column, old: Column, pos: float = 1.0, neg: float = 1.05) -> Column:
    """A sigmoid gate of the ratio with a temperature by the advantage's sign."""
    tau = F.when(a > 0, F.lit(pos)).otherwise(F.lit(neg))
    return -a * (4 / tau) / (1 + F.exp(-tau * (F.exp(log_ratio(new, old)) - 1)))


@register("cispo")
def cispo(a: Column, new: Column, old: Column, low: float = 10.0, high: float = 0.2) -> Column:
    return -clamp(F.exp(log_ratio(new, old)), 1 - low, 1 + high) * a * new


@register("gpg")
def gpg(a: Column, new: Column, old: Column) -> Column:
    return -new * a


@register("reinforce")
def reinforce(a: Column, new: Column, old: Column) -> Column:
    return -a * new


def token_losses(kind: str, advantage: Column, new: Column, old: Column, **options: float) -> Column:
    if kind not in POLICY:
        raise ValueError(f"unknown loss {kind}; there are {', '.join(sorted(POLICY))}")
    return zip_map(lambda a, n, o: POLICY[kind](a, n, o, **options), advantage, new, old)


def gspo(advantage: Column, new: Column, old: Column, mask: Column, low: float, high: float) -> Column:
    """Losses with one ratio per sequence: exp of its mean log ratio, at most e^10."""
    mean = masked_sum(zip_map(lambda n, o: n - o, new, old), mask) / F.greatest(mask_size(mask), F.lit(1.0))
    return let(F.exp(clamp(mean, high=10.0)), lambda ratio: F.transform(advantage, lambda a: F.greatest(-a * ratio, -a * clamp(ratio, 1 - low, 1 + high))))


def gmpo(advantage: Column, new: Column, old: Column, mask: Column, low: float, high: float) -> Column:
    """A sequence's loss: minus its mean advantage times the geometric mean of its clipped ratios."""
    def worse(a: Column, n: Column, o: Column) -> Column:
        k, sign = log_ratio(n, o), F.signum(a)
        return F.least(sign * k, sign * clamp(k, -low, high)) * sign
    return -masked_mean(advantage, mask) * F.exp(masked_mean(zip_map(worse, advantage, new, old), mask))


def kl_penalty(new: Column, ref: Column, kind: str) -> Column:
    """Elementwise estimators of KL: k1, abs, k2 (mse), k3 (low_var_kl, log ratio clamped to 20 and the result to 10)."""
    kind = kind.removesuffix("+")
    d = new - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        k = clamp(-d, -SAFE, SAFE)
        return clamp(F.exp(k) - k - 1, -10.0, 10.0)
    raise ValueError(f"unknown estimator {kind}")


def value_loss(pred: Column, returns: Column, old: Column, clip: float) -> Column:
    """Half the larger squared error of the prediction and of the prediction clipped around the old one."""
    clipped = F.greatest(F.least(pred, old + clip), old - clip)
    return 0.5 * F.greatest((pred - returns) * (pred - returns), (clipped - returns) * (clipped - returns))


def aggregate_loss(df: DataFrame, loss: Column, mask: Column, mode: str, horizon: int | None = None) -> Column:
    """The batch's loss of per-token ``loss``, as an aggregate over rows. A row without a token counts in no sequence mean."""
    total, n = masked_sum(loss, mask), mask_size(mask)
    rows = F.greatest(F.lit(1), F.count_if(n > 0))
    if mode == "token-mean":
        return F.sum(total) / F.sum(n)
    if mode == "seq-mean-token-sum":
        return F.sum(total) / rows
    if mode == "seq-mean-token-mean":
        return F.sum(F.when(n > 0, total / (n + MASK_EPS))) / rows
    if mode == "seq-mean-token-sum-norm":
        return F.sum(total) / rows / F.lit(float(horizon))
    raise ValueError(f"unknown mode {mode}")


def entropy(logits: Column) -> Column:
    """Entropy of the distribution that an array of logits stands for."""
    def with_top(top: Column) -> Column:
        z = array_sum(F.transform(logits, lambda x: F.exp(x - top)))
        return F.ln(z) + top - array_sum(F.transform(logits, lambda x: F.exp(x - top) * x)) / z
    return let(F.array_max(logits), with_top)


def sum_pi_squared(logits: Column) -> Column:
    def with_top(top: Column) -> Column:
        z = array_sum(F.transform(logits, lambda x: F.exp(x - top)))
        return array_sum(F.transform(logits, lambda x: F.exp(2 * (x - top)))) / (z * z)
    return let(F.array_max(logits), with_top)


def covariance_tokens(df: DataFrame, ident: str, advantage: str, new: str, mask: str) -> DataFrame:
    """One row per counted token with the product of its advantage's and log probability's distances from their batch means."""
    tokens = df.select(ident, F.posexplode(F.arrays_zip(F.col(advantage).alias("a"), F.col(new).alias("n"), F.col(mask).alias("m"))).alias("pos", "t")).select(ident, "pos", "t.a", "t.n", "t.m").where("m > 0")
    means = tokens.agg(F.avg("a").alias("ma"), F.avg("n").alias("mn"))
    return tokens.join(F.broadcast(means)).withColumn("cov", (F.col("a") - F.col("ma")) * (F.col("n") - F.col("mn"))).select(ident, "pos", "cov")


def top_share(tokens: DataFrame, value: str, share: float, order: list[str]) -> DataFrame:
    """The ``share`` of rows (at least one) with the largest ``value``, ties by ``order``: a distributed top-k."""
    k = max(1, int(tokens.count() * share))
    return tokens.orderBy(F.desc(value), *order).limit(k)



#: Distillation losses of a token by name; the reverse ones take the log probabilities of the token drawn, the forward one arrays of them.
DISTILLATION: dict[str, Callable[..., Column]] = {kind: (lambda student, teacher, kind=kind: kl_penalty(student, teacher, kind)) for kind in ("kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3")}


def register_distillation(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if DISTILLATION.get(name, f) is not f:
            raise ValueError(f"distillation loss {name} is registered already")
        DISTILLATION[name] = f
        return f

    return add


def distillation(name: str) -> Callable[..., Column]:
    if name not in DISTILLATION:
        raise ValueError(f"unknown distillation loss {name}; there are {', '.join(sorted(DISTILLATION))}")
    return DISTILLATION[name]


def loss_range(loss: Column, mask: Column) -> list[Column]:
    """``loss_min, loss_max, abs_loss`` over the masked tokens of all rows, as aggregates."""
    held = F.filter(F.zip_with(loss, mask, lambda x, m: F.when(m > 0, x)), lambda x: x.isNotNull())
    return [F.min(F.array_min(held)).alias("loss_min"), F.max(F.array_max(held)).alias("loss_max"), (F.sum(array_sum(F.transform(held, lambda x: F.abs(x)))) / F.sum(F.size(held))).alias("abs_loss")]


@register_distillation("forward_kl_topk")
def forward_topk(teacher: Column, student: Column, k: int) -> Column:
    """Divergence of the teacher from the student over the teacher's ``k`` likeliest tokens (arrays of log probabilities), at least 0."""
    top = F.slice(F.reverse(F.array_sort(F.zip_with(teacher, student, lambda t, s: F.struct(t.alias("t"), s.alias("s"))))), 1, k)
    return F.greatest(F.lit(0.0), array_sum(F.transform(top, lambda z: F.exp(z["t"]) * (z["t"] - z["s"]))))


def clip_cov_tokens(tokens: DataFrame, ident: str, low: float, high: float, share: float, seed: int) -> DataFrame:
    """Of the tokens whose covariance lies between the bounds a random ``share`` of all tokens, chosen by hash: those that lose their
    gradient."""
    n = int(tokens.count() * share)
    order = F.sha1(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string"), F.lit("|"), F.col("pos").cast("string")))
    return tokens.where((F.col("cov") > low) & (F.col("cov") < high)).orderBy(order, ident, "pos").limit(n)
