"""Column expressions over token arrays and scalars: masks, divergences, losses, log-probabilities.

Everything is fp64.  A masked mean over no token is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum of ``values`` where ``mask`` is 1, over one array."""
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), _zero(), lambda a, x: a + x)


def mask_count(mask: Column) -> Column:
    return F.aggregate(mask, _zero(), lambda a, m: a + m)


def masked_mean(values: Column, mask: Column) -> Column:
    return F.try_divide(masked_sum(values, mask), mask_count(mask))


def masked_var(values: Column, mask: Column, unbiased: bool = True) -> Column:
    """Variance of the masked tokens of one array; an error for fewer than two tokens when unbiased."""
    mean, n = masked_mean(values, mask), mask_count(mask)
    squares = F.zip_with(values, mask, lambda v, m: m * (v - mean) * (v - mean))
    var = F.try_divide(F.aggregate(squares, _zero(), lambda a, x: a + x), n)
    if not unbiased:
        return var
    return F.when(n < 2, F.raise_error(F.lit("masked variance needs two tokens")).cast("double")).otherwise(var * n / (n - 1))


def eos_mask(tokens: Column, eos: int) -> Column:
    """1 up to and including the first ``eos``, 0 after; all 1 without one."""
    at = F.array_position(tokens, F.lit(eos))
    return F.transform(tokens, lambda t, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Running count of valid tokens, less one, at least 0."""
    upto = lambda i: F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda a, m: a + m.cast("int"))
    return F.transform(mask, lambda m, i: F.greatest(upto(i) - 1, F.lit(0)))


def continued_positions(last: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: last + i)


def last_valid_index(positions: Column, mask: Column) -> Column:
    """First index of the largest masked position, from 0."""
    x = F.zip_with(positions, mask, lambda p, m: p * m)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def scatter_reward(score: Column, valid: Column, length: Column) -> Column:
    """``score`` at the last valid place of an array of ``length``; a length of 0 puts it into the last place."""
    at = F.when(valid == 0, length).otherwise(valid)
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == at, score).otherwise(_zero()))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Token divergence estimators: ``kl``, ``abs``, ``mse``, ``low_var_kl``."""
    d = ref - logp
    if kind == "kl":
        return -d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return clip(F.exp(d) - d - 1, -10, 10)
    raise NotImplementedError(kind)


def penalised_reward(score: Column, logp: Column, ref: Column, ratio: float) -> Column:
    return score - (logp - ref) * F.lit(float(ratio))


def policy_terms(logp: Column, old: Column, advantage: Column, clip_ratio: float = 0.2) -> dict[str, Column]:
    """Per token: the clipped surrogate ``loss``, whether it was ``clipped``, and ``kl`` to the old policy."""
    ratio = F.exp(logp - old)
    plain, bounded = -advantage * ratio, -advantage * clip(ratio, 1 - clip_ratio, 1 + clip_ratio)
    return {"loss": F.greatest(plain, bounded), "clipped": (bounded > plain).cast("double"), "kl": old - logp}


def value_terms(value: Column, old: Column, returns: Column, clip_range: float = 0.5) -> dict[str, Column]:
    """Per token: half the larger squared error of the value and its clipped form, and whether the latter won."""
    near = F.greatest(F.least(value, old + clip_range), old - clip_range)
    plain, bounded = (value - returns) * (value - returns), (near - returns) * (near - returns)
    return {"loss": 0.5 * F.greatest(plain, bounded), "clipped": (bounded > plain).cast("double")}


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, _zero(), lambda a, x: a + F.exp(x - top)))


def token_entropy(logits: Column) -> Column:
    """Entropy of the softmax: log-sum-exp less the expected logit."""
    z = log_sum_exp(logits)
    return z - F.aggregate(logits, _zero(), lambda a, x: a + F.exp(x - z) * x)


def token_logprob(logits: Column, label: Column) -> Column:
    """Log-probability of the label, an index from 0."""
    return F.get(logits, label) - log_sum_exp(logits)


def top_k_logits(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become -inf; ties of the k-th stay."""
    cut = F.get(F.sort_array(logits, asc=False), k - 1)
    return F.transform(logits, lambda x: F.when(x >= cut, x).otherwise(F.lit(float("-inf"))))


def scaled(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda x: x / F.lit(float(temperature)))


def argmax(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def pad_to(x: Column, length: int, pad, left: bool = False) -> Column:
    """Pad an array to ``length``; longer ones stay as they are."""
    more = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(x), F.lit(0)))
    return F.concat(more, x) if left else F.concat(x, more)


def truncated(x: Column, length: int, side: str = "right") -> Column:
    """Cut an array to ``length``: keep its ``left`` or ``right`` end's opposite, or raise an error."""
    if side == "right":
        return F.slice(x, 1, length)
    if side == "left":
        return F.when(F.size(x) > length, F.slice(x, F.size(x) - length + 1, length)).otherwise(x)
    if side == "error":
        return F.when(F.size(x) > length, F.raise_error(F.lit("sequence too long")).cast("array<bigint>")).otherwise(x)
    raise NotImplementedError(side)


def strip_left_pad(x: Column, mask: Column) -> Column:
    """What follows the left padding; an array of padding alone is empty."""
    at = F.array_position(mask, F.lit(1)).cast("int")
    return F.when(at > 0, F.slice(x, at, F.size(x))).otherwise(F.slice(x, 1, 0))


def sft_loss_mask(prompt_length: Column, total: Column, width: Column) -> Column:
    """1 where the next token is a response token: from the prompt's last place, without the last response place."""
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when((i >= prompt_length - 1) & (i < total - 1), 1).otherwise(0))


def shifted_response(x: Column, length: int) -> Column:
    """The slice that lies one place left of the last ``length`` elements."""
    return F.slice(x, F.size(x) - length, length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _zero(), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_schedule(step: Column, warmup: int, total: int, floor: float = 0.0, cycles: float = 0.5) -> Column:
    """Learning-rate factor: linear warm-up, then a cosine down to ``floor``."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    wave = 0.5 * (1 + F.cos(F.lit(3.141592653589793 * cycles * 2) * progress))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(_zero(), wave * (1 - floor) + floor))


def constant_schedule(step: Column, warmup: int) -> Column:
    return F.least(F.lit(1.0), step / F.lit(float(max(1, warmup))))


def adaptive_kl_value(value: float, current: float, target: float, steps: float, horizon: float) -> float:
    """The next coefficient of the adaptive KL controller."""
    error = min(max(current / target - 1, -0.2), 0.2)
    return value * (1 + error * steps / horizon)


def sft_sample(prompt: Column, response: Column, length: int, pad: int, truncation: str = "error") -> Column:
    """Prompt and response as one padded or cut sample: ids, masks and positions of ``length``."""
    both = F.concat(prompt, response)
    ids = pad_to(truncated(both, length, truncation), length, pad)
    valid = F.least(F.size(both), F.lit(length))
    mask = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < valid, 1).otherwise(0))
    loss = sft_loss_mask(F.size(prompt), F.size(both), F.lit(length))
    places = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.least(i, valid - 1))
    return F.struct(ids.alias("input_ids"), mask.alias("attention_mask"), places.alias("position_ids"), F.zip_with(loss, mask, lambda a, b: a * b).alias("loss_mask"))


def stacked_pair(chosen: Column, rejected: Column, length: int, pad: int) -> Column:
    """A preference pair as two rows of ids and masks, each row's mask its own."""
    row = lambda x: pad_to(truncated(x, length), length, pad)
    mask = lambda x: pad_to(F.transform(truncated(x, length), lambda t: F.lit(1)), length, 0)
    return F.struct(F.array(row(chosen), row(rejected)).alias("input_ids"), F.array(mask(chosen), mask(rejected)).alias("attention_mask"))


def causal_mask(mask: Column) -> Column:
    """For each query place, which key places it sees: earlier or equal, and valid."""
    return F.transform(mask, lambda q, i: F.transform(mask, lambda k, j: F.when(j <= i, k).otherwise(0)))


def actor_loss(policy: Column, entropy: Column, entropy_weight: float, divergence: Column | None = None, divergence_weight: float = 0.0) -> Column:
    """The actor's loss: policy loss less weighted entropy, plus weighted divergence from the reference model if given."""
    out = policy - entropy * F.lit(float(entropy_weight))
    return out if divergence is None else out + divergence * F.lit(float(divergence_weight))


def sft_loss(logprobs: Column, mask: Column) -> Column:
    """Mean negative log-probability of the labelled tokens; the first place of ``mask`` belongs to no prediction."""
    shifted = F.slice(mask, 2, F.size(mask))
    return -masked_mean(F.slice(logprobs, 1, F.size(shifted)), shifted)


def unpadded(values: Column, mask: Column) -> Column:
    """The masked elements and their places: ``values, places``."""
    seen = lambda i: F.get(mask, i) == 1
    places = F.filter(F.transform(mask, lambda _, i: i), seen)
    return F.struct(F.filter(values, lambda _, i: seen(i)).alias("values"), places.alias("places"))


def repadded(values: Column, places: Column, width: Column, fill) -> Column:
    """``values`` at their ascending ``places`` in an array of ``width``, ``fill`` elsewhere."""
    gaps = F.transform(places, lambda p, i: p - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1)
    head = F.flatten(F.zip_with(gaps, values, lambda n, v: F.concat(F.array_repeat(F.lit(fill), n.cast("int")), F.array(v))))
    return F.concat(head, F.array_repeat(F.lit(fill), (width - F.size(head)).cast("int")))


def last_token_moved(values: Column, positions: Column, mask: Column) -> Column:
    """The value at the mask's last 1 (the first place without one), put at the largest masked position; 0 elsewhere."""
    behind = F.array_position(F.reverse(mask), F.lit(1))
    source = F.when(behind > 0, F.size(mask) - behind).otherwise(0).cast("int")
    target = last_valid_index(positions, mask)
    return F.transform(values, lambda _, i: F.when(i == target, F.get(values, source)).otherwise(_zero()))


def sampled_token(logits: Column, seed: int, key: Column) -> Column:
    """A token drawn from the softmax by its largest logit with Gumbel noise, which depends on seed, key and place alone."""
    uniform = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, i), 11) + 0.5) / float(1 << 53)
    return argmax(F.transform(logits, lambda x, i: x - F.ln(-F.ln(uniform(i)))))


def next_token(logits: Column, do_sample: Column, seed: int, key: Column) -> Column:
    """Sampled where the row asks for it, else the likeliest."""
    return F.when(do_sample, sampled_token(logits, seed, key)).otherwise(argmax(logits))
