"""Scalar functions as Spark columns: answer parsing, intervals, confidence, identifiers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import vocab

Z95 = NormalDist().inv_cdf(0.975)

# Phrases that mark a refusal, matched in lower case.
REFUSALS = (
    "i cannot",
    "i can't",
    "i can not",
    "i'm unable",
    "i am unable",
    "cannot assist",
    "unable to assist",
    "as an ai",
    "i won't",
    "i will not",
    "i'm not able",
    "i am not able",
    "sorry, i",
    "sorry, but i",
)
# Fixed value: a whole answer is 0, 1, 2, yes or no, perhaps quoted, then perhaps a comma and a confidence, and a full stop.
ANSWER = r"""(?i)^\s*["'`]?\s*([0-2]|yes|no)\s*["'`]?\s*(?:,\s*([0-9]*\.?[0-9]+))?\s*\.?\s*$"""


def answer_token(raw: Column) -> Column:
    """The closed answer in lower case, or '' where the text is not one."""
    return F.lower(F.regexp_extract(raw, ANSWER, 1))


def looks_like_refusal(raw: Column) -> Column:
    low = F.lower(raw)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def _status(raw: Column, good: Column) -> Column:
    return F.when(good, "ok").when(looks_like_refusal(raw), "refused").otherwise("unparseable")


def parse_hand_count(raw: Column) -> Column:
    """struct(value int, status): 0, 1 or 2, else refused or unparseable."""
    token = answer_token(raw)
    good = token.isin("0", "1", "2")
    return F.struct(F.when(good, token.cast("int")).alias("value"), _status(raw, good).alias("status"))


def parse_manipulation(raw: Column) -> Column:
    """struct(value boolean, status): yes or no, else refused or unparseable."""
    token = answer_token(raw)
    good = token.isin("yes", "no")
    return F.struct(F.when(good, token == "yes").alias("value"), _status(raw, good).alias("status"))


def verbalized_confidence(raw: Column) -> Column:
    """struct(kind, value): the stated confidence if it lies in [0, 1], else none."""
    value = F.regexp_extract(raw, ANSWER, 2).try_cast("double")
    good = value.between(0, 1)
    return F.struct(F.when(good, "verbalized").otherwise("none").alias("kind"), F.when(good, value).alias("value"))


def logprob_confidence(logprobs: Column) -> Column:
    """struct(kind, value): exp of the mean token log probability; none for no tokens or a value outside [0, 1]."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / F.size(logprobs)
    value = F.when(F.size(logprobs) > 0, F.exp(mean))
    good = value.between(0, 1)
    return F.struct(F.when(good, "logprob").otherwise("none").alias("kind"), F.when(good, value).alias("value"))


def combine_status(a: Column, b: Column) -> Column:
    """The graver of two statuses."""
    rank = lambda c: F.coalesce(*[F.when(c == s, i) for i, s in enumerate(vocab.SEVERITY)])
    return F.element_at(F.array(*map(F.lit, vocab.SEVERITY)), F.greatest(rank(a), rank(b)) + 1)


def only_if_ok(status: Column, value: Column) -> Column:
    return F.when(status == "ok", value)


def vendor_yes_no(value: Column) -> Column:
    """yes/true and no/false in any case; anything else raises."""
    low = F.lower(value)
    return F.when(low.isin("yes", "true"), True).when(low.isin("no", "false"), False).otherwise(F.raise_error(F.concat(F.lit("not a yes/no label: "), F.coalesce(value, F.lit("null")))).cast("boolean"))


def wilson_lower(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """One-sided lower bound of a proportion; 0 for no trials."""
    z = NormalDist().inv_cdf(confidence)
    p = k / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)).otherwise(F.lit(0.0))


def wilson_interval(k: Column, n: Column, z: float = 1.959964) -> Column:
    """struct(lo, hi), two-sided, clipped to [0, 1]; (0, 1) for no trials."""
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(F.when(n > 0, F.greatest(centre - half, F.lit(0.0))).otherwise(0.0).alias("lo"), F.when(n > 0, F.least(centre + half, F.lit(1.0))).otherwise(1.0).alias("hi"))


def confidence_band(value: Column) -> Column:
    return F.when(value >= vocab.BANDS[0], "high").when(value >= vocab.BANDS[1], "middle").when(value.isNotNull(), "low")


def agrees(a: Column, b: Column) -> Column:
    """True, false, or null where either is missing."""
    return a == b


def qualified_worker(factory: Column, worker: Column) -> Column:
    """Worker numbers restart in each factory: the cluster is both."""
    return F.concat_ws("/", factory, worker)


def n_frames(duration: Column, fps: Column) -> Column:
    return (duration * fps).cast("long")


def frame_id(prefix: str, clip: Column, index: Column) -> Column:
    return F.format_string(f"{prefix}/%s/%08d", clip, index)


def content_id(prefix: str, data: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(data, 256))


def latency_cost(ms: Column, per_hour: float) -> Column:
    return ms / 1000.0 / 3600.0 * per_hour


def days_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 86_400e6


def hash_order(name: str, key: Column, seed: int = vocab.SEED) -> Column:
    """The draw order of a named sample: the md5 of seed, name and key. Any engine can repeat it."""
    return F.md5(F.concat(F.lit(f"{seed}:{name}:"), key.cast("string")).cast("binary"))


def draw(name: str, modulus: Column, *parts: Column, seed: int = vocab.SEED) -> Column:
    """A hashed number below modulus for the parts (12 hex digits of an md5)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), *[p.cast("string") for p in parts]).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), modulus.cast("long"))


def log_factorial(n: Column) -> Column:
    """ln n!: exact below 16, Stirling's series from there (off by less than 1e-11)."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), n.cast("int"))).otherwise(series)


def binomial(u: Column, n: Column, p: float) -> Column:
    """The least k at which the distribution of n trials of probability p (0 < p < 1) reaches u: a draw, for uniform u.
    Ten deviations about the mean are walked, about 20 * sqrt(n p (1 - p)) steps."""
    mean, reach = n * p, 10 * F.sqrt(n * p * (1 - p)) + 10
    lo, hi = F.greatest(F.lit(0), F.floor(mean - reach)).cast("long"), F.least(n, F.ceil(mean + reach)).cast("long")
    first = F.exp(log_factorial(n) - log_factorial(lo) - log_factorial(n - lo) + lo * math.log(p) + (n - lo) * math.log1p(-p))
    state = F.struct(first.alias("mass"), first.alias("sum"), lo.alias("k"))

    def step(s: Column, j: Column) -> Column:
        mass = s["mass"] * (n - j) / (j + 1) * (p / (1 - p))
        return F.struct(mass.alias("mass"), (s["sum"] + mass).alias("sum"), F.when(s["sum"] >= u, s["k"]).otherwise(j + 1).alias("k"))

    return F.when(n > 0, F.aggregate(F.sequence(lo, hi - 1), state, step, lambda s: s["k"])).otherwise(F.lit(0).cast("long"))


def percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def edited(text: Column, edits: list[tuple[str, str]]) -> Column:
    """text with each (find, put) replaced in turn, literally and everywhere: how a prompt becomes its variants."""
    for find, put in edits:
        text = F.replace(text, F.lit(find), F.lit(put))
    return text


def edited_by(text: Column, edits: Column) -> Column:
    """The same with the edits in a column: array of structs (find, put); an empty find changes nothing."""
    return F.aggregate(edits, text, lambda t, e: F.when(e["find"] == "", t).otherwise(F.replace(t, e["find"], e["put"])))


def task_value(task: Column, hands: Column, manipulation: Column) -> Column:
    """The answer to a named task as a boolean: hands_ge_1, hands_eq_2 or manipulation; another name raises."""
    unknown = F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null")))).cast("boolean")
    return F.when(task == "hands_ge_1", hands >= 1).when(task == "hands_eq_2", hands == 2).when(task == "manipulation", manipulation).otherwise(unknown)
