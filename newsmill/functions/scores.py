"""Scores of items, bands of time and other number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URGENT = ("BREAKING", "URGENT", "DEVELOPING", "JUST IN")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def time_band(age_s: Column) -> Column:
    return F.when(age_s < 900, "Just Now").when(age_s < 3600, "Past Hour").when(age_s < 86400, "Today").when(age_s < 172800, "Yesterday").otherwise("Older")


def age_short(age_s: Column) -> Column:
    whole = lambda n: F.floor(age_s / n).cast("string")
    return F.when(age_s < 60, "just now").when(age_s < 3600, F.concat(whole(60), F.lit("m ago"))).when(age_s < 86400, F.concat(whole(3600), F.lit("h ago"))).otherwise(F.concat(whole(86400), F.lit("d ago")))


def age_weeks(age_s: Column) -> Column:
    whole = lambda n: F.floor(age_s / n).cast("string")
    return F.when(age_s < 60, "now").when(age_s < 3600, F.concat(whole(60), F.lit("m"))).when(age_s < 86400, F.concat(whole(3600), F.lit("h"))).when(age_s < 604800, F.concat(whole(86400), F.lit("d"))).otherwise(F.concat(whole(604800), F.lit("w")))


def round6(x: Column) -> Column:
    """A number from 0 to about 1e9 with six decimals, ties up, without the decimal
    text of each that F.round makes."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def tenths(x: Column) -> Column:
    """A number from 0 on with one decimal, rounded by its exact binary value, ties
    to even; ``format_string`` rounds the shortest decimal that names it. Ten times
    x is the sum of two exact terms and the error of their sum is exact, too."""
    a, b = x * 8, x * 2
    total = a + b
    error = b - (total - a)
    low = F.floor(total)
    rest = total - low
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    n = F.when(up, low + 1).otherwise(low)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def whole(x: Column) -> Column:
    """A number without decimals, ties to even."""
    return F.bround(x).cast("bigint").cast("string")


def age_compact(s: Column) -> Column:
    return F.when(s < 0, "0ms").when(s < 1, F.concat(F.floor(s * 1000).cast("string"), F.lit("ms"))).when(s < 60, F.concat(tenths(s), F.lit("s"))).otherwise(F.concat(whole(s / 60), F.lit("m")))


def dur_precision(ms: Column) -> Column:
    return F.when(ms >= 100, 0).when(ms >= 1, 1).otherwise(2)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def activity_bars(n: Column) -> Column:
    return F.when(n >= 10, 4).when(n >= 5, 3).when(n >= 2, 2).when(n >= 1, 1).otherwise(0)


def freshness(age_s: Column, half_life_s: float = 3600.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_s, F.lit(0.0)) / half_life_s)


def source_weight(weight: Column, default: float = 1.0) -> Column:
    return F.least(F.coalesce(weight, F.lit(default)) / 2, F.lit(1.0))


def diversity(count: Column) -> Column:
    return F.when(count < 3, 1.0).otherwise(F.pow(F.lit(0.7), count - 3))


def cluster_score(size: Column) -> Column:
    return F.when(size.isNull() | (size < 2), 0.5).otherwise(0.5 + 0.5 * (1 - 1 / size))


def entity_score(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.5).otherwise(0.5 + 0.4 * (1 - 1 / (n + 1)))


def breaking_score(title: Column, age_s: Column) -> Column:
    return F.when(age_s > 1800, 0.5).when(F.upper(title).rlike("|".join(URGENT)), 0.7 + 0.3 * (1 - age_s / 1800)).otherwise(0.5)


def read_score(read: Column) -> Column:
    return F.when(read, 0.7).otherwise(1.0)


def composite(parts: list[tuple[Column, float]], how: str = "average") -> Column:
    if not parts:
        return F.lit(0.0)
    if how == "max":
        return F.greatest(*[c for c, _ in parts]) if len(parts) > 1 else parts[0][0]
    if how == "min":
        return F.least(*[c for c, _ in parts]) if len(parts) > 1 else parts[0][0]
    if how == "product":
        out = F.lit(1.0)
        for c, _ in parts:
            out = out * c
        return out
    total = sum(w for _, w in parts)
    if not total:
        return F.lit(0.0)
    out = F.lit(0.0)
    for c, w in parts:
        out = out + c * w
    return out / total


def media_score(age_s: Column, semantic: Column, rerank: Column, arousal: Column, negative: Column, varied: Column, w=(0.5, 0.3, 0.4, 0.8)) -> Column:
    decay = 1 / (1 + age_s / 86400)
    raw = 0.3 * semantic + 0.2 * rerank + arousal * w[0] + negative * w[1] + varied * w[2]
    return raw * (1 - (1 - decay) * w[3])


def glitch(value: Column, threshold: float) -> Column:
    return F.when(value < threshold, 0.0).otherwise((value - threshold) / (1 - threshold))


def trend(velocity: Column) -> Column:
    return F.when(velocity > 5, "spiking").when(velocity > 1, "steady").otherwise("fading")


def story_status(hit: Column, miss: Column) -> Column:
    return F.when(miss >= 2, "fading").when((hit >= 4) & (miss == 1), "sustained").when(hit >= 4, "persistent").when(hit >= 2, "developing").otherwise("breaking")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, added up in doubles, as a float; 0 for empty, unlike
    sizes or zero vectors."""
    return cosine_double(a, b).cast("float")


def cosine_double(a: Column, b: Column) -> Column:
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add)
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, F.coalesce(F.try_divide(dot, F.sqrt(norm(a)) * F.sqrt(norm(b))), F.lit(0.0))).otherwise(0.0)


def weight_adjust(weight: Column, up: Column, step: float = 0.05) -> Column:
    """A weight one step up or down, within 0..1."""
    return clamp(F.when(up, weight + step).otherwise(weight - step))


def relevance_label(place: Column, score: Column) -> Column:
    """The label of a reranked story; place counts from 0."""
    return F.when((place < 2) & (score >= 0.8), "MAJOR").when((place < 4) & (score >= 0.6), "TOP").when(score >= 0.5, "RELEVANT").otherwise("NOTED")


STATUSES = ("breaking", "persistent", "sustained", "developing", "fading")


def status_order(status: Column) -> Column:
    out = F.lit(len(STATUSES))
    for k, name in enumerate(STATUSES):
        out = F.when(status == name, k).otherwise(out)
    return out


def story_label(status: Column, hit: Column) -> Column:
    """A careful label: a single hit may be noise."""
    return (
        F.when(status == "breaking", "\u25cf NEW").when(status == "developing", "\u25d0 EMERGING").when((status == "persistent") & (hit >= 6), "\u2605 MAJOR")
        .when(status == "persistent", "\u25c9 ONGOING").when(status == "sustained", "\u25d1 SUSTAINED").when(status == "fading", "\u25cb FADING").otherwise("\u25e6 NOTED")
    )
