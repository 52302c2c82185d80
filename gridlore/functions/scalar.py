"""Column functions: dates, text, numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_of(date: Column) -> Column:
    """January and February belong to the year before."""
    return F.year(date) - F.when(F.month(date) <= 2, 1).otherwise(0)


def kickoff_instant(date: Column, clock: Column, zone: str | Column) -> Column:
    """The instant of a local date and "HH:MM"; a bad clock is midnight. Daylight saving is the zone's."""
    good = F.when(clock.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$"), clock).otherwise("00:00")
    local = F.to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), F.lpad(good, 5, "0")), "yyyy-MM-dd HH:mm")
    return F.to_utc_timestamp(local, zone)


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_hour(ts: Column, zone: str | Column) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone)) + F.minute(F.from_utc_timestamp(ts, zone)) / 60


def utc_offset_hours(ts: Column, zone: str | Column) -> Column:
    return (F.unix_timestamp(F.from_utc_timestamp(ts, zone)) - F.unix_timestamp(ts)) / 3600


def game_key(season: Column, week: Column) -> Column:
    return season * 100 + week


def parse_result(text: Column) -> Column:
    """"W 24-17" as struct(outcome, scored, allowed); null unless it has that form."""
    part = lambda i: F.regexp_extract(text, r"^([WLT])\s+(\d+)-(\d+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("outcome"), part(2).cast("int").alias("scored"), part(3).cast("int").alias("allowed")))


def build_id(season: Column, week: Column, *sides: Column) -> Column:
    return F.concat_ws("_", season.cast("string"), F.lpad(week.cast("string"), 2, "0"), *sides)


def normal_code(text: Column, aliases: Mapping[str, str]) -> Column:
    """Trimmed, upper-cased and mapped by the aliases."""
    code = F.upper(F.trim(text))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), code), code)


def split_ids(text: Column, sep: str = ";") -> Column:
    """The distinct non-empty parts of a list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != ""))


def personnel(text: Column, groups: Sequence[str], default: str | None = None, total: int = 0) -> Column:
    """"1 RB, 2 TE" as a map of counts for the groups; what is missing from `total` goes to `default`."""
    pairs = F.filter(F.transform(F.split(text, ","), lambda x: F.struct(F.regexp_extract(x, r"(\d+)\s+\w+", 1).alias("n"), F.regexp_extract(x, r"\d+\s+(\w+)", 1).alias("g"))), lambda x: x["g"] != "")
    count = lambda g: F.aggregate(pairs, F.lit(0), lambda a, x: a + F.when(x["g"] == g, x["n"].cast("int")).otherwise(0))
    known = {g: count(g) for g in groups}
    if default:
        known[default] = F.greatest(F.lit(total) - sum(v for k, v in known.items() if k != default), F.lit(0))
    return F.create_map(*[x for g, c in known.items() for x in (F.lit(g), c)])


def label_of(counts: Mapping[str, Column], known: Sequence[str], other: str = "other") -> Column:
    """The digits of the counts, if that is a known label."""
    code = F.concat(*[c.cast("string") for c in counts.values()])
    return F.when(code.isin(*known), code).otherwise(other)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def remove_vig(home: Column, away: Column) -> Column:
    """The home side's share of two implied probabilities."""
    return home / (home + away)


def margin_multiplier(margin: Column, winner_edge: Column) -> Column:
    """ln(|margin| + 1) * 2.2 / (0.001 * edge + 2.2): large wins of favourites count less; a tie counts 1."""
    return F.when(margin == 0, 1.0).otherwise(F.log(F.abs(margin) + 1) * 2.2 / (0.001 * winner_edge + 2.2))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(c / (1 - c))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def clock_text(quarter: Column, seconds_left: Column) -> Column:
    """Quarter and game seconds left as "Q4 1:37"."""
    s = seconds_left % 900
    return F.format_string("Q%d %d:%02d", quarter, F.floor(s / 60), s % 60)


def shorten(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 3)), F.lit("..."))).otherwise(text)


def hash_holdout(key: Column, parts: int = 10, part: int = 0) -> Column:
    """Whether the crc32 of the key as text leaves `part`."""
    return F.crc32(key.cast("string")) % parts == part


def member_keys(side: str, ids: Column) -> Column:
    return F.transform(ids, lambda x: F.concat(F.lit(f"{side}|"), x.cast("string")))
