"""URL rules indexed by their rarest literal token (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm._common import free_name, join_checked, lower_ascii, settle

#: Token that every URL has, for rules without a whole literal token.
ANY = "*"


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))


def _segments(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, verdict, tokens, pattern) of rules "host/path", where "*" in the path is any text.

    A rule fits its host and all subdomains, on paths that begin with its path.
    Tokens are the host's labels and the path's whole segments; the last one,
    which may go on, isn't whole.
    """
    host = F.substring_index("rule", "/", 1)
    path = F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")
    parts = F.split(path, "/")
    whole = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ~x.contains("*"))
    body = F.replace(F.replace(F.col("rule"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    pattern = F.concat(F.lit("(?s)\\A(?:[^/]*\\.)?\\Q"), body, F.when(F.contains("rule", F.lit("/")), F.lit("\\E")).otherwise(F.lit("\\E(?=/|\\z)")))
    return rules.select("rule", "verdict", F.array_distinct(F.concat(_labels(host), _segments(whole))).alias("tokens"), pattern.alias("pattern"))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of `pages`: page_id, host, path, rule, verdict.

    `rules` has columns rule ("host/path", in lower-case host) and verdict. The
    longest fitting rule wins, of equally long ones the last in order of
    characters; without one, rule is null and verdict is `default`. A null URL
    or one without "://" has an empty host and path. Ids may be null or repeat;
    each row is judged by its URL alone. Empty tables are no error.

    Each rule is indexed under the token of its own that the fewest URLs hold;
    a URL's tokens fetch the rules, and only those are tried as regular
    expressions. A URL's rows meet again in the task that made them. An index
    beyond the broadcast bound is joined by a shuffle, whose hot tokens, if a
    rule has no rarer one, are split by AQE.
    """
    row = free_name(pages, "row")
    url = F.col(url_col).cast("string")
    urls = pages.select(F.monotonically_increasing_id().alias(row), F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    tokens = F.array_distinct(F.concat(F.array(F.lit(ANY)), _labels(F.col("host")), _segments(F.split("path", "/"))))
    held = urls.select(row, "page_id", "host", "path", F.explode(tokens).alias("token"))

    table = settle(rule_table(rules), "rules")
    wanted = settle(table.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    counts = join_checked(held.select("token"), wanted, "token", "left_semi").groupBy("token").count()
    rarest = table.select("rule", F.explode("tokens").alias("token")).join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = settle(table.join(rarest, "rule", "left").select(F.coalesce("token", F.lit(ANY)).alias("token"), F.struct(F.length("rule").alias("length"), "rule", "verdict").alias("won"), "pattern"), "index")
    tried = join_checked(held, index, "token", "left")
    fits = F.expr("rlike(concat(host, path), pattern)")
    best = tried.groupBy(row, "page_id", "host", "path").agg(F.max(F.when(fits, F.col("won"))).alias("won"))
    return best.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
