"""Rules as data: advertisement filter, curation filters and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.functions.text import blank

# Words, URL parts and title patterns that mark advertisements.
AD_WORDS = (
    "sponsored", "advertisement", "paid content", "paid post", "partner content", "branded content", "promoted", "presented by", "brought to you by", "underwritten by", "[ad]", "[sponsored]",
    "secure your spot", "reserve your spot", "save your spot", "register now", "register today", "sign up now", "sign up today", "join us at", "join us for", "webinar:", "free webinar", "live webinar",
    "upcoming webinar", "virtual event", "virtual summit", "conference registration", "early bird", "early-bird",
    "credit card", "cash back card", "cash back bonus", "best card", "right card", "0% apr", "0% intro", "0% interest", "no interest", "balance transfer", "intro apr", "introductory rate",
    "home equity", "cash out of your home", "mortgage rate", "refinance", "home loan", "equity loan",
    "best cash back", "save hundreds", "save on interest", "avoid interest", "avoid credit card interest", "charging 0% interest", "limited time offer", "act now", "don't miss out",
    "holiday gift", "gift buying", "best deals", "price drop", "flash sale", "clearance", "doorbuster", "black friday", "cyber monday", "prime day",
)
AD_URLS = (
    r"/sponsored/", r"/native/", r"/branded-content/", r"/partner/", r"/advertisement/", r"doubleclick\.net", r"googlesyndication\.com", r"/paid-post/", r"/commercial/", r"/promo/", r"utm_source=paid",
    r"/underwriter/", r"/cnn-underscored/", r"/select/shopping", r"nbcnews\.com/select", r"/reviewed/", r"/advisor/",
)
AD_TITLES = (
    r"^sponsored:", r"^ad:", r"\[sponsored\]", r"\[ad\]", r"paid post:", r"partner content:", r"^promo:",
    r"\$\d+.*cash\s*back", r"cash\s*back.*\$\d+", r"save.*\$\d+", r"\d+%.*interest", r"interest.*\d+%", r"best.*card.*for", r"card.*of\s*(the\s*)?\d{4}", r"top\s*\d+.*cards?", r"cards?\s*charging",
    r"(get|earn).*bonus", r"limited.time", r"act\s*now", r"don'?t\s*miss",
    r"best\s*(deal|price|buy)s?", r"(record.?low|lowest)\s*price", r"save.*on.*purchase", r"\d+%\s*off",
    r"secure your (spot|seat)", r"reserve your (spot|seat)", r"register (now|today|here)", r"sign up (now|today|here)", r"join us (at|for)", r"^webinar:", r"free (webinar|workshop|training)",
    r"upcoming (event|webinar|conference)", r"early.?bird", r"call for (papers|speakers|proposals)",
)
CNN = (r"/cnn-underscored/", r"/specials/", r"cnn\.com/sponsored", r"cnn\.com/partners", r"/deals/", r"/coupons/", r"/reviews/")
AD_SOURCES = {
    "CNN Top": CNN, "CNN World": CNN, "CNN Politics": CNN,
    "Fox News": (r"/lifestyle/", r"/deals/", r"foxnews\.com/category/sponsored"),
    "NBC News": (r"/select/", r"/shopping/", r"nbcnews\.com/shopping"),
    "USA Today": (r"/reviewed/", r"/blueprint/", r"usatoday\.com/deals"),
    "Forbes": (r"/sites/", r"/advisor/", r"forbes\.com/advisor"),
}


def is_ad(title: Column, summary: Column, url: Column, source: Column) -> Column:
    """One pattern for each field, all inside generated code."""
    import re

    words = "|".join(re.escape(w) for w in AD_WORDS)
    out = (F.trim(blank(title)) == "") | blank(url).rlike("|".join(AD_URLS)) | blank(title).rlike("(?i)" + "|".join(f"(?:{p})" for p in AD_TITLES))
    out = out | F.lower(blank(title)).rlike(words) | F.lower(blank(summary)).rlike(words)
    for name, patterns in AD_SOURCES.items():
        out = out | ((blank(source) == name) & blank(url).rlike("|".join(patterns)))
    return out


def curate(items: DataFrame, rules: DataFrame) -> DataFrame:
    """``pos, action, filters``: rules (rule_id, name, action, pattern, enabled)
    with a pattern that fits url, title or summary; hide wins, else the first
    rule's action. The rules are few (they are written by hand) and are sent to
    every task."""
    hit = items.crossJoin(F.broadcast(rules.where("enabled"))).where(F.expr("coalesce(url, '') rlike pattern OR coalesce(title, '') rlike pattern OR coalesce(summary, '') rlike pattern"))
    return hit.groupBy("pos").agg(
        F.when(F.bool_or(F.col("action") == "hide"), "hide").otherwise(F.min_by("action", "rule_id")).alias("action"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("rule_id", "name"))), lambda x: x["name"])).alias("filters"),
    )


def parse_magnitude(title: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(blank(title), r"^M (-?[0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def alerts(items: DataFrame, rules: DataFrame) -> DataFrame:
    """``alert_id, pos``: rules (alert_id, kind, pattern, op, value, enabled). A
    pattern fits as a literal part of title and summary in lower case; a
    threshold compares an earthquake's magnitude."""
    text = F.lower(F.concat_ws(" ", blank(F.col("title")), blank(F.col("summary"))))
    own = items.select("pos", text.alias("text"), F.when(F.col("source_type") == "usgs", parse_magnitude(F.col("title"))).otherwise(0.0).alias("mag"))
    m, v = F.col("mag"), F.col("value")
    above = F.when(F.col("op") == ">", m > v).when(F.col("op") == ">=", m >= v).when(F.col("op") == "<", m < v).when(F.col("op") == "<=", m <= v).when(F.col("op").isin("=", "=="), m == v)
    fits = F.when(F.col("kind") == "pattern", F.col("text").contains(F.lower("pattern"))).when(F.col("kind") == "threshold", (m > 0) & above)
    return own.crossJoin(F.broadcast(rules.where("enabled"))).where(fits).select("alert_id", "pos")


# The filters that are there from the start (enabled ones first).
DEFAULT_PATTERNS = {
    "Ads & Sponsored": ("/sponsored/", "/branded-content/", "/partner/", "/paid-post/", "/advertisement/", r"\[sponsored\]", r"\[ad\]", "paid content", "partner content"),
    "Shopping & Deals": ("/deals/", "/coupons/", "/shopping/", "/reviewed/", "/underscored/", "/select/", "/blueprint/", "best.*deals", "price drop"),
}
DEFAULT_SEMANTIC = {"Clickbait Titles": "dim", "Breaking News Boost": "boost", "Opinion Pieces": "tag"}


def default_rules(spark) -> DataFrame:
    """The pattern filters, enabled, and the semantic ones, which a user enables."""
    rows = [(k, name, "hide", "(?i)" + "|".join(f"(?:{p})" for p in patterns), True) for k, (name, patterns) in enumerate(DEFAULT_PATTERNS.items())]
    rows += [(len(rows) + k, name, action, "", False) for k, (name, action) in enumerate(DEFAULT_SEMANTIC.items())]
    return spark.createDataFrame(rows, "rule_id int, name string, action string, pattern string, enabled boolean")


def rule_stats(items: DataFrame, rules: DataFrame) -> DataFrame:
    """``name, matches`` of each enabled rule."""
    hit = items.join(F.broadcast(rules.where("enabled")), F.expr("coalesce(url, '') rlike pattern OR coalesce(title, '') rlike pattern OR coalesce(summary, '') rlike pattern"))
    return rules.select("name").join(hit.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("matches"))


def shown(items: DataFrame, modes: DataFrame) -> DataFrame:
    """The items that their source's mode (source_name, mode, exposure) lets be
    seen: live and auto all, off none, sample the share ``exposure``, by a hash of
    the id, so that an item is seen always or never. Other sources: all."""
    share = F.pmod(F.crc32(F.encode(F.col("id"), "UTF-8")), F.lit(1000)) / 1000
    own = items.join(modes.select("source_name", "mode", "exposure"), "source_name", "left")
    return own.where(F.col("mode").isNull() | F.col("mode").isin("live", "auto") | ((F.col("mode") == "sample") & (share < F.col("exposure")))).select(items.columns)
