"""Tables that users edit: curation filters, alerts and their matches, the modes
of sources. Each change is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.functions.text import blank

# The alerts that are there from the start.
DEFAULT_ALERTS = (
    ("breaking-news", "Breaking News", "correlation", False, "", "", None, ()),
    ("major-earthquake", "Major Earthquake", "threshold", True, "magnitude", ">=", 6.0, ()),
    ("market-move", "Big Market Move", "threshold", False, "probability_change_24h", ">=", 0.15, ()),
    ("ai-news", "AI/ML News", "semantic", False, "", "", None, ()),
    ("security-breach", "Security Breach", "semantic", False, "", "", None, ()),
    ("political-breaking", "Political Breaking", "semantic", False, "", "", None, ()),
    ("space-launch", "Space Launch", "pattern", False, "", "", None, ("(?i)launch", "(?i)rocket", "(?i)spacex", "(?i)nasa.*mission")),
)


def default_alerts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row[:7], list(row[7])) for row in DEFAULT_ALERTS], "id string, name string, kind string, enabled boolean, field string, op string, value double, patterns array<string>")


def rule_id(name: Column) -> Column:
    return F.replace(F.lower(blank(name)), F.lit(" "), F.lit("-"))


def created(rules: DataFrame, new: DataFrame) -> DataFrame:
    """``rules`` with those of ``new`` (name, action, criteria, created_at, session
    or null), semantic and enabled; a rule of the same id is replaced, and of new
    ones with one id the last by created_at stays (ties: the greatest criteria).
    A rule with a session is shared."""
    own = new.select(rule_id(F.col("name")).alias("id"), "name", "action", "criteria", "created_at", F.lit(True).alias("enabled"), F.col("session").isNotNull().alias("shared"), "session")
    cols = own.columns
    last = own.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("created_at", "criteria", "name", "action")).alias("r")).select("r.*")
    return rules.select(cols).join(last.select("id"), "id", "left_anti").select(cols).unionByName(last)


def switched(rules: DataFrame, column: str, which: DataFrame, to: bool | None = None) -> DataFrame:
    """``rules`` with the flag ``column`` of the ids in ``which`` set, or turned
    over where ``to`` is None; ids that no rule has change nothing."""
    own = rules.join(which.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    new = ~F.col(column) if to is None else F.lit(to)
    return own.withColumn(column, F.when(F.col("_hit"), new).otherwise(F.col(column))).select(rules.columns)


def imported(rules: DataFrame, others: DataFrame) -> DataFrame:
    """``rules`` with copies of ``others`` under ids of their own, private ones."""
    copies = others.withColumns({"id": F.concat("id", F.lit("-imported")), "shared": F.lit(False)}).select(rules.columns)
    return rules.join(copies.select("id"), "id", "left_anti").select(rules.columns).unionByName(copies)


def listed(rules: DataFrame, enabled: bool = False) -> DataFrame:
    return (rules.where("enabled") if enabled else rules).orderBy("created_at", "name", "id")


def shared_in(rules: DataFrame, session: str = "") -> DataFrame:
    return rules.where(F.col("shared") & (F.lit(session == "") | (F.col("session") == session)))


def dismissed(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Matches (alert_id, item_id, at, dismissed) with those of ``items`` (item_id)
    dismissed, whatever their alert."""
    gone = items.select("item_id").distinct().withColumn("_hit", F.lit(True))
    return matches.join(gone, "item_id", "left").withColumn("dismissed", F.col("dismissed") | F.coalesce("_hit", F.lit(False))).select(matches.columns)


def recent_matches(matches: DataFrame, n: int) -> DataFrame:
    return matches.orderBy(F.desc("at"), F.desc("item_id"), F.desc("alert_id")).limit(n)


PREFS_SCHEMA = "source_name string, mode string, exposure double"


def save_prefs(prefs: DataFrame, path: str) -> None:
    """The modes of sources as JSON lines; what was there is replaced."""
    prefs.select("source_name", "mode", "exposure").write.mode("overwrite").json(path)


def load_prefs(spark: SparkSession, path: str) -> DataFrame:
    """The modes of sources; a line that isn't JSON is left out."""
    return spark.read.schema(PREFS_SCHEMA).option("mode", "DROPMALFORMED").json(path)
