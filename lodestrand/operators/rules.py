"""Line rules, secrets and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (kind, severity, pattern) in order of precedence; classes are spelled out and nothing looks around, so every engine reads them alike.
SECRETS = (
    ("aws_access_key", "HIGH", "AKIA[0-9A-Z]{16}"),
    ("google_key", "HIGH", "AIza[0-9A-Za-z_-]{35}"),
    ("private_key", "HIGH", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("github_token", "HIGH", "gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack_token", "HIGH", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("db_url_password", "HIGH", "[a-z][a-z0-9+]*://[^:/@ ]+:[^@/ ]+@"),
    ("assigned_secret", "MEDIUM", "(token|secret|password|passwd|api_key|apikey)[ ]*[=:][ ]*[\"'][^\"' ]{8,}[\"']"),
)
#: (category, severity, pattern) of quality rules, first match of a line wins.
QUALITY = (
    ("dangerous_call", "HIGH", "(^|[^A-Za-z0-9_])(eval|exec)[ ]*[(]"),
    ("shouting", "MEDIUM", "(^|[^A-Za-z0-9_])[A-Z]{4,}!!"),
    ("symbol_noise", "MEDIUM", "[$%&#*]{3}"),
    ("license_line", "LOW", "(MIT License|Apache License|General Public License)"),
    ("todo", "LOW", "(^|[^A-Za-z0-9_])(TODO|FIXME|XXX|HACK)([^A-Za-z0-9_]|$)"),
)


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def first_rule(line: Column, rules, what: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(line.rlike(rule[2]), rule[what]).otherwise(out)
    return out


def scan(texts: DataFrame, key: str, text: str, rules) -> DataFrame:
    """A finding for each line that a rule fits: (key, line_no, line, category, severity); one pass, no rule join."""
    found = lines(texts, key, text).withColumn("category", first_rule(F.col("line"), rules, 0))
    return found.where("category is not null").withColumn("severity", first_rule(F.col("line"), rules, 1))


def redacted(text: Column) -> Column:
    out = text
    for _, _, pattern in SECRETS:
        out = F.regexp_replace(out, pattern, "***REDACTED***")
    return out


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).otherwise(2)


def first_wins(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Of rows with equal keys the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
