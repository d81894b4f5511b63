"""A corpus of source lines made from the orders table, for queries on data that holds what the detectors look for.

The text is input only and reads the same in Spark SQL and in the SQL twins: one line per order, one file per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_U, _V, _H = "translate(md5('a' || k), '0123456789abcdef', 'aB3dE5gH7jK9mN2p')", "translate(md5('b' || k), '0123456789abcdef', 'qR4sT6uV8wX1yZ0c')", "md5('k' || k)"
_Q, _A = "chr(34)", "chr(39)"
_DIGITS = f"translate({_H}, 'abcdef', '012345')"

#: The line of each residue of the order key.
LINES = [
    f"'aws_access_key_id = ' || {_Q} || 'AKIA' || upper(substr({_H}, 1, 16)) || {_Q}",
    f"'github: ghp_' || {_U} || substr({_V}, 1, 4)",
    f"'SLACK=xoxb-' || substr({_DIGITS}, 1, 10) || '-' || substr({_U}, 1, 24)",
    f"'stripe.api_key = ' || {_A} || 'sk_live_' || substr({_U}, 1, 24) || {_A}",
    f"'openai sk-' || {_U} || substr({_V}, 1, 16)",
    f"'  sk-ant-api03-' || {_U} || {_V} || {_U}",
    f"'AIza' || {_U} || substr({_V}, 1, 3)",
    f"'//registry/:_authToken=npm_' || {_U} || substr({_V}, 1, 4)",
    f"'password = pypi-' || {_U} || {_V}",
    "'-----BEGIN RSA PRIVATE KEY-----'",
    f"'hook: https://hooks.slack.com/services/T' || substr({_U}, 1, 9) || '/B' || substr({_V}, 1, 9) || '/' || substr({_U}, 1, 24)",
    f"'https://discord.com/api/webhooks/' || substr({_DIGITS}, 1, 18) || '/' || {_U} || {_V} || substr({_U}, 1, 4)",
    f"'mail SG.' || substr({_U}, 1, 22) || '.' || {_V} || substr({_U}, 1, 11)",
    f"'twilio SK' || {_H}",
    f"'dapi' || {_H}",
    f"'vault hvs.' || {_U} || {_V} || {_U}",
    f"'session_blob = ' || {_Q} || {_U} || substr({_V}, 1, 8) || {_Q}",
    f"'  url = https://cdn.example.com/assets/' || {_U} || {_V} || ' rest'",
    f"{_U} || {_V}",
    f"'# password = ' || {_Q} || {_U} || {_Q}",
    f"'a=AKIA' || upper(substr({_H}, 1, 16)) || ' b=AKIA' || upper(substr(md5('z' || k), 1, 16))",
    f"'secret = ' || {_Q} || {_U} || {_V} || {_Q} || ' ; key = ' || {_Q} || {_U} || {_V} || {_Q}",
    f"'request_uuid = ' || {_Q} || substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-4' || substr({_H}, 13, 3) || '-a' || substr({_H}, 16, 3) || '-' || substr({_H}, 19, 12) || {_Q}",
    f"'commit_sha: ' || {_A} || {_H} || substr(md5('g' || k), 1, 8) || {_A}",
    f"'api_key = ' || {_Q} || 'YOUR_API_KEY_HERE_example' || {_Q}",
    "'   '",
    "'import os and the quick brown fox ' || k || ' jumps over a test'",
    f"'db_password: ' || {_A} || 'hunter' || (k % 100) || {_A}",
    f"'    user = ' || {_Q} || 'admin' || (k % 10) || {_Q} || '  # for the mock'",
    "'def handle_' || k || '(request):'",
    f"'TOKEN = os.getenv(' || {_Q} || 'APP_TOKEN' || {_Q} || ', ' || {_Q} || substr({_U}, 1, 24) || {_Q} || ')'",
    "chr(123) || {Q} || 'client_secret' || {Q} || ': ' || {Q} || {U} || {Q} || ', ' || {Q} || 'version' || {Q} || ': ' || {Q} || 'v1.2.' || (k % 9) || {Q} || chr(125)".replace("{Q}", _Q).replace("{U}", _U),
]
FILES = ["src/app/main.py", "config/settings.yaml", "tests/test_auth.py", "deploy/.env", "build/output/app.min.js", "docs/README.md", "secrets/prod.key", ".git/objects/refs.txt", "web/login.test.ts", "src/CommitHash.java"]

ROWS = (
    "SELECT k, 'repo' || c || '/' || CASE c % 10 "
    + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FILES))
    + " END AS file, CASE k % 32 "
    + " ".join(f"WHEN {i} THEN {line}" for i, line in enumerate(LINES))
    + " END AS line FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) o"
)
#: Lines of a partition, about, where that makes more partitions than the cores ask for.
LINES_A_TASK = 500_000
SQL = f"SELECT file, row_number() OVER (PARTITION BY file ORDER BY k) AS line_no, line FROM ({ROWS}) t"


#: The same rows for Spark. Digests that a line holds more than once, and the residue that chooses it, are columns of their own; a step chooses among few lines, as the JVM leaves a method of many uncompiled (beyond 8,000 bytes of code). A step asks twice for the line of the step before, so that Spark keeps them apart.
_NAMED = {_U: "u", _V: "v", _H: "h"}
_FILE = "'repo' || c || '/' || CASE c % 10 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FILES)) + " END"
STEP = 16


def _made() -> str:
    made = f"SELECT k, file, k % {len(LINES)} AS r, {', '.join(f'{digest} AS {name}' for digest, name in _NAMED.items())}, CAST(NULL AS STRING) AS line FROM {{dealt}}"
    for first in range(0, len(LINES), STEP):
        branches = " ".join(f"WHEN r = {i} THEN {line}" for i, line in enumerate(LINES[first : first + STEP], first))
        for digest, name in _NAMED.items():
            branches = branches.replace(digest, name)
        made = f"SELECT k, file, r, {', '.join(_NAMED.values())}, CASE WHEN line IS NOT NULL THEN line {branches} END AS line FROM ({made})"
    return f"SELECT k, file, line FROM ({made})"


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, file, line; a file's lines in one partition. What is done to lines costs far more than their size tells, so that partitions joined by size would be about as many as cores, or one more and the last alone: their number is given, several for each core. Keys are dealt and lines made behind the shuffle, as a table of few row groups is read by few tasks."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = max(4 * spark.sparkContext.defaultParallelism, orders.count() // LINES_A_TASK)
    return spark.sql(_made(), dealt=orders.selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k", f"{_FILE} AS file").repartition(parts, "file"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line_no, line."""
    return _dealt(spark, sf_dir).select("file", F.row_number().over(Window.partitionBy("file").orderBy("k")).cast("long").alias("line_no"), "line")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, lines: one row per file, as a reader of whole files gives."""
    rows = _dealt(spark, sf_dir).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("rows"))
    return rows.select("file", F.col("rows.line").alias("lines"))
