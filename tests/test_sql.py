"""The functions and views that SQL sees, against the operators."""

import pytest
from pyspark.sql import functions as F

from vaultsieve.functions import sql, text
from vaultsieve.operators import detect, report
from vaultsieve.plans import registry  # noqa: F401, I001
from vaultsieve.plans import corpus

TEXTS = ["", " ", "a", "aaaa", "password", "12345678", "123456789", "AKIA" + "Q" * 16, "aB3dE5gH7jK9mN2pqR4sT6uV8wX1yZ0c", "é中é中é中é中é中é中é中é中é中é中1", "it's \"quoted\" \\ text", None]


@pytest.fixture(scope="module")
def known(spark):
    return sql.register(spark)


def test_scalars_equal_the_operators(spark, known):
    spark.createDataFrame([(t,) for t in TEXTS], "t string").createOrReplaceTempView("texts")
    ours = spark.sql("SELECT t, token_entropy(t) AS e, entropy_confidence(token_entropy(t)) AS c, looks_secret(t) AS s, redact_token(t) AS r, is_skipped_line(t) AS k FROM texts")
    t = F.col("t")
    want = spark.table("texts").select("t", text.entropy(t).alias("e"), detect.entropy_confidence(text.entropy(t)).alias("c"), detect.looks_like_secret(t).alias("s"), report.redacted(t).alias("r"), detect.is_skipped(text.strip(t)).alias("k"))
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, want.collect()))
    assert [r[0] for r in spark.sql("SELECT decision_path(p) FROM VALUES (0.1D), (0.5D), (0.9D) AS v(p)").collect()] == ["low_confidence", "ambiguous", "high_confidence"]


def test_findings_beside_their_lines(spark, known):
    rows = corpus.lines(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([("odd", i, t) for i, t in enumerate([*TEXTS, "  # password = 'aB3dE5gH7jK9mN2pqR4sT6uV8wX1yZ0c'", "A" * 64, "key = 'x' ; key = 'x'"])], "file string, line_no long, line string")
    rows.unionByName(odd).createOrReplaceTempView("lines")
    found = spark.sql("SELECT file, line_no, f.* FROM (SELECT *, findings(line) AS found FROM lines), LATERAL inline(found) AS f")
    want = detect.scan_lines(spark.table("lines")).select(*found.columns)
    assert found.count() == want.count() > 500
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_views_of_fixed_values(spark, known):
    assert spark.sql("SELECT count(DISTINCT type) FROM signatures").first()[0] == 16
    assert spark.sql("SELECT count(*) FROM lines l JOIN signatures s ON l.line rlike s.pattern WHERE s.type = 'AWS_ACCESS_KEY_ID'").first()[0] > 10
    assert spark.table("ignored_names").count() > 10 and "findings" in known
