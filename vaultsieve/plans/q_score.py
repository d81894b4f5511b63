"""Queries on scores, reports, training data, evaluation and service batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultsieve.functions import constants as C
from vaultsieve.operators import dataset, detect, evaluation, features, report, scoring, service
from vaultsieve.plans import corpus, oracle
from vaultsieve.plans.q_features import CAND, FEATURE_SQL, candidates
from vaultsieve.plans.registry import query
from vaultsieve.sources import records
from vaultsieve.sources.package import ship
from vaultsieve.streaming import limiter

#: Scored rows made from orders; the text reads the same in both engines. Scores have three places, so there are ties.
SCORES = (
    "SELECT id, label, source, split, token, kind, CAST(floor(u * 450) + label * 500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score, CAST(floor(v * 700) + label * 300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score_b FROM ("
    "SELECT id, label, source, split, token, kind, CAST(translate(substr(md5('s' || id), 1, 6), 'abcdef', '012345') AS DOUBLE) / CAST(1000000 AS DOUBLE) AS u, CAST(translate(substr(md5('t' || id), 1, 6), 'abcdef', '012345') AS DOUBLE) / CAST(1000000 AS DOUBLE) AS v FROM ("
    "SELECT o_orderkey AS id, CASE WHEN (o_orderkey + o_custkey) % 7 < 2 THEN 1 ELSE 0 END AS label, CASE WHEN o_custkey % 3 = 0 THEN 'synthetic' ELSE 'mined' END AS source, "
    "CASE WHEN o_custkey % 10 < 6 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'val' WHEN o_custkey % 10 = 8 THEN 'cal' ELSE 'test' END AS split, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'AKIA' WHEN 1 THEN 'ghp_' WHEN 2 THEN 'xoxb-' ELSE '' END || substr(md5('r' || (o_orderkey % 900)), 1, 24) AS token, CASE o_orderkey % 4 WHEN 0 THEN 'jwt' WHEN 1 THEN 'git_sha' WHEN 2 THEN NULL ELSE 'uuid' END AS kind FROM orders) a) b"
)
W = f"WITH s AS ({SCORES})"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(SCORES.replace("FROM orders)", "FROM {orders})"), orders=spark.read.parquet(f"{sf}/orders.parquet"))
    return rows.withColumn("label", F.col("label").cast("long")).withColumn("id", F.col("id").cast("long"))


def _r(*columns: str, places: int = 6):
    return [F.round(c, places).alias(c) for c in columns]


def _findings(spark, sf) -> DataFrame:
    return detect.scan_lines(corpus.lines(spark, sf))


# Scores.
_A, _B = -10.0853, 5.1874
_P = f"(1 / (1 + exp({_A}::DOUBLE * score + {_B}::DOUBLE)))"


@query("v_platt_route", f"{W}, p AS (SELECT id, {_P} AS p FROM s) SELECT id, round(p, 6) AS p, p >= 0.15 AS is_secret, round(CASE WHEN p < 0.15 THEN 1 - p ELSE p END, 6) AS ml_confidence, CASE WHEN p < 0.15 THEN 'safe' WHEN p > 0.85 THEN 'blocked' ELSE 'review' END AS routing FROM p")
def v_platt_route(spark, sf):
    made = scores(spark, sf).select("id", scoring.platt(F.col("score"), _A, _B).alias("p"))
    v = scoring.verdict(F.col("p"))
    return made.select("id", F.round("p", 6).alias("p"), v["is_secret"].alias("is_secret"), F.round(v["ml_confidence"], 6).alias("ml_confidence"), v["routing"].alias("routing"))


@query("v_fuse", f"{W} SELECT id, round(CASE WHEN id % 2 = 0 THEN 0.6::DOUBLE * o + 0.4::DOUBLE * score ELSE 0.3::DOUBLE * o + 0.7::DOUBLE * score END, 6) AS confidence FROM (SELECT *, CASE WHEN id % 3 = 0 OR score_b = 0 THEN 0.5::DOUBLE ELSE score_b END AS o FROM s)")
def v_fuse(spark, sf):
    original = F.when(F.col("id") % 3 != 0, F.col("score_b"))
    return scores(spark, sf).select("id", F.round(scoring.fused(original, F.col("score"), F.when(F.col("id") % 2 == 0, "regex").otherwise("entropy")), 6).alias("confidence"))


_MODELS = f"{W}, m AS (SELECT id, CASE WHEN id % 7 <> 3 THEN score END AS a, CASE WHEN id % 5 <> 4 THEN score_b END AS b FROM s)"


def _two(spark, sf):
    return scores(spark, sf).select("id", F.when(F.col("id") % 7 != 3, F.col("score")).alias("a"), F.when(F.col("id") % 5 != 4, F.col("score_b")).alias("b"))


for _name, _sql in {
    "weighted": "CASE WHEN a IS NULL AND b IS NULL THEN 0.5 WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE 0.6::DOUBLE * a + 0.4::DOUBLE * b END",
    "soft": "coalesce(list_avg([x for x in [a, b] if x IS NOT NULL]), 0.5)",
    "hard": "CASE WHEN a IS NULL AND b IS NULL THEN 0.5 WHEN a IS NULL THEN (b >= 0.5)::INT WHEN b IS NULL THEN (a >= 0.5)::INT ELSE (a >= 0.5 AND b >= 0.5)::INT END",
    "surest": "CASE WHEN a IS NULL AND b IS NULL THEN 0.5 WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN abs(b - 0.5) > abs(a - 0.5) THEN b ELSE a END",
}.items():

    def _combine(spark, sf, name=_name):
        return _two(spark, sf).select("id", F.round(getattr(scoring, name)(F.col("a"), F.col("b")).cast("double"), 6).alias("p"))

    query(f"v_ensemble_{_name}", f"{_MODELS} SELECT id, round(CAST({_sql} AS DOUBLE), 6) AS p FROM m")(_combine)


@query("v_two_stage", f"{W} SELECT id, CASE WHEN score < 0.15 THEN 'A_reject' WHEN score > 0.85 THEN 'A_accept' ELSE 'B' END AS stage, CASE WHEN score < 0.15 THEN false WHEN score > 0.85 THEN true ELSE score_b >= 0.35 END AS is_secret FROM s")
def v_two_stage(spark, sf):
    made = scoring.two_stage(F.col("score"), F.col("score_b"))
    return scores(spark, sf).select("id", made["stage"].alias("stage"), made["is_secret"].alias("is_secret"))


@query("v_lazy_stage", f"{W} SELECT CASE WHEN score < 0.15 OR score > 0.85 THEN 'A' ELSE 'B' END AS stage, CASE WHEN score < 0.15 THEN false WHEN score > 0.85 THEN true ELSE score_b >= 0.35 END AS is_secret, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2")
def v_lazy_stage(spark, sf):
    """The second scorer sees the ambiguous rows alone."""
    rows = scores(spark, sf).select("id", F.col("score").alias("score_a"))
    other = scores(spark, sf).select("id", "score_b")
    made = scoring.lazy_two_stage(rows, lambda part: part.join(other, "id"))
    return made.groupBy("stage", "is_secret").agg(F.count(F.lit(1)).alias("n"))


@query("v_api_path", f"{W} SELECT id, CASE WHEN score > 0.85 THEN 'high_confidence' WHEN score < 0.15 THEN 'low_confidence' ELSE 'ambiguous' END AS path FROM s")
def v_api_path(spark, sf):
    return scores(spark, sf).select("id", scoring.decision_path(F.col("score")).alias("path"))


#: A stand-in for a model's score of a finding.
_PSEUDO = "CAST(translate(substr(md5(token), 1, 6), 'abcdef', '012345') AS DOUBLE) / CAST(1000000 AS DOUBLE)"


@query(
    "v_verify",
    f"WITH {oracle.FINDINGS}, p AS (SELECT *, {_PSEUDO} AS p FROM findings), q AS (SELECT *, CASE WHEN evidence = 'regex' THEN confidence ELSE 0.3::DOUBLE * confidence + 0.7::DOUBLE * (CASE WHEN p < 0.15 THEN 1 - p ELSE p END) END AS c FROM p) SELECT file, CAST(line_no AS BIGINT) AS line_no, type, token, CASE WHEN evidence = 'regex' THEN 'regex' ELSE 'hybrid' END AS evidence, round(c, 6) AS confidence FROM q WHERE evidence = 'regex' OR (p >= 0.15 AND c >= 0.5)",
)
def v_verify(spark, sf):
    found = _findings(spark, sf).withColumn("p", F.expr(_PSEUDO))
    return scoring.verified(found).select("file", "line_no", "type", "token", "evidence", F.round("confidence", 6).alias("confidence"))


@query("v_explain", f"""{CAND} SELECT file, line_no, token, CASE WHEN evidence_low THEN 'likely not a secret (20% confidence): ' ELSE 'likely secret (80% confidence): ' END ||
  CASE WHEN evidence_low THEN CASE WHEN g = '' THEN 'based on overall context' ELSE g END ELSE CASE WHEN y = '' THEN 'based on overall context' ELSE y END END AS explanation
  FROM (SELECT *, type = 'ENTROPY_CANDIDATE' AS evidence_low,
    concat_ws(', ', CASE WHEN {oracle.any_match('nm', C.SECRET_NAMES)} THEN 'variable name suggests secret' END, CASE WHEN ent > 4.0 THEN printf('high entropy (%.2f)', ent) END) AS y,
    concat_ws(', ', CASE WHEN regexp_matches(full_text, {oracle.text(C.MENTIONS['git'])}) THEN 'git-related context' END, CASE WHEN regexp_matches(full_text, {oracle.text(C.MENTIONS['hash'])}) THEN 'hash/checksum context' END, CASE WHEN regexp_matches(full_text, {oracle.text(C.MENTIONS['test'])}) THEN 'test/mock context' END) AS g
    FROM cand)""")
def v_explain(spark, sf):
    """With the file features and safe names held at no, which other queries cover."""
    made = {k: v for f in (features.name_flags, features.context_flags, features.ratios) for k, v in f().items()}
    made |= {"file_is_config": F.lit(False), "file_extension_risk": F.lit(0), "file_is_test": F.lit(False), "var_contains_safe": F.lit(False)}
    rows = features.base(candidates(spark, sf)).select("file", "line_no", "token", "type", *[v.alias(k) for k, v in made.items()])
    low = F.col("type") == "ENTROPY_CANDIDATE"
    return rows.select("file", "line_no", "token", scoring.explanation(~low, F.when(low, 0.2).otherwise(0.8)).alias("explanation"))


@query("v_features_map", f"{CAND} SELECT token, CAST(max(n) AS BIGINT) AS token_length, CAST(65 AS BIGINT) AS n_features FROM cand GROUP BY token")
def v_features_map(spark, sf):
    """All features of a candidate as a map by name."""
    rows = features.with_features(candidates(spark, sf).select("file", "line_no", "line", "before", "after", "total_lines", "type", "token"))
    named = rows.select("token", F.map_from_arrays(F.array(*[F.lit(x) for x in features.ORDER]), F.array(*features.ORDER)).alias("m"))
    return named.groupBy("token").agg(F.max(F.col("m")["token_length"]).cast("long").alias("token_length"), F.max(F.size("m")).cast("long").alias("n_features"))


# Reports.
_REDACTED = "CASE WHEN token IS NULL OR trim(token) = '' THEN NULL WHEN length(token) < 8 THEN '[REDACTED]' WHEN length(token) = 8 THEN left(token, 1) || '...' || right(token, 1) WHEN length(token) <= 10 THEN left(token, 2) || '...' || right(token, 2) ELSE left(token, 4) || '...' || right(token, 4) END"


@query("r_redact", f"WITH {oracle.FINDINGS} SELECT file, CAST(line_no AS BIGINT) AS line_no, type, {_REDACTED} AS token FROM findings")
def r_redact(spark, sf):
    return report.redact(_findings(spark, sf)).select("file", "line_no", "type", "token")


@query("r_redact_lengths", f"SELECT c_custkey, {_REDACTED} AS token FROM (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 14 = 13 THEN NULL WHEN c_custkey % 14 = 12 THEN '  ' ELSE substr(md5('x' || c_custkey), 1, (c_custkey % 14)::INT) END AS token FROM customer)")
def r_redact_lengths(spark, sf):
    k = F.col("c_custkey")
    token = F.when(k % 14 == 13, None).when(k % 14 == 12, "  ").otherwise(F.substring(F.md5(F.concat(F.lit("x"), k.cast("string"))), F.lit(1), (k % 14).cast("int")))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", report.redacted(token).alias("token"))


@query("r_gate", f"WITH {oracle.FINDINGS}, w AS (SELECT max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS worst FROM findings WHERE severity <> 'critical') SELECT unnest(['none', 'info', 'medium', 'high', 'critical']) AS level, unnest([false, worst >= 0, worst >= 2, worst >= 3, worst >= 4]) AS failed FROM w")
def r_gate(spark, sf):
    found = _findings(spark, sf).where("severity != 'critical'")
    worst = found.agg(F.max(report.severity_rank(F.col("severity"))).alias("worst"))
    levels = [F.struct(F.lit(x).alias("level"), (F.lit(False) if x == "none" else F.col("worst") >= C.SEVERITIES.index(x)).alias("failed")) for x in ("none", "info", "medium", "high", "critical")]
    return worst.select(F.inline(F.array(*levels)))


@query("r_summary", f"WITH {oracle.FINDINGS} SELECT CAST(count(*) AS BIGINT) AS total_findings, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical, CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high FROM findings")
def r_summary(spark, sf):
    return _findings(spark, sf).agg(*report.counts())


@query("r_totals_quirk", f"WITH {oracle.FINDINGS}, n AS (SELECT file, count(*) AS n FROM corpus GROUP BY file), m AS (SELECT file, max(line_no) AS m FROM findings GROUP BY file) SELECT CAST(count(*) AS BIGINT) AS scanned_files, CAST(sum(coalesce(m, n)) AS BIGINT) AS total_lines FROM n LEFT JOIN m USING (file)")
def r_totals_quirk(spark, sf):
    """A tree scan counts a file with findings up to its last finding, others whole."""
    last = _findings(spark, sf).groupBy("file").agg(F.max("line_no").alias("last"))
    every = corpus.files(spark, sf).select("file", F.size("lines").cast("long").alias("n")).join(last, "file", "left")
    return every.agg(F.count(F.lit(1)).alias("scanned_files"), F.sum(F.coalesce("last", "n")).alias("total_lines"))


_REQUEST = "SELECT file, CAST(line_no AS BIGINT) AS line_no, type, severity, confidence, token, regexp_extract(file, '^repo([0-9]+)', 1)::BIGINT % 20 AS request FROM findings"


@query("r_batch", f"WITH {oracle.FINDINGS}, q AS ({_REQUEST}), f AS (SELECT DISTINCT file, regexp_extract(file, '^repo([0-9]+)', 1)::BIGINT % 20 AS request FROM corpus) SELECT f.request, CAST(count(DISTINCT f.file) AS BIGINT) AS total_files, CAST(count(q.file) AS BIGINT) AS total_findings, CAST(count(*) FILTER (q.confidence > 0.8) AS BIGINT) AS high_confidence_findings FROM f LEFT JOIN q USING (file) GROUP BY f.request")
def r_batch(spark, sf):
    request = (F.regexp_extract("file", "^repo([0-9]+)", 1).cast("long") % 20).alias("request")
    asked = corpus.files(spark, sf).select(request, F.col("file").alias("filename"))
    found = _findings(spark, sf).select(request, F.col("file").alias("filename"), "confidence")
    return service.batch_summary(asked, found).select("request", "total_files", F.col("total_findings").cast("long"), F.col("high_confidence_findings").cast("long"))


@query("r_api", f"WITH {oracle.FINDINGS} SELECT type AS secret_type, coalesce({_REDACTED}, '***') AS token_redacted, CAST(line_no AS BIGINT) AS line_no, substr(stripped, 1, 200) AS snippet, severity, round(confidence, 6) AS confidence FROM findings")
def r_api(spark, sf):
    return _findings(spark, sf).select(*report.response()).withColumn("confidence", F.round("confidence", 6))


@query("r_strings", f"WITH {oracle.FINDINGS} SELECT '[' || upper(severity) || '] ' || type || ' at ' || file || ':' || CAST(line_no AS BIGINT) || ' (evidence: ' || evidence || ')' AS shown FROM findings")
def r_strings(spark, sf):
    return _findings(spark, sf).select(report.finding_text().alias("shown"))


@query("r_json", f"WITH {oracle.FINDINGS} SELECT file, CAST(line_no AS BIGINT) AS line_no, type, substr(stripped, 1, 200) AS snippet, false AS has_token FROM findings")
def r_json(spark, sf):
    """Findings as JSON texts without tokens, read again."""
    found = _findings(spark, sf)
    text = report.as_json(found)
    back = F.from_json(text, "file string, line_no long, type string, snippet string, token string")
    return found.select(back.alias("j"), text.alias("t")).select("j.file", "j.line_no", "j.type", "j.snippet", F.col("t").contains('"token":').alias("has_token"))


@query("r_table", f"WITH {oracle.FINDINGS} SELECT severity, file, CAST(line_no AS BIGINT) AS line_no, type FROM findings")
def r_table(spark, sf):
    """The table as it is shown: by the text of the severity, file and line."""
    return _findings(spark, sf).select("severity", "file", "line_no", "type").orderBy("severity", "file", "line_no", "type")


@query("r_table_all", f"WITH {oracle.FINDINGS} SELECT severity, file, CAST(line_no AS BIGINT) AS line_no, type, coalesce({_REDACTED}, '—') AS secret FROM findings")
def r_table_all(spark, sf):
    """Every finding of the table as it is shown, with the redacted token, by the text of the severity, file and line."""
    found = _findings(spark, sf).select("severity", "file", "line_no", "type", F.coalesce(report.redacted(F.col("token")), F.lit("—")).alias("secret"))
    return found.orderBy("severity", "file", "line_no", "type")


@query("r_cube", f"WITH {oracle.FINDINGS} SELECT severity, evidence, CAST(count(*) AS BIGINT) AS n FROM findings GROUP BY CUBE (severity, evidence)")
def r_cube(spark, sf):
    """An extension: counts by severity, by evidence, by both and in all."""
    return _findings(spark, sf).cube("severity", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query("s_manifest", "SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 = 0")
def s_manifest(spark, sf):
    """What a check of stored contents finds altered if two thirds of the manifest are true."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("models/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    known = docs.select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 3 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return records.altered(docs, known).select("name", F.col("seen").alias("sha256"))


# Training data.
_REC = f"{W}, r AS (SELECT id, label, source, split, token, 'api_key = ' || chr(34) || token || chr(34) AS line_content FROM s)"


def _records(spark, sf) -> DataFrame:
    rows = scores(spark, sf)
    return rows.select("id", "label", "source", "split", "token", "kind", F.concat(F.lit('api_key = "'), "token", F.lit('"')).alias("line_content"))


@query("t_validate", "SELECT CAST(c_custkey AS BIGINT) AS line, CAST((c_custkey % 5 = 0)::INT + (c_custkey % 7 = 0)::INT + (c_custkey % 4 = 3)::INT AS BIGINT) AS n_errors FROM customer")
def t_validate(spark, sf):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(k, F.when(k % 5 != 0, F.lit("t")).alias("token"), F.lit("l").alias("line_content"), F.when(k % 7 != 0, F.array(F.lit("b"))).alias("context_before"), F.array(F.lit("a")).alias("context_after"), (k % 4).alias("m"))
    rows = rows.withColumn("label", F.when(F.col("m") == 3, 2).otherwise(F.col("m") % 2))
    return rows.select(F.col("c_custkey").alias("line"), F.size(dataset.errors(F.col("c_custkey"))).cast("long").alias("n_errors"))


_JSON = (
    "SELECT c_custkey AS k, CASE c_custkey % 11 WHEN 0 THEN chr(123) || 'broken' WHEN 1 THEN '[1, 2]' ELSE chr(123) || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '{q}token{q}: 5, ' WHEN 2 THEN '{q}token{q}: null, ' ELSE '{q}token{q}: {q}t{q}, ' END || CASE c_custkey % 3 WHEN 0 THEN '{q}line_content{q}: [1], ' ELSE '{q}line_content{q}: {q}l{q}, ' END || "
    "CASE c_custkey % 7 WHEN 0 THEN '{q}context_before{q}: {q}b{q}, ' WHEN 1 THEN '' ELSE '{q}context_before{q}: [{q}b{q}], ' END || '{q}context_after{q}: [], {q}label{q}: ' || CASE c_custkey % 6 WHEN 0 THEN '2' WHEN 1 THEN '1.0' WHEN 2 THEN '{q}1{q}' WHEN 3 THEN 'true' WHEN 4 THEN '0' ELSE '1' END || chr(125) END AS text FROM "
).replace("{q}", '"')


@query(
    "t_validate_json",
    f"WITH j AS ({_JSON} customer), o AS (SELECT *, 'Line ' || k || ': ' AS l, CASE WHEN json_valid(text) THEN text END AS v FROM j), m AS (SELECT k, l, v, CASE WHEN json_type(v) = 'OBJECT' THEN list_filter(["
    + ", ".join(f"CASE WHEN json_type(v, '$.{f}') IS NULL THEN 'Missing required field ''{f}''' END" for f in ("token", "line_content", "context_before", "context_after", "label"))
    + ", " + ", ".join(f"CASE WHEN json_type(v, '$.{f}') <> '{t}' THEN '''{f}'' must be a {n}' END" for f, t, n in (("token", "VARCHAR", "string"), ("line_content", "VARCHAR", "string"), ("context_before", "ARRAY", "list"), ("context_after", "ARRAY", "list")))
    + ", CASE WHEN NOT (json_type(v, '$.label') = 'BOOLEAN' OR json_type(v, '$.label') IN ('BIGINT', 'UBIGINT') AND json_extract_string(v, '$.label') IN ('0', '1')) THEN '''label'' must be 0 or 1' END], lambda x: x IS NOT NULL) ELSE ['not a JSON object'] END AS e FROM o) SELECT CAST(k AS BIGINT) AS line, array_to_string([l || x for x in e], chr(10)) AS errors FROM m",
)
def t_validate_json(spark, sf):
    """What is wrong with records as lines of JSON, wrong types included."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), F.expr(_JSON.removeprefix("SELECT c_custkey AS k, ").removesuffix(" AS text FROM ")).alias("text"))
    return rows.select(F.col("k").cast("long").alias("line"), F.array_join(dataset.text_errors(F.col("text"), F.col("k")), "\n").alias("errors"))


@query(
    "t_empty_splits",
    f"{W}, c AS (SELECT label, part, count(*) AS n FROM (SELECT *, id % 400 AS part FROM s WHERE id % 37 = 0 OR id % 400 < 3) GROUP BY ALL) SELECT CAST(label AS BIGINT) AS label, CAST(part AS BIGINT) AS part, split FROM (SELECT label, part, unnest(['train', 'val', 'cal', 'test']) AS split, unnest([floor(n * 0.65::DOUBLE), floor(n * (0.65::DOUBLE + 0.1::DOUBLE)) - floor(n * 0.65::DOUBLE), floor(n * (0.65::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE)) - floor(n * (0.65::DOUBLE + 0.1::DOUBLE)), n - floor(n * (0.65::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE))]) AS size FROM c) WHERE size <= 0",
)
def t_empty_splits(spark, sf):
    """Strata too small for a part in each split."""
    rows = scores(spark, sf).withColumn("part", F.col("id") % 400).where((F.col("id") % 37 == 0) | (F.col("part") < 3))
    return dataset.empty_splits(rows, {"train": 0.65, "val": 0.1, "cal": 0.1, "test": 0.15}, ["label", "part"]).select("label", "part", "split")


@query("t_dedup", f"{_REC} SELECT id, token FROM r QUALIFY row_number() OVER (PARTITION BY sha1(token || '|' || line_content) ORDER BY id) = 1")
def t_dedup(spark, sf):
    return dataset.first_of_each(_records(spark, sf), "id").select("id", "token")


@query("t_label_dist", f"{W} SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(label AS BIGINT) AS label FROM s) GROUP BY label")
def t_label_dist(spark, sf):
    return scores(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("t_type_dist", f"{W} SELECT coalesce(kind, CASE WHEN label = 1 THEN 'unknown_positive' ELSE 'unknown_negative' END) AS type, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1")
def t_type_dist(spark, sf):
    rows = scores(spark, sf).withColumns({"secret_type": F.col("kind"), "negative_type": F.col("kind")})
    return rows.groupBy(dataset.type_key().alias("type")).agg(F.count(F.lit(1)).alias("n"))


def _split_sql(strata: str, cuts: list[tuple[str, str]], last: str) -> str:
    case = " ".join(f"WHEN rn <= floor(n * {c}) THEN '{name}'" for name, c in cuts)
    return f"{W} SELECT id, CASE {case} ELSE '{last}' END AS split FROM (SELECT id, row_number() OVER (PARTITION BY {strata} ORDER BY md5(id || '|42'), id) AS rn, count(*) OVER (PARTITION BY {strata}) AS n FROM s)"


@query("t_split", _split_sql("label", [("train", "0.7::DOUBLE"), ("val", "(0.7::DOUBLE + 0.15::DOUBLE)")], "test"))
def t_split(spark, sf):
    return dataset.split(scores(spark, sf).drop("split"), {"train": 0.7, "val": 0.15, "test": 0.15}, ["label"], "id").select("id", "split")


@query("t_split4", _split_sql("label, source", [("train", "0.65::DOUBLE"), ("val", "(0.65::DOUBLE + 0.1::DOUBLE)"), ("cal", "(0.65::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE)")], "test"))
def t_split4(spark, sf):
    return dataset.split(scores(spark, sf).drop("split"), {"train": 0.65, "val": 0.1, "cal": 0.1, "test": 0.15}, ["label", "source"], "id").select("id", "split")


@query("t_seq_split", f"{W} SELECT id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (ORDER BY md5(id || '|42'), id) AS rn, count(*) OVER () AS n FROM s)")
def t_seq_split(spark, sf):
    """One stratum for all rows, 80/10/10."""
    rows = scores(spark, sf).select("id", F.lit(0).alias("all"))
    return dataset.split(rows, {"train": 0.8, "val": 0.1, "test": 0.1}, ["all"], "id").select("id", "split")


@query("t_kfold", f"{W} SELECT id, CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // q END AS BIGINT) AS fold FROM (SELECT id, rn - 1 AS r, n // 5 AS q, n % 5 AS m FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM s))")
def t_kfold(spark, sf):
    return dataset.folds(scores(spark, sf), 5, ["label"], "id").select("id", "fold")


_PARTS = "tr AS (SELECT * FROM s WHERE split = 'train'), va AS (SELECT * FROM s WHERE split = 'val' AND token NOT IN (SELECT token FROM tr)), ca AS (SELECT * FROM s WHERE split = 'cal' AND token NOT IN (SELECT token FROM tr) AND token NOT IN (SELECT token FROM va)), te AS (SELECT * FROM s WHERE split = 'test' AND token NOT IN (SELECT token FROM tr) AND token NOT IN (SELECT token FROM va) AND token NOT IN (SELECT token FROM ca))"


@query("t_leak_anti", f"{W}, {_PARTS} SELECT split, id FROM (SELECT * FROM tr UNION ALL SELECT * FROM va UNION ALL SELECT * FROM ca UNION ALL SELECT * FROM te)")
def t_leak_anti(spark, sf):
    rows = scores(spark, sf)
    kept, _ = dataset.without_leaks({name: rows.where(F.col("split") == name) for name in ("train", "val", "cal", "test")})
    out = None
    for part in kept.values():
        out = part if out is None else out.unionByName(part)
    return out.select("split", "id")


@query("t_leak_budget", f"{W}, {_PARTS}, b AS (SELECT split, count(*) AS before FROM s GROUP BY split), a AS (SELECT split, count(*) AS after FROM (SELECT split FROM tr UNION ALL SELECT split FROM va UNION ALL SELECT split FROM ca UNION ALL SELECT split FROM te) GROUP BY split) SELECT split, CAST(before AS BIGINT) AS before, CAST(coalesce(after, 0) AS BIGINT) AS after, before - coalesce(after, 0) > 0.2::DOUBLE * before AS over_budget FROM b LEFT JOIN a USING (split)")
def t_leak_budget(spark, sf):
    rows = scores(spark, sf)
    return dataset.without_leaks({name: rows.where(F.col("split") == name) for name in ("train", "val", "cal", "test")})[1]


@query("t_same_records", f"{_REC} SELECT sha1(token || '|' || line_content) AS key, CAST(count(DISTINCT split) AS BIGINT) AS n_splits FROM r GROUP BY 1 HAVING count(DISTINCT split) > 1")
def t_same_records(spark, sf):
    rows = _records(spark, sf)
    return dataset.same_records({name: rows.where(F.col("split") == name) for name in ("train", "val", "cal", "test")})


@query("t_weight", f"{W} SELECT source, round((count(*) - sum(label)) / sum(label) * 1.5::DOUBLE, 6) AS weight FROM s GROUP BY source")
def t_weight(spark, sf):
    return scores(spark, sf).groupBy("source").agg(F.round(dataset.class_weight(1.5), 6).alias("weight"))


@query("t_noise", f"{_REC} SELECT id, flipped, CAST(CASE WHEN flipped THEN 1 - label ELSE label END AS BIGINT) AS label FROM (SELECT *, ('0x' || substr(md5(id || '|42'), 1, 6))::BIGINT / 16777216.0::DOUBLE <= 0.08::DOUBLE AND NOT starts_with(token, 'AKIA') AND NOT starts_with(token, 'ghp_') AS flipped FROM r)")
def t_noise(spark, sf):
    return dataset.noisy(_records(spark, sf), "id").select("id", "flipped", F.col("label").cast("long").alias("label"))


@query("t_contrast", f"{_REC}, c AS (SELECT *, ('0x' || substr(md5(id || '|7'), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u, ('0x' || substr(md5(id || '|7'), 7, 4))::BIGINT % 4 AS w FROM r) SELECT id, CASE WHEN label = 1 THEN ['example_key', 'placeholder_token', 'revoked_token', 'mock_credential'][w + 1] ELSE ['api_key', 'auth_token', 'password', 'secret_key'][w + 1] END || ' = ' || chr(34) || token || chr(34) AS line_content, CAST(0 AS BIGINT) AS label FROM c WHERE u < 0.1::DOUBLE AND NOT (label = 1 AND (starts_with(token, 'AKIA') OR starts_with(token, 'ghp_')))")
def t_contrast(spark, sf):
    return dataset.contrastive(_records(spark, sf), "id").select("id", "line_content", F.col("label").cast("long").alias("label"))


_FLOOR = "CASE WHEN length(t) <= 6 THEN 3.2::DOUBLE WHEN length(t) >= 20 THEN 2.0::DOUBLE ELSE 3.2::DOUBLE - (length(t) - 6) * (1.2::DOUBLE / 14) END"
_FOUND = " UNION ALL ".join(f"SELECT file, line_no, {i} * 100 + unnest(range(len(m))) AS pos, unnest(m) AS t FROM (SELECT *, regexp_extract_all(line, {oracle.text(p)}, 1) AS m FROM corpus)" for i, p in enumerate(dataset.LINE_TOKENS))


@query("t_best_token", f"WITH corpus AS ({corpus.SQL}), f AS ({_FOUND}), g AS (SELECT *, {oracle.entropy('t')} AS e FROM f) SELECT file, CAST(line_no AS BIGINT) AS line_no, t AS token, round(e, 6) AS entropy FROM (SELECT *, row_number() OVER (PARTITION BY file, line_no ORDER BY round(e, 9) DESC, pos) AS rn FROM g WHERE e >= {_FLOOR} AND e > 0 AND NOT regexp_matches(t, {oracle.text(dataset.PLACEHOLDER)})) WHERE rn = 1")
def t_best_token(spark, sf):
    rows = corpus.lines(spark, sf).select("file", "line_no", dataset.best_token(F.col("line")).alias("b"))
    return rows.where("b.token is not null").select("file", "line_no", "b.token", F.round("b.entropy", 6).alias("entropy"))


@query("t_truncate", "SELECT doc_id, substr(text, 1, 2048) AS text FROM documents")
def t_truncate(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", dataset.truncated(F.col("text")).alias("text"))


@query("t_neutral", f"{W} SELECT v AS vendor, bool_or(label = 1) AS in_positive, bool_or(label = 0) AS in_negative, bool_or(label = 1) AND bool_or(label = 0) AS neutralized FROM s, (SELECT unnest(['AKIA', 'ghp_', 'sk_', 'xox']) AS v) WHERE starts_with(token, v) GROUP BY v")
def t_neutral(spark, sf):
    vendor = F.coalesce(*[F.when(F.col("token").startswith(v), v) for v in dataset.VENDORS])
    rows = scores(spark, sf).withColumn("vendor", vendor).where("vendor is not null")
    pos, neg = F.bool_or(F.col("label") == 1), F.bool_or(F.col("label") == 0)
    return rows.groupBy("vendor").agg(pos.alias("in_positive"), neg.alias("in_negative"), (pos & neg).alias("neutralized"))


@query("t_length_div", f"{W} SELECT round(abs(p - n) / greatest(p, n), 6) AS divergence FROM (SELECT avg(length(token)) FILTER (label = 1) AS p, avg(length(token)) FILTER (label = 0) AS n FROM s)")
def t_length_div(spark, sf):
    one = scores(spark, sf).agg(F.avg(F.when(F.col("label") == 1, F.length("token"))).alias("p"), F.avg(F.when(F.col("label") == 0, F.length("token"))).alias("n"))
    return one.select(F.round(F.abs(F.col("p") - F.col("n")) / F.greatest("p", "n"), 6).alias("divergence"))


@query("t_auth_symmetry", f"{CAND} SELECT evidence_label AS label, round(avg(a), 6) AS rate FROM (SELECT CAST((type = 'ML_CANDIDATE') AS BIGINT) AS evidence_label, ({oracle.any_part('lower(full_text)', dataset.AUTH_WORDS)})::INT::DOUBLE AS a FROM cand) GROUP BY 1")
def t_auth_symmetry(spark, sf):
    from vaultsieve.functions.text import contains_any
    from vaultsieve.operators.context import full_context

    rows = candidates(spark, sf).select((F.col("type") == "ML_CANDIDATE").cast("long").alias("label"), contains_any(F.lower(full_context()), dataset.AUTH_WORDS).cast("double").alias("a"))
    return rows.groupBy("label").agg(F.round(F.avg("a"), 6).alias("rate"))


@query("t_corr", f"{CAND} SELECT unnest(['token_length', 'token_entropy']) AS feature, unnest([round(corr(n, y), 6), round(corr(ent, y), 6)]) AS r FROM (SELECT n::DOUBLE AS n, ent, (type NOT IN ('ENTROPY_CANDIDATE', 'ML_CANDIDATE'))::INT::DOUBLE AS y FROM cand)")
def t_corr(spark, sf):
    """Point-biserial correlation of features with the label."""
    rows = features.base(candidates(spark, sf)).withColumn("y", (~F.col("type").isin("ENTROPY_CANDIDATE", "ML_CANDIDATE")).cast("double"))
    one = rows.select("y", *[features.ratios()[f].cast("double").alias(f) for f in ("token_length", "token_entropy")]).agg(*[F.round(F.corr(f, "y"), 6).alias(f) for f in ("token_length", "token_entropy")])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in ("token_length", "token_entropy")])))


_TOKEN_SQL = {f: FEATURE_SQL[f] for f in features.TOKEN_ONLY if f in FEATURE_SQL}


@query(
    "t_corr_all",
    f"{CAND}, v AS (SELECT (type NOT IN ('ENTROPY_CANDIDATE', 'ML_CANDIDATE'))::INT::DOUBLE AS y, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _TOKEN_SQL.items()) + " FROM cand), "
    f"r AS (SELECT unnest({list(_TOKEN_SQL)!r}) AS feature, unnest([" + ", ".join(f"CASE WHEN stddev_pop({k}) > 0 THEN abs(corr({k}, y)) END" for k in _TOKEN_SQL) + "]) AS r FROM v) SELECT feature, round(r, 6) AS r, r > 0.3 AS warning FROM r WHERE r IS NOT NULL",
)
def t_corr_all(spark, sf):
    """How strongly each token feature goes with the label, in one pass; a warning where it alone tells too much. Features that don't vary have none."""
    y = (~F.col("type").isin("ENTROPY_CANDIDATE", "ML_CANDIDATE")).cast("double").alias("y")
    found = candidates(spark, sf).select("file", "line_no", "line", "before", "after", "total_lines", "type", "token")
    rows = features.with_features(found).select(y, *features.TOKEN_ONLY)
    return evaluation.correlations(rows, features.TOKEN_ONLY, "y").select("feature", F.round("r", 6).alias("r"), "warning")


@query("t_passthrough", f"{CAND} SELECT round(avg((starts_with(token, 'AKIA') OR starts_with(token, 'ghp_') OR starts_with(token, 'sk_live_') OR starts_with(token, 'npm_') OR starts_with(token, 'pypi-') OR starts_with(token, 'xoxb-') OR starts_with(token, 'sk-') OR starts_with(token, 'AIza') OR (ent > 3.5 AND least(1.0::DOUBLE, ent / CASE WHEN special THEN 6.5::DOUBLE WHEN hex AND n >= 8 THEN 4.0::DOUBLE ELSE 6.0::DOUBLE END) > 0.7))::INT), 6) AS rate FROM cand WHERE n >= 8")
def t_passthrough(spark, sf):
    rows = features.base(candidates(spark, sf)).where("n >= 8")
    test = (features.vendor()["vendor_prefix_boost"] > 0.5) | ((F.col("ent") > 3.5) & (features.randomness()["normalized_entropy"] > 0.7))
    return rows.agg(F.round(F.avg(test.cast("double")), 6).alias("rate"))


# Evaluation.
_CURVE = f"{W}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg, n FROM g), k AS (SELECT *, tp / (tp + fp)::DOUBLE AS precision, tp / pos::DOUBLE AS recall FROM c), h AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-10) AS f1 FROM k)"


@query("t_pr_curve", f"{_CURVE} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM k")
def t_pr_curve(spark, sf):
    return evaluation.curve(scores(spark, sf)).select("score", F.col("tp").cast("long"), F.col("fp").cast("long"), *_r("precision", "recall"))


@query("t_threshold", f"{_CURVE} SELECT coalesce((SELECT score FROM h WHERE precision >= 0.95::DOUBLE ORDER BY recall DESC, score LIMIT 1), (SELECT score FROM h ORDER BY f1 DESC, score LIMIT 1)) AS threshold")
def t_threshold(spark, sf):
    return evaluation.threshold(scores(spark, sf))


@query("t_dual", f"{_CURVE}, d AS (SELECT coalesce((SELECT score FROM h WHERE recall >= 0.98::DOUBLE ORDER BY precision DESC, score LIMIT 1), 0.15::DOUBLE) AS low, coalesce((SELECT score FROM h WHERE precision >= 0.95::DOUBLE ORDER BY recall DESC, score LIMIT 1), 0.85::DOUBLE) AS high, (SELECT score FROM h ORDER BY f1 DESC, score LIMIT 1) AS optimal) SELECT CASE WHEN low >= high THEN 0.15::DOUBLE ELSE low END AS low, CASE WHEN low >= high THEN 0.85::DOUBLE ELSE high END AS high, optimal FROM d")
def t_dual(spark, sf):
    return evaluation.dual_thresholds(scores(spark, sf))


_CM = "count(*) FILTER (label = 1 AND y)::DOUBLE AS tp, count(*) FILTER (label = 0 AND y)::DOUBLE AS fp, count(*) FILTER (label = 0 AND NOT y)::DOUBLE AS tn, count(*) FILTER (label = 1 AND NOT y)::DOUBLE AS fn"


@query("t_confusion", f"{W}, m AS (SELECT split, {_CM} FROM (SELECT *, score >= 0.5 AS y FROM s) GROUP BY split) SELECT split, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m")
def t_confusion(spark, sf):
    return evaluation.metrics(scores(spark, sf), 0.5, ["split"]).select("split", "tp", "fp", "tn", "fn", *_r("accuracy", "precision", "recall", "f1"))


@query("t_auc", f"{W} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.c * b.c) / (sum(a.c * b.c)), 6) AS auc FROM (SELECT score, count(*)::DOUBLE AS c FROM s WHERE label = 1 GROUP BY score) a, (SELECT score, count(*)::DOUBLE AS c FROM s WHERE label = 0 GROUP BY score) b")
def t_auc(spark, sf):
    return evaluation.auc(scores(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query("t_brier", f"{W} SELECT round(avg((score - label) * (score - label)), 6) AS before, round(avg(({_P} - label) * ({_P} - label)), 6) AS after FROM s")
def t_brier(spark, sf):
    return scores(spark, sf).agg(F.round(evaluation.brier(F.col("score")), 6).alias("before"), F.round(evaluation.brier(scoring.platt(F.col("score"), _A, _B)), 6).alias("after"))


@query("t_routing", f"{W}, p AS (SELECT {_P} AS p FROM s) SELECT CAST(count(*) FILTER (p < 0.15) AS BIGINT) AS safe, CAST(count(*) FILTER (p BETWEEN 0.15 AND 0.85) AS BIGINT) AS review, CAST(count(*) FILTER (p > 0.85) AS BIGINT) AS secret, round(100.0::DOUBLE * count(*) FILTER (p BETWEEN 0.15 AND 0.85) / count(*), 6) AS review_percent FROM p")
def t_routing(spark, sf):
    route = scoring.route(scoring.platt(F.col("score"), _A, _B))
    return scores(spark, sf).agg(F.count_if(route == "safe").alias("safe"), F.count_if(route == "review").alias("review"), F.count_if(route == "blocked").alias("secret"), F.round(100.0 * F.count_if(route == "review") / F.count(F.lit(1)), 6).alias("review_percent"))


@query("t_topk_errors", f"{W}, e AS (SELECT *, CASE WHEN label = 0 AND score >= 0.4 THEN 'fp' WHEN label = 1 AND score < 0.4 THEN 'fn' END AS error FROM s), x AS (SELECT *, count(*) OVER (PARTITION BY error) AS total, row_number() OVER (PARTITION BY error ORDER BY CASE WHEN error = 'fp' THEN -score ELSE score END, id) AS rn FROM e WHERE error IS NOT NULL) SELECT error, id, score, CAST(total AS BIGINT) AS total, CASE WHEN length(token) > 20 THEN left(token, 20) || '...' ELSE token END AS token FROM x WHERE rn <= 10")
def t_topk_errors(spark, sf):
    made = evaluation.top_errors(scores(spark, sf).drop("kind"), 0.4, 10, "id")
    return made.select(F.col("kind").alias("error"), "id", "score", "total", "token")


@query("t_cv_agg", f"{W}, f AS (SELECT id % 5 AS fold, {_CM} FROM (SELECT *, score >= 0.5 AS y FROM s) GROUP BY 1), m AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM f) SELECT round(avg(p), 6) AS mean_precision, round(stddev_pop(p), 6) AS std_precision, round(avg(r), 6) AS mean_recall, round(stddev_pop(r), 6) AS std_recall FROM m")
def t_cv_agg(spark, sf):
    by = evaluation.metrics(scores(spark, sf).withColumn("fold", F.col("id") % 5), 0.5, ["fold"])
    return by.agg(F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.stddev_pop("precision"), 6).alias("std_precision"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.stddev_pop("recall"), 6).alias("std_recall"))


@query("t_meandiff", f"{CAND} , y AS (SELECT type = 'ENTROPY_CANDIDATE' AS g, n::DOUBLE AS token_length, ent AS token_entropy FROM cand), z AS (SELECT 'token_length' AS feature, avg(token_length) FILTER (g) AS a, avg(token_length) FILTER (NOT g) AS b FROM y UNION ALL SELECT 'token_entropy', avg(token_entropy) FILTER (g), avg(token_entropy) FILTER (NOT g) FROM y) SELECT feature, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(a - b, 6) AS difference FROM z")
def t_meandiff(spark, sf):
    rows = features.base(candidates(spark, sf)).select("type", *[features.ratios()[f].cast("double").alias(f) for f in ("token_length", "token_entropy")])
    return evaluation.mean_differences(rows, ["token_length", "token_entropy"], F.col("type") == "ENTROPY_CANDIDATE").select("feature", *_r("mean_a", "mean_b", "difference"))


@query("t_topcount", f"WITH {oracle.FINDINGS} SELECT type, CAST(count(*) AS BIGINT) AS n FROM findings GROUP BY type ORDER BY n DESC, type LIMIT 5")
def t_topcount(spark, sf):
    return _findings(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(5)


@query("t_grid", f"{W}, g AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold), x AS (SELECT 'a' AS config, score AS p, label FROM s UNION ALL SELECT 'b', score_b, label FROM s), c AS (SELECT config, threshold, count(*) FILTER (label = 1 AND p >= threshold)::DOUBLE AS tp, count(*) FILTER (label = 0 AND p >= threshold)::DOUBLE AS fp, sum(label)::DOUBLE AS pos FROM x, g GROUP BY ALL) SELECT config, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos + 1e-10), 6) AS f1, tp / (tp + fp) >= 0.9::DOUBLE AND tp / pos >= 0.9::DOUBLE AS on_target FROM c")
def t_grid(spark, sf):
    made = evaluation.grid(scores(spark, sf), [0.3, 0.5, 0.7], {"a": F.col("score"), "b": F.col("score_b")})
    return made.select("config", "threshold", F.col("tp").cast("long"), F.col("fp").cast("long"), *_r("precision", "recall", "f1"), "on_target")


@query("t_gonogo", f"{W}, m AS (SELECT {_CM} FROM (SELECT *, score >= 0.5 AS y FROM s)), p AS (SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM m) SELECT round(0.3::DOUBLE * ((precision >= 0.88)::INT + (recall >= 0.92)::INT + (f1 >= 0.90)::INT) / 3 + 0.1::DOUBLE * (precision <= 1)::INT, 6) AS weighted_score, NOT (precision >= 0.88 AND recall >= 0.92 AND f1 >= 0.90) AS critical_failure, 'NO-GO' AS decision FROM p")
def t_gonogo(spark, sf):
    """Criteria of two categories; the others weigh nothing here, so that the decision is no."""
    one = evaluation.metrics(scores(spark, sf))
    bounds = evaluation.aggregate_criteria()
    rows = [("aggregate_metrics", "precision", "precision", bounds["precision"], None), ("aggregate_metrics", "recall", "recall", bounds["recall"], None), ("aggregate_metrics", "f1_score", "f1", bounds["f1_score"], None), ("calibration", "bounded", "precision", None, 1.0)]
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"), F.col(m).alias("value"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high")) for c, n, m, lo, hi in rows])
    return evaluation.acceptance(one.select(F.inline(cells)))


_KINDS, _TESTS = list(C.PER_TYPE), list(C.STRESS)
_NEED = "VALUES " + ", ".join(f"('{k}', {r}::DOUBLE, {p}::DOUBLE)" for k, (r, p) in C.PER_TYPE.items())
_BOUNDS = lambda of: "CASE name " + " ".join(f"WHEN '{k}' THEN " + (" AND ".join(x for x in (f"value >= {lo}" if lo is not None else "", f"value <= {hi}" if hi is not None else "") if x)) for k, (lo, hi) in of.items()) + " END"
_ECE = "(SELECT sum(abs(d)) / sum(n) FROM (SELECT sum(score - label) AS d, count(*) AS n FROM {} GROUP BY least(floor(score * 10), 9)))"
_GO = f"""{W}, g AS (SELECT label, score, score >= 0.5 AS y, {_KINDS!r}[CAST(id % 9 AS INT) + 1] AS type, {_TESTS!r}[CAST(id % 8 AS INT) + 1] AS stress, id // 8 % 4 AS variant FROM s),
agg AS (SELECT count(*) FILTER (label = 1 AND y) / count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (label = 1 AND y) / count(*) FILTER (label = 1)::DOUBLE AS r, avg((score - label) * (score - label)) AS brier,
  count(*) FILTER ((score < 0.15 OR score > 0.85) AND y = (label = 1)) / count(*) FILTER (score < 0.15 OR score > 0.85)::DOUBLE AS sure, count(*) FILTER (score < 0.15) / count(*)::DOUBLE AS reject, count(*) FILTER (score > 0.85) / count(*)::DOUBLE AS accept,
  coalesce(count(*) FILTER (score < 0.15 AND label = 1) / nullif(count(*) FILTER (score < 0.15), 0)::DOUBLE, 0) AS fnr, coalesce(count(*) FILTER (score > 0.85 AND label = 0) / nullif(count(*) FILTER (score > 0.85), 0)::DOUBLE, 0) AS fpr FROM g),
sc AS (SELECT score, sum(label) AS p, count(*) AS n FROM g GROUP BY score), cu AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS all_n, sum(p) OVER () AS pos FROM sc WINDOW w AS (ORDER BY score DESC)),
st AS (SELECT stress, count(*) FILTER (label = 1 AND y) / count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (label = 1 AND y) / count(*) FILTER (label = 1)::DOUBLE AS r, count(*) FILTER (y = (label = 1)) / count(*)::DOUBLE AS a, count(*) FILTER (score < 0.15) / count(*)::DOUBLE AS reject FROM g GROUP BY stress),
va AS (SELECT stress, var_pop(r) AS v FROM (SELECT stress, variant, count(*) FILTER (label = 1 AND y) / count(*) FILTER (label = 1)::DOUBLE AS r FROM g GROUP BY stress, variant) GROUP BY stress),
crit AS (
  SELECT 'aggregate_metrics' AS category, name, value, {_BOUNDS({k: (v, None) for k, v in C.AGGREGATE.items()})} AS ok FROM (SELECT unnest(['precision', 'recall', 'f1_score', 'auprc']) AS name, unnest([p, r, 2 * p * r / (p + r), (SELECT sum(p / pos * tp / all_n) FROM cu)]) AS value FROM agg)
  UNION ALL SELECT 'calibration', name, value, {_BOUNDS(C.CALIBRATION)} FROM (SELECT unnest(['ece', 'brier_score', 'high_confidence_accuracy', 'max_feature_importance']) AS name, unnest([{_ECE.format("g")}, brier, sure, 0.12]) AS value FROM agg)
  UNION ALL SELECT 'stage_routing', name, value, {_BOUNDS(C.ROUTING)} FROM (SELECT unnest(['stage_a_reject_rate', 'stage_a_accept_rate', 'stage_b_rate', 'stage_a_reject_fn_rate', 'stage_a_accept_fp_rate']) AS name, unnest([reject, accept, 1 - reject - accept, fnr, fpr]) AS value FROM agg)
  UNION ALL SELECT 'per_type_metrics', type, rec, rec >= need_r AND prec >= need_p FROM (SELECT type, count(*) FILTER (label = 1 AND y) / count(*) FILTER (label = 1)::DOUBLE AS rec, count(*) FILTER (label = 1 AND y) / count(*) FILTER (y)::DOUBLE AS prec FROM g GROUP BY type) JOIN ({_NEED}) need(type, need_r, need_p) USING (type)
  UNION ALL SELECT 'stress_tests', name, value, {_BOUNDS({k: v[1:] for k, v in C.STRESS.items()})} FROM (SELECT stress AS name, CASE stress WHEN 'prefix_collision' THEN p WHEN 'git_sha_masquerading' THEN r WHEN 'context_inversion' THEN a WHEN 'stage_routing_balance' THEN reject WHEN 'confidence_calibration' THEN {_ECE.format("(SELECT * FROM g WHERE stress = 'confidence_calibration')")} WHEN 'adversarial_perturbation' THEN r ELSE v END AS value FROM st JOIN va USING (stress)))
"""
_RULES = "CASE category " + " ".join(f"WHEN '{k}' THEN passed >= {n}" for k, n in C.NEEDED.items()) + " ELSE passed = total END"
_SHARES = "CASE category " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in C.CATEGORY_WEIGHTS.items()) + " END"


def _release(spark, sf) -> DataFrame:
    k = F.col("id")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (k % n).cast("int"))
    rows = scores(spark, sf).select("label", "score", pick(_KINDS, 9).alias("type"), pick(_TESTS, 8).alias("stress"), (F.floor(k / 8) % 4).alias("variant"))
    return evaluation.release_criteria(rows, importance=0.12)


@query("t_release", f"{_GO} SELECT category, name, round(value, 6) AS value FROM crit")
def t_release(spark, sf):
    """The value of every criterion of the five categories."""
    return _values(_release(spark, sf))


def _values(criteria: DataFrame) -> DataFrame:
    """One row a criterion: of a type, its recall, which comes first."""
    need = F.create_map(*[F.lit(x) for k, (r, _) in C.PER_TYPE.items() for x in (k, r)])
    recall = (F.col("category") != "per_type_metrics") | (F.col("low") == F.element_at(need, F.col("name")))
    return criteria.where(recall).select("category", "name", F.round("value", 6).alias("value"))


@query("t_release_categories", f"{_GO}, c AS (SELECT category, count(*) FILTER (ok) AS passed, count(*) AS total FROM crit GROUP BY category) SELECT category, CAST(passed AS BIGINT) AS passed, CAST(total AS BIGINT) AS total, {_RULES} AS enough, {_SHARES} AS weight FROM c")
def t_release_categories(spark, sf):
    """The five categories: how many of their criteria pass, and whether that is enough."""
    return evaluation.categories(_release(spark, sf), C.NEEDED).select("category", "passed", "total", "enough", "weight")


@query("t_release_decision", f"{_GO}, c AS (SELECT category, count(*) FILTER (ok) AS passed, count(*) AS total FROM crit GROUP BY category), d AS (SELECT round(sum({_SHARES} * passed / total), 6) AS weighted_score, bool_or(category = 'aggregate_metrics' AND passed < total) AS critical_failure FROM c) SELECT *, CASE WHEN weighted_score >= 0.85 AND NOT critical_failure THEN 'GO' ELSE 'NO-GO' END AS decision FROM d")
def t_release_decision(spark, sf):
    """Whether a model with these scores is released."""
    return evaluation.acceptance(_release(spark, sf), C.NEEDED)



# Service.
@query("w_rate_window", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM events")
def w_rate_window(spark, sf):
    return service.requests_in_window(spark.read.parquet(f"{sf}/events.parquet"), 3600).select("event_id", "in_window")


_EXACT = """WITH RECURSIVE e AS (SELECT user_id AS client, event_id, epoch_us(ts) / 1e6::DOUBLE AS t0, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events), r AS (
  SELECT client, event_id, t0, rn, true AS allowed, 1::BIGINT AS remaining, 0::BIGINT AS retry_after, [t0] AS times FROM e WHERE rn = 1
  UNION ALL
  SELECT client, event_id, t0, rn, len(k) < 2, CASE WHEN len(k) < 2 THEN 1 - len(k) ELSE 0 END, CASE WHEN len(k) < 2 THEN 0 ELSE greatest(1, CAST(floor(k[1] + 86400 - t0) AS BIGINT) + 1) END, CASE WHEN len(k) < 2 THEN list_append(k, t0) ELSE k END
  FROM (SELECT e.*, list_filter(r.times, lambda t: t > e.t0 - 86400) AS k FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1)
) SELECT client, event_id, t0 AS "at", allowed, CAST(remaining AS INT) AS remaining, CAST(retry_after AS INT) AS retry_after FROM r"""


@query("w_rate_exact", _EXACT)
def w_rate_exact(spark, sf):
    """Decisions of the exact limiter on the events table; the streaming form keeps the same state."""
    ship(spark)
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("client"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return limiter.limit(events, 86400, 2)


@query("w_limits", "WITH q AS (SELECT doc_id % 10 AS request, source AS filename, text FROM documents) SELECT request, filename, '400 duplicate filename' AS error FROM q GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT request, NULL, '413 too many files' FROM q GROUP BY request HAVING count(*) > 20 UNION ALL SELECT request, filename, '413 file too large' FROM q WHERE strlen(text) > 20000")
def w_limits(spark, sf):
    asked = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") % 10).alias("request"), F.col("source").alias("filename"), F.col("text").alias("content"))
    return service.request_errors(asked, 20, 20000)


_PROMPT_NAME = "CASE " + " ".join(f"WHEN regexp_matches(line, {oracle.text(p)}) THEN regexp_extract(line, {oracle.text(p)}, 1)" for p in service.NAMES) + " END"


@query("w_var", f"WITH corpus AS ({corpus.SQL}) SELECT file, CAST(line_no AS BIGINT) AS line_no, {_PROMPT_NAME} AS name FROM corpus")
def w_var(spark, sf):
    return corpus.lines(spark, sf).select("file", "line_no", service.prompt_name(F.col("line")).alias("name"))


_PROMPT = f"""{CAND}, p AS (SELECT file, line_no, token, type, 'TOKEN: ' || coalesce({_REDACTED}, '***') || chr(10) || 'TYPE: ' || type || chr(10) || 'VARIABLE: ' || coalesce({_PROMPT_NAME}, 'unknown') || chr(10) || 'FILE: ' || file || chr(10) || 'CONTEXT:' || chr(10) ||
  array_to_string(list_concat(list_concat(b, ['>>> ' || line]), a), chr(10)) || chr(10) || 'Real secret or false positive? Answer in JSON.' AS prompt FROM (SELECT c.*, fl.ls[greatest(line_no - 3, 1):line_no - 1] AS b, fl.ls[line_no + 1:line_no + 3] AS a FROM cand c JOIN fl USING (file)))"""


def _prompts(spark, sf) -> DataFrame:
    return candidates(spark, sf).withColumn("prompt", service.prompt())


@query("w_prompt", f"{_PROMPT} SELECT file, line_no, token, prompt FROM p")
def w_prompt(spark, sf):
    return _prompts(spark, sf).select("file", "line_no", "token", "prompt")


@query("w_batches", f"{_PROMPT}, b AS (SELECT file, prompt, (row_number() OVER (PARTITION BY file ORDER BY line_no, type, token) - 1) // 5 AS batch FROM p) SELECT file, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(prompt)) AS BIGINT) AS n_chars FROM b GROUP BY file, batch")
def w_batches(spark, sf):
    made = service.prompt_batches(_prompts(spark, sf), "file", ["line_no", "type", "token"])
    return made.select("file", "batch", F.size("prompts").cast("long").alias("n"), F.aggregate("prompts", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"))


_ANSWERS = ['{"is_secret": false, "confidence": 0.9, "reasoning": "a digest"}', '```json\n{"is_secret": true, "confidence": 0.7}\n```', "This is a false positive, I think.", "Looks like it is a secret", '```\n{"confidence": 0.2}\n```', "{broken"]
_READ = [(False, 0.9, "a digest"), (True, 0.7, "No explanation provided"), (False, 0.5, "This is a false positive, I think."), (True, 0.5, "Looks like it is a secret"), (True, 0.2, "No explanation provided"), (True, 0.5, "{broken")]


@query("w_parse", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, " + ", ".join(f"CASE c_custkey % 6 {' '.join(f'WHEN {i} THEN {form(r[j])}' for i, r in enumerate(_READ))} END AS {n}" for j, (n, form) in enumerate([("is_secret", lambda x: str(x).lower()), ("confidence", lambda x: f"{x}::DOUBLE"), ("reasoning", oracle.text)])) + " FROM customer")
def w_parse(spark, sf):
    """The twin knows what each answer says; the query reads it."""
    content = F.get(F.array(*[F.lit(x) for x in _ANSWERS]), (F.col("c_custkey") % 6).cast("int"))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", content.alias("content"))
    return rows.select("c_custkey", *[v.alias(k) for k, v in service.answer(F.col("content")).items()])


@query("w_parse_batch", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN [false, true, true] WHEN 1 THEN [true, true, true] ELSE [false, false, false] END) AS is_secret, unnest(CASE c_custkey % 3 WHEN 0 THEN [0.9, 0.5, 0.5] WHEN 1 THEN [0.5, 0.5, 0.5] ELSE [0.1, 0.1, 0.1] END)::DOUBLE AS confidence FROM customer")
def w_parse_batch(spark, sf):
    one = '{"is_secret": false, "confidence": 0.1}'
    content = F.get(F.array(F.lit('[{"is_secret": false, "confidence": 0.9}]'), F.lit("no list"), F.lit(f"[{one},{one},{one},{one}]")), (F.col("c_custkey") % 3).cast("int"))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.inline(service.batch_answers(content, F.lit(3))))
