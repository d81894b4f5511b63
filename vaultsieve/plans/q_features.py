"""Queries on contexts and features."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultsieve.functions import constants as C
from vaultsieve.operators import context, detect, features
from vaultsieve.plans import corpus, oracle
from vaultsieve.plans.oracle import any_match, any_part, any_start, entropy, text
from vaultsieve.plans.registry import query

_FILES = f"corpus AS ({corpus.SQL}), fl AS (SELECT file, list(line ORDER BY line_no) AS ls FROM corpus GROUP BY file)"
_CTX = f"WITH {_FILES}, x AS (SELECT c.file, CAST(line_no AS BIGINT) AS line_no, line, ls, len(ls) AS total, array_to_string(ls[greatest(line_no - 3, 1):line_no + 3], chr(10)) AS full_text FROM corpus c JOIN fl ON c.file = fl.file)"


def _contexts(spark, sf) -> DataFrame:
    return context.contexts(corpus.files(spark, sf))


@query("c_window3", f"{_CTX} SELECT file, line_no, line, array_to_string(ls[greatest(line_no - 3, 1):line_no - 1], chr(10)) AS before, array_to_string(ls[line_no + 1:line_no + 3], chr(10)) AS after, full_text FROM x")
def c_window3(spark, sf):
    return _contexts(spark, sf).select("file", "line_no", "line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"), context.full_context().alias("full_text"))


@query("c_window3_rows", f"WITH corpus AS ({corpus.SQL}) SELECT a.file, CAST(a.line_no AS BIGINT) AS line_no, CAST(count(*) AS BIGINT) AS n_near, CAST(sum(strlen(b.line)) AS BIGINT) AS n_bytes FROM corpus a JOIN corpus b ON a.file = b.file AND abs(a.line_no - b.line_no) <= 3 GROUP BY 1, 2")
def c_window3_rows(spark, sf):
    """The same neighbourhood for sources that come as one row per line: a window frame, not a range join."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(-3, 3)
    return corpus.lines(spark, sf).select("file", "line_no", F.count(F.lit(1)).over(w).alias("n_near"), F.sum(F.octet_length("line")).over(w).cast("long").alias("n_bytes"))


@query("c_total_lines", f"WITH corpus AS ({corpus.SQL}) SELECT file, CAST(count(*) AS BIGINT) AS total_lines FROM corpus GROUP BY file")
def c_total_lines(spark, sf):
    return corpus.files(spark, sf).select("file", F.size("lines").cast("long").alias("total_lines"))


def _name_sql() -> str:
    branches = " ".join(f"WHEN regexp_matches(pre, {text(p)}) THEN regexp_extract(pre, {text(p)}, 1)" for p in C.NAME_PATTERNS)
    return f"CASE {branches} END"


#: Candidates with what the features need.
CAND = f"""WITH {oracle.FINDINGS}, fl AS (SELECT file, list(line ORDER BY line_no) AS ls FROM corpus GROUP BY file),
c0 AS (SELECT f.file, CAST(f.line_no AS BIGINT) AS line_no, f.type, f.token, f.line, length(f.token) AS n, {entropy("f.token")} AS ent, len(ls) AS total, lower(f.file) AS path,
  array_to_string(ls[greatest(f.line_no - 3, 1):f.line_no + 3], chr(10)) AS full_text, substr(f.line, 1, strpos(f.line, f.token) - 1) AS pre, substr(f.line, strpos(f.line, f.token) + length(f.token)) AS post
  FROM findings f JOIN fl ON f.file = fl.file),
c1 AS (SELECT *, {_name_sql()} AS name FROM c0),
cand AS (SELECT *, coalesce(name, '') AS nm, regexp_matches(token, '^[0-9a-fA-F]*$') AS hex, regexp_matches(token, '[^a-zA-Z0-9]') AS special FROM c1)
"""


def candidates(spark, sf, once: bool = False) -> DataFrame:
    return detect.scan_lines(_contexts(spark, sf), once)


#: The SQL of each feature of a family.
FEATURE_SQL: dict[str, str] = {}


def family(name: str, columns: dict[str, str], *functions) -> None:
    """A query of some feature columns and its twin; booleans stay booleans, counts are long, reals are rounded."""
    kinds = {k: v.split(":", 1)[0] for k, v in columns.items()}
    FEATURE_SQL.update({k: v.split(":", 1)[1] for k, v in columns.items()})
    cast = {"b": "CAST({} AS BOOLEAN)", "i": "CAST({} AS BIGINT)", "d": "round(CAST({} AS DOUBLE), 6)"}
    sql = ", ".join(cast[v.split(":", 1)[0]].format(v.split(":", 1)[1]) + f" AS {k}" for k, v in columns.items())

    @query(name, f"{CAND} SELECT file, line_no, type, token, {sql} FROM cand")
    def run(spark, sf):
        made = {k: v for f in functions for k, v in f().items()}
        shown = {"b": lambda x: x.cast("boolean"), "i": lambda x: x.cast("long"), "d": lambda x: F.round(x.cast("double"), 6)}
        return features.base(candidates(spark, sf)).select("file", "line_no", "type", "token", *[shown[kinds[k]](made[k]).alias(k) for k in columns])


_share = lambda p: f"len(regexp_extract_all(token, {text(p)})) / greatest(n, 1)::DOUBLE"
_CLASSES = "(regexp_matches(token, '[a-z]')::INT + regexp_matches(token, '[A-Z]')::INT + regexp_matches(token, '[0-9]')::INT + special::INT)"
_B64 = "(n >= 4 AND greatest(len(regexp_extract_all(token, '[A-Za-z0-9+/=]')), len(regexp_extract_all(token, '[A-Za-z0-9_=-]'))) / n::DOUBLE >= 0.95)"

family("f_ratios", {"token_length": "i:n", "token_entropy": "d:ent", "char_class_count": f"i:{_CLASSES}", "digit_ratio": f"d:{_share('[0-9]')}", "uppercase_ratio": f"d:{_share('[A-Z]')}", "special_char_ratio": f"d:{_share('[^a-zA-Z0-9]')}"}, features.ratios)
family("f_base64_hex", {"is_base64_like": f"b:{_B64}", "has_padding": "b:ends_with(token, '=')"}, features.base64_and_padding)
family("f_match_type", {"regex_match_type": "i:CASE WHEN type = 'ENTROPY_CANDIDATE' THEN 0 WHEN type = 'OPENAI_API_KEY' THEN 4 WHEN type = 'SLACK_TOKEN' THEN 5 WHEN type = 'GCP_API_KEY' THEN 6 WHEN type = 'AWS_ACCESS_KEY_ID' THEN 1 ELSE 9 END"}, features.match_type)
#: Without back-references: four equal characters are four of any one that the token holds.
_RUN4 = "len([x for x in list_distinct(string_split(token, '')) if contains(token, repeat(x, 4))]) > 0"
_SHAPE = f"(CASE WHEN n < 4 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (CASE WHEN {_RUN4} THEN 0.25::DOUBLE ELSE 0 END) + least(0.3::DOUBLE, len(regexp_extract_all(token, '[A-Za-z]{{4,}}')) * 0.1::DOUBLE) + (CASE WHEN regexp_matches(token, '[-_./]{{2,}}') THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(token, 'v?[0-9]+\\.[0-9]+') THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(lower(token), 'example|sample|test|demo|fake|xxxx|0000|placeholder|your') THEN 0.1::DOUBLE ELSE 0 END)) END)"
family("f_structure", {"token_structure_score": f"d:{_SHAPE}", "has_version_pattern": f"b:{any_match('token', C.VERSIONS)}"}, features.structure)
_NORM = f"(CASE WHEN n < 4 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ent / (CASE WHEN special THEN 6.5::DOUBLE WHEN n >= 8 AND hex THEN 4.0::DOUBLE WHEN {_B64} THEN 6.0::DOUBLE ELSE 5.954::DOUBLE END)) END)"
family("f_norm_entropy", {"normalized_entropy": f"d:{_NORM}"}, features.randomness)
_COUNTS = "map_values(list_histogram(string_split(token, '')))"
_EVEN = f"(1 - (list_max({_COUNTS}) - n / len({_COUNTS})::DOUBLE) / n)"
_CRYPTO = f"CASE WHEN n < 8 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN {_NORM} > 0.9 THEN 0.4::DOUBLE WHEN {_NORM} > 0.7 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN {_SHAPE} < 0.1::DOUBLE THEN 0.3::DOUBLE WHEN {_SHAPE} < 0.3::DOUBLE THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN {_EVEN} > 0.8 THEN 0.2::DOUBLE WHEN {_EVEN} > 0.6 THEN 0.1::DOUBLE ELSE 0 END) - (CASE WHEN regexp_matches(token, {text(C.UUID)}) THEN 0.4::DOUBLE ELSE 0 END) - (CASE WHEN n = 40 AND hex THEN 0.3::DOUBLE ELSE 0 END))) END"
family("f_crypto", {"cryptographic_score": f"d:{_CRYPTO}"}, features.randomness)
family("f_vendor", {"vendor_prefix_boost": f"d:CASE WHEN {any_start('token', C.BOOST_FULL)} THEN 1.0 WHEN {any_start('token', C.BOOST_MOST)} THEN 0.8 WHEN {any_start('token', C.BOOST_SOME)} THEN 0.6 ELSE 0 END"}, features.vendor)


@query("f_known_prefix", f"{CAND} SELECT token, CAST(min(CASE " + " ".join(f"WHEN starts_with(token, '{p}') THEN {k}" for p, k in C.KNOWN_PREFIXES.items()) + " ELSE 0 END) AS BIGINT) AS kind FROM cand GROUP BY token")
def f_known_prefix(spark, sf):
    return candidates(spark, sf).groupBy("token").agg(F.min(features.known_prefix(F.col("token"))).cast("long").alias("kind"))


family("f_span_offset", {"token_span_offset": "d:greatest(0.0, least(1.0, (length(pre) + n / 2.0) / length(trim(line))))"}, features.position)
_EMBEDDED = f"(regexp_matches(line, {text(C.URL_SCHEMES)}) OR regexp_matches(line, {text(C.URL_USER)}) OR len([x for x in regexp_extract_all(line, '[?&][a-z_]+=') if contains(line, x || token)]) > 0)"
family("f_embedded", {"token_in_multiline_block": f"b:{any_match('full_text', C.ARMOUR_MARKS)}", "embedded_token_flag": f"b:{_EMBEDDED}"}, features.position)
_odd = lambda m: f"(length(pre) - length(replace(pre, {m}, ''))) % 2 = 1 AND NOT contains(token, {m}) AND NOT starts_with(post, {m}) AND contains(post, {m})"
_beside = lambda m: f"ends_with(pre, {m}) AND starts_with(post, {m})"
family("f_quote", {"token_quote_type": f"i:CASE WHEN {_beside('chr(39)')} THEN 1 WHEN {_beside('chr(34)')} THEN 2 WHEN {_beside('chr(96)')} THEN 3 WHEN {_odd('chr(34)')} THEN 2 WHEN {_odd('chr(39)')} THEN 1 WHEN {_odd('chr(96)')} THEN 3 ELSE 0 END"}, features.position)
family("f_uuid_hash", {"is_uuid_v4": f"b:regexp_matches(token, {text(C.UUID4)})", "is_known_hash_length": "b:hex AND n IN (32, 40, 64, 128)", "has_hash_prefix": f"b:{any_start('token', C.HASH_PREFIXES)}"}, features.identity)
family("f_mismatch", {"entropy_charset_mismatch": f"d:CASE WHEN n < 8 THEN 0 WHEN ent > 3.5 AND {_CLASSES} <= 2 THEN least(1.0, 0.3 + least(0.5, (ent - 3.5) / 2.0)) WHEN ent < 3.0 AND {_CLASSES} >= 3 THEN 0.2 ELSE 0 END"}, features.mismatch)


def _jwt(head: object, body: object, tail: str = "c2ln") -> str:
    part = lambda x: base64.urlsafe_b64encode((x if isinstance(x, str) else json.dumps(x)).encode()).decode().rstrip("=")
    return f"{part(head)}.{part(body)}.{tail}"


#: Tokens of each kind, with whether they are well-formed and live.
JWTS = {
    _jwt({"alg": "HS256", "typ": "JWT"}, {"sub": "user1", "exp": 1900000000}): True,
    _jwt({"alg": "none", "typ": "JWT"}, {"sub": "user1"}): False,
    _jwt({"alg": "RS256"}, {"sub": "a-Test-account"}): False,
    _jwt({"alg": "RS256", "typ": "at+jwt"}, {"exp": 1500000000}): False,
    _jwt({"alg": "RS256", "typ": "JOSE"}, {"sub": "x"}): False,
    _jwt([1, 2], {"sub": "x"}): False,
    _jwt({"alg": "ES256"}, {"name": "Zoë >>> ???"}): True,
    _jwt({"alg": "ES256"}, {"exp": "soon"}): True,
    "SG.notbase64!.zzz": False,
    "abc": False,
    "a.b.c.d": False,
}
_CASES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(JWTS))


@query("f_jwt", f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE c_custkey % {len(JWTS)} {_CASES} END AS token, c_custkey % {len(JWTS)} IN ({', '.join(str(i) for i, v in enumerate(JWTS.values()) if v)}) AS valid FROM customer")
def f_jwt(spark, sf):
    """The twin knows which tokens are valid; the query decodes them."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.expr(f"CASE c_custkey % {len(JWTS)} {_CASES} END").alias("token"))
    return rows.withColumn("valid", features.jwt_valid(F.col("token")))


@query("c_var_name", f"{CAND} SELECT file, line_no, token, name FROM cand")
def c_var_name(spark, sf):
    return candidates(spark, sf).select("file", "line_no", "token", context.variable_name(F.col("line"), F.col("token")).alias("name"))


@query("c_comment", f"{_CTX} SELECT file, line_no, {any_start('ltrim(line)', C.COMMENT_STARTS)} AS is_comment FROM x")
def c_comment(spark, sf):
    return corpus.lines(spark, sf).select("file", "line_no", context.is_comment(F.col("line")).alias("is_comment"))


_EXT = r"regexp_extract(lower(file), '[^/.][^/]*?(\.[^./]+)$', 1)"


@query("c_file_type", f"WITH {_FILES} SELECT file, CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{v}'" for e, v in C.LANGUAGES.items()) + " END AS file_type FROM fl")
def c_file_type(spark, sf):
    return corpus.files(spark, sf).select("file", context.file_type(F.col("file")).alias("file_type"))


@query("c_test_file", f"WITH {_FILES} SELECT file, {any_match('file', ['(?i)' + p for p in C.TEST_PATHS])} AS is_test FROM fl")
def c_test_file(spark, sf):
    return corpus.files(spark, sf).select("file", context.is_test_file(F.col("file")).alias("is_test"))


_NAME = "regexp_extract(file, '([^/]*)$', 1)"
_CONFIG = f"({_EXT} IN ({', '.join(text(e) for e in (*C.CONFIG_EXTENSIONS, '.env'))}) OR starts_with({_NAME}, '.env') OR {any_part(f'lower({_NAME})', C.CONFIG_NAMES)})"
_RISKY = f"({_EXT} IN ({', '.join(text(e) for e in C.RISKY_EXTENSIONS)}))"


@query("c_config_file", f"WITH {_FILES} SELECT file, {_EXT} AS extension, {_CONFIG} AS is_config, {_RISKY} AS is_risky FROM fl")
def c_config_file(spark, sf):
    from vaultsieve.operators.paths import suffix

    return corpus.files(spark, sf).select("file", suffix(F.col("file")).alias("extension"), context.is_config_file(F.col("file")).alias("is_config"), context.is_risky_file(F.col("file")).alias("is_risky"))


@query("c_safe_risky", f"{_CTX} SELECT file, line_no, {any_match('full_text', C.SAFE_CONTEXT)} AS safe, {any_match('full_text', C.RISKY_CONTEXT)} AS risky FROM x")
def c_safe_risky(spark, sf):
    return _contexts(spark, sf).select("file", "line_no", context.is_safe_context(context.full_context()).alias("safe"), context.is_risky_context(context.full_context()).alias("risky"))


@query("c_finding_context", f"{CAND} SELECT file, line_no, token, CAST(total AS BIGINT) AS total_lines, CAST(length(full_text) AS BIGINT) AS n_chars FROM cand")
def c_finding_context(spark, sf):
    """Findings that come without lines meet their file again by its path; a missing file leaves the snippet."""
    found = detect.scan_lines(corpus.lines(spark, sf)).select("file", "line_no", "token", "snippet")
    whole = found.join(corpus.files(spark, sf), "file", "left")
    near = F.slice("lines", F.greatest(F.col("line_no") - 3, F.lit(1)).cast("int"), (F.col("line_no") + 3 - F.greatest(F.col("line_no") - 3, F.lit(1)) + 1).cast("int"))
    return whole.select("file", "line_no", "token", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("total_lines"), F.length(F.coalesce(F.array_join(near, "\n"), F.col("snippet"))).cast("long").alias("n_chars"))


_SAFE_ID = "regexp_matches(lower(nm), '_id\\b') AND NOT regexp_matches(lower(nm), '(key|secret|api)_id\\b')"
family(
    "f_var_flags",
    {
        "var_name_extracted": "b:name IS NOT NULL",
        "var_contains_secret": f"b:{any_match('nm', C.SECRET_NAMES)}",
        "var_contains_safe": f"b:{any_match('nm', [p for p in C.SAFE_NAMES if '<' not in p])} OR ({_SAFE_ID})",
        "var_name_length": "i:length(nm)",
        "var_is_uppercase": "b:nm = upper(nm) AND nm <> lower(nm) AND contains(nm, '_')",
        "var_is_camelcase": "b:regexp_matches(nm, '^[a-z].*[A-Z]')",
    },
    features.name_flags,
)
_grams = lambda x, g: "least(1.0::DOUBLE, " + " + ".join(f"(CASE WHEN contains(lower({x}), '{k}') THEN {v * 0.5!r}::DOUBLE ELSE 0 END)" for k, v in g.items()) + ")"
family("f_ngram", {"var_ngram_secret_score": f"d:{_grams('nm', C.SECRET_GRAMS)}", "var_ngram_safe_score": f"d:{_grams('nm', C.SAFE_GRAMS)}"}, features.name_grams)
family("f_assign_type", {"assignment_type": "i:CASE WHEN contains(pre, ':=') THEN 3 WHEN contains(pre, '=>') THEN 4 WHEN regexp_matches(pre, ':\\s*[\"'']?$') THEN 2 WHEN regexp_matches(pre, '=\\s*[\"'']?$') THEN 1 ELSE 0 END"}, features.assignment)
_OPEN = "regexp_extract(pre, '([\"''`])[^\"''`=:]*$', 1)"
family("f_string_literal", {"in_string_literal": f"b:({_beside('chr(34)')}) OR ({_beside('chr(39)')}) OR ({_beside('chr(96)')}) OR ({_OPEN} <> '' AND len([i for i in range(1, length(token || post) - n + 1) if substr(post, i, 1) = {_OPEN} AND substr(token || post, n + i - 1, 1) <> chr(92)]) > 0)"}, features.literal)
family(
    "f_context_flags",
    {
        "line_is_comment": f"b:{any_start('ltrim(line)', C.COMMENT_STARTS)}",
        "context_mentions_test": f"b:regexp_matches(full_text, {text(C.MENTIONS['test'])})",
        "context_mentions_git": f"b:regexp_matches(full_text, {text(C.MENTIONS['git'])})",
        "context_mentions_hash": f"b:regexp_matches(full_text, {text(C.MENTIONS['hash'])})",
        "context_has_import": f"b:{any_match('full_text', C.IMPORTS)}",
        "context_has_function_def": f"b:{any_match('full_text', C.FUNCTIONS)}",
        "file_is_test": f"b:{any_match('file', ['(?i)' + p for p in C.TEST_PATHS])}",
        "file_is_config": f"b:{_CONFIG}",
        "file_extension_risk": f"i:CASE WHEN {_RISKY} THEN 2 WHEN {_CONFIG} THEN 1 ELSE 0 END",
        "line_position_ratio": "d:line_no / total::DOUBLE",
    },
    features.context_flags,
)
family("f_semantic", {"semantic_context_score": "d:greatest(-1.0::DOUBLE, least(1.0::DOUBLE, " + " + ".join(f"(CASE WHEN regexp_matches(full_text, {text(p)}) THEN {w!r}::DOUBLE ELSE 0 END)" for p, w in C.SEMANTIC) + "))"}, features.semantic)
_NEAR = f"regexp_extract_all(full_text, {text(C.NEARBY_TOKEN)})"
family(
    "f_density",
    {
        "surrounding_secret_density": f"d:coalesce(list_avg([(({entropy('t')} > 4.0 AND length(t) >= 20)::INT + {any_start('t', C.KNOWN_PREFIXES)}::INT)::DOUBLE for t in {_NEAR}[1:20]]), 0)",
        "surrounding_entropy_avg": f"d:coalesce(list_avg([{entropy('t')} for t in {_NEAR}[1:10]]), 0)",
    },
    features.density,
)
family(
    "f_surround",
    {
        "surrounding_token_count": f"i:len([t for t in regexp_extract_all(line, {text(C.LINE_TOKEN)}) if {entropy('t')} > 3.5])",
        "key_value_distance": "i:CASE WHEN name IS NULL OR strpos(line, name) = 0 THEN -1 ELSE abs(strpos(line, token) - strpos(line, name) - length(name)) END",
        "json_path_hint": "i:greatest((length(line) - length(ltrim(line))) // 2, len(regexp_extract_all(line, '[{\\[]')))",
    },
    features.surroundings,
)
family("f_adjacency", {"adjacency_ngram_score": f"d:coalesce(list_sum([{_grams('v', C.SECRET_GRAMS)} for v in flatten([regexp_extract_all(x, {text(C.IDENTIFIER)}, 1) for x in string_split(full_text, chr(10)) if NOT contains(x, token)])]), 0)"}, features.adjacency)
_ROWS = "string_split(full_text, chr(10))"
_AT = f"list_position([contains(x, token) for x in {_ROWS}], true)"
family("f_cross_entropy", {"cross_line_entropy": f"d:coalesce(list_avg([{entropy('x')} for x in list_concat({_ROWS}[greatest({_AT} - 3, 1):{_AT} - 1], {_ROWS}[{_AT} + 1:{_AT} + 3]) if trim(x) <> '']), 0)"}, features.cross_lines)
family("f_token_kinds", {"is_hex_len_40": "b:hex AND n = 40", "is_hex_len_64": "b:hex AND n = 64", "is_test_token": f"b:{any_part('token', C.TEST_TOKENS)}", "contains_example_keyword": f"b:{any_part('token', C.EXAMPLE_TOKENS)}"}, features.token_kinds)
family("f_paths", {"file_is_git_related": f"b:{any_part('path', C.GIT_PATHS)}", "file_is_build": f"b:{any_part('path', C.BUILD_PATHS)}", "file_is_example": f"b:{any_part('path', C.EXAMPLE_PATHS)} OR {any_part('file', C.EXAMPLE_FILES)}"}, features.path_kinds)
_H = "hex AND n IN (32, 40, 64)"
family(
    "f_hex",
    {
        "hex_context_git_keywords": f"b:{_H} AND {any_part('lower(full_text)', C.HEX_GIT)}",
        "hex_context_crypto_keywords": f"b:{_H} AND {any_part('lower(full_text)', C.HEX_CRYPTO)}",
        "hex_adjacent_assignment_pattern": f"i:CASE WHEN NOT ({_H}) THEN 0 WHEN {any_part('lower(line)', C.HEX_ENV)} THEN 1 WHEN contains(line, ': ') OR contains(line, '=') THEN 2 WHEN contains(line, '(') AND contains(line, ')') THEN 3 ELSE 0 END",
        "hex_in_url_or_dsn": f"b:{_H} AND ({_EMBEDDED} OR {any_part('lower(line)', C.HEX_URLS)})",
        "hex_file_suggests_secret": f"b:{_H} AND {any_part('path', C.SECRET_PATHS)}",
    },
    features.hexadecimal,
)
_AFTER = " OR ".join(f"(regexp_matches(line, {text(p)}) AND length(pre) >= strpos(line, regexp_extract(line, {text(p)})) - 1 + length(regexp_extract(line, {text(p)})) - 1)" for p in C.ENV_FALLBACKS)
family("f_env", {"env_loader_in_context": f"b:{any_match('full_text', C.ENV_LOADERS)}", "is_env_fallback_value": f"b:{_AFTER}"}, features.environment)


@query("f_record", f"{CAND} SELECT file, line_no, token, {any_part('path', C.RECORD_TEST_PARTS)} AS in_test, {any_start('ltrim(line)', C.RECORD_COMMENT_STARTS)} AS in_comment, round((least(line_no - 1, 3) + 1) / (least(line_no - 1, 3) + 1 + least(total - line_no, 3))::DOUBLE, 6) AS place FROM cand WHERE total > 1")
def f_record(spark, sf):
    """Features of training records differ in three: test file, comment and place, which follow from the record alone."""
    made = features.base(candidates(spark, sf).where("total_lines > 1"), record=True)
    return made.select("file", "line_no", "token", "in_test", "in_comment", F.round("place", 6).alias("place"))


@query("f_all")
def f_all(spark, sf):
    """All 65 features of every candidate; each family has a twin of its own."""
    return features.with_features(candidates(spark, sf).select("file", "line_no", "line", "before", "after", "total_lines", "type", "token"))
