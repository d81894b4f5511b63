"""The 65 features of a candidate, as columns over token, line, before, after, file, type, line_no, total_lines."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultsieve.functions import batches
from vaultsieve.functions import constants as C
from vaultsieve.functions.text import after_first, before_first, contains_any, count_of, matches_any, spelled, starts_any, strip
from vaultsieve.operators import context as X
from vaultsieve.sources.package import ship

_HEX = r"^[0-9a-fA-F]*$"
c = F.col

#: What contexts are asked for, by name: each pattern is tried on every context, in batches.
ASKED = {"armour": C.ARMOUR_MARKS, **{k: (p,) for k, p in C.MENTIONS.items()}, "import": C.IMPORTS, "function": C.FUNCTIONS, **{f"semantic {i}": (p,) for i, (p, _) in enumerate(C.SEMANTIC)}, "loader": C.ENV_LOADERS}
#: What tokens are asked for likewise.
ASKED_OF_TOKENS = {"placeholder": tuple(f"(?i){p}" for p in C.PLACEHOLDERS), "version": C.VERSIONS, "marks": (r"[-_./]{2,}",), "number": (r"v?\d+\.\d+",)}
#: Every name that adds to the adjacency score holds one of these.
_GRAM_PARTS = "key|secret|passw|pwd|token|bearer|credential"


def _sum(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def base(candidates: DataFrame, record: bool = False) -> DataFrame:
    """What several features are made of, computed once, in steps: a step's column that a later one reads twice is not computed twice.

    record: by the rules for training records, which have no file around them. Entropies and the context's patterns are
    taken in batches.
    """
    ship(candidates.sparkSession)
    made = candidates.withColumns({"full": X.full_context(), "token": F.coalesce("token", F.lit("")), "name": X.variable_name(c("line"), c("token"))})
    made = made.withColumns({"n": F.length("token"), "kinds": batches.characters(c("token")), "pre": before_first(c("line"), c("token")), "post": after_first(c("line"), c("token")), "path": F.lower("file"), "low": F.lower("full"), "near": near_tokens(c("full")), "rows": F.split("full", "\n", -1), "marks": batches.held(c("full"), _joined(ASKED)), "token_marks": batches.held(c("token"), _joined(ASKED_OF_TOKENS))})
    made = made.withColumns({"ent": c("kinds.bits"), "near_means": batches.near(c("near"), tuple(C.KNOWN_PREFIXES)), "line_bits": batches.entropies(F.regexp_extract_all("line", F.lit(spelled(C.LINE_TOKEN)), F.lit(0))), "shape": structure_score(c("token")), "base64": is_base64_like(), "has_token": F.transform("rows", lambda x: x.contains(c("token")))})
    made = made.withColumns({"norm": normalized_entropy(c("token"), c("ent"), c("base64")), "first": F.array_position("has_token", F.lit(True)).cast("int")})
    made = made.withColumn("beside", batches.entropies(beside()))
    if record:
        line, path = strip(c("line")), F.lower(F.coalesce("file", F.lit("")))
        count = F.size("before") + 1 + F.size("after")
        return made.withColumns({"in_comment": starts_any(line, C.RECORD_COMMENT_STARTS), "in_test": contains_any(path, C.RECORD_TEST_PARTS), "place": F.when(count > 1, (F.size("before") + 1) / count).otherwise(0.5)})
    place = F.when(c("line_no").isNotNull() & (c("total_lines") > 0), c("line_no") / c("total_lines")).otherwise(0.5)
    return made.withColumns({"in_comment": X.is_comment(c("line")), "in_test": X.is_test_file(c("file")), "place": place})


def _joined(asked: dict[str, Iterable[str]]) -> list[str]:
    return ["|".join(f"(?:{p})" for p in patterns) for patterns in asked.values()]


def _asked(name: str, of: dict[str, Iterable[str]], text: str, marks: str) -> Column:
    return F.when(c(marks).isNull(), matches_any(c(text), of[name])).otherwise(c(marks).bitwiseAND(F.lit(1 << list(of).index(name))) != 0)


def asked(name: str) -> Column:
    """Whether the context matches any of the patterns of that name; contexts that batches leave open are asked here."""
    return _asked(name, ASKED, "full", "marks")


def asked_of_token(name: str) -> Column:
    return _asked(name, ASKED_OF_TOKENS, "token", "token_marks")


def of_kind(kind: str, others: str) -> Column:
    """How many of the token's characters are of a kind, which the batches count in ASCII; others: the pattern of all that are not, in any script."""
    return F.when(c(f"kinds.{kind}").isNull(), without(c("token"), others)).otherwise(c(f"kinds.{kind}"))


def char_classes() -> Column:
    return _sum((of_kind(kind, others) > 0).cast("int") for kind, others in (("lower", r"\P{Ll}"), ("upper", r"\P{Lu}"), ("digit", r"\P{Nd}"), ("other", r"[\p{L}\p{N}]")))


def ratios() -> dict[str, Column]:
    n = F.greatest(c("n"), F.lit(1))
    return {
        "token_length": c("n"),
        "token_entropy": c("ent"),
        "char_class_count": char_classes(),
        "digit_ratio": of_kind("digit", r"\P{Nd}") / n,
        "uppercase_ratio": of_kind("upper", r"\P{Lu}") / n,
        "special_char_ratio": of_kind("other", r"[\p{L}\p{N}]") / n,
    }


def without(text: Column, kind: str) -> Column:
    """How many characters are not of that kind."""
    return F.length(F.regexp_replace(text, f"{kind}+", ""))


def is_base64_like() -> Column:
    most = F.greatest(of_kind("plain64", r"[^A-Za-z0-9+/=]"), of_kind("url64", r"[^A-Za-z0-9_=-]"))
    return (c("n") >= 4) & (most / F.greatest(c("n"), F.lit(1)) >= 0.95)


def base64_and_padding() -> dict[str, Column]:
    return {"is_base64_like": c("base64"), "has_padding": c("token").endswith("=")}


def match_type() -> dict[str, Column]:
    codes = F.create_map(*[F.lit(x) for pair in C.TYPE_CODES.items() for x in pair])
    return {"regex_match_type": F.when(c("type") == "ENTROPY_CANDIDATE", 0).otherwise(F.coalesce(F.element_at(codes, c("type")), F.lit(9)))}


def structure_score(token: Column) -> Column:
    words = count_of(token, r"[A-Za-z]{4,}")
    score = F.when(token.rlike(r"(.)\1{3,}"), 0.25).otherwise(0.0) + F.least(F.lit(0.3), words * 0.1) + F.when(asked_of_token("marks"), 0.15).otherwise(0.0)
    score = score + F.when(asked_of_token("number"), 0.2).otherwise(0.0) + F.when(asked_of_token("placeholder"), 0.1).otherwise(0.0)
    return F.when(F.length(token) < 4, 0.0).otherwise(F.least(score, F.lit(1.0)))


def structure() -> dict[str, Column]:
    return {"token_structure_score": c("shape"), "has_version_pattern": asked_of_token("version")}


def normalized_entropy(token: Column, value: Column, base64: Column) -> Column:
    most = F.when(token.rlike(r"[^\p{L}\p{N}]"), C.ENTROPY_SPECIAL).when((F.length(token) >= 8) & token.rlike(_HEX), C.ENTROPY_HEX).when(base64, C.ENTROPY_BASE64).otherwise(C.ENTROPY_ALPHANUMERIC)
    return F.when(F.length(token) < 4, 0.0).otherwise(F.least(value / most, F.lit(1.0)))


def crypto_score(token: Column, kinds: Column, norm: Column, shape: Column) -> Column:
    """kinds: the token's different characters, and how often the most frequent one comes; norm, shape: its normalized entropy and structure score."""
    n = F.length(token)
    even = 1 - (kinds["most"] - n / kinds["kinds"]) / n
    score = F.when(norm > 0.9, 0.4).when(norm > 0.7, 0.2).otherwise(0.0) + F.when(shape < 0.1, 0.3).when(shape < 0.3, 0.15).otherwise(0.0) + F.when(even > 0.8, 0.2).when(even > 0.6, 0.1).otherwise(0.0)
    score = score - F.when(token.rlike(C.UUID), 0.4).otherwise(0.0) - F.when((n == 40) & token.rlike(_HEX), 0.3).otherwise(0.0)
    return F.when(n < 8, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def randomness() -> dict[str, Column]:
    return {"normalized_entropy": c("norm"), "cryptographic_score": crypto_score(c("token"), c("kinds"), c("norm"), c("shape"))}


def vendor() -> dict[str, Column]:
    return {"vendor_prefix_boost": F.when(starts_any(c("token"), C.BOOST_FULL), 1.0).when(starts_any(c("token"), C.BOOST_MOST), 0.8).when(starts_any(c("token"), C.BOOST_SOME), 0.6).otherwise(0.0)}


def known_prefix(token: Column) -> Column:
    kind = F.lit(0)
    for prefix, code in reversed(C.KNOWN_PREFIXES.items()):
        kind = F.when(token.startswith(prefix), code).otherwise(kind)
    return kind


def position() -> dict[str, Column]:
    inside = F.length(strip(c("line")))
    ratio = (F.length("pre") + c("n") / 2) / inside
    quote = F.lit(0)
    # A pair of equal quotes at the token decides first; then an odd number of quotes before and one behind, in this order.
    for mark, code in reversed([('"', 2), ("'", 1), ("`", 3)]):
        odd = (F.length("pre") - F.length(F.replace(c("pre"), F.lit(mark), F.lit("")))) % 2 == 1
        quote = F.when(odd & ~c("token").contains(mark) & ~c("post").startswith(mark) & c("post").contains(mark), code).otherwise(quote)
    for mark, code in (("`", 3), ('"', 2), ("'", 1)):
        quote = F.when(c("pre").endswith(mark) & c("post").startswith(mark), code).otherwise(quote)
    known = c("pre").isNotNull() & (c("n") > 0)
    return {
        "token_span_offset": F.when(~known | (inside == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))),
        "token_in_multiline_block": (c("n") > 0) & asked("armour"),
        "embedded_token_flag": embedded(),
        "token_quote_type": F.when(known, quote).otherwise(0),
    }


def embedded() -> Column:
    parameter = F.exists(F.split(c("line"), r"(?=[?&])"), lambda p: p.rlike("^[?&][a-z_]+=") & F.startswith(F.regexp_replace(p, "^[?&][a-z_]+=", ""), c("token")))
    return (c("n") > 0) & (c("line").rlike(C.URL_SCHEMES) | c("line").rlike(C.URL_USER) | parameter)


def identity() -> dict[str, Column]:
    t = c("token")
    return {
        "is_uuid_v4": t.rlike(C.UUID4),
        "is_known_hash_length": (c("n") > 0) & t.rlike(_HEX) & c("n").isin(*C.HASH_LENGTHS),
        "has_hash_prefix": starts_any(t, C.HASH_PREFIXES),
    }


def jwt_valid(token: Column) -> Column:
    """Three parts; the first two are base64url JSON objects; an algorithm other than none, a known type, no test subject, no expiry long past."""
    parts = F.split(token, r"\.")

    def claims(i: int) -> Column:
        raw = F.translate(F.get(parts, F.lit(i)), "-_", "+/")
        padded = F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), F.lit("="))
        return F.when(F.length(raw) % 4 != 1, F.try_to_binary(padded, F.lit("base64")).cast("string"))

    head, body = claims(0), claims(1)
    is_object = lambda x: F.coalesce(x.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(x).isNotNull(), F.lit(False))
    kind, subject, expiry = F.get_json_object(head, "$.typ"), F.lower(F.get_json_object(body, "$.sub")), F.get_json_object(body, "$.exp").try_cast("double")
    fine = (F.coalesce(F.get_json_object(head, "$.alg"), F.lit("")) != "none") & (kind.isNull() | kind.isin("JWT", "at+jwt"))
    valid = is_object(head) & is_object(body) & fine & ~F.coalesce(contains_any(subject, C.JWT_SUBJECTS), F.lit(False)) & ~F.coalesce(expiry < C.JWT_EARLIEST, F.lit(False))
    # A branch, so that nothing of it is computed ahead for tokens of another form.
    return F.coalesce(F.when(F.size(parts) == 3, valid), F.lit(False))


def jwt() -> dict[str, Column]:
    return {"jwt_structure_valid": jwt_valid(c("token"))}


def mismatch() -> dict[str, Column]:
    kinds = char_classes()
    high = F.least(F.lit(1.0), 0.3 + F.least(F.lit(0.5), (c("ent") - 3.5) / 2.0))
    return {"entropy_charset_mismatch": F.when(c("n") < 8, 0.0).when((c("ent") > 3.5) & (kinds <= 2), high).when((c("ent") < 3.0) & (kinds >= 3), 0.2).otherwise(0.0)}


def name_flags() -> dict[str, Column]:
    name = F.coalesce("name", F.lit(""))
    return {
        "var_name_extracted": c("name").isNotNull(),
        "var_contains_secret": matches_any(name, C.SECRET_NAMES),
        "var_contains_safe": matches_any(name, C.SAFE_NAMES),
        "var_name_length": F.length(name),
        "var_is_uppercase": name.rlike(r"\p{Lu}") & ~name.rlike(r"\p{Ll}") & name.contains("_"),
        "var_is_camelcase": name.rlike(r"^\p{Ll}.*\p{Lu}"),
    }


def gram_score(low: Column, grams: dict[str, float]) -> Column:
    """low: a name in lower case."""
    return F.least(_sum(F.when(low.contains(g), w * 0.5).otherwise(0.0) for g, w in grams.items()), F.lit(1.0))


def name_grams() -> dict[str, Column]:
    name = F.lower(F.coalesce("name", F.lit("")))
    return {"var_ngram_secret_score": gram_score(name, C.SECRET_GRAMS), "var_ngram_safe_score": gram_score(name, C.SAFE_GRAMS)}


def assignment() -> dict[str, Column]:
    pre = c("pre")
    return {"assignment_type": F.when(pre.isNull(), 0).when(pre.contains(":="), 3).when(pre.contains("=>"), 4).when(pre.rlike(r":\s*[\"']?$"), 2).when(pre.rlike(r"=\s*[\"']?$"), 1).otherwise(0)}


def literal() -> dict[str, Column]:
    marks = ['"', "'", "`"]
    beside = reduce(lambda a, b: a | b, [c("pre").endswith(m) & c("post").startswith(m) for m in marks])
    opener = F.regexp_extract(c("pre"), r"([\"'`])(?:[^\"'`=:]|(?<=\\)[=:])*$", 1)
    tail = F.concat(F.right(c("token"), F.lit(1)), c("post"))
    closed = reduce(lambda a, b: a | b, [(opener == m) & tail.rlike(r"[^\\]" + m) for m in marks])
    return {"in_string_literal": F.coalesce((c("n") > 0) & (beside | closed), F.lit(False))}


def context_flags() -> dict[str, Column]:
    return {
        "line_is_comment": c("in_comment"),
        "context_mentions_test": asked("test"),
        "context_mentions_git": asked("git"),
        "context_mentions_hash": asked("hash"),
        "context_has_import": asked("import"),
        "context_has_function_def": asked("function"),
        "file_is_test": c("in_test"),
        "file_is_config": X.is_config_file(c("file")),
        "file_extension_risk": F.when(X.is_risky_file(c("file")), 2).when(X.is_config_file(c("file")), 1).otherwise(0),
        "line_position_ratio": c("place"),
    }


def semantic() -> dict[str, Column]:
    score = _sum(F.when(asked(f"semantic {i}"), w).otherwise(0.0) for i, (_, w) in enumerate(C.SEMANTIC))
    return {"semantic_context_score": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))}


def _mean(values: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))
    return F.coalesce(F.aggregate(values, start, step, lambda a: F.when(a["n"] > 0, a["sum"] / a["n"])), F.lit(0.0))


def near_tokens(text: Column) -> Column:
    """The first 20 tokens of a text, whose entropies two features share."""
    return F.slice(F.regexp_extract_all(text, F.lit(spelled(C.NEARBY_TOKEN)), F.lit(0)), 1, 20)


def density() -> dict[str, Column]:
    return {"surrounding_secret_density": c("near_means.secrets"), "surrounding_entropy_avg": c("near_means.bits")}


def surroundings() -> dict[str, Column]:
    line = c("line")
    at = F.instr(line, c("name"))
    indent = F.length(line) - F.length(F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+", ""))
    return {
        "surrounding_token_count": F.size(F.filter("line_bits", lambda e: e > 3.5)),
        "key_value_distance": F.when(c("name").isNull() | (c("n") == 0) | (at == 0), -1).otherwise(F.abs(F.length("pre") - (at - 1 + F.length("name")))),
        "json_path_hint": F.greatest(F.floor(indent / 2).cast("int"), F.length(line) - F.length(F.translate(line, "{[", ""))),
    }


def adjacency() -> dict[str, Column]:
    others = F.filter("rows", lambda x, i: ~F.get("has_token", i) & F.lower(x).rlike(_GRAM_PARTS))
    names = F.flatten(F.transform(others, lambda x: F.regexp_extract_all(x, F.lit(f"(?U){C.IDENTIFIER}"), F.lit(1))))
    score = F.aggregate(F.filter(F.transform(names, F.lower), lambda x: x.rlike(_GRAM_PARTS)), F.lit(0.0), lambda a, x: a + gram_score(x, C.SECRET_GRAMS))
    return {"adjacency_ngram_score": F.when((c("n") > 0) & c("full").contains(c("token")), score).otherwise(0.0)}


def beside() -> Column:
    """The three lines on each side of the first one with the token, blank ones left out."""
    first, start = c("first"), F.greatest(c("first") - 3, F.lit(1))
    near = F.concat(F.slice("rows", start, first - start), F.slice("rows", first + 1, F.lit(3)))
    return F.when((c("n") > 0) & (first > 0), F.filter(near, lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]")))


def cross_lines() -> dict[str, Column]:
    return {"cross_line_entropy": _mean(c("beside"))}


def token_kinds() -> dict[str, Column]:
    t = c("token")
    return {
        "is_hex_len_40": (c("n") == 40) & t.rlike(_HEX),
        "is_hex_len_64": (c("n") == 64) & t.rlike(_HEX),
        "is_test_token": contains_any(t, C.TEST_TOKENS),
        "contains_example_keyword": contains_any(t, C.EXAMPLE_TOKENS),
    }


def path_kinds() -> dict[str, Column]:
    no = F.lit(False)
    return {
        "file_is_git_related": F.coalesce(contains_any(c("path"), C.GIT_PATHS), no),
        "file_is_build": F.coalesce(contains_any(c("path"), C.BUILD_PATHS), no),
        "file_is_example": F.coalesce(contains_any(c("file"), C.EXAMPLE_FILES) | contains_any(c("path"), C.EXAMPLE_PATHS), no),
    }


def hexadecimal() -> dict[str, Column]:
    is_hex, line = c("n").isin(*C.HEX_LENGTHS) & c("token").rlike(_HEX), F.lower("line")
    kind = F.when(contains_any(line, C.HEX_ENV), 1).when(c("line").contains("="), 2).when(c("line").contains(": "), 2).when(c("line").contains("(") & c("line").contains(")"), 3).otherwise(0)
    return {
        "hex_context_git_keywords": is_hex & contains_any(c("low"), C.HEX_GIT),
        "hex_context_crypto_keywords": is_hex & contains_any(c("low"), C.HEX_CRYPTO),
        "hex_adjacent_assignment_pattern": F.when(is_hex, kind).otherwise(0),
        "hex_in_url_or_dsn": is_hex & (embedded() | contains_any(line, C.HEX_URLS)),
        "hex_file_suggests_secret": is_hex & F.coalesce(contains_any(c("path"), C.SECRET_PATHS), F.lit(False)),
    }


def environment() -> dict[str, Column]:
    after = [F.when(c("line").rlike(p), F.length("pre") >= F.regexp_instr(c("line"), F.lit(p)) - 1 + F.length(F.regexp_extract(c("line"), p, 0)) - 1).otherwise(False) for p in C.ENV_FALLBACKS]
    return {"env_loader_in_context": asked("loader") | matches_any(c("line"), C.ENV_LOADERS), "is_env_fallback_value": F.coalesce(reduce(lambda a, b: a | b, after), F.lit(False))}


FAMILIES = (
    ratios, base64_and_padding, match_type, structure, randomness, vendor, position, identity, jwt, mismatch, name_flags, name_grams, assignment, literal, context_flags, semantic, density, surroundings,
    adjacency, cross_lines, token_kinds, path_kinds, hexadecimal, environment,
)

#: All features in the order of the model's vector.
ORDER = (
    "token_length token_entropy char_class_count digit_ratio uppercase_ratio special_char_ratio is_base64_like has_padding regex_match_type token_structure_score has_version_pattern normalized_entropy "
    "cryptographic_score vendor_prefix_boost token_span_offset token_in_multiline_block embedded_token_flag token_quote_type is_uuid_v4 is_known_hash_length jwt_structure_valid entropy_charset_mismatch "
    "has_hash_prefix var_name_extracted var_contains_secret var_contains_safe var_name_length var_is_uppercase var_is_camelcase assignment_type in_string_literal var_ngram_secret_score var_ngram_safe_score "
    "line_is_comment context_mentions_test context_mentions_git context_mentions_hash context_has_import context_has_function_def file_is_test file_is_config file_extension_risk surrounding_entropy_avg "
    "semantic_context_score line_position_ratio surrounding_secret_density surrounding_token_count key_value_distance json_path_hint adjacency_ngram_score cross_line_entropy is_hex_len_40 is_hex_len_64 "
    "is_test_token contains_example_keyword file_is_git_related file_is_build file_is_example hex_context_git_keywords hex_context_crypto_keywords hex_adjacent_assignment_pattern hex_in_url_or_dsn "
    "hex_file_suggests_secret env_loader_in_context is_env_fallback_value"
).split()
#: The leading features, which look at the token alone.
TOKEN_ONLY = ORDER[:23]


def with_features(candidates: DataFrame, record: bool = False) -> DataFrame:
    """The candidates' columns and all features as doubles, in one projection without a shuffle."""
    made = {k: v for family in FAMILIES for k, v in family().items()}
    return base(candidates, record).select(*[F.col(x) for x in candidates.columns], *[made[k].cast("double").alias(k) for k in ORDER])
