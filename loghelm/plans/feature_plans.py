"""Feature queries."""

from itertools import combinations

from pyspark.sql import functions as F

from loghelm.functions import features as fx
from loghelm.functions import text
from loghelm.operators import features as ops
from loghelm.plans import sqltext as q
from loghelm.plans.registry import query
from loghelm.plans.views import table, with_views

_C = with_views("v_messages")
_NW = fx.TOKEN


def _cnt(sql, pattern):
    return f"len(regexp_extract_all({sql}, {q.quoted(pattern)}))"


def _has(sql, word):
    return f"CAST(contains({sql}, {q.quoted(word)}) AS INT)"


def _rx(sql, pattern):
    return f"CAST(regexp_matches({sql}, {q.quoted(pattern)}) AS INT)"


_M, _L = "message", "lower(message)"
_TOK = f"regexp_extract_all(message, {q.quoted(_NW)})"
_LEN = "greatest(length(message), 1)"
_N = f"greatest(len({_TOK}), 1)"
_DISTINCT = f"len(list_distinct({_TOK}))"
SQL_20 = f"""least(length(message), 10000) AS message_length, CAST(least(len({_TOK}), 2000) AS INT) AS token_count,
 round({_cnt(_M, chr(92) + 'p{Nd}')} / {_LEN}, 6) AS digit_ratio, round({_cnt(_M, chr(92) + 'p{Lu}')} / {_LEN}, 6) AS uppercase_ratio,
 CAST(least({_cnt(_M, fx.SPECIAL)}, 5000) AS INT) AS special_char_count,
 CAST(least(len(list_filter({_TOK}, lambda t: regexp_matches(t, '^\\p{{Nd}}+$'))), 1000) AS INT) AS numeric_token_count,
 round({_DISTINCT} / {_N}, 6) AS unique_token_ratio, {_rx(_M, fx.IP)} AS contains_ip, {_rx(_M, fx.URL)} AS contains_url,
 {_rx(_M, fx.PATH)} AS contains_path, {_rx(_M, fx.PORT)} AS contains_port, {_has(_L, 'hex_id')} AS contains_hex,
 {' + '.join(_has(_L, w) for w in fx.ERROR_KEYWORDS)} AS error_keyword_count,
 {', '.join(f"{_has(_L, w)} AS contains_{w}" for w in ('error', 'warning', 'timeout', 'failure', 'exception'))},
 round(1 - {_DISTINCT} / {_N}, 6) AS repeated_token_ratio,
 round(length(regexp_replace(message, {q.quoted(text.WS)}, '', 'g')) / {_N}, 6) AS average_token_length"""

_ROUND_20 = {"digit_ratio", "uppercase_ratio", "unique_token_ratio", "repeated_token_ratio", "average_token_length"}


def _rounded(columns, names):
    return [F.round(c, 6).alias(n) if n in _ROUND_20 else c for c, n in zip(columns, names)]


def _ints(df):
    """Character counts as the twin's integer type."""
    return df.withColumn("message_length", F.col("message_length").cast("long"))


def _frame_20(spark, sf):
    return table(spark, sf, "v_messages").select("id", "source_dataset", "true_label", *fx.structured_20(F.col("message"), fx.CAPS))


@query("features_structured_20", _C + f"SELECT id, {SQL_20} FROM v_messages")
def features_structured_20(spark, sf):
    return _ints(table(spark, sf, "v_messages").select("id", *_rounded(fx.structured_20(F.col("message"), fx.CAPS), fx.STRUCTURED_20)))


_MASKED = _C.rstrip() + f", raw_ AS (SELECT id, {q.replaced('lower(message)', text.IDENTITY_RULES)} AS message FROM v_messages)\n"


@query("features_structured_20_masked", _MASKED + f"SELECT id, {SQL_20} FROM raw_")
def features_structured_20_masked(spark, sf):
    masked = text.mask_identity(F.lower("message"))
    return _ints(table(spark, sf, "v_messages").select("id", masked.alias("message")).select(
        "id", *_rounded(fx.structured_20(F.col("message"), fx.CAPS), fx.STRUCTURED_20)))


@query("features_structured_10", _C + f"""SELECT id, length(message) AS message_length,
 round({_cnt(_M, chr(92) + 'p{Nd}')} / {_LEN}, 6) AS digit_ratio, round({_cnt(_M, chr(92) + 'p{Lu}')} / {_LEN}, 6) AS uppercase_ratio,
 CAST({_cnt(_M, fx.SPECIAL)} AS INT) AS special_char_count, {_rx(_M, fx.IP)} AS contains_ip,
 {', '.join(f"{_has(_L, w)} AS contains_{w}" for w in ('failed', 'error', 'warning', 'admin', 'login'))} FROM v_messages""")
def features_structured_10(spark, sf):
    names = ["message_length", "digit_ratio", "uppercase_ratio", "special_char_count", "contains_ip"]
    names += [f"contains_{w}" for w in ("failed", "error", "warning", "admin", "login")]
    return _ints(table(spark, sf, "v_messages").select("id", *_rounded(fx.structured_10(F.col("message")), names)))


@query("features_live_9", with_views("v_text") + f"""SELECT kind, id, length(text) AS length, CAST({_cnt('text', chr(92) + 'p{Nd}')} AS INT) AS digits,
 CAST({_cnt('text', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} AS INT) AS symbols, CAST({_cnt('text', chr(92) + 'p{Lu}')} AS INT) AS uppers,
 CAST({_cnt('text', _NW)} AS INT) AS words, {_rx('text', text.IPV4)} AS has_ip, {_has('text', 'error')} AS has_error, {_has('text', 'warning')} AS has_warning,
 {_rx('text', fx.THREE_DIGITS)} AS has_code FROM v_text""")
def features_live_9(spark, sf):
    out = table(spark, sf, "v_text").select("kind", "id", *fx.structured_9(F.col("text")))
    return out.withColumn("length", F.col("length").cast("long"))


@query("features_behaviour", with_views("v_logs") + f"""SELECT event_id, CAST(hour(timestamp) AS INT) AS hour, CAST(isodow(timestamp) - 1 AS INT) AS weekday,
 CAST({_cnt(_M, chr(92) + 'p{Nd}')} AS INT) AS digit_count, CAST({_cnt(_M, '/')} AS INT) AS path_count, length(message) AS msg_length,
 coalesce(TRY_CAST(nullif(regexp_extract(message, 'pid=(\\d+)', 1), '') AS INT), 0) AS pid FROM v_logs""")
def features_behaviour(spark, sf):
    out = table(spark, sf, "v_logs").select("event_id", *fx.behaviour(F.col("message"), F.col("timestamp")))
    return out.withColumn("msg_length", F.col("msg_length").cast("long"))


@query("features_audit", with_views("v_logs") + f"""SELECT event_id, CAST(hour(timestamp) AS INT) AS hour, CAST(isodow(timestamp) - 1 AS INT) AS weekday,
 CAST(isodow(timestamp) >= 6 AS INT) AS is_weekend, {_has(_L, 'error')} AS has_error, {_has(_L, 'fail')} AS has_failed, {_has(_L, 'critical')} AS has_critical,
 CAST({_cnt(_M, chr(92) + 'p{Nd}')} AS INT) AS digit_count, CAST({_cnt(_M, '/')} AS INT) AS path_count FROM v_logs""")
def features_audit(spark, sf):
    return table(spark, sf, "v_logs").select("event_id", *fx.audit_set(F.col("message"), F.col("timestamp")))


@query("features_early_report", with_views("v_text") + f"""SELECT kind, id, length(text) AS text_length, CAST({_cnt('text', _NW)} AS INT) AS word_count,
 {_rx('text', chr(92) + 'p{Nd}')} AS has_number, {_has('lower(text)', 'block')} AS has_block, CAST(length(text) > 100 AS INT) AS long_text,
 {', '.join(f"{_has('lower(text)', w)} AS has_{w}" for w in fx.EARLY_WORDS[1:])} FROM v_text""")
def features_early_report(spark, sf):
    out = table(spark, sf, "v_text").select("kind", "id", *fx.early_report(F.col("text")))
    return out.withColumn("text_length", F.col("text_length").cast("long"))


@query("features_level_code", with_views("v_bracketed") + """, p AS (SELECT event_id, replace(split_part(split_part(value, ']', 2), ':', 1), ' ', '') AS level,
 CAST(regexp_matches(value, '([0-9]{1,3}\\.){3}[0-9]{1,3}') AS INT) AS has_ip FROM v_bracketed)
SELECT event_id, level, has_ip, CAST(dense_rank() OVER (ORDER BY level) - 1 AS INT) AS level_code FROM p""")
def features_level_code(spark, sf):
    from loghelm.operators import parse
    parsed = parse.parse_bracketed(table(spark, sf, "v_bracketed"))
    return ops.with_codes(parsed, "level", "level_code").select("event_id", "level", (F.col("ip") != "N/A").cast("int").alias("has_ip"), "level_code")


@query("features_rare_categories", with_views("v_logs") + """, c AS (SELECT *, service || CASE WHEN k > 97 THEN '-' || CAST(user_id AS VARCHAR) ELSE '' END AS name FROM v_logs),
n AS (SELECT name, count(*) AS n FROM c GROUP BY 1)
SELECT event_id, CASE WHEN n < 2 THEN 'OTHER' ELSE name END AS name FROM c JOIN n USING (name)""")
def features_rare_categories(spark, sf):
    named = table(spark, sf, "v_logs").select("event_id", F.expr("service || CASE WHEN k > 97 THEN '-' || CAST(user_id AS STRING) ELSE '' END").alias("name"))
    return ops.rare_to_other(named, "name").select("event_id", "name")


_SERVICES = ["CRON", "hdfs", "httpd", "sshd"]


@query("features_one_hot", with_views("v_logs") + "SELECT event_id, " + ", ".join(
    f'CAST(service = \'{s}\' AS INT) AS "service_{s}"' for s in _SERVICES) + " FROM v_logs")
def features_one_hot(spark, sf):
    return ops.one_hot(table(spark, sf, "v_logs"), "event_id", "service", _SERVICES)


_SCALED = ["digit_count", "path_count", "msg_length"]


@query("features_scaled", with_views("v_logs") + f""", f AS (SELECT event_id, {_cnt(_M, chr(92) + 'p{Nd}')} AS digit_count, {_cnt(_M, '/')} AS path_count, length(message) AS msg_length FROM v_logs)
SELECT event_id, """ + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in _SCALED) + " FROM f")
def features_scaled(spark, sf):
    raw = table(spark, sf, "v_logs").select("event_id", *fx.behaviour(F.col("message"), F.col("timestamp"))).select("event_id", *_SCALED)
    return ops.scaled(raw, _SCALED).select("event_id", *[F.round(c, 6).alias(c) for c in _SCALED])


@query("features_described", _C.rstrip() + f", f AS (SELECT id, {SQL_20} FROM v_messages)\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS rows, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
    f"round(CAST(max({c}) AS DOUBLE), 4) AS max, count(*) FILTER ({c} IS NULL) AS missing FROM f" for c in fx.STRUCTURED_20))
def features_described(spark, sf):
    frame = _frame_20(spark, sf)
    out = ops.describe(frame, fx.STRUCTURED_20)
    return out.select("feature", "rows", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "missing")


_CORR = ["message_length", "token_count", "digit_ratio", "special_char_count", "unique_token_ratio", "error_keyword_count", "average_token_length"]


@query("features_correlation", _C.rstrip() + f", f AS (SELECT id, {SQL_20} FROM v_messages)\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS corr FROM f" for a, b in combinations(_CORR, 2)))
def features_correlation(spark, sf):
    return ops.correlations(_frame_20(spark, sf), _CORR).withColumn("corr", F.round("corr", 3))


def _terms_sql(pattern=ops.WORD, bigrams=True):
    words = f"regexp_extract_all(lower(coalesce(message, '')), {q.quoted(pattern)})"
    tokens = f"toks AS (SELECT id, {words} AS w FROM v_messages)"
    both = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))" if bigrams else "w"
    return _C.rstrip() + f""", {tokens}, ex AS (SELECT id, unnest({both}) AS term FROM toks),
tf AS (SELECT id, term, count(*) AS tf FROM ex GROUP BY 1, 2)
"""


def _counts(spark, sf, pattern=ops.WORD, bigrams=True):
    return ops.term_counts(table(spark, sf, "v_messages"), "id", "message", pattern, bigrams)


def _tfidf_sql(max_features, min_df, max_df, sublinear):
    tf = "1 + ln(tf)" if sublinear else "tf"
    return _terms_sql() + f""", n AS (SELECT count(*) AS n FROM v_messages),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf, n GROUP BY term, n HAVING count(*) >= {min_df} AND count(*) <= {max_df} * n
  ORDER BY cf DESC, term LIMIT {max_features}),
raw_ AS (SELECT id, term, ({tf}) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n)
"""


@query("term_counts", _terms_sql() + "SELECT * FROM tf")
def term_counts(spark, sf):
    return _counts(spark, sf)


@query("number_tokens", _terms_sql(ops.NUMBER, False) + "SELECT * FROM tf")
def number_tokens(spark, sf):
    return _counts(spark, sf, ops.NUMBER, False)


@query("vocabulary", _tfidf_sql(**ops.PRESETS["corpus"]) + "SELECT * FROM vocab")
def vocabulary(spark, sf):
    vocab, _ = _vocabulary(spark, sf, "corpus")
    return spark.createDataFrame(vocab, "term string, df long, cf long")


def _vocabulary(spark, sf, preset):
    p, texts = ops.PRESETS[preset], table(spark, sf, "v_messages")
    words, pairs, both = (ops.term_counts(texts, "id", "message", bigrams=b, singles=s) for b, s in ((False, True), (True, False), (True, True)))
    n = texts.count()
    return ops.joint_vocabulary(words, pairs, both, n, p["max_features"], p["min_df"], p["max_df"]), n


def _weights(spark, sf, preset):
    vocab, n = _vocabulary(spark, sf, preset)
    out = ops.weights(table(spark, sf, "v_messages"), "id", "message", vocab, n, ops.PRESETS[preset]["sublinear"])
    return out.withColumn("weight", F.round("weight", 6))


_WEIGHTED = "SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM raw_"


@query("tf_idf_corpus", _tfidf_sql(**ops.PRESETS["corpus"]) + _WEIGHTED)
def tf_idf_corpus(spark, sf):
    return _weights(spark, sf, "corpus")


@query("tf_idf_train", _tfidf_sql(**ops.PRESETS["train"]) + _WEIGHTED)
def tf_idf_train(spark, sf):
    return _weights(spark, sf, "train")
