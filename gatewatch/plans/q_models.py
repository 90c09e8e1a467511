"""Feature and model queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import features as FE
from ..functions import patterns as PT
from ..operators import behaviour as BE
from ..operators import models as M
from ..session import stored
from . import oracle_views as O
from .q_detect import _HC, HOUR_SQL
from .registry import query

c = lambda n: F.col(n)


def _chars(col, chars):
    out = col
    for ch in chars:
        out = f"replace({out}, {O.lit(ch)}, '')"
    return f"CAST(length({col}) - length({out}) AS DOUBLE)"


def _flag(cond):
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE)"


_T = "make_timestamp(ts_us)"
_BASIC = dict(zip(FE.BASIC, [
    "CAST(length(request_uri) AS DOUBLE)", _chars("request_uri", "&"), _chars("request_uri", R.FEATURE_SPECIALS),
    _chars("request_uri", "%"), _chars("request_uri", "."), _chars("request_uri", "/"), _chars("request_uri", "?"),
    *["CAST(0 AS DOUBLE)"] * 3, *[_flag(f"request_method = '{v}'") for v in ("GET", "POST", "PUT", "DELETE")],
    _flag("request_method NOT IN ('GET','POST','PUT','DELETE')"), "CAST(length(http_user_agent) AS DOUBLE)",
    _flag(O.contains_any("lower(http_user_agent)", R.FEATURE_BOT_WORDS)), _flag("http_user_agent = ''"),
    f"CAST(hour({_T}) AS DOUBLE)", f"CAST(isodow({_T}) - 1 AS DOUBLE)", _flag(f"isodow({_T}) >= 6"),
    _flag(f"hour({_T}) < 6 OR hour({_T}) > 22"), "CAST(status AS DOUBLE)", "CAST(body_bytes_sent AS DOUBLE)",
    "request_time"]))


@query("m01_basic_features", "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in _BASIC.items()) + " FROM access_log")
def m01(d):
    return M.basic_features(d.access_log)


_TXT = "replace(lower(request_uri), '%20', ' ') || ' '"


def _count(word):
    return f"CAST((length(t) - length(replace(t, {O.lit(word)}, ''))) / {len(word)} AS DOUBLE)"


def _alt(words):
    # leftmost-first alternation, counted by marking every hit
    import re
    pat = "|".join(re.escape(w).replace("/", "/") for w in words)
    return f"CAST(len(regexp_extract_all(t, {O.lit(pat)})) AS DOUBLE)"


_ATT = {}
for _k, _ws in R.FEATURE_KEYWORDS:
    _ATT[f"{_k}_keyword_count"] = _alt(_ws)
    _ATT[f"{_k}_detected"] = _flag(f"{_alt(_ws)} > 0")
_ATT |= {
    "sql_quotes": _chars("t", "'\""), "sql_comments": f"{_count('--')} + {_count('/*')}", "sql_semicolons": _chars("t", ";"),
    "sql_unions": _count("union"), "xss_script_tags": _count("<script"),
    "xss_event_handlers": " + ".join(_flag(f"contains(t, '{w}')") for w in ("onload", "onerror", "onclick")),
    "xss_javascript": _count("javascript:"), "dir_traversal_dots": f"{_count('../')} + {_count('..' + chr(92))}",
    "dir_traversal_encoded": _count("%2e%2e"), "cmd_injection_pipes": _chars("t", "|&"),
    "cmd_injection_backticks": _chars("t", "`"), "cmd_injection_dollar": _count("$("),
    "file_inclusion_protocols": " + ".join(_flag(f"contains(t, '{w}')") for w in ("php://", "file://", "data://"))}


@query("m02_attack_features", "SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, e in _ATT.items()) + f" FROM (SELECT *, {_TXT} AS t FROM access_log) x")
def m02(d):
    return M.attack_features(d.access_log)


@query("m03_behaviour_features", f"""
SELECT event_id, {', '.join(_HC)}, CAST(length(request_uri) AS DOUBLE) AS url_length, {_count('union')} AS sql_unions FROM (SELECT *, {_TXT} AS t FROM ({HOUR_SQL}) h) x""")
def m03(d):
    f = M.all_features(d.access_log)
    return f.select("event_id", *[F.round(x, 6).alias(x) if "time" in x else x for x in _HC], "url_length", "sql_unions")


@query("m04_char_tfidf", """
SELECT event_id, round(sum(w) / sqrt(sum(w * w)), 6) AS weight_sum, count(*) AS terms FROM (
 SELECT event_id, g, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM (SELECT event_id, g, CAST(count(*) AS DOUBLE) AS tf FROM grams GROUP BY 1, 2) t
 JOIN (SELECT g, CAST(count(DISTINCT event_id) AS DOUBLE) AS df FROM grams GROUP BY 1) d USING (g), (SELECT CAST(count(*) AS DOUBLE) AS n FROM access_log) m) x GROUP BY 1""")
def m04(d):
    t, _ = M.char_tfidf(d.access_log.select("event_id", "request_uri"), "request_uri", max_features=100_000)
    v = vector_to_array("tfidf")
    return t.select("event_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("weight_sum"),
                    F.size(F.filter(v, lambda x: x > 0)).cast("bigint").alias("terms"))


@query("m05_scale_encode", """
SELECT event_id, round((body_bytes_sent - avg(body_bytes_sent) OVER ()) / stddev_pop(body_bytes_sent) OVER (), 6) AS bytes_z,
 round((status - avg(status) OVER ()) / stddev_pop(status) OVER (), 6) AS status_z, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS label_index FROM access_log""")
def m05(d):
    s = M.standardise(d.access_log.select("event_id", "event_type", "body_bytes_sent", "status"), ["body_bytes_sent", "status"])
    e, _ = M.encode_labels(s, "event_type")
    return e.select("event_id", F.round(c("scaled")[0], 6).alias("bytes_z"), F.round(c("scaled")[1], 6).alias("status_z"),
                    "label_index")


def _labelled(d):
    rows = d.access_log.withColumn("label", F.coalesce(F.substring_index(PT.first_attack_match(), ":", 1), F.lit("normal")))
    f = stored(M.all_features(rows, ("event_id", "label")))  # scaling, fits, scores and predictions each read it
    return f, [x for x in f.columns if x not in ("event_id", "label")]


@query("m06_random_forest")
def m06(d):
    f, cols = _labelled(d)
    model, got = M.train_random_forest(f, cols, "label", "event_id", trees=20, depth=8)
    return M.classify(model, f, cols, got["classes"], "RandomForest").groupBy("label", "attack_type").agg(F.count("*").alias("n"))


@query("m07_isolation_forest")
def m07(d):
    rows = d.access_log.withColumn("attack_label", PT.first_attack_match())
    f = BE.anomaly_features(rows, 1704067920000000)
    names = [x for x in f.columns if x != "remote_addr"]
    s = M.standardise(f, names)
    forest = M.collect_forest(M.grow_forest(s, "scaled", "remote_addr"))
    scored = M.flag_anomalies(M.score_forest(s, "scaled", forest))
    return scored.select("remote_addr", "anomaly_score", "decision", "is_anomaly")


@query("m08_dense_network")
def m08(d):
    f, cols = _labelled(d)
    s = M.standardise(f, cols)
    wide = s.select("event_id", "label", *[c("scaled")[i].alias(f"x{i}") for i in range(len(cols))])
    xs = [f"x{i}" for i in range(len(cols))]
    model, classes = M.train_perceptron(wide, xs, "label")
    return M.classify(model, wide, xs, classes, "DenseNetwork").groupBy("label", "attack_type").agg(F.count("*").alias("n"))


def _votes(d):
    """Three rule-based models over the log, as a prediction table."""
    a, e = d.access_log, c("event_id")
    mk = lambda name, hit, kind, conf: a.select(
        "event_id", F.lit(name).alias("model_name"), hit.alias("is_attack"), F.when(hit, F.lit(kind)).alias("attack_type"),
        F.lit(conf).alias("confidence"), F.create_map(F.lit("normal"), F.when(hit, 1 - conf).otherwise(conf),
                                                      F.lit("attack"), F.when(hit, conf).otherwise(1 - conf)).alias("probability_scores"))
    return (mk("a", e % 3 == 0, "sql_injection", 0.9).unionByName(mk("b", e % 2 == 0, "xss", 0.8))
            .unionByName(mk("z", e % 5 == 0, "anomaly", 0.6)))


@query("m09_ensemble_vote", """
SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 0.2 ELSE 0 END) > 0.5 AS is_attack,
 CASE WHEN event_id % 3 = 0 THEN 'sql_injection' WHEN event_id % 2 = 0 THEN 'xss' WHEN event_id % 5 = 0 THEN 'anomaly' END AS attack_type, CAST(0.81 AS DOUBLE) AS confidence,
 CAST(round(0.5 * CASE WHEN event_id % 3 = 0 THEN 0.9 ELSE 0.1 END + 0.3 * CASE WHEN event_id % 2 = 0 THEN 0.8 ELSE 0.2 END + 0.2 * CASE WHEN event_id % 5 = 0 THEN 0.6 ELSE 0.4 END, 6) AS DOUBLE) AS p_attack FROM access_log""")
def m09(d):
    w = d.spark.sql("SELECT * FROM VALUES ('a', 1.0D), ('b', 0.6D), ('z', 0.4D), ('off', 0.0D) AS t(model_name, weight)")
    v = M.ensemble_vote(_votes(d), w, "event_id")
    return v.select("event_id", "is_attack", "attack_type", F.round("confidence", 6).alias("confidence"),
                    F.round(c("probability_scores")["attack"], 6).alias("p_attack"))


@query("m10_best_model", """
SELECT model_name, score FROM (SELECT concat('m', user_id % 3) AS model_name, arg_max(value, (ts, event_id)) AS score FROM events GROUP BY 1) t WHERE score > 0 ORDER BY score DESC, model_name LIMIT 1""")
def m10(d):
    m = d.events.select(F.concat(F.lit("m"), (c("user_id") % 3).cast("string")).alias("model_name"),
                        c("value").alias("validation_accuracy"), F.struct("ts", "event_id").alias("trained_us"))
    return M.best_model(m)


@query("ag28_prediction_stats", f"SELECT count(*) AS total_predictions, count({O.PATTERN_LABEL}) AS attack_predictions, round(count({O.PATTERN_LABEL})/CAST(count(*) AS DOUBLE), 6) AS attack_detection_rate FROM access_log")
def ag28(d):
    p = d.access_log.select(PT.first_attack_match().isNotNull().alias("is_attack"))
    return M.prediction_statistics(p).withColumn("attack_detection_rate", F.round("attack_detection_rate", 6))
