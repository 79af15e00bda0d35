"""Classifier queries: n-grams, TF-IDF, scoring, evaluation, corpus preparation.

The corpus is rendered from three tables, one per label, by SQL that Spark and
DuckDB both read, so the oracles can build n-grams of the same lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ngrams import char_ngrams
from ..functions.sql import text
from ..operators import classify as m
from ..operators import corpus as corp
from ..operators import evaluate, robustness
from ..operators.route import confidence_filter, union_all
from ..sources import LABELS
from .coercion_queries import PERTURB_RULES, PERTURB_TEXT
from .query import Query, table

# label: (table, line). Lines of one label repeat where the row says so, to give the dedupe something to do.
_CLOCK = "concat('04:31:', lpad(CAST({0} % 60 AS STRING), 2, '0'))"
CORPUS = {
    "cisco_asa": ("customer", f"concat('<166>Mar 7 ', {_CLOCK.format('c_custkey')}, ' edge-', c_nationkey, "
                  "' %ASA-6-302013: Built inbound TCP connection ', c_custkey % 700, ' for outside:198.18.', c_nationkey, '.', c_custkey % 250, '/2027 ', c_mktsegment)"),
    "miscellaneous": ("supplier", "concat('1,2023/03/07 04:31:01,TRAFFIC,end,198.18.1.', s_nationkey, ',allow-', lower(s_name), ',trust,untrust')"),
    "proxy_access": ("customer", f"concat('198.18.', c_nationkey, '.', c_custkey % 250, ' - - [07/Mar/2023:', {_CLOCK.format('c_custkey')}, "
                     "' +0000] \"CONNECT files.example.net:443 HTTP/1.1\" 200 ', c_custkey % 900, ' \"-\" \"loom/3\" \"cs_bytes=', c_custkey % 400, ' proxy_action=tunnel ssl_bump=peek\"')"),
    "snort_alert": ("part", f"concat('03/07-', {_CLOCK.format('p_partkey')}, '.250000 [**] [1:', p_partkey % 800, ':2] PROBE ', p_brand, "
                    "' [**] [Priority: ', p_size % 4, '] {TCP} 203.0.113.', p_partkey % 250, ':55000 -> 192.0.2.80:25')"),
    "syslog": ("supplier", f"concat('<86>1 2023-03-07T', {_CLOCK.format('s_suppkey')}, 'Z loom-', s_nationkey, ' sshd ', "
               "s_suppkey, ' - - pam_unix(sshd:session): session closed for user ', lower(s_name))"),
    "web_access": ("part", f"concat('203.0.113.', p_partkey % 250, ' - - [07/Mar/2023:', {_CLOCK.format('p_partkey')}, "
                   "' +0000] \"GET /', replace(p_name, ' ', '/'), ' HTTP/1.1\" 200 ', p_partkey % 1300, ' \"-\" \"', p_brand, '\"')"),
    "zeek_conn": ("customer", "concat('{\"ts\":', 1678163400 + c_custkey % 900, ',\"id.orig_h\":\"198.18.', c_nationkey, '.7\",\"proto\":\"tcp\",\"orig_bytes\":', "
                  "c_custkey % 500, ',\"conn_state\":\"SF\",\"history\":\"ShAD\"}')"),
    "zeek_dns": ("supplier", "concat('{\"ts\":', 1678163400 + s_suppkey, ',\"query\":\"host', s_suppkey, '.example.net\",\"qclass_name\":\"C_INTERNET\",\"qtype_name\":\"A\",\"AA\":true}')"),
    "zeek_http": ("part", "concat('{\"ts\":', 1678163400 + p_partkey % 900, ',\"trans_depth\":1,\"method\":\"GET\",\"host\":\"garden.example\",\"uri\":\"/', "
                  "replace(p_name, ' ', '-'), '\",\"user_agent\":\"spade\"}')"),
}
# Lines of formats no label stands for.
FOREIGN = ("nation", "concat('CEF:0|Acme|Gate|1|', n_nationkey, '|note|3|msg=hello from ', lower(n_name))")

# A small fixed model: classes in order, one intercept each, and weighted terms (classes that are not named get the rest).
CLASSES = LABELS
INTERCEPTS = (-0.25, 0.05, 0.0, 0.1, 0.1, 0.15, -0.1, -0.05, 0.0)
_REST = -0.4
_WEIGHTED = {
    "edge-": (2.5, {"cisco_asa": 2.0}), " %as": (2.0, {"cisco_asa": 2.5, "web_access": -1.5}), "asa": (1.5, {"cisco_asa": 1.0}),
    "built": (2.0, {"cisco_asa": 1.5}), "tcp ": (1.8, {"cisco_asa": 1.0, "snort_alert": 0.5}), "pam": (2.2, {"syslog": 2.0}),
    "sshd": (2.1, {"syslog": 2.5, "web_access": -1.5}), "user ": (1.4, {"syslog": 0.9}), "get ": (1.9, {"web_access": 2.0, "zeek_http": 0.2}),
    "http/": (2.3, {"web_access": 2.5, "proxy_access": 1.2}), "mar": (1.1, {"cisco_asa": 0.3, "web_access": 0.3}), "2023": (1.2, {"syslog": 0.3, "web_access": 0.1}),
    "tra": (1.7, {"miscellaneous": 2.2, "zeek_http": 0.4}), "ing": (1.3, {"cisco_asa": 0.1, "syslog": 0.2}), "uild": (1.6, {"cisco_asa": 0.7}),
    "[**]": (2.0, {"snort_alert": 3.0}), "peek": (1.9, {"proxy_access": 3.0}), "histo": (2.2, {"zeek_conn": 2.8}), "qclas": (2.2, {"zeek_dns": 2.8}),
    "_dept": (2.1, {"zeek_http": 2.8}), "\"ts\"": (1.0, {"zeek_conn": 0.6, "zeek_dns": 0.6, "zeek_http": 0.6}), "heron": (1.5, {"cisco_asa": 0.8}), "gate-": (1.5, {"cisco_asa": 1.4}),
}
TERMS = {t: (idf, tuple(w.get(c, _REST) for c in CLASSES)) for t, (idf, w) in _WEIGHTED.items()}


def model(spark):
    rows = [(t, idf, list(w)) for t, (idf, w) in TERMS.items()]
    terms = spark.createDataFrame(rows, "term string, idf double, weights array<double>")
    return m.LogTypeModel(CLASSES, INTERCEPTS, terms, len(TERMS))


def corpus(spark, sf_dir):
    return union_all([table(spark, sf_dir, t).selectExpr(f"{text(label)} AS label", f"{line} AS line")
                      for label, (t, line) in CORPUS.items()])


def keyed(spark, sf_dir):
    """Distinct lines with an id."""
    return corp.dedupe_lines(corpus(spark, sf_dir)).selectExpr("label", "line", "sha2(concat_ws(':', label, line), 256) AS id")


_CORPUS_SQL = " UNION ALL ".join(f"SELECT '{label}' AS label, {line} AS line FROM {t}" for label, (t, line) in CORPUS.items())
_KEYED_SQL = f"SELECT label, line, sha256(label || ':' || line) AS id FROM (SELECT DISTINCT label, line FROM ({_CORPUS_SQL}))"


def _grams_sql(lines: str) -> str:
    """Terms of ``lines`` (id, line) with their count per line."""
    return f"""
  words AS (SELECT id, ' ' || unnest(list_filter(string_split_regex(lower(line), '\\s+'), lambda w: w <> '')) || ' ' AS p FROM ({lines})),
  sizes AS (SELECT id, p, unnest(range(2, least(5, length(p)) + 1)) AS n FROM words),
  grams AS (SELECT id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM sizes),
  tf AS (SELECT id, substr(p, i, n) AS term, count(*) AS tf FROM grams GROUP BY 1, 2)"""


#: Lines whose n-grams one task counts: some 70 n-grams a line are a row each of what it holds.
LINES_PER_TASK = 20_000


def _ngrams(spark, sf_dir):
    """The lines are dealt by their key before they become n-grams, so no n-gram is moved and a task's table is bounded."""
    lines = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    dealt = lines.repartition(lines.count() // LINES_PER_TASK + 1, "c_custkey")
    return dealt.selectExpr("c_custkey", f"explode({char_ngrams('c_name')}) AS gram").groupBy(
        "c_custkey", "gram").agg(F.count("*").alias("n"))


_NGRAMS_SQL = f"WITH {_grams_sql('SELECT c_custkey AS id, c_name AS line FROM customer')} SELECT id AS c_custkey, term AS gram, tf AS n FROM tf"


def _doc_freq(spark, sf_dir):
    return m.term_statistics(keyed(spark, sf_dir))


_DOC_FREQ_SQL = f"WITH {_grams_sql(_KEYED_SQL)} SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term"


def _tfidf(spark, sf_dir):
    lines = keyed(spark, sf_dir)
    terms = m.tfidf_terms(lines)
    vectors = m.tfidf_vectors(lines, "id", "line", terms)
    return vectors.groupBy("term").agg(F.count("*").alias("n_lines"), F.round(F.sum("weight"), 4).alias("total"),
                                       F.round(F.max("weight"), 6).alias("largest"))


_TFIDF_SQL = f"""
WITH {_grams_sql(_KEYED_SQL)}, n AS (SELECT count(*) AS n FROM ({_KEYED_SQL})),
  vocabulary AS (SELECT term, ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf, n
    GROUP BY term HAVING count(*) >= 5 ORDER BY sum(tf) DESC, term LIMIT 300000),
  x AS (SELECT id, term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS x FROM tf JOIN vocabulary USING (term)),
  w AS (SELECT term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x)
SELECT term, count(*) AS n_lines, round(sum(w), 4) AS total, round(max(w), 6) AS largest FROM w GROUP BY term"""


def _scored(lines: str) -> str:
    """CTEs that end in ``scored``: id and one probability per class of the fixed model."""
    values = ", ".join(f"({text(t)}, {idf}::DOUBLE, {', '.join(f'{w}::DOUBLE' for w in ws)})" for t, (idf, ws) in TERMS.items())
    n = range(len(CLASSES))
    return f"""{_grams_sql(lines)},
  model AS (SELECT * FROM (VALUES {values}) AS v(term, idf, {', '.join(f'w{i}' for i in n)})),
  dots AS (SELECT id, sqrt(sum(x * x)) AS norm, {', '.join(f'sum(x * w{i}) AS s{i}' for i in n)} FROM
    (SELECT id, (1 + ln(CAST(tf AS DOUBLE))) * idf AS x, {', '.join(f'w{i}' for i in n)} FROM tf JOIN model USING (term)) GROUP BY id),
  margins AS (SELECT l.id, {', '.join(f'coalesce(s{i} / norm, 0) + ({b}::DOUBLE) AS m{i}' for i, b in enumerate(INTERCEPTS))}
    FROM ({lines}) AS l LEFT JOIN dots ON l.id = dots.id),
  exps AS (SELECT id, {', '.join(f'exp(m{i} - greatest({", ".join(f"m{k}" for k in n)})) AS e{i}' for i in n)} FROM margins),
  scored AS (SELECT id, {', '.join(f'e{i} / ({" + ".join(f"e{k}" for k in n)}) AS p{i}' for i in n)} FROM exps)"""


_PS = ", ".join(f"p{i}" for i in range(len(CLASSES)))
_BEST = "CASE " + " ".join(f"WHEN p{i} = greatest({_PS}) THEN '{c}'" for i, c in reversed(list(enumerate(CLASSES)))) + " END"


def _score(spark, sf_dir):
    scored = m.score(keyed(spark, sf_dir), "id", "line", model(spark))
    return scored.selectExpr("id", *[f"round(probabilities[{i}], 6) AS p_{c}" for i, c in enumerate(CLASSES)])


_SCORE_SQL = f"WITH {_scored(_KEYED_SQL)} SELECT id, {', '.join(f'round(p{i}, 6) AS p_{c}' for i, c in enumerate(CLASSES))} FROM scored"


def _predict(spark, sf_dir):
    lines = keyed(spark, sf_dir)
    return m.predictions(m.score(lines, "id", "line", model(spark)), CLASSES)


def _score_log_type(spark, sf_dir):
    """What a run does with its lines; ones that stand several times are scored each for itself."""
    lines = keyed(spark, sf_dir)
    twice = lines.unionByName(lines.filter("substr(id, 1, 1) = '0'"))
    return m.classify(twice, model(spark), 0.8, "line").selectExpr("id", "log_type", "confidence", "candidates[0].label AS label")


_SCORE_LOG_TYPE_SQL = f"""WITH {_scored(_KEYED_SQL)} SELECT id, CASE WHEN greatest({_PS}) >= 0.8 THEN {_BEST} ELSE 'unknown' END AS log_type,
  round(greatest({_PS}), 4) AS confidence, {_BEST} AS label FROM scored, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR substr(id, 1, 1) = '0'"""


def _top2(spark, sf_dir):
    return _predict(spark, sf_dir).selectExpr(
        "id", "candidates[0].label AS first", "candidates[0].p AS first_p", "candidates[1].label AS second", "candidates[1].p AS second_p")


_TOP2_SQL = f"""WITH {_scored(_KEYED_SQL)}, long AS (SELECT id, unnest([{', '.join(f"'{c}'" for c in CLASSES)}]) AS label,
  unnest([{_PS}]) AS p, unnest(range({len(CLASSES)})) AS i FROM scored),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, i DESC) AS r FROM long)
SELECT id, max(label) FILTER (r = 1) AS first, round(max(p) FILTER (r = 1), 4) AS first_p, max(label) FILTER (r = 2) AS second,
  round(max(p) FILTER (r = 2), 4) AS second_p FROM ranked GROUP BY id"""

# Predictions for the evaluation queries: every line's label against one derived from its digest.
_PREDICTION = ("CASE WHEN substr(id, 1, 1) IN ('0', '1') THEN 'syslog' WHEN substr(id, 1, 1) = '2' THEN 'web_access' "
               "WHEN substr(id, 1, 1) = '3' THEN 'cisco_asa' ELSE label END")
_PRED_SQL = f"SELECT label, line, {_PREDICTION} AS prediction FROM ({_KEYED_SQL})"


def _pred(spark, sf_dir):
    return keyed(spark, sf_dir).selectExpr("label", "line", f"{_PREDICTION} AS prediction")


_REPORT_SQL = f"""
WITH p AS ({_PRED_SQL}), c AS (SELECT unnest([{', '.join(f"'{c}'" for c in CLASSES)}]) AS class),
  t AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS given,
    count(*) FILTER (label = class AND prediction = class) AS hit FROM c, p GROUP BY class),
  r AS (SELECT class, support, hit, hit / given AS precision, hit / support AS recall, 2.0 * hit / (given + support) AS f1 FROM t)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(sum(hit) AS DOUBLE) / CAST(sum(support) AS DOUBLE), 4), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / CAST(sum(support) AS DOUBLE), 4),
  round(sum(recall * support) / CAST(sum(support) AS DOUBLE), 4), round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 4), CAST(sum(support) AS BIGINT) FROM r"""

_CONFUSION_SQL = (f"SELECT label, " + ", ".join(f"count(*) FILTER (prediction = '{c}') AS as_{c}" for c in CLASSES)
                  + f" FROM ({_PRED_SQL}) GROUP BY label")


def _ranked_sql(seed: int) -> str:
    return (f"SELECT label, line, row_number() OVER (PARTITION BY label ORDER BY sha256('{seed}:' || line)) AS i, "
            f"count(*) OVER (PARTITION BY label) AS total FROM (SELECT DISTINCT label, line FROM ({_CORPUS_SQL}))")


# The cap of the query is small enough to cut the larger labels at every scale factor.
_CAP = 90


def _robust_sample(spark, sf_dir):
    """All lines that carry what the perturbation changes, under two labels, one in five of them twice."""
    lines = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ROBUST_LABEL} AS label", f"{PERTURB_TEXT} AS line")
    return lines.unionByName(lines.filter("c_custkey % 5 = 0")).drop("c_custkey")


_ROBUST_LABEL = "CASE WHEN c_custkey % 3 = 0 THEN 'syslog' ELSE 'cisco_asa' END"


def _robustness(spark, sf_dir):
    report = robustness.robustness(_robust_sample(spark, sf_dir), model(spark), 7, PERTURB_RULES)
    return report.selectExpr("label", *[f"round({c}, 4) AS {c}" for c in report.columns if c != "label"])


def _robustness_sql():
    from .coercion_queries import _PERTURBED_SQL
    original = f"SELECT 'o:' || c_custkey AS id, {PERTURB_TEXT} AS line FROM customer"
    changed = f"SELECT 'p:' || c_custkey AS id, line FROM ({_PERTURBED_SQL})"
    return f"""WITH {_scored(original + ' UNION ALL ' + changed)}, s AS (SELECT id, {_BEST} AS prediction, greatest({_PS}) AS confidence FROM scored),
  r AS (SELECT {_ROBUST_LABEL} AS label, o.prediction AS op, o.confidence AS oc, p.prediction AS pp, p.confidence AS pc
    FROM customer, (SELECT unnest([1, 2]) AS copy), s AS o, s AS p
    WHERE (copy = 1 OR c_custkey % 5 = 0) AND o.id = 'o:' || c_custkey AND p.id = 'p:' || c_custkey)
SELECT label, round(avg(CASE WHEN op = label THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg(CASE WHEN pp = label THEN 1.0 ELSE 0.0 END), 4) AS p_accuracy,
  round(avg(oc), 4) AS mean_confidence, round(avg(pc), 4) AS p_mean_confidence, round(min(pc), 4) AS p_min_confidence FROM r GROUP BY label"""


def _with_foreign(spark, sf_dir):
    t, line = FOREIGN
    return corpus(spark, sf_dir).unionByName(table(spark, sf_dir, t).selectExpr("'foreign' AS label", f"{line} AS line"))


def _ood(spark, sf_dir):
    return robustness.ood_probe(_with_foreign(spark, sf_dir), model(spark), CLASSES).selectExpr(
        "line", "label", "round(confidence, 4) AS confidence")


_OOD_SQL = f"""WITH {_scored(f'SELECT sha256({FOREIGN[1]}) AS id, {FOREIGN[1]} AS line FROM {FOREIGN[0]}')}
SELECT line, {_BEST} AS label, round(greatest({_PS}), 4) AS confidence
FROM scored JOIN (SELECT sha256({FOREIGN[1]}) AS id, {FOREIGN[1]} AS line FROM {FOREIGN[0]}) USING (id)"""


def _train(spark, sf_dir):
    """Fit on the training part of the corpus, judge on the rest. The formats are unlike, so every held-out line has to come out right."""
    split = corp.stratified_split(corp.cap_per_class(corp.dedupe_lines(corpus(spark, sf_dir))))
    fitted = m.train(split.filter("NOT is_test"))
    scored = m.predictions(m.with_probabilities(split.filter("is_test").withColumnRenamed("label", "truth"), "line", fitted), fitted.classes)
    return evaluate.classification_report(scored.selectExpr("truth AS label", "label AS prediction"))


_TRAIN_SQL = f"""
WITH t AS (SELECT label, count(*) AS n FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY i) AS i, count(*) OVER (PARTITION BY label) AS total
  FROM ({_ranked_sql(42)}) WHERE i <= {corp.PER_CLASS}) WHERE i <= round(total * 0.2) GROUP BY label)
SELECT label AS class, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1, n AS support FROM t
UNION ALL SELECT 'accuracy', NULL, NULL, 1, CAST(sum(n) AS BIGINT) FROM t
UNION ALL SELECT unnest(['macro avg', 'weighted avg']), 1, 1, 1, CAST(sum(n) AS BIGINT) FROM t"""

QUERIES = [
    Query("char_ngrams", _ngrams, _NGRAMS_SQL),
    Query("doc_freq", _doc_freq, _DOC_FREQ_SQL),
    Query("tfidf_vectors", _tfidf, _TFIDF_SQL),
    Query("score_join", _score, _SCORE_SQL),
    Query("score_log_type", _score_log_type, _SCORE_LOG_TYPE_SQL),
    Query("top2_candidates", _top2, _TOP2_SQL),
    Query("train_log_type", _train, _TRAIN_SQL),
    Query("dedupe_lines", lambda s, d: corp.dedupe_lines(corpus(s, d)), f"SELECT DISTINCT label, line FROM ({_CORPUS_SQL})"),
    Query("samples_per_label", lambda s, d: corp.samples_per_label(corpus(s, d)),
          f"SELECT label, count(*) AS n, CAST({len(CORPUS)} AS BIGINT) AS n_labels FROM ({_CORPUS_SQL}) GROUP BY label"),
    Query("class_cap", lambda s, d: corp.cap_per_class(corp.dedupe_lines(corpus(s, d)), _CAP),
          f"SELECT label, line FROM ({_ranked_sql(42)}) WHERE i <= {_CAP}"),
    Query("labelled_sample", lambda s, d: corp.sample_per_label(corp.dedupe_lines(corpus(s, d))),
          f"SELECT label, line FROM ({_ranked_sql(0)}) WHERE i <= {corp.SAMPLE_SIZE}"),
    Query("stratified_split", lambda s, d: corp.stratified_split(corp.dedupe_lines(corpus(s, d))),
          f"SELECT label, line, i <= round(total * 0.2) AS is_test FROM ({_ranked_sql(42)})"),
    Query("classification_report", lambda s, d: evaluate.classification_report(_pred(s, d)), _REPORT_SQL),
    Query("confusion_matrix", lambda s, d: evaluate.confusion_matrix(_pred(s, d), list(CLASSES)), _CONFUSION_SQL),
    Query("top_misclassified", lambda s, d: evaluate.top_misclassified(_pred(s, d)),
          f"SELECT label, prediction, substr(line, 1, 120) AS line FROM ({_PRED_SQL}) WHERE label <> prediction ORDER BY label, prediction, line LIMIT 10"),
    Query("robustness_report", _robustness, _robustness_sql()),
    Query("ood_probe", _ood, _OOD_SQL),
]
