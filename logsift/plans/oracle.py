"""Oracle SQL (DuckDB dialect) for the registered queries.

Each statement recomputes its query from the raw tables with plain SQL, so
that a mismatch points at the Spark plan.  The shared views are written as
CTEs; constants (weights, templates, fixed model, thresholds) come from the
same modules as the Spark side.
"""

from __future__ import annotations

from logsift.constants import (ALPHA, AMBIGUOUS_SHARE, BUCKETS, CANARY_SHARE, CLASS_WEIGHTS,
                               CLASSES, CONFIDENCE_BUCKETS, DASHBOARD_URL,
                               DOUBLE_REVIEW_SHARE, DRIFT_THRESHOLD, INCIDENT_CATEGORIES,
                               LATENCY_BUCKETS, MAX_FEATURES, METRIC_CONFIDENCE,
                               METRIC_LATENCY, METRIC_LOADED, METRIC_REQUESTS,
                               REQUEST_SIZE, REVIEW_THRESHOLD, REVIEWED_SHARE,
                               SEVERITY_DRIFT, SEVERITY_HIGH, SEVERITY_REVIEW,
                               SHIFT_EPSILON, SNIPPET_CHARS, STATUS_OK, TRAIN_SHARE,
                               UNKNOWN_VERSION)
from logsift.functions.buckets import bucket_sql, cumulative_cuts
from logsift.functions.histogram import bound_label
from logsift.operators.corpus import (AMBIGUOUS_TEMPLATES, CLEAR_TEMPLATES,
                                      SLOT_CHOICES, SLOT_NUMBERS, template_parts)
from logsift.plans.fixed_model import (FIXED_CLASSES, FIXED_INTERCEPTS, FIXED_TERMS,
                                       FIXED_VERSION, WIDE_CENTRE, WIDE_CLASSES, WIDE_INTERCEPTS,
                                       WIDE_SCALE, WIDE_VERSION)
from logsift.operators.validate import REQUIRED
from logsift.plans.views import DEFECT_SHARE, LIFECYCLE_VERSIONS

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _b(salt: str, key: str = "rid") -> str:
    return bucket_sql(key, salt)


def _num(salt: str, base: int, span: int) -> str:
    return f"CAST({base} + {_b(salt)} % {span} AS VARCHAR)"


def _slot(name: str) -> str:
    if name in SLOT_NUMBERS:
        base, span = SLOT_NUMBERS[name]
        return _num(name, base, span)
    values = SLOT_CHOICES[name]
    return f"{_list(values)}[{_b(name)} % {len(values)} + 1]"


def _render(template: str) -> str:
    return "concat(" + ", ".join(q(v) if k == "lit" else _slot(v)
                                 for k, v in template_parts(template)) + ")"


def _class_case() -> str:
    cuts = cumulative_cuts(CLASS_WEIGHTS)
    b = _b("class")
    whens = " ".join(f"WHEN {b} < {c} THEN {q(v)}" for v, c in zip(CLASSES[:-1], cuts[:-1]))
    return f"CASE {whens} ELSE {q(CLASSES[-1])} END"


def _message_case() -> str:
    tb = _b("template")
    whens = []
    for cls in CLASSES:
        for family, amb in ((CLEAR_TEMPLATES, "false"), (AMBIGUOUS_TEMPLATES, "true")):
            temps = family[cls]
            for i, t in enumerate(temps):
                whens.append(f"WHEN true_label = {q(cls)} AND ambiguous = {amb} "
                             f"AND {tb} % {len(temps)} = {i} THEN {_render(t)}")
    return "CASE " + " ".join(whens) + " END"


def logs_cte() -> str:
    amb_cut = int(round(AMBIGUOUS_SHARE * BUCKETS))
    split_cut = int(round(TRAIN_SHARE * BUCKETS))
    return f"""logs0 AS (
  SELECT event_id AS rid, ts AS event_time FROM events
), logs1 AS (
  SELECT rid, sha256(CAST(rid AS VARCHAR)) AS log_id, event_time,
         strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS "timestamp",
         {_list(["api_gateway", "auth_service", "db_primary"])}[{_b('source')} % 3 + 1] AS source,
         {_class_case()} AS true_label,
         {_b('ambiguous')} < {amb_cut} AS ambiguous,
         CASE WHEN {_b('split')} < {split_cut} THEN 'train' ELSE 'test' END AS split
  FROM logs0
), logs AS (
  SELECT rid, log_id, event_time, "timestamp", source,
         CASE WHEN true_label = 'noise' THEN 'INFO' ELSE upper(true_label) END AS level,
         {_message_case()} AS message, true_label, ambiguous, split
  FROM logs1
)"""


def _model_values() -> str:
    rows = ", ".join("(" + ", ".join([q(t[0])] + [repr(float(x)) for x in t[1:]]) + ")"
                     for t in FIXED_TERMS)
    k = len(FIXED_CLASSES)
    cols = ", ".join(["term", "idf"] + [f"w_{i}" for i in range(k)])
    return f"model({cols}) AS (VALUES {rows})"


def terms_sql(text_sql: str) -> str:
    """Lower-cased tokens as a DuckDB list (bigrams are added where used)."""
    return f"regexp_extract_all(lower({text_sql}), '{TOKEN_RE}')"


def _sums_sql(k: int, key: str, model: str = "model") -> str:
    """Squared norm and dot products of the records' terms ``tf``."""
    d_cols = ", ".join(f"sum(x * w_{i}) AS d{i}" for i in range(k))
    return f"""hit AS (SELECT tf.{key}, tf.tf * {model}.idf AS x, {model}.* FROM tf JOIN {model} USING (term)),
sums AS (SELECT {key}, sum(x * x) AS ss, {d_cols} FROM hit GROUP BY {key})"""


def _decide_sql(classes, intercepts, version: str, rows: str, key: str) -> str:
    """Margins, probabilities and decision of the records ``rows``."""
    margins = ", ".join(
        f"{float(b)!r} + coalesce(d{i} / sqrt(ss), 0.0) AS m_{c}"
        for i, (c, b) in enumerate(zip(classes, intercepts)))
    sig = ", ".join(f"1.0 / (1.0 + exp(-m_{c})) AS s_{c}" for c in classes)
    all_s = " + ".join(f"s_{c}" for c in classes)
    probs = ", ".join(f"s_{c} / ({all_s}) AS p_{c}" for c in classes)
    best = "greatest(" + ", ".join(f"m_{c}" for c in classes) + ")"
    cat = "CASE " + " ".join(f"WHEN m_{c} = {best} THEN {q(c)}" for c in classes) + " END"
    conf = "CASE " + " ".join(f"WHEN m_{c} = {best} THEN p_{c}" for c in classes) + " END"
    return f"""marg AS (SELECT {rows}.*, {margins} FROM {rows} LEFT JOIN sums USING ({key})),
sig AS (SELECT *, {sig} FROM marg),
prob AS (SELECT *, {probs} FROM sig),
scored AS (SELECT *, {cat} AS category, {conf} AS confidence,
                  ({conf}) < {REVIEW_THRESHOLD} AS needs_review,
                  {q(version)} AS model_version FROM prob)"""


def scored_cte(where: str = "") -> str:
    return f"""{_model_values()},
slog AS (SELECT * FROM logs {where}),
tok AS (SELECT rid, {terms_sql('message')} AS t FROM slog),
trm AS (SELECT rid, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS term FROM tok),
tf AS (SELECT rid, term, count(*) AS tf FROM trm GROUP BY rid, term),
{_sums_sql(len(FIXED_CLASSES), 'rid')},
{_decide_sql(FIXED_CLASSES, FIXED_INTERCEPTS, FIXED_VERSION, 'slog', 'rid')}"""


def with_logs(body: str) -> str:
    return f"WITH {logs_cte()}\n{body}"


def with_scored(body: str, where: str = "") -> str:
    return f"WITH {logs_cte()},\n{scored_cte(where)}\n{body}"


def r(expr: str) -> str:
    return f"round({expr}, 6)"


TEST = "WHERE split = 'test'"


def _hist(value_sql: str, source: str, bounds, metric: str) -> str:
    parts = []
    for b in bounds:
        parts.append(f"SELECT '{metric}_bucket' AS metric, {q(bound_label(b))} AS le, "
                     f"CAST(count(*) FILTER (WHERE {value_sql} <= {b!r}) AS DOUBLE) AS value FROM {source}")
    parts.append(f"SELECT '{metric}_bucket', '+Inf', CAST(count({value_sql}) AS DOUBLE) FROM {source}")
    parts.append(f"SELECT '{metric}_sum', NULL, coalesce(sum({value_sql}), 0.0) FROM {source}")
    parts.append(f"SELECT '{metric}_count', NULL, CAST(count({value_sql}) AS DOUBLE) FROM {source}")
    return "\nUNION ALL ".join(parts)


def _docs_terms_cte(where: str = "") -> str:
    return f"""dt AS (SELECT doc_id, {terms_sql('text')} AS t FROM documents {where}),
dterm AS (SELECT doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS term FROM dt),
dtf AS (SELECT doc_id, term, count(*) AS tf FROM dterm GROUP BY doc_id, term)"""


def _idf_cte(src: str, n_docs_sql: str) -> str:
    return f"""dfq AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(doc_id) AS df FROM {src} GROUP BY term),
vocab AS (SELECT * FROM dfq ORDER BY cf DESC, term ASC LIMIT {MAX_FEATURES}),
idf AS (SELECT term, df, ln((1.0 + ({n_docs_sql})) / (1.0 + df)) + 1.0 AS idf FROM vocab)"""


def _tfidf_body(tf_src: str) -> str:
    return f"""x AS (SELECT t.doc_id, t.term, t.tf * i.idf AS x FROM {tf_src} t JOIN idf i USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id)
SELECT x.doc_id, x.term, {r('x.x / nrm.norm')} AS tfidf FROM x JOIN nrm USING (doc_id)"""


def _split_docs(split: str) -> str:
    cut = int(round(TRAIN_SHARE * BUCKETS))
    op = "<" if split == "train" else ">="
    return f"WHERE {bucket_sql('doc_id', 'split')} {op} {cut}"


def _rolling_cte() -> str:
    return """part AS (
  SELECT floor(epoch_us(event_time) / 60000000)::BIGINT AS slot, sum(confidence) AS s, count(*) AS c
  FROM scored WHERE event_time IS NOT NULL AND confidence IS NOT NULL GROUP BY 1
), spread AS (SELECT slot - k AS start_slot, s, c FROM part, range(5) AS rk(k)),
win AS (SELECT start_slot, sum(s) AS s, CAST(sum(c) AS BIGINT) AS n FROM spread GROUP BY start_slot),
rolling AS (
  SELECT make_timestamp(start_slot * 60000000) AS window_start,
         make_timestamp(start_slot * 60000000 + 300000000) AS window_end,
         n, s / n AS avg_confidence FROM win
)"""


def _severity_sql() -> str:
    inc = ", ".join(q(c) for c in INCIDENT_CATEGORIES)
    return (f"CASE WHEN category IN ({inc}) AND confidence >= {REVIEW_THRESHOLD} THEN {q(SEVERITY_HIGH)} "
            f"WHEN category IN ({inc}) AND confidence < {REVIEW_THRESHOLD} THEN {q(SEVERITY_REVIEW)} END")


def _reviews_cte() -> str:
    rev = int(round(REVIEWED_SHARE * BUCKETS))
    dbl = int(round(DOUBLE_REVIEW_SHARE * BUCKETS))
    return f"""flagged AS (SELECT * FROM scored WHERE needs_review AND {_b('reviewed')} < {rev}),
reviews AS (
  SELECT rid * 2 + 1 AS id, log_id, message, category AS predicted_category,
         true_label AS true_category, event_time + INTERVAL 1 HOUR AS "timestamp" FROM flagged
  UNION ALL
  SELECT rid * 2, log_id, message, category, category, event_time + INTERVAL 30 MINUTE
  FROM flagged WHERE {_b('double')} < {dbl}
),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY "timestamp" DESC, id DESC) AS rn
    FROM reviews) WHERE rn = 1
)"""


def _track_sql() -> str:
    cut = int(round(CANARY_SHARE * BUCKETS))
    return f"CASE WHEN {_b('track')} < {cut} THEN 'canary' ELSE 'stable' END"


def _lifecycle_cte() -> str:
    vb = bucket_sql("event_id", "version")
    return f"""life AS (
  SELECT {_list(LIFECYCLE_VERSIONS)}[{vb} % {len(LIFECYCLE_VERSIONS)} + 1] AS version, ts, event_id AS seq,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS value
  FROM events WHERE event_type IN ('signup', 'error')
), gauge AS (
  SELECT version, CAST(value AS DOUBLE) AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY version ORDER BY ts DESC, seq DESC) AS rn FROM life)
  WHERE rn = 1
)"""


def _labels_sql(*pairs) -> str:
    inner = []
    for i, (name, col) in enumerate(pairs):
        inner.append(q(("," if i else "") + f'{name}="') + f" || {col} || " + q('"'))
    return "'{' || " + " || ".join(inner) + " || '}'"


def _report_cte() -> str:
    return """conf AS (SELECT true_label, category, count(*) AS n FROM scored GROUP BY 1, 2),
pt AS (SELECT true_label AS label, sum(n) AS support,
              sum(CASE WHEN true_label = category THEN n ELSE 0 END) AS tp FROM conf GROUP BY 1),
pp AS (SELECT category AS label, sum(n) AS predicted FROM conf GROUP BY 1),
rep0 AS (SELECT coalesce(pt.label, pp.label) AS label, coalesce(tp, 0) AS tp,
                coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
         FROM pt FULL OUTER JOIN pp ON pt.label = pp.label),
rep1 AS (SELECT label, tp, support,
                CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
                CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM rep0),
rep AS (SELECT label, precision, recall,
               CASE WHEN precision + recall = 0 THEN 0.0
                    ELSE 2.0 * precision * recall / (precision + recall) END AS f1,
               CAST(support AS BIGINT) AS support, tp FROM rep1)"""


def oracle_sql() -> dict[str, str]:
    lab = '"timestamp", source, level, message, true_label'
    docs_all = f"WITH {_docs_terms_cte()}"
    s: dict[str, str] = {}

    # corpus / projections
    s["log_scan"] = with_logs(f"SELECT {lab} FROM logs")
    s["label_mask"] = with_logs('SELECT log_id, "timestamp", source, level, message FROM logs')
    cut = int(round(DEFECT_SHARE * BUCKETS))
    kept = ", ".join(f"CASE WHEN NOT ({_b('defect')} < {cut} AND {_b('field')} % {len(REQUIRED)} = {i}) THEN \"{c}\" END AS \"{c}\""
                     for i, c in enumerate(REQUIRED))
    s["validate_logs"] = with_logs(
        f", defective AS (SELECT log_id, {kept} FROM logs)\n"
        "SELECT log_id, (\"timestamp\" IS NOT NULL AND source IS NOT NULL AND level IS NOT NULL "
        "AND message IS NOT NULL) AS is_valid, "
        "CASE WHEN \"timestamp\" IS NULL THEN 'missing timestamp' WHEN source IS NULL THEN 'missing source' "
        "WHEN level IS NULL THEN 'missing level' WHEN message IS NULL THEN 'missing message' END AS reason "
        "FROM defective")
    line = " || ',' || ".join(f"'\"' || replace({c}, '\"', '\"\"') || '\"'" for c in ('"timestamp"', "source", "level", "message", "true_label"))
    good = ", ".join(f"CASE WHEN {_b('csv')} >= {2 * cut} THEN {c} END AS {c}" for c in ('"timestamp"', "source", "level", "message", "true_label"))
    s["log_scan_csv"] = with_logs(
        f"SELECT {good}, CASE WHEN {_b('csv')} < {cut} THEN \"timestamp\" || ',' || source "
        f"WHEN {_b('csv')} < {2 * cut} THEN {line} || ',more' END AS bad_line FROM logs")
    s["level_from_category"] = with_logs(
        "SELECT true_label, level, count(*) AS n FROM logs GROUP BY 1, 2")
    s["weighted_mix"] = with_logs(
        f"SELECT true_label, n, {r('n / sum(n) OVER ()')} AS share FROM "
        "(SELECT true_label, count(*) AS n FROM logs GROUP BY 1)")
    s["render_logs"] = with_logs("SELECT log_id, true_label, message FROM logs")
    s["ambiguous_share"] = with_logs(
        f"SELECT true_label, count(*) AS n, count(*) FILTER (WHERE ambiguous) AS n_ambiguous, "
        f"{r('avg(CASE WHEN ambiguous THEN 1.0 ELSE 0.0 END)')} AS share FROM logs GROUP BY 1")
    s["train_test_split"] = with_logs("SELECT log_id, split FROM logs")
    s["log_id"] = with_logs("SELECT rid, log_id FROM logs")
    s["version_fallback"] = with_scored(
        f"SELECT track, model_version, count(*) AS n FROM ("
        f"SELECT {_track_sql()} AS track, CASE WHEN {_track_sql()} = 'canary' THEN {q(UNKNOWN_VERSION)} "
        f"ELSE model_version END AS model_version FROM scored) GROUP BY 1, 2")

    tgt = ", ".join(f"({q(k)}, {v!r})" for k, v in {"en": 0.70, "fr": 0.15, "de": 0.10, "es": 0.05}.items())
    s["class_mix_resample"] = f"""WITH tgt(lang, target) AS (VALUES {tgt}),
cnt AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
frac AS (SELECT lang, target * min(n / target) OVER () / n AS keep FROM cnt JOIN tgt USING (lang))
SELECT d.doc_id, d.lang FROM documents d JOIN frac USING (lang)
WHERE {bucket_sql('d.doc_id', 'resample')} < keep * {BUCKETS}"""

    # envelopes
    s["envelope_explode"] = with_logs(
        f"SELECT CAST(rid // {REQUEST_SIZE} AS BIGINT) AS request_id, "
        f"CAST(row_number() OVER (PARTITION BY rid // {REQUEST_SIZE} ORDER BY rid % {REQUEST_SIZE}) - 1 AS INTEGER) AS pos, "
        "\"timestamp\", source, level, message FROM logs")
    s["envelope_collect"] = with_scored(
        f"SELECT CAST(rid // {REQUEST_SIZE} AS BIGINT) AS request_id, CAST(count(*) AS INTEGER) AS n_results, "
        f"string_agg(log_id, ',' ORDER BY rid % {REQUEST_SIZE}) AS log_ids, "
        f"string_agg(category, ',' ORDER BY rid % {REQUEST_SIZE}) AS categories, "
        "CAST(count(*) FILTER (WHERE needs_review) AS INTEGER) AS n_review FROM scored GROUP BY 1")

    # text features
    tok = f"regexp_extract_all(lower(text), '{TOKEN_RE}')"
    s["tokenize"] = (f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
                     f"FROM (SELECT doc_id, {tok} AS t FROM documents)")
    s["ngrams"] = (f"SELECT doc_id, CAST(len(g) AS INTEGER) AS n_terms, "
                   f"CAST(len(g) - len(t) AS INTEGER) AS n_bigrams, md5(array_to_string(g, '|')) AS terms_md5 FROM ("
                   f"SELECT doc_id, t, list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS g "
                   f"FROM (SELECT doc_id, {tok} AS t FROM documents))")
    s["term_freq"] = f"{docs_all}\nSELECT doc_id, term, CAST(tf AS INTEGER) AS tf FROM dtf"
    s["doc_freq"] = f"{docs_all}\nSELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(doc_id) AS df FROM dtf GROUP BY term"
    s["vocabulary_topk"] = (f"{docs_all},\n{_idf_cte('dtf', 'SELECT count(*) FROM documents')}\n"
                            "SELECT term, cf, df, CAST(row_number() OVER (ORDER BY cf DESC, term ASC) AS INTEGER) AS rank FROM vocab")
    s["idf"] = (f"{docs_all},\n{_idf_cte('dtf', 'SELECT count(*) FROM documents')}\n"
                f"SELECT term, df, {r('idf')} AS idf FROM idf")
    s["tfidf"] = (f"{docs_all},\n{_idf_cte('dtf', 'SELECT count(*) FROM documents')},\n"
                  f"{_tfidf_body('dtf')}")
    train_where = _split_docs("train")
    test_where = _split_docs("test")
    s["oov_transform"] = (
        f"WITH {_docs_terms_cte(train_where)},\n"
        f"{_idf_cte('dtf', f'SELECT count(*) FROM documents {train_where}')},\n"
        f"tt AS (SELECT doc_id, {terms_sql('text')} AS t FROM documents {test_where}),\n"
        "tterm AS (SELECT doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS term FROM tt),\n"
        "ttf AS (SELECT doc_id, term, count(*) AS tf FROM tterm GROUP BY doc_id, term),\n"
        f"{_tfidf_body('ttf')}")
    s["label_index"] = ("SELECT lang AS class, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_index, n "
                        "FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
    cw = ("SELECT {task} AS task, class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight "
          "FROM (SELECT CAST({col} AS VARCHAR) AS class, count(*) AS n FROM {tbl} GROUP BY 1)")
    s["class_weights"] = "\nUNION ALL ".join([
        cw.format(task="'lang'", col="lang", tbl="documents"),
        cw.format(task="'toxic'", col="toxic", tbl="labels"),
        cw.format(task="'quality'", col="quality", tbl="labels")])

    # training: all but the flags is stated here; both must be true
    s["train_classifier"] = with_logs(
        f""", tr AS (SELECT true_label, message FROM logs WHERE split = 'train'),
cnt AS (SELECT true_label AS class, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k FROM tr GROUP BY 1),
voc AS (SELECT least({MAX_FEATURES}, count(DISTINCT term)) AS n_terms
        FROM (SELECT unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS term
              FROM (SELECT {terms_sql('message')} AS t FROM tr)))
SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS label_index, n,
       {r('total / (k * n)')} AS positive_weight,
       {r(f'{ALPHA} * total / (total / k + total - n)')} AS reg_param,
       CAST(n_terms AS INTEGER) AS n_terms, true AS converged, true AS stationary FROM cnt, voc""")

    # scoring
    mcols = ", ".join(f"{r('m_' + c)} AS m_{c}" for c in FIXED_CLASSES)
    pcols = ", ".join(f"{r('p_' + c)} AS p_{c}" for c in FIXED_CLASSES)
    s["margin"] = with_scored(f"SELECT log_id, {mcols} FROM scored")
    s["predict_category"] = with_scored("SELECT log_id, category FROM scored")
    s["class_probability"] = with_scored(f"SELECT log_id, {pcols} FROM scored")
    s["confidence"] = with_scored(f"SELECT log_id, category, {r('confidence')} AS confidence FROM scored")
    s["score_logs"] = with_scored(
        f"SELECT log_id, \"timestamp\", source, level, message, category, {r('confidence')} AS confidence, "
        "needs_review, model_version FROM scored")
    s["needs_review"] = with_scored(
        f"SELECT log_id, {r('confidence')} AS confidence, needs_review FROM scored")
    s["review_queue"] = with_scored(
        f"SELECT log_id, \"timestamp\", category, {r('confidence')} AS confidence, needs_review FROM scored "
        f"WHERE confidence < {REVIEW_THRESHOLD} ORDER BY \"timestamp\", log_id LIMIT 15")

    wide = ", ".join(f"({bucket_sql('term', f'w_{c}')} - {WIDE_CENTRE}) / {WIDE_SCALE!r} AS w_{i}" for i, c in enumerate(WIDE_CLASSES))
    s["score_documents_wide"] = (
        f"{docs_all},\n{_idf_cte('dtf', 'SELECT count(*) FROM documents')},\n"
        f"wide AS (SELECT term, idf, {wide} FROM idf),\ntf AS (SELECT * FROM dtf),\n"
        f"{_sums_sql(len(WIDE_CLASSES), 'doc_id', 'wide')},\n"
        f"{_decide_sql(WIDE_CLASSES, WIDE_INTERCEPTS, WIDE_VERSION, 'documents', 'doc_id')}\n"
        f"SELECT doc_id, category, {r('confidence')} AS confidence, needs_review, model_version, "
        + ", ".join(f"{r('m_' + c)} AS m_{c}" for c in WIDE_CLASSES) + " FROM scored")

    # evaluation on the test split
    s["confusion_matrix"] = with_scored(
        "SELECT true_label, category, count(*) AS n FROM scored GROUP BY 1, 2", TEST)
    s["class_report"] = with_scored(
        f"{_report_cte_prefix()}SELECT label, {r('precision')} AS precision, {r('recall')} AS recall, "
        f"{r('f1')} AS f1, support FROM rep", TEST)
    s["report_averages"] = with_scored(
        f"{_report_cte_prefix()}, tot AS (SELECT sum(support) AS n FROM rep)\n"
        f"SELECT 'accuracy' AS label, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, "
        f"{r('(SELECT sum(tp) FROM rep) / (SELECT n FROM tot)')} AS f1, CAST((SELECT n FROM tot) AS BIGINT) AS support\n"
        f"UNION ALL SELECT 'macro avg', {r('avg(precision)')}, {r('avg(recall)')}, {r('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM rep\n"
        f"UNION ALL SELECT 'weighted avg', {r('sum(precision * support) / sum(support)')}, "
        f"{r('sum(recall * support) / sum(support)')}, {r('sum(f1 * support) / sum(support)')}, "
        "CAST(sum(support) AS BIGINT) FROM rep", TEST)
    s["low_confidence_count"] = with_scored(
        f"SELECT count(*) FILTER (WHERE confidence < {REVIEW_THRESHOLD}) AS low_confidence, count(*) AS total FROM scored",
        TEST)
    s["review_gate"] = with_scored(
        f"SELECT *, low_confidence > 0 AS passed FROM (SELECT count(*) FILTER (WHERE confidence < {REVIEW_THRESHOLD}) "
        "AS low_confidence, count(*) AS total FROM scored)", TEST)

    # metrics
    s["request_counter"] = with_scored(
        f"SELECT category, {q(STATUS_OK)} AS status_code, CAST(count(*) AS DOUBLE) AS value FROM scored GROUP BY 1")
    s["confidence_histogram"] = with_scored(
        f"SELECT metric, le, {r('value')} AS value FROM ({_hist('confidence', 'scored', CONFIDENCE_BUCKETS, METRIC_CONFIDENCE)})")
    lat_src = "(SELECT value / 1000.0 AS latency_s FROM events)"
    s["latency_histogram"] = (
        f"SELECT metric, le, {r('value')} AS value FROM ({_hist('latency_s', lat_src, LATENCY_BUCKETS, METRIC_LATENCY)})")
    s["model_loaded_gauge"] = f"WITH {_lifecycle_cte()}\nSELECT version, value FROM gauge"
    counter_labels = _labels_sql(("category", "category"), ("status_code", f"{q(STATUS_OK)}"))
    s["metrics_snapshot"] = with_scored(
        f", {_lifecycle_cte()}\n"
        f"SELECT metric, labels, le, {r('value')} AS value FROM (\n"
        f"SELECT {q(METRIC_REQUESTS)} AS metric, {counter_labels} AS labels, CAST(NULL AS VARCHAR) AS le, "
        f"CAST(count(*) AS DOUBLE) AS value FROM scored GROUP BY category\n"
        f"UNION ALL SELECT metric, '{{}}', le, value FROM ({_hist('confidence', 'scored', CONFIDENCE_BUCKETS, METRIC_CONFIDENCE)})\n"
        f"UNION ALL SELECT metric, '{{}}', le, value FROM ({_hist('latency_s', lat_src, LATENCY_BUCKETS, METRIC_LATENCY)})\n"
        f"UNION ALL SELECT {q(METRIC_LOADED)}, {_labels_sql(('version', 'version'))}, NULL, value FROM gauge)")
    s["rolling_confidence"] = with_scored(
        f", {_rolling_cte()}\nSELECT window_start, window_end, n, {r('avg_confidence')} AS avg_confidence FROM rolling")
    s["latency_percentiles"] = (
        f"SELECT {r('quantile_disc(value / 1000.0, 0.9)')} AS p90, {r('quantile_disc(value / 1000.0, 0.95)')} AS p95 FROM events")
    ca = "avg(confidence) FILTER (WHERE track = 'canary')"
    st = "avg(confidence) FILTER (WHERE track = 'stable')"
    cs = "stddev_samp(confidence) FILTER (WHERE track = 'canary')"
    ss = "stddev_samp(confidence) FILTER (WHERE track = 'stable')"
    s["canary_compare"] = with_scored(
        f", tr AS (SELECT {_track_sql()} AS track, confidence FROM scored)\n"
        "SELECT count(*) FILTER (WHERE track = 'canary') AS canary_n, count(*) FILTER (WHERE track = 'stable') AS stable_n, "
        f"{r(ca)} AS canary_avg, {r(st)} AS stable_avg, {r(cs)} AS canary_stddev, {r(ss)} AS stable_stddev, "
        f"{r(ca + ' - ' + st)} AS delta_avg FROM tr")
    eps = repr(SHIFT_EPSILON)
    s["distribution_shift"] = with_scored(
        f""", rs AS (SELECT true_label AS bucket, count(*) AS n FROM logs WHERE split = 'train' GROUP BY 1),
cs AS (SELECT category AS bucket, count(*) AS n FROM scored WHERE split = 'test' GROUP BY 1),
r2 AS (SELECT bucket, n AS n_ref, n / sum(n) OVER () AS p_ref FROM rs),
c2 AS (SELECT bucket, n AS n_cur, n / sum(n) OVER () AS p_cur FROM cs),
j AS (SELECT coalesce(n_ref, 0) AS n_ref, coalesce(n_cur, 0) AS n_cur,
             greatest(coalesce(p_ref, 0.0), {eps}) AS pr, greatest(coalesce(p_cur, 0.0), {eps}) AS pc
      FROM r2 FULL OUTER JOIN c2 ON r2.bucket = c2.bucket)
SELECT CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_cur) AS BIGINT) AS n_cur, {r('sum((pc - pr) * ln(pc / pr))')} AS psi,
       {r('sum(pc * ln(pc / pr))')} AS kl FROM j""")

    # alerts
    sev = _severity_sql()
    s["alert_routing"] = with_scored(
        f"SELECT * FROM (SELECT log_id, category, {r('confidence')} AS confidence, {sev} AS severity FROM scored) "
        "WHERE severity IS NOT NULL")
    s["drift_alert"] = with_scored(
        f", {_rolling_cte()}\nSELECT window_start, window_end, n, {r('avg_confidence')} AS avg_confidence, "
        f"{q(SEVERITY_DRIFT)} AS severity FROM rolling WHERE avg_confidence < {DRIFT_THRESHOLD}")
    s["alert_payload"] = with_scored(
        f"SELECT log_id, severity, category, substr(message, 1, {SNIPPET_CHARS}) AS snippet, "
        f"{q(DASHBOARD_URL)} || log_id AS dashboard_link FROM (SELECT *, {sev} AS severity FROM scored) "
        "WHERE severity IS NOT NULL")
    s["alert_summary"] = with_scored(
        f", {_rolling_cte()}\nSELECT severity, count(*) AS n FROM ("
        f"SELECT {sev} AS severity FROM scored UNION ALL "
        f"SELECT {q(SEVERITY_DRIFT)} FROM rolling WHERE avg_confidence < {DRIFT_THRESHOLD}) "
        "WHERE severity IS NOT NULL GROUP BY 1")

    # feedback
    s["correction_rate"] = with_scored(
        f", {_reviews_cte()}\nSELECT predicted_category, count(*) AS n, "
        "count(*) FILTER (WHERE predicted_category <> true_category) AS n_corrected, "
        f"{r('avg(CASE WHEN predicted_category <> true_category THEN 1.0 ELSE 0.0 END)')} AS correction_rate "
        "FROM latest GROUP BY 1")
    s["correction_pairs"] = with_scored(
        f", {_reviews_cte()}\nSELECT predicted_category, true_category, count(*) AS n, "
        f"{r('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY predicted_category)')} AS share "
        "FROM latest GROUP BY 1, 2")
    s["latest_feedback"] = with_scored(
        f", {_reviews_cte()}\nSELECT log_id, id, predicted_category, true_category, \"timestamp\" FROM latest")
    s["retraining_set"] = with_scored(
        f", {_reviews_cte()}\nSELECT message, true_label AS label, 'train' AS origin FROM logs WHERE split = 'train' "
        "UNION ALL SELECT message, true_category, 'feedback' FROM latest")
    s["review_backlog"] = with_scored(
        f", {_reviews_cte()}\nSELECT log_id, category, {r('confidence')} AS confidence FROM scored "
        "WHERE needs_review AND log_id NOT IN (SELECT log_id FROM reviews)")
    return s


def _report_cte_prefix() -> str:
    return f", {_report_cte()}\n"
