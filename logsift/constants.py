"""Fixed values.

The numbers in the first block must equal the behaviour being reproduced
(class weights, thresholds, histogram bounds, source names, level rule);
they are stated here once, in their natural order, and imported everywhere
else.  The second block holds choices of this project (window slide,
snippet length, split shares, dashboard link).
"""

# --- fixed values that define the behaviour ---------------------------------

# Classes and their generation weights (noise, error, security, warning).
CLASSES = ["noise", "error", "security", "warning"]
CLASS_WEIGHTS = [0.70, 0.15, 0.05, 0.10]

# Log sources emitted by the log producer.
SOURCES = ["api_gateway", "auth_service", "db_primary"]

# Share of records per class that use the ambiguous (overlapping) wording.
AMBIGUOUS_SHARE = 0.20

# Review threshold: confidence strictly below it is flagged.
REVIEW_THRESHOLD = 0.75

# Drift rule: rolling mean confidence below this over the window alerts.
DRIFT_THRESHOLD = 0.70
DRIFT_WINDOW = "5 minutes"

# Alert routing: categories that page a human.
INCIDENT_CATEGORIES = ["error", "security"]
SEVERITY_HIGH = "High Severity"
SEVERITY_REVIEW = "CRITICAL: Human Review Required"
SEVERITY_DRIFT = "WARNING: Model Drift Detected"

# Histogram upper bounds (inclusive, cumulative, plus +Inf).
CONFIDENCE_BUCKETS = [0.1, 0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 1.0]
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]

# Feature extraction: vocabulary cap and n-gram range.
MAX_FEATURES = 5000
NGRAM_MAX = 2

# Classifier: L2 strength of the logistic loss, per-row-mean objective.
ALPHA = 0.0005

# Metric names and the status recorded for a scored record.
METRIC_REQUESTS = "inference_requests_total"
METRIC_CONFIDENCE = "inference_confidence_score"
METRIC_LATENCY = "inference_latency_seconds"
METRIC_LOADED = "model_loaded"
STATUS_OK = "200"

# Version reported when none is known.
UNKNOWN_VERSION = "unknown"

# --- choices of this project -------------------------------------------------

# md5 buckets are integers in [0, BUCKETS).
BUCKETS = 10000
# Rolling-mean slide.
DRIFT_SLIDE = "1 minute"
# Length of the message snippet carried in an alert.
SNIPPET_CHARS = 200
# Dashboard link prefix carried in an alert payload.
DASHBOARD_URL = "/dashboards/log-triage?log_id="
# Train share of the deterministic split (5000 train / 1000 test).
TRAIN_SHARE = 5000 / 6000
# Share of scored records routed to the canary track.
CANARY_SHARE = 0.10
# Share of flagged records that already received a reviewer correction.
REVIEWED_SHARE = 0.60
# Share of reviewed records that were corrected twice (duplicate feedback).
DOUBLE_REVIEW_SHARE = 0.20
# Records per simulated request envelope.
REQUEST_SIZE = 10
# Epsilon for PSI / KL on empty shares.
SHIFT_EPSILON = 1e-6
