"""Fixed values of the data-quality rules: word lists, patterns, weights and thresholds."""

# --- fixed values: cell texts that a CSV reader folds to null (exact match, no trimming) ---
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: words that stand for "no value" (compared after trim and lower case) ---
SENTINEL_WORDS = ("n/a", "na", "null", "none", "unknown", "missing", "undefined", "-", "?", "")

# --- fixed values: cell texts that make a text column boolean when all cells are among them ---
BOOL_LIKE = (
    "true", "false", "True", "False", "TRUE", "FALSE",
    "yes", "no", "Yes", "No", "YES", "NO",
    "y", "n", "Y", "N", "1", "0",
    "on", "off", "On", "Off", "ON", "OFF",
)

# --- fixed values: words cast to true / false (compared after trim and lower case) ---
TRUE_WORDS = ("true", "1", "yes", "y", "t", "on")
FALSE_WORDS = ("false", "0", "no", "n", "f", "off")

# --- fixed values: boolean words of the CSV type inference ---
CSV_BOOL_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")

# --- fixed values: format patterns, first match wins; each must cover the whole cell ---
PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "date_iso": r"\d{4}-\d{2}-\d{2}",
    "phone": r"\+?[\d\s\-().]{7,15}",
    "url": r"https?://\S+",
    "postcode_uk": r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}",
    "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
}
CASE_FREE_PATTERNS = ("postcode_uk", "uuid")

# --- fixed values: score weights ---
SCORE_WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "validity": 0.25, "consistency": 0.15}

# --- fixed values: thresholds of the rules ---
DETECT_SHARE = 0.8        # share of cells that must parse for a text column to be numeric / date
MAJORITY_SHARE = 0.5      # validity and pattern majority (strictly greater)
CAST_LOSS_LIMIT = 0.05    # largest share of cells a cast or a custom transform may turn null
OUTLIER_MIN_ROWS = 30
HISTOGRAM_MIN_ROWS = 10
HISTOGRAM_BINS = 10
IQR_FENCE = 1.5
SENTINEL_FENCE = 3.0
SENTINEL_MIN_ROWS = 10
SENTINEL_MIN_REPEATS = 5
TOP_VALUES = 5
SAMPLE_CELLS = 3
MISSINGNESS_ALPHA = 0.05
MISSINGNESS_MIN_ROWS = 10
MISSINGNESS_MIN_NULLS = 5
SOURCE_DAYS = 7
RESULT_DAYS = 14
PREVIEW_ROWS = 20

# --- fixed values: vocabulary of a plan ---
PLAN_TYPES = ("int", "float", "string", "date", "bool")
FILL_STRATEGIES = ("median", "mean", "mode", "fill", "drop_row", "drop_column", "leave_null")
OUTLIER_STRATEGIES = ("keep", "winsorise", "remove", "cap")
NORMALIZE_KINDS = ("min_max", "z_score", False)
RUN_STATUSES = ("PENDING", "ANALYZING", "AWAITING_REVIEW", "TRANSFORMING", "COMPLETED", "FAILED")

# Code points that count as white space when a text cell is stripped.
WHITESPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
