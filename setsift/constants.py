"""Fixed values.

These values must stay exactly as they are for results to agree with the
published outputs of the method this library re-implements: stop words, term
patterns, cut-offs, default settings and the wording of generated sentences.
"""

# ---------------------------------------------------------------- fixed values
# Stop words removed from explanation terms (English, then Chinese).
STOPWORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with",
    "is", "are", "be", "by", "as", "that", "this", "it", "from",
    "公民", "居民", "政府", "相关", "部门", "进行", "已经", "可以",
    "需要", "希望", "提供", "一个", "这个", "那个", "问题", "当前",
]

# Term patterns (Java regex syntax).
LATIN_WORD_PATTERN = r"[a-zA-Z][a-zA-Z_\-]{2,}"
HAN_RUN_PATTERN = r"[\x{4e00}-\x{9fff}]+"
HAN_NGRAM_MIN, HAN_NGRAM_MAX = 2, 4
MAX_MATCHED_TERMS = 12

# Confidence bands: (label, minimum top score, minimum gap to the second score).
CONFIDENCE_BANDS = [("high", 0.50, 0.10), ("medium", 0.35, 0.05), ("low", 0.25, None)]
CONFIDENCE_FLOOR = "very low"
CONFIDENCE_UNKNOWN = "unknown"

# Truth-table status rules.
DEFAULT_CONSISTENCY_CUTOFF = 0.80
DEFAULT_MIN_CASES = 1
DEFAULT_CONTRADICTION_LOWER = 0.40
DEFAULT_CONTRADICTION_UPPER = 0.60
STATUS_SUFFICIENT, STATUS_CONTRADICTORY, STATUS_WEAK = "sufficient", "contradictory", "weak"

# Calibration defaults of the interactive run (full_out / crossover / full_in, crisp threshold).
DEFAULT_FULL_OUT, DEFAULT_CROSSOVER, DEFAULT_FULL_IN = 0.15, 0.30, 0.45
DEFAULT_CRISP_THRESHOLD = 0.30
DEFAULT_THRESHOLD_GRID = [0.25, 0.30, 0.35, 0.40, 0.45, 0.50]

# Threshold suggestion rules: (rule, quantile, interpretation).
THRESHOLD_RULES = [
    ("conservative", 0.75, "Strict: a quarter of the pooled scores reaches it."),
    ("balanced", 0.60, "Middle way: two fifths of the pooled scores reach it."),
    ("inclusive", 0.50, "Generous: half of the pooled scores reach it."),
]
# Score distribution summary: (statistic, quantile); 0 and 1 are the minimum and maximum.
SUMMARY_STATISTICS = [
    ("minimum", 0.0), ("25th percentile", 0.25), ("median", 0.5),
    ("60th percentile", 0.60), ("75th percentile", 0.75), ("maximum", 1.0),
]

# Prototype checks.
PROTOTYPE_COLUMNS = ["condition_name", "prototype", "type"]
PROTOTYPE_TYPES = ["condition", "outcome"]
SHORT_PROTOTYPE_WORDS = 5
LONG_PROTOTYPE_WORDS = 80
EMPTY_MARKERS = ["", "nan", "None"]

# Supervised mode.
MAX_FEATURES = 5000
NGRAM_MIN, NGRAM_MAX = 1, 2
MIN_DF, MAX_DF = 1, 0.95
MAX_ITER = 1000
LABEL_EXCLUDE_COLUMNS = ["case_id", "text", "outcome", "target_label", "label"]
FEW_EXAMPLES = 3

# Sentences.
SOLUTION_SENTENCE = (
    "When the configuration [%s] is present, the outcome occurs in %d out of %d observed case(s)."
)
# ------------------------------------------------------------ end fixed values

# Wording of our own.
NOTE_HEAD = "'%s' fits best (score %.4f, confidence %s). "
NOTE_GAP = "It leads '%s' by %.4f."
NOTE_NO_SECOND = "There is no other condition."
NOTE_MATCHED = "Terms in common with its prototype: %s."
NOTE_NO_MATCH = "No term is shared with its prototype."

# Cases listed per configuration where a list is asked for; the long form has all of them.
MAX_LISTED_CASES = 1000
