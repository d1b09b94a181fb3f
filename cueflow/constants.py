"""Limits, word lists, ordered rules and presets that results depend on."""

# Python's notion of whitespace (str.isspace), used wherever text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same within a line (no newline), and its opposite.
BLANK_CLASS = r"[\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NON_WHITESPACE_CLASS = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# What words are made of: letters, numbers, marks and the underscore of any script.
WORD_CLASS = r"[\p{L}\p{N}\p{M}_]"

# Formats and languages that requests may name.
FORMATS = ("srt", "webvtt")
LANGUAGES = ("en", "es", "fr", "de", "it", "pt", "nl")

# Hard limits of the rule set.
MIN_SEGMENT_MS = 500
MAX_SEGMENT_MS = 10000
HARD_MAX_CPS = 25.0
MAX_LINE_CHARS = 80
MAX_LINES = 2
GAP_MS = 10000
MERGE_GAP_MS = 100
MAX_CONTENT_CHARS = 10 * 1024 * 1024
MAX_SEGMENTS = 10000
CHUNK_CUES = 30
SAMPLE_HEAD = 50
SAMPLE_WHOLE = 100
TOP_ENTRIES = 50
TOP_CHANGES = 50
PRESERVED_SHOWN = 5
LEARN_MAX_WORDS = 5

# Issue messages.
MESSAGES = {
    "duration_too_short": "Segment duration ({duration}ms) is below minimum ({bound}ms)",
    "duration_short": "Segment duration ({duration}ms) is below recommended ({bound}ms)",
    "duration_too_long": "Segment duration ({duration}ms) exceeds maximum ({bound}ms)",
    "duration_long": "Segment duration ({duration}ms) exceeds recommended ({bound}ms)",
    "cps_too_high": "CPS ({cps}) exceeds maximum ({bound})",
    "cps_high": "CPS ({cps}) exceeds target ({bound})",
    "empty_text": "Segment has empty text",
    "too_many_lines": "Segment has {lines} lines (max: {bound})",
    "line_too_long": "Line {line} has {size} characters (max: {bound})",
    "line_long": "Line {line} has {size} characters (target: {bound})",
    "negative_start": "Segment has negative start time",
    "invalid_timing": "End time must be after start time",
    "overlap": "Segment {first} overlaps with segment {second}",
    "out_of_order": "Segment {current} starts before segment {previous}",
    "large_gap": "Large gap ({gap}ms) between segments {previous} and {current}",
    "empty_document": "Document contains no segments",
    "parse_error": "Failed to parse subtitles: Unsupported format: {name}",
}

# Recommended thresholds and the presets that override them.
DEFAULT_SETTINGS = {
    "min_duration_ms": 1500,
    "max_duration_ms": 6000,
    "max_cps": 17.0,
    "line_wrap": 42,
    "max_lines": 2,
    "merge_mode": "smart",
}
PRESETS = {
    "default": {},
    "aggressive": {"merge_mode": "aggressive", "max_cps": 20.0, "min_duration_ms": 1000},
    "conservative": {"merge_mode": "conservative", "max_cps": 15.0, "min_duration_ms": 2000},
    "accessibility": {
        "max_cps": 12.0, "min_duration_ms": 2000, "max_duration_ms": 8000, "line_wrap": 37,
    },
    "streaming": {"merge_mode": "smart", "max_cps": 18.0, "line_wrap": 42, "max_lines": 2},
    "ml_enhanced": {"merge_mode": "smart", "max_cps": 17.0},
}
# Allowed range of each setting.
SETTING_RANGES = {
    "line_wrap": (20, 80),
    "max_lines": (1, 4),
    "min_duration_ms": (500, 5000),
    "max_duration_ms": (2000, 10000),
    "max_cps": (5.0, 25.0),
}

# Filler words and phrases per language.
FILLERS = {
    "en": [
        "um", "uh", "er", "ah", "like", "you know", "I mean", "sort of",
        "kind of", "basically", "actually", "literally", "right", "okay",
        "so", "well", "hmm", "uhh", "umm", "eh", "oh", "yeah",
    ],
    "es": [
        "eh", "este", "pues", "bueno", "o sea", "es decir", "mira",
        "sabes", "vale", "verdad", "vaya", "hombre", "entonces",
    ],
    "fr": [
        "euh", "ben", "bah", "alors", "donc", "voila", "quoi", "hein",
        "enfin", "bon", "eh bien", "tu vois", "tu sais", "genre",
    ],
    "de": [
        "aeh", "aehm", "also", "halt", "eben", "ja", "ne", "sozusagen",
        "quasi", "eigentlich", "irgendwie", "praktisch", "nun",
    ],
    "it": [
        "eh", "ehm", "cioe", "beh", "allora", "quindi", "ecco", "vabbe",
        "diciamo", "praticamente", "sostanzialmente", "insomma",
    ],
    "pt": [
        "eh", "ah", "hum", "ne", "pois", "entao", "tipo", "assim",
        "quer dizer", "olha", "veja", "sabe", "entende",
    ],
    "nl": [
        "eh", "uhm", "nou", "dus", "eigenlijk", "zeg maar", "weet je",
        "he", "toch", "gewoon", "even", "ff", "ofzo",
    ],
}

# Punctuation rules, applied in this order.
PUNCTUATION_RULES = [("...", "\u2026"), ("!!", "!"), ("??", "?"), ("  ", " ")]

# Spelling rules that come before every other source.
BUILTIN_SPELLINGS = [
    ("Bentancour", "Bentancur"),
    ("Bentancurt", "Bentancur"),
    ("The Young", "De Jong"),
    ("Frankie de Jong", "Frenkie de Jong"),
    ("Frankie", "Frenkie"),
    ("Chavi", "Xavi"),
    ("Xvi", "Xavi"),
    ("Superano", "Upamecano"),
    ("Uruguai", "Uruguay"),
]

# The manifest used when the supplied one cannot be read.
FALLBACK_MANIFEST = {
    "topic": "General",
    "genre": "Unknown",
    "industry": "General",
    "country": "General",
    "dialect": "Standard English",
    "summary": "Analysis failed",
    "style_guide": "Correct standard English errors. Preserve intent.",
}

# Candidate search, context graph and ranking parameters.
EDIT_MAX_DISTANCE = 2
EDIT_PREFIX = 7
EDIT_TOP = 12
EDIT_RATIO_PASS1 = 0.15
EDIT_RATIO_PASS2 = 0.30
EDIT_MAX_CHARS = 8
VOCAB_MIN_FREQ = 2
VOCAB_MIN_CHARS = 3
VOCAB_MAX_CHARS = 40
CONTEXT_ALPHA = 0.7
CONTEXT_TAU = 7.0
CONTEXT_TOP = 8
CONTEXT_FLOOR = 0.5
RANK_WEIGHTS = {
    "bias": -0.4,
    "delta_logp": 0.7,
    "edit_penalty": 1.0,
    "vocab_support": 0.15,
    "neighbor_support": 0.12,
    "locked_penalty": 2.0,
}
RANK_THRESHOLD_PASS1 = 0.75
RANK_THRESHOLD_PASS2 = 0.70

# Confidence bands as (name, lower bound), each reaching up to the next bound.
CONFIDENCE_BANDS = [("low", 0.0), ("medium", 0.5), ("high", 0.75), ("very_high", 0.9)]
