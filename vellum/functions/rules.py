"""Rule values. These are fixed values that results depend on; everything else in the library is derived from them."""

# Word ranges (least, most) by content type and expected length; None: no upper bound.
LENGTH_RANGES = {
    "articles": {"SIMPLE": (800, 1000), "MEDIUM": (1000, 1999), "LONG": (2000, 3000)},
    "questAnswers": {"SIMPLE": (0, 1499), "MEDIUM": (1500, 3500), "LONG": (3501, None)},
    "practicalGuide": {"SIMPLE": (0, 1499), "MEDIUM": (1500, 3000), "LONG": (3001, None)},
    "audioScript": {"SIMPLE": (800, 1500), "MEDIUM": (1500, 3000), "LONG": (3000, 4500)},
    "videoScript": {"SIMPLE": (800, 1500), "MEDIUM": (1500, 3000), "LONG": (3000, 4500)},
    "caseStudy": {"SIMPLE": (0, 1499), "MEDIUM": (1500, 3500), "LONG": (3501, None)},
    "whiteBook": {"SIMPLE": (0, 1499), "MEDIUM": (1500, 3000), "LONG": (3001, None)},
    "comparative": {"SIMPLE": (0, 1499), "MEDIUM": (1500, 3500), "LONG": (3501, None)},
    "quiz": {"SIMPLE": (0, 999), "MEDIUM": (1000, 1500), "LONG": (1501, None)},
}
LENGTH_TOLERANCE_PCT = 10
EXPECTED_LENGTHS = ("SIMPLE", "MEDIUM", "LONG")
FUNNEL_STAGES = ("AWARENESS", "CONSIDERATION", "DECISION")
TYPOGRAPHY_LOCALES = ("fr-FR",)
EVERGREEN_LOCALES = ("fr-FR", "en-US")

# Structure: tags that generated content may use, and phrases of the outline that must not leak.
HEADING_TAGS = ("h2", "h3", "h4")
BODY_TAGS = ("p", "ul", "ol", "li", "blockquote", "em", "strong", "code", "a", "figure", "figcaption", "table", "thead", "tbody", "tr", "th", "td")
TABLE_TAGS = ("table", "thead", "tbody", "tr", "th", "td")
COMMENT_PATTERNS = ("Angle de réponse", "Note", "Instruction", "Indication")
TRAILING_TITLES = ("Lecture complémentaire", "Learn more")
TEXT_BLOCKS = ("p", "ul", "ol", "blockquote")

# SEO: titles by role, thresholds and weights.
UTILITY_TITLES = ("lecture complementaire", "learn more", "sources", "references", "pour aller plus loin", "further reading")
COMPLEMENTARY_TITLES = ("lecture complémentaire", "lecture complementaire", "learn more")
GLOBAL_TRAILING_TITLES = ("lecture complémentaire", "lecture complementaire", "learn more", "sources", "références", "references")
EMPHASIS_TAGS = ("em", "strong")
# Occurrences of keywords by expected length: least in all, most in all, least of the main keyword.
OCCURRENCES = {"SIMPLE": (5, None, 3), "MEDIUM": (7, 10, None), "LONG": (10, 15, None)}
QUIZ_OCCURRENCES = (2, 6, None)
CHUNK_WORDS, CHUNK_OVERLAP, TOP_CHUNKS = 128, 16, 3
CHUNK_WEIGHTS = (0.60, 0.25, 0.15)
SENTENCE_SIMILARITY = 0.75

# Sources: link format, tracking parameters, status codes and policy by content type.
REQUIRED_TARGET, REQUIRED_REL = "_blank", ("noopener", "noreferrer")
FORBIDDEN_ANCHORS = ("cliquez ici", "lire plus", "click here", "read more")
TRACKING_PATTERNS = ("utm_*", "ref", "trk", "src", "source", "campaign", "mc_cid", "mc_eid", "gclid", "fbclid", "msclkid")
STATUS_ALLOWED, STATUS_FORBIDDEN, STATUS_UNKNOWN = (200, 301, 302), (400, 404, 410), (401, 403, 406, 202, 500, 502, 503)
METHODS, TIMEOUT_SECONDS, MAX_CONCURRENCY = ("HEAD", "GET"), 5, 5
ALLOWED_TYPES = ("articles", "practicalGuide", "caseStudy", "whiteBook", "comparative")
CAUTION_TYPES, FORBIDDEN_TYPES = ("audioScript", "videoScript"), ("questAnswers", "quiz")
# References by expected length: most in all, least for each section.
REFERENCE_LIMITS = {"SIMPLE": (1, None), "MEDIUM": (None, 1), "LONG": (None, None)}

# Patterns of URLs, links and dates.
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
RAW_URL = r"(?U)(?<![\"'=])(https?://[^\s<>\"]+)"
MARKDOWN_LINK = r"\[[^\]]+\]\(https?://[^)]+\)"
ATTACHED_ANCHOR = r"(?iU)\w<a\s+"
FULL_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-](?:19|20)\d{2}\b"
YEAR = r"\b(?:19|20)\d{2}\b"

# Typography: rule, severity, the text that it looks at, pattern, message.
TYPOGRAPHY = (
    ("double_spaces", "minor", "decoded", r" {2,}", "Two or more spaces stand in a row."),
    ("trailing_spaces", "minor", "lines", r"[ \t]+$", "Lines end in blanks."),
    ("space_before_dot", "minor", "decoded", r"(?U)[\s\x1c-\x1f]+\.", "White space stands before a full stop."),
    ("space_before_comma", "minor", "decoded", r"(?U)[\s\x1c-\x1f]+,", "White space stands before a comma."),
    ("french_nbsp_before_double_punctuation", "major", "decoded", r"(?<!\x{00A0})[:;!?%]", "A no-break space is missing before double punctuation."),
    ("multiple_punctuation", "minor", "decoded", r"[!?.,;:]{2,}", "Punctuation marks are repeated."),
    ("attached_links", "minor", "raw", r"(?iU)\w<a\b", "A link is attached to the word before it."),
    ("repeated_line_breaks", "minor", "raw", r"(?iU)(<br\s*/?>\s*){2,}", "Line breaks are repeated."),
)

# Temporal expressions and context markers by language.
MONTHS = {
    "fr": ("janvier", "février", "fevrier", "mars", "avril", "mai", "juin", "juillet", "août", "aout", "septembre", "octobre", "novembre", "décembre", "decembre"),
    "en": ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
}
EXPRESSIONS = {
    "relative_date": {
        "fr": ("aujourd'hui", "cette année", "ce mois-ci", "cette semaine", "récemment", "actuellement", "désormais", "à l'heure actuelle", "ces derniers mois", "la semaine dernière", "l'année dernière"),
        "en": ("today", "this year", "this month", "this week", "recently", "currently", "nowadays", "at the moment", "in recent months", "last week", "last year"),
    },
    "news_reference": {
        "fr": ("actualité", "dernière annonce", "nouvelle réglementation", "réforme récente", "tendance actuelle"),
        "en": ("news", "latest announcement", "new regulation", "recent reform", "current trend"),
    },
    "version_reference": {
        "fr": ("dernière version", "nouvelle version", "version actuelle", "mise à jour récente"),
        "en": ("latest version", "new version", "current version", "recent update"),
    },
}
SOURCE_MARKERS = {"fr": ("selon", "étude", "rapport", "baromètre", "source", "publication", "observatoire"), "en": ("according to", "study", "report", "source", "publication", "survey")}
HISTORY_MARKERS = {"fr": ("depuis", "historiquement", "dans les années", "au cours de"), "en": ("since", "historically", "in the", "over the years")}
CONTEXT_CHARS = 80

# The judges of a whole evaluation, in their order.
DEFAULT_JUDGES = ("length", "typography", "seo", "structure", "sources")
# Summaries of a whole evaluation: nothing but errors, some errors, none.
SUMMARIES = ("Global evaluation could not be completed.", "Global evaluation completed with some technical errors.", "Global evaluation completed with %d judge result(s).")
