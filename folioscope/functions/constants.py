"""Fixed values.

Word lists, patterns, sizes and texts below have to equal those of the system
whose results are matched; they are data, not design.
"""

# -- page cleaning -----------------------------------------------------------

# fixed values: lines printed at the head or foot of every page
RUNNING_HEADERS = (
    "GUIDELINE FOR THE PHARMACOLOGICAL TREATMENT OF HYPERTENSION IN ADULTS",
    "GUIDELINE FOR THE PHARMACOLOGICAL TREATMENT OF HYPERTENSION IN",
    "RECOMMENDATIONS",
    "RECOMMENDATION",
)

# fixed values: the shorter header list used for heading detection and checks
HEADING_RUNNING_HEADERS = (
    "GUIDELINE FOR THE PHARMACOLOGICAL TREATMENT OF HYPERTENSION IN ADULTS",
    "RECOMMENDATIONS",
    "RECOMMENDATION",
)

# fixed value: size of a repeated line block
BLOCK_LINES = 3

# -- headings ----------------------------------------------------------------

# fixed values: top-level section names of the profiled document
MAIN_SECTIONS = (
    "EXECUTIVE SUMMARY",
    "INTRODUCTION",
    "METHOD FOR DEVELOPING THE GUIDELINE",
    "SPECIAL SETTINGS",
    "PUBLICATION, IMPLEMENTATION, EVALUATION AND RESEARCH GAPS",
    "IMPLEMENTATION TOOLS",
    "REFERENCES",
    "ANNEXES",
)

# fixed values: phrases of the profiled document's own title
TITLE_PHRASE = "PHARMACOLOGICAL TREATMENT OF HYPERTENSION"
TITLE_PREFIX = "GUIDELINE FOR THE PHARMACOLOGICAL TREATMENT OF HYPERTENSION"

# fixed values: front-matter pages without headings
TOC_PAGES = tuple(range(1, 13))

# fixed values: sections left out, by exact title
EXCLUDED_SECTIONS = ("REFERENCES", "ANNEXES")

# fixed values: sections left out, by word inside the title
EXCLUDED_TITLE_WORDS = (
    "REFERENCES",
    "BIBLIOGRAPHY",
    "ANNEXES",
    "ANNEX",
    "APPENDIX",
    "APPENDICES",
    "INDEX",
    "DISCLOSURES",
    "CONFLICTS OF INTEREST",
    "ACKNOWLEDGEMENTS",
    "LIST OF CONTRIBUTORS",
    "WEB ANNEX",
)

# fixed values: titles dropped by the layout strategy
STOP_TITLES = ("contents", "table of contents", "your responsibility")

# fixed values: font-name markers of bold text
BOLD_MARKERS = ("Bold", "bold", "SemiBold", "Heavy", "Black", "ExtraBold")

# fixed values: patterns, matched without regard to case from the line start
NUMBERED_RECOMMENDATION = r"\d+\.\s{1,4}RECOMMENDATION(?:S)?\s+ON\s+\S"
DECIMAL_NUMBER = r"""(?:\d+\.){1,4}\s*(?:\d+\.?)?\s+[A-Z0-9\("']"""
ROMAN_NUMBER = r"(?:[IVXLCDM]+\.)\s+[A-Z0-9]"
PREFIX_WORDS = (
    "RECOMMENDATION",
    "RECOMMENDATIONS",
    "SECTION",
    "CHAPTER",
    "PART",
    "MODULE",
    "STEP",
    "STAGE",
    "ALGORITHM",
    "BOX",
    "TABLE",
    "KEY MESSAGE",
    "PICO",
    "GRADE",
    "CLASS",
)
PREFIX_NUMBER = r"(?:[0-9IVXLCDM\.\-]+|\b(?:ONE|TWO|THREE|FOUR)\b)"
TOPIC_TITLES = (
    "EXECUTIVE SUMMARY",
    "INTRODUCTION",
    "BACKGROUND",
    "EPIDEMIOLOGY",
    "DIAGNOSIS",
    "INVESTIGATIONS",
    "ASSESSMENT",
    "MANAGEMENT",
    "PHARMACOLOGICAL TREATMENT",
    "NON-PHARMACOLOGICAL MANAGEMENT",
    "LIFESTYLE INTERVENTIONS",
    "DRUG THERAPY",
    "MONITORING",
    "BLOOD PRESSURE TARGETS",
    "CARDIOVASCULAR RISK",
    "TARGET ORGAN DAMAGE",
    "SPECIAL POPULATIONS",
    "SPECIAL SETTINGS",
    "DIABETES",
    "CHRONIC KIDNEY DISEASE",
    "PREGNANCY",
    "ELDERLY",
    "SECONDARY HYPERTENSION",
    "RESISTANT HYPERTENSION",
    "HYPERTENSIVE EMERGENCIES",
    "HYPERTENSIVE CRISIS",
    "FOLLOW-UP",
    "IMPLEMENTATION",
    "RATIONALE AND IMPACT",
    "TERMS USED IN THIS GUIDELINE",
    "RECOMMENDATIONS FOR RESEARCH",
    "CONTEXT",
)
NOISE_PREFIXES = (
    r"https?://",
    r"www\.",
    r"published\s*:",
    r"last\s+updated\s*:",
    r"page\s+\d+",
    r"isbn\s*:",
    r"doi\s*:",
    r"©\s*\d{4}",
    r"downloaded\s+from",
)

# fixed values: limits of heading lines and of the strategy cascade
HEADING_MIN_CHARS = 3
HEADING_MAX_CHARS = 140
CAPS_MIN_CHARS = 4
CAPS_MAX_CHARS = 60
CONTINUATION_MAX_CHARS = 100
BOOKMARK_MIN_ENTRIES = 3
BOOKMARK_MIN_HEADINGS = 4
LINE_SCAN_BELOW = 3
BUCKETS_BELOW = 2
BUCKET_PAGES = 5
DEFAULT_BODY_SIZE = 10.0
LARGER_BY = 2.0
BOLD_LARGER_BY = 0.5

# -- chunks ------------------------------------------------------------------

# fixed values: chunk sizes in tokens
TARGET_TOKENS = 600
MAX_TOKENS = 900
MIN_TOKENS = 400
OVERLAP_TOKENS = 80

# fixed values: the three chunk-size experiments
# (config_id, name, target, max, min, overlap)
CHUNK_CONFIGS = (
    ("cfg_small", "Small Chunks (300/40)", 300, 450, 200, 40),
    ("cfg_balanced", "Balanced Chunks (600/80) - Current", 600, 900, 400, 80),
    ("cfg_large", "Large Chunks (900/150)", 900, 1350, 600, 150),
)

# -- retrieval ---------------------------------------------------------------

# fixed values: BM25 parameters
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# fixed values: fusion parameters and candidate counts
RRF_CONSTANT = 60
RRF_DENSE_WEIGHT = 0.5
SCORE_FUSION_ALPHA = 0.6
TOP_K = 5
OVERFETCH_FACTOR = 6
OVERFETCH_MIN = 40
LEG_FACTOR = 2
LEG_MIN = 10

# fixed value: the DNS namespace of name-based UUIDs (RFC 4122)
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"

# fixed values: default document, file lookup and name of hits without them
DEFAULT_DOCUMENT_ID = "who_guideline_01"
DOCUMENT_FILES = {
    "who_guideline_01": "WHO_guideline_01.pdf",
    "doc_001": "WHO_guideline_01.pdf",
    "nice_guideline_02": "NICE_guideline_02.pdf",
}
DEFAULT_DOCUMENT_NAME = (
    "WHO Guideline for the Pharmacological Treatment of Hypertension in Adults"
)

# fixed values: texts of the prompt
EMPTY_CONTEXT = "[No matching context passages retrieved for this specific guideline.]"
CONTEXT_SEPARATOR = "\n\n---\n\n"
HISTORY_TURNS = 6
TARGET_NOTE = (
    "\nIMPORTANT TARGET GUIDELINE INSTRUCTION: The user has targeted the guideline: "
    "'{name}' (Organization: {organization}). "
    "You must base your answer EXCLUSIVELY on the provided passages from this specific guideline. "
    "Do not cite or reference other organizations (such as WHO or others) "
    "unless they appear in this document's text. "
    "If the provided context from this guideline does not contain the answer, "
    "explicitly state that this guideline does not mention it.\n"
)
PATIENT_HEAD = "\nPATIENT'S UPLOADED TEST RESULTS & CLINICAL REPORT:\n"
PATIENT_TAIL = (
    "TAILORING INSTRUCTION: Specifically contextualize your answer to this patient's "
    "blood pressure level and risk factors using the guideline thresholds and evidence "
    "from context.\n"
)
PATIENT_TEXT_HEAD = "\nPATIENT'S CLINICAL REPORT CONTEXT:\n"
NO_COMORBIDITIES = "None specified"
NO_MEDICATIONS = "None reported"
UNKNOWN_READING = "Unknown"
DEFAULT_BP_CATEGORY = "Hypertension"
DEFAULT_REPORT_SUMMARY = "Patient Blood Pressure Report analyzed."
REPORT_TEXT_KEPT = 4000
REPORT_TEXT_SENT = 12000

# -- checks ------------------------------------------------------------------

# fixed values: thresholds of the chunk checks
TOKEN_DRIFT = 0.10
SHORT_TEXT_CHARS = 50
DUPLICATE_RATIO = 0.97
OVERLAP_WINDOW_CHARS = 1500
OVERLAP_MIN_CHARS = 20
CHARS_PER_TOKEN = 4.0
OVERLAP_WARNING = 0.30
OVERLAP_ERROR = 0.50
CHUNK_ID_PATTERN = r"^[a-zA-Z0-9]+_\d+_section_\d+_c\d+$"
REQUIRED_FIELDS = (
    "chunk_id",
    "document_id",
    "document_name",
    "section_id",
    "section_title",
    "page_start",
    "page_end",
    "token_count",
    "text",
)

# -- experiments -------------------------------------------------------------

# fixed values: cut-offs and weights of the experiments
BENCHMARK_KS = (1, 3, 5)
SWEEP_KS = (1, 2, 3, 4, 5, 8, 10)
SWEEP_HIT_WEIGHT = 0.6
SWEEP_PRECISION_WEIGHT = 0.4
DEFAULT_CHUNK_TOKENS = 600
BENCHMARK_LEG = 10
ABLATION_K = 5

# fixed values: progress percentages of the ingestion stages
STAGE_PERCENT = (
    ("start", 2.0),
    ("extract", 5.0),
    ("extracted", 18.0),
    ("sections", 22.0),
    ("sectioned", 32.0),
    ("chunks", 36.0),
    ("chunked", 42.0),
    ("embed", 42.0),
    ("embedded", 85.0),
    ("index", 88.0),
    ("done", 100.0),
)

# fixed values: embedding batches and waits between attempts
EMBED_BATCH = 15
EMBED_ATTEMPTS = 6
QUOTA_MARKERS = ("429", "resource_exhausted", "quota")
QUOTA_WAIT = 15.0
QUOTA_WAIT_MAX = 60.0
ERROR_WAIT = 2.0
GENERATE_ATTEMPTS = 2
GENERATE_WAIT = 1.0

# -- HTML ---------------------------------------------------------------------

# Fixed values of the HTML standard: elements that end a paragraph or heading
# where they begin or end, and character references.
HTML_BLOCK_ELEMENTS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
HTML_HIDDEN_ELEMENTS = ("script", "style", "template")
HTML_REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae",
    "middot": "\u00b7", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019",
    "ldquo": "\u201c", "rdquo": "\u201d", "bull": "\u2022", "hellip": "\u2026", "euro": "\u20ac",
    "trade": "\u2122",
}
