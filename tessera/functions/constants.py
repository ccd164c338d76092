"""Word lists, patterns, thresholds and texts that results depend on. They are data, kept together."""

# Fixed stop words of the reranker, of the extractive answerer, and of groundedness.
RERANK_STOP = "the a an and or of to in is was for".split()
ANSWER_STOP = "the a an and or of to in is was for with on at by as it this that are be".split()
GROUND_STOP = ANSWER_STOP + ["doc", "no"]

# Fixed keywords of the topic check.
TOPIC_WORDS = (
    "patient diagnosis treatment medication dosage symptom clinical medical doctor nurse hospital therapy lab test result "
    "allergy vital blood prescription surgery discharge admission chronic acute prognosis screening vaccine dose mg "
    "diagnosed condition disease syndrome"
).split()

# Fixed rules of the input guardrail, in order of precedence: (pattern over the lower-cased request, rule).
REQUEST_RULES = [
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions", "prompt-injection"),
    (r"disregard\s+(all\s+)?(previous|prior)\s+instructions", "prompt-injection"),
    (r"system\s*prompt", "prompt-injection"),
    (r"you\s+are\s+now\s+", "role-hijack"),
    (r"jailbreak|DAN\s+mode|do\s+anything\s+now", "jailbreak"),
    (r"reveal\s+(your\s+)?(system|initial)\s+(prompt|instructions)", "exfiltration"),
    (r"print\s+(all\s+)?(patient|medical)\s+records", "pii-harvesting"),
    (r"list\s+all\s+(ssn|social security|patient)s?\b", "pii-harvesting"),
    (r"dump\s+(the\s+)?(database|context|documents)", "exfiltration"),
    (r"<\s*script|javascript\s*:", "xss"),
]

# Fixed patterns of personal data: (type, pattern, confidence), in order.
PII_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.99),
    ("SSN", r"\b\d{3}\s\d{2}\s\d{4}\b", 0.90),
    ("PHONE", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.95),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.99),
    ("MRN", r"\bMRN[:\s#]*([A-Z0-9-]{4,12})\b", 0.97),
    ("MRN", r"\b(?:Medical Record|Chart)(?: Number| No\.?)[:\s#]*([A-Z0-9-]{4,12})\b", 0.90),
    ("DATE", r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b", 0.95),
    ("DATE", r"\b(?:19|20)\d{2}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12]\d|3[01])\b", 0.95),
    ("DATE", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+(?:19|20)\d{2}\b", 0.92),
    ("ZIP", r"\b\d{5}(?:-\d{4})?\b", 0.60),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b", 0.70),
]

# Fixed patterns of names, group 1 being the name: (pattern, confidence), in order.
NAME_PATTERNS = [
    (r"\b(?:Dr|Mr|Mrs|Ms|Miss)\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b", 0.90),
    (r"\bPatient(?: Name)?\s*:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b", 0.95),
    (r"\bDOB\s*:\s*([A-Z][a-z]+\s+[A-Z][a-z]+)\b", 0.80),
    (r"(?<=[a-z]\s)([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})\b", 0.65),
]

# Fixed capitalised words that are no names; types looked for unless said otherwise; least confidence.
NOT_NAMES = "Patient Doctor Hospital Clinic Department Emergency Intensive Care Unit Room Bed Floor Building".split()
PII_TYPES = ("SSN", "PHONE", "EMAIL", "MRN", "DATE", "PERSON", "ZIP")
PII_THRESHOLD = 0.5

# Fixed pattern of a section's header line.
HEADER = r"^[A-Z][A-Za-z0-9 ,/\-()]{2,60}:?\s*$"

# Fixed phrases that tell a request's intent, fixed names of a prompt's blocks, and the fixed pattern of a field's line.
SUMMARY_WORDS = ("summariz", "summary", "tldr", "overview")
EXTRACT_WORDS = ("extract", "list all", "what medications", "allergies")
PROMPT_TAGS = ("CONTEXT", "QUESTION", "ANSWER")
FIELD = r"^\s*([A-Za-z][A-Za-z0-9 _/-]{1,30}):\s*(.+)"

# Fixed parts of log keys whose values are hidden.
HINT_KEYS = "ssn phone email mrn dob name address".split()

# Fixed texts.
DISCLAIMER = (
    "\n\n_Disclaimer: This summary is generated from clinical documents for informational purposes and is not medical advice. "
    "Confirm with a licensed clinician before making care decisions._"
)
NO_EVIDENCE = "I could not find information in the provided clinical documents to answer this question. [no-evidence]"
NO_CONTEXT = "Based on the information provided, I cannot give a grounded answer because no retrieved context was supplied. [no-context]"
NO_SUMMARY = "No content to summarize. [no-evidence]"
NO_FIELDS = "No structured fields found. [no-evidence]"
ESCALATED = ("This answer was flagged for clinical review and was not approved for release (", "). A clinician will follow up. [escalated]")
ANSWER_PROMPT = "You answer clinical questions using ONLY the provided context. Cite every factual claim with [doc]. If the context lacks the answer, say so explicitly.\n\n"
SUMMARY_PROMPT = "Summarize the following clinical document context in 3-5 sentences. Cite claims with [doc].\n\n"
EXTRACT_PROMPT = "Extract structured clinical fields (diagnoses, medications, dosages, allergies, vitals) from the context as 'Field: value' lines. Cite with [doc].\n\n"

# Fixed settings.
MIN_GROUNDEDNESS, RATE_PER_MINUTE = 0.35, 60
PRICE_IN, PRICE_OUT = 0.5, 1.5
GATE = {"min_pass_rate": 0.8, "min_groundedness": 0.4, "max_latency_ms": 5000.0}
DEFAULT_KEY = "demo-key-123"
