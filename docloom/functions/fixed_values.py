"""Word lists, patterns, templates and messages that decide results.

They are stated as plain data in natural order so that results agree with the
behaviour this library reproduces.  No logic lives here.
"""

from __future__ import annotations

# --- source organisations -------------------------------------------------------------
SOURCE_ORGS = ("DHR", "ICMR", "Nature")
VERIFICATION_STATUSES = ("unverified", "verified")

# --- tokens and stop words ------------------------------------------------------------
LEXICAL_STOP = (
    "the", "and", "for", "with", "from", "that", "this", "what", "when", "where",
    "which", "about", "does", "have", "been", "were", "are", "was", "how",
)
GATE_STOP = (
    "what", "when", "where", "which", "about", "does", "have", "been", "were", "with",
    "from", "that", "this", "your", "their", "would", "could", "should", "article",
    "nature", "study", "research",
)
TITLE_STOP = (
    "the", "and", "for", "with", "from", "that", "this", "into", "using", "based",
    "about", "want", "main", "findings", "published", "article", "nature", "paper",
    "study", "research",
)
LIST_TOPIC_STOP = (
    "any", "article", "articles", "about", "date", "from", "form", "more", "nature",
    "paper", "papers", "published", "report", "reports", "research", "show", "tell",
)
FRAGMENT_STOP = (
    "what", "when", "where", "which", "about", "does", "have", "been", "were", "with",
    "from", "that", "this", "your", "their", "would", "could", "should", "study",
    "paper", "article", "nature",
)
FOLLOW_UP_STOP = ("what", "when", "where", "which", "about", "want", "main")

MEDICAL_TERMS = (
    "clinical", "patient", "patients", "disease", "cancer", "diabetes", "therapy",
    "therapeutic", "treatment", "treatments", "drug", "drugs", "vaccine", "vaccines",
    "trial", "trials", "cohort", "hospital", "medical", "medicine", "health", "symptom",
    "symptoms", "diagnosis", "prognosis", "surgery", "screening", "tuberculosis",
    "asthma", "stroke", "cardiac", "oncology", "pathology", "biomarker", "antibiotic",
    "resistance", "mortality", "morbidity", "epidemiology", "pharmaceutical", "placebo",
    "randomized", "genome", "protein", "infection", "viral", "bacterial", "chronic",
    "acute", "pediatric", "pregnancy", "hypertension", "obesity", "insulin",
    "immunotherapy", "chemotherapy", "transplant", "tumor", "tumour", "syndrome",
    "disorder", "illness", "bedaquiline", "biomedical", "pharma", "dosing", "efficacy",
    "safety", "adverse", "endpoint", "endpoints",
)

MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)

# --- question patterns: alternatives between word boundaries ---------------------------
NON_MEDICAL_ALTERNATIVES = (
    r"quantum|qubit|football|basketball|soccer|cricket|recipe|cooking|"
    r"bitcoin|cryptocurrency|stock\s+market|weather|capital\s+of|"
    r"javascript|python\s+programming|movie|netflix|celebrity|"
    r"election|president|parliament|pizza|burger|pasta|taco|"
    r"ice\s*cream|chocolate|candy|cookie|cupcake|donut|"
    r"aliens?|diet\s*coke|intelligence|loose\s+weight|chilling|"
    r"tea|pre\s*workout"
)
FOOD_ALTERNATIVES = r"pizza|burger|eat|eating|snack|meal|breakfast|lunch|dinner"
CORPUS_META_ALTERNATIVES = r"nature|articles?|papers?|published|corpus|indexed"
ENUMERATION_ALTERNATIVES = r"how many|list|count|articles?|papers?|reports?|published"
META_COUNT_ALTERNATIVES = r"how many|list|count|articles?|papers?"
MEDICAL_DOMAIN_ALTERNATIVES = (
    r"medical|clinical|biomedical|life\s+sciences?|health\s+research"
)
COUNT_ALTERNATIVES = r"how many|number of|count of|total"
HOW_MUCH_ALTERNATIVES = r"how much"
HOW_MUCH_SUBJECTS = r"articles?|papers?|reports?|indexed|corpus|nature"
LIST_ALTERNATIVES = r"list|which|what are|name all|enumerate|published on"
REPORT_ALTERNATIVES = r"reports?|articles?|papers?"
EXPLAIN_ALTERNATIVES = r"what|why|how|explain|summarize|describe"

REFUSAL_MARKERS = (
    "insufficient information",
    "do not have sufficient",
    "does not contain",
    "do not contain",
    "not contain information",
    "cannot answer",
    "can't answer",
    "not in the provided",
    "no relevant",
    "outside the provided",
    "not covered in the provided",
)

# --- personal-data patterns: (label, pattern, ignore case) -----------------------------
PII_PATTERNS = (
    ("aadhaar", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", False),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", True),
    ("phone", r"(?:\+91[\s-]?)?[6-9]\d{9}\b", False),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", True),
    ("credential", r"\b(password|passwd|api[_-]?key|secret[_-]?key)\s*[:=]\s*\S+", True),
)

# --- page boilerplate -----------------------------------------------------------------
PLACEHOLDER_PATTERN = r"mock\s+ingest\s+content|fixture\s+content\s+for"
UI_BOILERPLATE_PATTERN = (
    r"share this article|get shareable link|cookies? policy|sign up for alerts|"
    r"subscribe to nature|download pdf|supplementary information only available|"
    r"springer nature sharedit|copy shareable link|content-sharing initiative"
)
SKIP_LINE_STARTS = (
    r"share this article",
    r"anyone you share the following link",
    r"get shareable link",
    r"sorry, a shareable link is not currently available",
    r"copy shareable link to clipboard",
    r"provided by the springer nature",
    r"content-sharing initiative",
    r"keywords\s*:",
    r"cite this article",
    r"download citation",
    r"received\s*:",
    r"accepted\s*:",
    r"published\s*:",
    r"doi\s*:",
    r"https?://doi\.org/",
    r"https?://www\.nature\.com/articles/",
    r"/\S*articles/\S+",
    r"rights and permissions",
    r"reprints and permissions",
    r"about this article",
    r"author information",
    r"competing interests",
    r"additional information",
    r"data availability",
    r"references\s*$",
    r"acknowledgements?\s*$",
    r"supplementary information",
)
ARTICLE_ID_LINE = r"/s\d{5,}-\d{3,}-\d{5,}-\d+\s*$"
INLINE_NOISE = (
    r"Share this article[^.]*\.",
    r"Get shareable link[^.]*\.",
    r"Copy shareable link to clipboard[^.]*\.",
    r"Provided by the Springer Nature SharedIt[^.]*\.",
    r"Keywords\s*:[^.]*\.",
    r"Cite this article[^.]*\.",
    r"Download citation[^.]*\.",
)

# --- titles and links -----------------------------------------------------------------
FILE_SIZE_TITLE = r"^\([\d.]+\s*(MB|KB|GB)\)$"
GENERIC_TITLES = ("guidelines", "costing manual")
LEGACY_HOSTS = ("htain.dhr.gov.in", "dhr.gov.in", "icmr.gov.in")
LEGACY_TITLE = "Legacy non-Nature source (re-ingest or purge)"
DEFAULT_TITLE = "Indexed medical document"
LEGACY_FIXTURE_URL = r"^https://www\.nature\.com/articles/d41586-026-0000[12]-[08]$"
URL_REPLACEMENTS = {
    "https://www.nature.com/articles/d41586-026-00001-0":
        "https://www.nature.com/articles/s41467-026-73798-3",
    "https://www.nature.com/articles/d41586-026-00002-8":
        "https://www.nature.com/articles/s41467-026-70664-0",
}
TITLE_BY_URL = {
    "https://www.nature.com/articles/s41467-026-73798-3":
        "BNT162b2 LP.8.1 early vaccine effectiveness against COVID-19 ED/UC visits",
    "https://www.nature.com/articles/s41467-026-70664-0":
        "Optimizing global genomic surveillance for early detection of SARS-CoV-2 variants",
}
ARTICLE_LINK = "nature.com/articles"
ARTICLE_URL = r"nature\.com/articles/s\d+"
ARTICLE_PATH = r"^/articles/s\d+-\d+-\d+-\d+$"
ARTICLE_BASE = "https://www.nature.com"
DHR_BASE = "https://htain.dhr.gov.in"
DHR_ROW_BASE = "https://www.dhr.gov.in"
ICMR_BASE = "https://www.icmr.gov.in"
ICMR_HOST = "www.icmr.gov.in"
ICMR_PRIORITY = ("guideline", "report", "document", "publication", "manual", "policy")
LISTING_POLICY = {
    "date_range": "last_30_days",
    "subject": "medical-research",
    "article_type": "research",
}
LISTING_URL = (
    "https://www.nature.com/search?"
    "article_type=research&subject=medical-research&date_range=last_30_days&order=relevance"
)

# --- structure ------------------------------------------------------------------------
MARKDOWN_HEADING = r"^#{1,6}\s+\S"
NUMBERED_HEADING = r"^\d+(?:\.\d+)*\.?\s+[A-Za-z]"
ALL_CAPS_HEADING = r"^[A-Z0-9][A-Z0-9\s\-–—,:]{3,79}$"
SECTION_VOCABULARY = (
    "introduction", "background", "methods", "methodology", "results", "discussion",
    "conclusion", "recommendations", "recommendation", "contraindications",
    "contraindication", "dosage", "dosing", "adverse effects", "warnings",
    "precautions", "indications", "summary", "executive summary", "guidelines",
    "treatment", "diagnosis", "management",
)
ABBREVIATIONS = (
    "Dr.", "dr.", "e.g.", "i.e.", "No.", "no.", "vs.", "etc.", "Fig.", "fig.", "Mr.",
    "Mrs.", "Prof.",
)

# --- web pages ------------------------------------------------------------------------
STRIP_TAGS = (
    "script", "style", "nav", "footer", "header", "noscript", "iframe", "aside", "form",
)
STRIP_CLASSES = (
    "c-article-sidebar", "c-article-metrics", "c-article-info-details",
    "c-article-identifiers", "c-article-references", "c-article-section__figure",
    "c-bibliographic-information", "c-share-box", "c-article-share-box",
    "c-article-actions", "c-article-subject-collection", "u-hide-print",
)
STRIP_CLASS_PARTS = ("cookie", "newsletter", "subscribe")
STRIP_ATTRIBUTES = (("data-test", "sidebar"), ("data-track-action", "share"))
STRIP_ARIA_PART = "Share"
BLOCK_TAGS = (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "section", "article",
    "blockquote", "pre", "table", "tr",
)
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
)
# Named character references of HTML that pages use: the name as written, and the character.
CHARACTER_REFERENCES = (
    ("&quot;", "\""), ("&amp;", "&"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
    ("&nbsp;", "\u00a0"), ("&cent;", "\u00a2"), ("&pound;", "\u00a3"), ("&sect;", "\u00a7"),
    ("&copy;", "\u00a9"), ("&laquo;", "\u00ab"), ("&reg;", "\u00ae"), ("&deg;", "\u00b0"),
    ("&plusmn;", "\u00b1"), ("&micro;", "\u00b5"), ("&para;", "\u00b6"), ("&middot;", "\u00b7"),
    ("&raquo;", "\u00bb"), ("&frac12;", "\u00bd"), ("&times;", "\u00d7"), ("&auml;", "\u00e4"),
    ("&ccedil;", "\u00e7"), ("&egrave;", "\u00e8"), ("&eacute;", "\u00e9"), ("&ntilde;", "\u00f1"),
    ("&ouml;", "\u00f6"), ("&divide;", "\u00f7"), ("&uuml;", "\u00fc"), ("&szlig;", "\u00df"),
    ("&alpha;", "\u03b1"), ("&beta;", "\u03b2"), ("&gamma;", "\u03b3"), ("&mu;", "\u03bc"),
    ("&ensp;", "\u2002"), ("&emsp;", "\u2003"), ("&thinsp;", "\u2009"), ("&ndash;", "\u2013"),
    ("&mdash;", "\u2014"), ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"),
    ("&rdquo;", "\u201d"), ("&bull;", "\u2022"), ("&hellip;", "\u2026"), ("&euro;", "\u20ac"),
    ("&trade;", "\u2122"), ("&rarr;", "\u2192"), ("&minus;", "\u2212"), ("&le;", "\u2264"),
    ("&ge;", "\u2265"),
)

# --- templates and messages -----------------------------------------------------------
QUESTION_FRAMES = (
    "For the Nature medical-research article on {topic} (published {date}), what were the primary outcomes and how strong was the evidence?",
    "In the {date} Nature paper about {topic}, what study design and patient population did the authors use?",
    "What clinical or policy implications does the Nature study on {topic} ({date}) draw for healthcare practice?",
    "How do the authors of the {date} article on {topic} discuss limitations, bias, and generalizability?",
    "What novel methods or interventions does the Nature research on {topic} ({date}) evaluate compared with prior work?",
    "Summarize screening, diagnostic, or treatment conclusions from the Nature article on {topic} ({date}).",
    "What sample size, endpoints, and statistical results are reported in the {date} Nature study of {topic}?",
    "Does the {date} Nature paper on {topic} report harms, safety signals, or adverse events — and what were they?",
)
REFUSAL_MESSAGE = (
    "I made a Pinky promise that I will never ever give Invalid response"
)
REFUSAL_SELF_MARK = "pinky promise"
NO_SUGGESTIONS = (
    "\n\nNo verified topics are indexed yet. Verify sources in the HITL console, "
    "then try again."
)
SUGGESTION_HEADING = "\n\nTry one of these verified topics:"
DISCLAIMER = (
    "_Disclaimer: This tool supports research review only; it does not provide "
    "individual diagnoses or prescriptions._"
)
CLARIFICATION_MESSAGE = """**Clarification needed**

Your question could apply to **more than one** indexed Nature medical-research article in our corpus. To give a single, accurate answer with **one citation**, please specify:

- **Publication date** (YYYY-MM-DD, as listed on Nature)
- **Time window** (e.g. last 7 days vs full 30-day index) if relevant
- **Exact focus** — what you want from the article (e.g. main findings, methods, limitations, screening accuracy, policy implications)

Example: *"Summarize the 2026-06-01 Nature paper on asthma COPD screening — methods and clinical implications only."*

_We answer one article per question unless you are asking for a count or list across the portfolio._"""
DATE_NOT_FOUND = (
    "Sorry, we don't have any articles for {date} in our database. "
    "Try referring to our top 3 articles instead:"
)
EMPTY_CONTEXT_ANSWER = (
    "**Summary:** The indexed sources do not contain enough detail to answer "
    "confidently; try a more specific question or verify sources in the sandbox.\n\n"
)
NO_CONTEXT_ANSWER = (
    "I do not have sufficient information in the provided sources to answer "
    "that question safely. Please consult official ICMR/DHR guidelines or a "
    "qualified clinician.\n\n"
)
VERIFIED_QUESTION = (
    "What does verified {org} guidance in '{title}' state about clinical management "
    "and key recommendations?"
)
OFF_TOPIC_PROMPTS = (
    ("demo-off-topic-aliens-cancer",
     "👽 Do you think Aliens have cure for Cancer?",
     "Do you think aliens have a cure for cancer? Explain briefly in a science-fiction way, but keep it general (no medical advice)."),
    ("demo-off-topic-dietcoke-weight",
     "🥤 If I drink Diet Coke can I really cut that weight?",
     "If I drink Diet Coke can I really cut that weight? Keep it vague and general for a prototype demo."),
    ("demo-off-topic-intelligence",
     "🧠 What is the research done on Increasing Intelligence?",
     "What is the research done on increasing intelligence? Keep it general and not medical advice."),
    ("demo-off-topic-chilling-weight",
     "😎 Any reports on How to Loose weight by just chilling?",
     "Any reports on how to lose weight by just chilling? Keep it funny, vague, and prototype-only."),
    ("demo-off-topic-tea-preworkout",
     "🍵 Do you think Tea can be used as Pre workout?",
     "Do you think tea can be used as pre workout? Keep it vague, funny, and prototype-only."),
)
FALLBACK_PROMPT = (
    "fallback-tb-screening",
    "Bedaquiline-resistant TB under revised DOTS",
    "What does the indexed Nature research say about bedaquiline-resistant tuberculosis and DOTS treatment protocols?",
)
ANSWER_HEADINGS = (
    "article summary|summary|key points|important points|direct answer|top articles|"
    "sources|limitations|methods|results|findings|clinical implications"
)

# --- index verification ---------------------------------------------------------------
REQUIRED_METADATA = (
    "source_url", "document_title", "publication_year", "page_number", "exact_context",
    "verification_status", "source_org", "chunk_id", "content_hash",
)
LIVE_MODEL_PREFIX = "BAAI/"
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "
SAMPLE_QUERY = "tuberculosis Bedaquiline treatment guidelines"

# Whitespace as Unicode defines it for stripping; built from the rule, not listed.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
