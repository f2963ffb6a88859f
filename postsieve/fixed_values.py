"""Fixed values.

Word lists, patterns, labels and limits that have to be exactly these for results to match. They are
defaults only: every operator takes its list, pattern or limit as a parameter.
"""

from __future__ import annotations

# --- Fixed values: feed labels -------------------------------------------------------------------
MAIL = "LinkedIn"
CARDS = "LinkedIn"
SEARCH_API = "Adzuna"
ARRAY_FEED = "RemoteOK"
CATEGORY_FEED = "Remotive"
RSS = "WeWorkRemotely"
PAGED_SEARCH = "JSearch"
SOURCES = [MAIL, SEARCH_API, ARRAY_FEED, CATEGORY_FEED, RSS, PAGED_SEARCH]

# --- Fixed values: limits ------------------------------------------------------------------------
FEED_CHARS = 1200
DETAIL_CHARS = 4000
REQUEST_CHARS = 1500
EVALUATION_CHARS = 1200
LEDGER_DAYS = 21
STORE_ROWS = 300
DIGEST_ROWS = 10
KEEP_SCORE = 3
GATE_DAYS = 3
RECENCY_DAYS = {"mail": 2, "cards": 1, "search_api": 3, "paged_search": 3}
ID_TITLE_CHARS = 30
ID_COMPANY_CHARS = 20
ID_CHARS = 12
SCORE_DOTS = 5

# --- Fixed values: scoring labels ----------------------------------------------------------------
DEFAULT_SCORE = 3
DEFAULT_LANE = "ADJACENT"
LANES = ["CORE", "ADJACENT"]
SCORED_METHOD = "claude"
FALLBACK_METHOD = "fallback"

# --- Fixed values: title terms that exclude a posting (substrings) --------------------------------
EXCLUDED_TITLE_TERMS = [
    "software engineer", "backend engineer", "frontend engineer", "fullstack engineer",
    "devops engineer", "data engineer", "machine learning engineer", "security engineer",
    "platform engineer", "infrastructure engineer", "systems engineer", "developer", "programmer",
    "ux designer", "ui designer", "ui/ux designer", "user experience designer",
    "interaction designer", "account executive", "sales representative", "finance director",
    "medical director", "clinical director", "legal counsel", "data scientist", "data analyst",
    "junior", "intern", "entry level", "customer support", "technical support", "help desk",
    "customer service",
]

# --- Fixed values: blocked hosts (substrings of the network location) -----------------------------
BLOCKED_DOMAINS = [
    "liveblog365.com", "unaux.com", "infinityfree.me", "wuaze.com", "fast-page.org", "zya.me",
    "starterparadise.com", "lovestoblog.com", "iceiy.com", "hiresociall.com", "jaabz.com",
    "learn4good.com", "jooble.org", "whatjobs.com", "bebee.com", "theelitejob.com", "lensa.com",
    "jobleads.com", "talent.com", "gusher.co", "career.zycto.com", "wfh.hiresociall.com",
]

# --- Fixed values: workplace signals (substrings of title and description) ------------------------
ON_SITE_SIGNALS = [
    "hybrid", "on-site", "onsite", "in-office", "in office", "in-person", "in person",
    "office required", "must be local", "must be in", "days in office", "days per week in",
    "occasional travel required", "relocation required",
]
REMOTE_SIGNALS = [
    "remote", "work from home", "wfh", "fully distributed", "anywhere", "telecommute", "telework",
    "distributed team", "work from anywhere", "location independent",
]

# --- Fixed values: residency patterns -------------------------------------------------------------
RESIDENCY_PATTERNS = [
    r"\bu\.?s\.?\s*(citizens?|residents?|nationals?)\s+only\b",
    r"\b(citizens?|residents?)\s+of\s+the\s+(u\.?s\.?|united states|usa)\s+only\b",
    r"\bmust\s+be\s+(a\s+)?u\.?s\.?\s*(citizen|resident|national)\b",
    r"\bmust\s+be\s+(located|based|residing|living)\s+in\s+the\s+(u\.?s\.?|united states|usa)\b",
    r"\bmust\s+(reside|live|be located|be based)\s+in\s+the\s+(u\.?s\.?|united states|usa)\b",
    r"\b(u\.?s\.?|united states|usa)\s+(residents?|citizens?|based)\s+only\b",
    r"\bonly\s+open\s+to\s+(u\.?s\.?|united states|usa)\b",
    r"\bopen\s+(only\s+)?to\s+(u\.?s\.?|united states|usa)\s+(residents|citizens|applicants)\b",
    r"\bcontinental\s+united states\s+only\b",
    r"\b(u\.?s\.?|united states)\s+only\b",
]
# Every residency pattern needs one of these words; a cheap test before the patterns run.
RESIDENCY_WORDS = ["only", "must", "open"]

OPENNESS_PATTERNS = [
    r"\bcanad(a|ian)\b",
    r"\bnorth\s+america\b",
    r"\bamericas\b",
    r"\b(latam|latin america)\b",
    r"\bworldwide\b",
    r"\banywhere\s+(in\s+)?(the\s+)?(world|globe)\b",
    r"\bglobal(ly)?\s+(remote|distributed)\b",
    r"\bremote\s+(international|worldwide|global)\b",
    r"\bopen\s+to\s+(applicants\s+)?(from\s+)?(any|all)\s+(country|countries|locations?)\b",
    r"\bcosta\s+rica\b",
    r"\bmexico\b",
]

# --- Fixed values: senior title alternatives (word-bounded as a whole) ----------------------------
SENIOR_TITLE_ALTERNATIVES = [
    r"creative director", r"executive creative director", r"group creative director",
    r"associate creative director", r"acd", r"ecd", r"gcd",
    r"head of (creative|brand|content|marketing|design|experience|programming|culture|communications|growth|copy|story)",
    r"(?:s?vp|vice president)\s+(of\s+)?(creative|marketing|brand|design|content|experience|communications)",
    r"chief (brand|marketing|creative|experience|content|communications) officer",
    r"cmo", r"cco", r"cbo", r"ccmo", r"cxo",
    r"(creative|brand|art|content|marketing|design|narrative|experience|immersive|communications|copy|story)\s+director",
    r"director\s*(of|,)\s+(creative|brand|content|marketing|design|experience|communications|copy|story)",
    r"(creative|brand|content|marketing|design)\s+lead",
    r"creative technologist", r"ai creative director", r"creative partner",
]

# --- Fixed values: array feed relevance -----------------------------------------------------------
RELEVANT_TAGS = [
    "marketing", "content", "creative", "brand", "design", "executive", "director", "lead", "manager",
]
RELEVANT_TITLE_TERMS = [
    "director", "head of", "chief", "vp ", "lead", "creative", "brand", "content", "marketing",
]

# --- Fixed values: category feed ------------------------------------------------------------------
DEFAULT_LOCATION = "Worldwide"
SKIPPED_REGIONS = ["europe", "european", "asia", "apac", "emea", "africa", "middle east"]
RESCUED_REGIONS = ["americas", "worldwide", "global", "us", "canada"]

# --- Fixed values: card and detail page classes ---------------------------------------------------
CARD_CLASS = "base-card"
CARD_TITLE_CLASS = "base-search-card__title"
CARD_COMPANY_CLASS = "base-search-card__subtitle"
CARD_LINK_CLASS = "base-card__full-link"
DETAIL_CONTAINERS = [
    ("div", "show-more-less-html__markup"),
    ("section", "show-more-less-html"),
    ("div", "description__text"),
]

# --- Fixed values: external id patterns, first hit wins -------------------------------------------
EXTERNAL_ID_PATTERNS = [
    r"currentJobId=(\d+)",
    r"/(?:comm/)?jobs/view/[^/?\s#]*?(\d{6,})(?:[/?#]|$)",
    r"/jobs/(\d{6,})(?:[/?#]|$)",
    r"(\d{7,})(?:[/?#]|$)",
]
EXTERNAL_ID_PARAMETER = "currentJobId"
EXTERNAL_URL_FORMAT = "https://www.linkedin.com/jobs/view/%s/"

# --- Fixed values: alert mail, posting anchors ----------------------------------------------------
MAIL_SITE = "linkedin.com"
MAIL_SHORT_SITE = "li.com"
ANCHOR_URL_MARKERS = ["/jobs/view/", "/comm/jobs/view/", "currentJobId="]
ANCHOR_SCAFFOLDING = [
    "actively hiring", "actively recruiting", "now hiring", "apply with resume", "apply now",
    "easy apply", "people clicked apply", "promoted by hirer", "responses managed",
    "view all jobs", "see all", "unsubscribe", "manage", "settings", "connections",
    "view profile", "view company", "click here", "show more", "show less", "sign in", "log in",
    "follow", "save this job", "dismiss", "not interested",
]
LOCATION_PATTERN = r"[a-z .,\-]{2,40}"
LOCATION_WORDS = [
    "canada", "united states", " usa", "ontario", "quebec", "california", "texas", "new york",
    "metropolitan area", "remote",
]
ANCHOR_BLOCK_TAGS = ["td", "div", "table", "tr"]
COMPANY_TAGS = ["span", "p", "div", "td"]

# --- Fixed values: alert mail, anchors without a posting url --------------------------------------
LOOSE_SCAFFOLDING = [
    "apply", "unsubscribe", "manage", "settings", "connections", "canada", "ontario", "toronto",
    "united states", "view all", "see more", "learn more", "click here", "sign in", "log in",
    "linkedin", "privacy", "terms", "help", "support", "profile", "resume", "salary", "dismiss",
    "not interested", "save", "easy apply", "promoted", "following", "connect",
]
STRONG_TITLE_SIGNALS = [
    "creative director", "head of creative", "chief creative", "executive creative",
    "group creative", "vp creative", "chief brand", "head of brand", "brand director",
    "chief marketing", "head of marketing", "vp marketing", "head of content",
    "director of content", "content director", "head of experience", "narrative director",
    "chief experience", "creative technologist", "ai creative", "creative lead",
]

# --- Fixed values: alert mail, plain text lines ---------------------------------------------------
LINE_URL_MARKERS = ["linkedin.com/jobs/view/", "linkedin.com/comm/jobs/view/"]
LINE_URL_PATTERN = r'https?://[^\s<>"]+linkedin\.com[^\s<>"]*jobs[^\s<>"]*'
LINE_SCAFFOLDING = [
    "actively hiring", "apply with resume", "apply now", "easy apply", "people clicked apply",
    "promoted by", "view all jobs", "see all", "unsubscribe", "manage your", "view profile",
    "view company", "click here", "this company is", "you can also", "based on your",
]
