"""Word lists, patterns and labels.

FIXED VALUES. Everything in this module is data that must equal the
behaviour being reproduced (keyword lists, their order, regex patterns,
label texts). Order is meaningful: it decides ranking ties and output order.
Patterns are written without flags; ``functions.text`` adds the flags per
engine.
"""

# ---------------------------------------------------------------- pricing ---
PRICE_MONTHLY_PATTERNS = [
    r"\$[\d,]+(?:\.\d{2})?\s*/\s*(?:user/|seat/|member/)?(?:mo|month)\b",
    r"\$[\d,]+(?:\.\d{2})?\s+per\s+(?:user\s+per\s+|seat\s+per\s+|member\s+per\s+)?(?:mo|month)\b",
    r"\$[\d,]+(?:\.\d{2})?\s+monthly\b",
]
PRICE_ANNUAL_PATTERNS = [
    r"\$[\d,]+(?:\.\d{2})?\s*/\s*(?:user/|seat/|member/)?(?:yr|year)\b",
    r"\$[\d,]+(?:\.\d{2})?\s+per\s+(?:user\s+per\s+|seat\s+per\s+)?(?:yr|year|annum)\b",
    r"\$[\d,]+(?:\.\d{2})?\s+(?:annually|yearly|per\s+year)\b",
]
TIER_WORDS = [
    "Free", "Starter", "Basic", "Essential",
    "Growth", "Standard", "Plus", "Professional", "Pro",
    "Business", "Scale", "Advanced", "Premium", "Elite",
    "Enterprise", "Ultimate", "Unlimited", "Max", "Team",
]
PRICING_CONTEXT_PATTERN = r"\b(?:plan|tier|month|mo|annual|year(?:ly)?|seat|user|per)\b"
PRICE_WINDOW_CHARS = 40
PRICE_CAP = 100000
ZERO_PRICE_PATTERN = r"\$0(?:\.00)?\b"
PRICE_AMOUNT_PATTERN = r"\$([\d,]+)"

PRICING_MODELS = [
    ("per_seat", ["per user", "per seat", "per member", "/user", "/seat", "user/mo", "seat/mo"]),
    ("flat_rate", ["flat rate", "one price", "single plan", "all-inclusive"]),
    ("usage_based", ["pay as you go", "usage-based", "per api call", "per request",
                     "pay per use", "metered", "metered billing", "per credit", "credits per"]),
    ("freemium", ["free forever", "free plan", "always free", "free tier",
                  "free crm", "free tools", "forever free"]),
    ("contact_sales", ["contact sales", "custom pricing", "talk to sales",
                       "request a quote", "request pricing", "get a quote"]),
]
TRIAL_OFFERS = [
    ("free_trial", ["free trial", "try free", "try it free", "14-day trial",
                    "30-day trial", "14 day trial", "30 day trial"]),
    ("free_plan", ["free plan", "free forever", "always free", "free tier",
                   "free crm", "free tools", "forever free"]),
    ("money_back", ["money-back", "money back", "refund guarantee"]),
    ("no_credit_card", ["no credit card", "no cc required", "without credit card"]),
]
FREE_PHRASES = ["free crm", "free tools"]

# -------------------------------------------------------------- messaging ---
H1_PATTERN = r"^# [^#]"
H2_PATTERN = r"^## [^#]"
H3_PATTERN = r"^### [^#]"
HEADING_PREFIX_PATTERN = r"^#+\s*"
N_SUBHEADLINES = 6
N_H3 = 4
BUCKET_MIN_SCORE = 2
BUCKET_TOP_N = 3
HEADING_WEIGHT = 3

SEGMENTS = [
    ("SMB", ["small business", "startup", "solopreneur", "freelancer", "small team"]),
    ("Mid-market", ["growing team", "mid-size", "scaling", "scale-up", "mid-market"]),
    ("Enterprise", ["enterprise", "fortune 500", "large team", "global", "organization"]),
    ("Developer", ["api", "developer", "open source", "integrate", "sdk", "webhook"]),
    ("Agency", ["agency", "client", "manage multiple", "white label", "reseller"]),
    ("eCommerce", ["ecommerce", "shopify", "store", "merchant", "shop"]),
]
VALUE_PROPS = [
    ("cost_leadership", ["affordable", "cheap", "save money", "low cost", "free", "reduce cost"]),
    ("speed", ["fast", "instant", "real-time", "quick", "in minutes", "in seconds"]),
    ("ease", ["easy", "simple", "no code", "drag and drop", "intuitive", "effortless"]),
    ("power", ["powerful", "advanced", "enterprise-grade", "robust", "feature-rich"]),
    ("outcome_driven", ["grow", "revenue", "roi", "results", "convert", "pipeline", "leads"]),
    ("collaboration", ["team", "together", "collaborate", "shared", "workspace"]),
    ("ai_native", ["ai-powered", "ai native", "machine learning", "intelligent", "predict"]),
]
TONES = [
    ("fear", ["risk", "lose", "falling behind", "miss out", "left behind", "threat"]),
    ("aspiration", ["grow", "succeed", "achieve", "dominate", "win", "thrive", "transform"]),
    ("trust", ["trusted", "reliable", "secure", "proven", "guaranteed", "certified"]),
    ("urgency", ["now", "today", "limited", "don't wait", "act fast", "hurry"]),
    ("empathy", ["struggle", "frustrate", "pain", "we understand", "we know"]),
    ("exclusivity", ["only", "unique", "exclusive", "first", "leader", "pioneering"]),
]
CTA_TYPES = [
    ("low_friction", ["get started", "try free", "start free", "sign up free", "try it free"]),
    ("demo_request", ["book a demo", "get a demo", "request demo", "schedule demo", "see it in action"]),
    ("sales_led", ["contact sales", "talk to sales", "speak to sales", "get a quote"]),
    ("high_intent", ["start free trial", "start your trial", "try for free"]),
    ("generic", ["sign up", "learn more", "get started", "explore"]),
]
PROOF_NOUN = r"(?:customers|users|companies|businesses|teams|reviews|integrations|countries)"
PROOF_PATTERNS = [
    r"[\d,]+\+?\s+" + PROOF_NOUN,
    r"(?:millions|thousands|hundreds)\s+of\s+" + PROOF_NOUN,
]
N_PROOF_POINTS = 5
UPTIME_PATTERN = r"\d{2,3}(?:\.\d+)?%\s*uptime"
BUZZWORDS = [
    "AI-powered", "all-in-one", "seamless", "robust", "cutting-edge",
    "next-generation", "world-class", "revolutionary", "game-changing",
    "innovative", "transformative", "best-in-class", "holistic", "synergy",
    "frictionless", "end-to-end", "360-degree", "360°",
]

# ------------------------------------------------------------- complaints ---
NAV_PATTERN = r"(\]\(https?://|\* \[|^\[.*\]\()"
REVIEW_LINE_MIN_CHARS = 25
COMPLAINT_CATEGORIES = [
    ("pricing_value", ["expensive", "overpriced", "costly", "pricey",
                       "not worth", "too much", "price increase", "raised prices",
                       "pricing", "cost", "cheap", "affordable"]),
    ("ux_complexity", ["difficult", "confusing", "complicated", "hard to use",
                       "steep learning curve", "clunky", "not intuitive",
                       "overwhelming", "complex", "messy", "unintuitive"]),
    ("performance", ["slow", "buggy", "crash", "glitch", "lag", "freeze",
                     "error", "downtime", "unreliable", "unstable", "bug"]),
    ("customer_support", ["poor support", "slow response", "unhelpful", "no support",
                          "bad customer service", "support team", "ticket", "wait time",
                          "unresponsive", "hard to reach"]),
    ("missing_features", ["missing", "lacks", "wish it had", "doesn't have",
                          "need more", "limited", "no option", "can't do",
                          "feature request", "would like to see", "needs improvement"]),
    ("integrations", ["integration", "doesn't integrate", "sync issue",
                      "api problem", "doesn't work with", "compatibility",
                      "connect", "native integration"]),
    ("onboarding", ["hard to set up", "setup", "onboarding", "getting started",
                    "documentation", "tutorial", "training", "learn"]),
    ("reporting_analytics", ["reporting", "analytics", "dashboard", "metrics",
                             "data export", "insights", "visibility", "tracking"]),
]
N_TOP_COMPLAINTS = 5
N_SAMPLE_LINES = 5
FEATURE_GAP_PATTERNS = [
    r"\bwish(?:ed)?\b.{0,20}(?:had|have|offered?)\s+([a-z][^\.\n]{8,60})",
    r"\bmissing\s+(?:a\s+|an\s+|the\s+)?([a-z][^\.\n]{8,50})",
    r"\b(?:doesn't|does not|can't|cannot)\s+([a-z][^\.\n]{5,40})",
    r"\b(?:lack|lacks|lacking)\s+([a-z][^\.\n]{5,50})",
    r"\b(?:need|needs|needed)\s+(?:a\s+|better\s+|more\s+|an\s+)?([a-z][^\.\n]{5,50})",
    r"\bwould\s+(?:love|like)\s+(?:to\s+see\s+|if\s+)?([a-z][^\.\n]{5,60})",
    r"\bno\s+(?:built[- ]in|native|direct)\s+([a-z][^\.\n]{5,40})",
    r"\blimited\s+([a-z][^\.\n]{5,40})",
]
GAP_NOISE_PREFIXES = ["the ", "a ", "an ", "to ", "and ", "or ", "it ", "is ", "was ", "be ", "by "]
GAP_MIN_CHARS = 8
N_FEATURE_GAPS = 10
COMMON_COMPETITORS = [
    "salesforce", "hubspot", "pipedrive", "zoho", "monday",
    "asana", "notion", "clickup", "airtable", "jira",
    "intercom", "zendesk", "freshdesk", "stripe", "mailchimp",
    "activecampaign", "klaviyo", "marketo", "pardot",
]
COMPARISON_TRIGGER_PATTERN = (
    r"\b(?:vs\.?|versus|compared (?:to|with)|alternative to|switched from|coming from|"
    r"migrated from|replaced)\s+([A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+){0,2})"
)
COMPETITOR_STOP_WORDS = ["the", "a", "an", "our", "us", "it", "this", "that"]
COMPETITOR_MIN_CHARS = 3
POSITIVE_SIGNALS = [
    "great", "love", "excellent", "amazing", "fantastic",
    "easy to use", "highly recommend", "best", "wonderful",
]
NEGATIVE_SIGNALS = [
    "hate", "terrible", "awful", "worst", "horrible",
    "useless", "waste", "disappointed", "frustrating", "poor",
]
SENTIMENT_POSITIVE_ABOVE = 0.6
SENTIMENT_NEGATIVE_BELOW = 0.4

# ---------------------------------------------------------------- signals ---
DEPARTMENTS = [
    ("engineering", ["software engineer", "backend", "frontend", "full stack", "sre", "devops", "platform"]),
    ("product", ["product manager", "product designer", "ux", "ui designer", "product lead"]),
    ("data_ai", ["data scientist", "ml engineer", "ai researcher", "data analyst", "data engineer"]),
    ("sales", ["account executive", "sales rep", "sales manager", "bdr", "sdr", "revenue"]),
    ("marketing", ["marketing manager", "growth", "content writer", "seo", "demand gen", "brand"]),
    ("customer_success", ["customer success", "implementation", "onboarding", "account manager", "csm"]),
    ("security", ["security engineer", "security analyst", "infosec", "compliance", "soc"]),
    ("finance_legal", ["finance", "accounting", "legal", "counsel", "cfo", "controller"]),
    ("hr_people", ["recruiter", "people ops", "hr business", "talent acquisition"]),
    ("leadership", ["vp of", "director of", "head of", "chief", "cto", "cmo", "cpo"]),
]
TECH_AREAS = [
    ("AI_ML", ["machine learning", "llm", "nlp", "generative ai", "ai engineer", "model training"]),
    ("mobile", ["ios", "android", "react native", "mobile engineer", "flutter"]),
    ("infrastructure", ["kubernetes", "aws", "gcp", "azure", "cloud", "terraform", "microservices"]),
    ("security", ["security", "zero trust", "soc 2", "gdpr", "compliance", "pen test"]),
    ("data_platform", ["spark", "kafka", "data warehouse", "dbt", "snowflake", "databricks"]),
    ("api_platform", ["api", "developer platform", "sdk", "integration", "webhook", "rest", "graphql"]),
    ("enterprise", ["enterprise", "salesforce", "sso", "saml", "audit log", "rbac"]),
    ("payments", ["payment", "billing", "stripe", "revenue recognition", "monetization"]),
]
# Declared order (ties of the dominant level resolve in this order).
SENIORITY = [
    ("junior", ["junior", "entry level", "associate", "intern", "graduate"]),
    ("mid", ["software engineer", "manager", "specialist", "analyst"]),
    ("senior", ["senior", "staff", "lead", "principal", "sr."]),
    ("leadership", ["director", "vp", "vice president", "head of", "chief"]),
]
# Classification priority (first hit wins per line).
SENIORITY_PRIORITY = ["leadership", "senior", "mid", "junior"]
SENIORITY_MIN_LINE_CHARS = 5
REGIONS = [
    ("EMEA", ["london", "berlin", "amsterdam", "paris", "dublin", "emea", "europe"]),
    ("APAC", ["singapore", "sydney", "tokyo", "bangalore", "apac", "asia"]),
    ("LATAM", ["são paulo", "mexico city", "latam", "latin america"]),
    ("North America", ["new york", "san francisco", "austin", "toronto", "chicago", "seattle"]),
    ("Remote", ["remote", "work from anywhere", "distributed", "fully remote"]),
]
INFER_AI = "Heavy AI/ML investment — likely building AI features"
INFER_SALES_LED = "Sales-led growth motion — acquiring new customers aggressively"
INFER_RETENTION = "Product-led / retention focus — more CS than Sales"
INFER_BALANCED = "Balanced growth — roughly equal Sales and CS investment"
INFER_ENTERPRISE = "Enterprise push — investing in security/compliance"
INFER_LEADERSHIP = "Leadership build-out — scaling org structure"
INFER_DEV_AI = "Building developer-facing AI platform"

# -------------------------------------------------------------- snapshots ---
MAX_SNAPSHOT_ARCHIVES = 10
MIN_PAGE_CHARS = 500
PAGE_ERROR_DEFAULT = "no markdown / too short"
PAGE_ERROR_CHARS = 200
REVIEW_URL_PREFIX = "https://www.capterra.com/p/"
URL_DISCOVERY_FAILED = "URL discovery failed (no sitemap match, no probe success)"
SHARE_SPIKE_FACTOR = 1.5
SHARE_SPIKE_FLOOR = 0.05

# ------------------------------------------------------------------- urls ---
DISCOVERY_KEYWORDS = [
    ("pricing", ["pricing", "plans", "/buy", "/subscribe"]),
    ("signals", ["careers/jobs", "/jobs", "careers", "/join-us", "/work-with-us"]),
]
FALLBACK_PATHS = [
    ("pricing", ["/pricing", "/plans"]),
    ("signals", ["/careers", "/jobs"]),
]
PROBE_MIN_CHARS = 500
ATS_MIN_CHARS = 200
ATS_TEMPLATES = [
    "https://boards.greenhouse.io/{slug}",
    "https://jobs.lever.co/{slug}",
    "https://{slug}.workable.com",
    "https://{slug}.ashbyhq.com",
]
N_SITEMAP_CHILDREN = 3
DEAD_DOMAIN_MARKERS = ["timeout", "err_connection"]
DOMAIN_PATTERN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"

# -------------------------------------------------------------- financial ---
MAX_PERIODS = 5
LABEL_REVENUE = r"(?:^|\b)Revenue"
LABEL_NET_INCOME = r"Net Income"
LABEL_TOTAL_ASSETS = r"(?:Total\s+)?Assets$"
LABEL_EQUITY = r"Stockholders.*Equity|Shareholders.*Equity"
LABEL_OPERATING_INCOME = r"Operating Income"
LABEL_RND = r"Research|R&D"
LABEL_INTANGIBLE = r"Intangible"
LABEL_PPE = r"Property.*Plant|PP&E"
LABEL_SEGMENT_REVENUE = r"Revenue|Sales|Net sales"
LABEL_CAPEX = r"Capital Expenditure"
LABEL_FREE_CASH_FLOW = r"Free Cash Flow"
RATIO_DIGITS = 6
INTENSITY_DIGITS = 4
MAX_TEXT_CHARS = 5000
TRUNCATION_SUFFIX = "... [truncated]"
MAX_EVENT_CHARS = 1000
MAX_COMPETITORS = 4

FILING_HEAD_N = {"10-K": 5, "8-K": 10, "4": 20, "3": 20, "5": 20, "DEF 14A": 5}
INSIDER_FORMS = ["4", "3", "5"]
INSIDER_CODES = [
    ("P", "Purchase"),
    ("S", "Sale"),
    ("A", "Grant/Award"),
    ("M", "Option Exercise"),
    ("C", "Conversion"),
    ("G", "Gift"),
]
UNKNOWN_NAME = "Unknown"
COMP_TABLES = ["executive_compensation", "compensation", "summary_compensation"]

GEO_SEGMENT_WORDS = [
    "americas", "europe", "asia", "china", "japan", "united states", "international",
    "greater china", "rest of", "emea", "apac", "latin", "canada", "india",
]
PRODUCT_SEGMENT_WORDS = [
    "product", "service", "iphone", "mac", "ipad", "wearable", "cloud", "office",
    "windows", "gaming", "linkedin", "advertising", "subscription", "hardware",
    "software", "intelligent cloud", "personal computing", "productivity", "aws",
]
ESG_TERMS_10K = [
    "environmental", "sustainability", "climate", "carbon", "social responsibility",
    "diversity", "governance", "esg", "human capital",
]
ESG_TERMS_PROXY = ["environmental", "sustainability", "corporate governance", "board diversity"]

# -------------------------------------------------------------- sentiment ---
VADER_ALPHA = 15
NEWS_LOOKBACK_DAYS = 14
NEWS_MAX_ARTICLES = 30
NEWS_SAMPLE_HEADLINES = 5
NEGATIVE_SPIKE_BELOW = -0.2
PATENT_CAP = 50
CPC_PREFIX_CHARS = 4
CPC_TOP_N = 10
NOT_FOUND = "Not Found"
NO_TICKER = "-1"
LEGAL_ADDRESS_DEFAULT = "N/A"

# ----------------------------------------------------------------- report ---
MODULE_ORDER = ["financial", "ip", "sentiment", "porters", "vrio", "pestel"]
IP_NOT_IMPLEMENTED = "IP module not implemented"
