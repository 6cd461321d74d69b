"""Word lists, patterns and constants that fix the results. Order matters wherever a list is searched for its first hit."""

# Scales of numbers, first hit in this order.
SCALES = [
    ("k", 1e3), ("thousand", 1e3), ("m", 1e6), ("mn", 1e6), ("million", 1e6), ("millions", 1e6), ("b", 1e9), ("bn", 1e9), ("billion", 1e9), ("billions", 1e9),
    ("t", 1e12), ("tn", 1e12), ("trillion", 1e12), ("trillions", 1e12), ("lakh", 1e5), ("crore", 1e7),
]

# Currency marks, first hit in this order.
CURRENCIES = [
    ("$", "USD"), ("usd", "USD"), ("dollar", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"), ("pound", "GBP"),
    ("₹", "INR"), ("inr", "INR"), ("rupee", "INR"),
]

# Words that name a unit.
UNIT_WORDS = "employees|stores|units|metric tons|shares|locations|users|subscribers"

# Canonical predicate -> its aliases.
PREDICATE_ALIASES = {
    "revenue": ["annual turnover", "yearly revenue", "total revenue", "sales revenue", "turnover", "revenue from operations", "revenue from services", "revenue from customers", "service revenue", "total income"],
    "net_revenue": ["net turnover", "net sales"],
    "gross_revenue": ["gross turnover", "gross sales"],
    "ebitda": ["adjusted ebitda", "reported ebitda", "service ebitda", "operating ebitda"],
    "operating_income": ["operating profit", "operating earnings"],
    "net_income": ["net profit", "net earnings"],
    "express_parcel_volume": ["express parcels shipped", "express parcel shipments", "express parcels", "express parcel"],
    "freight_volume": ["ptl freight delivered", "ptl freight tonnage", "freight tonnage"],
    "pincode_reach": ["pin codes covered", "pin-code reach", "pincode reach"],
    "active_customers": ["no. of active customers", "active customers"],
    "headquarters": ["headquarters", "hq", "head office", "registered office", "corporate address", "office address"],
    "ceo": ["chief executive officer"],
    "director": ["managing director", "board member"],
    "employees": ["headcount", "total employees", "workforce", "workforce strength"],
    "real_gdp_growth": ["real gdp growth", "gdp growth", "real gdp growth rate", "economic growth", "gross domestic product", "gross domestic product growth"],
    "cpi_inflation": ["cpi inflation", "headline cpi inflation", "headline inflation", "retail inflation", "consumer price index", "cpi c"],
    "wpi_inflation": ["wpi inflation", "wholesale price inflation", "wholesale price index"],
    "fiscal_deficit": ["fiscal deficit", "gross fiscal deficit", "fiscal deficit percent of gdp", "fiscal deficit of gdp"],
    "current_account_deficit": ["current account deficit", "cad percent of gdp"],
    "forex_reserves": ["foreign exchange reserves", "forex reserves", "foreign currency assets"],
    "repo_rate": ["policy repo rate", "repo rate", "policy rate"],
}

# Metrics of tables and callouts, first hit in this order.
FAST_METRICS = [
    ("revenue", ["revenue from services", "revenue from operations", "revenue from customers", "total revenue", "revenue", "turnover"]),
    ("total_income", ["total income"]),
    ("ebitda", ["adjusted ebitda", "reported ebitda", "service ebitda", "operating ebitda", "ebitda"]),
    ("ebitda_margin", ["ebitda margin", "adj. ebitda margin"]),
    ("express_parcel_volume", ["express parcels shipped", "express parcel shipments", "express parcel volume", "express parcels"]),
    ("freight_volume", ["ptl freight delivered", "ptl freight tonnage", "freight volume", "freight delivered"]),
    ("pincode_reach", ["pin-code reach", "pin codes covered", "pincode reach", "pincodes"]),
    ("delivery_centres", ["last-mile delivery centres", "delivery centres"]),
    ("workforce", ["workforce strength", "total employees", "workforce"]),
    ("active_customers", ["no. of active customers", "active customers"]),
    ("real_gdp_growth", ["real gdp growth", "gdp growth", "real gdp", "economic growth", "gross domestic product"]),
    ("cpi_inflation", ["cpi inflation", "headline inflation", "retail inflation", "cpi headline", "cpi (combined)", "inflation"]),
    ("wpi_inflation", ["wpi inflation", "wholesale price inflation", "wholesale price index"]),
    ("fiscal_deficit", ["fiscal deficit", "gross fiscal deficit"]),
    ("current_account_deficit", ["current account deficit", "cad (% of gdp)", "cad"]),
    ("forex_reserves", ["foreign exchange reserves", "forex reserves"]),
    ("repo_rate", ["policy repo rate", "repo rate", "policy rate"]),
]

# Metric groups.
RATE_METRICS = ["real_gdp_growth", "cpi_inflation", "wpi_inflation", "fiscal_deficit", "current_account_deficit", "repo_rate"]
MACRO_METRICS = ["real_gdp_growth", "cpi_inflation", "wpi_inflation", "fiscal_deficit", "current_account_deficit", "forex_reserves", "repo_rate"]
MACRO_INSTITUTIONS = ["reserve bank of india", "government of india", "international monetary fund", "national statistical office", "india"]

# Lines that are no callout.
CALLOUT_STOP_LINES = ["YoY", "QoQ", "Bps", "ss", "TL", "SCS", "PTL", "FY24", "FY23", "FY22", "FY21"]

# Institutions by pattern, first hit in this order.
INSTITUTIONS = [
    ("Reserve Bank of India|RBI", "Reserve Bank of India"),
    ("Ministry of Finance|Government of India|Department of Economic Affairs", "Government of India"),
    ("International Monetary Fund|IMF", "International Monetary Fund"),
    ("National Statistical Office|NSO|MoSPI", "National Statistical Office"),
    (r"Delhivery\s*(?:Limited|Ltd\.?|Corporate)?", "Delhivery Limited"),
]

# Legal forms by pattern, and how they are spelt.
LEGAL_FORMS = [
    (r"\b(?:Corp\b\.?|Corporation)\b", "Corporation"), (r"\b(?:Inc\b\.?|Incorporated)\b", "Inc."), (r"\b(?:Ltd\b\.?|Limited)\b", "Ltd."), (r"\b(?:LLC|L\.L\.C\.)\b", "LLC"),
]

# Patterns of numbers and periods.
NUMBER = r"([\d,]+(?:\.\d+)?)"
FISCAL_SPAN = r"\b(?:FY|Fiscal|Financial\s*Year)?\s*(?:20)?(\d{2})[-/](\d{2})\b"
FISCAL_YEAR = r"\b(?:FY|Fiscal|Financial\s*Year)\s*(\d{2,4})\b"
QUARTER = r"\b(Q[1-4])\s*(?:FY)?\s*(\d{2,4})\b"
DAY_RANGE = r"(\d{4}-\d{2}-\d{2})\s*(?:to|–|-)\s*(\d{4}-\d{2}-\d{2})"
YEAR = r"\b(19\d{2}|20\d{2})\b"
FOOTNOTE = r"^\(?\d{1,2}\)?\*?$"
CHART_LABEL = r"^(?:chart|table|figure|section|box|appendix|\d+\.\d+)\b"

# Period of a callout by words in its text and file name, first hit in this order.
CALLOUT_PERIODS = [
    (["2024-25", "fy25", "fy2025"], "FY2025", "fiscal_year"), (["2023-24", "fy24", "fy2024", "2024"], "FY2024", "fiscal_year"), (["fy22", "2022"], "FY2022", "fiscal_year"),
    (["fy21", "2021"], "FY2021", "fiscal_year"), (["q4"], "Q4 FY2024", "quarter"),
]

# Texts of the explanations; %s stands for a value.
TIME_REASON = "Claim A specifies '%s' while Claim B specifies '%s'"
SCOPE_REASON = "Claim A pertains to '%s' scope while Claim B pertains to '%s' scope"
EXPLAIN_TIME = "The values refer to different reporting periods (%s), so the difference does not constitute a contradiction."
EXPLAIN_SCOPE = "The claims reflect different operational scopes (%s), explaining why the values differ."
EXPLAIN_SAME_VALUE = "Both independent sources assert the same %s of %s for %s with matching context."
EXPLAIN_CONFLICT = "Direct conflict: Source A reports %s while Source B reports %s for the same entity (%s) and identical period (%s)."
EXPLAIN_SAME_TEXT = "Both sources affirm identical information: '%s' for %s."

# Document subject by a part of the file name, first hit in this order.
SUBJECT_RULES = [
    (["delhivery"], "Delhivery Limited"), (["rbi"], "Reserve Bank of India"), (["economic-survey", "india-economic"], "Government of India"), (["imf"], "International Monetary Fund"),
]
DEFAULT_SUBJECT = "Acme Corporation"

# Dataset by a part of the file name, first hit in this order.
DATASET_RULES = [(["delhivery"], "delhivery"), (["economic", "rbi", "imf", "india"], "india-macroeconomy")]
DEFAULT_DATASET = "synthetic"
DATASETS = [
    ("all", "All Datasets", "Global Knowledge Base"),
    ("delhivery", "Delhivery Logistics (FY22–FY24)", "Corporate Starter Dataset"),
    ("india-macroeconomy", "India Macroeconomy (MoF / RBI / IMF)", "Institutional Starter Dataset"),
    ("synthetic", "Synthetic Showcase (Acme Corp)", "Evaluation Benchmark"),
]

# Density signals as (name, alternatives inside word boundaries, points a hit, most points or None), in order of report.
DENSITY_SIGNALS = [
    ("financial_metrics", r"\b(?:revenue|turnover|net income|operating income|sales|ebitda|profit|loss|assets|debt|cash|expenses|margin|dividend)\b", 3.5, None),
    ("currency_scales", r"(?:\$|€|£|₹|USD|EUR|GBP|INR|crore|crores|lakh|lakhs|million|millions|billion|billions|trillion)\b", 2.5, None),
    ("operational_metrics", r"\b(?:employees|headcount|customers|subscribers|shipments|volume|express parcel|centers|pincodes|coverage|clients|network)\b", 3.0, None),
    ("macro_metrics", r"\b(?:gdp|inflation|deficit|cpi|wpi|repo rate|forex|reserves|growth rate|gross domestic product|current account)\b", 3.5, None),
    ("macro_entities", r"\b(?:RBI|Reserve Bank|Ministry of Finance|Economic Survey|IMF|Government of India|Central Bank)\b", 2.5, None),
    ("temporal", r"\b(?:FY\s*\d{2,4}|Q[1-4]\s*\d{2,4}|\b(?:19|20)\d{2}\b|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}|as of|ended|quarter|fiscal)\b", 2.0, 6.0),
    ("roles_entities", r"\b(?:Delhivery|CEO|Managing Director|Officer|Founder|President|Chairman|Director|Headquarters|Registered Office|subsidiary)\b", 2.0, None),
    ("numbers_percentages", r"\b\d+(?:[.,]\d+)?\s*(?:%|percent|cr|mn|bn)?\b", 0.5, 4.0),
]
BOILERPLATE = (
    r"all rights reserved|confidential|printed on|page \d+ of \d+|this page intentionally left blank|table of contents|contents page|forward-looking statements|safe harbor"
    r"|statutory auditors|independent auditor's report|cin:|isin:"
)
TABLE_POINTS, BOILERPLATE_POINTS, LEAST_DENSITY, MOST_CHUNKS = 8.0, -10.0, 6.0, 15

# Characters that a well-read page consists of.
READABLE = r"[a-zA-Z0-9\s.,;:$\-–—%()/\"'#@&+=*<>\[\]]"

# Pairing, grounding and resolution thresholds.
PAIR_SCORES = {"same_subject": 0.45, "part_subject": 0.30, "same_predicate": 0.35, "macro": 0.25, "part_predicate": 0.20, "cosine": 0.20}
LEAST_PAIR_SCORE, MOST_PAIRS = 0.35, 8
GROUND = {"block": 0.80, "block_weak": 0.65, "other": 0.82, "page": 0.78}
VALUE_TOLERANCE = 0.01
EMBEDDING_DIM = 128
