"""Fixed values of the compliance domain, kept together and in plain text.

Everything here must hold exactly for results to be right: labels, keyword
lists, answer wording, detector patterns and file layouts.  Operators import
these values; none of them contains wording or word lists of its own.
"""

from __future__ import annotations

# --- risk labels -----------------------------------------------------------
# Position is the rank.
RISK_LEVELS = ("Low", "Medium", "High", "Critical")

# --- canonical entity types ------------------------------------------------
# Type -> label fragments that indicate it (lower case).
ENTITY_TYPE_WORDS = {
    "NRIC": ("nric",),
    "Passport": ("passport",),
    "Account": ("account",),
    "Salary": ("salary", "income", "payroll", "compensation"),
    "Address": ("address",),
    "Phone": ("phone", "mobile"),
    "Email": ("email",),
    "EmployeeID": ("emp", "employee", "staff id", "payroll number"),
    "PayNow": ("paynow",),
}
# Fixed value: a label with this word never counts as an account.
NOT_ACCOUNT_WORD = "payroll"

# --- intents ---------------------------------------------------------------
# Fixed values.
PII_SEARCH = "PII_SEARCH"
AML_SEARCH = "AML_SEARCH"
REG_SEARCH = "REG_SEARCH"
SAR_DRAFT = "SAR_DRAFT"
OUT_OF_SCOPE = "OUT_OF_SCOPE"

PII_INTENT_WORDS = ("nric", "salary", "pii", "chats", "messages")
AML_INTENT_WORDS = ("structuring", "crypto", "high-risk", "high risk")
REG_INTENT_PHRASES = ("mas 610", "suspicious transactions")
SAR_STRICT_ID = "t028"
DEFAULT_TRANSACTION_ID = "T028"

# Trigger words of the multi-intent classifier.
PII_TRIGGERS = (
    "nric", "identity", "passport", "phone", "account number", "iban", "salary", "leaked",
    "chats", "messages", "communication logs", "customer said",
    "pii", "personal data", "masking", "exposure", "data leak",
)
AML_TRIGGERS = (
    "crypto", "structuring", "smurfing", "layering", "funnel",
    "high-risk transaction", "suspicious transaction",
    "risk score", "aml", "typology",
    "wire to batam", "rapid withdrawals", "cash deposits",
)
REG_TRIGGERS = (
    "mas 610", "mas 626", "mas notice",
    "hkma", "basel iii", "lcr", "nsfr",
    "owner", "regulatory deadline", "article", "obligation",
    "what does regulation say about",
)
SAR_TRIGGERS = (
    "draft sar", "draft a sar", "write sar", "write a sar", "prepare sar", "prepare a sar",
    "suspicious activity report", "file report", "report this",
)

# --- weak labels of the raw (untagged) mode --------------------------------
# Keyword in the text -> label.
RAW_ENTITY_KEYWORDS = (
    ("nric", "NRIC"),
    ("passport", "Passport"),
    ("phone", "Phone"),
    ("phone number", "Phone Number"),
    ("account", "Account"),
    ("account number", "Account Number"),
    ("salary", "Salary"),
)
RAW_HIGH_WORDS = ("nric", "passport", "account")
RAW_MEDIUM_WORD = "salary"
NOT_TAGGED = "(not tagged)"

# --- modes and tools -------------------------------------------------------
# Fixed values.
MODE_RAW = "no_layer"
MODE_TAGGED = "layer"
TOOL_NAMES = {
    (PII_SEARCH, MODE_RAW): "raw_search_pii",
    (PII_SEARCH, MODE_TAGGED): "search_pii_tool",
    (AML_SEARCH, MODE_RAW): "raw_search_aml",
    (AML_SEARCH, MODE_TAGGED): "search_aml_tool",
    (REG_SEARCH, MODE_RAW): "raw_search_reg",
    (REG_SEARCH, MODE_TAGGED): "search_regulations_tool",
    (SAR_DRAFT, MODE_RAW): "none",
    (SAR_DRAFT, MODE_TAGGED): "draft_sar_tool",
}
TOOL_STRUCTURED_REG = "query_regulations"

# --- answer wording --------------------------------------------------------
# Fixed values.
NO_RESULTS = "No results found for your query."
OUT_OF_SCOPE_TEXT = (
    "Query out of scope for this demo — please ask about PII, AML high-risk "
    "transactions, MAS 610 regulations, or SAR drafting in our synthetic dataset."
)
NO_SAR = "No SAR draft available for the requested transaction."
NO_SAR_RAW = (
    "No SAR draft available for the requested transaction in this "
    "baseline mode (no tagged AML semantic layer)."
)
NOT_PROVIDED = "(not provided)"
MISSING = "(missing)"
NO_ID = "(no id)"
UNASSIGNED = "Unassigned"

PII_HEADLINE = "🚨 **PII Matches Found:**"
PII_TOTAL = "Total: %d hits (Critical: %d, High: %d, Medium: %d, Low: %d)"
PII_HIT = "\n• ID: `%s` | Risk: **%s** | Entities: %s"
PII_EXCERPT = "  _Excerpt (masked):_ "

AML_HEADLINE = "**High-Risk Transactions:**"
AML_TOTAL = "Total: %d transactions (showing up to first %d)."
AML_NARRATIVE = "  _Narrative:_ "

REG_HEADLINE = "**Regulatory Obligations:**"
REG_TOTAL = "Total: %d obligations (showing up to first %d)."

SNAPSHOT_HEADLINE = "Regulatory semantic-layer snapshot:"
SNAPSHOT_ORDER = (
    "reg_total_obligations",
    "reg_unique_documents",
    "reg_unique_owners",
    "reg_with_deadline",
    "reg_overdue_obligations",
    "reg_missing_owner",
)

TOPIC_SOURCE = "MAS Notice 610"
TOPIC_RISK = "suspicious"
TOPIC_NONE = (
    "In the tagged regulations, there are no suspicious-transaction "
    "obligations under MAS Notice 610 matching this filter."
)
COVERAGE_TOTAL = (
    "Under MAS Notice 610, the tagged regulatory data shows **%d** "
    "suspicious-transaction obligations.\n\n"
    "- **With deadlines captured:** %d\n"
    "- **Missing/blank deadlines:** %d\n"
)
COVERAGE_EXAMPLES = "\n**Examples (first few paragraphs):**\n"
MISSING_TOTAL = (
    "From **MAS Notice 610**, there are **%d** tagged suspicious-transaction obligations.\n"
    "Out of these, **%d** have a missing owner and/or deadline."
)
MISSING_EXAMPLES = "\n\n**Obligations with missing owner/deadline (first few):**\n"

VALIDATION_FALLBACK = (
    "Results available, but writer validation failed. Falling back to template output."
)

# Excerpt lengths and list limits.
PII_EXCERPT_CHARS = 140
AML_EXCERPT_CHARS = 160
REG_EXCERPT_CHARS = 200
EXAMPLE_CHARS = 160
RAW_HIT_LIMIT = 20
# Other names under which a table may hold a column, in order of preference.
COLUMN_NAMES = {
    "message_id": ("id",),
    "risk_flag": ("risk_level",),
    "pii_entities": ("entities",),
    "original_text": ("text",),
    "transaction_id": ("tx_id",),
    "amount_sgd": ("amount", "amount_SGD"),
    "risk_score": ("risk",),
    "aml_tags": ("tags", "typology"),
    "original_narrative": ("narrative",),
}
# Own wording.
MALFORMED_TEXT = "This question cannot be searched as a pattern."
REPORT_ROWS = 20
PREVIEW_ROWS = 3
COVERAGE_ROWS = 3
MISSING_ROWS = 5
TOP_LABELS = 15
TOP_RANKED = 10
NEIGHBOURS = 3

# --- golden questions ------------------------------------------------------
# The acceptance questions (q1-q6) and structured variants.
GOLDEN_QUESTIONS = (
    ("q1", "Show me any messages with NRIC leaks."),
    ("q2", "Have there been any salary details exposed in chats?"),
    ("q3", "Find high-risk transactions related to crypto."),
    ("q4", "Show me examples of structuring."),
    ("q5", "What are the MAS 610 rules on suspicious transactions?"),
    ("q6", "Draft a SAR for transaction T028"),
    ("q7", "How many suspicious transaction obligations under MAS 610 have deadlines captured?"),
    ("q8", "From MAS 610, show suspicious transaction obligations and highlight where owner "
           "or deadline is missing."),
    ("q9", "Which messages expose a phone contact?"),
    ("q10", "Tell me a joke."),
    ("q11", "SAR for T005"),
    ("q12", "high-risk"),
)

# --- banking detectors -----------------------------------------------------
# Fixed values: (label, canonical type, pattern, replacement, literal the match must contain).
# Order matters: each detector sees the text already masked by the ones before.
BANKING_DETECTORS = (
    ("Email", "Email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "<EMAIL>", "@"),
    ("Passport", "Passport", "([Pp]assport )[A-Z][0-9]{7}[A-Z]", "$1<PASSPORT>", "assport "),
    ("NRIC", "NRIC", "[STFG][0-9]{7}[A-Z]", "<NRIC>", None),
    ("Employee ID", "EmployeeID", "SG[0-9]{9}", "<EMP_ID>", "SG"),
    ("Account Number", "Account",
     "[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3,4}|[0-9]{3}-[0-9]{6}-[0-9]{3}"
     "|[A-Z]{2}[0-9]{2}[A-Z]{3,4}[0-9]{10,16}", "<ACCOUNT>", None),
    ("Phone", "Phone", "[+][0-9]{2}[0-9 ]{8,12}|[89][0-9]{3} ?[0-9]{4}", "<PHONE>", None),
    ("Address", "Address",
     "(Blk )?[0-9]+ [A-Z][A-Za-z0-9 ]* #[0-9]{2}-[0-9]{2,3}( S\\([0-9]{6}\\))?",
     "<ADDRESS>", " #"),
    ("Salary", "Salary",
     "((?:[Ss]alary|[Pp]ayslip|[Ii]ncome|[Pp]ayroll|[Gg]ross|[Nn]et)[^.<]*? )"
     "[0-9]{1,3}(?:,[0-9]{3})+"
     "|((?:[Ss]alary|[Pp]ayslip|[Ii]ncome|[Pp]ayroll)[^.<]*? )[0-9]{4,6}",
     "$1$2<SALARY>", None),
)

# Detectors for the generated test tables, same layout.
TABLE_DETECTORS = (
    ("EMAIL", "Email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "<EMAIL>", "@"),
    ("SECRET", "NRIC", "(token|api_key|password|secret) = \"[0-9a-f]{16,}\"", "<SECRET>", " = \""),
    ("ACCOUNT", "Account", "[0-9]{16}", "<ACCOUNT>", None),
    ("PHONE", "Phone", "[+(][0-9][0-9 ()-]{7,}[0-9]", "<PHONE>", None),
    ("IP", "EmployeeID", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "<IP>", None),
)

# --- typology rules --------------------------------------------------------
# Fixed values: (tag, pattern on the lower-cased narrative, weight).
BANKING_TYPOLOGIES = (
    ("structuring", "structur|threshold", 3),
    ("smurfing",
     "smurf|runner|on behalf|third party"
     "|different (person|people|individual|branch|counter)|coordinated", 3),
    ("funnel", "funnel|multiple (small )?(incoming|paynow)|strangers|turnover", 3),
    ("crypto", "crypto|virtual asset|wallet", 2),
    ("gambling", "betting|casino|gambling", 2),
    ("trade_based", "trade|invoic|goods", 3),
    ("layering", "layer|same-day|immediate|multiple accounts|personal accounts", 3),
    ("jurisdiction", "high-risk jurisdiction|bvi|panama|labuan|offshore|overseas", 2),
)
# Fixed values: (tag, pattern, low inclusive, high exclusive).
BANKING_AMOUNT_BAND = ("structuring", "cash deposit", 9000.0, 10000.0)
# Fixed values: (at least, points), highest first.
BANKING_AMOUNT_STEPS = ((100000.0, 2), (30000.0, 1))

# The same layout for the generated event table.
TABLE_TYPOLOGIES = (
    ("structuring", "structur|threshold", 3),
    ("smurfing", "signup", 3),
    ("funnel", "view .*: [0-9]}", 3),
    ("crypto", "error", 2),
    ("gambling", "click .*: 7", 2),
)
TABLE_AMOUNT_BAND = ("structuring", "purchase", 90.0, 100.0)
TABLE_AMOUNT_STEPS = ((100.0, 2), (30.0, 1))

# --- obligation rules ------------------------------------------------------
# Pattern on the lower-cased text -> label; first match wins.
RISK_TYPE_RULES = (
    ("suspicious|laundering|terroris|structuring|smurf|cash transaction|sanction", "AML/CFT"),
    ("due diligence|beneficial owner|politically exposed", "Customer Due Diligence"),
    ("liquidity|stable funding", "Liquidity Risk"),
    ("concentration", "Concentration Risk"),
    ("outsourc|third-party|vendor", "Third-party Risk"),
    ("cyber|penetration|authentication|encrypt|malware", "Cyber Risk"),
    ("transaction monitoring|alerts", "Transaction Monitoring"),
)
DEFAULT_RISK_TYPE = "Operational Risk"
# Pattern on the lower-cased text -> unit; all that match.
BUSINESS_UNIT_RULES = (
    ("laundering|suspicious|due diligence|compliance|monitor", "Compliance"),
    ("transaction|operation|continuity|cash", "Operations"),
    ("risk|outsourc|third-party", "Risk Management"),
    ("liquidity|stable funding", "Treasury"),
    ("system|cyber|penetration|cloud|authentication", "IT"),
    ("board", "Board"),
)
# Pattern on the lower-cased text -> owner; first match wins.
OWNER_RULES = (
    ("mlro|money laundering reporting|monitor .*money laundering", "MLRO"),
)
DEFAULT_OWNER = "Compliance"
# Deadline phrases; first match wins, %s keeps the captured period.
DEADLINE_PERIOD = "(?:within|later than) ([0-9]+ (?:business|calendar) days)"
DEADLINE_RULES = (
    ("at least annually|annually", "Annual"),
    ("ongoing|at all times", "Ongoing"),
)
# Document family -> regulation, with the remainder as article.
FAMILY_PREFIX = "Basel III"
SOURCE_SUFFIX = "\\s*\\(.*\\)$"

# The same layout for the generated document table.
TABLE_RISK_TYPE_RULES = (
    ("licensed under", "License"),
    ("(token|api_key|password|secret) = ", "Secret"),
    ("disgusting", "Conduct"),
)
TABLE_BUSINESS_UNIT_RULES = (
    ("licen[cs]e", "Legal"),
    ("@", "Support"),
    ("http", "Web"),
)
TABLE_OWNER_RULES = (
    ("general public license", "Legal"),
)
TABLE_DEADLINE_PERIOD = "(version [0-9])"
TABLE_DEADLINE_RULES = (
    ("cc by", "Annual"),
    ("license[.]", "Ongoing"),
)

# --- source files ----------------------------------------------------------
# Folders searched for an input file, in order.
CANDIDATE_FOLDERS = ("", "data", "tests_data")
OUTPUT_FOLDER = "outputs"
DATE_FORMAT = "dd-MM-yyyy"
