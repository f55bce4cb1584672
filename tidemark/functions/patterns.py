"""Patterns and word lists whose exact content decides results."""

# Semantic types; the order breaks ties.
SEMANTIC_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[1-9]?[0-9]{7,15}$",
    "zip_code": r"^\d{5}(-\d{4})?$",
    "credit_card": r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "ip_address": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "date": r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$",
    "currency": r"^\$?[\d,]+\.?\d{0,2}$",
}

# Column roles by words in the lower-cased name; the order decides.
ROLE_KEYWORDS = {
    "id": ["id", "key", "index", "identifier", "uuid"],
    "target": ["target", "label", "outcome", "result", "class"],
    "feature": ["feature", "attribute", "variable", "predictor"],
    "timestamp": ["time", "date", "timestamp", "created", "updated"],
    "categorical": ["category", "type", "group", "class", "status"],
    "numerical": ["amount", "count", "value", "score", "rate", "price"],
}

# Words in a column name that point to personal data.
PII_NAME_WORDS = ["email", "phone", "ssn", "social", "address", "name", "credit", "card"]

# Text that looks like a date at its start, or like a formatted number.
DATE_PREFIX = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"
FORMATTED_NUMBER = r"^\d{1,3}(,\d{3})*(\.\d+)?$"

# Columns that should never be negative, and value ranges per column name.
POSITIVE_COLUMNS = ["age", "price", "amount", "count", "quantity"]
VALUE_RANGES = {"age": (0.0, 150.0)}

# Separators that hint at a path or hierarchy.
HIERARCHY = r"[/\\>-]"

# Question intent: patterns per family.
SQL_PATTERNS = [
    r"generate\s+sql",
    r"create\s+sql",
    r"write\s+sql",
    r"sql\s+query\s+for",
    r"give\s+me\s+sql",
    r"show\s+me\s+sql",
    r"sql\s+to\s+",
    r"convert\s+to\s+sql",
    r"sql\s+statement",
]
ANALYSIS_PATTERNS = [
    r"what\s+is\s+the\s+(average|mean|sum|total|count|maximum|minimum)",
    r"how\s+many\s+",
    r"show\s+me\s+(top|bottom|highest|lowest)",
    r"(analyze|analysis)\s+",
    r"what\s+are\s+the\s+(trends|patterns)",
    r"compare\s+",
    r"find\s+(all|records|data)\s+where",
    r"list\s+(all|the)\s+",
    r"get\s+(me\s+)?(all|the)\s+",
    r"which\s+.*\s+has\s+the\s+(highest|lowest|most|least)",
    r"summarize\s+",
    r"group\s+by",
    r"calculate\s+",
    r"percentage\s+of",
    r"distribution\s+of",
    r"list\s+.*\s+(customers|users|records|data|entries)",
    r"show\s+.*\s+(customers|users|records|data|entries)",
    r"find\s+.*\s+(customers|users|records|data|entries)",
    r"get\s+.*\s+(customers|users|records|data|entries)",
    r"display\s+.*\s+(customers|users|records|data|entries)",
    r"retrieve\s+.*\s+(customers|users|records|data|entries)",
    r"(list|show|find|get|display)\s+.*\s+(from|in|where|who|that)",
    r".*\s+who\s+(are|have|meet)",
    r".*\s+that\s+(are|have|meet)",
    r".*\s+with\s+",
    r".*\s+where\s+",
]
DOCUMENT_PATTERNS = [
    r"what\s+does\s+the\s+document\s+say",
    r"according\s+to\s+the\s+(document|pdf|file)",
    r"find\s+information\s+about",
    r"search\s+for\s+",
    r"what\s+is\s+mentioned\s+about",
    r"explain\s+.*\s+from\s+the\s+document",
]
QUESTION_WORDS = ["what", "how", "when", "where", "which", "who"]
INDICATOR_WORDS = ["total", "average", "count", "sum", "maximum", "minimum", "highest", "lowest"]
RETRIEVAL_WORDS = ["list", "show", "find", "get", "display", "retrieve", "give", "provide"]
EXPLICIT_SQL = ["generate sql", "create sql", "write sql", "sql query", "sql for"]

# Parts of a token that mark it as an address or link, which is never corrected.
SKIP_MARKS = ["@", ":", "/", ".com"]

# White space of Unicode and the ASCII separators, as one character class.
WHITE_SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
