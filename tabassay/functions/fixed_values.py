"""Values that decide the results: tokens, patterns, weights, limits, wordings.

Nothing here is logic.  Every list is a fixed value the operators must agree on.
"""

# White space removed by a trim (the Unicode set Python strips).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
    " \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts that mean "missing" when a table is loaded.
NA_TOKENS = ["", "NA", "N/A", "NULL", "null", "NaN", "nan", "None"]

# Delimiters tried on a text file, most preferred first.
DELIMITERS = [",", "\t", ";", "|"]
DELIMITER_SAMPLE = 2048

# Keys of a JSON object that may hold the rows, in lookup order.
RECORD_KEYS = ["data", "rows", "records", "items", "results"]

# Numeric grammar.  Texts outside it (also "TBD", "n/a") are not numbers.
FINITE_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE_NUMBER = r"^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$"

# The wider grammar of "looks like a number" (Python float literals).
FLOAT_LITERAL = (
    r"^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN]"
    r"|(\p{Nd}+(_\p{Nd}+)*(\.(\p{Nd}+(_\p{Nd}+)*)?)?|\.\p{Nd}+(_\p{Nd}+)*)"
    r"([eE][+-]?\p{Nd}+(_\p{Nd}+)*)?)$"
)

# Date shapes, first match wins.
DATE_SHAPES = [
    ("ISO", r"^\d{4}-\d{2}-\d{2}$"),
    ("US", r"^\d{2}/\d{2}/\d{4}$"),
    ("EU", r"^\d{2}-\d{2}-\d{4}$"),
    ("ISO_SLASH", r"^\d{4}/\d{2}/\d{2}$"),
    ("YYYY-MM", r"^\d{4}-\d{2}$"),
    ("YYYY", r"^\d{4}$"),
    ("TEXT", r"^[A-Z][a-z]{2}\s+\d{1,2},\s+\d{4}$"),
]

# Fragments left behind by a wrong decoding.
MOJIBAKE = [
    "Ã©", "Ã¼", "Ã¤", "Ã¶", "Ã±",
    "â€™", 'â€"', "â€œ", "â€", "Â£",
    "Å¡", "Å¾", "Å", "Ä",
]

# A letter and a digit in one line.  Where both occur, two of them have no
# other letter or digit between them; put this way, long texts take linear time.
LETTER_AND_DIGIT = r"[A-Za-z][^A-Za-z0-9\n]*[0-9]|[0-9][^A-Za-z0-9\n]*[A-Za-z]"

# How many leading non-null values the heads look at.
ID_HEAD, DATE_HEAD, EMAIL_HEAD = 50, 100, 10

# Column names for which negative numbers are normal.
SIGNED_NAME_PARTS = ["lat", "lon", "coord", "temp"]

# Score levels, best first, with the lowest score of each.
LEVELS = [("Excellent", 90), ("Good", 70), ("Needs Cleaning", 50), ("Poor", None)]

# Repairs that may be applied to a table.
FIX_TYPES = ["dedupe", "drop_nulls", "impute_median", "impute_mode", "strip_whitespace"]

# The e-mail contract pattern.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

# Formats tried, in order, when looking for the newest date.
DATE_FORMATS = [
    "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "MMM d, yyyy", "yyyy-MM", "yyyy",
]

# Sector profiles - label, purpose, origin of the weights, dimension
# weights (each set sums to 1) and, per role, the column names that may fill it.
SECTOR_PROFILES = {
    "generic": {
        "label": "Generic CSV",
        "description": "Balanced hygiene scoring for any tabular dataset.",
        "source": "Default hygiene weights.",
        "weights": {
            "completeness": 0.25, "uniqueness": 0.20, "outliers": 0.20,
            "type_consistency": 0.15, "cardinality": 0.10, "deep_checks": 0.10,
        },
        "hints": {},
    },
    "retail": {
        "label": "Retail / Transactional",
        "description": "Keys, sales facts, and duplicate transaction detection.",
        "source": "TCS DQART retail; Wang & Strong fitness-for-use.",
        "weights": {
            "completeness": 0.25, "uniqueness": 0.20, "timeliness": 0.15,
            "validity": 0.15, "type_consistency": 0.10, "outliers": 0.15,
        },
        "hints": {
            "store_id": ["store_id", "store", "location_id", "store_nbr"],
            "date": ["date", "dt", "transaction_date", "week"],
            "sku": ["sku", "item_id", "product_id", "item"],
            "sales": ["sales", "revenue", "amount", "weekly_sales"],
        },
    },
    "healthcare": {
        "label": "Healthcare / Clinical",
        "description": "Completeness and consistency for clinical or claims data.",
        "source": "Al-Hgaish et al. AHP on ISO 25012; Kahn et al. EHR framework.",
        "weights": {
            "completeness": 0.21, "validity": 0.16, "type_consistency": 0.14,
            "timeliness": 0.15, "precision": 0.14, "deep_checks": 0.10,
            "uniqueness": 0.10,
        },
        "hints": {
            "patient_id": ["patient_id", "member_id", "mrn", "subject_id"],
            "event_date": ["date", "event_date", "service_date", "admit_date"],
        },
    },
    "financial": {
        "label": "Financial / KYC",
        "description": "Timeliness, integrity, and compliance-oriented checks.",
        "source": "Li et al. Future Internet 2023 (trust institution AHP weights).",
        "weights": {
            "timeliness": 0.36, "completeness": 0.23, "validity": 0.13,
            "compliance": 0.11, "type_consistency": 0.08, "uniqueness": 0.09,
        },
        "hints": {
            "customer_id": ["customer_id", "client_id", "account_id", "cif"],
            "email": ["email", "email_address"],
        },
    },
    "survey": {
        "label": "Survey / Research",
        "description": "Item-level completeness and duplicate respondent detection.",
        "source": "AAPOR Standard Definitions; Total Survey Error framework.",
        "weights": {
            "completeness": 0.25, "uniqueness": 0.25, "validity": 0.25,
            "type_consistency": 0.15, "deep_checks": 0.10,
        },
        "hints": {"respondent_id": ["respondent_id", "response_id", "id", "uuid"]},
    },
    "ml_training": {
        "label": "ML Training",
        "description": "Labels, feature completeness, and duplicate row detection.",
        "source": "Gong et al. dataset quality survey; ML training DQ practice.",
        "weights": {
            "label_quality": 0.25, "completeness": 0.20, "uniqueness": 0.15,
            "type_consistency": 0.15, "outliers": 0.15, "validity": 0.10,
        },
        "hints": {"label": ["label", "target", "y", "class"]},
    },
}

# Contract rules - id, name, severity, kind, the roles whose columns it is
# about, and its parameter.  The first holds for every table; a sector's rules apply where
# all their roles are filled.
EVERY_TABLE = [("no_duplicate_rows", "No duplicate rows", "warning", "no_duplicate_rows", [], None)]
SECTOR_RULES = {
    "retail": [
        ("unique_transaction", "Unique ({})", "critical", "unique", ["store_id", "date", "sku"], None),
        ("sales_non_negative", "{} ≥ 0", "critical", "min_value", ["sales"], 0),
    ],
    "financial": [
        ("email_format", "Valid email format ({})", "warning", "regex", ["email"], EMAIL_PATTERN),
    ],
    "ml_training": [
        ("label_present", "Label column present ({})", "critical", "not_null", ["label"], None),
    ],
    "survey": [
        ("unique_respondent", "Unique respondent ({})", "warning", "unique", ["respondent_id"], None),
        ("high_item_missingness", "Rows with more than 2 empty items", "warning",
         "max_empty_cells_per_row", [], 2),
    ],
}
