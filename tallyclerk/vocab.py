"""Vocabularies, label lists, phrases and thresholds.

Everything in this module is a fixed value that decides results: change one and
verdicts change.  Logic lives elsewhere.
"""

from __future__ import annotations

# --- Fixed values: record vocabulary ---------------------------------------
FIELDS = (
    "shipper",
    "consignee",
    "notify_party",
    "port_of_loading",
    "port_of_discharge",
    "container_count",
    "gross_weight_kg",
)
PARTY_FIELDS = ("shipper", "consignee", "notify_party")
PORT_FIELDS = ("port_of_loading", "port_of_discharge")
COUNT_FIELDS = ("container_count",)
WEIGHT_FIELDS = ("gross_weight_kg",)

CATEGORIES = ("BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "GENERAL", "SPAM")
COMPARISON_CATEGORY = "BL_COMPARISON"
DEFAULT_CATEGORY = "GENERAL"

REVIEW_REASONS = (
    "missing_attachment",
    "unreadable",
    "wrong_doc_type",
    "missing_value",
    "low_confidence",
)
# The scorer reports on four of the five reasons, in this order.
SCORED_REASONS = ("wrong_doc_type", "missing_attachment", "unreadable", "missing_value")

STATUSES = ("OK", "MISMATCH", "NEEDS_REVIEW")
REVIEW_ACTIONS = ("confirm", "correct")

# --- Fixed values: thresholds ----------------------------------------------
TRUST_THRESHOLD = 0.60
MIN_USEFUL_CHARS = 40
DOC_TYPE_HEAD = 500
SNIPPET_CHARS = 200
MODEL_CAP = 0.80
OCR_CAP = 0.50
CONF_COLON, CONF_WIDE, CONF_WRAP, CONF_TIGHT = 0.95, 0.85, 0.80, 0.70
STRONG, WEAK, GUESS = 0.95, 0.75, 0.40
UNUSABLE_PREDICTION = 0.30
UNSTATED_CONFIDENCE = 0.70
QUALITY_MIN_CHARS, QUALITY_MIN_TOKENS, QUALITY_MIN_RATIO = 40, 10, 0.60
BATCH_SIZE = 15
SCORE_WEIGHTS = {"macro_f1": 0.30, "defect_f1": 0.20, "end_to_end": 0.50}

# --- Fixed values: document labels, most specific first ---------------------
LABELS: dict[str, list[str]] = {
    "shipper": ["Shipper/Exporter", "Shipper (Principal or Seller)", "Shipper", "SHIPPER"],
    "consignee": ["Consignee (Non-Negotiable)", "To the Order of", "Consignee", "CONSIGNEE"],
    "notify_party": [
        "Notify Party/Intermediate Consignee",
        "Notify Party",
        "NOTIFY PARTY",
        "Notify",
    ],
    "port_of_loading": [
        "Port of Loading (POL)",
        "PORT OF LOADING",
        "Port of Loading",
        "Load Port",
        "POL",
    ],
    "port_of_discharge": [
        "Port of Discharge (POD)",
        "PORT OF DISCHARGE",
        "Port of Discharge",
        "Discharge Port",
        "POD",
    ],
    "container_count": [
        "No. of Containers or Packages",
        "No. of Containers",
        "Total Containers",
        "Container Count",
    ],
    "gross_weight_kg": [
        "TOTAL Gross Weight (KG)",
        "TOTAL Gross Wt (kgs)",
        "Gross Weight (KG)",
        "Gross Wt (kgs)",
        "GROSS WEIGHT",
        "Gross Weight",
    ],
}

# --- Fixed values: document type markers ------------------------------------
OTHER_MARKERS = (
    "COMMERCIAL INVOICE",
    "PACKING LIST",
    "CERTIFICATE OF ORIGIN",
    "ARRIVAL NOTICE",
    "DELIVERY ORDER",
)
SI_MARKERS = ("SHIPPING INSTRUCTION", "BL INSTRUCTION", "BILL OF LADING INSTRUCTION")
BL_MARKERS = ("BILL OF LADING",)

# --- Fixed values: classification phrases, in order --------------------------
PHRASE_RULES: list[tuple[str, tuple[str, ...], float]] = [
    (
        "BL_COMPARISON",
        ("PLEASE COMPARE THE SI AND DRAFT BL", "SEND THE DRAFT BL", "DRAFT BL FOR"),
        STRONG,
    ),
    ("SI_REQUEST", ("PLEASE FIND SHIPPING INSTRUCTION", "SHIPPING INSTRUCTION FOR"), STRONG),
    (
        "INVOICE_QUERY",
        ("QUERY ON INVOICE", "DETENTION CHARGES", "GR IS STILL MISSING", "D&D"),
        STRONG,
    ),
    (
        "GENERAL",
        (
            "OUTSTANDING BL",
            "BERTHING REPORT",
            "SUBMIT SI & AED",
            "UPDATE SUMMARY",
            "LOADING COMPLETED",
            "PENDING ITEMS",
        ),
        STRONG,
    ),
    (
        "SPAM",
        (
            "CONGRATULAT",
            "PRIZE",
            "CLAIM YOUR",
            "MAILBOX HAS EXCEEDED",
            "VERIFY YOUR ACCOUNT",
            "LIMITED TIME OFFER",
            "UNPAID CUSTOMS",
            "BITCOIN",
            "GIFT CARD",
            "CLICK HERE",
            "HTTP://",
            "GUARANTEED",
        ),
        STRONG,
    ),
    ("INVOICE_QUERY", ("INVOICE",), WEAK),
]
ATTACHMENT_EVIDENCE = "has attachments"
DEFAULT_EVIDENCE = "no signal matched"
MODEL_EVIDENCE = "model"
MISSING_ATTACHMENT_PHRASE = "COMPARE THE SI"

# --- Fixed values: normalisation --------------------------------------------
BLANKS = ("", "???", "N/A", "N.A.", "NA", "TBA", "TBC", "-", "--", "TO BE ADVISED")
CORPORATE_SUFFIXES = (
    "CO", "COMPANY", "LIMITED", "LTD", "PVT", "PTE", "SDN", "BHD", "LLC", "INC",
    "INCORPORATED", "GMBH", "FZE", "FZ", "CORP", "CORPORATION", "PTY", "PLC", "SA",
    "NV", "BV", "AG", "SRL", "SPA",
)
NUMBER_WORDS = (
    "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX",
    "SEVEN", "EIGHT", "NINE", "TEN", "ELEVEN", "TWELVE",
)
LB_TO_KG = 0.45359237
REFERENCE_PATTERNS = (r"\(([A-Z]{2,4}\d{5,})\)", r"\b([A-Z]{3,4}\d{7,})\b")

# --- Fixed values: notes, reasons, report wording ---------------------------
NOTE_MISSING_ATTACHMENT = "A comparison was requested but the documents were not attached."
NOTE_NOTHING_TO_COMPARE = "No draft BL supplied yet; nothing to compare."
NOTE_UNREADABLE = "The {side} could not be read. It may be a scanned image."
NOTE_WRONG_TYPE = "An attachment is not a Shipping Instruction or Bill of Lading."
NOTE_SCANNED = (
    "Scanned document. The values below were recovered by OCR and are suggestions only"
    " - they were not compared. Please confirm or correct them."
)
NOTE_MISMATCH = "Discrepancy found in: {fields}."
NOTE_OK = "No mismatch detected."
NOTE_CONFIRMED = "Human reviewer confirmed the result."
NOTE_CORRECTED = "Human reviewer corrected {field} to {value}."
NOTE_SUPPLIED = "Human reviewer supplied {field}: {value}."

REASON_ABSENT = "value not found in the {side}"
REASON_LOW_CONFIDENCE = "extracted with low confidence"

WARN_NOT_FOUND = "attachment not found"
WARN_EMPTY = "attachment is empty"
WARN_MISSING_FIELDS = "fields not found: "
WARN_NO_READER = "no reader for {method}"

MODEL_LABEL = "(model)"
MODEL_SNIPPET = "recovered by language model"

REPORT_LABELS = {
    "shipper": "Shipper",
    "consignee": "Consignee",
    "notify_party": "Notify Party",
    "port_of_loading": "Port of Loading",
    "port_of_discharge": "Port of Discharge",
    "container_count": "Container Count",
    "gross_weight_kg": "Gross Weight (kg)",
}
AMENDMENT_SUBJECT = "Amendment required to draft Bill of Lading"
AMENDMENT_LINE = (
    "- {label}: the Shipping Instruction states {si}, the draft Bill of Lading states {bl}."
)
AMENDMENT_OPENING = "Dear Sir or Madam,\n\nWe have checked the draft Bill of Lading"
AMENDMENT_MIDDLE = (
    " against the Shipping Instruction and found the following discrepancies:\n\n"
)
AMENDMENT_CLOSING = (
    "\n\nThe Shipping Instruction is the authoritative reference. Please amend the draft"
    " accordingly and return it for checking before finalisation.\n\n"
    "Kind regards,\nShipping Operations"
)

# --- Fixed values: character sets -------------------------------------------
# What Python's str.strip() / str.split() treat as white space.
ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
UNICODE_SPACE = (
    ASCII_SPACE
    + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Windows-1252 characters for bytes 0x80-0x9F; five bytes have no character.
CP1252_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
CP1252_BYTES = tuple(b for b in range(0x80, 0xA0) if b not in CP1252_UNDEFINED)
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def distinct_labels(extra: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Labels per field without case-insensitive repeats, learned ones last.

    Matching ignores case, so a repeat can never win against its first spelling.
    """
    out: dict[str, list[str]] = {}
    for field in FIELDS:
        seen: set[str] = set()
        kept = []
        for label in LABELS[field] + list((extra or {}).get(field, [])):
            if label.upper() not in seen:
                seen.add(label.upper())
                kept.append(label)
        out[field] = kept
    return out
