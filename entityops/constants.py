"""Fixed values.

Everything in this module is data that must equal the published behaviour the engine matches:
word lists, lookup tables, weights, thresholds and identifier patterns.  No logic lives here.
"""

# --- fixed values: names ---------------------------------------------------------------------
LEGAL_SUFFIXES = [
    "private limited", "pvt ltd", "pvt. ltd.", "limited", "ltd", "llp", "inc", "corporation", "corp",
]

# --- fixed values: trust scoring -------------------------------------------------------------
FIELD_WEIGHTS = {
    "tradingName": 30, "tax": 25, "city": 15, "street": 15, "postalCode": 10, "country": 5, "phone": 5,
}
DEFAULT_FIELD_WEIGHT = 1
IDENTITY_FIELDS = ["tradingName", "city", "street", "postalCode"]
ISOLATED_FIELDS = ["tax", "country"]
TRUST_BANDS = [(85, "high"), (60, "medium")]
TRUST_STATUS = [(85, "match"), (50, "partial")]
BLEND_STATUS = [(85, "match"), (60, "partial")]

# --- fixed values: address reconciliation ----------------------------------------------------
ADDRESS_WEIGHTS = {
    "postalCode": 0.25, "cityName": 0.2, "district": 0.15, "streetName": 0.2, "buildingName": 0.1,
}
ROLE_BONUS = {
    "operational": 0.15, "additional_pob": 0.1, "principal_pob": 0.05, "registered_office": 0.0, "plant": 0.0,
}

# --- fixed values: document authority, lower position wins ------------------------------------
LEGAL_NAME_AUTHORITY = [
    "IN_CERTIFICATE_OF_INCORPORATION", "IN_GST_CERTIFICATE", "IN_DEED_OF_PARTNERSHIP",
]
TRADING_NAME_AUTHORITY = [
    "IN_GST_CERTIFICATE", "IN_PAN_CARD", "IN_CERTIFICATE_OF_INCORPORATION", "IN_ADDRESS_PROOF",
]
ADDRESS_AUTHORITY = ["IN_ADDRESS_PROOF", "IN_GST_CERTIFICATE", "IN_CERTIFICATE_OF_INCORPORATION"]
AUTHORITY_UNLISTED = 40
AUTHORITY_OTHER_FIELD = 50

# --- fixed values: rule vocabulary -----------------------------------------------------------
BASE_OPERATORS = ["exists", "notExists", "equals", "notEquals", "in", "notIn"]
EXTRA_OPERATORS = [
    "eqIgnoreCase", "gt", "gte", "lt", "lte", "isBlank", "isNotBlank", "startsWith", "endsWith",
    "contains", "matches", "lengthEq", "lengthGte", "lengthLte", "dateBefore", "dateAfter",
    "dateWithinDays",
]
RULE_TYPES = ["atLeastOne", "allOrNone", "mutuallyExclusive", "conditional"]
ACTION_TYPES = ["makeRequired", "makeOptional", "makeApplicable", "makeRequiredOneOf"]

# --- fixed values: identifier patterns -------------------------------------------------------
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
GSTIN_SHAPES = (
    r"^(?:[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z].{3}"
    r"|[0-9]{2}[A-Z]{4}[0-9]{5}[A-Z][0-9][A-Z]{2}"
    r"|[0-9]{4}[A-Z]{3}[0-9]{5}[A-Z]{2}[0-9]"
    r"|[0-9]{4}[A-Z]{3}[0-9]{5}[A-Z]{3})$"
)
GSTIN_STRICT = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
GSTIN_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
IFSC = r"^[A-Z]{4}0[A-Z0-9]{6}$"
PIN = r"^[0-9]{6}$"
UDYAM = r"^UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}$"
CIN = r"^[LUu][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"
IBAN_SHAPE = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
BIC = r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"
EMAIL = r"^[a-zA-Z0-9+_.-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_E164 = r"^\+[1-9][0-9]{6,14}$"
USCC = r"^[1-9][0-9A-Z]{17}$"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28]
AE_TRN = r"^100[0-9]{12}$"
US_EIN = r"^[1-9][0-9]{8}$"
GB_VAT = r"^GB([0-9]{9}|[0-9]{12}|GD[0-9]{3}|HA[0-9]{3})$"
GB_CRN = r"^([0-9]{8}|[A-Z]{2}[0-9]{6})$"
NATIONAL_ID_12 = r"\b[0-9]{4}\s+[0-9]{4}\s+[0-9]{4}\b"
GB_POSTCODE = r"(?i)^[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}$"
ID_LIKE_TOKEN = r"\b([A-Z]{5}[0-9]{4}[A-Z]|[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"
CITY_NAME = r"^[a-zA-Z.,'&()/\- ]{2,50}$"

# --- fixed values: tax state code to region, holder type by fourth letter ---------------------
STATE_REGION = {
    "01": "JK", "02": "HP", "03": "PB", "04": "CH", "05": "UT", "06": "HR", "07": "DL", "08": "RJ",
    "09": "UP", "10": "BR", "11": "SK", "12": "AR", "13": "NL", "14": "MN", "15": "MZ", "16": "TR",
    "17": "ML", "18": "AS", "19": "WB", "20": "JH", "21": "OR", "22": "CT", "23": "MP", "24": "GJ",
    "25": "DD", "26": "DN", "27": "MH", "28": "AP", "29": "KA", "30": "GA", "31": "LD", "32": "KL",
    "33": "TN", "34": "PY", "35": "AN", "36": "TG", "37": "AD", "38": "LA", "97": "OT",
}
HOLDER_TYPE = {
    "P": "individual", "C": "company", "H": "huf", "F": "firm", "A": "aop", "T": "trust",
    "B": "body_of_individuals", "L": "local_authority", "J": "artificial_juridical_person",
    "G": "government",
}

# --- fixed values: advisory field patterns ---------------------------------------------------
_FREE_TEXT = r"[a-zA-Z0-9.,:;$%&+\]\[*\"( )'\/^\-]"
FIELD_PATTERNS = {
    "tradingName": "^" + _FREE_TEXT + "{3,128}$",
    "streetName": "^" + _FREE_TEXT + "{0,256}$",
    "streetNumber": "^" + _FREE_TEXT + "{0,20}$",
    "buildingName": "^" + _FREE_TEXT + "{0,36}$",
    "district": "^" + _FREE_TEXT + "{0,36}$",
    "cityCode": r"^[a-zA-Z0-9&./]{1,13}$",
    "regionCode": r"^[a-zA-Z0-9 ]{1,15}$",
    "postalCode": r"^[0-9]{6}$",
    "TAXNO3": r"^[A-Z]{5}[0-9]{4}[A-Z]{1}$|^ZZ$",
    "TAXNO4": (
        r"^[0-9]{2}[a-zA-Z]{5}[0-9]{4}[a-zA-Z]{1}.{3}$"
        r"|^[0-9]{2}[A-Za-z]{4}[0-9]{5}[A-Za-z][0-9][A-Za-z]{2}$"
        r"|^[0-9]{4}[a-zA-Z]{3}[0-9]{5}[a-zA-Z]{2}[0-9]$"
        r"|^[0-9]{4}[A-Za-z]{3}[0-9]{5}[A-Za-z]{3}$"
    ),
    "TEL": r"^[1-9]{1}[0-9]{9}$",
    "MOB": r"^[1-9]{1}[0-9]{9}$",
    "emailAddress": r"^[a-zA-Z0-9+_.-]+@[a-zA-Z0-9.-]+$",
    "industryClassificationCode": r"^[A-Z0-9]{1,4}$",
}
NOT_APPLICABLE_FIELDS = [
    "TAXNO1", "taxDeclarationTypeCode", "taxDeclarationRegimeCode", "taxJurisdictionCode",
    "internationalCharacterSetCode", "ibanNumber", "bankAccountControlKeyNumber",
]
WRITABLE_DOC_TYPES = [
    "IN_PAN_CARD", "IN_GST_CERTIFICATE", "IN_CANCELLED_CHEQUE", "CN_BUSINESS_LICENSE",
    "CN_BANK_ACCOUNT_PERMIT", "AE_TRADE_LICENSE", "AE_VAT_CERTIFICATE", "US_W9", "US_VOIDED_CHECK",
    "US_CERTIFICATE_OF_GOOD_STANDING", "GB_COMPANIES_HOUSE_CERTIFICATE", "GB_VAT_CERTIFICATE",
]
PRE_SELECT_CONFIDENCE = 0.80
AUTO_APPLY_THRESHOLD = 0.85
STAGE_RESOLVED_THRESHOLD = 0.85

# --- fixed values: locale profiles (country: dual record, script, charset code, charset name) --
LOCALE_PROFILES = {
    "CN": (True, "zh", "C", "Chinese"),
    "AE": (True, "ar", "A", "Arabic"),
    "US": (False, "en", None, None),
    "GB": (False, "en", None, None),
}

# --- fixed values: display -------------------------------------------------------------------
EMPTY_DISPLAY = "—"
RESOLUTION_NOTE = {
    "cityCode": " (will resolve to city code)",
    "bankingInstitutionCode": " (will resolve via bank master)",
}

# --- fixed values: document type anchors, catalog order decides ties --------------------------
ANCHORS = {
    "IN_GST_CERTIFICATE": ["goods and services tax", "gstin", "registration certificate", "reg-06"],
    "IN_PAN_CARD": ["permanent account number", "income tax department", "आयकर", "sole proprietor"],
    "IN_DEED_OF_PARTNERSHIP": ["deed of partnership", "partnership deed", "llp agreement", "limited liability partnership"],
    "IN_MTO_IATA_CHA_CERTIFICATE": [
        "multimodal transport operator", "mto licence", "mto certificate", "customs house agent", "cha certificate",
    ],
    "IN_IEC_CERTIFICATE": ["importer exporter code", "iec certificate", "directorate general of foreign trade", "dgft"],
    "IN_ADDRESS_PROOF": ["address proof", "utility bill", "electricity bill", "rent agreement"],
    "IN_CANCELLED_CHEQUE": ["ifsc", "cancelled", "a/c no", "account number", "micr"],
    "IN_UDYAM_CERTIFICATE": ["udyam", "msme", "ministry of micro"],
    "IN_CERTIFICATE_OF_INCORPORATION": ["certificate of incorporation", "corporate identity number", "cin"],
}
LOCALE_ANCHORS = {
    "CN": {
        "CN_BUSINESS_LICENSE": ["营业执照", "统一社会信用代码", "business license", "uscc", "法定代表人"],
        "CN_BANK_ACCOUNT_PERMIT": ["开户许可证", "bank account permit", "基本存款账户"],
    },
    "AE": {
        "AE_TRADE_LICENSE": ["trade licence", "trade license", "economic department", "رخصة", "تجارية"],
        "AE_VAT_CERTIFICATE": ["tax registration", "trn", "vat certificate", "الرقم الضريبي"],
    },
    "US": {
        "US_W9": ["form w-9", "w-9", "employer identification", "request for taxpayer"],
        "US_VOIDED_CHECK": ["routing number", "account number", "void", "check"],
        "US_CERTIFICATE_OF_GOOD_STANDING": ["certificate of good standing", "secretary of state"],
    },
    "GB": {
        "GB_COMPANIES_HOUSE_CERTIFICATE": ["companies house", "certificate of incorporation", "company number"],
        "GB_VAT_CERTIFICATE": ["vat registration", "hm revenue", "vat certificate"],
    },
}
FILENAME_HINTS = {
    "IN_PAN_CARD": ["pan_card", "pan_aadhaar", "business_pan", "sole_proprietor"],
    "IN_GST_CERTIFICATE": ["gst_certificate", "gst_cert"],
    "IN_ADDRESS_PROOF": ["address_proof"],
    "IN_MTO_IATA_CHA_CERTIFICATE": ["mto_iata", "iata_cha", "cha_certificate"],
    "IN_IEC_CERTIFICATE": ["importer_exporter", "iec_certificate"],
    "IN_CERTIFICATE_OF_INCORPORATION": ["certificate_of_incorporation"],
    "IN_DEED_OF_PARTNERSHIP": ["deed_of_partnership", "partnership_deed"],
    "IN_CANCELLED_CHEQUE": ["cancelled_cheque", "bank_cheque"],
    "IN_UDYAM_CERTIFICATE": ["udyam"],
}
LOCALE_FILENAME_HINTS = {
    "CN": {
        "CN_BUSINESS_LICENSE": ["business_license", "yingye_zhizhao", "uscc"],
        "CN_BANK_ACCOUNT_PERMIT": ["bank_permit", "kaihu"],
    },
    "AE": {
        "AE_TRADE_LICENSE": ["trade_license", "trade_licence"],
        "AE_VAT_CERTIFICATE": ["vat_certificate", "trn"],
    },
    "US": {
        "US_W9": ["w9", "w_9"],
        "US_VOIDED_CHECK": ["voided_check", "cancelled_check"],
        "US_CERTIFICATE_OF_GOOD_STANDING": ["good_standing"],
    },
    "GB": {
        "GB_COMPANIES_HOUSE_CERTIFICATE": ["companies_house", "certificate_of_incorporation"],
        "GB_VAT_CERTIFICATE": ["vat_certificate"],
    },
}
NATIONAL_ID_MARKERS = ["aadhaar", "uidai", "enrolment no", "unique identification authority"]
PAN_MARKERS = ["permanent account number", "income tax department"]

# --- fixed values: query intent vocabulary ---------------------------------------------------
COUNTRY_ALIASES = {
    "india": "IN", "indonesia": "ID", "brazil": "BR", "germany": "DE", "france": "FR", "italy": "IT",
    "spain": "ES", "china": "CN", "denmark": "DK", "sweden": "SE", "norway": "NO", "poland": "PL",
    "romania": "RO", "czech": "CZ", "czechia": "CZ", "slovakia": "SK", "switzerland": "CH",
    "netherlands": "NL", "belgium": "BE", "usa": "US", "united states": "US", "mexico": "MX",
    "thailand": "TH", "singapore": "SG", "malaysia": "MY", "australia": "AU", "canada": "CA",
    "portugal": "PT", "austria": "AT", "hungary": "HU", "finland": "FI", "ireland": "IE",
    "south africa": "ZA", "turkey": "TR", "uae": "AE", "united arab emirates": "AE", "uk": "GB",
    "united kingdom": "GB",
}
CITY_ALIASES = {
    "mumbai": "Mumbai", "bombay": "Mumbai", "chennai": "Chennai", "madras": "Chennai",
    "delhi": "Delhi", "new delhi": "Delhi", "bengaluru": "Bengaluru", "bangalore": "Bengaluru",
    "pune": "Pune", "hyderabad": "Hyderabad", "kolkata": "Kolkata", "calcutta": "Kolkata",
    "prague": "Prague", "bucharest": "Bucharest", "bratislava": "Bratislava", "zurich": "Zurich",
    "sao": "Sao Paulo", "sao paulo": "Sao Paulo",
}
STATUS_WORDS = ["active", "inactive", "suspended", "pending", "rejected"]
WORKFLOW_PHRASES = [
    "in workflow", "workflow pending", "pending workflow", "under workflow", "awaiting approval",
    "approval pending",
]
DRAFT_PATTERNS = ["with draft", "has draft", "draft vendors?", "unpublished changes"]
STOP_WORDS = [
    "vendor", "vendors", "find", "search", "show", "get", "lookup", "named", "called", "with", "from",
    "in", "the", "and", "for", "all", "every", "any", "list", "present", "active", "inactive",
    "suspended", "pending", "rejected", "workflow", "workflows", "approval", "draft", "drafts", "tax",
    "id", "ids", "code", "codes",
]
KNOWN_ISO2 = [
    "IN", "BR", "CZ", "RO", "SK", "IT", "CH", "DE", "FR", "ES", "US", "GB", "NL", "BE", "PL", "CN",
    "DK", "SE", "NO", "ID",
]
ERP_CODE_PATTERNS = [
    r"\b(?:erp\s*)?(?:vendor\s*)?code\s*[:\s#-]*(\d{4,10})\b",
    r"\berp\s+(\d{4,10})\b",
    r"\bERP_VNDR_CD\s*[:\s#-]*(\d{4,10})\b",
]
BP_CODE_PATTERNS = [
    r"\b(?:sap\s*)?mdg\s*(?:bp\s*)?(?:vendor\s*)?(?:code\s*)?[:\s#-]*(\d{4,10})\b",
    r"\bsap\s+(\d{4,10})\s+code\b",
    r"\bsap\s+code\s+(\d{4,10})\b",
    r"\b(?:s4\s*)?bp\s*(?:vendor\s*)?code\s*[:\s#-]*(\d{4,10})\b",
    r"\bS4_BP_VNDR_CD\s*[:\s#-]*(\d{4,10})\b",
]
CODE_MARKERS = ["mdg", "bp", "sap", "erp"]
VENDOR_CODE = r"\b([A-Z]{2}\d{5,})\b"
TAX_TOKEN = r"\b(?=[A-Z0-9]*\d)[A-Z0-9]{8,}\b"
LIST_ALL = (
    r"\b(all|every|any|list)\b[\s\S]*\bvendors?\b|\bvendors?\b[\s\S]*\b(in|from|for)\b"
)
ERP_CODE_TYPE = "ERP_VNDR_CD"
BP_CODE_TYPE = "S4_BP_VNDR_CD"

# --- fixed values: usage reporting -----------------------------------------------------------
FEATURE_CATALOG = [
    ("doc_extract", ["extract.", "llm.complete_json"]),
    ("doc_corroboration", ["documents.entity_corroboration"]),
    ("nl_search", ["nl_search."]),
    ("company_search", ["company_search."]),
    ("onboard_chat", ["onboard.chat_plan"]),
    ("steward_assist", ["steward_assist."]),
    ("web_trust", ["evidence."]),
]
TEST_NAME_PREFIXES = ["pytest", "monitoring-test", "model-only-test"]
INPUT_USD_PER_MTOK = 2.0
OUTPUT_USD_PER_MTOK = 8.0
FEEDBACK_MIN_SAMPLES = 8
FEEDBACK_NEGATIVE_RATE = 0.4

# --- fixed values: redaction and uploads -----------------------------------------------------
BLOCKED_COLUMNS = [
    "value", "values", "snippet", "text", "ocr_text", "filename", "file_name", "patches", "raw",
]
SIGNATURES = [
    ("255044462D", "application/pdf"),
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("504B0304", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024

# --- fixed values: registry payload aliases, first non-blank wins -----------------------------
REGISTRY_ALIASES = {
    "status": ["gstStatus", "status", "sts", "Status"],
    "legal_name": ["legalName", "legal_name", "lgnm", "LegalName"],
    "trading_name": ["tradingName", "trade_name", "tradeNam", "TradeName"],
    "city": ["cityName", "loc", "city", "dst"],
    "postal_code": ["postalCode", "pincode", "pin"],
}
INACTIVE_STATUSES = ["cancelled", "canceled", "inactive", "suspended", "provisional"]
