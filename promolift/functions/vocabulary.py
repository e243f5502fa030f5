"""Codes, labels and bands that reports must carry literally.

They are data, not logic. Everything that compares against a campaign code
takes it from here.
"""

# --- fixed values: contact stages -------------------------------------------
ALLOCATED = "ALC"
DELIVERED = "DLV"
EXPOSED = "EXP"
ACTIVATED = "ACT"
REDEEMED = "RDM"

# Stages whose coupon value comes from the offer table, not from the event row.
OFFER_PRICED_STAGES = ("ALC", "DLV", "EXP")

# --- fixed values: labels in reports ----------------------------------------
NULL_KEY = "XX"
TOTAL_KEY = "total"
OVERALL = "overall"

# --- fixed values: flags ----------------------------------------------------
CONTROL_FLAG = "Y"
LESS_LOYAL_FLAG = "Y"

# --- fixed values: loyalty levels -------------------------------------------
INACTIVE_LOYALTY = ("GO", "LP")
TOP_LOYALTY = ("PR", "VL")

# --- fixed values: slot segments (name, first rank, last rank) --------------
MAIN_SLOTS = ("baulcm", 1, 8)
LESS_LOYAL_SLOTS = ("lessloyal", 1, 3)
COMMON_SLOTS = (
    ("baby", 9, 12),
    ("npm", 13, 20),
    ("extralcm", 21, 24),
    ("babyextra", 25, 28),
    ("nfm", 29, 32),
    ("additional", 33, 40),
)
OTHER_SLOTS = "others"

# --- fixed values: age bands (older than, name), oldest first ---------------
AGE_BANDS = (
    (66, "67 eller mer"),
    (55, "56-66"),
    (45, "46-55"),
    (35, "36-45"),
    (25, "26-35"),
    (0, "0-25"),
)
AGE_UNKNOWN = "Uklassifiserte"
TARGETING_DAY_OF_WEEK = "7"

# --- fixed values: customer universe ----------------------------------------
EXCLUDED_ID_BLOCKS = ("0000", "0181", "5020", "5027", "6066", "1166", "2345")
HOME_COUNTRY = "NO"
NOT_DECEASED = "00000000"
MEMBER_PREFIX = "0"
NULL_TEXT_ID = "null"

# --- fixed values: private-label words --------------------------------------
PRIVATE_LABEL_WORDS = ("X-TRA", "NGLAMARK", "MARKET")
PRIVATE = "private"
NON_PRIVATE = "non-private"

# --- fixed values: uplift ----------------------------------------------------
TEST_ARM = 1
CONTROL_ARM = 0
SIGNIFICANT_Z = 1.959964  # two-sided 0.95
DIRECTIONAL_Z = 1.281552  # two-sided 0.80
