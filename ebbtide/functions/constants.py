"""Fixed values that must equal the reference's for identical results.

FIXED VALUES -- do not edit; these are the published parameters of the
reference analysis (column lists, maps, tokens, thresholds, weights).
"""

from __future__ import annotations

# --- FIXED VALUES (begin) ----------------------------------------------------

EPS = 1e-6
RANDOM_SEED = 42

NULL_TOKENS = ("NULL", "null", "NaN", "missing", "-")

DROP_COLS = (
    "datovr_Mean", "recv_sms_Mean", "unan_dat_Mean", "callfwdv_Mean",
    "mou_pead_Mean", "drop_dat_Mean", "totmou", "totcalls", "mou_opkd_Mean",
    "avg6qty", "drop_blk_Mean", "attempt_Mean", "complete_Mean",
    "ccrndmou_Mean", "mouowylisv_Mean", "mouiwylisv_Mean", "mou_rvce_Mean",
    "threeway_Mean", "da_Mean", "adjmou", "adjqty", "blck_dat_Mean",
    "totrev", "adjrev", "truck", "rv", "income", "numbcars", "forgntvl",
    "Customer_ID", "new_cell", "dwllsize", "kid3_5", "kid6_10",
    "kid11_15", "kid16_17",
)

RATIO_KEYWORDS = (
    "_rate", "_ratio", "_share", "_momentum", "_stability",
    "per_minute", "per_sub", "per_call", "ltv",
)

BINARY_MAPS = {
    "asl_flag": {"Y": 1, "N": 0},
    "creditcd": {"Y": 1, "N": 0},
    "ownrent": {"R": 0, "U": 0, "O": 1},
    "dualband": {"Y": 1, "N": 0, " ": 0},
}

HIGH_CARD_CATS = (
    "prizm_social_one", "area", "crclscod", "marital",
    "dwlltype", "refurb_new", "hnd_webcap",
)

# numeric columns used for box plots / t-tests / log histograms / correlation
BOX_FEATURES = (
    "rev_Mean", "mou_Mean", "totmrc_Mean", "da_Mean",
    "ovrmou_Mean", "ovrrev_Mean", "vceovr_Mean", "roam_Mean",
    "change_mou", "months", "totcalls", "eqpdays",
)
KEY_NUMERIC = (
    "rev_Mean", "mou_Mean", "totmrc_Mean", "da_Mean", "ovrmou_Mean", "ovrrev_Mean",
    "vceovr_Mean", "roam_Mean", "change_mou", "months", "eqpdays", "recchu_Mean",
    "adjrev", "adjmou", "monthsit_Mean", "drop_dat_Mean",
)
TTEST_FEATURES = (
    "rev_Mean", "mou_Mean", "totmrc_Mean", "da_Mean", "ovrmou_Mean", "ovrrev_Mean",
    "vceovr_Mean", "roam_Mean", "change_mou", "months", "eqpdays",
)
EXPLORER_FEATURES = (
    "rev_Mean", "mou_Mean", "months", "eqpdays", "change_mou",
    "change_rev", "custcare_Mean", "ovrmou_Mean", "roam_Mean", "actvsubs",
)

# risk tiers on the positive-class probability
RISK_HIGH = 0.70
RISK_MEDIUM = 0.40
RISK_LABELS = ("High Risk", "Medium Risk", "Low Risk")

# device age tiers: right-closed bins (-inf,180], (180,365], (365,730], (730,inf)
TIER_EDGES = (180, 365, 730)

# change flags
DECLINE_CUTOFF = -5

# composite model score
COMPOSITE_WEIGHTS = {"roc_auc": 0.35, "pr_auc": 0.25, "f1": 0.20, "recall": 0.15, "brier": 0.05}

# smoothing of the target encoder
TARGET_SMOOTHING = 20

# --- FIXED VALUES (end) ------------------------------------------------------
