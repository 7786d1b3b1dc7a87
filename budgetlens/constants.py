"""Fixed values that must equal the reference study's choices for equal results.

Fixed values: thresholds, cut lists, seeds and factors, stated as in the study.
"""

# ---- fixed values -----------------------------------------------------------
TARGET_THRESHOLD = 0.20          # residual rate at or above which a unit is "on track"
THRESHOLD_SWEEP = [0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40]
ALT_THRESHOLDS = [0.10, 0.20, 0.30]
ZERO_INFLATED_RATE = 0.30        # a part is zero-inflated when zero in more than 30% of units
CORE_RATE = 0.20                 # a part is core when zero in fewer than 20% of units
ZERO_DELTA_FACTOR = 0.65         # multiplicative replacement: 0.65 x smallest positive
WINSOR_Q = 0.99
CONTACT_BUDGETS = [0.10, 0.25, 0.50]
CURVE_POINTS = 60                # capture curve over linspace(0.01, 1, 60)
CALIBRATION_BINS = 10
TARGET_RECALLS = [0.80, 0.90, 0.95]
HIST_BINS = 60
TOP_CONTRIBUTIONS = 5
TOP_PAIRS = 8
SEED = 42
N_FOLDS = 5
HOLDOUT_FRACTION = 0.20
SILHOUETTE_SAMPLE = 5000
ROW_SAMPLE = 1000                # the stand-in has 1,500 units, so the sample is a real one
ISOMETRY_PAIRS = 400
PEER_SCALE = 1e7                 # aggregate excess is reported in units of 1e7
IMPLAUSIBLE_RATE = -1.0          # spends more than twice the income
DESCRIBE_PCTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
TAIL_PCTS = [0.5, 0.9, 0.95, 0.99, 0.999]
GAP_PCTS = [0.25, 0.5, 0.75, 0.9]
KMEANS_K = list(range(2, 9))
# plausibility checks: (name, column, operator, value)
PLAUSIBILITY_CHECKS = [
    ("negative_residual", "residual", "<", 0.0),
    ("rate_below_minus_1", "rate", "<", -1.0),
    ("rate_below_minus_5", "rate", "<", -5.0),
    ("zero_rent", "rent", "=", 0.0),
    ("zero_education", "education", "=", 0.0),
    ("zero_insurance", "insurance", "=", 0.0),
    ("size_below_2", "size", "<", 2.0),
    ("debt_above_10x_income", "debt_to_income", ">", 10.0),
]
# ------------------------------------------------------------------------------
