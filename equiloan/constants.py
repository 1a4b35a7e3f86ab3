"""Fixed values of the fair-lending workflow.

Everything in this module is a value that must equal the workflow being
rebuilt for the results to be right (column lists, codes, thresholds, seeds,
the energy constant). Column names are given in the sanitised form used
throughout the package: ``-`` becomes ``_`` and a trailing ``.0`` of a code is
dropped (see ``equiloan.functions.columns.sanitize_name``); the denial-reason
indicator list keeps the source's spelling and is sanitised where it is used.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

# The six predictors (order of the retained feature list).
PREDICTORS = [
    "loan_amount",
    "loan_to_value_ratio",
    "property_value",
    "income",
    "debt_to_income_ratio",
    "loan_term",
]

# Tract minority-share thresholds that define the protected attributes.
THRESHOLDS = [40, 50, 60, 70, 80, 90]

# action_taken codes kept, and the ones that count as approved.
VALID_ACTIONS = [1, 2, 3]
APPROVED_ACTIONS = [1, 2]

# Columns min-max scaled to 0..1 over all rows.
COLUMNS_TO_SCALE = [
    "loan_amount",
    "debt_to_income_ratio",
    "loan_to_value_ratio",
    "loan_term",
    "property_value",
    "total_units",
    "income",
    "credit_score",
    "tract_minority_population_percent",
]

# Columns one-hot encoded to <column>_<value> indicators.
COLUMNS_TO_ENCODE = [
    "derived_ethnicity", "derived_race", "derived_sex",
    "preapproval", "loan_type", "loan_purpose", "lien_status",
    "reverse_mortgage", "open_end_line_of_credit", "business_or_commercial_purpose",
    "negative_amortization", "interest_only_payment",
    "balloon_payment", "other_nonamortizing_features", "construction_method", "occupancy_type",
    "submission_of_application",
    "manufactured_home_secured_property_type",
    "applicant_ethnicity_1", "co_applicant_ethnicity_1", "applicant_ethnicity_observed",
    "co_applicant_ethnicity_observed", "applicant_race_1", "co_applicant_race_1", "applicant_race_observed",
    "co_applicant_race_observed", "applicant_sex", "co_applicant_sex", "applicant_sex_observed",
    "co_applicant_sex_observed", "applicant_age", "co_applicant_age", "applicant_age_above_62",
    "co_applicant_age_above_62",
    "aus_1", "aus_2", "aus_3", "aus_4", "aus_5",
    "denial_reason_1", "denial_reason_2", "denial_reason_3", "denial_reason_4",
]

# Exclusion / descriptive conditions: indicator <column>_<code> and the value
# whose rows are excluded (all eight are "== 1" in the workflow).
CONDITIONS = [
    ("loan_type", "1"),
    ("loan_purpose", "1"),
    ("lien_status", "1"),
    ("reverse_mortgage", "2"),
    ("open_end_line_of_credit", "2"),
    ("business_or_commercial_purpose", "2"),
    ("occupancy_type", "1"),
    ("submission_of_application", "1"),
]

# Columns dropped before modelling, when present (sanitised indicator names).
COLUMNS_TO_DROP = [
    "credit_score",
    "preapproval_1",
    "preapproval_2",
    "negative_amortization_1111",
    "negative_amortization_2",
    "interest_only_payment_1111",
    "interest_only_payment_2",
    "balloon_payment_1111",
    "balloon_payment_2",
    "other_nonamortizing_features_1111",
    "other_nonamortizing_features_2",
    "submission_of_application_1111",
    "submission_of_application_2",
    "submission_of_application_3",
    "total_units",
    "reverse_mortgage_1111",
    "open_end_line_of_credit_1111",
    "business_or_commercial_purpose_1",
    "business_or_commercial_purpose_1111",
    "construction_method_1",
    "occupancy_type_2",
    "occupancy_type_3",
    "manufactured_home_secured_property_type_1111",
    "manufactured_home_secured_property_type_3",
]

# Denial-reason indicator columns of the prepared table, as named there.
DENIAL_REASON_INDICATORS = [
    "denial_reason-1_1", "denial_reason-1_2", "denial_reason-1_3", "denial_reason-1_4", "denial_reason-1_5",
    "denial_reason-1_6", "denial_reason-1_7", "denial_reason-1_8", "denial_reason-1_9", "denial_reason-1_10",
    "denial_reason-1_1111", "denial_reason-2_1.0", "denial_reason-2_2.0", "denial_reason-2_3.0", "denial_reason-2_4.0",
    "denial_reason-2_5.0", "denial_reason-2_6.0", "denial_reason-2_7.0", "denial_reason-2_8.0", "denial_reason-2_9.0",
    "denial_reason-3_1.0", "denial_reason-3_2.0", "denial_reason-3_3.0", "denial_reason-3_4.0", "denial_reason-3_5.0",
    "denial_reason-3_6.0", "denial_reason-3_7.0", "denial_reason-3_8.0", "denial_reason-3_9.0", "denial_reason-4_1.0",
    "denial_reason-4_2.0", "denial_reason-4_3.0", "denial_reason-4_4.0", "denial_reason-4_5.0", "denial_reason-4_6.0",
    "denial_reason-4_7.0", "denial_reason-4_8.0", "denial_reason-4_9.0",
]


def _slot_codes(indicators: list[str]) -> dict[str, list[str]]:
    """'denial_reason-2_1.0' -> slot 'denial_reason_2', code '1' (sanitised)."""
    out: dict[str, list[str]] = {}
    for name in indicators:
        slot, code = name.rsplit("_", 1)
        code = code[:-2] if code.endswith(".0") else code
        out.setdefault(slot.replace("-", "_"), []).append(code)
    return out


# Denial reason slots and the codes each slot's indicators cover.
DENIAL_CODES = _slot_codes(DENIAL_REASON_INDICATORS)
DENIAL_SLOTS = list(DENIAL_CODES)
# Primary-reason classes: the ten indicators of slot 1.
PRIMARY_REASON_CODES = ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10"]

# Final denial reason cascade: approved -> 1; code 1 (debt-to-income) in any
# slot -> 2; code 4 (collateral) -> 3; code 5 (insufficient cash) -> 4; else 5.
DENIAL_CASCADE = [("1", 2), ("4", 3), ("5", 4)]
DENIAL_OTHER = 5
DENIAL_APPROVED = 1

# Seeds of the splits and forests.
SEED_FOREST = 11850
SEED_SPLIT = 42
TEST_FRACTION = 0.25
N_BINS = 10

# Energy: kWh = hours / 24 / 365 * 57754 / 1000.
ENERGY_WATT_YEAR = 57754.0

# Model sizes.
FOREST_TREES = 120
FOREST_TREES_TUNED = 100
FOREST_DEPTH = 10
FOREST_BINS = 16
LOGISTIC_MAX_ITER = 1000
TUNE_GRID = {"numTrees": [100, 200], "maxDepth": [10, 20], "minInstancesPerNode": [1, 2]}

# --- defaults of this rebuild (not fixed by the workflow) -------------------

# Year list of the descriptives and the single-year slice, mapped onto the
# years present in the driver's tables.
DESCRIBE_YEARS = [1997, 1998, 1999, 2000]
SLICE_YEAR = 1998

# Protected attribute columns: 1 = privileged (share below threshold).
ATTRIBUTES = [f"a{t}" for t in THRESHOLDS]

# Portable arithmetic hash used for repeatable splits.
HASH_MODULUS = 1000003
HASH_MULTIPLIER = 48271
HASH_QUOTIENT = 69621
