"""Closed lists and thresholds of the audit. Results depend on them."""

# Fixed values.
STATUSES = ("ok", "refused", "unparseable", "timeout", "error")
SEVERITY = ("ok", "unparseable", "refused", "timeout", "error")
VARIANTS = ("P0", "P0a", "P0b", "P1", "P2", "P3", "P4", "P5", "P6", "P7")
CONFIDENCE_KINDS = ("logprob", "verbalized", "none")
PASSES = ("primary", "retest", "review")
DIFFICULTIES = ("easy", "medium", "hard")
SEED = 777
RESAMPLES = 10_000
REPLICATION_PP, DISAGREEMENT_PP, SPREAD_PP, SHIFT_PP = 2.0, 1.0, 5.0, 2.0
DOMAIN_BIAS_PP, RETEST_DAYS, DESIGN_EFFECT_LIMIT = 5.0, 7.0, 2.0
FLOOR, COVERAGE = 0.80, 0.70
BANDS = (0.99, 0.90)
BINS = 10
SAMPLE_SIZES = {
    "E10k-ego": 10_000, "E10k-ego4d": 10_000, "E10k-epic": 10_000, "S10k-U": 10_000, "S10k-S": 10_000, "E100k-ego": 10_000,
    "P2k": 2_000, "G200-ego": 200, "G200-ego4d": 200, "G200-epic": 200, "R100": 100,
}
