"""Values that scores, tiers and weights are made of."""

# Breakpoints and scores.
RSI_SCORES = ((20, 10), (25, 9), (30, 8), (35, 7), (40, 5.5), (45, 3.5), (50, 2))
BOLLINGER_SCORES = ((-0.1, 10), (0, 9), (0.10, 8), (0.20, 6.5), (0.35, 5), (0.65, 3), (0.80, 2))
ZSCORE_SCORES = ((-2.5, 10), (-2, 9), (-1.5, 7.5), (-1, 6), (-0.5, 4), (0, 2.5))
STOCHASTIC_SCORES = ((0.05, 10), (0.10, 9), (0.20, 8), (0.30, 6.5), (0.50, 4), (0.70, 2.5), (0.80, 1.5))
WILLIAMS_SCORES = ((-95, 10), (-90, 9), (-80, 8), (-70, 6.5), (-50, 4), (-30, 2.5), (-20, 1.5))
PCR_SCORES = ((3, 10), (2, 9), (1.5, 8), (1.2, 7), (1, 6), (0.7, 4), (0.5, 2.5))
CAP_TIERS = (("Small", 0, 15e9), ("Mid", 15e9, 50e9), ("Large", 50e9, 150e9), ("Very Large", 150e9, 500e9), ("Mega", 500e9, None))
WEIGHTS = {"s_rsi": 0.30, "s_bb": 0.20, "s_mr": 0.15, "s_pcr": 0.15, "s_stochrsi": 0.10, "s_williams": 0.10}
#: Levels around the price, in ATRs.
LEVELS = {"stop_loss": -1.5, "target_1": 2.0, "target_2": 4.0, "entry_low": -0.5, "entry_high": 0.3}
SETUPS = ((7.5, "Strong"), (6.0, "Watchlist"))  # least composite score; below: Monitor
SCORE_BUCKETS = ((0.0, 6.0), (6.0, 6.5), (6.5, 7.0), (7.0, 7.5), (7.5, 10.0))  # closed at the right
Z_BUCKETS = (-5.0, -2.5, -2.0, -1.5, -1.0, 0.0)
PCR_MIN_CALLS, PCR_MIN_TOTAL = 200, 500
OUT_OF_SAMPLE_START = "2025-08-01"
