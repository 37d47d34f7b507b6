"""Fixed conventions shared by the operators."""

# Calendar and execution defaults.
TRADING_DAYS = 252
COMMISSION_BPS = 1.0
SLIPPAGE_BPS = 5.0
IMPACT_COEF = 0.10
BORROW_BPS_ANNUAL = 50.0
PARTICIPATION_CAP = 0.10
CONFIDENCE = 0.95
BOOTSTRAP_BLOCK = 21
BOOTSTRAP_REPLICATES = 1_000
INITIAL_CAPITAL = 1_000_000.0

# The named stress windows (both ends inclusive).
STRESS_WINDOWS = (
    ("GFC 2008", "2008-09-01", "2009-03-31"),
    ("COVID 2020", "2020-02-15", "2020-04-15"),
    ("Inflation 2022", "2022-01-01", "2022-10-31"),
)

# The default cross-asset ETF universe.
ETF_BASKET = (
    "SPY", "QQQ", "IWM", "DIA", "MDY",
    "EFA", "EEM", "EWJ", "FXI",
    "TLT", "IEF", "SHY", "LQD", "HYG", "TIP",
    "GLD", "SLV", "USO", "DBC", "UUP",
)
