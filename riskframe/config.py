"""Column roles and fixed values of the scoring data model.

Nothing in the library is hard-wired to these names: every operator takes
column names as arguments and defaults to the roles below.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference model's definitions for equal results)
# ---------------------------------------------------------------------------
# generic "no product" sentinel, and the two per-column sentinels
SENTINEL = -9999998.0
X11_SENTINEL = -99000720.0
X12_SENTINEL = -99000792.0
# label used for a missing category
UNKNOWN_CATEGORY = "DESCONOCIDO"
# label of categories outside the top-N list
OTHER_CATEGORY = "OTROS"
# label of an out-of-range ordinal level
OTHER_LEVEL = "otro"
# bureau-score bucket edges (left-closed) and labels, in order
X7_EDGES = [0.0, 600.0, 700.0, 750.0, 800.0, 850.0, 1001.0]
X7_LABELS = ["X7_lt600", "X7_600_700", "X7_700_750", "X7_750_800", "X7_800_850", "X7_gt850"]
# ordinal category levels kept as their own dummy
X8_LEVELS = [1, 2, 3, 4, 5]
# PSI status thresholds and labels
PSI_WARN = 0.10
PSI_ALERT = 0.25
PSI_OK_LABEL = "OK"
PSI_WARN_LABEL = "ADVERTENCIA"
PSI_ALERT_LABEL = "ALERTA"
PSI_RETRAIN_LABEL = "REENTRENAR"
# zero-share floor inside PSI
PSI_EPS = 1e-4
# score bands of the scoring form: below 5000 high risk, below 11000 moderate
BAND_HIGH_MAX = 5000.0
BAND_MODERATE_MAX = 11000.0
BAND_LABELS = ["ALTO", "MODERADO", "BAJO"]
# overfit diagnosis thresholds on the R2 gap
OVERFIT_STABLE = 0.03
OVERFIT_MILD = 0.08
# suffixes of derived flag columns
SENTINEL_FLAG_SUFFIX = "_sin_registro"
NULL_FLAG_SUFFIX = "_sin_dato"

# ---------------------------------------------------------------------------
# Column roles of the applicants table (lower-case names on Spark)
# ---------------------------------------------------------------------------
ID = "id"
SPLIT = "base"
TARGET = "target"
TRAIN = "TRAIN"
TEST = "TEST"
NUMERIC = ["x1", "x2", "x3", "x4", "x5", "x6", "x7", "x8", "x10", "x11", "x12"]
CATEGORICAL = ["x9"]
# column -> sentinel that marks "no record" (flagged, then nulled)
SENTINEL_COLS = {"x3": SENTINEL, "x4": SENTINEL, "x11": X11_SENTINEL, "x12": X12_SENTINEL}
# columns whose real nulls carry information (flagged)
NULL_FLAG_COLS = ["x1", "x2", "x5", "x7"]
# right-skewed amounts that get a log1p feature
LOG_COLS = ["x1", "x2", "x3", "x4", "x5", "x10"]
