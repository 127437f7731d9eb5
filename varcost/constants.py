"""Labels, thresholds and lists that results must carry exactly."""

# Data-quality thresholds.
MAX_NULL_RATE = 0.02
MIN_UNIQUENESS = 0.99
MIN_PRICE = 0.01
MAX_PRICE = 500_000.0

# Variance alert and severity bands, highest first.
ALERT_AT = 0.15
SEVERITY_BANDS = (("CRITICO", 0.30), ("ALTO", 0.15), ("MODERADO", 0.05))
SEVERITY_NONE = "NORMAL"

# Trend labels.
TREND_NEW = "NUEVO"
TREND_WORSE = "EMPEORA"
TREND_BETTER = "MEJORA"
TREND_SAME = "ESTABLE"

# Official regions and the label for every other one.
REGIONS = (
    "GBA NORTE", "GBA SUR", "GBA OESTE", "CABA", "INTERIOR", "PATAGONIA", "NOA", "NEA", "CUYO",
)
REGION_OTHER = "OTRAS"

# Defaults for missing catalogue attributes.
NO_LABORATORY = "SIN DATO"
NO_UNIT = "UN"

# Tax ids hold this many digits.
TAX_ID_DIGITS = 11

# Audit labels.
SOURCE_CATALOGUE = "nomenclador_nacional"
SOURCE_PROVIDERS = "listado_prestadores"
VERSION = "1.0.0"

# Calendar flags.
HIGH_SEASON_MONTHS = (1, 6, 7)
CLOSING_MONTHS = (3, 6, 9, 12)

# Fixed value: providers kept per month in the top report.
TOP_PROVIDERS = 20

# Surrogate key of the "no such dimension row" member.
UNKNOWN_KEY = "UNKNOWN"
