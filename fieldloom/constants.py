"""Fixed values of the parcel domain. Each Earth model stays with the operators that use it."""

# Earth models, in metres.
EARTH_RADIUS_M = 6_371_000.0
MERCATOR_RADIUS_M = 6_378_137.0
MERCATOR_MAX_LAT = 85.05112878
M_PER_DEG = 111_320.0
M_PER_DEG_LAT_HA = 111_132.0
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LNG = 111.32
PIXEL_M_AT_ZOOM_0 = 156_543.03392

# Zones, sizes and limits.
COVERAGE_BBOX = (46.9, -20.1, 47.2, -19.7)
MAX_RADIUS_M = 20_000.0
PARCEL_MAX_HA = 2.0
MIN_COVER_RATIO = 0.35
BLOCK_COVERED = 0.5
MAX_FEATURES = 6_000
MAX_CANDIDATES = 48
MAX_CELLS = 36
MAX_TO_CLASSIFY = 20
CENTER_DUPLICATE_KM = 0.005
CENTER_DUPLICATE_M = 15.0
MIN_KNOWN_COVERAGE = 0.6
MIN_CANDIDATE_M2, MAX_CANDIDATE_M2 = 1_000.0, 800_000.0
MIN_COMPACTNESS, MIN_HULL_RATIO, MAX_ASPECT = 0.35, 0.8, 12.0
SIZE_CLASSES = (("< 0,1 ha", 0.0, 0.1), ("0,1-0,5 ha", 0.1, 0.5), ("0,5-1 ha", 0.5, 1.0), ("> 1 ha", 1.0, float("inf")))
NDVI_ZONES = (("high", 0.75, 1.01), ("mid", 0.35, 0.75), ("low", -1.0, 0.35))
PROTECTED_SOURCE = "Tracé automatique corrigé"
NO_CROP = "(non predit)"
ZONING_SCALE_M, ZONING_MAX_PX = 10.0, 400
BARRIER = 1_000_000.0

# Thresholds of the barley classifiers.
RF_THRESHOLD, RF_REJECT, RF_ACCEPT, RF_MAX_OCT_NDVI, RF_MAX_PEAK_DOY = 0.3268, 0.15, 0.70, 0.50, 245.0
GREEN_NDVI = 0.35
LOGISTIC = {"features": ["ndvi"], "mean": [60.5], "std": [9.2408], "coef": [1.37939], "intercept": 0.10256, "threshold": 0.5}
MIN_CNN_CONFIDENCE = 70.0
