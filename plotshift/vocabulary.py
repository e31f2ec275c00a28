"""Fixed values of the land-use change task: names and codes that results must agree on."""

# Class code of every change type.
CHANGE_TYPES = {
    "Demolition": 0,
    "Road": 1,
    "Residential": 2,
    "Commercial": 3,
    "Industrial": 4,
    "Mega Projects": 5,
}

BANDS = ("red", "green", "blue")
INDEXES = ("NDVI", "SAVI", "NDBI", "NDWI")
DATE_COLUMNS = tuple(f"date{i}" for i in range(5))
STATUS_COLUMNS = tuple(f"change_status_date{i}" for i in range(5))

# Number of rows a complete submission must have.
TEST_ROWS = 120526
FOLDS = 5
SEED = 42

# Small constant that keeps ratios finite.
EPS = 1e-9

# Sphere radius of the spherical Mercator projection, metres.
MERCATOR_RADIUS = 6378137.0

GEOMETRY_TYPE = (
    "array<struct<hole:boolean,pts:array<struct<x:double,y:double>>>>"
)
