"""Domain constants shared by every operator.

The blocks below are fixed values: results are only right when they equal the
published planning rules, so they are stated literally and kept together.
"""

from __future__ import annotations

# --- fixed values: geodesy -------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_320.0
ARCSEC_PER_DEGREE = 3600.0
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]

# --- fixed values: difficulty classes --------------------------------------
DIFFICULTIES = ["green", "blue", "red", "black"]
DIFFICULTY_FLOOR_PCT = {"green": 0.0, "blue": 15.0, "red": 25.0, "black": 40.0}
MIN_SKIABLE_PCT = 5.0
MAX_SKIABLE_PCT = 70.0
GRADE_TARGETS = [
    # ord, difficulty, grade, target slope %
    (0, "green", "gentle", 7.0),
    (1, "green", "steep", 12.0),
    (2, "blue", "gentle", 17.0),
    (3, "blue", "steep", 22.0),
    (4, "red", "gentle", 28.0),
    (5, "red", "steep", 37.0),
    (6, "black", "gentle", 45.0),
    (7, "black", "steep", 60.0),
]
ROLLING_WINDOW_M = 300.0

# --- fixed values: tracing -------------------------------------------------
STEP_M = 30.0
LENGTH_MAX_M = 1000.0
MIN_TRAVERSE_DEG = 2.0
MAX_TRAVERSE_DEG = 89.0
MAX_CENTER_PATHS = 4
MIN_PATH_POINTS = 4
MAX_TURN_DEG = 40.0
BEARING_MEMORY = 4
FLAT_TERRAIN_PCT = 15.0
MOMENTUM_WEIGHT = 0.8
BASE_NOISE_DEG = 5.0
RINGS = [(15.0, 2.0), (30.0, 1.0)]  # radius m, weight
RING_BEARINGS = [0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]
SIDE_GRADIENT_MIN_PCT = 0.5
SIDE_FLAT_PCT = 2.0

# --- fixed values: earthworks ----------------------------------------------
EXCAVATOR_CUT_M = 2.5
BELT_WIDTH_M = {"green": (10.0, 25.0), "blue": (20.0, 35.0), "red": (25.0, 40.0), "black": (20.0, 35.0)}

# --- fixed values: connections and routing ---------------------------------
MIN_DROP_M = 5.0
GRID_STEP_M = 15.0
GRID_BUFFER = 0.5
GRID_MAX_CELLS = 100
COST_SIGMA = 8.0
MIN_EDGE_M = 0.1
SIMILARITY_DEG = 0.0001
RESAMPLE_M = 7.0
SMOOTHING = {"green": 4.0, "blue": 3.0, "red": 2.0, "black": 2.0}
NODE_SNAP_M = 30.0
CONNECTOR_SNAP_M = 80.0

# --- fixed values: lifts ---------------------------------------------------
LIFT_TYPES = ["surface_lift", "chairlift", "gondola", "aerial_tram"]
LIFT_SAMPLE_M = 30.0
PYLON_TABLE = {
    # pylon height, station height, min spacing, max spacing, min clearance, sag factor
    "surface_lift": (15.0, 5.0, 10.0, 100.0, 10.0, 0.05),
    "chairlift": (25.0, 6.0, 15.0, 200.0, 15.0, 0.06),
    "gondola": (35.0, 6.0, 20.0, 300.0, 20.0, 0.06),
    "aerial_tram": (60.0, 10.0, 30.0, 1e6, 30.0, 0.06),
}
SPACING_ROUNDS = 20

# --- fixed values: styling -------------------------------------------------
SLOPE_COLORS = {"green": "#22C55E", "blue": "#3B82F6", "red": "#EF4444", "black": "#1F2937"}
SLOPE_RGBA = {
    "green": [34, 197, 94, 200],
    "blue": [59, 130, 246, 200],
    "red": [239, 68, 68, 200],
    "black": [31, 41, 55, 255],
}
DIFFICULTY_EMOJI = {"green": "🟢", "blue": "🔵", "red": "🔴", "black": "⚫"}
LIFT_COLORS = {"surface_lift": "#D8B4FE", "chairlift": "#A855F7", "gondola": "#6B21A8", "aerial_tram": "#7C3AED"}
LIFT_RGBA = {
    "surface_lift": [216, 180, 254, 200],
    "chairlift": [168, 85, 247, 200],
    "gondola": [107, 33, 168, 200],
    "aerial_tram": [124, 58, 237, 200],
}
LIFT_ICONS = {"surface_lift": "🎿", "chairlift": "🪑", "gondola": "🚡", "aerial_tram": "🚠"}
LIFT_DISPLAY = {
    "surface_lift": "Surface Lift",
    "chairlift": "Chairlift",
    "gondola": "Gondola",
    "aerial_tram": "Aerial Tram",
}
NODE_PYLON_RGBA = [107, 114, 128, 230]
ENDPOINT_RGBA = [249, 115, 22, 230]
START_MARKER_RGBA = [255, 255, 255, 200]

# --- fixed values: names ---------------------------------------------------
SLOPE_PREFIXES = {
    "green": ["Gentle", "Easy", "Nursery", "Bunny", "Beginner's", "Soft"],
    "blue": ["Cruiser", "Scenic", "Alpine", "Mountain", "Valley", "Classic"],
    "red": ["Bold", "Thunder", "Steep", "Expert's", "Challenge", "Pro"],
    "black": ["Extreme", "Death", "Kamikaze", "Insane", "Devil's", "Daredevil"],
}
SLOPE_SUFFIXES = [
    "Run", "Trail", "Slope", "Descent", "Pass", "Chute", "Face", "Bowl",
    "Gully", "Ridge", "Drop", "Way", "Line", "Route", "Pitch", "Section",
]
LIFT_PREFIXES = {
    "surface_lift": ["Bunny", "Beginner's", "Practice", "Easy", "Learner's", "First"],
    "chairlift": ["Alpine", "Mountain", "Scenic", "Valley", "Ridge", "Summit"],
    "gondola": ["Panorama", "Vista", "Sky", "Peak", "Grand", "Majestic"],
    "aerial_tram": ["Eagle", "Falcon", "Summit", "Peak", "Apex", "Pinnacle"],
}
LIFT_SUFFIXES = {
    "surface_lift": ["Tow", "Lift", "Pull", "Rope", "Drag", "Line"],
    "chairlift": ["Chair", "Lift", "Express", "Quad", "Six", "Flyer"],
    "gondola": ["Gondola", "Cabin", "Tram", "Link", "Connect", "Cruiser"],
    "aerial_tram": ["Tram", "Cable Car", "Aerial", "Skyway", "Tramway", "Rise"],
}
LENGTH_WORDS = {"short": ["Little", "Mini", "Short"], "long": ["Grand", "Big", "Giant"]}
SHORT_LIFT_M = 500.0
LONG_LIFT_M = 1500.0
SUMMIT_M = 500.0
BIG_DROP_M = 300.0

# --- fixed values: ids, clicks, history ------------------------------------
ID_PREFIX = {"node": "N", "segment": "S", "slope": "SL", "lift": "L"}
UNDO_DEPTH = 50
DEBOUNCE_MS = 150
KEY_DECIMALS = 6
DOCUMENT_VERSION = "2.0"
GPX_NAMESPACE = "http://www.topografix.com/GPX/1/1"
GPX_CREATOR = "terrapath"
ALPS_BOX = (4.5, 42.75, 17.0, 48.5)  # west, south, east, north

# Workflow transitions: state, event, guard on committed segments, next state.
# guard: any = no condition, none = only without segments, some = only with segments.
TRANSITIONS = [
    ("IdleReady", "start_slope", "any", "SlopeStarting"),
    ("IdleReady", "start_lift", "any", "LiftPlacing"),
    ("IdleReady", "view_slope", "any", "IdleViewingSlope"),
    ("IdleReady", "view_lift", "any", "IdleViewingLift"),
    ("IdleViewingSlope", "close_panel", "any", "IdleReady"),
    ("IdleViewingSlope", "view_slope", "any", "IdleViewingSlope"),
    ("IdleViewingSlope", "view_lift", "any", "IdleViewingLift"),
    ("IdleViewingSlope", "start_slope", "any", "SlopeStarting"),
    ("IdleViewingSlope", "start_lift", "any", "LiftPlacing"),
    ("IdleViewingLift", "close_panel", "any", "IdleReady"),
    ("IdleViewingLift", "view_slope", "any", "IdleViewingSlope"),
    ("IdleViewingLift", "view_lift", "any", "IdleViewingLift"),
    ("IdleViewingLift", "start_slope", "any", "SlopeStarting"),
    ("IdleViewingLift", "start_lift", "any", "LiftPlacing"),
    ("SlopeStarting", "commit_path", "any", "SlopeBuilding"),
    ("SlopeStarting", "cancel_slope", "any", "IdleReady"),
    ("SlopeStarting", "enable_custom", "any", "SlopeCustomPicking"),
    ("SlopeBuilding", "commit_path", "any", "SlopeBuilding"),
    ("SlopeBuilding", "finish_slope", "any", "IdleViewingSlope"),
    ("SlopeBuilding", "cancel_slope", "any", "IdleReady"),
    ("SlopeBuilding", "enable_custom", "any", "SlopeCustomPicking"),
    ("SlopeCustomPicking", "select_custom_target", "any", "SlopeCustomPath"),
    ("SlopeCustomPicking", "cancel_custom", "none", "SlopeStarting"),
    ("SlopeCustomPicking", "cancel_custom", "some", "SlopeBuilding"),
    ("SlopeCustomPicking", "cancel_slope", "any", "IdleReady"),
    ("SlopeCustomPath", "commit_custom_continue", "any", "SlopeBuilding"),
    ("SlopeCustomPath", "commit_custom_finish", "any", "IdleViewingSlope"),
    ("SlopeCustomPath", "cancel_custom", "none", "SlopeStarting"),
    ("SlopeCustomPath", "cancel_custom", "some", "SlopeBuilding"),
    ("SlopeCustomPath", "cancel_slope", "any", "IdleReady"),
    ("LiftPlacing", "complete_lift", "any", "IdleViewingLift"),
    ("LiftPlacing", "cancel_lift", "any", "IdleReady"),
]

# Clicks that a state refuses: state, target, action text, reason text.
CLICK_RULES = [
    ("SlopeBuilding", "terrain", "click terrain", 'Enable "Custom Connect" to select a target point.'),
    ("SlopeBuilding", "node", "click node", 'Enable "Custom Connect" to select a target point.'),
    ("SlopeBuilding", "slope", "view slope", "Finish or cancel the current slope first."),
    ("SlopeBuilding", "lift", "view lift", "Finish or cancel the current slope first."),
    ("SlopeBuilding", "pylon", "view lift", "Finish or cancel the current slope first."),
    ("SlopeBuilding", "segment", "view segment", "Finish or cancel the current slope first."),
    ("LiftPlacing", "slope", "view slope", "Finish placing the lift first (click uphill for top station)."),
    ("LiftPlacing", "segment", "view segment", "Finish placing the lift first (click uphill for top station)."),
    ("LiftPlacing", "lift", "view lift", "Finish placing the lift first (click uphill for top station)."),
    ("LiftPlacing", "pylon", "view lift", "Finish placing the lift first (click uphill for top station)."),
]
# --- end of fixed values ---------------------------------------------------

# Physical design (ours).
TILE = 64  # raster cells per tile side
CHUNK_ROWS = 4096  # rows of one ordered group handled by one window partition
FOLD_ROWS = 256  # rows of one ordered group folded inside one array
GROUP_ROWS = 512  # rows of one tile traced together in one task
