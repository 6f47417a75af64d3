"""Default settings, as one place to look them up. All are parameters of what uses them."""

# Ceilings on a revision
DEFAULTS = {"pages": 20, "page_elements": 3000, "elements": 20000, "element_chars": 20000, "chars": 2000000, "file_bytes": 104857600}
#: Weights of a pair's score; neighbor stays at 0 as nothing names neighbours.
WEIGHTS = {"identifier": 0.32, "text": 0.24, "spatial": 0.22, "type": 0.12, "neighbor": 0.0, "geometry": 0.10}
SPATIAL_RADIUS, CANDIDATE_RADII, MIN_MATCH_SCORE, MOVE_TOLERANCE = 0.12, 2.5, 0.42, 0.018
HIGH, MEDIUM = 0.78, 0.55
COMPATIBLE = 0.65
#: Comparisons that the elements of two pages would take without candidates, at most.
PAGE_WORK = 2_000_000
TOP_K, RRF_K, LISTED = 8, 60, 3
#: Lines and citations of an answer that lists changes.
ANSWER_LINES, ANSWER_CITED = 20, 10
EXACT_BOOST, PROXIMITY_WEIGHT, PROXIMITY_RADIUS = 0.5, 0.6, 0.18
WEAK_SUPPORT, WEAK_TOP = 0.18, 0.01
EXPLAINED_OVERLAP, PEER_IOU, MOST_RESIDUALS, EMITTED_RESIDUALS = 0.6, 0.15, 20, 6
