"""Fixed values.  Results depend on them, so they are stated as plain text here."""

# Activity scale.
ACTIVE_FROM = 6.0
ACTIVITY_LOW = 2.0
ACTIVITY_HIGH = 12.0

# Replicate noise.
HIGH_VARIANCE_STD = 0.50
LABEL_NOISE_STD = 0.70
STD_EPSILON = 0.10
MAD_FACTOR = 1.4826
IQR_FACTOR = 1.5
ZSCORE_CUT = 2.5

# Screening data.
SCREEN_NOISE_FLOOR = 1.0
SCREEN_MIN_INFORMATIVE = 5.0
SCREEN_ACTIVE_FROM = 30.0
FREQUENT_HITTER_RATE = 0.40
PROMISCUOUS_RATE = 0.30
INACTIVE_PER_ACTIVE = 10

# Groups.
FREQUENT_GROUP_FROM = 10
GROUP_WEIGHT_CAP = 15
GROUP_WEIGHT_DECAY = 0.5

# Fidelity weights.
FIDELITY_WEIGHTS = {
    "T1_high": 1.0,
    "T1_confirmed": 0.9,
    "T1_standard": 0.8,
    "T2_censored": 0.5,
    "T3_weak": 0.3,
}

# Unit spellings to nanomolar factors, in match order.
UNIT_FACTORS = {
    "nm": 1.0, "nanomolar": 1.0, "nano molar": 1.0,
    "um": 1e3, "µm": 1e3, "micromolar": 1e3, "micro molar": 1e3, "μm": 1e3,
    "mm": 1e6, "millimolar": 1e6,
    "m": 1e9, "molar": 1e9,
    "pm": 1e-3, "picomolar": 1e-3, "pico molar": 1e-3,
}
UNIT_CONFIDENCE = {
    "nm": 1.00, "nanomolar": 1.00,
    "um": 0.95, "µm": 0.95, "micromolar": 0.95, "μm": 0.95,
    "mm": 0.90, "millimolar": 0.90,
    "m": 0.85, "molar": 0.85,
    "pm": 0.90, "picomolar": 0.90,
    "inferred_nm": 0.60,
    "unknown": 0.30,
}
UNIT_CONFIDENCE_DEFAULT = 0.80

# Reliability per source database.
SOURCE_RELIABILITY = {"BindingDB": 1.00, "ChEMBL": 0.90, "PubChem": 0.60}
SOURCE_RELIABILITY_DEFAULT = 0.60

# Assay confidence and context rules.
ASSAY_CONFIDENCE = {
    "biochemical_confirmatory": 1.00, "biochemical_single_point": 0.80,
    "binding": 0.75, "confirmatory": 1.00, "panel": 0.60,
    "HTS": 0.30, "hts_percent_inhibition": 0.30, "unknown": 0.50,
}
CONTEXT_DELTAS = {
    "has_dose_response": 0.30, "has_doi": 0.20, "has_pmid": 0.10,
    "is_biochemical": 0.15, "is_cell_based": 0.05,
    "is_hts_penalty": -0.30, "is_rnai": -0.40, "is_non_human": -0.05,
}
CONFIRMATORY_WORDS = ["confirmatory", "confirm", "dose"]
BIOCHEMICAL_WORDS = ["biochem", "enzyme", "recombinant", "purified"]
CELL_WORDS = ["cell", "cellular", "lysis", "transfect"]
RNAI_WORDS = ["rnai", "sirna", "shrna"]
TIME_DEPENDENCE_PATTERNS = [
    r"preincubat", r"time[\s\-]?depend", r"irreversib",
    r"covalent", r"jump[\s\-]?dilut", r"washout", r"kinact",
]

# Similarity, neighbours, applicability domain.
CLIFF_SIMILARITY = 0.80
CLIFF_DELTA = 1.5
CLIFF_SEVERITY = [("severe", 3.0), ("moderate", 2.0), ("mild", 1.5)]
NEIGHBOURS = 5
NEIGHBOUR_SIMILARITY_CUT = 0.35
DENSITY_NEIGHBOURS = 10
SELF_NEIGHBOURS = 10
SELF_SIMILARITY_CUT = 0.25
GATE_MIN_ROWS = 10

# Stereo ranking.
STEREO_TIER = {
    "defined": 4, "achiral": 4, "partial_undefined": 2, "fully_undefined": 1, "unknown": 0,
}
STEREO_DEDUP_RANK = {"defined": 0, "achiral": 1, "undefined": 2}
CONSENSUS_BONUS = 0.15
CONSENSUS_MIN_SOURCES = 2

# Coefficients of the released weight, and what a missing factor counts.
WEIGHT_FACTORS = {"novelty": 0.20, "diversity": 0.10, "complexity": 0.05, "resolution": 0.10, "stereo_penalty": 0.60}
WEIGHT_DEFAULTS = {"novelty": 0.5, "diversity": 0.5, "complexity": 0.3, "consensus": 0.0, "resolution": 0.0, "stereo_penalty": 0.0}

# Label uncertainty weights.
UNCERTAINTY_WEIGHTS = {"std": 0.35, "assay": 0.25, "source": 0.15, "unit": 0.15, "context": 0.10}

# How far a point value may lie from the middle of its bootstrap.
POINT_LIMITS = {"r2": 0.05, "roc_auc": 0.03}

# Splits.
MIN_VAL_FRACTION = 0.08
CLUSTER_CUTOFFS = [0.40, 0.50, 0.55, 0.60, 0.65, 0.35, 0.30, 0.25]
SPLITS_EXPECTED_TO_MATCH = ["random"]
SPLITS_EXPECTED_TO_DIFFER = ["scaffold", "similarity"]
SPLITS_MAY_DIFFER = ["lead_opt", "confirmed", "cliff_aware"]

# Qualifiers.
QUALIFIERS = ["=", ">", "<", ">=", "<="]

# Grids of the linear models.
NET_PENALTIES = [1e-4, 1e-3, 1e-2, 1e-1, 1.0]
NET_INVERSES = [0.01, 0.1, 1.0, 10.0, 100.0]
NET_MIXES = [0.1, 0.5, 0.9]

# Grids of the boosted trees (depths, child weights, L1 penalties) and their rounds.
TREE_DEPTHS = [4, 6, 8]
TREE_CHILD_WEIGHTS = [1.0, 5.0, 10.0]
TREE_ALPHAS = [0.0, 0.1]
TREE_ROUNDS, TREE_PATIENCE = 2000, 50
STACK_DEPTHS = [3, 4, 5]
STACK_CHILD_WEIGHTS = [1.0, 5.0]
STACK_ALPHAS = [0.0, 0.1]
STACK_ROUNDS = 500

# Seeds a split is validated with, and how far its figures may spread over them.
VALIDATION_SEEDS = [42, 43, 44]
SPREAD_TEST_SIZE, SPREAD_KS, SPREAD_HEALTH = 0.10, 0.10, 15
