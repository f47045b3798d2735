"""Fixed values of the tool-wear domain. Every operator takes them as keyword defaults."""

# fixed values: channels of a recording and their sampling
CHANNELS = ("acc", "acoustic", "Fx", "Fy", "Fz")
STEP_SECONDS = 0.0006
FS = 1000 / 0.6

# fixed values: which set belongs to which split
SPLITS = {
    "train": (1, 2, 5, 7, 8, 10, 11),
    "val": (3, 6, 12),
    "test": (4, 9, 13),
    "unseen": (14, 15, 16, 17),
}
DEFAULT_SPLIT = "unseen"

# fixed values: spellings of the wear type
TYPE_MAP = {
    "adhesive": "adhesion",
    "adhesive_wear": "adhesion",
    "flank": "flank_wear",
    "flank_wear_and_adhesion": "flank_wear+adhesion",
    "flank_wear_&_adhesion": "flank_wear+adhesion",
    "flank_wear+adhesive_wear": "flank_wear+adhesion",
    "combination": "flank_wear+adhesion",
}
WEAR_TYPES = ("flank_wear", "adhesion", "flank_wear+adhesion")
ADHESION_TYPES = ("adhesion", "flank_wear+adhesion")

# fixed values: materials, limits of wear, fit windows and sets, literature exponents
LAST_CK45_SET = 11
CK45, RVS = "CK45", "RVS 304"
WEAR_CAP_UM = 450.0
WEAR_DIVISOR = 1000.0
FAILURE_UM = 300.0
LIFE_FAILURE_UM = 90.0
WINDOW = (0.15, 0.85)
FIT_SETS = (1, 2, 5, 7, 8, 10, 11, 12, 13)
EXCLUDED_SETS = (1,)
CAUTION_SETS = (6, 17)
CAUTION_WEIGHT = 0.5
LITERATURE_N = {CK45: 0.25, RVS: 0.20}

N_SEGMENTS = 10
BASELINE_K = 3

# fixed values: bins of the wear distribution table
WEAR_EDGES = (0, 50, 100, 150, 200, 300, 450, 1000)
WEAR_LABELS = ("0–50", "50–100", "100–150", "150–200", "200–300", "300–450", ">450")

# fixed values: high-pass taps of the published Daubechies-4 wavelet
DB4_HIGH = (
    -0.23037781330885523, 0.7148465705525415, -0.6308807679295904, -0.02798376941698385,
    0.18703481171888114, 0.030841381835986965, -0.032883011666982945, -0.010597401784997278,
)
# fixed values: settings of the cutting detector
WAVELET = {"z": 10.0, "baseline": 1000, "min_active": 1000, "trim": -0.05}

# fixed values: names of the cutting parameters
CUTTING = ("Vc", "n", "fz", "Vf", "Ae", "Ap", "z")
