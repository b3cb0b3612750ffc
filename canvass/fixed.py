"""Fixed values that results depend on, stated together in one place.

Each must equal the value the analysed workflow uses (or the library default it
relies on); operators take them as defaults, so changing one here changes the
results everywhere it is used.
"""

# ---- Fixed values -------------------------------------------------------------

# raw answers
NULL_TOKEN = "NA"  # the only missing-value token of the raw export
MULTI_SEP = ";"  # separator of multi-select answers
SENTINELS = {"Less than 1 year": 0.5, "More than 50 years": 51.0}  # text answers that stand for numbers
DROPPED_MARKER = "(dropped)"  # codebook rows marked as dropped columns

# bands (right-closed intervals)
EXPERIENCE_EDGES = [-1, 3, 10, 100]
CAREER_EDGES = [0, 2, 5, 10, 15, 20, 30, 60]  # first interval closed on the left
TOP_OPTIONS = 10  # options kept per rate-by-band chart

# split
TEST_SIZE = 0.2  # test = ceil(0.2 N)
SEED = 42
FOLDS = 5

# statistics
ALPHA = 0.05
CORRELATION_TIERS = (0.5, 0.3)  # |r|: strong, medium
CRAMERS_V_TIERS = (0.3, 0.1)  # V: strong, medium
ETA_SQUARED_TIERS = (0.14, 0.06)  # eta^2: large, medium
PROFILE_CLIP = (0.005, 0.995)  # moments of the numeric profile use clipped values
MIN_PAIRS = 3  # correlation pairs with fewer rows are skipped
REGRESSION_CAP = 0.99  # OLS line below this quantile of y
HISTOGRAM_BINS = 30
HISTOGRAM_LOG_BINS = 50
SAMPLE_ROWS = 5000  # seeded scatter sample
BOOTSTRAP_REPLICATES = 1000  # plotting-library default for confidence bands
BOOTSTRAP_LEVEL = 0.95

# linear track
WINSOR = (0.01, 0.99)
MIN_FREQUENCY = 30  # one-hot levels rarer than this fold together
MISSING_LEVEL = "Missing"
INFREQUENT_LEVEL = "infrequent"
C = 1.0
MAX_ITER = 3000
THRESHOLD = 0.5  # class 1 when probability >= 0.5

# boosted trees
TREES = 500
LEARNING_RATE = 0.05
DEPTH = 6
TREE_MISSING_LEVEL = "__MISSING__"
