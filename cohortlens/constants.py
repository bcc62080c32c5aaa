"""Names, lists, ranges and defaults that results depend on."""

from __future__ import annotations

# --- columns of a cohort table --------------------------------------------------------
LABEL = "grade_label"  # 1 = fail = positive
NEVER_FEATURES = ("SID", "grade", "grade_label", "MOOCgrade", "custom_fold_id")

# --- decoding of parameter cells ------------------------------------------------------
NULL_WORDS = ("none", "nan")
TRUE_WORDS = ("true", "yes")
FALSE_WORDS = ("false", "no")
INT_PARAMS = (
    "n_estimators", "max_depth", "num_leaves", "min_child_weight", "min_samples_split",
    "min_samples_leaf", "n_neighbors", "max_iter", "min_child_samples",
)
BOOL_PARAMS = (
    "fit_intercept", "early_stopping", "bootstrap", "fit_prior", "probability", "verbose",
    "replace", "shuffle",
)
FLOAT_PARAMS = (
    "learning_rate", "subsample", "colsample_bytree", "gamma", "reg_alpha", "reg_lambda",
    "alpha", "l1_ratio",
)
# names the lenient variant adds
EXTRA_INT_PARAMS = ("random_state", "iterations", "depth")
EXTRA_FLOAT_PARAMS = ("tol", "C")

# columns of a trial table that hold results, not parameters
METRIC_COLUMNS = (
    "Model", "Model_Name", "ACC", "AUC", "F1", "Precision", "Recall", "Specificity",
    "Balanced_ACC", "G-Mean", "G_Mean", "Weighted_Score", "TP", "FP", "TN", "FN",
    "Threshold", "Fail_Miss_Rate", "Recall (Fail Capture)", "Specificity (Pass Correct)",
    "FPR", "FNR", "Wrongly_Accused_Rate", "Correct_Grade0_Rate",
)
METRIC_FRAGMENTS = ("Contrib", "Weight")

# --- thresholds and objective ---------------------------------------------------------
EPS = 1e-9
MIN_RECALL = 0.8
PENALTY_BASE = 6.0
PENALTY_FUSION = 0.6
WEIGHT_SPECIFICITY = 0.5
WEIGHT_RECALL = 0.5
FALLBACK_THRESHOLD = 0.5

# --- search budgets -------------------------------------------------------------------
SEED = 42
BASE_TRIALS, BASE_RANDOM_TRIALS, BASE_TOP = 100, 30, 50
FUSION_TRIALS, FUSION_RANDOM_TRIALS, FUSION_TOP = 50, 12, 30
FUSION_MIN_VALUE = -0.5
TOP_NATIVE = 20
SELECT_FEATURES = 180
BACKGROUND_CENTRES = 20

# rounds without a better loss on held-out training rows after which boosting stops: configured for the first two,
# the libraries' own for the others
STOPPING_ROUNDS = {"XGBoost": 300, "LightGBM": 300, "HGB": 10, "CatBoost": 20}

# --- neural baseline schedule ---------------------------------------------------------
FOCAL_ALPHA, FOCAL_GAMMA = 0.75, 2.0
FOCAL_LEARNING_RATE, FOCAL_WEIGHT_DECAY = 0.002, 1e-4
FOCAL_EPOCHS, FOCAL_PATIENCE, FOCAL_PLATEAU, FOCAL_CLIP = 80, 20, 5, 1.0

# --- model families -------------------------------------------------------------------
POSITIVE_WEIGHT_FAMILIES = ("XGBoost", "LightGBM")
TREE_FAMILIES = ("LightGBM", "XGBoost", "CatBoost", "RF", "ET", "DT", "GBC", "HGB")
BASE_METHODS = ("XGBoost", "LightGBM", "DT", "Ridge", "HGB", "ET")
FUSION_METHODS = (
    "XGBoost", "LightGBM", "BNB", "ET", "HGB", "LR", "ENLR", "Ridge", "KNN", "RF", "DT", "LDA",
)

# --- search ranges: name -> (tuned, fixed) --------------------------------------------
BASE_SPACES = {
    "XGBoost": (
        {"learning_rate": [0.001, 0.5], "n_estimators": [100, 5000], "max_depth": [3, 20],
         "min_child_weight": [0.1, 100], "subsample": [0.4, 1.0], "colsample_bytree": [0.4, 1.0],
         "gamma": [0, 20], "reg_lambda": [0.0001, 1000], "reg_alpha": [0.0001, 1000]},
        {},
    ),
    "ET": (
        {"n_estimators": [100, 800], "max_depth": [5, 25], "min_samples_split": [2, 20],
         "min_samples_leaf": [2, 10], "max_features": ["sqrt", "log2", 0.5, 0.9],
         "bootstrap": [True, False]},
        {"random_state": 42},
    ),
    "LightGBM": (
        {"learning_rate": [0.001, 0.5], "n_estimators": [100, 5000], "num_leaves": [20, 1024],
         "max_depth": [-1, 50], "min_child_samples": [5, 300], "feature_fraction": [0.4, 1.0],
         "bagging_fraction": [0.4, 1.0], "lambda_l1": [1e-8, 100], "lambda_l2": [1e-8, 100]},
        {"random_state": 42},
    ),
    "RF": (
        {"n_estimators": [100, 800], "max_depth": [5, 15], "min_samples_split": [2, 20],
         "min_samples_leaf": [2, 10], "max_features": ["sqrt", "log2", 0.5, 0.8]},
        {"random_state": 42},
    ),
    "KNN": ({"n_neighbors": [3, 200], "weights": ["uniform", "distance"], "p": [1, 2]}, {}),
    "HGB": (
        {"learning_rate": [0.001, 0.5], "max_iter": [100, 5000], "max_depth": [1, 50, None],
         "min_samples_leaf": [5, 300], "l2_regularization": [1e-8, 100]},
        {"random_state": 42},
    ),
    "LR": (
        {"C": [0.001, 100.0], "penalty": ["l1", "l2"], "solver": ["liblinear", "saga"]},
        {"random_state": 42, "max_iter": 1000},
    ),
    "ENLR": (
        {"C": [0.001, 100.0], "l1_ratio": [0.1, 0.9]},
        {"random_state": 42, "penalty": "elasticnet", "solver": "saga", "max_iter": 2000},
    ),
    "GNB": ({"var_smoothing": [1e-15, 1e-1]}, {}),
    "BNB": ({"alpha": [0.0001, 1000.0], "binarize": [0.0, 1.0]}, {}),
    "DT": (
        {"max_depth": [1, 50, None], "min_samples_split": [2, 100], "min_samples_leaf": [1, 50]},
        {"random_state": 42},
    ),
    "LDA": ({"solver": ["svd", "lsqr"], "tol": [1e-8, 1e-1]}, {}),
    "Ridge": ({"alpha": [0.00001, 10000.0], "max_iter": [100, 10000]}, {"random_state": 42}),
    "AdaBoost": ({"n_estimators": [50, 500], "learning_rate": [0.01, 1.0]}, {"random_state": 42}),
    "GBC": (
        {"n_estimators": [100, 500], "learning_rate": [0.01, 0.5], "max_depth": [3, 10]},
        {"random_state": 42},
    ),
}

# what the fusion layer changes: (added to the tuned part, added to the fixed part)
FUSION_SPACE_CHANGES = {
    "ET": ({}, {"class_weight": "balanced"}),
    "RF": ({}, {"class_weight": "balanced"}),
    "HGB": ({}, {"early_stopping": True}),
    "LR": ({"class_weight": ["balanced", None]}, {}),
    "ENLR": ({}, {"class_weight": "balanced"}),
    "DT": ({"class_weight": ["balanced", None]}, {}),
    "Ridge": ({"class_weight": ["balanced", None]}, {}),
}

# float ranges by name, even where both ends are whole numbers
FLOAT_RANGE_PARAMS = ("learning_rate", "gamma", "l2_regularization")
LOG_RANGE_RATIO = 100

# defaults of the configured base layer
BASE_DEFAULTS = {
    "XGBoost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5, "min_child_weight": 3},
    "LightGBM": {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": -1},
    "DT": {"max_depth": 6},
    "Ridge": {"alpha": 1.0, "max_iter": 1000},
    "HGB": {"max_iter": 100, "learning_rate": 0.1},
    "ET": {"n_estimators": 100, "max_depth": 8, "min_samples_leaf": 2},
}

# families without a configured default take those of the library they stand for; iteration limits of
# the logistic families as in their search ranges, the mix of the elastic net is the middle of its range
LIBRARY_DEFAULTS = {
    "CatBoost": {"iterations": 1000, "depth": 6, "learning_rate": 0.03},
    "GBC": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "AdaBoost": {"n_estimators": 50, "learning_rate": 1.0},
    "RF": {"n_estimators": 100, "max_depth": None, "max_features": "sqrt"},
    "LR": {"C": 1.0, "penalty": "l2", "max_iter": 1000},
    "ENLR": {"C": 1.0, "l1_ratio": 0.5, "max_iter": 2000},
    "MLP": {"hidden": 100, "max_iter": 200},
}
