"""Values that have to be exactly these for results to be right.

Everything in this file is a fixed value: names, thresholds, word lists, patterns and presets of the
method itself. The jobs take them as defaults of their parameters.
"""

# The 15 syntactic features, in vector order.
SYNTACTIC_FEATURES = [
    "avg_sent_len",
    "burstiness",
    "punct_entropy",
    "punct_density",
    "avg_dep_depth",
    "nv_ratio",
    "ttr",
    "hlr",
    "complexity_ratio",
    "passive_ratio",
    "comma_cv",
    "cr_pos",
    "unique_trigrams_per_tok",
    "pos_entropy",
    "total_tokens",
]

# The 10 surface features, in vector order.
SURFACE_FEATURES = [
    "comma_density",
    "dash_density",
    "quote_density",
    "excl_density",
    "punct_intensity",
    "avg_word_len",
    "avg_sent_len",
    "caps_ratio",
    "digit_ratio",
    "unique_word_ratio",
]

# The 7 surface features of the first variant, in vector order.
SURFACE_FEATURES_V1 = [
    "comma_density",
    "dash_density",
    "quote_density",
    "avg_word_len",
    "avg_sent_len",
    "caps_ratio",
    "punct_intensity",
]

# Words of the news domain that give the class away.
DOMAIN_STOP_WORDS = [
    "риа", "новости", "сообщает", "говорится", "ранее", "рф", "года", "2019",
    "сообщил", "отметил", "добавил", "уточнил", "подчеркнул",
]
DOMAIN_STOP_WORDS_SHORT = [
    "риа", "новости", "сообщает", "говорится", "ранее", "рф", "года", "2019",
]

# Agency datelines cut from the head of a text, applied in this order, case ignored.
DATELINE_PATTERNS = [
    r"^[А-ЯЁA-Z\s\-]{2,},\s\d+\s[а-яё]+\s[—–-]\s*(РИА Новости|ТАСС|Интерфакс|Лента\.ру)\.?\s*",
    r"^[А-ЯЁA-Z\s\-]{2,}\s[—–-]\s*(РИА Новости|ТАСС)\.?\s*",
    r"^[А-ЯЁ][а-яё]+\s[А-ЯЁ][а-яё]+\.\.\s*",
    r"^(РИА НОВОСТИ|ТАСС|ЛЕНТА\.РУ)\.?\s*",
    r"^ТАСС,\s+\d+\s+[а-яё]+\.\s*",
]
CAPITAL_LETTER = "[А-ЯЁA-Z]"
CYRILLIC_LETTER = "[а-яА-ЯёЁ]"

# Explanation rules as (name, feature, direction, threshold, hypothesis), in report order.
EXPLANATION_RULES = [
    ("cr_pos_high", "cr_pos", ">", 0.62, "H1"),
    ("unique_trigrams_low", "unique_trigrams_per_tok", "<", 0.25, "H1"),
    ("pos_entropy_low", "pos_entropy", "<", 2.0, "H1"),
    ("burstiness_low", "burstiness", "<", 4.0, "H2"),
    ("punct_entropy_low", "punct_entropy", "<", 1.5, "H2"),
    ("comma_cv_low", "comma_cv", "<", 0.3, "H2"),
    ("ttr_low", "ttr", "<", 0.55, "H3"),
    ("hlr_low", "hlr", "<", 0.35, "H3"),
    ("complexity_low", "complexity_ratio", "<", 0.04, "H3"),
    ("dep_depth_low", "avg_dep_depth", "<", 3.5, "H4"),
    ("nv_ratio_high", "nv_ratio", ">", 3.0, "H4"),
]

# Hypothesis label of each feature in importance reports.
FEATURE_HYPOTHESIS = {
    "avg_sent_len": "H2",
    "burstiness": "H2",
    "punct_entropy": "H2",
    "punct_density": "H2",
    "comma_cv": "H2",
    "avg_dep_depth": "H4",
    "nv_ratio": "H4",
    "ttr": "H3",
    "hlr": "H3",
    "complexity_ratio": "H3",
    "passive_ratio": "H3",
    "cr_pos": "H1",
    "unique_trigrams_per_tok": "H1",
    "pos_entropy": "H1",
    "total_tokens": "Ctrl",
}

# Feature groups removed together in the group ablation.
ABLATION_GROUPS = {
    "G1 syntax": ["cr_pos", "unique_trigrams_per_tok", "pos_entropy", "avg_dep_depth"],
    "G2 punctuation": ["punct_entropy", "punct_density", "comma_cv", "burstiness"],
    "G3 lexis": ["ttr", "hlr", "avg_sent_len", "nv_ratio"],
    "G4 structure": ["complexity_ratio", "passive_ratio"],
    "Control": ["total_tokens"],
}

# Features compared between domains.
STABILITY_FEATURES = ["burstiness", "punct_entropy", "cr_pos", "ttr", "avg_dep_depth"]

# Generator models (id, label, fixed temperature, fixed top_p) and request options.
GENERATOR_MODELS = [
    ("meta-llama/Llama-3.1-8B-Instruct", "Llama-3.1-8B", None, None),
    ("Qwen/Qwen2.5-7B-Instruct", "Qwen-2.5-7B", None, None),
    ("deepseek-ai/DeepSeek-R1-Distill-Llama-8B", "DeepSeek-R1-Llama", 0.3, 0.9),
]
GENERATOR_STYLES = [
    "в сухом официальном стиле российского информагентства",
    "в стиле аналитической колонки российского СМИ",
    "как краткую сводку для российского телеграм-канала",
    "в стиле классической газетной заметки (федеральный выпуск)",
]
GENERATOR_LENGTHS = ["300", "400", "600"]

# Names of the stored experiments.
BASELINE_EXPERIMENTS = {
    "tfidf_rf": "TF-IDF + Random Forest",
    "tfidf_logreg": "TF-IDF + Logistic Regression",
    "stylo_rf": "Stylometry + Random Forest",
    "stylo_logreg": "Stylometry + Logistic Regression",
}

# Model presets. A depth of None means as deep as the library allows.
FOREST_PRESETS = {
    "core": {"trees": 300, "depth": 20, "leaf": 2, "balanced": True},
    "tfidf_rf": {"trees": 200, "depth": None, "leaf": 1, "balanced": True},
    "stylo_rf": {"trees": 200, "depth": 15, "leaf": 1, "balanced": True},
    "notebook": {"trees": 100, "depth": None, "leaf": 1, "balanced": False},
    "ablation": {"trees": 200, "depth": None, "leaf": 1, "balanced": True},
}
LOGISTIC_PRESETS = {
    "library": {"c": 1.0, "max_iter": 2000, "balanced": True},
    "notebook": {"c": 1.0, "max_iter": 1000, "balanced": False},
}
TFIDF_PRESETS = {
    "library": {"min_df": 3, "max_features": 3000, "sublinear": True, "stop_words": DOMAIN_STOP_WORDS},
    "notebook": {"min_df": 5, "max_features": 2000, "sublinear": False, "stop_words": DOMAIN_STOP_WORDS_SHORT},
}
SEED = 42
