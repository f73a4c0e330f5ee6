"""Word lists, names and thresholds that decide results.

Every list is a default; the functions that use one accept another.
"""

# ---- fixed values: cue phrases -------------------------------------------------
CAUSAL_CONNECTIVES = (
    "because",
    "therefore",
    "as a result",
    "driven by",
    "given that",
    "leads to",
    "consequently",
    "thus",
)
GROUNDED_EVIDENTIALS = (
    "data shows",
    "kpis indicate",
    "metrics reveal",
    "shows",
    "indicates",
    "reveals",
    "based on",
    "demonstrates",
)
UNGROUNDED_ASSERTIONS = ("it is clear", "obviously", "undoubtedly", "clearly", "evident")
HEDGES = ("may", "could", "possibly", "suggest", "might", "perhaps", "likely", "probably")
BOOSTERS = ("definitely", "must", "always", "certainly", "absolutely")
MODALS = ("should", "must", "could", "will", "may", "might")

# ---- fixed values: support thresholds ------------------------------------------
ALIGN_THRESHOLDS = (0.10, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)

# ---- fixed values: section headings --------------------------------------------
SECTIONS = ("observations", "interpretations", "recommendations")

# ---- fixed values: metric vocabulary, in scaling order -------------------------
ALL_METRICS = (
    "flesch_reading_ease",
    "flesch_kincaid_grade",
    "clarity_score_avg",
    "f1_bert",
    "relevance_score_avg",
    "precision_bert",
    "recall_bert",
    "factuality_precision_50",
    "recommendations_precision_50",
    "reasoning_percentage",
    "factuality_score_avg",
    "actionability_score_avg",
    "reasoning_score_avg",
    "answer_quantification_density",
    "human_answer_quantification_density",
    "answer_causal_density",
    "human_answer_causal_density",
    "answer_hedge_to_booster_ratio",
    "human_answer_hedge_to_booster_ratio",
    "answer_hedge_density",
    "human_answer_hedge_density",
    "answer_booster_density",
    "human_answer_booster_density",
    "answer_modal_should_freq",
    "human_answer_modal_should_freq",
    "answer_modal_must_freq",
    "human_answer_modal_must_freq",
    "answer_modal_could_freq",
    "human_answer_modal_could_freq",
    "answer_modal_will_freq",
    "human_answer_modal_will_freq",
    "answer_modal_may_freq",
    "human_answer_modal_may_freq",
    "answer_modal_might_freq",
    "human_answer_modal_might_freq",
)
DEFAULT_SKEWED = (
    "answer_hedge_to_booster_ratio",
    "recommendations_precision_50",
    "answer_quantification_density",
    "human_answer_quantification_density",
    "factuality_precision_50",
)
DEFAULT_LOWER_IS_BETTER = ("flesch_kincaid_grade",)

# ---- our own declared rules for measures that would need a tagger --------------
# Closed word classes (universal tag -> words); open classes follow suffixes.
CLOSED_CLASSES = {
    "ADP": (
        "of", "in", "to", "for", "with", "on", "at", "by", "from", "into", "about", "over",
        "after", "under", "between", "through", "during", "against", "without", "within", "across",
    ),
    "PRON": (
        "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
        "this", "that", "these", "those", "who", "what", "which",
    ),
    "INTJ": ("oh", "ah", "wow", "hey", "yes", "please"),
    "DET": ("the", "a", "an"),
    "CCONJ": ("and", "or", "but"),
    "AUX": (
        "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did",
        "should", "must", "could", "will", "may", "might", "can", "would",
    ),
}
FORMAL_TAGS = ("NOUN", "PROPN", "ADJ", "ADP")
INFORMAL_TAGS = ("VERB", "ADV", "PRON", "INTJ")
# Suffix rules, tried in order; a token that fits none is a noun.
SUFFIX_RULES = (
    ("ADV", ("ly",)),
    ("VERB", ("ing", "ed", "ize")),
    ("ADJ", ("ous", "ful", "ive", "able", "al")),
)
# Verbs that open an instruction.
BASE_VERBS = (
    "add", "adopt", "assess", "build", "check", "consider", "create", "cut", "develop", "ensure",
    "expand", "focus", "hire", "implement", "improve", "increase", "invest", "keep", "launch",
    "monitor", "plan", "reduce", "review", "start", "stop", "track", "train", "use",
)
# Entity labels kept by the entity density, and the labels a quantity may carry.
ENTITY_LABELS = ("ORG", "PRODUCT", "MONEY", "PERCENT", "DATE")
QUANTITY_LABELS = ("PERCENT", "MONEY", "DATE", "TIME", "QUANTITY", "CARDINAL")
