"""Fixed values of the analysis: thresholds, labels, patterns and bucket edges."""

# Cut points that define a disrupted observation (strict comparison).
DISRUPTION_CUTS = {
    "shannon": ("<", 2.0),
    "max_read_prop": (">", 0.5),
    "log_copy_16S_per_ml_sputum": (">", 9.0),
}

# Display names of the measures.
MEASURE_LABELS = {
    "shannon": "Shannon Diversity (base e)",
    "max_read_prop": "Max ASV Proportional Abundance",
    "log_copy_16S_per_ml_sputum": "Log Copies 16S rRNA per mL Sputum",
}

# Display names of the outcome abbreviations used in model names.
OUTCOME_LABELS = {
    "sv_": "Suspected VA-LRTI",
    "svp": "Suspected VA-LRTI\n+Culture\n+Signs",
    "svaps": "Suspected VA-LRTI\n+Culture\n+Signs\n+Antibiotic Change",
}

# Course periods as (label, first day, first day of the next period).
WEEK_PERIODS = [("Week 1", 0, 7), ("Week 2", 7, 14), ("Beyond Week 2", 14, None)]
ENROLLMENT_PERIODS = [
    ("Enrollment", 0, 1),
    ("Week 1", 1, 7),
    ("Week 2", 7, 14),
    ("Beyond Week 2", 14, None),
]

# Grouping of prior critical-care indications, applied in this order.
INDICATION_RULES = [
    ("stroke|subarachnoid|neuromuscular|ALS", "neurologic disorder"),
    ("cancer|carcinoma", "cancer"),
]
INDICATION_WHEN_MISSING = "prior records not available"
PNEUMONIA_PATTERN = "pneumonia"

# Clean-up of cultured organism names, applied in this order.
ORGANISM_RULES = [("Staphylococcus$", "Staphylococcus (non-aureus)"), ("_", " ")]

# Label of an observation without a dominant genus.
NO_DOMINANT_GENUS = "no dominant genus"

# Tokens that mean "missing" in measurement files.
NULL_TOKEN = "NA"
SENTINELS = ["Undetermined"]

# Central interval widths.
INTERVAL_WIDTHS = [0.5, 0.8, 0.95]
