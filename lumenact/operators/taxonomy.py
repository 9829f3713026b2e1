"""The default topic taxonomy and the levels of adversarial depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Topics and their subtopics, in order. The topic is the class.
SUBTOPICS = {
    "Enterprise documents": [
        "Internal records & memos",
        "Operational procedures & guides",
        "Project & planning documents",
        "Commercial transaction records",
    ],
    "General news & content": [
        "Current affairs & geopolitics",
        "Science & technology news",
        "Culture & sports",
        "Environment & society",
    ],
    "Customer service": [
        "Billing & payment disputes",
        "Account access & management",
        "Technical support & troubleshooting",
        "Shipping, returns & refunds",
    ],
    "Legal": [
        "Contract clause analysis",
        "Regulatory & data compliance",
        "Employment & labor law",
        "Intellectual property & licensing",
    ],
    "Financial": [
        "Investor & market communications",
        "Personal banking & credit",
        "Insurance & risk management",
        "Tax & accounting",
    ],
    "HR & people operations": [
        "Talent acquisition & recruiting",
        "Onboarding & learning development",
        "Performance management",
        "Compensation, benefits & leave",
    ],
    "Healthcare": [
        "Clinical documentation",
        "Public health & epidemiology",
        "Medical research & clinical trials",
        "Mental health & behavioral care",
    ],
}

# Level numbers and names. The wording of the rest is ours.
LEVELS = [
    (0, "direct", "The question names its subject.", "Ask plainly, in the subject's own words."),
    (1, "surface_hint", "The wording points to the subject.", "Ask naturally; the subject may show."),
    (2, "scenario_entailment", "A situation whose answer needs the subject.",
     "Describe a case or a process, and do not name the subject."),
    (3, "surface_camouflage", "The question seems to be about something else.",
     "Let only a good answer bring up the subject."),
    (4, "maximum_camouflage", "Nothing in the question hints at the subject.",
     "Ask a sound question from elsewhere whose full answer needs the subject."),
]


def default_taxonomy(spark: SparkSession) -> DataFrame:
    """(subtopic, topic, description, ord)."""
    pairs = [(s, t) for t, names in SUBTOPICS.items() for s in names]
    rows = [(s, t, f"Texts on {s.lower()}, from the field of {t.lower()}.", i) for i, (s, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "subtopic string, topic string, description string, ord int")


def default_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level int, name string, description string, instruction string")
