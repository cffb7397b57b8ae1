"""quizlens: a Spark-first engine that audits multiple-choice corpora and the scores reported on them."""

__version__ = "0.1.0"
