"""structura: questionnaire and site-structure processing on Spark."""

__version__ = "0.1.0"
