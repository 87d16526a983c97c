"""tickertide: news-headline signals and return studies as Spark DataFrame operators."""

__version__ = "0.1.0"
