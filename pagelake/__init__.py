"""pagelake: a web-extraction and content-curation engine on PySpark."""

__version__ = "0.1.0"
