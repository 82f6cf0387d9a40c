"""glossaloom: naming policies, style banks and text alignment for serial corpora on Spark."""

__version__ = "0.1.0"
