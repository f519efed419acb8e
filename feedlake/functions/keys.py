"""The two identity keys of a URL."""

from pyspark.sql import Column, functions as F


def discovery_key(url: Column) -> Column:
    """Key under which discovery knows an article: the URL in lower case."""
    return F.lower(url)


def vault_key(url: Column) -> Column:
    """Key under which a stored note is known: lower case, no trailing slashes."""
    return F.rtrim(F.lower(url), F.lit("/"))
