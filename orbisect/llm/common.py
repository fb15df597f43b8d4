"""Helpers that the corpus operators share: stores, words, identities and ASCII case."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workspace, written

__all__ = ["ascii_lower", "filesystem", "held", "identity", "stripped", "words", "workspace", "written"]

#: Words and white space as the operators see them: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that lower() changes at most where they are A-Z.
PLAIN = r"^[\x00-\x7F\u00A0-\u00BF\u00DF-\u00FF\u2010-\u2027]*\z"


#: Schemes by which Hadoop calls stores that Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it that a URI of the shared folder names; works on executors too."""
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is.

    lower() would also change letters beyond ASCII; it is used where none of them is in the text, as it is
    many times faster than translate().
    """
    return F.when(text.rlike(PLAIN), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stripped(text: Column) -> Column:
    """text without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


#: A document is told by its doc_id and the hash of its text, so that rows which repeat both count as one.
DOC = ("__d", "__t")


def identity(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias(DOC[0]), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(DOC[1])]


def held(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one column __doc beside its identity and more, so that no name of theirs meets an operator's own."""
    return docs.select(F.struct("*").alias("__doc"), *identity(), *more)


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
