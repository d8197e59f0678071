"""Helpers that the operators of this subpackage share."""

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from forgelens.sources.workspace import shared_folder, written  # noqa: F401

# workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__package__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# letters other than A-Z that have a lower case: titlecase and uppercase in the sense of Unicode
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; the built-in function where the text has no other capital letter."""
    return F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def tokenizer_file(name: str) -> str:
    """A public vocabulary file, by default of the installed package; FORGELENS_TOKENIZERS names another folder."""
    folder = os.environ.get("FORGELENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def of_worker(name: str, make):
    """A value that a Python worker process keeps for its later tasks."""
    held = sys.__dict__.setdefault("_forgelens_llm", {})
    if name not in held:
        held[name] = make()
    return held[name]
