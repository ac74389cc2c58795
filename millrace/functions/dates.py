"""The one date that templates carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def template_date(c: Column | str) -> Column:
    """The date of ``DD Mon YYYY`` (a day of one or two digits), null for anything else."""
    text = col(c)
    padded = F.when(text.rlike(r"^\d [A-Za-z]{3} \d{4}$"), F.concat(F.lit("0"), text)).otherwise(text)
    fixed = F.when(padded.rlike(r"^\d{2} [A-Za-z]{3} \d{4}$"), F.concat(F.substring(padded, 1, 3), F.initcap(F.substring(padded, 4, 3)), F.substring(padded, 7, 5)))
    return F.try_to_timestamp(fixed, F.lit("dd MMM yyyy")).cast("date")
