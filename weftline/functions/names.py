"""Naming-convention conversions used to recognise a column in code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_snake(name: Column) -> Column:
    """``UserID`` → ``user_id``, ``HTTPServer`` → ``http_server``."""
    humps = F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(humps, "([A-Z])([A-Z][a-z])", "$1_$2"))


def to_camel(name: Column) -> Column:
    """Only an underscore followed by a lowercase letter folds away."""
    parts = F.split(name, "_(?=[a-z])")
    return F.array_join(
        F.transform(
            parts,
            lambda part, i: F.when(i == 0, part).otherwise(
                F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, F.lit(2), F.length(part)))
            ),
        ),
        "",
    )


def to_pascal(name: Column) -> Column:
    camel = to_camel(name)
    return F.concat(F.upper(F.substring(camel, 1, 1)), F.substring(camel, F.lit(2), F.length(camel)))


def plural_table(model: Column) -> Column:
    """Table name assumed for a model that does not state one."""
    return F.concat(to_snake(model), F.lit("s"))


def singular(name: Column) -> Column:
    """Drops one trailing lowercase ``s``; other names stay as they are."""
    return F.when(name.endswith("s"), F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)
