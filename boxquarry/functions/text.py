"""Names, paths, keys and fingerprints as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def labels_path(path: Column, which: str = "first") -> Column:
    """An image's label file: the ``first`` or ``last`` folder named images becomes labels, and the suffix .txt."""
    if which not in ("first", "last"):
        raise ValueError("which is first or last")
    head = "^(.*?)" if which == "first" else "^(.*)"
    return F.regexp_replace(F.regexp_replace(path, head + "(?<=^|/)images/", "$1labels/"), r"\.[^./]+$", ".txt")


def source_group(name: Column, rules: Sequence[tuple[str, str]], inside: bool = False) -> Column:
    """The group of the first prefix that a name has (or, ``inside``, has after an underscore); else its first word."""
    out = F.split_part(name, F.lit("_"), F.lit(1))
    for prefix, group in reversed(list(rules)):
        hit = name.startswith(prefix) | (name.contains("_" + prefix) if inside else F.lit(False))
        out = F.when(hit, group).otherwise(out)
    return out


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def canonical_base(path: Column) -> Column:
    """The stem without an export's ``.rf.<hex>`` mark, in lower case."""
    return F.regexp_replace(F.lower(stem(path)), r"\.rf\.[0-9a-f]+$", "")


def slug(value: Column, most: int = 40) -> Column:
    """Lower-case words joined by underscores; a longer one is cut and ends in a digest of the whole."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most - 9), F.lit("_"), F.substring(F.sha1(plain), 1, 8)))


def split_values(value: Column, mark: str = ";") -> Column:
    """Trimmed values between marks, without empty ones; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), mark), lambda v: F.trim(v)), lambda v: v != "")


def first_present(*values: Column) -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def truthy(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin("1", "true", "yes", "y")


def compact_counter(keys: Column, counts: Column) -> Column:
    """``k=v;`` pairs of a group, by key."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(keys.cast("string").alias("k"), counts.alias("v")))), lambda x: F.concat(x["k"], F.lit("="), x["v"].cast("string"))), ";")


def stable_key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts between bars: they order as the unsigned number does."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)


def fingerprint(order: Sequence[str], value: str) -> Column:
    """SHA-256 of a group's values in this order, one a line; the order counts."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("v"))))
    return F.sha2(F.array_join(F.transform(held, lambda x: x["v"]), "\n"), 256)


def resolved(path: str, root: str) -> Column:
    """A path below ``root``, unless it is absolute or has a scheme."""
    p = F.col(path)
    return F.when(p.startswith("/") | p.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def csv_cell(value: Column) -> Column:
    """A CSV cell: quoted if it holds a comma, a quote or a line end."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\\r\\n]'), quoted).otherwise(value)
