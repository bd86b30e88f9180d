"""Column expressions for gene names, token lists and warning strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: Column | str) -> Column:
    """String with NULL as the empty string."""
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(F.trim(_col(value)), F.lit(""))


def tokens(value: Column | str, pattern: str = "[;|]") -> Column:
    """Trimmed, non-blank parts of a delimited string."""
    parts = F.transform(F.split(text(value), pattern), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def complex_genes(name: Column | str) -> Column:
    """Subunits of a complex name; ``_ + & :`` all separate them."""
    return tokens(name, "[_+&:]")


def join_sorted(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), ";")


def append_warnings(value: Column | str, warnings: Sequence[str]) -> Column:
    """Add each warning to a ``;`` list once, keeping the order."""
    clean = [str(w) for w in warnings if str(w)]
    if not clean:
        return text(value)
    have = F.filter(F.split(text(value), ";"), lambda x: x != "")
    new = F.array(*[F.lit(w) for w in clean])
    return F.array_join(F.concat(have, F.array_except(F.array_distinct(new), have)), ";")


def interaction_label(columns: Sequence[str]) -> Column:
    """Display label of an LR row: its given name, else ``ligand - receptor``."""
    plain = F.concat_ws(" - ", "ligand", "receptor")
    if "interaction_name_2" in columns:
        return F.coalesce(blank_to_null("interaction_name_2"), plain)
    return plain


def interaction_name(ligand: str = "ligand", receptor: str = "receptor", pathway: str = "pathway") -> Column:
    """Identifier-safe name of an LR row."""
    return F.regexp_replace(F.concat_ws("_", ligand, receptor, pathway), r"[^\p{L}\p{N}_]", "_")


def first_present(columns: Sequence[str], names: Sequence[str]) -> str | None:
    return next((n for n in names if n in columns), None)
