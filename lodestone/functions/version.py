"""Version algebra: sort keys, equality, and how well a version fits a lineage or a request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EOL_CAP, SINGLE_CAP, ADJACENT, NEUTRAL = 0.3, 0.7, 0.5, 0.5


def labelled(labels: Column, prefix: str) -> Column:
    """What follows prefix in the first label that has more than it; empty if none does."""
    rest = F.transform(F.filter(labels, lambda x: F.startswith(x, F.lit(prefix)) & (F.length(x) > len(prefix))), lambda x: F.substring(x, len(prefix) + 1, 1 << 20))
    return F.coalesce(F.get(rest, F.lit(0)), F.lit(""))


def site_of(labels: Column) -> Column:
    return labelled(labels, "site-")


def version_of(labels: Column) -> Column:
    """latest, or digits joined by dots, from the first well-formed version label; empty if there is none."""
    found = F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.rlike(x, F.lit(r"^version-(?:latest|v?\d+(?:-\d+)*)$")))
    return F.translate(F.coalesce(F.substring(F.get(found, F.lit(0)), 9, 1 << 20), F.lit("")), "-", ".")


def version_key(version: Column) -> Column:
    """An array that sorts as versions do: latest is the greatest, a version without digits the least."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("double"))
    latest = F.array(F.lit(float("inf")))
    return F.when(version == "latest", latest).when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(-1.0)))


def canonical(version: Column) -> Column:
    """A text that equal versions share: latest, the numbers without leading zeros, or the version itself; null for an empty one."""
    numbers = F.regexp_replace(F.btrim(F.regexp_replace(version, r"[^0-9]+", "."), F.lit(".")), r"(^|\.)0+(?=[0-9])", "$1")
    return F.when(F.coalesce(version, F.lit("")) == "", None).when(version == "latest", version).when(F.rlike(version, F.lit("[0-9]")), numbers).otherwise(F.concat(F.lit("="), version))


def versions_equal(a: Column, b: Column) -> Column:
    """1.25 and v1.25 are equal; empty versions equal nothing."""
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def sorted_versions(lineage: Column) -> Column:
    """A lineage in order of version; equal keys by text."""
    keyed = F.transform(lineage, lambda v: F.struct(version_key(v).alias("key"), v.alias("version")))
    return F.transform(F.array_sort(keyed), lambda x: x["version"])


def latest_of(lineage: Column) -> Column:
    return F.coalesce(F.try_element_at(sorted_versions(lineage), F.lit(-1)), F.lit(""))


def is_eol(site: Column, version: Column, ended: Mapping[str, Sequence[str]]) -> Column:
    out = F.lit(False)
    for name, versions in ended.items():
        out = out | ((site == name) & version.isin(*versions))
    return F.coalesce(out, F.lit(False))


def currency_at(place: Column, known: Column, version: Column, site: Column, eol: Column, many: Sequence[str] = ()) -> Column:
    """How late a version stands at its place (0 if it isn't there) among `known` versions; the cap for ended versions applies to every case."""
    share = F.when(place > 0, place / known).otherwise(NEUTRAL)
    single = F.when(site.isin(*many), SINGLE_CAP).otherwise(1.0) if many else F.lit(1.0)
    base = F.when((F.coalesce(version, F.lit("")) == "") | (known == 0), NEUTRAL).when(known == 1, single).otherwise(share)
    return F.when(F.coalesce(eol, F.lit(False)), F.least(base, F.lit(EOL_CAP))).otherwise(base)


def match_at(place: Column, known: Column, key: Column, keys: Column, wanted: Column) -> Column:
    """1 for a requested version, ADJACENT next to one in the lineage, NEUTRAL where nothing is known.

    key, keys and wanted are canonical: of the version, of its lineage in order, and of the requested versions.
    """
    at = place.cast("int")
    near = F.array_compact(F.array(F.get(keys, at - 2), F.get(keys, at)))
    return (
        F.when(key.isNull(), NEUTRAL)
        .when(F.array_contains(wanted, key), 1.0)
        .when(known == 0, NEUTRAL)
        .when((place > 0) & F.coalesce(F.arrays_overlap(near, wanted), F.lit(False)), ADJACENT)
        .otherwise(0.0)
    )


def _ordered(lineage: Column) -> Column:
    return sorted_versions(F.coalesce(lineage, F.array().cast("array<string>")))


def currency_fit(version: Column, site: Column, eol: Column, lineage: Column, many: Sequence[str] = ()) -> Column:
    """currency_at for a lineage in any order; evidence.annotated has the lineage sorted once a document."""
    order = _ordered(lineage)
    return currency_at(F.array_position(order, version), F.size(order), version, site, eol, many)


def match_fit(version: Column, lineage: Column, targets: Column) -> Column:
    order = _ordered(lineage)
    return match_at(F.array_position(order, version), F.size(order), canonical(version), F.transform(order, canonical), F.transform(targets, canonical))


def version_fit(version: Column, site: Column, eol: Column, lineage: Column, targets: Column, many: Sequence[str] = ()) -> Column:
    """match_fit where versions are requested, else currency_fit."""
    return F.when(F.size(targets) > 0, match_fit(version, lineage, targets)).otherwise(currency_fit(version, site, eol, lineage, many))


# Fixed pattern: a version with a dot in free text. Only digits and dots beside it count, as letters of other scripts may follow at once.
TOKENS = r"(?<![0-9.])(v?\d+\.\d+(?:\.\d+)*)(?![0-9.])"


def versions_in(text: Column) -> Column:
    """The distinct versions that a text names, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(1)))
