"""Path columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last component; trailing slashes and ``/.`` do not count."""
    return F.substring_index(F.regexp_replace(path, r"(?:/\.?)+\z", ""), "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix, ``<noext>`` when there is none."""
    suffix = F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))
    return F.when(suffix == "", "<noext>").otherwise(suffix)


def parent_parts(path: Column) -> Column:
    """Directory components of a relative path."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def below_any(path: Column, directories: tuple[str, ...]) -> Column:
    """True for files below one of the directories, at any depth."""
    return F.arrays_overlap(parent_parts(path), F.array(*[F.lit(d) for d in directories]))


def normal_path(path: Column) -> Column:
    """Relative path without ``.``, empty and resolvable ``..`` components."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        can_pop = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return (
            F.when((part == "") | (part == "."), kept)
            .when((part == "..") & (F.size(kept) > 0) & can_pop, F.slice(kept, 1, F.size(kept) - 1))
            .when((part == "..") & path.startswith("/"), kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    rooted = F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    # Most paths are already normal; the component walk runs only for the rest.
    plain = ~path.rlike(r"(?:^|/)\.{0,2}(?:/|$)")
    return F.when(plain, path).when(rooted == "", ".").otherwise(rooted)


def module_of(path: Column) -> Column:
    """First directory of the path, "" for files at the root."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")
