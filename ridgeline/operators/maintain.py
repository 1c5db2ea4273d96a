"""Index maintenance as relational algebra over vectors or postings.

Ids are explicit and never shift.  Removal and update are anti-joins, merging is a union
of tables whose specifications agree, sub-setting is a filter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_total

# --- selectors ------------------------------------------------------------------------


@dataclass(frozen=True)
class IdRange:
    """lo <= id < hi"""

    lo: int
    hi: int

    def condition(self) -> Column:
        return (F.col("id") >= self.lo) & (F.col("id") < self.hi)


@dataclass(frozen=True)
class IdArray:
    ids: tuple[int, ...]

    def condition(self) -> Column:
        return F.col("id").isin(list(self.ids))


@dataclass(frozen=True)
class IdTable:
    """Ids in a table of any size."""

    table: DataFrame


def remove_ids(df: DataFrame, selector) -> DataFrame:
    if isinstance(selector, IdTable):
        return df.join(selector.table.select("id"), "id", "left_anti")
    return df.filter(~selector.condition())


def keep_ids(df: DataFrame, selector) -> DataFrame:
    if isinstance(selector, IdTable):
        return df.join(selector.table.select("id"), "id", "left_semi")
    return df.filter(selector.condition())


def update_vectors(df: DataFrame, updates: DataFrame, assign=None) -> DataFrame:
    """Rows of the same ids replaced; ``assign`` gives updates their list.  Ids that are
    not there are not added."""
    known = updates.join(df.select("id"), "id", "left_semi")
    new = assign(known) if assign else known
    return df.join(updates.select("id"), "id", "left_anti").unionByName(new.select(df.columns))


def shift_ids(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("id", F.col("id") + F.lit(by))


def merge(a: DataFrame, b: DataFrame, add_id: int = 0, specs: tuple | None = None) -> DataFrame:
    """Rows of both; ids of b shifted.  ``specs`` must be equal if given."""
    if specs and specs[0] != specs[1]:
        raise ValueError(f"cannot merge {specs[0]!r} with {specs[1]!r}")
    return a.unionByName(shift_ids(b, add_id) if add_id else b)


def copy_subset(df: DataFrame, kind: str, a1: int, a2: int) -> DataFrame:
    """kind ``range``: a1 <= id < a2; ``modulo``: id % a1 = a2; ``share``: the part from
    a1 to a2 of all rows, cut proportionally in each list (in the order of ids)."""
    if kind == "range":
        return df.filter((F.col("id") >= a1) & (F.col("id") < a2))
    if kind == "modulo":
        return df.filter(F.pmod("id", F.lit(a1)) == a2)
    if kind != "share":
        raise ValueError(f"unknown kind {kind!r}")
    from pyspark.sql import Window as W

    total = df.count()
    sizes = df.groupBy("list_no").agg(F.count(F.lit(1)).alias("_n"))  # one row per list
    ends = running_total(sizes, "list_no", F.col("_n"), "_end")
    cut = lambda a: F.floor(F.col("_end") * a / max(total, 1)) - F.floor((F.col("_end") - F.col("_n")) * a / max(total, 1))
    shares = ends.select("list_no", cut(a1).alias("_lo"), cut(a2).alias("_hi"))
    place = F.row_number().over(W.partitionBy("list_no").orderBy("id")) - 1
    rows = df.withColumn("_place", place).join(shares, "list_no")
    return rows.filter((F.col("_place") >= F.col("_lo")) & (F.col("_place") < F.col("_hi"))).select(df.columns)


# --- list algebra ---------------------------------------------------------------------


def stack_horizontally(parts: list[DataFrame]) -> DataFrame:
    """Same lists, concatenated."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stack_vertically(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Lists of each part after those of the parts before: (postings, number of lists)."""
    out, at = None, 0
    for p, nlist in parts:
        moved = p.withColumn("list_no", (F.col("list_no") + at).cast("int"))
        out = moved if out is None else out.unionByName(moved)
        at += nlist
    return out


def slice_lists(df: DataFrame, i0: int, i1: int) -> DataFrame:
    """Lists i0 <= list_no < i1, numbered from 0."""
    return df.filter((F.col("list_no") >= i0) & (F.col("list_no") < i1)).withColumn("list_no", (F.col("list_no") - i0).cast("int"))


def mask_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Lists of ``first``; where one is empty, that of ``second``."""
    return first.unionByName(second.join(first.select("list_no").distinct(), "list_no", "left_anti").select(first.columns))


def stop_lists(df: DataFrame, max_size: int) -> DataFrame:
    """Without lists of more than max_size rows."""
    few = df.groupBy("list_no").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= max_size)
    return df.join(few.select("list_no"), "list_no", "left_semi")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids): ids of rows with equal keys, groups of two and more.  Group sizes are
    found first, so only ids of real groups travel."""
    several = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return df.join(several, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids"))


# --- sliding window of slices ---------------------------------------------------------


@dataclass
class SlidingWindow:
    """Rows of the newest slices; ``step`` appends a slice and may drop the oldest."""

    slices: list[DataFrame] = field(default_factory=list)

    def step(self, new: DataFrame | None, remove_oldest: bool) -> SlidingWindow:
        if remove_oldest and not self.slices:
            raise ValueError("no slice to remove")
        kept = self.slices[1:] if remove_oldest else self.slices
        return SlidingWindow(kept + ([new] if new is not None else []))

    def rows(self) -> DataFrame:
        return stack_horizontally(self.slices)

    def list_ends(self) -> DataFrame:
        """(list_no, slice, size, end): cumulative sizes by list over the window."""
        from pyspark.sql import Window as W

        tagged = [s.groupBy("list_no").agg(F.count(F.lit(1)).alias("size")).withColumn("slice", F.lit(i)) for i, s in enumerate(self.slices)]
        sizes = stack_horizontally(tagged)
        return sizes.withColumn("end", F.sum("size").over(W.partitionBy("list_no").orderBy("slice").rowsBetween(W.unboundedPreceding, 0)))


def window_of(df: DataFrame, slice_col: str, newest: int, n: int) -> DataFrame:
    """The n newest slices up to ``newest`` of a table with a slice column."""
    return df.filter((F.col(slice_col) > newest - n) & (F.col(slice_col) <= newest))
