"""Relational building blocks: projections, merges, lookups and first/last picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions.text import split_team_league


def q(name: str) -> Column:
    """A column by its literal name, symbols and dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalise_header(df: DataFrame) -> DataFrame:
    """Lower case headers without surrounding blanks."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """The frame itself; KeyError if a column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def drop_strict(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns that must be there."""
    return require(df, cols).drop(*cols)


def drop_shared(right: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """The right frame without the columns that the left one has, keys excepted."""
    return right.drop(*(set(left.columns) & set(right.columns) - set(keys)))


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    """Listed columns first if present, the others in their order."""
    head = [c for c in first if c in df.columns]
    return df.select(*[q(c) for c in head + [c for c in df.columns if c not in head]])


def coalesce_pairs(df: DataFrame, stems: list[str], suffixes: tuple[str, str] = ("_pitch", "_bat")) -> DataFrame:
    """Each stem's suffixed columns become one, the first non-null of those that exist."""
    out, gone = [], set()
    for s in stems:
        have = [s + x for x in suffixes if s + x in df.columns]
        if have:
            out.append(F.coalesce(*[q(c) for c in have]).alias(s))
            gone |= set(have)
    return df.select(*[q(c) for c in df.columns if c not in gone], *out)


def columns_like(df: DataFrame, text: str) -> list[str]:
    """Columns whose name holds a text, case aside."""
    return [c for c in df.columns if text.lower() in c.lower()]


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on the keys, right columns that the left has dropped first, key values coalesced."""
    return left.join(drop_shared(right, left, keys), keys, "full")


def null_safe_merge(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Full outer join in which null keys match; shared other columns get the suffixes, and ``_in_left``/``_in_right`` tell the sides."""
    shared = set(left.columns) & set(right.columns) - set(keys)
    ren = lambda df, s, side: df.select(*[q(k).alias(f"_{side}_{i}") for i, k in enumerate(keys)],
                                        *[q(c).alias(c + s if c in shared else c) for c in df.columns if c not in keys], F.lit(True).alias(f"_in_{side}"))
    a, b = ren(left, suffixes[0], "left"), ren(right, suffixes[1], "right")
    on = reduce(lambda x, y: x & y, [F.col(f"_left_{i}").eqNullSafe(F.col(f"_right_{i}")) for i in range(len(keys))])
    j = a.join(b, on, "full")
    key = [F.coalesce(f"_left_{i}", f"_right_{i}").alias(k) for i, k in enumerate(keys)]
    rest = [q(c) for c in j.columns if not c.startswith(("_left_", "_right_", "_in_"))]
    return j.select(*key, *rest, F.coalesce("_in_left", F.lit(False)).alias("_in_left"), F.coalesce("_in_right", F.lit(False)).alias("_in_right"))


def role(pitching: Column, batting: Column) -> Column:
    """Two-Way, Pitcher, Batter or Unknown by which side is there."""
    return F.when(pitching & batting, "Two-Way").when(pitching, "Pitcher").when(batting, "Batter").otherwise("Unknown")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the value of the last row of each non-blank key."""
    return df.where(q(key).isNotNull() & (F.trim(q(key)) != "")).groupBy(q(key).alias(key)).agg(F.max_by(q(value), q(order)).alias(value))


def first_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the value of the first row of each key."""
    return df.where(q(key).isNotNull()).groupBy(q(key).alias(key)).agg(F.min_by(q(value), q(order)).alias(value))


def lookup(df: DataFrame, column: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """``column`` replaced by the table's value where its key is found. The table is joined, not hinted: Spark broadcasts
    it while its size allows."""
    t = table.select(q(key).alias("_k"), q(value).alias("_v"))
    return df.join(t, q(column) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", q(column))).drop("_k", "_v")


def not_containing(c: Column, text: str) -> Column:
    """True unless the text is in the value; null values are kept."""
    return ~F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def valid_labels(df: DataFrame, label: str) -> DataFrame:
    """``df`` with team and league of labels ``Team (League)``; malformed ones, those without a team or a league, and divisions are left out."""
    team, league = split_team_league(q(label))
    d = df.withColumns({"team": team, "league": league})
    return d.where((F.col("team") != "") & (F.col("league") != "") & ~F.lower("team").startswith("division"))


#: Letters of the pieces on which texts and the names that hold them meet.
PIECE = 3


def _pieces(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substring(c, i, F.lit(n))))


def contains_first(values: DataFrame, value: str, names: DataFrame, name: str, order: str) -> DataFrame:
    """(value, name): for each value the first name, by ``order``, that contains it literally; values that none contains are left out.

    A name that contains a value has all the value's pieces of ``PIECE`` letters, so both meet on the one of them that
    fewest names have; shorter values meet on themselves and an empty one on the first letters. No pair is formed without a piece in common."""
    v = values.select(q(value).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    n = names.select(q(name).alias("_n"), q(order).alias("_o")).where(F.col("_n").isNotNull())
    long = F.length("_v") >= PIECE
    held = n.select("_n", "_o", F.explode(F.array_union(F.array(F.lit("")), F.flatten(F.array(*[_pieces(F.col("_n"), k) for k in range(1, PIECE + 1)])))).alias("_p")).distinct()
    rare = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    asked = v.select("_v", F.explode(F.when(long, _pieces(F.col("_v"), PIECE)).otherwise(F.array("_v"))).alias("_p"))
    # a piece that no name has rules the value out; else the rarest one is asked for
    best = asked.join(rare, "_p", "left").groupBy("_v").agg(F.every(F.col("_c").isNotNull()).alias("_ok"), F.min(F.struct("_c", "_p")).alias("_b"))
    met = best.where("_ok").select("_v", F.col("_b._p").alias("_p")).join(held, "_p").where(F.col("_n").contains(F.col("_v")))
    return met.groupBy("_v").agg(F.min_by("_n", "_o").alias(name)).withColumnRenamed("_v", value)


def fallback_names(df: DataFrame, column: str, full: str, names: DataFrame, name: str, order: str, mapping: DataFrame, old: str, new: str, mapping_order: str) -> DataFrame:
    """``df`` with ``full`` filled where it is null: the key in ``column`` is looked up in ``mapping`` (first of repeated old names), and the
    first of ``names`` that contains the new name literally is taken. Keys compare without case and surrounding blanks; a blank
    key or new name finds nothing."""
    key = lambda c: F.lower(F.trim(q(c)))
    gone = df.where(q(full).isNull() & (key(column) != "")).select(key(column).alias("_k")).distinct()
    m = mapping.where((key(old) != "") & (F.trim(q(new)) != "")).groupBy(key(old).alias("_k")).agg(F.min_by(q(new), q(mapping_order)).alias("_new"))
    wanted = gone.join(m, "_k")
    hits = contains_first(wanted, "_new", names, name, order).withColumnRenamed(name, "_hit")
    found = wanted.join(hits, "_new").select("_k", "_hit")
    on = (key(column) == F.col("_k")) & q(full).isNull()
    out = df.join(found, on, "left").withColumn(full, F.coalesce(q(full), F.col("_hit")))
    return out.select(*[q(c) for c in df.columns])


def frequent(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys that occur more than so often."""
    return df.where(q(key).isNotNull()).groupBy(q(key).alias(key)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
