"""Exact ranks and rank cuts that never sort a whole table, or a whole group, in one task.

Rows are ordered by an md5 of (seed, key).  The first hex digits of that hash split every group
into even buckets in rank order, so a group with a third of all rows is spread like any other.
Counts per bucket give the rank at which each bucket starts; only rows inside a bucket have to be
sorted, and a cut has to look only into the bucket that holds it.

``key`` must identify a row: rows with equal keys are interchangeable to every function here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelkit.functions.hashing import hash_order
from labelkit.operators.bounded import MAX_LOCAL_ROWS, local_copy
from labelkit.session import written

# Hex digits of the hash that name a bucket: where rows are ranked, and where a cut is looked for
# first. A cut bucket with more rows than SORT_ROWS is looked into by REFINE_DIGITS more.
RANK_DIGITS = 3
CUT_DIGITS = 2
REFINE_DIGITS = 3
SORT_ROWS = 4_000_000

# Selection by rank: rows of a group that are ordered in one window at last, and rows of a group that are
# looked at to guess where the wanted one lies.
SELECT_ROWS = 100_000
SELECT_SAMPLE = 4_000


def _names(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _group_key(name: str) -> Column:
    """Group value as text that also tells null from empty, so groups join and partition by plain equality."""
    return F.coalesce(F.concat(F.lit("v"), F.col(name).cast("string")), F.lit("n"))


def _group_keys(by: list[str]) -> dict[str, Column]:
    return {f"__g{i}": _group_key(c) for i, c in enumerate(by)} or {"__g0": F.lit("all")}


def _keyed(df: DataFrame, key: str, by: list[str], seed: int) -> DataFrame:
    """Narrow table: group keys as __g0.., order hash, row key."""
    groups = [column.alias(name) for name, column in _group_keys(by).items()]
    return df.select(*groups, hash_order(seed, key).alias("h"), F.col(key).alias("k"))


def _bucket(digits: int) -> Column:
    return F.substring("h", 1, digits)


def _bucket_starts(keyed: DataFrame, groups: list[str], digits: int) -> DataFrame:
    """Rows before each bucket and rows of the whole group; at most 16**digits rows per group."""
    order = Window.partitionBy(*groups).orderBy("b")
    whole = Window.partitionBy(*groups)
    sizes = keyed.groupBy(*groups, _bucket(digits).alias("b")).agg(F.count("*").alias("in_bucket"))
    upto = F.sum("in_bucket").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumns(
        {"before": upto - F.col("in_bucket"), "n": F.sum("in_bucket").over(whole)}
    )


def group_rank(
    df: DataFrame,
    key: str,
    by: str | Sequence[str] | None = None,
    seed: int = 42,
    rank: str = "rank",
    digits: int = RANK_DIGITS,
) -> DataFrame:
    """1-based rank of every row in its group's seeded shuffle order.

    One shuffle of the rows, on (group, bucket); the bucket table is joined on the same columns.
    """
    by = _names(by)
    groups = list(_group_keys(by))
    rows = df.withColumns({**_group_keys(by), "__h": hash_order(seed, key)}).withColumn(
        "__b", F.substring("__h", 1, digits)
    )
    starts = _bucket_starts(_keyed(df, key, by, seed), groups, digits).select(
        *groups, F.col("b").alias("__b"), F.col("before").alias("__before")
    )
    if not by:
        starts = F.broadcast(starts)  # at most 16**digits rows
    inside = Window.partitionBy(*groups, "__b").orderBy("__h", F.col(key))
    ranked = rows.join(starts, [*groups, "__b"], "inner").withColumn(
        rank, (F.col("__before") + F.row_number().over(inside)).cast("bigint")
    )
    return ranked.select(*[c for c in df.columns if c != rank], rank)


def global_rank(df: DataFrame, key: str, seed: int = 42, rank: str = "rank") -> DataFrame:
    """Exact 1-based rank over the whole table."""
    return group_rank(df, key, None, seed, rank)


def _holds_cut() -> Column:
    return (F.col("at") > F.col("before")) & (F.col("at") <= F.col("before") + F.col("in_bucket"))


def _cut_buckets(
    keyed: DataFrame, groups: list[str], cuts: Sequence[Callable[[Column], Column]], digits: int
) -> DataFrame:
    """The bucket that holds each cut: (groups, b, before, in_bucket, cut, at)."""
    n = F.col("n").cast("double")
    wanted = F.array(*[cut(n).cast("bigint") for cut in cuts])
    return (
        _bucket_starts(keyed, groups, digits)
        .select(*groups, "b", "in_bucket", "before", F.posexplode(wanted).alias("cut", "at"))
        .where(_holds_cut())
    )


def _refined(keyed: DataFrame, found: DataFrame, groups: list[str], digits: int) -> DataFrame:
    """The same cuts in buckets of more digits; only rows of the cut buckets are counted."""
    inside = keyed.withColumn("b", _bucket(digits)).join(found.drop("in_bucket"), [*groups, "b"], "inner")
    sizes = inside.groupBy(*groups, "cut", "at", "before", _bucket(digits + REFINE_DIGITS).alias("b")).agg(
        F.count("*").alias("in_bucket")
    )
    order = Window.partitionBy(*groups, "cut").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("in_bucket").over(order)
    return sizes.withColumn("before", F.col("before") + upto - F.col("in_bucket")).where(_holds_cut())


def _thresholds(
    keyed: DataFrame, groups: list[str], cuts: Sequence[Callable[[Column], Column]], digits: int
) -> DataFrame:
    """Per group, the (hash, key) of the last row of each cut: columns __t0, __t1, ..

    A cut of zero rows has no such row and gives null.
    """
    found = _cut_buckets(keyed, groups, cuts, digits)
    local = local_copy(found)
    if local is None:  # too many groups to look at: refine once in any case
        found, digits = _refined(keyed, found, groups, digits), digits + REFINE_DIGITS
    else:
        found = local
        while digits < 32 and found.where(F.col("in_bucket") > SORT_ROWS).limit(1).count():
            # no more rows than there were buckets, so the copy fits again
            found, digits = local_copy(_refined(keyed, found, groups, digits)), digits + REFINE_DIGITS
    inside = Window.partitionBy(*groups, "b", "cut").orderBy("h", "k")
    last = (
        keyed.withColumn("b", _bucket(digits))
        .join(found.drop("in_bucket"), [*groups, "b"], "inner")
        .withColumn("r", F.col("before") + F.row_number().over(inside))
        .where(F.col("r") == F.col("at"))
    )
    return last.groupBy(*groups).agg(
        *[
            F.first(F.when(F.col("cut") == i, F.struct("h", "k")), ignorenulls=True).alias(f"__t{i}")
            for i in range(len(cuts))
        ]
    )


def split_at(
    df: DataFrame,
    key: str,
    cuts: Sequence[Callable[[Column], Column]],
    names: Sequence[str],
    by: str | Sequence[str] | None = None,
    seed: int = 42,
    column: str = "split",
    digits: int = CUT_DIGITS,
) -> DataFrame:
    """Name the part each row falls in when its group is cut at the given ranks.

    ``cuts`` are rising functions of the group size, ``names`` has one more entry than ``cuts``.
    Two passes over (group, key), more only for very large groups, find the last row of each part;
    the table itself is then labelled by comparing hashes in a map-only pass, so wide rows are not
    shuffled.  With more groups than
    fit a checked local table the thresholds are joined by shuffle.
    """
    by = _names(by)
    groups = list(_group_keys(by))
    limits = _thresholds(_keyed(df, key, by, seed), groups, cuts, digits)
    local = local_copy(limits)
    place = F.struct(hash_order(seed, key).alias("h"), F.col(key).alias("k"))

    def part(bounds: Sequence[Column]) -> Column:
        chosen = F.lit(names[-1])
        for bound, name in reversed(list(zip(bounds, names))):
            chosen = F.when(F.coalesce(place <= bound, F.lit(False)), F.lit(name)).otherwise(chosen)
        return chosen

    if local is None or by:
        found = limits if local is None else local
        joined = df.withColumns(_group_keys(by)).join(found, groups, "left")
        labelled = joined.withColumn(column, part([F.col(f"__t{i}") for i in range(len(cuts))]))
        return labelled.drop(*groups, *[f"__t{i}" for i in range(len(cuts))])
    row = local.first()
    key_type = df.schema[key].dataType

    def literal(i: int) -> Column:
        bound = row[f"__t{i}"] if row is not None else None
        if bound is None:
            return F.lit(None).cast(local.schema[f"__t{i}"].dataType) if row is not None else F.lit(None)
        return F.struct(F.lit(bound["h"]).alias("h"), F.lit(bound["k"]).cast(key_type).alias("k"))

    if row is None:
        return df.withColumn(column, F.lit(names[-1]))
    return df.withColumn(column, part([literal(i) for i in range(len(cuts))]))


def top_n_per_group(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[Column],
    n: int,
    salts: int = 64,
) -> DataFrame:
    """First ``n`` rows of each group.

    A group is ranked in ``salts`` independent parts first, so the task that finishes a hot group
    sees at most ``salts * n`` of its rows.  Both filters are pruned before their shuffle by
    Spark's window group limit.
    """
    by = _names(by)
    order = list(order)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = Window.partitionBy(*by, "__salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (
        salted.withColumn("__rn", F.row_number().over(part))
        .where(F.col("__rn") <= n)
        .withColumn("__rn", F.row_number().over(whole))
        .where(F.col("__rn") <= n)
        .drop("__rn", "__salt")
    )


def _place(df: DataFrame, order: Sequence[Column]) -> Column:
    """Total order of rows: the order columns, then a hash of the row. Rows of equal place are copies of each other."""
    hashed = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.xxhash64(*hashed)])])


def _inside() -> Column:
    return (F.col("lo").isNull() | (F.col("place") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("place") <= F.col("hi")))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast copy of at most ``MAX_LOCAL_ROWS`` rows, or a written table where there are more groups."""
    rows = df.limit(MAX_LOCAL_ROWS + 1).collect()
    if len(rows) > MAX_LOCAL_ROWS:
        return written(df, "places")
    schema = T.StructType.fromJson(json.loads(df.schema.json().replace('"nullable":false', '"nullable":true')))
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _narrowed(narrow: DataFrame, state: DataFrame, groups: list[str], rows: int, turn: int) -> DataFrame:
    """The state with a smaller range for groups that still have more than ``rows`` rows in theirs.

    A sample of the range gives two places that very likely enclose the wanted one; counting tells in which
    of the three parts it lies, so the answer is exact whatever the sample.
    """
    inside = narrow.join(state.where(F.col("left") > rows), groups).where(_inside())
    draw = F.pmod(F.xxhash64("place", F.lit(turn)), F.lit(1 << 30)) * F.col("left") < F.lit((1 << 30) * SELECT_SAMPLE)
    looked = inside.where(draw).groupBy(*groups, "want", "left").agg(F.array_sort(F.collect_list("place")).alias("seen"))
    at = F.col("want") / F.col("left") * F.size("seen")
    margin = 3 * F.sqrt(F.size("seen")) + 1
    below, above = F.floor(at - margin).cast("int"), F.ceil(at + margin).cast("int")
    guessed = looked.select(*groups, F.when(below >= 0, F.get("seen", below)).alias("a"), F.get("seen", above).alias("b"))
    cuts = _small(state.join(guessed, groups, "left"))
    counted = narrow.join(cuts.where(F.col("left") > rows), groups).where(_inside())
    upto_a = F.coalesce(F.col("place") <= F.col("a"), F.lit(False))
    upto_b = F.coalesce(F.col("place") <= F.col("b"), F.lit(True))
    sizes = counted.groupBy(*groups).agg(F.count_if(upto_a).alias("under"), F.count_if(~upto_a & upto_b).alias("mid"))
    found = cuts.join(sizes, groups, "left")
    low = F.col("want") <= F.col("under")
    high = F.col("want") > F.col("under") + F.col("mid")
    part = lambda name, first, second, third: (
        F.when(F.col("under").isNull(), F.col(name)).when(low, first).when(high, third).otherwise(second).alias(name)
    )
    return _small(
        found.select(
            *groups,
            part("lo", F.col("lo"), F.coalesce("a", "lo"), F.col("b")),
            part("hi", F.col("a"), F.coalesce("b", "hi"), F.col("hi")),
            part("left", F.col("under"), F.col("mid"), F.col("left") - F.col("under") - F.col("mid")),
            part("want", F.col("want"), F.col("want") - F.col("under"), F.col("want") - F.col("under") - F.col("mid")),
        )
    )


def _nth_places(narrow: DataFrame, groups: list[str], n: int, rows: int) -> DataFrame:
    """(groups, t, ties, keep): place of the n-th row of each group that has one, how many rows share it, and how many of
    them are among the first n.  ``narrow`` is (groups, place).

    Counted cuts narrow a range around the n-th row until it holds few rows, or copies of one row only, which are
    counted and not sorted.  So no window holds a group, however large the group or n.
    """
    none = F.lit(None).cast(narrow.schema["place"].dataType)
    sizes = narrow.groupBy(*groups).agg(F.count("*").alias("left")).where(F.col("left") >= n)
    state = _small(sizes.select(*groups, none.alias("lo"), none.alias("hi"), "left", F.lit(n).cast("bigint").alias("want")))
    turn, before = 0, None
    while (most := state.agg(F.sum(F.when(F.col("left") > rows, F.col("left")))).first()[0]) and most != before:
        state, turn, before = _narrowed(narrow, state, groups, rows, turn), turn + 1, most
    order = Window.partitionBy(*groups).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    places = narrow.join(state, groups).where(_inside()).groupBy(*groups, "place", "want").agg(F.count("*").alias("ties"))
    passed = places.withColumn("upto", F.sum("ties").over(order)).withColumn("keep", F.col("want") - F.col("upto") + F.col("ties"))
    at = passed.where((F.col("keep") > 0) & (F.col("upto") >= F.col("want")))
    return _small(at.select(*groups, F.col("place").alias("t"), "ties", "keep"))


_BOUND = {"t": "__t", "ties": "__ties", "keep": "__keep"}


def first_of_groups(
    df: DataFrame, by: str | Sequence[str] | None, order: Sequence[Column], n: int, rows: int = SELECT_ROWS
) -> DataFrame:
    """First ``n`` rows of each group (of the table where ``by`` is None), by ascending order columns, then a hash of the row.

    The n-th row's place is found by counting, and the table is then filtered by comparing places, so wide rows
    are not shuffled, and neither a group nor the n rows kept meet in one task.
    """
    keys = _group_keys(_names(by))
    groups = list(keys)
    placed = df.withColumns({**keys, "__place": _place(df, order)})
    bounds = _nth_places(placed.select(*groups, F.col("__place").alias("place")), groups, n, rows).withColumnsRenamed(_BOUND)
    marked = placed.join(bounds, groups, "left")
    kept = marked.where(F.col("__t").isNull() | (F.col("__place") < F.col("__t")) | ((F.col("__place") == F.col("__t")) & (F.col("__ties") == F.col("__keep"))))
    # of copies of one row that are not all kept, one is shown as often as it is kept
    copies = marked.where((F.col("__place") == F.col("__t")) & (F.col("__ties") > F.col("__keep")))
    if bounds.where("__ties > __keep").isEmpty():
        return kept.select(*df.columns)
    one = copies.groupBy(*groups, "__keep").agg(F.first(F.struct(*df.columns)).alias("row"))
    again = one.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "__keep"))).select("row.*")
    return kept.select(*df.columns).unionByName(again)


def row_of_rank(df: DataFrame, order: Sequence[Column], rank: int, rows: int = SELECT_ROWS) -> DataFrame:
    """The row with the given 1-based rank; no row where there are fewer."""
    placed = df.withColumns({**_group_keys([]), "__place": _place(df, order)})
    bounds = _nth_places(placed.select("__g0", F.col("__place").alias("place")), ["__g0"], rank, rows).withColumnsRenamed(_BOUND)
    found = placed.join(bounds, "__g0").where(F.col("__place") == F.col("__t"))
    return found.agg(F.first(F.struct(*df.columns)).alias("row")).where("row IS NOT NULL").select("row.*")


def order_range(order: str, width: int) -> Column:
    """Start of the range of ``width`` order values a row lies in (exact for whole numbers)."""
    return F.col(order) - F.pmod(F.col(order), F.lit(width))


def next_in_group(
    df: DataFrame,
    by: str,
    order: str,
    columns: Sequence[str],
    width: int = 1024,
    prefix: str = "next_",
    keep_range: bool = False,
) -> DataFrame:
    """The given columns of the row that follows within its group, by a whole-number order column.

    As ``lead`` over the group, but the group is cut into ranges of ``width`` order values, so no
    task holds a whole group and the rows are shuffled once, on (group, range).  The first row of
    a later range is shown to the range before it; a pass over (group, order) finds those rows,
    which are none for groups shorter than a range.
    """
    payload = F.struct(F.lit(True).alias("there"), *[F.col(c) for c in columns])
    rows = df.withColumns({"__range": order_range(order, width), "__own": F.lit(True)})
    firsts = df.select(by, order, order_range(order, width).alias("__range")).groupBy(by, "__range").agg(
        F.min(order).alias(order)
    )
    previous = F.lag("__range").over(Window.partitionBy(by).orderBy("__range"))
    edges = firsts.withColumn("__before", previous).where("__before IS NOT NULL").select(by, order, "__before")
    local = local_copy(edges)
    if local is None or local.count():
        guests = df.join(edges if local is None else F.broadcast(local), [by, order], "inner")
        rows = rows.unionByName(
            guests.withColumns({"__range": F.col("__before"), "__own": F.lit(False)}).drop("__before")
        )
    lead = F.lead(payload).over(Window.partitionBy(by, "__range").orderBy(order))
    found = rows.withColumn("__next", lead).where("__own")
    return found.select(
        *df.columns,
        *[F.col("__next")[c].alias(prefix + c) for c in columns],
        *(["__range"] if keep_range else []),
    )
