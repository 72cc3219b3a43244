"""Similar names without comparing all of a block: two-character pieces, prefixes and lengths.

One edit changes two pieces at most, so two names within d edits share a piece among the 2 d + 1 rarest of either. Only names that
do, and whose lengths are near enough, are compared; nothing above the threshold is lost, whatever the names' first letters or sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.text import edit_similarity, identity_name
from rosterline.operators.ranked import shared_path

#: A list of names under one piece and length that is longer than that is split.
LIST = 10_000


def _pieces(name: Column) -> Column:
    """Two-character pieces with the name's ends; the second and further of the same kind are numbered, so that each is one of its own."""
    padded = F.concat(F.lit("\0"), name, F.lit("\1"))
    two = F.regexp_extract_all(padded, F.lit("(?s)(?=(..))."), F.lit(1))
    return F.transform(two, lambda p, i: F.concat(p, F.size(F.filter(F.slice(two, 1, i), lambda o: o == p)).cast("string")))


def _edits(length: Column, least: float) -> Column:
    """The most edits between a name of that length and one that is similar enough: such a one has length / least characters at most."""
    longest = F.floor(length / F.lit(least) + F.lit(1e-9))
    return F.floor(longest * F.lit(1 - least) + F.lit(1e-9)).cast("int")


def similar_names(names: DataFrame, name: str, within: list[str], least: float = 0.8) -> DataFrame:
    """Pairs name_a < name_b of different names of the same values of `within`, with T16 similarity of `least` (2/3 or more) or higher.

    Names are taken as they are, each once: rows with equal names are no pairs but one name, so a frequent name costs no more than a rare
    one. Nulls have no pairs, null values of `within` are values. Lists of a piece are split by length and, where they are
    still long, into shares: a share of either side meets every other, so each pair is compared once.
    """
    if not 2 / 3 <= least <= 1:
        raise ValueError("least must be from 2/3 to 1")
    keys = [f"_w{i}" for i in range(len(within))]
    one = names.filter(F.col(name).isNotNull()).select(*(F.col(w).alias(k) for w, k in zip(within, keys, strict=True)), F.col(name).alias("_name")).distinct()
    one = one.withColumn("_length", F.length("_name")).filter("_length > 0")
    flat = one.select("*", F.explode(_pieces(F.col("_name"))).alias("_piece"))
    # Rare pieces first; the order must be the same for all names, no more.
    counts = flat.groupBy("_piece").agg(F.count("*").alias("_n"))
    ranked = flat.join(counts, "_piece").groupBy(*keys, "_name", "_length").agg(F.array_sort(F.collect_list(F.struct("_n", "_piece"))).alias("_all"))  # as many as characters
    prefix = F.transform(F.slice("_all", F.lit(1), 2 * _edits(F.col("_length"), least) + 1), lambda p: p["_piece"])
    rows = ranked.select(*keys, "_name", "_length", prefix.alias("_prefix"))

    under = rows.select("*", F.explode("_prefix").alias("_piece"))
    lists = under.groupBy(*keys, "_piece", "_length").agg(F.ceil(F.count("*") / LIST).cast("int").alias("_shares")).filter("_shares > 1")
    share = lambda of: F.pmod(F.xxhash64(of), F.coalesce("_shares", F.lit(1))).cast("int")
    right = _with_shares(under, lists, keys).withColumn("_share", share("_name")).drop("_shares")
    # A shorter (or equally long) name asks in the lists of all lengths that can be near.
    lengths = F.sequence("_length", F.floor(F.col("_length") / least + 1e-9).cast("int"))
    left = under.select(*keys, F.col("_name").alias("_a"), F.col("_length").alias("_of"), F.col("_prefix").alias("_first"), "_piece", F.explode(lengths).alias("_length"))
    left = _with_shares(left, lists, keys).withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    shared = [*keys, "_piece", "_length", "_share"]
    left = left.select(*(F.col(c).alias(f"_l{c}") for c in shared), "_a", "_of", "_first")
    met = left.join(right, [F.col(f"_l{c}").eqNullSafe(F.col(c)) for c in shared])
    met = met.filter((F.col("_of") < F.col("_length")) | (F.col("_a") < F.col("_name")))
    # Pairs that share several pieces meet under each; the first one counts.
    met = met.filter(F.array_intersect("_first", "_prefix")[0] == F.col("_piece"))
    pairs = met.withColumn("similarity", edit_similarity(F.col("_a"), F.col("_name"))).filter(F.col("similarity") >= least - 1e-12)
    return pairs.select(*(F.col(k).alias(w) for w, k in zip(within, keys, strict=True)), F.least("_a", "_name").alias("name_a"), F.greatest("_a", "_name").alias("name_b"), "similarity")


def _with_shares(rows: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the shares of their list, null for one."""
    named = lists.select(*(F.col(c).alias(f"_l{c}") for c in [*keys, "_piece", "_length"]), "_shares")
    on = [F.col(c).eqNullSafe(F.col(f"_l{c}")) for c in [*keys, "_piece", "_length"]]
    return rows.join(named, on, "left").drop(*(f"_l{c}" for c in [*keys, "_piece", "_length"]))


def people_alike(records: DataFrame, within: list[str], least: float = 0.8) -> DataFrame:
    """Pairs of identity names (T6) that may be one person, with how many records have either.

    Records belong to a name by identity_name(full_name); same_person() over records of such a pair gives R11's confidence. Records are
    read once: they are counted as they are spelled, only spellings are made into names, and the names are written below spark.checkpoint.dir.
    """
    spelled = records.groupBy(*within, "full_name").agg(F.count("*").alias("_spelled"))
    named = spelled.withColumn("_identity", identity_name(F.col("full_name"))).groupBy(*within, "_identity").agg(F.sum("_spelled").alias("_records"))
    path = shared_path(records.sparkSession, "names")
    named.write.parquet(path)
    counts = records.sparkSession.read.schema(named.schema).parquet(path)
    out = similar_names(counts, "_identity", within, least)
    for side in ("a", "b"):
        own = counts.select(*(F.col(w).alias(f"_o{i}") for i, w in enumerate(within)), F.col("_identity").alias("_own"), F.col("_records").alias(f"records_{side}"))
        on = [F.col(w).eqNullSafe(F.col(f"_o{i}")) for i, w in enumerate(within)]
        out = out.join(own, [*on, F.col(f"name_{side}") == F.col("_own")]).drop("_own", *(f"_o{i}" for i in range(len(within))))
    return out
