"""Changes of tables as pure transforms from old rows and new rows to the next snapshot; `colloquy.sources.store` commits snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put in or over; of the columns `keep` an existing row's value stays. new has one row a key."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in old.columns])
    cond = [old[k].eqNullSafe(n[f"n_{k}"]) for k in keys]
    j = old.withColumn("_old", F.lit(True)).join(n.withColumn("_new", F.lit(True)), cond, "full_outer")
    pick = lambda c: F.when(F.col("_new").isNull(), F.col(c)).when(F.col("_old").isNotNull() & F.lit(c in keep), F.col(c)).otherwise(F.col(f"n_{c}"))
    return j.select(*[pick(c).alias(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def insert_checked(old: DataFrame, new: DataFrame, keys: list[str], parents: dict[str, DataFrame]) -> DataFrame:
    """insert_absent, but KeyError if a value of a column of new is missing in its parent table (a one-column frame)."""
    for column, parent in parents.items():
        p = parent.toDF(column)
        missing = new.select(column).join(p, column, "left_anti").limit(1).collect()
        if missing:
            raise KeyError(f"{column} {missing[0][0]!r} is unknown")
    return insert_absent(old, new.dropDuplicates(keys), keys)


def update_newer(old: DataFrame, new: DataFrame, key: str, stamp: str, columns: list[str]) -> DataFrame:
    """old with columns and stamp of new where old's stamp is NULL or older."""
    n = new.select(F.col(key).alias("n_key"), *[F.col(c).alias(f"n_{c}") for c in [*columns, stamp]])
    j = old.join(n, old[key] == n["n_key"], "left")
    newer = F.col("n_key").isNotNull() & (F.col(stamp).isNull() | (F.col(stamp) < F.col(f"n_{stamp}")))
    return j.select(*[F.when(newer, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in (*columns, stamp) else F.col(c) for c in old.columns])


def delete(df: DataFrame, keys: DataFrame, on: list[str], condition: Column | None = None) -> DataFrame:
    """df without the rows whose key is in keys (and for which condition holds)."""
    if condition is None:
        return df.join(keys.select(*on).distinct(), on, "left_anti").select(*df.columns)
    marked = df.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return marked.where(~(F.coalesce("_hit", F.lit(False)) & F.coalesce(condition, F.lit(False)))).drop("_hit").select(*df.columns)


def deleted_counts(tables: dict[str, DataFrame], keys: DataFrame, on: list[str]) -> DataFrame:
    """(table_name, deleted): how many rows a cascade over the tables takes away."""
    out = None
    for name, df in tables.items():
        n = df.join(keys.select(*on).distinct(), on, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        out = n if out is None else out.unionAll(n)
    return out


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """listing (file_path, file_size, mtime_ns) with `change`: new, backfill (no time stored), changed (time and size differ), touched (only the time), same."""
    s = state.select(F.col("file_path").alias("s_path"), F.col("file_size").alias("s_size"), F.col("mtime_ns").alias("s_mtime"))
    j = listing.join(s, listing["file_path"] == s["s_path"], "left")
    change = F.when(F.col("s_path").isNull(), "new").when(F.coalesce("s_mtime", F.lit(0)) == 0, "backfill").when(F.col("s_mtime") == F.col("mtime_ns"), "same").when(F.col("s_size").eqNullSafe(F.col("file_size")), "touched").otherwise("changed")
    return j.select(*listing.columns, change.alias("change"))


def appended(old_max: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """new with `sequence` that goes on after the key's largest one in old_max (key, sequence); numbers run within a key only."""
    w = Window.partitionBy(key).orderBy(order)
    m = old_max.select(F.col(key).alias("m_key"), F.col("sequence").alias("m_seq"))
    j = new.join(m, new[key] == m["m_key"], "left")
    return j.withColumn("sequence", (F.coalesce("m_seq", F.lit(-1)) + F.row_number().over(w)).cast("int")).drop("m_key", "m_seq")
