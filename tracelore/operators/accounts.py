"""Account analytics over the star schema, and keyed loads of its nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore.operators.segments import top_per_key


def upsert_nodes(state: DataFrame, rows: DataFrame, key: str, now: Column, insert_only: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Next snapshot: given properties overwrite, insert-only ones stay, untouched rows stay."""
    given = [c for c in rows.columns if c != key]
    new = rows.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"n_{c}") for c in given])
    j = state.join(new, key, "full_outer")
    hit = F.coalesce("__hit", F.lit(False))
    columns: list[Column] = [F.col(key)]
    for c in dict.fromkeys([*state.columns, *given, *insert_only, "updated_at"]):
        if c == key:
            continue
        old = F.col(c) if c in state.columns else F.lit(None)
        if c in insert_only:
            value = F.coalesce(old, F.when(hit, now))
        elif c == "updated_at":
            value = F.when(hit, now).otherwise(old)
        elif c in given:
            value = F.when(hit, F.col(f"n_{c}")).otherwise(old)
        else:
            value = old
        columns.append(value.alias(c))
    return j.select(*columns)


def refresh_edges(existing: DataFrame, fresh: DataFrame, keys: list[str], owner: str = "seed") -> DataFrame:
    """Edges this load owns are dropped and rebuilt from ``fresh``, others stay; one per key."""
    mine = fresh.withColumn("source", F.lit(owner)).dropDuplicates(keys)
    others = existing.filter(F.coalesce("source", F.lit("")) != owner)
    return others.unionByName(mine.select(*others.columns))


def latest_usage(usage: DataFrame) -> DataFrame:
    """Rows of the newest month of each (account, sku); utilisation to three places, null at zero seats."""
    newest = Window.partitionBy("account_id", "sku").orderBy(F.col("month").desc())
    seats = F.col("contracted_seats")
    # The rank limit is applied before the shuffle as well, and usage is scanned once.
    return usage.filter("month IS NOT NULL").withColumn("__at", F.rank().over(newest)).filter("__at = 1").drop("__at").withColumn(
        "utilization", F.when(F.coalesce(seats, F.lit(0.0)) != 0, F.round(F.col("mau") / seats, 3))
    )


def arr_band(arr: Column) -> Column:
    return (
        F.when(arr < 100_000, "<100k").when(arr < 500_000, "100k-500k").when(arr < 1_000_000, "500k-1m").when(arr < 5_000_000, "1m-5m").otherwise("5m+")
    )


def finalize_accounts(accounts: DataFrame, usage: DataFrame) -> DataFrame:
    """Yearly revenue and band, seats, mean utilisation, health clipped to 5..99 (the jitter is a column)."""
    lines = latest_usage(usage).groupBy("account_id").agg(
        F.sum("monthly_revenue").alias("mrr"), F.sum("contracted_seats").alias("seats_total"), # Utilisation has three places: summing thousandths keeps the mean exact.
        (F.sum(F.round(F.col("utilization") * 1000)) / F.count("utilization") / 1000).alias("avg_util"),
    )
    base = F.when(F.col("trajectory") == "expanding", 84).when(F.col("trajectory") == "steady", 73).when(F.col("trajectory") == "new", 64).otherwise(38)
    util = F.coalesce("avg_util", F.lit(0.0))
    health = F.floor(F.greatest(F.lit(5.0), F.least(F.lit(99.0), base + (util - 0.8) * 15 + F.col("health_jitter"))))
    arr = F.round(F.coalesce("mrr", F.lit(0.0)) * 12, 2)
    return accounts.drop("health_score").join(lines, "account_id", "left").select(
        *[F.col(c) for c in accounts.columns if c != "health_score"], arr.alias("arr"), arr_band(arr).alias("arr_band"),
        F.coalesce("seats_total", F.lit(0.0)).alias("seats_total"), F.round(util, 3).alias("avg_utilization"), health.alias("health_score"),
    )


def usage_edges(usage: DataFrame) -> DataFrame:
    return latest_usage(usage).select("account_id", "sku", "month", "mau", "contracted_seats", "utilization", "monthly_revenue")


def expansion(usage: DataFrame, accounts: DataFrame) -> DataFrame:
    return usage_edges(usage).filter("utilization >= 1.0").join(accounts.select("account_id", "name", "owner"), "account_id")


def falling_use(usage: DataFrame) -> DataFrame:
    """(account_id, falling): whether the slope of units over months is below zero. Its sign is that of n * sum(xy) - sum(x) * sum(y), told from units as decimals
    of six places, so a flat line is flat in whatever order its months are read; rounding would decide it otherwise. Units that are no such decimal leave the
    account to the slope as it is."""
    month = F.year("month") * 12 + F.month("month")
    units = F.col("mau").try_cast("decimal(24, 6)")
    said = F.col("month").isNotNull() & F.col("mau").isNotNull()
    sums = usage.groupBy("account_id", "month").agg(F.sum("mau").alias("mau")).filter(said).groupBy("account_id").agg(
        F.count("*").alias("n"), F.sum(month.cast("long")).alias("x"), F.sum(units).alias("y"), F.sum(month.cast("decimal(10, 0)") * units).alias("xy"),
        F.bool_or(units.isNull()).alias("odd"), F.regr_slope("mau", month.cast("double")).alias("slope"),
    )
    falling = F.when(F.col("odd"), F.col("slope") < 0).otherwise(F.col("n") * F.col("xy") < F.col("x") * F.col("y"))
    return sums.select("account_id", F.coalesce(falling, F.lit(False)).alias("falling"))


def renewal_risk(accounts: DataFrame, usage: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Renewal within ``days`` and at risk, unhealthy, falling use, or a line at zero."""
    zero = latest_usage(usage).groupBy("account_id").agg(F.bool_or(F.col("mau") == 0).alias("dead_line"))
    soon = accounts.filter(F.datediff("renewal_date", as_of).between(0, days))
    rows = soon.join(falling_use(usage), "account_id", "left").join(zero, "account_id", "left")
    falling = F.coalesce("falling", F.lit(False))
    dead = F.coalesce("dead_line", F.lit(False))
    why = F.concat_ws(
        "+", F.when(F.col("trajectory") == "at_risk", "at_risk"), F.when(F.col("health_score") < 50, "health"), F.when(falling, "falling"), F.when(dead, "dead_line")
    )
    return rows.withColumn("reasons", why).filter("reasons <> ''")


#: Catalogue items in one part.
PART_SKUS = 512


def whitespace(accounts: DataFrame, products: DataFrame, usage: DataFrame) -> DataFrame:
    """(account_id, sku) of catalogue items an account does not use. The catalogue is cut by hash into parts of about ``PART_SKUS`` items, and
    an account's own items of a part are subtracted from the part: no pair that is in use is formed, and no row holds more than a part. Whether the
    parts are broadcast is left to their size."""
    parts = max(1, -(-products.select("sku").distinct().count() // PART_SKUS))
    part = F.pmod(F.xxhash64("sku"), F.lit(parts)).alias("part")
    catalogue = products.select("sku", part).distinct().groupBy("part").agg(F.collect_list("sku").alias("__all"))
    used = usage.select("account_id", "sku", part).groupBy("account_id", "part").agg(F.collect_set("sku").alias("__used"))
    rows = accounts.select("account_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    rows = rows.join(used, ["account_id", "part"], "left").join(catalogue, "part")
    gap = F.array_except("__all", F.coalesce("__used", F.array().cast("array<string>")))
    return rows.select("account_id", F.explode(gap).alias("sku"))


def attach(usage: DataFrame, rules: DataFrame) -> DataFrame:
    """(account_id, has_sku, lacks_sku): owns one product of a rule without the other."""
    owned = usage.select("account_id", "sku").distinct()
    have = owned.join(rules, owned["sku"] == rules["has_sku"]).select("account_id", "has_sku", "lacks_sku")
    return have.join(owned.withColumnRenamed("sku", "lacks_sku"), ["account_id", "lacks_sku"], "left_anti")


def upgrades(usage: DataFrame, accounts: DataFrame, products: DataFrame) -> DataFrame:
    """Low-tier lines on large accounts."""
    large = accounts.filter("size_class = 'strategic'").select("account_id")
    low = products.filter("tier = 'low'").select("sku")
    return latest_usage(usage).join(large, "account_id", "left_semi").join(low, "sku", "left_semi").select("account_id", "sku").distinct()


def book_of_business(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("owner").agg(
        F.count("*").alias("accounts"), F.sum("arr").alias("arr"), F.avg("health_score").alias("health"), F.count_if(F.col("trajectory") == "at_risk").alias("at_risk")
    )


def usage_trend(usage: DataFrame) -> DataFrame:
    """Month over month change per (account, sku); a line has one row per month, so its frame is short."""
    prev = F.expr("lag(mau) OVER (PARTITION BY account_id, sku ORDER BY month)")
    return usage.withColumn("prev_mau", prev).withColumn("change", F.col("mau") - F.col("prev_mau"))


def renewals_due(renewals: DataFrame, as_of: Column, days: int) -> DataFrame:
    return renewals.filter(F.datediff("renewal_date", as_of).between(0, days))


def account_brief(accounts: DataFrame, usage: DataFrame, contacts: DataFrame, renewals: DataFrame) -> DataFrame:
    """Every account with its footprint and contacts by role; both lists are bounded by the
    catalogue and the role list."""
    foot = usage_edges(usage).groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct("sku", "utilization"))).alias("footprint"), F.sum("mau").alias("mau")
    )
    who = contacts.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("role", "email"))).alias("contacts"))
    return accounts.join(foot, "account_id", "left").join(who, "account_id", "left").join(renewals.select("account_id", "term_months"), "account_id", "left")


def reconcile(accounts: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """(domain, field, ours, theirs) where the two records differ; ``missing`` rows for domains
    only one side knows."""
    ours = accounts.select("domain", F.lit(True).alias("__a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    theirs = entities.select("domain", F.lit(True).alias("__e"), *[F.col(f).alias(f"e_{f}") for f in fields])
    both = ours.join(theirs, "domain", "full_outer")
    diffs = [F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"e_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("ours"), F.col(f"e_{f}").alias("theirs"))) for f in fields]
    gone = F.struct(
        F.lit("missing").alias("field"), F.when(F.col("__a").isNotNull(), "yes").otherwise("no").alias("ours"), F.when(F.col("__e").isNotNull(), "yes").otherwise("no").alias("theirs")
    )
    known = F.col("__a").isNotNull() & F.col("__e").isNotNull()
    rows = F.when(known, F.array_compact(F.array(*diffs))).otherwise(F.array(gone))
    return both.select("domain", F.explode(rows).alias("d")).select("domain", "d.field", "d.ours", "d.theirs")


def null_marks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the shortest value of its type (empty, zero) wherever one of ``columns`` is not null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    least = {c: F.array() if isinstance(kinds[c], T.ArrayType) else F.lit("" if isinstance(kinds[c], T.StringType) else 0) for c in columns}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), least[c].cast(kinds[c])) for c in columns})


def schema_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, property, type, rows, null_share): one pass per table."""
    out = None
    for name, df in tables.items():
        nulls = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f.name).isNull()).alias(f"n_{i}") for i, f in enumerate(df.schema.fields)])
        items = F.array(*[
            F.struct(F.lit(f.name).alias("property"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n_{i}").alias("nulls"))
            for i, f in enumerate(df.schema.fields)
        ])
        part = nulls.select(F.lit(name).alias("table"), "rows", F.explode(items).alias("p")).select(
            "table", "p.property", "p.type", "rows", F.round(F.col("p.nulls") / F.greatest("rows", F.lit(1)), 6).alias("null_share")
        )
        out = part if out is None else out.unionByName(part)
    return out


def edge_triples(edges: dict[tuple[str, str, str], DataFrame]) -> DataFrame:
    """(from_label, edge, to_label, n) for every edge table."""
    out = None
    for (src, kind, dst), df in edges.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(src).alias("from_label"), F.lit(kind).alias("edge"), F.lit(dst).alias("to_label"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def ad_hoc(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A read-only question over the given tables, named ``{table}`` in the text."""
    first = next(iter(tables.values()))
    return first.sparkSession.sql(sql, **tables)


def largest_lines(usage: DataFrame, k: int = 3) -> DataFrame:
    return top_per_key(latest_usage(usage), ["account_id"], [F.col("monthly_revenue").desc(), F.col("sku").asc()], k)
