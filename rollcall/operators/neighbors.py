"""Work on the nearest rows in any number of columns: local outlier factor, imputation, oversampling.

All of it runs on one exact k-nearest join (``pivots.knn_join``).  Rows that
must not meet (other classes, other patterns of missing columns) get one more
coordinate that sets them farther apart than anything that may meet, so several
joins become one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import spread
from rollcall.operators import pivots


def lof(df: DataFrame, key: str, features: str | Sequence[str], k: int = 20, outlier: float = 1.5) -> DataFrame:
    """Local outlier factor of every row over an array column or several columns."""
    e = spread.pin(pivots.knn_join(df, key, features, k))
    kd = e.groupBy("i").agg(F.max("d").alias("_kd"))
    reach = e.join(kd.select(F.col("i").alias("j"), F.col("_kd").alias("_kj")), "j").groupBy("i").agg(F.avg(F.greatest("d", "_kj")).alias("_r"))
    lrd = spread.pin(reach.select("i", (1.0 / (F.col("_r") + 1e-10)).alias("_l")))
    mean = e.join(lrd.select(F.col("i").alias("j"), F.col("_l").alias("_lj")), "j").groupBy("i").agg(F.avg("_lj").alias("_m"))
    out = lrd.join(mean, "i").select(F.col("i").alias(key), (F.col("_m") / F.col("_l")).alias("lof"))
    return out.withColumn("is_outlier", F.col("lof") > outlier)


def draw(*parts: Column | str) -> Column:
    """Uniform (0, 1) from md5 of the parts joined by ``|``: the same on every retry and in other engines."""
    h = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(h, 16, 10).cast("double") + 0.5) / float(1 << 52)


def impute_columns(df: DataFrame, key: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Every missing cell of ``columns`` becomes the mean over the k nearest rows that have the column, else the column's mean.

    Distances run over the columns both rows have, scaled by the root of
    all / common.  Rows with one pattern of missing columns search together; a
    pattern meets every pattern that has something it lacks.  There are at most
    2^columns patterns.  Keys are integers; ties go to the smaller key.
    """
    columns, full = list(columns), (1 << len(columns)) - 1
    mask = sum((F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))
    rows = spread.pin(df.select(F.col(key).alias("_k"), mask.alias("_p"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]))
    seen = [r["_p"] for r in rows.select("_p").distinct().orderBy("_p").collect()]
    pairs = [(p, q) for p in seen for q in seen if p & q and q & ~p]
    means = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    filled = rows
    if pairs:
        extent = rows.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns]).first()
        apart = 4.0 * sum((extent[c] or 0.0) ** 2 for c in columns) ** 0.5 + 1.0
        groups = F.array(*[F.struct(F.lit(n).alias("g"), F.lit(p).alias("p"), F.lit(q).alias("q")) for n, (p, q) in enumerate(pairs)])

        def placed(side: str) -> DataFrame:
            t = rows.withColumn("_g", F.explode(F.filter(groups, lambda s: s[side] == F.col("_p"))))
            common = F.col("_g.p").bitwiseAND(F.col("_g.q"))
            at = [F.when(common.bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).otherwise(0.0) for i, c in enumerate(columns)]
            return t.select((F.col("_k") * len(pairs) + F.col("_g.g")).alias("id"), F.array(*at, F.col("_g.g") * apart).alias("v"))

        edges = pivots.knn_join(placed("p"), "id", "v", k, donors=placed("q")).filter(F.col("d") < apart / 2)
        stretch = F.array(*[F.lit((len(columns) / (p & q).bit_count()) ** 0.5) for p, q in pairs])
        lacks = F.array(*[F.lit(q & ~p) for p, q in pairs])
        group = F.pmod("i", F.lit(len(pairs))).cast("int")
        found = edges.select(F.floor(F.col("i") / len(pairs)).alias("_k"), F.floor(F.col("j") / len(pairs)).alias("_j"),
                             (F.col("d") * F.element_at(stretch, group + 1)).alias("d"), F.element_at(lacks, group + 1).alias("_lacks"))
        giver = rows.select(F.col("_k").alias("_j"), F.array(*columns).alias("_x"))
        cells = found.join(giver, "_j").select("_k", "_j", "d", "_lacks", F.posexplode("_x").alias("c", "x"))
        cells = cells.filter(F.expr("_lacks & shiftleft(1, c) <> 0"))
        near = cells.groupBy("_k", "c").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "_j", "x"))), 1, k).alias("n"))
        mean = F.aggregate("n", F.lit(0.0), lambda s, e: s + e["x"]) / F.size("n")
        wide = near.select("_k", "c", mean.alias("x")).groupBy("_k").agg(*[F.max(F.when(F.col("c") == i, F.col("x"))).alias(f"_n_{c}") for i, c in enumerate(columns)])
        filled = rows.join(wide, "_k", "left")
    filled = spread.with_global(filled, means)
    best = [F.coalesce(*[F.col(n) for n in (c, f"_n_{c}", f"_m_{c}") if n in filled.columns]).alias(f"_f_{c}") for c in columns]
    out = df.join(filled.select("_k", *best), df[key] == F.col("_k"), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in columns}).drop("_k", *[f"_f_{c}" for c in columns])


def smote(df: DataFrame, key: str, features: str | Sequence[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows between a row and one of its k nearest of its class, until every class has as many rows as the largest.

    Returns the rows given (copy -1) and the new ones: key of the base row,
    ``copy``, ``other`` (key of the neighbour), ``u`` (place between them), the
    features, the label and ``is_synthetic``.  The rows of a class take turns in
    the order of the key; a class of one row is repeated as it is.  Rows without
    a label stay as they are.
    """
    counts = {r[label]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(counts.values(), default=0)
    few = [(c, n) for c, n in sorted(counts.items()) if n < most]
    given = df.select(F.col(key), F.lit(-1).alias("copy"), F.lit(None).cast(df.schema[key].dataType).alias("other"), F.lit(None).cast("double").alias("u"),
                      pivots.as_vector(features).alias("_x"), F.col(label), F.lit(False).alias("is_synthetic"))
    out = given
    if few:
        kind = "string" if isinstance(few[0][0], str) else "long"
        classes = df.sparkSession.createDataFrame([(c, n, most - n, i) for i, (c, n) in enumerate(few)], f"_c {kind}, _n long, _need long, _i int")
        rows = given.join(F.broadcast(classes), F.col(label) == F.col("_c")).select(key, label, "_x", "_n", "_need", "_i", F.lit(1).alias("_one"))
        norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, x: s + x * x))
        rows = spread.pin(rows)
        apart = 4.0 * (rows.agg(F.max(norm)).first()[0] or 0.0) + 1.0
        e = pivots.knn_join(rows.withColumn("_v", F.concat("_x", F.array(F.col("_i") * apart))), key, "_v", k).filter(F.col("d") < apart / 2)
        near = e.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "j"))), lambda s: s["j"]).alias("_js"))
        base = spread.running(rows, ["_i"], [key], {"r": "_one"})
        turns = F.when(F.col("r_before") < F.col("_need"), F.floor((F.col("_need") - F.col("r_before") - 1) / F.col("_n")).cast("int")).otherwise(-1)
        base = base.withColumn("_t", turns).filter("_t >= 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_t"))))
        base = base.join(near, base[key] == near["i"], "left").withColumn("_js", F.coalesce("_js", F.array(F.col(key))))
        at = (F.floor(draw(F.col(key), F.col("copy"), F.lit(seed), F.lit("row")) * F.size("_js")) + 1).cast("int")
        base = base.withColumn("other", F.element_at("_js", at)).withColumn("u", draw(F.col(key), F.col("copy"), F.lit(seed), F.lit("place")))
        there = rows.select(F.col(key).alias("_o"), F.col("_x").alias("_y"))
        new = base.join(there, F.col("other") == F.col("_o"))
        mixed = F.transform(F.arrays_zip("_x", "_y"), lambda s: s["_x"] + F.col("u") * (s["_y"] - s["_x"]))
        out = given.unionByName(new.select(key, "copy", "other", "u", mixed.alias("_x"), label, F.lit(True).alias("is_synthetic")))
    if isinstance(features, str):
        return out.withColumnRenamed("_x", features)
    return out.select(key, "copy", "other", "u", *[F.col("_x")[i].alias(c) for i, c in enumerate(features)], label, "is_synthetic")
