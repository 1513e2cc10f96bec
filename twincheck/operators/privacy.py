"""Re-identification and memorization risks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clip01, risk_level
from .sequences import order_statistic

#: Rows of a side in a nearest-neighbour attack, and probes of one: the attack's own sample sizes, so its cross join is bounded.
SIDE, PROBES, NEAR = 200, 100, 0.5


def first_rows(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The first n rows by key: a top-k, which never sorts the table as a whole."""
    return df.orderBy(*key).limit(n)


def singling_out(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(matched, total, risk): the share of synthetic rows that equal a real row on all the columns; null equals null."""
    key = F.to_json(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns)))
    found = synth.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(real.select(key.alias("k")).distinct().withColumn("hit", F.lit(True)), "k", "left")
    return found.agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("risk", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def _vectors(df: DataFrame, columns: list[str], key: str, n: int) -> DataFrame:
    own = df.select(F.col(key).alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    return first_rows(own, n, "id")


def _distance(a: Column, b: Column, scale: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), scale.alias("s")), lambda z: F.pow((z["a"] - z["b"]) / z["s"], F.lit(2))), F.lit(0.0), lambda t, x: t + x))


def linkability(real: DataFrame, synth: DataFrame, aux: DataFrame, columns: list[str], key: str, n_aux: int = 2) -> DataFrame:
    """(linked, probes, risk): probes whose nearest synthetic row lies within NEAR of a real row."""
    columns = columns[: 2 * n_aux]
    r, s, a = _vectors(real, columns, key, SIDE), _vectors(synth, columns, key, SIDE), _vectors(aux, columns, key, PROBES)
    scale = r.agg(F.array(*(F.stddev_pop(F.col("v")[i]) + 1e-8 for i in range(len(columns)))).alias("scale"))
    # PROBES x SIDE and SIDE x SIDE rows
    near = a.alias("a").join(F.broadcast(s.alias("s"))).join(F.broadcast(scale)).groupBy("a.id").agg(F.min_by(F.struct(F.col("s.id").alias("sid"), F.col("s.v").alias("v")), F.struct(_distance(F.col("a.v"), F.col("s.v"), F.col("scale")), F.col("s.id"))).alias("n"))
    close = near.join(F.broadcast(r.select(F.col("v").alias("rv")))).join(F.broadcast(scale)).groupBy("id").agg(F.min(_distance(F.col("n.v"), F.col("rv"), F.col("scale"))).alias("d"))
    return close.agg(F.count_if(F.col("d") < NEAR).alias("linked"), F.count(F.lit(1)).alias("probes")).withColumn("risk", F.coalesce(F.try_divide("linked", "probes"), F.lit(0.0)))


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df cut at the lower median of a unique numeric key, found exactly."""
    middle = order_statistic(df, key, -(-df.where(F.col(f"`{key}`").isNotNull()).count() // 2))
    return df.where(F.col(key) <= middle), df.where(F.col(key) > middle)


def inference(real: DataFrame, synth: DataFrame, secrets: list[str], known: list[str], seed: int = 42) -> DataFrame:
    """(secret, risk): how much better than guessing a forest, fitted on synthetic rows, tells real secrets. Null with fewer than 20 and 10 rows."""
    spark, rows = real.sparkSession, []
    known = [c for c in known if c not in secrets]
    numeric = {f.name for f in real.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")}
    for c in secrets:
        s, r = (d.select(*(F.col(k).cast("double").alias(k) for k in known), F.col(c).alias("secret")).dropna() for d in (synth, real))
        if s.limit(20).count() < 20 or r.limit(10).count() < 10:
            rows.append((c, None))
            continue
        assemble = VectorAssembler(inputCols=known, outputCol="features")
        if c in numeric:
            model = Pipeline(stages=[assemble, RandomForestRegressor(labelCol="secret", numTrees=20, maxDepth=5, seed=seed)]).fit(s)
            got = model.transform(r).agg(F.avg(F.abs(F.col("prediction") - F.col("secret"))).alias("e"), F.stddev_pop("secret").alias("sd")).first()
            rows.append((c, max(0.0, 1 - got["e"] / (got["sd"] + 1e-8))))
        else:
            both = s.unionByName(r).select(F.col("secret").cast("string").alias("secret"))
            index = StringIndexer(inputCol="secret", outputCol="label", stringOrderType="alphabetAsc").fit(both)
            k = len(index.labels)
            model = Pipeline(stages=[index, assemble, RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed)]).fit(s)
            acc = model.transform(r).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()["a"]
            rows.append((c, max(0.0, (acc - 1 / k) / (1 - 1 / k)) if k > 1 else 0.0))
    return spark.createDataFrame(rows, "secret string, risk double")


def column_risk(distances: DataFrame) -> DataFrame:
    """(column, singleton_ratio, overlap, risk) from frequency tables: values that occur once among synthetic rows, times the share of real values seen there."""
    out = distances.groupBy("column").agg(
        F.coalesce(F.try_divide(F.count_if(F.col("n_synth") == 1), F.count_if(F.col("n_synth") > 0)), F.lit(0.0)).alias("singleton_ratio"),
        F.coalesce(F.try_divide(F.count_if((F.col("n_real") > 0) & (F.col("n_synth") > 0)), F.count_if(F.col("n_real") > 0)), F.lit(0.0)).alias("overlap"),
    )
    return out.withColumn("risk", F.col("singleton_ratio") * F.col("overlap"))


def verdict(risks: DataFrame, limits: tuple[float, float, float] = (0.05, 0.10, 0.15)) -> DataFrame:
    """From (singling_out, linkability, inference): overall risk, its level and the pass. A missing risk counts as 1 and fails."""
    names = ("singling_out", "linkability", "inference")
    so, link, inf = (F.coalesce(F.col(c), F.lit(1.0)) for c in names)
    total = clip01(0.40 * so + 0.35 * link + 0.25 * inf)
    return risks.select(*names, total.alias("overall_risk"), risk_level(total).alias("risk_level"), ((so <= limits[0]) & (link <= limits[1]) & (inf <= limits[2])).alias("passed"))


def membership(members: DataFrame, others: DataFrame, synth: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(auc, advantage, tpr_at_fpr_001): can the distance to the nearest synthetic row tell members from others? SIDE rows each."""
    sides = [_vectors(d, columns, key, SIDE) for d in (members, others, synth)]
    scale = sides[0].agg(F.array(*(F.stddev_pop(F.col("v")[i]) + 1e-8 for i in range(len(columns)))).alias("scale"))
    probes = sides[0].withColumn("member", F.lit(1)).unionByName(sides[1].withColumn("member", F.lit(0)))
    score = probes.alias("p").join(F.broadcast(sides[2].select(F.col("v").alias("sv")))).join(F.broadcast(scale)).groupBy("p.id", "member").agg((-F.round(F.min(_distance(F.col("p.v"), F.col("sv"), F.col("scale"))), 9)).alias("score"))
    # 2 * SIDE rows from here on
    n, m = (F.sum(x).over(Window.partitionBy()) for x in (F.col("member"), 1 - F.col("member")))
    rank = F.rank().over(Window.orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy("score")) - 1) / 2
    down = Window.orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, 0)
    ranked = score.select("member", rank.alias("rank"), n.alias("n"), m.alias("m"), (F.sum("member").over(down) / n).alias("tpr"), (F.sum(1 - F.col("member")).over(down) / m).alias("fpr"))
    return ranked.groupBy("n", "m").agg(F.sum(F.col("rank") * F.col("member")).alias("w"), F.greatest(F.max(F.col("tpr") - F.col("fpr")), F.lit(0.0)).alias("advantage"), F.coalesce(F.max(F.when(F.col("fpr") <= 0.01, F.col("tpr"))), F.lit(0.0)).alias("tpr_at_fpr_001")).select(
        ((F.col("w") - F.col("n") * (F.col("n") + 1) / 2) / (F.col("n") * F.col("m"))).alias("auc"), "advantage", "tpr_at_fpr_001"
    )


def verbatim(real: DataFrame, synth: DataFrame, columns: list[str], key: str, n: int | None = None) -> DataFrame:
    """(matched, total, risk) of the synthetic rows; of the first n by key if given."""
    return singling_out(real, synth if n is None else first_rows(synth, n, key), columns)
