"""Agronomic rules, classifier verdicts and their cascade, as projections; seasonal features as grouped aggregates joined back to observations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions import spectral as X
from fieldloom.functions.mathx import clamp, finite, logistic, round_even, round_up
from fieldloom.functions.text import joined, month_start
from fieldloom.sources.shared import written

ML_INDICES = ("NDVI", "EVI", "NDRE", "NDMI")


def whole(x: Column) -> Column:
    return x.cast("long").cast("string")


def agro_score(ndvi: Column, days: Column, stage: Column, vv: Column, vh: Column, ratio: Column, spread: Column, n_ndvi: Column) -> dict[str, Column]:
    """Score from 0 to 100 and its parts: NDVI .3, cycle .25, radar .25, dynamics .2. Missing parts count 50, a missing NDVI 0."""
    has = ndvi.isNotNull()
    plain = F.when(~has, 0.0).when(ndvi.between(25, 75), 80 + (1 - F.abs(ndvi - 50) / 25) * 20).when(ndvi.between(15, 85), 40.0).otherwise(10.0)
    known = days.isNotNull() & stage.isNotNull()
    fits = F.coalesce(
        (stage == "Levée") & ndvi.between(15, 40) | (stage == "Tallage") & ndvi.between(30, 65) | (stage == "Montaison") & ndvi.between(40, 80) | (stage == "Épiaison") & ndvi.between(50, 80),
        F.lit(False),
    )
    late = F.coalesce((stage == "Maturation") & ndvi.between(30, 60) | (stage == "Récolte") & ndvi.between(10, 40), F.lit(False))
    cycle = F.when(~known, 50.0).when(days.between(0, 130), F.when(fits, 95.0).when(late, 90.0).otherwise(80.0)).when(days > 130, 30.0).otherwise(0.0)
    both = vv.isNotNull() & vh.isNotNull()
    typical, fair = vv.between(-14, -8) & vh.between(-22, -14), vv.between(-16, -6) & vh.between(-24, -12)
    base = F.when(typical, 90.0).when(fair, 60.0).otherwise(20.0)
    radar = F.when(~both, 50.0).otherwise(F.when(ratio.between(0.3, 0.6), F.least(F.lit(100.0), base + 10)).otherwise(base))
    enough = (n_ndvi >= 3) & spread.isNotNull()
    trend = F.when(~enough, 50.0).when(spread >= 15, 70 + F.least(F.lit(30.0), spread)).when(spread >= 5, 50.0).otherwise(20.0)
    pct = whole(ndvi)
    notes = joined(
        " | ",
        F.when(has, F.when(ndvi.between(25, 75), F.concat(F.lit("NDVI "), pct, F.lit("% dans la plage orge"))).when(ndvi.between(15, 85), F.concat(F.lit("NDVI "), pct, F.lit("% limite pour l'orge"))).otherwise(F.concat(F.lit("NDVI "), pct, F.lit("% hors plage orge typique")))),
        F.when(known & days.between(0, 130), F.concat(F.lit("Cycle "), whole(days), F.lit("j cohérent (stade "), stage, F.lit(")"))).when(known & (days > 130), F.concat(F.lit("Cycle "), whole(days), F.lit("j > 130j, dépasse le cycle orge"))),
        F.when(both, F.when(typical, F.concat(F.lit("Radar VV="), vv.cast("string"), F.lit("dB VH="), vh.cast("string"), F.lit("dB typique cultures"))).when(fair, "Radar acceptable mais pas typique orge").otherwise("Signature radar atypique pour céréales")),
        F.when(enough, F.when(spread >= 15, F.concat(F.lit("Dynamique NDVI "), whole(round_even(spread)), F.lit("% (bon signal cultural)"))).when(spread >= 5, F.concat(F.lit("Dynamique NDVI faible ("), whole(round_even(spread)), F.lit("%)"))).otherwise("NDVI stable - pas typique d'une culture")),
    )
    score = clamp(round_up(plain * 0.3 + cycle * 0.25 + radar * 0.25 + trend * 0.2), 0, 100)
    return {"agro_score": score, "ndvi_score": round_up(plain), "cycle_score": round_up(cycle), "radar_score": round_up(radar), "trend_score": round_up(trend), "agro_details": notes}


def hybrid(cnn_confidence: Column, cnn_is_barley: Column, agro: Column) -> dict[str, Column]:
    """Network and rules together, .6 and .4; a disagreement above 55 costs confidence."""
    cnn = F.when(cnn_is_barley, cnn_confidence).otherwise(100 - cnn_confidence)
    score = round_up(cnn * 0.6 + agro * 0.4)
    apart = F.abs(cnn - agro)
    final = clamp(round_up(score - F.when(apart > 55, apart * 0.08).otherwise(0.0)), 0, 100)
    text = F.when(score > 50, "✅ ORGE CONFIRMÉE — CNN + Règles agro concordent").otherwise("❌ NON-ORGE — CNN + Règles agro concordent")
    text = F.concat(text, F.when(apart > 55, F.concat(F.lit(" (⚠️ désaccord CNN/Agro: "), whole(round_even(apart)), F.lit("%)"))).otherwise(""))
    return {"score": score, "is_barley": score > 50, "confidence": final, "verdict": text}


def network_answer(confidence: Column, is_barley: Column, p_barley: Column, p_other: Column) -> Column:
    """A network's answer as a struct; null if a number is missing or not finite, or the verdict is missing."""
    ok = is_barley.isNotNull()
    for v in (confidence, p_barley, p_other):
        ok = ok & finite(v).isNotNull()
    return F.when(ok, F.struct(confidence.alias("confidence"), is_barley.alias("is_barley"), p_barley.alias("prob_barley"), p_other.alias("prob_non_barley")))


def segment(ring: Column, is_barley: Column, confidence: Column, ndvi: Column, area: Column, least: float = 0.0) -> Column:
    """The whole parcel as the barley contour, with its figures; null if the verdict is another or too unsure."""
    return F.when(is_barley & (confidence >= least), F.struct(ring.alias("coordinates"), round_up(confidence).alias("confidence"), (ndvi / 100).alias("ndvi"), round_up(area / 10_000, 2).alias("area_ha")))


def rules_only(agro: Column) -> dict[str, Column]:
    start = F.when(agro > 50, "⚠️ ORGE PROBABLE").otherwise("⚠️ NON-ORGE PROBABLE")
    return {"score": agro, "is_barley": agro > 50, "confidence": agro, "verdict": F.concat(start, F.lit(" (CNN indisponible, estimation agro seule) — Score agro "), whole(agro), F.lit("%"))}


def forest_level(p: Column, ndvi_oct: Column, doy_peak: Column) -> Column:
    return F.when(p < K.RF_REJECT, "NON_ORGE").when((p >= K.RF_ACCEPT) & (ndvi_oct <= K.RF_MAX_OCT_NDVI) & (doy_peak <= K.RF_MAX_PEAK_DOY), "ORGE").when(p.isNotNull(), "A_VERIFIER")


def _percent(p: Column) -> Column:
    return round_up(p * 100)


def forest_verdict(p: Column, level: Column, threshold: float = K.RF_THRESHOLD) -> dict[str, Column]:
    yes = p >= threshold
    start = F.when(~yes, "❌ NON-ORGE").when(level == "ORGE", "✅ ORGE CONFIRMÉE").otherwise("⚠️ ORGE À VÉRIFIER")
    return {"score": _percent(p), "is_barley": yes, "confidence": _percent(F.greatest(p, 1 - p)), "verdict": F.concat(start, F.lit(" — RF Orge (probabilité d'orge "), whole(_percent(p)), F.lit("%)"))}


def logistic_verdict(p: Column, threshold: float = 0.5) -> dict[str, Column]:
    yes = p >= threshold
    start = F.when(yes, "✅ ORGE CONFIRMÉE").otherwise("❌ NON-ORGE")
    return {"score": _percent(p), "is_barley": yes, "confidence": _percent(F.greatest(p, 1 - p)), "verdict": F.concat(start, F.lit(" — Sentinel-2 (probabilité d'orge "), whole(_percent(p)), F.lit("%)"))}


def cascade(rf: Column, s2: Column, cnn: Column, options: dict[str, dict[str, Column]]) -> dict[str, Column]:
    """The verdict of the first classifier that has an answer: forest, logistic, network with rules, rules alone."""
    out = {k: F.when(rf.isNotNull(), options["rf"][k]).when(s2.isNotNull(), options["s2"][k]).when(cnn.isNotNull(), options["hybrid"][k]).otherwise(options["rules"][k]) for k in ("score", "is_barley", "confidence", "verdict")}
    out["source"] = F.when(rf.isNotNull(), "rf").when(s2.isNotNull(), "s2").when(cnn.isNotNull(), "hybrid").otherwise("rules")
    return out


def risks(ndvi: Column, ratio: Column, is_barley: Column, confidence: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(ndvi < 15, "Végétation très faible"),
            F.when(ndvi > 85, "Végétation trop dense pour de l'orge"),
            F.when(ratio > 0.45, "Structure radar type forêt"),
            F.when(~is_barley & (confidence > 70), "Verdict non-orge avec une confiance élevée"),
        )
    )


def presence(is_barley: Column, gdd_detected: Column) -> Column:
    return F.when(~is_barley, "none").when(gdd_detected, "confirmed").otherwise("probable")


def recommendation(source: Column, is_barley: Column, score: Column, confidence: Column, cnn: Column, agro: Column) -> Column:
    """What to do next, in a sentence of the classifier that decided."""
    crop = F.when(is_barley, "Orge").otherwise("Non-orge")
    seasonal = F.concat(crop, F.lit(" selon la dynamique saisonnière Sentinel-2 de la parcelle (probabilité d'orge "), whole(score), F.lit("%)."))
    index = F.concat(crop, F.lit(" selon les indices Sentinel-2 de la parcelle (probabilité d'orge "), whole(score), F.lit("%)."))
    sure = F.concat(F.lit("Orge "), F.when(confidence > 70, "confirmée").otherwise("probable"), F.lit(". Score hybride "), whole(score), F.lit("% (CNN "), whole(round_up(cnn)), F.lit("% + Agro "), whole(agro), F.lit("%)."))
    unsure = F.concat(F.lit("Non-orge détecté. Score hybride "), whole(score), F.lit("%. Vérification terrain recommandée."))
    rules = F.concat(F.when(is_barley, "Orge probable").otherwise("Non-orge probable"), F.lit(" (modèle CNN indisponible, estimation basée uniquement sur les règles agronomiques, score "), whole(agro), F.lit("%). Vérification terrain recommandée."))
    return F.when(source == "rf", seasonal).when(source == "s2", index).when(source == "hybrid", F.when(is_barley, sure).otherwise(unsure)).otherwise(rules)


def analysed(df: DataFrame) -> DataFrame:
    """Everything that an analysis derives from (lat, ndvi, days_since_planting, growth_stage, vv, vh, ndvi_range, n_ndvi, cnn_confidence, cnn_is_barley, rf_probability, ndvi_oct, doy_peak, gdd_detected)."""
    c = F.col
    df = df.withColumn("vh_vv", X.radar(c("vv"), c("vh"))["vh_vv"])
    df = df.withColumns(agro_score(c("ndvi"), c("days_since_planting"), c("growth_stage"), c("vv"), c("vh"), c("vh_vv"), c("ndvi_range"), c("n_ndvi")))
    df = df.withColumn("s2_probability", logistic(K.LOGISTIC, {"ndvi": c("ndvi")})).withColumn("rf_level", forest_level(c("rf_probability"), c("ndvi_oct"), c("doy_peak")))
    options = {
        "rf": forest_verdict(c("rf_probability"), c("rf_level")),
        "s2": logistic_verdict(c("s2_probability"), K.LOGISTIC["threshold"]),
        "hybrid": hybrid(c("cnn_confidence"), c("cnn_is_barley"), c("agro_score")),
        "rules": rules_only(c("agro_score")),
    }
    df = df.withColumns(cascade(c("rf_probability"), c("s2_probability"), c("cnn_confidence"), options))
    df = df.withColumn("risk_factors", risks(c("ndvi"), c("vh_vv"), c("is_barley"), c("confidence")))
    df = df.withColumn("barley_presence", presence(c("is_barley"), c("gdd_detected")))
    df = df.withColumn("recommendation", recommendation(c("source"), c("is_barley"), c("score"), c("confidence"), c("cnn_confidence"), c("agro_score")))
    return df.withColumn("anomaly_level", F.when(c("is_barley"), "AUCUNE").otherwise("FORTE"))


def seasonal_features(series: DataFrame, order: str | None = None) -> DataFrame:
    """Features of each observation (parcel_id, month_key, reflectances B2 to B11): its own indices and the parcel's statistics.

    Of rows with one date the first by ``order`` counts, a column that tells a list's places; without it, that of the least reflectances, so that
    a rerun chooses the same. Observations without data stay, as zeros; parcels without any NDVI
    are absent.
    """
    bands = {k: F.col(k) for k in ("B2", "B4", "B5", "B8", "B11")}
    rows = series.withColumns(X.monthly(bands)).withColumn("date", month_start(F.col("month_key"))).where("date is not null")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("parcel_id", "date").orderBy(*([order] if order else [c for c in series.columns if c.startswith("B")]), "month_key"))).where("_n = 1").drop("_n", *([order] if order else []))
    rows = rows.withColumns({"month": F.month("date"), "day_of_year": F.dayofyear("date"), "PSRI": X.senescence(F.col("B2"), F.col("B4"), F.col("B6")), "MSI": X.moisture(F.col("B8"), F.col("B11"))})
    ndvi, doy = F.col("NDVI"), F.col("day_of_year")
    green = ndvi >= K.GREEN_NDVI
    aggs = []
    for name in ML_INDICES:
        v = F.col(name)
        aggs += [F.avg(v).alias(f"{name}_mean"), F.max(v).alias(f"{name}_max"), F.min(v).alias(f"{name}_min"), F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias(f"{name}_std")]
    for m, key in ((6, "jun"), (8, "aug"), (9, "sep"), (10, "oct")):
        aggs.append(F.coalesce(F.avg(F.when(F.col("month") == m, ndvi)), F.avg(ndvi)).alias(f"NDVI_{key}"))
    aggs += [
        F.max(F.when(ndvi.isNotNull(), F.struct(ndvi.alias("v"), (-F.unix_date("date")).alias("o"), doy.alias("d")))).alias("_peak"),
        (F.max(F.when(green, doy)) - F.min(F.when(green, doy))).alias("green_span_days"),
        F.min(F.when(green, doy)).alias("first_green_doy"),
        F.max(F.when(green, doy)).alias("last_green_doy"),
        (F.count_if(green) / F.count(F.lit(1))).alias("pct_green"),
        F.count(ndvi).alias("_valid"),
    ]
    stats = rows.groupBy("parcel_id").agg(*aggs).where("_valid > 0").withColumn("doy_max_ndvi", F.col("_peak.d"))
    falling = rows.join(stats.select("parcel_id", "doy_max_ndvi"), "parcel_id").where(ndvi.isNotNull() & (doy >= F.col("doy_max_ndvi")))
    falling = falling.groupBy("parcel_id").agg(F.when(F.count(F.lit(1)) >= 3, F.coalesce(F.regr_slope("NDVI", "day_of_year"), F.lit(0.0))).otherwise(0.0).alias("_slope"))
    stats = stats.join(falling, "parcel_id", "left").withColumn("ndvi_falling_slope", F.when(F.col("first_green_doy").isNull(), 0.0).otherwise(F.coalesce("_slope", F.lit(0.0))))
    stats = stats.withColumn("pct_green", F.when(F.col("first_green_doy").isNull(), 0.0).otherwise(F.col("pct_green")))
    stats = stats.withColumns(
        {
            "drop_max_to_oct": F.col("NDVI_max") - F.col("NDVI_oct"),
            "drop_sep_oct": F.col("NDVI_sep") - F.col("NDVI_oct"),
            "ratio_oct_max": F.col("NDVI_oct") / (F.col("NDVI_max") + 1e-4),
            "ramp_jun_to_aug": F.col("NDVI_aug") - F.col("NDVI_jun"),
        }
    ).drop("_peak", "_valid", "_slope")
    both = rows.drop("date").join(stats, "parcel_id")
    numbers = [c for c, t in both.dtypes if c not in ("parcel_id", "month_key")]
    return both.select("parcel_id", "month_key", *[F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in numbers])


#: Months of the parts of a crop's season and of the seasons of a year; parameters, as feature sets name them without saying which months they are.
CROP_PARTS = {"early_crop": (5, 6), "mid_crop": (7, 8), "late_crop": (9, 10)}
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}


def index_features(series: DataFrame, *parts: dict[str, tuple[int, ...]], indices: tuple[str, ...] = ML_INDICES) -> DataFrame:
    """Features of each parcel over its observations (parcel_id, month_key, reflectances): of each index mean, median, std (of a sample; 0 of one value), min, max, amp,
    q10 and q90, and the mean of each part of the year, by its months.

    One aggregate for all of them. Null values count in none; what no value is there for is null; parcels without any value stay, as nulls.
    """
    bands = {k: F.col(k) for k in ("B2", "B4", "B5", "B8", "B11")}
    rows = series.withColumns(X.monthly(bands)).withColumn("_month", F.month(month_start(F.col("month_key"))))
    aggs = []
    for i in indices:
        v = finite(F.col(i))
        of = {"mean": F.avg(v), "median": F.median(v), "std": F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)), "min": F.min(v), "max": F.max(v), "amp": F.max(v) - F.min(v), "q10": F.percentile(v, 0.1), "q90": F.percentile(v, 0.9)}
        of |= {f"{name}_mean": F.avg(F.when(F.col("_month").isin(*months), v)) for part in parts for name, months in part.items()}
        aggs += [value.alias(f"{i}_{name}") for name, value in of.items()]
    return rows.groupBy("parcel_id").agg(*aggs)


def classify(features: DataFrame, probability: Column, threshold: float = K.RF_THRESHOLD) -> DataFrame:
    """Mean probability of each parcel's observations, and what follows from it."""
    p = features.withColumn("_p", probability).groupBy("parcel_id").agg(F.avg("_p").alias("probability"), F.count(F.lit(1)).alias("n_observations"), F.first("NDVI_oct").alias("ndvi_oct"), F.first("doy_max_ndvi").alias("doy_peak"))
    return p.withColumn("is_barley", F.col("probability") >= threshold).withColumn("level", forest_level(F.col("probability"), F.col("ndvi_oct"), F.col("doy_peak")))


def train_forest(features: DataFrame, label: str, columns: list[str], trees: int = 300, depth: int = 30, seed: int = 42):
    """A random forest of MLlib over observations; parity is of features and verdicts, not of the forest's numbers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=columns, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw")]
    return Pipeline(stages=stages).fit(features)


def forest_probability(model, features: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(features).withColumn("p", F.coalesce(F.get(vector_to_array("_prob"), 1), F.lit(0.0))).drop("_x", "_prob", "_pred", "_raw")


NODE = "tree int, node int, feature int, threshold double, left_child int, right_child int, value double"


def write_forest(nodes: DataFrame, path: str) -> None:
    """Stores a forest as a table of nodes (NODE): an inner one has a feature's number, a threshold and children, a leaf the share of the class."""
    nodes.write.parquet(path)


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    """The nodes (NODE) of a stored forest: a table of nodes, or what MLlib saves of a random forest for two classes."""
    if "nodeData" not in (stored := spark.read.parquet(path)).columns:
        return stored.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in NODE.split(", ")])
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    kept = lambda c: F.when(inner, c)
    share = F.coalesce(F.try_divide(F.get(n["impurityStats"], 1), F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))
    return stored.select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        kept(n["split"]["featureIndex"]).alias("feature"),
        kept(F.get(n["split"]["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        kept(n["leftChild"]).alias("left_child"),
        kept(n["rightChild"]).alias("right_child"),
        F.when(~inner, share).alias("value"),
    )


#: Nodes that go to every task at once; a larger forest is evaluated some trees at a time.
MOST_NODES = 200_000
_TREE = "array<struct<feature:int,threshold:double,l:int,r:int,value:double>>"


def _arrays(nodes: list) -> tuple[list[list[tuple]], int]:
    """(trees as lists of nodes, whose children are places in the list, the root first; edges to the deepest leaf) of rows of NODE in order."""
    trees: dict[int, list] = {}
    for n in nodes:
        trees.setdefault(n["tree"], []).append(n)
    out, deepest = [], 0
    for tree in trees.values():
        place = {n["node"]: k for k, n in enumerate(tree)}
        out.append([(n["feature"], n["threshold"], place.get(n["left_child"]), place.get(n["right_child"]), n["value"]) for n in tree])
        level, depth = [0], -1
        while level:
            level, depth = [c for k in level for c in out[-1][k][2:4] if c is not None], depth + 1
        deepest = max(deepest, depth)
    return out, deepest


def forest_scores(features: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """features with ``p``, the mean over a stored forest's trees of the leaf that each row comes to.

    Trees are arrays of nodes in one row that goes to all tasks, MOST_NODES nodes at a time (or one tree, if that has more): they
    don't grow with the rows. A row walks down each tree in a fold as long as the deepest tree. Missing features count as 0.
    """
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect()  # a row a tree
    if not sizes:
        raise ValueError("the forest has no trees")
    lots: list[list[int]] = []
    held = MOST_NODES
    for row in sizes:
        if held + row["n"] > MOST_NODES:
            lots.append([])
            held = 0
        lots[-1].append(row["tree"])
        held += row["n"]
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    out = features.withColumn("p", F.lit(0.0)).withColumn("_x", x)
    for lot in lots:
        arrays, deepest = _arrays(nodes.where(F.col("tree").between(lot[0], lot[-1])).orderBy("tree", "node").collect())
        row = features.sparkSession.createDataFrame([(arrays,)], f"_trees array<{_TREE}>")

        steps = F.array_repeat(F.lit(0), max(deepest, 1))

        def leaf(tree: Column) -> Column:
            def down(k: Column, _: Column) -> Column:
                n = F.get(tree, k)
                return F.when(n["feature"].isNull(), k).when(F.get(F.col("_x"), n["feature"]) <= n["threshold"], n["l"]).otherwise(n["r"])

            return F.get(tree, F.aggregate(steps, F.lit(0), down))["value"]

        scored = out.crossJoin(F.broadcast(row))
        sums = F.aggregate(F.transform("_trees", leaf), F.lit(0.0), lambda a, v: a + v)
        out = scored.withColumn("p", F.col("p") + sums).drop("_trees")
    return out.withColumn("p", F.col("p") / len(sizes)).drop("_x")


def fit_logistic(rows: DataFrame, features: list[str], label: str) -> dict:
    """A penalised logistic model over standardised features, in MLlib: the optimum that plain gradient descent approaches."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean, std = [stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] or 1.0 for f in features]
    z = rows.select(F.col(label).cast("double").alias("label"), *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, std, strict=True)])
    z = VectorAssembler(inputCols=features, outputCol="x").transform(z)
    fit = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / stats["n"], elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(z)
    return {"features": features, "mean": mean, "std": std, "coef": list(fit.coefficients), "intercept": fit.intercept, "threshold": 0.5}


#: Fits that leave-one-out refines at a time.
LOT = 1_000


def leave_one_out(rows: DataFrame, sets: list[list[str]], label: str, key: str, least: float = 0.8) -> DataFrame:
    """Leave-one-out accuracy of each feature set: (rank, features, n_rows, accuracy, majority); sets with too few complete rows are left out.

    The fit without a row is a Newton step away from the fit of all rows, and how far its optimum is from there is bounded (``_held_out``). Where the
    sign of the row's logit is beyond that bound, it is settled without a fit of its own; the other rows, a handful in a large table,
    are fitted, LOT at a time. So a table is read a few times, whatever its size, by tasks that return sums alone.
    """
    import numpy as np

    x = lambda names: F.array(*[F.col(n).cast("double") for n in names])
    options = F.array(*[F.struct(F.lit(k).alias("rank"), x(names).alias("x")) for k, names in enumerate(sets)])
    parts = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("double").alias("y"), F.explode(options).alias("o")).select("key", "y", "o.*")
    whole = F.forall("x", lambda v: finite(v).isNotNull()) & F.col("y").isNotNull()
    # A small file's rows, but each row's fit costs work.
    parts = written(parts.withColumn("whole", whole).repartition(rows.sparkSession.sparkContext.defaultParallelism, "key"))
    wide = max(map(len, sets))
    value = lambda k: F.when(F.col("whole"), F.get("x", k))
    aggs = [f(value(k)).alias(f"{n}{k}") for k in range(wide) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
    ones = F.count_if(F.col("whole") & (F.col("y") == 1))
    scale, majority = {}, {}
    for g in parts.groupBy("rank").agg(F.count(F.lit(1)).alias("total"), F.count_if("whole").alias("n"), ones.alias("ones"), *aggs).collect():  # a row a set
        if g["n"] >= max(2, least * g["total"]):
            get = lambda n, c=len(sets[g["rank"]]), g=g: np.array([g[f"{n}{k}"] for k in range(c)], float)
            m, s = get("m"), get("s")
            s[(s == 0) | (get("lo") == get("hi"))] = 1.0
            scale[g["rank"]] = (m, s, np.append(1.0, np.maximum(np.abs(get("lo") - m), np.abs(get("hi") - m)) / s), g["n"], g["ones"])
    zs = parts.where(F.col("whole") & F.col("rank").isin(*scale)).select("rank", "y", "x")
    hits = dict.fromkeys(scale, 0)
    mixed = {r: v for r, v in scale.items() if 0 < v[4] < v[3]}
    for r, (_, _, _, n, n_ones) in scale.items():
        majority[r] = max(n_ones / n, 1 - n_ones / n)
        if r not in mixed:  # all rows have one label, and so do the others of each
            hits[r] = n
    if mixed:
        start = {r: (np.zeros((1, len(v[0]) + 1)), np.ones((1, len(v[0])))) for r, v in mixed.items()}
        fits = _newton(zs, mixed, start)
        open_ = written(_held_out(zs, mixed, fits))
        for g in open_.groupBy("rank").agg(F.count_if("hit").alias("hits")).collect():
            hits[g["rank"]] += g["hits"]
        numbered = written(open_.where("hit is null").select("rank", "y", "x").withColumn("lot", F.row_number().over(W.partitionBy("rank").orderBy("y", "x"))).withColumn("lot", F.floor((F.col("lot") - 1) / LOT)))
        for r, lot in sorted((g["rank"], g["lot"]) for g in numbered.select("rank", "lot").distinct().collect()):
            own = numbered.where((F.col("rank") == r) & (F.col("lot") == lot)).collect()
            m, s, _, n, n_ones = mixed[r]
            y = np.array([o["y"] for o in own])
            z = np.column_stack([np.ones(len(own)), (np.array([o["x"] for o in own]) - m) / s])
            sole = (y == 1) & (n_ones == 1) | (y != 1) & (n_ones == n - 1)  # the others all have the other label
            if (~sole).any():
                z, y = z[~sole], y[~sole]
                w0 = np.repeat(fits[r][0], len(y), 0)
                w = _newton(zs.where(F.col("rank") == r), {r: mixed[r]}, {r: (w0, _penalties(z, n))}, {r: (z, y)})[r][0]
                hits[r] += int((((w * z).sum(1) >= 0) == (y == 1)).sum())
    found = [(r, ",".join(sets[r]), scale[r][3], hits[r] / scale[r][3], float(majority[r])) for r in sorted(scale)]
    return rows.sparkSession.createDataFrame(found, "rank int, features string, n_rows long, accuracy double, majority double")


def _penalties(z, n: int):
    """Variances, without each row, of features that have variance 1 with it: the weights of the ridge where features are standardised over the others. Of others that are all equal it is any positive number, as their weight is 0."""
    import numpy as np

    v = n / (n - 1) * (1 - z[:, 1:] ** 2 / (n - 1))
    return np.where(v < 1e-12, 1.0, v)


def _newton(rows: DataFrame, scale: dict, start: dict, without: dict | None = None) -> dict:
    """Logistic fits by Newton's method: of each set (rank) some fits at once, from weights and ridges; ``without`` has a row (z, y) that each leaves out.

    Returns (weights, their Hessians and gradients) by set. Tasks add up gradients and Hessians of all fits by matrix products; a step that raises the loss is halved.
    """
    import numpy as np

    def sums(weights: dict) -> dict:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc: dict = {}
            for batch in batches:
                for r, group in batch.groupby("rank"):
                    m, s = scale[r][:2]
                    x, y = np.stack(group["x"].to_numpy()), (group["y"].to_numpy() == 1).astype(float)
                    for k in range(0, len(y), 2_000):
                        z = np.column_stack([np.ones(len(y[k : k + 2_000])), (x[k : k + 2_000] - m) / s])
                        got = _sums(z, y[k : k + 2_000], weights[r])
                        acc[r] = got if r not in acc else [a + b for a, b in zip(acc[r], got, strict=True)]
            if acc:
                yield pd.DataFrame({"rank": list(acc), "v": [np.concatenate([a.ravel() for a in v]) for v in acc.values()]})

        out: dict = {}
        for row in rows.mapInPandas(run, "rank int, v array<double>").collect():  # a row a task and set, of some fits
            v = np.array(row["v"])
            out[row["rank"]] = v if row["rank"] not in out else out[row["rank"]] + v
        found = {}
        for r, w in weights.items():
            u, c = w.shape
            loss, g, h = out[r][:u], out[r][u : u + u * c].reshape(u, c), out[r][u + u * c :].reshape(u, c, c)
            if without:
                z, y = without[r]
                l0, g0, h0 = _sums(z, (y == 1).astype(float), w, each=True)
                loss, g, h = loss - l0, g - g0, h - h0
            ridge = start[r][1]
            found[r] = (loss + (ridge * w[:, 1:] ** 2).sum(1) / 2, g + np.pad(ridge * w[:, 1:], ((0, 0), (1, 0))), h + np.eye(c) * np.pad(ridge, ((0, 0), (1, 0)))[:, None, :])
        return found

    best = {r: w for r, (w, _) in start.items()}
    state = sums(best)
    step = {r: -np.linalg.solve(h, g[..., None])[..., 0] for r, (_, g, h) in state.items()}
    for _ in range(60):
        moving = {r for r in best if np.abs(step[r]).max() >= 1e-9}
        if not moving:
            break
        tried = sums({r: best[r] + step[r] for r in best})
        for r in best:
            better = tried[r][0] <= state[r][0] + 1e-12 * np.abs(state[r][0])
            on = better[:, None]
            best[r] = np.where(on, best[r] + step[r], best[r])
            state[r] = tuple(np.where(better.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in zip(tried[r], state[r], strict=True))
            step[r] = np.where(on, -np.linalg.solve(state[r][2], state[r][1][..., None])[..., 0], step[r] / 2)
    return {r: (best[r], state[r][2], state[r][1]) for r in best}


def _sums(z, y, w, each: bool = False) -> list:
    """(losses, gradients, Hessians) of fits with weights w over rows z with labels y; with ``each`` of a row for each fit."""
    import numpy as np

    a = (z * w).sum(1) if each else z @ w.T
    p = 1 / (1 + np.exp(-np.clip(a, -700, 700)))
    t = y if each else y[:, None]
    loss, d, q = np.logaddexp(0, a) - t * a, p - t, p * (1 - p)
    c = z.shape[1]
    if each:
        return [loss, d[:, None] * z, q[:, None, None] * z[:, :, None] * z[:, None, :]]
    h = (z[:, :, None] * z[:, None, :]).reshape(len(z), c * c)
    return [loss.sum(0), d.T @ z, (q.T @ h).reshape(-1, c, c)]


def _held_out(rows: DataFrame, scale: dict, fits: dict) -> DataFrame:
    """(rank, y, x, hit) of rows: whether the fit of the other rows gives a row its label; null where only that fit itself can tell.

    From the fit of all rows a Newton step d of the others' loss F leads to w. Their Hessian H changes by a factor of exp(t) at most where logits change by t
    (as the logistic function's second derivative does), so with t the largest change by d, the gradient in w has at most the norm
    e = exp(t/2) (exp(t) - 1 - t) / t |d|_H in the metric of the Hessian there. With C the largest norm of a row in it and C e < 1, logits at the optimum
    differ from those at w by s = -log(1 - C e) at most, and a row of norm c by c s / C.
    """
    import numpy as np

    plain = {r: (*scale[r], fits[r][0][0], fits[r][1][0], fits[r][2][0]) for r in scale}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, group in batch.groupby("rank"):
                m, s, most, n, ones, w, h, g = plain[r]
                y = group["y"].to_numpy() == 1
                z = np.column_stack([np.ones(len(y)), (np.stack(group["x"].to_numpy()) - m) / s])
                _, d0, h0 = _sums(z, y.astype(float), np.repeat(w[None], len(y), 0), each=True)
                more = np.pad(_penalties(z, n) - 1, ((0, 0), (1, 0)))
                with np.errstate(all="ignore"):
                    own = h - h0 + np.eye(len(w)) * more[:, None, :]
                    sound = (np.linalg.eigvalsh(own)[:, 0] > 1e-9) & (ones - y > 0) & (ones - y < n - 1)
                    inverse = np.linalg.inv(np.where(sound[:, None, None], own, np.eye(len(w))))
                    d = -(inverse @ (g - d0 + more * w)[..., None])[..., 0]
                    t = np.maximum(np.abs(d) @ most, 1e-12)
                    norm = np.sqrt(np.maximum(np.einsum("ki,kij,kj->k", d, own, d), 0))
                    e = np.exp(t / 2) * (np.expm1(t) - t) / t * norm
                    wide = np.exp(t / 2) * np.sqrt(np.einsum("i,kij,j->k", most, np.abs(inverse), most))
                    mine = np.exp(t / 2) * np.sqrt(np.einsum("ki,kij,kj->k", z, inverse, z))
                    off = -np.log1p(-wide * e) * mine / wide + 1e-7
                    logit = (z * (w + d)).sum(1)
                    sure = sound & (wide * e < 1) & (np.abs(logit) > off)
                yield pd.DataFrame({"rank": r, "y": group["y"].to_numpy(), "x": group["x"].to_numpy(), "hit": pd.array(np.where(sure, (logit >= 0) == y, None), "boolean")})

    return rows.mapInPandas(run, "rank int, y double, x array<double>, hit boolean")


def best_feature_set(scores: DataFrame) -> DataFrame:
    """The most accurate set; of equals the one with fewer features, then the earlier."""
    return scores.orderBy(F.desc("accuracy"), F.size(F.split("features", ",")), "rank").limit(1)
