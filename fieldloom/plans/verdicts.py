"""Queries over scores, features and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import constants as K
from fieldloom.functions import spectral as X
from fieldloom.functions import text as T
from fieldloom.functions.mathx import logistic, round_up
from fieldloom.operators import scoring as C
from fieldloom.plans.geo import r
from fieldloom.sources.fixtures import table, with_
from fieldloom.sources.shared import new_folder, written

STAGE_SQL = """case when days_since_planting < 0 then 'Pré-semis' when days_since_planting <= 7 then 'Semis' when days_since_planting <= 20 then 'Levée' when days_since_planting <= 45 then 'Tallage' when days_since_planting <= 65 then 'Montaison'
  when days_since_planting <= 80 then 'Épiaison' when days_since_planting <= 110 then 'Maturation' when days_since_planting is not null then 'Récolte' end"""


def _analysed(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "analyses").withColumn("growth_stage", T.growth_stage(F.col("days_since_planting")))
    # The single-feature model has an answer wherever NDVI is known; leave it out for a third, so that every verdict occurs.
    return C.analysed(a.withColumn("ndvi", F.when(F.col("parcel_id") % 3 == 1, F.lit(None)).otherwise(F.col("ndvi"))))


def analyses(spark: SparkSession, d: str) -> DataFrame:
    a = _analysed(spark, d)
    return a.select(
        "parcel_id", "vh_vv", "agro_score", "ndvi_score", "cycle_score", "radar_score", "trend_score", "agro_details", round_up(F.col("s2_probability"), 6).alias("s2_probability"),
        "rf_level", "score", "is_barley", "confidence", "verdict", "source", F.concat_ws("|", "risk_factors").alias("risk_factors"), "barley_presence", "recommendation", "anomaly_level",
    )


ANALYSES = with_("analyses") + f""", a as (select * replace (case when parcel_id%3=1 then null else ndvi end as ndvi), {STAGE_SQL} as stage, floor(vh/vv*1000+0.5e0)/1000 as vh_vv from analyses),
p as (select *, 
  case when ndvi is null then 0e0 when ndvi between 25 and 75 then 80+(1-abs(ndvi-50)/25)*20 when ndvi between 15 and 85 then 40e0 else 10e0 end as s1,
  case when days_since_planting is null then 50e0 when days_since_planting between 0 and 130 then case
     when ndvi is null then 80e0
     when stage='Levée' and ndvi between 15 and 40 or stage='Tallage' and ndvi between 30 and 65 or stage='Montaison' and ndvi between 40 and 80 or stage='Épiaison' and ndvi between 50 and 80 then 95e0
     when stage='Maturation' and ndvi between 30 and 60 or stage='Récolte' and ndvi between 10 and 40 then 90e0 else 80e0 end when days_since_planting > 130 then 30e0 else 0e0 end as s2,
  case when vv is null or vh is null then 50e0 else least(100e0, case when vv between -14 and -8 and vh between -22 and -14 then 90e0 when vv between -16 and -6 and vh between -24 and -12 then 60e0 else 20e0 end + case when vh_vv between 0.3e0 and 0.6e0 then 10e0 else 0e0 end) end as s3,
  case when n_ndvi < 3 or ndvi_range is null then 50e0 when ndvi_range >= 15 then 70+least(30e0, ndvi_range) when ndvi_range >= 5 then 50e0 else 20e0 end as s4 from a),
g as (select *, greatest(0e0, least(100e0, floor(s1*0.3e0+s2*0.25e0+s3*0.25e0+s4*0.2e0+0.5e0))) as agro,
  1/(1+exp(-({K.LOGISTIC['intercept']}e0+{K.LOGISTIC['coef'][0]}e0*(ndvi-{K.LOGISTIC['mean'][0]}e0)/{K.LOGISTIC['std'][0]}e0))) as sp,
  case when cnn_is_barley then cnn_confidence else 100-cnn_confidence end as cnn,
  case when rf_probability < 0.15e0 then 'NON_ORGE' when rf_probability >= 0.7e0 and ndvi_oct <= 0.5e0 and doy_peak <= 245 then 'ORGE' when rf_probability is not null then 'A_VERIFIER' end as lvl from p),
h as (select *, floor(cnn*0.6e0+agro*0.4e0+0.5e0) as hs, abs(cnn-agro) as apart,
  case when rf_probability is not null then 'rf' when sp is not null then 's2' when cnn_confidence is not null then 'hybrid' else 'rules' end as source from g),
v as (select *,
  case source when 'rf' then floor(rf_probability*100+0.5e0) when 's2' then floor(sp*100+0.5e0) when 'hybrid' then hs else agro end as score,
  case source when 'rf' then rf_probability >= 0.3268e0 when 's2' then sp >= 0.5e0 when 'hybrid' then hs > 50 else agro > 50 end as yes,
  case source when 'rf' then floor(greatest(rf_probability,1-rf_probability)*100+0.5e0) when 's2' then floor(greatest(sp,1-sp)*100+0.5e0)
    when 'hybrid' then greatest(0e0, least(100e0, floor(hs-case when apart > 55 then apart*0.08e0 else 0e0 end+0.5e0))) else agro end as conf from h)
select parcel_id, vh_vv, agro as agro_score, floor(s1+0.5e0) as ndvi_score, floor(s2+0.5e0) as cycle_score, floor(s3+0.5e0) as radar_score, floor(s4+0.5e0) as trend_score,
  nullif(concat_ws(' | ',
    case when ndvi between 25 and 75 then 'NDVI '||cast(cast(ndvi as bigint) as varchar)||'% dans la plage orge' when ndvi between 15 and 85 then 'NDVI '||cast(cast(ndvi as bigint) as varchar)||'% limite pour l''orge' when ndvi is not null then 'NDVI '||cast(cast(ndvi as bigint) as varchar)||'% hors plage orge typique' end,
    case when days_since_planting between 0 and 130 then 'Cycle '||cast(days_since_planting as varchar)||'j cohérent (stade '||stage||')' when days_since_planting > 130 then 'Cycle '||cast(days_since_planting as varchar)||'j > 130j, dépasse le cycle orge' end,
    case when vv is null or vh is null then null when vv between -14 and -8 and vh between -22 and -14 then 'Radar VV='||cast(vv as varchar)||'dB VH='||cast(vh as varchar)||'dB typique cultures' when vv between -16 and -6 and vh between -24 and -12 then 'Radar acceptable mais pas typique orge' else 'Signature radar atypique pour céréales' end,
    case when n_ndvi < 3 or ndvi_range is null then null when ndvi_range >= 15 then 'Dynamique NDVI '||cast(cast(round_even(ndvi_range,0) as bigint) as varchar)||'% (bon signal cultural)' when ndvi_range >= 5 then 'Dynamique NDVI faible ('||cast(cast(round_even(ndvi_range,0) as bigint) as varchar)||'%)' else 'NDVI stable - pas typique d''une culture' end), '') as agro_details,
  {r('sp', 6)} as s2_probability, lvl as rf_level, score, yes as is_barley, conf as confidence,
  case source when 'rf' then case when not yes then '❌ NON-ORGE' when lvl='ORGE' then '✅ ORGE CONFIRMÉE' else '⚠️ ORGE À VÉRIFIER' end||' — RF Orge (probabilité d''orge '||cast(cast(score as bigint) as varchar)||'%)'
    when 's2' then case when yes then '✅ ORGE CONFIRMÉE' else '❌ NON-ORGE' end||' — Sentinel-2 (probabilité d''orge '||cast(cast(score as bigint) as varchar)||'%)'
    when 'hybrid' then case when yes then '✅ ORGE CONFIRMÉE' else '❌ NON-ORGE' end||' — CNN + Règles agro concordent'||case when apart > 55 then ' (⚠️ désaccord CNN/Agro: '||cast(cast(round_even(apart,0) as bigint) as varchar)||'%)' else '' end
    else case when yes then '⚠️ ORGE PROBABLE' else '⚠️ NON-ORGE PROBABLE' end||' (CNN indisponible, estimation agro seule) — Score agro '||cast(cast(agro as bigint) as varchar)||'%' end as verdict,
  source, concat_ws('|', case when ndvi < 15 then 'Végétation très faible' end, case when ndvi > 85 then 'Végétation trop dense pour de l''orge' end, case when vh_vv > 0.45e0 then 'Structure radar type forêt' end, case when not yes and conf > 70 then 'Verdict non-orge avec une confiance élevée' end) as risk_factors,
  case when not yes then 'none' when gdd_detected then 'confirmed' else 'probable' end as barley_presence,
  case source when 'rf' then case when yes then 'Orge' else 'Non-orge' end||' selon la dynamique saisonnière Sentinel-2 de la parcelle (probabilité d''orge '||cast(cast(score as bigint) as varchar)||'%).'
    when 's2' then case when yes then 'Orge' else 'Non-orge' end||' selon les indices Sentinel-2 de la parcelle (probabilité d''orge '||cast(cast(score as bigint) as varchar)||'%).'
    when 'hybrid' then case when yes then 'Orge '||case when conf > 70 then 'confirmée' else 'probable' end||'. Score hybride '||cast(cast(score as bigint) as varchar)||'% (CNN '||cast(cast(floor(cnn_confidence+0.5e0) as bigint) as varchar)||'% + Agro '||cast(cast(agro as bigint) as varchar)||'%).'
      else 'Non-orge détecté. Score hybride '||cast(cast(score as bigint) as varchar)||'%. Vérification terrain recommandée.' end
    else case when yes then 'Orge probable' else 'Non-orge probable' end||' (modèle CNN indisponible, estimation basée uniquement sur les règles agronomiques, score '||cast(cast(agro as bigint) as varchar)||'%). Vérification terrain recommandée.' end as recommendation,
  case when yes then 'AUCUNE' else 'FORTE' end as anomaly_level
from v
"""


BANDS = ("2", "3", "4", "5", "6", "7", "8", "8a", "11", "12")


def _features(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bands")
    bands = b.select("parcel_id", "month_key", *[X.reflectance(F.col(f"b{k}")).alias(f"B{k.upper()}") for k in BANDS])
    return C.seasonal_features(bands)


#: All 48 features, as the operator names them.
WANTED = [
    *[f"B{k.upper()}" for k in BANDS], *C.ML_INDICES, "PSRI", "MSI", "month", "day_of_year", *[f"{i}_{f}" for i in C.ML_INDICES for f in ("mean", "max", "min", "std")], "NDVI_jun", "NDVI_aug", "NDVI_sep", "NDVI_oct",
    "doy_max_ndvi", "green_span_days", "first_green_doy", "last_green_doy", "pct_green", "ndvi_falling_slope", "drop_max_to_oct", "drop_sep_oct", "ratio_oct_max", "ramp_jun_to_aug",
]


def seasonal_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("parcel_id", "month_key", *[round_up(F.col(c), 5).alias(c.lower()) for c in WANTED])


FEATURES_SQL = with_("bands") + """, x as (select parcel_id, m, month_key, """ + ", ".join(f"b{k}/10000e0 as b{k}" for k in BANDS) + """, cast(dayofyear(make_date(2025, m, 1)) as double) as doy, cast(m as double) as month, cast(dayofyear(make_date(2025, m, 1)) as double) as day_of_year from bands),
i as (select *, (b8-b4)/(b8+b4) as ndvi, 2.5e0*(b8-b4)/nullif(b8+6*b4-7.5e0*b2+1, 0) as evi, (b8-b5)/(b8+b5) as ndre, (b8-b11)/(b8+b11) as ndmi, (b4-b2)/(b6+1e-4) as psri, b11/(b8+1e-4) as msi from x),
s as (select parcel_id, """ + ", ".join(f"avg({i}) as {i}_mean, max({i}) as {i}_max, min({i}) as {i}_min, case when count({i})=1 then 0e0 else stddev_samp({i}) end as {i}_std" for i in ("ndvi", "evi", "ndre", "ndmi")) + """,
  coalesce(avg(ndvi) filter (where m=6), avg(ndvi)) as ndvi_jun, coalesce(avg(ndvi) filter (where m=8), avg(ndvi)) as ndvi_aug, coalesce(avg(ndvi) filter (where m=9), avg(ndvi)) as ndvi_sep, coalesce(avg(ndvi) filter (where m=10), avg(ndvi)) as ndvi_oct,
  min(doy) filter (where ndvi >= 0.35e0) as first_green_doy, max(doy) filter (where ndvi >= 0.35e0) as last_green_doy, count(*) filter (where ndvi >= 0.35e0)/count(*) as pct_green
  from i group by 1 having count(ndvi) > 0),
k as (select parcel_id, doy as doy_max_ndvi from (select *, row_number() over (partition by parcel_id order by ndvi desc, doy) as rn from i where ndvi is not null) where rn = 1),
f as (select i.parcel_id, case when count(*) >= 3 then coalesce(regr_slope(ndvi, doy), 0e0) else 0e0 end as slope from i join k using (parcel_id) where ndvi is not null and doy >= doy_max_ndvi group by 1),
stats as (select s.*, k.doy_max_ndvi, case when first_green_doy is null then 0e0 else f.slope end as ndvi_falling_slope, last_green_doy-first_green_doy as green_span_days,
  ndvi_max-ndvi_oct as drop_max_to_oct, ndvi_sep-ndvi_oct as drop_sep_oct, ndvi_oct/(ndvi_max+1e-4) as ratio_oct_max, ndvi_aug-ndvi_jun as ramp_jun_to_aug from s join k using (parcel_id) join f using (parcel_id))
"""
SEASONAL_FEATURES = FEATURES_SQL + f"""select i.parcel_id, i.month_key, {', '.join(f'coalesce({r(c.lower(), 5)}, 0e0) as {c.lower()}' for c in WANTED)} from i join stats using (parcel_id)"""


def index_features(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles, amplitudes and means of parts of the year of four indices."""
    b = table(spark, d, "bands")
    found = C.index_features(b.select("parcel_id", "month_key", *[X.reflectance(F.col(f"b{k}")).alias(f"B{k.upper()}") for k in BANDS]), C.CROP_PARTS, C.SEASONS)
    return found.select("parcel_id", *[round_up(F.col(c), 5).alias(c.lower()) for c in found.columns[1:]])


def _index_features_sql() -> str:
    names = {**C.CROP_PARTS, **C.SEASONS}
    of = {"mean": "avg({i})", "median": "median({i})", "std": "case when count({i})=1 then 0e0 else stddev_samp({i}) end", "min": "min({i})", "max": "max({i})", "amp": "max({i})-min({i})", "q10": "quantile_cont({i}, 0.1)", "q90": "quantile_cont({i}, 0.9)"}
    of |= {f"{name}_mean": f"avg({{i}}) filter (where m in ({', '.join(map(str, months))}))" for name, months in names.items()}
    columns = ", ".join(f"{r(sql.format(i=i), 5)} as {i}_{name}" for i in ("ndvi", "evi", "ndre", "ndmi") for name, sql in of.items())
    return FEATURES_SQL[: FEATURES_SQL.index("s as (select parcel_id")].rstrip().rstrip(",") + f" select parcel_id, {columns} from i group by 1"


#: A forest of fifteen nodes a tree, from a table that both engines have.
FOREST = """select cast(n_nationkey as int) as tree, k.node, case when k.node < 7 then cast((n_nationkey*3+k.node*5)%5 as int) end as feature,
  case when k.node < 7 then 0.1037e0+((n_nationkey*37+k.node*11)%40)/70e0 end as threshold, case when k.node < 7 then 2*k.node+1 end as left_child, case when k.node < 7 then 2*k.node+2 end as right_child,
  case when k.node >= 7 then ((n_nationkey*29+k.node*13)%100)/100e0 end as value
from nation cross join (select 0 as node union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9
  union all select 10 union all select 11 union all select 12 union all select 13 union all select 14) k"""
SPLIT_ON = ["NDVI", "NDVI_mean", "NDVI_oct", "NDVI_max", "pct_green"]


def forest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Parcel verdicts by a forest that is read from its artefact, a table of nodes."""
    path = new_folder(spark)
    C.write_forest(spark.sql(FOREST.replace("from nation", "from {nation}"), nation=spark.read.parquet(f"{d}/nation.parquet")), path)
    scores = C.forest_scores(_features(spark, d), C.read_forest(spark, path), SPLIT_ON)
    out = C.classify(scores, F.col("p"))
    return out.select("parcel_id", round_up(F.col("probability"), 5).alias("probability"), "n_observations", round_up(F.col("ndvi_oct"), 4).alias("ndvi_oct"), "doy_peak", "is_barley", "level")


FOREST_VERDICTS = FEATURES_SQL.replace("with ", "with recursive ", 1) + f""", forest as materialized ({FOREST}),
o as materialized (select parcel_id, m, [coalesce(ndvi, 0e0), coalesce(ndvi_mean, 0e0), coalesce(ndvi_oct, 0e0), coalesce(ndvi_max, 0e0), coalesce(pct_green, 0e0)] as x, ndvi_oct, doy_max_ndvi from i join stats using (parcel_id)),
walk as (select parcel_id, m, tree, 0 as node, null::double as value from o, (select distinct tree from forest)
  union all select w.parcel_id, w.m, w.tree, case when o.x[f.feature+1] <= f.threshold then f.left_child else f.right_child end, null from walk w join forest f on f.tree = w.tree and f.node = w.node and f.feature is not null join o on o.parcel_id = w.parcel_id and o.m = w.m),
scores as (select w.parcel_id, w.m, avg(f.value) as p from walk w join forest f on f.tree = w.tree and f.node = w.node and f.feature is null group by 1, 2),
p as (select parcel_id, avg(p) as p, count(*) as n, any_value(ndvi_oct) as o, any_value(doy_max_ndvi) as k from scores join o using (parcel_id, m) group by 1)
select parcel_id, {r('p', 5)} as probability, n as n_observations, {r('o', 4)} as ndvi_oct, k as doy_peak, p >= 0.3268e0 as is_barley,
  case when p < 0.15e0 then 'NON_ORGE' when p >= 0.7e0 and o <= 0.5e0 and k <= 245 then 'ORGE' else 'A_VERIFIER' end as level from p
"""


def logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "analyses")
    p = logistic(K.LOGISTIC, {"ndvi": F.col("ndvi")})
    return a.select("parcel_id", round_up(p, 6).alias("probability"), (p >= 0.5).alias("is_barley"))


LOGISTIC_SCORES = with_("analyses") + f""", p as (select parcel_id, 1/(1+exp(-({K.LOGISTIC['intercept']}e0+{K.LOGISTIC['coef'][0]}e0*(ndvi-{K.LOGISTIC['mean'][0]}e0)/{K.LOGISTIC['std'][0]}e0))) as p from analyses)
select parcel_id, {r('p', 6)} as probability, p >= 0.5e0 as is_barley from p
"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return f.withColumn("label", (F.col("NDVI_oct") + F.col("parcel_id") % 3 * 0.25 > F.col("NDVI_mean")).cast("double"))


def forest_trained(spark: SparkSession, d: str) -> DataFrame:
    """A forest trained on all features of all observations, stored, read back as nodes, and the parcels' verdicts by it. Twenty trees of depth eight stand for the operator's default of 300 of depth 30."""
    rows = written(_labelled(spark, d))
    path = new_folder(spark)
    C.train_forest(rows, "label", WANTED, trees=20, depth=8).stages[-1].save(path)
    scores = C.forest_scores(rows, C.read_forest(spark, f"{path}/data"), WANTED)
    return C.classify(scores, F.col("p")).select("parcel_id", "probability", "is_barley", "level")


def _parcel_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).groupBy("parcel_id").agg(F.max("label").alias("label"), *[F.first(c).alias(c) for c in ("NDVI_mean", "NDVI_oct", "NDVI_max", "pct_green")])
    return rows.withColumn("pct_green", F.when(F.col("parcel_id") % 10 != 0, F.col("pct_green")))


def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    names = ["NDVI_mean", "NDVI_oct"]
    rows = _parcel_rows(spark, d).persist()
    m = C.fit_logistic(rows, names, "label")
    rows.unpersist()
    found = [(f, *(round(float(x), 3) + 0.0 for x in (a, s, c, m["intercept"]))) for f, a, s, c in zip(names, m["mean"], m["std"], m["coef"], strict=True)]
    return spark.createDataFrame(found, "feature string, mean double, std double, coef double, intercept double")


def _newton(keys: str) -> str:
    """SQL of a step of Newton's method for a logistic model with two features u and v: sums over rows of its gradient and Hessian, then Cramer's rule. Weights but the constant are penalised by half their squares."""
    det = lambda a: f"({a[0]}*({a[4]}*{a[8]}-{a[5]}*{a[7]})-{a[1]}*({a[3]}*{a[8]}-{a[5]}*{a[6]})+{a[2]}*({a[3]}*{a[7]}-{a[4]}*{a[6]}))"
    h, g = ["h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22"], ["g0", "g1", "g2"]
    step = [f"{det([g[i // 3] if i % 3 == k else x for i, x in enumerate(h)])}/{det(h)}" for k in range(3)]
    return f"""select k+1, {keys}w0-{step[0]}, w1-{step[1]}, w2-{step[2]} from (
    select k, {keys}w0, w1, w2, sum(p-y) as g0, sum((p-y)*u)+w1 as g1, sum((p-y)*v)+w2 as g2, sum(p*(1-p)) as h00, sum(p*(1-p)*u) as h01, sum(p*(1-p)*v) as h02, sum(p*(1-p)*u*u)+1 as h11, sum(p*(1-p)*u*v) as h12, sum(p*(1-p)*v*v)+1 as h22
    from (select *, 1/(1+exp(-(w0+w1*u+w2*v))) as p from fit join z {'using (rank, o)' if keys else 'on true'} where k < 15) group by k, {keys}w0, w1, w2)"""


LABELLED_SQL = FEATURES_SQL.replace("with ", "with recursive ", 1) + """, l as (select parcel_id, case when ndvi_oct+parcel_id%3*0.25e0 > ndvi_mean then 1e0 else 0e0 end as y, ndvi_mean as a, ndvi_oct as b, case when parcel_id%10<>0 then coalesce(pct_green, 0e0) end as c from stats)"""
LOGISTIC_FIT = LABELLED_SQL + f""", m as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from l), z as materialized (select y, (a-ma)/sa as u, (b-mb)/sb as v from l, m),
fit(k, w0, w1, w2) as (select 0, 0e0, 0e0, 0e0 union all {_newton('')}), best as (select * from fit order by k desc limit 1)
select feature, round(case feature when 'NDVI_mean' then ma else mb end, 3) as mean, round(case feature when 'NDVI_mean' then sa else sb end, 3) as std, round(case feature when 'NDVI_mean' then w1 else w2 end, 3) as coef, round(w0, 3) as intercept
from m, best, (select unnest(['NDVI_mean', 'NDVI_oct']) as feature)
"""


def feature_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = [["NDVI_mean"], ["NDVI_oct"], ["NDVI_mean", "NDVI_oct"], ["NDVI_oct", "pct_green"]]
    scores = written(C.leave_one_out(_parcel_rows(spark, d), sets, "label", "parcel_id"))
    best = C.best_feature_set(scores).first()
    out = scores.select("rank", "features", "n_rows", round_up(F.col("accuracy"), 6).alias("accuracy"), round_up(F.col("majority"), 6).alias("majority"), (F.col("rank") == (best["rank"] if best else -1)).alias("best"))
    return out


FEATURE_SETS = LABELLED_SQL + f""", own as materialized (select 0 as rank, parcel_id as o, y, a as u, 0e0 as v from l union all select 1, parcel_id, y, b, 0e0 from l union all select 2, parcel_id, y, a, b from l union all select 3, parcel_id, y, b, c from l where c is not null),
m as (select t.rank, t.o, avg(r.u) as mu, stddev_pop(r.u) as su, avg(r.v) as mv, stddev_pop(r.v) as sv from own t join own r on r.rank = t.rank and r.o <> t.o group by 1, 2),
z as materialized (select m.rank, m.o, y, (u-mu)/coalesce(nullif(su, 0), 1) as u, (v-mv)/coalesce(nullif(sv, 0), 1) as v from m join own on own.rank = m.rank and own.o <> m.o),
fit(k, rank, o, w0, w1, w2) as (select 0, rank, o, 0e0, 0e0, 0e0 from m union all {_newton('rank, o, ')}),
hits as (select own.rank, y, (w0+w1*(u-mu)/coalesce(nullif(su, 0), 1)+w2*(v-mv)/coalesce(nullif(sv, 0), 1) >= 0) = (y = 1) as hit from fit join m using (rank, o) join own using (rank, o) where k = 15),
scores as (select rank, count(*) as n_rows, avg(case when hit then 1e0 else 0e0 end) as accuracy, greatest(avg(y), 1-avg(y)) as majority from hits group by 1 having count(*) >= 0.8e0*(select count(*) from l))
select cast(rank as integer) as rank, ['NDVI_mean', 'NDVI_oct', 'NDVI_mean,NDVI_oct', 'NDVI_oct,pct_green'][rank+1] as features, n_rows, {r('accuracy', 6)} as accuracy, {r('majority', 6)} as majority,
  row_number() over (order by accuracy desc, case when rank < 2 then 1 else 2 end, rank) = 1 as best from scores
"""

QUERIES = {
    "analyses": (analyses, ANALYSES),
    "seasonal_features": (seasonal_features, SEASONAL_FEATURES),
    "index_features": (index_features, _index_features_sql()),
    "forest_verdicts": (forest_verdicts, FOREST_VERDICTS),
    "logistic_scores": (logistic_scores, LOGISTIC_SCORES),
    "forest_trained": (forest_trained, None),
    "logistic_fit": (logistic_fit, LOGISTIC_FIT),
    "feature_sets": (feature_sets, FEATURE_SETS),
}
