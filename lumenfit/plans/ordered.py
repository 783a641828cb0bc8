"""Catalogue: ordered operators, splits, batches, run registry (W-1 .. W-10, P-1 .. P-5, M-1 .. M-6)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lumenfit.operators import features as fe
from lumenfit.operators import forest, index, splits
from lumenfit.plans.cal import FEATURES, FILE_KEY, cal
from lumenfit.functions.hashing import poisson1_sql, uniform_sql
from lumenfit.plans.registry import on_cal, query, rnd, rounded, sql_rnd, sql_rounded
from lumenfit.sources import runs

BUCKET = 2000  # rows per ordering bucket, small enough for several buckets on the driver tables


@query("lag_diff", on_cal(
    "select idx, " + sql_rnd("bmjd - lag(bmjd) over (order by idx)", 9) + " as bmjd_diff from cal"))
def lag_diff(spark, sf):
    return rounded(index.lag_diff(cal(spark, sf), "bmjd", rows_per_bucket=BUCKET), ["bmjd_diff"], 9)


@query("dense_index", on_cal("select idx, row_number() over (order by bmjd, idx) - 1 as rn from cal"))
def dense_index(spark, sf):
    out = index.with_dense_index(cal(spark, sf), ["bmjd", "idx"], rows_per_bucket=BUCKET)
    return out.select("idx", "rn")


@query("dense_index_tied", on_cal(
    "select idx, row_number() over (order by xycov, idx) - 1 as rn from cal"))
def dense_index_tied(spark, sf):
    """The leading order column has three values, so each is a hot value cut again by the second."""
    out = index.with_dense_index(cal(spark, sf), ["xycov", "idx"], rows_per_bucket=BUCKET)
    return out.select("idx", "rn")


@query("time_span", on_cal(
    "select " + sql_rounded({
        "t_min": "min(bmjd)", "t_max": "max(bmjd)", "t_range": "max(bmjd)-min(bmjd)", "min_step": "min(d)",
    }) + ", count(*) as n from d",
    "d as (select bmjd, bmjd - lag(bmjd) over (order by idx) as d from cal)"))
def time_span(spark, sf):
    return rounded(index.time_span(cal(spark, sf)), ["t_min", "t_max", "t_range", "min_step"], keep=("n",))


_RANKED = ["xpos", "ypos", "xfwhm", "yfwhm", "bg_flux", "pix1", "pix5", "pix9"]
_CORR = [
    "w as (select file_key, " + ", ".join(f"abs(corr({c}, flux)) as {c}" for c in _RANKED)
    + " from cal group by file_key)",
    "l as (" + " union all ".join(f"select file_key, '{c}' as feature, {c} as v from w" for c in _RANKED) + ")",
    "imp as (select file_key, feature, v / sum(v) over (partition by file_key) as importance from l)",
    "rk as (select *, row_number() over (partition by file_key order by importance desc, feature) as rank "
    "from imp)",
    "cu as (select *, sum(importance) over (partition by file_key order by rank) as cumulative from rk)",
    "kk as (select *, least(sum(case when cumulative < 95e-2 then 1 else 0 end) over (partition by file_key) + 1,"
    " count(*) over (partition by file_key)) as k from cu)",
]


def _importance_like(spark, sf):
    """Per file, every feature's share of the absolute correlations with the flux."""
    wide = cal(spark, sf, FILE_KEY).groupBy("file_key").agg(
        *[F.abs(F.corr(c, "flux")).alias(c) for c in _RANKED]
    )
    total = sum((F.col(c) for c in _RANKED[1:]), F.col(_RANKED[0]))
    return wide.select("file_key", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col(c) / total).alias("importance")) for c in _RANKED
    ])).alias("r")).select("file_key", "r.*")


@query("importance_rank", on_cal(
    f"select file_key, feature, {sql_rnd('importance')} as importance, cast(rank as int) as rank from rk",
    *_CORR, extra=FILE_KEY))
def importance_rank(spark, sf):
    out = forest.rank_importances(_importance_like(spark, sf), by="file_key")
    return rounded(out, ["importance"], keep=("file_key", "feature", "rank"))


@query("importance_cumsum", on_cal(
    f"select file_key, feature, cast(rank as int) as rank, {sql_rnd('cumulative')} as cumulative, "
    "cast(k as bigint) as k, rank <= k as selected from kk", *_CORR, extra=FILE_KEY))
def importance_cumsum(spark, sf):
    out = forest.select_k(_importance_like(spark, sf), 0.95, by="file_key")
    return out.select("file_key", "feature", "rank", rnd("cumulative").alias("cumulative"), "k", "selected")


_KEEP = ["xpos", "ypos", "pix5"]


@query("feature_slice", on_cal(f"select idx, {sql_rounded(_KEEP, 9)} from cal"))
def feature_slice(spark, sf):
    packed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cal(spark, sf))
    cut = forest.slice_features(packed.select("idx", "features"), FEATURES, _KEEP)
    return rounded(fe.unpack_features(cut, _KEEP, "selected", extra=("idx",)), _KEEP, 9)


_HIST = "h as (select user_id as run, event_id as epoch, value as r2_test from events)"


@query("running_best", "with " + _HIST + ", b as (select *, max(r2_test) over (partition by run order by epoch) "
       "as best from h) select run, epoch, r2_test, best, r2_test >= best as is_record from b")
def running_best(spark, sf):
    h = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "user_id as run", "event_id as epoch", "value as r2_test"
    )
    return index.running_best(h, "r2_test", by="run", chunk=1000)


@query("epoch_shuffle", on_cal(
    "select idx, md5(idx || ':3:42') as order_key, " + sql_rnd("flux", 9) + " as flux from cal"))
def epoch_shuffle(spark, sf):
    return splits.epoch_order(cal(spark, sf), 3).select("idx", "order_key", rnd("flux", 9).alias("flux"))


@query("batch_assign", on_cal(
    "select idx, b as batch from (select idx, (row_number() over (order by idx) - 1) // 32 as b, "
    "count(*) over () as n from cal) where b < n // 32"))
def batch_assign(spark, sf):
    return splits.assign_batches(cal(spark, sf), 32, rows_per_bucket=BUCKET).select("idx", "batch")


@query("batch_sample", on_cal(
    "select batch, slot, idx, " + sql_rnd("flux", 9) + " as flux from draws join numbered using (pos)",
    "numbered as (select idx, flux, row_number() over (order by idx) - 1 as pos, count(*) over () as n from cal)",
    "ids as (select unnest(range((n // 50) * 50)) as id, n from (select count(*) as n from cal))",
    f"draws as (select id // 50 as batch, id % 50 as slot, cast(floor({uniform_sql('42', '1', 'id')} * n) as bigint) as pos "
    "from ids)"))
def batch_sample(spark, sf):
    """Batches drawn with replacement; every draw is a digest that SQL repeats."""
    df = cal(spark, sf)
    drawn = splits.sample_batches(df, df.count() // 50, 50, epoch=1)
    return drawn.select("batch", "slot", "idx", rnd("flux", 9).alias("flux"))


_RANK = "h as (select idx, row_number() over (order by md5(idx || ':42')) as r, count(*) over () as n from cal)"


@query("split_75_25", on_cal(
    "select idx, case when r <= ceil(75e-2*n) then 'test' else 'train' end as split from h", _RANK))
def split_75_25(spark, sf):
    return splits.hash_split(cal(spark, sf), test_size=0.75).select("idx", "split")


@query("split_20_40_40", on_cal(
    "select idx, case when r <= v then 'val' when r <= v + ceil(5e-1*(n-v)) then 'test' else 'train' end as split "
    "from (select *, ceil(2e-1*n) as v from h)", _RANK))
def split_20_40_40(spark, sf):
    return splits.hash_split3(
        cal(spark, sf), fracs={"val": 0.2, "test": 0.4, "train": 0.4}
    ).select("idx", "split")


@query("split_60_20_20", on_cal(
    "select idx, case when r <= v then 'train' when r <= v + ceil(5e-1*(n-v)) then 'test' else 'val' end as split "
    "from (select *, ceil(6e-1*n) as v from h)", _RANK))
def split_60_20_20(spark, sf):
    return splits.hash_split3(cal(spark, sf)).select("idx", "split")


@query("folds_10", on_cal(
    "select idx, cast(cast('0x' || substr(md5(idx || ':42'), 1, 15) as bigint) % 10 as int) as fold from cal"))
def folds_10(spark, sf):
    return splits.hash_folds(cal(spark, sf), k=10).select("idx", "fold")


@query("bootstrap_weights", on_cal(
    "select tree, count(*) as n, sum(w)::bigint as total, sum(w * idx)::bigint as weighted, "
    "count(*) filter (w = 0) as out_of_bag, max(w)::int as most from w group by tree",
    "trees as (select unnest(range(8)) as tree)",
    f"w as (select tree, idx, {poisson1_sql('u')} as w from (select tree, idx, {uniform_sql('42', 'idx', 'tree')} as u "
    "from cal, trees))"))
def bootstrap_weights(spark, sf):
    """How often each tree draws the rows; every draw is a digest that SQL repeats."""
    w = splits.bootstrap_weights(cal(spark, sf), n_trees=8, own_digests=True).select("idx", F.posexplode("w").alias("tree", "w"))
    return w.groupBy(F.col("tree").cast("bigint").alias("tree")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").cast("bigint").alias("total"),
        F.sum(F.col("w") * F.col("idx")).cast("bigint").alias("weighted"), F.count_if(F.col("w") == 0).alias("out_of_bag"),
        F.max("w").cast("int").alias("most"),
    )


_SETTINGS = {
    "n_nalu_layers": "cast(1 + event_id % 3 as int)",
    "n_nalu_neurons": "cast((event_id % 4) * 8 as int)",
    "n_classes": "cast(1 as int)",
    "batch_size": "cast(32 * (1 + event_id % 2) as int)",
    "learning_rate": "case when event_id % 3 = 0 then 1e-3 when event_id % 3 = 1 then 1e-2 else 1e-1 end",
    "n_epochs": "cast(200 + event_id % 1800 as int)",
    "test_size": "case when event_id % 2 = 0 then 75e-2 else 25e-2 end",
    "random_state": "cast(user_id as int)",
    "pre_process": "event_id % 2 = 0",
    "pca_transform": "event_id % 5 = 0",
}
_S = "s as (select event_id, " + ", ".join(f"{e} as {c}" for c, e in _SETTINGS.items()) + " from events)"
_NAME = "'saves_nnl' || n_nalu_layers || '_nnn' || n_nalu_neurons || '_nc' || n_classes || '_bs' || batch_size || " \
        "'_lr' || learning_rate || '_ne' || n_epochs || '_ts' || test_size || '_rs' || random_state || '_PP' || " \
        "cast(pre_process as int) || '_PCA' || cast(pca_transform as int) || '/'"


def _run_table(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", *[f"{e} as {c}" for c, e in _SETTINGS.items()]
    )


@query("run_name_compose", f"with {_S} select event_id, {_NAME} as path from s")
def run_name_compose(spark, sf):
    return runs.compose_run(_run_table(spark, sf)).select("event_id", "path")


@query("run_name_parse", f"with {_S} select *, null::varchar as warm_start from s")
def run_name_parse(spark, sf):
    paths = runs.compose_run(_run_table(spark, sf)).select("event_id", "path")
    return runs.parse_run(paths).select("event_id", *_SETTINGS, "warm_start")


_CKPT = {
    "loss": "concat('1.', cast(event_id % 997 as varchar(9)), 'e-05')",
    "acc": "concat('0.', cast(10000 + event_id % 89999 as varchar(9)))",
    "br2": "concat('0.', cast(1000 + event_id % 8999 as varchar(9)))",
    "tr2": "concat('0.', cast(1000 + (event_id * 7919) % 8999 as varchar(9)))",
    "ep": "case when event_id % 10 = 9 then '_FINAL' else cast(event_id % 10 as varchar(9)) end",
}
_CKPT_PATH = ("concat('saves_', cast(user_id as varchar(20)), '/model_epoch', ep, '_l', loss, '_a', acc, "
              "'_BatchR2-', br2, '_TestR2-', tr2, '.ckpt')")
_C = ("c0 as (select event_id, user_id, " + ", ".join(f"{e} as {c}" for c, e in _CKPT.items()) + " from events), "
      f"c as (select *, {_CKPT_PATH} as path from c0)")


def _checkpoints(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", "user_id", *[f"{e} as {c}" for c, e in _CKPT.items()]
    )
    return df.selectExpr("event_id", "user_id", f"{_CKPT_PATH} as path")


@query("checkpoint_parse", f"with {_C} select event_id, try_cast(ep as int) as epoch, ep = '_FINAL' as is_final, "
       "cast(loss as double) as loss, cast(acc as double) as accuracy, cast(br2 as double) as batch_r2, "
       "cast(tr2 as double) as test_r2 from c")
def checkpoint_parse(spark, sf):
    return runs.parse_checkpoint(_checkpoints(spark, sf)).drop("path", "user_id")


@query("checkpoint_compose", f"with {_C} select event_id, try_cast(ep as int) as epoch, ep = '_FINAL' as is_final, "
       "cast(loss as double) as loss, cast(acc as double) as accuracy, cast(br2 as double) as batch_r2, "
       "cast(tr2 as double) as test_r2 from c")
def checkpoint_compose(spark, sf):
    """File names composed from epochs and scores carry them through a reading back."""
    known = runs.parse_checkpoint(_checkpoints(spark, sf)).drop("path", "is_final")
    named = runs.compose_checkpoint(known, F.concat(F.lit("saves_"), F.col("user_id").cast("string"), F.lit("/")))
    return runs.parse_checkpoint(named.select("event_id", "path")).drop("path")


@query("best_checkpoint", f"with {_C} select user_id, path as best_path, cast(tr2 as double) as best_test_r2 from "
       "(select *, row_number() over (partition by user_id order by cast(tr2 as double) desc, path desc) as r from c)"
       " where r = 1")
def best_checkpoint(spark, sf):
    return runs.best_run(runs.parse_checkpoint(_checkpoints(spark, sf)), by="user_id")


_SAVE = ("case event_id % 4 when 0 then 'randForest_STD_approach.save' when 1 then 'randForest_PCA_approach.save' "
         "when 2 then 'randForest_RFI_PCA_approach.save' else 'randForest_RFI_ICA_approach.save' end")


@query("approach_parse", f"select event_id, {_SAVE} as path, case event_id % 4 when 0 then 'STD' when 1 then 'PCA' "
       "when 2 then 'RFI_PCA' else 'RFI_ICA' end as rf_type from events")
def approach_parse(spark, sf):
    saves = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", f"{_SAVE} as path")
    return runs.parse_approach(saves)


@query("default_neurons", f"with {_S} select event_id, cast(case when n_nalu_neurons > 0 then n_nalu_neurons else 16 "
       "end as int) as n_nalu_neurons from s")
def default_neurons(spark, sf):
    return runs.default_neurons(_run_table(spark, sf), 16).select("event_id", "n_nalu_neurons")
