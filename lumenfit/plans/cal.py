"""The calibration table derived from ``events`` and ``embeddings``, in Spark and as SQL text.

One row per event: nine "pixels", centroid and widths come from an embedding vector, modulated by the event
number so that rows differ, and the flux depends on position and the centre pixel's share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfit.schema import FEATURES_16, NOT_IN_TARGETS, PIXELS, RAW_COLUMNS

_BASE = {
    "xpos": "145e-1 + <E10> + 1e-3*((event_id*31)%89)",
    "ypos": "145e-1 + <E11> + 1e-3*((event_id*37)%83)",
    "xfwhm": "1e0 + 1e-1*abs(<E12>)",
    "yfwhm": "1e0 + 1e-1*abs(<E13>)",
    **{
        f"pix{k}": f"(abs(<E{k}>)+5e-2)*(1e0+5e-4*((event_id*{k + 6})%97))"
        for k in range(1, 10)
    },
}
_SUM = "(" + "+".join(PIXELS) + ")"
_DERIVED = {
    "idx": "idx",
    "bmjd": "bmjd",
    "flux": "4e-1 + 2e-2*(xpos-145e-1) - 3e-2*(xpos-145e-1)*(ypos-145e-1)"
            f" + 5e-2*pix5/{_SUM} + 1e-6*v",
    "fluxerr": "2e-3 + 1e-5*(idx%11)",
    "xpos": "xpos", "ypos": "ypos",
    "xerr": "2e-3 + 1e-4*(idx%7)",
    "yerr": "2e-3 + 1e-4*(idx%5)",
    "xycov": "1e-5*(idx%3)",
    "xfwhm": "xfwhm", "yfwhm": "yfwhm",
    "np": "4e0 + xfwhm*yfwhm",
    "dn_peak": "15e2 + 1e2*pix5",
    "t_cernox": "24e0 + 1e-3*(idx%13)",
    "bg_flux": "1e-3 + 1e-5*(idx%17)",
    "sigma_bg_flux": "1e-4 + 1e-6*(idx%19)",
    **{p: p for p in PIXELS},
}


def _fill(expr: str, element: str) -> str:
    for k in range(13, 0, -1):
        expr = expr.replace(f"<E{k}>", element.format(k))
    return expr


def _mjd(df: DataFrame) -> str:
    """Microseconds since 1970 of the stored wall-clock time, whatever the session's time zone."""
    if isinstance(df.schema["ts"].dataType, T.TimestampNTZType):
        utc = "from_utc_timestamp(cast(ts as timestamp), current_timezone())"
    else:
        utc = "ts"
    return f"unix_micros({utc})/86400e6+40587e0"


def cal(spark: SparkSession, sf_dir: str, extra: dict[str, str] | None = None) -> DataFrame:
    """The calibration table; ``extra`` adds columns computed from the events row.

    An event refers to the vector whose number is its own modulo the number of vectors (numbered from 0), so that all
    vectors are in use.
    """
    extra = extra or {}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return from_events(events, vectors, extra)


def from_events(events: DataFrame, vectors: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    extra = extra or {}
    refers = F.col("event_id") % F.lit(max(1, vectors.count()))
    joined = events.join(vectors.select("vec_id", "embedding"), refers == F.col("vec_id"))
    element = "cast(element_at(embedding, {}) as double)"
    base = joined.selectExpr(
        "event_id as idx", f"{_mjd(events)} as bmjd", "value as v",
        *[f"{_fill(e, element)} as {c}" for c, e in _BASE.items()],
        *[f"{e} as {c}" for c, e in extra.items()],
    )
    return base.selectExpr(*[f"{e} as {c}" for c, e in _DERIVED.items()], *extra)


def cal_sql(extra: dict[str, str] | None = None) -> str:
    """The same table as a CTE named ``cal`` for the SQL oracle."""
    extra = extra or {}
    element = "cast(embedding[{}] as double)"
    base = ", ".join([f"{_fill(e, element)} as {c}" for c, e in _BASE.items()]
                     + [f"{e} as {c}" for c, e in extra.items()])
    derived = ", ".join([f"{e} as {c}" for c, e in _DERIVED.items()] + list(extra))
    return (
        "cal_base as (select event_id as idx, epoch_us(ts)/86400e6+40587e0 as bmjd, value as v, "
        f"{base} from events join embeddings on event_id % (select count(*) from embeddings) = vec_id), "
        f"cal as (select {derived} from cal_base)"
    )


FILE_KEY = {"file_key": "concat('t', cast(user_id % 8 as varchar(20)))"}


def cal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-target shape: no covariance, peak or temperature column, eight files."""
    return cal(spark, sf_dir, FILE_KEY).drop(*NOT_IN_TARGETS)


PRED = "flux + 1e-3*((idx%21)-10)/10e0"


def cal_pred(spark: SparkSession, sf_dir: str, extra: dict[str, str] | None = None) -> DataFrame:
    """With a known prediction, for scores that need no fitted model."""
    return cal(spark, sf_dir, extra).withColumn("prediction", F.expr(PRED))


FEATURES = sorted(FEATURES_16)
ALL = RAW_COLUMNS
