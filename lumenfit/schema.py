"""Column names, roles and feature presets of the calibration tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIXELS = [f"pix{k}" for k in range(1, 10)]

# The column sets of the calibration data model.
RAW_COLUMNS = [
    "bmjd", "flux", "fluxerr", "xpos", "ypos", "xerr", "yerr", "xycov", "xfwhm", "yfwhm", "np",
    "dn_peak", "t_cernox", "bg_flux", "sigma_bg_flux", *PIXELS,
]
NOT_IN_TARGETS = ["xycov", "dn_peak", "t_cernox"]
FLUX_SCALED = ["fluxerr", "bg_flux", "sigma_bg_flux", "flux"]

# Columns removed from the 24 raw ones to form each feature set.
DROP_SETS = {
    "drop3": ["flux", "fluxerr", "dn_peak"],
    "drop5": ["flux", "fluxerr", "xerr", "yerr", "xycov"],
    "drop6_freq": ["flux", "fluxerr", "xerr", "yerr", "xycov", "t_cernox"],
    "drop7": ["flux", "fluxerr", "dn_peak", "xycov", "t_cernox", "xerr", "yerr"],
    "drop8": ["flux", "fluxerr", "dn_peak", "xycov", "t_cernox", "xerr", "yerr", "sigma_bg_flux"],
    "drop9": ["flux", "fluxerr", "bmjd", "dn_peak", "xycov", "t_cernox", "xerr", "yerr", "sigma_bg_flux"],
}
FEATURES_16 = ["xpos", "ypos", "np", "xfwhm", "yfwhm", "bmjd", "bg_flux", *PIXELS]
FEATURES_15 = [c for c in FEATURES_16 if c != "bmjd"]

# Which error column belongs to which input when resampling.
ERROR_OF = {
    "flux": "fluxerr", "xpos": "xerr", "ypos": "yerr", "xfwhm": "xerr", "yfwhm": "yerr",
    "bg_flux": "sigma_bg_flux", "bmjd": "bmjd_err", "np": "np_err",
    **{p: "fluxerr" for p in PIXELS},
}

RAW_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in RAW_COLUMNS])
TARGET_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in RAW_COLUMNS if c not in NOT_IN_TARGETS]
)
HISTORY_SCHEMA = T.StructType(
    [T.StructField("epoch", T.IntegerType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("loss", "accuracy", "r2_train", "r2_test", "chisq_train", "chisq_test")
    ]
)


def pixel_cols(df: DataFrame) -> list[str]:
    """F-1: columns whose name contains ``pix`` or ``pld`` in any case, error columns excluded."""
    return [
        c for c in df.columns
        if ("pix" in c.lower() or "pld" in c.lower()) and "err" not in c.lower()
    ]


def error_cols(df: DataFrame) -> list[str]:
    """Columns whose name contains ``err``; ``sigma_bg_flux`` is an error under another name."""
    return [c for c in df.columns if "err" in c.lower()]


@dataclass(frozen=True)
class Roles:
    """F-11: the columns of a frame by role, resolved from their names."""

    inputs: list[str]
    errors: list[str]
    pixels: list[str]

    @classmethod
    def of(cls, df: DataFrame, exclude=("idx", "flux")) -> "Roles":
        errors = error_cols(df)
        inputs = [c for c in df.columns if c not in errors and c not in exclude]
        return cls(inputs, errors, pixel_cols(df))


def split_roles(df: DataFrame) -> tuple[list[str], list[str]]:
    """F-11: (inputs, errors) by the ``err`` substring."""
    errors = error_cols(df)
    return [c for c in df.columns if c not in errors], errors


def feature_preset(df: DataFrame, preset: str) -> list[str]:
    """F-13: the sorted feature names of a preset that exist in ``df``.

    ``features15``, ``features16``, ``non_err`` (every column without ``err`` except the label), or one of
    :data:`DROP_SETS`. The label is never a feature.
    """
    have = set(df.columns) - {"idx", "flux", "file_key", "split"}
    if preset == "features15":
        names = set(FEATURES_15)
    elif preset == "features16":
        names = set(FEATURES_16)
    elif preset == "non_err":
        names = {c for c in have if "err" not in c}
    elif preset in DROP_SETS:
        base = set(RAW_COLUMNS) | ({"freq"} if preset.endswith("freq") else set())
        names = base - set(DROP_SETS[preset])
    else:
        raise ValueError(f"unknown feature preset {preset!r}")
    return sorted(names & have)
