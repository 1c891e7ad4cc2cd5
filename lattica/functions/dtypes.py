"""Storage types from what values are, and casts that lose nothing or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import IncompatibleSchema, LossyCast, NonIntegerCounts

#: Largest value of each unsigned type, and bounds of the signed and float targets.
UNSIGNED = (("uint8", 255), ("uint16", 65535), ("uint32", 4294967295))
EXACT_FLOAT32 = 1 << 24


def value_stats(x: DataFrame, value: str = "value") -> DataFrame:
    """One row: n, lo, hi, whole. One pass over the values."""
    v = F.col(value)
    return x.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True)).alias("whole"))


def narrowest(hi: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, most in reversed(UNSIGNED):
        out = F.when(hi <= most, name).otherwise(out)
    return out


def min_dtype(stats: DataFrame) -> DataFrame:
    """min_dtype: the narrowest unsigned type, or null for fractional, negative or larger values; for no values uint8."""
    fits = F.col("whole") & (F.coalesce("lo", F.lit(0)) >= 0)
    return stats.select(F.when(fits, narrowest(F.coalesce("hi", F.lit(0)))).alias("min_dtype"))


def storage_dtypes(stats: DataFrame, n_vars: int) -> DataFrame:
    """data_dtype, index_dtype: uint16 or uint32 for counts, else float32; columns in uint16 where they fit."""
    counts = F.col("whole") & (F.coalesce("lo", F.lit(0)) >= 0) & (F.coalesce("hi", F.lit(0)) <= UNSIGNED[2][1])
    data = F.when(counts & (F.coalesce("hi", F.lit(0)) <= UNSIGNED[1][1]), "uint16").when(counts, "uint32").otherwise("float32")
    return stats.select(data.alias("data_dtype"), F.lit("uint16" if n_vars - 1 <= UNSIGNED[1][1] else "uint32").alias("index_dtype"))


def codec_plan(stats: DataFrame) -> DataFrame:
    """codec, value_dtype: integer packing for counts, byte planes for the rest."""
    counts = F.col("whole") & (F.coalesce("lo", F.lit(0)) >= 0) & (F.coalesce("hi", F.lit(0)) <= UNSIGNED[2][1])
    return stats.select(F.when(counts, "integer").otherwise("float").alias("codec"), F.when(counts, "uint32").otherwise("float32").alias("value_dtype"))


def lossy(value: Column, target: str) -> Column:
    """Whether a cast of a value to int, long or float changes it."""
    if target == "float":
        # by way of double, as a cast of long to float to double is taken for one of long to double
        return ~(value.cast("double").cast("float").cast("double").eqNullSafe(value.cast("double")))
    lo, hi = {"int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1), "uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, UNSIGNED[2][1])}[target]
    return F.isnan(value.cast("double")) | (value != F.floor(value)) | (value < lo) | (value > hi)


def lossless_cast(x: DataFrame, target: str, value: str = "value") -> DataFrame:
    """x with its value cast, or LossyCast. Checked in one aggregate before the cast."""
    bad = x.where(lossy(F.col(value), target)).limit(1).count()
    if bad:
        raise LossyCast(f"{value} doesn't fit {target} without loss")
    return x.withColumn(value, F.col(value).cast({"uint8": "smallint", "uint16": "int", "uint32": "long"}.get(target, target)))


def output_dtype(stored: str, minimal: str | None, *, explicit: str | None = None, cast_back: bool = True) -> str:
    """The type that a read returns: an explicit one, else float32 where the minimal type fits it, else the stored one."""
    if explicit:
        return explicit
    return "float32" if cast_back and minimal in ("uint8", "uint16") else stored


def index_dtype(nnz: int) -> str:
    return "int32" if nnz < 1 << 31 else "int64"


#: The types of values in the order of their widths, whole and fractional.
WHOLE, FRACTIONAL = ("uint8", "uint16", "uint32", "int32", "int64"), ("float32", "float64")
#: Casts that lose nothing whatever the values.
SAFE = {
    "uint8": ("uint16", "uint32", "int32", "int64", "float32", "float64"), "uint16": ("uint32", "int32", "int64", "float32", "float64"),
    "uint32": ("int64", "float64"), "int32": ("int64", "float64"), "int64": (), "float32": ("float64",), "float64": (),
}
SPARK = {"uint8": "smallint", "uint16": "int", "uint32": "bigint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}


def widest(names: list[str]) -> str:
    """The type that holds the values of all; whole and fractional ones don't mix, and fractional ones must be one."""
    if len({n in FRACTIONAL for n in names}) > 1 or (names[0] in FRACTIONAL and len(set(names)) > 1):
        raise IncompatibleSchema(f"no common type for {sorted(set(names))}")
    return max(names, key=lambda n: (WHOLE + FRACTIONAL).index(n))


def float_width(source: str, explicit: str | None = None) -> str:
    """What fractional values are stored as: an explicit type, else float64 for float64 and float32 for the rest."""
    if explicit not in (None, *FRACTIONAL):
        raise ValueError(f"{explicit} is no fractional type")
    return explicit or ("float64" if source == "float64" else "float32")


def declared_codec(value_dtype: str, codec: str | None = None) -> str:
    """The codec of a push writer, which sees its values only later: that of the declared type. A fractional type has no integer codec."""
    own = "float" if value_dtype in FRACTIONAL else "integer"
    if codec not in (None, "integer", "float"):
        raise ValueError(f"codec {codec!r} is neither integer nor float")
    if codec == "integer" and own == "float":
        raise NonIntegerCounts(f"{value_dtype} values have no integer codec")
    return codec or own


def read_plan(stored: str, minimal: str | None, nnz: int, n_vars: int, *, data: str | None = None, index: str | None = None, cast_back: bool = True) -> dict:
    """data, index and safe of a read. An explicit type stands; else float32 where the narrowest type fits it, else the stored one."""
    out = data or ("float32" if cast_back and (minimal or stored) in (*[n for n in SAFE if "float32" in SAFE[n]], "float32") else stored)
    width = index or ("int32" if nnz < 1 << 31 and n_vars < 1 << 31 else "int64")
    if out not in SPARK or width not in ("int32", "int64"):
        raise ValueError(f"unknown types {out}, {width}")
    if width == "int32" and max(nnz, n_vars) >= 1 << 31:
        raise LossyCast(f"{nnz} entries don't fit int32 offsets")
    return {"data": out, "index": width, "safe": out == stored or out in SAFE[stored] or (minimal is not None and out in SAFE[minimal])}


def cast_values(x: DataFrame, stored: str, target: str, *, allow_lossy: bool = False, safe: bool = False, value: str = "value") -> DataFrame:
    """x with its value in `target`: at once for a safe pair or with allow_lossy, else after a check that nothing is lost.

    A narrowing pair is checked even where it is called safe.
    """
    known = target == stored or target in SAFE[stored]
    widening = (WHOLE + FRACTIONAL).index(target) >= (WHOLE + FRACTIONAL).index(stored)
    if not (known or allow_lossy or (safe and widening)):
        names = {"int32": "int", "int64": "long", "float32": "float"}
        if target != "float64" and x.where(lossy(F.col(value), names.get(target, target))).limit(1).count():
            raise LossyCast(f"{value} doesn't fit {target} without loss")
    return x.withColumn(value, F.col(value).cast(SPARK[target]))


def count_faults(stats: DataFrame) -> DataFrame:
    """One row: fault of values as counts, null for none: "negative", "fractional", "wide". The first that holds is given."""
    fault = F.when(F.coalesce("lo", F.lit(0)) < 0, "negative").when(~F.col("whole"), "fractional").when(F.coalesce("hi", F.lit(0)) > UNSIGNED[2][1], "wide")
    return stats.select(fault.alias("fault"))


def decide_codec(fault: str | None, source: str, codec: str | None = None) -> str:
    """integer or float, from the fault of the values as counts. Only values that aren't whole counts fall back to float of themselves.

    Wide counts of a whole source are an error; of a fractional source they are stored as they are. Negative ones of a whole source
    are an error, as no other codec holds them.
    """
    if codec == "float" or (codec is None and fault is not None and source in FRACTIONAL):
        return "float"
    if fault == "wide":
        raise ValueError("counts beyond 32 bits")
    if fault is not None:
        raise NonIntegerCounts(f"{fault} values are no counts")
    return "integer"


def bytes_per_entry(minimal: str | None, n_vars: int) -> int:
    """What an entry is sized at: counts at two bytes whatever their width, others at four; columns at two where they fit, else four."""
    return (2 if minimal else 4) + (2 if n_vars <= 65536 else 4)
