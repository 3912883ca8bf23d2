"""Channel names, types and order, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The older names of four positions, and what they are called now.
SYNONYMS = {"T3": "T7", "T4": "T8", "P7": "T5", "P8": "T6"}
#: Parts of a raw name that tell the channel's type, in the order in which they are tried.
TYPE_MARKS = [("ref", ("A1", "A2")), ("ecg", ("ECG", "EKG")), ("extra", ("PHOTIC", "IBI", "BURSTS", "SUPPR")), ("eog", ("ROC", "LOC"))]
#: What is deleted from a name, in this order.
DELETED = ("EEG", "LE", "REF", "EAR")


def renamed(name: Column, renames: dict[str, str] | None) -> Column:
    """The user's renames, before anything else."""
    if not renames:
        return name
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in renames.items() for x in kv)), name), name)


def channel_type(raw: Column, reader_type: Column) -> Column:
    """The type by the raw name's marks (case matters), else the reader's."""
    out = reader_type
    for kind, marks in reversed(TYPE_MARKS):
        has = F.lit(False)
        for m in marks:
            has = has | raw.contains(m)
        out = F.when(has, F.lit(kind)).otherwise(out)
    return out


def cleaned(raw: Column) -> Column:
    """Upper case, without the deleted parts and all but letters and digits; a bare REF stays."""
    up = F.upper(raw)
    out = up
    for part in DELETED:
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.when(up == "REF", up).otherwise(F.regexp_replace(out, r"[^\p{L}\p{N}]", ""))


def resolved(clean: Column, kind: Column) -> Column:
    """The name by type; null for a type without a rule or an empty name."""
    ecg = F.concat(F.lit("EKG"), F.regexp_replace(clean, r"[^\p{Nd}]", ""))
    ref = F.when(clean.contains("A1"), "A1").when(clean.contains("A2"), "A2").when(clean.contains("L"), "A1").when(clean.contains("R"), "A2").otherwise("REF")
    return F.when(kind == "eeg", F.nullif(clean, F.lit(""))).when(kind.isin("eog", "extra"), clean).when(kind == "ecg", ecg).when(kind == "ref", ref)


def numbered_copies(df: DataFrame, by: list[str], name: str, order: list[str], out: str) -> DataFrame:
    """Repeated names get -COPY once for each earlier one; cleaned names hold no dash, so results are unique."""
    nth = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order)) - 1
    return df.withColumn(out, F.concat(F.col(name), F.repeat(F.lit("-COPY"), nth)))


def copies(names: Column) -> Column:
    """The same for an array of names, in the order it has."""
    earlier = lambda n, i: F.size(F.filter(F.slice(names, 1, i), lambda x: x == n))
    return F.transform(names, lambda n, i: F.concat(n, F.repeat(F.lit("-COPY"), earlier(n, i))))


def cased(name: Column) -> Column:
    """First letter large, the rest small."""
    low = F.lower(name)
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 20))


def modern(name: Column) -> Column:
    return renamed(name, SYNONYMS)


def reordered(names: Column, data: Column, target: list[str]) -> Column:
    """The rows of ``data`` in the order of ``target``; null where a channel is absent."""
    return F.transform(F.array(*map(F.lit, target)), lambda c: F.try_element_at(data, F.nullif(F.array_position(names, c), F.lit(0)).cast("int")))


def missing(names: Column, target: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, target)), names)


def zero_filled(rows: Column, n: Column) -> Column:
    return F.transform(rows, lambda x: F.coalesce(x, F.array_repeat(F.lit(0.0), n)))


def resampled(samples: Column, old: float | Column, new: float) -> Column:
    """Nearest samples at another rate: floor(n * new / old) of them, without any smoothing."""
    old = old if isinstance(old, Column) else F.lit(float(old))
    n = F.size(samples)
    n_out = F.floor(n * (F.lit(float(new)) / old)).cast("int")
    at = lambda i: F.least(F.floor(i * (old / F.lit(float(new)))).cast("int"), n - 1)
    return F.when(n_out > 0, F.transform(F.sequence(F.lit(0), F.greatest(n_out, F.lit(1)) - 1), lambda i: F.get(samples, at(i)))).otherwise(F.array().cast("array<double>"))
