"""Quantities recorded in different units (problem 5).

A multi-pattern automaton over all spellings of units reads the unit field, the type and
the comment of each measurement; of overlapping spellings the longest wins, and the field
it stands in and the number beside it decide what it means.  The unit's factor is joined
from a table of conversion factors that is built from prefixes and so has a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Powers of ten of the prefixes, and how amounts, masses and volumes are written.
PREFIXES = {"f": -15, "p": -12, "n": -9, "u": -6, "m": -3, "": 0}
PREFIX_NAMES = {"femto": -15, "pico": -12, "nano": -9, "micro": -6, "milli": -3, "": 0}
PER_LITRE = ["/L", "/l", " L-1", " l-1", ".L-1", ".l-1", "/dm3", ".dm-3", " dm-3", "/liter", "/litre"]
VOLUMES = {"L": 0, "l": 0, "dL": -1, "dl": -1, "mL": -3, "ml": -3, "uL": -6, "ul": -6}


def unit_table() -> list[tuple[str, str, int]]:
    """(spelling, unit, power of ten to mol/L or g/L); spellings have u for micro and single blanks."""
    out: dict[str, tuple[str, int]] = {}
    for p, e in PREFIXES.items():
        out[p + "M"] = ("molar", e)
        for v in PER_LITRE:
            out[f"{p}mol{v}"] = ("molar", e)
        for vol, ve in VOLUMES.items():
            for form in (f"{p}g/{vol}", f"{p}g.{vol}-1", f"{p}g {vol}-1"):
                out[form] = ("mass", e - ve)
            for form in (f"{p}mol/{vol}", f"{p}mol.{vol}-1", f"{p}mol {vol}-1"):
                out.setdefault(form, ("molar", e - ve))
        for e_written in (f"1e{e} M", f"10^{e} M", f"1e{e:03d} M", f"10e{e} M"):
            if e:
                out[e_written] = ("molar", e + (1 if e_written.startswith("10e") else 0))
    for p in "fpnu":
        out[p + "m"] = ("molar", PREFIXES[p])  # in a potency's unit a small m can only be molar
    for name, e in PREFIX_NAMES.items():
        out[name + "molar"] = ("molar", e)
    out["Log M"] = out["log M"] = out["log(M)"] = ("log_molar", 0)
    for other in ("%", "h", "min", "mL/min/kg", "ml/min/kg"):
        out[other] = ("other", 0)
    return [(k, *v) for k, v in out.items()]


_POTENCY = re.compile(r"^(?P<log>-\s?log\s*|p(?=[IEAK])|log\s*)?(?P<kind>[iea]c\s?50|k_?[id])(?![a-z0-9])", re.I)
_NUMBER = r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
_READING = re.compile(rf"(?:[iea]c\s?50|k_?[id])(?![a-z0-9])\s*(?:=|:|was|of|is)?\s*(?P<v>{_NUMBER})(?P<gap>\s*)$", re.I)


def clean(text: str | None) -> str:
    """Micro signs as u, runs of blanks as one, no blanks around."""
    return "" if text is None else re.sub(r"\s+", " ", text.replace("µ", "u").replace("μ", "u")).strip()


class UnitFinder:
    """Longest-match search for unit spellings that stand alone."""

    def __init__(self) -> None:
        self.units = {k: (u, e) for k, u, e in unit_table()}
        self.automaton = ahocorasick.Automaton()
        for k in self.units:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def _matches(self, text: str):
        return [(e + 1 - len(k), e + 1, k) for e, k in self.automaton.iter(text)]

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Disjoint matches from left to right, of overlapping ones the longest.

        No letter may adjoin; a digit may stand before (2nM) but not after."""
        good = [m for m in self._matches(text) if not (m[1] < len(text) and (text[m[1]].isalnum() or text[m[1]] == "/")) and not (m[0] and (text[m[0] - 1].isalpha() or text[m[0] - 1] == "/") and text[m[0]].isalpha())]
        out: list[tuple[int, int, str]] = []
        for m in sorted(good, key=lambda m: (m[0] - m[1], m[0])):
            if all(m[1] <= o[0] or m[0] >= o[1] for o in out):
                out.append(m)
        return sorted(out)


def read_measurement(finder: UnitFinder, kind: str | None, value: float | None, units: str | None, comment: str | None) -> tuple[float, str, int] | None:
    """(number, unit, power of ten) of a potency, or None where value or unit can't be told."""
    label, unit_text, note = clean(kind), clean(units), clean(comment)
    m = _POTENCY.match(label)
    if not m:
        return None
    log, rest = (m.group("log") or "").strip().lower(), label[m.end() :].strip(" _()[],")
    number = None if value is None or not np.isfinite(value) else float(value)
    if log in ("-log", "p") or log.startswith("-"):
        return None if number is None or unit_text not in ("", "-") and finder.units.get(unit_text, ("",))[0] != "log_molar" else (-number, "log_molar", 0)
    if log == "log":
        return None if number is None else (number, "log_molar", 0)
    unit = None
    for text in (unit_text, rest):
        if text in finder.units:
            unit = finder.units[text]
        elif text and text != "-":
            hits = finder.find(text)
            if len(hits) != 1 or text[: hits[0][0]].strip(" ([,") or text[hits[0][1] :].strip(" )],"):
                return None
            unit = finder.units[hits[0][2]]
        if unit:
            break
    if number is None and unit is None and note:
        for a, _, spelling in finder.find(note):
            r = _READING.search(note[:a])
            if r:
                return float(r.group("v").replace(",", ".")), *finder.units[spelling]
        return None
    if number is not None and unit is None and note:
        named = {finder.units[s] for a, _, s in finder.find(note) if not re.search(r"\d\s*$", note[:a]) and len(s) > 1 or note[:a].endswith(("units: ", "[", " in "))}
        unit = named.pop() if len(named) == 1 else None
    return None if number is None or unit is None else (number, *unit)


def read_label(finder: UnitFinder, kind: str | None, units: str | None, comment: str | None) -> tuple[float, str | None, int, float, str | None, int]:
    """What the texts of a record say, whatever its number: (sign, unit, power) if it has one and (number, unit, power) if not.

    The number itself plays no part in reading the texts, so records with equal texts share one reading."""
    given, missing = read_measurement(finder, kind, 1.0, units, comment), read_measurement(finder, kind, None, units, comment)
    return *(given or (0.0, None, 0)), *(missing or (0.0, None, 0))


def factor_table(spark: SparkSession) -> DataFrame:
    """(unit, power, factor): factors to picomoles per litre, for masses before division by the molar weight."""
    powers = sorted({(u, e) for _, u, e in unit_table()})
    return spark.createDataFrame([(u, e, float(10.0 ** (e + 12))) for u, e in powers], "unit string, power int, factor double")


def to_picomolar(rows: DataFrame, weights: DataFrame, *, id: str, kind: str, value: str, units: str, comment: str, molecule: str, weight_key: str, weight: str) -> DataFrame:
    """Potencies as whole picomoles per litre: (id, value_pm), each id once.

    Masses are divided by the molecule's molar weight; without a weight they are no case.
    Values that are null, NaN or not above zero, unknown units and other kinds of
    measurement give no row.  Empty tables give an empty result; further columns are ignored.
    """
    fields = [("sign", T.DoubleType()), ("given_unit", T.StringType()), ("given_power", T.IntegerType()), ("told", T.DoubleType()), ("told_unit", T.StringType()), ("told_power", T.IntegerType())]
    schema = T.StructType([T.StructField("id", rows.schema[id].dataType), T.StructField("molecule", T.StringType()), T.StructField("value", T.DoubleType()), *[T.StructField(n, t) for n, t in fields]])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = UnitFinder()
        for pdf in parts:
            # Each distinct combination of texts is searched once a batch; its reading is given to all its rows.
            at, texts = pd.factorize(pd.MultiIndex.from_frame(pdf[["kind", "units", "comment"]]))
            told = pd.DataFrame([read_label(finder, *(None if x != x else x for x in t)) for t in texts], columns=[n for n, _ in fields])
            yield pd.concat([pdf[["id", "molecule", "value"]].reset_index(drop=True), told.take(at).reset_index(drop=True)], axis=1).astype({"given_power": "int32", "told_power": "int32"})

    source = rows.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(kind).alias("kind"), F.col(value).cast("double").alias("value"), F.col(units).alias("units"), F.col(comment).alias("comment"), F.col(molecule).alias("molecule"))
    has = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    number = F.when(has, F.col("value") * F.col("sign")).otherwise(F.col("told"))
    unit, power = (F.when(has, F.col(f"given_{c}")).otherwise(F.col(f"told_{c}")) for c in ("unit", "power"))
    measured = source.mapInPandas(read, schema).select("id", "molecule", number.alias("number"), unit.alias("unit"), power.alias("power")).filter("unit is not null and unit <> 'other'")
    read_rows = measured.join(F.broadcast(factor_table(rows.sparkSession)), ["unit", "power"])
    masses = weights.filter(F.col(weight) > 0).groupBy(F.col(weight_key).alias("molecule")).agg(F.max(weight).alias("weight"))
    plain = read_rows.filter("unit <> 'mass'").withColumn("weight", F.lit(None).cast("double"))
    by_mass = read_rows.filter("unit = 'mass'").join(masses, "molecule").select(*plain.columns)
    pm = F.when(F.col("unit") == "log_molar", F.pow(F.lit(10.0), F.col("number") + 12)).when(F.col("unit") == "mass", F.col("number") * F.col("factor") / F.col("weight")).otherwise(F.col("number") * F.col("factor"))
    out = plain.unionByName(by_mass).withColumn("pm", pm).filter((F.col("pm") > 0) & (F.col("pm") < 9e18))
    return out.groupBy("id").agg(F.max("pm").alias("pm")).select(F.col("id").alias(id), F.bround("pm", 0).cast("long").alias("value_pm"))
