import math
from collections import Counter

import pytest

from kgweave.operators.units import UnitFinder, clean, read_measurement, to_picomolar, unit_table

FINDER = UnitFinder()


@pytest.mark.parametrize(
    ("kind", "value", "units", "comment", "pm"),
    [
        ("IC50", 5.0, "nM", None, 5e3),
        (" ic50 ", 5.0, " uM ", None, 5e6),
        ("K_i", 2.0, "µmol L-1", None, 2e6),
        ("Kd", 2.0, "nm", None, 2e3),
        ("EC50", 3.0, "1e-6 M", None, 3e6),
        ("EC50", 3.0, "10^-9 M", None, 3e3),
        ("IC50 (pM)", 7.0, None, None, 7),
        ("K_i_mM", 7.0, None, None, 7e9),
        ("IC50", 7.0, None, "all results in nM, mean of 3", 7e3),
        ("IC50", 7.0, None, "[µM]", 7e6),
        ("Ki", None, None, "Ki was 9,178e-06 mM", 9178),
        ("K_i", None, None, "K_i: 7282000pM (n=4)", 7282000),
        ("Kd", None, None, "measured Kd of 0.5 µM at 37 C", 5e5),
        ("pIC50", 6.0, "-", None, 1e6),
        ("-log IC50", 9.0, None, None, 1e3),
        ("Log Ki", -9.0, "Log M", None, 1e3),
    ],
)
def test_reads(kind, value, units, comment, pm):
    number, unit, power = read_measurement(FINDER, kind, value, units, comment)
    got = 10 ** (number + 12) if unit == "log_molar" else number * 10.0 ** (power + 12)
    assert math.isclose(got, pm, rel_tol=1e-9)


@pytest.mark.parametrize(
    ("kind", "value", "units", "comment"),
    [
        ("LogP", 3.0, None, None),
        ("Inhibition", 50.0, "%", None),
        ("IC50", None, "nM", "inactive at 10 uM"),
        ("IC50", math.nan, "nM", None),
        ("IC50", 5.0, None, "see protocol"),
        ("IC50", 5.0, None, None),
        ("IC50", None, None, None),
        ("pKi", None, None, None),
        (None, 5.0, "nM", None),
        ("IC50", 5.0, "bananas", None),
        ("", 1.0, "", ""),
    ],
)
def test_no_case(kind, value, units, comment):
    r = read_measurement(FINDER, kind, value, units, comment)
    assert r is None or r[1] == "other"


def test_longest_match_wins():
    assert [m[2] for m in FINDER.find(clean("3 nmol/L and 2 µg/ml, not M2"))] == ["nmol/L", "ug/ml"]


def test_spellings_are_distinct():
    assert max(Counter(k for k, _, _ in unit_table()).values()) == 1


COLS = "activity_id long, activity_type string, activity_value double, units string, activity_comment string, molecule_chembl_id string, unit string, power int"
NAMES = dict(id="activity_id", kind="activity_type", value="activity_value", units="units", comment="activity_comment", molecule="molecule_chembl_id", weight_key="chembl_id", weight="mol_weight")


def test_table(spark):
    drugs = spark.createDataFrame([("D", 500.0), ("D", 500.0), ("E", None)], "chembl_id string, mol_weight double")
    data = [
        (1, "IC50", 1.0, "ug/mL", None, "D", "clash", 1),
        (1, "IC50", 1.0, "ug/mL", None, "D", "clash", 1),
        (2, "IC50", 1.0, "ug/mL", None, "E", None, None),
        (3, "IC50", 1.0, "nM", None, None, None, None),
        (4, "IC50", -1.0, "nM", None, "D", None, None),
        (5, "Ki", 1.0, None, "x" * 200_000 + " Ki = 2 nM", "D", None, None),
        (None, "Ki", 1.0, "nM", None, "D", None, None),
    ]
    out = to_picomolar(spark.createDataFrame(data, COLS), drugs, **NAMES)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2_000_000), (3, 1000)]
    assert to_picomolar(spark.createDataFrame([], COLS), drugs, **NAMES).count() == 0
