"""Scalar and text functions against hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from scoutframe.functions import expr as X
from scoutframe.functions import text as T


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict()


def d(x):
    return F.lit(x).cast("double")


def test_safe_div(spark):
    cases = {"a": (9, 4, 2.25), "b": (3, 0, None), "c": (3, None, None), "e": (None, 3, None), "f": (3, -3, None), "g": (0, 7, 0.0)}
    got = one(spark, **{k: X.safe_div(d(a), d(b)) for k, (a, b, _) in cases.items()})
    assert got == {k: v[2] for k, v in cases.items()}


def test_formulas(spark):
    """A player with 7 of 16 (3 threes), 4 free throws, 6 turnovers and 5 assists in 32 of 200 team minutes."""
    got = one(
        spark,
        efg=X.efg(d(7), d(3), d(16)),
        ts=X.true_shooting(d(21), d(16), d(4)),
        poss=X.possessions(d(61), d(18), d(9), d(13)),
        usage=X.usage(d(16), d(4), d(6), d(32), d(200), d(61), d(18), d(13)),
        tov=X.turnover_pct(d(6), d(16), d(4)),
        ast=X.assist_pct(d(5), d(32), d(200), d(27), d(7)),
        reb=X.rebound_pct(d(8), d(32), d(200), d(34), d(30)),
        stl=X.steal_pct(d(2), d(32), d(200), d(70)),
        blk=X.block_pct(d(3), d(32), d(200), d(58), d(22)),
    )
    want = {
        "efg": 8.5 / 16, "ts": 21 / 35.52, "poss": 72.92, "usage": 100 * 23.76 * 40 / (32 * 81.92), "tov": 600 / 23.76,
        "ast": 500 / (0.8 * 27 - 7), "reb": 32000 / 2048, "stl": 8000 / 2240, "blk": 12000 / 1152,
    }
    assert got == pytest.approx(want)


def test_rounding_and_means(spark):
    got = one(
        spark, a=X.half_even(d(0.5)), b=X.half_even(d(1.5)), c=X.half_even(d(2.5)), e=X.row_mean(d(80), d(None), d(80), d(80)),
        f=X.row_mean(d(None), d(None)), g=X.geo_mean(d(4), d(9)), h=X.geo_mean(d(4), d(None)), i=X.weighted_mean([d(50), d(None)], [1, 3]),
    )
    assert got == {"a": 0, "b": 2, "c": 2, "e": 80.0, "f": None, "g": pytest.approx(6.0), "h": None, "i": None}


def test_text(spark):
    made, attempted = T.made_attempted(F.lit("1.2-4.6"))
    none, _ = T.made_attempted(F.lit("--"))
    got = one(
        spark, made=made, attempted=attempted, none=none, h=T.height_inches(F.lit("6' 9\"")), bad=T.height_inches(F.lit("99' 9\"")),
        a=T.match_key(F.lit("T. J. Warren")), b=T.match_key(F.lit("TJ Warren")), c=T.match_key(F.lit("Gary Payton II")),
        e=T.match_key(F.lit("Asbjørn Midtgaard")), f=T.match_key(F.lit("De'Andre O'Neal")), g=T.school_key(F.lit("Texas A&M")),
        i=T.school_key(F.lit("texas a & m ")), k=T.match_key(F.lit("Shai Gilgeous-Alexander Jr.")), l=T.name_key(F.lit("V. J. Żółć-Ňěț III")), m=T.school_key(F.lit("East. Basketball College – Wash’s St.")), n=T.match_key(F.lit("Jr")), o=T.school_key(F.lit(None).cast("string")), j=T.school_key(F.lit("Duke Blue Devils men's basketball")), p=T.position_group(F.lit(" sg ")),
        q=T.position_group(F.lit("ATH")),
    )
    assert got == {
        "made": 1.2, "attempted": 4.6, "none": None, "h": 81, "bad": None, "a": "tj warren", "b": "tj warren", "c": "gary payton",
        "e": "asbjorn midtgaard", "f": "deandre oneal", "g": "texas a and m", "i": "texas a and m", "j": "duke blue devils", "p": "G", "q": "UNKNOWN", "k": "shai gilgeousalexander",
        "l": "j zocnet", "m": "eastate college - washs state", "n": "", "o": "",
    }
