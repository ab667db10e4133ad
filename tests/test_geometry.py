import math

import numpy as np
from pyspark.sql import functions as F

from heatfield.functions import geometry as G
from heatfield.functions import scalars as S


def test_zones_tile_the_box_and_name_landmarks():
    u, v = np.meshgrid((np.arange(256) + 0.5) / 256, (np.arange(256) + 0.5) / 256)
    got = G.label(u.ravel(), v.ravel())
    assert len(G.ZONES) == 33 and (got < G.UNLABELLED).all()
    at = lambda a, b: G.ZONE_NAMES[G.label(np.array([a]), np.array([b]))[0]]
    assert [at(0.02, 0.02), at(0.98, 0.98), at(0.32, 0.70), at(0.67, 0.30), at(0.5, 0.5), at(1.5, 0.5)] == ["Blue Base", "Red Base", "Baron Pit", "Dragon Pit", "Mid River", "Unlabelled"]


def test_mirror_cells_and_turrets(spark):
    df = spark.createDataFrame([(1000.0, 2000.0), (14870.0, 14980.0), (-120.0, -120.0), (-500.0, 20000.0)], "x double, y double")
    mx, my = G.mirrored(F.col("x"), F.col("y"))
    back = df.select("x", "y", mx.alias("a"), my.alias("b")).select("x", "y", *[c.alias(n) for n, c in zip("pq", G.mirrored(F.col("a"), F.col("b")), strict=True)]).collect()
    assert all(math.isclose(r.x, r.p, abs_tol=1e-6) and math.isclose(r.y, r.q, abs_tol=1e-6) for r in back)
    assert [r[0] for r in df.select(G.cell_of(F.col("x"), F.col("y"), 32)).collect()] == [130, 1023, 0, 992]
    fine = G.cell_of(F.col("x"), F.col("y"), 128)
    assert [r[0] for r in df.select(G.coarser(fine, 128, 32)).collect()] == [130, 1023, 0, 992]
    u, v = G.TURRETS[0]
    t = spark.createDataFrame([(u * G.SPAN_X - 120 + d, v * G.SPAN_Y - 120) for d in (0.0, 774.0, 776.0)], "x double, y double")
    assert [r[0] for r in t.select(G.under_turret(F.col("x"), F.col("y"))).collect()] == [True, True, False]


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert [val(S.u8(F.lit(x), 2)) for x in (9.9, -3.0, 9999.0, None)] == [4, 0, 254, None]
    assert val(S.respawn_seconds(F.lit(18), F.lit(31.0))) == 42.5 * 1.15 and val(S.respawn_seconds(F.lit(1), F.lit(3.0))) == 10
    assert [val(S.player_name(F.lit(x))) for x in ("a#b#c", "#x", "plain")] == ["a#b", "#x", "plain"] and val(S.player_tag(F.lit("a#b#c"))) == "c"
    assert val(S.minutes_seconds(F.lit(125))) == "2:05" and [val(S.kilo_gold(F.lit(x))) for x in (-1250, 0, 900)] == ["-1.3k", "0.0k", "+0.9k"]
    assert [val(S.fuzzy_score(" Kai", F.lit(x))) for x in ("kai", "Kai'Sa", "Mordekaiser", "Khazix i", "zed")] == [0, 1, 2, 3, None]
    assert [val(S.fuzzy_score(q, F.lit("Dr. Mundo"), F.lit("Dr. Mundo#EU"), S.ALIASES)) for q in ("mundo", "drmundo", "dr. mundo", "dr. mundo#eu", "drmundo#e", "u#u", "")] == [0, 1, 0, 0, 2, 3, 0]


def test_search_order(spark):
    items = spark.createDataFrame([("Annie",), ("Ann",), ("Joanna",), ("zed",)], "label string")
    assert [(r.label, r.score) for r in S.search(items, "ann", "label").collect()] == [("Ann", 0), ("Annie", 1), ("Joanna", 2)]
