"""The hand-computed sample: six events, three games with events, two players."""

import pytest
from pyspark.sql import functions as F

from heatfield.operators import facets as H

COLS = "x int, y int, flags int, second int, team_gold int, assists int, region int, cause int, victim_champ int, victim_role int, victim_player int, killer_champ int, killer_role int, killer_player int, match int, victim_lane_gold int, killer_lane_gold int, patch int"
ROWS = [
    (1000, 2000, 0, 100, 1000, 0, 1, 0, 10, 0, 0, 20, 1, 1, 0, 500, 100, 0),
    (1000, 2000, 0, 120, 1000, 1, 1, 0, 10, 0, 0, 20, 1, 1, 0, 500, -500, 0),
    (1000, 2000, 0, 140, 1000, 2, 1, 0, 10, 0, 0, 20, 1, 1, 0, 500, -500, 0),
    (1000, 2000, 1, 160, -1000, 1, 1, 0, 20, 1, 1, 10, 0, 0, 1, -500, 500, 0),
    (1000, 2000, 1, 180, -1000, 0, 1, 0, 20, 1, 1, 10, 0, 0, 1, -500, 500, 0),
    (9000, 9000, 0, 200, 0, 0, 2, 1, 10, 0, 0, None, None, None, 2, 100, None, 0),
]
TEN = H.Actor(champ=((10, False),))


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(ROWS, COLS)


@pytest.mark.parametrize(
    ("state", "deaths", "kills"),
    [
        (H.State(), 6, 5),
        (H.State(subject=TEN), 4, 2),
        (H.State(subject=TEN, opponent=H.Actor(role=((1, False),))), 3, 2),
        (H.State(subject=H.Actor(side=((200, False),))), 2, 3),
        (H.State(lane_gold=(0, 1000)), 4, 3),
        (H.State(lane_gold=(0, 1000), subject=TEN), 4, 2),
        (H.State(team_gold=(1, 2000)), 3, 3),
        (H.State(team_gold=(1, 2000), time=(110, 150), assists=(0, 1), subject=H.Actor(champ=((10, False), (20, False), (20, True)))), 1, 0),
    ],
)
def test_totals(sample, state, deaths, kills):
    r = H.totals(H.perspectives(sample, state)).first()
    assert (r.deaths, r.kills) == (deaths, kills)


def test_games_zones_and_cells(sample):
    r = H.totals(H.perspectives(sample, H.State())).first()
    assert (r.death_games, r.kill_games, r.games) == (3, 2, 3)
    seen = H.perspectives(sample, H.State(subject=TEN))
    assert {(z.region, z.deaths, z.kills, z.games) for z in H.by_zone(seen).collect()} == {(1, 3, 2, 2), (2, 1, 0, 1)}
    assert {(c.cell, c.deaths, c.kills, c.games) for c in H.grid(H.perspectives(sample, H.State()), 32).collect()} == {(130, 5, 5, 2), (627, 1, 0, 1)}
    top = H.zone_summary(seen, "danger").collect()
    assert [(t.region, round(t.value, 6)) for t in top] == [(1, round(8 / 15, 6))]
    share = {s.region: s.value for s in H.layer(H.by_zone(seen), "deaths").collect()}
    assert share == {1: 0.75, 2: 0.25}


def test_danger_and_percentiles(spark):
    df = spark.createDataFrame([(0, 4, 1), (1, 1, 0), (2, 0, 5), (3, 0, 0)], "cell int, deaths int, kills int")
    assert [r.v for r in df.orderBy("cell").select(H.danger(F.col("deaths"), F.col("kills")).alias("v")).collect()] == [9 / 15, None, 5 / 15, None]
    values = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (0.0,)], "v double")
    assert H.index_percentile(values, "v", 0.99).first()[0] == 9.0 and H.index_percentile(values, "v", 0.5, last=True).first()[0] == 2.0
    assert [H.auto_size(True, n) for n in (9831, 2458, 10)] == [128, 64, 32] and [H.auto_size(False, n) for n in (49, 199, 200)] == [32, 64, 128]
    assert round(H.evidence()) == 46


def test_links_keep_what_is_known_and_drop_the_rest():
    state = H.parse_state("?layer=danger&grid=12&scale=log&time=300,100&gold=-99999,99999&lanegold=-500,1000&mirror=1&s.champ=10,!20,bad,²&s.side=200&smooth=0&s.player=0")
    assert (state.layer, state.grid, state.scale, state.time, state.team_gold, state.lane_gold, state.smooth) == ("danger", None, "log", None, (-25000, 25000), (-500, 1000), False)
    assert state.subject == H.Actor(champ=((10, False), (20, True)), side=((200, False),))
    assert H.parse_state(H.state_query(state)) == state and H.parse_state("layer=x&grid=5&time=a,b&assists=1") == H.State() == H.parse_state("")
    assert H.state_query(H.State()) == "layer=deaths" and H.parse_state("grid=64&assists=0,99").assists == (0, 9)


def test_players_keep_their_identity_in_another_release(spark):
    dim = lambda *rows: spark.createDataFrame([(i, k) for k, i in enumerate(rows)], "id string, sk int")
    old = {"player": dim("puuid-a", "puuid-b"), "patch": dim("14.1", "14.2"), "region": dim("Mid", "Top")}
    new = {"player": dim("puuid-b", "puuid-a"), "patch": dim("14.2"), "region": dim("Top", "Mid"), "champ": spark.createDataFrame([("10", 10)], "id string, sk int")}
    state = H.State(subject=H.Actor(player=((0, False),), champ=((10, False), (99, False)), role=((4, False), (7, False))), opponent=H.Actor(player=((1, True),)), patch=((0, False), (1, True)), region=((0, False),))
    moved = H.reconciled(state, new, old)
    assert moved.subject.player == ((1, False),) and moved.opponent.player == ((0, True),) and moved.subject.player_id == (("puuid-a", False),)
    assert (moved.patch, moved.region, moved.subject.champ, moved.subject.role) == (((0, True),), ((1, False),), ((10, False),), ((4, False),))
    link = H.state_query(moved)
    assert "s.player_id=puuid-a" in link and "o.exclude_player_id=puuid-b" in link
    again = H.reconciled(H.parse_state(link), new)
    assert again.subject.player == ((1, False),) and again.opponent.player == ((0, True),)
    with pytest.raises(ValueError, match="reconciled"):
        H.actor("victim", H.Actor(player_id=(("x", False),)))


def test_counts_copy_no_row_and_the_size_is_chosen_in_one_plan(sample, capsys):
    H.grid(H.perspectives(sample, H.State()), 32).explain()
    assert "Expand" not in capsys.readouterr().out
    for state, size in ((H.State(), 32), (H.State(layer="danger"), 32), (H.State(grid=64), 64)):
        got = H.auto_grid(H.perspectives(sample, state), state).collect()
        assert {r["size"] for r in got} == {size}
        want = {tuple(r) for r in H.grid(H.perspectives(sample, state), size).collect()}
        assert {tuple(r)[:6] for r in got} == want
    none = H.totals(H.perspectives(sample.limit(0), H.State())).first()
    assert tuple(none) == (0, 0, 0, 0, 0) and H.auto_grid(H.perspectives(sample.limit(0), H.State()), H.State()).count() == 0


def test_blur_keeps_mass_inside_and_loses_it_at_the_edge(spark):
    df = spark.createDataFrame([(20 * 64 + 20, 1, 0), (0, 0, 1)], "cell int, deaths int, kills int")
    r = H.blurred(df, 64).agg(F.sum("deaths"), F.sum("kills")).first()
    assert r[0] == pytest.approx(sum(H.KERNEL) ** 2) and r[1] == pytest.approx(sum(H.KERNEL[4:]) ** 2)
