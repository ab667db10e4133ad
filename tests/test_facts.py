"""Facts of generated matches against a scalar replay written for the test, then releases and ingestion."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from heatfield.functions.geometry import MIN_X, SPAN_X, SPAN_Y, TURRETS
from heatfield.functions.scalars import RESPAWN, ROLES
from heatfield.operators import facts as X
from heatfield.operators import release as R
from heatfield.sources import adapter
from heatfield.sources import documents as D
from heatfield.streaming import runs as U


def match_doc(n, rng, **info):
    people = [{"participantId": i + 1, "puuid": f"p{(i + n) % 14:02d}-long-id", "championId": 10 + i, "teamId": 100 if i < 5 else 200, "teamPosition": "" if n == 1 and i == 3 else ROLES[i % 5], "individualPosition": "Invalid" if i == 3 else ROLES[i % 5], "riotIdGameName": f"N{i}" if i else None, "riotIdTagline": "T", "win": i < 5, "deaths": None} for i in range(10)]
    return {"metadata": {"matchId": f"EU_{n}"}, "info": {"gameVersion": "14.3.1", "mapId": 11, "queueId": 420, "gameCreation": 5, "gameEndTimestamp": 9, "gameDuration": 1800, "participants": people} | info}


def timeline_doc(n, rng):
    frames = []
    for f in range(8):
        states = {str(p): {"participantId": p, "totalGold": rng.randrange(500, 9000) if rng.random() < 0.9 else None, "minionsKilled": rng.randrange(99), "jungleMinionsKilled": rng.randrange(9), **({"position": {"x": rng.randrange(5000), "y": rng.randrange(5000)}} if rng.random() < 0.9 else {})} for p in range(1, 11)}
        events = []
        for _ in range(9):
            t = f * 240_000 + rng.randrange(0, 240) * 1000
            kind = rng.choice(["CHAMPION_KILL"] * 5 + ["LEVEL_UP", "LEVEL_UP", "ELITE_MONSTER_KILL", "BUILDING_KILL"])
            e = {"type": kind, "timestamp": t}
            if kind == "CHAMPION_KILL":
                v = rng.randrange(1, 11)
                e |= {"victimId": v, "killerId": rng.choice([0, v % 10 + 1, (v + 4) % 10 + 1]), "position": {"x": rng.randrange(14000) + 0.5, "y": rng.randrange(14000)}, "assistingParticipantIds": [1] * rng.randrange(3), "bounty": 300, "shutdownBounty": rng.randrange(200), "victimDamageReceived": [{"type": k, "physicalDamage": rng.randrange(3), "magicDamage": 1} for k in rng.sample(["TOWER", "minion", "Monster", "x"], 3)]}
            elif kind == "LEVEL_UP":
                e |= {"participantId": rng.randrange(1, 11), "level": rng.randrange(0, 19)}
            elif kind == "ELITE_MONSTER_KILL":
                e |= dict(zip(("monsterType", "monsterSubType"), rng.choice([("DRAGON", "FIRE_DRAGON"), ("DRAGON", "ELDER_DRAGON"), ("BARON_NASHOR", None), ("RIFTHERALD", None)]), strict=True))
            events.append(e)
        frames.append({"timestamp": f * 240_000 + 500, "participantFrames": states, "events": events})
    return {"metadata": {"matchId": f"EU_{n}"}, "info": {"frameInterval": 240_000, "frames": frames}}


def replay(match, line):
    """The facts by plain loops over the whole past of each kill."""
    people = {p["participantId"]: p for p in match["info"]["participants"]}
    frames, out = line["info"]["frames"], {}
    evs = sorted(((e["timestamp"], f, i, e) for f, fr in enumerate(frames) for i, e in enumerate(fr["events"])), key=lambda x: x[:3])
    kills = [t for t, _, _, e in evs if e["type"] == "CHAMPION_KILL"]

    def level_before(pid, k):
        ups = [e["level"] for _, _, _, e in evs[:k] if e["type"] == "LEVEL_UP" and e["participantId"] == pid and e["level"]]
        return ups[-1] if ups else 1

    def back_at(pid, k):
        died = [j for j in range(k) if evs[j][3]["type"] == "CHAMPION_KILL" and evs[j][3]["victimId"] == pid]
        if not died:
            return None, 0, 0
        t, minute = evs[died[-1]][0], evs[died[-1]][0] / 60_000
        wait = RESPAWN[min(max(level_before(pid, died[-1]), 1), 20) - 1] * (1 if minute < 15 else 1 + min((minute - 15) // 5 * 0.05, 0.5))
        return t, t + int(wait * 1000), len(died)

    role = lambda p: p["teamPosition"] or ("" if p["individualPosition"] == "Invalid" else p["individualPosition"])
    for k, (t, f, i, e) in enumerate(evs):
        if e["type"] != "CHAMPION_KILL":
            continue
        at = max((j for j, fr in enumerate(frames) if fr["timestamp"] <= t), default=0)
        st = frames[at]["participantFrames"]
        gold = lambda p: st[str(p)]["totalGold"]
        place = lambda p: (lambda q: q and (q["x"], q["y"]))(st[str(p)].get("position"))
        alive = {p: back_at(p, k)[1] <= t for p in people}
        past = [x[3] | {"t": x[0]} for x in evs[:k]]
        monsters = [x for x in past if x["type"] == "ELITE_MONSTER_KILL"]
        last = lambda word: max((x["t"] for x in monsters if word in x["monsterType"]), default=None)
        d, b, up = last("DRAGON"), last("BARON"), 0
        if t >= (300_000 if d is None else d + 300_000):
            up |= 8 if any("ELDER" in (x["monsterSubType"] or "") for x in monsters) else 1
        up |= 2 if t >= (1_200_000 if b is None else b + 360_000) else 0
        up |= 4 if last("HERALD") is None and 840_000 <= t < 1_500_000 else 0
        took = [x["t"] for x in past if x["type"] in ("ELITE_MONSTER_KILL", "BUILDING_KILL")]
        v, champion = e["victimId"], bool(e["killerId"])
        best = max(e["victimDamageReceived"], key=lambda x: x["physicalDamage"] + x["magicDamage"])["type"].upper()
        turrets = [q for a, c in TURRETS for q in ((a, c), (1 - c, 1 - a))]
        row = {"cause": 0 if champion else {"TOWER": 1, "MINION": 2, "MONSTER": 3}.get(best, 4), "x": round(e["position"]["x"]), "y": e["position"]["y"], "second": t // 1000, "assists": len(e["assistingParticipantIds"]), "bounty": e["bounty"] + e["shutdownBounty"], "objectives_up": up, "since_objective": min(254, (t - took[-1]) // 2000) if took else None}
        both = [[gold(p) for p in people if people[p]["teamId"] == s and gold(p) is not None] for s in (100, 200)]
        row["team_gold"] = sum(both[0]) - sum(both[1]) if both[0] or both[1] else None
        row["alive_counts"] = sum(alive[p] for p in people if p <= 5) << 4 | sum(alive[p] for p in people if p > 5)
        near = any(math.hypot(e["position"]["x"] - (a * SPAN_X + MIN_X), e["position"]["y"] - (c * SPAN_Y - 120)) <= 775 for a, c in turrets)
        imputed = any(not people[p]["teamPosition"] for p in ([v, e["killerId"]] if champion else [v]))
        row["flags"] = (v > 5) + 2 * (v <= 5) + 4 * (t == min(kills)) + 8 * near + 16 * any(x != t and abs(x - t) <= 5000 for x in kills) + 32 * imputed
        for who, p in (("victim", v), ("killer", e["killerId"] if champion else None)):
            if p is None:
                row |= {f"{who}_{c}": None for c in X.BLOCK}
                continue
            foes = [q for q in people if people[q]["teamId"] != people[p]["teamId"]]
            opp = [q for q in foes if role(people[q]) and role(people[q]) == role(people[p])]
            o = opp[-1] if opp else None
            cs = lambda q: st[str(q)]["minionsKilled"] + st[str(q)]["jungleMinionsKilled"]
            far = lambda q: math.dist(place(p), place(q))
            mates = [far(q) for q in people if place(p) and q != p and q not in foes and alive[q] and place(q)]
            died_at, _, deaths = back_at(p, k)
            scored = sum(x["type"] == "CHAMPION_KILL" and x["killerId"] == p for x in past)
            row |= {f"{who}_champ": people[p]["championId"], f"{who}_role": ROLES.index(role(people[p])) if role(people[p]) else None, f"{who}_level": level_before(p, k), f"{who}_gold_diff_lane": gold(p) - gold(o) if o and gold(p) is not None and gold(o) is not None else None, f"{who}_cs_diff_lane": cs(p) - cs(o) if o else None, f"{who}_isolation": min(254, int(min(mates) // 100)) if mates else None, f"{who}_enemies_near": sum(alive[q] and bool(place(q)) and far(q) <= 2000 for q in foes) if place(p) else None, f"{who}_ordinal": deaths if who == "victim" else scored, f"{who}_since_prev_death": None if died_at is None else min(254, (t - died_at) // 4000), f"{who}_lane_opp_champ": people[o]["championId"] if o else None, f"{who}_player_id": people[p]["puuid"]}
        out[f, i] = row
    return out


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root, rng, made = tmp_path_factory.mktemp("landed"), random.Random(4), {}
    for n in range(4):
        made[n] = match_doc(n, rng), timeline_doc(n, rng)
        for kind, doc in zip(("match", "timeline"), made[n], strict=True):
            (root / kind).mkdir(exist_ok=True)
            (root / kind / f"{n}.json").write_text(json.dumps(doc))
    return root, made


def test_facts_equal_the_replay(spark, landed):
    root, made = landed
    m, t = D.read_documents(spark, f"{root}/match", D.MATCH), D.read_documents(spark, f"{root}/timeline", D.TIMELINE)
    facts = X.kill_facts(m, t).cache()
    for n, (match, line) in made.items():
        want = replay(match, line)
        got = {(r.frame_index, r.event_index): r.asDict() for r in facts.filter(f"match_id = 'EU_{n}'").collect()}
        assert got.keys() == want.keys()
        for key, row in want.items():
            assert {c: got[key][c] for c in row} == row, (n, key)
    assert X.unreconciled(facts, m, t).isEmpty()
    assert {r.type for r in X.audit(t).collect()} >= {"CHAMPION_KILL", "LEVEL_UP"}
    assert t.filter(D.timeline_fault().isNotNull()).isEmpty() and m.filter(D.identity_fault().isNotNull()).isEmpty()


def test_a_task_replays_a_bounded_number_of_matches(spark, landed, monkeypatch):
    root, made = landed
    m, t = D.read_documents(spark, f"{root}/match", D.MATCH), D.read_documents(spark, f"{root}/timeline", D.TIMELINE)
    for each in (1, 2, 256):
        monkeypatch.setattr(X, "MATCHES", each)
        facts = X.kill_facts(m, t)
        assert facts.rdd.getNumPartitions() == -(-len(made) // each) and facts.select("match_id").distinct().count() == len(made)


def test_a_task_joins_a_bounded_number_of_facts(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 100)
    fact = spark.range(1000).selectExpr("id", "id % 300 as k")
    tables = {"k": ("k", spark.range(300).selectExpr("id as k", "id * 2 as twice"), "inner")}
    for small in (10, 500):
        monkeypatch.setattr(R, "SMALL", small)
        out = R.denormalised(fact, tables)
        assert {(r.id, r.twice) for r in out.collect()} == {(i, i % 300 * 2) for i in range(1000)}
        assert small == 500 or out.rdd.getNumPartitions() == 10


@pytest.mark.parametrize(("change", "reason"), [({}, None), ({"mapId": None}, "wrong_map"), ({"mapId": 12, "queueId": 450}, "wrong_map"), ({"queueId": 450}, "wrong_queue"), ({"endOfGameResult": "Abort"}, "not_complete"), ({"gameDuration": 299}, "too_short"), ({"gameEndTimestamp": None, "gameDuration": 400_000}, None), ({"participants": []}, "bad_participant_count"), ({"gameVersion": "13.1"}, "out_of_patch")])
def test_rejections(spark, tmp_path, change, reason):
    (tmp_path / "m.json").write_text(json.dumps(match_doc(0, None, **change)))
    assert D.read_documents(spark, str(tmp_path), D.MATCH).select(D.rejection(["14.3"])).first()[0] == reason


def test_keys_of_any_number_of_values(spark, tmp_path):
    dim = spark.range(1000).selectExpr("concat('m', lpad(cast(id * 7 % 1000 as string), 4, '0')) as k")
    got = {r.k: r.sk for r in R.ranged_keys(dim.repartition(7), "k", "sk", str(tmp_path / "keys")).collect()}
    assert got == {f"m{i:04d}": i for i in range(1000)}
    with pytest.raises(ValueError, match="more than"):
        R.dense_keys(dim, "k", "sk", 999)
    for table, how in ((dim.unionByName(dim), "inner"), (dim.unionByName(dim), "left"), (dim.limit(5), "inner")):
        with pytest.raises(Exception, match="number of rows"):
            R.denormalised(dim, {"x": ("k", table.withColumn("sk", F.lit(1)), how)}).collect()
    out = R.denormalised(dim, {"x": ("k", dim.limit(5).withColumn("sk", F.lit(1)), "left")})
    assert out.columns == ["k", "sk"] and out.filter("sk = 1").count() == 5 and out.count() == 1000


def test_rows_that_no_release_has(spark):
    cols = "x int, y int, victim_role int, killer_role int, match int, patch int, region int, victim_player int, killer_player int, cause int, killer_champ int"
    good = (0, 0, 4, None, 0, 0, 33, 1, 1, 0, 5)
    change = {"place": {0: -121}, "role": {2: 5}, "reference": {4: 9}, "execution": {9: 1}}
    rows = [good, *[tuple(c.get(i, v) for i, v in enumerate(good)) for c in change.values()], tuple({8: 7}.get(i, v) for i, v in enumerate(good))]
    got = R.broken(spark.createDataFrame(rows, cols), 1, 1, 2).collect()
    assert sorted(r.fault for r in got) == sorted([*change, "reference"])
    found = R.cells(spark.createDataFrame([good] * 6, cols).withColumn("flags", F.lit(0)), 1, 1, 2).collect()
    said = {"rows": 6}
    R._audited(found, said)
    for bad in ({"rows": 7}, said):
        with pytest.raises(ValueError):
            R._audited(found if bad != said else [*found, *R.cells(spark.createDataFrame(rows[1:2], cols).withColumn("flags", F.lit(0)), 1, 1, 2).collect()], bad)
    manifest = {"dataset_id": "v1-" + "a" * 20, "versions": {}, "rows": 0, "matches": 1, "players": 0, "game_start": [1, 2], "patches": [], "regions": [], "champion_kills": None, "bytes_per_row": 54}
    assert R.checked_manifest(manifest) == manifest
    for bad in (manifest | {"more": 1}, {k: v for k, v in manifest.items() if k != "rows"}, manifest | {"rows": "0"}, manifest | {"matches": 0}, manifest | {"rows": True}, manifest | {"dataset_id": "../x"}):
        with pytest.raises(ValueError):
            R.checked_manifest(bad)
    facts = spark.createDataFrame([("a", 5, 40_000), ("b", 300, None), ("c", 1, 1)], "match_id string, assists int, team_gold int")
    assert {tuple(r) for r in X.out_of_range(facts).collect()} == {("a", "team_gold"), ("b", "assists")}


def test_documents_are_written_and_read_again(spark, landed, tmp_path):
    root, made = landed
    docs = D.read_documents(spark, f"{root}/match", D.MATCH).drop("file")
    D.write_documents(docs, f"{tmp_path}/out")
    assert all(f.endswith(".json.gz") for f in docs.sparkSession.read.text(f"{tmp_path}/out").inputFiles())
    back = D.read_documents(spark, f"{tmp_path}/out", D.MATCH, whole=False).drop("file")
    assert sorted(back.collect(), key=str) == sorted(docs.collect(), key=str) and len(made) == back.count()
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        D.write_documents(docs, f"{tmp_path}/out")


def test_names(spark, tmp_path):
    (tmp_path / "names.json").write_text('{"data": {"A": {"key": "7", "name": "Seven"}, "B": {"key": "x", "name": "none"}}}')
    names = U.champion_names(spark, str(tmp_path / "names.json"))
    df = spark.createDataFrame([(7,), (8,)], "champ int")
    assert {tuple(r) for r in U.named(df, names, "champ", "shown").collect()} == {(7, "Seven"), (8, "8")}
    assert U.champion_names(spark, str(tmp_path / "none.json")) is None and U.named(df, None, "champ", "shown").filter("shown = '7'").count() == 1


def test_a_release_is_written_in_ranges_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 100)
    rows = spark.range(2000).select(F.format_string("%05d", "id").alias("match_id"), F.lit(1).alias("pid"))
    assert R.written(rows, str(tmp_path / "rows"), ["match_id", "pid"], 2000)["rows"] == 2000
    sizes = [r.n for r in spark.read.parquet(str(tmp_path / "rows")).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 15 and max(sizes) <= 300 and sum(sizes) == 2000


def test_matches_are_numbered_in_partitions_of_bounded_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapter, "EACH", 70)
    spark.range(11_200).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.lit("click").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    matches, _ = adapter.documents(spark, str(tmp_path))
    sizes = [r.n for r in matches.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 400 and len(sizes) >= 8 and max(sizes) <= 100


def test_lane_opponents_are_found_without_a_shuffle(spark):
    p = [{"participantId": i, "puuid": f"p{i}", "championId": 10 + i, "teamId": 100 if i <= 5 else 200, "teamPosition": ["TOP", "JUNGLE", "TOP", "", "UTILITY"][(i - 1) % 5], "win": i <= 5} for i in range(1, 11)]
    got = D.participants(spark.createDataFrame([({"matchId": "EU_1"}, {"participants": p})], D.MATCH))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    plain = D.lane_opponents(got.drop("opp", "opp_champ"))
    assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert [(r.pid, r.opp) for r in got.orderBy("pid").collect()][:5] == [(1, 8), (2, 7), (3, 8), (4, None), (5, 10)]
