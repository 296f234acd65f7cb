import http.server
import io
import json
import re
import threading
import zipfile

import numpy as np
import pytest
from oracle import SF

from ruleloom.operators import catalog
from ruleloom.plans.queries import QUERIES
from ruleloom.sources import files
from ruleloom.streaming import serial


def queue(spark, n=40):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    rows = [(i, f"u{i}", (base[i % 6] + rng.standard_normal(8) * (0.05 if i % 4 else 0.5)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "serial_order long, unit_id string, vector array<double>")


def plain(rows, match, variant, group, most):
    """The whole queue by loops over lists: (events, families) as the rules say."""
    fams, vec, events = {}, {}, []
    cos = lambda a, b: round(float(np.dot(a, b)), 6)
    num = lambda u: (re.sub("[0-9]", "", u), int(re.sub("[^0-9]", "", u)))
    for n, unit, v in rows:
        v = np.array(v) / np.linalg.norm(v)
        near = sorted(((-cos(f["v"], v), name) for name, f in fams.items()))[:20]
        rejected, outcome = 0, None
        while near and outcome is None:
            score, name = -near[0][0], near[0][1]
            f = fams[name]
            if score < variant:
                break
            if score >= match:
                f["eq"] = sorted([*f["eq"], unit], key=num)
                outcome = "EQUIVALENT"
                continue
            hit = [g for g in f["groups"] if cos(vec[g[0]], v) >= group]
            if hit:
                hit[0].append(unit)
                hit[0].sort(key=num)
                outcome = "ADD_TO_EXISTING_GROUP"
            elif len(f["groups"]) == 1 and len(f["groups"][0]) >= most:
                rejected, near = rejected + 1, near[1:]
            elif len(f["groups"]) >= most // 2:
                var = sorted([x for g in f["groups"] for x in g] + [unit], key=num)
                order = sorted(f["eq"] + [x for x in var if x != unit], key=num) + [unit]
                mean = np.mean([v if x == unit else vec[x] for x in order], axis=0)
                f["groups"], f["v"] = [var], mean / np.linalg.norm(mean)
                outcome = "FULL_RULE_FAMILY"
            else:
                f["groups"].append([unit])
                outcome = "CREATE_NEW_GROUP"
        if outcome is None:
            name, outcome = f"NM{n + 1:04d}", "NEW_FAMILY"
            fams[name] = {"eq": [unit], "groups": [], "v": v}
        vec[unit] = v
        events.append((n, unit, outcome, name, rejected))
    return events, {k: (f["eq"], f["groups"]) for k, f in fams.items()}


RULES = {"match": 0.97, "variant": 0.75, "group": 0.93, "most": 4}


def rules():
    judge = lambda unit, found: serial.by_threshold(unit, found, RULES["match"], RULES["variant"])
    return judge, lambda unit, v, family, members: serial.by_groups(unit, v, family, members, RULES["group"], RULES["most"])


def wide(spark, n=240):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((7, 8))
    rows = [(i, f"u{i}", (base[i % 7] + rng.standard_normal(8) * rng.choice([0.02, 0.3, 0.45])).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "serial_order long, unit_id string, vector array<double>")


def test_every_outcome_as_in_plain_python(spark):
    rows, q = wide(spark)
    events, families = plain(rows, **RULES)
    state, found = serial.fold(q, None, *rules())
    assert [(e["serial_order"], e["unit_id"], e["outcome"], e["family_id"], e["n_rejected"]) for e in found] == events
    assert {k: (f.equivalent, f.groups) for k, f in state.families.items()} == families
    assert {e[2] for e in events} == {"NEW_FAMILY", "EQUIVALENT", "ADD_TO_EXISTING_GROUP", "CREATE_NEW_GROUP", "FULL_RULE_FAMILY"} and any(e[4] for e in events)
    assert [r.asDict() for r in serial.event_log(q, *rules(), limit=77).orderBy("serial_order").collect()] == found


def test_a_stored_run_goes_on_where_it_stopped(spark, tmp_path):
    rows, q = wide(spark, 120)
    whole, events = serial.fold(q, None, *rules())
    path = f"file://{tmp_path}/run"
    first = serial.consolidate(q, path, *rules(), limit=25, most=2)
    assert first.next_order == 50
    # a slice that was written before a crash, without its pointer, is replaced
    spark.createDataFrame([(f"x{i}", 50 + i, "u", "NEW_FAMILY", "F", None, 0, True) for i in range(9)], serial.EVENT).write.parquet(f"{path}/events/from=50")
    assert serial.committed(spark, path).count() == 50
    last = serial.consolidate(q, path, *rules(), limit=25)
    assert [r.asDict() for r in serial.committed(spark, path).orderBy("serial_order").collect()] == events
    assert {k: (f.equivalent, f.groups, f.version, f.base_origin) for k, f in last.families.items()} == {k: (f.equivalent, f.groups, f.version, f.base_origin) for k, f in whole.families.items()}
    assert serial.consolidate(q, path, *rules()).next_order == 120
    for r in serial.replay(serial.committed(spark, path)).collect():
        f = whole.families[r["family_id"]]
        assert (r["n_members"], r["version"], r["base_origin"], r["state_origin"]) == (len(f.members()), f.version, f.base_origin, f.state_origin)


def test_event_log_holds_every_slice(spark):
    q = queue(spark)
    _, events = serial.fold(q)
    for limit in (13, 20, 40, 100):
        assert [r.asDict() for r in serial.event_log(q, limit=limit).orderBy("serial_order").collect()] == events
    assert serial.event_log(q.where("false")).count() == 0
    with pytest.raises(ValueError, match="no unit 10"):
        serial.event_log(q.where("serial_order < 10 or serial_order > 30"), limit=5)


def test_changes_that_lose_or_repeat_a_unit_are_refused():
    f = serial.Family("F", "a", np.ones(1), ["a"], [["b"]])
    for how in (serial.Generalisation("ADD_TO_EXISTING_GROUP", 1), serial.Generalisation("FULL_RULE_FAMILY", None, ["a"], [["c"]], np.ones(1)), serial.Generalisation("FULL_RULE_FAMILY", None, ["a", "b", "b"], [["c"]], np.ones(1)), serial.Generalisation("WHAT")):
        with pytest.raises(ValueError):
            serial._changed(f, "c", how)


def test_registered_log_and_replay_take_units_beyond_a_slice(spark, monkeypatch):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    monkeypatch.setattr(serial, "event_log", lambda q, judge, generalise, run=serial.event_log: run(q, judge, generalise, 100))
    assert n > 100 and QUERIES["serial_consolidation"](spark, SF).count() == n
    assert sum(r["n_members"] for r in QUERIES["state_replay"](spark, SF).collect()) == n


def test_empty_queue_keeps_the_state(spark):
    state, events = serial.fold(queue(spark, 3).where("false"))
    assert events == [] and state.families == {} and state.next_order == 0


def test_sync_stream_touches_its_buckets_only(spark, tmp_path):
    schema = "family_id string, seq long, sha string, vector double"
    active, want, changed = f"{tmp_path}/active", {}, {}

    def sync(n, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events/{n}")
        before = serial.bucket_files(spark, active)
        serial.sync_stream(spark, f"{tmp_path}/events/*", active, f"{tmp_path}/check", schema, buckets=8, deltas=2).awaitTermination()
        for f, seq, _, v in rows:
            if seq >= want.get(f, (-1, 0))[0]:
                want[f] = seq, v
        after = serial.bucket_files(spark, active)
        changed[n] = {b for b in after if after[b] != before.get(b)}
        assert {r["family_id"]: (r["seq"], r["vector"]) for r in serial.active_index(spark, active, schema).collect()} == want
        return after

    sync(0, [(f"f{i}", i, "h", i / 10) for i in range(40)])
    for n in range(1, 4):  # the third delta of f3's bucket compacts it
        files_ = sync(n, [("f3", 100 + n, "h", 1.0 + n), ("f3", 50, "old", 9.0)])
    assert changed[0] == set(range(8)) and len(changed[1]) == 1 and changed[1] == changed[2] == changed[3]
    (bucket,) = changed[3]
    assert any("/bases/" in x for x in files_[bucket]) and not any("/bases/" in x for b in files_ if b != bucket for x in files_[b])


def test_a_sync_batch_that_runs_again_changes_nothing(spark, tmp_path):
    schema = "family_id string, seq long, sha string, vector double"
    spark.createDataFrame([("a", 1, "h1", 0.1), ("b", 2, "h2", 0.2)], schema).write.parquet(f"{tmp_path}/events/1")
    for check in ("one", "two"):  # another checkpoint: batch 0 is run again, as after a crash
        serial.sync_stream(spark, f"{tmp_path}/events/*", f"{tmp_path}/active", f"{tmp_path}/{check}", schema).awaitTermination()
    rows = serial.active_index(spark, f"{tmp_path}/active", schema).collect()
    assert {(r["family_id"], r["seq"], r["vector"]) for r in rows} == {("a", 1, 0.1), ("b", 2, 0.2)}
    assert all(len(x) == 1 for x in serial.bucket_files(spark, f"{tmp_path}/active").values())
    assert serial.active_index(spark, f"{tmp_path}/none", schema).count() == 0


def test_usage_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"ts": f"2024-01-01T0{h}:10:00", "model": "m", "usage": {"tokens": h + 1}} for h in (0, 0, 1, 5, 9)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    serial.running_usage(spark, f"{tmp_path}/in", "ts timestamp, model string, usage map<string,long>", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r["hour"].hour, r["total"]) for r in rows} >= {(0, 2), (1, 2), (5, 6)}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'\xef\xbb\xbf{"id": "x", "n": 1}\n\n{"id": "y", "n": 2}\n')
    assert {r["id"] for r in files.json_lines(spark, f"{tmp_path}/a.jsonl", "id string, n int").collect()} == {"x", "y"}
    (tmp_path / "bad.jsonl").write_text('{"id": "x"}\nnot json\n')
    try:
        files.json_lines(spark, f"{tmp_path}/bad.jsonl", "id string").collect()
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "bad.jsonl:2" in str(e)
    kept = files.json_lines(spark, f"{tmp_path}/bad.jsonl", "id string", strict=False)
    assert kept.where("_corrupt_record is not null").count() == 1
    (tmp_path / "b.json").write_text('[{"id": "p"}, {"id": "q"}]')
    assert files.json_array(spark, f"{tmp_path}/b.json", "id string").count() == 2
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.md").write_text("# t")
    assert [(r["stem"], r["text"]) for r in files.text_files(spark, str(tmp_path)).collect()] == [("n", "# t")]
    (tmp_path / "c.csv").write_text("ID,name\n1.0,a\n2,b\n")
    assert sorted(r["ID"] for r in files.csv_cases(spark, f"{tmp_path}/c.csv").collect()) == [1, 2]
    out = files.json_lines(spark, f"{tmp_path}/a.jsonl", "id string, n int")
    files.write_json(out, f"{tmp_path}/out")
    try:
        files.write_json(out, f"{tmp_path}/out")
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "exist" in str(e)
    files.write_json(out, f"{tmp_path}/out", overwrite=True)
    files.append(out, f"{tmp_path}/log")
    files.append(out, f"{tmp_path}/log")
    files.copy(spark, f"{tmp_path}/log", f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 4
    assert files.checksums(spark, f"{tmp_path}/sub").first()["length"] == 3


def test_case_steps(spark):
    rows = [("c", 'Step1: "home"\nStep2: list\nStep3: item', "Step1: tap\nStep2: open")]
    got = files.case_steps(spark.createDataFrame(rows, "case_id string, pages string, actions string")).orderBy("step_id").collect()
    assert [tuple(r) for r in got] == [("c", 1, "'home'", "tap", "list"), ("c", 2, "list", "open", "item")]


def test_nested_families_round_trip(spark):
    flat = [("f", "a", "EQUIVALENT", None), ("f", "b", "VARIANT", 0), ("f", "c", "VARIANT", 1), ("g", "d", "EQUIVALENT", None)]
    df = spark.createDataFrame(flat, "family_id string, member_id string, member_type string, group_index int")
    assert sorted(map(tuple, catalog.unnest(catalog.nest(df)).collect()), key=str) == sorted(flat, key=str)


def test_stages_are_skipped_when_their_tables_are_there_and_manifests_say_so(spark, tmp_path):
    from ruleloom.plans import stages

    root, calls = f"file://{tmp_path}/root", []
    given = {"a": spark.range(5)}
    steps = [stages.Step("b", ("a",), lambda t: calls.append("b") or t["a"].where("id > 1")), stages.Step("c", ("a", "b"), lambda t: calls.append("c") or t["b"].unionAll(t["a"]))]
    planned = stages.run_stage(spark, root, 2, steps, given, dry_run=True)
    assert set(planned) == {"a"} and calls == []
    assert stages.run_stage(spark, root, 2, steps, given)["c"].count() == 8
    stages.run_stage(spark, root, 2, steps, given)
    assert calls == ["b", "c"]
    stages.run_stage(spark, root, 2, steps, given, overwrite=True)
    assert calls == ["b", "c"] * 2
    bad = stages.Step("d", ("b",), lambda t: t["b"].select("missing"))
    with pytest.raises(Exception, match="missing"):
        stages.run_stage(spark, root, 2, [bad], given | {"b": given["a"]})
    lines = [json.loads(x) for r in stages.summaries(spark, root).collect() for x in r["content"].splitlines()]
    assert sorted((x["step"], x["status"]) for x in lines) == sorted([("b", "success"), ("c", "success")] * 2 + [("b", "skipped"), ("c", "skipped"), ("d", "failed")])
    assert len({x["inputs"]["a"] for x in lines if "a" in x["inputs"]}) == 1
    assert stages.fingerprint(spark.range(5)) == stages.fingerprint(spark.range(4, -1, -1)) != stages.fingerprint(spark.range(6))


def test_archives_with_unsafe_members_or_wrong_checksums_are_refused(spark):
    def packed(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, "x")
        return out.getvalue()

    frame = lambda name: spark.createDataFrame([("p", packed(name))], "path string, content binary")
    assert [(r["member"], bytes(r["data"])) for r in files.unzipped(frame("a/b.txt")).collect()] == [("a/b.txt", b"x")]
    for name in ("../b", "/b", "a/../../b", "C:/b"):
        with pytest.raises(Exception, match="unsafe member"):
            files.unzipped(frame(name)).collect()
    with pytest.raises(Exception, match="wrong checksum"):
        files.unzipped(frame("a"), expected=spark.createDataFrame([("p", "00")], "path string, sha256 string")).collect()


def test_rest_source_tries_again_and_keeps_urls_that_fail(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            code = 404 if self.path == "/gone" else 503 if seen.count(self.path) < 3 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"html_url": "u" + self.path, "title": "t", "body": None}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(files.IssueSource)
    urls = [f"http://127.0.0.1:{server.server_port}/{x}" for x in ("one", "gone")]
    rows = {r["url"]: r for r in spark.read.format("rest_issues").option("urls", json.dumps(urls)).option("pause", "0").load().collect()}
    server.shutdown()
    assert rows["u/one"]["title"] == "t" and rows["u/one"]["error"] is None
    assert "404" in rows[urls[1]]["error"] and seen.count("/gone") == 1 and seen.count("/one") == 3


def test_a_bad_line_is_named_by_file_and_number(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text("".join(f'{{"id": {i}}}\n' for i in range(500)))
    (tmp_path / "bad.jsonl").write_text("".join('not json\n' if i == 321 else "\n" if i % 50 == 0 else f'{{"id": {i}}}\n' for i in range(1, 400)))
    given = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = files.numbered_lines(spark, f"{tmp_path}/*.jsonl")
        assert lines.rdd.getNumPartitions() > 4
        found = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in lines.collect()}
        assert len(found) == 899 and found["ok.jsonl", 500] == '{"id": 499}' and found["bad.jsonl", 321] == "not json" and found["bad.jsonl", 50] == ""
        loose = files.json_lines(spark, f"{tmp_path}/*.jsonl", "id long", strict=False).where("_corrupt_record is not null").collect()
        assert [(r["_file"].rsplit("/", 1)[1], r["_line"]) for r in loose] == [("bad.jsonl", 321)]
        with pytest.raises(Exception, match=r"bad\.jsonl:321"):
            files.json_lines(spark, f"{tmp_path}/*.jsonl", "id long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", given)
    assert files.json_lines(spark, f"{tmp_path}/ok.jsonl", "id long").count() == 500


def test_a_store_of_bodies_is_called_once(spark, tmp_path):
    log, store = tmp_path / "log", f"{tmp_path}/store"

    def get(url, run="a"):
        with log.open("a") as f:
            f.write(url + "\n")
        if url == "u2" and run == "a":
            raise ConnectionError("lost")
        return run + url

    rows = spark.createDataFrame([("1", "u1"), ("2", "u1"), ("3", "u2"), ("4", None)], "id string, url string")
    look = lambda df: {r["id"]: (r["status"], r["body"], r["error"]) for r in df.collect()}
    assert {s for s, *_ in look(files.fetched(rows, store, get, dry_run=True)).values()} == {"missing"} and not log.exists()
    assert look(files.fetched(rows, store, get)) == {"1": ("fetched", "au1", None), "2": ("fetched", "au1", None), "3": ("failed", None, "lost"), "4": ("failed", None, "no url")}
    assert sorted(log.read_text().split()) == ["u1", "u2"]
    again = look(files.fetched(rows, store, lambda url: get(url, "b")))
    assert again["1"] == ("cached", "au1", None) and again["3"] == ("fetched", "bu2", None)
    assert sorted(log.read_text().split()) == ["u1", "u2", "u2"]
    files.fetched(rows, store, get)
    assert len(log.read_text().split()) == 3  # nothing is left to call
    (tmp_path / "store" / "aside-broken").mkdir()
    assert look(files.fetched(rows, store, lambda url: get(url, "c"), overwrite=True))["1"] == ("fetched", "cu1", None)
    assert look(files.fetched(rows, store, get))["1"] == ("cached", "cu1", None)


def test_the_offline_answers_read_the_report_as_it_was_given(spark):
    from pyspark.sql import functions as F

    from ruleloom.functions import text
    from ruleloom.plans import stages

    bodies = ["x" * 399, "x" * 400, "  " + "x" * 399 + "  ", "y" * 500 + "\n\n# more\nz", "x" * 398 + "\n\n"]
    given = spark.createDataFrame([(f"D{i}", "s", f"u{i}", f"title {i}", b) for i, b in enumerate(bodies)], "id string, source string, url string, title string, body string")
    prompts = given.select("id", text.fill_template(stages.PROMPT, "{{REPORT}}", text.issue_markdown(F.col("title"), F.col("url"), F.col("body"))).alias("prompt"))
    found = {r["id"]: json.loads(r["answer"].split("\n", 2)[2][:-4]) for r in stages.offline_answers(prompts).collect()}
    for i, b in enumerate(bodies):
        assert found[f"D{i}"] == {"is_violation": len(b.strip(" ")) >= 400, "violated": {"situation": f"title {i}", "rule": b.strip(" "), "domain": "app"}}


def test_recall_orders_only_the_best_of_a_large_catalog():
    import time

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(20_000, 8)), 1) + 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::7] = x[0]  # ties
    state = serial.State()
    for n, v in enumerate(x):
        state.put(serial.Family(f"F{n}", None, v))
    for q in (x[0], x[1]):
        scores = np.round(x @ q, 6)
        want = sorted(range(len(x)), key=lambda i: (-scores[i], f"F{i}"))
        for k in (1, 20, 30_000):
            assert state.recall(q, k) == [(f"F{i}", float(scores[i])) for i in want[:k]]
    began = time.process_time()
    for q in x[1:30_000:700]:
        state.recall(q, 20)
    quick = time.process_time() - began
    began = time.process_time()
    for q in x[1:30_000:700]:
        np.lexsort((np.array(state.names), -np.round(x @ q, 6)))[:20]
    print(f"{quick:.3f} s, by a full sort {time.process_time() - began:.3f} s")
    assert quick < (time.process_time() - began) / 3


def test_a_member_joins_a_large_family_without_sorting_it_anew(monkeypatch):
    family = serial.Family("F", "V0", np.ones(1), [f"V{i}" for i in range(0, 4_000, 2)], [[f"V{i}" for i in range(1, 4_000, 2)]])
    calls, natural = [], serial.natural
    monkeypatch.setattr(serial, "natural", lambda u: calls.append(u) or natural(u))
    as_equal = serial._changed(family, "V1001", serial.Generalisation("EQUIVALENT"))
    in_group = serial._changed(family, "V1000", serial.Generalisation("ADD_TO_EXISTING_GROUP", 0))
    assert len(calls) < 60
    assert as_equal.equivalent == sorted([*family.equivalent, "V1001"], key=natural) and as_equal.groups == family.groups
    assert in_group.groups == [sorted([*family.groups[0], "V1000"], key=natural)] and len(family.groups[0]) == 2_000
