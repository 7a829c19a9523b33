import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from test_windows import BASE
from wardlog.constants import FEATURES
from wardlog.operators import clusters, correlate, exposure, forest, geo, maintenance, pages, quality
from wardlog.operators import statistics as stats
from wardlog.operators.features import feature_vector, ip_features
from wardlog.plans import importing, reports, training
from wardlog.sources import connections, fixtures, logs, tables
from wardlog.sources.rules import builtin_rules

ALIGNED = BASE - BASE % 60


def web(seq, at, status=200, url="/ab", ip="1.1.1.1", ua="ua"):
    return {"seq": seq, "epoch": ALIGNED + at, "src_ip": ip, "log_type": "web", "url": url,
            "status_code": status, "user_agent": ua, "detail": {}, "raw": ""}


def one(spark, rows, **more):
    return ip_features(brute.make_events(spark, rows), **more).first()


def test_intervals_and_entropy(spark):
    row = one(spark, [web(i, i * 10, (200, 404, 500, 302)[i % 4]) for i in range(5)])
    assert (row.interval_mean, row.interval_std, row.events) == (10.0, 0.0, 5.0)
    even = one(spark, [web(i, i, (200, 404, 500, 302)[i % 4]) for i in range(8)])
    assert even.status_entropy == 2.0
    uneven = one(spark, [web(0, 0), web(1, 1), web(2, 9), web(3, 9)])
    gaps = [1, 8, 0]
    mean = round(sum(gaps) / 3, 3)
    assert uneven.interval_mean == mean and uneven.interval_std == round(
        math.sqrt(sum((g - mean) ** 2 for g in gaps) / 2), 3)


def test_ratios_and_lengths(spark):
    rows = [web(0, 0, url="/ab"), web(1, 1, 404, url="/abcd"),
            {"seq": 2, "epoch": ALIGNED + 2, "src_ip": "1.1.1.1", "log_type": "ssh",
             "detail": {"event": "failed"}, "username": "a", "raw": "%%"}]
    row = one(spark, rows)
    assert (row.url_avg_len, row.error_ratio, row.uniq_usernames, row.uniq_uas) == (4.0, 0.5, 1, 1)
    assert row.fail_ratio == round(2 / 3, 4)
    assert row.special_char_ratio == round(4 / (4 + 6 + 3), 6)
    split = ip_features(brute.make_events(spark, rows + [web(9, 61)]), min_events=2)
    assert split.count() == 1


def test_median_and_explanation(spark):
    frame = spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate([5, 1, 9, 3, 100, 4])],
                                  "id int, a double, b double")
    got = {r.feature: r for r in stats.medians(frame, ("a", "b")).collect()}
    assert got["a"].baseline == 4.5 and got["b"].baseline == 1.0
    assert got["a"].std == pytest.approx(np.std([5, 1, 9, 3, 100, 4]))
    top = stats.explain(frame, stats.medians(frame, ("a", "b")), ("a", "b"), 1)
    assert top.where("id = 4").first().top_features[0].feature == "a"


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0), (0.9, 1)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    frame = spark.createDataFrame(rows, "score double, label int")
    assert stats.roc_auc(frame).first().auc == pytest.approx(want)
    single = spark.createDataFrame([(0.3, 1)], "score double, label int")
    assert stats.roc_auc(single).first().auc is None
    assert stats.confusion(single, 0.5).first().f1 == 0.0


def test_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(600)]
    rows += [(1000 + i, [9.0 + i, -9.0, 9.0, 9.0]) for i in range(3)]
    frame = spark.createDataFrame(rows, "id bigint, features array<double>").repartition(5)
    model = forest.train(frame, ("id",), trees=60)
    again = forest.train(frame.repartition(3), ("id",), trees=60)
    assert model.nodes.equals(again.nodes)
    forest.fit_bounds(model, forest.with_raw_scores(model, frame))
    scored = forest.predict(model, frame).orderBy(F.desc("anomaly_score")).collect()
    assert {r.id for r in scored[:3]} == {1000, 1001, 1002}
    assert scored[0].anomaly_score == 1.0 and scored[-1].anomaly_score == 0.0
    folder = tempfile.mkdtemp()
    model.save(spark, folder)
    loaded = forest.Forest.load(spark, folder)
    assert loaded.nodes.equals(model.nodes) and loaded.high == model.high
    with pytest.raises(ValueError):
        forest.train(frame.limit(5), ("id",))


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c * 10 + rng.normal()), float(-c * 10 + rng.normal())])
            for i, c in enumerate([0, 1, 2] * 30)]
    frame = spark.createDataFrame(rows, "id int, features array<double>")
    made = clusters.cluster(frame, k_range=(2, 4), restarts=2)
    assert made.k == 3 and made.silhouette > 0.8
    assert clusters.outliers(made.rows, 4).count() == 4
    from pyspark.ml.evaluation import ClusteringEvaluator
    judge = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster")
    assert made.silhouette == round(judge.evaluate(made.rows), 4)


def test_clusters_of_few_values(spark):
    """Fewer values than clusters, one value only, repeated rows, too few rows."""
    def frame(*values):
        return spark.createDataFrame([(i, [float(v), 1.0]) for i, v in enumerate(values)], "id int, features array<double>")

    two = clusters.cluster(frame(*[0, 1] * 5), k_range=(2, 4), restarts=2)
    assert (two.k, two.silhouette) == (2, 1.0) and two.rows.agg({"distance": "max"}).first()[0] == 0.0
    one = clusters.cluster(frame(*[3] * 8), k=4, restarts=2)
    assert (one.k, one.silhouette) == (1, 0.0) and one.rows.where("cluster = 0").count() == 8
    with pytest.raises(ValueError):
        clusters.cluster(frame(1, 2, 3), k=2)


def test_connection_files(spark):
    folder = tempfile.mkdtemp()

    def line(protocol, label, extra=""):
        cells = ["0"] * 41
        cells[1:4] = [protocol, "http", "SF"]
        cells[4] = "bad"
        return ",".join(cells + [label]) + extra

    for name, lines in (("train", [line("tcp", "normal"), line("udp", " Normal ", ",21")]),
                        ("test", [line("udp", "neptune", ",3"), line("icmp", "smurf")])):
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    train, test = connections.load_pair(spark, f"{folder}/train", f"{folder}/test")
    assert [r.y for r in train.collect()] == [0, 0] and [r.y for r in test.collect()] == [1, 1]
    codes = {r.label: r.protocol_type for r in test.collect()}
    assert codes == {"neptune": 1.0, "smurf": 2.0}      # train: tcp 0, udp 1; unseen last
    assert connections.profile(train).first().asDict() == {
        "samples": 2, "features": 41, "normal": 2, "attack": 0, "attack_ratio": 0.0}


def test_addresses(spark):
    cases = {"172.31.255.1": "internal", "172.32.0.1": "unknown", "8.8.8.8": "unknown",
             "171.208.1.1": "domestic", "203.0.113.9": "reserved", "x": "unknown",
             " 10.1.1.1 ": "internal", "::1": "unknown", "1.2.3.400": "unknown"}
    frame = spark.createDataFrame([(k,) for k in cases], "src_ip string")
    got = {r.src_ip: r for r in geo.locate(frame, geo.builtin_ranges(spark)).collect()}
    assert {k: r.category for k, r in got.items()} == cases
    assert got["171.208.1.1"].province == "四川" and got["x"].label != got["::1"].label
    nested = geo.with_bounds(spark.createDataFrame(
        [("10.0.0.0/8", "wide", None, "internal"), ("10.1.0.0/16", "narrow", None, "reserved")],
        "cidr string, label string, province string, category string"))
    got = geo.locate(frame.where("src_ip like '%10.1%'"), nested).first()
    assert got.label == "narrow"


def test_correlation_window_and_class(spark):
    findings = spark.createDataFrame(
        [(1, 1, "sqli", "high", "http://t/product.php", "id"), (2, 1, "cve_match", "mid", "http://t/", "")],
        "finding_id bigint, task_id bigint, vuln_type string, severity string, url string, "
        "param string")
    attack = "/product.php?id=1+UNION+SELECT+1"
    rows = [web(0, 0, url=attack), web(1, 0, url="/product.php?id=2"), web(2, 0, url="/news?id=1"),
            web(3, -26 * 3600, url=attack)]
    events = brute.make_events(spark, rows)
    now = F.timestamp_add("SECOND", F.lit(ALIGNED + 3600), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    assert [r.seq for r in correlate.related_events(findings, events, now).collect()] == [0]
    assert [r.finding_id for r in correlate.exploited(findings, events, now).collect()] == [1]
    urls = spark.createDataFrame([("/product.php?x=9",)], "url string")
    assert correlate.findings_for_urls(urls, findings).first().finding_id == 1


def test_versions_and_headers(spark):
    def lt(a, b):
        return spark.range(1).select(exposure.version_lt(
            exposure.parse_version(F.lit(a)), exposure.parse_version(F.lit(b)))).first()[0]

    assert lt("1.12.4", "3.5.0") and not lt("1.24", "1.24.0") and lt("9", "10.0")
    page = spark.createDataFrame([(1, {"x-frame-options": "ALLOW-FROM http://a", "Server": "nginx"},
                                   "<script src=jquery-1.12.4.min.js>")],
                                 "page_id bigint, headers map<string,string>, body string")
    kinds = {r.header: r.kind for r in exposure.header_audit(page).collect()}
    assert kinds["X-Frame-Options"] == "weak" and kinds["Referrer-Policy"] == "missing"
    found = exposure.technologies(page)
    assert {(r.name, r.version) for r in found.collect()} == {("jQuery", "1.12.4"), ("nginx", None)}
    assert exposure.vulnerable_components(found).first().fixed_in == "3.5.0"


def test_sensitive_file_evidence(spark):
    rows = [("h", "/.ENV", 200, {}, "x\nSECRET_KEY=1\n"), ("h", "backup.zip", 200, {}, "PK\x03\x04z"),
            ("h", ".env", 404, {}, "SECRET_KEY=1"), ("h", "admin", 200, {}, "nothing")]
    frame = spark.createDataFrame(
        rows, "host string, path string, status int, headers map<string,string>, body string")
    got = {r.path: r for r in exposure.sensitive_files(frame).collect()}
    assert set(got) == {"/.ENV", "backup.zip"}
    assert got["/.ENV"].is_variant and "SECRET_KEY=1" in got["/.ENV"].evidence
    leak = spark.range(1).select(exposure.leaked_file(F.lit("a root:x:0:0:root"), F.lit("none")))
    assert leak.first()[0].matched == "root:x:0:0:"


def test_form_and_link_targets(spark):
    body = ('<a href="/p?id=1&id=2&token=x">a</a><a href="//h.org/q?a=">b</a><a href="http://o/x?y=1">'
            '<form action="s?cat=1"><input name=q value="v"><input type=file name=f></form>')
    frame = spark.createDataFrame([(1, "http://h.org/dir/page", body)],
                                  "page_id bigint, url string, body string")
    links = pages.links(frame)
    assert [r.link for r in links.orderBy("position").collect()] == [
        "http://h.org/p?id=1&id=2&token=x", "http://h.org/q?a="]
    every = pages.link_parameters(links).unionByName(pages.form_parameters(frame))
    got = {(r.method, r.url, r.param): r.params for r in pages.first_targets(every).collect()}
    assert got == {("GET", "http://h.org/p", "id"): {"id": "2"},
                   ("GET", "http://h.org/q", "a"): {"a": ""},
                   ("GET", "http://h.org/s", "q"): {"q": "v", "cat": "1"},
                   ("GET", "http://h.org/s", "cat"): {"q": "v", "cat": "1"}}


def test_reply_parsing_and_agreement(spark):
    texts = ['```json\n{"severity_assessment":"高危","analysis":"a","recommendation":"r"}\n```',
             "no json", '{"analysis": "only"}']
    frame = spark.createDataFrame([(t, s) for t, s in zip(texts, ("high", "low", "mid"))],
                                  "output string, rule_severity string")
    rows = quality.parse_reply(frame).collect()
    assert [r.parse_error for r in rows] == [False, True, False] and rows[1].raw == "no json"
    assert quality.structured_usability(frame).first()["usable"] == 1
    agreed = quality.agreement(frame).first()
    assert (agreed.total, agreed.strict, agreed.unrecognized, agreed.strict_rate) == (3, 1, 2, 0.3333)


def test_longest_range_by_one_join(spark):
    """Random nested ranges of all prefix lengths against a search through the list."""
    import ipaddress
    import random
    rng = random.Random(5)
    nets = [ipaddress.ip_network((rng.choice((10 << 24, 0, rng.randrange(1 << 32))) & ~((1 << (32 - n)) - 1), n))
            for n in [rng.randrange(33) for _ in range(80)]] + [ipaddress.ip_network("10.0.0.0/8")] * 2
    ranges = spark.createDataFrame([(str(n), f"label {i}", None, "x") for i, n in enumerate(nets)],
                                   "cidr string, label string, province string, category string")
    ips = [str(ipaddress.ip_address(x)) for x in [0, (1 << 32) - 1, 10 << 24, *[rng.randrange(1 << 32) for _ in range(200)],
                                                  *[int(n[0]) for n in nets], *[int(n[-1]) for n in nets]]]
    df = spark.createDataFrame([(x,) for x in [*ips, None, "nonsense", "::1"]], "src_ip string")
    located = geo.locate(df, geo.with_bounds(ranges))
    assert located._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1

    def best(ip):
        holding = [(-n.prefixlen, f"label {i}") for i, n in enumerate(nets) if ipaddress.ip_address(ip) in n]
        return min(holding)[1] if holding else geo.UNKNOWN_LABEL

    want = {ip: best(ip) for ip in ips} | {None: geo.INVALID_LABEL, "nonsense": geo.INVALID_LABEL, "::1": geo.UNKNOWN_LABEL}
    assert {r.src_ip: r.label for r in located.collect()} == want


def test_ranks_of_crowded_values_are_dealt_evenly(spark):
    """Nearly all values lie in a thousandth of their range."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 100 == 0, F.col("id") * 1e6).otherwise(F.col("id") * 1e-3).alias("x"))
    from wardlog.operators.timeline import in_even_parts
    parts = [r["count"] for r in in_even_parts(rows, "x").groupBy("_part").count().collect()]
    assert len(parts) > 1 and max(parts) < 2 * sum(parts) / len(parts)
    values = sorted(r.x for r in rows.collect())
    got = stats.medians(rows, ["x"]).first()
    assert got.baseline == (values[9999] + values[10000]) / 2
    scored = rows.select(F.col("x").alias("score"), (F.col("x") > 15).cast("int").alias("label"))
    assert stats.roc_auc(scored).first().auc == 1.0


def test_retention_and_sinks(spark):
    folder = tempfile.mkdtemp()
    events = fixtures.security_events(spark, "/root/testdata/sf0.001").drop(
        "k", "event_type", "value", "user_id")
    tables.append_events(events, folder)
    stored = tables.read(spark, folder)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    kept = maintenance.retained(stored, now, "7")
    assert 0 < kept.count() < stored.count() == events.count()
    assert "PartitionFilters: [isnotnull(event_date" in kept._jdf.queryExecution().toString()
    undated = stored.limit(1).withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "event_date": F.lit(None).cast("date")})
    assert maintenance.retained(stored.unionByName(undated), now, "7").count() == kept.count() + 1
    assert maintenance.retention_days("x") == 30 and maintenance.retention_days("9") == 9
    results = spark.createDataFrame([("a", 1), ("b", 2)], "algo string, x int")
    out = tempfile.mkdtemp()
    tables.replace_partition(results, out, "algo")
    tables.replace_partition(results.where("algo = 'a'").withColumn("x", F.lit(9)), out, "algo")
    assert {(r.algo, r.x) for r in tables.read(spark, out).collect()} == {("a", 9), ("b", 2)}


def test_import_job(spark):
    lines = fixtures.log_lines(spark, "/root/testdata/sf0.001")
    bad = spark.createDataFrame([(10 ** 6, "noise"), (10 ** 6 + 1, " ")], "seq bigint, value string")
    out = tempfile.mkdtemp()
    result = importing.import_lines(lines.unionByName(bad), builtin_rules(3 * 86400, 2), out,
                                    year=fixtures.YEAR, source_id=7)
    assert (result.parsed, result.rejected) == (lines.count(), 1)
    assert result.alerts > 0 and result.matched >= result.alerts
    assert importing.rejected_lines(spark, out).first().raw == "noise"
    assert spark.read.parquet(f"{out}/alerts").count() == result.alerts


def test_two_imports_are_one_import_of_both(spark, tmp_path):
    """A source in two files, the second of which continues an alert of the first."""
    lines = fixtures.log_lines(spark, "/root/testdata/sf0.001")
    rules = builtin_rules(3 * 86400, 2)
    columns = ("title", "src_ip", "count", "first_seen", "last_seen")
    told = lambda out: sorted(map(tuple, spark.read.parquet(f"{out}/alerts").select(*columns).collect()), key=str)
    whole = importing.import_lines(lines, rules, str(tmp_path / "a"), year=fixtures.YEAR)
    parts = [lines.where("seq < 500"), lines.where("seq >= 500")]
    results = [importing.import_lines(p, rules, str(tmp_path / "b"), year=fixtures.YEAR, run=i) for i, p in enumerate(parts)]
    assert told(tmp_path / "b") == told(tmp_path / "a")
    assert sum(r.matched for r in results) == whole.matched and sum(r.alerts for r in results) == whole.alerts
    again = importing.import_lines(parts[1], rules, str(tmp_path / "b"), year=fixtures.YEAR, run=1)
    assert (again.matched, again.alerts) == (0, 0) and told(tmp_path / "b") == told(tmp_path / "a")


def test_lines_of_text_files_are_numbered(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"one\ntwo \xff\nthree\n")
    rows = logs.read_lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.value for r in rows] == ["one", "two \ufffd", "three"] and len({r.seq for r in rows}) == 3


def test_ranges_and_windows_are_taken_as_given(spark):
    as_of = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    alerts = spark.createDataFrame([("1.1.1.1", 1709251200 - 40 * 86400, None), ("2.2.2.2", 1709251200 - 60 * 86400, None)],
                                   "src_ip string, last_seen bigint, source_type string")
    got = reports.baseline_labels(alerts.select("src_ip"), alerts, as_of, hours=50 * 24)
    assert {r.src_ip: r.y for r in got.collect()} == {"1.1.1.1": 1, "2.2.2.2": 0}
    events = alerts.select(F.timestamp_seconds("last_seen").cast("timestamp_ntz").alias("ts"), "src_ip")
    assert [r.src_ip for r in reports.training_events(events, as_of, 50 * 24).collect()] == ["1.1.1.1"]
    made = fixtures.security_events(spark, "/root/testdata/sf0.001")
    detected = training.train_and_detect(made, alerts, window=7200, n_trees=5)
    assert detected.summary.first().samples == ip_features(made, 7200).count()
    with pytest.raises(ValueError):
        training.train_and_detect(made, alerts, window=0)


def test_train_and_detect(spark):
    events = fixtures.security_events(spark, "/root/testdata/sf0.001")
    from wardlog.catalog import base
    made = training.train_and_detect(events, base.alerts(spark, "/root/testdata/sf0.001"),
                                     window=3600, n_trees=20)
    summary = made.summary.first()
    assert summary.samples == ip_features(events, 3600).count() and summary.anomalies > 0
    row = made.detections.orderBy(F.desc("anomaly_score")).first()
    assert set(row.feature_vector) == set(FEATURES) and len(row.top_features) == 3
    assert made.alerts.where("source_type = 'ml'").count() == made.alerts.count() > 0
    evaluation = made.evaluation.first()
    assert evaluation.n_samples == summary.samples
    assert evaluation.auc is None or 0 <= evaluation.auc <= 1
    assert feature_vector(ip_features(events, 3600)).first().features is not None


def test_published_models_explain_as_when_trained(spark, tmp_path):
    from wardlog.plans import models
    from wardlog.catalog import base
    folder, out = "/root/testdata/sf0.001", str(tmp_path)
    from wardlog.session import materialise
    events, alerts = fixtures.security_events(spark, folder), materialise(base.alerts(spark, folder))
    with pytest.raises(ValueError):
        models.run_scoring(events, out)
    told = models.run_training(events, alerts, out, "first", base.as_of(), hours=0, window=3600, n_trees=5, k=3).collect()
    assert {r.algo: (r.samples, r.k) for r in told} == {
        "isolation_forest": (ip_features(events, 3600).count(), None), "kmeans": (ip_features(events, 3600).count(), 3)}
    assert told[0].basis_ips == alerts.select("src_ip").distinct().count() and told[0].events == events.count()
    stored = tables.read(spark, f"{out}/detections").select("algo", "src_ip", "epoch", "anomaly_score", "cluster", "distance", "top_features")
    again = models.run_scoring(events, out).select(*stored.columns)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(stored) == rows(again) and stored.where("algo = 'kmeans'").count() == told[0].samples
    from wardlog.operators.clusters import cluster
    made = {(r.src_ip, r.bucket): (r.cluster, round(r.distance, 6)) for r in cluster(
        feature_vector(ip_features(events, 3600)), k=3).rows.collect()}
    assert made == {(r.src_ip, r.epoch): (r.cluster, round(r.distance, 6)) for r in stored.where("algo = 'kmeans'").collect()}
    # a second version takes over with its pointer; the first can still be asked for
    models.run_training(events, alerts, out, "second", base.as_of(), hours=0, window=7200, n_trees=2, also_kmeans=False)
    assert models.Model.load(spark, f"{out}/models").window == 7200
    assert models.Model.load(spark, f"{out}/models", "first").window == 3600
    assert tables.read(spark, f"{out}/detections").where("algo = 'isolation_forest'").count() == ip_features(events, 7200).count()
    assert tables.read(spark, f"{out}/model_runs").count() == 3
