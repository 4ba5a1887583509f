"""Two-valued, case-blind predicates on one event."""

from pyspark.sql import functions as F

from emberwatch.operators import predicates as P

ROW = (
    "web", "request", "failure", "203.0.113.5", "/api/v1/orders?id=1 UNION SELECT null", 404,
    "J.Harper", None, None,
)
SCHEMA = (
    "source string, action string, status string, src_ip string, path string, "
    "http_status int, user string, dst_ip string, event_id int"
)
CASES = [
    (P.eq("user", "j.harper"), True), (P.eq("user", "J.HARPER"), True),
    (P.ne("user", "root"), True), (P.eq("http_status", 404), True),
    (P.eq("http_status", "404"), True), (P.eq("http_status", "404.0"), False),
    (P.ge("http_status", 400), True), (P.gt("http_status", 404), False),
    (P.gt("user", 0), False), (P.lt("http_status", "x"), False),
    (P.eq("source", "ssh") & P.eq("status", "success") | P.eq("http_status", 404), True),
    (P.eq("source", "ssh") & (P.eq("status", "success") | P.eq("http_status", 404)), False),
    (~P.eq("source", "ssh"), True),
    (~(P.eq("source", "web") & P.eq("http_status", 404)), False),
    (P.matches("path", r"union\s+select"), True), (P.not_matches("path", "union"), False),
    (P.matches("http_status", "404"), False), (P.not_matches("http_status", "404"), True),
    (P.contains("path", "/API/"), True), (P.contains("http_status", "4"), False),
    (P.one_of("http_status", [401, 403, 404]), True), (P.one_of("http_status", [200]), False),
    (P.one_of("http_status", ["404"]), True), (P.one_of("user", ["x", "j.HARPER"]), True),
    (P.exists("user"), True), (P.exists("dst_ip"), False),
    (P.eq("event_id", 4625), False), (P.gt("event_id", 0), False),
    (P.ne("event_id", 4625), True), (P.not_matches("dst_ip", "x"), True),
    (P.eq("nothing", 1), False), (P.ne("nothing", 1), True), (P.one_of("dst_ip", ["x"]), False),
]


def test_predicates(spark):
    row = spark.createDataFrame([ROW], SCHEMA)
    got = row.select(
        *(p.bind(row.schema).alias(f"c{i}") for i, (p, _) in enumerate(CASES))
    ).first()
    wrong = [i for i, (_, want) in enumerate(CASES) if got[i] is not want]
    assert not wrong


def test_search(spark):
    alerts = spark.createDataFrame(
        [("r", "Rule", "text", "T1", "tag", {"src_ip": "9.9.9.9"}, "high", ["ssh"])],
        "rule_id string, rule_name string, narrative string, mitre_id string, "
        "mitre_name string, entity map<string,string>, severity string, sources array<string>",
    )
    assert P.search_alerts(alerts, "9.9.9").count() == 1
    assert P.search_alerts(alerts, "TAG").count() == 1
    assert P.search_alerts(alerts, "zzz").count() == 0
    assert P.alerts_with(alerts, ["high"], ["web", "ssh"]).count() == 1
    assert P.alerts_with(alerts, [], ["web"]).count() == 0
    row = spark.createDataFrame([ROW], SCHEMA).withColumns(
        {"host": F.lit(None).cast("string"), "msg": F.lit("x"), "raw": F.lit("RAW")}
    )
    assert P.search_events(row, "raw").count() == 1
    assert P.with_sources(row, []).count() == 1
