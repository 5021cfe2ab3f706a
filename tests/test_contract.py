import json

import pytest

from helpers import document
from watchlake.operators.contract import error_text, validate_contract
from watchlake.plans import medallion

# payload, codes of the structural rules, further codes of the full rule set
CASES = [
    (document(), [], []),
    (document(device_type=..., playback_position=...), [], []),
    (document(schema_name=...), ["missing:schema_name"], []),
    (document(event_time=...), ["missing:event_time"], []),
    (document(event_id=5), ["type:event_id"], []),
    (document(user_id=None), ["type:user_id"], []),
    (document(playback_position="7"), ["type:playback_position"], []),
    (document(playback_position=1.5), ["type:playback_position"], []),
    (document(playback_position=1.0), [], []),
    (document(playback_position=99999999999), [], []),
    (document(playback_position=True), ["type:playback_position"], []),
    (document(device_type={"a": 1}), ["type:device_type"], []),
    (document(event_type="Unknown Event"), ["enum:event_type"], []),
    (document(event_type=3), ["type:event_type", "enum:event_type"], []),
    (document(schema_name="other"), ["const:schema_name"], []),
    (document(schema_version=2), ["const:schema_version"], []),
    (document(event_version=0), ["range:event_version"], []),
    (document(event_header_reemission=-1), ["range:event_header_reemission"], []),
    (document(playback_position=-1), ["range:playback_position"], []),
    (document(completion_percent=101), ["range:completion_percent"], []),
    (document(watch_duration_sec=-5), ["range:watch_duration_sec"], []),
    (document(zeta=1, extra=None), ["unknown:extra,zeta"], []),
    (document(session_id=""), [], ["blank:session_id"]),
    (document(platform=""), [], ["blank:platform"]),
    (document(event_time="yesterday"), [], ["format:event_time"]),
    (document(event_time="12:30"), [], ["format:event_time"]),
    (document(event_time="2024-02-30T00:00:00"), [], ["format:event_time"]),
    (document(event_time="2024-02-28T00:00:00+02:00"), [], []),
    (document(event_type="pause"), [], ["requires:pause_reason"]),
    (document(event_type="resume", resume_reason=...), [], ["requires:resume_reason"]),
    (document(event_type="abandoned", pause_reason="x"), [], ["requires:abandoned_reason"]),
    (document(event_type="pause", pause_reason="x"), [], []),
    (document(event_type="completed"), [], ["requires:completion_percent"]),
    (document(event_type="completed", completion_percent=99), [], ["incomplete:completion_percent"]),
    (document(event_type="completed", completion_percent=100), [], []),
]
TEXTS = [("not json", ["malformed"]), ("[1]", ["malformed"]), ("", ["malformed"]), (None, ["malformed"])]


def violations(spark, texts, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, raw_value STRING")
    rows = validate_contract(df, rules).orderBy("i").collect()
    assert len(rows) == len(texts)
    return [list(r.violations) for r in rows]


def test_structural_rules(spark):
    got = violations(spark, [json.dumps(c[0]) for c in CASES], "json_schema")
    assert got == [c[1] for c in CASES]


def test_full_rules(spark):
    got = violations(spark, [json.dumps(c[0]) for c in CASES], "full")
    assert [sorted(g) for g in got] == [sorted(c[1] + c[2]) for c in CASES]


@pytest.mark.parametrize("rules", ["json_schema", "full"])
def test_text_that_is_no_object(spark, rules):
    assert violations(spark, [t[0] for t in TEXTS], rules) == [t[1] for t in TEXTS]


def test_an_empty_object_misses_all_required_fields(spark):
    (codes,) = violations(spark, ["{}"], "json_schema")
    assert len(codes) == 10 and all(c.startswith("missing:") for c in codes)


def test_rule_set_must_exist(spark):
    with pytest.raises(ValueError):
        violations(spark, ["{}"], "lenient")


def test_filter_on_violations_does_not_repeat_the_parse(spark):
    df = spark.createDataFrame([("k", "{}")], "event_key STRING, raw_value STRING")
    letters = medallion.dead_letters(df)
    assert letters._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    assert letters.first().error.startswith("missing:schema_name; missing:schema_version")


def test_error_text(spark):
    df = spark.createDataFrame([(["a", "b"],)], "violations ARRAY<STRING>")
    assert df.select(error_text().alias("e")).first().e == "a; b"


def test_no_step_of_the_check_is_left_to_the_interpreter(spark, tmp_path):
    spark.createDataFrame([("{}",)], "raw_value string").write.parquet(str(tmp_path / "rows"))
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rules in ("json_schema", "full"):
            checked = validate_contract(spark.read.parquet(str(tmp_path / "rows")), rules)
            plan = checked._jdf.queryExecution().executedPlan()
            compiled = debug.codegenStringSeq(plan)
            # The step that parses is the only one with an expression that Spark does not compile.
            assert [line for line in plan.toString().splitlines() if "Generate inline" in line and "*(" not in line.split("Generate")[0] and "from_json" not in line] == []
            # The JVM interprets methods of over 8,000 bytes.
            assert compiled.size() and max(compiled.apply(i)._3().maxMethodCodeSize() for i in range(compiled.size())) <= 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
