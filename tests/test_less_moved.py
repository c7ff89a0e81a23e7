"""What doesn't need payloads or whole frames isn't handed them."""

from cairnlog.operators import derive, kv, log
from cairnlog.plans import binary_queries

SF = "/root/testdata/sf0.001"


def test_places_are_found_without_payloads(spark, monkeypatch):
    seen, keydir = [], kv.keydir
    for module in (kv, derive):
        monkeypatch.setattr(module, "keydir", lambda log: seen.append(log) or keydir(log))
    assert binary_queries.binary_items(spark, SF).count() == binary_queries.binary_compact(spark, SF).count() > 0
    assert len(seen) == 2
    for df in seen:
        assert df.count() > 0 and df.where("payload is not null").count() == 0


def test_check_and_reports_read_no_payloads(spark, monkeypatch):
    seen, check, report = [], kv.check, binary_queries.log.recovery_report
    monkeypatch.setattr(kv, "check", lambda df, r: seen.append(df) or check(df, r))
    monkeypatch.setattr(binary_queries.log, "recovery_report", lambda df, *a: seen.append(df) or report(df, *a))
    assert binary_queries.binary_check(spark, SF).first().keys_checked > 0
    assert len(seen) == 2
    for df in seen:
        assert df.where("key is not null").count() > 0 and df.where("payload is not null").count() == 0


def test_strict_check_is_handed_damage_alone(spark, monkeypatch):
    seen, check = [], log.check_frames
    monkeypatch.setattr(log, "check_frames", lambda frames, last: seen.append(frames) or check(frames, last))
    assert binary_queries.binary_scan(spark, SF).count() == 1000
    assert [r.status for r in seen[0].collect()] == ["truncated"]  # the torn tail
